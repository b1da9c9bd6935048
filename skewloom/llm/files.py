"""Whole files in the shared folder, written and read by tasks through the scheme of the path."""

from __future__ import annotations

import uuid

from pyarrow import fs as pafs


def at(path: str) -> tuple[pafs.FileSystem, str]:
    """Spark names the S3 scheme after its connector."""
    for scheme in ("s3a://", "s3n://"):
        if path.startswith(scheme):
            path = f"s3://{path[len(scheme):]}"
    return pafs.FileSystem.from_uri(path)


def sweep(folder: str) -> None:
    """Removes what failed tasks left unfinished, once all tasks are done."""
    fs, name = at(folder)
    for f in fs.get_file_info(pafs.FileSelector(name, allow_not_found=True)):
        if f.path.endswith(".part"):
            fs.delete_file(f.path)


class Writer:
    """A file that appears under its name only when complete; a repeated task replaces it."""

    def __init__(self, path: str):
        self.fs, self.name = at(path)
        self.fs.create_dir(self.name.rpartition("/")[0], recursive=True)
        self.part = f"{self.name}.{uuid.uuid4().hex}.part"
        self.out = self.fs.open_output_stream(self.part)
        self.size = 0

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def close(self) -> None:
        self.out.close()
        self.fs.move(self.part, self.name)


def reader(path: str):
    """A random-access file."""
    fs, name = at(path)
    return fs.open_input_file(name)
