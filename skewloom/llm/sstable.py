"""Token ids in sorted-string tables.

A table file holds documents in ascending order of a binary key: blocks of prefix-compressed keys with
their token ids, a sparse index with the first key of each block, a Bloom filter over the identifiers
and a fixed footer. A lookup reads the footer, asks the filter, binary-searches the sparse index and
reads one block.

File layout (little-endian): ``block*  index  bloom  footer``.
Block: zlib of entries ``shared:u16 rest:u16 n:u32 key-rest ids`` with ids of the width in the footer.
Index: per block ``offset:u64 size:u32 key-length:u16 key``; footer: see ``FOOTER``.

The key is the identifier, sign-flipped and big-endian, then the number of the file and a sequence number, which tell
apart rows of one identifier and rows without one; no key occurs twice. A null identifier sorts first and is flagged in the key.
A null text is empty. Repeated rows are all stored; an empty table gives no file.
"""

from __future__ import annotations

import bisect
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skewloom.session import Scratch

from . import files

MAGIC = b"SKWSST01"
#: index offset, index size, bloom offset, bloom size, documents, tokens, bytes of an id, magic.
FOOTER = struct.Struct("<QQQQQQQ8s")
ENTRY = struct.Struct("<HHI")
INDEX = struct.Struct("<QIH")
KEY = struct.Struct(">BQII")
BLOCK_BYTES = 256 * 1024
BLOOM_BITS, BLOOM_HASHES = 10, 7
#: Text bytes that go into one file.
SHARD_BYTES = 24 << 20
#: Words and other pieces that a worker keeps encoded, in each of two generations.
CACHE_WORDS, CACHE_PIECES = 400_000, 100_000
#: Letters whose lower case is one letter of the same kind, and punctuation that may follow them in a piece.
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
PUNCTUATION = ".,;:!?#*$%&|)"
#: Text that is encoded at a time.
ENCODE_BYTES = 4 << 20

META = T.StructType(
    [T.StructField(n, t) for n, t in (("shard", T.IntegerType()), ("path", T.StringType()), ("n_docs", T.LongType()), ("n_tokens", T.LongType()))]
)


def key_of(doc_id: int | None, shard: int, seq: int) -> bytes:
    return KEY.pack(doc_id is not None, 0 if doc_id is None else doc_id + (1 << 63), shard, seq)


def id_of(key: bytes) -> int | None:
    known, number, *_ = KEY.unpack(key)
    return number - (1 << 63) if known else None


def _byte_letters() -> dict[int, str]:
    """The printable stand-ins of byte-level models: printable Latin-1 stays, other bytes follow from 256."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in keep]
    return {b: chr(b) for b in keep} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Memory:
    """A bounded map in two generations: when the younger is full it becomes the older one."""

    def __init__(self, limit: int, make: Callable[[str], bytes]):
        self.limit, self.make, self.young, self.old = limit, make, {}, {}

    def all(self, keys: list[str]) -> list[bytes]:
        """The values of distinct keys; those that are not known are made."""
        found = list(map(self.young.get, keys))
        for k, value in enumerate(found):
            if value is None:
                key = keys[k]
                value = self.old.get(key)
                found[k] = value = self.make(key) if value is None else value
                if len(key) <= 64:
                    if len(self.young) >= self.limit:
                        self.old, self.young = self.young, {}
                    self.young[key] = value
        return found


class Encoder:
    """Exact token ids of texts.

    Neither the tokenizer's normaliser nor its splitter joins anything across a blank, so the ids of a text
    are those of its blank-separated pieces in turn. The pieces of many texts are numbered at once. A piece of ``LETTERS``
    and trailing punctuation splits between the two, as none of these letters has a normal form that would join
    the punctuation; the letters, lower-cased, go to the tokenizer's model as the one word that they are. Whatever
    else goes to the whole tokenizer. Distinct words are encoded once and remembered; ids are gathered by number.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.model, self.table = self.tok.model, _byte_letters()
        self.words, self.others = Memory(CACHE_WORDS, self._word), Memory(CACHE_PIECES, self._whole)

    def _whole(self, piece: str) -> bytes:
        return np.array(self.tok.encode(piece, add_special_tokens=False).ids, "<u4").tobytes()

    def _word(self, key: str) -> bytes:
        """Ids of lower-case ``LETTERS``."""
        said = key if key.isascii() else key.encode().decode("latin-1").translate(self.table)
        ids = [t.id for t in self.model.tokenize(said)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        """One text's ids as little-endian 32-bit bytes."""
        return self.encode_all(pa.array([text]))[0].tobytes()

    def encode_all(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of every text; the working memory is some times the texts' size."""
        split = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        coded = split.flatten().dictionary_encode()
        piece, code = coded.dictionary, coded.indices.to_numpy()
        core = pc.utf8_rtrim(piece, PUNCTUATION)
        plain = pc.match_substring_regex(core, f"^[{LETTERS}]+$")
        word = pc.utf8_lower(core.filter(plain)).dictionary_encode()
        tail = pc.replace_substring_regex(piece.filter(plain), f"^[{LETTERS}]+", "").dictionary_encode()
        other = piece.filter(pc.invert(plain)).to_pylist()
        atoms = [*self.words.all(word.dictionary.to_pylist()), *self.others.all(tail.dictionary.to_pylist()), *self.others.all(other), b""]
        size = np.fromiter(map(len, atoms), np.int64, len(atoms)) // 4
        # Every piece is two atoms: letters and punctuation, or itself and nothing.
        n_words, n_tails, is_plain = len(word.dictionary), len(tail.dictionary), plain.to_numpy(zero_copy_only=False)
        both = np.full((len(piece), 2), len(atoms) - 1)
        both[is_plain, 0], both[is_plain, 1] = word.indices.to_numpy(), tail.indices.to_numpy() + n_words
        both[~is_plain, 0] = np.arange(len(other)) + n_words + n_tails
        flat, _ = _gather(np.frombuffer(b"".join(atoms), "<u4"), size, both.ravel())
        made, ends = _gather(flat, size[both].sum(1), code)
        cuts = np.append(0, ends)[split.offsets.to_numpy() - split.offsets[0].as_py()]
        return [made[i:j] for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


def _gather(flat: np.ndarray, size: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``which`` of ``flat``, whose runs have these sizes, one after the other; and where each ends."""
    many = size[which]
    ends = np.cumsum(many)
    return flat[np.repeat((np.cumsum(size) - size)[which] - (ends - many), many) + np.arange(ends[-1] if len(ends) else 0)], ends


@lru_cache(2)
def encoder(path: str) -> Encoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Encoder(path)


class TableWriter:
    """Writes one file from entries in key order; holds one block, the sparse index and the filter's hashes."""

    def __init__(self, path: str, id_bytes: int):
        self.path, self.width = path, id_bytes
        self.file: files.Writer | None = None
        self.block, self.size, self.first, self.last = [], 0, b"", b""
        self.index: list[bytes] = []
        self.hashes: list[int] = []
        self.docs = self.tokens = 0

    def add(self, key: bytes, ids: np.ndarray) -> None:
        n, value = len(ids), ids.astype(f"<u{self.width}").tobytes()
        if not self.block:
            self.first, self.last = key, b""
        shared = next((k for k, (a, b) in enumerate(zip(key, self.last, strict=False)) if a != b), min(len(key), len(self.last)))
        self.block.append(ENTRY.pack(shared, len(key) - shared, n) + key[shared:] + value)
        self.size += len(self.block[-1])
        self.last = key
        self.hashes.append(xxhash.xxh64_intdigest(key[:9]))
        self.docs += 1
        self.tokens += n
        if self.size >= BLOCK_BYTES:
            self._flush()

    def _flush(self) -> None:
        if not self.block:
            return
        self.file = self.file or files.Writer(self.path)
        packed = zlib.compress(b"".join(self.block), 1)
        self.index.append(INDEX.pack(self.file.size, len(packed), len(self.first)) + self.first)
        self.file.write(packed)
        self.block, self.size = [], 0

    def close(self) -> None:
        self._flush()
        if not self.file:
            return
        index, bloom = b"".join(self.index), bloom_of(np.array(self.hashes, np.uint64))
        start = self.file.size
        self.file.write(index + bloom)
        self.file.write(FOOTER.pack(start, len(index), start + len(index), len(bloom), self.docs, self.tokens, self.width, MAGIC))
        self.file.close()


def _bits(hashes: np.ndarray, size: int) -> np.ndarray:
    step = (hashes >> np.uint64(33)) | np.uint64(1)
    return (hashes[:, None] + step[:, None] * np.arange(BLOOM_HASHES, dtype=np.uint64)) % np.uint64(size)


def bloom_of(hashes: np.ndarray) -> bytes:
    size = max(64, -(-len(hashes) * BLOOM_BITS // 8) * 8)
    bits = np.zeros(size, np.uint8)
    for k in range(0, len(hashes), 1 << 16):
        bits[_bits(hashes[k : k + (1 << 16)], size).ravel()] = 1
    return np.packbits(bits, bitorder="little").tobytes()


class TableReader:
    """Reads one file by whole scan or by lookup."""

    def __init__(self, path: str):
        self.file = files.reader(path)
        size = self.file.size()
        foot = self.file.read_at(FOOTER.size, size - FOOTER.size)
        self.index_at, self.index_size, self.bloom_at, self.bloom_size, self.docs, self.tokens, self.width, magic = FOOTER.unpack(foot)
        if magic != MAGIC:
            raise ValueError(f"{path} is no table file")
        raw, at, self.index = self.file.read_at(self.index_size, self.index_at), 0, []
        while at < len(raw):
            offset, length, k = INDEX.unpack_from(raw, at)
            self.index.append((raw[at + INDEX.size : at + INDEX.size + k], offset, length))
            at += INDEX.size + k
        self.keys = [k for k, _, _ in self.index]
        self.bloom = None

    def entries(self, block: int) -> Iterator[tuple[bytes, np.ndarray]]:
        _, offset, length = self.index[block]
        raw, at, last = zlib.decompress(self.file.read_at(length, offset)), 0, b""
        while at < len(raw):
            shared, rest, n = ENTRY.unpack_from(raw, at)
            at += ENTRY.size
            last = last[:shared] + raw[at : at + rest]
            at += rest
            yield last, np.frombuffer(raw, f"<u{self.width}", n, at)
            at += n * self.width

    def scan(self) -> Iterator[tuple[bytes, np.ndarray]]:
        for k in range(len(self.index)):
            yield from self.entries(k)

    def may_have(self, doc_id: int | None) -> bool:
        if self.bloom is None:
            self.bloom = np.frombuffer(self.file.read_at(self.bloom_size, self.bloom_at), np.uint8)
        h = np.array([xxhash.xxh64_intdigest(key_of(doc_id, 0, 0)[:9])], np.uint64)
        at = _bits(h, self.bloom_size * 8)[0].astype(np.int64)
        return bool(((self.bloom[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all())

    def lookup(self, doc_id: int | None) -> list[np.ndarray]:
        """The id arrays of all rows with this identifier."""
        if not self.may_have(doc_id):
            return []
        low, high = key_of(doc_id, 0, 0), key_of(doc_id, (1 << 32) - 1, (1 << 32) - 1)
        found, block = [], max(0, bisect.bisect_right(self.keys, low) - 1)
        while block < len(self.index) and self.keys[block] <= high:
            found += [ids for key, ids in self.entries(block) if low <= key <= high]
            block += 1
        return found


def _write(folder: str, vocab: str, end_id: int, id_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, shard = encoder(vocab), TaskContext.get().partitionId()
        path = f"{folder}/shard-{shard:06d}.sst"
        table, end = TableWriter(path, id_bytes), np.array([end_id], "<u4")
        seq, before = 0, (None,)
        for b in batches:
            for doc_id, ids in zip(b.column("sort_id").to_pylist(), _encoded(enc, b.column("text")), strict=True):
                seq = seq + 1 if doc_id == before[0] and len(before) == 2 else 0
                before = (doc_id, 0)
                table.add(key_of(doc_id, shard, seq), np.append(ids, end))
        table.close()
        if table.docs:
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "path": [path], "n_docs": [table.docs], "n_tokens": [table.tokens]})

    return run


def _groups(col: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of rows of some ``ENCODE_BYTES`` of text; a longer text is a range of its own."""
    size = np.nan_to_num(pc.binary_length(col).to_numpy(zero_copy_only=False)).astype(np.int64)
    low = total = 0
    for k, n in enumerate(size.tolist()):
        if k > low and total + n > ENCODE_BYTES:
            yield low, k
            low, total = k, 0
        total += n
    if low < len(size):
        yield low, len(size)


def _encoded(enc: Encoder, col: pa.Array) -> Iterator[np.ndarray]:
    """The ids of each text of a column. A very long text goes in parts that end at a blank."""
    col = pc.fill_null(col, "")
    for low, high in _groups(col):
        if high - low > 1 or len(text := col[low].as_py()) <= ENCODE_BYTES:
            yield from enc.encode_all(col.slice(low, high - low))
            continue
        out, at = [], 0
        while at < len(text):
            cut = text.find(" ", at + ENCODE_BYTES)
            cut = len(text) if cut < 0 else cut
            out += enc.encode_all(pa.array([text[at:cut]]))
            at = cut
        yield np.concatenate(out)


def write(docs: DataFrame, vocab: str, end_id: int = 1, id_bytes: int = 2, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES, file_order: bool = False) -> DataFrame:
    """Writes the tables and returns their list: ``shard path n_docs n_tokens`` in key order.

    ``id_bytes`` 2 holds vocabularies of up to 65,536 ids. Rows go to files by ranges of identifier;
    the hash of the text is part of the range, so rows that share an identifier are split too.
    With ``file_order`` rows go to files by their order in the Parquet files that ``docs`` was read from,
    and only inside a file are they sorted by identifier.
    """
    scratch = Scratch(docs.sparkSession, "sstable")
    place = [F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row")] if file_order else []
    picked = docs.select(F.col(id_col).cast("long").alias("sort_id"), F.col(text_col).alias("text"), *place)
    size = picked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-size // shard_bytes))
    order = [F.col("sort_id").asc_nulls_first(), F.xxhash64("text")]
    # The last term splits very many rows of one identifier and text.
    ranged = picked.repartitionByRange(shards, *(["file", "row"] if file_order else [*order, F.rand(7)])).sortWithinPartitions(*order)
    made = scratch.table(ranged.select("sort_id", "text").mapInArrow(_write(folder := scratch.path("shards"), vocab, end_id, id_bytes), META), "manifest")
    files.sweep(folder)
    return made


READ = "doc_id long, start long, n_tokens long, ids_crc32 long, shard int"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for path, start, shard in zip(b.column("path").to_pylist(), b.column("start").to_pylist(), b.column("shard").to_pylist(), strict=True):
            rows = []
            for key, ids in TableReader(path).scan():
                rows.append((id_of(key), start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                start += len(ids)
            cols = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([shard] * len(rows), pa.int32())], names=["doc_id", "start", "n_tokens", "ids_crc32", "shard"])


def placed(manifest: DataFrame) -> DataFrame:
    """The list with ``start``: the ids of all earlier files. It has one row per file, not per document."""
    rows, start, out = manifest.orderBy("shard").collect(), 0, []
    for r in rows:
        out.append((r["shard"], r["path"], start))
        start += r["n_tokens"]
    made = manifest.sparkSession.createDataFrame(out, "shard int, path string, start long")
    return made.repartition(max(1, len(out)), "shard")


def read(manifest: DataFrame) -> DataFrame:
    """Per document of the files: ``doc_id start n_tokens ids_crc32 shard``."""
    return placed(manifest).select("path", "start", "shard").mapInArrow(_read, READ)
