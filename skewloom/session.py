"""Session construction and the shared scratch area every iterative plan writes to."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "skewloom", master: str | None = None, cpus: int | None = None, **conf: str) -> SparkSession:
    """A session with AQE, skew handling and UTC; ``conf`` entries override the defaults."""
    b = SparkSession.builder.appName(app)
    if master or cpus:
        b = b.master(master or f"local[{cpus}]")
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    for k, v in {**defaults, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Sends this package's modules to the Python workers, once for each application.

    Functions that run in workers refer to their modules by name, which need not be installed there.
    """
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = Path(__file__).resolve().parent
    where = os.path.join(tempfile.mkdtemp(prefix=f"{package.name}-"), f"{package.name}.zip")
    atexit.register(shutil.rmtree, os.path.dirname(where), ignore_errors=True)
    with zipfile.ZipFile(where, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    spark.sparkContext.addPyFile(where)
    _shipped.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, with its scheme.

    A cluster names it in ``spark.checkpoint.dir``; a path without a scheme is of the default file system.
    Only on a local master, where tasks see the driver's disk, is a folder under /tmp chosen if it is unset.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = f"file:///tmp/checkpoints/{os.getpid()}"
        spark.conf.set("spark.checkpoint.dir", named)
        spark.sparkContext.setCheckpointDir(named)
    named = named.rstrip("/")
    if ":" not in named.split("/", 1)[0]:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(named)
        named = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString()
    return f"file://{named[5:]}" if named.startswith("file:/") and not named.startswith("file://") else named


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a folder through the file system that its scheme names."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class Scratch:
    """Written tables in the shared folder: they cut lineage and outlive lost executors.

    ``table`` writes a DataFrame as Parquet and reads it back, so what follows depends on files
    and not on earlier stages. ``drop`` frees tables that are no longer needed, ``finish`` all but those that a
    result reads; the rest goes when the interpreter ends (results that were returned may still read it until then).
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        ship_package(spark)
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"
        self._count = 0
        self._tables: set[str] = set()
        self._names: dict[str, str] = {}
        atexit.register(_clear, spark, self.root)

    def path(self, name: str) -> str:
        self._count += 1
        return f"{self.root}/{self._count:03d}-{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        where = self.path(name)
        df.write.parquet(where)
        out = self.spark.read.schema(df.schema).parquet(where)
        out._scratch_path = where
        self._tables.add(where)
        return out

    def bucketed(self, df: DataFrame, name: str, keys: list[str], n: int) -> DataFrame:
        """The table in ``n`` files by ``keys``: a join on all of them moves its other side only."""
        where, known = self.path(name), f"{name}_{uuid.uuid4().hex}"
        df.repartition(n, *keys).write.format("parquet").bucketBy(n, *keys).option("path", where).saveAsTable(known)
        out = self.spark.table(known)
        out._scratch_path = where
        self._tables.add(where)
        self._names[where] = known
        return out

    def counted(self, df: DataFrame, name: str) -> tuple[DataFrame, int]:
        """The table and its number of rows, which is observed while it is written."""
        seen = Observation()
        out = self.table(df.observe(seen, F.count(F.lit(1)).alias("n")), name)
        return out, seen.get["n"]

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            where = getattr(t, "_scratch_path", None)
            if where in self._tables:
                self._remove(where)

    def _remove(self, where: str) -> None:
        self._tables.discard(where)
        if where in self._names:
            self.spark.sql(f"DROP TABLE IF EXISTS {self._names.pop(where)}")
        remove_path(self.spark, where)

    def finish(self, out: DataFrame) -> DataFrame:
        """``out``; tables of this folder that it does not read go."""
        read = {f[: f.rindex("/")].rpartition(self.root.rpartition("/")[2])[2] for f in out.inputFiles()}
        for where in sorted(self._tables):
            if where.rpartition(self.root.rpartition("/")[2])[2] not in read:
                self._remove(where)
        return out


def _clear(spark: SparkSession, root: str) -> None:
    try:
        remove_path(spark, root)
    except Exception:  # noqa: BLE001 - the JVM may already be gone when the interpreter ends
        pass


#: Tables of fewer files than cores, and of at most so many bytes a core, are spread over all cores when read.
SPREAD_BYTES = 16 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str, spread: bool = False) -> DataFrame:
    """One driver table; ``spread`` deals the rows of a small table in few files to all cores, for costly work on rows."""
    ship_package(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if spread and len(files := df.inputFiles()) < cores:
        fs = spark.sparkContext._jvm.org.apache.hadoop.fs
        size = sum(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).getLen() for p in map(fs.Path, files))
        if size <= SPREAD_BYTES * cores:
            return df.repartition(cores)
    return df
