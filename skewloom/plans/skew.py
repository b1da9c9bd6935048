"""Load balancing of the gather join: the same rows, other physical plans.

``auto``          leave it to adaptive execution (skew join, coalescing);
``degree_split``  keys with more rows than a threshold are joined by broadcast, the rest by shuffle;
``salt``          every hot key is spread over ``salts`` partitions, the other side is replicated for it;
``broadcast``     broadcast the state side, if it is within ``BROADCAST_ROWS``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skewloom.session import Scratch

STRATEGIES = ("auto", "degree_split", "salt", "broadcast")
BROADCAST_ROWS = 1_000_000
#: Default number of rows of a key from which it counts as heavy.
THRESHOLD = 1024
SALTS = 16
#: Edges from which a loop keeps them in files by key, so that a round moves the state only; edges of one file, and of one key at most.
BUCKET_FROM, BUCKET_ROWS, BUCKET_KEY_ROWS = 250_000, 1_000_000, 100_000


class Gather:
    """The inner join of edge rows ``many`` with state rows, for one loop: hot keys are found and dealt with once.

    A loop (``rounds``) over many edges keeps them in files by key and joins them there, unless a key has so many that only
    adaptive execution can split it.
    """

    def __init__(self, scratch: Scratch, many: DataFrame, key: str, strategy: str = "auto", threshold: int = THRESHOLD, salts: int = SALTS, rounds: bool = True):
        if strategy not in STRATEGIES:
            raise ValueError(f"strategy must be one of {STRATEGIES}")
        self.many, self.key, self.strategy, self.salts = many, key, strategy, salts
        if strategy in ("degree_split", "salt"):
            found = many.groupBy(F.col(key).alias("__hot")).agg(F.count("*").alias("__n")).where(F.col("__n") > threshold).select("__hot")
            hot, n = scratch.counted(found, "hot")
            if n > BROADCAST_ROWS:  # too many to be exceptions: adaptive execution splits them
                self.strategy = strategy = "auto"
        kept = lambda df, *keys: _by_key(scratch, df, list(keys)) if rounds else None
        if strategy in ("degree_split", "salt"):
            # The hot keys are sent to the edges, so that no key is moved whole to find out that it is hot.
            self.hot = F.broadcast(hot)
            marked = many.join(self.hot, many[key] == F.col("__hot"), "left")
            if strategy == "salt":
                salt = F.when(F.col("__hot").isNotNull(), F.pmod(F.xxhash64(*many.columns), F.lit(salts))).otherwise(0)
                salted = scratch.table(marked.withColumn("__salt", salt.cast("int")).drop("__hot"), "salted")
                self.many = kept(salted, key, "__salt") or salted
            else:
                split = scratch.table(marked.withColumn("__heavy", F.col("__hot").isNotNull()).drop("__hot"), "split")
                self.light, self.heavy = split.where("NOT __heavy").drop("__heavy"), split.where("__heavy").drop("__heavy")
                self.light = kept(self.light, key) or self.light
        else:
            self.many = kept(many, key) or many

    def join(self, few: DataFrame, few_key: str, rows: int | None = None) -> DataFrame:
        """``few`` has ``rows`` rows; they are counted if that is not given and matters."""
        on = lambda a, b: a[self.key] == b[few_key]
        small = lambda df: F.broadcast(df) if (df.count() if rows is None else rows) <= BROADCAST_ROWS else df
        if self.strategy == "broadcast":
            return self.many.join(small(few), on(self.many, few))
        if self.strategy == "degree_split":
            is_hot = few[few_key] == F.col("__hot")
            heavy, light = few.join(self.hot, is_hot, "left_semi"), few.join(self.hot, is_hot, "left_anti")
            heavy = small(heavy)
            return self.light.join(light, on(self.light, light)).unionByName(self.heavy.join(heavy, on(self.heavy, heavy)))
        if self.strategy == "salt":
            copies = F.when(F.col("__hot").isNotNull(), F.sequence(F.lit(0), F.lit(self.salts - 1))).otherwise(F.array(F.lit(0)))
            right = few.join(self.hot, few[few_key] == F.col("__hot"), "left").withColumn("__s", F.explode(copies)).drop("__hot")
            return self.many.join(right, on(self.many, right) & (self.many["__salt"] == right["__s"])).drop("__salt", "__s")
        return self.many.join(few, on(self.many, few))


def _by_key(scratch: Scratch, df: DataFrame, keys: list[str]) -> DataFrame | None:
    """The rows in files by ``keys``, or None if they are few or a key has too many."""
    size = df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.sum("n").alias("rows"), F.max("n").alias("most")).first()
    if (size["rows"] or 0) < BUCKET_FROM or size["most"] > BUCKET_KEY_ROWS:
        return None
    spark = scratch.spark
    return scratch.bucketed(df, "by_key", keys, max(spark.sparkContext.defaultParallelism, -(-size["rows"] // BUCKET_ROWS)))


def gather(many: DataFrame, key: str, few: DataFrame, few_key: str, strategy: str = "auto", threshold: int = THRESHOLD, salts: int = SALTS) -> DataFrame:
    """One such join."""
    return Gather(Scratch(many.sparkSession, "gather"), many, key, strategy, threshold, salts, rounds=False).join(few, few_key)
