"""Relational building blocks and per-row nested work."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skewloom.plans.skew import SALTS, THRESHOLD, gather

from .graph import Graph


def inner_join(t1: DataFrame, t2: DataFrame, strategy: str = "auto") -> DataFrame:
    """``key value1 value2``: every row of ``t2(key, value)`` with the row of ``t1(key, value)`` that has its key."""
    left = t1.select(F.col("key").alias("k1"), F.col("value").alias("value1"))
    return gather(t2.select("key", F.col("value").alias("value2")), "key", left, "k1", strategy).select("key", "value1", "value2")


def masked_min(df: DataFrame, value: str, committed: str, threshold: int) -> DataFrame:
    """One row ``least``: the least value at or above the threshold of rows that are not committed."""
    return df.agg(F.min(F.when(~F.col(committed) & (F.col(value) >= threshold), F.col(value))).alias("least"))


def edges_by_weight(graph: Graph, limit: int | None = None) -> DataFrame:
    """Edges by weight, then position; the ``limit`` lightest if it is given."""
    out = graph.edges.orderBy("weight", "pos")
    return out.limit(limit) if limit is not None else out


def unvisited(vertices: DataFrame, visited: DataFrame) -> DataFrame:
    v = visited.select(F.col("id").alias("seen"))
    return vertices.join(v, vertices["id"] == v["seen"], "left_anti")


def split_by_degree(graph: Graph, threshold: int) -> tuple[DataFrame, DataFrame]:
    """Vertices below the threshold, and the others."""
    d = graph.out_degree()
    return d.where(F.col("degree") < threshold), d.where(F.col("degree") >= threshold)


def work_arithmetic(data: Column, steps: Column | int) -> Column:
    """``steps`` rounds of ``v1 += v2; v2 += v1`` from ``(data, 1)``, then ``v2``, in doubles; steps may be a column."""
    steps = F.lit(steps) if isinstance(steps, int) else steps
    turns = F.when(steps > 0, F.sequence(F.lit(1), steps)).otherwise(F.array().cast("array<int>"))
    start = F.struct(data.cast("double").alias("a"), F.lit(1.0).alias("b"))
    return F.aggregate(turns, start, lambda v, _: F.struct((v["a"] + v["b"]).alias("a"), (v["b"] + (v["a"] + v["b"])).alias("b")), lambda v: v["b"])


def nested_work(rows: DataFrame, work: Column | None = None, strategy: str = "auto", threshold: int = THRESHOLD, salts: int = SALTS) -> DataFrame:
    """``idx rst``: the sum of ``work`` over ``iter`` turns of each row ``idx iter data``; unit work by default.

    ``auto`` multiplies, as a turn does not depend on its number. ``salt`` adds up turn by turn, which is the shape of a nested loop:
    rows of up to ``threshold`` turns where they are, the others in pieces of so many turns, which are dealt out by row and one of
    ``salts`` numbers. ``degree_split`` does so for rows with more turns and multiplies for the others. ``idx`` is a key.
    """
    work, most = F.lit(1.0) if work is None else work, max(1, threshold)
    if strategy == "auto":
        return rows.select("idx", (F.greatest(F.col("iter"), F.lit(0)) * work).cast("double").alias("rst"))
    if strategy not in ("degree_split", "salt"):
        raise ValueError("strategy must be auto, degree_split or salt")
    # A turn's value is found once for a row; no turn becomes a row of its own.
    turns = lambda value, n: F.aggregate(F.array_repeat(value, F.greatest(n, F.lit(0))), F.lit(0.0), lambda so_far, w: so_far + w)
    light, heavy = rows.where(F.coalesce(F.col("iter") <= most, F.lit(True))), rows.where(F.col("iter") > most)
    few = nested_work(light, work) if strategy == "degree_split" else light.select("idx", turns(work.cast("double"), F.col("iter")).alias("rst"))
    pieces = F.explode(F.sequence(F.lit(0), F.ceil(F.col("iter") / most).cast("int") - 1))
    cut = heavy.select("idx", "iter", work.cast("double").alias("w"), pieces.alias("piece"))
    dealt = cut.select("idx", "w", F.least(F.lit(most), F.col("iter") - F.col("piece") * most).cast("int").alias("n"), F.pmod("piece", F.lit(salts)).alias("salt")).repartition("idx", "salt")
    many = dealt.select("idx", turns(F.col("w"), F.col("n")).alias("w")).groupBy("idx").agg(F.sum("w").alias("rst"))
    return few.unionByName(many)


def nested_work_udf(rows: DataFrame, work: Callable[[float, int], float]) -> DataFrame:
    """``idx rst`` for a work function of the user, called with data and turn; Arrow batches."""
    @F.pandas_udf("double")
    def run(turns: pd.Series, data: pd.Series) -> pd.Series:
        return pd.Series([float(sum(work(d, k) for k in range(max(0, n)))) for n, d in zip(turns, data, strict=True)])

    return rows.select("idx", run("iter", "data").alias("rst"))


def vector_profile(rows: DataFrame) -> DataFrame:
    """One row: sum, least, greatest and mean of ``iter``."""
    return rows.agg(F.sum("iter").cast("long").alias("total"), F.min("iter").alias("least"), F.max("iter").alias("greatest"), F.avg("iter").alias("mean"), F.count("*").alias("n"))


def vector_histogram(rows: DataFrame) -> DataFrame:
    return rows.groupBy("iter").agg(F.count("*").alias("count"))
