"""The driver loop of all iterative operators.

A step takes the last round's rows and returns the next as a plan. Each round is written to the
shared folder, which cuts lineage and makes a lost executor repeat one round at most; one number per
round, observed while it is written, comes back to the driver and decides whether to go on.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from skewloom.session import Scratch


#: Part of the rows of the state from which a round of so many changed rows writes all of it.
MANY = 0.25


@dataclass
class Result:
    state: DataFrame
    rounds: int
    #: Changed rows of each round.
    sizes: list[int] = field(default_factory=list)


def improve(scratch: Scratch, start: DataFrame, offers: Callable[[DataFrame, int], DataFrame], value: str, least: bool, max_rounds: int = 10_000, compact_every: int = 12) -> Result:
    """The best value of each id, least or greatest: ``offers(front, rows)`` gives rows ``id value`` from the rows that changed last.

    A round in which many rows may get better writes the whole state, with a mark on those that did, and moves it once; others
    write only the rows that got better. Then the state is the best of all that was written; its tables are merged now and then.
    """
    best = F.min if least else F.max
    front, n = scratch.counted(start.select("id", value), "state0")
    log, sizes, rows = [front], [], n
    for k in range(1, max_rounds + 1):
        # One table of a whole state has each id once.
        every = (log[0] if len(log) == 1 else _union(log).groupBy("id").agg(best(value).alias(value))).select(F.col("id").alias("k_id"), F.col(value).alias("known"))
        made = offers(front, n)
        better = F.col("known").isNull() | (F.col(value) < F.col("known") if least else F.col(value) > F.col("known"))
        if n >= MANY * rows:
            both = made.join(every, made["id"] == every["k_id"], "full")
            pick = F.least(value, "known") if least else F.greatest(value, "known")
            state, rows, n = _marked(scratch, both.select(F.coalesce("id", "k_id").alias("id"), pick.alias(value), F.coalesce(F.col(value).isNotNull() & better, F.lit(False)).alias("changed")), f"state{k}")
            scratch.drop(*log)
            front, log = state.where("changed").select("id", value), [state]
            sizes.append(n)
            if not n:
                break
            continue
        front, n = scratch.counted(made.join(every, made["id"] == every["k_id"], "left").where(better).select("id", value), f"changed{k}")
        sizes.append(n)
        if not n:
            break
        log.append(front)
        rows += n
        if len(log) >= compact_every:
            merged, rows = scratch.counted(_union(log).groupBy("id").agg(best(value).alias(value)), f"merged{k}")
            scratch.drop(*[t for t in log if t is not front])
            log = [merged]
    return Result(_union(log).groupBy("id").agg(best(value).alias(value)), len(sizes), sizes)


def _marked(scratch: Scratch, df: DataFrame, name: str) -> tuple[DataFrame, int, int]:
    """The written table, its rows and how many of them are marked as changed."""
    seen = Observation()
    out = scratch.table(df.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.col("changed").cast("long")).alias("changed")), name)
    return out, seen.get["n"], seen.get["changed"] or 0


def _union(parts: list[DataFrame]) -> DataFrame:
    names = [c for c in parts[0].columns if c != "changed"]
    out = parts[0].select(*names)
    for p in parts[1:]:
        out = out.unionByName(p.select(*names))
    return out


def levels(scratch: Scratch, start: DataFrame, step: Callable[[DataFrame, DataFrame, int, int], DataFrame], max_levels: int = 10_000, compact_every: int = 16) -> tuple[list[DataFrame], Result]:
    """Level-synchronous growth: ``step(frontier, visited, k, rows)`` gives level ``k`` of a frontier of so many rows; it must be new rows.

    Every level is a table of its own, so a round writes its frontier only. The tables of many levels
    are merged now and then, which keeps the plan of the anti join short.
    """
    front, n = scratch.counted(start, "level0")
    parts, merged, sizes = [front], [front], []
    for k in range(1, max_levels + 1):
        visited = _union(merged)
        front, n = scratch.counted(step(front, visited, k, n), f"level{k}")
        sizes.append(n)
        if not n:
            break
        parts.append(front)
        merged.append(front)
        if len(merged) >= compact_every:
            merged = [scratch.table(visited.unionByName(front), f"merged{k}")]
    return parts, Result(_union(merged), len(parts) - 1, sizes)


def last_level(df: DataFrame, column: str = "level") -> int:
    return df.agg(F.max(column)).first()[0] or 0
