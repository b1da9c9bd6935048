"""Mixing sources to target weights by Pfair scheduling.

Every source is cut into blocks of ``block_chars`` characters in order of document id. With the weight
``w`` of its source, block ``k`` is released at slot ``floor(k / w)`` and due before ``ceil((k + 1) / w)``.
One block takes one slot; the released block with the earliest deadline goes first. No source is ever a
whole block ahead of or behind its share, however long the input: weights are exact rational numbers, never
rounded. When a source runs out the rest go on with their weights scaled up, until every document is
placed: nothing is dropped or repeated. Sources of weight zero come after all others.

A document belongs to the block in which it starts; one that is longer than a block uses up the slots it
covers. Default weights are the sources' characters to the power ``alpha``; given weights of sources that
do not occur are ignored, and a source without a given weight gets the least given one. A null source is
a source, a null text is empty; an empty table has no slot. Rows with equal id, source and text stand next to each other.
Other columns, whatever their names, stay. The driver makes the schedule slot by slot and writes it to the shared folder in pieces;
it holds one piece and the table of weights, of at most ``MAX_SOURCES`` sources.
"""

from __future__ import annotations

import heapq
import io
import math
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skewloom.session import Scratch

from . import files
from .common import small_side

BLOCK_CHARS = 1 << 16
ALPHA = 0.5
#: Sources that have a weight of their own.
MAX_SOURCES = 100_000
#: Slots of the schedule that the driver holds at a time.
SLOT_ROWS = 1 << 19
#: Documents whose running sum one task takes.
RANGE_ROWS = 100_000


@dataclass
class Phase:
    """Until a source runs out: first slot, first block of each source, and their exact shares of a period."""

    base: int
    period: int
    first: dict[int, int]
    share: dict[int, int]

    def window(self, s: int, k: int) -> tuple[int, int]:
        """Release and deadline of the block that is the phase's ``k``-th of ``s``."""
        return self.base + k * self.period // self.share[s], self.base - (-(k + 1) * self.period // self.share[s])


def shares(weights: dict[int, float]) -> dict[int, int]:
    """The least whole numbers in the exact ratio of the weights; without a positive one all are equal."""
    exact = {s: Fraction(w) for s, w in weights.items() if w > 0} or {s: Fraction(1) for s in weights}
    unit = math.lcm(*(w.denominator for w in exact.values()))
    whole = {s: int(w * unit) for s, w in exact.items()}
    common = math.gcd(*whole.values())
    return {s: w // common for s, w in whole.items()}


def one_phase(share: dict[int, int], left: dict[int, int]) -> Iterator[tuple[int, int]]:
    """Earliest deadline first until a source has placed its blocks: the source of each slot, and which of its blocks."""
    period, count = sum(share.values()), dict.fromkeys(share, 0)
    released = [(0, s) for s in share]
    ready: list[tuple[int, int]] = []
    t = 0
    while True:
        while released and released[0][0] <= t:
            s = heapq.heappop(released)[1]
            heapq.heappush(ready, (-(-(count[s] + 1) * period // share[s]), s))
        due, s = heapq.heappop(ready)
        assert due > t, "a deadline was missed"
        yield s, count[s]
        t += 1
        count[s] += 1
        if count[s] == left[s]:
            return
        heapq.heappush(released, (count[s] * period // share[s], s))


def placements(blocks: dict[int, int], weights: dict[int, float]) -> Iterator[tuple[Phase, int, int]]:
    """The whole schedule of ``blocks[s]`` blocks per source, slot by slot: its phase, the source, and which of the phase's blocks."""
    left, base = {s: n for s, n in blocks.items() if n}, 0
    done = {s: 0 for s in left}
    while left:
        share = shares({s: weights[s] for s in left})
        phase, count = Phase(base, sum(share.values()), {s: done[s] for s in share}, share), dict.fromkeys(share, 0)
        for s, k in one_phase(share, left):
            yield phase, s, k
            count[s] += 1
        for s, n in count.items():
            done[s] += n
            left[s] -= n
            base += n
            if not left[s]:
                del left[s], done[s]


def _written(scratch: Scratch, names: list, blocks: dict[int, int], weights: dict[int, float]) -> DataFrame:
    """``t_source t_block slot release deadline``: the schedule, written in files of ``SLOT_ROWS`` rows, of which the driver holds one."""
    folder, rows, n = scratch.path("slots"), [], 0
    schema = pa.schema([("t_source", pa.string()), ("t_block", pa.int64()), ("slot", pa.int64()), ("release", pa.int64()), ("deadline", pa.int64())])

    def flush() -> None:
        held = io.BytesIO()
        pq.write_table(pa.table(list(zip(*rows, strict=True)) if rows else [[]] * 5, schema=schema), held)
        out = files.Writer(f"{folder}/part-{n // SLOT_ROWS:06d}.parquet")
        out.write(held.getvalue())
        out.close()
        rows.clear()

    for slot, (phase, s, k) in enumerate(placements(blocks, weights)):
        rows.append((names[s], phase.first[s] + k, slot, *phase.window(s, k)))
        n = slot
        if len(rows) == SLOT_ROWS:
            flush()
    if rows or not n:
        flush()
    return scratch.spark.read.schema("t_source string, t_block long, slot long, release long, deadline long").parquet(folder)


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.xxhash64(text).alias("text_hash"),
        F.char_length(text).cast("long").alias("chars"),
    )


def schedule(docs: DataFrame, weights: dict[str | None, float] | None = None, block_chars: int = BLOCK_CHARS, alpha: float = ALPHA, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Per distinct (id, source, text hash): ``before chars copies block slot release deadline``.

    ``before``: characters of the source before the document. Slot, then ``before``, is the order.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mixing")
    sized = scratch.table(
        _sized(docs, id_col, text_col, source_col).groupBy("doc_id", "source", "text_hash").agg(F.max("chars").alias("chars"), F.count("*").alias("copies")), "sized"
    )
    order = ["source", "doc_id", "text_hash"]
    n = max(1, -(-sized.count() // RANGE_ROWS))
    # Written once: the range of a row must not change when a task is repeated.
    ranged = scratch.table(sized.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()), "ranged")
    taken = F.col("chars") * F.col("copies")
    parts = ranged.groupBy("source", "part").agg(F.sum(taken).alias("sum"))
    running = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(F.col("source").alias("o_source"), F.col("part").alias("o_part"), F.coalesce(F.sum("sum").over(running), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("part", "source").orderBy("doc_id", "text_hash").rowsBetween(Window.unboundedPreceding, -1)
    within = ranged.withColumn("within", F.coalesce(F.sum(taken).over(inside), F.lit(0)))
    met = within.join(offsets, within["source"].eqNullSafe(offsets["o_source"]) & (within["part"] == offsets["o_part"]))
    placed = scratch.table(
        met.select("doc_id", "source", "text_hash", "chars", "copies", (F.col("offset") + F.col("within")).alias("before")).withColumn(
            "block", F.floor(F.col("before") / block_chars).cast("long")
        ),
        "placed",
    )
    # One row per source: the weights are a table of the driver.
    found = placed.groupBy("source").agg(F.max("block").alias("last"), F.sum(F.col("chars") * F.col("copies")).alias("chars")).limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources; mix groups of them")
    names = sorted((r["source"] for r in found), key=lambda s: (s is not None, s))
    number = {s: k for k, s in enumerate(names)}
    blocks = {number[r["source"]]: r["last"] + 1 for r in found}
    if weights:
        least = min(weights.values())
        target = {number[s]: weights.get(s, least) for s in names}
    else:
        target = {number[r["source"]]: float(max(1, r["chars"])) ** alpha for r in found}
    slot_df, n_slots = _written(scratch, names, blocks, target), sum(blocks.values())
    full = placed.join(small_side(slot_df, n_slots), placed["source"].eqNullSafe(slot_df["t_source"]) & (placed["block"] == slot_df["t_block"]))
    return full.select("doc_id", "source", "text_hash", "before", "chars", "copies", "block", "slot", "release", "deadline")


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, block_chars: int = BLOCK_CHARS, alpha: float = ALPHA) -> DataFrame:
    """All rows of ``docs`` with their columns, sorted by the schedule; the parts are ranges of slots."""
    placed = schedule(docs, weights, block_chars, alpha).select(
        F.col("doc_id").alias("__id"), F.col("source").alias("__source"), F.col("text_hash").alias("__hash"), F.col("slot").alias("__slot"), F.col("before").alias("__before")
    )
    hashed = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    met = docs.join(placed, docs["doc_id"].eqNullSafe(placed["__id"]) & docs["source"].eqNullSafe(placed["__source"]) & (hashed == placed["__hash"]))
    return met.orderBy("__slot", "__before").select(*[docs[c] for c in docs.columns])
