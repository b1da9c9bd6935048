"""Measures over all pairs of vertices without a table of pairs.

The graph goes to every task as NumPy rows, the sources are dealt to the tasks, and a task keeps numbers for vertices only: memory
and shuffled rows are bounded by vertices and edges. Only the time is that of all pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skewloom.session import Scratch

from .graph import Graph

#: Distinct edges and vertices up to which a graph is sent to every task.
FITS = 4_000_000
#: Places of vertices and edges that one walk over several sources holds, and words of one walk over bits.
WALK_PLACES, WALK_WORDS = 1 << 20, 1 << 22
#: Tasks for each core: few, as each returns a row for every vertex, but enough to even out.
TASKS_A_CORE = 3


@dataclass
class Rows:
    """Edges as places in the ascending ``ids``, by source; ``n`` parallel edges are one edge."""

    ids: np.ndarray
    src: np.ndarray
    dst: np.ndarray
    n: np.ndarray

    @property
    def starts(self) -> np.ndarray:
        return np.searchsorted(self.src, np.arange(len(self.ids) + 1))


def small_rows(scratch: Scratch, graph: Graph) -> Rows | None:
    """The graph for the driver to send out, or None if it is too large for that."""
    edges, m = scratch.counted(graph.multiplicity().where("src IS NOT NULL AND dst IS NOT NULL"), "multiplicity")
    if m > FITS or graph.vertices.count() > FITS:
        scratch.drop(edges)
        return None
    e = edges.select(*[F.col(c).cast("long").alias(c) for c in ("src", "dst", "n")]).toArrow()
    src, dst, n = (e.column(c).to_numpy() for c in ("src", "dst", "n"))
    known = graph.vertices.where("id IS NOT NULL").select(F.col("id").cast("long").alias("id")).toArrow().column("id").to_numpy()
    scratch.drop(edges)
    ids = np.unique(np.concatenate([known, src, dst]))
    order = np.lexsort((dst, src))
    return Rows(ids, np.searchsorted(ids, src[order]), np.searchsorted(ids, dst[order]), n[order].astype("float64"))


def dependencies(starts: np.ndarray, dst: np.ndarray, n: np.ndarray, sources: np.ndarray) -> np.ndarray:
    """For each vertex the sum over ``sources`` of the share of shortest paths that pass it, as Brandes counts them.

    All sources walk at once: a place is a source's copy of a vertex.
    """
    size = len(starts) - 1
    first = np.arange(len(sources)) * size + sources
    sigma, seen, last = np.zeros(len(sources) * size), np.zeros(len(sources) * size, dtype=bool), np.empty(len(sources) * size, dtype=np.int64)
    sigma[first], seen[first] = 1.0, True
    front, at, steps = first, sources, []
    while len(front):
        low = starts[at]
        degree = starts[at + 1] - low
        ends = np.cumsum(degree)
        e = np.arange(ends[-1]) + np.repeat(low - (ends - degree), degree)
        to, came = np.repeat(front - at, degree) + dst[e], np.repeat(front, degree)
        new = np.flatnonzero(~seen[to])  # what is not seen yet is one level further
        if not len(new):
            break
        e, to, came = e[new], to[new], came[new]
        flow = sigma[came] * n[e]
        np.add.at(sigma, to, flow)
        steps.append((came, to, flow))
        k = np.arange(len(to))
        last[to] = k
        one = np.flatnonzero(last[to] == k)  # each place once
        front, at = to[one], dst[e[one]]
        seen[front] = True
    delta = np.zeros(len(sources) * size)
    for came, to, flow in reversed(steps):
        np.add.at(delta, came, flow / sigma[to] * (1 + delta[to]))
    delta[first] = 0.0
    return delta.reshape(len(sources), size).sum(axis=0)


def hops_to(src: np.ndarray, dst: np.ndarray, size: int, sources: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each vertex the sum of its hops from ``sources``, and how many others of them reach it; edges are by ``dst``.

    A source is a bit, so a step takes 64 of them at once.
    """
    words = -(-len(sources) // 64)
    seen, k = np.zeros((size, words), dtype=np.uint64), np.arange(len(sources))
    np.bitwise_or.at(seen, (sources, k // 64), np.left_shift(np.uint64(1), (k % 64).astype(np.uint64)))
    front, level = seen.copy(), 0
    hops, pairs = np.zeros(size, dtype=np.int64), np.zeros(size, dtype=np.int64)
    live = np.zeros(size, dtype=bool)
    live[sources] = True
    while True:
        level += 1
        e = np.flatnonzero(live[src])
        if not len(e):
            return hops, pairs
        to = dst[e]
        cuts = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
        met, to = np.bitwise_or.reduceat(front[src[e]], cuts, axis=0), to[cuts]
        new = met & ~seen[to]
        count = np.bitwise_count(new).sum(axis=1, dtype=np.int64)
        hops[to] += level * count
        pairs[to] += count
        seen[to] |= new
        front[live] = 0
        live[:] = False
        some = count > 0
        front[to[some]] = new[some]
        live[to[some]] = True


def _from_sources(scratch: Scratch, rows: Rows, sources: DataFrame, walk: Callable[[Rows], tuple[Callable, Callable]], schema: str) -> DataFrame:
    """A table of the sums for each vertex over all sources.

    ``walk(rows)`` gives a function that takes sources, and one that ends with the vertices' numbers.
    """
    spark = scratch.spark
    sent = spark.sparkContext.broadcast(rows)
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine: Rows = sent.value
        add, done = walk(mine)
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            ids = ids[np.isin(ids, mine.ids)]  # a source outside the graph reaches nothing
            add(np.searchsorted(mine.ids, ids))
        numbers = done()
        used = np.flatnonzero(np.any(numbers, axis=0))
        for k in range(0, len(used), 1 << 16):
            part = used[k : k + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(mine.ids[part]), *[pa.array(c[part]) for c in numbers]], names=names)

    dealt = sources.where("id IS NOT NULL").select(F.col("id").cast("long").alias("id")).repartition(TASKS_A_CORE * spark.sparkContext.defaultParallelism)
    made = dealt.mapInArrow(run, schema).groupBy(names[0]).agg(*[F.sum(c).alias(c) for c in names[1:]])
    out = scratch.table(made, "sums")
    sent.unpersist()
    return out


def _walk_dependencies(rows: Rows) -> tuple[Callable, Callable]:
    starts, total = rows.starts, np.zeros(len(rows.ids))
    width = max(1, WALK_PLACES // max(1, len(rows.ids) + len(rows.src)))

    def add(at: np.ndarray) -> None:
        for k in range(0, len(at), width):
            total[:] += dependencies(starts, rows.dst, rows.n, at[k : k + width])

    return add, lambda: [total]


def _walk_hops(rows: Rows) -> tuple[Callable, Callable]:
    order = np.argsort(rows.dst, kind="stable")
    src, dst = rows.src[order], rows.dst[order]
    hops, pairs = np.zeros(len(rows.ids), dtype=np.int64), np.zeros(len(rows.ids), dtype=np.int64)
    width, kept = 64 * max(1, WALK_WORDS // max(1, len(rows.ids) + len(rows.src))), [np.empty(0, dtype=np.int64)]

    def take(at: np.ndarray) -> None:
        h, p = hops_to(src, dst, len(rows.ids), at)
        hops[:] += h
        pairs[:] += p

    def add(at: np.ndarray) -> None:  # a walk costs the same for few sources, so batches are filled
        waiting = np.concatenate([kept[0], at])
        whole = len(waiting) // width * width
        for k in range(0, whole, width):
            take(waiting[k : k + width])
        kept[0] = waiting[whole:]

    def done() -> list[np.ndarray]:
        if len(kept[0]):
            take(kept[0])
        return [hops, pairs]

    return add, done


def dependency_sums(scratch: Scratch, rows: Rows, sources: DataFrame) -> DataFrame:
    """``b sum``: dependencies of all ``sources(id)`` on vertices other than the source; vertices with zero may be absent."""
    return _from_sources(scratch, rows, sources, _walk_dependencies, "b long, sum double")


def hop_sums(scratch: Scratch, rows: Rows, sources: DataFrame) -> DataFrame:
    """``v hops pairs``: hops to each vertex from all other ``sources(id)`` that reach it, and how many do; absent if none does."""
    return _from_sources(scratch, rows, sources, _walk_hops, "v long, hops long, pairs long")
