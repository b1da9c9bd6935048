"""SimHash near-duplicates found by Golay-code fuzzy hashing.

Fingerprint: lower-case A-Z, words between ASCII white space, all four-word shingles with repeats
(fewer words: the whole sequence; none or a null text: zero), XXH64 with seed 42; a bit is one if set
in over half of the hashes.

Two fingerprints link if at most four bits differ. The 64 bits are three segments of 22, 21 and 21
bits. Four errors over three segments leave either one segment without error and another with at
most two, or the errors (1, 1, 1) or (1, 1, 2). For the first case the keys are a whole segment and
the Golay codewords near another: words at distance two share a codeword within distance four. For
the second case the fingerprint with a zero where the other has a one gives, for each zero bit of one
segment, that segment with the bit set and the nearest codeword of another segment; the other fingerprint
gives its whole segment and all near codewords. The parities of the remaining segments, known to flip or
to stay, are part of the key. So every linked pair shares a key. Equal fingerprints are one class throughout.

Fingerprints that share a key are compared, and of each key's group only a spanning forest of its
links leaves the task, never all pairs. The members of a large group are dealt to tasks as pairs of
chunks. Components then follow from star contraction.

Null ids have no part in a component's name; a component of null ids only has a null name. Repeated
rows each get the same answer; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skewloom.session import Scratch

from . import golay
from .common import small_side
from .components import components

MAX_BITS = 4
#: Members of a key's group that are compared in one piece.
CHUNK = 4096
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Identifiers alone are broadcast up to this number.
BROADCAST_IDS = 2_000_000
#: Fingerprints whose keys one task makes.
PRINTS_PER_TASK = 20_000
#: Hashes whose bits are counted at a time.
BLOCK = 1 << 16


def fingerprint(text: bytes | None) -> int:
    """Unsigned 64-bit fingerprint of a UTF-8 text."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - 3)
    if n == 1:
        cuts = [joined]
    else:
        gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32).tolist()
        cuts = [joined[a:b] for a, b in zip([0, *[g + 1 for g in gaps[: n - 1]]], [*gaps[3:], len(joined)], strict=True)]
    counts = np.zeros(64, np.int64)
    digest = xxhash.xxh64_digest
    for k in range(0, n, BLOCK):
        raw = np.frombuffer(b"".join([digest(c, 42) for c in cuts[k : k + BLOCK]]), np.uint8).reshape(-1, 8)
        counts += np.unpackbits(raw, axis=1).sum(0, dtype=np.uint32)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = b.column("text").cast(pa.binary())
        made = np.fromiter((fingerprint(t.as_py()) for t in texts), np.uint64, len(texts))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(made.view(np.int64))], names=["doc_id", "print"])


def prints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id print`` for every row; the fingerprint's bits as a signed 64-bit integer."""
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return picked.mapInArrow(_fingerprints, "doc_id long, print long")


def keys_of(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All keys of unsigned fingerprints, and the row each key is of."""
    seg = [((fps >> np.uint64(at)) & np.uint64((1 << width) - 1)).astype(np.int64) for at, width in SEGMENTS]
    code, is_set = zip(*[golay.codewords(s) for s in seg], strict=True)
    par = [np.bitwise_count(s).astype(np.int64) & 1 for s in seg]
    rows, keys = [], []

    def put(table: int, values: np.ndarray, mask: np.ndarray) -> None:
        r, c = np.nonzero(mask)
        rows.append(r)
        keys.append(values[r, c] | (table << 59))

    table = 0
    for a in range(3):
        for b in range(3):
            if a != b:
                put(table, seg[a][:, None] << 12 | code[b], is_set[b])
                table += 1
    for i, j, k in ((0, 1, 2), (1, 2, 0), (2, 0, 1)):
        own = (par[j] << 1 | par[k])[:, None]
        put(table, (seg[i][:, None] << 12 | code[j]) << 2 | own, is_set[j])
        bit = np.int64(1) << np.arange(SEGMENTS[i][1], dtype=np.int64)
        zero = (seg[i][:, None] & bit) == 0
        for flip in (0b10, 0b11) if k == 2 else (0b10,):
            put(table, ((seg[i][:, None] | bit) << 12 | code[j][:, :1]) << 2 | (own ^ flip), zero)
        table += 1
    return np.concatenate(keys), np.concatenate(rows)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        every = b.column("print").to_numpy(zero_copy_only=False)
        for k in range(0, len(every), 2048):
            fps = every[k : k + 2048]
            key, row = keys_of(fps.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fps[row])], names=["key", "print"])


def forest(fps: np.ndarray, bits: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the links among distinct unsigned fingerprints, by breadth-first search."""
    left, us, vs = fps, [], []
    while len(left) > 1:
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            now, front = front[:256], front[256:]
            near = np.bitwise_count(now[:, None] ^ left[None, :]) <= bits
            got = near.any(0)
            if got.any():
                us.append(now[near[:, got].argmax(0)])
                vs.append(left[got])
                front = np.concatenate([front, left[got]])
                left = left[~got]
    empty = np.zeros(0, np.uint64)
    return np.concatenate(us or [empty]), np.concatenate(vs or [empty])


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        col = b.column("prints")
        flat, offs = col.flatten().to_numpy(zero_copy_only=False).view(np.uint64), col.offsets.to_numpy()
        offs = offs - offs[0]
        size = np.diff(offs)
        at = offs[:-1][size == 2]
        u, v = flat[at], flat[at + 1]
        near = np.bitwise_count(u ^ v) <= MAX_BITS
        us, vs = [u[near]], [v[near]]
        for k in np.flatnonzero(size > 2):
            u, v = forest(flat[offs[k] : offs[k + 1]])
            us.append(u)
            vs.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (us, vs)], names=["u", "v"])


def links(scratch: Scratch, distinct: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``u v``: links among the distinct fingerprints ``print`` that join their components."""
    spread = distinct.select("print").repartition(max(1, -(-distinct.count() // PRINTS_PER_TASK)))
    keys = spread.mapInArrow(_keys, "key long, print long")
    shared = scratch.table(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "shared")
    # Few keys are shared: within the bound they go to the members, so those are not shuffled again.
    members = keys.join(small_side(shared, shared.count()), "key")
    parts = F.ceil(F.col("n") / chunk).cast("int")
    mine = F.pmod(F.xxhash64("print"), F.col("parts")).cast("int")
    dealt = members.withColumn("parts", parts).withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    groups = dealt.groupBy("key", F.least("mine", "other").alias("a"), F.greatest("mine", "other").alias("b")).agg(F.collect_set("print").alias("prints"))
    return groups.select("prints").mapInArrow(_links, "u long, v long").distinct()


def cluster(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id print root component_id`` for every row."""
    scratch = Scratch(docs.sparkSession, "simhash")
    made = scratch.table(prints(docs, id_col, text_col), "prints")
    classes = scratch.table(made.groupBy("print").agg(F.min("doc_id").alias("least")), "classes")
    roots = components(scratch, scratch.table(links(scratch, classes), "links"))
    named = classes.join(roots, classes["print"] == roots["node"], "left").select(
        classes["print"].alias("c_print"), F.coalesce("root", classes["print"]).alias("root"), "least"
    )
    named = scratch.table(named, "named")
    least = named.groupBy(F.col("root").alias("l_root")).agg(F.min("least").alias("component_id"))
    # The name of each class; the written table lets the join below split a class of very many copies.
    final = scratch.table(named.join(least, named["root"] == least["l_root"]).select("c_print", "root", "component_id"), "components")
    return made.join(final, made["print"] == final["c_print"]).select("doc_id", "print", "root", "component_id")


def keep(docs: DataFrame) -> DataFrame:
    """One document of each component, with all its columns: that with the least id.

    Of repeated rows with that id one stays. Rows with a null id stay, as none of them can be named.
    """
    scratch = Scratch(docs.sparkSession, "simhash-keep")
    named = cluster(docs)
    copies = F.count_if(F.col("doc_id") == F.col("component_id"))
    odd = scratch.table(named.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("k_id")).agg(copies.alias("copies")).where("copies <> 1"), "odd")
    n, n_more = odd.agg(F.count("*"), F.count_if(F.col("copies") > 1)).first()
    # The ids that go are fewer than those that stay: within the bound the texts are not shuffled.
    out = docs.join(small_side(odd.select("k_id"), n, BROADCAST_IDS), docs["doc_id"] == odd["k_id"], "left_anti")
    if not n_more:
        return out
    more = small_side(odd.where("copies > 1").select("k_id"), n_more, BROADCAST_IDS)
    return out.unionByName(docs.join(more, docs["doc_id"] == odd["k_id"], "left_semi").dropDuplicates(["doc_id"]))
