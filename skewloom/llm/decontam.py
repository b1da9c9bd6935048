"""Benchmark decontamination by winnowing.

Main path: DataFrame functions only.

Every five-word gram of a text is hashed once, and each window of ten words, that is six grams, is stood for by its
least hash. Neighbouring windows with one least hash are one fingerprint: a text has some two for seven words.
Training fingerprints that the benchmark has are extended to all windows that they stand for, and those windows
are met with the benchmark's as strings. Equal windows have equal fingerprints, so every shared span of ten
words or more is found; the words of all matching windows together are the hit words.

An item of one to nine words is one window of its own length, whose fingerprint is the hash of the whole window, and
every place of a text is tried for it. Distinct windows and distinct sets of items are numbered, so an opening that all items
share is met once and not once for each item.

Null texts have no words; items without words or id are ignored. Items that share an id act as one. Texts of any
length are read whole. Repeated document rows each get the same answer; empty tables give zero counts; further columns of the
documents, whatever their names, ride along in ``row``, and those of the benchmark are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skewloom.session import Scratch

from .common import BROADCAST_ROWS, alnum_words, count_alnum, hash_of, small_side

WINDOW, GRAM = 10, 5


def _places(n: Column) -> Column:
    """0 .. n - 1, empty for n < 1."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _worded(rows: DataFrame) -> DataFrame:
    """Adds the words of ``text`` and their hashes, the hashes of all grams, and the least hash of each window."""
    words = rows.withColumn("words", alnum_words(F.col("text")))
    hashes = words.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    grams = hashes.withColumn("grams", F.transform(_places(F.size("hashes") - GRAM + 1), lambda i: hash_of(F.col("hashes"), i, GRAM)))
    each = _places(F.size("grams") - (WINDOW - GRAM))
    return grams.withColumn("least", F.transform(each, lambda i: F.least(*[F.get("grams", i + c) for c in range(WINDOW - GRAM + 1)])))


def _span(width: Column | int) -> Column:
    return F.array_join(F.slice("words", F.col("at") + 1, width), " ")


def _short(w: int) -> Column:
    """Every window of ``w`` words."""
    one = lambda i: F.struct(F.lit(w).alias("width"), hash_of(F.col("hashes"), i, w).alias("print"), i.alias("low"), (i + 1).alias("end"))
    return F.transform(_places(F.size("hashes") - w + 1), one)


def _fingerprints(worded: DataFrame, widths: list[int]) -> DataFrame:
    """``width print low high`` of every fingerprint: it stands for the windows that start at ``low`` to ``high``."""
    made = []
    if WINDOW in widths:
        new = lambda i: (i == 0) | (F.get("least", i) != F.get("least", i - 1))
        worded = worded.withColumn("fresh", F.filter(_places(F.size("least")), new))
        made.append(
            F.transform(
                "fresh",
                lambda i, k: F.struct(
                    F.lit(WINDOW).alias("width"), F.get("least", i).alias("print"), i.alias("low"),
                    F.coalesce(F.get("fresh", k + 1), F.size("least")).alias("end"),
                ),
            )
        )
    made += [_short(w) for w in widths if w < WINDOW]
    return worded.select("doc_id", "text_hash", "words", F.inline(F.concat(*made) if len(made) > 1 else made[0]))


def benchmark_windows(scratch: Scratch, benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The distinct windows ``width print span set_id``, and ``set_id items``: the sets of item ids (as strings) that have them."""
    rows = benchmark.where(F.col(item_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text"))
    n = F.size("words")
    at = _worded(rows).where(n > 0).withColumn("width", F.least(n, F.lit(WINDOW))).withColumn("at", F.explode(_places(n - F.col("width") + 1)))
    short = F.lit(None).cast("long")
    for w in range(1, WINDOW):
        short = F.when(F.col("width") == w, hash_of(F.col("hashes"), F.lit(0), w)).otherwise(short)
    made = F.when(F.col("width") == WINDOW, F.get("least", F.col("at"))).otherwise(short)
    every = at.select("width", made.alias("print"), _span(F.col("width")).alias("span"), "item")
    spans = scratch.table(every.groupBy("width", "print", "span").agg(F.sort_array(F.collect_set("item")).alias("items")), "spans")
    sets = scratch.table(spans.select(F.col("items").alias("s_items")).distinct().withColumn("set_id", F.monotonically_increasing_id()), "sets")
    windows = scratch.table(spans.join(sets, spans["items"] == sets["s_items"]).select("width", "print", "span", "set_id"), "windows")
    return windows, sets.select("set_id", F.col("s_items").alias("items"))


def hits(rows: DataFrame, windows: DataFrame, widths: list[int], n_windows: int, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``doc_id text_hash at width set_id``: the windows of ``rows`` (doc_id, text_hash, text) that the benchmark has.

    With a benchmark within ``broadcast_rows`` windows the fingerprints are met where the texts are
    read. A larger one is met by a shuffle of distinct fingerprints, which finds the candidate
    documents, and then by the hashes of those documents' windows.
    """
    known = windows.select(F.col("width").alias("b_width"), F.col("print").alias("b_print")).distinct()
    same = lambda df: (df["width"] == known["b_width"]) & (df["print"] == known["b_print"])
    if n_windows <= broadcast_rows:
        found = _fingerprints(_worded(rows), widths)
        found = found.join(F.broadcast(known), same(found), "left_semi")
    else:
        prints = _fingerprints(_worded(rows), widths).select("doc_id", "text_hash", "width", "print").distinct()
        keys = prints.join(known, same(prints), "left_semi").select(F.col("doc_id").alias("m_doc"), F.col("text_hash").alias("m_hash")).distinct()
        mine = rows.join(keys, rows["doc_id"].eqNullSafe(keys["m_doc"]) & (rows["text_hash"] == keys["m_hash"]), "left_semi")
        found = _fingerprints(_worded(mine), widths)
    at = found.select("doc_id", "text_hash", "words", "width", F.explode(F.sequence("low", F.col("end") - 1)).alias("at"))
    spans = at.select("doc_id", "text_hash", "at", "width", _span(F.col("width")).alias("span"))
    bench = windows.select(F.col("width").alias("w_width"), F.col("span").alias("w_span"), "set_id")
    met = spans.join(small_side(bench, n_windows, broadcast_rows), (spans["width"] == bench["w_width"]) & (spans["span"] == bench["w_span"]))
    return met.select("doc_id", "text_hash", "at", "width", "set_id")


def score(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Per document ``doc_id n_words n_hit n_items items_sha256 contaminated`` and the input ``row``."""
    scratch = Scratch(docs.sparkSession, "winnowing")
    windows, sets = benchmark_windows(scratch, benchmark)
    # Which widths occur is at most ten numbers.
    sizes = {r["width"]: r["n"] for r in windows.groupBy("width").agg(F.count("*").alias("n")).collect()}
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"), F.struct("*").alias("row"))
    found = hits(keyed.select("doc_id", "text_hash", "text"), windows, sorted(sizes) or [WINDOW], sum(sizes.values()), broadcast_rows)
    found = scratch.table(found.distinct(), "hits")
    per_doc = found.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set(F.struct("at", "width"))).alias("spans"))
    many = found.select("doc_id", "text_hash", "set_id").distinct().join(sets, "set_id").groupBy("doc_id", "text_hash")
    many = many.agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")).select(F.col("doc_id").alias("i_doc"), F.col("text_hash").alias("i_hash"), "items")
    per_doc = per_doc.join(many, per_doc["doc_id"].eqNullSafe(many["i_doc"]) & (per_doc["text_hash"] == many["i_hash"]))
    union = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda a, s: F.struct(
            F.greatest(a["end"], s["at"] + s["width"]).alias("end"),
            (a["n"] + F.greatest(F.lit(0), s["at"] + s["width"] - F.greatest(a["end"], s["at"]))).alias("n"),
        ),
        lambda a: a["n"],
    )
    per_doc = scratch.table(per_doc.select(F.col("doc_id").alias("h_doc"), F.col("text_hash").alias("h_hash"), union.alias("hit"), "items"), "documents")
    per_doc = small_side(per_doc, per_doc.count(), broadcast_rows)
    base = keyed.select("doc_id", "text_hash", "row", count_alnum(F.col("text")).alias("n_words"))
    met = base.join(per_doc, base["doc_id"].eqNullSafe(per_doc["h_doc"]) & (base["text_hash"] == per_doc["h_hash"]), "left")
    n_hit = F.coalesce("hit", F.lit(0)).cast("long")
    items = F.coalesce("items", F.array().cast("array<string>"))
    return met.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), "row",
    )


def keep(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a benchmark window, with all their columns."""
    return score(docs, benchmark).where(~F.col("contaminated")).select("row.*")
