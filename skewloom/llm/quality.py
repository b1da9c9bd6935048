"""Quality rules: per-document counts and cross-document line frequency per host.

Main path: DataFrame functions only. One scan of the texts writes counts and line hashes; all that follows
reads these.

The counts of a text (null: no words) are word characters, symbol characters, repeated lines and
words in repeated three-word windows. The cross-document rule hashes every normalised line that has
a word (lower case, runs of white space and digits to one space) and counts, per host, the distinct
documents that have it. A line above the host's limit is boilerplate and is removed; a document of
which too small a share remains is depleted and rejected.

Copies must not turn ordinary lines into boilerplate: equal texts of a host count as one document, and a
frequent line is boilerplate only if its documents differ next to it (on one side at least half as many
different lines as documents) or if it is next to boilerplate in at least half of its places, up to ``GROW``
lines into a block. So a menu or footer of several lines goes as a whole, and copies of a document stay.

Texts of any length are measured whole, in one row each. A null host is a host of its own. Repeated rows each
get the same answer; empty tables give empty results; further columns, whatever their names, ride along in ``row``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skewloom.session import Scratch

from .common import SPACED, extract, small_side

#: A line is above the limit if more distinct documents of the host than both of these have it.
MIN_DOCS = 20
MAX_SHARE = 0.05
#: A document is depleted if less than this share of its line characters remains.
MIN_LEFT = 0.3
#: Lines of a block that are reached from each of its edges.
GROW = 4
SYMBOLS = r"[#*$%&|<>]"
#: White space inside a line, and what separates the words of a normalised one.
BLANKS, BETWEEN = " \t\x0b\x0c\r", r"[\x20\x09\x0B-\x0D0-9]+"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _normal(text: Column) -> Column:
    """Line feeds stay, so the lines of the result are those of the text."""
    return F.lower(F.regexp_replace(text, BETWEEN, " "))


def _line_hash(normal: Column) -> Column:
    return F.xxhash64(F.trim(normal))


def _has_word(line: Column) -> Column:
    return F.trim(line, F.lit(BLANKS)) != ""


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", carry: bool = True) -> DataFrame:
    """One row per document: ``doc_id host text_hash rid``, the counts, and hash and length of each line with a word.

    With ``carry`` the input row rides along in ``row``.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    row = [F.struct("*").alias("row")] if carry else []
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).alias("host"), text.alias("text"), _normal(text).alias("normal"), *row)
    pairs = F.arrays_zip(F.split("text", "\n", -1).alias("line"), F.split("normal", "\n", -1).alias("normal"))
    worded = rows.withColumn("words", extract(F.col("text"), SPACED)).withColumn("lines", F.filter(pairs, lambda x: _has_word(x["line"])))
    n = F.size("words")
    windows = F.when(n >= 3, F.sequence(F.lit(0), n - 3)).otherwise(F.array().cast("array<int>"))
    grams = F.sort_array(F.transform(windows, lambda i: F.struct(F.xxhash64(*[F.get("words", i + c) for c in range(3)]).alias("h"), i.alias("i"))))
    row = ["row"] if carry else []
    counted = worded.select(
        "doc_id", "host", *row, F.xxhash64("text").alias("text_hash"), n.cast("long").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct(F.transform("lines", lambda x: x["line"])))).cast("long").alias("n_dup_lines"),
        F.transform("lines", lambda x: _line_hash(x["normal"])).alias("hashes"),
        F.transform("lines", lambda x: F.char_length(x["line"])).alias("sizes"),
        grams.alias("grams"),
    )
    same = lambda x, k: F.coalesce(x["h"] == F.get("grams", k)["h"], F.lit(False))
    found = counted.withColumn("at", F.sort_array(F.transform(F.filter("grams", lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"])))
    covered = F.aggregate(
        "at",
        F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(3), i - a["last"])).alias("n")),
        lambda a: a["n"],
    )
    out = found.select("doc_id", "host", *row, "text_hash", *COUNTS[:4], covered.alias("n_repeat_words"), "hashes", "sizes")
    return out.withColumn("rid", F.monotonically_increasing_id())


def places(measured: DataFrame) -> DataFrame:
    """One row per line with a word: its hash, the hashes of the lines before and after it, its length."""
    n = F.size("hashes")
    none = F.array(F.lit(None).cast("long"))
    before = F.concat(none, F.slice("hashes", F.lit(1), F.greatest(n - 1, F.lit(0))))
    after = F.concat(F.slice("hashes", F.lit(2), F.greatest(n - 1, F.lit(0))), none)
    zipped = F.arrays_zip(F.col("hashes").alias("line"), before.alias("before"), after.alias("after"), F.col("sizes").alias("size"))
    return measured.where(n > 0).select("rid", "host", "text_hash", F.inline(zipped))


def _on(lines: DataFrame, some: DataFrame, column: str, limit: int, how: str = "inner", flag: str | None = None) -> DataFrame:
    """Joins lines with a set ``s_host s_line`` of hosts and lines; ``flag`` says whether the line is in it."""
    right = some if flag is None else some.withColumn(flag, F.lit(True))
    met = lines.join(small_side(right, limit), lines["host"].eqNullSafe(right["s_host"]) & (lines[column] == right["s_line"]), how)
    return met.drop("s_host", "s_line")


def boilerplate(scratch: Scratch, measured: DataFrame, min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE, grow: int = GROW) -> tuple[DataFrame, int]:
    """``s_host s_line`` of the boilerplate lines, and how many they are."""
    lines = places(measured)
    per_line = lines.groupBy("host", "line").agg(F.count_distinct("text_hash").alias("n_docs")).where(F.col("n_docs") > min_docs)
    hosts = measured.where(F.size("hashes") > 0).groupBy(F.col("host").alias("h_host")).agg(F.count_distinct("text_hash").alias("host_docs"))
    above = per_line.join(hosts, per_line["host"].eqNullSafe(hosts["h_host"])).where(F.col("n_docs") > max_share * F.col("host_docs"))
    frequent = scratch.table(above.select(F.col("host").alias("s_host"), F.col("line").alias("s_line"), "n_docs"), "frequent")
    n = frequent.count()
    if not n:
        return frequent.select("s_host", "s_line"), 0
    seen = scratch.table(_on(lines, frequent, "line", n).select("host", "line", "before", "after", "n_docs"), "seen")
    sides = seen.groupBy("host", "line").agg(F.max("n_docs").alias("n_docs"), F.count_distinct("before").alias("n_before"), F.count_distinct("after").alias("n_after"))
    edges = sides.where(2 * F.greatest("n_before", "n_after") >= F.col("n_docs")).select(F.col("host").alias("s_host"), F.col("line").alias("s_line"))
    found = scratch.table(edges, "edges")
    size = found.count()
    for _ in range(grow):
        if not 0 < size < n:
            break
        beside = _on(_on(seen, found, "before", size, "left", "b"), found, "after", size, "left", "a")
        near = F.sum(F.when(F.col("a") | F.col("b"), 1).otherwise(0))
        more = beside.groupBy("host", "line").agg(near.alias("near"), F.count("*").alias("n")).where("2 * near >= n").select(F.col("host").alias("s_host"), F.col("line").alias("s_line"))
        found = scratch.table(found.unionByName(more).distinct(), "grown")
        before, size = size, found.count()
        if size == before:
            break
    return found, size


def score(docs: DataFrame, min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE, min_left: float = MIN_LEFT, carry: bool = True) -> DataFrame:
    """Per document the counts, ``n_removed`` lines, ``base_failed`` and ``kept``.

    With ``carry`` also the input row in ``row`` and ``removed``, the hashes of its boilerplate lines (null if none).
    """
    scratch = Scratch(docs.sparkSession, "quality")
    measured = scratch.table(measure(docs, carry=carry), "measured")
    found, n = boilerplate(scratch, measured, min_docs, max_share)
    hit = _on(places(measured), found, "line", n)
    gone = hit.groupBy(F.col("rid").alias("g_rid")).agg(F.sum("size").alias("gone"), F.count("*").alias("n_gone"), F.collect_set("line").alias("removed"))
    gone = scratch.table(gone, "gone")
    met = measured.join(small_side(gone, gone.count()), F.col("rid") == F.col("g_rid"), "left")
    size = F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)
    depleted = F.coalesce(size - F.col("gone") < min_left * size, F.lit(False))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return met.select(
        "doc_id", "host", *COUNTS, F.coalesce("n_gone", F.lit(0)).cast("long").alias("n_removed"),
        failed.alias("base_failed"), (~failed & ~depleted).alias("kept"), *(["removed", "row"] if carry else []),
    )


def cleaned(text: Column, removed: Column) -> Column:
    """The text without the lines of these hashes."""
    pairs = F.arrays_zip(F.split(text, "\n", -1).alias("line"), F.split(_normal(text), "\n", -1).alias("normal"))
    left = F.filter(pairs, lambda x: ~(_has_word(x["line"]) & F.array_contains(removed, _line_hash(x["normal"]))))
    return F.when(removed.isNull(), text).otherwise(F.array_join(F.transform(left, lambda x: x["line"]), "\n"))


def keep(docs: DataFrame, text_col: str = "text", size_col: str = "n_chars") -> DataFrame:
    """The documents that pass, with all their columns and without their boilerplate lines.

    Where lines were removed, ``size_col`` (if there is one) is the new number of code points.
    """
    passed = score(docs).where("kept").select("row.*", F.col("removed").alias("__removed"), cleaned(F.col(f"row.{text_col}"), F.col("removed")).alias("__clean"))
    changed = {text_col: F.col("__clean")}
    if size_col in docs.columns:
        size = F.char_length("__clean").cast(docs.schema[size_col].dataType)
        changed[size_col] = F.when(F.col("__removed").isNull(), F.col(size_col)).otherwise(size)
    return passed.select(*[changed.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])
