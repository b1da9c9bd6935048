"""The registered queries of the ten operators, and SQL where SQL can express one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skewloom.session import Scratch, read_table

from . import decontam, html_extract, licenses, mixing, quality, secrets, simhash, sstable, substring, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """The path of a public tokenizer's file; it is read where it is."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_block_labeller(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(read_table(spark, sf_dir, "pages", spread=True))


def op2_capture_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, scratch = read_table(spark, sf_dir, "pages", spread=True), Scratch(spark, "warc")
    found = warc.lookup(warc.index(scratch, warc.write(scratch, pages)), pages)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


def op3_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.score(read_table(spark, sf_dir, "documents", spread=True), read_table(spark, sf_dir, "benchmark")).drop("row")


def op4_golay_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.cluster(read_table(spark, sf_dir, "documents", spread=True))
    return found.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def op5_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = mixing.schedule(read_table(spark, sf_dir, "documents", spread=True))
    each = placed.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return each.select("doc_id", "source", "chars", "before", "block", "slot", "release", "deadline")


def op6_collinear_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.passages(read_table(spark, sf_dir, "documents", spread=True))


def op7_guess_cost_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find(read_table(spark, sf_dir, "documents", spread=True), vocabulary=vocabulary())


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(read_table(spark, sf_dir, "documents", spread=True), carry=False).drop("host")


def op9_minhash_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.find(read_table(spark, sf_dir, "documents", spread=True))


def op10_sorted_string_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sstable.read(sstable.write(read_table(spark, sf_dir, "documents", spread=True), vocabulary()))


QUERIES |= {
    "op1_block_labeller": op1_block_labeller,
    "op2_capture_index": op2_capture_index,
    "op3_winnowing": op3_winnowing,
    "op4_golay_simhash": op4_golay_simhash,
    "op5_pfair_mixing": op5_pfair_mixing,
    "op6_collinear_passages": op6_collinear_passages,
    "op7_guess_cost_secrets": op7_guess_cost_secrets,
    "op8_quality_rules": op8_quality_rules,
    "op9_minhash_licenses": op9_minhash_licenses,
    "op10_sorted_string_tables": op10_sorted_string_tables,
}


def quality_sql(min_docs: int = quality.MIN_DOCS, max_share: float = quality.MAX_SHARE, min_left: float = quality.MIN_LEFT, grow: int = quality.GROW) -> str:
    """The quality rules in SQL; the lines that each round of growth adds are a table."""
    near = lambda k: f"(c.before IN (SELECT norm FROM m{k} WHERE source IS NOT DISTINCT FROM c.source) OR c.after IN (SELECT norm FROM m{k} WHERE source IS NOT DISTINCT FROM c.source))"
    rounds = "".join(
        f"""m{k + 1} AS (SELECT * FROM m{k} UNION SELECT source, norm FROM f c GROUP BY source, norm HAVING 2 * sum(CASE WHEN {near(k)} THEN 1 ELSE 0 END) >= count(*)),
"""
        for k in range(grow)
    )
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
g0 AS (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3),
g AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, ws[i], ws[i + 1], ws[i + 2]) AS c FROM g0),
p AS (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM g WHERE c > 1),
r AS (SELECT rid, count(DISTINCT p) AS n FROM p GROUP BY rid),
l0 AS (SELECT rid, source, t, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM d),
l AS (SELECT *, trim(lower(regexp_replace(line, '[\x20\x09-\x0D0-9]+', ' ', 'g')), ' ') AS norm FROM l0 WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dl AS (SELECT rid, count(*) - count(DISTINCT line) AS n FROM l GROUP BY rid),
c AS (SELECT *, lead(norm) OVER (PARTITION BY rid ORDER BY i) AS after, lag(norm) OVER (PARTITION BY rid ORDER BY i) AS before FROM l),
n AS (SELECT source, norm, count(DISTINCT t) AS n_docs FROM c GROUP BY source, norm),
hd AS (SELECT source, count(DISTINCT t) AS host_docs FROM c GROUP BY source),
fr AS (SELECT n.source, n.norm, n_docs FROM n JOIN hd ON n.source IS NOT DISTINCT FROM hd.source WHERE n_docs > {min_docs} AND n_docs > {max_share}::DOUBLE * host_docs),
f AS (SELECT c.*, n_docs FROM c JOIN fr ON c.source IS NOT DISTINCT FROM fr.source AND c.norm = fr.norm),
m0 AS (SELECT source, norm FROM f GROUP BY source, norm HAVING 2 * greatest(count(DISTINCT before), count(DISTINCT after)) >= max(n_docs)),
{rounds}s AS (SELECT l.rid, sum(length(line)) AS ac, sum(CASE WHEN m.norm IS NULL THEN length(line) ELSE 0 END) AS lc, count(m.norm) AS n_removed
      FROM l LEFT JOIN m{grow} m ON l.source IS NOT DISTINCT FROM m.source AND l.norm = m.norm GROUP BY l.rid),
b AS (
  SELECT d.rid, d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(dl.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words
  FROM d JOIN w USING (rid) LEFT JOIN dl USING (rid) LEFT JOIN r USING (rid))
SELECT b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT coalesce(lc < {min_left}::DOUBLE * ac, false) AS kept
FROM b LEFT JOIN s USING (rid)
"""


ORACLES["op3_winnowing"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
bl AS (SELECT item, ws, least(len(ws), 10) AS k FROM b WHERE len(ws) > 0),
bs AS (SELECT item, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM bl),
bw AS (SELECT DISTINCT item, k, array_to_string(ws[i:i + k - 1], ' ') AS span FROM bs),
ks AS (SELECT DISTINCT k FROM bw),
ds AS (SELECT rid, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM d, ks WHERE len(ws) >= k),
dw AS (SELECT rid, i, k, array_to_string(ws[i:i + k - 1], ' ') AS span FROM ds),
h AS (SELECT dw.rid, dw.i, dw.k, bw.item FROM dw JOIN bw ON dw.span = bw.span AND dw.k = bw.k),
pos AS (SELECT rid, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT rid, i, k FROM h)),
nh AS (SELECT rid, count(DISTINCT p) AS n_hit FROM pos GROUP BY rid),
it AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT rid, item FROM h) GROUP BY rid)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN nh USING (rid) LEFT JOIN it USING (rid)
"""

ORACLES["op2_capture_index"] = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages),
s AS (SELECT *, octet_length(encode(html)) AS n, sha1(html) AS dig FROM p),
t AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS top FROM s)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, dig AS payload_digest,
       CASE WHEN n >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id <> top THEN top END AS refers_to, url
FROM t
"""
ORACLES["op9_minhash_licenses"] = licenses.oracle()
ORACLES["op8_quality_rules"] = quality_sql()
