"""Every operator on odd rows, on empty tables and with extra columns: defined results, no crash."""

import pytest

from skewloom.llm import decontam, html_extract, licenses, mixing, quality, secrets, simhash, sstable, substring, warc
from skewloom.llm.queries import vocabulary
from skewloom.session import Scratch

BENCH = "item_id long, text string, row string"


def bench(spark, rows=()):
    return spark.createDataFrame([(*r, "x") for r in rows], BENCH)


def runs(spark, docs):
    return {
        "decontam": decontam.score(docs, bench(spark, [(1, "one"), (2, None), (None, "two"), (3, "")])).drop("row"),
        "simhash": simhash.cluster(docs),
        "mixing": mixing.mix(docs),
        "secrets": secrets.find(docs),
        "quality": quality.score(docs).drop("row"),
        "tokens": sstable.read(sstable.write(docs, vocabulary())),
    }


@pytest.mark.parametrize("extra", [False, True])
def test_one_row_for_each_row(spark, docs_of, odd_rows, extra):
    docs = docs_of(odd_rows, extra)
    for name, out in runs(spark, docs).items():
        got = sorted((r.doc_id is not None, r.doc_id or 0) for r in out.collect())
        assert got == sorted((i is not None, i or 0) for i, *_ in odd_rows), name


@pytest.mark.parametrize("extra", [False, True])
def test_stages_keep_columns(spark, docs_of, odd_rows, extra):
    docs = docs_of(odd_rows, extra)
    kept = [quality.keep(docs), simhash.keep(docs), decontam.keep(docs, bench(spark, [(1, "one")])), mixing.mix(docs)]
    assert all(k.columns == docs.columns for k in kept)
    ids = [sorted(r.doc_id for r in k.collect() if r.doc_id is not None) for k in kept]
    assert ids[1] == [1, 4, 5, 7, 8, 9] and 8 not in ids[2] and len(ids[3]) == 11


def test_empty_tables(spark, docs_of):
    docs = docs_of([])
    for name, out in runs(spark, docs).items():
        assert out.count() == 0, name
    assert licenses.find(docs).count() == 0 and substring.passages(docs).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_extract.extract(pages, practice_pages=20).count() == 0
    scratch = Scratch(spark, "t")
    assert warc.lookup(warc.index(scratch, warc.write(scratch, pages)), pages).count() == 0
    some = docs_of([(1, "one two", "a")])
    assert decontam.score(some, bench(spark)).first().n_hit == 0


def test_null_values(spark, docs_of, odd_rows):
    docs = docs_of(odd_rows)
    q = {r.doc_id: r for r in quality.score(docs).collect()}
    assert q[1].n_words == q[2].n_words == q[3].n_words == 0 and q[1].base_failed and not q[1].kept
    s = {r.doc_id: r for r in simhash.cluster(docs).collect()}
    assert s[1].print == s[2].print == s[3].print == 0 and s[2].component_id == 1
    assert {r.component_id for r in simhash.cluster(docs).where("doc_id IS NULL").collect()} == {None}
    t = {r.doc_id: r for r in sstable.read(sstable.write(docs, vocabulary())).collect()}
    assert t[1].n_tokens == t[2].n_tokens == 1
    x = {r.doc_id: r for r in secrets.find(docs).collect()}
    assert x[1].spans == "" and x[1].n_assign == 0
    assert licenses.find(docs).count() == 0
    assert {r.doc_id for r in substring.passages(docs).collect()} <= {4, 6}


def test_near_duplicate_texts_are_not_shuffled(spark, docs_of):
    words = lambda k: " ".join(f"w{k}n{c}" for c in range(30))
    rows = [(k, words(k % 40), "s") for k in range(60)] + [(None, words(90), "s"), (3, words(3), "s")]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = simhash.keep(docs_of(rows))
        plan = kept._jdf.queryExecution().toString()
        assert sorted((r.doc_id is None, r.doc_id) for r in kept.where("doc_id IS NOT NULL").collect()) == [(False, k) for k in range(40)]
        assert kept.where("doc_id IS NULL").count() == 1 and "SortMergeJoin" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
