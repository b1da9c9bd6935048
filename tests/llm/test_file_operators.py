"""HTML, WARC, mixing, token tables and the pipeline."""

import gzip
import random
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from skewloom.llm import files, html_blocks, html_extract, mixing, page_maker, sstable, warc
from skewloom.llm.queries import vocabulary
from skewloom.session import Scratch, read_table

# html


def test_blocks():
    page = """<title>t</title><nav><a href="/x">Menu</a></nav><!-- <p>no</p> --><p>One&nbsp; &amp two<br>three <b>four<p>Five<script>var a="</p>";</script><ul><li>A<li>B</ul>
    <table><tr><td>1<td>2</table><textarea>no</textarea><div title="a > b">Six</div>tail"""
    found = html_blocks.blocks(page)
    assert [b.text for b in found] == ["Menu", "One & two three four", "Five", "A", "B", "1", "2", "Six", "tail"]
    assert found[0].link == 4 and found[1].link == 0
    for odd in ("", "<", "<p", "plain", "</p></div>", "<p class='x>y", "<script>never closed", "<!-- open", "&#x110000;&bogus;", "<b>" * 5000 + "x"):
        html_blocks.blocks(odd)


def test_long_and_hostile_tags():
    long = "x" * 9000
    page = f"""<p title="{long} > <b>no</b>">One<p data-a='{long}>' class='{" ".join(f"c{k}" for k in range(40))} last'>Two"""
    found = html_blocks.blocks(page)
    assert [b.text for b in found] == ["One", "Two"] and "last" in found[1].path[-1][1]
    for odd in ("<a b='" * 30_000, "<a b=" * 30_000, "<!-- " * 30_000, '<p x="1">y' * 20_000, "<p it's>a"):
        html_blocks.blocks(odd)


@pytest.mark.parametrize(
    "page, want",
    [
        ("<body><div><h1>Storm hits the coast</h1><p>Winds of up to ninety miles an hour brought down trees and power lines, officials said.</p><p>Repairs are going to take some days, and schools stay closed.</p><ul><li>Bring water and batteries.</li><li>Stay away from the shore.</li></ul></div></body>", "Storm hits the coast\nWinds of up to ninety miles an hour brought down trees and power lines, officials said.\nRepairs are going to take some days, and schools stay closed.\nBring water and batteries.\nStay away from the shore."),
        ("<body><table><tr><td><a href=/n>News</a> <a href=/s>Sport</a></td></tr><tr><td><p>The council met on Monday to vote on the new bridge, which is to open next year.</p><p>Work begins in spring, the mayor told reporters after the vote.</p></td></tr></table></body>", "The council met on Monday to vote on the new bridge, which is to open next year.\nWork begins in spring, the mayor told reporters after the vote."),
    ],
)
def test_pages_without_semantic_tags(page, want):
    assert html_extract.texts_of(html_extract.trained(), [page]) == [want]


def test_labeller_on_held_out_pages():
    model = html_extract.trained()
    xs, ys = html_extract.practice(150, 4242)
    right = np.concatenate([a == (b > 0) for a, b in zip(model.label(xs), ys, strict=True)])
    assert right.mean() > 0.97
    # Pages without article or main element, where no rule on tags would do.
    made = [(p, y) for p, y in page_maker.pages(400, 777) if "<article" not in p and "<main" not in p]
    pairs = [(html_blocks.blocks(p), y) for p, y in made]
    pairs = [(b, y) for b, y in pairs if len(b) == len(y)]
    right = np.concatenate([a == np.array(y) for a, (_, y) in zip(model.label([html_blocks.features(b) for b, _ in pairs]), pairs, strict=True)])
    assert right.mean() > 0.95


def test_gradients():
    model = html_extract.Labeller(hidden=3)
    xs, ys = html_extract.practice(3, 1)
    x, mask = html_extract._padded([a[:4] for a in xs])
    y = np.zeros(mask.shape[:2], np.float32)
    g = model.gradients(x, mask, y)

    def loss():
        z, _ = model.logits(x.astype(np.float64), mask)
        return (np.logaddexp(0, z) * mask[..., 0]).sum() / mask.sum()

    for k in ("uf", "ub", "wf", "bb", "v"):
        at = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        old = model.p[k]
        e, lows = np.zeros(old.shape), []
        e[at] = 1e-3
        for s in (1, -1):
            model.p[k] = old.astype(np.float64) + s * e
            lows.append(loss())
        model.p[k] = old
        assert (lows[0] - lows[1]) / 2e-3 == pytest.approx(g[k][at], rel=0.05, abs=1e-5)


def test_pages_of_the_table(spark, data):
    pages = read_table(spark, data, "pages")
    got = {r.page_id: r for r in html_extract.extract(pages).collect()}
    for p in pages.collect():
        want = "\n".join(b.text for b in html_blocks.blocks(p.html) if any(t == "article" for t, _ in b.path))
        assert got[p.page_id].text == want and got[p.page_id].n_chars == len(want)


def test_odd_pages(spark):
    rows = [(1, None, None), (2, "u", ""), (2, "u", ""), (None, None, "<p>x"), (3, "u", "<div>" + "<p>word " * 20_000)]
    out = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(out) == 5 and all(r.n_chars == len(r.text) for r in out)
    assert all(r.text == "" for r in out if r.page_id in (1, 2))


def test_practice_labels_match_blocks():
    made = page_maker.pages(100, 1)
    assert sum(len(html_blocks.blocks(p)) == len(y) for p, y in made) >= 95


# warc


def test_url_key():
    assert warc.url_key("https://www.Example.com:443/a/b?q=1#top") == "com,example)/a/b?q=1"
    assert warc.url_key("http://a.b.org:8080") == "org,b,a:8080)/" and warc.url_key(None) == "" and warc.url_key("http://[bad") == "!http://[bad"


def test_archive_round_trip(spark, monkeypatch):
    big = "é" * 700
    rows = [(k, f"http://h{k % 3}.org/{k % 7}", f"<p>{k % 11}</p>" if k % 2 else big + str(k % 3)) for k in range(60)]
    rows += [(None, None, None), (60, None, ""), (60, None, ""), (61, "http://x\n y", big + "0"), (None, "http://n", big + "0"), (59, rows[59][1], rows[59][2])]
    pages = spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, digest string")
    scratch = Scratch(spark, "t")
    captures = warc.write(scratch, pages, file_bytes=3000)
    shards = warc.index(scratch, captures, shard_captures=10, block_lines=3)
    assert shards.count() > 3 and captures.select("path").distinct().count() > 3
    got = sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.lookup(shards, pages).collect())
    import hashlib

    top = {}
    for i, _, h in rows:
        top[h or ""] = max(top.get(h or "", -1), -1 if i is None else i)
    want = []
    for i, _, h in rows:
        raw = (h or "").encode()
        to = top[h or ""] if len(raw) >= 1000 and i != top[h or ""] else None
        want.append((str(i), len(raw), hashlib.sha1(raw).hexdigest(), "response" if to is None else "revisit", to))
    assert got == sorted(want, key=lambda x: x[:4]) or sorted(map(str, got)) == sorted(map(str, want))
    one = warc.lookup(shards, pages.where("page_id = 5")).collect()
    assert {r.page_id for r in one} == {r[0] for r in rows if r[1] == rows[5][1]}
    path = captures.first().path
    whole = gzip.decompress(files.reader(path).read())  # members one after the other
    assert whole.startswith(b"WARC/1.1\r\n")


# mixing


@pytest.mark.parametrize("counts", [{0: 50, 1: 500, 2: 7}, {0: 1}, {0: 3000, 1: 1, 2: 1000, 3: 1000}])
def test_schedule_stays_within_a_block(counts):
    weights = {s: (s + 1) ** 0.5 for s in counts}
    placed = list(mixing.placements(counts, weights))
    assert sorted((s, ph.first[s] + k) for ph, s, k in placed) == sorted((s, k) for s, n in counts.items() for k in range(n))
    for slot, (ph, s, k) in enumerate(placed):
        release, deadline = ph.window(s, k)
        assert release <= slot < deadline and sum(ph.share.values()) == ph.period
        t = slot + 1 - ph.base
        for x, a in ph.share.items():
            if t % 7 == 0:
                got = sum(q is ph and y == x for q, y, _ in placed[ph.base : slot + 1])
                assert abs(got - Fraction(t * a, ph.period)) < 1


@pytest.mark.parametrize("weights", [{0: 1, 1: 2}, {0: 0.0001, 1: 0.3, 2: 0.6999}, {0: 2**0.5, 1: 3**0.5, 2: 1.0}])
def test_schedule_keeps_the_given_weights(weights):
    counts = {s: 1 + int(40_000 * w / sum(weights.values())) for s, w in weights.items()}
    got = dict.fromkeys(weights, 0)
    for t, (_, s, _) in enumerate(mixing.placements(counts, weights), 1):
        got[s] += 1
        if t <= 30_000:
            assert all(abs(got[x] - t * w / sum(weights.values())) < 1 + 1e-6 for x, w in weights.items())


def test_mixed_rows(spark, docs_of, prose, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE_ROWS", 20)
    monkeypatch.setattr(mixing, "SLOT_ROWS", 7)
    docs = docs_of([(k, prose(5 + k % 40, k), "abc"[min(2, k % 5)]) for k in range(150)])
    placed = {r.doc_id: r for r in mixing.schedule(docs, {"a": 1, "b": 1, "c": 2}, block_chars=200).collect()}
    texts = {r.doc_id: r for r in docs.collect()}
    for s in "abc":
        before = 0
        for i in sorted(i for i in placed if texts[i].source == s):
            assert placed[i].before == before and placed[i].block == before // 200 and placed[i].release <= placed[i].slot < placed[i].deadline
            before += len(texts[i].text)
    order = [r.doc_id for r in mixing.mix(docs, {"a": 1, "b": 1, "c": 2}, block_chars=200).collect()]
    assert order == sorted(placed, key=lambda i: (placed[i].slot, placed[i].before))


# tokens


def test_encoder_is_exact(prose):
    e = sstable.Encoder(vocabulary())
    odd = ["don't it's 'STRASSE' Straße İstanbul ΣΑΣ éx ́ a\tc\x1cd <|endoftext|>x <|endoftext|> 12ab34,, ...!! ½ 漢字 ﬁ x​y K", "", " ", "\n\n", "a" * 300 + "." + "é" * 99, "ŉ ǰ, ﬃ; 한, ÀÉ) it'S, THEY'LL!"]
    for t in [*odd, prose(500, 1), " ".join(odd)]:
        assert np.frombuffer(e.encode(t), "<u4").tolist() == e.tok.encode(t, add_special_tokens=False).ids


def test_encoder_on_random_strings():
    e, r = sstable.Encoder(vocabulary()), random.Random(5)
    letters = ["İ", "ı", "ß", "É", "é", "Ω", "Σ", "ς", "Ǆ", "ŉ", "ﬁ", "한", "漢", "A", "b", "q", "\u0307", "\u0301", "\u0338", "ª", "ⅷ", "٣", "7", "'s", "'", "\x85", "\xa0", "\u2028", "\x1c", "\t"]
    drawn = letters + list(sstable.PUNCTUATION) + ["İ", "ab", " "]
    texts = ["".join(r.choice(drawn) for _ in range(r.randint(1, 9))) for _ in range(60_000)]
    want = [x.ids for x in e.tok.encode_batch(texts, add_special_tokens=False)]
    wrong = [t for t, a, b in zip(texts, e.encode_all(pa.array(texts)), want, strict=True) if a.tolist() != b]
    assert wrong == []


def test_parts_of_a_long_text(prose, monkeypatch):
    e = sstable.Encoder(vocabulary())
    texts = [prose(700, 1), None, "", prose(30, 2), prose(2, 3) * 40, prose(300, 4)]
    want = [e.tok.encode(t or "", add_special_tokens=False).ids for t in texts]
    for size in (64, 1000, 1 << 20):
        monkeypatch.setattr(sstable, "ENCODE_BYTES", size)
        assert [x.tolist() for x in sstable._encoded(e, pa.array(texts))] == want


def test_tables(spark, docs_of, prose):
    rows = [(k * 3 - 30, prose(k % 50, k), "s") for k in range(120)] + [(None, "x", "s"), (0, prose(4, 1), "s"), (0, prose(4, 2), "s")]
    manifest = sstable.write(docs_of(rows), vocabulary(), shard_bytes=4000)
    got = sorted(sstable.read(manifest).collect(), key=lambda r: r.start)
    tok = sstable.Encoder(vocabulary()).tok
    key = lambda x: (x is not None, x or 0)
    assert [r.doc_id for r in got] == sorted((i for i, *_ in rows), key=key) and len({r.shard for r in got}) > 2
    start = 0
    for r in got:
        assert r.start == start
        start += r.n_tokens
    want = sorted(zlib.crc32(np.array([*tok.encode(t, add_special_tokens=False).ids, 1], "<u4").tobytes()) for _, t, _ in rows)
    assert sorted(r.ids_crc32 for r in got) == want
    tables = [sstable.TableReader(r.path) for r in manifest.collect()]
    for i in (-30, 0, 327, None):
        assert sum(len(t.lookup(i)) for t in tables) == sum(x == i for x, *_ in rows)
    assert sum(len(t.lookup(1)) for t in tables) == 0 and sum(t.may_have(k) for t in tables for k in range(10_001, 10_301)) < 30 * len(tables)


# pipeline


def test_pipeline(spark, data):
    docs = read_table(spark, data, "documents")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, data)
        assert out.columns == docs.columns, k
    got = corpus_pipeline.run(spark, data).collect()
    ids = {r.doc_id for r in got}
    assert len(ids) == len(got) > 50
    rows = sorted(got, key=lambda r: r.start)
    assert [r.start for r in rows] == [sum(x.n_tokens for x in rows[:k]) for k in range(len(rows))]


def test_pipeline_stages_by_hand(spark, data):
    """Each stage's rows follow from its operator's verdicts on the rows that the one before it kept."""
    from skewloom.llm import decontam, quality, simhash

    docs = read_table(spark, data, "documents")
    kept = docs.join(quality.score(docs).where("kept").select("doc_id"), "doc_id", "left_semi")
    names = simhash.cluster(kept).collect()
    first = {r.component_id for r in names}
    third = decontam.score(kept.where(kept["doc_id"].isin(list(first))), read_table(spark, data, "benchmark"))
    want = {r.doc_id for r in third.where("NOT contaminated").collect()}
    assert {r.doc_id for r in corpus_pipeline.run(spark, data).collect()} == want
