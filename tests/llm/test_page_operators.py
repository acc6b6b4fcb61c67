"""Operators over pages and vectors: expected texts, round trips, brute force, SQL, awkward inputs; and the pipeline."""

import base64
import gzip
import hashlib
import html as references
import random
import re
import time
import tracemalloc

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from spanloom.llm import bpe, decontaminate, entries, html, langid, secrets, simhash, topk, warc
from spanloom.llm.common import stored, table

D = "/root/testdata/sf0.001"


def article(source):
    inner = re.search(r"<article>(.*?)</article>", source, re.S)[1]
    blocks = re.split(r"</?(?:p|h1)>|<br>", inner)
    return "\n".join(b for b in (" ".join(references.unescape(re.sub(r"<[^>]+>", "", x)).split()) for x in blocks) if b)


def test_articles_of_the_pages(spark):
    pages = table(spark, D, "pages")
    want = {r["page_id"]: article(r["html"]) for r in pages.collect()}
    got = html.main_text(pages).collect()
    assert {r["page_id"]: r["text"] for r in got} == want and all(r["n_chars"] == len(r["text"]) for r in got)


PAGE = """<html><head><title>x</title><script>if(a<b){"</p>"}</script></head><body><div class="cookie-notice">We use cookies <button>OK</button></div><header><nav><a href=/>Home</a></nav></header>
<main><article><header><h1>Title &amp; more</h1></header><p>First&nbsp;with <a href=x>link</a> and &lt;b&gt;.<p>Second   para
line</p><div class="ad-slot">Buy now!</div><ul><li>one<li>two</ul><aside class="related"><h3>Related</h3><a href=1>Other</a></aside><p>Third para of the text.</p></article>
<section id="comments"><h2>Comments</h2><div class="comment"><p>I disagree with all of this.</p></div><form><input><textarea>t</textarea></form></section></main><aside class="sidebar"><p>Side words.</p></aside><footer>&copy; 2024"""


def test_parts_of_a_page_it_was_not_trained_on():
    assert html.extract(PAGE, html.trained()) == "Title & more\nFirst with link and <b>.\nSecond para line\none\ntwo\nThird para of the text."


def test_marginals_are_exact():
    m, parents = html.trained(), [-1, 0, 1, 1, 0]
    keys = [("#page", "", "", 0, 0, 0), ("div", "#page", "", 0, 1, 1), ("p", "div", "", 0, 2, 2), ("p", "div", "ad", 2, 1, 1), ("nav", "#page", "", 2, 1, 0)]
    total = np.zeros(2)
    marginal = np.zeros((5, 2))
    for s in range(32):
        x = [s >> i & 1 for i in range(5)]
        w = np.exp(sum(m.own(k) for k, v in zip(keys, x, strict=True) if v) + sum(m.pair[2 * x[parents[i]] + x[i]] for i in range(1, 5)))
        total += w
        for i in range(5):
            marginal[i, x[i]] += w
    odds, _ = m.marginals(keys, parents)
    assert odds == pytest.approx(np.log(marginal[:, 1] / marginal[:, 0]))


def test_held_out_layouts():
    m, wrong, n = html.trained(), 0, 0
    for source in html.labelled_pages(80, seed=99):
        page, truth = html.labels(source)
        odds, _ = m.marginals(page.keys(), page.parents)
        wrong += sum((o >= 0) != bool(t) for o, t in zip(odds, truth, strict=True))
        n += len(truth)
    assert wrong / n < 0.03


@pytest.mark.parametrize("part", ["<a ", "<div>", "<li></li>", "</foo>", "<p><button><div>", "<!x", "<a '", '<a x="', "<td><div>", "<h1>", "<script", "<!--", "<li><ul>"])
def test_html_work_is_linear(part):
    """Hostile pages: four times the length takes about four times the time, not sixteen."""
    took = []
    for n in (20_000, 80_000):
        start = time.perf_counter()
        html.Page("<li><ul><foo><td>" + "<div>" * 2000 + part * n)
        took.append(time.perf_counter() - start)
    assert took[1] < 8 * took[0] + 0.5


def test_html_body_without_containers():
    model = html.trained()
    assert html.extract("<body><p>Only one paragraph of plain text stands here, and nothing else does.</p></body>", model) == "Only one paragraph of plain text stands here, and nothing else does."
    assert html.extract("<html><body><h1>A title</h1><p>Some words in the first paragraph of the page.</p><p>And more words in the second one.</p></body></html>", model) == "A title\nSome words in the first paragraph of the page.\nAnd more words in the second one."


PAGES = [(1, "http://a b\n", "same ☃"), (2, None, None), (3, "u", ""), (4, "u", "same ☃"), (5, "u", "WARC/1.1\r\n\r\nx\r\n\r\nContent-Length: 5"), (5, "u", "again"), (None, "u", "null id"), (7, "u", "<p>" + "long " * 100_000)]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(PAGES, "page_id long, url string, html string").select("*", *(F.lit(1).alias(c) for c in ("uid", "digest", "bytes", "original", "text")))


def test_html_awkward(pages):
    got = html.main_text(pages).collect()
    assert len(got) == len(PAGES) and {r["text"] for r in got if r["page_id"] in (2, 3)} == {""}
    assert html.main_text(pages.where("false")).count() == 0


def test_warc_round_trip(pages):
    got = warc.captures(pages).collect()
    groups = {}
    for k, _, t in PAGES:
        groups.setdefault(t or "", []).append(k if k is not None else -1)
    want = []
    for k, _, t in PAGES:
        data, last = (t or "").encode(), max(groups[t or ""])
        revisit = (k if k is not None else -1) != last
        want.append((k, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", last if revisit else None))
    assert sorted(str(tuple(r)) for r in got) == sorted(map(str, want))
    assert warc.captures(pages.where("false")).count() == 0


def test_warc_nested_rows(spark, pages, tmp_path):
    warc.write(pages, str(tmp_path / "w"))
    rows = warc.assemble(warc.read(spark, str(tmp_path / "w"))).collect()
    assert len(rows) == len(PAGES) and all(len(r["request"]) == len(r["metadata"]) == 1 for r in rows)
    assert sorted(r["payload"] for r in rows if r["record_type"] == "response") == sorted({t or "" for _, _, t in PAGES})


def test_warc_small_payloads_are_all_responses(pages):
    assert {r["record_type"] for r in warc.captures(pages, least_bytes=10**7).collect()} == {"response"}


def test_warc_reads_what_others_write(spark, tmp_path):
    """Members, plain files, and payloads made of line breaks, in archives of several records."""
    rng = random.Random(4)
    payloads = ["".join(rng.choice(["\r", "\n", "\r\n", "\r\n\r\n", "x", "WARC/1.1"]) for _ in range(rng.randint(0, 12))) for _ in range(300)]
    one = lambda k, p: f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:{k}>\r\nContent-Length: {len(p) + 4}\r\n\r\nH\r\n\r\n".encode().replace(b"H\r\n\r\n", b"\r\n\r\n") + p.encode() + b"\r\n\r\n"
    records = [one(k, p) for k, p in enumerate(payloads)]
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "part-0.gz").write_bytes(b"".join(map(gzip.compress, records[:100])))
    (tmp_path / "w" / "part-1.gz").write_bytes(gzip.compress(b"".join(records[100:200])))
    (tmp_path / "w" / "part-2.warc").write_bytes(b"".join(records[200:]))
    got = {r["record_id"]: r["payload"] for r in warc.read(spark, str(tmp_path / "w")).collect()}
    assert got == {f"urn:{k}": p for k, p in enumerate(payloads)}
    (tmp_path / "w" / "part-3.gz").write_bytes(gzip.compress(records[0][:-30]))
    with pytest.raises(Exception, match="ends within a record"):
        warc.read(spark, str(tmp_path / "w")).count()


VECTORS = [(0, [1.0, -2.0]), (100, [0.5, 0.5]), (1, [1.0, 1.0]), (2, [1.0, 1.0]), (3, None), (4, [float("nan"), 1.0]), (5, [1.0, None]), (6, []), (7, [3.0]), (None, [9.0, 9.0]), (8, [1.0, 1.0]), (8, [1.0, 1.0]), (9, [float("inf"), 0.0])]


def test_top_k_awkward(spark):
    df = spark.createDataFrame(VECTORS, "vec_id long, embedding array<double>").withColumn("id", F.lit(1))
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk.search(df.drop("id"), F.col("id") % 100 == 0, k=4).collect()}
    one = 1 << 20
    assert [got[100, k] for k in range(1, 5)] == [(7, 3 * one // 2), (1, one), (2, one), (8, one)]
    assert [got[0, k][0] for k in range(1, 5)] == [7, 6, 100, 1]
    assert topk.search(df.where("false"), F.col("id") % 100 == 0).count() == 0
    assert topk.search(df.where("vec_id = 1"), F.col("id") % 100 == 0).count() == 0


@pytest.mark.parametrize("block", [3, 2048])
def test_top_k_equals_brute_force(spark, block):
    df = table(spark, D, "embeddings")
    rows = df.collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.floor(1024 * np.array([r["embedding"] for r in rows], np.float64)).astype(np.int64)
    want = set()
    for q in np.flatnonzero(ids % 20 == 0):
        s = x @ x[q]
        order = [i for i in np.lexsort((ids, -s)) if i != q][:10]
        want |= {(int(ids[q]), k + 1, int(ids[i]), int(s[i])) for k, i in enumerate(order)}
    assert {tuple(r) for r in topk.search(df, F.col("id") % 20 == 0, block=block).collect()} == want


def test_top_k_memory_of_a_full_block():
    rng = np.random.default_rng(2)
    q, x = np.floor(rng.normal(0, 300, (topk.BLOCK, 64))), np.floor(rng.normal(0, 300, (topk.ROWS, 64)))
    tracemalloc.start()
    best = topk.Best(np.arange(len(q)), q, 10, np.full(len(q), -np.inf))
    best.add(np.arange(len(x)) + 10**6, x)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    a, ids, score = best.kept
    want = np.sort(q @ x.T, axis=1)[:, ::-1][:, :10]
    assert (score.reshape(len(q), 10) == want).all() and peak < 400e6


def test_top_k_bounds_hold():
    rng = np.random.default_rng(1)
    q, x = np.floor(rng.normal(0, 300, (20, 64))), np.floor(rng.normal(5, 300, (50, 64)))
    for s in topk.SEGMENTS:
        assert (topk.statistics(q, s) @ topk.statistics(x, s).T >= q @ x.T - 1e-6).all()


@pytest.mark.parametrize("name", sorted(entries.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{D}/{t}.parquet')")
    df = entries.queries()[name](spark, D)
    found = con.execute(entries.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    assert {tuple(str(r[c]) for c in sorted(columns)) for r in df.collect()} == {tuple(str(r[columns.index(c)]) for c in sorted(columns)) for r in found.fetchall()}


def test_pipeline_equals_its_stages_by_hand(spark):
    docs = table(spark, D, "documents")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    # each stage's decision from the operator's own results on what the stage before kept
    lang = {r["doc_id"]: r["lang_pred"] for r in langid.identified(docs).collect()}
    rows = {k: t for k, t in rows.items() if lang[k] != "und"}
    frame = lambda: spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    rows = {r["doc_id"]: rows[r["doc_id"]] for r in simhash.alike(frame()).collect() if r["doc_id"] == r["component_id"]}
    items = [decontaminate.plain(r["text"]) for r in table(spark, D, "benchmark").collect()]
    rows = {k: t for k, t in rows.items() if not any(i in decontaminate.plain(t) for i in items)}
    spans = {r["doc_id"]: r["spans"] for r in secrets.report(frame()).collect()}
    for k, s in spans.items():
        out, at = "", 0
        for _, a, b in (x.split(":") for x in s.split(",") if x):
            if int(b) > at:
                out, at = out + rows[k][at : max(at, int(a))] + "[secret]", int(b)
        rows[k] = out + rows[k][at:]
    want = {k: bpe.digests(t, bpe.model(bpe.vocabulary_path())) for k, t in rows.items()}
    assert {r[0]: tuple(r)[1:] for r in corpus_pipeline.run(spark, D).collect()} == want


def test_pipeline_keeps_the_columns(spark):
    docs = table(spark, D, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stored(stage(spark, docs, D), "stage")
        assert out.columns == docs.columns and 0 < out.count() <= docs.count()
        docs = out


ROWS = [(1, None), (2, ""), (3, "plain words of a first text that stays as it is"), (3, "plain words of a first text that stays as it is"), (4, "plain words of a first text that stays as it is"), (None, "no id but a password=hunter2222 here"), (None, "no id and no secret in these words"), (5, "1234 5678"), (6, "long " * 60_000)]


def test_pipeline_stages_on_awkward_documents(spark):
    docs = spark.createDataFrame([(k, t, "en", "web", 0) for k, t in ROWS], "doc_id long, text string, lang string, source string, n_chars long").select("*", *(F.lit(1).alias(c) for c in ("id", "t", "k", "key", "node", "fp", "spans", "_row", "views", "component_id")))
    left = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stored(stage(spark, docs, D), "stage")
        left[name] = sorted((r["doc_id"] or 0 for r in out.select("doc_id").collect()))
        if name != "tokens":
            assert out.columns == docs.columns
            docs = out
    assert left["language"] == [0, 0, 3, 3, 4, 6] and left["near_duplicates"] == [0, 0, 3, 3, 6]
    assert left["decontaminated"] == left["redacted"] == left["tokens"] == left["near_duplicates"]
    texts = {r["text"] for r in docs.collect()}
    assert "no id but a [secret] here" in texts and "no id and no secret in these words" in texts
    assert all(r["n_chars"] == len(r["text"]) for r in docs.collect())


def test_pipeline_stages_on_an_empty_table(spark):
    docs = table(spark, D, "documents").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, D).count() == 0


def test_stages_hand_few_rows_at_once_to_python(spark):
    """What a worker holds beside Spark's memory is that of a batch, 10,000 rows unless told otherwise."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("a few plain words").alias("text"), F.lit("en").alias("lang"))
    sizes = lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches)
    try:
        for name, stage in corpus_pipeline.STAGES:
            if name != "redacted":  # no Python there
                spark.conf.set(key, 10_000)
                stage(spark, docs.limit(20), D)
                assert docs.coalesce(1).mapInArrow(sizes, "n long").agg(F.max("n")).first()[0] == 1000
    finally:
        spark.conf.set(key, before)
