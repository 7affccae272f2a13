"""Toxicity on held-out documents, page extraction on labelled pages, and top-k search."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from threatlake.llm import html_extract, topk, toxicity
from threatlake.llm.common import table
from threatlake.llm.html_extract import extract_pages, label, learn, main_text
from threatlake.llm.html_tree import blocks, parse
from threatlake.llm.topk import top_inner_products


@pytest.fixture(scope="module")
def insulted(spark):
    """Documents of which a fifth have planted words; half of the held-out ones' endings no label shows."""
    docs = [(r.doc_id, r.text) for r in table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text").collect()]
    rng, rows = random.Random(3), []
    for k, (i, text) in enumerate(docs):
        toxic, held = int(k % 5 == 0), k % 3 == 0
        words = text.split(" ")
        for _ in range(max(3, len(words) // 40) if toxic else 0):
            words.insert(rng.randrange(len(words) + 1), rng.choice(["grobul", "snarvik"]) + rng.choice(["ish", "er", "a", "o"] if held else ["a", "o", "en", "um"]))
        rows.append((i, " ".join(words), toxic, held))
    return spark.createDataFrame(rows, "doc_id bigint, text string, toxic int, held boolean").cache()


def test_toxicity_held_out(insulted):
    learnt = insulted.where("not held").select("doc_id")
    labels = insulted.select("doc_id", "toxic").join(learnt, "doc_id", "left_semi")
    model = toxicity.train_on(insulted, labels, F.lit(True))
    found = toxicity.score_documents(insulted, model).withColumnRenamed("doc_id", "i").join(insulted, F.col("i") == F.col("doc_id")).where("held").collect()
    hit = [r for r in found if r.score >= 0.3]
    right = sum(r.toxic for r in hit)
    assert right / sum(r.toxic for r in found) > 0.8 and right / len(hit) > 0.8
    clean = toxicity.keep_clean(insulted, model, 0.3)
    assert clean.columns == insulted.columns and clean.count() == insulted.count() - toxicity.score_documents(insulted, model).where("score >= 0.3").count()


def test_toxicity_odd_texts(spark, odd_docs, odd_rows, no_docs):
    labels = spark.createDataFrame([(i, k % 2) for k, (i, _, _) in enumerate(odd_rows)] + [(None, 1), (3, None), (4, 7)], "doc_id bigint, toxic int")
    model = toxicity.train_on(odd_docs, labels, F.lit(True))
    found = toxicity.score_documents(odd_docs, model).collect()
    assert len(found) == len(odd_rows) and all(0 <= r.score <= 1 for r in found)
    assert len({r.score for r in found if r.doc_id in (1000, 1001, 1002)}) == 1
    assert toxicity.score_documents(no_docs, model).count() == 0
    nothing = toxicity.train_on(odd_docs, labels.limit(0), F.lit(True))
    assert {round(r.score, 6) for r in toxicity.score_documents(odd_docs, nothing).collect()} == {0.05}


PAGE = """<html><head><title>T</title><script>var a="</p>";</script></head><body><nav><ul><li><a href="/">home</a></li></ul></nav>
<div class="cookie-notice">We use cookies.</div><article><h1>A  title &amp; more</h1><p><b>First&nbsp;part &lt;x&gt;<br>of it. It goes on for some time, as these do.</p>
<div class="ad">Buy this</div><p>Second
 part, which is also of some length. It ends here.<p>Third &eacute; part.</article><aside>More to read</aside>
<section id="comments"><div class="comment"><p>I liked it. Really.</p></div></section><footer>&copy; us</footer>"""


@pytest.fixture(scope="module")
def page_model(spark, sf_dir):
    return html_extract.train_on(table(spark, sf_dir, "pages"))


def test_pages(spark, page_model):
    pages = table(spark, "/root/testdata/sf0.01", "pages")
    html = {r.page_id: r.html for r in pages.collect()}
    right = {}
    for i, page in html.items():
        nodes = parse(page)
        truth = label(nodes)
        right[i] = "\n".join(b.text for b in blocks(nodes) if truth[b.node])
    found = {r.page_id: r for r in extract_pages(pages, page_model).collect()}
    assert sum(found[i].text == right[i] for i in html) >= 0.99 * len(html)
    assert all(r.n_chars == len(r.text) for r in found.values())


def test_page_of_another_kind(page_model):
    assert main_text(page_model, PAGE) == "A title & more\nFirst part <x> of it. It goes on for some time, as these do.\nSecond part, which is also of some length. It ends here.\nThird é part."


def test_layouts(page_model):
    rng, wrong, total = random.Random(5), 0, 0
    prose = [f"This is sentence {k} of a page. It goes on a little, and then it ends." for k in range(30)]
    for _ in range(60):
        nodes, truth = html_extract.variant(rng.sample(prose, 6), ["Something else that is said here.", "Menu"], rng)
        found = blocks(nodes)
        tree = html_extract.as_tree(nodes, found)
        likely, _ = page_model.marginals(tree)
        wrong += sum((likely[tree.place[b.node]] >= 0.5) != truth[b.node] for b in found)
        total += len(found)
    assert wrong <= 0.03 * total


def test_marginals_by_enumeration():
    rng = np.random.default_rng(0)
    model = html_extract.Model(rng.normal(size=html_extract.FEATURES), rng.normal(size=(html_extract.EDGES, 4)))
    tree = html_extract.Tree([[k, k + 9] for k in range(6)], [-1, 0, 0, 1, 1, 2], [0, 3, 4, 3, 5, 6], {})
    weight, inside = 0.0, np.zeros(6)
    for state in range(64):
        y = [state >> k & 1 for k in range(6)]
        w = np.exp(sum(y[k] * model.unary[tree.features[k]].sum() for k in range(6)) + sum(model.pair[tree.edge[k], 2 * y[tree.parent[k]] + y[k]] for k in range(1, 6)))
        weight, inside = weight + w, inside + w * np.array(y)
    assert np.allclose(model.marginals(tree)[0], inside / weight)


def test_odd_pages(spark, page_model):
    deep = "<div>" * 3000 + "deep" + "</div>" * 3000
    rows = [(1, "u", None), (2, None, ""), (3, "v", "no markup at all"), (4, "w", "<p>a<p>b</div></span><<>"), (5, "x", deep), (6, "y", "<article>" + "<p>word and word.</p>" * 20_000 + "</article>"),
            (None, "z", PAGE), (None, "z", PAGE)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("text", F.lit(1)).withColumn("n_chars", F.lit("x"))
    found = extract_pages(df, page_model).collect()
    assert len(found) == len(rows)
    assert {r.page_id: r.text for r in found if r.page_id in (1, 2)} == {1: "", 2: ""}
    assert next(r for r in found if r.page_id == 6).text.count("\n") == 19_999
    assert len({r.text for r in found if r.page_id is None}) == 1
    assert extract_pages(df.limit(0), page_model).count() == 0
    assert learn([]).marginals(html_extract.as_tree(parse("x"), blocks(parse("x"))))[0]


def _brute(rows, k):
    def fine(v):
        return v is not None and all(x is not None and np.isfinite(x) for x in v)

    rows = [(i, [int(np.floor(64 * float(x))) for x in v]) for i, v in rows if i is not None and fine(v)]
    out = {}
    for q, v in rows:
        if q % 5 == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w)), c) for c, w in rows if c != q)[:k]
            out[q] = [(c, -s) for s, c in scores]
    return {q: x for q, x in out.items() if x}


@pytest.mark.parametrize("scale", [1.0, 1e6])  # products of the second are above 2^52, where doubles end, and below 2^63
def test_top_inner_products(spark, monkeypatch, scale):
    monkeypatch.setattr(topk, "BLOCK", 16)
    monkeypatch.setattr(topk, "QUERIES", 8)
    rng = np.random.default_rng(1)
    rows = [(k, (rng.normal(size=24) * rng.uniform(0.1, 2) * scale).astype(np.float32).tolist()) for k in range(120)]
    rows += [(200 + k, rows[7][1]) for k in range(30)]  # ties
    rows += [(300, None), (301, [float("nan")] * 24), (302, [None] * 24), (303, [float("inf")] * 24), (None, rows[3][1]), (305, [0.0] * 24)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("score", F.lit("x")).withColumn("norm", F.lit(1)).repartition(3)
    found = {}
    for r in top_inner_products(df, F.col("vec_id") % 5 == 0, k=10).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(found[r.query_id])
    assert found == _brute([(i, None if v is None else [None if x is None else np.float32(x) for x in v]) for i, v in rows], 10)


def test_top_inner_products_beyond_64_bits(spark):
    df = spark.createDataFrame([(k, [3e8 + k, 1.0]) for k in range(3)], "vec_id bigint, embedding array<double>")
    with pytest.raises(Exception, match="does not fit 64 bits"):
        top_inner_products(df, F.lit(True), k=2).collect()


def test_top_inner_products_of_few(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [0.5, -1.0]), (5, [0.0, 0.0])], "vec_id bigint, embedding array<float>")
    found = top_inner_products(df, F.col("vec_id") % 5 == 0, k=20).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in found) == [(0, 1, 5, 0), (0, 2, 1, -6144), (5, 1, 0, 0), (5, 2, 1, 0)]
    assert top_inner_products(df.limit(0), F.lit(True)).count() == 0
