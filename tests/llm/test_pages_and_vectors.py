"""Operators on pages and embeddings."""

import numpy as np
import pytest

from wardline.llm import html_text, pivots, url_rules
from wardline.llm.dom import Page, decode


@pytest.fixture(scope="module")
def model():
    return html_text.train()


def test_url_rules(spark):
    urls = [(1, None), (2, "no scheme"), (3, "http://Example.ORG/es/x?q#f"), (4, "https://a.example.org/en/18"), (5, "http://org"), (6, "http://myorg/"),
            (7, "x://shop.com/fr/1"), (8, "x://shop.com/de/1"), (9, "x://com/de/"), (10, "x://a.org/?x"), (None, "x://b.net/en/1"), (3, "http://Example.ORG/es/x?q#f")]
    pages = spark.createDataFrame([(i, u, "h", "r") for i, u in urls], "page_id long, url string, host string, rule string")
    got = sorted((tuple(r) for r in url_rules.judge(pages, url_rules.rule_table(spark, url_rules.RULES)).collect()), key=lambda r: (r[0] or 0, r[1]))
    by = {r[0]: r[1:] for r in got}
    assert len(got) == 12
    assert by[1] == ("", "", None, "allow") and by[3] == ("example.org", "/es/x", "example.org/es/", "block") and by[4][2:] == ("example.org/en/1", "block")
    assert by[5] == ("org", "", None, "allow") and by[6][2] is None and by[7][2:] == ("com/fr/", "allow") and by[8][2:] == ("com/de/", "block") and by[9][3] == "block"
    assert by[10] == ("a.org", "/", "org/", "allow") and by[None] == ("b.net", "/en/1", None, "allow")
    assert url_rules.judge(pages.where("false"), url_rules.rule_table(spark, url_rules.RULES)).count() == 0
    assert url_rules.judge(pages, url_rules.rule_table(spark, [])).count() == 12


def test_main_text(model):
    page = ("<html><head><title>x</title></head><body><nav class=menu><a href=/>Home</a> <a href=/b>News</a></nav><div class='ad'>Buy now and save.</div>"
            "<article><h1>A &amp; B</h1><p>First  long <b>para</b>graph of\n the text, with more words in it.<p>Second one, also of some length, ends here.</article>"
            "<section id=comments><p>I like it.</p></section><footer>&copy; me</footer>")
    assert html_text.extract([page, None, "", "<p>", "no < tags & all"], model)[:3] == [
        "A & B First long paragraph of the text, with more words in it. Second one, also of some length, ends here.", "", ""]


def test_attributes_of_real_pages_are_no_labels(model):
    text = "First long paragraph of the text, with more words in it, and a second sentence."
    page = f'<body><article data-year="2024"><h1 data-youtube="a">Head line</h1><p data-yt>{text}</p><p data-y="x">{text}</p><p x-data-y="7">{text}</p></article></body>'
    assert html_text.extract([page], model) == [f"Head line {text} {text} {text}"]
    assert set(Page(page).label) == {None} and Page('<p data-y="1">a</p>').label == [None, 1] and Page('<p data-y="1">a</p>', labels=False).label == [None, None]


def test_formulas_and_fallback_content_are_read(model):
    long = "of the text, with many more words in it, and then a second sentence that ends here."
    math = '<math display="inline"><semantics><mrow><mi>e</mi><mo>=</mo><msup><mi>m</mi><mn>2</mn></msup></mrow></semantics></math>'
    page = (f"<article><h1>Head line</h1><p>First paragraph {math} {long}</p><noscript><p>Second paragraph {long}</p></noscript>"
            f"<p>Third paragraph {long}</p><object data=x><p>Fourth paragraph {long}</p></object></article>")
    assert html_text.extract([page], model) == [f"Head line First paragraph e=m2 {long} Second paragraph {long} Third paragraph {long} Fourth paragraph {long}"]
    for tag in ("noscript", "object", "audio", "video", "canvas"):
        p = Page(f"<p>one <{tag}>two</{tag}> three</p><div>four</div>")
        assert [(p.tag[n], t.strip()) for n, t in p.pieces] == [("p", "one"), (tag, "two"), ("p", "three"), ("div", "four")]
        assert Page(f"<p>one <{tag}>two</p><div>four</div>").parent == [-1, 0, 1, 0]


def test_held_out_pages(model):
    import re

    from wardline.llm.dom import main_text
    from wardline.llm.training_pages import pages

    same = 0
    for source in pages(60, 4242):
        p = Page(source)
        want = main_text(p, np.array([1 if x is None else x for x in p.label], dtype=bool))
        same += html_text.extract([re.sub(r' data-y="\d"', "", source)], model)[0] == want
    assert same >= 54


def test_decoding_keeps_nothing_below_a_dropped_node():
    kept = decode([-1, 0, 1, 2, 0], np.array([3.0, -5.0, 2.0, 1.0, 4.0]))
    assert kept.tolist() == [True, False, False, False, True]


def test_vectors(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(300, 32))
    near = base[:60] + rng.normal(size=(60, 32)) * 0.25
    v = np.vstack([base, near]).astype(np.float32)
    rows = [(i, x.tolist(), 0) for i, x in enumerate(v)] + [(1000 + i, v[0].tolist(), None) for i in range(50)]
    rows += [(2000, None, 1), (2001, [0.0] * 32, 1), (2002, [float("nan")] * 32, 1), (2003, [None] + [1.0] * 31, 1), (2004, [], 1), (2005, [1.0, 2.0], 1), (2006, [2.0, 4.0], 1), (None, v[1].tolist(), 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in pivots.near_vectors(df).collect()}
    ids = [r[0] for r in rows[:410]]
    x = np.array([r[1] for r in rows[:410]], dtype=float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    ids.append(None)
    x = np.vstack([x, x[1]])
    link = x @ x.T >= 0.9
    want = link.sum(1) - 1
    found = sum(got[i][0] for i in ids)
    assert found >= 0.9 * want.sum() and all(got[i][0] <= n for i, n in zip(ids, want))
    assert got[0] == (want[0], 0) and got[1000][1] == 0
    assert [got[i] for i in range(2000, 2005)] == [(0, i) for i in range(2000, 2005)]
    assert got[2005] == (1, 2005) and got[2006] == (1, 2005)
    assert pivots.near_vectors(df.where("false")).count() == 0


@pytest.mark.parametrize("dim, block", [(32, 64), (64, 1024)])
def test_large_clusters_at_four_noises(spark, monkeypatch, dim, block):
    monkeypatch.setattr(pivots, "BLOCK", block)
    rng = np.random.default_rng(dim)
    noises = [0.1, 0.2, 0.3, 0.34]
    v = np.vstack([c + n * np.linalg.norm(c) / np.sqrt(dim) * rng.normal(size=(125, dim)) for n in noises for c in rng.normal(size=(3, dim))])
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in pivots.near_vectors(df).collect()}
    x = v / np.linalg.norm(v, axis=1)[:, None]
    want = (x @ x.T >= 0.9).sum(1) - 1
    assert all(got[i] <= n for i, n in enumerate(want))
    for i in range(4):
        part = range(375 * i, 375 * (i + 1))
        assert sum(got[j] for j in part) >= 0.9 * sum(want[j] for j in part) > 10_000, noises[i]


def test_reference_points_are_apart_and_many():
    rng = np.random.default_rng(1)
    sample = np.repeat(rng.normal(size=(5, 16)), 40, axis=0) + 0.01 * rng.normal(size=(200, 16))
    sample /= np.linalg.norm(sample, axis=1, keepdims=True)
    p = pivots.reference_points(sample, 64)
    cosine = p[:5] @ p[:5].T - np.eye(5)
    assert p.shape == (64, 16) and cosine.max() < pivots.APART and np.allclose(np.linalg.norm(p, axis=1), 1)
