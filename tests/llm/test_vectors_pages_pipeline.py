import collections
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from caseloom.llm import block_nn, components, embedding_dedup, queries, quality_nbsvm, wrapper_html

from .conftest import SF01, prose
from .test_text_operators import base_spans, brute_groups, words


@pytest.fixture(scope="module")
def odd_vectors(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(90, 6))
    x[30:45] = x[3] + rng.normal(scale=0.05, size=(15, 6))
    x[45:60] = x[4]
    rows = [(i, [float(v) for v in np.float32(r)]) for i, r in enumerate(x)]
    rows += [(100, None), (101, [0.0] * 6), (102, [1.0, None, 0, 0, 0, 0]), (103, [float("nan")] * 6), (104, [float("inf")] + [0.0] * 5), (120, [1.0, 2.0]), (121, [2.0, 4.0]), (None, [1.0] * 6), (105, []), (140, [-0.0, 1.0, 0, 0, 0, 0]), (160, [0.0, 1.0, 0, 0, 0, 0])]
    rows = [(i, e if e is None else [None if v is None else float(v) for v in e]) for i, e in rows]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("key", F.lit("mine")).withColumn("v", F.lit(1))
    return df.repartition(3)


def good(rows):
    return [(r.vec_id, np.array(r.embedding, dtype=np.float64)) for r in rows if r.vec_id is not None and r.embedding and all(v is not None and np.isfinite(v) for v in r.embedding) and any(r.embedding)]


@pytest.mark.parametrize("sizes", [{}, {"query_rows": 2, "candidate_rows": 7}])
def test_nearest_equals_brute_force(spark, odd_vectors, sizes):
    rows = good(odd_vectors.collect())
    got = collections.defaultdict(list)
    for r in block_nn.nearest(odd_vectors, F.col("vec_id") % 20 == 0, k=7, **sizes).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score, r["rank"]))
    for q, x in rows:
        if q % 20 == 0:
            best = sorted((-float((x * y).sum()), i) for i, y in rows if i != q and len(y) == len(x))[:7]
            assert [i for i, _, _ in got[q]] == [i for _, i in best] and np.allclose([s for _, s, _ in got[q]], [-s for s, _ in best], atol=1e-12)
            assert [r for _, _, r in got[q]] == list(range(1, len(best) + 1))
    assert set(got) <= {q for q, _ in rows if q % 20 == 0}
    assert block_nn.nearest(odd_vectors.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_quantisation_bound():
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(50, 64)), rng.normal(size=(60, 64)) * 10
    (q, s, n, e), (p, t, m, f) = block_nn.quantise(x), block_nn.quantise(y)
    near = q.astype(float) @ p.astype(float).T * s[:, None] * t[None]
    assert (np.abs(x @ y.T - near) <= np.outer(e, m) + np.outer(n, f) + np.outer(e, f) + 1e-9).all()


def brute_links(rows, t):
    links, label = collections.Counter(), {i: i for i, _ in rows}
    pairs = []
    for a, (i, x) in enumerate(rows):
        for j, y in rows[:a]:
            if len(x) == len(y) and (x @ y) / (np.linalg.norm(x) * np.linalg.norm(y)) >= t:
                pairs.append((i, j))
                links[i] += 1
                links[j] += 1
    for _ in rows:
        for i, j in pairs:
            label[i] = label[j] = min(label[i], label[j])
    return links, label


@pytest.mark.parametrize("sizes", [{}, {"cell_rows": 10, "block_rows": 4}, {"cell_rows": 5, "sample_rows": 20}])
def test_embedding_dedup_equals_brute_force(spark, odd_vectors, sizes):
    rows = good(odd_vectors.collect())
    links, label = brute_links(rows, 0.9)
    out = embedding_dedup.dedup(odd_vectors, 0.9, **sizes).collect()
    assert len(out) == odd_vectors.count()
    for r in out:
        if r.vec_id is None:
            assert r.n_links == 0 and r.kept
        else:
            assert (r.n_links, r.component_id, r.kept) == (links[r.vec_id], label.get(r.vec_id, r.vec_id), label.get(r.vec_id, r.vec_id) == r.vec_id)
    assert embedding_dedup.dedup(odd_vectors.limit(0)).count() == 0


@pytest.mark.parametrize("kind", ["float", "double"])
def test_embedding_dedup_writes_vectors_once(spark, monkeypatch, kind):
    """Vectors without structure, where every cell borders on every other one,
    and near copies: what is written keeps to the size of the vectors, and
    pairs of blocks are read without a further exchange."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1200, 64))
    x[100:180] = x[7] + rng.normal(scale=0.1, size=(80, 64))
    x[200:400:4] = x[9] + rng.normal(scale=0.3, size=(50, 64))
    x[500:520] = x[11]
    x = x.astype(np.float32)
    ids = rng.permutation(5000)[: len(x)]
    df = spark.createDataFrame([(int(i), [float(v) for v in r]) for i, r in zip(ids, x, strict=True)], f"vec_id long, embedding array<{kind}>").repartition(3)
    stored, plans, write = {}, {}, embedding_dedup.written

    def watched(frame, name):
        plans[name] = frame._jdf.queryExecution().executedPlan().toString()
        out = write(frame, name)
        stored[name] = sum(len(bytes(v)) if isinstance(v, bytes | bytearray) else 8 * len(v) if isinstance(v, list) else 8 for r in out.collect() for v in r)
        return out

    monkeypatch.setattr(embedding_dedup, "written", watched)
    rows = [(int(i), r.astype(np.float64)) for i, r in zip(ids, x, strict=True)]
    unit = np.array([r / np.linalg.norm(r) for _, r in rows])
    near = (unit @ unit.T >= 0.9) & ~np.eye(len(x), dtype=bool)
    label = ids.copy()
    for _ in range(10):
        label = np.array([min(label[i], label[near[i]].min(initial=label[i])) for i in range(len(x))])
    want = {int(i): (int(near[k].sum()), int(label[k]), bool(label[k] == i)) for k, i in enumerate(ids)}
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.dedup(df, 0.9, cell_rows=40, block_rows=20).collect()} == want
    assert sum(stored.values()) <= 2.5 * x.size * (4 if kind == "float" else 8), stored
    assert "Exchange " not in plans["vector-links"].replace("BroadcastExchange", ""), plans["vector-links"]


@pytest.mark.parametrize("width, threshold", [(64, 0.9), (64, 0.8), (200, 0.9), (5, 0.95), (64, 0.2)])
def test_blocks_link_as_brute_force(width, threshold):
    """Shortened rows bound the cosine, and two blocks find the links of their
    rows, weighted, within each and between them."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(900, width))
    x[100:300] = x[3] + rng.normal(scale=0.1, size=(200, width))
    x[300:500:2] = x[4] + rng.normal(scale=0.35, size=(100, width))
    x = x.astype(np.float32)
    u = embedding_dedup.unit(x.astype(np.float64))
    centre, direction = embedding_dedup.spherical_kmeans(u[::2], 9), embedding_dedup.principal(u[::2], threshold)
    for d in (direction, np.eye(width)[: width // 2]):
        s = embedding_dedup.shortened(u, d)
        assert (s @ s.T >= u @ u.T - embedding_dedup.SLACK).all()
    home, ids, n = embedding_dedup.cells_of(u, centre), rng.permutation(900), rng.integers(1, 4, 900)
    order = np.argsort(home, kind="stable")
    a, b = ({"ids": ids[o], "ns": n[o], "cells": home[o].astype(np.int32), "vs": x[o]} for o in (order[:500], order[500:]))
    got, label = collections.Counter(), {int(i): int(i) for i in ids}
    edges = []
    for s, t in ((a, a), (a, b), (b, b)):
        for r in embedding_dedup.block_links(s, t, s is t, centre, direction, threshold, 64).itertuples():
            got[r.id] += r.links
            edges.append((r.id, r.component))
    near = (u @ u.T >= threshold) & ~np.eye(900, dtype=bool)
    assert got == {int(ids[k]): int(n[near[k]].sum()) for k in range(900) if near[k].any()}
    want = ids.copy()
    for _ in range(40):
        want = np.array([min(want[k], want[near[k]].min(initial=want[k])) for k in range(900)])
        for i, j in edges:
            label[i] = label[j] = min(label[i], label[j])
    assert [label[int(i)] for i in ids] == want.tolist()


def test_vector_queries_on_table(spark):
    rows = good(spark.read.parquet(f"{SF01}/embeddings.parquet").collect())
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    got = collections.defaultdict(list)
    for r in queries.QUERIES["op4_block_nn"](spark, SF01).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.score)
    for q in np.flatnonzero(ids % 20 == 0):
        s = np.delete(x @ x[q], q)
        assert np.allclose(got[ids[q]], np.sort(s)[::-1][:20], atol=1e-12)
    links, label = brute_links(rows, 0.9)
    for r in queries.QUERIES["op10_embedding_dedup"](spark, SF01).collect():
        assert (r.n_links, r.component_id) == (links[r.vec_id], label[r.vec_id])


def test_components_of_paths_and_hubs(spark):
    rng = random.Random(8)
    edges = [(i, i + 1) for i in range(1000, 1060)] + [(7, i) for i in range(2000, 2050)] + [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(25)] + [(5, 5)]
    label = {v: v for e in edges for v in e}
    for _ in range(80):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = {r.id: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got.get(v, v) == m for v, m in label.items())
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- pages ----------------------------------------------------------------------


def page(i, body, host="h.example"):
    return (i, f"https://{host}/{i}", body)


def test_wrapper_without_marks(spark):
    """Plain divs: constant ones are template, varying ones content; notices,
    comments and menus go although they vary."""
    shell = "<html><head><title>T</title><style>p{{}}</style></head><body><div><a href=/>Home</a> <a href=/x>About</a></div><div class='cookie-notice'>Cookies {0}</div><div><h1>Title&nbsp;{0}</h1><p>Long text of page {0} &amp; more of it\n to fill the space<p>Second <b>part</b> {0}<br>line<ul><li>one {0}<li>two</ul></div><form><p>Search {0}</p></form><div>Imprint 2020</div><div id=comments><p>me: {0} great</p></div><script>var x='</div>{0}'</script></body></html>"
    df = spark.createDataFrame([page(i, shell.format(i)) for i in range(6)], "page_id long, url string, html string")
    for r in wrapper_html.main_text(df.repartition(3)).collect():
        i = r.page_id
        assert r.main_text == f"Title {i}\nLong text of page {i} & more of it to fill the space\nSecond part {i} line\none {i}\ntwo"


def test_wrapper_takes_constant_lines_off_articles(spark):
    body = "<article><h1>H{0}</h1><div class=by>By our staff</div><p>Text {0}.</p></article>"
    df = spark.createDataFrame([page(i, body.format(i)) for i in range(5)] + [page(9, body.format(9), "other.example")], "page_id long, url string, html string")
    got = {r.page_id: r.main_text for r in wrapper_html.main_text(df).collect()}
    assert got[0] == "H0\nText 0." and got[9] == "H9\nBy our staff\nText 9."


def test_wrapper_odd_rows(spark):
    rows = [(1, None, None), (2, "x", ""), (None, "http://a.b/", "<p>only<"), (4, "http://a.b/", "no tags &lt; here &am"), (4, "http://a.b/", "no tags &lt; here &am"), (5, "http://C.d", "<div>" * 3000 + "deep"), (6, "http://c.d", "<script>never closed"), (7, "http://c.d", "<article>" + "<p>w x</p>" * 5000 + "</article>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("mine")).withColumn("wrapper", F.lit("mine"))
    out = wrapper_html.main_text(df).collect()
    got = {r.page_id: r.main_text for r in out}
    assert len(out) == len(rows) and (got[1], got[2], got[None], got[4], got[5], got[6]) == ("", "", "only<", "no tags < here &am", "deep", "")
    assert got[7] == "\n".join(["w x"] * 5000) and all(r.host == "mine" for r in out)
    assert wrapper_html.main_text(df.limit(0)).count() == 0


def test_wrapper_keeps_an_article_that_few_pages_copy(spark):
    """Four distinct pages hold one copied table among twelve without it; the
    byline of all pages is template."""
    body = "<article><h1>H{0}</h1><div class=by>By our staff</div><p>Text {0}.</p>{1}</article>"
    rows = [page(i, body.format(i, "<table><tr><td>Copied</td></tr></table>" if i < 4 else "")) for i in range(16)]
    got = {r.page_id: r.main_text for r in wrapper_html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"H{i}\nText {i}." + ("\nCopied" if i < 4 else "") for i in range(16)}


@pytest.mark.parametrize("parts", [1, 6])
def test_wrapper_counts_equal_pages_once(spark, parts):
    """However the copies are dealt to tasks."""
    same = "<article><h1>H</h1><div class=by>By our staff</div><p>Text.</p></article>"
    df = spark.createDataFrame([page(i, same) for i in range(12)], "page_id long, url string, html string").repartition(parts)
    assert {r.main_text for r in wrapper_html.main_text(df).collect()} == {"H\nBy our staff\nText."}
    (w,) = wrapper_html.induce(df).collect()
    assert wrapper_html.load(w.wrapper).pages == 1


@pytest.mark.parametrize("open_, shut", [
    ("<div class='layout with-sidebar'>", "</div>"), ("<div class='no-sidebar has-navbar comments-closed ad-free share-enabled'>", "</div>"),
    ("<div class=sidebar>", "</div>"), ("<form action=/>", "</form>"), ("<aside>", "</aside>"), ("<div class=widget>", "</div>"), ("<head>", "")])
@pytest.mark.parametrize("tag", ["article", "main", "div role=main"])
def test_wrapper_drops_nothing_around_the_article(open_, shut, tag):
    body = f"<html><body>{open_}<nav>Menu</nav><{tag}><h1>Title</h1><p>Text of it</p></{tag.split()[0]}><div class=comment-list>me</div>{shut}</body></html>"
    assert wrapper_html.extract(body, None) == "Title\nText of it"


def test_wrapper_keeps_what_holds_most_text():
    form = "<body><form><p>Long text of a page that lies in one form</p><select><option>one</select></form></body>"
    assert wrapper_html.extract(form, None) == "Long text of a page that lies in one form"
    said = "<body><div><p>Text</p></div><div class=comments><article><p>a long comment of a reader</p></article></div></body>"
    assert wrapper_html.extract("<article><p>Text</p></article>" + said, None) == "Text"
    assert wrapper_html.extract("<div class='site-footer'>foot</div><div class='cookie-notice'>eat</div><div class=ads_top>buy</div><p>Text</p>", None) == "Text"


def test_wrapper_keeps_math_and_text_behind_unclosed_elements():
    assert wrapper_html.extract("<article><p>so <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds</p></article>", None) == "so x=1 holds"
    for tag in ("svg", "noscript", "template", "math", "iframe"):
        assert wrapper_html.extract(f"<article><p>before</p><{tag}><p>behind</p></article>", None) == "before\nbehind"
    assert wrapper_html.extract("<article><p>before</p><svg><text>no</text></svg><p>behind</p><script>var x", None) == "before\nbehind"


def test_wrapper_keeps_all_varying_parts():
    part = "<div class=part>" + "long part " * 30 + "</div>"
    story = f"<div><div class=story><h1>Title</h1><p>Lead</p>{part}<div class=part>second</div></div><ul><li><a href=/>a link</a></ul></div>"
    long = " ".join(["long part"] * 30)
    assert wrapper_html.extract(f"<body><nav>Menu</nav>{story}</body>", None) == f"Title\nLead\n{long}\nsecond\na link"
    assert wrapper_html.extract("<main><p>in main, longer</p></main><article><p>beside</p></article><article><a href=/>link only</a></article>", None) == "in main, longer\nbeside\nlink only"


def neutral(i, said=1):
    """A page of divs and sections whose classes name nothing: a menu of the
    page's own, an article, links to others, comments of readers, a teaser."""
    menu = "".join(f"<li><a href=/{i}/{k}>topic {i} {k}</a>" for k in range(4))
    comments = "".join(f"<div class=e2><div>reader {i} {k}</div><div>I read all of page {i} and say {k}</div></div>" for k in range(said))
    story = f"<h1>Title {i}</h1><div>Lead of page {i}</div><div class=c3><p>{f'long text {i} ' * 30}</p><p>See <a href=/{i}>source {i}</a> for more of it</p><p>second {i}</p></div>"
    return f"<html><body><div class=a1><ul>{menu}</ul></div><div class=b2>{story}</div><div class=d4><div>Also read</div><div><a href=/x{i}>another story {i}</a></div></div><section class=q1>{comments}</section></body></html>"


def neutral_text(i):
    return f"Title {i}\nLead of page {i}\n{' '.join([f'long text {i}'] * 30)}\nSee source {i} for more of it\nsecond {i}"


@pytest.mark.parametrize("parts", [1, 5])
def test_wrapper_decides_where_tags_and_classes_name_nothing(spark, parts):
    """Links and comments vary from page to page like the article does."""
    rows = [page(i, neutral(i, i % 4)) for i in range(12)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(parts)
    assert {r.page_id: r.main_text for r in wrapper_html.main_text(df).collect()} == {i: neutral_text(i) for i in range(12)}
    # without its host's other pages nothing tells them apart
    assert wrapper_html.extract(neutral(1), None) != neutral_text(1)


def test_wrapper_prefers_the_part_with_most_text_to_teasers_in_articles(spark):
    body = "<body><div class=k><h1>H{0}</h1><p>" + "words of page {0} " * 20 + "</p></div><div class=z><article><p>teaser {0}</p></article></div></body>"
    df = spark.createDataFrame([page(i, body.format(i)) for i in range(6)], "page_id long, url string, html string")
    for r in wrapper_html.main_text(df).collect():
        assert r.main_text == f"H{r.page_id}\n" + " ".join([f"words of page {r.page_id}"] * 20)


def test_wrapper_keeps_titles_and_link_lists_inside_articles(spark):
    body = "<div class=m><a href=/{0}>go {0}</a></div><article><h1>Weather report</h1><p>Rain {0}.</p><ul><li><a href=/s{0}>source {0}</a></ul></article>"
    df = spark.createDataFrame([page(i, body.format(i)) for i in range(6)], "page_id long, url string, html string")
    for r in wrapper_html.main_text(df).collect():
        assert r.main_text == f"Weather report\nRain {r.page_id}.\nsource {r.page_id}"


def varied(i):
    """A page whose classes are its own, but for those of the byline."""
    own = "".join(chr(97 + int(c)) for c in f"{i:04d}")
    divs = "".join(f"<div class='{own}{k} x'><p>v{i} {k}</p></div>" for k in ("a", "b", "c", "d", "e"))
    return f"<article class='post category-{own}'><h1>H{i}</h1><div class='by {own}'>By our staff</div>{divs}</article>"


def test_wrapper_of_pages_with_their_own_classes_stays_small():
    frames = [wrapper_html.pd.DataFrame({"host": ["h"] * 50, "html": [varied(i) for i in range(k, k + 50)]}) for k in range(0, 800, 50)]
    (out,) = wrapper_html._induce(iter(frames))
    (dumped,) = out["wrapper"].tolist()
    tree = wrapper_html.load(dumped)
    assert tree.pages == 800 and wrapper_html.size(tree) < 60
    two = wrapper_html._merge_group(wrapper_html.pd.DataFrame({"host": ["h"] * 2, "wrapper": [dumped] * 2}))
    assert wrapper_html.load(two["wrapper"][0]).pages == 1600
    assert wrapper_html.extract(varied(900), tree) == "\n".join(["H900"] + [f"v900 {k}" for k in "abcde"])


def test_wrapper_hands_on_when_merging_grows(monkeypatch):
    monkeypatch.setattr(wrapper_html, "HELD_NODES", 100)
    frame = wrapper_html.pd.DataFrame({"host": ["h"] * 60, "html": [varied(i) for i in range(60)]})
    out = list(wrapper_html._induce(iter([frame])))
    assert len(out) > 1 and sum(wrapper_html.load(w).pages for f in out for w in f["wrapper"]) == 60


@pytest.mark.parametrize("broadcast_bytes", [0, 10**7])
def test_wrappers_broadcast_or_joined(spark, broadcast_bytes):
    rows = [page(i, varied(i)) for i in range(30)] + [(99, None, "<p>alone</p>"), (98, "https://h.example/x", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {r.page_id: r.main_text for r in wrapper_html.main_text(df, broadcast_bytes=broadcast_bytes).collect()}
    assert got == {i: "\n".join([f"H{i}"] + [f"v{i} {k}" for k in "abcde"]) for i in range(30)} | {99: "alone", 98: ""}


def test_matching_is_the_best_alignment():
    rng = random.Random(3)

    def tree(depth):
        return wrapper_html.Folded(rng.choice("abc"), 1, 0, [tree(depth - 1) for _ in range(rng.randint(0, 3))] if depth else [])

    def best(a, b):
        """All order-preserving alignments of the children."""
        if a.label != b.label:
            return 0

        def walk(x, y):
            if not x or not y:
                return 0
            return max(walk(x[1:], y), walk(x, y[1:]), best(x[0], y[0]) + walk(x[1:], y[1:]))

        return 1 + walk(a.kids, b.kids)

    for _ in range(60):
        a, b = tree(3), tree(3)
        assert wrapper_html.matching(a, b) == best(a, b)
    assert json.loads(wrapper_html.dump(a)) == json.loads(wrapper_html.dump(wrapper_html.load(wrapper_html.dump(a))))


def test_pages_query(spark):
    import html
    import re

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF01}/pages.parquet").collect()}
    for r in queries.QUERIES["op7_wrapper_html"](spark, SF01).collect():
        h = pages[r.page_id]
        parts = re.split("</?(?:p|h1)>", h[h.index("<article>") + 9 : h.index("</article>")])
        parts = [" ".join(html.unescape(re.sub("<[^>]+>", "", x.replace("<br>", " "))).split()) for x in parts]
        assert r.text == "\n".join(p for p in parts if p) and r.n_chars == len(r.text)


# --- pipeline --------------------------------------------------------------------


def test_pipeline_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    labels = spark.read.parquet(f"{SF01}/labels.parquet")
    after = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.written(stage(spark, after[-1], SF01), "test-stage")
        after.append(out)
    assert all(a.columns == docs.columns for a in after[:-1])
    score = {r.doc_id: r.predicted for r in quality_nbsvm.score(docs.select("doc_id", "text"), labels).collect()}
    kept = [(r.doc_id, r.text) for r in after[1].collect()]
    assert {d for d, _ in kept} == {d for d, p in score.items() if p == 1}
    group = brute_groups(sorted(kept))
    texts = {r.doc_id: r.text for r in after[2].collect()}
    assert set(texts) == set(group.values())
    clean = {r.doc_id: r for r in after[3].collect()}
    assert set(clean) == set(texts)
    for d, t in texts.items():
        assert not base_spans(clean[d].text) and clean[d].n_chars == len(clean[d].text) and (base_spans(t) or clean[d].text == t or "[SECRET]" in clean[d].text)
    times = collections.Counter(r.doc_id for r in after[4].select("doc_id").collect())
    assert set(times) <= set(clean) and max(times.values()) <= 2
    assert sum(len(words(clean[d].text)) * n for d, n in times.items()) == pytest.approx(1.5 * sum(len(words(r.text)) for r in clean.values()), rel=0.05)
    assert collections.Counter(r.doc_id for r in after[5].collect()) == times
