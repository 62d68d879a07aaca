"""Parsing, decoding and held-out layouts."""

import itertools
import time
from collections import Counter
from functools import lru_cache

import numpy as np

from netsluice.llm import main_text as M
from netsluice.llm.dom import parse


@lru_cache(maxsize=1)
def trees():
    return M.fit_on([], composed=350)


def runs(source):
    return [t for _, t, _ in sorted(r for n in parse(source) for r in n.runs)]


def test_blocks_of_text():
    assert runs("<p>a &amp b &#233;&nbsp; c<p>d<br>e") == ["a & b é c", "d e"]
    assert runs("<div>x<script>var t='</p>';</script>y<!-- no --> <b>z</div>w") == ["x y z", "w"]
    assert runs("<ul><li>one<li>two<ul><li>in</ul><li>three</ul>") == ["one", "two", "in", "three"]
    assert runs("<table><tr><td>a<td>b<tr><td>c</table>d") == ["a", "b", "c", "d"]
    assert runs("<p>1 &lt; 2 < 3</p><div hidden>no<div>no</div></div><span style='display: none'>no</span>yes") == ["1 < 2 < 3", "yes"]
    assert runs("<form><select><option>no</select><textarea><p>no</textarea>q</form>") == ["q"]
    assert runs("<p title='a>b'>t</p></div></section>u<style>x") == ["t", "u"]
    assert runs("") == [] and runs("plain") == ["plain"] and runs("<" * 50) == ["<" * 50]


def test_text_of_formulas_and_of_embedded_parts():
    assert runs("<p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> be.</p>") == ["Let x=2 be."]
    assert runs("<article><p>a</p><noscript><p>b</p></noscript><object data=x><p>c</p></object><video>d</video></article>") == ["a", "b", "c", "d"]
    assert runs("<svg><text>no</text></svg>yes<svg/>and<svg>open") == ["yes and open"]


def test_quotes_and_cut_tags():
    assert runs("<p title=it's>a</p><p title = 'x>y'>b</p><p title=\"open>c</p>") == ["a", "b", "c"]
    assert runs("<p>a</p><p class='x") == ["a", "<p class='x"]
    assert runs("<p>a < b <3 <</p>c </") == ["a < b <3 <", "c </"]
    assert runs("a<" + "b c='d' " * 5) == ["a<" + " ".join(["b c='d'"] + ["b c='d'"] * 4)]


def test_broken_pages_take_linear_time():
    tag = "<div " + " ".join(f'data-a{k}="value {k}"' for k in range(200))
    n = 100_000
    pages = [
        tag, "<p>x</p>" * 1000 + tag, "<div " + "a='b' \"" * 5000, "<div>" * n, "<svg>" * n, "x <a " * n, "<div hidden>" * n, "</b" * n,
        "<iframe>" * n, "<ul><li>" * (n // 2) + "</ol>" * n, "<div>" * n + "</section>" * n, "<a x='" * n + '">', "<a " * n + 'x=">"',
        "<!-" * n, "<textarea>" * n, "<div x=\"" * n, "<p><b " * n, "&#" * n, "<table><tr>" * (n // 2),
    ]
    for page in pages:
        start = time.perf_counter()
        parse(page)
        assert time.perf_counter() - start < 3, page[:40]
    start = time.perf_counter()
    nodes = parse("<div>" * 20_000 + "deep" + "<p>y</p>" * 20_000)
    assert M.kept_text(nodes, M.decode(nodes, trees().scores(M.features(nodes)))) is not None
    assert time.perf_counter() - start < 60


def test_decoding_is_the_best_without_contradiction():
    g = np.random.default_rng(1)
    nodes = parse("<div><p>a</p><div><p>b</p></div></div><p>c</p>")
    parent = [nodes.index(n.parent) if n.parent else -1 for n in nodes]
    for _ in range(20):
        scores = g.normal(size=(len(nodes), 3))

        def allowed(s):
            return all(
                p < 0 or s[p] == M.SPLIT or s[i] == M.DROP or (s[p] == M.KEEP and s[i] == M.KEEP) for i, p in enumerate(parent)
            )

        best = max((s for s in itertools.product(range(3), repeat=len(nodes)) if allowed(s)), key=lambda s: sum(scores[i][x] for i, x in enumerate(s)))
        assert tuple(M.decode(nodes, scores)) == best


def test_held_out_layouts():
    composer = M.Composer([], ["Home", "About us", "News", "Contact", "Sport", "Read more"], seed=99)
    shared = kept = meant = 0
    for _ in range(120):
        nodes = parse(composer.page())
        states = M.known_states(nodes)
        want = Counter(M.kept_text(nodes, np.array(states)).split())
        got = Counter(M.kept_text(nodes, M.decode(nodes, trees().scores(M.features(nodes)))).split())
        shared += sum((want & got).values())
        kept += sum(got.values())
        meant += sum(want.values())
    assert shared >= 0.95 * kept and shared >= 0.95 * meant


def test_rows(spark):
    article = "".join(f"<p>This is sentence {k} of the article, long enough to read on. It has more to say.</p>" for k in range(6))
    page = f"<html><body><nav><ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li></ul></nav><article><h1>Title of it</h1>{article}</article><footer>&copy; us</footer></body></html>"
    rows = [(1, "u", page, "x"), (2, None, None, "y"), (3, "v", "", "z"), (1, "u", page, "x"), (None, "w", "<p>" * 3000 + "deep", "q")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = M.extracted(df, trees()).collect()
    texts = {r.page_id: r.text for r in got}
    assert len(got) == 5 and texts[2] == texts[3] == ""
    assert texts[1].split("\n")[0] == "Title of it" and len(texts[1].split("\n")) == 7 and all(r.n_chars == len(r.text) for r in got)
    assert M.extracted(df.limit(0), trees()).collect() == []


def test_training_on_a_table(spark):
    composer = M.Composer([], [], seed=5)
    df = spark.createDataFrame([(k, "u", composer.page()) for k in range(20)] + [(99, None, None)], "page_id long, url string, html string")
    fitted = M.train(df, sample_pages=10, composed=40)
    assert len(M.extracted(df, fitted).collect()) == 21
    assert M.train(df.limit(0), composed=30).scores(np.zeros((1, M.features(parse("x")).shape[1]), np.float32)).shape == (1, 3)
