"""Texts that are made to be slow are handled in seconds; names of columns that operators use inside don't clash."""

import time

import pytest
from factloom.llm import decontam, html_extract, line_dedup, near_dedup, pii, suffix_dedup
from factloom.llm.labelled_pages import labelled_pages

SLOW_TEXTS = {
    "spaces after a cue": "token" + " " * 1_000_000 + "!",
    "spaces after an at-sign in words": "a [at] b" + " " * 1_000_000 + "!",
    "starts of secrets": "sk-" * 100_000,
    "schemes": "a://" * 100_000,
    "capitalised words after a number": "12 " + "A" * 1_000_000,
    "dots": "1." * 300_000,
    "at-signs": "a@" * 300_000,
}
SLOW_PAGES = {
    "unclosed quotes": '<a "x ' * 20_000,
    "unclosed quotes of both kinds": "<a \"x <b 'y " * 10_000 + "'>",
    "unclosed tags": "<div " * 20_000,
    "ends of a script that don't end": "<script>" + "</script " * 20_000,
    "a quoted name": "<img x=1 \"" + "A" * 100_000 + '">text',
    "a paragraph far out": "<p><td>" + "<b>" * 20_000 + "<hr>" * 20_000,
    "a row far out": "<table><tr>" + "<b>" * 20_000 + "<tr>" * 20_000,
    "ends that reach no cell": "<b><td>" + "<i>" * 20_000 + "</b>" * 20_000,
    "nested": "".join(f'<div class="name{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676)}">' for k in range(5_000)) + "deep" + "</b>" * 5_000,
}


@pytest.mark.parametrize("name", SLOW_TEXTS)
def test_slow_texts(name):
    began = time.time()
    pii.find(SLOW_TEXTS[name], pii.build_automaton())
    assert time.time() - began < 5


@pytest.mark.parametrize("name", SLOW_PAGES)
def test_slow_pages(name):
    model = html_extract.train(labelled_pages()[:50])
    began = time.time()
    html_extract.extract(SLOW_PAGES[name], model)
    assert time.time() - began < 5


def test_many_dropped_lines(spark):
    """A text that loses 200,000 lines is cut in time that grows with its lines."""
    lines = "\n".join(f"word{k % 7} another{k} more{k} text{k} and so on" for k in range(200_000)).replace("0", "o")
    docs = spark.createDataFrame([(k, lines + f"\nown{k}") for k in range(3)], "doc_id bigint, text string")
    lost = docs.where("doc_id > 0").selectExpr("doc_id AS id", "unhex(md5(text)) AS text_key", "sequence(0, 199999) AS dropped")
    began = time.time()
    rows = {r["doc_id"]: r for r in line_dedup.without_lines(docs, lost).collect()}
    assert time.time() - began < 30
    assert rows[0]["text"] == lines + "\nown0" and [rows[k]["text"] for k in (1, 2)] == ["own1", "own2"] and rows[1]["n_dropped"] == 200_000


def test_inherited_features():
    """What a node inherits is what the nodes above it hand down, each once."""
    nodes, _ = html_extract.parse('<div class="aa bb"><p class="aa">x</p><div class="cc"><p>y</p></div></div><p>z</p>')
    _, handed = html_extract.features(nodes)
    within = {}
    for k, x in enumerate(nodes):
        within[k] = within.get(x.parent, []) + handed[k]
    found = {x.start: within[x.parent] for x in nodes if x.tag == "#text"}
    assert found["x"] == ["in aa", "in bb", "in div", "in p"] and found["y"] == ["in aa", "in bb", "in div", "in cc"] and found["z"] == []


def test_marginals_by_enumeration():
    """Messages give the same marginals as a sum over all labellings of a small tree."""
    import itertools
    import math

    model = html_extract.train(labelled_pages()[:50])
    nodes, _ = html_extract.parse("<body><nav><a>one</a></nav><p>Two words.</p><div>three</div></body>")
    found = html_extract.marginals(nodes, model)
    nodes, _ = html_extract.parse("<body><nav><a>one</a></nav><p>Two words.</p><div>three</div></body>")
    own, within = [], []
    for x, features, handed in zip(nodes, *html_extract.features(nodes), strict=True):
        above = within[x.parent] if x.parent >= 0 else []
        within.append(above + handed)
        own.append(html_extract.DAMPING * sum(model["odds"].get(f, 0.0) for f in (*features, *above)))
    total, hit = 0.0, [0.0] * len(nodes)
    for labels in itertools.product((0, 1), repeat=len(nodes)):
        score = -30.0 * labels[0] + sum(s for s, y in zip(own, labels, strict=True) if y) + sum(model["hand"][labels[x.parent]][y] for x, y in zip(nodes[1:], labels[1:], strict=True))
        total += math.exp(score)
        for k, y in enumerate(labels):
            hit[k] += math.exp(score) * y
    assert all(abs(p - h / total) < 1e-9 for p, h in zip(found, hit, strict=True))


NAMES = ["__key", "__row", "__id", "__text__", "key", "row", "own", "text_key", "runs", "both", "dropped", "lost_id"]


@pytest.mark.parametrize("run", [near_dedup.near_duplicates, suffix_dedup.remove_repeats, line_dedup.drop_recurring_lines, lambda d: decontam.find_matches(d, d.selectExpr("doc_id AS item_id", "text"))])
def test_inner_names(spark, run):
    docs = spark.createDataFrame([(1, "some words of a text"), (2, "some words of a text"), (3, None)], "doc_id bigint, text string").selectExpr("*", *(f"'kept' AS {n}" for n in NAMES))
    rows = run(docs).collect()
    assert len(rows) == 3 and all(r[n] == "kept" for r in rows for n in NAMES)
