"""Nested facts as paths against plain recursion."""

import json
import random

from factloom.operators import facts
from factloom.sources.shared import stored

SHAPES = ["{}", "[]", "null", '"x"', "5", "not json", None, '{"a":{"b":[{"c":1},[2,[]],null,true]},"d":"","é":"ü"}', '[[["deep"]]]', '{"a":null,"b":[],"c":{"d":""},"e":{"f":0},"g":false}']


def flat(value, path=""):
    if isinstance(value, dict):
        return [x for k, v in value.items() for x in flat(v, f"{path}.{k}" if path else k)]
    if isinstance(value, list):
        return [x for k, v in enumerate(value) for x in flat(v, f"{path}[{k}]")]
    return [(path, str(value))]


def read(text):
    try:
        return json.loads(text) if text is not None else {}
    except ValueError:
        return {}


def made(rng, depth):
    kind = rng.randrange(6 if depth else 4)
    return [rng.randrange(-9, 9), rng.choice(["t", "", "a.b", 'q"']), rng.choice([True, False]), None][kind] if kind < 4 else {rng.choice("abcd"): made(rng, depth - 1) for _ in range(rng.randrange(3))} if kind == 4 else [made(rng, depth - 1) for _ in range(rng.randrange(3))]


def test_paths(spark):
    rng = random.Random(2)
    texts = SHAPES + [json.dumps(made(rng, 5)) for _ in range(80)]
    rows = spark.createDataFrame(list(enumerate(texts)), "id bigint, json string")
    found = sorted((r["id"], r["path"], r["value"]) for r in facts.flattened(rows).collect())
    assert found == sorted((k, *x) for k, t in enumerate(texts) for x in flat(read(t)))


def test_missing_fields(spark):
    fields = ["a", "b", "c.d", "e.f", "g", "h.i"]

    def lacks(value, field):
        base, _, rest = field.partition(".")
        if not isinstance(value, dict):
            return True
        value = value.get(base)
        return ((not isinstance(value, dict)) or value.get(rest) in (None, "", [])) if rest else value in (None, "", [])

    texts = [*SHAPES, '{"a":1,"b":[null],"c":{"d":[]},"e":{"f":"x"},"g":{},"h":"i"}', '{"c":[{"d":1}],"h":{"i":{}}}']
    found = {(r["id"], r["field"]) for r in facts.missing(spark.createDataFrame(list(enumerate(texts)), "id bigint, json string"), fields).collect()}
    assert found == {(k, f) for k, t in enumerate(texts) for f in fields if lacks(json.loads(t) if t and t != "not json" else None, f)}


def test_evidence_ids(spark):
    text = '{"one":{"id":"a","x":{"id":"no"}},"many":[{"id":"b"},{"id":5},"c",{"id":"d"},[{"id":"no"}]],"none":"id","id":"no"}'
    rows = facts.evidence_ids(spark.createDataFrame([(1, text), (2, "[]"), (3, None)], "id bigint, json string")).collect()
    assert {r["evidence_id"] for r in rows} == {"a", "b", "d"} and {r["id"] for r in rows} == {1}
    many = [r["evidence_id"] for r in sorted(rows, key=lambda r: r["position"]) if r["evidence_id"] != "a"]
    assert many == ["b", "d"]


def test_shallow_facts_take_one_pass(spark, monkeypatch):
    """Facts of LEVELS levels or less are stored once, deeper ones once for each LEVELS more."""
    made = []
    monkeypatch.setattr(facts, "stored", lambda df, name: made.append(df) or stored(df, name))
    for depth, passes in ((facts.LEVELS, 1), (facts.LEVELS + 1, 2), (2 * facts.LEVELS + 1, 3)):
        made.clear()
        texts = ["[" * depth + "7" + "]" * depth, "[[]]", "{}", "null", '{"a":{}}']
        found = facts.flattened(spark.createDataFrame(list(enumerate(texts)), "id bigint, json string")).collect()
        assert sorted(map(tuple, found)) == [(0, "[0]" * depth, "7", "BIGINT"), (3, "", "None", "VOID")]
        assert len(made) == passes
