"""Templates and their places against plain lookups."""

import json
import random
import re

from factloom.operators import templates
from pyspark.sql import functions as F


def plain_slug(text):
    return re.sub("[^a-z0-9_]+", "", text.lower().replace(":", "_").replace(" ", "_"))


def test_chain(spark):
    known = {"generic": "g", "order_7": "o7", "order": "o", "more": "m"}
    table = spark.createDataFrame(list(known.items()), "name string, template string")
    refs = ["Order 7", "order: 7", "ORDER 9", " order 9", "x y", "", "éé", None, "order 9"]
    for extra in ((), ("none", "more")):
        found = {r["id"]: r["name"] for r in templates.chosen(spark.createDataFrame(list(enumerate(refs)), "id bigint, ref string"), table, extra).collect()}
        for k, ref in enumerate(refs):
            chain = [plain_slug(ref or ""), *(plain_slug(w) for w in (ref or "").split()[:1]), *extra, "generic"]
            assert found[k] == next(n for n in chain if n in known)
    assert templates.chosen(spark.createDataFrame([(1, "x")], "id bigint, ref string"), table.where("name = 'order'")).first()["template"] is None


def lookup(key, context):
    base, dot, rest = key.partition(".")
    found = None
    if base in context:
        found = context[base]
    elif m := re.match(r"([a-zA-Z_]+)_(\d+)", base):
        for name in (n.format(m[1]) for n in templates.LISTS):
            at = max(int(m[2]) - 1, 0)
            if isinstance(context.get(name), list) and at < len(context[name]):
                found = context[name][at]
                break
    if dot:
        found = found.get(rest) if isinstance(found, dict) else None
    return None if isinstance(found, (dict, list)) else found


def test_places(spark):
    rng = random.Random(4)
    scalar = lambda: rng.choice(["x", "", 5, -2, True, False, None, "{a}", "ü"])
    thing = lambda: rng.choice([scalar(), {"p": scalar(), "q": scalar()}])
    names = ["a", "item", "items", "item_list", "items_detailed", "item_detailed", "item_1", "b"]
    keys = ["a", "a.p", "b.q", "item", "item_1", "item_0", "item_2.p", "item_3", "items_1", "item_1.q", "none", "b_1", "item_2x", "a.", ".p"]
    rows, contexts = [], []
    for k in range(150):
        context = {n: rng.choice([thing, lambda: [thing() for _ in range(rng.randrange(1, 4))]])() for n in rng.sample(names, rng.randrange(1, 6))}
        rows.append((k, "".join(rng.choice([f"{{{rng.choice(keys)}}}", " text ", "{", "}", "{}", "\n", "{x{a}}"]) for _ in range(rng.randrange(6)))))
        contexts.append((k, json.dumps(context)))
    found = {r["id"]: r["text"] for r in templates.filled(spark.createDataFrame([*rows, (900, "{a} {b"), (901, None)], "id bigint, template string"), spark.createDataFrame(contexts, "id bigint, json string")).collect()}
    for (k, template), (_, context) in zip(rows, contexts, strict=True):
        value = lambda m, c=json.loads(context): f"{{missing:{m[1]}}}" if (v := lookup(m[1], c)) is None else str(v)
        assert found[k] == re.sub(r"\{([^{}]+)\}", value, template), (template, context)
    assert (found[900], found[901]) == ("{missing:a} {b", "")


def test_places_hold_what_the_reference_finds(spark):
    """Empty objects and lists are there as well, a part is one key, and a number beyond all lists is none."""
    contexts = ['{"item_1":{},"items":[{"p":1}]}', '{"item":[],"items":["x"]}', '{"a":{"p.q":1,"it\'s \\"so\\"":2},"it\'s":3}', '{"items":["x"]}', '{"a":[1],"b":{}}', "[1]", "none", None, '{"":{"":"e"}}', '{"items":[{},{"p":7}]}']
    places = ["{item_1.p}", "{item_1}", "{a.p.q}{a.it's \"so\"}{it's}", "{item_99999999999}", "{a}{b}", "{a}", "{a}", "{a}", "{.}", "{item_1.p}{item_2.p}"]
    told = ["{missing:item_1.p}", "x", "123", "{missing:item_99999999999}", "{missing:a}{missing:b}", "{missing:a}", "{missing:a}", "{missing:a}", "e", "{missing:item_1.p}7"]
    rows = spark.createDataFrame(list(enumerate(places)), "id bigint, template string")
    found = templates.filled(rows, spark.createDataFrame(list(enumerate(contexts)), "id bigint, json string"))
    assert [r["text"] for r in found.orderBy("id").collect()] == told


def test_rows_are_told_where_they_are(spark):
    """Rows with their context aren't shuffled, and nothing of theirs is gathered, whatever their number."""
    table = spark.createDataFrame([("generic", "{a}"), ("generic", "{b}"), ("x", "x {a}")], "name string, template string")
    rows = spark.range(40).select("id", F.when(F.col("id") % 2 == 0, "X").otherwise("y").alias("ref"), F.lit('{"a":1}').alias("json"))
    found = templates.told(templates.chosen(rows, table))
    assert {tuple(r) for r in found.collect()} == {(k, "generic" if k % 2 else "x", "1" if k % 2 else "x 1") for k in range(40)}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == plan.count("Join") and "Generate" not in plan
