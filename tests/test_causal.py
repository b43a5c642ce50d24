"""Whole events: a literal world, edges against all pairs of random worlds, rules, references, and worlds without some parts against computing anew."""

import itertools
import json
import random
import re

import pytest
from factloom.operators import causal, counterfactual, references, rules
from factloom.plans import causal_queries
from factloom.sources.records import REFERENCE
from pyspark.sql import functions as F

EVENTS = f"case_id bigint, event_id bigint, type string, kind string, value string, actors array<string>, objects array<string>, action string, state map<string,string>, evidence array<{REFERENCE}>"
ENTITIES = "case_id bigint, entity_id string, type string, name string"
NAMES = {"entity:a": "API_KEY", "entity:b": "DB_PASS", "entity:c": "QUEUE"}


def event(n, type, action, objects=(), value="2026-01-01", state=None, case=1, actors=("entity:p",), refs=None):
    refs = [n] if refs is None else refs
    return (case, n, type, "unknown" if value is None else "date", value, list(actors), sorted(objects), action, state, [(f"s{r % 3}", f"c{r}", r, r + 9, f"h{r}") for r in refs])


def world(spark, rows):
    cases = {r[0] for r in rows} or {1}
    entities = [(c, i, "System" if i == "entity:c" else "Secret", n) for c in cases for i, n in NAMES.items()]
    return spark.createDataFrame(rows, EVENTS), spark.createDataFrame(entities, ENTITIES)


SIX = [
    event(1, "PolicyChange", "API_KEY must be never in source", ["entity:a"], "2026-01-03"),
    event(2, "Config", "API_KEY environment only", ["entity:a"], "2026-01-02", {"API_KEY": "env-only"}),
    event(3, "Deployment", "deployed QUEUE", ["entity:c"], "2026-01-04"),
    event(4, "Rotation", "rotated QUEUE before deployment", ["entity:c"], "2026-01-05", refs=[3, 4]),
    event(5, "Config", "set the key", (), "2026-01-06", refs=[]),
    event(6, "Leak", "`DB_PASS` leaked, then closed QUEUE when rotation ended", ["entity:b"], None, {"API_KEY": "leaked"}),
]


def test_six_events(spark):
    events, entities = world(spark, SIX)
    found = {(r["a"], r["b"], r["type"]): r for r in causal.edges(events, entities).collect()}
    assert {k: r["reason"] for k, r in found.items()} == {(1, 2, "enables"): "RULE_SECRET_HANDLING_CAUSAL", (4, 3, "before"): "RULE_TIME_PHRASE_BEFORE", (4, 6, "before"): "RULE_TIME_PHRASE_BEFORE"}
    assert {k: r["confidence"] for k, r in found.items()} == {(1, 2, "enables"): "high", (4, 3, "before"): "medium", (4, 6, "before"): "medium"}
    assert [r["chunk_id"] for r in found[4, 3, "before"]["evidence"]] == ["c3", "c4"]
    blocked = {(r["reason"], r["a"], r["b"]) for r in causal.blocked(events).collect()}
    assert blocked == {("RULE_POLICY_PRECEDES_CONFIG", 1, 5), ("RULE_SECRET_HANDLING_CAUSAL", 1, 5), ("RULE_SECRET_HANDLING_CAUSAL", 2, 5)}
    needed = {(r["event_id"], r["type"]) for r in causal.needed_info(causal.blocked(events), events).collect()}
    assert needed == {(1, "PolicyChange"), (2, "Config"), (5, "Config")}
    broken = causal.violations(events, causal.edges(events, entities)).collect()
    assert [(r["type"], r["events"], r["entities"]) for r in broken] == [("TEMPORAL_CONFLICT", [3, 4], ["entity:c"])]


def test_dates_and_conflicts(spark):
    rows = [event(1, "Other", "x", ["entity:a"], "2026-01-01", {"API_KEY": "on"}), event(2, "Other", "y", ["entity:a"], "2026-01-02", {"API_KEY": "off"}), event(3, "Other", "z", ["entity:c"], "2026-01-02", {"QUEUE": "on", "API_KEY": "x"})]
    found = {(r["a"], r["b"], r["type"], r["reason"]) for r in causal.edges(*world(spark, rows), dates=True).collect()}
    assert found == {(1, 2, "contradicts", "RULE_CONFLICT_IMPLIED"), (1, 2, "before", "RULE_TIME_EXPLICIT_DATE"), (1, 3, "before", "RULE_TIME_EXPLICIT_DATE")}
    conflict = causal.conflicts(*world(spark, rows)).first()
    assert (conflict["entity_id"], conflict["states"], conflict["n_events"]) == ("entity:a", ["off", "on"], 2)


def test_violations_of_states_and_policies(spark):
    rows = [
        event(1, "PolicyChange", "API_KEY must be never in source", ["entity:a", "entity:b"]),
        event(2, "PolicyChange", "never in source: API_KEY", ["entity:a"]),
        event(3, "Other", "mode", ["entity:c"], "2026-01-01", {"m": "active"}, refs=[7]),
        event(4, "Other", "mode", ["entity:c"], "2026-01-01", {"m": "destroyed", "n": "enabled"}, refs=[7, 8]),
        event(5, "Other", "mode", ["entity:c"], "2026-01-02", {"n": "disabled"}),
    ]
    found = causal.violations(world(spark, rows)[0], spark.createDataFrame([(1, 5, 4, "causes", [])], f"case_id bigint, a bigint, b bigint, type string, evidence array<{REFERENCE}>")).collect()
    policies = [(r["events"], r["entities"]) for r in found if r["type"] == "POLICY_CONFLICT"]
    assert policies == [([1, 2], ["entity:a"])] * 2  # each breaks the other
    state = next(r for r in found if r["type"] == "STATE_CONFLICT")
    assert (state["events"], state["reason"], [e["chunk_id"] for e in state["evidence"]]) == ([3, 4], "entity has contradictory state values for m at 2026-01-01: active, destroyed", ["c7", "c8"])
    assert [(r["events"], r["reason"]) for r in found if r["type"] == "CAUSAL_CONFLICT"] == [([4, 5], "causal edge points to an event that occurs earlier in time")]


def tokens(e):
    said = e[7] + (" " + json.dumps(e[8], sort_keys=True, separators=(",", ":")) if e[8] is not None else "")
    found = {o if o.startswith("entity:") else o.upper() for o in e[6]} | {x.strip().upper() for x in re.findall("`([^`]+)`", said)} | set(re.findall(r"\b[A-Z][A-Z0-9_]{2,}\b", said))
    return said.lower(), found - {""}


def says_before(e, f):
    """Whether e puts itself before f, behind it, or says nothing of it (None)."""
    text, _ = tokens(e)
    other, names = tokens(f)
    terms = sorted({*causal.TYPE_TERMS.get(f[2], []), *(w for w in re.findall("[a-z0-9]+", other) if len(w) >= 4), *(n.lower() for n in names if not n.startswith("entity:"))})
    for phrases, forward in ((("before", "prior to"), True), (("after", "following"), False)):
        if any(f"{p} {t}" in text for p in phrases for t in terms):
            return forward
    for t in terms:
        if f"then {t}" in text or f"when {t} ended" in text:
            return f"then {t}" in text
    return None


WORDS = ["before", "after", "prior to", "following", "then", "when", "ended", "deploy", "deployment", "rotation", "leak", "API_KEY", "QUEUE", "DB_PASS", "`x`", "`Q`", "x", "config", "before before", "never in source", "env-only"]


def random_events(rng, case, n):
    types = ["PolicyChange", "Config", "Deployment", "Rotation", "Leak", "Other"]
    state = lambda: rng.choice([None, None, {rng.choice([*NAMES.values(), "mode"]): rng.choice(["active", "destroyed", "enabled", ""])}, {"API_KEY": "active", "QUEUE": "disabled"}])
    return [event(k, rng.choice(types), " ".join(rng.choices(WORDS, k=rng.randrange(1, 7))), rng.sample(list(NAMES), rng.randrange(3)), rng.choice([None, "2026-01-01", "2026-01-01T10:00:00Z", "2026-02-01"]), state(), case, rng.sample(["entity:p", "entity:a"], rng.randrange(3)), [rng.randrange(6)]) for k in range(n)]


def test_edges_against_all_pairs(spark):
    rng = random.Random(6)
    rows = [r for case in range(25) for r in random_events(rng, case, 9)]
    expected = set()
    for e, f in itertools.permutations(rows, 2):
        if e[0] != f[0] or not tokens(e)[1] & tokens(f)[1]:
            continue
        at = lambda x: (x[4] or "~", x[1])
        never, env = (lambda x: any(w in tokens(x)[0] for w in causal.NEVER)), (lambda x: any(w in tokens(x)[0] for w in causal.ENV_ONLY))
        if e[2] == "PolicyChange" and f[2] == "Config" and at(e) < at(f):
            expected.add((e[0], e[1], f[1], "before"))
        if e[6] and f[6] and never(e) and env(f) and not (at(f) < at(e) and never(f) and env(e)):
            expected.add((e[0], e[1], f[1], "enables"))
        if (forward := says_before(e, f)) is not None:
            expected.add((e[0], *((e[1], f[1]) if forward else (f[1], e[1])), "before"))
    found = {(r["case_id"], r["a"], r["b"], r["type"]) for r in causal.edges(*world(spark, rows)).where("type <> 'contradicts'").collect()}
    assert len(expected) > 100 and found == expected


def test_changed_violations(spark):
    schema = "case_id bigint, type string, events array<bigint>, entities array<string>, reason string"
    old = spark.createDataFrame([(1, "S", [1, 2], ["a"], "r1"), (1, "S", [1, 2], ["a"], "r2"), (1, "S", [3], ["a"], "same"), (1, "P", [4], [], "gone"), (1, "P", [4], [], "gone")], schema)
    new = spark.createDataFrame([(1, "S", [1, 2], ["a"], "r0"), (1, "S", [3], ["a"], "same"), (2, "P", [4], [], "new")], schema)
    found = {(r["case_id"], r["change"], r["type"], r["old_reason"], r["new_reason"]) for r in causal.violation_diff(old, new).collect()}
    assert found == {(1, "changed", "S", "r2", "r0"), (1, "removed", "P", "gone", None), (2, "added", "P", None, "new")}


def test_references_go_up_and_come_together(spark):
    """A diamond, a cycle, edges of other types, and one claim on which most rests."""
    edges = [("a", "b", "supports"), ("a", "c", "implies"), ("b", "d", "supports"), ("c", "d", "supports"), ("d", "a", "supports"), ("x", "a", "contradicts"), *((f"n{k}", "hot", "supports") for k in range(300)), ("hot", "top", "implies")]
    own = [("a", 1), ("b", 1), ("c", 2), ("x", 9), *((f"n{k}", 10 + k % 150) for k in range(300))]
    refs = spark.createDataFrame([(c, ("s", f"c{r}", r, r + 1, "h")) for c, r in own], f"claim_id string, ref {REFERENCE}")
    table = spark.createDataFrame(edges, "a string, b string, type string")
    found = references.gathered(refs, table)
    counts = {r["claim_id"]: r["n_refs"] for r in references.counts(table.selectExpr("explode(array(a, b)) AS claim_id"), found).collect()}
    assert {c: counts[c] for c in ("a", "b", "c", "d", "x", "hot", "top", "n0")} == {"a": 2, "b": 2, "c": 2, "d": 2, "x": 1, "hot": 150, "top": 150, "n0": 1}
    arrays = {r["claim_id"]: [e["offset_start"] for e in r["evidence"]] for r in references.as_arrays(found).collect()}
    assert arrays["d"] == [1, 2] and len(arrays["top"]) == 150
    artifacts = spark.createDataFrame([("s", "c1"), ("s", "c9")], "source_id string, chunk_id string")
    assert {(r["claim_id"], r["ref"]["offset_start"]) for r in references.outside(found, artifacts, []).where("claim_id < 'e'").collect()} == {(c, 2) for c in "abcd"}


def test_rules_are_rows(spark, tmp_path):
    """Another keyword, a switched rule and a missing parameter change reasons without any other code."""
    said = {"ruleset_id": "mine", "rules": [{"rule_id": "RULE_MIN_EVIDENCE", "enabled": True, "params": {}}, {"rule_id": "RULE_SCOPE", "enabled": True, "params": {}}, {"rule_id": "RULE_CONTRADICTION", "enabled": False, "params": {}}, {"rule_id": "RULE_WORLD_UNKNOWNS_SECURITY", "enabled": True, "params": {"security_keywords": ["pin"], "unknown_kinds_for_security": ["missing_object"]}}]}
    (tmp_path / "mine.json").write_text(json.dumps(said))
    table = rules.load(spark, "core.v1", str(tmp_path / "mine.json"))
    facts = spark.createDataFrame([("t1", "RULE_MIN_EVIDENCE", "t1", "missing_evidence", None, 0), ("t2", "RULE_SCOPE", "r", None, None, None), ("t3", "RULE_CONTRADICTION", "x", None, None, None), ("t4", "RULE_WORLD_UNKNOWNS_SECURITY", "e", "missing_object", "changed the PIN", None), ("t5", "RULE_WORLD_UNKNOWNS_SECURITY", "e", "missing_time", "Access", None), ("t6", rules.UNCONDITIONAL, "v", None, None, None), ("t6", rules.UNCONDITIONAL, "v", None, None, None)], "target string, rule_id string, ref string, kind string, word string, number bigint")
    found = rules.reasons(table, facts)
    targets = spark.createDataFrame([(f"t{k}",) for k in range(1, 8)], "t string")
    status = {(r["ruleset_id"], r["target"]): (r["status"], r["n_reasons"]) for r in rules.verdicts(table, targets, found).collect()}
    ok, fail, ask = ("VERIFIED_OK", 0), ("VERIFIED_FAIL", 1), ("VERIFIED_NEEDS_INFO", 1)
    assert [status["core.v1", f"t{k}"] for k in range(1, 8)] == [ask, fail, fail, ok, ask, fail, ok]
    assert [status["mine", f"t{k}"] for k in range(1, 8)] == [ask, fail, ok, ask, ok, fail, ok]
    assert {(r["ruleset_id"], r["target"], r["kind"]) for r in rules.required_info(found).collect()} == {("core.v1", "t1", "missing_evidence"), ("mine", "t1", "missing_evidence"), ("mine", "t4", "missing_object"), ("core.v1", "t5", "missing_time")}
    with pytest.raises(ValueError):
        (tmp_path / "none.json").write_text("{}")
        rules.load(spark, str(tmp_path / "none.json"))


def content(w):
    return [sorted(map(repr, df.select(*sorted(df.columns)).collect())) for df in (w.events, w.entities, w.relations, w.unknowns, w.conflicts)]


def test_removal_equals_computing_anew(spark):
    """Random worlds without random events, runs of events and entities; targets that aren't there are faults."""
    rng = random.Random(9)
    rows = [r for case in range(20) for r in random_events(rng, case, 14)]
    events, entities = world(spark, rows)
    ops = []
    for case in range(20):
        start = rng.randrange(10)
        ops += [(case, "REMOVE_EVENT", str(k)) for k in {*rng.sample(range(14), rng.randrange(4)), *range(start, start + rng.randrange(9))} if k < 14]
        ops += [(case, "REMOVE_ENTITY", x) for x in rng.sample(list(NAMES), rng.randrange(2))]
    bad = [(1, "REMOVE_EVENT", "99"), (2, "REMOVE_ENTITY", "entity:none"), (77, "REMOVE_EVENT", "1"), (3, "REMOVE_EVENT", "entity:a")]
    removals = spark.createDataFrame(ops + bad, "case_id bigint, op string, target string")
    before = counterfactual.computed(events, entities)
    assert {tuple(r) for r in counterfactual.faults(removals, events, entities).collect()} == set(bad)
    after = counterfactual.removed(before, removals)
    gone = {(c, int(t)) for c, op, t in ops if op == "REMOVE_EVENT"}
    lost = {(c, t) for c, op, t in ops if op == "REMOVE_ENTITY"}
    left = [(*r[:5], *([x for x in r[k] if (r[0], x) not in lost] for k in (5, 6)), *r[7:]) for r in rows if (r[0], r[1]) not in gone]
    fewer = entities.join(spark.createDataFrame(list(lost) or [(0, "")], "case_id bigint, entity_id string"), ["case_id", "entity_id"], "left_anti")
    anew = counterfactual.computed(spark.createDataFrame(left, EVENTS).withColumn("state", F.col("state")), fewer)
    assert content(after)[1:] == content(anew)[1:]
    assert sorted((r["case_id"], r["event_id"], tuple(r["actors"]), tuple(r["objects"])) for r in after.events.collect()) == sorted((r[0], r[1], tuple(r[5]), tuple(r[6])) for r in left)


def test_focus(spark):
    """Scores by object, word, label and type; events at odds stay whatever their score."""
    from factloom.operators import focus

    rows = [event(k, "Other", "nothing", ["queue"] if k == 1 else [], f"2026-01-{k + 1:02d}") for k in range(12)]
    rows[2] = event(2, "Leak", "the secret queue", ["entity:c"], None, {"QUEUE": "x"})
    rows[3] = event(3, "Other", "x", ["entity:a"], "2026-03-01", {"API_KEY": "on"})
    rows[4] = event(4, "Other", "y", ["entity:a"], "2026-03-02", {"API_KEY": "off"})
    events, entities = world(spark, rows)
    score = {r["event_id"]: r["score"] for r in focus.scored(events, entities, "Secret QUEUE? secret").collect()}
    assert (score[1], score[2], score[3], score[5]) == (5 + 3, 3 + 3 + 1 + 2, 0, 0)
    found = {r["event_id"]: r["forced"] for r in focus.focused(events, entities, "secret queue", max_chunks=1, max_events=3).collect()}
    assert found == {2: False, 1: False, 0: False, 3: True, 4: True}
    assert focus.focused(events, entities, "?!").count() == 12


@pytest.mark.parametrize("query", ["event_edges", "violation_changes", "case_reasons"])
def test_exploded_tables_are_not_broadcast(spark, query):
    """A small file may hold many rows once it is exploded: whatever its size, it goes to no join by way of the driver."""
    found = causal_queries.ALL[[q.__name__ for q in causal_queries.ALL].index(query)](spark, "/root/testdata/sf0.001")
    joins = [line for line in found._jdf.queryExecution().sparkPlan().toString().splitlines() if "Join" in line]
    assert len(joins) > 3
    assert not [line for line in joins if "Broadcast" in line and "rule_id" not in line]  # the rules' own table is small by definition


def test_events_are_indexed_once(spark):
    """The rules read a stored index; none of them makes texts and tokens of events anew."""
    plan = causal.edges(*world(spark, SIX))._jdf.queryExecution().optimizedPlan().toString()
    assert "to_json" not in plan and "`([^`]+)`" not in plan


@pytest.mark.parametrize("query", ["counterfactual_missing", "counterfactual_conflicts", "counterfactual_relations"])
def test_what_went_is_not_broadcast(spark, query):
    """Removed events are a share of all events, so a table of them is shuffled, however small its file."""
    found = causal_queries.ALL[[q.__name__ for q in causal_queries.ALL].index(query)](spark, "/root/testdata/sf0.001")
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
