"""Operators on literal cases."""

import random
from collections import defaultdict

import pytest
from factloom.functions import canonical, text
from factloom.operators import claims, domains, evidence, graph, reports, service, versions, world
from pyspark.sql import functions as F


def one(spark, column, **values):
    schema = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], schema).select(column).first()[0]


def claim_rows(spark):
    rows = [(1, 0, "Sky", "is", "Blue", "affirm"), (1, 1, "  sky ", "is", " blue", "affirm"), (2, 0, "sky", "is", "blue", "deny")]
    df = spark.createDataFrame(rows, "doc_id bigint, line_no int, subject string, predicate string, object string, polarity string").withColumn("modality", F.lit("assert"))
    key = [text.proposition(F.col(c)) for c in ("subject", "predicate", "object")]
    return df.withColumn("claim_id", F.concat(F.lit("c"), "doc_id", "line_no")).withColumn("proposition", F.sha2(F.concat_ws("|", *key), 256))


def test_duplicates_and_contradictions(spark):
    df = claim_rows(spark)
    assert [tuple(r) for r in claims.duplicates(df).collect()] == [(1, 1, 1, 0)]
    found = claims.contradictions(df).first()
    assert (found["n_affirm"], found["n_deny"], found["n_pairs"]) == (2, 1, 2)
    assert claims.duplicate_groups(df).first()["n_pairs"] == 1


def test_closure(spark):
    edges = [(t, x, y) for t, n in (("supports", "ABC"), ("implies", "IJK"), ("depends_on", "DEF")) for x, y in zip(n, n[1:])]
    df = spark.createDataFrame(edges, "type string, a string, b string")
    assert {(r["a"], r["b"], r["n_edges"]) for r in graph.closure(df).collect()} == {("A", "C", 2), ("I", "K", 2), ("D", "F", 2)}


def test_closure_takes_the_least_shortest_path(spark):
    df = spark.createDataFrame([("t", *e) for e in ("AX", "AB", "XZ", "BZ", "ZA")], "type string, a string, b string")
    assert {r["via"] for r in graph.closure(df).where("a = 'A' and b = 'Z'").collect()} == {"A>B>Z"}


def test_cycles_and_order(spark):
    edges = spark.createDataFrame([(1, 1, 2), (1, 2, 3), (2, 5, 6), (2, 6, 5), (2, 6, 7), (3, 9, 8)], "case_id bigint, a bigint, b bigint")
    rows = [(1, 1, None), (1, 2, "1"), (1, 3, None), (1, 4, "0"), (2, 5, None), (2, 6, None), (2, 7, None), (3, 8, "1"), (3, 9, "2")]
    events = spark.createDataFrame([(c, e, "date" if v else "unknown", v) for c, e, v in rows], "case_id bigint, event_id bigint, kind string, value string")
    found = graph.arranged(events, edges).orderBy("case_id", "part", "position").collect()
    part = lambda c, p: [r["event_id"] for r in found if r["case_id"] == c and r["part"] == p]
    assert part(1, "order") == [4, 1, 2, 3] and part(1, "chain") == [1, 2, 3]
    assert part(2, "cycle") == [5, 6] and part(3, "cycle") == [8, 9]  # 9 before 8 by phrase, after it by date
    assert not part(2, "order") and not part(2, "chain") and not part(1, "cycle")
    assert {(r["case_id"], r["node"]) for r in graph.cycle_nodes(graph.arranged(events, edges)).collect()} == {(2, 5), (2, 6), (3, 8), (3, 9)}


def test_graphs_against_all_pairs(spark):
    """Against all edges by time made in full, self-reachability for cycles, and all chains."""
    draw = random.Random(11)
    events, edges = [], []
    for case in range(60):
        n = draw.randint(1, 8)
        events += [(case, case * 10 + k, v and "date" or "unknown", v) for k in range(n) for v in [draw.choice([None, None, "1", "2", "3"])]]
        edges += [(case, case * 10 + draw.randrange(n), case * 10 + draw.randrange(n)) for _ in range(draw.randint(0, 4))]
    found = defaultdict(list)
    df = spark.createDataFrame(events, "case_id bigint, event_id bigint, kind string, value string")
    for r in graph.arranged(df, spark.createDataFrame(edges, "case_id bigint, a bigint, b bigint")).orderBy("position").collect():
        found[r["case_id"], r["part"]].append(r["event_id"])
    for case in range(60):
        value = {e: v for c, e, _, v in events if c == case}
        nxt = {x: {y for y in value if (case, x, y) in edges or (value[x] and value[y] and value[x] < value[y])} for x in value}
        reach = {x: set(nxt[x]) for x in value}
        for _ in value:
            reach = {x: reach[x].union(*[nxt[y] for y in reach[x]]) for x in value}
        cycle = sorted(x for x in value if x in reach[x])
        assert found[case, "cycle"] == cycle
        if cycle:
            assert not found[case, "order"] and not found[case, "chain"]
            continue
        order, left = [], dict(value)
        while left:
            free = min((x for x in left if not any(x in nxt[y] for y in left)), key=lambda x: (value[x] or "~", x))
            order.append(free)
            del left[free]
        chains = [[x] for x in value]
        for c in chains:
            chains += [[*c, y] for y in nxt[c[-1]]]
        assert found[case, "order"] == order and found[case, "chain"] == min(chains, key=lambda c: (-len(c), c))


def test_support_tree(spark):
    df = spark.createDataFrame([("a", "b", "supports"), ("b", "t", "implies"), ("c", "t", "depends_on"), ("t", "a", "supports")], "a string, b string, type string")
    assert {(r["node"], r["depth"]) for r in graph.support_tree(df, "t").collect()} == {("b", 1), ("a", 2)}


def test_event_types(spark):
    cases = {"rotated `PROD_API_TOKEN`": "Config", "rotated the lock": "Rotation", "KEY exposed": "Leak", "do not commit KEY": "PolicyChange", "release note": "Other", "login page": "Access", "new policy": "PolicyChange", "environment set": "Config", "rollout": "Deployment", "committed it": "Leak"}
    df = spark.createDataFrame([(k,) for k in cases], "action string").select("action", world.event_type(F.col("action")).alias("type"))
    assert {r["action"]: r["type"] for r in df.collect()} == cases


def test_violations_and_verdicts(spark):
    rows = [
        (1, 1, "PolicyChange", "date", "2026-03-01", "A", "u", "A must never appear in source", "active"),
        (1, 2, "Leak", "date", "2026-03-02", "A", "u", "A committed to source repo", "active"),
        (1, 3, "Other", "date", "2026-03-07", "B", "u", "x", "active"),
        (1, 4, "Other", "date", "2026-03-07", "B", "u", "y", "destroyed"),
        (2, 5, "Access", "unknown", None, "C", "u", "access login", "active"),
        (3, 6, "Other", "date", "2026-03-07", "D", "u", "calm", "active"),
    ]
    df = spark.createDataFrame(rows, "case_id bigint, event_id bigint, type string, kind string, value string, object string, actor string, action string, state string")
    found = world.violations(df, world.typed_edges(df))
    assert {(r["type"], r["a"], r["b"]) for r in found.collect()} == {("POLICY_CONFLICT", 1, 2), ("STATE_CONFLICT", 3, 4)}
    none = df.limit(0).select("case_id")
    verdicts = {r["case_id"]: r["status"] for r in world.verify(df, found, none).collect()}
    assert verdicts == {1: "FAIL", 2: "NEEDS_INFO", 3: "OK"}
    assert {(r["action"], r["target"]) for r in world.repair_hints(found, df).where("type = 'POLICY_CONFLICT'").collect()} == {("DROP_EVENT", 2), ("NARROW_SCOPE", 1)}
    newer = df.where("event_id <> 4").withColumn("action", F.when(F.col("event_id") == 3, "z").otherwise(F.col("action")))
    assert {(r["event_id"], r["status"], r["fields"]) for r in versions.diff_events(df, newer).collect()} == {(4, "removed", ""), (3, "changed", "action")}


def test_credit_and_clinical(spark):
    a = spark.createDataFrame([(1, 4200, 2100, 620, 1, 36), (2, None, 5, 700, 0, 3)], "applicant_id bigint, income bigint, debt bigint, score bigint, delinquencies bigint, employment_months bigint")
    r, s = domains.credit_decisions(a).orderBy("applicant_id").collect()
    assert (r["dti_percent"], r["dti_status"], r["delinquency_status"], r["score_status"], r["employment_status"], r["risk_tier"], r["decision"]) == (50, "pass", "caution", "caution", "pass", "subprime_tier3", "approved_conditional")
    assert (s["dti_percent"], s["risk_tier"], s["employment_status"]) == (0, "prime_tier1", "caution")
    p = spark.createDataFrame([(1, "2026-01-31", 148, 94, 52, True, "headache, dizziness for 3 days"), (2, "soon", 120, 80, 30, False, "")], "patient_id bigint, encounter_date string, systolic bigint, diastolic bigint, age bigint, family_history boolean, complaint string")
    x, y = domains.clinical_screen(p).orderBy("patient_id").collect()
    assert (x["systolic_status"], x["assessment"], x["next_assessment"], x["bp_text"]) == ("elevated", "positive_screen_hypertension", "2026-03-02", "BP 148/94 mmHg")
    assert y["next_assessment"] == "{missing:next_assessment_date}"
    assert [tuple(r) for r in domains.symptoms(p).orderBy("position").collect()] == [(1, 0, "headache", 3), (1, 1, "dizziness", 3)]


def test_clauses_and_language(spark):
    docs = spark.createDataFrame([(1, "The parties agree to keep it confidential. The term is one year. This is governed by the law of France.", "en"), (2, "La loi applicable est française. Les tribunaux compétents sont à Paris.", "fr")], "doc_id bigint, text string, lang string")
    found = {(r["doc_id"], r["clause"], r["sentence"]) for r in domains.clauses(docs).collect()}
    assert found == {(1, "confidentiality_obligations", 1), (1, "term_duration", 2), (1, "governing_law", 3), (2, "loi_applicable", 1), (2, "juridiction", 2)}
    assert [r["language"] for r in domains.language_votes(docs).orderBy("doc_id").collect()] == ["en", "fr"]


def test_chunks(spark):
    docs = spark.createDataFrame([(1, "x" * 1200), (2, "é" * 1201), (3, "")], "doc_id bigint, text string").withColumn("relpath", F.lit("p"))
    found = {(r["doc_id"], r["index"], r["offset_start"], r["offset_end"]) for r in evidence.chunks(docs).collect()}
    assert found == {(1, 0, 0, 1200), (2, 0, 0, 1200), (2, 1, 1080, 1201), (3, 0, 0, 0)}


def test_canonical_json(spark):
    assert canonical.canonical({"b": [1, None], "a": "é"}) == '{"a":"é","b":[1,null]}'
    with pytest.raises(ValueError):
        canonical.canonical(float("nan"))
    assert one(spark, canonical.canonical_json(F.col("j")), j='{"z": 1, "a": "x"}') == '{"a":"x","z":1}'


def test_text_functions(spark):
    assert one(spark, text.normalized(F.col("t")), t="é\r\nx\ry") == "é\nx\ny"
    assert one(spark, text.proposition(F.col("t")), t="  A  b\n") == "a b"
    assert one(spark, text.paragraphs(F.col("t")), t="a  b\nc\n \n\n“d”") == 'a b c\n\n"d"'
    assert one(spark, text.query_tokens(F.col("t")), t="Key key A-1") == ["1", "a", "key"]
    assert one(spark, text.slug(F.col("t")), t=" Hello, World! ") == "hello_world"
    assert one(spark, text.truncated(F.col("t"), 3), t="abcd") == "abc..."
    assert one(spark, text.rendered("{a} {b}", {"a": F.col("a")}), a=None) == "{missing:a} {missing:b}"


def test_admissions(spark):
    at = [0, 1, 2, 61, 62, 200]
    df = spark.createDataFrame([(1, "e", k, s) for k, s in enumerate(at)], "tenant_id bigint, endpoint string, event_id bigint, s bigint").withColumn("ts", F.timestamp_seconds("s"))
    found = service.admissions(df, limit=2, seconds=60)
    assert [r["admitted"] for r in found.orderBy("event_id").collect()] == [True, True, False, True, True, True]


def test_seals(spark):
    docs = spark.createDataFrame([(1, "a", "p1"), (2, "b", "p2"), (3, "c", "p3")], "doc_id bigint, text string, relpath string")
    now = docs.where("doc_id < 3").withColumn("text", F.when(F.col("doc_id") == 2, "b\n").otherwise(F.col("text")))
    assert {r["doc_id"]: r["status"] for r in service.replayed(service.sealed(docs), now).collect()} == {1: "ok", 2: "tampered", 3: "missing"}


def test_enrichment(spark):
    events = spark.createDataFrame([(1, 1, "unknown", None, None), (1, 2, "date", "2024-01-01", "x"), (1, 3, "date", "2024-01-01", None)], "case_id bigint, event_id bigint, kind string, value string, actor string")
    patches = spark.createDataFrame([(1, 1, "2024-02-01", "y"), (1, 2, "2024-03-01", "z"), (9, 9, "2024-02-01", "q")], "case_id bigint, event_id bigint, value string, actor string")
    found = {r["event_id"]: (r["kind"], r["value"], r["actor"], r["ordering_conflict"]) for r in versions.enriched(events, patches).collect()}
    assert found == {1: ("date", "2024-02-01", "y", False), 2: ("date", "2024-01-01", "x", True), 3: ("date", "2024-01-01", None, False)}


def test_credit_gaps_and_ties(spark):
    rows = [(1, 8, 1, None, 0, 24), (2, 8, 3, 640, None, None), (3, 1000, None, 700, 0, 30), (4, 200, 1, 700, 0, 30), (5, 8, 5, 700, 0, 30), (6, None, 5, 700, 0, 30)]
    a = spark.createDataFrame(rows, "applicant_id bigint, income bigint, debt bigint, score bigint, delinquencies bigint, employment_months bigint")
    r = {x["applicant_id"]: x for x in domains.credit_decisions(a).collect()}
    assert [r[k]["dti_percent"] for k in range(1, 7)] == [12, 38, 0, 1, 62, 0]
    assert r[1]["risk_tier"] == "subprime_tier3" and r[1]["score_status"] == "caution" and r[3]["dti_status"] == "pass" and r[2]["employment_status"] == "caution"


def test_contract_gaps(spark):
    a = spark.createDataFrame([(1, 'EFFECTIVE DATE: "January  1, 2024". "goods" SHALL MEAN things.'), (2, "effective date May 40, 2024.")], "contract_id bigint, text string")
    r = {x["contract_id"]: x for x in domains.contract_fields(a).collect()}
    assert r[1]["effective_date"] == "2024-01-01" and r[1]["n_terms"] == 1 and r[2]["effective_date"] is None


def test_policy_conflicts_start_from_policy_changes(spark):
    rows = [("c", 1, "PolicyChange", "date", "2024-01-01", "k", "keys never in source", None), ("c", 2, "Config", "date", "2024-01-02", "k", "never in source", None), ("c", 3, "Leak", "date", "2024-01-03", "k", "committed to repo", None)]
    events = spark.createDataFrame(rows, "case_id string, event_id bigint, type string, kind string, value string, object string, action string, state string")
    edges = spark.createDataFrame([], "case_id string, a bigint, b bigint, type string")
    found = {(x["type"], x["a"], x["b"]) for x in world.violations(events, edges).collect()}
    assert found == {("POLICY_CONFLICT", 1, 2), ("POLICY_CONFLICT", 1, 3)}


def test_repeated_patches(spark):
    key = "case_id string, event_id bigint"
    events = spark.createDataFrame([("c", 1, "a"), ("c", 2, "b")], f"{key}, action string")
    out = versions.patched(events, spark.createDataFrame([("c", 2), ("c", 2)], key), spark.createDataFrame([("c", 1, "x"), ("c", 1, "y")], f"{key}, action string"), spark.createDataFrame([("c", 3, "n"), ("c", 3, "n")], f"{key}, action string"))
    assert sorted((r["event_id"], r["action"]) for r in out.collect()) == [(1, "y"), (3, "n")]


def test_answers(spark):
    answers = spark.createDataFrame([(1, "score: 50.0000001; tier = 'Prime', tier: \"prime\"\nother=x, rate=high", ["e1", "e2"], ["secret plan", ""]), (2, None, None, None), (3, "cite #e1, Evidence : e9. The SECRET Plan", ["e1"], ["secret plan"])], "id bigint, answer string, must_cite array<string>, forbidden array<string>")
    facts = spark.createDataFrame([(1, "score", "50"), (1, "tier", "PRIME"), (1, "rate", "3")], "id bigint, key string, value string")
    found = {(r["id"], r["key"], r["claimed"]): r["verdict"] for r in domains.checked_answers(answers, facts).where("id < 3").collect()}
    assert found == {(1, "score", "50.0000001"): "ok", (1, "tier", "prime"): "ok", (1, "other", "x"): "unknown", (1, "rate", "high"): "ok"}
    assert {tuple(r) for r in domains.answer_faults(answers).collect()} == {(1, "missing_citation", "e1"), (1, "missing_citation", "e2"), (3, "extra_citation", "e9"), (3, "forbidden_topic", "secret plan")}


def test_set_differences(spark):
    old, new = (spark.createDataFrame(rows, "a bigint, b string") for rows in ([(1, "x"), (1, "x"), (2, None)], [(2, None), (3, "y")]))
    assert {tuple(r) for r in versions.diff_sets(old, new, ["a", "b"]).collect()} == {(1, "x", "removed"), (3, "y", "added")}


def test_casefile_counts_without_joins(spark):
    """What a case holds is counted in one grouping; only the verdicts are joined. Cycles are those of arranged()."""
    events = spark.createDataFrame([(c, 10 * c + k, "Other", "unknown" if k == 2 else "date", None if k == 2 else str(k), "o", None if k else "p", "x", s) for c in (1, 2) for k, s in enumerate(["active", "enabled", None])], "case_id bigint, event_id bigint, type string, kind string, value string, object string, actor string, action string, state string")
    edges = spark.createDataFrame([(1, 11, 10), (1, 12, 12)], "case_id bigint, a bigint, b bigint").withColumn("type", F.lit("before"))
    verdicts = spark.createDataFrame([(1, "FAIL"), (2, "OK")], "case_id bigint, status string")
    made = reports.casefile(events, edges, world.violations(events, edges).where("type = 'TEMPORAL_CONFLICT'"), verdicts)
    assert [tuple(r)[:-1] for r in made.orderBy("case_id").collect()] == [(1, "FAIL", 2, 3, 1, 1, 1, 2), (2, "OK", 2, 3, 1, 1, 0, 0)]
    alone = reports.casefile(events, edges, edges.select("case_id"), verdicts)
    assert alone._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
    assert {tuple(r) for r in graph.cycles(events, edges).collect()} == {(1, 10), (1, 11), (1, 12)}
