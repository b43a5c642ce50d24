"""Rounding as the bits say, whole words in any script, enrichments and their faults."""

import math
from fractions import Fraction

import pytest
from factloom.operators import domains, enrichment, versions
from factloom.sources.records import REFERENCE
from pyspark.sql import functions as F


def test_ratio_as_python_rounds(spark):
    """All ratios of whole numbers up to 1,200 whose half percent is exact, those next to one, and others of any size."""
    pairs = {(d, i) for i in range(1, 1201) for d in range(1, 1201) if 200 * d % i == 0 and 200 * d // i % 2 == 1}
    assert len(pairs) > 6000
    pairs |= {(d * 977 % 100_003, i * 131 % 9_973 + 1) for d in range(300) for i in range(20)} | {(0, 5), (5, 0), (10**12 + 1, 7), (3, 10**9)}
    rows = spark.createDataFrame(sorted(pairs), "debt bigint, income bigint").withColumn("ratio", F.when(F.col("income") != 0, F.col("debt") / F.col("income")).otherwise(0.0))
    for r in rows.withColumn("percent", domains.rounded_percent("ratio")).collect():
        expected = round(r["debt"] / r["income"], 2) if r["income"] else 0.0
        assert r["percent"] == round(expected * 100), (r["debt"], r["income"])


def test_halves_that_double_hits(spark):
    """The double next to each half itself, and its neighbours."""
    ratios = [x for n in range(2000) for h in [(2 * n + 1) / 200] for x in (h, math.nextafter(h, 9e9), math.nextafter(h, 0.0))]
    for r in spark.createDataFrame([(x,) for x in ratios], "ratio double").withColumn("percent", domains.rounded_percent("ratio")).collect():
        exact = Fraction(r["ratio"]) * 100
        assert r["percent"] == round(exact)


@pytest.mark.parametrize("text, language, n", [("loiœ Loi, loi_ LOI!", "fr", 2), ("xley ley leyы ley2 (ley)", "es", 2), ("rechtß recht", "de", 1), ("nothing", "en", 0), (None, "en", None)])
def test_whole_words(spark, text, language, n):
    row = domains.language_votes(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).first()
    assert row["language"] == language and (n is None or row[f"n_{language}"] == n)


def test_two_patches_of_one_event(spark):
    events = spark.createDataFrame([(1, 1, "unknown", None, None), (1, 2, "unknown", None, None)], "case_id bigint, event_id bigint, kind string, value string, actor string")
    patches = spark.createDataFrame([(1, 1, "2024-01-01", "a"), (1, 1, "2024-01-02", "b"), (1, 2, "2024-01-03", "c")], "case_id bigint, event_id bigint, value string, actor string")
    rows = {r["event_id"]: (r["kind"], r["value"], r["actor"]) for r in versions.enriched(events, patches).collect()}
    assert rows == {1: ("unknown", None, None), 2: ("date", "2024-01-03", "c")}


EVENTS = f"case_id bigint, event_id bigint, type string, kind string, value string, actors array<string>, objects array<string>, action string, state map<string,string>, evidence array<{REFERENCE}>"
MORE = "case_id bigint, event_id bigint, actors array<string>, objects array<string>, time_kind string, time_value string"


def test_enrichment(spark):
    event = lambda case, n, kind, value: (case, n, "Other", kind, value, ["p"], [], "x", None, [])
    events = spark.createDataFrame([event(1, 1, "unknown", None), event(1, 2, "date", "2024-01-01"), event(1, 3, "date", "2024-01-01"), event(1, 4, "unknown", None), event(2, 1, "unknown", None), event(3, 1, "unknown", None)], EVENTS)
    more = [
        (1, 1, ["q", "", "q\r\n"], ["o"], "datetime", "2024-05-01T00:00:00Z"), (1, 2, None, None, "date", "2024-01-01"), (1, 3, None, None, "relative", None), (1, 4, None, None, "relative", "soon"), (1, 9, None, None, "date", "2024-01-01"),
        (2, 1, None, None, "date", "2024-01-01"), (2, 1, None, None, "date", "2024-01-01"), (3, 1, [""], None, "instant", "x"), (3, 2, None, [], "date", None),
    ]
    table = spark.createDataFrame(more, MORE)
    assert {(r["case_id"], r["event_id"], r["fault"]) for r in enrichment.faults(table).collect()} == {(2, 1, "duplicate event"), (3, 1, "empty actors"), (3, 1, "unsupported time kind"), (3, 2, "empty objects"), (3, 2, "time without value")}
    new, conflicts = enrichment.enriched(events, table)
    found = {(r["case_id"], r["event_id"]): (r["kind"], r["value"], r["actors"], r["objects"]) for r in new.collect()}
    assert found[1, 1] == ("instant", "2024-05-01T00:00:00Z", ["p", "q", "q\n"], ["o"])
    assert found[1, 4] == ("unknown", None, ["p"], []) and found[2, 1][0] == "unknown" and found[3, 1][0] == "unknown"
    assert [(r["event_id"], r["told_kind"], r["told_value"]) for r in conflicts.collect()] == [(3, "unknown", None)]


def test_clauses_are_read_where_the_text_is(spark):
    """Language, clauses and their sentences come from one row's text: no text is shuffled or broadcast."""
    from factloom.plans import domain_queries

    found = domain_queries.secrecy_clauses(spark, "/root/testdata/sf0.001")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    docs = spark.createDataFrame([(1, "An agreement. The term is short."), (2, "Laufzeit; recht und partei."), (3, None), (4, "lawparty x-law")], "doc_id bigint, text string")
    told = domains.with_language(docs)
    assert [tuple(r) for r in told.select("doc_id", "language", "n_en", "n_de").orderBy("doc_id").collect()] == [(1, "en", 1, 0), (2, "de", 0, 2), (3, "en", 0, 0), (4, "en", 1, 0)]
    rows = domains.clause_texts(told.withColumnRenamed("language", "lang")).orderBy("doc_id").collect()
    assert [tuple(r) for r in rows] == [(1, "en", "term_duration", 2, "The term is short."), (2, "de", "laufzeit", 1, "Laufzeit; recht und partei.")]
