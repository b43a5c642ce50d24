"""Span operators, reports and the admission stream on literal cases."""

import json
import os

from factloom.operators import extraction as ex
from factloom.operators import reports, service, world
from factloom.streaming.admission import stream_admissions
from pyspark.sql import functions as F

TEXT = "Anna opened the door and Bert waited. She smiled; he turned.\nDr. Ude said \"Is it late?\" then."


def docs(spark):
    return spark.createDataFrame([(1, TEXT), (2, ""), (3, None)], "doc_id bigint, text string")


def cut(rows):
    return [TEXT[r["start"] : r["end"]] for r in sorted(rows, key=lambda r: r["start"])]


def test_sentences_and_clauses(spark):
    spans = ex.sentences(docs(spark), ("dr",))
    assert cut(spans.collect()) == ["Anna opened the door and Bert waited.", "She smiled; he turned.", 'Dr. Ude said "Is it late?', '" then.']
    assert cut(ex.clauses(docs(spark), spans).collect()) == ["Anna opened the door", " and Bert waited.", "She smiled;", " he turned.", 'Dr. Ude said "Is it late?', '" then.']


def test_references_and_frames(spark):
    spans = ex.sentences(docs(spark), ("dr",))
    mentions = ex.in_spans(ex.find_all(docs(spark), {"m": "Anna|Bert|Ude"}), spans, "start")
    pronouns = ex.in_spans(ex.find_all(docs(spark), {"p": ex.PRONOUN}), spans, "start")
    found = {r["surface"]: r["refers_to"] for r in ex.references(pronouns, mentions).collect()}
    assert found == {"She": "Bert", "he": "Bert", "it": "Ude"}
    none = ex.references(pronouns, mentions.where("surface = 'Ude'")).orderBy("start").collect()
    assert [r["refers_to"] for r in none] == ["unknown_1", "unknown_2", "Ude"]
    clauses = ex.clauses(docs(spark), spans)
    inside = lambda p: ex.in_spans(ex.find_all(docs(spark), {"x": p}), clauses, "start")
    frames = {r["verb"]: (r["actor"], r["object"]) for r in ex.frames(inside("opened|waited|turned|said"), inside("Anna|Bert|Ude")).collect()}
    assert frames == {"opened": ("Anna", None), "waited": ("Bert", None), "turned": (None, None), "said": ("Ude", None)}


def test_utterances(spark):
    row = ex.utterances(docs(spark)).first()
    assert (row["quote"], row["speaker"], row["asks"]) == ("Is it late?", "Bert", True)


def test_budget(spark):
    lines = F.array(*[F.lit(f"l{k}") for k in range(5)])
    text = lambda n: spark.range(1).select(reports.budgeted([("A", lines), ("B", lines)], n)).first()[0]
    assert text(100).count("l") == 10 and text(10) == "A\n" + "\n".join(f"l{k}" for k in range(5)) + "\n\nB\nl0\nl1" and text(0) == "A\nNone.\n\nB\nNone."


def test_repair_actions(spark):
    verdicts = spark.createDataFrame([(1, "FAIL", "RULE_CAUSAL_TEMPORAL_CYCLE,RULE_CONSTRAINT_VIOLATION"), (2, "NEEDS_INFO", "RULE_WORLD_UNKNOWNS_SECURITY"), (3, "OK", "")], "case_id bigint, status string, reasons string")
    assert {(r["case_id"], r["priority"]) for r in reports.repair_actions(verdicts).collect()} == {(1, 20), (1, 25), (2, 10)}


def test_fan_out_counts_later_times(spark):
    df = spark.createDataFrame([(1, 1, "date", "1"), (1, 2, "date", "2"), (1, 3, "date", "2"), (1, 4, "unknown", None)], "case_id bigint, event_id bigint, kind string, value string")
    assert {(r["event_id"], r["fan_out"]) for r in world.fan_out(df).collect()} == {(1, 2), (2, 0), (3, 0)}


def test_stream_agrees_with_batch(spark, tmp_path):
    rows = [{"tenant_id": k % 2, "endpoint": "e", "event_id": k, "s": 7 * k} for k in range(60)]
    schema = "tenant_id bigint, endpoint string, event_id bigint, s bigint"
    (tmp_path / "in").mkdir()
    for part in range(3):
        (tmp_path / "in" / f"{part}.json").write_text("\n".join(json.dumps(r) for r in rows[20 * part : 20 * part + 20]))
        os.utime(tmp_path / "in" / f"{part}.json", (1_700_000_000 + part,) * 2)  # the source takes files by time; equal times have no order
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).json(str(tmp_path / "in")).withColumn("ts", F.timestamp_seconds("s"))
    query = stream_admissions(stream, 3, 60).writeStream.format("memory").queryName("admitted").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    batch = service.admissions(spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds("s")), 3, 60)
    get = lambda df: {(r["tenant_id"], r["event_id"], r["admitted"]) for r in df.collect()}
    assert get(spark.table("admitted")) == get(batch) and len(get(batch)) == 60


def test_references_that_agree(spark):
    """Random sentences of names and pronouns against a scan of all candidates, with names of unknown gender or number."""
    import random
    import re

    from factloom.operators import extraction

    rng = random.Random(3)
    people = {"Ann": (r"\bAnn\b", "F", "S"), "Bob": (r"\bBob\b", "M", "S"), "Crew": (r"\bCrew\b", "P", "P"), "Dee": (r"\bDee\b", None, None)}
    words = [*people, "he", "She", "THEY", "it", "his", "them", "its", "went", "home"]
    texts = {k: " ".join(" ".join(rng.choices(words, k=rng.randrange(1, 5))) + rng.choice(".!?") for _ in range(7)) for k in range(60)}
    docs = spark.createDataFrame([*texts.items(), (99, None), (98, "")], "doc_id bigint, text string")
    spans = extraction.sentences(docs)
    pronouns = extraction.in_spans(extraction.find_all(docs, {"pronoun": extraction.PRONOUN}), spans, "start")
    mentions = extraction.in_spans(extraction.character_mentions(docs, people), spans, "start")
    found = {(r["doc_id"], r["start"]): (r["refers_to"], r["rule"], r["position"]) for r in extraction.agreeing_references(pronouns, mentions).collect()}
    expected = {}
    for k, text in texts.items():
        sentence = lambda at, text=text: sum(text[:at].count(c) for c in ".!?")
        named = [(m.start(), n) for n, (p, _, _) in people.items() for m in re.finditer(p, text)]
        unknown, position = {}, 0
        for m in re.finditer(extraction.PRONOUN, text):
            gender, number = extraction.PRONOUN_KINDS[m.group().lower()]
            fits = [(sentence(m.start()) - sentence(at), -at, n) for at, n in named if 0 <= sentence(m.start()) - sentence(at) <= 2 and not (gender in "MF" and people[n][1] not in (None, gender)) and not (number == "P" and people[n][2] not in (None, "P"))]
            if fits:
                expected[k, m.start()] = (min(fits)[2], "recency", position)
            else:
                unknown[gender] = unknown.get(gender, 0) + 1
                expected[k, m.start()] = (f"unknown_{gender}_{unknown[gender]}", "lookback_limit", position)
            position += 1
    assert len(expected) > 300 and found == expected
