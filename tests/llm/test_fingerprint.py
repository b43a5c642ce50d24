"""op13: sketches against hashlib, texts beside the next ones, edges."""

import hashlib
import random
import re

import duckdb
import pytest
from factloom.llm import fingerprint
from factloom.llm.queries import FINGERPRINT_SQL, op13_fingerprints
from pyspark.sql import functions as F


def sketch(text):
    words = [w.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for w in re.findall("[^\x20\x09-\x0d]+", text or "")]
    if not words:
        return []
    hashes = {hashlib.md5(" ".join(words[i : i + 5]).encode()).hexdigest()[:16] for i in range(max(1, len(words) - 4))}
    return sorted(h for h in hashes if h < "2") or ["0" + hashlib.md5(" ".join(words).encode()).hexdigest()[1:16]]


TEXTS = [None, "", " \t\n", "a", "One two THREE", "one two three", "É é İ", "w\x1cx y\x85z", " ".join(f"w{k}" for k in range(5000)), "x " * 50_000]


def test_sketch(spark):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string").select("doc_id", fingerprint.sketch(F.col("text")).alias("s")).collect()
    for row in rows:
        assert row["s"] == sketch(TEXTS[row["doc_id"]])


def likeness(a, b):
    a, b = set(a), set(b)
    return len(a & b) / len(a | b) if a | b else 1.0


@pytest.mark.parametrize("rows_in_bucket", [2, 512])
def test_beside_next(spark, monkeypatch, rows_in_bucket):
    """With buckets of any size, each document meets the next one; null and equal ids, and names that clash, do no harm."""
    monkeypatch.setattr(fingerprint, "BUCKET_ROWS", rows_in_bucket)
    rng = random.Random(4)
    docs = [(rng.choice([-5, 7, 2**40, *range(30)]), " ".join(rng.choices("abcdefg", k=rng.randrange(12)))) for _ in range(60)] + [(None, "n o"), (None, None), (3, "a"), (3, "a")]
    table = spark.createDataFrame([(*d, 1, "x", True) for d in docs], "doc_id bigint, text string, bucket int, next_text string, guest boolean").repartition(3)
    order = sorted([(i, t or "") for i, t in docs], key=lambda d: (d[0] is None, -(d[0] or 0), d[1]))
    expected = []
    for (i, text), (_, following) in zip(order, order[1:] + order[:1], strict=True):
        third = len(text) // 3
        expected.append((i, text, text[: len(text) - third] + following[:third], following))
    made = fingerprint.with_edits(table)
    assert sorted((r["doc_id"], r["text"], r["edited"], r["next_text"]) for r in made.where("doc_id IS NOT NULL").collect()) == sorted(e for e in expected if e[0] is not None)
    assert sorted((r["text"], r["next_text"]) for r in made.where("doc_id IS NULL").collect()) == sorted((e[1], e[3]) for e in expected if e[0] is None)
    for row in fingerprint.digests(made).where("doc_id IS NOT NULL").collect():
        hits = [e for e in expected if e[0] == row["doc_id"] and hashlib.sha256(e[2].encode()).hexdigest() == row["edited_sha256"] and "".join(sketch(e[1])) == row["fingerprint"]]
        assert any(abs(row["near_edited"] - likeness(sketch(e[1]), sketch(e[2]))) < 1e-12 and abs(row["near_next"] - likeness(sketch(e[1]), sketch(e[3]))) < 1e-12 for e in hits)


def test_one_none_and_only_null_ids(spark):
    one = spark.createDataFrame([(1, "a b c d e f")], "doc_id bigint, text string")
    row = fingerprint.digests(fingerprint.with_edits(one)).first()
    assert row["near_next"] == 1.0 and row["n_chars"] == 11
    assert fingerprint.digests(fingerprint.with_edits(one.limit(0))).collect() == []
    none = spark.createDataFrame([(None, "b"), (None, "a")], "doc_id bigint, text string")
    assert {(r["text"], r["next_text"]) for r in fingerprint.with_edits(none).collect()} == {("a", "b"), ("b", "a")}


def test_sketches_merge_and_contain(spark):
    """The union of two sketches is that of both texts; a short text within a long one is found to be contained."""
    rng = random.Random(8)
    long = " ".join(f"w{rng.randrange(10**6)}" for _ in range(8000))
    part = " ".join(long.split()[1000:1600])
    table = spark.createDataFrame([(1, long), (2, part)], "doc_id bigint, text string").select("doc_id", fingerprint.sketch(F.col("text")).alias("s"))
    both = table.agg(fingerprint.merged(F.col("s")).alias("s")).first()["s"]
    assert both == sorted({*sketch(long), *sketch(part)})
    a, b = table.alias("a"), table.alias("b")
    row = a.where("a.doc_id = 2").join(b.where("b.doc_id = 1")).select(fingerprint.contained(F.col("a.s"), F.col("b.s")).alias("c"), fingerprint.likeness(F.col("a.s"), F.col("b.s")).alias("l")).first()
    assert row["c"] == 1.0 and row["l"] < 0.15


def test_no_python_in_the_plan(spark):
    plan = op13_fingerprints(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_sql(spark):
    duckdb.sql("CREATE OR REPLACE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    relation = duckdb.sql(FINGERPRINT_SQL)
    ours = op13_fingerprints(spark, "/root/testdata/sf0.001").select(*relation.columns).collect()
    assert sorted((*r[:5], *(round(x, 9) for x in r[5:])) for r in ours) == sorted((*r[:5], *(round(x, 9) for x in r[5:])) for r in relation.fetchall())
