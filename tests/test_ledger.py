"""The ledger: written twice, tampered with, taken back; canonical JSON of nested rows against the plain form."""

import json
import os
import unicodedata

import pytest
from factloom.functions.canonical import canonical, with_canonical
from factloom.sources import ledger
from pyspark.sql import functions as F


@pytest.fixture
def rows(spark):
    spark.dataSource.register(ledger.Ledger)
    sealed = spark.range(20).select(F.concat(F.lit('{"case":'), "id", F.lit("}")).alias("bundle"), F.concat(F.lit('{"said":'), F.col("id") % 3, F.lit("}")).alias("output"))
    return ledger.files_of(sealed.withColumn("attestation", ledger.attested(F.col("bundle"), F.col("output"))))


def write(rows, folder):
    rows.write.format("ledger").mode("append").save(str(folder))


def contents(folder):
    return {os.path.join(d, f): open(os.path.join(d, f), "rb").read() for d, _, names in os.walk(folder) for f in names}


def test_written_twice_and_read(spark, rows, tmp_path):
    write(rows, tmp_path)
    before = contents(tmp_path)
    write(rows.repartition(7), tmp_path)
    assert contents(tmp_path) == before and len(before) == 60
    read = spark.read.format("ledger").load(str(tmp_path))
    assert sorted(map(tuple, read.collect())) == sorted((r[0], r[1], r[2]) for r in rows.collect())
    assert {r["ok"] for r in ledger.verified(read).collect()} == {True}


def test_tampering_is_seen(spark, rows, tmp_path):
    write(rows, tmp_path)
    folders = sorted(os.listdir(tmp_path))
    for folder, name, act in ((folders[0], ledger.OUTPUT, "ab"), (folders[1], ledger.BUNDLE, "ab"), (folders[2], ledger.ATTESTATION, None)):
        path = tmp_path / folder / name
        if act:
            with open(path, act) as file:
                file.write(b"\n")
        else:
            os.remove(path)
    errors = {r["bundle_sha256"]: r["errors"] for r in ledger.verified(spark.read.format("ledger").load(str(tmp_path))).where("NOT ok").collect()}
    assert errors == {folders[0]: "output is not what is attested", folders[1]: "folder is not the bundle's hash; bundle is not what is attested", folders[2]: "missing attestation"}


def test_other_content_fails_and_is_taken_back(spark, rows, tmp_path):
    write(rows.where("name = 'bundle.json'"), tmp_path)
    before = contents(tmp_path)
    other = rows.withColumn("content", F.when(F.col("name") == ledger.BUNDLE, F.lit(b"x")).otherwise(F.col("content")))
    with pytest.raises(Exception, match="another content"):
        write(other.coalesce(1), tmp_path)
    assert contents(tmp_path) == before
    with pytest.raises(Exception, match="no place"):
        write(rows.withColumn("name", F.lit("../x")), tmp_path)
    with pytest.raises(Exception, match="append"):
        rows.write.format("ledger").mode("overwrite").save(str(tmp_path))


def test_canonical_of_nested_rows(spark):
    schema = "v struct<b:array<struct<z:int,a:string>>,a:map<string,struct<y:boolean,x:bigint>>,c:struct<q:string>>"
    texts = ["plain", "café", "café", 'quote " \\ / \n\t', "\x01\x1f", "\\u0041", "😀", "n\n\u0301", "\u0301", "", None]
    values = [([(1, t), (None, "x"), None], {"k": (True, 5), t or "": None, "b": (None, -1)}, None if k % 2 else (t,)) for k, t in enumerate(texts)]
    rows = spark.createDataFrame([(v,) for v in values], schema)

    def plain(v):
        b, a, c = v
        return {"b": [None if x is None else {"z": x[0], "a": x[1]} for x in b], "a": {k: None if x is None else {"y": x[0], "x": x[1]} for k, x in a.items()}, "c": None if c is None else {"q": c[0]}}

    found = [r["j"] for r in with_canonical(rows, "v", "j").collect()]
    assert sorted(found) == sorted(canonical(plain(v)) for v in values)
    strings = [x for j in found for e in json.loads(j)["b"] if e for x in (e["a"],) if x]
    assert all(unicodedata.is_normalized("NFC", x) for x in strings) and "n\n\u0301" in strings  # an escape takes no accent
    assert with_canonical(rows.limit(1), "v", "j")._jdf.queryExecution().toString().count("ArrowEvalPython") <= 2
    with pytest.raises(TypeError):
        with_canonical(spark.range(1).selectExpr("struct(1.5D AS x) AS v"), "v", "j")


def test_names_stay_off_the_driver(tmp_path):
    """What a task tells the driver has one size, whatever the number of its files; a job that fails still takes them all back."""
    import pickle

    writer = ledger.LedgerWriter(str(tmp_path))
    rows = [{"bundle_sha256": f"{k:064x}", "name": ledger.BUNDLE, "content": b"x"} for k in range(300)]
    few, many, none = writer.write(iter(rows[:1])), writer.write(iter(rows[1:])), writer.write(iter([]))
    assert len(pickle.dumps(many)) == len(pickle.dumps(few)) and len(contents(tmp_path)) == 303
    writer.abort([few, None, many, none])
    assert not contents(tmp_path)
    writer.commit([writer.write(iter(rows))])
    assert len(contents(tmp_path)) == 300 and not (tmp_path / ledger.LISTINGS).exists()
