"""Files of folders: paths, endings, bytes that are no text, manifests."""

import hashlib

import pytest
from factloom.sources import inputs
from factloom.sources.records import text_files
from pyspark.sql import functions as F


@pytest.fixture
def folder(tmp_path):
    for name, content in {"a.md": "é\r\nx", "sub dir/b.TXT": "b", "sub dir/deep/c.json": "﻿{}", "d.pdf": "no"}.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content.encode())
    return tmp_path


@pytest.mark.parametrize("form", ["{}", "{}/", "file://{}"])
def test_text_files(spark, folder, form):
    rows = {r["relpath"]: r for r in text_files(spark, form.format(folder)).collect()}
    assert set(rows) == {"a.md", "sub dir/b.TXT"}
    assert (rows["a.md"]["text"], rows["a.md"]["bytes"], rows["a.md"]["sha256"]) == ("é\r\nx", 5, hashlib.sha256("é\r\nx".encode()).hexdigest())


def test_bytes_that_are_no_text(spark, folder):
    (folder / "bad.txt").write_bytes(b"ok \xff\xfe")
    with pytest.raises(Exception, match="not UTF-8: bad.txt"):
        text_files(spark, str(folder)).collect()


def test_manifest(spark, folder):
    found = inputs.files(spark, str(folder))
    manifest = inputs.manifest_of(found)
    assert {(r["ref"], r["status"]) for r in inputs.resolved(found, manifest).collect()} == {("a", "ok"), ("sub dir/b", "ok"), ("sub dir/deep/c", "ok"), ("d", "ok")}
    odd = manifest.where("ref = 'a'").withColumn("sha256", F.upper("sha256")).union(spark.createDataFrame([("gone", "gone.md", "0"), ("d", "d.pdf", "0"), ("twice", "a.md", "0"), ("twice", "d.pdf", "0")], "ref string, relpath string, sha256 string"))
    rows = inputs.resolved(found, odd).collect()
    assert sorted((r["ref"], r["status"], r["content"] is None) for r in rows) == [("a", "ok", False), ("d", "altered", True), ("gone", "missing", True), ("twice", "ambiguous", True), ("twice", "ambiguous", True)]
    text = found.where("relpath LIKE '%.json'").select(inputs.json_text(F.col("content"), F.col("relpath"))).first()[0]
    assert text == "{}"
