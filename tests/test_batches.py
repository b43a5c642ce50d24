"""Texts in pieces of bounded size: composition, matches and their sentences."""

import unicodedata

import pyarrow as pa
from factloom.functions import batches, text
from factloom.operators import extraction
from pyspark.sql import functions as F


def test_slices_are_bounded():
    texts = ["x" * 600_000, "y" * 600_000, None, "z" * 3_000_000, "", "w"] + ["v" * 1000] * 5000
    batch = pa.RecordBatch.from_pydict({"id": range(len(texts)), "text": texts})
    pieces = list(batches.slices(iter([batch, batch.slice(0, 0)])))
    assert pa.Table.from_batches(pieces).column("text").to_pylist() == texts
    assert all(p.num_rows == 1 or sum(len(t or "") for t in p["text"].to_pylist()) <= batches.SLICE_BYTES for p in pieces)


def test_composed_is_nfc(spark):
    """All characters that composition changes or joins, alone and behind a letter, and texts that stay on the JVM."""
    odd = [chr(c) for c in range(0x80, 0x2FA20) if not 0xD800 <= c < 0xE000 and (unicodedata.combining(chr(c)) or unicodedata.decomposition(chr(c)))]
    texts = [x for c in odd for x in (c, f"a{c}", f"\u1100{c}", f"é{c}\u0323", *(unicodedata.normalize(f, c) for f in ("NFD", "NFKD")))] + [None, "", "plain", "é ü 😀 中文", "\u1100\u1161\u11a8"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    found = dict(text.composed(rows, "t").collect())
    assert found == {k: t and unicodedata.normalize("NFC", t) for k, t in enumerate(texts)}
    stays = spark.createDataFrame([("é ü ß",), ("中文 😀",), ("дом",)], "t string")
    assert not stays.where(F.col("t").rlike(text.unsettled())).count()


def test_matches_with_their_sentences(spark):
    """As the window over matches and sentences finds them, without a shuffle."""
    texts = ["Anna came. She left!  \n he stayed; it rained\n\nThey", " . he", "", None, "...", "\t she\n\n\nHer name. Bert and his dog"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    patterns = {"p": extraction.PRONOUN, "m": extraction.MENTION, "blank": r"\s"}
    found = extraction.in_sentences(docs, patterns)
    expected = extraction.in_spans(extraction.find_all(docs, patterns), extraction.sentences(docs), "start")
    assert found.columns == expected.columns and sorted(found.collect()) == sorted(expected.collect()) and found.count() > 10
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_mentions_are_not_broadcast(spark, tmp_path):
    """A small file of texts may hold many mentions."""
    spark.createDataFrame([(1, "Jesus spoke. He left.")], "doc_id long, text string").write.parquet(str(tmp_path / "t"))
    docs = spark.read.parquet(str(tmp_path / "t"))
    pronouns, people = extraction.in_sentences(docs, {"p": extraction.PRONOUN}), extraction.character_mentions(docs, find=extraction.in_sentences)
    for found in (extraction.agreeing_references(pronouns, people), extraction.references(pronouns, people)):
        assert "Broadcast" not in found._jdf.queryExecution().sparkPlan().toString()
        assert found.count() == 1
