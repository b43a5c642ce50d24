"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing names, for every operator."""

import pytest
from factloom.llm import bpe, decontam, html_extract, langid, line_dedup, near_dedup, pii, quality, suffix_dedup, toxicity
from pyspark.sql import functions as F

import public_tokenizers

LONG = "alpha beta gamma delta epsilon zeta eta theta kappa lambda mu nu " * 3000
ROWS = [(1, None, "en"), (2, "", None), (3, LONG, "en"), (4, "Some words of a plain text, no more.", "en"), (4, "Some words of a plain text, no more.", "en"), (None, "No id here but ten words or more to be read.", "fr")]


def model(spark):
    train = spark.createDataFrame([(i, t, x) for i in range(6) for t, x in (("the cat and the dog", "en"), ("le chat et le chien", "fr"))], "doc_id bigint, text string, lang string")
    return langid.fit(train)


def tox(spark):
    docs = spark.createDataFrame([(i, "you idiot moron" if i % 2 else "a calm word") for i in range(12)], "doc_id bigint, text string")
    return toxicity.fit(docs, spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id bigint, toxic int"))


def bench(spark):
    return spark.createDataFrame([(1, "some words of a plain text"), (2, None), (3, "")], "item_id bigint, text string")


OPERATORS = {
    "bpe": (lambda s, d: bpe.encode_documents(d, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN), ["n_tokens", "token_ids", "decoded"]),
    "langid": (lambda s, d: langid.predict(d, model(s)), ["lang_pred", "score", "ambiguous"]),
    "pii": (lambda s, d: pii.find_spans(d), ["spans", "base_spans"]),
    "quality": (lambda s, d: quality.judge(quality.ledger(d)), [*quality.MEASURES, "failed", "base_failed", "kept"]),
    "toxicity": (lambda s, d: toxicity.score(d, tox(s)), ["score", "predicted"]),
    "suffix": (lambda s, d: suffix_dedup.remove_repeats(d), ["n_bytes", "n_removed", "n_spans", "spans", "kept_bytes"]),
    "html": (lambda s, d: html_extract.extract_pages(d.withColumnRenamed("text", "html")).withColumnRenamed("text", "main").withColumnRenamed("html", "text"), ["main", "n_chars"]),
    "lines": (lambda s, d: line_dedup.drop_recurring_lines(d), ["n_lines", "n_dropped"]),
    "near": (lambda s, d: near_dedup.near_duplicates(d), ["n_shingles", "component_id", "kept"]),
    "decontam": (lambda s, d: decontam.find_matches(d, bench(s)), ["n_words", "hits", "items", "near_items"]),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_edge_rows(spark, name):
    run, added = OPERATORS[name]
    docs = spark.createDataFrame(ROWS, "doc_id bigint, text string, lang string")
    clash = docs.withColumns({c: F.lit("old") for c in added if c not in ("text", "main")})
    out = run(spark, clash)
    assert sorted(out.columns) == sorted([*docs.columns, *added])
    rows = out.collect()
    assert len(rows) == len(ROWS)
    assert all(r[c] != "old" for r in rows for c in added)
    by_id = {}
    for r in rows:
        by_id.setdefault(r["doc_id"], []).append([r[c] for c in added])
    assert by_id[4][0] == by_id[4][1]
    assert run(spark, docs.where("doc_id > 99")).count() == 0


def test_defined_results(spark):
    docs = spark.createDataFrame(ROWS, "doc_id bigint, text string, lang string")
    get = lambda df: {r["doc_id"]: r for r in df.collect()}
    near = get(near_dedup.near_duplicates(docs))
    assert [near[k]["component_id"] for k in (1, 2, 3, 4)] == [1, 2, 3, 4] and near[1]["n_shingles"] == 0 and near[None]["kept"]
    assert near_dedup.near_duplicates(docs, merge_rows=True).count() == 5
    quality_rows = get(quality.judge(quality.ledger(docs)))
    assert quality_rows[1]["n_words"] == 0 and quality_rows[2]["base_failed"] and not quality_rows[3]["kept"]
    lang = get(langid.predict(docs, model(spark)))
    assert lang[1]["lang_pred"] == lang[2]["lang_pred"] == "und" and lang[4]["lang_pred"] in ("en", "fr")
    hit = get(decontam.find_matches(docs, bench(spark)))
    assert hit[4]["items"] == ["1"] and hit[4]["hits"] == [0, 6] and hit[1]["n_words"] == 0
    cut = get(suffix_dedup.remove_repeats(docs))
    assert cut[3]["n_bytes"] == len(LONG) and cut[3]["n_removed"] == len(LONG) and cut[4]["n_removed"] == 0
    lines = get(line_dedup.drop_recurring_lines(docs))
    assert lines[1]["text"] is None and lines[2]["text"] == ""


def test_untrained_models(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string, lang string, toxic int")
    docs = spark.createDataFrame(ROWS, "doc_id bigint, text string, lang string")
    assert {r["lang_pred"] for r in langid.predict(docs, langid.fit(none)).collect()} == {"und"}
    assert {r["predicted"] for r in toxicity.score(docs, toxicity.fit(docs, none.select("doc_id", "toxic"))).collect()} == {0}
    assert {tuple(r["items"]) for r in decontam.find_matches(docs, none.select(F.col("doc_id").alias("item_id"), "text")).collect()} == {()}
