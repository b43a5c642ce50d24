"""The corpus pipeline, stage by stage, each on what the one before it kept."""

import corpus_pipeline
import numpy as np
import tiktoken
from factloom.llm import queries
from factloom.llm.bpe import read_ranks
from tests.llm.test_against_brute_force import near, windows

import public_tokenizers

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs, kept = spark.read.parquet(f"{SF}/documents.parquet"), {}
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert k == 4 or docs.columns == columns
        kept[name] = {r["doc_id"]: r for r in docs.collect()}
    quality = {r["doc_id"] for r in queries.op3_quality_rules(spark, SF).where("kept").collect()}
    assert set(kept["quality_rules"]) == quality == set(kept["line_dedup"])
    groups = near({k: r["text"] or "" for k, r in kept["line_dedup"].items()}, 5)
    assert set(kept["near_dedup"]) == {k for k, (_, c) in groups.items() if k == c}
    items = windows({r["item_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()})
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    import re

    def clean(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(lower))
        return not any(tuple(words[j : j + n]) in items for n in {len(w) for w in items} for j in range(len(words) - n + 1))

    assert set(kept["decontamination"]) == {k for k, r in kept["near_dedup"].items() if clean(r["text"] or "")}
    ranks = {t: k for k, t in enumerate(read_ranks(public_tokenizers.path(queries.RANKS)))}
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in kept["byte_bpe"].values():
        assert bytes(r["token_ids"]) == np.array(encoding.encode_ordinary(r["text"]), "<u4").tobytes() and r["round_trip"]
    assert set(kept["byte_bpe"]) == set(kept["decontamination"])
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, SF).collect()} == set(kept["byte_bpe"])


def test_empty_and_odd_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = docs.limit(0).union(spark.createDataFrame([(1, None, None, None, None), (1, None, None, None, None), (None, "", "en", "s", 0)], docs.schema))
    for start in (docs.limit(0), odd):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, start, SF)
            assert k == 4 or out.columns == docs.columns
            out.collect()
