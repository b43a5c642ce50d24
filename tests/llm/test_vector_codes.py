"""op12: bounds that lose nothing, codebooks and codes against plain loops, edges."""

import math
import random

import duckdb
import numpy as np
import pytest
from factloom.llm import vector_codes as vc
from factloom.llm.queries import op12_vector_codes, vector_codes_sql

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def by_loops(vectors, rounds=6):
    """Codebooks and (code, error) of integer vectors by looking at every entry."""
    width = len(vectors[0]) // 8
    books = [[v[p * width : (p + 1) * width] for v in vectors[:16]] for p in range(8)]

    def code(v):
        found = [min((sum((a - b) ** 2 for a, b in zip(v[p * width : (p + 1) * width], e, strict=True)), k) for k, e in enumerate(books[p])) for p in range(8)]
        return [k for _, k in found], sum(d for d, _ in found)

    for _ in range(rounds):
        codes = [code(v)[0] for v in vectors]
        for p in range(8):
            for k in range(len(books[p])):
                parts = [v[p * width : (p + 1) * width] for v, c in zip(vectors, codes, strict=True) if c[p] == k]
                if parts:
                    books[p][k] = [math.floor(sum(x) / len(parts)) if abs(sum(x)) < 2**50 else sum(x) // len(parts) for x in zip(*parts, strict=True)]
    return books, [code(v) for v in vectors]


@pytest.mark.parametrize("large", [False, True])
def test_nearest(large):
    rng = np.random.default_rng(1)
    for width in (1, 2, 3, 4, 8, 12):
        points, entries = rng.integers(-9, 9, (400, width)), rng.integers(-9, 9, (16, width))
        if large:
            points, entries = points.astype(object) * 10**25, entries.astype(object) * 10**25
        distances = ((points[:, None] - entries[None]) ** 2).sum(2)
        found, d = vc.nearest(points, entries)
        assert found.tolist() == distances.argmin(1).tolist() and d.tolist() == distances.min(1).tolist()


def test_bounds_hold():
    rng = np.random.default_rng(2)
    points, entries = rng.integers(-(1 << 23), 1 << 23, (300, 8)), rng.integers(-(1 << 23), 1 << 23, (16, 8))
    exact = ((points[:, None] - entries[None]) ** 2).sum(2)
    for blocks in (1, 2, 4):
        (s, r), (t, q) = vc.profile(points, blocks), vc.profile(entries, blocks)
        bound = ((s[:, None] - t[None]) ** 2 + np.maximum(np.abs(r[:, None] - q[None]) - 2, 0) ** 2).sum(2)
        assert (bound <= exact * (8 // blocks)).all()


def test_against_loops(spark):
    rng = random.Random(3)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(16)], rng.choice([None, 1, 2])) for i in range(120)]
    rows += [(200, rows[0][1], 1), (201, None, 1), (202, [*rows[0][1][:15], None], 1), (203, [float("nan")] * 16, 2), (204, [float("inf")] * 16, 2)]
    table = spark.createDataFrame(rows, SCHEMA)
    books = vc.fit(table)
    kept = [r for r in rows if r[0] < 201]
    vectors = [[math.floor(4096 * x) for x in np.array(v, np.float32).astype(float).tolist()] for _, v, _ in kept]
    expected, codes = by_loops(vectors)
    assert books == expected
    encoded = vc.encode(table, books)
    found = {r["vec_id"]: r for r in vc.digests(encoded, books).collect()}
    assert {i: (f["code"], f["error"]) for i, f in found.items()} == {r[0]: (bytes(c).hex(), e) for r, (c, e) in zip(kept, codes, strict=True)}
    for label in (None, 1, 2):
        total = sum(e for r, (_, e) in zip(kept, codes, strict=True) if r[2] == label)
        assert {found[r[0]]["label_error"] for r in kept if r[2] == label} == {total}
    back = encoded.select("vec_id", vc.decoded(encoded["code"], books).alias("v")).collect()
    for row in back:
        code = bytes.fromhex(found[row["vec_id"]]["code"])
        assert row["v"] == [x / 4096 for p, k in enumerate(code) for x in books[p][k]]


def test_edges(spark):
    """Few rows, repeated ids, vectors of other lengths, large components, clashing names, no rows."""
    rows = [(1, [], 1), (1, [0.5], 1), (1, [0.5], 1), (None, [1e20] * 9, None), (2, [-0.00001] * 8, 1)]
    table = spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA + ", code int, V int")
    books = vc.fit(table)
    assert [len(b) for b in books] == [5] * 8 and len(books[0][0]) == 2
    encoded = vc.encode(table, books)
    assert encoded.columns == ["vec_id", "embedding", "label", "V", "code", "error"]
    found = vc.digests(encoded, books).collect()
    assert len(found) == 5 and all(len(r["code"]) == 16 for r in found)
    empty = table.where("vec_id > 5")
    assert vc.fit(empty) == [] and vc.digests(vc.encode(empty, []), []).collect() == []


def test_sql(spark):
    duckdb.sql("CREATE OR REPLACE VIEW embeddings AS SELECT * FROM '/root/testdata/sf0.001/embeddings.parquet'")
    relation = duckdb.sql(vector_codes_sql())
    ours = op12_vector_codes(spark, "/root/testdata/sf0.001").select(*relation.columns).collect()
    assert sorted(map(tuple, ours)) == sorted(relation.fetchall())
