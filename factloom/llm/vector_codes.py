"""Vector code compression: codebooks by rounds of integer means; entries are filtered by lower bounds from coarse to fine.

A component x becomes the integer floor(SCALE * x); a vector is cut into PARTS equal parts, and each is coded as the nearest
of ENTRIES entries of that part's codebook. For a block of b components with sum S and root R = sqrt(b * sum of squares - S * S),
b times the squared distance to an entry is at least (S - S')^2 + (R - R')^2: the means differ by (S - S') / b, and the norms of the residuals from
the means by (R - R') / sqrt(b). The whole part is one block first, then halves, then quarters; each time the entry of the least bound gives an exact
distance that no bound may exceed, points with one entry left are done, and at the end the survivors' distances are computed exactly. The bounds are integers, and roots are given 2 of tolerance, so nothing
nearest is lost. Distances and sums are exact for components up to 1e30: values too large for 64 bits are Python integers.

Rows whose vector is null, or holds null or non-finite components, have no code and are left out. Vectors are padded with zeros to the longest
one's length and to a multiple of PARTS; an empty vector is all zeros. Without kept rows the codebooks are empty, and so is the result.
"""

from __future__ import annotations

import hashlib
import math
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm.common import free_name, join_hot, slices, stored

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Below this, eight squared differences of sums fit in 64 bits.
SMALL = 1 << 24
MAX_LONG = (1 << 63) - 1

#: Codebooks: for each part its entries, lists of integers.
Books = list[list[list[int]]]


def kept(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """The rows that have a code."""
    return rows.where(F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < float("inf"))))


def integers(vectors: list[list[float]] | pa.Array, width: int) -> np.ndarray:
    """Vectors without nulls as rows of floor(SCALE * x), padded with zeros to the width; Python integers if some are large."""
    if isinstance(vectors, pa.Array):
        sizes = np.diff(vectors.offsets.to_numpy())
        flat = vectors.values.slice(vectors.offsets[0].as_py(), int(sizes.sum())).to_numpy(zero_copy_only=False)
    else:
        sizes, flat = np.array([len(v) for v in vectors], int), np.array([x for v in vectors for x in v])
    made = np.zeros((len(sizes), width))
    made[np.arange(width) < sizes[:, None]] = flat
    if not made.size or np.abs(made).max() < SMALL / SCALE:
        return np.floor(made * SCALE).astype(np.int64)
    ratios = [[x.as_integer_ratio() for x in v] for v in made.tolist()]
    return np.array([[SCALE * over // under for over, under in v] for v in ratios], object).reshape(made.shape)


def roots(values: np.ndarray) -> np.ndarray:
    """Square roots, one off at most."""
    if values.dtype == object:
        return np.array([math.isqrt(v) for v in values.ravel()], object).reshape(values.shape)
    return np.sqrt(values.astype(float)).astype(np.int64)


def profile(points: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """S and R of each block of each point."""
    cut = points.reshape(len(points), blocks, points.shape[1] // blocks)
    sums = cut.sum(2)
    return sums, roots(cut.shape[2] * (cut * cut).sum(2) - sums * sums)


def nearest(points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each point's nearest entry, the first of equally near ones, and the squared distance to it."""
    n, m, width = len(points), len(entries), points.shape[1]
    if not width or not n:
        return np.zeros(n, int), np.zeros(n, np.int64)
    alive, best = np.ones((n, m), bool), None
    for blocks in (1, 2, 4):
        if width % blocks:
            break
        left = np.arange(n) if best is None else np.flatnonzero(alive.sum(1) > 1)  # points with more than one entry left
        (s, r), (t, q) = profile(points[left], blocks), profile(entries, blocks)
        bound = sum((s[:, b, None] - t[:, b]) ** 2 + np.maximum(np.abs(r[:, b, None] - q[:, b]) - 2, 0) ** 2 for b in range(blocks))
        likely = np.where(alive[left], bound, bound.max(initial=0) + 1).argmin(1)
        exact = ((points[left] - entries[likely]) ** 2).sum(1)
        best = exact if best is None else best
        best[left] = np.minimum(best[left], exact)
        alive[left] &= np.asarray(bound <= best[left][:, None] * (width // blocks), bool)
    row, entry = np.nonzero(alive)
    exact = np.repeat(best[:, None], m, 1) + 1
    exact[row, entry] = ((points[row] - entries[entry]) ** 2).sum(1)
    found = exact.argmin(1)
    return found, exact[np.arange(n), found]


def in_parts(vectors: np.ndarray, books: Books) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each part: the points, their nearest entries, the distances."""
    found = []
    for points, book in zip(np.split(vectors, PARTS, 1), books, strict=True):
        entries = np.array(book, object).reshape(len(book), points.shape[1])
        if points.dtype != object and all(abs(x) < SMALL for e in book for x in e):
            entries = entries.astype(np.int64)
        else:
            points = points.astype(object)
        found.append((points, *nearest(points, entries)))
    return found


def fit(rows: DataFrame, id_col: str = "vec_id", vector: str = "embedding", rounds: int = ROUNDS) -> Books:
    """The codebooks of all kept rows. They begin with the ENTRIES rows of the least ids (nulls last, equal ids by vector); fewer rows make
    fewer entries. In each round tasks send sums and counts for each entry, and the driver gets a number for each component of a codebook.

    rows is read once for each round: give a table, not what is dear to compute."""
    rows = kept(rows, vector).select(F.col(id_col).alias("id"), F.col(vector).alias("v"))
    first = [r["v"] for r in rows.orderBy(F.asc_nulls_last("id"), "v").limit(ENTRIES).collect()]
    if not first:
        return []
    width = -(-rows.agg(F.max(F.size("v"))).first()[0] // PARTS) * PARTS
    books = [part.tolist() for part in np.split(integers(first, width), PARTS, 1)]
    for _ in range(rounds):
        sums = rows.select("v").mapInArrow(summed(books, width), "part int, entry int, place int, total decimal(38,0)")
        totals = {(r["part"], r["entry"], r["place"]): int(r["total"]) for r in sums.groupBy("part", "entry", "place").agg(F.sum("total").alias("total")).collect()}
        for part, book in enumerate(books):
            for entry in range(len(book)):
                if count := totals.get((part, entry, -1), 0):
                    book[entry] = [totals.get((part, entry, k), 0) // count for k in range(width // PARTS)]
    return books


def sums_of(points: np.ndarray, entry: np.ndarray) -> list[list[int]]:
    """For each entry up to the last that is used: how many points have it, and the sum of each of their components."""
    if points.dtype == object:
        return [[int((entry == e).sum()), *points[entry == e].sum(0).tolist()] for e in range(entry.max(initial=-1) + 1)]
    # doubles hold these sums exactly: a batch has fewer than 2^29 rows of components below SMALL
    return np.column_stack([np.bincount(entry), *[np.bincount(entry, points[:, k]) for k in range(points.shape[1])]]).astype(np.int64).tolist()


def summed(books: Books, width: int):
    """A function for mapInArrow: a task's sums by part, entry and place; the count has place -1."""

    def run(batches):
        totals: dict[tuple[int, int, int], int] = {}
        for batch in batches:
            for piece in slices([batch], "v"):
                for part, (points, entry, _) in enumerate(in_parts(integers(piece.column("v"), width), books)):
                    for e, found in enumerate(sums_of(points, entry)):
                        for place, total in enumerate(found if found[0] else (), -1):
                            totals[part, e, place] = totals.get((part, e, place), 0) + int(total)
        if totals:
            keys = [pa.array(column, pa.int32()) for column in zip(*totals, strict=True)]
            yield pa.RecordBatch.from_arrays([*keys, pa.array([Decimal(v) for v in totals.values()], pa.decimal128(38, 0))], names=["part", "entry", "place", "total"])

    return run


def encode(rows: DataFrame, books: Books, vector: str = "embedding") -> DataFrame:
    """rows that have a code, with code (a byte for each part) and error (summed squared distances, at most 2^63 - 1); columns
    of rows with those names are replaced. Vectors longer than those of fit are cut, as their further places have no entries."""
    width = PARTS * (len(books[0][0]) if books else 0)
    names = [c for c in rows.columns if c.lower() not in ("code", "error")]
    fields = [T.StructField("code", T.BinaryType()), T.StructField("error", T.LongType())]
    source = free_name("v", rows)

    def run(batches):
        for batch in slices(batches, source):
            parts = in_parts(integers(batch.column(source), width), books)
            code = np.stack([entry for _, entry, _ in parts], 1).astype(np.uint8)
            error = [min(sum(d), MAX_LONG) for d in zip(*[d.tolist() for _, _, d in parts], strict=True)]
            made = [pa.array([c.tobytes() for c in code], pa.binary()), pa.array(error, pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], names=[*names, "code", "error"])

    if not books:
        rows = rows.where(F.lit(False))
    short = F.slice(F.col(vector), 1, max(1, width)) if width else F.array().cast("array<double>")
    return kept(rows, vector).select(*[F.col(f"`{c}`") for c in names], short.alias(source)).mapInArrow(run, T.StructType([rows.schema[c] for c in names] + fields))


def decoded(code: Column, books: Books) -> Column:
    """The vector that a code stands for: its entries' components, over SCALE."""
    values = F.from_json(F.lit(str([[[x / SCALE for x in e] for e in book] for book in books])), "array<array<array<double>>>")
    digits = F.transform(F.sequence(F.lit(1), F.lit(max(1, len(books)))), lambda k: F.conv(F.hex(F.substring(code, k, 1)), 16, 10).cast("int"))
    return F.flatten(F.zip_with(values, digits, lambda book, entry: F.get(book, entry)))


def digests(encoded: DataFrame, books: Books, id_col: str = "vec_id", label: str = "label") -> DataFrame:
    """The columns of the contract. Errors are added up for each label, nulls together; sums beyond 2^63 - 1 are given as that."""
    rows = stored(encoded.select(F.col(id_col).alias("vec_id"), F.lower(F.hex("code")).alias("code"), "error", F.to_json(F.struct(F.col(label).alias("label"))).alias("key")), "codes")
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(MAX_LONG).cast("decimal(38,0)")).cast("bigint")
    labels = stored(rows.groupBy("key").agg(total.alias("label_error"), F.count("*").alias("n")), "labels")
    numbers = ",".join(str(x) for book in books for entry in book for x in entry)
    made = join_hot(rows, labels, ["key"], "n")
    return made.select("vec_id", "code", "error", "label_error", F.lit(hashlib.sha256(numbers.encode()).hexdigest()).alias("codebooks_sha256"))
