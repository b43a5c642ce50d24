"""Toxicity by a linear classifier over character n-grams, scaled by naive Bayes log-count ratios.

A feature is the presence of a hashed n-gram of a word with its edges. Its value is its log-count ratio between toxic and
other training texts; a logistic regression with a penalty on its weights is fitted on those values.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm.common import map_column, stored

#: Lengths of n-grams, and to how many numbers they are hashed.
SIZES, BUCKETS = (4, 5, 6), 1 << 21
#: Labelled documents of each label that training reads at most, about.
TRAIN_PER_LABEL = 1500
SMOOTHING = 1.0
#: A feature is used if at least so many training texts of one label, and this share of them, have it, and if its ratio is at least that.
MIN_TEXTS, MIN_SHARE, MIN_RATIO = 3, 0.015, 1.0
PENALTY, STEPS = 0.003, 300
THRESHOLD = 0.7


def features(text: str | None) -> np.ndarray:
    """Sorted distinct hashed n-grams of a text: runs of letters, with one edge character between them."""
    if not text:
        return np.zeros(0, np.uint32)
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    letter = (codes >= 0x61) & (codes <= 0x7A) | (codes >= 0xC0)
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[:1] = True
    c = np.concatenate((np.array([32], np.uint32), np.where(letter, codes, 32)[keep].astype(np.uint32), np.array([32], np.uint32)))
    out, h, edge = [], c, c == 32
    for n in range(2, max(SIZES) + 1):
        h = h[:-1] * np.uint32(0x01000193) ^ c[n - 1 :]
        if n in SIZES:
            inner = np.zeros(len(h), bool)
            for k in range(1, n - 1):
                inner |= edge[k : k + len(h)]
            out.append(((h + np.uint32(n)) * np.uint32(0x9E3779B1))[~inner])
    return np.unique(np.concatenate(out) >> np.uint32(32 - BUCKETS.bit_length() + 1))


def fit_weights(rows: list[np.ndarray], labels: np.ndarray, used: np.ndarray, ratio: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights (ratio x coefficient) of the used features (sorted), and the bias. rows: the used features of each text."""
    y = labels.astype(np.float64)
    n = [max(1, int((labels == k).sum())) for k in (0, 1)]
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    col = np.searchsorted(used, np.concatenate(rows)) if len(row) else np.zeros(0, np.int64)
    value = ratio[col] if len(row) else np.zeros(0)
    # each label weighs the same; Adam, as the features' counts differ widely
    weight = np.where(y == 1, 0.5 / n[1], 0.5 / n[0])
    w, b = np.zeros(len(used)), 0.0
    m, v, mb, vb = np.zeros(len(used)), np.zeros(len(used)), 0.0, 0.0
    for step in range(1, STEPS + 1):
        z = np.bincount(row, value * w[col], minlength=len(rows)) + b
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * weight
        g = np.bincount(col, error[row] * value, minlength=len(used)) + PENALTY * w
        gb = error.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        rate = 0.05 / (1 + 0.01 * step)
        w = w - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        b = b - rate * (mb / (1 - 0.9**step)) / (np.sqrt(vb / (1 - 0.99**step)) + 1e-8)
    return w * ratio, float(b)


def fit(docs: DataFrame, labels: DataFrame, text_col: str = "text", label_col: str = "toxic", id_col: str = "doc_id", per_label: int = TRAIN_PER_LABEL) -> dict:
    """A model from docs and labels (id, 1: toxic or 0: not): of each label about per_label rows, chosen by a hash of the id.

    Rows without a text or label are passed over; of several labels of an id the highest counts. With one label only, or
    none, there are no features and every text scores near 0 or 1. The sample is chosen among the labels, so the ids that
    are sent to the tasks are bounded, and no text is shuffled. Executors make and count the features; the driver fits the
    weights of the used ones.
    """
    spark = docs.sparkSession
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.max(label_col).cast("int").alias("y"))
    sizes = {r[0]: r[1] for r in known.groupBy("y").count().collect()}
    if len(sizes) < 2:
        return {"used": np.zeros(0, np.int64), "weights": np.zeros(0), "bias": 30.0 if 1 in sizes else -30.0}
    share = F.when(F.col("y") == 1, min(1.0, per_label / sizes[1])).otherwise(min(1.0, per_label / sizes[0]))
    chosen = known.where(F.pmod(F.xxhash64(F.col("__id").cast("string")), F.lit(1_000_000)) < share * 1_000_000)
    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("__id"), F.col(text_col).alias("text"))
    sample = stored(texts.join(F.broadcast(chosen), "__id").select("text", "y", F.xxhash64(F.col("__id").cast("string"), "text").alias("k")), "sample")
    n = {r[0]: r[1] for r in sample.groupBy("y").count().collect()}

    def count(batches):
        for batch in batches:
            total = np.zeros((2, BUCKETS), np.int64)
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total[y, features(text)] += 1
            at = np.flatnonzero(total.any(0))
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[0, at]), pa.array(total[1, at])], names=["f", "n0", "n1"])

    common = [F.greatest(F.lit(MIN_TEXTS), F.lit(MIN_SHARE * n.get(k, 0))) for k in (0, 1)]
    counted = sample.select("text", "y").mapInArrow(count, "f bigint, n0 bigint, n1 bigint").groupBy("f").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    counted = counted.where((F.col("n0") >= common[0]) | (F.col("n1") >= common[1])).toPandas().sort_values("f")
    rate = [(counted[f"n{k}"].to_numpy() + SMOOTHING) / (n.get(k, 0) + 2 * SMOOTHING) for k in (0, 1)]
    ratio = np.log(rate[1]) - np.log(rate[0])
    used, ratio = counted["f"].to_numpy()[np.abs(ratio) >= MIN_RATIO], ratio[np.abs(ratio) >= MIN_RATIO]
    shared = spark.sparkContext.broadcast(used)

    def featured(batches):
        for batch in batches:
            made = [np.intersect1d(features(t), shared.value, assume_unique=True).astype("<u4").tobytes() for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary()), batch.column(1), batch.column(2)], names=["f", "y", "k"])

    found = sample.mapInArrow(featured, "f binary, y int, k bigint").toPandas().sort_values("k", kind="stable")
    weights, bias = fit_weights([np.frombuffer(f, "<u4") for f in found["f"]], found["y"].to_numpy(), used, ratio)
    return {"used": used, "weights": weights, "bias": bias}


def score(df: DataFrame, model: dict, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Adds score (0 to 1, higher: label 1 likelier) and predicted (1 if score >= threshold); columns with those names are replaced.

    Null and empty texts have no features and score what the bias says. Texts are read whole. Repeated rows and other
    columns stay; an empty table gives an empty one.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def make():
        model = shared.value
        table = np.zeros(BUCKETS)
        table[model["used"]] = model["weights"]

        def work(texts):
            z = np.array([table[features(t)].sum() for t in texts]) + model["bias"]
            p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
            return p.tolist(), (p >= threshold).astype(int).tolist()

        return work

    return map_column(df, text_col, [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())], make)
