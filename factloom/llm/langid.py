"""Language identification with error-correcting output codes.

Each language has a codeword. For each bit a binary classifier over hashed letter n-grams is fitted: which of two sets of
languages does a text belong to? A text's n-grams give each bit a margin; the loss of a codeword is the sum of the
logistic losses of its bits against the margins, and the codeword with the least loss is chosen. Where the runner-up is
near, the prediction is flagged as ambiguous.
"""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm.common import map_column

#: n-grams of 1 to MAX_N letters (with word edges) are hashed to BUCKETS numbers.
MAX_N, BUCKETS = 3, 1 << 15
#: Labelled documents that training reads at most, about, for each language.
TRAIN_PER_LANGUAGE = 5000
SMOOTHING = 0.5
#: The margin of a text with evidence worth this many n-grams counts in full; longer texts count as no more.
FULL_EVIDENCE = 60
#: A difference of losses below this, for each bit, is ambiguous.
AMBIGUOUS = 0.25
UNDETERMINED = "und"


def codewords(n: int) -> np.ndarray:
    """n codewords of +1 and -1, a row each. Up to six languages: every split in two sets; more: seeded random splits, far apart."""
    if n <= 1:
        return np.zeros((n, 0), np.int8)
    if n <= 6:
        bits = [b for b in itertools.product((1, -1), repeat=n - 1) if -1 in b]
        return np.array([(1, *b) for b in bits], np.int8).T
    draw = np.random.default_rng(n)
    length = max(15, int(10 * np.log2(n)))
    best, far = None, -1
    for _ in range(50):
        rows = draw.choice(np.array([1, -1], np.int8), (n, length))
        apart = min(np.count_nonzero(rows[i] != rows[j]) for i in range(n) for j in range(i))
        both = (np.abs(rows.sum(0)) < n).all()  # each bit must split the languages
        if both and apart > far:
            best, far = rows, apart
    return best


def ngrams(text: str) -> np.ndarray:
    """Hashed n-grams of a text's letters; what lies between words is one edge character."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    letter = LETTER.take(codes)
    if not letter.any():
        return np.zeros(0, np.uint32)
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first character after a word stands for the gap
    keep[:1] = True
    c = np.where(letter, codes, 32)[keep].astype(np.uint32)
    out = [c[c != 32] * np.uint32(0x9E3779B1)]
    h = c
    for n in range(2, MAX_N + 1):
        h = h[:-1] * np.uint32(0x01000193) ^ c[n - 1 :]
        out.append((h + np.uint32(n)) * np.uint32(0x9E3779B1))
    return np.concatenate(out) >> np.uint32(32 - BUCKETS.bit_length() + 1)


def _letters() -> np.ndarray:
    return np.fromiter(map(str.isalpha, map(chr, range(0x110000))), bool, 0x110000)


LETTER = _letters()


def count_ngrams(train: DataFrame, text_col: str, lang_col: str) -> dict[str, np.ndarray]:
    """Counts of hashed n-grams for each language, summed on the executors; the driver gets languages x BUCKETS numbers."""
    schema = "lang string, bucket int, n bigint"

    def count(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                into = total.setdefault(lang, np.zeros(BUCKETS, np.int64))
                into += np.bincount(ngrams(text), minlength=BUCKETS)
        import pyarrow as pa

        for lang, n in total.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(at), pa.string()), "bucket": pa.array(at, pa.int32()), "n": pa.array(n[at], pa.int64())})

    rows = train.select(text_col, lang_col).mapInArrow(count, schema).groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    counts = {}
    for lang, own in rows.groupby("lang"):
        counts[lang] = np.zeros(BUCKETS)
        counts[lang][own["bucket"]] = own["n"]
    return counts


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", per_language: int = TRAIN_PER_LANGUAGE) -> dict:
    """A model from labelled texts: of each language about per_language documents, chosen by a hash of the id.

    Rows without a text or language are passed over. Without any labelled row the model knows no language.
    """
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = {r[0]: r[1] for r in rows.groupBy(lang_col).count().collect()}
    if not sizes:
        return {"languages": [], "codes": codewords(0), "weights": np.zeros((BUCKETS, 0), np.float32)}
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, per_language / n))])
    draw = F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(1_000_000)) < share[F.col(lang_col)] * 1_000_000
    counts = count_ngrams(rows.where(draw), text_col, lang_col)
    languages = sorted(counts)
    codes = codewords(len(languages))
    rates = np.array([(counts[x] + SMOOTHING) / (counts[x].sum() + SMOOTHING * BUCKETS) for x in languages]).reshape(len(languages), BUCKETS)
    weights = np.stack([np.log(rates[bit > 0].mean(0)) - np.log(rates[bit < 0].mean(0)) for bit in codes.T], 1) if codes.shape[1] else np.zeros((BUCKETS, 0))
    return {"languages": languages, "codes": codes, "weights": weights.astype(np.float32)}


def decode(model: dict, margins: np.ndarray) -> tuple[str, float, bool]:
    """Language, share of its likelihood among all, and whether the runner-up is near, from the margins of the bits."""
    codes, languages = model["codes"], model["languages"]
    losses = np.logaddexp(0, -codes * margins).sum(1)  # loss-weighted decoding: a bit counts as its margin is sure
    order = np.argsort(losses, kind="stable")
    p = np.exp(losses[order[0]] - losses)
    near = len(order) > 1 and losses[order[1]] - losses[order[0]] < AMBIGUOUS * codes.shape[1]
    return languages[order[0]], float(1 / p.sum()), bool(near)


def predict(df: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """Adds lang_pred, score (0 to 1) and ambiguous; columns of df with those names are replaced.

    A null text, a text without a letter, and any text where the model knows no language, is `und` with score 0 and
    ambiguous. Texts are read whole. Repeated rows and other columns stay; an empty table gives an empty one.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def make():
        model = shared.value
        weights = model["weights"]

        def one(text):
            if not text or not model["languages"]:
                return UNDETERMINED, 0.0, True
            grams = ngrams(text)
            if not len(grams):
                return UNDETERMINED, 0.0, True
            total = np.zeros(weights.shape[1], np.float64)
            for at in range(0, len(grams), 1 << 20):
                total += weights.take(grams[at : at + (1 << 20)], 0).sum(0, dtype=np.float64)
            return decode(model, total / max(len(grams), 1) * min(len(grams), FULL_EVIDENCE) / MAX_N)

        return lambda texts: list(zip(*map(one, texts), strict=True))

    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType())]
    return map_column(df, text_col, fields, make)
