"""op1 and op4 against plain loops: n-grams, weights, decoding over all codewords, scores as sums over features; odd labels."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from factloom.llm import langid, toxicity

MASK = 0xFFFFFFFF


def plain_ngrams(text):
    """Hashed n-grams of letters, runs of anything else as one edge character, by 32-bit arithmetic."""
    chars, kept = text.lower(), []
    for k, c in enumerate(chars):
        if c.isalpha() or k == 0 or chars[k - 1].isalpha():
            kept.append(ord(c) if c.isalpha() else 32)
    if not any(c.isalpha() for c in chars):
        return []
    shift = 33 - langid.BUCKETS.bit_length()
    out = [(c * 0x9E3779B1 & MASK) >> shift for c in kept if c != 32]
    for n in range(2, langid.MAX_N + 1):
        for i in range(len(kept) - n + 1):
            h = kept[i]
            for c in kept[i + 1 : i + n]:
                h = (h * 0x01000193 & MASK) ^ c
            out.append(((h + n) * 0x9E3779B1 & MASK) >> shift)
    return out


LETTERS = {"aa": "abcde", "bb": "cdefg", "cc": "xyzé", "dd": "aexuo"}


def made_text(rng, letters):
    return " ".join("".join(rng.choices(letters, k=rng.randrange(1, 8))) for _ in range(rng.randrange(1, 30))) + rng.choice(["", "!", " 12", "\n"])


def test_op1_by_enumeration(spark):
    rng = random.Random(1)
    rows = [(k, made_text(rng, LETTERS[lang]), lang) for k, lang in enumerate(list(LETTERS) * 30)] + [(999, None, "aa"), (998, "abc", None)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    assert model["languages"] == sorted(LETTERS) and len({tuple(c) for c in model["codes"]}) == 4
    counts = {lang: Counter(g for _, t, x in rows if x == lang and t for g in plain_ngrams(t)) for lang in model["languages"]}
    rate = lambda lang, g: (counts[lang][g] + langid.SMOOTHING) / (sum(counts[lang].values()) + langid.SMOOTHING * langid.BUCKETS)
    texts = [made_text(rng, LETTERS[x]) for x in list(LETTERS) * 5] + ["", "12 3", "É", "ab́c"]
    table = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(99, None)], "doc_id bigint, text string")
    found = {r["doc_id"]: r for r in langid.predict(table, model).collect()}
    for k, text in enumerate(texts):
        grams = plain_ngrams(text)
        if not grams:
            assert (found[k]["lang_pred"], found[k]["score"]) == ("und", 0.0)
            continue
        margins = []
        for bit in model["codes"].T:
            sides = [[lang for lang, b in zip(model["languages"], bit, strict=True) if b == s] for s in (1, -1)]
            weight = lambda g, sides=sides: np.subtract(*[math.log(np.mean([rate(x, g) for x in side])) for side in sides])
            margins.append(sum(map(weight, grams)) / len(grams) * min(len(grams), langid.FULL_EVIDENCE) / langid.MAX_N)
        losses = {lang: sum(math.log1p(math.exp(-b * m)) for b, m in zip(code, margins, strict=True)) for lang, code in zip(model["languages"], model["codes"], strict=True)}
        best = min(losses, key=losses.get)
        assert found[k]["lang_pred"] == best
        assert found[k]["score"] == pytest.approx(math.exp(-losses[best]) / sum(math.exp(-x) for x in losses.values()), rel=1e-3)
        second = sorted(losses.values())[1]
        if abs(second - losses[best] - langid.AMBIGUOUS * len(margins)) > 1e-3:
            assert found[k]["ambiguous"] == (second - losses[best] < langid.AMBIGUOUS * len(margins))
    assert found[99]["lang_pred"] == "und"


def plain_features(text):
    chars, kept = (text or "").lower(), []
    letter = lambda c: "a" <= c <= "z" or ord(c) >= 0xC0
    for k, c in enumerate(chars):
        if letter(c) or k == 0 or letter(chars[k - 1]):
            kept.append(ord(c) if letter(c) else 32)
    kept = [32, *kept, 32] if chars else []
    shift, out = 33 - toxicity.BUCKETS.bit_length(), set()
    for n in toxicity.SIZES:
        for i in range(len(kept) - n + 1):
            gram = kept[i : i + n]
            if 32 not in gram[1:-1]:
                h = gram[0]
                for c in gram[1:]:
                    h = (h * 0x01000193 & MASK) ^ c
                out.add(((h + n) * 0x9E3779B1 & MASK) >> shift)
    return out


def test_op4_scores_are_sums(spark):
    rng = random.Random(2)
    docs = [(k, made_text(rng, "abcdef") + (" vile foul" if k % 3 == 0 else " mild kind")) for k in range(150)] + [(900, None), (901, ""), (902, "ünïcode Vile")]
    labels = [(k, int(k % 3 == 0)) for k in range(120)] + [(0, 0), (1, 0), (1, 0), (900, 1), (77777, 1), (5, None), (6, 7)]  # contradicting, repeated, without a text, unknown
    table = spark.createDataFrame(docs, "doc_id bigint, text string")
    model = toxicity.fit(table, spark.createDataFrame(labels, "doc_id bigint, toxic int"))
    known = {k: max(y for i, y in labels if i == k and y in (0, 1)) for k in {i for i, y in labels if y in (0, 1)}}
    sample = [(plain_features(t), known[k]) for k, t in docs if k in known and t is not None]
    n = [sum(y == s for _, y in sample) for s in (0, 1)]
    have = [Counter(f for fs, y in sample if y == s for f in fs) for s in (0, 1)]
    ratio = {f: math.log((have[1][f] + 1) / (n[1] + 2)) - math.log((have[0][f] + 1) / (n[0] + 2)) for f in {*have[0], *have[1]}}
    enough = [max(toxicity.MIN_TEXTS, toxicity.MIN_SHARE * k) for k in n]
    used = {f for f, r in ratio.items() if abs(r) >= toxicity.MIN_RATIO and (have[0][f] >= enough[0] or have[1][f] >= enough[1])}
    assert set(model["used"].tolist()) == used and len(used) > 5
    weights = dict(zip(model["used"].tolist(), model["weights"].tolist(), strict=True))
    assert np.mean([weights[f] * ratio[f] >= 0 for f in used]) > 0.9  # a feature pulls where its ratio points
    for row in toxicity.score(table, model).collect():
        z = model["bias"] + sum(weights.get(f, 0.0) for f in plain_features(row["text"]))
        assert row["score"] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-9) and row["predicted"] == int(row["score"] >= toxicity.THRESHOLD)
