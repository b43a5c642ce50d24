"""Quality rules as a ledger: each rule is evaluated once and leaves a bit; policies and ablations are bit arithmetic.

measure() adds what rules look at, ledger() adds the bit mask `failed` of the rules that a text fails, judge() applies a
policy (a named, versioned mask of the rules that reject), ablations() counts what each rule of a policy does alone, from
a histogram of masks. Another policy or an ablation never looks at a text again.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from operator import eq

import numpy as np
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm.common import map_column

WORD = re.compile(r"[^\x20\t-\r]+")
SYMBOLS = "#*$%&|<>"
#: Thai, Lao, Myanmar, Khmer, Japanese and Chinese are written without spaces, so their words' lengths say nothing.
UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
#: A word of letters and of marks that belong to them, as vowels of Indic scripts and the joiners between them.
LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}\u200c\u200d]*")
WINDOW = 5
MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_letter_words", "n_adjacent", "n_unspaced"]


@dataclass(frozen=True)
class Rule:
    """A rule's place in the mask is its bit; fails is an SQL condition over the measurements."""

    name: str
    bit: int
    fails: str


#: The rules; a bit is never given to another rule, so that stored masks keep their meaning.
RULES = [
    Rule("few_words", 0, "n_words < 10"),
    Rule("repeated_windows", 1, "100 * n_repeat_words > 20 * n_words"),
    Rule("symbols", 2, "10 * n_symbols > n_words"),
    Rule("short_words", 3, "word_chars < 2 * n_words"),
    Rule("long_words", 4, "word_chars - n_unspaced > 15 * n_words"),
    Rule("repeated_lines", 5, "n_lines > 3 and 2 * n_dup_lines > n_lines"),
    Rule("few_letters", 6, "10 * n_letter_words < 4 * n_words"),
    Rule("echoed_words", 7, "10 * n_adjacent > 3 * n_words"),
]
#: Versioned policies: the rules that reject.
POLICIES = {
    "base": ["few_words", "repeated_windows"],
    "v1": ["few_words", "repeated_windows", "symbols", "short_words", "long_words", "repeated_lines", "few_letters", "echoed_words"],
}


def mask_of(names: list[str], rules: list[Rule] = RULES) -> int:
    bits = {r.name: 1 << r.bit for r in rules}
    return sum(bits[n] for n in set(names))


def repeated_cover(words: list[str], window: int = WINDOW) -> int:
    """Words in runs of `window` words that occur twice or more, first occurrences included. Names for runs are exact, not hashes."""
    if len(words) <= window:
        return 0
    seen: dict[str, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    if len(seen) == len(words):
        return 0
    names, length = ids, 1
    while length < window:
        step = min(length, window - length)  # names of runs of length + step words, from two that overlap
        _, names = np.unique(names[:-step] * (names.max() + 1) + names[step:], return_inverse=True)
        length += step
        if names.max() + 1 == len(names):
            return 0
    often = np.bincount(names)[names] > 1
    edges = np.zeros(len(words) + 1, np.int64)
    starts = np.flatnonzero(often)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + window, -1)
    return int(np.count_nonzero(np.cumsum(edges)[:-1]))


def letter_words(words: list[str]) -> int:
    """Words that are letters and marks only, but for punctuation around them; and all that have a letter of a script without spaces."""
    bare = list(map(str.strip, words, [".,;:!?\"'()"] * len(words)))
    return sum(b.isalpha() or not b.isascii() and (LETTERS.fullmatch(b) is not None or UNSPACED.search(b) is not None) for b in bare)


def measures_of(text: str | None) -> tuple[int, ...]:
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (
        len(words),
        sum(map(len, words)),
        sum(map(text.count, SYMBOLS)),
        len(lines),
        len(lines) - len(set(lines)),
        repeated_cover(words),
        letter_words(words),
        sum(map(eq, words, words[1:])),
        0 if text.isascii() else len(UNSPACED.findall(text)),
    )


def measure(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds the measurements of each text as bigint columns (columns with their names are replaced). Null counts as an empty text."""
    return map_column(df, text_col, [T.StructField(m, T.LongType()) for m in MEASURES], lambda: lambda texts: list(zip(*map(measures_of, texts), strict=True)))


def ledger(df: DataFrame, text_col: str = "text", rules: list[Rule] = RULES) -> DataFrame:
    """measure() and the bigint mask `failed`: bit r.bit is set where rule r fails.

    Null and empty texts have no words and fail few_words only. Long texts are measured whole. Repeated rows stay, as
    does any other column; an empty table gives an empty ledger.
    """
    failed: Column = F.lit(0).cast("bigint")
    for r in rules:
        failed = failed.bitwiseOR(F.when(F.expr(r.fails), F.lit(1 << r.bit)).otherwise(0).cast("bigint"))
    return measure(df, text_col).withColumn("failed", failed)


def passes(policy: str) -> Column:
    return F.col("failed").bitwiseAND(F.lit(mask_of(POLICIES[policy])).cast("bigint")) == 0


def judge(ledgered: DataFrame, policy: str = "v1") -> DataFrame:
    """Adds base_failed and kept: false if base_failed, else whether the policy passes the text."""
    return ledgered.withColumn("base_failed", ~passes("base")).withColumn("kept", passes("base") & passes(policy))


def ablations(ledgered: DataFrame, policy: str = "v1", rules: list[Rule] = RULES) -> DataFrame:
    """One row for each rule of a policy: texts that it fails, that only it rejects, and that stay without it.

    Masks are counted first, so at most 2^rules rows are looked at again; and bit_or and bit_and over the rejected
    masks tell which rules rejected anything and which rejected everything.
    """
    mask = mask_of(POLICIES[policy], rules)
    masks = ledgered.groupBy(F.col("failed").bitwiseAND(F.lit(mask).cast("bigint")).alias("failed")).agg(F.count("*").alias("n"))
    chosen = [r for r in rules if mask >> r.bit & 1]
    rows = F.explode(F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("bigint").alias("bit")) for r in chosen])).alias("r")
    each = masks.select("failed", "n", rows).select("failed", "n", "r.*")
    hit = F.col("failed").bitwiseAND(F.col("bit")) != 0
    alone = F.col("failed") == F.col("bit")
    rejected = F.when(F.col("failed") != 0, F.col("failed"))
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("bigint")
    return each.groupBy("rule").agg(
        total(hit).alias("n_failed"),
        total(alone).alias("n_only"),
        total((F.col("failed") == 0) | alone).alias("n_kept_without"),
        F.coalesce(F.bit_or(rejected), F.lit(0)).cast("bigint").alias("any_rejecting"),
        F.coalesce(F.bit_and(rejected), F.lit(0)).cast("bigint").alias("all_rejecting"),
    )
