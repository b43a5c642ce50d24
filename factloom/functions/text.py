"""Text functions: normalisation, tokens, identities."""

from __future__ import annotations

import unicodedata
from functools import cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from factloom.functions.batches import slices


@F.pandas_udf(StringType())
def nfc(texts: pd.Series) -> pd.Series:
    """Unicode composition, which Spark has no function for; most texts are composed and pass unchanged."""
    return texts.map(lambda t: t if t is None or t.isascii() or unicodedata.is_normalized("NFC", t) else unicodedata.normalize("NFC", t))


@cache
def unsettled() -> str:
    """A pattern of the characters without which a text is composed: marks, what composition replaces, and what it joins to the character before. Those that
    the JVM doesn't know count as marks."""
    found = set(range(0x1161, 0x1176)) | set(range(0x11A8, 0x11C3))  # vowels and finals of Hangul
    for code in range(0x300, 0x2FA20):
        parts = unicodedata.decomposition(chr(code)).split()
        if unicodedata.normalize("NFC", chr(code)) != chr(code):
            found.add(code)
        elif len(parts) == 2 and not parts[0].startswith("<"):
            found.add(int(parts[1], 16))
    rest = sorted(c for c in found if unicodedata.category(chr(c))[0] != "M")
    runs: list[list[int]] = []
    for c in rest:
        if runs and c == runs[-1][1] + 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return r"[\x{300}-\x{10FFFF}&&[\p{M}\p{Cn}%s]]" % "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in runs)


def composed(rows: DataFrame, column: str) -> DataFrame:
    """rows with a text column composed. Rows whose text has nothing to compose, as most are, stay on the JVM; the texts of others are composed in pieces of
    a batch, so that a Python worker doesn't hold all of it as strings."""
    other = F.coalesce(F.col(column).rlike(r"[^\x00-\x{2FF}]") & F.col(column).rlike(unsettled()), F.lit(False))
    place = rows.columns.index(column)

    def run(batches):
        for batch in slices(batches, column):
            texts = [t if t is None else unicodedata.normalize("NFC", t) for t in batch.column(place).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if k == place else c for k, c in enumerate(batch.columns)], schema=batch.schema)

    return rows.where(~other).unionByName(rows.where(other).mapInArrow(run, rows.schema))


def lf(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


def normalized(text: Column) -> Column:
    """NFC, line feeds only."""
    return lf(nfc(text))


def proposition(text: Column) -> Column:
    """Trimmed, white space collapsed, lower case."""
    return F.lower(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")))


def paragraphs(text: Column) -> Column:
    """Straight quotes, paragraphs split at blank lines, white space collapsed within them, joined by an empty line."""
    straight = F.translate(text, "‘’“”", "''\"\"")
    parts = F.transform(F.split(straight, r"\n\s*\n"), lambda p: F.trim(F.regexp_replace(p, r"\s+", " ")))
    return F.array_join(F.filter(parts, lambda p: p != ""), "\n\n")


def api_text(text: Column) -> Column:
    """Form feeds to line feeds, runs of blanks to one, at most two line feeds in a row, trimmed."""
    text = F.regexp_replace(F.regexp_replace(lf(text), "\f", "\n"), "[ \t]+", " ")
    return F.regexp_replace(F.regexp_replace(text, "\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def query_tokens(query: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(query), F.lit("[a-z0-9]+"), 0)))


def query_terms(query: Column) -> Column:
    return F.filter(F.split(F.lower(query), r"\s+"), lambda t: t != "")


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def truncated(text: Column, size: int = 120) -> Column:
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit("..."))).otherwise(text)


def identity(prefix: str, *parts: Column) -> Column:
    """prefix:sha256 of the parts joined by bars."""
    return F.concat(F.lit(prefix + ":"), F.sha2(F.concat_ws("|", *[F.coalesce(p, F.lit("")) for p in parts]), 256))


def rendered(template: str, values: dict[str, Column]) -> Column:
    """A template with {key} places; an unknown or null value shows as {missing:key}."""
    out: list[Column] = []
    rest = template
    while "{" in rest:
        before, _, rest = rest.partition("{")
        key, _, rest = rest.partition("}")
        out += [F.lit(before), F.coalesce(values[key].cast("string"), F.lit(f"{{missing:{key}}}")) if key in values else F.lit(f"{{missing:{key}}}")]
    return F.concat(*out, F.lit(rest))
