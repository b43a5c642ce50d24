"""Spans in free text: tokens, sentences and clauses, mentions, references, frames, utterances, time markers.

Spark has no function that returns the places of all matches, so spans are found in Arrow batches; everything after that
(which clause a span is in, what a pronoun refers to, who acts) is joins and windows over span tables.
"""

from __future__ import annotations

import re
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.batches import slices

#: Fixed values.
TOKEN = r"[A-Za-z0-9']+"
PRONOUN = r"(?i)\b(?:he|she|they|him|her|them|his|their|its?)\b"
QUOTE = r"(?<=\")[^\"]+(?=\")"
TIME_MARKERS = r"(?i)\b(?:before|after|then|when|while|until|today|yesterday|tomorrow)\b"
MENTION = r"\b[A-Z][a-z]{3,}\b"
VERB = r"\b[a-z]+(?:ed|ing)\b|\b(?:is|are|was|were|be|has|have|had|said)\b"
LOOKBACK = 2
SPANS = "doc_id bigint, label string, start bigint, end bigint, surface string"


STOP, WORD = re.compile(r"[.!?]|\n"), re.compile(r"[A-Za-z']+\Z")


def as_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def find_all(docs: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """(doc_id, label, start, end, surface) of all matches of labelled patterns, in code points."""
    schema = pa.schema([("doc_id", pa.int64()), ("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("surface", pa.string())])

    def run(batches):
        compiled = [(label, re.compile(p)) for label, p in patterns.items()]
        for batch in slices(batches):
            rows = [(d, label, m.start(), m.end(), m.group()) for d, t in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True) for label, p in compiled for m in p.finditer(t or "")]
            yield as_batch(rows, schema)

    return docs.select("doc_id", "text").mapInArrow(run, SPANS)


def spans_of(text: str, short: frozenset[str] = frozenset()) -> list[tuple[int, int]]:
    """Start and end of each sentence of a text."""
    out, start = [], 0
    for m in STOP.finditer(text):
        if m.start() < start:
            continue
        if m.group() != "\n" and short and (w := WORD.search(text, start, m.start())) and w.group().lower() in short:
            continue
        end = m.start() if m.group() == "\n" else m.end()
        if end > start:
            out.append((start, end))
        start = m.end()
        while start < len(text) and text[start].isspace():
            start += 1
    return [*out, (start, len(text))] if start < len(text) else out


def sentences(docs: DataFrame, abbreviations: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, sentence, start, end): up to a full stop, question or exclamation mark, or to the line's end; no stop ends one after an abbreviation."""
    short = frozenset(a.lower() for a in abbreviations)
    schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "sentence", "start", "end")])

    def run(batches):
        for batch in slices(batches):
            rows = [(d, k, a, b) for d, t in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True) for k, (a, b) in enumerate(spans_of(t or "", short))]
            yield as_batch(rows, schema)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, sentence bigint, start bigint, end bigint")


def in_sentences(docs: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """find_all's matches that begin in a sentence, with its number, start and end: in_spans(find_all(docs), sentences(docs), "start"). A text has all that
    it takes, so both are found where it is read, and nothing is shuffled to put them together."""
    whole = ("sentence", "span_start", "span_end")
    schema = pa.schema([("doc_id", pa.int64()), ("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("surface", pa.string()), *[(c, pa.int64()) for c in whole]])

    def run(batches):
        compiled = [(label, re.compile(p)) for label, p in patterns.items()]
        for batch in slices(batches):
            rows = []
            for d, t in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                spans = spans_of(t or "")
                starts = [a for a, _ in spans]
                for label, p in compiled:
                    for m in p.finditer(t or ""):
                        k = bisect_right(starts, m.start()) - 1
                        if k >= 0 and m.start() < spans[k][1]:
                            rows.append((d, label, m.start(), m.end(), m.group(), k, *spans[k]))
            yield as_batch(rows, schema)

    return docs.select("doc_id", "text").mapInArrow(run, SPANS + "".join(f", {c} bigint" for c in whole))


def clauses(docs: DataFrame, sentence_spans: DataFrame) -> DataFrame:
    """(doc_id, sentence, clause, start, end): sentences cut after semicolons, colons and dashes, and before and, but, yet."""
    cuts = find_all(docs, {"after": "[;:—–]", "before": " and | but | yet "})
    cuts = cuts.select("doc_id", F.when(F.col("label") == "after", F.col("end")).otherwise(F.col("start")).alias("at"))
    inside = in_spans(cuts, sentence_spans, "at").select("doc_id", "sentence", "at", F.col("span_end").alias("end"))
    starts = sentence_spans.select("doc_id", "sentence", F.col("start").alias("at"), "end").union(inside).distinct()
    w = Window.partitionBy("doc_id", "sentence").orderBy("at")
    return starts.select("doc_id", "sentence", (F.row_number().over(w) - 1).cast("bigint").alias("clause"), F.col("at").alias("start"), F.coalesce(F.lead("at").over(w), "end").alias("end")).where("end > start")


def in_spans(points: DataFrame, spans: DataFrame, at: str) -> DataFrame:
    """points with the span of the same document that each lies in: the last that starts at or before it, if it reaches it.

    Spans of a document don't overlap, so one window over both finds them without an interval join.
    """
    columns = [c for c in spans.columns if c not in ("doc_id", "start", "end")]
    left = points.select("doc_id", F.col(at).alias("__at"), F.lit(1).alias("__kind"), F.struct(*points.columns).alias("p"), F.lit(None).cast(spans.select(F.struct(*spans.columns)).schema[0].dataType).alias("s"))
    right = spans.select("doc_id", F.col("start").alias("__at"), F.lit(0).alias("__kind"), F.lit(None).cast(left.schema["p"].dataType).alias("p"), F.struct(*spans.columns).alias("s"))
    w = Window.partitionBy("doc_id").orderBy("__at", "__kind").rowsBetween(Window.unboundedPreceding, 0)
    found = left.union(right).withColumn("s", F.last("s", ignorenulls=True).over(w)).where("p is not null and __at < s.end")
    return found.select("p.*", *[F.col(f"s.{c}").alias(c) for c in columns], F.col("s.start").alias("span_start"), F.col("s.end").alias("span_end"))


def references(pronouns: DataFrame, mentions: DataFrame, lookback: int = LOOKBACK) -> DataFrame:
    """Each pronoun (doc_id, start, surface, sentence) with a mention of its own or the `lookback` sentences before: of the nearest
    sentence the last one; without any, unknown_N in the order of the text."""
    near = mentions.groupBy("doc_id", "sentence").agg(F.max_by("surface", "start").alias("mention"))
    reach = near.select("doc_id", "mention", F.col("sentence").alias("of"), F.explode(F.sequence(F.lit(0), F.lit(lookback))).alias("distance"))
    reach = reach.select("doc_id", (F.col("of") + F.col("distance")).alias("sentence"), "distance", "mention")
    best = reach.groupBy("doc_id", "sentence").agg(F.min_by("mention", "distance").alias("mention"))
    joined = pronouns.join(best.hint("merge"), ["doc_id", "sentence"], "left")  # as many rows as mentions, which the size of a file of texts says nothing of
    w = Window.partitionBy("doc_id").orderBy("start").rowsBetween(Window.unboundedPreceding, 0)
    number = F.count(F.when(F.col("mention").isNull(), 1)).over(w)
    return joined.select("doc_id", "start", "surface", F.coalesce("mention", F.concat(F.lit("unknown_"), number.cast("string"))).alias("refers_to"))


def frames(verbs: DataFrame, mentions: DataFrame) -> DataFrame:
    """For each verb (doc_id, sentence, clause, start, surface): the last mention before it in its clause, and the first after it."""
    key = ["doc_id", "sentence", "clause"]
    rows = verbs.select(*key, "start", F.lit("v").alias("kind"), "surface").union(mentions.select(*key, "start", F.lit("m").alias("kind"), "surface"))
    mention = F.when(F.col("kind") == "m", F.col("surface"))
    order = Window.partitionBy(*key).orderBy("start", "kind")
    actor = F.last(mention, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    target = F.first(mention, ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing))
    return rows.select(*key, "start", "kind", F.col("surface").alias("verb"), actor.alias("actor"), target.alias("object")).where("kind = 'v'").drop("kind")


def utterances(docs: DataFrame) -> DataFrame:
    """Quoted texts, whether each asks, and the last mention in the 120 characters before it."""
    found = find_all(docs, {"quote": QUOTE})
    before = docs.select("doc_id", "text").join(found, "doc_id").withColumn("window", F.substring("text", F.greatest(F.col("start") - 120, F.lit(1)).cast("int"), F.least(F.col("start"), F.lit(120)).cast("int")))
    speaker = F.try_element_at(F.regexp_extract_all("window", F.lit("(?U)" + MENTION), 0), F.lit(-1))
    return before.select("doc_id", "start", "end", F.trim("surface").alias("quote"), F.coalesce(speaker, F.lit("unknown")).alias("speaker"), F.trim("surface").endswith("?").alias("asks"))


#: Gender and number of pronouns (others are neuter, singular), and names of characters with theirs.
PRONOUN_KINDS = {"he": ("M", "S"), "him": ("M", "S"), "his": ("M", "S"), "she": ("F", "S"), "her": ("F", "S"), "they": ("P", "P"), "them": ("P", "P"), "their": ("P", "P"), "it": ("N", "S"), "its": ("N", "S")}
CHARACTERS = {
    "Jesus": (r"\bJesus\b", "M", "S"),
    "John": (r"\bJohn\b", "M", "S"),
    "disciples": (r"\bdisciples\b", "P", "P"),
    "woman_of_Samaria": (r"\bwoman of Samaria\b|\bSamaritan woman\b", "F", "S"),
}


def character_mentions(docs: DataFrame, characters: dict[str, tuple[str, str, str]] = CHARACTERS, find=find_all) -> DataFrame:
    """find_all's spans of characters (or those of in_sentences), with gender and number."""
    found = find(docs, {label: pattern for label, (pattern, _, _) in characters.items()})
    kinds = F.create_map(*[x for label, (_, gender, number) in characters.items() for x in (F.lit(label), F.struct(F.lit(gender).alias("gender"), F.lit(number).alias("number")))])
    return found.withColumn("kind", kinds[F.col("label")]).select(*found.columns, "kind.gender", "kind.number")


def characters(mentions: DataFrame) -> DataFrame:
    """(doc_id, char_id, label, n_mentions, first_start, position): who is named in a text, in order of the first mention."""
    found = mentions.groupBy("doc_id", "label").agg(F.count("*").alias("n_mentions"), F.min("start").alias("first_start"))
    order = Window.partitionBy("doc_id").orderBy("first_start", "label")
    return found.select("doc_id", F.concat(F.lit("char_"), F.lower("label")).alias("char_id"), "label", "n_mentions", "first_start", (F.row_number().over(order) - 1).cast("bigint").alias("position"))


def agreeing_references(pronouns: DataFrame, mentions: DataFrame, lookback: int = LOOKBACK) -> DataFrame:
    """Each pronoun (doc_id, start, surface, sentence) with a mention (doc_id, start, label, gender, number, sentence) that agrees with it, of its own
    or the `lookback` sentences before: of the nearest sentence the last one. He and she want their gender, they a plural, it takes any; a mention of
    unknown gender or number agrees with all. Without any: unknown_G_N, counted for each gender in the order of the text.

    A mention stands under each kind of pronoun that it agrees with, in each sentence that it reaches; so a pronoun looks up one row.
    """
    kinds = F.create_map(*[x for p, (gender, number) in PRONOUN_KINDS.items() for x in (F.lit(p), F.struct(F.lit(gender).alias("gender"), F.lit(number).alias("number")))])
    gender_fits = lambda g: F.col("gender").isNull() | (F.col("gender") == g)
    fits = {"M": gender_fits("M"), "F": gender_fits("F"), "P": F.col("number").isNull() | (F.col("number") == "P"), "N": F.lit(True)}
    agreeing = F.explode(F.array_compact(F.array(*[F.when(c, k) for k, c in fits.items()])))
    last = mentions.select("doc_id", "sentence", "start", "label", agreeing.alias("kind")).groupBy("doc_id", "sentence", "kind").agg(F.max_by("label", F.struct("start", "label")).alias("label"))
    reach = last.select("doc_id", "kind", "label", "sentence", F.explode(F.sequence(F.lit(0), F.lit(lookback))).alias("distance"))
    best = reach.groupBy("doc_id", (F.col("sentence") + F.col("distance")).alias("sentence"), "kind").agg(F.min_by("label", "distance").alias("label"))
    asked = pronouns.select("doc_id", "start", "surface", "sentence").withColumn("kind", F.coalesce(kinds[F.lower("surface")]["gender"], F.lit("N")))
    joined = asked.join(best.hint("merge"), ["doc_id", "sentence", "kind"], "left")  # see references()
    scan = Window.partitionBy("doc_id", "kind").orderBy("start").rowsBetween(Window.unboundedPreceding, 0)
    unknown = F.concat(F.lit("unknown_"), "kind", F.lit("_"), F.count(F.when(F.col("label").isNull(), 1)).over(scan).cast("string"))
    position = (F.row_number().over(Window.partitionBy("doc_id").orderBy("start")) - 1).cast("bigint")
    return joined.select("doc_id", position.alias("position"), "start", "surface", F.coalesce("label", unknown).alias("refers_to"), F.when(F.col("label").isNull(), "lookback_limit").otherwise("recency").alias("rule"))
