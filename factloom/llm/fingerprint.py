"""Document fingerprints: threshold-scaled sketches of word shingles, without Python functions.

A shingle is SHINGLE words in a row. Its hash is the first 16 hexadecimal digits of the MD5 of its words, joined by spaces, and is
retained if its first digit is below LIMIT, which keeps an eighth of all shingles. The fraction is fixed and not a number of hashes,
so sketches of very unequal documents can be compared: the share of one's hashes that the other has estimates how much of it
the other contains, and the union of two sketches is the sketch of both documents together.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHINGLE = 5
#: Retained hashes are those whose first hexadecimal digit is below this.
LIMIT = "2"
DIGITS = 16
#: Rows of a bucket of neighbouring ids, and how many buckets there are at most: the only bound that the driver holds.
BUCKET_ROWS, MAX_BUCKETS = 512, 1 << 16


def sketch(text: Column) -> Column:
    """The retained hashes of a text, sorted: array<string>. Words are [^\\x20\\x09-\\x0D]+ with A-Z in lower case.

    A text of fewer than SHINGLE words is one shingle. If none of a text's hashes is retained, the hash of all its words stands
    for it, its first digit set to 0. Without words, or for null, the sketch is empty."""
    low = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    words = F.filter(F.split(low, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")

    def of(words: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(words) - SHINGLE, F.lit(0)))
        hashes = F.transform(starts, lambda i: F.left(F.md5(F.concat_ws(" ", *[F.get(words, i + k) for k in range(SHINGLE)])), F.lit(DIGITS)))
        kept = F.array_sort(F.array_distinct(F.filter(hashes, lambda h: h < LIMIT)))
        whole = F.concat(F.lit("0"), F.substring(F.md5(F.array_join(words, " ")), 2, DIGITS - 1))
        return F.when(F.size(words) == 0, F.array().cast("array<string>")).otherwise(bound(kept, lambda k: F.when(F.size(k) > 0, k).otherwise(F.array(whole))))

    return bound(words, of)


def bound(value: Column, use) -> Column:
    """use(value) with value computed once for each row, though use names it often."""
    return F.transform(F.array(value), use)[0]


def merged(sketches: Column) -> Column:
    """An aggregate: the sketch of all documents of a group, as if they were one (but for shingles across their borders).

    For groups of bounded size; it holds the group's hashes."""
    return F.array_sort(F.array_distinct(F.flatten(F.collect_list(sketches))))


def likeness(a: Column, b: Column) -> Column:
    """The estimated share of common shingles among all of both: 0 to 1; two empty sketches are alike."""
    common = F.size(F.array_intersect(a, b)).cast("double")
    both = F.size(a) + F.size(b)
    return F.when(both == 0, 1.0).otherwise(common / F.greatest(both - common, F.lit(1.0)))


def contained(a: Column, b: Column) -> Column:
    """The estimated share of a's shingles that b has: 0 to 1; an empty sketch is contained in all."""
    return F.when(F.size(a) == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)).cast("double") / F.greatest(F.size(a), F.lit(1)))


def beside_next(docs: DataFrame) -> DataFrame:
    """doc_id, text and the sketch of each document, and the next one's text and sketch, by descending doc_id; after the last comes the first.

    A null text is empty. Null ids come last; equal ids are put in order by text, and equal rows follow each other. An only document
    is its own next one; an empty table stays empty. Other columns are left out, whatever their names.

    Ids are cut at quantiles into buckets of about BUCKET_ROWS rows, so nothing is sorted in one task; a bucket also gets a copy of
    the rows that the next one begins with, which are those with the quantile itself as id. So texts are shuffled once. A bucket
    holds all rows of one id: ids are meant to be distinct or nearly so.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = docs.count()
    n = min(MAX_BUCKETS, max(1, rows // BUCKET_ROWS))
    at = docs.agg(F.percentile_approx("doc_id", [(k + 1) / n for k in range(n)], max(10_000, 20 * n)), F.max("doc_id")).first()
    cuts = sorted({*(at[0] or []), *([] if at[1] is None else [at[1]])})
    bucket, top = bucket_of(F.col("doc_id"), cuts), F.col("doc_id") == F.get(array_of(cuts, "bigint"), F.col("own"))
    places = F.when(top, F.array(F.struct(F.col("own").alias("bucket"), F.lit(False).alias("guest")), F.struct(F.pmod(F.col("own") + 1, F.lit(max(1, len(cuts)))).alias("bucket"), F.lit(True).alias("guest")))).otherwise(F.array(F.struct(F.col("own").alias("bucket"), F.lit(False).alias("guest"))))
    dealt = docs.withColumn("own", bucket).select("doc_id", "text", F.explode(places).alias("place")).select("doc_id", "text", "place.*").repartition("bucket")
    order = Window.partitionBy("bucket").orderBy("guest", F.col("doc_id").desc_nulls_last(), "text")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    row = dealt.select("doc_id", "text", "bucket", "guest", sketch(F.col("text")).alias("sketch"))
    following = {c: F.coalesce(F.lead(c).over(order), F.first(c).over(whole)) for c in ("text", "sketch")}
    return row.select("doc_id", "text", "sketch", "guest", *[v.alias(f"next_{c}") for c, v in following.items()]).where(~F.col("guest")).drop("guest")


def array_of(values: list, kind: str) -> Column:
    return F.from_json(F.lit(str(values)), f"array<{kind}>")


def bucket_of(value: Column, cuts: list[int]) -> Column:
    """How many cuts are below the value, found in two steps; 0 for null."""
    step = max(1, math.isqrt(len(cuts)))
    blocks = [cuts[k : k + step] for k in range(0, len(cuts), step)]
    coarse = F.size(F.filter(array_of([b[-1] for b in blocks], "bigint"), lambda c: c < value))
    fine = bound(coarse, lambda k: k * step + F.coalesce(F.size(F.filter(F.get(array_of(blocks, "array<bigint>"), k), lambda c: c < value)), F.lit(0)))
    return F.when(value.isNull() | F.lit(not cuts), 0).otherwise(fine)


def with_edits(docs: DataFrame) -> DataFrame:
    """beside_next's columns, n_chars, the edited text and its sketch. In the edited text the last floor(n_chars / 3) code points
    are replaced by the first as many of the next document, or by all of it."""
    third = F.floor(F.col("n_chars") / 3).cast("int")
    made = beside_next(docs).withColumn("n_chars", F.length("text").cast("bigint"))
    edited = F.concat(F.left("text", (F.col("n_chars") - third).cast("int")), F.left("next_text", third))
    return made.withColumn("edited", edited).withColumn("edited_sketch", sketch(F.col("edited")))


def digests(edits: DataFrame) -> DataFrame:
    own, edited, following = F.col("sketch"), F.col("edited_sketch"), F.col("next_sketch")
    return edits.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), F.array_join(own, "").alias("fingerprint"), F.array_join(edited, "").alias("edited_fingerprint"),
        likeness(own, edited).alias("near_edited"), likeness(own, following).alias("near_next"), contained(own, edited).alias("in_edited"), contained(own, following).alias("in_next"),
    )
