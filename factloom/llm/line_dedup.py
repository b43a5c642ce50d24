"""Line dedup by a log-template tree of fixed depth.

Tokens with a digit, addresses and links are variable fields. A line goes down the tree by its number of tokens and its
leading tokens to a leaf. The rest of the line is cut into FIELDS fields of about the same number of tokens. Lines of a leaf
that differ in one field only are merged: their template has that field as a variable one. Lines that differ in none
have the template without a variable field. A template with a variable field has at least MIN_CONSTANT other tokens, so two
thirds of a line, or nearly, stand in its template. Templates that recur across documents are dropped; the first document
that has a template keeps its line.

A copied document has nothing but recurring lines, which says nothing about its lines: near copies, as told by the signatures
of near_dedup, count as one text. Whole lines of LONG tokens or more recur from two such texts on, other templates from three.

Nothing of a leaf is gathered: each line names its template for each choice of the variable field, and names are counted.
A name has 64 bits; among 10^12 lines about one in a million has another line's name by chance.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm.common import free_name, release, slices, stored
from factloom.llm.near_dedup import estimated_classes

#: Leading tokens on the way to a leaf, fields of the rest of a line, and tokens besides the variable field.
DEPTH, FIELDS, MIN_CONSTANT = 1, 3, 3
#: Texts in which a template must occur to recur, near copies counted once; and whole lines of LONG tokens or more: defaults of parameters.
MIN_TEXTS, MIN_TEXTS_LONG, LONG = 3, 2, 16
VARIABLE = re.compile(r"[0-9@]|://")
WILD = "<*>"
#: What makes a line not blank, for Python and for Spark.
NOT_BLANK = "[^ \\t\\r\\f\\x0B]"
BLACK = re.compile(NOT_BLANK)
#: The factors of the parts of a template's name: leaf, fields.
FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def generalised(line: str) -> list[str]:
    tokens = line.split()
    return [WILD if VARIABLE.search(t) else t for t in tokens] if VARIABLE.search(line) else tokens


def parts_of(line: str) -> tuple[int, list[int], list[int]]:
    """A line's number of tokens, the hashes of its leaf and of its fields, and the fields' numbers of tokens."""
    tokens = generalised(line)
    n, rest = len(tokens), max(0, len(tokens) - DEPTH)
    cuts = [DEPTH + rest * k // FIELDS for k in range(FIELDS + 1)]
    parts = [f"{n} {' '.join(tokens[:DEPTH])}", *(" ".join(tokens[a:b]) for a, b in zip(cuts, cuts[1:]))]
    return n, [xxhash.xxh3_64_intdigest(p.encode("utf-8", "surrogatepass")) for p in parts], [b - a for a, b in zip(cuts, cuts[1:])]


def template_keys(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Names of the templates of each line: without a variable field, then with each of the fields variable; and how many texts
    each must be in, 0 for templates that are no templates, as too few other tokens are left."""
    if not lines:
        return np.zeros((0, FIELDS + 1), np.int64), np.zeros((0, FIELDS + 1), np.int8)
    n, hashes, sizes = map(np.array, zip(*map(parts_of, lines)))
    mixed = hashes.astype(np.uint64) * FACTORS
    mixed = (mixed ^ (mixed >> np.uint64(29))) * FACTORS[::-1]
    whole = mixed.sum(1, dtype=np.uint64)
    names = np.column_stack([whole, whole[:, None] - mixed[:, 1:] + FACTORS[:1] * np.arange(1, FIELDS + 1, dtype=np.uint64)])
    names = (names ^ (names >> np.uint64(32))) * FACTORS[1]
    need = np.full(names.shape, MIN_TEXTS, np.int8)
    need[n >= LONG, 0] = MIN_TEXTS_LONG
    need[:, 1:][(n[:, None] - sizes < MIN_CONSTANT) | (sizes == 0)] = 0
    return (names ^ (names >> np.uint64(31))).view(np.int64), need


def text_key(text: str) -> bytes:
    return hashlib.md5(text.encode("utf-8", "surrogatepass"), usedforsecurity=False).digest()


def parse_lines(docs: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """A row for each text with lines that are not blank: id, text_key, lines (places in the text), and for each of those lines
    FIELDS + 1 names of templates (keys) and what they need."""
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("id", kind), T.StructField("text_key", T.BinaryType()), T.StructField("templates", T.ArrayType(T.StructType([T.StructField("line", T.IntegerType()), T.StructField("need", T.ByteType()), T.StructField("key", T.LongType())])))])

    def run(batches):
        for batch in slices(batches, "t"):
            row, key, at, size = [], [], [], []
            flat: list[str] = []
            for r, text in enumerate(batch.column(1).to_pylist()):
                lines = [(k, x) for k, x in enumerate((text or "").split("\n")) if BLACK.search(x)]
                if lines:
                    row.append(r)
                    key.append(text_key(text))
                    at += [k for k, _ in lines]
                    flat += [x for _, x in lines]
                    size.append(len(lines))
            names, need = template_keys(flat)
            whose = np.repeat(np.arange(len(row)), size)
            is_template = need.ravel() > 0
            line = np.repeat(np.array(at, np.int32), FIELDS + 1)[is_template]
            counts = np.bincount(np.repeat(whose, FIELDS + 1)[is_template], minlength=len(row)) if row else np.zeros(0, np.int64)
            offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
            templates = pa.StructArray.from_arrays([pa.array(line), pa.array(need.ravel()[is_template]), pa.array(names.ravel()[is_template])], names=["line", "need", "key"])
            arrays = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(key, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), templates)]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("t")).mapInArrow(run, schema)


def near_copies(docs: DataFrame, text_col: str, carriers: DataFrame) -> DataFrame:
    """(text_key, class) for the texts in carriers (text_key): near copies, by word shingles, are one class."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.unhex(F.md5(text.cast("binary"))).alias("text_key"), text.alias("text"))
    return estimated_classes(rows.join(carriers, "text_key", "left_semi").dropDuplicates(["text_key"]), "text_key")


def dropped_lines(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", min_texts: int = MIN_TEXTS, min_texts_long: int = MIN_TEXTS_LONG) -> DataFrame:
    """For each text that loses lines: id, text_key and dropped, the sorted places of those lines.

    Texts are told apart by their content, so exact copies count once, and so do near copies. Names of templates are counted
    within tasks first, over rows; only those in enough rows are looked at by text, and only texts that have one of those are
    signed and told apart.
    """
    spark = docs.sparkSession
    parsed = stored(parse_lines(docs, text_col, id_col), "lines")
    need = F.when(F.col("need") == MIN_TEXTS, F.lit(min_texts)).otherwise(F.lit(min(min_texts, min_texts_long)))
    keys = F.array_distinct(F.transform("templates", lambda t: F.struct(t["key"].alias("key"), t["need"].alias("need"))))
    counted = parsed.select(F.inline(keys)).groupBy("key").agg(F.count("*").alias("n"), F.max("need").alias("need"))
    often = stored(counted.where(F.col("n") >= need).select("key"), "templates")
    release(spark)
    lines = parsed.select("id", "text_key", F.inline("templates")).join(often, "key")
    found = stored(lines.select("id", "text_key", "line", "key", need.alias("need")), "shared-lines")
    release(spark)
    classes = stored(near_copies(docs, text_col, found.select("text_key").distinct()), "classes")
    carried = found.groupBy("key", "need", "text_key").agg(F.min("id").alias("id")).join(classes, "text_key").groupBy("key", "need", "class").agg(F.min("id").alias("id"))
    recurring = carried.groupBy("key", "need").agg(F.count("*").alias("n"), F.min("id").alias("first_id")).where("n >= need").select("key", "first_id")
    lost = found.join(recurring, "key").where(~F.col("id").eqNullSafe(F.col("first_id")))
    return lost.groupBy("id", "text_key").agg(F.array_sort(F.collect_set("line")).alias("dropped"))


def drop_recurring_lines(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", min_texts: int = MIN_TEXTS, min_texts_long: int = MIN_TEXTS_LONG) -> DataFrame:
    """docs with recurring lines taken out of text_col, and n_lines, n_dropped (bigint; columns with these names are replaced).

    A template recurs if min_texts texts have it; a whole line of LONG tokens or more, which no two texts say alike by chance, if
    min_texts_long do. Equal counts treat all lines alike.

    n_lines counts lines that are not blank; blank lines stay. A null text stays null and has no lines. Rows with one id
    and text fare alike; several rows with the least id and different texts all keep the line. A null id never comes first,
    unless only null ids have a template, and then all keep it. Other columns stay; an empty table gives an empty one.
    """
    lost = stored(dropped_lines(docs, text_col, id_col, min_texts, min_texts_long), "lost-lines")
    release(docs.sparkSession)
    return without_lines(docs, lost, text_col, id_col)


def without_lines(docs: DataFrame, lost: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """docs without the lines that lost (id, text_key, dropped) names; see drop_recurring_lines."""
    extra = {"n_lines", "n_dropped"}
    columns = [c for c in docs.columns if c.lower() not in extra]
    key, own, lost_id = (free_name(n, docs) for n in ("text_key", "dropped", "lost_id"))
    lost = lost.withColumnsRenamed({"id": lost_id, "text_key": key, "dropped": own})
    keyed = docs.select(*[F.col(f"`{c}`") for c in columns], F.unhex(F.md5(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary"))).alias(key))
    joined = keyed.join(lost, keyed[f"`{id_col}`"].eqNullSafe(lost[lost_id]) & (keyed[key] == lost[key]), "left")
    parts = F.split(F.col(f"`{text_col}`"), "\n", -1)
    places = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col(own))  # by hash, not a search for each line
    kept = F.array_join(F.transform(F.array(parts), lambda p: F.transform(places, lambda i: F.get(p, i)))[0], "\n")
    blank = F.size(F.filter(parts, lambda x: x.rlike(NOT_BLANK)))
    return joined.select(
        *[F.when(F.col(own).isNull(), F.col(f"`{c}`")).otherwise(kept).alias(c) if c == text_col else F.col(f"`{c}`") for c in columns],
        F.coalesce(F.when(F.col(f"`{text_col}`").isNotNull(), blank), F.lit(0)).cast("bigint").alias("n_lines"),
        F.coalesce(F.size(own), F.lit(0)).cast("bigint").alias("n_dropped"),
    )


def digests(deduped: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return deduped.select("doc_id", "n_lines", "n_dropped", F.length(text).cast("bigint").alias("n_chars"), F.sha2(text, 256).alias("text_sha256"))
