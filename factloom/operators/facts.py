"""Nested facts, as JSON of any shape, taken apart into paths, level by level."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.sources.shared import stored


#: Fixed value: levels of nesting that one pass goes down.
LEVELS = 4


def kind_of(value: Column) -> Column:
    """OBJECT, ARRAY, or the kind of a scalar (VOID for null)."""
    return F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)


def exploded(rows: DataFrame) -> DataFrame:
    """A row for each member of the objects and arrays in the column value: the other columns, pos, key (null in arrays), member."""
    columns = [c for c in rows.columns if c != "value"]
    members = rows.sparkSession.tvf.variant_explode(F.col("held").outer())
    return rows.withColumnRenamed("value", "held").lateralJoin(members).select(*columns, "pos", "key", F.col("value").alias("member"))


def descended(rows: DataFrame) -> DataFrame:
    """rows (id, path, value) with the members of objects and arrays instead of these; scalars and what is empty stay, with a null pos."""
    members = rows.sparkSession.tvf.variant_explode_outer(F.col("held").outer())
    step = F.when(F.col("pos").isNull(), F.col("path")).when(F.col("key").isNull(), F.concat("path", F.lit("["), F.col("pos").cast("string"), F.lit("]"))).when(F.col("path") == "", F.col("key")).otherwise(F.concat_ws(".", "path", "key"))
    return rows.select("id", "path", F.col("value").alias("held")).lateralJoin(members).select("id", step.alias("path"), F.coalesce("value", "held").alias("value"), "pos")


def flattened(rows: DataFrame) -> DataFrame:
    """(id, path, value, kind) of the scalars in json: a.b[0].c names a key in a key, a place, a key. Empty objects and arrays have none; a null text has
    none; JSON that can't be read is null and has none either. Values are as Python writes them: True, None, strings as they are.

    All rows go down LEVELS levels in one pass, which stores scalars and what is deeper; that goes down in another pass, as often as the deepest needs."""
    frontier = rows.select("id", F.lit("").alias("path"), F.try_parse_json("json").alias("value"))  # a filter here would have json read twice
    found = None
    while True:
        for _ in range(LEVELS):
            frontier = descended(frontier)
        nested = F.col("kind").isin("OBJECT", "ARRAY")
        deeper = nested & F.col("pos").isNotNull()
        ends = frontier.withColumn("kind", kind_of(F.col("value")))
        ends = stored(ends.select("id", "path", "kind", F.when(~nested, text_of(F.col("value"), F.col("kind"))).alias("text"), deeper.alias("deeper"), F.when(deeper, F.col("value")).alias("value")), "facts")
        scalars = ends.where(~nested).select("id", "path", F.col("text").alias("value"), "kind")
        found = scalars if found is None else found.union(scalars)
        below = ends.where("deeper")
        if below.isEmpty():
            return found
        frontier = below.select("id", "path", "value")


def text_of(value: Column, kind: Column) -> Column:
    text = value.cast("string")
    return F.when(kind == "VOID", "None").when(kind == "BOOLEAN", F.initcap(text)).otherwise(text)


def missing(rows: DataFrame, fields: list[str]) -> DataFrame:
    """(id, field): expected fields, a key or a key.key, that json lacks or has as null, an empty text or an empty list. What is no object lacks all."""
    read = rows.select("id", F.try_parse_json("json").alias("value"))

    def absent(field: str) -> Column:
        base, _, rest = field.partition(".")
        path = f"$['{base}']" + (f"['{rest}']" if rest else "")
        found = F.try_variant_get("value", path, "variant")
        kind = kind_of(found)
        return F.coalesce((kind == "VOID") | ((kind == "STRING") & (found.cast("string") == "")) | (F.schema_of_variant(found).isin("ARRAY<VOID>", "ARRAY<>") & (F.to_json(found) == "[]")), F.lit(True))

    names = [F.when(absent(f), F.lit(f)) for f in fields]
    return read.select("id", F.explode(F.array_compact(F.array(*names))).alias("field"))


def evidence_ids(rows: DataFrame) -> DataFrame:
    """(id, position, evidence_id): the ids, if texts, of the objects that json holds, by itself or in a list, one level deep, in order."""
    top = rows.select("id", F.try_parse_json("json").alias("value")).where("value IS NOT NULL")
    first = exploded(top.where(kind_of(F.col("value")) == "OBJECT")).withColumn("kind", kind_of(F.col("member")))
    alone = first.where("kind = 'OBJECT'").select("id", F.array(F.col("pos"), F.lit(0)).alias("at"), "member")
    listed = first.where("kind = 'ARRAY'").select("id", F.col("pos").alias("outer_pos"), F.col("member").alias("value"))
    inner = exploded(listed).select("id", F.array("outer_pos", "pos").alias("at"), "member")
    found = reduce(DataFrame.union, [alone, inner.where(kind_of(F.col("member")) == "OBJECT")])
    ids = found.select("id", "at", F.try_variant_get("member", "$.id", "variant").alias("x")).where(kind_of(F.col("x")) == "STRING")
    return ids.select("id", F.concat_ws(".", F.transform("at", lambda k: F.lpad(k.cast("string"), 6, "0"))).alias("position"), F.col("x").cast("string").alias("evidence_id"))
