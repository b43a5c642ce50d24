"""Templates chosen by name with fallbacks, and filled from nested facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.operators.facts import kind_of, text_of

#: The last template of every chain; how a list may be called whose elements are named by number.
GENERIC = "generic"
LISTS = ["{}", "{}s", "{}_list", "{}s_detailed", "{}_detailed"]


def slug(text: Column) -> Column:
    return F.regexp_replace(F.translate(F.lower(text), ": ", "__"), "[^a-z0-9_]+", "")


def chosen(rows: DataFrame, templates: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """rows (id, ref, and more) with name and template instead of ref: the first template (name, template) of a chain: the whole reference, its first
    word, the extra names, generic. Without any, name and template are null. Of templates of one name the least counts.

    There are as many templates as people write, so they go to every task, once for each link of the chain; rows stay where they are."""
    first = F.regexp_extract("ref", r"(?U)\S+", 0)
    chain = [F.nullif(slug(F.col("ref")), F.lit("")), F.nullif(slug(first), F.lit("")), *map(F.lit, [*extra, GENERIC])]
    known = templates.groupBy("name").agg(F.min("template").alias("template"))
    tried = rows.select("*", *[name.alias(f"link_{k}") for k, name in enumerate(chain)])
    for k in range(len(chain)):
        tried = tried.join(F.broadcast(known.select(F.col("name").alias(f"link_{k}"), F.struct("name", "template").alias(f"found_{k}"))), f"link_{k}", "left")
    best = F.coalesce(*[f"found_{k}" for k in range(len(chain))])
    return tried.withColumn("best", best).select(*[c for c in rows.columns if c != "ref"], "best.name", "best.template")


def members(value: Column) -> Column:
    """What an object holds, by key; null for anything else."""
    return F.try_variant_get(value, "$", "map<string,variant>")


def named(key: Column, held: Column) -> Column:
    """What key or key.part names in what a context holds, as a variant; null if that isn't there."""
    base = F.substring_index(key, ".", 1)
    item, number = (F.regexp_extract(base, "^([a-zA-Z_]+)_([0-9]+)", g) for g in (1, 2))
    place = number.try_cast("int")
    lists = [F.try_variant_get(F.try_element_at(held, F.concat(F.lit(n.partition("{}")[0]), item, F.lit(n.partition("{}")[2]))), "$", "array<variant>") for n in LISTS]
    element = F.when(place.isNotNull(), F.coalesce(*[F.get(x, F.greatest(place - 1, F.lit(0))) for x in lists]))
    found = F.coalesce(F.try_element_at(held, base), element)
    return F.when(F.contains(key, F.lit(".")), F.try_element_at(members(found), F.substring(key, F.length(base) + 2, F.length(key)))).otherwise(found)


def told(rows: DataFrame) -> DataFrame:
    """rows (template, json, and more) with text instead: places {key}, {key.part}, {item_N} and {item_N.part} of the template filled from the object in json.

    A key of the context comes before a list's element; N counts from 1, and 0 is the first as well. The first list that has an N-th element counts, even if
    that has no such part. A part is one key, dots and all. What isn't there, null, a list or an object shows as {missing:key}. Each row is filled where it
    is, from a map of its own context."""
    pieces = F.regexp_extract_all("template", F.lit(r"\{[^{}]+\}|[^{]+|\{"), 0)
    keyed = F.transform(pieces, lambda p: F.struct(p.alias("piece"), F.when(p.startswith("{") & (F.length(p) > 1), F.substring(p, F.lit(2), F.length(p) - 2)).alias("key")))
    valued = F.transform(keyed, lambda s: F.struct(s["piece"].alias("piece"), s["key"].alias("key"), named(s["key"], F.col("held")).alias("value")))
    shown = F.transform(valued, lambda s: F.when(s["key"].isNull(), s["piece"]).otherwise(F.coalesce(scalar(s["value"]), F.concat(F.lit("{missing:"), s["key"], F.lit("}")))))
    read = rows.withColumn("held", members(F.try_parse_json("json")))
    return read.select(*[c for c in rows.columns if c not in ("template", "json")], F.coalesce(F.array_join(shown, ""), F.lit("")).alias("text"))


def scalar(value: Column) -> Column:
    """The text of a scalar; null for null, a list or an object."""
    kind = kind_of(value)
    return F.when(~kind.isin("OBJECT", "ARRAY", "VOID"), text_of(value, kind))


def filled(rows: DataFrame, context: DataFrame) -> DataFrame:
    """(id, text) of rows (id, template) told() from context (id, json), one row each. Rows that hold their context need no join."""
    return told(rows.select("id", "template").join(context.select("id", "json"), "id", "left"))
