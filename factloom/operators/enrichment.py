"""Worlds enriched: actors and objects are added to events, unknown times filled; times that differ are conflicts.

An enrichment has case_id, event_id, actors and objects (arrays, or null for nothing said), time_kind (date, datetime, relative, unknown, or null)
and time_value. Those of a case are one set: a fault in it refuses the whole set, and the case stays as it was. Events are as in causal.py.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import lf

#: What kinds of times become. A relative time says nothing of when.
KINDS = {"unknown": "unknown", "date": "date", "datetime": "instant", "relative": "unknown"}


def ids_of(column: str) -> Column:
    """Ids with line feeds only, without empty ones, sorted; null stays null."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(column, lf), lambda x: x != "")))


def faults(enrichments: DataFrame) -> DataFrame:
    """(case_id, event_id, fault), each once: events that are named twice, lists that are empty, kinds of time that don't exist or lack a value."""
    named = enrichments.groupBy("case_id", "event_id").agg(F.count("*").alias("n")).where("n > 1").select("case_id", "event_id", F.lit("duplicate event").alias("fault"))
    known = F.col("time_kind").isin(list(KINDS))
    checks = {"empty actors": F.size(ids_of("actors")) == 0, "empty objects": F.size(ids_of("objects")) == 0, "unsupported time kind": ~known, "time without value": F.col("time_kind").isin("date", "datetime") & F.col("time_value").isNull()}
    each = [enrichments.where(c).select("case_id", "event_id", F.lit(name).alias("fault")) for name, c in checks.items()]
    return reduce(DataFrame.union, each, named).distinct()


def enriched(events: DataFrame, enrichments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The events with what the enrichments add, and the conflicts (case_id, event_id, kind, value, told_kind, told_value) of known times with other ones.
    Enrichments of events that aren't there change nothing."""
    kind = F.element_at(F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair]), F.col("time_kind"))
    sound = enrichments.join(faults(enrichments).select("case_id").distinct(), "case_id", "left_anti")
    told = sound.select("case_id", "event_id", ids_of("actors").alias("more_actors"), ids_of("objects").alias("more_objects"), kind.alias("told_kind"), F.when(kind != "unknown", lf(F.col("time_value"))).alias("told_value"))
    both = events.join(told, ["case_id", "event_id"], "left")
    fills = (F.col("kind") == "unknown") & F.col("told_kind").isNotNull()
    union = lambda c: F.when(F.col(f"more_{c}").isNull(), F.col(c)).otherwise(F.array_sort(F.array_union(c, f"more_{c}")))
    new = {"actors": union("actors"), "objects": union("objects"), "kind": F.when(fills, F.col("told_kind")).otherwise(F.col("kind")), "value": F.when(fills, F.col("told_value")).otherwise(F.col("value"))}
    differ = (F.col("kind") != "unknown") & F.col("told_kind").isNotNull() & ~((F.col("kind") == F.col("told_kind")) & F.col("value").eqNullSafe(F.col("told_value")))
    return both.select(*[new.get(c, F.col(c)).alias(c) for c in events.columns]), both.where(differ).select("case_id", "event_id", "kind", "value", "told_kind", "told_value")
