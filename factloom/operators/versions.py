"""Versions of a world: differences, patches, enrichment, removal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIELDS = ["type", "kind", "value", "object", "actor", "action", "state"]


def diff_events(old: DataFrame, new: DataFrame) -> DataFrame:
    """Events that were added, removed or changed, with the names of the changed fields."""
    key = ["case_id", "event_id"]
    o = old.select(*key, F.struct(*FIELDS).alias("o"))
    n = new.select(*key, F.struct(*FIELDS).alias("n"))
    changed = F.array_compact(F.array(*[F.when(~F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}")), F.lit(c)) for c in FIELDS]))
    status = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").when(F.size(changed) > 0, "changed")
    fields = F.when(F.col("o").isNotNull() & F.col("n").isNotNull(), F.array_join(changed, ",")).otherwise("")
    return o.join(n, key, "full").select(*key, status.alias("status"), fields.alias("fields")).where("status is not null")


def diff_sets(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows, by all columns of the key (nulls are equal), that only one version has: added or removed."""
    sides = old.select(*key, F.lit(1).alias("side")).unionByName(new.select(*key, F.lit(2).alias("side")))
    found = sides.groupBy(*key).agg(F.bit_or("side").alias("sides")).where("sides < 3")
    return found.select(*key, F.when(F.col("sides") == 1, "removed").otherwise("added").alias("status"))


def diff_entities(old: DataFrame, new: DataFrame) -> DataFrame:
    return diff_sets(old, new, ["case_id", "type", "name"])


def diff_violations(old: DataFrame, new: DataFrame) -> DataFrame:
    """Violations by identity (case, type, events): added or removed; those in both are left out."""
    return diff_sets(old, new, ["case_id", "type", "a", "b"])


def without_object(events: DataFrame, name: str) -> DataFrame:
    """A world without an entity: events stay and lose the object."""
    return events.withColumn("object", F.when(F.col("object") != name, F.col("object")))


def patched(events: DataFrame, removed: DataFrame, updated: DataFrame, added: DataFrame) -> DataFrame:
    """Removals, then updates of actions, then additions, all by (case_id, event_id). Updates of unknown events change nothing; of
    several updates of one event the last in order of the text holds, and repeated additions count once."""
    key = ["case_id", "event_id"]
    rows = events.join(removed.select(*key), key, "left_anti").join(updated.groupBy(*key).agg(F.max("action").alias("new_action")), key, "left")
    rows = rows.withColumn("action", F.coalesce("new_action", "action")).drop("new_action")
    return rows.unionByName(added.dropDuplicates(key).join(events.select(*key), key, "left_anti").select(rows.columns))


def enriched(events: DataFrame, patches: DataFrame) -> DataFrame:
    """Fills unknown times and missing actors from patches (case_id, event_id, value, actor); another known time is a conflict.
    Two patches of one event contradict each other or say nothing new, so neither is applied; enrichment.py refuses the set."""
    once = patches.groupBy("case_id", "event_id").agg(F.count("*").alias("n_patches"), F.max("value").alias("p_value"), F.max("actor").alias("p_actor")).where("n_patches = 1")
    rows = events.join(once, ["case_id", "event_id"], "left")
    fills = (F.col("kind") == "unknown") & F.col("p_value").isNotNull()
    return rows.select(
        "case_id",
        "event_id",
        F.when(fills, "date").otherwise(F.col("kind")).alias("kind"),
        F.when(fills, F.col("p_value")).otherwise(F.col("value")).alias("value"),
        F.coalesce("actor", "p_actor").alias("actor"),
        F.coalesce((F.col("kind") != "unknown") & (F.col("p_value") != F.col("value")), F.lit(False)).alias("ordering_conflict"),
    )
