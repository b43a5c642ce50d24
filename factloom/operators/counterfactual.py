"""Worlds without some of their events or entities: only what stood beside what went away is computed anew.

removals has case_id, op (REMOVE_EVENT or REMOVE_ENTITY) and target, an id as text; those of a case are carried out together. A removal that names
nothing is a fault and changes nothing. Events and entities are as in causal.py; relations, unknowns and conflicts are those of the world before.

What went is a share of all events, so a table of it is shuffled (spread), never gathered on the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators import causal, world
from factloom.sources.shared import spread


@dataclass
class World:
    events: DataFrame
    entities: DataFrame
    relations: DataFrame
    unknowns: DataFrame
    conflicts: DataFrame


def computed(events: DataFrame, entities: DataFrame) -> World:
    """A world from its events and entities, as a whole."""
    return World(events, entities, world.relations(events), causal.unknowns(events), causal.conflicts(events, entities))


def faults(removals: DataFrame, events: DataFrame, entities: DataFrame) -> DataFrame:
    """Removals whose target isn't there."""
    there = events.select("case_id", F.lit("REMOVE_EVENT").alias("op"), F.col("event_id").cast("string").alias("target")).union(entities.select("case_id", F.lit("REMOVE_ENTITY"), "entity_id")).hint("merge")
    return removals.join(there, ["case_id", "op", "target"], "left_anti").select("case_id", "op", "target")


def removed(before: World, removals: DataFrame) -> World:
    """The world after the removals. Relations close over runs of events that went; unknowns are computed for events that lost an entity, conflicts for
    entities of which an event went; everything else is taken over."""
    ops = spread(removals.join(faults(removals, before.events, before.entities), ["case_id", "op", "target"], "left_anti").distinct(), "removals")
    gone = ops.where("op = 'REMOVE_EVENT'").select("case_id", F.col("target").cast("bigint").alias("event_id"))
    lost = ops.where("op = 'REMOVE_ENTITY'").select("case_id", F.col("target").alias("entity_id"))
    entities = before.entities.join(lost, ["case_id", "entity_id"], "left_anti").hint("merge")
    events, touched = without(before.events.join(gone, ["case_id", "event_id"], "left_anti"), lost)
    events = spread(events, "events")

    stay = before.unknowns.join(gone, ["case_id", "event_id"], "left_anti").join(touched, ["case_id", "event_id"], "left_anti")
    unknowns = stay.unionByName(causal.unknowns(events.join(touched, ["case_id", "event_id"], "left_semi")))

    named = before.events.join(gone, ["case_id", "event_id"], "left_semi").select("case_id", F.explode("objects").alias("entity_id"))
    changed = named.union(lost).distinct().hint("merge")
    around = events.select("*", F.explode("objects").alias("entity_id")).join(changed, ["case_id", "entity_id"], "left_semi").drop("entity_id").dropDuplicates(["case_id", "event_id"])
    anew = causal.conflicts(around, entities.join(changed, ["case_id", "entity_id"], "left_semi"))
    conflicts = before.conflicts.join(changed, ["case_id", "entity_id"], "left_anti").unionByName(anew)
    return World(events, entities, closed_over(before.relations, gone, events), unknowns, conflicts)


def without(events: DataFrame, lost: DataFrame) -> tuple[DataFrame, DataFrame]:
    """events without the lost entities among actors and objects, and the ids of those that had one."""
    by_case = lost.groupBy("case_id").agg(F.collect_set("entity_id").alias("lost"))  # as many as a case has removals
    joined = events.join(by_case, "case_id", "left")
    none = F.array().cast("array<string>")
    left = {c: F.filter(c, lambda x: ~F.array_contains(F.coalesce("lost", none), x)) for c in ("actors", "objects")}
    had = F.arrays_overlap(F.concat("actors", "objects"), F.coalesce("lost", none))
    return joined.withColumns(left).select(events.columns), joined.where(had).select("case_id", "event_id").hint("merge")


def closed_over(relations: DataFrame, gone: DataFrame, events: DataFrame) -> DataFrame:
    """The chain of neighbours in time without the events that went. What follows an event that went is looked up behind it, twice as far
    each round, so a run of n of them takes about log2(n) rounds."""
    key = ["case_id", "to_id"]
    went = spread(gone.select("case_id", F.col("event_id").alias("to_id")), "gone")
    stay = relations.join(went, key, "left_anti").join(went.select("case_id", F.col("to_id").alias("from_id")), ["case_id", "from_id"], "left_anti")
    steps = relations.select("case_id", "from_id", "to_id")
    jumps = spread(steps.join(went.select("case_id", F.col("to_id").alias("from_id")), ["case_id", "from_id"], "left_semi"), "jumps")
    while True:
        on = jumps.select("case_id", F.col("from_id").alias("to_id"), F.col("to_id").alias("then"))
        far = jumps.join(went, key, "left_semi").join(on, key, "left").select("case_id", "from_id", F.col("then").alias("to_id")).where("to_id IS NOT NULL")
        if far.isEmpty():
            break
        jumps = spread(jumps.join(went, key, "left_anti").unionByName(far), "jumps")
    into = steps.join(went, key, "left_semi").join(went.select("case_id", F.col("to_id").alias("from_id")), ["case_id", "from_id"], "left_anti").hint("merge")
    ends = into.join(jumps.join(went, key, "left_anti").select("case_id", F.col("from_id").alias("to_id"), F.col("to_id").alias("next_id")), key).select("case_id", "from_id", F.col("next_id").alias("to_id"))
    times = events.select("case_id", "event_id", "value")
    made = ends.join(times.toDF("case_id", "from_id", "from_value"), ["case_id", "from_id"]).join(times.toDF("case_id", "to_id", "to_value"), key)
    return stay.select("case_id", "from_id", "to_id", "relation").union(made.select("case_id", "from_id", "to_id", F.when(F.col("from_value") == F.col("to_value"), "same_time").otherwise("before")))
