"""Patches of worlds, operation by operation, with the guards that refuse one.

Operations are rows (case_id, op_no (unique in a case, from 0), op, id, type, name, object, action, from_id, to_id), in the order of op_no; what an operation
doesn't say is null. Worlds hold each entity, event and relation once. A case whose patch has a fault keeps its world. Whether something is there at an operation follows from what
was done to it before, so everything is a window over the history of one entity, event or relation; no case is replayed in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Types of what a patch may add.
ENTITY_TYPES = ["Concept", "Org", "Person", "Policy", "Secret", "Service", "System"]
EVENT_TYPES = ["Access", "Config", "Deployment", "Leak", "Other", "PolicyChange", "Rotation"]
RELATION_TYPES = ["after", "before", "same_time"]
OPS = [f"{verb}_{what}" for what in ("ENTITY", "EVENT") for verb in ("ADD", "UPDATE", "REMOVE")] + ["ADD_RELATION", "REMOVE_RELATION"]
RELATION = ["type", "from_id", "to_id"]


def history(base: DataFrame, ops: DataFrame, what: str, key: list[str], fields: list[str]) -> DataFrame:
    """What was done to each thing, the base first (op_no null): op, was (was it there before), now, and its fields after that.

    Each operation is taken as if those before it had been carried out."""
    start = base.select("case_id", *key, F.lit(None).cast("bigint").alias("op_no"), F.lit(f"ADD_{what}").alias("op"), *fields)
    done = ops.where(F.col("op").isin([f"{v}_{what}" for v in ("ADD", "UPDATE", "REMOVE", "DROP", "LOOK")])).select("case_id", *key, "op_no", "op", *fields)
    rows = start.unionByName(done)
    order = Window.partitionBy("case_id", *key).orderBy(F.asc_nulls_first("op_no"))
    before, up_to = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, 0)
    there = F.when(F.col("op") == f"ADD_{what}", True).when(F.col("op").isin(f"REMOVE_{what}", f"DROP_{what}"), False)
    # a field that an addition leaves out is empty, one that an update leaves out stays
    said = {c: F.when((F.col("op") == f"UPDATE_{what}") & F.col(c).isNull(), None).when(F.col("op") == f"LOOK_{what}", None).otherwise(F.struct(F.col(c).alias("v"))) for c in fields}
    return rows.select(
        "case_id",
        *key,
        "op_no",
        "op",
        F.coalesce(F.last(there, ignorenulls=True).over(before), F.lit(False)).alias("was"),
        F.coalesce(F.last(there, ignorenulls=True).over(up_to), F.lit(False)).alias("now"),
        F.lead("op_no").over(order).alias("until"),
        *[F.last(s, ignorenulls=True).over(up_to)["v"].alias(c) for c, s in said.items()],
    )


def histories(entities: DataFrame, events: DataFrame, relations: DataFrame, ops: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Histories of entities, events and relations; ids that new relations name are looked up (LOOK) among entities and events, and
    relations go (DROP) with an event at one of their ends."""
    ends = ops.where("op = 'ADD_RELATION'").select(*ops.columns, F.explode(F.array("from_id", "to_id")).alias("end"))
    look = lambda what: ops.unionByName(ends.withColumn("id", F.col("end")).withColumn("op", F.lit(f"LOOK_{what}")).select(ops.columns))
    of_entities = history(entities, look("ENTITY"), "ENTITY", ["id"], ["type", "name"])
    of_events = history(events, look("EVENT"), "EVENT", ["id"], ["type", "object", "action"])
    known = relations.select("case_id", *RELATION).union(ops.where("op = 'ADD_RELATION'").select("case_id", *RELATION)).distinct()
    gone = ops.where("op = 'REMOVE_EVENT'").select("case_id", "op_no", "id")
    at_ends = known.select("case_id", *RELATION, F.explode(F.array_distinct(F.array("from_id", "to_id"))).alias("id"))
    dropped = at_ends.join(gone, ["case_id", "id"]).select("case_id", *RELATION, "op_no", F.lit("DROP_RELATION").alias("op"))
    of_relations = history(relations, ops.select("case_id", *RELATION, "op_no", "op").union(dropped), "RELATION", RELATION, [])
    return of_entities, of_events, of_relations


def patch_faults(entities: DataFrame, events: DataFrame, relations: DataFrame, ops: DataFrame) -> DataFrame:
    """The first operation of each case's patch that can't be carried out, and why: (case_id, op_no, op, reason)."""
    of_entities, of_events, of_relations = histories(entities, events, relations, ops)
    fault = lambda df, reason: df.select("case_id", "op_no", "op", reason.alias("reason")).where("reason is not null")

    def presence(df: DataFrame) -> DataFrame:
        verb = F.substring_index("op", "_", 1)
        reason = F.when((verb == "ADD") & F.col("was"), "already exists").when(verb.isin("UPDATE", "REMOVE") & ~F.col("was"), "not found")
        return fault(df.where("op_no is not null"), reason)

    def wrong_type(what: str, types: list[str]) -> Column:
        needed = F.col("op").isin(f"ADD_{what}", f"UPDATE_{what}") if what != "RELATION" else F.col("op").endswith("_RELATION")
        missing = F.col("type").isNull() & (F.col("op") != f"UPDATE_{what}")
        return needed & (missing | ~F.col("type").isin(types))

    invalid = wrong_type("ENTITY", ENTITY_TYPES) | wrong_type("EVENT", EVENT_TYPES) | wrong_type("RELATION", RELATION_TYPES)
    said = F.when(~F.col("op").isin(OPS), "unsupported operation").when(F.coalesce(invalid, F.lit(False)), "invalid type")
    looked = of_entities.where("op = 'LOOK_ENTITY'").unionByName(of_events.where("op = 'LOOK_EVENT'"), allowMissingColumns=True)
    unknown = looked.groupBy("case_id", "op_no", "id").agg(F.bool_or("was").alias("known")).where("not known")
    removals = ops.where("op = 'REMOVE_ENTITY'").select("case_id", F.col("op_no").alias("at"), "id")
    span = [F.coalesce("op_no", F.lit(-1)).alias("since"), "until"]
    by_events = of_events.where("now and object is not null").select("case_id", F.col("object").alias("id"), *span)
    by_relations = of_relations.where("now").select("case_id", F.explode(F.array_distinct(F.array("from_id", "to_id"))).alias("id"), *span)
    held = lambda df: removals.join(df, ["case_id", "id"]).where("since < at and (until is null or at <= until)").select("case_id", F.col("at").alias("op_no"), F.lit("REMOVE_ENTITY").alias("op"))
    faults = [
        fault(ops, said),
        *map(presence, (of_entities, of_events, of_relations)),
        fault(unknown.withColumn("op", F.lit("ADD_RELATION")), F.lit("unknown id")),
        fault(held(by_events), F.lit("referenced by events")),
        fault(held(by_relations), F.lit("referenced by relations")),
    ]
    # several reasons of one operation: the order in which they are looked at
    rank = F.array_position(F.array(*map(F.lit, ["unsupported operation", "invalid type", "unknown id", "already exists", "not found", "referenced by events", "referenced by relations"])), F.col("reason"))
    first = reduce(DataFrame.unionByName, faults).groupBy("case_id").agg(F.min(F.struct("op_no", rank.alias("rank"), "op", "reason")).alias("f"))
    return first.select("case_id", "f.op_no", "f.op", "f.reason")


def patched_world(entities: DataFrame, events: DataFrame, relations: DataFrame, ops: DataFrame, faults: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entities, events and relations after the patch; cases with a fault are as they were."""
    sound = ops.join(faults.select("case_id"), "case_id", "left_anti")

    final = lambda df, *columns: df.where("until is null and now").select("case_id", *columns)
    of_entities, of_events, of_relations = histories(entities, events, relations, sound)
    return final(of_entities, "id", "type", "name"), final(of_events, "id", "type", "object", "action"), final(of_relations, *RELATION)
