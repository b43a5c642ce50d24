"""World events: types, relations, unknowns, conflicts, focus; causal edges and constraints of a focused world."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the rules.
SECURITY_WORDS = ["access", "secret", "key", "token", "credential"]
POLICY_PHRASES = ["must never appear in source", "must never be in source", "must never in source", "must never appear in repo", "must never be in repo", "must be never in source", "never in source"]
SOURCE_WORDS = ["source", "repo", "repository", "commit", "committed"]
NEGATIONS = [("active", "destroyed"), ("enabled", "disabled")]
TYPE_TERMS = {"Access": ["access", "login"], "Config": ["config", "configuration", "environment"], "Deployment": ["deployment", "deploy"], "Leak": ["leak", "breach", "exposed"], "PolicyChange": ["policy", "policy change"], "Rotation": ["rotation", "rotate", "rotated"]}
FORWARD, INVERSE = ["before", "prior to"], ["after", "following"]
MAX_EVENTS = 30


def any_of(text: Column, words: list[str]) -> Column:
    return reduce(or_, [F.contains(text, F.lit(w)) for w in words])


def event_type(action: Column) -> Column:
    """The first rule that holds decides; some look at the text as written, the others at lower case."""
    low = F.lower(action)
    secret = any_of(action, ["API_", "KEY", "TOKEN", "SECRET"]) | any_of(low, ["key", "secret", "token", "credential"])
    leaked = any_of(low, ["leak", "exposed", "breach"])
    return (
        F.when(any_of(low, ["never in source", "do not commit"]), "PolicyChange")
        .when(secret & leaked, "Leak")
        .when(secret, "Config")
        .when(any_of(low, ["rotate", "rotation"]), "Rotation")
        .when(any_of(low, ["deploy", "released", "rollout"]), "Deployment")
        .when(any_of(low, ["access", "login", "logged in"]), "Access")
        .when(any_of(low, ["leak", "exposed", "breach", "committed", "source control"]), "Leak")
        .when(any_of(low, ["policy"]), "PolicyChange")
        .when(any_of(low, ["config", "environment", "env-only"]), "Config")
        .otherwise("Other")
    )


def time_order() -> list[Column]:
    """Known times as text, then unknown ones, ties by id."""
    return [F.asc_nulls_last("value"), F.asc("event_id")]


def type_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("type", "kind").agg(F.count("*").alias("n"), F.countDistinct("case_id").alias("n_cases"))


def entities(events: DataFrame) -> DataFrame:
    """Objects and actors of each case, with the events and the first event that name them."""
    named = events.select("case_id", "event_id", F.explode(F.array(F.struct(F.lit("System").alias("type"), F.col("object").alias("name")), F.struct(F.lit("Person").alias("type"), F.col("actor").alias("name")))).alias("e")).where("e.name is not null")
    return named.groupBy("case_id", "e.type", "e.name").agg(F.count("*").alias("n_events"), F.min("event_id").alias("first_event"))


def relations(events: DataFrame) -> DataFrame:
    """Neighbours in time: before, or same_time."""
    w = Window.partitionBy("case_id").orderBy("value", "event_id")
    rows = events.where("kind <> 'unknown'").select("case_id", "event_id", "value", F.lead("event_id").over(w).alias("to_id"), F.lead("value").over(w).alias("to_value")).where("to_id is not null")
    return rows.select("case_id", F.col("event_id").alias("from_id"), "to_id", F.when(F.col("value") == F.col("to_value"), "same_time").otherwise("before").alias("relation"))


def unknowns(events: DataFrame) -> DataFrame:
    missing = [F.when(F.col("kind") == "unknown", F.lit("missing_time")), F.when(F.col("actor").isNull() & ((F.col("type") != "Other") | any_of(F.lower("action"), SECURITY_WORDS)), F.lit("missing_actor")), F.when(F.col("object").isNull(), F.lit("missing_object"))]
    return events.select("case_id", "event_id", F.explode(F.array_compact(F.array(*missing))).alias("unknown"))


def state_conflicts(events: DataFrame) -> DataFrame:
    """One object, one known time, two states that negate each other."""
    has = lambda s: F.bool_or(F.col("state") == s)
    found = events.where("kind <> 'unknown' and state is not null").groupBy("case_id", "object", "value").agg(F.array_join(F.array_sort(F.collect_set("state")), ",").alias("states"), F.count("*").alias("n_events"), *[(has(a) & has(b)).alias(f"p{k}") for k, (a, b) in enumerate(NEGATIONS)])
    return found.where("p0 or p1").drop("p0", "p1")


def value_conflicts(events: DataFrame) -> DataFrame:
    """Objects of a case with two states or more, at whatever time."""
    found = events.where("state is not null").groupBy("case_id", "object").agg(F.countDistinct("state").alias("n_states"), F.count("*").alias("n_events"))
    return found.where("n_states > 1")


def focus(events: DataFrame, tokens: list[str], implied: list[str], k: int = MAX_EVENTS) -> DataFrame:
    """The k best events of each case (3 for each query token in the action, 2 for an implied type), and all in a state conflict."""
    words = F.split(F.lower("action"), "[^a-z0-9_]+")
    score = sum((F.when(F.array_contains(words, t), 3).otherwise(0) for t in tokens), F.when(F.col("type").isin(implied), 2).otherwise(0))
    rank = F.row_number().over(Window.partitionBy("case_id").orderBy(F.desc("score"), *time_order()))
    ranked = events.withColumn("score", score).withColumn("rank", rank)
    torn = state_conflicts(events).select("case_id", "object", "value", F.lit(True).alias("forced"))
    rows = ranked.join(torn, ["case_id", "object", "value"], "left").withColumn("forced", F.coalesce("forced", F.lit(False)) & (F.col("kind") != "unknown"))
    return rows.where(f"rank <= {int(k)} or forced")


def before_edges(events: DataFrame) -> DataFrame:
    """Every pair of a focused world with different known times: the answer itself is as large as the pairs. What needs only the order
    of times takes it as ranks instead (fan_out, graph.arranged)."""
    known = events.where("kind <> 'unknown'").select("case_id", "event_id", "value")
    found = known.toDF("case_id", "a", "a_value").join(known.toDF("case_id", "b", "b_value"), "case_id").where("a_value < b_value")
    return found.select("case_id", "a", "b")


def fan_out(events: DataFrame) -> DataFrame:
    """Later events of each event, for whole worlds: counted by a window over times, without making pairs."""
    per_time = events.where("kind <> 'unknown'").groupBy("case_id", "value").agg(F.count("*").alias("n"))
    later = Window.partitionBy("case_id").orderBy(F.desc("value")).rowsBetween(Window.unboundedPreceding, -1)
    counted = per_time.select("case_id", "value", F.coalesce(F.sum("n").over(later), F.lit(0)).alias("fan_out"))
    return events.where("kind <> 'unknown'").join(counted, ["case_id", "value"]).select("case_id", "event_id", "fan_out")


def critical_events(events: DataFrame, top_k: int = 5) -> DataFrame:
    """The top_k events of each case by 10 for each later event and 1 for each reachable one; over time edges both are the same events."""
    scored = fan_out(events).withColumn("score", F.col("fan_out") * 11)
    rank = F.row_number().over(Window.partitionBy("case_id").orderBy(F.desc("score"), "event_id"))
    return scored.withColumn("rank", rank).where(f"rank <= {int(top_k)}")


def named_types(text: Column, phrases: list[str]) -> Column:
    """The types of which a term stands after one of the phrases in the text."""
    return F.array_compact(F.array(*[F.when(any_of(text, [f"{p} {term}" for p in phrases for term in terms]), F.lit(t)) for t, terms in TYPE_TERMS.items()]))


def typed_edges(events: DataFrame) -> DataFrame:
    """Edges between events of a case that share an object, each with its strongest reason.

    A policy precedes a configuration; never-in-source enables environment-only; phrases order events, the forward ones first.
    Each rule joins only the events that fit its two sides, so that no pairs are made that aren't edges (or, for policies, edges the
    other way round).
    """
    low, key = F.lower("action"), ["case_id", "object"]
    at = F.struct(F.coalesce("value", F.lit("~")).alias("value"), "event_id")
    side = lambda rows, name, *more: rows.select(*key, F.col("event_id").alias(name), *more)
    known = events.where("kind <> 'unknown'")
    enables = side(events.where(any_of(low, ["never in source", "never in repo"])), "a").join(side(events.where(any_of(low, ["environment only", "env-only"])), "b"), key)
    policy = side(known.where("type = 'PolicyChange'"), "a", at.alias("a_at")).join(side(known.where("type = 'Config'"), "b", at.alias("b_at")), key).where("a_at < b_at")
    typed = [*key, "type"]
    forward = side(events, "a", F.explode(named_types(low, FORWARD)).alias("type")).join(side(events, "b", "type"), typed)
    inverse = side(events, "b", F.explode(F.array_except(named_types(low, INVERSE), named_types(low, FORWARD))).alias("type")).join(side(events, "a", "type"), typed)
    rules = [(1, "enables", "RULE_SECRET_HANDLING_CAUSAL", enables), (2, "before", "RULE_POLICY_PRECEDES_CONFIG", policy), (3, "before", "RULE_TIME_PHRASE_BEFORE", forward), (3, "before", "RULE_TIME_PHRASE_BEFORE", inverse)]
    rows = reduce(DataFrame.union, [df.where("a <> b").select("case_id", "a", "b", F.lit(t).alias("type"), F.struct(F.lit(n).alias("priority"), F.lit(r).alias("reason")).alias("best")) for n, t, r, df in rules])
    return rows.groupBy("case_id", "a", "b", "type").agg(F.min("best").alias("best")).select("case_id", "a", "b", "type", "best.reason")


def violations(events: DataFrame, edges: DataFrame) -> DataFrame:
    """(case_id, type, a, b): policy changes broken in source context; before-edges against the known times; states that negate each other."""
    forbids = events.where((F.col("type") == "PolicyChange") & any_of(F.lower("action"), POLICY_PHRASES)).select("case_id", "object", F.col("event_id").alias("a"))
    exposes = events.where(any_of(F.lower("action"), SOURCE_WORDS)).select("case_id", "object", F.col("event_id").alias("b"))
    policy = forbids.join(exposes, ["case_id", "object"]).where("a <> b").select("case_id", F.lit("POLICY_CONFLICT").alias("type"), "a", "b")
    times = events.where("kind <> 'unknown'").select("case_id", "event_id", "value")
    timed = edges.where("type = 'before'").join(times.toDF("case_id", "a", "a_value"), ["case_id", "a"]).join(times.toDF("case_id", "b", "b_value"), ["case_id", "b"])
    temporal = timed.where("b_value < a_value").select("case_id", F.lit("TEMPORAL_CONFLICT").alias("type"), "a", "b")
    keyed = events.where("kind <> 'unknown'").select("case_id", "object", "value", "event_id", "state").groupBy("case_id", "object", "value")
    torn = keyed.agg(*[F.min(F.when(F.col("state") == s, F.col("event_id"))).alias(s) for pair in NEGATIONS for s in pair])
    state = torn.select("case_id", F.explode(F.array(*[F.struct(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"), (F.col(x).isNotNull() & F.col(y).isNotNull()).alias("both")) for x, y in NEGATIONS])).alias("s")).where("s.both")
    return policy.union(temporal).union(state.select("case_id", F.lit("STATE_CONFLICT").alias("type"), "s.a", "s.b"))


def violation_counts(found: DataFrame) -> DataFrame:
    kinds = ["POLICY_CONFLICT", "TEMPORAL_CONFLICT", "CAUSAL_CONFLICT", "STATE_CONFLICT"]
    return found.groupBy("case_id").agg(F.count("*").alias("n"), *[F.count_if(F.col("type") == k).alias(k.lower()) for k in kinds])


def repair_hints(found: DataFrame, events: DataFrame) -> DataFrame:
    """What would undo each violation, two hints each: by dropping or narrowing, by blanking a time, by splitting an entity."""
    types = events.select("case_id", F.col("event_id").alias("a"), F.col("type").alias("a_type"))
    rows = found.join(types, ["case_id", "a"]).join(types.toDF("case_id", "b", "b_type"), ["case_id", "b"])
    spare = F.when((F.col("a_type") != "PolicyChange") & (F.col("b_type") != "PolicyChange"), F.least("a", "b")).when(F.col("a_type") != "PolicyChange", F.col("a")).when(F.col("b_type") != "PolicyChange", F.col("b")).otherwise(F.least("a", "b"))
    hint = lambda action, risk, target: F.struct(F.lit(action).alias("action"), F.lit(risk).alias("risk"), target.alias("target"))
    all_of = F.least("a", "b")
    hints = (
        F.when(F.col("type") == "POLICY_CONFLICT", F.array(hint("DROP_EVENT", "medium", spare), hint("NARROW_SCOPE", "low", all_of)))
        .when(F.col("type") == "TEMPORAL_CONFLICT", F.array(hint("DROP_EDGE", "medium", all_of), hint("MARK_TIME_UNKNOWN", "low", F.col("b"))))
        .otherwise(F.array(hint("SPLIT_ENTITY", "medium", all_of), hint("MARK_TIME_UNKNOWN", "low", all_of)))
    )
    return rows.select("case_id", "type", "a", "b", F.explode(hints).alias("h")).select("case_id", "type", "a", "b", "h.action", "h.risk", "h.target")


def verify(events: DataFrame, found: DataFrame, cycles: DataFrame) -> DataFrame:
    """FAIL for a violation or a cycle, NEEDS_INFO for an unknown time or actor of a security event, OK otherwise; with reason codes."""
    secure = unknowns(events).where("unknown <> 'missing_object'").join(events.where(any_of(F.lower("action"), SECURITY_WORDS)).select("case_id", "event_id"), ["case_id", "event_id"], "left_semi")
    reasons = [(found, "RULE_CONSTRAINT_VIOLATION"), (cycles, "RULE_CAUSAL_TEMPORAL_CYCLE"), (secure, "RULE_WORLD_UNKNOWNS_SECURITY")]
    rows = reduce(DataFrame.union, [df.select("case_id", F.lit(code).alias("reason")).distinct() for df, code in reasons])
    by_case = rows.groupBy("case_id").agg(F.array_join(F.array_sort(F.collect_set("reason")), ",").alias("reasons"), F.bool_or(F.col("reason") != "RULE_WORLD_UNKNOWNS_SECURITY").alias("failed"))
    status = F.when(F.col("failed"), "FAIL").when(F.col("reasons").isNotNull(), "NEEDS_INFO").otherwise("OK")
    return events.select("case_id").distinct().join(by_case, "case_id", "left").select("case_id", status.alias("status"), F.coalesce("reasons", F.lit("")).alias("reasons"))
