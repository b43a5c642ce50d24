"""Worlds of whole events: causal edges by shared tokens, inferences that something missing blocks, violations; all with their evidence.

An event has case_id, event_id, type, kind and value (of its time), action, actors and objects (arrays of entity ids), state (a map of
texts, or null) and evidence (an array of references, structs of source_id, chunk_id, offset_start, offset_end, text_sha256 in this order, so that
sorting structs sorts references). An entity has case_id, entity_id, type and name.

Events meet through an inverted index: a row for each token of each event, joined by case and token, so only events that share one
are looked at. Findings and contradictions list pairs by definition; their size is that of what is found.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.operators.world import FORWARD, INVERSE, NEGATIONS, POLICY_PHRASES, SECURITY_WORDS, SOURCE_WORDS, TYPE_TERMS, any_of
from factloom.sources.shared import spread

#: Fixed values of the rules: what forbids a secret in source, what keeps it in the environment; reasons, the strongest first.
NEVER, ENV_ONLY = ["never in source", "never in repo"], ["environment only", "env-only"]
REASONS = ["RULE_CONFLICT_IMPLIED", "RULE_SECRET_HANDLING_CAUSAL", "RULE_POLICY_PRECEDES_CONFIG", "RULE_TIME_PHRASE_BEFORE", "RULE_TIME_EXPLICIT_DATE"]
BLOCKED = "UNKNOWN_BLOCKS_CAUSAL"
#: Terms and what follows a phrase are matched by their first characters, up to so many.
LEAD = 4


def canonical_token(token: Column) -> Column:
    """Trimmed, in capitals; ids of entities stay as they are."""
    token = F.trim(token)
    return F.when(token.startswith("entity:"), token).otherwise(F.upper(token))


def state_json(state: Column) -> Column:
    """Canonical JSON of a map of texts: keys sorted."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(state))))


def said(action: Column, state: Column) -> Column:
    return F.concat(action, F.coalesce(F.concat(F.lit(" "), state_json(state)), F.lit("")))


def object_tokens(objects: Column, text: Column) -> Column:
    """Objects, what stands in backticks, and names in capitals, in canonical form, sorted."""
    quoted = F.regexp_extract_all(text, F.lit("`([^`]+)`"), 1)
    capitals = F.regexp_extract_all(text, F.lit(r"(?U)\b[A-Z][A-Z0-9_]{2,}\b"), 0)
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.concat(objects, quoted, capitals), canonical_token), lambda t: t != "")))


def indexed(events: DataFrame) -> DataFrame:
    """events with what the rules look at: text (in lower case), tokens, terms by which other events may name it, and its place in time."""
    text = said(F.col("action"), F.col("state"))
    rows = events.withColumn("text", F.lower(text)).withColumn("tokens", object_tokens(F.col("objects"), text))
    synonyms = F.coalesce(F.element_at(F.create_map(*[x for t, terms in TYPE_TERMS.items() for x in (F.lit(t), F.array(*map(F.lit, terms)))]), F.col("type")), F.array().cast("array<string>"))
    words = F.regexp_extract_all("text", F.lit("[a-z0-9]{4,}"), 0)
    names = F.transform(F.filter("tokens", lambda t: ~t.startswith("entity:")), F.lower)
    return rows.select(
        "case_id", "event_id", "type", "kind", "value", "objects", "evidence", "text", "tokens", F.array_distinct(F.concat(synonyms, words, names)).alias("terms"),
        F.struct(F.coalesce("value", F.lit("~")).alias("value"), "event_id").alias("at"), (F.size("objects") == 0).alias("lacks_object"),
        any_of(F.col("text"), NEVER).alias("never"), any_of(F.col("text"), ENV_ONLY).alias("env"),
    )


def unknowns(events: DataFrame) -> DataFrame:
    """What an event lacks: a time, an actor (unless it is of type Other and says nothing of security), an object."""
    secure = (F.col("type") != "Other") | any_of(F.lower("action"), SECURITY_WORDS)
    missing = [F.when(F.col("kind") == "unknown", "missing_time"), F.when((F.size("actors") == 0) & secure, "missing_actor"), F.when(F.size("objects") == 0, "missing_object")]
    return events.select("case_id", "event_id", F.explode(F.array_compact(F.array(*missing))).alias("unknown"))


def secret_states(events: DataFrame, entities: DataFrame) -> DataFrame:
    """(case_id, entity_id, key, state, event_id): what events say of the state of a secret that is their object, under the secret's name."""
    secrets = entities.where("type = 'Secret'").select("case_id", "entity_id", F.col("name").alias("key")).hint("merge")
    told = events.select("case_id", "event_id", F.explode("objects").alias("entity_id"), "state").select("case_id", "entity_id", "event_id", F.explode("state").alias("key", "state"))
    return told.join(secrets, ["case_id", "entity_id", "key"]).select("case_id", "entity_id", "key", "state", "event_id").hint("merge")


def conflicts(events: DataFrame, entities: DataFrame) -> DataFrame:
    """Secrets of which events tell two states or more, whenever: the states and the first and last of the events by id, and how many."""
    told = secret_states(events, entities).groupBy("case_id", "entity_id", "key")
    found = told.agg(F.array_sort(F.collect_set(F.when(F.col("state") != "", F.col("state")))).alias("states"), F.countDistinct("event_id").alias("n_events"), F.min("event_id").alias("first_event"), F.max("event_id").alias("last_event"))
    reason = F.concat(F.col("key"), F.lit(" has conflicting states: "), F.array_join("states", ", "))
    return found.where(F.size("states") > 1).select("case_id", "entity_id", "key", "states", "n_events", "first_event", "last_event", reason.alias("reason"))


def tokens_of(rows: DataFrame, name: str, *columns: str) -> DataFrame:
    """A row for each token of each event; the event's id is called name, other columns name_column."""
    return rows.select("case_id", F.explode("tokens").alias("token"), F.col("event_id").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in columns])


def phrase_edges(rows: DataFrame) -> DataFrame:
    """(case_id, a, b): a before b, as one says of the other, with which it shares a token. The first phrase that fits decides, forward ones first; then
    `then X` and `when X ended`, by X in order. A row for each phrase and what follows it meets a row for each term by token and first characters."""
    phrases = [(k, p, p in FORWARD) for k, p in enumerate([*FORWARD, *INVERSE])] + [(len(FORWARD + INVERSE), p, p == "then") for p in ("then", "when")]

    def follows(rank: int, phrase: str, forward: bool) -> Column:
        leads = F.regexp_extract_all("text", F.lit(f"(?s){phrase} (?=(.{{1,{LEAD}}}))"), 1)
        return F.transform(leads, lambda lead: F.struct(F.lit(rank).alias("rank"), F.lit(phrase).alias("phrase"), F.lit(forward).alias("forward"), lead.alias("lead")))

    spoken = rows.withColumn("said", F.array_distinct(F.concat(*[follows(*p) for p in phrases]))).where(F.size("said") > 0)
    spoken = tokens_of(spoken, "speaker", "text", "said").select("case_id", "token", "speaker", "speaker_text", F.inline("speaker_said"))
    sizes = F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("lead")), lambda n: F.left("lead", n))))
    spoken = spoken.select("case_id", "token", sizes.alias("key"), "speaker", "speaker_text", "rank", "phrase", "forward")
    meant = tokens_of(rows, "meant", "terms").select("case_id", "token", "meant", F.explode("meant_terms").alias("term")).withColumn("key", F.left("term", F.lit(LEAD)))
    ending = F.when(F.col("phrase") == "when", " ended").otherwise("")
    fits = F.contains("speaker_text", F.concat("phrase", F.lit(" "), "term", ending))
    found = spoken.join(meant, ["case_id", "token", "key"]).where((F.col("speaker") != F.col("meant")) & fits)
    last = F.col("rank") == len(FORWARD + INVERSE)
    first = found.groupBy("case_id", "speaker", "meant").agg(F.min(F.struct("rank", F.when(last, F.col("term")).alias("term"), F.when(last, F.col("phrase")).alias("phrase"), "forward")).alias("first"))
    forward = F.col("first.forward")
    return first.select("case_id", F.when(forward, F.col("speaker")).otherwise(F.col("meant")).alias("a"), F.when(forward, F.col("meant")).otherwise(F.col("speaker")).alias("b"))


def policy_pairs(rows: DataFrame) -> DataFrame:
    """(case_id, a, b): a policy change and a later configuration that share a token."""
    policy, config = tokens_of(rows.where("type = 'PolicyChange'"), "a", "at"), tokens_of(rows.where("type = 'Config'"), "b", "at")
    return policy.join(config, ["case_id", "token"]).where("a_at < b_at").select("case_id", "a", "b").distinct()


def secret_pairs(rows: DataFrame) -> DataFrame:
    """(case_id, a, b): a keeps a secret out of source, b keeps it in the environment, both have objects and share a token. Of two that
    say both, the earlier one is a."""
    whole = rows.where("NOT lacks_object")
    never, env = tokens_of(whole.where("never"), "a", "at", "env"), tokens_of(whole.where("env"), "b", "at", "never")
    pairs = never.join(env, ["case_id", "token"]).where("a <> b AND NOT (a_env AND b_never AND b_at < a_at)")
    return pairs.select("case_id", "a", "b").distinct()


def contradicting(events: DataFrame, entities: DataFrame) -> DataFrame:
    """(case_id, a, b): events of one conflict, a before b by id."""
    told = secret_states(events, entities)
    torn = conflicts(events, entities).select("case_id", "entity_id", "key")
    members = told.join(torn, ["case_id", "entity_id", "key"]).select("case_id", "entity_id", "key", "event_id").distinct().hint("merge")
    a, b = (members.withColumnRenamed("event_id", c) for c in "ab")
    return a.join(b, ["case_id", "entity_id", "key"]).where("a < b").select("case_id", "a", "b").distinct()


def edges(events: DataFrame, entities: DataFrame, dates: bool = False) -> DataFrame:
    """(case_id, a, b, type, reason, confidence, evidence): each edge once, with its strongest reason and the references of both events.

    dates adds an edge for each two different known times: all pairs, by definition. What needs only their order has it from the
    events (graph.arranged). What the rules look at is found once for each event and stored: each of them reads it twice."""
    rows = spread(indexed(events).drop("objects", "evidence"), "indexed")
    known = rows.where("kind <> 'unknown'").select("case_id", "event_id", "value")
    by_date = known.toDF("case_id", "a", "a_value").join(known.toDF("case_id", "b", "b_value"), "case_id").where("a_value < b_value").select("case_id", "a", "b") if dates else None
    rules = [("contradicts", 0, contradicting(events, entities)), ("enables", 1, secret_pairs(rows)), ("before", 2, policy_pairs(rows)), ("before", 3, phrase_edges(rows)), ("before", 4, by_date)]
    found = reduce(DataFrame.union, [df.select("case_id", "a", "b", F.lit(kind).alias("type"), F.lit(k).alias("k")) for kind, k, df in rules if df is not None])
    best = found.groupBy("case_id", "a", "b", "type").agg(F.min("k").alias("k"))
    reason = F.element_at(F.array(*map(F.lit, REASONS)), F.col("k") + 1)
    told = with_evidence(best, events, "a", "b")
    return told.select("case_id", "a", "b", "type", reason.alias("reason"), F.when(F.col("k") == 3, "medium").otherwise("high").alias("confidence"), "evidence")


def with_evidence(rows: DataFrame, events: DataFrame, *ids: str) -> DataFrame:
    """rows with the distinct references, sorted, of the events that some columns name."""
    for c in ids:
        rows = rows.join(events.select("case_id", F.col("event_id").alias(c), F.col("evidence").alias(f"{c}_evidence")), ["case_id", c])
    return rows.withColumn("evidence", F.array_sort(F.array_distinct(F.concat(*[F.col(f"{c}_evidence") for c in ids])))).drop(*[f"{c}_evidence" for c in ids])


def blocked(events: DataFrame) -> DataFrame:
    """(case_id, reason, a, b, missing): pairs between which a rule might have found an edge, if neither lacked an object; a before b by id."""
    rows = indexed(events).select("case_id", "event_id", "type", "tokens", "at", "lacks_object", (F.col("never") | F.col("env")).alias("secret"))
    side = lambda df, name: df.select("case_id", *[F.col(c).alias(f"{name}_{c}") for c in df.columns if c != "case_id"])
    meet = lambda x, y: side(x, "x").join(side(y, "y"), "case_id").where("x_event_id <> y_event_id")
    pair = [F.least("x_event_id", "y_event_id").alias("a"), F.greatest("x_event_id", "y_event_id").alias("b")]
    policy, config, lacks = rows.where("type = 'PolicyChange'"), rows.where("type = 'Config'"), F.col("lacks_object")
    apart = meet(policy.where(lacks), config).union(meet(policy.where(~lacks), config.where(lacks))).where("x_at < y_at AND NOT arrays_overlap(x_tokens, y_tokens)")
    secrets = meet(rows.where(lacks & F.col("secret")), rows).union(meet(rows.where(lacks & ~F.col("secret")), rows.where("secret")))
    found = apart.select("case_id", F.lit(REASONS[2]).alias("reason"), *pair).union(secrets.select("case_id", F.lit(REASONS[1]).alias("reason"), *pair)).distinct()
    return found.withColumn("missing", F.lit("missing_object"))


def needed_info(found: DataFrame, events: DataFrame) -> DataFrame:
    """(case_id, event_id, type, missing): what would have to be known of the events of blocked inferences."""
    ends = found.select("case_id", F.explode(F.array("a", "b")).alias("event_id"), "missing").distinct()
    return ends.join(events.select("case_id", "event_id", "type"), ["case_id", "event_id"]).select("case_id", "event_id", "type", "missing")


def violations(events: DataFrame, found: DataFrame) -> DataFrame:
    """(case_id, type, events, entities, reason, evidence) of the policy changes that are broken in source context, of the edges (found) against
    known times, and of states that negate each other. Two policies that break each other are two violations."""
    shared = events.select("case_id", "event_id", "type", F.lower("action").alias("low"), F.explode("objects").alias("entity"))
    forbids = shared.where((F.col("type") == "PolicyChange") & any_of(F.col("low"), POLICY_PHRASES)).select("case_id", "entity", F.col("event_id").alias("a"))
    exposes = shared.where(any_of(F.col("low"), SOURCE_WORDS)).select("case_id", "entity", F.col("event_id").alias("b"))
    broken = forbids.join(exposes, ["case_id", "entity"]).where("a <> b").groupBy("case_id", "a", "b").agg(F.array_sort(F.collect_set("entity")).alias("entities"))
    policy = with_evidence(broken, events, "a", "b").withColumn("reason", F.lit("policy forbids source exposure for the same object referenced in a source-context event")).withColumn("type", F.lit("POLICY_CONFLICT"))
    at = events.where("kind <> 'unknown'").select("case_id", "event_id", "value", "objects")
    ends = found.where("type IN ('before', 'causes')").join(at.toDF("case_id", "a", "a_value", "a_objects"), ["case_id", "a"]).join(at.toDF("case_id", "b", "b_value", "b_objects"), ["case_id", "b"]).where("b_value < a_value")
    causes = F.col("type") == "causes"
    against = ends.withColumn("entities", F.array_sort(F.array_intersect("a_objects", "b_objects")))
    against = against.withColumn("reason", F.when(causes, "causal edge points to an event that occurs earlier in time").otherwise("causal before edge conflicts with explicit timeline ordering"))
    against = against.withColumn("type", F.when(causes, "CAUSAL_CONFLICT").otherwise("TEMPORAL_CONFLICT"))
    columns = ["case_id", "type", F.array_sort(F.array("a", "b")).alias("events"), "entities", "reason", "evidence"]
    return policy.select(columns).union(against.select(columns)).union(torn_states(events))


def torn_states(events: DataFrame) -> DataFrame:
    told = events.where("kind <> 'unknown' AND state IS NOT NULL").select("case_id", "event_id", "value", "evidence", F.explode("objects").alias("entity"), "state")
    told = told.select("case_id", "event_id", "value", "evidence", "entity", F.explode("state").alias("key", "state"))
    found = told.groupBy("case_id", "entity", "value", "key").agg(F.array_sort(F.collect_set("state")).alias("states"), F.array_sort(F.collect_set("event_id")).alias("events"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("evidence")))).alias("evidence"))
    negate = reduce(lambda x, y: x | y, [F.array_contains("states", a) & F.array_contains("states", b) for a, b in NEGATIONS])
    reason = F.concat(F.lit("entity has contradictory state values for "), "key", F.lit(" at "), "value", F.lit(": "), F.array_join("states", ", "))
    return found.where(negate).select("case_id", F.lit("STATE_CONFLICT").alias("type"), "events", F.array("entity").alias("entities"), reason.alias("reason"), "evidence")


def violation_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(case_id, change, type, events, entities, old_reason, new_reason). Violations with equal contents in both are left out first; of the rest,
    those of the same type, events and entities are `changed`, others are removed or added. Of several with these in common the last by reason counts."""
    identity = ["case_id", "type", "events", "entities"]
    each = [df.select(*identity, "reason").distinct() for df in (old, new)]
    left = [a.join(b, [*identity, "reason"], "left_anti").groupBy(identity).agg(F.max("reason").alias(name)) for a, b, name in ((*each, "old_reason"), (*each[::-1], "new_reason"))]
    change = F.when(F.col("old_reason").isNull(), "added").when(F.col("new_reason").isNull(), "removed").otherwise("changed")
    return left[0].join(left[1], identity, "full").select("case_id", change.alias("change"), "type", "events", "entities", "old_reason", "new_reason")
