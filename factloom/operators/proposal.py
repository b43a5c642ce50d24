"""Worlds proposed from text: entities and events of each case, found in the lines of its sources.

Lines are rows (case_id, source_id, line_no, line); sources are in the order of their ids.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from factloom.functions.text import composed, identity, lf
from factloom.operators.world import SECURITY_WORDS, any_of, event_type
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a line is, and what names and times look like.
HEADING = r"(?Ud)^#{1,6}[\s\x1c-\x1f]+(.*)$"
BULLET = r"(?Ud)^(?:[-*]|\d+\.)[\s\x1c-\x1f]+(.*)$"
BACKTICK = r"`([^`]+)`"
ALL_CAPS = r"(?U)\b[A-Z][A-Z0-9_]{2,}\b"
INSTANT = r"(?U)\b\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z\b"
DATE = r"(?U)\b\d{4}-\d{2}-\d{2}\b"
EDGES = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"
#: Names are looked up by their first characters, up to so many, at every place of a text.
LEAD = 8
#: Values that first characters are hashed to, so that most places where no name of the case can begin are left out.
MARKS = 1024


def stripped(lines: DataFrame) -> DataFrame:
    return composed(lines, "line").withColumn("line", F.regexp_replace("line", EDGES, "")).where("line <> ''")


def proposed_entities(lines: DataFrame) -> DataFrame:
    """Entities of each case: headings (a policy if they say so, a concept otherwise), names in backticks (secrets) and names in
    capitals (concepts, unless a secret has that name by then). A secret and a concept may share a name, if the capitals came first."""
    rows = stripped(lines)
    heading = F.regexp_replace(F.regexp_extract("line", HEADING, 1), EDGES, "")
    kind = F.when(F.contains(F.lower(heading), F.lit("policy")), "policy").otherwise("heading")
    named = lambda names, k: F.transform(names, lambda n: F.struct(k.alias("kind"), n.alias("name")))
    found = F.concat(
        named(F.array(heading), kind),
        named(F.transform(F.regexp_extract_all("line", F.lit(BACKTICK), 1), lf), F.lit("secret")),
        named(F.regexp_extract_all("line", F.lit(ALL_CAPS), 0), F.lit("caps")),
    )
    names = rows.select("case_id", F.struct("source_id", "line_no").alias("at"), F.inline(found)).where("name <> ''")
    first = lambda k: F.min(F.when(F.col("kind") == k, F.col("at")))
    by_name = names.groupBy("case_id", "name").agg(*[first(k).alias(k) for k in ("policy", "heading", "secret", "caps")])
    concept = F.col("heading").isNotNull() | (F.col("caps").isNotNull() & (F.col("secret").isNull() | (F.col("caps") < F.col("secret"))))
    types = F.array_compact(F.array(F.when(F.col("policy").isNotNull(), "Policy"), F.when(F.col("secret").isNotNull(), "Secret"), F.when(concept, "Concept")))
    typed = by_name.select("case_id", F.explode(types).alias("type"), "name")
    return typed.select("case_id", identity("entity", F.col("type"), F.col("name"), F.lit("")).alias("entity_id"), "type", "name")


def leads(text: Column, sizes: Column) -> Column:
    """All different pieces of a text of LEAD characters, and of those smaller sizes that names have."""
    of_size = lambda k: F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{k}}}))"), 1)
    none = F.array().cast("array<string>")
    return F.array_distinct(F.concat(*[F.when(F.array_contains(sizes, k), of_size(k)).otherwise(none) for k in range(1, LEAD + 1)]))


def bullet_actions(lines: DataFrame, tokens: list[str] | None = None) -> DataFrame:
    """(case_id, action, source_id): what the bullets of each source say; with tokens, only those that hold one or a security word."""
    rows = stripped(lines).select("case_id", "source_id", lf(F.regexp_extract("line", BULLET, 1)).alias("action")).where("action <> ''")
    if tokens:
        rows = rows.where(reduce(or_, [any_of(F.lower("action"), SECURITY_WORDS), any_of(F.lower("action"), tokens)]))
    return rows.select("case_id", "action", "source_id").distinct()


def pieces(low: DataFrame, names: DataFrame) -> DataFrame:
    """(case_id, key, lead): the pieces of actions (case_id, key, low) that a name of the case (names with lead) may begin with. The marks of its names, of bounded
    number, leave out all others but a few; a case with very many names leaves out none."""
    mark = F.pmod(F.hash("lead"), F.lit(MARKS))
    sizes = names.groupBy("case_id").agg(F.collect_set(F.length("lead")).alias("sizes"), F.collect_set(mark).alias("marks"))  # LEAD and MARKS of them at most
    every = low.join(sizes, "case_id").select("case_id", "key", "marks", F.explode(leads(F.col("low"), F.col("sizes"))).alias("lead"))
    return every.where((F.size("marks") > MARKS // 2) | F.array_contains("marks", mark)).drop("marks")


def mentioned(actions: DataFrame, entities: DataFrame) -> DataFrame:
    """(case_id, action, entity_id, type, name): entities whose name stands in an action, whatever the case of letters. A name meets
    only the actions that hold its first characters; a row for each of their pieces carries the action's hash, not its text."""
    low = actions.select("case_id", "action").distinct().withColumn("low", F.lower("action")).withColumn("key", F.md5("action"))
    names = entities.select("case_id", "entity_id", "type", "name", F.lower("name").alias("low_name")).withColumn("lead", F.substring("low_name", 1, LEAD))
    near = pieces(low, names).join(names, ["case_id", "lead"]).drop("lead")
    return near.join(low, ["case_id", "key"]).where(F.contains("low", "low_name")).select("case_id", "action", "entity_id", "type", "name")


def proposed_events(actions: DataFrame, entities: DataFrame) -> DataFrame:
    """One event for each different action of a case: its type, time, objects, what it says of the state of secrets, and how many
    sources say so. What an event is follows from its action, so equal actions are one event."""
    key = ["case_id", "action"]
    sources = actions.groupBy(*key).agg(F.count("*").alias("n_evidence"))
    secret = F.when(F.col("type") == "Secret", F.col("name"))
    objects = mentioned(actions, entities).groupBy(*key).agg(F.array_sort(F.collect_set("entity_id")).alias("objects"), F.array_sort(F.collect_set(secret)).alias("secrets"))
    low = F.lower("action")
    says = F.when(any_of(low, ["never in source", "never in repo"]), "never-in-repo").when(any_of(low, ["environment only", "env-only"]), "env-only")
    instant, date = F.regexp_extract("action", INSTANT, 0), F.regexp_extract("action", DATE, 0)
    kind = F.when(instant != "", "instant").when(date != "", "date").otherwise("unknown")
    rows = sources.join(objects, key, "left").select(
        *key,
        event_type(F.col("action")).alias("type"),
        kind.alias("kind"),
        F.when(instant != "", instant).when(date != "", date).alias("value"),
        F.coalesce("objects", F.array().cast("array<string>")).alias("objects"),
        F.when((F.size("secrets") > 0) & says.isNotNull(), F.to_json(F.map_from_arrays("secrets", F.transform("secrets", lambda _: says)))).alias("state"),
        "n_evidence",
    )
    event_id = identity("event", F.col("type"), F.col("kind"), F.col("value"), F.col("action"), F.lit(""), F.array_join("objects", "|"), F.coalesce("state", F.lit("{}")))
    return rows.select("case_id", event_id.alias("event_id"), "type", "kind", "value", "action", "objects", "state", "n_evidence")
