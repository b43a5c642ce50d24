"""The events of a world that a question is about, and all that a first look at the whole world finds at odds."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.operators import causal, graph
from factloom.sources.shared import stored

#: The types of events that words of a question imply.
HINTS = {
    "access": ["Access", "PolicyChange"], "control": ["Access", "PolicyChange"], "credential": ["Access", "Config"], "secret": ["Config", "Leak", "PolicyChange"], "policy": ["PolicyChange"],
    "deploy": ["Deployment"], "deployment": ["Deployment"], "config": ["Config"], "rotation": ["Rotation"], "rotate": ["Rotation"], "leak": ["Leak"],
}
OBJECT, WORD, LABEL, IMPLIED = 5, 3, 1, 2


def tokens_of(question: str) -> list[str]:
    return sorted(set(re.findall("[a-z0-9]+", question.lower())))


def scored(events: DataFrame, entities: DataFrame, question: str) -> DataFrame:
    """events with score: for each word of the question OBJECT if it is an object's id, WORD if the event says it, LABEL if an object is called so; and
    IMPLIED if the event is of a type that the words imply."""
    asked = tokens_of(question)
    said = causal.said(F.col("action"), F.col("state"))
    words = F.concat(F.transform("objects", lambda x: F.lower(F.trim(x))), F.transform(causal.object_tokens(F.array().cast("array<string>"), said), F.lower), F.regexp_extract_all(F.lower(said), F.lit("[a-z0-9]+"), 0))
    wanted = F.array(*map(F.lit, asked)).cast("array<string>")
    named = entities.where(F.lower("name").isin(asked)).select("case_id", "entity_id", F.lower("name").alias("label"))
    labels = events.select("case_id", "event_id", F.explode("objects").alias("entity_id")).join(named, ["case_id", "entity_id"]).groupBy("case_id", "event_id").agg(F.countDistinct("label").alias("n_labels"))
    objects = F.size(F.array_intersect(wanted, F.transform("objects", lambda x: F.lower(F.trim(x)))))
    implied = F.col("type").isin(sorted({t for a in asked for t in HINTS.get(a, [])}))
    score = OBJECT * objects + WORD * F.size(F.array_intersect(wanted, words)) + LABEL * F.coalesce("n_labels", F.lit(0)) + F.when(implied, IMPLIED).otherwise(0)
    return events.join(labels, ["case_id", "event_id"], "left").withColumn("score", score.cast("bigint")).drop("n_labels")


def at_odds(events: DataFrame, entities: DataFrame) -> DataFrame:
    """(case_id, event_id) of the events of conflicts, of violations, and on cycles of what is said to come before what."""
    found = stored(causal.edges(events, entities), "edges")
    torn = causal.secret_states(events, entities).join(causal.conflicts(events, entities).select("case_id", "entity_id", "key"), ["case_id", "entity_id", "key"]).select("case_id", "event_id")
    broken = causal.violations(events, found).select("case_id", F.explode("events").alias("event_id"))
    cycles = graph.cycles(events, found.where("type = 'before'")).select("case_id", F.col("node").alias("event_id"))
    return torn.union(broken).union(cycles).distinct()


def focused(events: DataFrame, entities: DataFrame, question: str, max_chunks: int = 10, max_events: int = 30) -> DataFrame:
    """The events of each case that score best, ties by time and id, and those at odds (forced), with score and rank. A question without words is
    about all events. At most max_events are taken by score, and no more than two for each chunk that was read, but ten."""
    k = min(max_events, max(10, 2 * max_chunks))
    rank = F.row_number().over(Window.partitionBy("case_id").orderBy(F.desc("score"), F.asc_nulls_last("value"), "event_id"))
    ranked = scored(events, entities, question).withColumn("rank", rank.cast("bigint"))
    if not tokens_of(question):
        return ranked.withColumn("forced", F.lit(False))
    odd = at_odds(events, entities).withColumn("forced", F.lit(True))
    rows = ranked.join(odd, ["case_id", "event_id"], "left").withColumn("forced", F.coalesce("forced", F.lit(False)))
    return rows.where((F.col("rank") <= k) | F.col("forced"))
