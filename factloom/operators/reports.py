"""Deterministic texts and summaries of a case: narratives under a line budget, casefiles, repair actions."""

from __future__ import annotations

from functools import reduce

from factloom.operators import world
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BRIEF = 8


def budgeted(sections: list[tuple[str, Column]], max_lines: int) -> Column:
    """Titles with as many lines as the budget leaves after titles and gaps, first sections first; "None." for no lines."""
    left = F.lit(max(0, max_lines - (2 * len(sections) - 1)))
    parts = []
    for title, lines in sections:
        taken = F.slice(lines, 1, left) if max_lines > 0 else F.slice(lines, 1, 0)
        parts.append(F.concat(F.lit(title + "\n"), F.when(F.size(taken) > 0, F.array_join(taken, "\n")).otherwise("None.")))
        left = F.greatest(left - F.size(taken), F.lit(0))
    return F.concat_ws("\n\n", *parts)


def constraint_narrative(found: DataFrame, max_lines: int = 200, brief: int = BRIEF) -> DataFrame:
    """What is wrong with each case that has violations."""
    rank = F.row_number().over(Window.partitionBy("case_id").orderBy("type", "a", "b"))
    line = F.concat(F.lit("- "), "type", F.lit(": "), F.col("a").cast("string"), F.lit(", "), F.col("b").cast("string"))
    first = found.withColumn("rank", rank).where(f"rank <= {int(brief)}").groupBy("case_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda s: s["line"]).alias("lines"))
    rows = world.violation_counts(found).join(first, "case_id")
    say = lambda title, c: F.concat(F.lit(title + ": "), F.col(c).cast("string"))
    summary = F.array(say("Violations", "n"), say("Policy", "policy_conflict"), say("Temporal", "temporal_conflict"), say("Causal", "causal_conflict"), say("State", "state_conflict"))
    return rows.select("case_id", budgeted([("Constraint Summary", summary), ("Violations", F.col("lines"))], max_lines).alias("text"))


def casefile(events: DataFrame, edges: DataFrame, found: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Counts of what a case holds, its verdict, and the hash of both."""
    counted = [("n_events", events), ("n_entities", world.entities(events)), ("n_unknowns", world.unknowns(events)), ("n_conflicts", world.value_conflicts(events)), ("n_violations", found), ("n_edges", edges)]
    one = lambda name: [F.lit(int(n == name)).cast("bigint").alias(n) for n, _ in counted]
    rows = reduce(DataFrame.union, [df.select("case_id", *one(name)) for name, df in counted]).groupBy("case_id").agg(*[F.sum(n).alias(n) for n, _ in counted])
    rows = rows.join(verdicts, "case_id")
    fields = ["status", "n_entities", "n_events", "n_unknowns", "n_conflicts", "n_violations", "n_edges"]
    return rows.select("case_id", *fields, F.sha2(F.concat_ws("|", *[F.col(f).cast("string") for f in fields]), 256).alias("casefile_sha256"))


def repair_actions(verdicts: DataFrame) -> DataFrame:
    """What would clear a case's reasons: enrichment for missing facts, patches for violations and cycles, by priority."""
    has = lambda code: F.contains("reasons", F.lit(code))
    action = lambda kind, risk, priority: F.struct(F.lit(kind).alias("kind"), F.lit(risk).alias("risk"), F.lit(priority).cast("bigint").alias("priority"))
    failed = F.col("status") == "FAIL"
    rules = [
        ((F.col("status") == "NEEDS_INFO") & has("RULE_WORLD_UNKNOWNS_SECURITY"), action("ADD_WORLD_ENRICHMENT", "low", 10)),
        (failed & has("RULE_CONSTRAINT_VIOLATION"), action("APPLY_WORLD_PATCH", "high", 20)),
        (failed & has("RULE_CAUSAL_TEMPORAL_CYCLE"), action("APPLY_WORLD_PATCH", "high", 25)),
    ]
    return verdicts.select("case_id", F.explode(F.array_compact(F.array(*[F.when(c, a) for c, a in rules]))).alias("r")).select("case_id", "r.kind", "r.risk", "r.priority")
