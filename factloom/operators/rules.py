"""Rules as data: a table of rules with parameters is joined to a table of facts; what holds are reasons, and reasons make verdicts.

A fact is a row of target (a claim or a case), rule_id, ref (what it is about, as text), and what the rule's parameters are held against: kind,
word, number. Another ruleset, a switched rule or another keyword is another row of the rule table; no operator changes.
"""

from __future__ import annotations

import json
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.canonical import canonical, digest

FOLDER = Path(__file__).parent.parent / "rulesets"
RULES = "ruleset_id string, ruleset_sha256 string, rule_id string, enabled boolean, params map<string,string>"
#: Reasons that fail a target, reasons that ask for information, and what the parameters are if a rule leaves them out.
FATAL = ["RULE_CONTRADICTION", "RULE_SCOPE", "RULE_CAUSAL_TEMPORAL_CYCLE", "RULE_CONSTRAINT_VIOLATION"]
ASKING = ["RULE_MIN_EVIDENCE", "RULE_WORLD_UNKNOWNS_SECURITY", "RULE_CAUSAL_NEEDS_INFO"]
SECURITY_TYPES = ["Access", "Config", "Deployment", "Leak", "PolicyChange"]
UNCONDITIONAL = "RULE_CONSTRAINT_VIOLATION"


def load(spark: SparkSession, *rulesets: str) -> DataFrame:
    """The rules of rulesets, each named by its id (a file of this package) or by a path on the driver; with the hash of the whole ruleset in
    canonical form. Values of parameters are JSON. Violations of constraints are reasons under every ruleset, so they have a row in each."""
    rows = []
    for name in rulesets:
        path = Path(name) if name.endswith(".json") else FOLDER / f"{name}.json"
        said = json.loads(path.read_text(encoding="utf-8"))
        if not isinstance(said.get("ruleset_id"), str) or not isinstance(said.get("rules"), list):
            raise ValueError(f"{path} is no ruleset")
        rules = [*said["rules"], {"rule_id": UNCONDITIONAL, "enabled": True, "params": {}}]
        rows += [(said["ruleset_id"], canonical(said), r["rule_id"], bool(r["enabled"]), {k: json.dumps(v) for k, v in r["params"].items()}) for r in rules]
    return spark.createDataFrame(rows, RULES).withColumn("ruleset_sha256", digest(F.col("ruleset_sha256")))


def fact(rows: DataFrame, rule_id: str, target: Column, ref: Column, kind: Column | None = None, word: Column | None = None, number: Column | None = None) -> DataFrame:
    none = F.lit(None)
    text = [(none if c is None else c).cast("string").alias(n) for n, c in (("kind", kind), ("word", word))]
    return rows.select(target.cast("string").alias("target"), F.lit(rule_id).alias("rule_id"), ref.cast("string").alias("ref"), *text, (none if number is None else number).cast("bigint").alias("number"))


def of_param(name: str, kind: str) -> Column:
    said = F.col("params")[name]
    return F.from_json(said, kind) if kind.startswith("array") else said.cast(kind)


def reasons(rules: DataFrame, *facts: DataFrame) -> DataFrame:
    """(ruleset_id, target, code, kind, ref), each once: facts for which an enabled rule holds.

    A rule table has a row for each rule of each ruleset, as many as people write, so it goes to every task; facts stay where they are."""
    texts = "array<string>"
    keywords, kinds, types = of_param("security_keywords", texts), of_param("unknown_kinds_for_security", texts), F.coalesce(of_param("security_event_types", texts), F.array(*map(F.lit, SECURITY_TYPES)))
    holds = {
        "RULE_MIN_EVIDENCE": F.col("number") < F.coalesce(of_param("min_evidence_count", "bigint"), F.lit(1)),
        "RULE_WORLD_UNKNOWNS_SECURITY": F.array_contains(kinds, F.col("kind")) & F.exists(keywords, lambda k: F.contains(F.lower("word"), k)),
        "RULE_CAUSAL_NEEDS_INFO": F.array_contains(types, F.col("word")),
        "RULE_SCOPE": F.coalesce(of_param("fail_on_scope_mismatch", "boolean"), F.lit(True)),
    }
    condition = reduce(lambda c, r: c.when(F.col("rule_id") == r, holds[r]), holds, F.when(F.lit(False), F.lit(True))).otherwise(True)
    found = reduce(DataFrame.union, facts).join(F.broadcast(rules.where("enabled")), "rule_id").where(condition)
    return found.select("ruleset_id", "target", F.col("rule_id").alias("code"), F.when(F.col("rule_id").isin(ASKING), F.col("kind")).alias("kind"), "ref").distinct()


def required_info(found: DataFrame) -> DataFrame:
    """(ruleset_id, target, kind, ref), each once: what would have to be known."""
    return found.where(F.col("code").isin(ASKING)).select("ruleset_id", "target", "kind", "ref").distinct()


def verdicts(rules: DataFrame, targets: DataFrame, found: DataFrame) -> DataFrame:
    """A row for each ruleset and target: VERIFIED_FAIL if a fatal reason holds, VERIFIED_NEEDS_INFO for others, VERIFIED_OK without; with the codes and the ruleset's hash."""
    by_target = found.groupBy("ruleset_id", "target").agg(F.array_sort(F.collect_set("code")).alias("codes"), F.count("*").alias("n_reasons"))
    rulesets = [F.struct(F.lit(i).alias("ruleset_id"), F.lit(h).alias("ruleset_sha256")) for i, h in sorted(map(tuple, rules.select("ruleset_id", "ruleset_sha256").distinct().collect()))]
    every = targets.select(F.col(targets.columns[0]).cast("string").alias("target")).distinct().select(F.inline(F.array(*rulesets)), "target")
    status = F.when(F.arrays_overlap("codes", F.array(*map(F.lit, FATAL))), "VERIFIED_FAIL").when(F.size("codes") > 0, "VERIFIED_NEEDS_INFO").otherwise("VERIFIED_OK")
    told = every.join(by_target, ["ruleset_id", "target"], "left")
    return told.select("ruleset_id", "ruleset_sha256", "target", status.alias("status"), F.coalesce(F.array_join("codes", ","), F.lit("")).alias("codes"), F.coalesce("n_reasons", F.lit(0)).alias("n_reasons"))
