"""Duplicate and contradicting claims, support chains, bullets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SUPPORT_LINKS = 50


def fingerprints(claims: DataFrame) -> DataFrame:
    return claims.select("doc_id", "line_no", "claim_id", F.sha2(F.concat_ws("|", "proposition", "polarity", "modality"), 256).alias("fingerprint"))


def duplicate_groups(claims: DataFrame) -> DataFrame:
    """Claims with one fingerprint: how many, in how many documents, and the first of them. All pairs are implied, none is made."""
    found = fingerprints(claims).groupBy("fingerprint").agg(F.count("*").alias("n_claims"), F.countDistinct("doc_id").alias("n_docs"), F.min("doc_id").alias("first_doc"))
    return found.where("n_claims > 1").withColumn("n_pairs", F.expr("n_claims * (n_claims - 1) div 2"))


def duplicates(claims: DataFrame) -> DataFrame:
    """Each claim that repeats an earlier one, with the first claim of its fingerprint."""
    order = F.struct("doc_id", "line_no")
    own = fingerprints(claims)
    first = own.groupBy("fingerprint").agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1")
    repeats = own.join(first, "fingerprint").where(order > F.col("first"))
    return repeats.select("doc_id", "line_no", F.col("first.doc_id").alias("first_doc"), F.col("first.line_no").alias("first_line"))


def contradictions(claims: DataFrame) -> DataFrame:
    """Propositions that are affirmed and denied, with the counts of either side and the first claims. n_pairs is their product."""
    n = lambda p: F.count_if(F.col("polarity") == p)
    first = lambda p: F.min(F.when(F.col("polarity") == p, F.col("claim_id")))
    found = claims.groupBy("proposition").agg(n("affirm").alias("n_affirm"), n("deny").alias("n_deny"), first("affirm").alias("affirm_id"), first("deny").alias("deny_id"))
    return found.where("n_affirm > 0 and n_deny > 0").withColumn("n_pairs", F.col("n_affirm") * F.col("n_deny"))


def support_edges(claims: DataFrame, links: int = SUPPORT_LINKS) -> DataFrame:
    """A chain within each document: a claim supports the next; the first `links` of them, by definition of the chain."""
    w = Window.partitionBy("doc_id").orderBy("line_no")
    rows = claims.select("doc_id", "claim_id", F.lead("claim_id").over(w).alias("to_id"), F.row_number().over(w).alias("seq"))
    return rows.where(f"to_id is not null and seq <= {int(links)}").select("doc_id", F.col("claim_id").alias("from_id"), "to_id", "seq")


def bullet_claims(lines: DataFrame) -> DataFrame:
    """Bullets of (case_id, line_no, line) with the heading above each, "Document" before any; order counts bullets only."""
    w = Window.partitionBy("case_id").orderBy("line_no")
    heading = F.when(F.col("line").rlike("^#{1,3} "), F.trim(F.regexp_replace("line", "^#{1,3} ", "")))
    rows = lines.withColumn("subject", F.coalesce(F.last(heading, ignorenulls=True).over(w), F.lit("Document"))).where(F.col("line").rlike("^[-*] "))
    return rows.select("case_id", "subject", F.trim(F.regexp_replace("line", "^[-*] ", "")).alias("object"), (F.row_number().over(w) - 1).alias("line_order"))
