"""References to evidence, carried from claims to all that rests on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.sources.shared import stored


def gathered(own: DataFrame, edges: DataFrame) -> DataFrame:
    """(claim_id, ref): the distinct references of each claim and of all claims that support or imply it, directly or not.

    own has claim_id and ref (a struct), edges a, b and type: a supports b. References go up level by level; only those that are new to a claim go
    on, so cycles end; what is new is told from what claims that something supports have, as others get nothing. They are rows and never gathered by claim: a claim on which a third of all references rest is many rows, not a long array.
    """
    steps = stored(edges.where("type IN ('supports', 'implies')").select("a", "b").distinct(), "steps")
    frontier = found = stored(own.select("claim_id", "ref").distinct(), "references")
    above = stored(steps.select(F.col("b").alias("claim_id")).distinct(), "above")
    known = stored(found.join(above, "claim_id", "left_semi"), "references")
    while not frontier.isEmpty():
        up = steps.join(frontier, steps["a"] == frontier["claim_id"]).select(F.col("b").alias("claim_id"), "ref").distinct()
        frontier = stored(up.join(known, ["claim_id", "ref"], "left_anti"), "references")
        found, known = found.union(frontier), known.union(frontier)
    return found


def counts(claims: DataFrame, refs: DataFrame) -> DataFrame:
    """(claim_id, n_refs) of each claim, 0 for those that nothing is known of."""
    return claims.select("claim_id").distinct().join(refs.groupBy("claim_id").agg(F.count("*").alias("n_refs")), "claim_id", "left").select("claim_id", F.coalesce("n_refs", F.lit(0)).alias("n_refs"))


def outside(refs: DataFrame, artifacts: DataFrame, keys: list[str]) -> DataFrame:
    """References (rows of keys and ref) to chunks that no artifact (keys, source_id, chunk_id) holds."""
    placed = refs.select("*", F.col("ref.source_id").alias("source_id"), F.col("ref.chunk_id").alias("chunk_id"))
    return placed.join(artifacts.select(*keys, "source_id", "chunk_id"), [*keys, "source_id", "chunk_id"], "left_anti").select(refs.columns)


def as_arrays(refs: DataFrame) -> DataFrame:
    """(claim_id, evidence): a claim's references as a sorted array, for claims with as many as a row can hold."""
    return refs.groupBy("claim_id").agg(F.array_sort(F.collect_list("ref")).alias("evidence"))


def text_of(ref: str = "ref"):
    """A reference as text: source, chunk, first and last place."""
    return F.concat_ws("|", *[F.col(f"{ref}.{c}").cast("string") for c in ("source_id", "chunk_id", "offset_start", "offset_end")])
