"""References that go up: cycles, claims with references of their own, and what is shuffled for it."""

from factloom.operators import references
from factloom.sources.records import REFERENCE


def test_claims_above_with_their_own(spark):
    def ref(k):
        return (f"s{k}", "c", k, k + 1, "h")

    own = spark.createDataFrame([("a", ref(1)), ("a", ref(2)), ("b", ref(2)), ("c", ref(3)), ("z", ref(9))], f"claim_id string, ref {REFERENCE}")
    edges = spark.createDataFrame([("a", "b", "supports"), ("b", "c", "implies"), ("c", "b", "supports"), ("a", "z", "contradicts")], "a string, b string, type string")
    found = sorted((r["claim_id"], r["ref"]["offset_start"]) for r in references.gathered(own, edges).collect())
    assert found == [("a", 1), ("a", 2), ("b", 1), ("b", 2), ("b", 3), ("c", 1), ("c", 2), ("c", 3), ("z", 9)]
