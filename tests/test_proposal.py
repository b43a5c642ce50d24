"""Names in actions, against a look at all pairs; and how many pieces of actions are shuffled for it."""

from factloom.operators import proposal
from pyspark.sql import functions as F


def test_mentions_of_few_and_of_many_names(spark):
    names = [(1, f"e{k}", "Secret", n) for k, n in enumerate(["OBJ_1", "a", "Access Policy", "ß1"])] + [(2, f"n{k}", "Concept", f"{k * 7919 % 10007:05d}x") for k in range(3000)]
    actions = [(1, "rotated obj_1 before Access Policy 3", 0), (1, "nothing", 0), (1, "SS1 ß1", 0), (2, "it was 00000x, then 07919xx05831x", 0), (2, "", 0), (3, "OBJ_1", 0)]
    entities, said = spark.createDataFrame(names, "case_id long, entity_id string, type string, name string"), spark.createDataFrame(actions, "case_id long, action string, source_id long")
    found = {(r["case_id"], r["action"], r["entity_id"]) for r in proposal.mentioned(said, entities).collect()}
    assert found == {(c, a, e) for c, a, _ in actions for d, e, _, n in names if c == d and n.lower() in a.lower()} and len(found) > 6


def test_pieces_without_a_name_stay(spark):
    names = spark.createDataFrame([(1, "obj_1"), (1, "access p")], "case_id long, lead string")
    low = spark.range(200).select(F.lit(1).cast("long").alias("case_id"), F.col("id").cast("string").alias("key"), F.concat(F.lit("rotated obj_1 before deployment "), "id").alias("low"))
    found = proposal.pieces(low, names)
    assert found.where("lead = 'obj_1'").count() == 200
    assert found.count() < 600  # of more than 10,000
