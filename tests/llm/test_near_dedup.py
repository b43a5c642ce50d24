"""Near-duplicates: what is compared at all."""

from factloom.llm import near_dedup


def test_what_the_least_node_has_alone_is_no_difference_of_others(spark, monkeypatch):
    """Copies of one text with changes of their own, too many to be linked: what the least node changed is its own difference, not that of the others."""
    text = [f"w{i}" for i in range(400)]
    places, nodes = iter(range(1, 399, 2)), [(bytes([0]), 15)] + [(bytes([i]), 12 + i % 3) for i in range(1, 14)]
    rows = []
    for node, n in nodes:
        words = list(text)
        for k, at in zip(range(n), places):
            words[at] = f"x{node[0]}_{k}"
        rows.append((1, node, node, " ".join(words)))
    all_of = spark.createDataFrame(rows, "key bigint, node binary, component binary, text string")
    kept = {}
    stored = near_dedup.stored
    monkeypatch.setattr(near_dedup, "stored", lambda df, name="graph": kept.setdefault(name, []).append(stored(df, name)) or kept[name][-1])
    pairs = near_dedup.close_pairs(all_of.drop("text"), all_of.select("node", "text"), 2, 80)
    found = {bytes(r.node): len(r.away) for r in kept["differences"][-1].collect()}
    assert found == {node: 4 * n for node, n in nodes}  # a changed word takes two shingles and brings two
    assert pairs.count() == 0
