"""op11: repairs against all sequences of edits, pieces against one chart, null and repeated rows."""

import hashlib
import random
import zlib

import duckdb
import pytest
from factloom.llm import conversations
from factloom.llm.queries import CONVERSATION_SQL, op11_conversation_repair
from pyspark.sql import functions as F

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
SPACE = " \t\n\x0b\x0c\r"


def by_enumeration(rows):
    """All of a conversation's edits, cheapest first by (cost, audit): the audit, the cost, the repaired lines."""
    seen, kinds = set(), []
    for role, text in rows:
        written = text.rstrip(SPACE)
        must_go = not written or (role, text) in seen
        seen.add((role, text))
        kinds.append((role, text, must_go, not must_go and written[-1] not in ".!?"))
    found = []

    def ok(initials):
        rest = initials[1:] if initials.startswith("s") else initials
        return initials == "" or rest != "" and len(rest) % 2 == 0 and rest == "ua" * (len(rest) // 2)

    def walk(k, cost, audit, lines, inserted):
        if cost > limit:
            return
        if k == len(kinds) and ok("".join(x[0] for x in lines if x)):
            found.append((cost, audit, lines))
        if inserted < 2:
            for role in ("user", "assistant"):
                walk(k, cost + 3, audit + "I", [*lines, f"{role}:"], inserted + 1)
        if k == len(kinds):
            return
        role, text, must_go, cut_off = kinds[k]
        walk(k + 1, cost + 4, audit + "D", lines, 0)
        if not must_go:
            walk(k + 1, cost + 3 * cut_off, audit + "K", [*lines, f"{role}:{text}"], 0)
            for new in ("user", "assistant"):
                walk(k + 1, cost + 3 + 3 * cut_off, audit + "R", [*lines, f"{new}:{text}"], 0)

    limit = 4 * len(kinds)
    walk(0, 0, "", [], 0)
    return min(found)


def test_against_enumeration(spark):
    rng = random.Random(11)
    talks = {c: [(rng.choice(["system", "user", "user", "assistant", "assistant", "tool"]), rng.choice(["Yes.", "No!", "and then", " ", "Why?", "x"])) for _ in range(rng.randrange(1, 6))] for c in range(60)}
    rows = [(c, t, role, text) for c, talk in talks.items() for t, (role, text) in enumerate(talk)]
    rng.shuffle(rows)
    found = conversations.digests(conversations.repair(spark.createDataFrame(rows, SCHEMA))).collect()
    assert len(found) == len(talks)
    for row in found:
        cost, audit, lines = by_enumeration(talks[row["conv_id"]])
        assert (row["cost"], row["audit"]) == (cost, audit), talks[row["conv_id"]]
        assert row["repaired_sha256"] == hashlib.sha256("\n".join(lines).encode()).hexdigest()


def test_long_conversation_in_pieces(spark):
    """One conversation with most rows is parsed in many pieces as in one chart; copies far apart are found."""
    rng = random.Random(5)
    texts = [f"{k}{rng.choice('.!? ')}" for k in range(1500)] + ["", "x", "same."]
    talk = [(rng.choice(["user", "assistant", "user", "assistant", "system"]), rng.choice(texts)) for _ in range(5200)]
    rows = [(7, t, *row) for t, row in enumerate(talk)] + [(c, t, "user", "Hello.") for c in (1, 9) for t in range(3)]
    pieces = conversations.repair(spark.createDataFrame(rows, SCHEMA).repartition(5))
    assert pieces.where("conv_id = 7").count() > 3
    found = {r["conv_id"]: r for r in conversations.digests(pieces).collect()}
    texts, roles = [t for _, t in talk], [r for r, _ in talk]
    steps, counts = conversations.faults(texts, [1] * len(talk), [f"{r}:{t}" for r, t in talk], set())
    chart = conversations.charted("", roles, steps)
    end, cost = conversations.ending(chart.items)
    audit, new_roles, new_texts = conversations.rebuilt(chart, end, conversations.TAILS[end], roles, texts, steps)
    lines = "\n".join(f"{r}:{t}" for r, t in zip(new_roles, new_texts, strict=True))
    assert {c: found[7][c] for c in counts} == counts
    assert (found[7]["cost"], found[7]["audit"], found[7]["repaired_sha256"]) == (cost, audit, hashlib.sha256(lines.encode()).hexdigest())
    assert found[7]["illegal"] == sum(a[0] + b[0] not in ("su", "ua", "au") for (a, _), (b, _) in zip(talk, talk[1:], strict=False))
    assert [found[c]["audit"] for c in (1, 9)] == ["KDDI", "KDDI"]
    repaired = conversations.repaired_rows(pieces).where("conv_id = 7").orderBy("piece", "place").collect()
    assert [(r["role"], r["text"]) for r in repaired] == list(zip(new_roles, new_texts, strict=True))


def test_many_copies_of_a_row(spark):
    """Repeated rows are added up, so that a conversation of one row a million times is one row."""
    rows = spark.range(1_000_000).select(F.lit(3).cast("bigint").alias("conv_id"), F.lit(0).cast("bigint").alias("turn"), F.lit("user").alias("role"), F.lit("Hi.").alias("text"))
    row = conversations.digests(conversations.repair(rows)).first()
    assert (row["duplicate"], row["illegal"], row["cost"]) == (999_999, 999_999, 4 * 999_999 + 3)
    assert row["audit"] == "K" + "D" * 999_999 + "I"


def test_nulls_and_empty_tables(spark):
    rows = [(None, None, None, None), (None, 4, "user", "A."), (None, 9, "assistant", "B."), (1, None, "user", "C"), (1, None, None, "D."), (2, 5, "", "E.")]
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", PIECE string, Open int")
    found = {r["conv_id"]: r for r in conversations.digests(conversations.repair(table)).collect()}
    assert set(found) == {None, 1, 2}
    assert (found[None]["gaps"], found[None]["blank"], found[None]["audit"]) == (4, 1, "DKK")
    assert found[1]["gaps"] == 0 and found[1]["truncated"] == 1
    assert found[2]["audit"] == "D"
    none = conversations.digests(conversations.repair(table.limit(0)))
    assert none.collect() == [] and none.columns[0] == "conv_id"
    gone = conversations.digests(conversations.repair(table.withColumn("copies", F.lit(0)), "copies")).collect()
    assert {(r["conv_id"], r["audit"], r["cost"], r["repaired_sha256"]) for r in gone} == {(c, "", 0, hashlib.sha256(b"").hexdigest()) for c in (None, 1, 2)}


def test_damage(spark):
    rows = [(c, t, "assistant", "One. Two!") for c in range(40) for t in range(3)] + [(None, 1, None, None)]
    made = {(r["conv_id"], r["turn"]): r for r in conversations.damaged(spark.createDataFrame(rows, SCHEMA)).collect()}
    for (c, t), row in made.items():
        case = zlib.crc32(f"{' ' if c is None else c}:{t}".encode()) % 20
        text = " " if c is None else "One. Two!"
        assert row["copies"] == {0: 0, 3: 2}.get(case, 1)
        assert row["text"] == ("" if case == 1 else text.replace(".", "").replace("!", "") if case == 2 else text)
        assert row["role"] == ("user" if case == 4 else " " if c is None else "assistant")


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_sql(spark, sf):
    duckdb.sql(f"CREATE OR REPLACE VIEW conversations AS SELECT * FROM '/root/testdata/{sf}/conversations.parquet'")
    relation = duckdb.sql(CONVERSATION_SQL)
    ours = op11_conversation_repair(spark, f"/root/testdata/{sf}").select(*relation.columns).collect()
    assert sorted(map(tuple, ours)) == sorted(relation.fetchall())
