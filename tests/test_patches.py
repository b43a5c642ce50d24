"""Patches against a replay, operation by operation; worlds proposed from a literal text."""

import random

from factloom.operators import patches, proposal

FIELDS = ["case_id", "op_no", "op", "id", "type", "name", "object", "action", "from_id", "to_id"]


def replay(entities, events, relations, ops):
    """One case's world after its patch, or the first fault."""
    ents, evs, rels = dict(entities), dict(events), set(relations)
    for o in ops:
        op, i, key = o["op"], o["id"], (o["type"], o["from_id"], o["to_id"])
        fault = None
        if op not in patches.OPS:
            fault = "unsupported operation"
        elif (op in ("ADD_ENTITY", "ADD_EVENT") or (op in ("UPDATE_ENTITY", "UPDATE_EVENT") and o["type"])) and o["type"] not in (patches.ENTITY_TYPES if op.endswith("ENTITY") else patches.EVENT_TYPES):
            fault = "invalid type"
        elif op.endswith("RELATION") and o["type"] not in patches.RELATION_TYPES:
            fault = "invalid type"
        elif op == "ADD_RELATION":
            fault = "unknown id" if not all(x in ents or x in evs for x in key[1:]) else "already exists" if key in rels else None
            rels.add(key)
        elif op == "REMOVE_RELATION":
            fault = None if key in rels else "not found"
            rels.discard(key)
        else:
            table = ents if op.endswith("ENTITY") else evs
            if op.startswith("ADD"):
                fault = "already exists" if i in table else None
                table[i] = (o["type"], o["name"]) if table is ents else (o["type"], o["object"], o["action"])
            elif i not in table:
                fault = "not found"
            elif op.startswith("UPDATE"):
                said = (o["type"], o["name"]) if table is ents else (o["type"], o["object"], o["action"])
                table[i] = tuple(n if n is not None else old for n, old in zip(said, table[i], strict=True))
            elif op == "REMOVE_ENTITY" and any(e[1] == i for e in evs.values()):
                fault = "referenced by events"
            elif op == "REMOVE_ENTITY" and any(i in r[1:] for r in rels):
                fault = "referenced by relations"
            else:
                del table[i]
                if table is evs:
                    rels = {r for r in rels if i not in r[1:]}
        if fault:
            return dict(entities), dict(events), set(relations), (o["op_no"], op, fault)
    return ents, evs, rels, None


def test_patches_replayed(spark):
    draw = random.Random(5)
    base, ops, want = ([], [], []), [], {}
    for case in range(150):
        ents = {f"n{k}": (draw.choice(["Secret", "Concept"]), f"name{k}") for k in range(3)}
        evs = {f"e{k}": ("Other", draw.choice(["n0", "n1", None]), "did") for k in range(3)}
        rels = {("before", "e0", "e1"), ("after", "e2", "n2")}
        mine = []
        for n in range(draw.randint(0, 6)):
            op = draw.choice([*patches.OPS, *patches.OPS, "MERGE"]) if n else draw.choice(patches.OPS)
            o = dict.fromkeys(FIELDS) | {"case_id": case, "op_no": n * 3, "op": op}
            if op.endswith("RELATION"):
                o |= {"type": draw.choice(["before", "after", "near"]), "from_id": draw.choice(["e0", "e2", "n0", "e5"]), "to_id": draw.choice(["e1", "n2", "e0"])}
            else:
                kind = "n" if op.endswith("ENTITY") else "e"
                o["id"] = kind + str(draw.randint(3, 5) if op.startswith("ADD") else draw.randint(0, 4))
                o["type"] = draw.choice(["Secret", "Org"] if kind == "n" else ["Leak", "Other"]) if op.startswith("ADD") or draw.random() < 0.3 else None
                if draw.random() < 0.05:
                    o["type"] = "Odd" if not op.startswith("REMOVE") else None
                if not op.startswith("REMOVE"):
                    o |= {"name": draw.choice(["x", None])} if kind == "n" else {"object": draw.choice(["n0", "n2", "n4", None]), "action": draw.choice(["y", None])}
            mine.append(o)
        base[0].extend((case, k, *v) for k, v in ents.items())
        base[1].extend((case, k, *v) for k, v in evs.items())
        base[2].extend((case, *r) for r in rels)
        ops += [tuple(o[c] for c in FIELDS) for o in mine]
        want[case] = replay(ents, evs, rels, mine)
    parts = [spark.createDataFrame(rows, s) for rows, s in zip([*base, ops], ["case_id bigint, id string, type string, name string", "case_id bigint, id string, type string, object string, action string", "case_id bigint, type string, from_id string, to_id string", "case_id bigint, op_no bigint, op string, id string, type string, name string, object string, action string, from_id string, to_id string"], strict=True)]
    faults = patches.patch_faults(*parts)
    assert {tuple(r) for r in faults.collect()} == {(c, *w[3]) for c, w in want.items() if w[3]}
    assert len({w[3][2] for w in want.values() if w[3]}) == 7 and sum(not w[3] for w in want.values()) > 30
    made = [{tuple(r) for r in df.collect()} for df in patches.patched_world(*parts, faults)]
    assert made[0] == {(c, k, *v) for c, w in want.items() for k, v in w[0].items()}
    assert made[1] == {(c, k, *v) for c, w in want.items() for k, v in w[1].items()}
    assert made[2] == {(c, *r) for c, w in want.items() for r in w[2]}


def test_proposed_world(spark):
    text = ["# Access Policy", "* DB_PASS was rotated", "1. `DB_PASS` stays env-only, never in repo", "- 2024-01-02T03:04:05Z db_pass leaked, 2023-01-01", "  - on 2024-05-06 visited by K9X", "-none", "#  ", None, "- `API_KEY` environment only", "- `API_KEY` environment only"]
    lines = spark.createDataFrame([(1, 1, n, t) for n, t in enumerate(text)] + [(1, 2, 0, "- `API_KEY` environment only"), (2, 1, 0, "- DB_PASS `")], "case_id bigint, source_id bigint, line_no bigint, line string")
    entities = proposal.proposed_entities(lines)
    assert {tuple(r) for r in entities.select("case_id", "type", "name").collect()} == {(1, "Policy", "Access Policy"), (1, "Secret", "DB_PASS"), (1, "Concept", "DB_PASS"), (1, "Concept", "K9X"), (1, "Secret", "API_KEY"), (2, "Concept", "DB_PASS")}
    actions = proposal.bullet_actions(lines)
    rows = {(r["case_id"], r["action"]): (r["type"], r["kind"], r["value"], len(r["objects"]), r["state"], r["n_evidence"]) for r in proposal.proposed_events(actions, entities).collect()}
    assert rows == {
        (1, "DB_PASS was rotated"): ("Rotation", "unknown", None, 2, None, 1),
        (1, "`DB_PASS` stays env-only, never in repo"): ("Config", "unknown", None, 2, '{"DB_PASS":"never-in-repo"}', 1),
        (1, "2024-01-02T03:04:05Z db_pass leaked, 2023-01-01"): ("Leak", "instant", "2024-01-02T03:04:05Z", 2, None, 1),
        (1, "on 2024-05-06 visited by K9X"): ("Other", "date", "2024-05-06", 1, None, 1),
        (1, "`API_KEY` environment only"): ("Config", "unknown", None, 1, '{"API_KEY":"env-only"}', 2),
        (2, "DB_PASS `"): ("Other", "unknown", None, 1, None, 1),
    }
    assert {r["action"] for r in proposal.bullet_actions(lines, ["visited"]).collect()} == {"on 2024-05-06 visited by K9X", "`API_KEY` environment only"}
