"""Contracts read by patterns against a plain reading with Python's expressions; literal cases of the dictionary of a contract."""

import re
from datetime import date

import pytest
from factloom.operators import contracts
from factloom.sources.records import CONTRACTS

TEXTS = [
    *(t.replace("{s}", "Alpha Works").replace("{c}", "Beta").replace("{a}", "Alpha").replace("{b}", "Bee").replace("{d}", "March 3, 2024").replace("{e}", "March 2, 2025").replace("{n}", "Oregon").replace("{l}", "march 3, 2024") for t in CONTRACTS),
    None,
    'Al, a firm ("X", "Vendor").\nAl, a firm ("Y", "Buyer").\nBo, a firm ("X", "Seller").\nX shall go. Y must stay. Vendor will call Al. Notx shall. Bo. X must.',  # Al is settled by its first line, X moves on to Bo
    'Cy, a firm ("Q").\nCy, a firm ("R", "Client", "Buyer"). Q must, R must. Buyer must.',  # no role at first, then the last label counts
    'Di as buyer and Ed as seller agree.\nDi, a firm ("D")\nEd, a firm ("E")\nDi as client and Ed as vendor act. E shall pay D. Client shall pay Ed. Buyer shall pay.',
    'El, a firm ("Provider")... El must?! Really! provider must. Provider will.  \t Provider\tmust.',
    'Effective Date: April 31, 2023. Fy, a firm ("Buyer"). Buyer must.',
    'Starts to begin on May 1, 2020 and continue until MAY 1, 2021 for a year. entered into as of JUNE 1, 2020.',
    '"A b" means c, d,. "A b" means other. the thing, (the "A b") and  more (the "Z") . "z" Means y.',
    "Gy, a firm (“Buyer”, ‘x’). “Buyer’s” must. Buyer’s friend must. terminates terminated. Terminate it. Terminate it. The term of this Agreement terminates.",
]


def day(text):
    m = re.search(r"\b(January|February|March|April|May|June|July|August|September|October|November|December)\s+(\d{1,2}),\s+(\d{4})\b", text or "")
    return date(int(m[3]), contracts.MONTHS.split("|").index(m[1]) + 1, int(m[2])).isoformat() if m else None


def clean(text):
    return re.sub("[ \t]+", " ", text.strip())


def read(text):
    for a, b in ("\r\n", "\n"), ("\r", "\n"), ("“", '"'), ("”", '"'), ("‘", "'"), ("’", "'"):
        text = (text or "").replace(a, b)
    text = "\n\n".join(p for p in map(clean, text.split("\n\n")) if p)
    python = lambda p: re.sub(r"^\(\?(\w+)U\)", r"(?\1)", p)
    paired, parties, called = {}, {}, {}
    for m in re.finditer(python(contracts.ROLE_PAIR), text):
        paired[clean(m[1])], paired[clean(m[3])] = m[2].lower(), m[4].lower()
    for m in re.finditer(python(contracts.PARTY), text):
        name = re.sub(r"(?i)^(by and between|and)\s+", "", clean(m[1]).rstrip(","))
        if name in parties:
            continue
        labels = re.findall('"([^"]+)"', m[2])
        called.update(dict.fromkeys(labels, name))
        role = next((x.lower() for x in reversed(labels) if x.lower() in contracts.ROLES), paired.get(name))
        if role:
            parties[name] = role
    known = [(n, n) for n in sorted(parties)] + list(called.items()) + [(parties[n].title(), n) for n in sorted(parties)]
    duties = []
    for m in re.finditer(r"[^.!?]+[.!?]", text):
        said = clean(m[0])
        hits = [(h.start(), k, name) for k, (subject, name) in enumerate(known) if (h := re.search(rf"\b{re.escape(subject)}\b", said))]
        if hits and re.search(python(contracts.DUTY), said):
            duties.append((m.start(), min(hits)[2], said))
    terms = {}
    for p, t, d in (contracts.MEANS, 1, 2), (contracts.SO_CALLED, 2, 1):
        for m in re.finditer(python(p), text):
            terms.setdefault(clean(m[t]), clean(m[d]).rstrip(","))
    ends = [c for c in map(clean, re.findall(r"[^.]*\bterminate(?:d|s)?\b[^.]*\.", text, re.I)) if not c.lower().startswith("the term of this agreement")]
    facts = {}
    try:
        m = re.search(python(contracts.EFFECTIVE), text)
        facts["effective_date"] = day(m[1]) if m else None
        m = re.search(python(contracts.TERM), text)
        facts["term_start"] = facts["effective_date"] if not m or "effective date" in m[1].lower() else day(m[1])
        facts["term_end"], facts["duration"] = (day(m[2]), clean(m[3])) if m else (None, None)
    except ValueError:
        facts = None
    return parties, called, duties, terms, list(dict.fromkeys(ends)), facts


@pytest.fixture(scope="module")
def tables(spark):
    table = spark.createDataFrame(list(enumerate(TEXTS)), "contract_id bigint, text string").repartition(3)
    rows = contracts.prepared(table)
    lines = contracts.matched_parties(rows)
    found = {"parties": contracts.parties(lines), "aliases": contracts.aliases(lines), "duties": contracts.duties(rows, lines), "terms": contracts.terms(rows), "ends": contracts.terminations(rows), "facts": contracts.facts(table)}
    return {name: df.collect() for name, df in found.items()}


@pytest.mark.parametrize("k", range(len(TEXTS)))
def test_against_plain_reading(tables, k):
    parties, called, duties, terms, ends, facts = read(TEXTS[k])
    of = {name: [r for r in rows if r["contract_id"] == k] for name, rows in tables.items()}
    assert {r["name"]: r["role"] for r in of["parties"]} == parties
    assert {r["alias"]: r["name"] for r in of["aliases"]} == called
    assert sorted((r["offset"], r["party"], r["sentence"]) for r in of["duties"]) == duties
    assert {r["term"]: r["definition"] for r in of["terms"]} == terms
    assert [r["clause"] for r in sorted(of["ends"], key=lambda r: r["position"])] == ends
    (row,) = of["facts"]
    if facts is None:
        assert row["warnings"] == "structured_error: day is out of range for month" and row["parties"] is None and row["n_duties"] == 0
    else:
        assert {c: row[c] for c in facts} == facts
        assert ("parties_not_found" in row["warnings"], "obligations_not_found" in row["warnings"], "term_not_found" in row["warnings"].split(",")) == (not parties, not duties, facts["term_end"] is None)


def test_precedence(tables):
    duties = {r["sentence"]: r["party"] for r in tables["duties"] if r["contract_id"] == 8}
    assert (duties["X shall go."], duties["Vendor will call Al."]) == ("Bo", "Al")
    assert "Y must stay." not in duties  # its line comes after Al is settled


def test_names_begin_at_the_first_letter_of_a_run(spark):
    """Patterns that try a run's first letter only find what they would find if they tried each letter."""
    import random

    from pyspark.sql import functions as F

    pieces = ["Ann Co", "7", " ", ", a firm (", ", an ", '")', "x", "ſ", "é", "\n", ".", "('A')", ' (the "Goods")', "(", ")", "  ", " 12 345 678 9 ", "-", "'", "and B", "\t", ", a  big co(x", "K.", '"']
    draw = random.Random(5)
    texts = spark.createDataFrame([(k, "".join(draw.choices(pieces, k=draw.randint(1, 14)))) for k in range(4000)], "id bigint, text string")
    for before in (contracts.PARTY, contracts.SO_CALLED):
        new = contracts.quick(before)
        assert new != before
        pairs = texts.select("text", *[F.regexp_extract_all("text", F.lit(p), 0).alias(n) for p, n in ((new, "x"), (before, "y"))])
        assert pairs.where(F.size("y") > 0).count() > 200
        assert pairs.where("x <> y").limit(3).collect() == []
