"""Parties, aliases, terms and duties of contracts: a dictionary for each contract, built from its own text, is matched in its sentences.

Input is contract_id and text; each table has a row for each thing found. Only what belongs to one contract is ever together, so contracts are
spread over tasks whatever their number. Patterns are matched by the JVM.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.sources.shared import stored

#: Roles, months and the patterns that find things.
ROLES = ["licensor", "licensee", "buyer", "seller", "client", "contractor", "provider", "customer", "vendor", "company", "discloser", "recipient"]
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
DATE = rf"(?:{MONTHS})\s+\d{{1,2}},\s+\d{{4}}"
NAME = r"[A-Z][A-Za-z0-9&.,'\- ]+?"
PARTY = rf"(?iU)({NAME}),\s+a[n]?\s+[^,\n]+?\(([^)]+)\)"
ROLE_PAIR = rf"(?iU)\b({NAME})\s+as\s+({'|'.join(ROLES)})\s+and\s+({NAME})\s+as\s+({'|'.join(ROLES)})\b"
EFFECTIVE = rf"(?iU)(?:effective\s+date|entered\s+into\s+as\s+of)\W{{0,20}}({DATE})"
TERM = rf"(?isU)begin\s+on\s+((?:the\s+)?Effective Date|{DATE}).{{0,120}}?continue\s+until\s+({DATE}).{{0,80}}?for\s+([^.,]+)"
MEANS = r'(?iU)"([A-Z][A-Za-z0-9 ]+)"\s+(?:means|shall mean)\s+([^.]+)\.'
SO_CALLED = r'(?iU)([A-Za-z0-9 ,\-]+?)\s+\(the\s+"([A-Z][A-Za-z0-9 ]+)"\)'
DUTY = r"(?iU)\b(shall|must|agrees to|is required to|will)\b"
LAW = r"(?iU)(This Agreement shall be governed by the laws of ([^.]+)\.)"
ENDS = r"(?iU)\bterminate(?:d|s)?\b"
EDGES = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"
#: What a text must hold for a pattern to be tried, as the patterns that begin with a name look at each letter's line anew.
NEEDS = {PARTY: r"(?iU),\s+a[n]?\s+[^,\n]+\(", ROLE_PAIR: rf"(?iU)\s+as\s+({'|'.join(ROLES)})\s+and\s", SO_CALLED: r'(?iU)\s\(the\s+"'}
#: Up to where a text can hold matches: behind the last thing that could end one.
ENDS_WITH = {PARTY: r"(?s)^.*\)", ROLE_PAIR: rf"(?isU)^.*\sas\s+(?:{'|'.join(ROLES)})\b", SO_CALLED: r'(?s)^.*"\)'}
#: What must stand before a match: a name that begins later in a run of its characters could have begun at the run's first letter, so no other is tried.
BEGINS = {PARTY: r"(?=[A-Z])(?<![A-Z][A-Za-z0-9&.,'\- ]{0,6})", SO_CALLED: r"(?<![A-Za-z0-9 ,\-])"}
WARNINGS = ["parties_not_found", "effective_date_not_found", "term_not_found", "obligations_not_found", "defined_terms_not_found", "governing_law_not_found", "termination_conditions_not_found"]


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, EDGES, "")


def cleaned(text: Column) -> Column:
    """Trimmed, blanks and tabs collapsed; line feeds stay."""
    return F.regexp_replace(stripped(text), "[ \t]+", " ")


def normalized(text: Column) -> Column:
    """Line feeds only, straight quotes, paragraphs trimmed and joined by an empty line; null is an empty text."""
    plain = F.translate(F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n"), "“”‘’", "\"\"''")
    return F.array_join(F.filter(F.transform(F.split(plain, "\n\n"), cleaned), lambda p: p != ""), "\n\n")


def prepared(contracts: DataFrame) -> DataFrame:
    return contracts.select("contract_id", normalized(F.col("text")).alias("text"))


def quick(pattern: str) -> str:
    """The pattern, tried only where a match can begin."""
    flags, rest = re.match(r"(\(\?[a-zA-Z]+\))(.*)", pattern, re.S).groups()
    return flags + BEGINS.get(pattern, "") + rest


def matches(pattern: str, *names: str) -> Column:
    """The matches of a pattern in order: structs of its groups, named in turn. A match is found once and then taken apart."""
    text = F.regexp_extract("text", ENDS_WITH[pattern], 0) if pattern in ENDS_WITH else F.col("text")
    found = F.when(F.col("text").rlike(NEEDS.get(pattern, "")), F.regexp_extract_all(text, F.lit(quick(pattern)), 0))
    return F.transform(found, lambda m: F.struct(*[F.regexp_extract(m, pattern, k + 1).alias(name) for k, name in enumerate(names)]))


def first_of(pattern: str, group: int) -> Column:
    """Of the first match; null if there is none."""
    return F.get(F.regexp_extract_all("text", F.lit(pattern), group), 0)


def dated(text: Column) -> Column:
    """A date as `Month D, YYYY`, its month in capitals and small letters, as ISO; null for others."""
    found = [F.regexp_extract(text, rf"(?U)\b({MONTHS})\s+(\d{{1,2}}),\s+(\d{{4}})\b", k) for k in (1, 2, 3)]
    month = F.array_position(F.array(*map(F.lit, MONTHS.split("|"))), found[0])
    return F.when(month > 0, F.to_json(F.struct(found[2].cast("int").alias("y"), month.cast("int").alias("m"), found[1].cast("int").alias("d"))))


def day_of(date: Column) -> Column:
    part = lambda c: F.get_json_object(date, f"$.{c}").cast("int")
    return F.try_to_date(F.format_string("%04d-%02d-%02d", part("y"), part("m"), part("d")), "yyyy-MM-dd").cast("string")


def matched_parties(rows: DataFrame) -> DataFrame:
    """(contract_id, place, name, labels, role): the lines that introduce a party, in order, up to the first of each name that has a role: by
    its last label that is one, or by a pair `X as role and Y as role` anywhere in the text, of which the last counts."""
    name = F.regexp_replace(F.regexp_replace(cleaned(F.col("m.name")), ",+$", ""), r"(?i)^(by and between|and)\s+", "")
    lines = rows.select("contract_id", F.posexplode(matches(PARTY, "name", "labels")).alias("place", "m"))
    lines = lines.select("contract_id", "place", name.alias("name"), F.regexp_extract_all("m.labels", F.lit('"([^"]+)"'), 1).alias("labels"))
    pairs = rows.select("contract_id", F.posexplode(matches(ROLE_PAIR, "g1", "g2", "g3", "g4")).alias("place", "m"))
    sides = F.explode(F.array(*[F.struct((F.col("place") * 2 + k).alias("at"), cleaned(F.col(f"m.g{2 * k + 1}")).alias("name"), F.lower(f"m.g{2 * k + 2}").alias("paired")) for k in (0, 1)]))
    paired = pairs.select("contract_id", sides.alias("s")).groupBy("contract_id", "s.name").agg(F.max_by("s.paired", "s.at").alias("paired"))
    labelled = F.element_at(F.filter("labels", lambda x: F.lower(x).isin(ROLES)), -1)
    own = F.when(F.exists("labels", lambda x: F.lower(x).isin(ROLES)), F.lower(labelled))
    found = lines.join(paired, ["contract_id", "name"], "left").withColumn("role", F.coalesce(own, "paired"))
    settled = F.min(F.when(F.col("role").isNotNull(), F.col("place"))).over(Window.partitionBy("contract_id", "name"))
    return found.withColumn("settled", settled).where("settled IS NULL OR place <= settled").select("contract_id", "place", "name", "labels", "role")


def parties(lines: DataFrame) -> DataFrame:
    return lines.where("role IS NOT NULL").select("contract_id", "name", "role")


def aliases(lines: DataFrame) -> DataFrame:
    """(contract_id, alias, name, at): what labels call the parties; a label that comes again means the later one, at its first place."""
    labels = lines.select("contract_id", "name", "place", F.posexplode("labels").alias("k", "alias")).withColumn("at", F.struct("place", "k"))
    return labels.groupBy("contract_id", "alias").agg(F.max_by("name", "at").alias("name"), F.min("at").alias("at"))


def subjects(lines: DataFrame) -> DataFrame:
    """(contract_id, subject, name, precedence): the dictionary of a contract. Of subjects at one place names come before aliases before roles."""
    named, called = parties(lines), aliases(lines)
    by = lambda df, k, subject, order: df.select("contract_id", subject.alias("subject"), "name", F.concat(F.lit(f"{k} "), order).alias("precedence"))
    place = F.format_string("%09d %09d", "at.place", "at.k")
    return reduce(DataFrame.union, [by(named, 0, F.col("name"), F.col("name")), by(called, 1, F.col("alias"), place), by(named, 2, F.initcap("role"), F.col("name"))])


def duties(rows: DataFrame, lines: DataFrame) -> DataFrame:
    """(contract_id, offset, party, sentence): sentences with an obligation and the party that they name first, at word boundaries; offset is the
    sentence's place in the normalised text. Sentences that name no party are left out."""
    pieces = rows.select("contract_id", F.posexplode(F.regexp_extract_all("text", F.lit(r"[^.!?]+[.!?]|[.!?]"), 0)).alias("k", "piece"))
    before = Window.partitionBy("contract_id").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    placed = pieces.withColumn("offset", F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0)).cast("bigint"))
    said = placed.where(F.length("piece") > 1).select("contract_id", "offset", cleaned(F.col("piece")).alias("sentence")).where(F.col("sentence").rlike(DUTY))
    whole = F.concat(F.lit(r"(?U)\b\Q"), F.replace("subject", F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit(r"\E\b"))
    hits = said.join(subjects(lines), "contract_id").where(F.contains("sentence", F.col("subject"))).withColumn("at", F.regexp_instr("sentence", whole)).where("at > 0")
    first = hits.groupBy("contract_id", "offset", "sentence").agg(F.min_by("name", F.struct("at", "precedence")).alias("party"))
    return first.select("contract_id", "offset", "party", "sentence")


def terms(rows: DataFrame) -> DataFrame:
    """(contract_id, term, definition): `"X" means Y.` before `Y (the "X")`, of each the first in the text."""
    turned = F.transform(matches(SO_CALLED, "definition", "term"), lambda m: F.struct(m["term"].alias("term"), m["definition"].alias("definition")))
    none = F.array().cast("array<struct<term:string,definition:string>>")
    told = F.concat(matches(MEANS, "term", "definition"), F.coalesce(turned, none))
    found = rows.select("contract_id", F.posexplode(told).alias("k", "m")).select("contract_id", "k", cleaned(F.col("m.term")).alias("term"), F.regexp_replace(cleaned(F.col("m.definition")), ",+$", "").alias("definition"))
    return found.groupBy("contract_id", "term").agg(F.min_by("definition", "k").alias("definition"))


def terminations(rows: DataFrame) -> DataFrame:
    """(contract_id, position, clause): sentences on how the contract ends, each once, but for the one that gives its term."""
    clauses = F.transform(F.filter(F.regexp_extract_all("text", F.lit(r"[^.]*\."), 0), lambda s: s.rlike(ENDS)), cleaned)
    kept = F.array_distinct(F.filter(clauses, lambda c: ~F.lower(c).startswith("the term of this agreement")))
    return rows.select("contract_id", F.posexplode(kept).alias("position", "clause")).withColumn("position", F.col("position").cast("bigint"))


def facts(contracts: DataFrame) -> DataFrame:
    """A row for each contract: dates, term, law, counts and names, and warnings of what wasn't found. A date that no calendar has is an error that
    leaves everything else of that contract empty. Null and empty texts have all warnings."""
    rows = stored(prepared(contracts), "texts")
    lines = stored(matched_parties(rows), "parties")
    # the same first match is taken apart group by group, as rows of a text are few and a match is short
    effective, start, end = dated(first_of(EFFECTIVE, 1)), first_of(TERM, 1), dated(first_of(TERM, 2))
    by_effect = F.contains(F.lower("start"), F.lit("effective date"))
    read = rows.select("contract_id", "text", effective.alias("effective"), start.alias("start"), end.alias("end"), cleaned(first_of(TERM, 3)).alias("duration"), cleaned(first_of(LAW, 2)).alias("jurisdiction"), cleaned(first_of(LAW, 1)).alias("law_clause"))
    read = read.withColumn("begin", F.when(F.col("start").isNotNull() & ~by_effect, dated(F.col("start"))))
    bad = reduce(lambda a, b: a | b, [F.col(c).isNotNull() & day_of(F.col(c)).isNull() for c in ("effective", "end", "begin")])
    year_zero = reduce(lambda a, b: a | b, [F.coalesce(F.get_json_object(c, "$.y") == "0", F.lit(False)) for c in ("effective", "end", "begin")])
    dates = read.select(
        "contract_id", "text", bad.alias("bad"), year_zero.alias("year_zero"), day_of(F.col("effective")).alias("effective_date"), "jurisdiction", "law_clause", "duration", day_of(F.col("end")).alias("term_end"),
        F.when(F.col("start").isNull() | by_effect, day_of(F.col("effective"))).otherwise(day_of(F.col("begin"))).alias("term_start"),
    )
    names = parties(lines).groupBy("contract_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "name", "role"))), "; ").alias("parties"))
    count = lambda df, name: df.groupBy("contract_id").agg(F.count("*").alias(name))
    found = dates.drop("text")
    for other in (names, count(duties(rows, lines), "n_duties"), count(terms(rows), "n_terms"), count(terminations(rows), "n_terminations")):
        found = found.join(other, "contract_id", "left")
    absent = [F.col(c).isNull() for c in ("parties", "effective_date", "term_end", "n_duties", "n_terms", "law_clause", "n_terminations")]
    warnings = F.array_join(F.array_compact(F.array(*[F.when(a, w) for a, w in zip(absent, WARNINGS, strict=True)])), ",")
    fault = F.when(F.col("year_zero"), "structured_error: year 0 is out of range").when(F.col("bad"), "structured_error: day is out of range for month")
    value = lambda c: F.when(~F.col("bad"), F.col(c)).alias(c)
    number = lambda c: F.when(F.col("bad"), 0).otherwise(F.coalesce(c, F.lit(0))).cast("bigint").alias(c)
    return found.select("contract_id", *map(value, ("parties", "effective_date", "term_start", "term_end", "duration", "jurisdiction", "law_clause")), *map(number, ("n_duties", "n_terms", "n_terminations")), F.coalesce(fault, warnings).alias("warnings"))
