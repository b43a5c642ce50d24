"""Repair of conversations by error-correcting Earley parsing of their roles.

A conversation's roles should read system? (user assistant)+, or be none. The grammar PRODUCTIONS is left-linear: each production is a
nonterminal that has been read, or none, and a role. So every chart item begins at the first row, and a column of the chart holds
one item for each completed nonterminal at most. From a column's items the roles that may follow are predicted; a role is scanned by keeping a row
(its role's initial fits), by giving it that role (REROLE), or without a row (INSERT); DELETE passes over a row and leaves the
item as it is. Items hold the minimum of (cost, audit), the audit being the edits' initials so far; the best completed item of the last
column is the repair. Blank and repeated rows must go, rows that end without [.!?] cost TRUNCATED more if they stay.

Two partial audits of the same rows that cost the same are never a prefix of each other, as each further insertion costs; so it is enough to
keep how the items' audits rank among each other, and where each came from. For the same reason audits of a stretch of rows can be ranked and
compared stretch by stretch. That is how a conversation of any length is parsed in many tasks: rows are sorted by ranges, cut into pieces, and
a piece that may be only part of its conversation is parsed from each item that could stand at its start. The pieces' costs and ranks are then
put together in order, and each piece is parsed once more between the items that were chosen.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import stored

#: Each: the nonterminal that is completed by a nonterminal before it ("": nothing read yet) and a role's initial.
PRODUCTIONS = [("System", "", "s"), ("Open", "", "u"), ("Open", "System", "u"), ("Turns", "Open", "a"), ("Open", "Turns", "u")]
STATES = ["", "System", "Open", "Turns"]
EXPECTS = {state: {role: head for head, before, role in PRODUCTIONS if before == state} for state in STATES}
#: Roles that may be given or inserted; what is to be inserted to get from an item to a complete conversation.
ROLES = {"u": "user", "a": "assistant"}
TAILS = {"": "", "System": "ua", "Open": "a", "Turns": ""}
DELETE, REROLE, INSERT, TRUNCATED = 4, 3, 3, 3
#: What is no word: the only white space that counts.
SPACE = " \t\n\x0b\x0c\r"
LEGAL = {"su", "ua", "au"}
#: A piece has so many rows and characters at most (but one row at least).
PIECE_ROWS, PIECE_CHARS = 1000, 1 << 20
BATCH_CHARS = 8 << 20

COUNTS = ["blank", "duplicate", "truncated"]
PIECE = f"piece bigint, open boolean, min_turn bigint, max_turn bigint, n_turns bigint, first string, last string, illegal bigint, {', '.join(f'{c} bigint' for c in COUNTS)}, cost bigint, audit string, roles array<string>, texts array<string>, copies array<bigint>, keys array<string>"


def damaged(rows: DataFrame) -> DataFrame:
    """rows with faults put in by crc32 of conv_id:turn, nulls as one space: copies is how often a row stands, 0 for one that is dropped."""
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    case = F.crc32(key.cast("binary")) % 20
    return rows.select(
        "conv_id", "turn", F.when(case == 4, "user").otherwise(role).alias("role"),
        F.when(case == 1, "").when(case == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(case == 0, 0).when(case == 3, 2).otherwise(1).cast("bigint").alias("copies"),
    )


def repair(rows: DataFrame, copies: str | None = None) -> DataFrame:
    """The repaired conversations of rows (conv_id, turn, role, text) in pieces: a piece has conv_id, piece (increasing within a conversation), open
    (other pieces may follow), the whole conversation's gaps, blank, duplicate, truncated, illegal and cost, and the piece's own audit and
    repaired rows (roles, texts).

    Rows stand in order of turn (nulls first; equal turns by a hash of role and text). Null roles and texts are one space; conversations of null id
    are one. A role of which no initial is legal, or an empty one, can't be kept as it is. copies names a column of how often a row stands; a
    conversation whose rows stand 0 times each has an empty audit. Repeated rows are added up before anything else. Other columns are left out.
    """
    n = F.lit(1) if copies is None else F.coalesce(F.col(copies), F.lit(0))
    here = n > 0
    plain = rows.select("conv_id", F.when(here, F.col("turn").cast("bigint")).alias("turn"), *[F.when(here, F.coalesce(F.col(c).cast("string"), F.lit(" "))).otherwise("").alias(c) for c in ("role", "text")], n.cast("bigint").alias("n"))
    distinct = plain.groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("copies"))
    keyed = distinct.withColumn("key", F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")))
    order = ["conv_id", "turn", "key"]
    conv = rows.schema["conv_id"].dataType.simpleString()
    sorted_rows = keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "turn", "key", "role", "text", "copies")
    pieces = stored(sorted_rows.mapInArrow(cut, f"conv_id {conv}, {PIECE}"), "pieces")

    open_ones = pieces.where("open").drop(*COUNTS, "cost", "audit")
    texts = open_ones.select("conv_id", "piece", F.explode("keys").alias("key")).distinct()
    firsts = texts.groupBy("conv_id", "key").agg(F.min("piece").alias("first_piece"), F.count("*").alias("n")).where("n > 1").select(F.col("conv_id").alias("conv"), F.col("key").alias("seen_key"), "first_piece")
    again = texts.join(firsts, F.col("conv_id").eqNullSafe(F.col("conv")) & (F.col("key") == F.col("seen_key")) & (F.col("piece") > F.col("first_piece")))
    seen = stored(again.groupBy("piece").agg(F.collect_set("key").alias("seen")), "seen")
    fed = open_ones.join(seen, "piece", "left").select("conv_id", *[c for c in open_ones.columns if c not in ("conv_id", "open")], "seen")
    spans = fed.mapInArrow(parsed_from_all, f"conv_id {conv}, piece bigint, min_turn bigint, max_turn bigint, n_turns bigint, first string, last string, illegal bigint, {', '.join(f'{c} bigint' for c in COUNTS)}, costs array<bigint>, ranks array<int>")
    routes = stored(in_order(spans).mapInArrow(put_together, f"piece bigint, start string, end string, is_last boolean, gaps bigint, {', '.join(f'{c} bigint' for c in COUNTS)}, illegal bigint, cost bigint"), "routes")
    totals = ["gaps", *COUNTS, "illegal", "cost"]
    chosen = fed.select("conv_id", "piece", "roles", "texts", "copies", "keys", "seen").join(routes, "piece")
    parts = chosen.select("conv_id", "piece", *totals, "roles", "texts", "copies", "keys", "seen", "start", "end", "is_last").mapInArrow(parsed_between, f"conv_id {conv}, piece bigint, {', '.join(f'{c} bigint' for c in totals)}, audit string, roles array<string>, texts array<string>")
    gaps = F.coalesce(F.col("max_turn") - F.col("min_turn") + 1 - F.col("n_turns"), F.lit(0))
    whole = pieces.where("NOT open").select("conv_id", "piece", F.lit(False).alias("open"), gaps.alias("gaps"), *totals[1:], "audit", "roles", "texts")
    return whole.unionByName(parts.withColumn("open", F.lit(True)))


def repaired_rows(pieces: DataFrame) -> DataFrame:
    """The repaired conversations row by row: conv_id, piece, place within the piece, role, text."""
    return pieces.select("conv_id", "piece", F.posexplode(F.arrays_zip("roles", "texts")).alias("place", "row")).select("conv_id", "piece", "place", F.col("row.roles").alias("role"), F.col("row.texts").alias("text"))


def digests(pieces: DataFrame) -> DataFrame:
    """One row for each conversation. A hash runs over a conversation's texts in order, so the pieces of one are read by one task, one after the other;
    conversations of one piece are hashed where they are."""
    totals = ["gaps", *COUNTS, "illegal", "cost"]
    lines: Column = F.array_join(F.transform(F.arrays_zip("roles", "texts"), lambda r: F.concat(r["roles"], F.lit(":"), r["texts"])), "\n")
    alone = pieces.where("NOT open").select("conv_id", *totals, "audit", F.sha2(lines, 256).alias("repaired_sha256"))
    conv = pieces.schema["conv_id"].dataType.simpleString()
    joined = in_order(pieces.where("open").select("conv_id", "piece", *totals, "audit", F.size("roles").alias("n"), lines.alias("lines")))
    return alone.unionByName(joined.mapInArrow(hashed, f"conv_id {conv}, {', '.join(f'{c} bigint' for c in totals)}, audit string, repaired_sha256 string"))


def in_order(pieces: DataFrame) -> DataFrame:
    return pieces.repartition("conv_id").sortWithinPartitions("conv_id", "piece")


class Chart:
    """The columns of a chart that begins with one completed item."""

    def __init__(self, start: str = ""):
        self.items = {start: (0, 0)}
        #: For each step what an item came from and the edits on the way; a number for rows that had to go.
        self.steps: list[int | dict[str, tuple[str, str]]] = []

    def drop(self, n: int) -> None:
        """n rows that must be deleted. Inserting just before would only make the audit greater, so items stay in order."""
        self.items = {state: (cost + n * DELETE, rank) for state, (cost, rank) in self.items.items()}
        self.steps.append(n)

    def read(self, initial: str, truncated: bool) -> None:
        offers = []
        for state, (cost, rank) in self.items.items():
            offers.append((state, cost + DELETE, (rank, "D"), state))
            at, edits = state, ""
            while len(edits) < 3:  # a third insertion would come back to where the first led
                for role, head in EXPECTS[at].items():
                    if role == initial:
                        offers.append((head, cost + TRUNCATED * truncated, (rank, edits + "K"), state))
                    elif role in ROLES:
                        offers.append((head, cost + REROLE + TRUNCATED * truncated, (rank, edits + "R"), state))
                at, cost, edits = next(head for role, head in EXPECTS[at].items() if role in ROLES), cost + INSERT, edits + "I"
        self.items, came = best(offers)
        self.steps.append({state: (before, key[1]) for state, (before, key) in came.items()})

    def edits(self, end: str) -> list[tuple[str, str]]:
        """For each step the item before it and the edits."""
        found = []
        for step in reversed(self.steps):
            if isinstance(step, int):
                found.append((end, "D" * step))
            else:
                end, letters = step[end]
                found.append((end, letters))
        return found[::-1]


def best(offers: Iterable[tuple]) -> tuple[dict, dict]:
    """Of (state, cost, key, before) the least by cost and key for each state, with the keys' ranks; and what each state came from."""
    least: dict[str, tuple] = {}
    for state, cost, key, before in offers:
        if state not in least or (cost, key) < least[state][:2]:
            least[state] = (cost, key, before)
    ranks = {key: k for k, key in enumerate(sorted({key for _, key, _ in least.values()}))}
    return {s: (cost, ranks[key]) for s, (cost, key, _) in least.items()}, {s: (before, key) for s, (_, key, before) in least.items()}


def ending(items: dict[str, tuple[int, int]]) -> tuple[str, int]:
    """The completed item that becomes a whole conversation most cheaply, and the cost with what must be inserted for that."""
    cost, _, state = min((cost + INSERT * len(TAILS[state]), rank, state) for state, (cost, rank) in items.items())
    return state, cost


def faults(texts: list[str], copies: list[int], keys: list[str], seen: set[str]) -> tuple[list[tuple[int | None, int]], dict[str, int]]:
    """What a chart reads: a row's number and whether its end is cut off, or None and how many rows must go; and the counts of faults."""
    counts, found = dict.fromkeys(COUNTS, 0), []
    for k, (text, n) in enumerate(zip(texts, copies, strict=True)):
        written = text.rstrip(SPACE)
        if not n:
            continue
        if not written:
            counts["blank"] += n
        elif keys[k] in seen:
            counts["duplicate"] += n
        else:
            seen.add(keys[k])
            cut_off = written[-1] not in ".!?"
            counts["truncated"] += cut_off
            counts["duplicate"] += n - 1
            found.append((k, cut_off))
            n -= 1
        if n:
            found.append((None, n))
    return found, counts


def charted(start: str, roles: list[str], found: list[tuple[int | None, int]]) -> Chart:
    chart = Chart(start)
    for k, what in found:
        if k is None:
            chart.drop(what)
        else:
            chart.read(roles[k][:1], bool(what))
    return chart


def rebuilt(chart: Chart, end: str, tail: str, roles: list[str], texts: list[str], found: list) -> tuple[str, list[str], list[str]]:
    """The audit and the repaired rows of a chart that ends with an item, with the roles of the tail inserted after it."""
    audit, new_roles, new_texts = [], [], []
    for (at, edits), (k, _) in zip(chart.edits(end), found, strict=True):
        audit.append(edits)
        for edit in edits.lstrip("D"):
            role = roles[k][:1] if edit == "K" else next(r for r in EXPECTS[at] if r in ROLES)
            new_roles.append(roles[k] if edit == "K" else ROLES[role])
            new_texts.append("" if edit == "I" else texts[k])
            at = EXPECTS[at][role]
    return "".join(audit) + "I" * len(tail), new_roles + [ROLES[r] for r in tail], new_texts + [""] * len(tail)


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[column.to_pylist() for column in batch.columns], strict=True)


def batched(rows: Iterable[tuple], texts: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows in batches of about BATCH_CHARS characters of the list or text at place texts."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 200 + sum(map(len, row[texts] or ()))
        if size > BATCH_CHARS:
            yield made(held, schema)
            held, size = [], 0
    if held:
        yield made(held, schema)


def made(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


LONG, TEXT, TEXTS = pa.int64(), pa.string(), pa.list_(pa.string())
SPAN = [("min_turn", LONG), ("max_turn", LONG), ("n_turns", LONG), ("first", TEXT), ("last", TEXT), ("illegal", LONG)]
COUNT_FIELDS = [(c, LONG) for c in COUNTS]
TOTAL_FIELDS = [("gaps", LONG), *COUNT_FIELDS, ("illegal", LONG), ("cost", LONG)]


def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows to pieces. A conversation that lies between others of its task in one piece is repaired at once; others stay open."""
    kinds: list[pa.DataType] = []

    def seen_types(batches):
        for batch in batches:
            kinds.append(batch.schema.field(0).type)
            yield batch

    def pieces():
        number = TaskContext.get().partitionId() << 32
        held: list[tuple] = []
        chars, alone = 0, False  # the first conversation may have begun in another task
        for row in rows_of(seen_types(batches)):
            other = held and row[0] != held[0][0]
            if other or len(held) == PIECE_ROWS or chars > PIECE_CHARS:
                yield piece_of(held, number, alone and bool(other))
                number, alone = number + 1, bool(other)
                held, chars = [], 0
            held.append(row)
            chars += len(row[4])
        if held:
            yield piece_of(held, number, False)

    rest = [("piece", LONG), ("open", pa.bool_()), *SPAN, *COUNT_FIELDS, ("cost", LONG), ("audit", TEXT), ("roles", TEXTS), ("texts", TEXTS), ("copies", pa.list_(LONG)), ("keys", TEXTS)]
    first = next(found := pieces(), None)
    if first is not None:
        yield from batched(chain_one(first, found), len(rest) - 2, pa.schema([("conv_id", kinds[0]), *rest]))


def chain_one(first: tuple, rest: Iterable[tuple]) -> Iterator[tuple]:
    yield first
    yield from rest


def piece_of(held: list[tuple], number: int, whole: bool) -> tuple:
    conv, turns, keys, roles, texts, copies = ([*x] for x in zip(*held, strict=True))
    conv = conv[0]
    known = sorted({t for t, n in zip(turns, copies, strict=True) if n and t is not None})
    initials = [role[:1] for role, n in zip(roles, copies, strict=True) if n]
    illegal = sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False)) + sum(n - 1 for n in copies if n)
    span = (known[0] if known else None, known[-1] if known else None, len(known), initials[0] if initials else None, initials[-1] if initials else None, illegal)
    if not whole:
        return (conv, number, True, *span, *[None] * len(COUNTS), None, None, roles, texts, copies, keys)
    found, counts = faults(texts, copies, keys, set())
    chart = charted("", roles, found)
    end, cost = ending(chart.items)
    return (conv, number, False, *span, *counts.values(), cost, *rebuilt(chart, end, TAILS[end], roles, texts, found), None, None)


def parsed_from_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Open pieces: costs and ranks of the best audits from each item to each; -1 where there is none."""
    for batch in batches:
        rows = []
        for conv, piece, *span, roles, texts, copies, keys, seen in rows_of([batch]):
            found, counts = faults(texts, copies, keys, set(seen or ()))
            audits = {}
            for start in STATES:
                chart = charted(start, roles, found)
                for end, (cost, _) in chart.items.items():
                    audits[start, end] = (cost, [edits for _, edits in chart.edits(end)])
            ranks = {tuple(a): k for k, a in enumerate(sorted(a for _, a in audits.values()))}
            pairs = [audits.get((start, end)) for start in STATES for end in STATES]
            rows.append((conv, piece, *span, *counts.values(), [p[0] if p else -1 for p in pairs], [ranks[tuple(p[1])] if p else -1 for p in pairs]))
        if rows:
            yield made(rows, pa.schema([("conv_id", batch.schema.field(0).type), ("piece", LONG), *SPAN, *COUNT_FIELDS, ("costs", pa.list_(LONG)), ("ranks", pa.list_(pa.int32()))]))


def put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The open pieces of a conversation in order: the items between which each is to be parsed, and the conversation's totals.

    A piece stands for up to PIECE_ROWS rows with 16 costs and ranks."""

    def routes():
        for _, pieces in groupby(rows_of(batches), key=lambda row: row[0]):
            items, steps, numbers = {"": (0, 0)}, [], []
            low = high = last = None
            turns = illegal = 0
            counts = [0] * len(COUNTS)
            for _, piece, min_turn, max_turn, n_turns, first_role, last_role, bad, *rest in pieces:
                *found, costs, ranks = rest
                counts = [a + b for a, b in zip(counts, found, strict=True)]
                turns += n_turns - (high is not None and high == min_turn)
                low, high = min_turn if low is None else low, high if max_turn is None else max_turn
                illegal += bad + (last is not None and first_role is not None and last + first_role not in LEGAL)
                last = last if last_role is None else last_role
                offers = []
                for i, start in enumerate(STATES):
                    for j, end in enumerate(STATES):
                        if start in items and costs[4 * i + j] >= 0:
                            cost, rank = items[start]
                            offers.append((end, cost + costs[4 * i + j], (rank, ranks[4 * i + j]), start))
                items, came = best(offers)
                steps.append({end: start for end, (start, _) in came.items()})
                numbers.append(piece)
            end, cost = ending(items)
            gaps = 0 if low is None else high - low + 1 - turns
            is_last = True
            for piece, step in zip(reversed(numbers), reversed(steps), strict=True):
                yield (piece, step[end], end, is_last, gaps, *counts, illegal, cost)
                end, is_last = step[end], False

    schema = pa.schema([("piece", LONG), ("start", TEXT), ("end", TEXT), ("is_last", pa.bool_()), *TOTAL_FIELDS])
    yield from batched(routes(), 1, schema)


def parsed_between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Open pieces, from the item at the start to that at the end."""
    for batch in batches:
        rows = []
        n = 1 + len(TOTAL_FIELDS)
        for conv, *head, roles, texts, copies, keys, seen, start, end, is_last in rows_of([batch]):
            found, _ = faults(texts, copies, keys, set(seen or ()))
            rows.append((conv, *head, *rebuilt(charted(start, roles, found), end, TAILS[end] if is_last else "", roles, texts, found)))
        schema = pa.schema([("conv_id", batch.schema.field(0).type), ("piece", LONG), *TOTAL_FIELDS, ("audit", TEXT), ("roles", TEXTS), ("texts", TEXTS)])
        yield from batched(rows, n + 3, schema)


def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in order: a conversation's totals, its whole audit, and the hash of its lines."""
    kinds: list[pa.DataType] = []

    def rows():
        for batch in batches:
            kinds.append(batch.schema.field(0).type)
            yield from rows_of([batch])

    def conversations():
        for conv, pieces in groupby(rows(), key=lambda row: row[0]):
            digest, audit, begun = hashlib.sha256(), [], False
            for _, _, *totals, edits, n, lines in pieces:
                audit.append(edits)
                if n:
                    digest.update(("\n" * begun + lines).encode())
                    begun = True
            yield (conv, *totals, "".join(audit), digest.hexdigest())

    first = next(found := conversations(), None)
    if first is not None:
        yield from batched(chain_one(first, found), 1 + len(TOTAL_FIELDS), pa.schema([("conv_id", kinds[0]), *TOTAL_FIELDS, ("audit", TEXT), ("repaired_sha256", TEXT)]))
