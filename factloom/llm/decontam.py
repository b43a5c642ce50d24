"""Benchmark decontamination with a distributed positional inverted index.

build_index() reads the documents once and stores postings: a row for some documents of PLACES words together, with the
terms that they have, sorted, and for each term the places where it stands. find_matches() works on that table: counts of benchmark terms are
sums over its rows, and a benchmark window is looked up from its rarest term. The places in that term's list, less the
term's offset, are possible starts; they are intersected with the offset-adjusted lists of the window's other terms,
rarest first. What is left are exact phrase matches. Starts where most terms lie near their place are proximity matches;
for these a window is looked up from one rare term more than may be lost, so one of them is there.

Windows go to the tasks in blocks of BLOCK_CHARS characters of benchmark text. A larger benchmark takes more passes over the
index, never over the texts, and each pass is stored before the next, so that memory doesn't grow with the benchmark.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm.common import WORDS_ONLY, Words, free_name, map_column, release, slices, stored

WINDOW = 10
#: Words of the documents in a row of the index, gaps included; a longer document has a row of its own.
PLACES = 60_000
#: Characters of benchmark text whose windows go to the tasks at once.
BLOCK_CHARS = 2_000_000
#: Proximity: so many words may be lost from a window, and the others may be displaced by so many places; in proportion for short items.
LOST, SLOP = 2, 3
#: Places between two documents of a block; windows and what is looked at beside them reach no further.
GAP = 64
#: Postings that are looked at together.
AT_ONCE = 200_000
INDEX = "keys array<binary>, starts binary, length bigint, terms binary, counts binary, places binary"


def number_type(length: int) -> type:
    """Of counts and places in a row of the index with so many places."""
    return np.uint16 if length <= 1 << 16 else np.int32


def build_index(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The postings of docs, as a stored table with a row for some texts of a task.

    keys: md5 of each text; starts: where it begins in the row's places (int64), GAP places after the last one's end; length:
    the row's places; terms: the words' hashes, sorted (uint64); counts: how many postings each term has; places: all postings
    by term (both number_type). Null, empty and wordless texts have no postings. Texts are read whole.
    """

    def run(batches):
        words = Words(WORDS_ONLY)
        for batch in slices(batches, "t"):
            found, keys, total = [], [], 0
            for text in batch.column(0).to_pylist():
                own = words.of(text)
                if found and total + len(own) + GAP > PLACES:
                    yield postings(found, keys)
                    found, keys, total = [], [], 0
                found.append(own)
                keys.append(hashlib.md5((text or "").encode("utf-8", "surrogatepass"), usedforsecurity=False).digest())
                total += len(own) + GAP
            yield postings(found, keys)

    return stored(docs.select(F.col(f"`{text_col}`").alias("t")).mapInArrow(run, INDEX), "postings")


def postings(texts: list[np.ndarray], keys: list[bytes]) -> pa.RecordBatch:
    """A row of the index."""
    sizes = np.array([len(x) for x in texts])
    starts = GAP + np.concatenate(([0], np.cumsum(sizes + GAP)))
    terms = np.concatenate(texts)
    places = np.arange(len(terms)) + np.repeat(starts[:-1] - np.cumsum(sizes) + sizes, sizes)
    order = np.argsort(terms, kind="stable")
    terms, counts = np.unique(terms[order], return_counts=True)
    small = number_type(int(starts[-1]))
    own = [x.tobytes() for x in (starts[:-1].astype(np.int64), terms, counts.astype(small), places[order].astype(small))]
    arrays = [pa.array([keys], pa.list_(pa.binary())), pa.array([own[0]]), pa.array([int(starts[-1])], pa.int64()), *(pa.array([x]) for x in own[1:])]
    return pa.RecordBatch.from_arrays(arrays, names=["keys", "starts", "length", "terms", "counts", "places"])


class Block:
    """A row of the index."""

    def __init__(self, row: dict):
        small = number_type(row["length"])
        self.keys, self.length = row["keys"], row["length"]
        self.starts, self.terms = np.frombuffer(row["starts"], np.int64), np.frombuffer(row["terms"], np.uint64)
        self.counts, self.places = (np.frombuffer(row[c], small).astype(np.int64) for c in ("counts", "places"))
        self.firsts = np.cumsum(self.counts) - self.counts

    def among(self, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the block's terms are in the sorted vocabulary, and their numbers there."""
        at = np.searchsorted(vocabulary, self.terms)
        at[at == len(vocabulary)] = 0
        own = np.flatnonzero(vocabulary[at] == self.terms) if len(vocabulary) else np.zeros(0, np.int64)
        return own, at[own]

    def lists(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The postings of some of the block's terms, and how many each has."""
        n = self.counts[which]
        return self.places[np.repeat(self.firsts[which] - np.cumsum(n) + n, n) + np.arange(n.sum())], n


def rows_of(batches):
    for batch in batches:
        for k in range(batch.num_rows):
            yield Block(batch.slice(k, 1).to_pylist()[0])


class Windows:
    """Distinct windows of some items: their terms, rarest first, the terms' offsets, and the items that have them."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        words = Words(WORDS_ONLY)
        texts = [words.of(text) for _, text in items]
        self.items, self.window = [item for item, _ in items], window
        self.vocabulary = np.unique(np.concatenate([np.zeros(0, np.uint64), *texts]))
        rows, owners = [np.zeros((0, window), np.int64)], [np.zeros(0, np.int64)]
        for number, text in enumerate(texts):
            ids = np.searchsorted(self.vocabulary, text)
            if len(ids) >= window:
                rows.append(np.lib.stride_tricks.sliding_window_view(ids, window))
            elif len(ids):
                rows.append(np.append(ids, np.full(window - len(ids), -1))[None])
            else:
                continue
            owners.append(np.full(len(rows[-1]), number))
        self.rows, inverse = np.unique(np.concatenate(rows), axis=0, return_inverse=True)
        pairs = np.unique(np.column_stack((inverse.reshape(-1), np.concatenate(owners))), axis=0)
        self.owner, self.owned = pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(len(self.rows) + 1))

    def order(self, counts: np.ndarray) -> None:
        """Puts the terms of each window in order; counts: of the vocabulary's terms in all documents."""
        rank = np.empty(len(counts) + 1, np.int64)
        rank[np.argsort(counts, kind="stable")] = np.arange(len(counts))
        rank[-1] = len(counts)  # places beyond a short item's end come last
        order = np.argsort(rank[self.rows], axis=1, kind="stable")
        self.length = (self.rows >= 0).sum(1)
        self.terms, self.offsets = np.take_along_axis(self.rows, order, 1), order
        self.lost, self.slop = LOST * self.length // self.window, SLOP * self.length // self.window
        self.bits = np.ascontiguousarray(np.where(self.terms >= 0, bit_of(self.terms), np.uint64(0)).T)  # by turn, as they are read
        self.places = np.ascontiguousarray(self.offsets.T)
        self.rarest, self.rare = self.anchors(0), self.anchors(LOST)
        del self.rows

    def owners(self, windows: np.ndarray) -> set[int]:
        return {i for w in np.unique(windows).tolist() for i in self.owner[self.owned[w] : self.owned[w + 1]].tolist()}

    def anchors(self, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows by their rarest terms, `most` besides the first, but no more than may be lost: (window, which of its terms) by
        term; those of term t are first[t] to first[t + 1]."""
        own = [np.flatnonzero((self.lost >= j) & (self.length > j)) if j else np.arange(len(self.length)) for j in range(most + 1)]
        window, which = np.concatenate(own), np.repeat(np.arange(most + 1), [len(x) for x in own])
        order = np.argsort(self.terms[window, which], kind="stable")
        window, which = window[order], which[order]
        return window, which, np.searchsorted(self.terms[window, which], np.arange(len(self.vocabulary) + 1))

    def lookup(self, block: Block, near: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and windows of exact matches in a block, and near ones as (place of a term, window) rows."""
        by_term, turn, first = self.rare if near else self.rarest
        exact, close = [np.zeros((2, 0), np.int64)], [np.zeros((2, 0), np.int64)]
        own, terms = block.among(self.vocabulary)
        places, n = block.lists(own)
        ids = np.full(block.length, -1, np.int64)  # which term stands at a place, so that a list is intersected by a look at it
        ids[places] = np.repeat(terms, n)
        anchored = np.flatnonzero(first[terms + 1] > first[terms])
        postings, n = block.lists(own[anchored])
        low, fan = np.repeat(first[terms[anchored]], n), np.repeat((first[1:] - first[:-1])[terms[anchored]], n)
        around = bits_around(ids) if near else None
        cuts = np.searchsorted(np.cumsum(fan), np.arange(AT_ONCE, int(fan.sum()) + AT_ONCE, AT_ONCE), side="right")
        done = 0
        for to in dict.fromkeys(cuts.tolist()):
            to = max(to, done + 1)
            at, n, begin = postings[done:to], fan[done:to], low[done:to]
            done = to
            if not len(at):
                continue
            which = np.repeat(begin - np.cumsum(n) + n, n) + np.arange(n.sum())
            window, anchor, at = by_term[which], turn[which], np.repeat(at, n)
            start = at - self.offsets[window, anchor]
            whole = anchor == 0
            whole_start, whole_window = start[whole], window[whole]
            for j in range(1, self.window):
                same = (self.terms[whole_window, j] < 0) | (ids[whole_start + self.offsets[whole_window, j]] == self.terms[whole_window, j])
                whole_start, whole_window = whole_start[same], whole_window[same]
            exact.append(np.stack((whole_start, whole_window)))
            if near:
                close.append(self.nearby(ids, around, at, start, window, anchor))
        hits = np.concatenate(exact, 1)
        return hits[0], hits[1], np.concatenate(close, 1)

    def nearby(self, ids: np.ndarray, around: np.ndarray, at: np.ndarray, start: np.ndarray, window: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        """Of the possible starts, those where all but LOST terms are found at most SLOP from their places, but not all in place.

        at is where the anchor stands, which is in the text, as the start need not be; the gaps around a text are wider than a
        window and SLOP. Bits rule most starts out first."""
        lost = np.zeros(len(start), np.int8)
        for j in range(self.window):
            bits = self.bits[j].take(window)
            lost += (bits > 0) & ((around.take(start + self.places[j].take(window)) & bits) == 0)
            if j >= 2:  # with less nearly all would stay
                going = np.flatnonzero(lost <= self.lost.take(window))
                at, start, window, anchor, lost = at.take(going), start.take(going), window.take(going), anchor.take(going), lost.take(going)
        lost = np.zeros(len(start), np.int64)
        moved = np.zeros(len(start), bool)
        again = np.zeros(len(start), bool)  # found from a rarer anchor
        for j in range(self.window):
            term, place = self.terms[window, j], start + self.offsets[window, j]
            here = ids[place] == term
            beside = here.copy()
            for d in range(1, SLOP + 1):
                beside |= (d <= self.slop[window]) & ((ids[place + d] == term) | (ids[place - d] == term))
            lost += (term >= 0) & ~beside
            moved |= (term >= 0) & ~here
            again |= (j < anchor) & here
        found = moved & ~again & (lost <= self.lost[window])
        return np.stack((at[found], window[found]))


def bit_of(terms: np.ndarray) -> np.ndarray:
    """One of 64 bits for each term."""
    return np.uint64(1) << ((terms.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(58))


def bits_around(ids: np.ndarray) -> np.ndarray:
    """For each place the bits of the terms at most SLOP from it."""
    own = np.where(ids >= 0, bit_of(ids), np.uint64(0))
    out = own.copy()
    for d in range(1, SLOP + 1):
        out[d:] |= own[:-d]
        out[:-d] |= own[d:]
    return out


def term_counts(index: DataFrame, vocabulary: np.ndarray) -> np.ndarray:
    """How often each term of the vocabulary occurs in all documents: sums over the index."""
    shared = index.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches):
        total = np.zeros(len(shared.value), np.int64)
        for block in rows_of(batches):
            own, terms = block.among(shared.value)
            total[terms] += block.counts[own]
        term = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"term": pa.array(term), "n": pa.array(total[term])})

    rows = index.mapInArrow(count, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(len(vocabulary), np.int64)
    for r in rows:
        out[r["term"]] = r["n"]
    return out


def blocks_of(bench: DataFrame, text_col: str, item_col: str, block_chars: int) -> list[DataFrame]:
    """The benchmark in blocks of about block_chars characters, by a hash of the item."""
    total = bench.agg(F.sum(F.length(text_col)).alias("n")).first()["n"] or 0
    n = max(1, -(-total // block_chars))
    if n == 1:
        return [bench]
    part = F.pmod(F.xxhash64(F.col(item_col).cast("string"), text_col), F.lit(n))
    return [bench.where(part == k) for k in range(n)]


def matched(index: DataFrame, windows: Windows, near: bool) -> DataFrame:
    """(key, hits, items, near_items) for the texts of the index with a match, whole or near."""
    shared = index.sparkSession.sparkContext.broadcast(windows)

    def run(batches):
        windows = shared.value
        for block in rows_of(batches):
            at, which, close = windows.lookup(block, near)
            mine, near_mine = (np.searchsorted(block.starts, x, side="right") - 1 for x in (at, close[0] if len(close[0]) else np.zeros(0, np.int64)))
            out = [[], [], [], []]
            for d in np.union1d(mine, near_mine).tolist():
                own = mine == d
                exact = windows.owners(which[own])
                other = windows.owners(close[1][near_mine == d]) - exact
                for x, v in zip(out, (block.keys[d], merged(at[own] - block.starts[d], windows.length[which[own]]), named(windows.items, exact), named(windows.items, other)), strict=True):
                    x.append(v)
            kinds = (pa.binary(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], names=["key", "hits", "items", "near_items"])

    return index.mapInArrow(run, "key binary, hits array<bigint>, items array<string>, near_items array<string>").dropDuplicates(["key"])


def search(index: DataFrame, bench: DataFrame, text_col: str = "text", item_col: str = "item_id", window: int = WINDOW, near: bool = True, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(key, hits, items, near_items) of the texts in a stored index that match items of bench; key is the text's md5."""
    if window + SLOP > GAP:
        raise ValueError(f"a window can't have more than {GAP - SLOP} words")
    found = []
    for block in blocks_of(bench, text_col, item_col, block_chars):
        windows = Windows([(r[0], r[1]) for r in block.select(F.col(item_col).cast("string"), text_col).collect()], window)
        windows.order(term_counts(index, windows.vocabulary))
        found.append(stored(matched(index, windows, near), "matches"))
        release(index.sparkSession)
    if len(found) == 1:
        return found[0]
    both = found[0]
    for other in found[1:]:
        both = both.union(other)
    gathered = both.groupBy("key").agg(*[F.flatten(F.collect_list(c)).alias(c) for c in ("hits", "items", "near_items")])  # one row for each block at most
    items = F.array_sort(F.array_distinct("items"))
    return gathered.select("key", union_of_runs(F.col("hits")).alias("hits"), items.alias("items"), F.array_sort(F.array_except(F.array_distinct("near_items"), "items")).alias("near_items"))


def find_matches(docs: DataFrame, bench: DataFrame, text_col: str = "text", item_col: str = "item_id", window: int = WINDOW, near: bool = True, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Adds to docs: n_words, hits (array of bigint: starts and ends of matched runs of words, alternately), items (array of
    string: ids of the items with an exact match, as text, sorted) and near_items (likewise, of proximity matches only).

    An item of fewer than `window` words, but not none, is one window; windows that items share count for each of them.
    Null, empty and wordless texts match nothing; null item ids are matched but not listed. Long texts are read whole.
    Repeated rows and other columns of docs stay (columns with the four names are replaced); with an empty benchmark
    nothing matches.
    """
    added = ("hits", "items", "near_items")
    key, own = free_name("key", docs), free_name("own", docs)
    columns = [c for c in docs.columns if c.lower() not in ("n_words", *added)]
    found = search(build_index(docs, text_col), bench, text_col, item_col, window, near, block_chars).select(F.col("key").alias(key), F.struct(*added).alias(own))

    def make():
        words = Words(WORDS_ONLY)
        return lambda texts: [[words.count(t) for t in texts]]

    counted = map_column(docs.select(*[F.col(f"`{c}`") for c in columns]), text_col, [T.StructField("n_words", T.LongType())], make)
    keyed = counted.withColumn(key, F.unhex(F.md5(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary"))))
    joined = keyed.join(found, key, "left")
    none = {"hits": F.array().cast("array<bigint>")} | dict.fromkeys(("items", "near_items"), F.array().cast("array<string>"))
    return joined.select(*[F.col(f"`{c}`") for c in columns], "n_words", *[F.coalesce(F.col(f"{own}.{c}"), none[c]).alias(c) for c in added])


def union_of_runs(runs):
    """Overlapping runs (starts and ends, alternately) of several blocks as disjoint ones."""
    starts, ends = F.filter(runs, lambda _, i: i % 2 == 0), F.filter(runs, lambda _, i: i % 2 == 1)
    ordered = F.array_sort(F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("a"), b.alias("b"))))
    joined = F.aggregate(
        ordered,
        F.array().cast("array<bigint>"),
        lambda acc, p: F.when(
            (F.size(acc) > 0) & (p["a"] <= F.try_element_at(acc, F.lit(-1))),
            F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.greatest(F.try_element_at(acc, F.lit(-1)), p["b"]))),
        ).otherwise(F.concat(acc, F.array(p["a"], p["b"]))),
    )
    return joined


def merged(starts: np.ndarray, lengths: np.ndarray) -> list[int]:
    """Disjoint runs that cover the same words, as starts and ends alternately."""
    out: list[int] = []
    for a, n in sorted(zip(starts.tolist(), lengths.tolist(), strict=True)):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], a + n)
        else:
            out += [a, a + n]
    return out


def named(items: list[str | None], numbers: set[int]) -> list[str]:
    return sorted({items[i] for i in numbers if items[i] is not None})


def n_hit():
    """Words in the runs of `hits`."""
    odd = F.aggregate(F.filter("hits", lambda _, i: i % 2 == 1), F.lit(0).cast("bigint"), lambda a, x: a + x)
    even = F.aggregate(F.filter("hits", lambda _, i: i % 2 == 0), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return odd - even


def digests(matched: DataFrame) -> DataFrame:
    return matched.select(
        "doc_id",
        "n_words",
        n_hit().alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
        F.size("near_items").cast("bigint").alias("n_near_items"),
    )
