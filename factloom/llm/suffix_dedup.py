"""Removal of repeated byte strings by sorting sampled suffixes.

A string of LENGTH bytes is removed wherever it stands if it starts anywhere else, too. To find such strings, suffixes are
sorted only at sampled places, chosen so that two equal strings are always sampled at the same place within them, which is
what a difference cover does. Here the cover is chosen by content: in each string, the 32-byte piece with the least hash
(the last such) is sampled. A string is then known by its sampled place, what stands to the right of it, and what stands
to the left of it. Sampled suffixes are sorted to the right and to the left, adjacent ones are compared for their common
prefixes, and strings are named by the ranks of their two parts.

Sampled places whose piece occurs once need no sorting, and those with equal surroundings are sorted as one; both are
found by grouping hashes of the pieces and the surroundings. So only few bytes are shuffled. Each string has one sampled
place; a place's repeated strings all hold its piece, so that what they cover is one run, known by the first and last.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm.common import free_name, join_hot, map_column, release, slices, stored

LENGTH, PIECE = 200, 32
#: Pieces in a string, and strings that are looked at together in a long text.
PIECES, AT_ONCE = LENGTH - PIECE + 1, 1 << 19
#: A piece with more different surroundings than this is not sorted in one task: its strings are counted by their hashes.
HOT = 100_000
_draw = np.random.default_rng(20240301)
BYTE = _draw.integers(1, 1 << 63, 256, dtype=np.uint64)
BASE = np.uint64(0xD6E8FEB86659FD93)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
SPAN = AT_ONCE + LENGTH


def _powers(base: np.uint64) -> np.ndarray:
    out = np.full(SPAN + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


class Hasher:
    """Hashes of ranges of up to SPAN bytes."""

    up, down = _powers(BASE), _powers(INVERSE)

    def __init__(self, data: np.ndarray):
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTE[data] * self.up[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self.sums[end] - self.sums[start]) * self.down[start]
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
        return h ^ (h >> np.uint64(29))


def sample(data: np.ndarray) -> dict[str, np.ndarray]:
    """Sampled places of a text: where (place), the hash of the piece there, the least and greatest distance (low, high) from a
    string's start to its sampled place there, and the hash of the bytes that those strings cover (around)."""
    found = []
    for first in range(0, len(data) - LENGTH + 1, AT_ONCE):
        own = data[first : first + SPAN - 1]
        hasher = Hasher(own)
        starts = np.arange(len(own) - PIECE + 1)
        value = hasher.of(starts, starts + PIECE)
        least, where, width = value, starts, 1
        while width < PIECES:  # least piece, and the last place of it, in runs of width pieces
            step = min(width, PIECES - width)
            right = least[step:] <= least[:-step]
            least, where = np.where(right, least[step:], least[:-step]), np.where(right, where[step:], where[:-step])
            width += step
        edge = np.flatnonzero(np.diff(where)) + 1
        begin, end = np.concatenate(([0], edge)), np.concatenate((edge, [len(where)])) - 1
        place = where[begin]
        around = hasher.of(begin, end + LENGTH)
        found.append((place + first, value[place].view(np.int64), place - end, place - begin, around.view(np.int64)))
    if not found:
        found = [(np.zeros(0, np.int64),) * 5]
    return dict(zip(("place", "piece", "low", "high", "around"), map(np.concatenate, zip(*found, strict=True)), strict=True))


def text_bytes(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)


PLACE = ["place", "piece", "low", "high", "around"]


def sampled(rows: DataFrame, pieces_only: bool) -> DataFrame:
    """Sampled places of all texts of rows (row, text); or only the hashes of their pieces."""

    def run(batches):
        for batch in slices(batches, "text"):
            row, made = [], []
            for r, text in enumerate(batch.column(1).to_pylist()):
                places = sample(text_bytes(text))
                row.append(np.full(len(places["place"]), r))
                made.append(places)
            columns = {c: np.concatenate([m[c] for m in made]) for c in PLACE}
            if pieces_only:
                yield pa.RecordBatch.from_pydict({"piece": pa.array(columns["piece"])})
                continue
            arrays = [batch.column(0).take(pa.array(np.concatenate(row)))]
            arrays += [pa.array(columns[c].astype(np.int16)) if c in ("low", "high") else pa.array(columns[c]) for c in PLACE]
            yield pa.RecordBatch.from_arrays(arrays, names=["row", *PLACE])

    return rows.mapInArrow(run, "piece bigint" if pieces_only else "row binary, place bigint, piece bigint, low smallint, high smallint, around bigint")


def common_prefixes(rows: np.ndarray, lengths: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorts byte strings (rows of a matrix, filled up with zeros) within groups. Returns the order and how many bytes each has in
    common with the one before it, none across groups."""
    order = np.lexsort((lengths, np.ascontiguousarray(rows).view(f"S{rows.shape[1]}").ravel(), groups))  # a row that ends goes before one with zeros there
    sorted_rows, n = rows[order], lengths[order]
    common = np.zeros(len(order), np.int64)
    for at in range(1, len(order), 1 << 15):
        to = min(len(order), at + (1 << 15))
        differ = sorted_rows[at:to] != sorted_rows[at - 1 : to - 1]
        first = np.where(differ.any(1), differ.argmax(1), rows.shape[1])
        common[at:to] = np.minimum(first, np.minimum(n[at:to], n[at - 1 : to - 1]))
    g = groups[order]
    common[1:][g[1:] != g[:-1]] = -1
    common[:1] = -1
    return order, common


def repeated_strings(groups: np.ndarray, low: np.ndarray, high: np.ndarray, around: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For different surroundings of sampled places (groups: of one piece): the least and greatest distance of a string that
    another surrounding has as well; -1 if there is none."""
    n = len(groups)
    left, right = np.zeros((n, PIECES), np.uint8), np.zeros((n, LENGTH), np.uint8)
    for k, data in enumerate(around):
        data = np.frombuffer(data, np.uint8)
        left[k, : high[k]] = data[: high[k]][::-1]
        right[k, : len(data) - high[k]] = data[high[k] :]
    left_order, left_common = common_prefixes(left, high, groups)
    right_order, right_common = common_prefixes(right, LENGTH - low, groups)
    least, most = np.full(n, -1), np.full(n, -1)
    for distance in range(int(low.min()), int(high.max()) + 1):
        names = np.empty((2, n), np.int64)
        names[0, left_order] = np.cumsum(left_common < distance)  # equal for those with equal parts of this length
        names[1, right_order] = np.cumsum(right_common < LENGTH - distance)
        has = np.flatnonzero((low <= distance) & (distance <= high))
        if len(has) < 2:
            continue
        _, inverse, count = np.unique(names[0, has] * (n + 1) + names[1, has], return_inverse=True, return_counts=True)
        hit = has[count[inverse] > 1]
        most[hit] = distance
        least[hit[least[hit] < 0]] = distance
    return least, most


KINDS = ["piece", "low", "high", "around"]


def sort_kinds(texts: DataFrame) -> DataFrame:
    """Rows (text, wanted: array of (piece, low, high, around, place)) -> (piece, low, high, around, data), data being the bytes."""

    def run(batches):
        for batch in slices(batches, "text"):
            out = [[] for _ in range(5)]
            for text, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = (text or "").encode("utf-8", "surrogatepass")
                for w in wanted:
                    for k, c in enumerate(KINDS):
                        out[k].append(w[c])
                    out[4].append(data[w["place"] - w["high"] : w["place"] - w["low"] + LENGTH])
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int16(), pa.int16(), pa.int64(), pa.binary()), strict=True)], names=[*KINDS, "data"])

    return texts.mapInArrow(run, "piece bigint, low smallint, high smallint, around bigint, data binary")


def compare_kinds(kinds: DataFrame) -> DataFrame:
    """(piece, low, high, around, least, most) of the kinds with a repeated string; rows of a piece come together."""
    schema = "piece bigint, low smallint, high smallint, around bigint, least smallint, most smallint"

    def settle(table):
        groups, low, high = (table.column(c).to_numpy().astype(np.int64) for c in ("piece", "low", "high"))
        least, most = repeated_strings(groups, low, high, table.column("data").to_pylist())
        made = table.select(KINDS).append_column("least", pa.array(least.astype(np.int16))).append_column("most", pa.array(most.astype(np.int16)))
        return made.filter(pa.array(most >= 0)).combine_chunks().to_batches()

    def run(batches):
        held, size = [], 0
        for batch in batches:  # whole pieces are compared as soon as enough rows are there
            held.append(batch)
            size += batch.num_rows
            if size >= HOT:
                table = pa.Table.from_batches(held)
                piece = table.column("piece").to_numpy()
                whole = int(np.searchsorted(piece, piece[-1]))
                if whole:
                    yield from settle(table.slice(0, whole))
                    held, size = table.slice(whole).to_batches(), len(piece) - whole
        if size:
            yield from settle(pa.Table.from_batches(held))

    return kinds.mapInArrow(run, schema)


def count_hot(kinds: DataFrame) -> DataFrame:
    """As compare_kinds, for pieces with very many kinds: the strings of each kind are counted by two hashes of each."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                data = np.frombuffer(row["data"], np.uint8)
                distance = np.arange(row["low"], row["high"] + 1)
                start = row["high"] - distance
                one, two = Hasher(data).of(start, start + LENGTH), Hasher(data ^ np.uint8(0x5A)).of(start, start + LENGTH)
                n = len(distance)
                arrays = [pa.array([row[c]] * n, t) for c, t in zip(KINDS, (pa.int64(), pa.int16(), pa.int16(), pa.int64()), strict=True)]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(distance.astype(np.int16)), pa.array(one.view(np.int64)), pa.array(two.view(np.int64))], names=[*KINDS, "distance", "one", "two"])

    strings = kinds.mapInArrow(run, "piece bigint, low smallint, high smallint, around bigint, distance smallint, one bigint, two bigint")
    key = ["piece", "distance", "one", "two"]
    often = strings.groupBy(*key).count().where("count > 1").select(*key)
    return strings.join(often, key).groupBy(*KINDS).agg(F.min("distance").alias("least"), F.max("distance").alias("most"))


def covered_runs(rows: DataFrame) -> DataFrame:
    """For rows (row, text): (row, runs), runs being pairs (from, to) of bytes of that text which a repeated string covers."""
    repeated = stored(sampled(rows, True).groupBy("piece").agg(F.count("*").alias("n")).where("n > 1"), "pieces")
    release(rows.sparkSession)
    places = stored(sampled(rows, False).join(repeated.select("piece"), "piece"), "places")
    release(rows.sparkSession)
    kinds = stored(places.groupBy(*KINDS).agg(F.count("*").alias("n"), F.min(F.struct("row", "place")).alias("at")), "kinds")
    several = kinds.groupBy("piece").agg(F.count("*").alias("n_kinds")).where("n_kinds > 1")
    # kinds with one place only, of pieces with several kinds, must be compared; the others of those pieces are what they are compared with
    compared = kinds.join(several, "piece")
    wanted = compared.groupBy(F.col("at.row").alias("row")).agg(F.collect_list(F.struct(*KINDS, F.col("at.place").alias("place"), "n_kinds")).alias("wanted"))
    data = stored(sort_kinds(rows.join(wanted, "row").dropDuplicates(["row"]).select("text", "wanted")).join(several.withColumnRenamed("n_kinds", "m"), "piece"), "surroundings")
    release(rows.sparkSession)
    few = data.where(F.col("m") <= HOT).drop("m").repartition("piece").sortWithinPartitions("piece")
    alike = compare_kinds(few).union(count_hot(data.where(F.col("m") > HOT).drop("m")))
    whole = kinds.where("n > 1").select(*KINDS, F.col("low").alias("least"), F.col("high").alias("most"))
    merged = whole.union(alike).groupBy(*KINDS).agg(F.min("least").alias("least"), F.max("most").alias("most"))
    found = stored(merged.join(kinds.select(*KINDS, "n"), KINDS), "found")
    runs = join_hot(places, found, KINDS, "n").select("row", (F.col("place") - F.col("most")).alias("a"), (F.col("place") - F.col("least") + LENGTH).alias("b"))
    out = stored(runs.distinct().groupBy("row").agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("runs")), "runs")
    release(rows.sparkSession)
    return out


def remove_repeats(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Adds n_bytes, n_removed, n_spans (bigint), spans (array of bigint: starts and ends of removed runs of bytes, alternately)
    and kept_bytes (binary: the other bytes, concatenated) to docs; columns with these names are replaced.

    Texts are UTF-8 bytes, null is empty. Strings are judged on the input, in all rows; repeated rows repeat each other's
    strings. Texts shorter than LENGTH bytes stay whole. Long texts are handled whole, in overlapping parts. Other columns
    stay; an empty table gives an empty one.
    """
    added = {"n_bytes", "n_removed", "n_spans", "spans", "kept_bytes"}
    columns = [c for c in docs.columns if c.lower() not in added]
    text_hash = F.md5(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary"))
    row = F.unhex(F.md5(F.concat(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("null")), F.lit(" "), text_hash).cast("binary")))
    row_name, both = free_name("row", docs), free_name("both", docs)
    runs_name = free_name("runs", docs)
    runs = covered_runs(docs.select(row.alias("row"), F.col(f"`{text_col}`").alias("text")))
    joined = docs.select(*[F.col(f"`{c}`") for c in columns], row.alias(row_name)).join(runs.withColumnsRenamed({"row": row_name, "runs": runs_name}), row_name, "left")
    flat = F.flatten(F.transform(runs_name, lambda r: F.array(r["a"], r["b"])))
    packed = F.struct(F.col(f"`{text_col}`").alias("text"), F.coalesce(flat, F.array().cast("array<bigint>")).alias("runs")).alias(both)

    def work(rows):
        out = [[], [], [], [], []]
        for r in rows:
            data = text_bytes(r["text"])
            edges = np.array(r["runs"], np.int64).reshape(-1, 2)
            spans: list[int] = []
            for a, b in edges.tolist():
                if spans and a <= spans[-1]:
                    spans[-1] = max(spans[-1], b)
                else:
                    spans += [a, b]
            cuts = [0, *spans, len(data)]
            kept = b"".join(data[cuts[k] : cuts[k + 1]].tobytes() for k in range(0, len(cuts), 2))
            for x, v in zip(out, (len(data), len(data) - len(kept), len(spans) // 2, spans, kept), strict=True):
                x.append(v)
        return out

    fields = [T.StructField(n, T.LongType()) for n in ("n_bytes", "n_removed", "n_spans")] + [T.StructField("spans", T.ArrayType(T.LongType())), T.StructField("kept_bytes", T.BinaryType())]
    return map_column(joined.select(*[F.col(f"`{c}`") for c in columns], packed), both, fields, lambda: work, keep_column=False)


def digests(removed: DataFrame) -> DataFrame:
    return removed.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept_bytes", 256).alias("kept_sha256"))
