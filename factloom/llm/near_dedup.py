"""MinHash near-duplicates by a multi-index Hamming join.

A text's set of word shingles gets a signature of SYMBOLS minhashes of 8 bits each. Signatures are cut into CHUNKS chunks.
If two signatures differ in at most THRESHOLD = 2 * CHUNKS - 1 symbols, then by the pigeonhole principle some chunk differs
in at most one symbol; so each chunk is looked up under every choice of one allowed error, the symbol there left out.
All pairs within the threshold meet under such a key (pairs beyond it may), and links are confirmed on full sets.

Texts with one set are one class and are never compared. Under a key all classes are compared with one leader; then, some
times over, those outside the key's largest component with one of its members, another one under each of their keys. Of
classes that are still in different components after that, those pairs are compared that a prefix filter over their
differences from a common reference can't exclude. So comparisons don't grow with the pairs of a group, and no link is lost.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm.common import LOWER, Words, free_name, map_column, slices, stored
from factloom.llm.graph import components

CHUNK, CHUNKS = 6, 12
SYMBOLS = CHUNK * CHUNKS
THRESHOLD = 2 * CHUNKS - 1
#: Two sets are linked if 100 * shared >= SIMILARITY * all.
SIMILARITY = 80
#: How often classes are compared with a leader of each key before those left apart are compared one by one.
TURNS = 1
#: Shingles that are permuted together.
AT_ONCE = 1 << 10
_draw = np.random.default_rng(20240229)
FACTORS = _draw.integers(1, 1 << 32, (SYMBOLS, 1), dtype=np.uint32) | np.uint32(1)
SHIFTS = _draw.integers(0, 1 << 32, (SYMBOLS, 1), dtype=np.uint32)


class Shingler:
    """Sets of 64-bit hashes of word shingles."""

    def __init__(self, size: int):
        self.size, self.words = size, Words(LOWER)

    def __call__(self, text: str | None) -> np.ndarray:
        """Sorted distinct shingle hashes; with fewer words than a shingle has, the whole sequence is one; none without words."""
        h = self.words.of(text)
        if not len(h):
            return h
        n = min(self.size, len(h))
        mixed = h[: len(h) - n + 1].copy()
        for k in range(1, n):
            mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - n + 1 + k]
        return np.unique(mixed ^ (mixed >> np.uint64(29)) ^ np.uint64(n))


def signature(hashes: np.ndarray) -> np.ndarray:
    """8 bits of the least value of each of SYMBOLS permutations."""
    h = ((hashes * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)).astype(np.uint32)
    low = np.full(SYMBOLS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(h), AT_ONCE):
        x = FACTORS * h[None, at : at + AT_ONCE]
        x += SHIFTS
        np.minimum(low, x.min(1), out=low)
    return (low * np.uint32(0x9E3779B1) >> np.uint32(24)).astype(np.uint8)


def keys_of(sig: np.ndarray) -> np.ndarray:
    """Keys of signatures (rows): for each chunk and each symbol that is left out, the other symbols with their place."""
    chunks = sig.reshape(len(sig), CHUNKS, CHUNK).astype(np.int64)
    out = []
    for hole in range(CHUNK):
        rest = [k for k in range(CHUNK) if k != hole]
        value = np.zeros(chunks.shape[:2], np.int64)
        for k in rest:
            value = value << 8 | chunks[:, :, k]
        out.append(value | (np.arange(CHUNKS) * CHUNK + hole) << 8 * (CHUNK - 1))
    return np.stack(out, 2).reshape(len(sig), -1)


def sign(rows: DataFrame, shingle: int) -> DataFrame:
    """Replaces the column text with set_key (16 bytes, name the set; null if it is empty), n_shingles and signature."""

    def make():
        shingles = Shingler(shingle)

        def work(texts):
            sets = [shingles(t) for t in texts]
            names = [hashlib.md5(s.tobytes(), usedforsecurity=False).digest() if len(s) else None for s in sets]
            return names, [len(s) for s in sets], [signature(s).tobytes() if len(s) else None for s in sets]

        return work

    fields = [T.StructField("set_key", T.BinaryType()), T.StructField("n_shingles", T.LongType()), T.StructField("signature", T.BinaryType())]
    return map_column(rows, "text", fields, make, keep_column=False)


def index(classes: DataFrame, every: int = 1) -> DataFrame:
    """(key, node) for each class and key; or for one key in `every`."""

    def run(batches):
        for batch in batches:
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(batch.num_rows, SYMBOLS)
            keys = keys_of(sig)[:, ::every]
            node = batch.column(0).take(pa.array(np.repeat(np.arange(batch.num_rows), keys.shape[1])))
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), node], names=["key", "node"])

    return classes.select("node", "signature").mapInArrow(run, "key bigint, node binary")


def estimated_classes(rows: DataFrame, name_col: str, shingle: int = 5) -> DataFrame:
    """(name_col, class) for rows (name_col, text): near copies have one class, as far as signatures tell, without a look at full sets.

    Texts under a key are compared with its leader and linked if at most THRESHOLD symbols of their signatures differ; classes
    are the components. A text without words is a class of its own. This is for counting copies once where that will do.
    """
    signed = stored(sign(rows, shingle), "signatures")
    sets = signed.where("set_key is not null").groupBy(F.col("set_key").alias("node")).agg(F.min("signature").alias("signature"))
    keyed = index(sets, every=CHUNK)
    led = keyed.groupBy("key").agg(F.min("node").alias("leader"), F.count("*").alias("n")).where("n > 1").select("key", "leader")
    pairs = keyed.join(led, "key").where("leader <> node").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    x, y = (sets.select(F.col("node").alias(n), F.col("signature").alias(s)) for n, s in (("a", "x"), ("b", "y")))

    def alike(batches):
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, SYMBOLS) for k in (2, 3))
            yield batch.select([0, 1]).filter(pa.array((x != y).sum(1) <= THRESHOLD))

    links = stored(pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(alike, "a binary, b binary"), "links")
    found = stored(components(links), "components").withColumnRenamed("node", "set_key")
    named = signed.select(name_col, "set_key").join(found, "set_key", "left")
    return named.select(name_col, F.coalesce("component", "set_key", name_col).alias("class")).distinct()


def confirm(pairs: DataFrame, texts: DataFrame, shingle: int, similarity: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough; texts: (node, text)."""

    def check(batches):
        shingles = Shingler(shingle)
        last, x = None, None
        for batch in slices(batches, "y"):
            keep = []
            for a, s, t in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3)), strict=True):
                if a != last:  # rows come by a
                    last, x = a, shingles(s)
                y = shingles(t)
                both = len(np.intersect1d(x, y, assume_unique=True)) if 100 * min(len(x), len(y)) >= similarity * max(len(x), len(y)) else 0
                keep.append(100 * both >= similarity * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    left = texts.select(F.col("node").alias("a"), F.col("text").alias("x"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("y"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "x", "y").mapInArrow(check, "a binary, b binary")


def split_groups(grouped: DataFrame, found: DataFrame) -> DataFrame:
    """Of (key, node) the rows under keys whose nodes are in two components or more, with their component, the key's most
    frequent component (main) and one node of that, another under each key (leader)."""
    labelled = grouped.join(found, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
    parts = labelled.groupBy("key", "component").agg(F.count("*").alias("n"), F.min_by("node", F.xxhash64("node", "key")).alias("leader"))
    heads = parts.groupBy("key").agg(F.max_by(F.struct("component", "leader"), F.struct("n", "component")).alias("m"), F.count("*").alias("parts"))
    heads = heads.where("parts > 1").select("key", F.col("m.component").alias("main"), F.col("m.leader").alias("leader"))
    return labelled.join(heads, "key")


def differences(members: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """For members (ref, node, component): n, the size of the node's set, and away, the elements in which it differs from ref's."""

    def run(batches):
        shingles = Shingler(shingle)
        last, x = None, None
        for batch in slices(batches, "y"):
            n, away = [], []
            for ref, s, t in zip(*(batch.column(k).to_pylist() for k in (0, 3, 4)), strict=True):
                if ref != last:  # rows come by ref
                    last, x = ref, shingles(s)
                y = shingles(t)
                n.append(len(y))
                away.append(np.setxor1d(x, y, assume_unique=True).view(np.int64))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), pa.array(n, pa.int64()), pa.array(away, pa.list_(pa.int64()))], names=["ref", "node", "component", "n", "away"])

    left = texts.select(F.col("node").alias("ref"), F.col("text").alias("x"))
    right = texts.select("node", F.col("text").alias("y"))
    return members.join(right, "node").join(left, "ref").select("ref", "node", "component", "x", "y").mapInArrow(run, "ref binary, node binary, component binary, n bigint, away array<bigint>")


def from_majority(rows: DataFrame) -> DataFrame:
    """rows of differences() with away taken from the set that most of a cluster agree on, instead of ref's: what ref has for itself, or
    lacks, is no longer a difference of all the others, which share it. An element in which more than half differ from ref changes
    sides; there are fewer of these than twice the mean size of away."""
    all_of = rows.groupBy("ref").agg(F.count("*").alias("n_ref"))
    told = rows.select("ref", F.explode("away").alias("e")).groupBy("ref", "e").agg(F.count("*").alias("n_e"))
    turned = told.join(all_of, "ref").where("2 * n_e > n_ref").groupBy("ref").agg(F.collect_list("e").alias("turned"))
    away = F.when(F.col("turned").isNull(), F.col("away")).otherwise(F.concat(F.array_except("away", "turned"), F.array_except("turned", "away")))
    return rows.join(turned, "ref", "left").withColumn("away", away).drop("turned")


def close_pairs(grouped: DataFrame, texts: DataFrame, shingle: int, similarity: int) -> DataFrame:
    """Pairs (a, b) of nodes that share a key and are in different components: none is left out that is linked, and few others are in.

    Nodes that keys tie together are a cluster, and all of a cluster are described by how they differ from one set, the reference, so
    that each node is described once: |x ^ y| = |dx| + |dy| - 2 |dx & dy|. The reference is what most of the cluster have; it is found
    from the differences from the cluster's least node (ref), whose own parts would otherwise be shared by the differences of all.
    With q = (100 - similarity) / (100 + similarity), x and y are linked if that is at most q (|x| + |y|), that is, if dx and dy
    share (fx + fy) / 2 elements, where f = |d| - q n is how far a node is beyond its allowance. If fx + fy <= 0 they are linked
    anyway; then both are linked with the node of the least f, so pairs with that one will do. Otherwise elements are put in
    order, rarest first: of sets that share t elements, the first |d| - t + 1 share one. Nodes are divided by f, as t, and with
    it the number of elements under which a node is looked up, depends on both. As |x ^ y| >= ||dx| - |dy||, fy is between
    fx - 2 q |y| and fx + 2 q |x|, and only those divisions are looked up; |y| is at most |x| / similarity. Nodes of the cluster's
    largest component are not compared with each other, so elements that none of the others has are nobody's as well.
    """
    q = (100 - similarity) / (100 + similarity)
    refs = grouped.groupBy("key").agg(F.min("node").alias("b"))
    clusters = components(grouped.select("key", F.col("node").alias("a")).join(refs, "key").select("a", "b").distinct())
    members = grouped.select("node", "component").distinct().join(clusters.withColumnRenamed("component", "ref"), "node").select("ref", "node", "component")
    sizes = members.groupBy("ref", "component").count().groupBy("ref").agg(F.max_by("component", F.struct("count", "component")).alias("main"))
    far = F.size("away") - F.lit(q) * F.col("n")
    rows = stored(from_majority(stored(differences(members, texts, shingle), "differences")).withColumn("far", far - 1e-6), "differences")
    width = F.greatest(F.lit(4.0), F.max("n") / 20)
    heads = rows.groupBy("ref").agg(F.min("far").alias("nearest"), F.min_by(F.struct("node", "component"), "far").alias("head"), width.alias("width"))
    placed = rows.join(heads, "ref").join(sizes, "ref").withColumn("part", F.floor(F.col("far") / F.col("width"))).withColumn("small", F.col("component") != F.col("main"))
    linked = placed.where("far + nearest <= 0 and component <> head.component").select(F.least("node", "head.node").alias("a"), F.greatest("node", "head.node").alias("b"))
    parts = placed.groupBy("ref").agg(F.collect_set("part").alias("parts"))  # as many as the greatest difference has widths
    single = placed.select("ref", "node", "small", F.explode("away").alias("e"))
    often = single.groupBy("ref", "e").agg(F.count("*").alias("n_e"), F.count_if("small").alias("n_small")).where("n_e > 1 and n_small > 0")
    # elements that make no pair come first, and need no rows
    ordered = single.join(often, ["ref", "e"]).groupBy("ref", "node").agg(F.array_sort(F.collect_list(F.struct("n_small", "n_e", "e"))).alias("es"))
    looked = placed.select("ref", "node", "component", "small", "far", "part", "width", "n", F.size("away").alias("n_away")).join(ordered, ["ref", "node"]).join(parts, "ref")
    lowest = F.floor((F.col("far") - F.lit(2 * q * 100 / similarity) * F.col("n") - 1e-6) / F.col("width"))
    highest = F.floor((F.col("far") + F.lit(2 * q) * F.col("n") + 1e-6) / F.col("width"))

    def looked_up(other):  # the elements under which a node meets those of another part
        shared = F.greatest(F.lit(1), F.ceil((F.col("far") + other * F.col("width")) / 2))
        own = F.col("n_away") - F.size("es")
        return F.struct(other.alias("other"), F.slice("es", 1, F.greatest(F.col("n_away") - shared + 1 - own, F.lit(0)).cast("int")).alias("es"))

    near = F.filter("parts", lambda p: (p >= lowest) & (p <= highest))
    places = F.explode(F.filter(F.transform(near, looked_up), lambda p: F.size(p["es"]) > 0)).alias("p")
    keyed = looked.select("ref", "node", "component", "small", "part", places).select("ref", F.least("part", "p.other").alias("low"), F.greatest("part", "p.other").alias("high"), "part", "small", "node", "component", F.explode("p.es").alias("e"))
    keyed = stored(keyed.select("ref", "low", "high", "e.e", "part", "small", "node", "component"), "places")
    x = keyed.where("small").drop("small")
    y = keyed.withColumnsRenamed({"node": "node_2", "component": "component_2", "part": "part_2"}).drop("small")
    met = x.join(y, ["ref", "low", "high", "e"]).where("component <> component_2 and part + part_2 = low + high")
    return linked.union(met.select(F.least("node", "node_2").alias("a"), F.greatest("node", "node_2").alias("b")))


def near_duplicates(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", shingle: int = 5, similarity: int = SIMILARITY, merge_rows: bool = False) -> DataFrame:
    """docs with n_shingles (size of the set), component_id (least id reachable over links, itself included) and kept.

    kept says whether the row's id is its component's. A text without words, or null, has an empty set, is linked with
    nothing and is its own component. Links are between texts: rows with one set are one class whatever their ids, and
    rows with one id and different texts are told apart. A null id takes part, is never the least, and is kept only if its
    component has no other id. With merge_rows, of rows with one id and text one is returned. Other columns stay (columns with the three names are replaced); an empty table gives an
    empty one.
    """
    added = {"n_shingles", "component_id", "kept"}
    columns = [c for c in docs.columns if c.lower() not in added]
    text_key = F.md5(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary"))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), text_key.alias("text_key"))
    signed = stored(sign(rows, shingle), "signatures")
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "text_key", "signature")).alias("c")
    classes = signed.where("set_key is not null").groupBy(F.col("set_key").alias("node")).agg(first).select("node", "c.id", "c.text_key", "c.signature")
    keyed = index(classes)
    leaders = keyed.groupBy("key").agg(F.min("node").alias("leader"), F.count("*").alias("n")).where("n > 1").select("key", "leader")
    grouped = stored(keyed.join(leaders, "key"), "keys")
    # one text for each class that meets another; by id and text, so that copies of one text are spread
    chosen = classes.join(grouped.select("node").distinct(), "node").select("node", F.col("id").alias("c_id"), F.col("text_key").alias("c_key"))
    same = rows["id"].eqNullSafe(chosen["c_id"]) & (rows["text_key"] == chosen["c_key"])
    texts = stored(rows.join(chosen, same).dropDuplicates(["c_id", "c_key"]).select("node", "text"), "texts")

    pairs = stored(grouped.where("leader <> node").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct(), "pairs")
    links = stored(confirm(pairs, texts, shingle, similarity), "links")
    found = stored(components(links), "components")
    tried, grouped = pairs, grouped.select("key", "node")
    for turn in range(TURNS + 1):
        grouped = stored(split_groups(grouped, found), "keys")
        if grouped.isEmpty():
            break
        if turn < TURNS:
            pairs = grouped.where("component <> main").select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b"))
        else:
            pairs = close_pairs(grouped, texts, shingle, similarity)
        pairs = stored(pairs.distinct().join(tried, ["a", "b"], "left_anti"), "pairs")
        fresh = stored(confirm(pairs, texts, shingle, similarity), "links")
        if not fresh.isEmpty():
            found = stored(components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).union(fresh)), "components")
        tried, grouped = tried.union(pairs), grouped.select("key", "node")

    named = signed.where("set_key is not null").join(found.withColumnRenamed("node", "set_key"), "set_key", "left").withColumn("component", F.coalesce("component", "set_key"))
    least = named.groupBy("component").agg(F.min("id").alias("component_id"))
    key, own = free_name("text_key", docs), free_name("own", docs)
    result = named.select("text_key", "n_shingles", "component").distinct().join(least, "component").select(F.col("text_key").alias(key), F.struct("n_shingles", "component_id").alias(own))
    joined = docs.select(*[F.col(f"`{c}`") for c in columns], text_key.alias(key)).join(result, key, "left")
    if merge_rows:
        joined = joined.dropDuplicates([id_col, key])
    component = F.when(F.col(own).isNull(), F.col(f"`{id_col}`")).otherwise(F.col(f"{own}.component_id"))
    return joined.select(*[F.col(f"`{c}`") for c in columns], F.coalesce(f"{own}.n_shingles", F.lit(0)).cast("bigint").alias("n_shingles"), component.alias("component_id"), F.col(f"`{id_col}`").eqNullSafe(component).alias("kept"))
