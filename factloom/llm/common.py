"""Helpers that the text operators share."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.sources.shared import shared_folder, stored  # noqa: F401  (the operators take them from here)

#: Bytes of text that a Python worker holds at once, whatever the size of Arrow's batches.
SLICE_BYTES = 16 << 20
#: Words whose hashes a task remembers.
CACHE_SIZE = 250_000
#: Keys with more than one row in so many are hot: there are fewer of them than that.
HOT_SHARE = 1000
#: Bytes with A-Z in lower case: as they are, and with all but digits, letters and what is not ASCII as spaces.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
WORDS_ONLY = bytes(LOWER[c] if 48 <= c <= 57 or 97 <= LOWER[c] <= 122 or c > 127 else 32 for c in range(256))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of what is no longer in use, which it does when the driver collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


class Words(dict):
    """Words of texts as 64-bit hashes. Bytes of UTF-8 are mapped by a table, then split at ASCII white space, \\x20 and \\x09-\\x0D.

    Words are hashed once for each task, as long as they fit."""

    def __init__(self, table: bytes):
        self.table = table

    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE_SIZE:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found

    def split(self, text: str | None) -> list[bytes]:
        return (text or "").encode("utf-8", "surrogatepass").translate(self.table).split()

    def count(self, text: str | None) -> int:
        return len(self.split(text))

    def of(self, text: str | None) -> np.ndarray:
        words = self.split(text)
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def crc_bucket(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo modulus; null ids count as an empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % modulus


def join_hot(big: DataFrame, small: DataFrame, keys: list[str], count: str) -> DataFrame:
    """big joined with small by keys, which are distinct in small; count is small's column of how many rows of big have the key.

    Keys with more than one in HOT_SHARE of the counted rows are fewer than HOT_SHARE, whatever the input's size. These are
    broadcast, so that their rows of big stay where they are; the others are joined by a shuffle. big is read twice."""
    total = small.agg(F.sum(count)).first()[0] or 0
    hot, rest = (small.where(F.col(count) * HOT_SHARE > total), small.where(F.col(count) * HOT_SHARE <= total))
    spread = big.join(F.broadcast(hot.drop(count)), keys)
    cold = big.join(F.broadcast(hot.select(keys)), keys, "left_anti").join(rest.drop(count), keys)
    return spread.unionByName(cold)


def free_name(name: str, df: DataFrame) -> str:
    """A column name that df doesn't have, in capitals or not."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def slices(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of about SLICE_BYTES of the named column, so that long texts don't add up."""
    for batch in batches:
        if not batch.num_rows:
            continue
        mean = max(1, batch.column(column).nbytes // batch.num_rows)
        step = max(1, SLICE_BYTES // mean)
        for start in range(0, batch.num_rows, step):
            yield batch.slice(start, step)


def map_column(df: DataFrame, column: str, fields: list[T.StructField], make: Callable[[], Callable[[list], list]], keep_column: bool = True) -> DataFrame:
    """Adds fields to df, computed from one column in Arrow batches; columns of df with those names are replaced.

    The column itself stays, unless keep_column is False.
    make() runs once in each task and returns a function from a list of values (None for null) to one list for each field.
    """
    names = {f.name.lower() for f in fields}
    kept = [c for c in df.columns if c.lower() not in names and (keep_column or c != column)]
    schema = T.StructType([df.schema[c] for c in kept] + fields)
    source = free_name("text", df)
    types = [to_arrow(f.dataType) for f in fields]

    def run(batches):
        work = make()
        for batch in slices(batches, source):
            made = work(batch.column(source).to_pylist())
            arrays = [batch.column(c) for c in range(len(kept))]
            arrays += [x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(made, types, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*kept, *(f.name for f in fields)])

    return df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{column}`").alias(source)).mapInArrow(run, schema)


def to_arrow(kind: T.DataType) -> pa.DataType:
    simple = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary()}
    if isinstance(kind, T.ArrayType):
        return pa.list_(to_arrow(kind.elementType))
    return simple[kind.simpleString()]
