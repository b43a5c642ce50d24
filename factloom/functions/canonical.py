"""Canonical JSON and the hashes of it."""

from __future__ import annotations

import json
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, IntegralType, MapType, StringType, StructType

from factloom.functions.text import unsettled


#: A string of a JSON text, with its quotes.
STRING = re.compile(r'"(?:[^"\\]|\\.)*"')


def canonical(value) -> str:
    """Sorted keys, no spaces, composed strings, non-ASCII as it is; NaN and infinities are errors. Keys that are equal once composed
    are one, the last of them."""
    plain = json.dumps(value, separators=(",", ":"), ensure_ascii=False, allow_nan=False)
    if not plain.isascii():
        value = json.loads(STRING.sub(lambda m: json.dumps(unicodedata.normalize("NFC", json.loads(m[0])), ensure_ascii=False), plain))
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


@F.pandas_udf(StringType())
def canonical_json(texts: pd.Series) -> pd.Series:
    """Canonical form of JSON texts."""
    return texts.map(lambda t: None if t is None else canonical(json.loads(t)))


def flat_json(**fields: Column) -> Column:
    """Canonical JSON of strings, integers and booleans without a Python function: fields in the order of their names, nulls kept."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def with_sorted_fields(value: Column, kind: DataType) -> Column:
    """value with the fields of all its structs in the order of their names, and the keys of its maps in order. Fractions have no one way to be written,
    so they are an error; times are to be texts."""
    if isinstance(kind, StructType):
        fields = [with_sorted_fields(value[f.name], f.dataType).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name)]
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda x: with_sorted_fields(x, kind.elementType))
    if isinstance(kind, MapType):
        return F.map_from_entries(F.array_sort(F.transform(F.map_entries(value), lambda e: F.struct(e["key"].alias("key"), with_sorted_fields(e["value"], kind.valueType).alias("value")))))
    if not isinstance(kind, (StringType, IntegralType, BooleanType)):
        raise TypeError(f"{kind.simpleString()} has no canonical form")
    return value


def with_canonical(rows: DataFrame, column: str, name: str) -> DataFrame:
    """rows with the canonical JSON of a column of any nesting. It is written by the JVM; only what has characters that aren't composed, or control
    characters, which are written in another way, goes through Python."""
    made = rows.withColumn(name, F.to_json(with_sorted_fields(F.col(column), rows.schema[column].dataType), {"ignoreNullFields": "false"}))
    odd = F.coalesce(F.col(name).rlike(r"\\u00") | (F.col(name).rlike(r"[^\x00-\x{2FF}]") & F.col(name).rlike(unsettled())), F.lit(False))
    return made.where(~odd).unionByName(made.where(odd).withColumn(name, canonical_json(F.col(name))))
