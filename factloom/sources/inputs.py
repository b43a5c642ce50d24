"""Inputs from folders: text files, files that a manifest names, records in JSON."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def files(spark: SparkSession, folder: str) -> DataFrame:
    """(relpath, content, bytes, sha256) of all files below a folder; relpath is the path from there, with slashes. Files without a byte are passed
    over, as Spark plans none for them."""
    root = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "", folder).rstrip("/") + "/"
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    relpath = F.expr("substring(path, instr(path, root) + length(root))")
    return rows.withColumn("root", F.lit(root)).select(relpath.alias("relpath"), "content", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def text_files(spark: SparkSession, folder: str) -> DataFrame:
    """Markdown and text files below a folder: relpath, text, sha256, bytes. Bytes that are not UTF-8 are an error that names the file."""
    found = files(spark, folder).where(F.lower("relpath").rlike(r"\.(md|txt)$"))
    return found.select("relpath", decoded(F.col("content"), F.col("relpath")).alias("text"), "sha256", "bytes")


def decoded(content: Column, name: Column) -> Column:
    """Bytes as UTF-8 text, or an error."""
    return F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(F.raise_error(F.concat(F.lit("not UTF-8: "), name)))


def json_text(content: Column, name: Column) -> Column:
    """Bytes as JSON text: UTF-8, without a byte order mark."""
    return F.regexp_replace(decoded(content, name), "^﻿", "")


def resolved(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """manifest (ref, relpath, sha256; hashes in any case of letters) with the content of each file that it names, and status: ok, missing, altered (content is left out then), or
    ambiguous for references that are named twice."""
    names = manifest.select("ref", F.col("relpath").alias("named"), F.lower("sha256").alias("expected"))
    twice = names.groupBy("ref").agg(F.count("*").alias("n_named"))
    joined = names.join(twice, "ref").join(found.select("relpath", "content", "sha256"), F.col("named") == F.col("relpath"), "left")
    status = F.when(F.col("n_named") > 1, "ambiguous").when(F.col("relpath").isNull(), "missing").when(F.col("sha256") != F.col("expected"), "altered").otherwise("ok")
    return joined.select("ref", F.col("named").alias("relpath"), status.alias("status"), F.when(status == "ok", F.col("content")).alias("content"))


def manifest_of(found: DataFrame) -> DataFrame:
    """(ref, relpath, sha256): a manifest of files, each named by its path without its ending."""
    return found.select(F.regexp_replace("relpath", r"\.[^./]*$", "").alias("ref"), "relpath", "sha256")
