"""Evidence packs: documents and their chunks, known by the hashes of their normal form, and a hash of the whole."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions.canonical import with_canonical
from factloom.functions.text import composed, lf
from factloom.operators import evidence


def normalized(docs: DataFrame) -> DataFrame:
    """docs with texts composed and with line feeds only. Null texts are empty."""
    return composed(docs.withColumn("text", F.coalesce("text", F.lit(""))), "text").withColumn("text", lf(F.col("text")))


def documents(docs: DataFrame) -> DataFrame:
    """(pack_id, doc_id, relpath, sha256, bytes) of normalized docs (pack_id, relpath, text): equal texts have one doc_id."""
    sha = F.sha2("text", 256)
    return docs.select("pack_id", F.concat(F.lit("doc:"), sha).alias("doc_id"), "relpath", sha.alias("sha256"), F.octet_length("text").cast("bigint").alias("bytes"))


def chunks(docs: DataFrame) -> DataFrame:
    """(pack_id, relpath, doc_id, chunk_id, index, offset_start, offset_end, text, text_sha256); a chunk's place is in the normal form."""
    keyed = docs.withColumn("doc_id", F.struct("pack_id", F.concat(F.lit("doc:"), F.sha2("text", 256)).alias("doc_id")))
    cut = evidence.chunks(keyed)
    whole = {c: F.col(c).cast("bigint") for c in ("index", "offset_start", "offset_end")}
    return cut.withColumns(whole).select("doc_id.pack_id", "relpath", "doc_id.doc_id", "chunk_id", "index", "offset_start", "offset_end", "text", F.substring("chunk_id", 7, 64).alias("text_sha256"))


def hashes(docs: DataFrame, root_hint: str = "") -> DataFrame:
    """(pack_id, pack_sha256, n_documents, n_chunks): the hash of a pack as one canonical record, its own hash left empty. Documents stand in the order of their
    paths, chunks after each other within them. A pack is a record, so it is as large as a row can be."""
    first = lambda rows, key, *fields: rows.groupBy("pack_id").agg(F.array_sort(F.collect_list(F.struct(*key, F.struct(*fields).alias("it")))).alias("all"))
    docs_of = first(documents(docs), ["relpath"], "doc_id", "relpath", "sha256", "bytes")
    chunks_of = first(chunks(docs), ["relpath", "index"], "doc_id", "chunk_id", "index", "offset_start", "offset_end", "text", "text_sha256").withColumnRenamed("all", "chunks")
    both = docs_of.join(chunks_of, "pack_id")
    record = F.struct(F.lit("1.0").alias("pack_version"), F.lit(root_hint).alias("root_hint"), F.lit("").alias("pack_sha256"), F.col("all.it").alias("documents"), F.col("chunks.it").alias("chunks"))
    made = with_canonical(both.select("pack_id", record.alias("record")), "record", "json")
    return made.select("pack_id", F.sha2("json", 256).alias("pack_sha256"), F.size("record.documents").cast("bigint").alias("n_documents"), F.size("record.chunks").cast("bigint").alias("n_chunks"))
