"""Documents to chunks, and the choice of chunks for a query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_CHARS, OVERLAP = 1200, 120


def inventory(docs: DataFrame) -> DataFrame:
    """relpath, doc_key (doc:sha256 of the text) and size in bytes of each document."""
    return docs.select("relpath", F.concat(F.lit("doc:"), F.sha2("text", 256)).alias("doc_key"), F.octet_length("text").cast("bigint").alias("bytes"))


def chunks(docs: DataFrame, max_chars: int = MAX_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """Pieces of max_chars code points, each overlapping the one before; the last is the first that reaches the end."""
    step = max_chars - overlap
    last = F.ceil(F.greatest(F.length("text") - max_chars, F.lit(0)) / step).cast("int")
    rows = docs.select("doc_id", "relpath", "text", F.explode(F.sequence(F.lit(0), last)).alias("index"))
    start = F.col("index") * step
    rows = rows.select("doc_id", "relpath", "index", start.alias("offset_start"), F.least(start + max_chars, F.length("text")).alias("offset_end"), F.substring("text", start + 1, F.lit(max_chars)).alias("text"))
    return rows.withColumn("chunk_id", F.concat(F.lit("chunk:"), F.sha2("text", 256)))


def occurrences(text: Column, term: str) -> Column:
    """Non-overlapping occurrences."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(term), F.lit("")))) / len(term)).cast("bigint")


def with_all_terms(chunked: DataFrame, terms: list[str]) -> DataFrame:
    low = F.lower("text")
    condition = F.lit(True)
    for t in terms:
        condition &= F.contains(low, F.lit(t))
    return chunked.where(condition)


def top_chunks(chunked: DataFrame, terms: list[str], k: int) -> DataFrame:
    """The k chunks with the highest term count, with ranks; chunks without a term never count."""
    score = sum((occurrences(F.lower("text"), t) for t in terms), F.lit(0).cast("bigint"))
    ordered = chunked.withColumn("score", score).where("score > 0").orderBy(F.desc("score"), "relpath", "doc_id", "index", "chunk_id").limit(k)
    return ordered.select("doc_id", "relpath", "index", "offset_start", "offset_end", "chunk_id", "score")
