"""Service tables: pages of an audit log, retention, admission by rate, sealed records."""

from __future__ import annotations

from collections import deque

from factloom.functions.canonical import digest, flat_json
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, WINDOW_SECONDS = 60, 60


def audit_page(requests: DataFrame, tenant: int, offset: int, limit: int) -> DataFrame:
    """A page of one tenant's log, newest first."""
    return requests.where(F.col("tenant_id") == tenant).orderBy(F.desc("ts"), F.desc("event_id")).offset(offset).limit(limit).select("event_id", "endpoint")


def retention(requests: DataFrame, cutoff: str) -> DataFrame:
    """Rows of each tenant that a purge at the cutoff removes, and those that stay."""
    old = F.col("ts") < F.lit(cutoff).cast("timestamp_ntz")
    return requests.groupBy("tenant_id").agg(F.count_if(old).alias("purged"), F.count_if(~old).alias("kept"))


def admissions(requests: DataFrame, limit: int = LIMIT, seconds: int = WINDOW_SECONDS) -> DataFrame:
    """Whether each request is admitted: at most `limit` admitted ones of a tenant and endpoint within the window before it.

    A refused request doesn't count, so this is no window function: the requests of a key come sorted to one task, which
    reads them as a stream and holds no more than the last `limit` admitted ones.
    """
    rows = requests.select("tenant_id", "endpoint", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    ordered = rows.repartition("tenant_id", "endpoint").sortWithinPartitions("tenant_id", "endpoint", "at", "event_id")

    def admit(batches):
        last, held = None, deque()
        for batch in batches:
            out = []
            for tenant, endpoint, at in zip(batch["tenant_id"], batch["endpoint"], batch["at"], strict=True):
                if (tenant, endpoint) != last:
                    last, held = (tenant, endpoint), deque()
                while held and at - held[0] > seconds * 1_000_000:
                    held.popleft()
                out.append(len(held) < limit)
                if out[-1]:
                    held.append(at)
            yield batch[["tenant_id", "endpoint", "event_id"]].assign(admitted=out)

    return ordered.mapInPandas(admit, "tenant_id bigint, endpoint string, event_id bigint, admitted boolean")


def sealed(docs: DataFrame) -> DataFrame:
    """The canonical record of each document, its hash, and an attestation over record and text."""
    record = flat_json(doc_id=F.col("doc_id"), relpath=F.col("relpath"), sha256=F.sha2("text", 256))
    rows = docs.select("doc_id", digest(record).alias("bundle_sha256"), F.sha2("text", 256).alias("output_sha256"))
    return rows.withColumn("attestation_sha256", F.sha2(F.concat("bundle_sha256", F.lit("|"), "output_sha256"), 256))


def replayed(seals: DataFrame, docs: DataFrame) -> DataFrame:
    """Seals against the texts as they are now: ok, tampered, or missing."""
    now = sealed(docs).select("doc_id", F.col("attestation_sha256").alias("now"))
    status = F.when(F.col("now").isNull(), "missing").when(F.col("now") == F.col("attestation_sha256"), "ok").otherwise("tampered")
    return seals.join(now, "doc_id", "left").select("doc_id", status.alias("status"))
