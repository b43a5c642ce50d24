"""Admission by rate as a stream: the state of a key is the times of its last admitted requests."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from factloom.operators.service import LIMIT, WINDOW_SECONDS
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stream_admissions(requests: DataFrame, limit: int = LIMIT, seconds: int = WINDOW_SECONDS) -> DataFrame:
    """For a stream of (tenant_id, endpoint, event_id, ts): whether each request is admitted. Within a batch requests are taken by
    time; a request older than the last batch's is judged by the state as it is. The state holds `limit` times at most."""
    rows = requests.select("tenant_id", "endpoint", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))

    def admit(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        batch = pd.concat(list(batches)).sort_values(["at", "event_id"], kind="stable")
        out = []
        for at in batch["at"]:
            held = [t for t in held if at - t <= seconds * 1_000_000]
            out.append(len(held) < limit)
            if out[-1]:
                held.append(int(at))
        state.update((held,))
        yield pd.DataFrame({"tenant_id": key[0], "endpoint": key[1], "event_id": batch["event_id"], "admitted": out})

    return rows.groupBy("tenant_id", "endpoint").applyInPandasWithState(admit, "tenant_id bigint, endpoint string, event_id bigint, admitted boolean", "held array<bigint>", "append", GroupStateTimeout.NoTimeout)
