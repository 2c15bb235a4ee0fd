"""Token buckets over a stream of requests, equal to the batch fold for requests in order."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.limits import CAPACITY, PER_MINUTE
from ..sources.shared import shared_dir

OUT = "key long, event_id long, allowed boolean, wait double"
STATE = "tokens double, at long"


def stream_allowances(requests: DataFrame, capacity: int = CAPACITY, per_minute: float = PER_MINUTE) -> DataFrame:
    """key, event_id, allowed, wait; requests: key, ts (microseconds), event_id.  A bucket is two numbers of state a key."""
    rate = per_minute / 60.0

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tokens, at = state.get if state.exists else (float(capacity), None)
        rows = pd.concat(list(parts)).sort_values(["ts", "event_id"])
        out = []
        for ts, event in zip(rows["ts"].tolist(), rows["event_id"].tolist(), strict=True):
            if at is not None:
                tokens = min(float(capacity), tokens + (ts - at) / 1e6 * rate)
            at = ts
            ok = tokens >= 1
            out.append((key[0], event, ok, 0.0 if ok else (1 - tokens) / rate if rate else 60.0))
            tokens -= ok
        state.update((tokens, at))
        yield pd.DataFrame(out, columns=["key", "event_id", "allowed", "wait"])

    return requests.groupBy("key").applyInPandasWithState(run, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def collected(rows: DataFrame) -> DataFrame:
    """Runs the stream over what its source holds now and gives the rows back, through a table in the shared folder."""
    spark = rows.sparkSession
    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex[:12]}"
    rows.writeStream.format("parquet").option("checkpointLocation", f"{at}/log").outputMode("append").trigger(availableNow=True).start(f"{at}/rows").awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{at}/rows")
