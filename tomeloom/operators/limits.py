"""Token buckets, eviction and backoff."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CAPACITY, PER_MINUTE = 6, 6
MOST_BUCKETS = 4096


def allowances(requests: DataFrame, capacity: int = CAPACITY, per_minute: float = PER_MINUTE) -> DataFrame:
    """key, event_id, allowed, wait of every request; requests: key, ts (microseconds), event_id.

    A bucket starts full, refills with time up to its capacity and gives one
    token a request.  The state depends on itself, so each key's requests are
    read in order of (ts, event_id), a batch at a time, with two numbers kept.
    """
    rate = per_minute / 60.0

    def run(batches):
        key, at, tokens = None, None, 0.0
        for batch in batches:
            columns = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            allowed, wait = [], []
            for k, ts in zip(*columns, strict=True):
                if at is None or k != key:
                    key, tokens = k, float(capacity)
                else:
                    tokens = min(float(capacity), tokens + (ts - at) / 1e6 * rate)
                at = ts
                allowed.append(tokens >= 1)
                wait.append(0.0 if tokens >= 1 else (1 - tokens) / rate if rate else 60.0)
                tokens -= tokens >= 1
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(allowed, pa.bool_()), pa.array(wait, pa.float64())], ["key", "event_id", "allowed", "wait"])

    schema = f"key {requests.schema['key'].dataType.simpleString()}, event_id {requests.schema['event_id'].dataType.simpleString()}, allowed boolean, wait double"
    return requests.select("key", "ts", "event_id").repartition("key").sortWithinPartitions("key", "ts", "event_id").mapInArrow(run, schema)


def kept_buckets(buckets: DataFrame, most: int = MOST_BUCKETS, rows_a_range: int = 100_000) -> DataFrame:
    """The buckets that stay: all below ``most``, else the later half by (last, key); buckets: key, last (a number).

    The rows are dealt into ranges of (last, key), of which only the least row and
    the count are looked at; ranges after the half stay, and places are counted
    in the one range that holds it.
    """
    n = buckets.count()
    if n < most:
        return buckets
    place = F.struct("last", "key")
    dealt = buckets.select("last", "key").repartitionByRange(max(2, -(-n // rows_a_range)), "last", "key")
    ranges = sorted(dealt.groupBy(F.spark_partition_id().alias("part")).agg(F.min(place).alias("least"), F.count("*").alias("n")).select("least", "n").collect())
    before, cut = 0, 0
    while before + ranges[cut]["n"] <= n // 2:
        before, cut = before + ranges[cut]["n"], cut + 1
    bounds = [r["least"] for r in ranges[cut : cut + 2]]
    at_least = lambda b: (F.col("last") > F.lit(b["last"])) | (F.col("last") == F.lit(b["last"])) & (F.col("key") >= F.lit(b["key"]))
    later = at_least(bounds[1]) if len(bounds) > 1 else F.lit(False)
    middle = buckets.where(at_least(bounds[0]) & ~later).withColumn("place", F.row_number().over(Window.orderBy("last", "key")) + before)
    return middle.where(F.col("place") > n // 2).select(*buckets.columns).unionByName(buckets.where(later))


def backoff(base: float, most: float, attempts: int) -> Column:
    """Delays before each retry, without jitter."""
    return F.transform(F.sequence(F.lit(0), F.lit(attempts - 2)), lambda k: F.least(F.lit(base) * F.pow(F.lit(2.0), k), F.lit(most)))


def jittered(delay: Column, jitter: float) -> Column:
    return F.greatest(F.lit(0.0), delay + delay * jitter * (2 * F.rand() - 1))


def is_rate_limit(message: Column, status: Column) -> Column:
    return F.contains(message, F.lit("429")) | F.contains(message, F.lit("Too Many Requests")) | F.coalesce(status == 429, F.lit(False))


def is_transient(message: Column, status: Column) -> Column:
    """Worth another try: rate limits, 502 to 504, time-outs."""
    named = message.rlike("50[234] |code: 50[234]|status_code=50[234]")
    late = F.lower(message).rlike("timeout|timed out")
    return is_rate_limit(message, status) | named | late | F.coalesce(status.isin(429, 502, 503, 504), F.lit(False))
