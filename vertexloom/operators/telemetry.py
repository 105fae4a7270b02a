"""Run-time metrics of spans and events, in batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vertexloom.operators.durable import partitions
from vertexloom.operators.hotkeys import number_rows
from vertexloom.operators.percentiles import exact_percentiles


def roll_up(df: DataFrame, name: str, latency: str, at: str) -> DataFrame:
    """(name, call_count, p50, p95, p99, last_seen) per lower-cased name, percentiles exact."""
    rows = df.select(F.lower(name).alias("name"), F.col(latency).alias("latency"), F.col(at).alias("at")).filter("name is not null")
    p = exact_percentiles(rows, ["name"], "latency").select("name", F.col("p500_rank").alias("p50"), F.col("p950_rank").alias("p95"), F.col("p990_rank").alias("p99"))
    return rows.groupBy("name").agg(F.count(F.lit(1)).alias("call_count"), F.max("at").alias("last_seen")).join(p, "name", "left").select("name", "call_count", "p50", "p95", "p99", "last_seen")


def smoothed(df: DataFrame, name: str, latency: str, order: str, alpha: float = 0.1) -> DataFrame:
    """(name, ema): exponential moving average in order, from 0.

    A value's weight depends only on how many come after it, so numbered chunks of a name are summed
    apart and no name is gathered: the average is the sum of alpha (1 - alpha)^(later values) x.
    """
    rows = df.select(F.lower(name).alias("name"), F.col(order).alias("o"), F.col(latency).cast("double").alias("x")).filter("name is not null and x is not null")
    near = number_rows(rows.repartitionByRange(partitions(df.sparkSession), "name", "o", "x").sortWithinPartitions("name", "o", "x"), ["name"], "k")
    total = rows.groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    return near.join(F.broadcast(total) if total.count() <= 100_000 else total, "name").groupBy("name").agg(F.sum(F.lit(alpha) * F.pow(F.lit(1.0 - alpha), F.col("n") - 1 - F.col("k")) * F.col("x")).alias("ema"))


#: How far the running percentiles move towards a value above and below them.
STEPS = {"p50_ms": (0.1, 0.1), "p95_ms": (0.05, 0.01), "p99_ms": (0.01, 0.001)}


def running_percentiles(df: DataFrame, name: str, latency: str, order: str) -> DataFrame:
    """(name, call_count, p50_ms, p95_ms, p99_ms): running estimates over a name's values in order, from its first.

    Each estimate is a sequential rule (towards the value by a step that depends on which is larger), so a
    name's values pass one state in order: batches of a name come one after the other from a sorted
    shuffle and only three numbers are kept, never its values.
    """
    rows = df.select(F.lower(name).alias("name"), F.col(order).alias("o"), F.col(latency).cast("double").alias("x")).filter("name is not null and x is not null")
    ordered = rows.repartition("name").sortWithinPartitions("name", "o", "x").select("name", "x")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, n, state = None, 0, [0.0] * 3
        steps, out = list(STEPS.values()), []
        for b in batches:
            for own, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if own != key:
                    if n:
                        out.append((key, n, *state))
                    key, n, state = own, 1, [x] * 3
                    continue
                n += 1
                state = [p + (x - p) * (up if x > p else down) for p, (up, down) in zip(state, steps)]
        if n:
            out.append((key, n, *state))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [pa.string(), pa.int64(), *[pa.float64()] * 3])], names=["name", "call_count", *STEPS])

    return ordered.mapInArrow(run, "name string, call_count bigint, p50_ms double, p95_ms double, p99_ms double")


def hot_paths(rolled: DataFrame, k: int = 10) -> DataFrame:
    return rolled.orderBy(F.col("call_count").desc(), "p95", "name").limit(k)
