"""Per-key results when a few keys hold most rows (exact offset chunking).

Rows are counted per (input partition, key); prefix sums of these counts number every row inside
its key without moving it; each key is cut into chunks of equal size, the chunks are processed as
independent groups, and the ordered chunk states of a key are merged at the end. No task ever
holds more than one chunk of a key, whatever the skew.

Defined results: rows with a NULL key form no group (``keep_null_key=True`` groups them under
NULL); an empty input gives an empty result; repeated rows count as often as they occur; ties in
the order are resolved by the remaining order columns, then by all other columns' hash.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vertexloom.operators.durable import durable, partitions, pinned

#: So many offsets (some 100 bytes each) may be sent to every task.
BROADCAST_OFFSETS = 200_000
_PID, _POS, _CHUNK = "__pid", "__pos", "__chunk"


def _micros(at: str) -> Column:
    return F.unix_micros(F.col(at).cast("timestamp"))


def number_chunks(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str] = (),
    target_chunks: int = 256,
    keep_null_key: bool = False,
    chunk_rows: int = 1 << 20,
) -> DataFrame:
    """``df`` with ``__chunk``: the row's equal-sized chunk within its key, ordered by ``order``.

    With ``order`` the rows are range-partitioned by key and order, so that later partitions hold
    later rows of a key; without it they stay in the partitions where they are.
    A chunk has N / target_chunks rows, but never more than ``chunk_rows``, so that one task's share
    stays the same however large the data. Keys of one chunk need no offsets; those of the others are
    counted, and broadcast up to ``BROADCAST_OFFSETS``, beyond which they are joined on (partition, key).
    """
    keys, order = list(keys), list(order)
    if not keep_null_key:
        df = df.dropna(subset=keys, how="any")
    if order:
        df = df.repartitionByRange(partitions(df.sparkSession), *keys, *order)
    rows = pinned(
        df.sortWithinPartitions(*keys, *order).withColumns({_PID: F.spark_partition_id(), _POS: F.monotonically_increasing_id()})
    )
    per_part = rows.groupBy(_PID, *keys).agg(F.count(F.lit(1)).alias("__n"), F.min(_POS).alias("__first"))
    by_key = Window.partitionBy(*keys)
    per_part = per_part.withColumns(
        {
            "__total": F.sum("__n").over(by_key),
            "__offset": F.coalesce(
                F.sum("__n").over(by_key.orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
            ),
        }
    )
    size = max(1, min(chunk_rows, -(-rows.count() // target_chunks)))
    hot = per_part.filter(F.col("__total") > size).select(
        F.col(_PID).alias("__hp"), *(F.col(k).alias(f"__hk{i}") for i, k in enumerate(keys)), "__offset", "__first"
    )
    same: Column = F.col(_PID) == F.col("__hp")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"__hk{i}"))
    hot = durable(hot)
    numbered = rows.join(F.broadcast(hot) if hot.count() <= BROADCAST_OFFSETS else hot, same, "left")
    chunk = F.coalesce(F.floor((F.col("__offset") + F.col(_POS) - F.col("__first")) / F.lit(size)), F.lit(0))
    return numbered.withColumn(_CHUNK, chunk).drop("__hp", "__offset", "__first", *(f"__hk{i}" for i in range(len(keys))))


def number_rows(df: DataFrame, keys: Sequence[str], to: str) -> DataFrame:
    """``df`` with ``to``: the 0-based number of each row inside its key, without gathering a key anywhere.

    Offsets join on (partition, key), so a key with most rows is still spread over all partitions.
    """
    rows = pinned(df.sortWithinPartitions(*keys).withColumns({_PID: F.spark_partition_id(), _POS: F.monotonically_increasing_id()}))
    per_part = rows.groupBy(_PID, *keys).agg(F.count(F.lit(1)).alias("__n"), F.min(_POS).alias("__first"))
    before = F.sum("__n").over(Window.partitionBy(*keys).orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1))
    per_part = per_part.withColumn("__offset", F.coalesce(before, F.lit(0))).drop("__n")
    numbered = rows.join(per_part, [_PID, *keys])
    return numbered.withColumn(to, F.col("__offset") + F.col(_POS) - F.col("__first")).drop(_PID, _POS, "__first", "__offset")


def chunked_counts(df: DataFrame, keys: Sequence[str], target_chunks: int = 256) -> DataFrame:
    """(keys..., n): rows per key; each chunk is counted apart, then the chunk counts are merged."""
    chunks = number_chunks(df.select(*keys), keys, target_chunks=target_chunks).groupBy(*keys, _CHUNK).agg(F.count(F.lit(1)).alias("__c"))
    return chunks.groupBy(*keys).agg(F.sum("__c").alias("n"))


def ordered_profile(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], state: str, at: str, target_chunks: int = 256
) -> DataFrame:
    """Per key, in order: rows, first and last ``at``, changes of ``state``, longest gap of ``at`` in seconds.

    Changes and gaps need neighbouring rows. Inside a chunk a window finds them; over the boundary
    of two chunks of one key they come from the last row of one and the first row of the next.
    NULL states equal only each other; a NULL ``at`` takes part in no gap.
    """
    keys = list(keys)
    rows = number_chunks(df, keys, order, target_chunks)
    inside = Window.partitionBy(*keys, _CHUNK).orderBy(_PID, _POS)
    prev = lambda c: F.lag(c).over(inside)
    rows = rows.withColumns({"__nth": F.row_number().over(inside), "__ps": prev(state), "__pa": prev(at)}).withColumns(
        {
            "__change": (F.col("__nth") > 1) & ~F.col(state).eqNullSafe(F.col("__ps")),
            "__gap": _micros(at) - _micros("__pa"),
        }
    )
    edge = lambda f: f(F.struct(state, at), F.struct(_PID, _POS))
    chunks = rows.groupBy(*keys, _CHUNK).agg(
        F.count(F.lit(1)).alias("__n"),
        F.min(at).alias("__lo"),
        F.max(at).alias("__hi"),
        F.sum(F.col("__change").cast("bigint")).alias("__changes"),
        F.max("__gap").alias("__maxgap"),
        edge(F.min_by).alias("__head"),
        edge(F.max_by).alias("__tail"),
    )
    before = F.lag("__tail").over(Window.partitionBy(*keys).orderBy(_CHUNK))
    chunks = chunks.withColumn("__before", before).withColumns(
        {
            "__changes": F.col("__changes")
            + (F.col("__before").isNotNull() & ~F.col(f"__before.{state}").eqNullSafe(F.col(f"__head.{state}"))).cast("bigint"),
            "__maxgap": F.greatest("__maxgap", _micros(f"__head.{at}") - _micros(f"__before.{at}")),
        }
    )
    return chunks.groupBy(*keys).agg(
        F.sum("__n").alias("n"),
        F.min("__lo").alias("first_at"),
        F.max("__hi").alias("last_at"),
        F.sum("__changes").alias("n_changes"),
        (F.max("__maxgap") / F.lit(1e6)).alias("max_gap_s"),
    )
