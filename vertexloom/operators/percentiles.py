"""Exact percentiles per group over very many values (distributed sort and per-partition counts).

Rows are sorted by (group, value) over all partitions, ties spread by a row hash, so no group and
no repeated value has to fit one task. Counts per (partition, group) give each group's offset in
each partition; only the at most two groups at a partition's ends can continue elsewhere, so at
most 2 x partitions offsets are sent to the tasks. Target ranks are then picked by position.

Results of separate partitions or days combine through ``value_counts``: histograms of exact
values (error 0), or of logarithmic buckets whose relative error is at most ``relative_error``;
the union of such tables is again valid input.

Defined results: rows with a NULL value, group column or weight, or a weight below 1, are ignored;
NaN sorts last; an empty input gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from vertexloom.operators.durable import partitions, pinned

#: Percentiles are given in thousandths, which keeps target ranks in exact integers.
PERMILLE = (500, 950, 990)


def value_counts(df: DataFrame, groups: Sequence[str], value: str, weight: str | None = None, relative_error: float = 0.0) -> DataFrame:
    """(groups..., value, n): mergeable state; with an error bound, positive values are put into the
    bucket (g^(k-1), g^k], g = (1 + e) / (1 - e), and represented by its mid 2 g^k / (g + 1)."""
    n = F.col(weight) if weight else F.lit(1)
    v = F.col(value)
    if relative_error:
        g = (1 + relative_error) / (1 - relative_error)
        v = F.when(v > 0, F.pow(F.lit(g), F.ceil(F.log(v) / math.log(g))) * (2 / (g + 1))).otherwise(v)
    return df.groupBy(*groups, v.alias("value")).agg(F.sum(n).cast("bigint").alias("n"))


def _runs(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[tuple, np.ndarray, np.ndarray]]:
    """(group, values, weights) of each run of equal group columns in a sorted partition."""
    key, values, weights = None, [], []
    for b in batches:
        if not b.num_rows:
            continue
        change = np.zeros(b.num_rows, dtype=bool)
        change[0] = True
        for c in b.columns[:k]:
            codes = c.dictionary_encode().indices.to_numpy(zero_copy_only=False)
            change[1:] |= codes[1:] != codes[:-1]
        at = np.append(np.flatnonzero(change), b.num_rows)
        v, w = b.column(k).to_numpy(zero_copy_only=False), b.column(k + 1).to_numpy(zero_copy_only=False)
        for lo, hi in zip(at[:-1], at[1:]):
            own = tuple(c[int(lo)].as_py() for c in b.columns[:k])
            if own != key:
                if values:
                    yield key, np.concatenate(values), np.concatenate(weights)
                key, values, weights = own, [], []
            values.append(v[lo:hi])
            weights.append(w[lo:hi])
    if values:
        yield key, np.concatenate(values), np.concatenate(weights)


def exact_percentiles(
    df: DataFrame, groups: Sequence[str], value: str, permille: Sequence[int] = PERMILLE, weight: str | None = None
) -> DataFrame:
    """(groups..., n, and for each percentile pNNN_rank and pNNN_linear).

    ``pNNN_rank`` is the smallest value such that at least NNN / 1000 of the group's rows are not
    above it; ``pNNN_linear`` interpolates the neighbouring order statistics at (n - 1) NNN / 1000.
    """
    groups = list(groups)
    kind = df.schema[value].dataType
    rows = df.select(*(F.col(g).alias(f"g{i}") for i, g in enumerate(groups)), F.col(value).alias("v"), (F.col(weight).cast("bigint") if weight else F.lit(1).cast("bigint")).alias("w"))
    rows = rows.dropna().filter("w > 0")
    names = [f"g{i}" for i in range(len(groups))]
    spread = F.xxhash64(F.monotonically_increasing_id())
    ordered = rows.withColumn("tie", spread).repartitionByRange(partitions(df.sparkSession), *names, "v", "tie").sortWithinPartitions(*names, "v").drop("tie")
    ordered = pinned(ordered.withColumn("pid", F.spark_partition_id()))
    counts = ordered.groupBy("pid", *names).agg(F.sum("w").alias("n"))
    over = Window.partitionBy(*names)
    parts = counts.withColumns(
        {
            "parts": F.count(F.lit(1)).over(over),
            "total": F.sum("n").over(over),
            "offset": F.coalesce(F.sum("n").over(over.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        }
    ).filter("parts > 1")
    # A group in several partitions ends or begins at a partition's edge: at most two such rows a partition.
    edges = {(r["pid"], *(r[g] for g in names)): (r["offset"], r["total"]) for r in parts.collect()}
    targets = tuple(permille)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid = -1

        def numbered() -> Iterator[pa.RecordBatch]:
            nonlocal pid
            for b in batches:
                if b.num_rows:
                    pid = b.column("pid")[0].as_py()
                    yield b

        out: list[list] = [[] for _ in range(len(names) + 4)]

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(out, arrow)], schema=arrow)
            for c in out:
                c.clear()
            return batch

        for key, v, w in _runs(numbered(), len(names)):
            upto = np.cumsum(w)
            offset, total = edges.get((pid, *key), (0, int(upto[-1])))
            for p in targets:
                low = (total - 1) * p // 1000
                for what, rank in ((0, -(-total * p // 1000) or 1), (1, low + 1), (2, min(low + 2, total))):
                    if offset < rank <= offset + upto[-1]:
                        got = v[np.searchsorted(upto, rank - offset)].item()
                        for c, x in zip(out, (*key, total, p, what, got)):
                            c.append(x)
            if len(out[0]) >= 8192:
                yield flush()
        if out[0]:
            yield flush()

    schema = T.StructType([*(ordered.schema[g] for g in names), T.StructField("n", T.LongType()), T.StructField("p", T.IntegerType()), T.StructField("what", T.IntegerType()), T.StructField("value", kind)])
    arrow = to_arrow_schema(schema)
    picked = ordered.mapInArrow(pick, schema)
    aggs = [F.max("n").alias("n")]
    for p in targets:
        take = lambda what, p=p: F.max(F.when((F.col("p") == p) & (F.col("what") == what), F.col("value")))
        part = (F.max("n") - 1) * F.lit(p) % F.lit(1000) / F.lit(1000.0)
        aggs += [take(0).alias(f"p{p}_rank"), (take(1) + (take(2) - take(1)) * part).alias(f"p{p}_linear")]
    out = picked.groupBy(*names).agg(*aggs)
    return out.select(*(F.col(n).alias(g) for n, g in zip(names, groups)), *[c for c in out.columns if c not in names])
