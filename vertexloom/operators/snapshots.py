"""What changed between consecutive full snapshots (content-defined chunks of key-sorted rows).

All snapshots are range-partitioned and sorted by key once. The merged key sequence is cut where a
hash of the key says so, hence a row added or removed never shifts the other cuts. A chunk whose
128-bit digest is equal in two consecutive snapshots is discarded; only the rows of unmatched
chunks are joined and classified by comparing their real columns.

Defined results: the row of highest sequence number counts per (snapshot, key); NULL equals only
NULL; keys compare exactly and rows with a NULL key or snapshot are ignored; a key absent from one
snapshot and back in a later one is removed, then added; empty input gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vertexloom.operators.durable import durable, partitions


def latest(df: DataFrame, keys: Sequence[str], seq: str, cols: Sequence[str]) -> DataFrame:
    """The row of highest ``seq`` per key, reduced before the shuffle by partial aggregation."""
    kept = F.max_by(F.struct(*cols), F.struct(F.col(seq), F.xxhash64(*cols)))
    return df.groupBy(*keys).agg(kept.alias("__row")).select(*keys, *(F.col(f"__row.{c}").alias(c) for c in cols))


def _unmatched(batches: Iterator[pa.RecordBatch], later: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of chunks whose digest differs from the same chunk of the snapshot before or after.

    Batches come sorted by key. Rows of the open chunk are held back until its end is seen, so
    memory is bounded by a batch and a chunk. ``later`` holds the snapshots that have a predecessor.
    """
    held: list[pa.RecordBatch] = []

    def close(rows: pa.Table) -> list[pa.RecordBatch]:
        snap = rows["snap"].to_numpy().astype(np.int64)
        chunk = np.cumsum(_starts(rows))
        base = snap.min()
        width = int(snap.max() - base) + 2
        slot = chunk * width + (snap - base)
        digest = np.zeros((3, (int(chunk.max()) + 1) * width), dtype=np.uint64)
        for total, column in zip(digest, ("fp1", "fp2")):
            np.add.at(total, slot, rows[column].to_numpy().view(np.uint64))
        np.add.at(digest[2], slot, np.uint64(1))
        by_snap = digest.reshape(3, -1, width)
        unlike = np.ones((by_snap.shape[1], width + 1), dtype=bool)  # [:, k]: snapshot k against k - 1
        unlike[:, 1:width] = (by_snap[:, :, 1:] != by_snap[:, :, :-1]).any(axis=0)
        prev = unlike[:, :width].reshape(-1)[slot] & np.isin(snap, later)
        following = unlike[:, 1:].reshape(-1)[slot] & np.isin(snap + 1, later)
        out = rows.append_column("vs_next", pa.array(following)).append_column("vs_prev", pa.array(prev))
        return out.filter(pa.array(following | prev)).drop_columns(["cut", "fp1", "fp2"]).combine_chunks().to_batches()

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows = pa.Table.from_batches(held)
        starts = np.flatnonzero(_starts(rows))
        if len(starts) and starts[-1] > 0:
            yield from close(rows.slice(0, starts[-1]))
            held = rows.slice(starts[-1]).combine_chunks().to_batches()
    if held:
        yield from close(pa.Table.from_batches(held))


def _starts(t: pa.Table) -> np.ndarray:
    """True at the first row of a key whose hash cuts (all snapshots' rows of a key stay together)."""
    cut = t["cut"].to_numpy()
    key = t["key"].combine_chunks()
    same = np.zeros(len(key), dtype=bool)
    if len(key) > 1:
        same[1:] = pc.equal(key[1:], key[:-1]).to_numpy(zero_copy_only=False)
    return cut & ~same


def snapshot_changes(
    df: DataFrame, snapshot: str, key: str, seq: str, compare: Sequence[str], carry: Sequence[str] = (), chunk: int = 64
) -> DataFrame:
    """(snapshot_no, id, change, old_*, new_*) for every two snapshots whose numbers are consecutive.

    change is ``added``, ``removed`` (reported at the first snapshot without the key) or ``changed``
    (any column of ``compare`` differs). ``carry`` columns come out as old_<c> and new_<c>. ``chunk``
    is the mean number of keys per chunk. The numbers of the first snapshot's rows are no additions.
    """
    cols = list(dict.fromkeys([*compare, *carry]))
    df = df.select(F.col(snapshot).cast("int").alias("snap"), F.col(key).alias("key"), F.col(seq).alias("__seq"), *(F.col(c).alias(f"v_{c}") for c in cols))
    df = df.filter(F.col("snap").isNotNull() & F.col("key").isNotNull())
    values = [f"v_{c}" for c in cols]
    compared = [f"v_{c}" for c in compare]
    # One range shuffle by key serves the reduction to the latest row, the sort and the chunks.
    ranged = df.repartitionByRange(partitions(df.sparkSession), "key")
    rows = latest(ranged, ["snap", "key"], "__seq", values)
    tagged = rows.select(
        "snap",
        "key",
        *values,
        F.xxhash64("key", *compared, *(F.col(c).isNull() for c in compared)).alias("fp1"),
        F.xxhash64(F.lit(7), F.reverse("key"), *(F.col(c).isNull() for c in compared), *compared).alias("fp2"),
        (F.pmod(F.xxhash64(F.lit("cut"), "key"), F.lit(chunk)) == 0).alias("cut"),
    ).sortWithinPartitions("key", "snap")
    schema = T.StructType([tagged.schema["snap"], tagged.schema["key"], *(tagged.schema[v] for v in values), T.StructField("vs_next", T.BooleanType()), T.StructField("vs_prev", T.BooleanType())])
    numbers = {r[0] for r in df.select("snap").distinct().collect()}  # one number a delivered snapshot
    later = np.array(sorted(n for n in numbers if n - 1 in numbers), dtype=np.int64)
    lone = durable(tagged.mapInArrow(lambda batches: _unmatched(batches, later), schema))
    old = lone.filter("vs_next").select((F.col("snap") + 1).alias("snap"), "key", F.struct(*values).alias("old"))
    new = lone.filter("vs_prev").select("snap", "key", F.struct(*values).alias("new"))
    both = old.join(new, ["snap", "key"], "full")
    differs = F.lit(False)
    for v in compared:
        differs |= ~F.col(f"old.{v}").eqNullSafe(F.col(f"new.{v}"))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(differs, "changed")
    out = both.withColumn("change", change).filter(F.col("change").isNotNull())
    return out.select(
        F.col("snap").alias("snapshot_no"),
        F.col("key").alias("id"),
        "change",
        *(F.col(f"old.v_{c}").alias(f"old_{c}") for c in carry),
        *(F.col(f"new.v_{c}").alias(f"new_{c}") for c in carry),
    )
