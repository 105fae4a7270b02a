"""Cutting lineage with tables that outlive the executors that wrote them."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``.

    Only where the session names none and runs on one machine a temporary folder is set.
    """
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if configured:
        if current is None:
            sc.setCheckpointDir(configured)
        return configured
    if current is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        own = tempfile.mkdtemp(prefix="vertexloom-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        sc.setCheckpointDir(own)
        current = sc.getCheckpointDir()
    return current


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` once as a parquet table in the shared folder and read it back.

    Use it where row order and partition numbers don't matter afterwards; columns keep their
    encoding, so it costs far less disk than a serialised checkpoint.
    """
    path = _fresh(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: A table counted to have at most so many rows may be sent whole to all tasks.
SENT_ROWS = 100_000


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that grows with the data: it is never sent whole to all tasks.

    The planner judges a table by its files, and a few MB of compressed ids are millions of rows in memory.
    """
    return df.hint("merge")


def _tables(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/tables/{spark.sparkContext.applicationId}"


def _fresh(spark: SparkSession) -> str:
    return f"{_tables(spark)}/{uuid.uuid4().hex}"


def forget(spark: SparkSession) -> None:
    """Delete all tables that this application wrote here: once its results are saved, nothing reads them."""
    from vertexloom.sources.graphs import _stored_star

    _stored_star.cache_clear()
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_tables(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


class Rounds:
    """A table that grows by a part each round, read as one scan however many rounds there were.

    Aggregates of a part are taken while it is written: no further job counts it.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.n, self.schema = spark, _fresh(spark), 0, None

    def add(self, df: DataFrame, **measures: Column) -> dict[str, int]:
        seen = Observation()
        if measures:
            df = df.observe(seen, *(m.alias(k) for k, m in measures.items()))
        df.write.parquet(f"{self.root}/round={self.n}")
        self.schema = df.schema
        self.n += 1
        return seen.get if measures else {}

    def all(self) -> DataFrame:
        """Every part, with its number as ``round``."""
        schema = T.StructType([*self.schema.fields, T.StructField("round", T.IntegerType())])
        return self.spark.read.schema(schema).parquet(self.root)

    def last(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.root}/round={self.n - 1}")


def pinned(df: DataFrame) -> DataFrame:
    """Checkpoint ``df``: partition numbers and the order of rows inside partitions stay fixed."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def numbered(df: DataFrame, to: str) -> DataFrame:
    """``df`` with 0-based row numbers in its present order: counts per partition give the offsets, no row moves."""
    rows = pinned(df.withColumns({"__pid": F.spark_partition_id(), "__pos": F.monotonically_increasing_id()}))
    first = {r["__pid"]: (r["n"], r["first"]) for r in rows.groupBy("__pid").agg(F.count(F.lit(1)).alias("n"), F.min("__pos").alias("first")).collect()}  # one row a partition
    shift, at = {}, 0
    for p in sorted(first):
        shift[p] = at - first[p][1]
        at += first[p][0]
    if not shift:
        return rows.withColumn(to, F.lit(0).cast("bigint")).drop("__pid", "__pos")
    offset = F.create_map(*(F.lit(x) for kv in shift.items() for x in kv))
    return rows.withColumn(to, F.col("__pos") + offset[F.col("__pid")]).drop("__pid", "__pos")


def partitions(spark: SparkSession) -> int:
    """Partition count for explicit range partitioning: the session's shuffle setting."""
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
