"""Structured Streaming: live telemetry and incremental graph patches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vertexloom.operators.build import replace_file
from vertexloom.sources.graphs import Graph, conform, EDGE, NODE


def tumbling_counts(events: DataFrame, at: str, by: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(window_start, by, n, total) over event time; rows later than the watermark are dropped."""
    w = F.window(F.col(at), width)
    keyed = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    return keyed.groupBy(w.alias("w"), F.lower(by).alias(by)).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), by, "n", "total")


def sessions(events: DataFrame, at: str, by: str, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """(by, session_start, session_end, n) of bursts of events no further apart than ``gap``."""
    keyed = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    return keyed.groupBy(F.session_window(F.col(at), gap).alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(by, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def watch_files(spark: SparkSession, root: str, extract: Callable[[DataFrame], tuple[DataFrame, DataFrame]], load: Callable[[], Graph], save: Callable[[Graph], None], checkpoint: str, every: str = "5 seconds", recluster: Callable[[Graph], Graph] | None = None, share: float = 0.05) -> StreamingQuery:
    """Patch a stored graph whenever files under ``root`` change: each batch replaces the changed files' rows.

    ``extract`` turns (path, content) rows into nodes and edges with a ``seq`` column; ``save`` must
    write a new snapshot, as the old one is read while it is replaced. ``recluster`` is called when the
    changed files' nodes are at least ``share`` of all.
    """
    files = spark.readStream.format("text").option("wholetext", True).option("recursiveFileLookup", True).load(root).select(F.input_file_name().alias("path"), F.col("value").alias("content"))

    def patch(batch: DataFrame, _: int) -> None:
        if batch.isEmpty():
            return
        graph = load()
        nodes, edges = extract(batch)
        before = graph.nodes
        # A batch's changed files are few by the trigger's nature; each is one replacement step.
        for row in batch.select("path").distinct().toLocalIterator():
            own = row["path"]
            graph = replace_file(graph, own, nodes.filter(F.col("source_file") == own), edges.filter(F.col("source_file") == own), "seq")
        out = Graph(conform(graph.nodes, NODE), conform(graph.edges, EDGE))
        if recluster and changed_share(before, nodes) >= share:
            out = recluster(out)
        save(out)

    return files.writeStream.foreachBatch(patch).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def changed_share(before: DataFrame, nodes: DataFrame) -> float:
    """Nodes of the files that ``nodes`` replace, old and new ids together, as a share of all nodes."""
    files = nodes.select("source_file").distinct()
    touched = before.join(files, "source_file", "left_semi").select("id").unionByName(nodes.select("id")).distinct().count()
    return touched / max(1, before.select("id").unionByName(nodes.select("id")).distinct().count())


def publish(graph: Graph, name: str) -> None:
    """Serve a graph as the views <name>_nodes and <name>_edges: later queries see it at once, running ones the old one."""
    graph.nodes.createOrReplaceTempView(f"{name}_nodes")
    graph.edges.createOrReplaceTempView(f"{name}_edges")


def valid_evidence(spans: DataFrame, files: DataFrame) -> DataFrame:
    """(path, valid): evidence (path, file_hash, state) whose file still has that hash and whose state is Valid."""
    now = files.select("path", F.sha2(F.col("content").cast("binary"), 256).alias("hash"))
    return spans.join(now, "path", "left").select("path", (F.coalesce(F.col("hash") == F.col("file_hash"), F.lit(False)) & (F.col("state") == "Valid")).alias("valid"))


def invalidated(changed: DataFrame, imports: DataFrame) -> DataFrame:
    """(path) of changed files and the files that import them directly."""
    return changed.select("path").unionByName(imports.join(changed.select(F.col("path").alias("imported")), "imported", "left_semi").select("path")).distinct()


def manifest_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change) between two manifests of (path, mtime): added, removed or modified."""
    a, b = old.select("path", F.col("mtime").alias("m0"), F.lit(1).alias("a")), new.select("path", F.col("mtime").alias("m1"), F.lit(1).alias("b"))
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(~F.col("m0").eqNullSafe(F.col("m1")), "modified")
    return a.join(b, "path", "full").select("path", change.alias("change")).filter("change is not null")


def cache_split(files: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files whose content hash is cached (with the cached result), and the others."""
    keyed = files.withColumn("key", F.sha2(F.col("content").cast("binary"), 256))
    return keyed.join(cache, "key"), keyed.join(cache.select("key"), "key", "left_anti")
