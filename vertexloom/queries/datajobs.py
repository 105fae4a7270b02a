"""Queries pN_ of the general problems (1, 2, 3, 6), over their whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vertexloom.operators.hierarchy import descendants, hierarchy, paths
from vertexloom.operators.hotkeys import chunked_counts, ordered_profile
from vertexloom.operators.percentiles import exact_percentiles, value_counts
from vertexloom.operators.snapshots import latest, snapshot_changes

NODE_FIELDS = ("label", "file_type", "source_file", "source_location", "community", "qualified_label", "extractor", "resolution_status", "plan_id")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def link_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(side, id, relation, observed_at, link_id): both ends of every link, the last delivery of each."""
    links = latest(_table(spark, sf_dir, "links"), ["link_id"], "observed_at", ["source", "target", "relation", "observed_at"])
    ends = F.explode(F.array(*(F.struct(F.lit(s).alias("side"), F.col(s).alias("id")) for s in ("source", "target"))))
    return links.select("link_id", "relation", "observed_at", ends.alias("e")).select("e.side", "e.id", "relation", "observed_at", "link_id")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    degrees = chunked_counts(link_ends(spark, sf_dir), ["side", "id"])
    total = _table(spark, sf_dir, "links").agg(F.count_distinct("link_id")).first()[0]  # one number
    return degrees.filter(F.col("n") * 100 >= total).select("side", "id")


def p1_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered_profile(link_ends(spark, sf_dir), ["side", "id"], ["observed_at", "link_id"], "relation", "observed_at")


def _node_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot_changes(_table(spark, sf_dir, "nodes"), "snapshot_no", "id", "seq", NODE_FIELDS, ["community"])


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _node_changes(spark, sf_dir).select("snapshot_no", "id", "change")


def p2_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every change with old and new community, beside what the log reported for it."""
    logged = _table(spark, sf_dir, "drift_events").groupBy("snapshot_no", F.col("node_id").alias("id")).agg(F.count(F.lit(1)).alias("n_reports"))
    changes = _node_changes(spark, sf_dir)
    return changes.join(logged, ["snapshot_no", "id"], "left").withColumn("n_reports", F.coalesce("n_reports", F.lit(0)))


def span_latencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name, day, latency_ns) of the last delivery of each span with a name and a positive latency."""
    spans = _table(spark, sf_dir, "trace_spans").withColumn("span", F.lower("span_id"))
    spans = latest(spans, ["span"], "seq", ["name", "start_time", "end_time"])
    spans = spans.filter("name is not null and end_time > start_time")
    return spans.select(F.lower("name").alias("name"), F.to_date(F.timestamp_micros(F.floor(F.col("start_time") / F.lit(1000)))).alias("day"), (F.col("end_time") - F.col("start_time")).alias("latency_ns"))


def _windows(df: DataFrame) -> DataFrame:
    day = F.struct(F.lit("day").alias("kind"), F.date_format("day", "yyyy-MM-dd").alias("start"))
    week = F.struct(F.lit("week").alias("kind"), F.date_format(F.trunc("day", "week"), "yyyy-MM-dd").alias("start"))
    return df.withColumn("w", F.explode(F.array(day, week))).withColumns({"window_kind": F.col("w.kind"), "window_start": F.col("w.start")})


WINDOW = ("name", "window_kind", "window_start")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    exact = exact_percentiles(_windows(span_latencies(spark, sf_dir)), WINDOW, "latency_ns", (950,))
    told = _table(spark, sf_dir, "runtime_metadata").filter("p95_ms is not null").select(*WINDOW, "p95_ms")
    true_ms = F.col("p950_rank") / F.lit(1e6)
    return told.join(exact, list(WINDOW)).filter(F.abs(F.col("p95_ms") - true_ms) > 0.2 * true_ms).select(*WINDOW).distinct()


def p3_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = exact_percentiles(_windows(span_latencies(spark, sf_dir)), WINDOW, "latency_ns")
    ms = lambda c: F.round(F.col(c) / F.lit(1e6), 6)
    return got.select(*WINDOW, F.col("n").alias("call_count"), ms("p500_rank").alias("p50_ms"), ms("p950_rank").alias("p95_ms"), ms("p990_rank").alias("p99_ms"))


def p3_weeks_from_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly percentiles from daily states of 1 % relative error, merged over the days."""
    days = value_counts(span_latencies(spark, sf_dir), ["name", "day"], "latency_ns", relative_error=0.01)
    weeks = days.withColumn("window_start", F.date_format(F.trunc("day", "week"), "yyyy-MM-dd"))
    got = exact_percentiles(weeks, ["name", "window_start"], "value", weight="n")
    ms = lambda c: F.round(F.col(c) / F.lit(1e6), 6)
    return got.select("name", "window_start", F.col("n").alias("call_count"), ms("p500_rank").alias("p50_ms"), ms("p950_rank").alias("p95_ms"), ms("p990_rank").alias("p99_ms"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = hierarchy(_table(spark, sf_dir, "trace_spans"), "span_id", "parent_span_id", "seq", ("missing_parent", "cycle", "below_cycle"))
    return found.select(F.col("id").alias("span_id"), F.col("top").alias("top_span_id"), "depth", F.col("kind").alias("ends"))


def p6_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = paths(_table(spark, sf_dir, "trace_spans"), "span_id", "parent_span_id", "seq")
    return got.select(F.col("id").alias("span_id"), F.col("top").alias("top_span_id"), "depth", F.col("kind").alias("ends"), F.array_join("path", "/").alias("path"), "n_descendants")


def p6_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every span with each span below it."""
    got = descendants(paths(_table(spark, sf_dir, "trace_spans"), "span_id", "parent_span_id", "seq"))
    return got.select(F.col("id").alias("span_id"), F.col("descendant").alias("descendant_id"), "steps")


QUERIES = {f.__name__: f for f in (p1_found, p1_profiles, p2_found, p2_communities, p3_found, p3_percentiles, p3_weeks_from_days, p6_found, p6_paths, p6_descendants)}

_LINKS = """ends AS (
  SELECT link_id, max_by(source, observed_at) AS source, max_by(target, observed_at) AS target FROM
  (SELECT link_id, {'x': source} AS source, {'x': target} AS target, observed_at FROM links) GROUP BY link_id),
sides AS (SELECT 'source' AS side, source.x AS id FROM ends UNION ALL SELECT 'target', target.x FROM ends)"""
_LAST_SPANS = """s AS (SELECT lower(name) AS name, start_time, end_time - start_time AS lat FROM (
  SELECT *, row_number() OVER (PARTITION BY lower(span_id) ORDER BY seq DESC) AS k FROM trace_spans) t
  WHERE k = 1 AND name IS NOT NULL AND end_time > start_time),
d AS (SELECT name, lat, CAST(make_timestamp(start_time // 1000) AS DATE) AS day FROM s),
w AS (SELECT name, lat, 'day' AS window_kind, strftime(day, '%Y-%m-%d') AS window_start FROM d
      UNION ALL SELECT name, lat, 'week', strftime(date_trunc('week', day), '%Y-%m-%d') FROM d),
r AS (SELECT *, row_number() OVER (PARTITION BY name, window_kind, window_start ORDER BY lat) AS k,
      count(*) OVER (PARTITION BY name, window_kind, window_start) AS n FROM w)"""
_DIFFER = " OR ".join(f"o.{c} IS DISTINCT FROM n.{c}" for c in NODE_FIELDS)
_NODES = f"""v AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY snapshot_no, id ORDER BY seq DESC) AS k FROM nodes) t WHERE k = 1),
c AS (SELECT coalesce(n.snapshot_no, o.snapshot_no + 1) AS snapshot_no, coalesce(n.id, o.id) AS id,
  CASE WHEN o.id IS NULL THEN 'added' WHEN n.id IS NULL THEN 'removed' WHEN {_DIFFER} THEN 'changed' END AS change,
  o.community AS old_community, n.community AS new_community
  FROM v o FULL JOIN v n ON o.id = n.id AND n.snapshot_no = o.snapshot_no + 1)"""
_SPANS = """n AS (SELECT lower(regexp_replace(span_id, '^\\s+|\\s+$', '', 'g')) AS id, lower(regexp_replace(parent_span_id, '^\\s+|\\s+$', '', 'g')) AS up, seq FROM trace_spans),
s AS (SELECT id, CASE WHEN NOT regexp_full_match(up, '0*') THEN up END AS up FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS k FROM n WHERE id IS NOT NULL AND NOT regexp_full_match(id, '0*')) t WHERE k = 1),
w(id, here, trail) AS (SELECT id, id, [id] FROM s UNION ALL SELECT w.id, s.up, list_append(trail, s.up) FROM w JOIN s ON s.id = w.here JOIN s p ON p.id = s.up WHERE NOT list_contains(trail, s.up)),
e AS (SELECT w.id, w.here, trail, s.up, p.id AS there, list_position(trail, s.up) AS pos FROM w JOIN s ON s.id = w.here LEFT JOIN s p ON p.id = s.up WHERE s.up IS NULL OR p.id IS NULL OR list_contains(trail, s.up)),
r AS (SELECT id, CASE WHEN there IS NULL THEN here ELSE list_min(trail[pos:]) END AS top, CAST(CASE WHEN there IS NULL THEN len(trail) - 1 ELSE pos - 1 END AS INTEGER) AS depth,
  CASE WHEN up IS NULL THEN 'root' WHEN there IS NULL THEN 'missing_parent' WHEN pos = 1 THEN 'cycle' ELSE 'below_cycle' END AS ends, list_reverse(CASE WHEN there IS NULL THEN trail ELSE trail[:pos] END) AS path FROM e),
b AS (SELECT path[k] AS id, r.id AS below, len(path) - k AS steps FROM r, generate_series(1, len(path) - 1) g(k))"""
SQL = {
    "p6_found": f"WITH RECURSIVE {_SPANS} SELECT id AS span_id, top AS top_span_id, depth, ends FROM r WHERE ends <> 'root'",
    "p6_paths": f"WITH RECURSIVE {_SPANS} SELECT id AS span_id, top AS top_span_id, depth, ends, array_to_string(path, '/') AS path, (SELECT count(*) FROM b WHERE b.id = r.id) AS n_descendants FROM r",
    "p6_descendants": f"WITH RECURSIVE {_SPANS} SELECT id AS span_id, below AS descendant_id, CAST(steps AS INTEGER) AS steps FROM b",
    "p1_found": f"WITH {_LINKS} SELECT side, id FROM sides WHERE id IS NOT NULL GROUP BY side, id HAVING count(*) * 100 >= (SELECT count(*) FROM ends)",
    "p2_found": f"WITH {_NODES} SELECT CAST(snapshot_no AS INTEGER) AS snapshot_no, id, change FROM c WHERE change IS NOT NULL AND snapshot_no BETWEEN 2 AND (SELECT max(snapshot_no) FROM nodes)",
    "p2_communities": f"WITH {_NODES} SELECT CAST(c.snapshot_no AS INTEGER) AS snapshot_no, c.id, change, old_community, new_community, (SELECT count(*) FROM drift_events e WHERE e.snapshot_no = c.snapshot_no AND e.node_id = c.id) AS n_reports FROM c WHERE change IS NOT NULL AND c.snapshot_no BETWEEN 2 AND (SELECT max(snapshot_no) FROM nodes)",
    "p3_found": f"WITH {_LAST_SPANS}, t AS (SELECT name, window_kind, window_start, min(lat) / 1e6 AS p95 FROM r WHERE k * 100 >= n * 95 GROUP BY ALL) SELECT DISTINCT name, window_kind, window_start FROM runtime_metadata m JOIN t USING (name, window_kind, window_start) WHERE abs(p95_ms - p95) > 0.2 * p95",
    "p3_percentiles": f"WITH {_LAST_SPANS} SELECT name, window_kind, window_start, max(n) AS call_count, round(min(lat) FILTER (k * 1000 >= n * 500) / 1e6, 6) AS p50_ms, round(min(lat) FILTER (k * 1000 >= n * 950) / 1e6, 6) AS p95_ms, round(min(lat) FILTER (k * 1000 >= n * 990) / 1e6, 6) AS p99_ms FROM r GROUP BY name, window_kind, window_start",
}
