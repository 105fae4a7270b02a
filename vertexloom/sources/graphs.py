"""Graphs from files and from relational tables."""

from __future__ import annotations

import functools
import re
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S, _D, _L = T.StringType(), T.DoubleType(), T.LongType()
NODE = T.StructType([T.StructField(c, _L if c == "community" else _S) for c in ("id", "label", "file_type", "source_file", "source_location", "community", "qualified_label", "extractor", "resolution_status", "plan_id")])
EDGE = T.StructType([T.StructField(c, _D if c in ("confidence_score", "weight") else _S) for c in ("source", "target", "relation", "confidence", "confidence_score", "source_file", "weight", "src_original", "tgt_original", "source_location", "extractor", "resolution_status", "plan_id")])
HYPEREDGE = T.StructType([T.StructField("id", _S), T.StructField("label", _S), T.StructField("nodes", T.ArrayType(_S)), T.StructField("relation", _S), T.StructField("confidence", _S), T.StructField("confidence_score", _D), T.StructField("source_file", _S)])
METADATA = T.StructType([T.StructField("ast_only", T.BooleanType()), T.StructField("schema_version", _S), T.StructField("created_at", _S), T.StructField("project_root", _S), T.StructField("extraction_modes", T.ArrayType(_S)), T.StructField("languages", T.ArrayType(_S))])


@dataclass(frozen=True)
class Graph:
    nodes: DataFrame
    edges: DataFrame
    hyperedges: DataFrame | None = None
    metadata: DataFrame | None = None

    def with_(self, **parts: DataFrame) -> Graph:
        return replace(self, **parts)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns of ``schema``, missing ones NULL."""
    return df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema))


#: Graph of the star tables: containment by geography, calls by orders and a ring of parts, imports by lines.
NODES_SQL = """SELECT 'region_' || CAST(r_regionkey AS STRING) AS id, r_name AS label, 'document' AS file_type, 'geo/regions/region.md' AS source_file, '' AS source_location, CAST(NULL AS BIGINT) AS community FROM region
UNION ALL SELECT 'nation_' || CAST(n_nationkey AS STRING), n_name, 'document', 'geo/nations/nation.md', '', CAST(n_nationkey AS BIGINT) FROM nation
UNION ALL SELECT 'customer_' || CAST(c_custkey AS STRING), c_name, 'code', 'src/controllers/' || lower(c_mktsegment) || '.rs', 'L1', CAST(c_nationkey AS BIGINT) FROM customer
UNION ALL SELECT 'supplier_' || CAST(s_suppkey AS STRING), s_name, 'code', 'src/db/supplier_' || CAST(s_suppkey % 5 AS STRING) || '.rs', 'L1', CAST(s_nationkey AS BIGINT) FROM supplier
UNION ALL SELECT 'part_' || CAST(p_partkey AS STRING), p_name, 'code', CASE WHEN p_partkey % 11 = 0 THEN 'vendor/parts/part.rs' WHEN p_partkey % 13 = 0 THEN 'src/tests/part_test.rs' ELSE 'src/services/' || lower(p_type) || '.rs' END, 'L1', CAST(p_partkey % 25 AS BIGINT) FROM part"""
EDGES_SQL = """WITH raw AS (SELECT 'region_' || CAST(n_regionkey AS STRING) AS source, 'nation_' || CAST(n_nationkey AS STRING) AS target, 'contains' AS relation, 'EXTRACTED' AS confidence FROM nation
UNION ALL SELECT 'nation_' || CAST(c_nationkey AS STRING), 'customer_' || CAST(c_custkey AS STRING), 'contains', 'EXTRACTED' FROM customer
UNION ALL SELECT 'nation_' || CAST(s_nationkey AS STRING), 'supplier_' || CAST(s_suppkey AS STRING), 'contains', 'EXTRACTED' FROM supplier
UNION ALL SELECT 'customer_' || CAST(o_custkey AS STRING), 'part_' || CAST(l_partkey AS STRING), 'calls', CASE min(l_returnflag) WHEN 'A' THEN 'INFERRED' WHEN 'N' THEN 'EXTRACTED' ELSE 'AMBIGUOUS' END FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_linenumber = 1 AND o_orderpriority = '1-URGENT' GROUP BY o_custkey, l_partkey
UNION ALL SELECT DISTINCT 'part_' || CAST(l_partkey AS STRING), 'supplier_' || CAST(l_suppkey AS STRING), 'imports', 'EXTRACTED' FROM lineitem WHERE l_linenumber = 1 AND l_returnflag = 'R'
UNION ALL SELECT 'part_' || CAST(p_partkey AS STRING), 'part_' || CAST((p_partkey * 7 + 3) % (SELECT count(*) FROM part) AS STRING), 'calls', 'INFERRED' FROM part)
SELECT source, target, relation, confidence, CAST(CASE confidence WHEN 'EXTRACTED' THEN 1.0 WHEN 'INFERRED' THEN 0.5 ELSE 0.2 END AS DOUBLE) AS confidence_score, CAST(CASE confidence WHEN 'INFERRED' THEN 0.8 ELSE 1.0 END AS DOUBLE) AS weight,
CASE WHEN relation = 'contains' OR confidence = 'EXTRACTED' THEN 'resolved' WHEN confidence = 'INFERRED' THEN 'heuristic' ELSE 'unresolved' END AS resolution_status FROM raw"""


_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")


def _private(sql: str) -> str:
    """The text with views of our own in place of the tables', so that no view of the session is touched."""
    return re.sub(rf"\b(FROM|JOIN) ({'|'.join(_TABLES)})\b", r"\1 __star_\2", sql)


def star_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """The graph of the star tables in ``sf_dir``, written once an application and read from then on."""
    return _stored_star(spark.sparkContext.applicationId, sf_dir, spark)


@functools.lru_cache(16)
def _stored_star(application: str, sf_dir: str, spark: SparkSession) -> Graph:
    from vertexloom.operators.durable import durable

    for t in _TABLES:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(f"__star_{t}")
    return Graph(durable(conform(spark.sql(_private(NODES_SQL)), NODE)), durable(conform(spark.sql(_private(EDGES_SQL)), EDGE)))


def link_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """The graph of the delivered tables: the nodes of the last snapshot and the framework's, and the last
    delivery of each link whose both ends are among them."""
    from vertexloom.operators.durable import durable
    from vertexloom.operators.snapshots import latest

    nodes = spark.read.parquet(f"{sf_dir}/nodes.parquet")
    last = nodes.agg(F.max("snapshot_no")).first()[0]
    cols = [c for c in nodes.columns if c not in ("snapshot_no", "id", "seq")]
    own = latest(nodes.filter((F.col("snapshot_no") == F.lit(last)) & F.col("id").isNotNull()), ["id"], "seq", cols)
    rest = spark.read.parquet(f"{sf_dir}/framework_nodes.parquet").join(own.select("id"), "id", "left_anti")
    every = durable(conform(own, NODE).unionByName(conform(rest, NODE)))
    links = spark.read.parquet(f"{sf_dir}/links.parquet")
    links = latest(links, ["link_id"], "observed_at", [c for c in links.columns if c != "link_id"]).filter("source is not null and target is not null")
    # Few ids hold most links: the ids side is sent to all tasks where it is small, else skewed parts are split at run time.
    ends = links.join(every.select(F.col("id").alias("source")), "source", "left_semi").join(every.select(F.col("id").alias("target")), "target", "left_semi")
    return Graph(every, durable(conform(ends, EDGE)))


def star_plan(spark: SparkSession, sf_dir: str, graph: Graph) -> Graph:
    """The star graph with the virtual rows of plan ``alpha``: a planned node and call per 29th customer."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").filter("c_custkey % 29 = 0")
    n = spark.read.parquet(f"{sf_dir}/supplier.parquet").agg(F.count(F.lit(1)).alias("n_supp"))
    pid = F.concat(F.lit("alpha_customer_"), F.col("c_custkey").cast("string"))
    nodes = c.select(pid.alias("id"), F.concat(F.lit("Planned"), "c_name").alias("label"), F.lit("code").alias("file_type"), F.lit("src/controllers/planned.rs").alias("source_file"), F.lit("alpha").alias("plan_id"))
    edges = c.join(F.broadcast(n)).select(pid.alias("source"), F.concat(F.lit("supplier_"), (F.col("c_custkey") % F.col("n_supp")).cast("string")).alias("target"), F.lit("calls").alias("relation"), F.lit("INFERRED").alias("confidence"), F.lit(0.5).alias("confidence_score"), F.lit(0.8).alias("weight"), F.lit("alpha").alias("plan_id"))
    return Graph(graph.nodes.unionByName(conform(nodes, NODE)), graph.edges.unionByName(conform(edges, EDGE)))


def read_json_graph(spark: SparkSession, path: str) -> Graph:
    """Node-link JSON: unreadable rows are skipped, dangling links dropped, later nodes overwrite."""
    from vertexloom.operators.build import add_edges, upsert_nodes

    schema = T.StructType([T.StructField("nodes", T.ArrayType(NODE)), T.StructField("links", T.ArrayType(EDGE)), T.StructField("hyperedges", T.ArrayType(HYPEREDGE)), T.StructField("metadata", METADATA)])
    doc = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    rows = lambda c: doc.select(F.posexplode(c).alias("seq", "r")).select("seq", "r.*")
    nodes = upsert_nodes(rows("nodes").filter("id is not null and label is not null"), "seq")
    edges = add_edges(nodes, rows("links").filter("source is not null and target is not null and relation is not null"), "seq")
    return Graph(nodes, edges, doc.select(F.explode("hyperedges").alias("r")).select("r.*"), doc.select("metadata.*"))


def write_json_graph(graph: Graph, path: str) -> None:
    """JSON lines of nodes and links, one file a partition, as ``read_json_lines`` takes them."""
    row = lambda kind, df: df.select(F.to_json(F.struct(F.lit(kind).alias("kind"), *df.columns)).alias("value"))
    row("node", graph.nodes).unionByName(row("link", graph.edges)).write.text(path)


def read_json_lines(spark: SparkSession, path: str) -> Graph:
    """The graph that ``write_json_graph`` wrote."""
    lines = spark.read.text(path)
    of = lambda kind, schema: lines.filter(F.get_json_object("value", "$.kind") == kind).select(F.from_json("value", schema).alias("r")).select("r.*")
    return Graph(of("node", NODE), of("link", EDGE))


def write_snapshot(graph: Graph, root: str, name: str) -> None:
    graph.nodes.write.parquet(f"{root}/{name}/nodes")
    graph.edges.write.partitionBy("relation").parquet(f"{root}/{name}/edges")


def read_snapshot(spark: SparkSession, root: str, name: str) -> Graph:
    return Graph(conform(spark.read.parquet(f"{root}/{name}/nodes"), NODE), conform(spark.read.parquet(f"{root}/{name}/edges"), EDGE))


def list_snapshots(spark: SparkSession, root: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(root)
    name = F.regexp_extract(F.col("path"), r"/([^/]+)/(?:nodes|edges)/", 1).alias("name")
    return files.select(name, "modificationTime", "length").groupBy("name").agg(F.max("modificationTime").alias("created_at"), F.sum("length").alias("bytes"))


def read_corpus(spark: SparkSession, root: str, ignore: Sequence[str] = (), types: bool = True) -> DataFrame:
    """(path, modified, content, file_type) of a source tree, without skipped folders, sensitive names and what the
    lines of an ignore file (``ignore``) cover; ``types`` drops files of no known type."""
    from vertexloom.functions.paths import file_type, ignore_regex, in_skipped_dir, is_sensitive

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = F.regexp_replace("path", "^file:", "")
    own = files.withColumn("rel", F.regexp_replace(F.replace(base, F.lit(root.rstrip("/")), F.lit("")), "^/+", ""))
    own = own.filter(~in_skipped_dir("rel") & ~is_sensitive("rel"))
    for rx in filter(None, map(ignore_regex, ignore)):
        own = own.filter(~F.col("rel").rlike(rx))
    out = own.select("path", F.col("modificationTime").alias("modified"), F.col("content").cast("string").alias("content"), file_type("rel").alias("file_type"))
    return out.filter("file_type is not null") if types else out


def is_stale(files: DataFrame, built_at: str) -> DataFrame:
    """One row (stale, newest): has any file (column modified) changed since the graph was built?"""
    return files.agg(F.coalesce(F.max("modified") > F.lit(built_at).cast("timestamp"), F.lit(False)).alias("stale"), F.max("modified").alias("newest"))


SPAN = "struct<name:string,span_id:string,parent_span_id:string,kind:string,start_time:bigint,end_time:bigint,attributes:map<string,string>,status:string>"


def parse_spans(df: DataFrame, text: str) -> DataFrame:
    """Spans of OTEL JSON texts: a flat array, or an object that wraps one."""
    flat, wrapped = F.from_json(text, f"array<{SPAN}>"), F.from_json(text, f"struct<spans:array<{SPAN}>>")["spans"]
    spans = F.when(F.ltrim(F.col(text)).startswith("["), flat).otherwise(wrapped)
    return df.select(F.explode(spans).alias("s")).select("s.*")


def parse_policy(df: DataFrame, text: str) -> DataFrame:
    """One row a rule of a policy text; no text, no rules."""
    rule = "array<struct<type:string,from_pattern:string,to_pattern:string,layers:array<string>,symbol_label:string,reason:string>>"
    return df.select(F.explode(F.from_json(text, f"struct<rules:{rule}>")["rules"]).alias("r")).select("r.*")


def parse_extraction(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, kind, id, source, target): items of a model's answer, read as JSON, from a code fence, or from brace to brace."""
    t = F.col(text)
    fenced = F.regexp_extract(t, r"(?s)```(?:json)?\s*(.*?)```", 1)
    braced = F.regexp_extract(t, r"(?s)(\{.*\})", 1)
    schema = "struct<nodes:array<struct<id:string,label:string>>,edges:array<struct<source:string,target:string,relation:string>>>"
    got = F.coalesce(*(F.when(F.get_json_object(x, "$.nodes").isNotNull() | F.get_json_object(x, "$.edges").isNotNull(), F.from_json(x, schema)) for x in (t, fenced, braced)))
    one = lambda kind, i, s, d: F.struct(F.lit(kind).alias("kind"), i.alias("id"), s.alias("source"), d.alias("target"))
    none = F.lit(None).cast("string")
    items = F.concat(
        F.transform(F.coalesce(got["nodes"], F.array().cast("array<struct<id:string,label:string>>")), lambda n: one("node", n["id"], none, none)),
        F.transform(F.coalesce(got["edges"], F.array().cast("array<struct<source:string,target:string,relation:string>>")), lambda e: one("edge", none, e["source"], e["target"])),
    )
    rows = df.select(key, F.explode(items).alias("i")).select(key, "i.*")
    return rows.filter("(kind = 'node' and id <> '') or (kind = 'edge' and source <> '' and target <> '')")
