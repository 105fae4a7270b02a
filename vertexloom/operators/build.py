"""Building and changing graphs: batches of rows in, nodes and edges out."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vertexloom.functions.paths import language_family, make_id
from vertexloom.operators.durable import shuffled
from vertexloom.sources.graphs import EDGE, NODE, Graph, conform

EDGE_KEY = ("source", "target", "relation", "confidence")


def validate(nodes: DataFrame, edges: DataFrame, hyperedges: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame | None, DataFrame]:
    """Valid rows, and (rule, n) of what was dropped."""
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    bad = {
        "node": (nodes, {"empty id": blank("id"), "empty label": blank("label"), "empty file": blank("source_file")}),
        "edge": (edges, {"empty endpoint": blank("source") | blank("target"), "score out of range": F.coalesce(~F.col("confidence_score").between(0, 1), F.lit(True))}),
    }
    if hyperedges is not None:
        bad["hyperedge"] = (hyperedges, {"fewer than three nodes": F.coalesce(F.size("nodes") < 3, F.lit(True))})
    report, kept = None, {}
    for kind, (df, rules) in bad.items():
        any_bad = F.lit(False)
        for c in rules.values():
            any_bad |= c
        kept[kind] = df.filter(~any_bad)
        counts = df.agg(*(F.count_if(c).alias(f"{kind}: {name}") for name, c in rules.items()))
        counts = counts.unpivot([], list(counts.columns), "rule", "n")
        report = counts if report is None else report.unionByName(counts)
    return kept["node"], kept["edge"], kept.get("hyperedge"), report


def upsert_nodes(rows: DataFrame, seq: str) -> DataFrame:
    """The last row of each id."""
    cols = [c for c in rows.columns if c not in ("id", seq)]
    last = rows.groupBy("id").agg(F.max_by(F.struct(*cols), F.struct(F.col(seq), F.xxhash64(*cols))).alias("r"))
    return conform(last.select("id", "r.*"), NODE)


def add_edges(nodes: DataFrame, rows: DataFrame, seq: str) -> DataFrame:
    """The first row of each logical key whose endpoints both exist."""
    ids = shuffled(nodes.select("id"))
    rows = rows.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    cols = [c for c in rows.columns if c not in (*EDGE_KEY, seq)]
    value = F.struct(*cols) if cols else F.struct(F.lit(1).alias("_"))
    first = rows.groupBy(*EDGE_KEY).agg(F.min_by(value, F.struct(F.col(seq), F.xxhash64(*(cols or EDGE_KEY)))).alias("r"))
    return conform(first.select(*EDGE_KEY, "r.*"), EDGE)


def build_stats(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes inserted and overwritten, edges inserted (repeats included) and dangling."""
    n = rows.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("id").alias("inserted"))
    ids = rows.select("id").distinct()
    ok = edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    e = edges.agg(F.count(F.lit(1)).alias("all_edges"))
    k = ok.agg(F.count(F.lit(1)).alias("edges_inserted"))
    return n.crossJoin(e).crossJoin(k).select(F.col("inserted").alias("nodes_inserted"), (F.col("rows") - F.col("inserted")).alias("nodes_overwritten"), "edges_inserted", (F.col("all_edges") - F.col("edges_inserted")).alias("edges_dangling"))  # single rows


def replace_file(graph: Graph, path: str, nodes: DataFrame, edges: DataFrame, seq: str) -> Graph:
    """The graph with all rows of one file replaced; edges that dangle afterwards are dropped."""
    kept = graph.nodes.filter(F.col("source_file") != path)
    new = upsert_nodes(nodes, seq)
    all_nodes = kept.join(new.select("id"), "id", "left_anti").unionByName(new)
    old = graph.edges.withColumn(seq, F.lit(0).cast("bigint")).filter(F.coalesce(F.col("source_file") != path, F.lit(True)))
    own = edges if seq in edges.columns else edges.withColumn(seq, F.lit(0))
    more = own.select(*((F.col(f.name) if f.name in own.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in EDGE), (F.col(seq) + 1).cast("bigint").alias(seq))
    ids = kept.select("id")
    old = old.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    return Graph(all_nodes, add_edges(all_nodes, old.unionByName(more), seq))


def remove_incident(edges: DataFrame, node: str) -> DataFrame:
    return edges.filter((F.col("source") != node) & (F.col("target") != node))


def remove_between(edges: DataFrame, a: str, b: str, relation: str | None = None) -> DataFrame:
    hit = F.col("source").isin(a, b) & F.col("target").isin(a, b) & ((F.col("source") != F.col("target")) | F.lit(a == b))
    return edges.filter(~(hit & (F.col("relation") == relation) if relation else hit))


def dangling(graph: Graph) -> DataFrame:
    """(source, target, relation, side): each missing endpoint once."""
    ids = graph.nodes.select("id")
    out = None
    for side in ("source", "target"):
        d = graph.edges.join(ids, F.col(side) == F.col("id"), "left_anti").select("source", "target", "relation", F.lit(side).alias("side"))
        out = d if out is None else out.unionByName(d)
    return out


def resolve_imports(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``imports`` edges marked resolved or unresolved by id, label or qualified label of their target."""
    names = nodes.select(F.explode(F.array_distinct(F.array_compact(F.array("id", "label", "qualified_label")))).alias("target")).distinct().withColumn("known", F.lit(True))
    marked = edges.join(names, "target", "left")
    is_import = F.col("relation") == "imports"
    status = F.when(is_import, F.when(F.col("known"), "resolved").otherwise("unresolved")).otherwise(F.col("resolution_status"))
    return marked.withColumns({"resolution_status": status, "extractor": F.when(is_import, "import_resolver").otherwise(F.col("extractor"))}).select(*edges.columns)


def resolve_calls(nodes: DataFrame, edges: DataFrame, relations: tuple[str, ...] = ("calls", "implements", "inherits")) -> DataFrame:
    """Behavioural edges to names bound where exactly one node of the same language family answers; unbound ones go."""
    ids = nodes.select("id", language_family("source_file").alias("family"))
    names = nodes.select(F.explode(F.array_distinct(F.array_compact(F.array("label", "qualified_label")))).alias("name"), F.col("id").alias("bound"), language_family("source_file").alias("family"))
    open_ = edges.filter(F.col("relation").isin(*relations)).join(ids, F.col("target") == ids["id"], "left_anti")
    rows = open_.withColumn("eid", F.xxhash64(*EDGE_KEY)).join(ids.select(F.col("id").alias("source"), "family"), "source")
    one = rows.select("eid", F.col("target").alias("name"), "family").join(names, ["name", "family"]).groupBy("eid").agg(F.count_distinct("bound").alias("n"), F.first("bound").alias("bound")).filter("n = 1").select("eid", "bound")
    bound = rows.join(one, "eid").withColumns({"target": F.col("bound"), "confidence": F.lit("INFERRED"), "confidence_score": F.lit(0.5), "resolution_status": F.lit("heuristic")})
    settled = edges.filter(~F.col("relation").isin(*relations)).unionByName(edges.filter(F.col("relation").isin(*relations)).join(ids, F.col("target") == ids["id"], "left_semi"))
    return settled.unionByName(bound.select(*edges.columns))


def split_module_imports(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(source, name, bound): ``module_name`` imports split at the right-most _ whose parts are a file stem and a label."""
    from vertexloom.functions.paths import stem

    cut = F.sequence(F.lit(1), F.length("target") - 1)
    parts = edges.filter("relation = 'imports' and length(target) > 2").select("source", F.col("target").alias("name"), F.explode(F.filter(cut, lambda k: F.substring("target", k, F.lit(1)) == "_")).alias("k"))
    parts = parts.select("source", "name", "k", F.substring("name", F.lit(1), F.col("k") - 1).alias("stem"), F.substring("name", F.col("k") + 1, F.length("name")).alias("label"))
    known = nodes.select(F.col("id").alias("bound"), stem("source_file").alias("stem"), F.lower("label").alias("label"))
    hit = parts.withColumn("label", F.lower("label")).join(known, ["stem", "label"])
    return hit.groupBy("source", "name").agg(F.max_by("bound", F.struct("k", "bound")).alias("bound"))


def preferred_binding(nodes: DataFrame, refs: DataFrame) -> DataFrame:
    """(ref_file, name, id): the node of that label, one of the same file first, then the least id."""
    hits = refs.join(nodes.select("id", F.col("label").alias("name"), "source_file"), "name")
    return hits.groupBy("ref_file", "name").agg(F.min_by("id", F.struct(F.col("source_file") != F.col("ref_file"), "id")).alias("id"))


def cross_file_edges(graph: Graph) -> DataFrame:
    """(source_file, target_file, relation, n) of edges between different files."""
    f = graph.nodes.select("id", "source_file")
    e = graph.edges.select("source", "target", "relation")
    e = e.join(f.select(F.col("id").alias("source"), F.col("source_file").alias("from_file")), "source").join(f.select(F.col("id").alias("target"), F.col("source_file").alias("to_file")), "target")
    return e.filter("from_file <> to_file").groupBy("from_file", "to_file", "relation").agg(F.count(F.lit(1)).alias("n"))


def baseline(graph: Graph) -> Graph:
    return Graph(graph.nodes.filter("plan_id is null"), graph.edges.filter("plan_id is null"))


def virtual(graph: Graph, plan: str) -> Graph:
    own = F.col("plan_id").isNull() | (F.col("plan_id") == plan)
    return Graph(graph.nodes.filter(own), graph.edges.filter(own))


def planned(graph: Graph, plan: str) -> Graph:
    return Graph(graph.nodes.filter(F.col("plan_id") == plan), graph.edges.filter(F.col("plan_id") == plan))


def merged_batches(batches: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """(kind, tokens, n) over batches of nodes and edges put one after the other: token sums and rows of each kind."""
    rows = [df.select(F.lit(k).alias("kind"), "tokens") for b in batches for k, df in zip(("node", "edge"), b)]
    return functools.reduce(DataFrame.unionByName, rows).groupBy("kind").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n"))


def plan_symbols(symbols: DataFrame, plan: str) -> tuple[DataFrame, DataFrame]:
    """Planned nodes, and planned edges to ``target`` where it isn't NULL, of (label, source_file, target, relation)."""
    pid = make_id(F.lit(plan), "label")
    nodes = symbols.select(pid.alias("id"), "label", F.lit("code").alias("file_type"), "source_file", F.lit("planned").alias("resolution_status"), F.lit(plan).alias("plan_id"))
    edges = symbols.filter("target is not null").select(pid.alias("source"), "target", "relation", F.lit("INFERRED").alias("confidence"), F.lit(0.5).alias("confidence_score"), F.lit(0.8).alias("weight"), F.lit("planned").alias("resolution_status"), F.lit(plan).alias("plan_id"))
    return conform(nodes, NODE), conform(edges, EDGE)


def build_targets(targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of build targets (name, kind, file, depends_on, tests, runs_in arrays)."""
    nid = lambda c: make_id(F.lit("target"), c)
    nodes = targets.select(nid("name").alias("id"), F.col("name").alias("label"), F.lit("code").alias("file_type"), F.col("file").alias("source_file"))
    out = None
    for relation in ("depends_on", "tests", "runs_in"):
        e = targets.select(nid("name").alias("source"), F.explode(relation).alias("t")).select("source", nid("t").alias("target"), F.lit(relation).alias("relation"), F.lit("EXTRACTED").alias("confidence"), F.lit(1.0).alias("confidence_score"), F.lit(1.0).alias("weight"))
        out = e if out is None else out.unionByName(e)
    return conform(nodes, NODE), conform(out, EDGE)
