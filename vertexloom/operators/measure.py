"""Aggregates, filters and scores over a graph."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vertexloom.functions.paths import VENDOR_DIRS, display_label, extension, is_framework_label, is_generated_path, is_test_path, stem, top_dir, unix_path
from vertexloom.operators.durable import durable, numbered, partitions, shuffled
from vertexloom.sources.graphs import Graph

BEHAVIOUR = ("calls", "imports", "inherits", "implements", "contains")


def half_edges(edges: DataFrame, *carry: str) -> DataFrame:
    """(id, other, ...) of both ends of every edge; a loop counts once."""
    a = edges.select(F.col("source").alias("id"), F.col("target").alias("other"), *carry)
    return a.unionByName(edges.filter("source <> target").select(F.col("target").alias("id"), F.col("source").alias("other"), *carry))


def degrees(graph: Graph) -> DataFrame:
    """(id, degree) of every node: incident edges, parallel ones counted, 0 included."""
    n = half_edges(graph.edges).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    return graph.nodes.select("id").join(shuffled(n), "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))


def histogram(df: DataFrame, by: str) -> DataFrame:
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n"))


def scope(nodes: DataFrame, include: Sequence[str] = (), exclude: Sequence[str] = (), types: Sequence[str] = (), generated: str = "include", tests: bool = True, virtual: bool = False) -> DataFrame:
    """Nodes within path, type, generated-code and test limits; without any limit planned rows stay, else ``virtual`` admits them."""
    path = unix_path("source_file")
    limited = include or exclude or types or generated != "include" or not tests
    out = nodes if virtual or not limited else nodes.filter("plan_id is null")
    for x in exclude:
        out = out.filter(~path.contains(x.lower()))
    if include:
        hit = F.lit(False)
        for x in include:
            hit |= path.contains(x.lower())
        out = out.filter(hit)
    if types:
        out = out.filter(F.col("file_type").isin(*types))
    if generated != "include":
        out = out.filter(is_generated_path("source_file") if generated == "only" else ~is_generated_path("source_file"))
    return out if tests else out.filter(~is_test_path("source_file"))


def relation_scope(edges: DataFrame, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> DataFrame:
    """Edges whose relation contains a wanted fragment and no unwanted one."""
    has = lambda xs: F.exists(F.array(*map(F.lit, xs)), lambda x: F.contains(F.lower("relation"), x))
    out = edges.filter(has(include)) if include else edges
    return out.filter(~has(exclude)) if exclude else out


def resolution_report(edges: DataFrame) -> DataFrame:
    """One row of conditional counts over the edges."""
    imports, calls = F.col("relation") == "imports", F.col("relation") == "calls"
    is_ = lambda s: F.coalesce(F.col("resolution_status") == s, F.lit(False))
    return edges.agg(
        F.count(F.lit(1)).alias("edges"), F.count_if(imports).alias("imports"), F.count_if(imports & is_("resolved")).alias("imports_resolved"), F.count_if(imports & is_("unresolved")).alias("imports_unresolved"),
        F.count_if(calls).alias("calls"), F.count_if(calls & is_("resolved")).alias("calls_resolved"), F.count_if(calls & is_("heuristic")).alias("calls_heuristic"), F.count_if(calls & is_("unresolved")).alias("calls_unresolved"),
        F.count_if(F.col("confidence") == "AMBIGUOUS").alias("ambiguous"),
    )


def quality_risk(graph: Graph, n: int = 10) -> DataFrame:
    """(id, degree, unresolved, risk) of the riskiest nodes: unresolved calls over edges, times degree, from degree 3 on."""
    e = half_edges(graph.edges, "relation", "resolution_status")
    own = e.groupBy("id").agg(F.count(F.lit(1)).alias("degree"), F.count_if((F.col("relation") == "calls") & (F.col("resolution_status") == "unresolved")).alias("unresolved"))
    own = own.filter("degree >= 3 and unresolved > 0").withColumn("risk", F.round(F.col("unresolved") / F.col("degree") * F.col("degree"), 3))
    return own.orderBy(F.col("risk").desc(), "id").limit(n)


def unresolved_by_file(edges: DataFrame, n: int = 20) -> DataFrame:
    """(source_file, total_edges, unresolved_refs) of the files with most unresolved imports."""
    lost = F.count_if((F.col("relation") == "imports") & (F.col("resolution_status") == "unresolved"))
    out = edges.groupBy("source_file").agg(F.count(F.lit(1)).alias("total_edges"), lost.alias("unresolved_refs")).filter("unresolved_refs > 0")
    return out.orderBy(F.col("unresolved_refs").desc(), "source_file").limit(n)


def trusted(edges: DataFrame, least: float = 0.0, extracted_only: bool = False) -> DataFrame:
    """Edges of at least this confidence score, or only extracted ones."""
    out = edges.filter(F.coalesce("confidence_score", F.lit(0.0)) >= least)
    return out.filter("confidence = 'EXTRACTED'") if extracted_only else out


def degrees_in_scope(graph: Graph, ids: DataFrame) -> DataFrame:
    """(id, degree) of the nodes ``ids``: edges whose both ends are among them."""
    keep = ids.select("id").distinct()
    inside = half_edges(graph.edges).join(keep, "id", "left_semi").join(keep.withColumnRenamed("id", "other"), "other", "left_semi")
    n = inside.groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    return keep.join(n, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))


def least_degree(graph: Graph, nodes: DataFrame, least: int) -> DataFrame:
    return nodes.join(degrees(graph).filter(F.col("degree") >= least).select("id"), "id", "left_semi")


def in_module(nodes: DataFrame, fragment: str) -> DataFrame:
    """Nodes whose path, qualified label or label holds the fragment, in any case."""
    f = F.lit(fragment.lower())
    hit = unix_path("source_file").contains(f) | F.coalesce(F.lower("qualified_label").contains(f), F.lit(False)) | F.lower("label").contains(f)
    return nodes.filter(hit) if fragment else nodes.limit(0)


def colliding_labels(nodes: DataFrame) -> DataFrame:
    """(id, shown): the label, or ``qualified (label)`` where several nodes bear it and one is qualified."""
    n = nodes.groupBy(F.lower("label").alias("l")).agg(F.count(F.lit(1)).alias("n"))
    both = F.when((F.col("n") > 1) & F.col("qualified_label").isNotNull(), F.format_string("%s (%s)", "qualified_label", "label"))
    return nodes.withColumn("l", F.lower("label")).join(n, "l", "left").select("id", F.coalesce(both, "label").alias("shown"))


def worst_collisions(nodes: DataFrame, n: int = 3) -> DataFrame:
    return label_collisions(nodes).orderBy(F.col("n").desc(), "label").limit(n)


def file_histograms(paths: DataFrame, path: str = "path") -> DataFrame:
    """(kind, name, n): files by extension, and path components that look vendored."""
    ext = paths.select(F.lit("extension").alias("kind"), F.when(extension(path) == "", "no-ext").otherwise(extension(path)).alias("name"))
    dirs = paths.select(F.explode(F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))).alias("name")).filter(F.col("name").isin(*VENDOR_DIRS))
    return ext.unionByName(dirs.select(F.lit("vendor").alias("kind"), "name")).groupBy("kind", "name").agg(F.count(F.lit(1)).alias("n"))


def top_counts(df: DataFrame, per: Sequence[str], by: str, n: int) -> DataFrame:
    """(per..., by, n, k): the most frequent values of each group, ties by value."""
    counts = df.groupBy(*per, by).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("k", F.row_number().over(Window.partitionBy(*per).orderBy(F.col("n").desc(), by))).filter(F.col("k") <= n)


def focus_labels(files: DataFrame, group: str, path: str) -> DataFrame:
    """(group, focus): the longest common folder of a group's files, of two parts or more, else its two commonest files.

    The first and the last path in order have the prefix that all have in common, so two values a
    group are compared, not its members.
    """
    clean = F.regexp_replace(F.replace(F.regexp_replace(F.col(path), r"^\\\\\?\\", ""), F.lit("\\"), F.lit("/")), "^/+", "")
    parts = F.filter(F.split(clean, "/"), lambda x: x != "")
    keyed = files.select(group, F.transform(parts, lambda x: F.lower(x)).alias("low"), parts.alias("parts"))
    ends = keyed.groupBy(group).agg(F.min("low").alias("a"), F.max("low").alias("b"), F.min_by("parts", F.struct("low", "parts")).alias("parts"))
    k = F.aggregate(F.zip_with("a", "b", lambda x, y: F.coalesce(x == y, F.lit(False))), F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda s, e: F.struct((s["n"] + (s["on"] & e).cast("int")).alias("n"), (s["on"] & e).alias("on")), lambda s: s["n"])
    shared = F.slice("parts", 1, k)
    folder = F.when(F.element_at(shared, -1).contains("."), F.slice(shared, 1, F.size(shared) - 1)).otherwise(shared)
    prefix = ends.select(group, F.when(k > 0, folder).alias("f")).select(group, F.when(F.size("f") > 1, F.array_join("f", "/")).alias("prefix"))
    top = top_counts(files, [group], path, 2).groupBy(group).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", path))), lambda x: x[path]), " | ").alias("commonest"))
    return prefix.join(top, group).select(group, F.coalesce("prefix", "commonest").alias("focus"))


def with_ends(graph: Graph, *cols: str) -> DataFrame:
    """Edges with the named node columns of both ends, as s_<col> and t_<col>."""
    out = graph.edges
    for side, key in (("s", "source"), ("t", "target")):
        out = out.join(shuffled(graph.nodes.select(F.col("id").alias(key), *(F.col(c).alias(f"{side}_{c}") for c in cols))), key)
    return out


def community_stats(graph: Graph) -> DataFrame:
    """(community, size, internal, cohesion, focus): internal edges over possible pairs, 0 for a single member."""
    own = graph.nodes.filter("community is not null")
    size = own.groupBy("community").agg(F.count(F.lit(1)).alias("size"))
    internal = with_ends(graph, "community").filter("s_community = t_community").groupBy(F.col("s_community").alias("community")).agg(F.count(F.lit(1)).alias("internal"))
    pairs = F.col("size") * (F.col("size") - 1) / 2
    cohesion = F.round(F.when(F.col("size") > 1, F.coalesce("internal", F.lit(0)) / pairs).otherwise(0.0), 9)
    out = size.join(internal, "community", "left").join(focus_labels(own, "community", "source_file"), "community")
    return out.select("community", "size", F.coalesce("internal", F.lit(0)).alias("internal"), cohesion.alias("cohesion"), "focus")


def community_members(nodes: DataFrame, n: int = 200) -> DataFrame:
    """(community, id): the first ``n`` members of each community, a page of a listing."""
    own = nodes.filter("community is not null")
    return own.withColumn("k", F.row_number().over(Window.partitionBy("community").orderBy("id"))).filter(F.col("k") <= n).select("community", "id")


def community_summary(graph: Graph, n: int = 5) -> DataFrame:
    """(community, section, name, n) of every community: its commonest types, files, inner and boundary
    relations, and its nodes of highest degree, ``n`` of each."""
    own = graph.nodes.filter("community is not null")
    e = with_ends(graph, "community")
    inner = e.filter("s_community = t_community").select(F.col("s_community").alias("community"), F.lit("internal").alias("section"), F.col("relation").alias("name"))
    side = lambda c: e.filter("s_community is not null or t_community is not null").filter(~F.col("s_community").eqNullSafe(F.col("t_community"))).select(F.col(c).alias("community"), F.lit("boundary").alias("section"), F.col("relation").alias("name")).filter("community is not null")
    of = lambda section, c: own.select("community", F.lit(section).alias("section"), F.col(c).alias("name"))
    rows = of("type", "file_type").unionByName(of("file", "source_file")).unionByName(inner).unionByName(side("s_community")).unionByName(side("t_community"))
    counted = top_counts(rows, ["community", "section"], "name", n).select("community", "section", "name", "n")
    d = degrees(graph).join(shuffled(own.select("id", "label", "community")), "id")
    top = d.withColumn("k", F.row_number().over(Window.partitionBy("community").orderBy(F.col("degree").desc(), "label", "id"))).filter(F.col("k") <= n)
    return counted.unionByName(top.select("community", F.lit("node").alias("section"), F.col("id").alias("name"), F.col("degree").alias("n")))


def community_overview(graph: Graph) -> DataFrame:
    """(community, internal, boundary, external_communities, top_node)."""
    e = with_ends(graph, "community").filter("s_community is not null and t_community is not null")
    ends = e.select(F.explode(F.array(F.struct(F.col("s_community").alias("c"), F.col("t_community").alias("o")), F.struct(F.col("t_community").alias("c"), F.col("s_community").alias("o")))).alias("x")).select("x.*")
    n = ends.groupBy(F.col("c").alias("community")).agg(F.floor(F.count_if(F.col("c") == F.col("o")) / 2).alias("internal"), F.count_if(F.col("c") != F.col("o")).alias("boundary"), F.count_distinct(F.when(F.col("c") != F.col("o"), F.col("o"))).alias("external_communities"))
    top = degrees(graph).join(graph.nodes.select("id", "community"), "id").filter("community is not null").groupBy("community").agg(F.min_by("id", F.struct(-F.col("degree"), "id")).alias("top_node"))
    return n.join(top, "community")


def bridges(graph: Graph) -> DataFrame:
    """(id, cross_edges, external_communities) of nodes with edges into other communities."""
    c = graph.nodes.select("id", "community")
    h = half_edges(graph.edges).join(c, "id").join(c.select(F.col("id").alias("other"), F.col("community").alias("oc")), "other")
    return h.filter("community is not null and oc is not null and community <> oc").groupBy("id").agg(F.count(F.lit(1)).alias("cross_edges"), F.count_distinct("oc").alias("external_communities"))


def boundary_crossings(graph: Graph) -> DataFrame:
    """(source, target, relation, score) of edges between communities, score = weight x confidence score."""
    e = with_ends(graph, "community").filter("s_community <> t_community")
    return e.select("source", "target", "relation", "confidence", F.round(F.col("weight") * F.col("confidence_score"), 9).alias("score"))


def label_collisions(nodes: DataFrame) -> DataFrame:
    """(label, n, n_files) of labels, in any case, that several nodes bear."""
    return nodes.groupBy(F.lower("label").alias("label")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("source_file").alias("n_files")).filter("n > 1")


def module_dependencies(graph: Graph, a: str, b: str) -> DataFrame:
    """(direction, relation, n) of edges between two path fragments."""
    e = with_ends(graph, "source_file")
    has = lambda c, x: F.contains(F.lower(c), F.lit(x.lower()))
    d = F.when(has("s_source_file", a) & has("t_source_file", b), "forward").when(has("s_source_file", b) & has("t_source_file", a), "backward")
    return e.select(d.alias("direction"), "relation").filter("direction is not null").groupBy("direction", "relation").agg(F.count(F.lit(1)).alias("n"))


def blast_radius(graph: Graph, ids: DataFrame) -> DataFrame:
    """One row: nodes one hop from ``ids`` in either direction, their files and communities, edges by confidence."""
    h = half_edges(graph.edges, "confidence").join(ids.select("id"), "id", "left_semi")
    n = h.join(graph.nodes.select(F.col("id").alias("other"), "source_file", "community"), "other")
    return n.agg(F.count_distinct("other").alias("nodes"), F.count_distinct("source_file").alias("files"), F.count_distinct("community").alias("communities"), F.count_if(F.col("confidence") == "EXTRACTED").alias("extracted"), F.count_if(F.col("confidence") == "INFERRED").alias("inferred"), F.count_if(F.col("confidence") == "AMBIGUOUS").alias("ambiguous"))


def import_only(graph: Graph) -> DataFrame:
    """(id) of nodes all of whose edges are imports."""
    return half_edges(graph.edges, "relation").groupBy("id").agg(F.bool_and(F.lower("relation") == "imports").alias("only")).filter("only").select("id")


def framework_noise(graph: Graph) -> DataFrame:
    """(id) of import-only nodes that bear a standard library's name and not their file's."""
    named = graph.nodes.filter((F.lower("label") != F.lower(stem("source_file"))) & is_framework_label("label")).select("id")
    return import_only(graph).join(shuffled(named), "id", "left_semi")


def aggregation_hubs(graph: Graph) -> DataFrame:
    """(id) of code nodes that merely gather imports: of two edges or more all, or more than seven tenths of
    more than two; without a place of their own, all but structural ones, from 40 files, or from 5 under a
    dotted or standard library's name."""
    code = graph.nodes.filter("file_type = 'code'").select("id", F.coalesce("qualified_label", "label").alias("shown"), (F.coalesce("source_location", F.lit("")) == "").alias("placeless"))
    h = half_edges(graph.edges, "relation").join(graph.nodes.select(F.col("id").alias("other"), F.col("source_file").alias("importer")), "other", "left")
    bare = ~F.col("relation").isin("contains", "method", "uses")
    n = h.groupBy("id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("relation") == "imports").alias("imports"), F.count_if(bare).alias("bare"), F.count_if(bare & (F.col("relation") != "imports")).alias("other_bare"),
        F.count_distinct(F.when(bare, F.col("importer"))).alias("importers"),
    )
    known = F.col("shown").contains(".") | is_framework_label("shown")
    far = F.col("placeless") & (F.col("bare") > 0) & (F.col("other_bare") == 0) & ((F.col("importers") >= 40) | ((F.col("importers") >= 5) & known))
    own = (F.col("imports") == F.col("n")) | ((F.col("n") > 2) & (F.col("imports") > 0.7 * F.col("n")))
    return n.filter("n > 1").join(code, "id").filter(own | far).select("id")


def god_nodes(graph: Graph, n: int = 20) -> DataFrame:
    """The most connected nodes that are neither file nodes, nor framework noise, nor aggregation hubs."""
    d = degrees(graph).filter("degree > 1").join(graph.nodes.select("id", "label", "source_file"), "id")
    d = d.filter(F.lower("label") != F.lower(stem("source_file"))).join(framework_noise(graph), "id", "left_anti").join(aggregation_hubs(graph), "id", "left_anti")
    return d.select("id", "label", "degree").orderBy(F.col("degree").desc(), "id").limit(n)


def suggested_questions(graph: Graph, stats: DataFrame, central: DataFrame) -> DataFrame:
    """(source, question, reason, node_ids): ambiguous edges (5), bottlenecks of ``central`` (id, score; 3), highly
    connected nodes with inferred edges (3), isolated nodes (3), communities of low cohesion (all)."""
    label = graph.nodes.select("id", "label")
    ends = graph.edges.filter("confidence = 'AMBIGUOUS'").orderBy("source", "target", "relation").limit(5)
    ends = ends.join(label.select(F.col("id").alias("source"), F.col("label").alias("a")), "source", "left").join(label.select(F.col("id").alias("target"), F.col("label").alias("b")), "target", "left")
    row = lambda df, kind, q, why, ids: df.select(F.lit(kind).alias("source"), q.alias("question"), why.alias("reason"), ids.alias("node_ids"))
    out = row(ends, "ambiguous", F.format_string("What is the relationship between `%s` and `%s`?", F.coalesce("a", "source"), F.coalesce("b", "target")), F.format_string("Edge `%s` is AMBIGUOUS", "relation"), F.array("source", "target"))
    top = central.orderBy(F.col("score").desc(), "id").limit(3).filter("score >= 0.01").join(label, "id", "left")
    out = out.unionByName(row(top, "bottleneck", F.format_string("Is `%s` a bottleneck?", F.coalesce("label", "id")), F.format_string("betweenness %.3f", "score"), F.array("id")))
    best = degrees(graph).orderBy(F.col("degree").desc(), "id").limit(20)
    near = half_edges(graph.edges, "confidence").filter("confidence = 'INFERRED'").join(best, "id").join(label.select(F.col("id").alias("other"), F.col("label").alias("near")), "other", "left")
    two = near.withColumn("k", F.row_number().over(Window.partitionBy("id").orderBy("other"))).filter("k <= 2").groupBy("id", "degree").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", F.coalesce("near", "other").alias("x")))), lambda s: s["x"]), ", ").alias("with_"))
    two = two.orderBy(F.col("degree").desc(), "id").limit(3).join(label, "id")
    out = out.unionByName(row(two, "inferred", F.format_string("How does `%s` interact with %s?", "label", "with_"), F.lit("highly connected by inferred relationships"), F.array("id")))
    lone = degrees(graph).filter("degree = 0").orderBy("id").limit(3).join(label, "id")
    out = out.unionByName(row(lone, "isolated", F.format_string("Why is `%s` isolated?", "label"), F.lit("Node has no edges."), F.array("id")))
    low = stats.filter("size >= 3 and cohesion < 0.15")
    ask = F.format_string("Should the %d members of community %d be reorganized?", "size", "community")
    return out.unionByName(row(low, "cohesion", ask, F.format_string("Cohesion %.3f < 0.15", "cohesion"), F.array().cast("array<string>")))


_CONFIDENCE_BONUS = {"AMBIGUOUS": 3.0, "INFERRED": 2.0, "EXTRACTED": 1.0}


def surprise(graph: Graph) -> DataFrame:
    """(source, target, relation, confidence, score, reasons) of every edge."""
    e = with_ends(graph, "file_type", "source_file", "community")
    base = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in _CONFIDENCE_BONUS.items() for x in kv)), "confidence"), F.lit(1.0))
    type_, dir_, comm = F.col("s_file_type") != F.col("t_file_type"), top_dir("s_source_file") != top_dir("t_source_file"), F.coalesce(F.col("s_community") != F.col("t_community"), F.lit(False))
    alike = F.col("relation") == "semantically_similar_to"
    d = degrees(graph)
    e = e.join(shuffled(d.select(F.col("id").alias("source"), F.col("degree").alias("sd"))), "source").join(shuffled(d.select(F.col("id").alias("target"), F.col("degree").alias("td"))), "target")
    hub = (F.least("sd", "td") <= 2) & (F.greatest("sd", "td") >= 5)
    score = (base + F.when(type_, 2.0).otherwise(0.0) + F.when(dir_, 2.0).otherwise(0.0) + F.when(comm, 1.0).otherwise(0.0)) * F.when(alike, 1.5).otherwise(1.0) + F.when(hub, 1.0).otherwise(0.0)
    reasons = F.array_compact(F.array(F.when(type_, "different types"), F.when(dir_, "different folders"), F.when(comm, "different communities"), F.when(alike, "similar meaning"), F.when(hub, "peripheral to hub")))
    return e.select("source", "target", "relation", "confidence", score.alias("score"), reasons.alias("reasons"))


def modularity(graph: Graph) -> DataFrame:
    """One row q: sum over communities of L_c / m - (k_c / 2m)^2; a loop adds its weight once to the degree."""
    e = with_ends(graph, "community").filter("s_community is not null and t_community is not null")
    m = e.agg(F.sum("weight").alias("m"))
    inside = e.filter("s_community = t_community").groupBy(F.col("s_community").alias("c")).agg(F.sum("weight").alias("l"))
    ends = e.select(F.col("s_community").alias("c"), "weight").unionByName(e.filter("source <> target").select(F.col("t_community").alias("c"), "weight"))
    k = ends.groupBy("c").agg(F.sum("weight").alias("k"))
    return k.join(shuffled(inside), "c", "left").join(F.broadcast(m)).agg(F.round(F.sum(F.coalesce("l", F.lit(0.0)) / F.col("m") - F.pow(F.col("k") / (2 * F.col("m")), 2)), 9).alias("q"))  # m is one row


def renumber_by_size(members: DataFrame) -> DataFrame:
    """(id, community): communities numbered by falling size, then least member."""
    size = members.groupBy("community").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least"))
    # Communities, one row each, are sorted over all partitions and numbered by partition offsets.
    new = numbered(size.repartitionByRange(partitions(size.sparkSession), F.col("n").desc(), "least").sortWithinPartitions(F.col("n").desc(), "least"), "new")
    return members.join(shuffled(new.select("community", "new")), "community").select("id", F.col("new").cast("bigint").alias("community"))


def page_rank(edges: DataFrame, damping: float = 0.85, rounds: int = 20, weight: str = "weight") -> DataFrame:
    """(id, rank) over nodes with an edge; weights split a node's rank, sinks spread theirs evenly."""
    e = durable(edges.groupBy("source", "target").agg(F.sum(weight).alias("w")).withColumn("share", F.col("w") / F.sum("w").over(Window.partitionBy("source"))).select("source", "target", "share"))
    ids = durable(e.select(F.col("source").alias("id")).unionByName(e.select(F.col("target").alias("id"))).distinct())
    n = ids.count()
    if not n:
        return ids.withColumn("rank", F.lit(0.0))
    sinks = ids.join(e.select(F.col("source").alias("id")), "id", "left_anti").withColumn("sink", F.lit(True))
    ids = durable(ids.join(sinks, "id", "left"))
    ranks = ids.select("id", "sink", F.lit(1.0 / n).alias("rank"))
    for k in range(rounds):
        lost = ranks.filter("sink").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("lost"))  # one row
        got = ranks.withColumnRenamed("id", "source").join(e, "source").groupBy(F.col("target").alias("id")).agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        ranks = ids.join(got, "id", "left").join(F.broadcast(lost)).select("id", "sink", (F.lit((1 - damping) / n) + damping * (F.coalesce("got", F.lit(0.0)) + F.col("lost") / n)).alias("rank"))
        if k % 4 == 3:
            ranks = durable(ranks)
    return ranks.select("id", "rank")


def choke_points(graph: Graph, rounds: int = 20) -> DataFrame:
    """(id, score): rank x (1 + 0.1 x directed degree)."""
    d = graph.edges.select(F.explode(F.array("source", "target")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("d"))
    return page_rank(graph.edges, rounds=rounds).join(d, "id").select("id", F.round(F.col("rank") * (1 + 0.1 * F.col("d")), 12).alias("score"))
