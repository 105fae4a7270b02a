"""Comparing graphs, impact, drift, verification, policies and plan gates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vertexloom.functions.paths import LANGUAGES, extension, glob_regex, is_test_path, percent
from vertexloom.operators.build import baseline, virtual
from vertexloom.operators.durable import durable, shuffled
from vertexloom.operators.measure import degrees, half_edges, modularity, surprise, with_ends
from vertexloom.operators.traverse import closure_from, oriented, reach
from vertexloom.sources.graphs import Graph


def diff_nodes(old: Graph, new: Graph) -> DataFrame:
    """(id, change) added or removed."""
    a, b = old.nodes.select("id"), new.nodes.select("id")
    return b.join(a, "id", "left_anti").distinct().withColumn("change", F.lit("added")).unionByName(a.join(b, "id", "left_anti").distinct().withColumn("change", F.lit("removed")))


def diff_edges(old: Graph, new: Graph) -> DataFrame:
    """(source, target, relation, change)."""
    k = ["source", "target", "relation"]
    a, b = old.edges.select(*k), new.edges.select(*k)
    return b.join(a, k, "left_anti").distinct().withColumn("change", F.lit("added")).unionByName(a.join(b, k, "left_anti").distinct().withColumn("change", F.lit("removed")))


def inventory(old: Graph, new: Graph) -> DataFrame:
    """(id, change, old_community, new_community): Added, Removed or CommunityChanged symbols."""
    a = old.nodes.select("id", F.col("community").alias("old_community"), F.lit(True).alias("a"))
    b = new.nodes.select("id", F.col("community").alias("new_community"), F.lit(True).alias("b"))
    change = F.when(F.col("a").isNull(), "Added").when(F.col("b").isNull(), "Removed").when(~F.col("old_community").eqNullSafe(F.col("new_community")), "CommunityChanged")
    return a.join(b, "id", "full").select("id", change.alias("change"), "old_community", "new_community").filter("change is not null")


def impact(graph: Graph, ids: DataFrame) -> DataFrame:
    """(id, depth) of everything that depends on ``ids``, the ids themselves left out."""
    return reach(oriented(graph.edges, "reverse"), ids).filter("depth > 0")


def review_order(changes: DataFrame) -> DataFrame:
    rank = F.when(F.col("change") == "Removed", 0).when(F.col("change") == "CommunityChanged", 1).otherwise(2)
    return changes.withColumn("rank", rank).orderBy("rank", "id")


def impact_report(graph: Graph, ids: DataFrame) -> DataFrame:
    """One row: downstream nodes, their communities, and by confidence the edges between them and the changed ones."""
    found = impact(graph, ids).select("id")
    every = durable(found.unionByName(ids.select("id")).distinct())
    e = graph.edges.join(shuffled(every.withColumnRenamed("id", "source")), "source", "left_semi").join(shuffled(every.withColumnRenamed("id", "target")), "target", "left_semi")
    n = found.join(shuffled(graph.nodes.select("id", "community")), "id").agg(F.count(F.lit(1)).alias("downstream"), F.count_distinct("community").alias("communities"))
    c = e.agg(*(F.count_if(F.col("confidence") == x.upper()).alias(x) for x in ("extracted", "inferred", "ambiguous")))
    return n.crossJoin(c)  # two single rows


def safe_diff(changes: DataFrame, budget: int = 200, sample: int = 10) -> DataFrame:
    """(change, n, id): every change up to ``budget`` of them; beyond it removals and moves by their first
    ``sample`` ids, additions by their number alone (id NULL)."""
    counts = changes.groupBy("change").agg(F.count(F.lit(1)).alias("n"))
    few = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))  # one row
    first = changes.withColumn("k", F.row_number().over(Window.partitionBy("change").orderBy("id")))
    shown = first.crossJoin(F.broadcast(few)).filter((F.col("total") <= budget) | ((F.col("k") <= sample) & (F.col("change") != "Added")))
    out = shown.select("change", "id").join(counts, "change").select("change", "n", "id")
    hidden = counts.filter("change = 'Added'").crossJoin(F.broadcast(few)).filter(F.col("total") > budget).select("change", "n", F.lit(None).cast("string").alias("id"))
    return out.unionByName(hidden)


def what_changed(old: Graph, new: Graph, expand: int = 5000, follow: int = 200) -> DataFrame:
    """One row: changes by kind, and the impact of up to ``follow`` of them; ``expanded`` tells whether there
    are few enough (``expand``) to be listed."""
    changes = inventory(old, new)
    n = changes.agg(F.count_if(F.col("change") == "Removed").alias("removed"), F.count_if(F.col("change") == "CommunityChanged").alias("moved"), F.count_if(F.col("change") == "Added").alias("added"))
    total = n.select((F.col("removed") + F.col("moved") + F.col("added")).alias("t")).first()[0]
    if total <= follow:
        e = impact_report(new, changes.join(new.nodes.select("id"), "id", "left_semi"))
    else:
        e = n.select(*(F.lit(0).cast("bigint").alias(c) for c in ("downstream", "communities", "extracted", "inferred", "ambiguous")))
    return n.withColumn("expanded", F.lit(total <= expand)).crossJoin(e)  # two single rows


def drift(old: Graph, new: Graph) -> DataFrame:
    """(kind, node_id, label, old_community, new_community, severity) between two graphs.

    Every move of a node (Warning when it leaves for none, else Info), more edges across communities
    than before (Warning), more or fewer communities (Info), and moves of nodes of degree above 5 (Critical).
    """
    both = old.nodes.select(F.col("id").alias("node_id"), "label", F.col("community").alias("old_community")).join(shuffled(new.nodes.select(F.col("id").alias("node_id"), F.col("community").alias("new_community"))), "node_id")
    moved = both.filter(~F.col("old_community").eqNullSafe(F.col("new_community")))
    row = lambda df, kind, severity: df.select(F.lit(kind).alias("kind"), "node_id", "label", "old_community", "new_community", severity.alias("severity"))
    out = row(moved, "CommunityChanged", F.when(F.col("new_community").isNull(), "Warning").otherwise("Info"))
    hubs = degrees(new).filter("degree > 5").select(F.col("id").alias("node_id"))
    out = out.unionByName(row(moved.join(shuffled(hubs), "node_id", "left_semi"), "HubMoved", F.lit("Critical")))
    one = lambda a, b, node, label: a.toDF("old_community").crossJoin(b.toDF("new_community")).select(F.lit(node).alias("node_id"), F.lit(label).alias("label"), "old_community", "new_community")  # noqa: E731  # two single rows
    cross = one(crossings(old), crossings(new), "cross-boundary", "Cross-boundary edges")
    out = out.unionByName(row(cross.filter("new_community > old_community"), "NewCrossBoundaryEdge", F.lit("Warning")))
    n = lambda g: g.nodes.agg(F.count_distinct("community"))
    count = durable(one(n(old), n(new), "community-structure", "Community count"))
    out = out.unionByName(row(count.filter("new_community > old_community"), "CommunitySplit", F.lit("Info")))
    return out.unionByName(row(count.filter("new_community < old_community"), "CommunityMerge", F.lit("Info")))


def drift_by_severity(events: DataFrame) -> DataFrame:
    """Events, the critical ones first, then warnings."""
    return events.orderBy(F.when(F.col("severity") == "Critical", 0).when(F.col("severity") == "Warning", 1).otherwise(2), "kind", "node_id")


def crossings(graph: Graph) -> DataFrame:
    """One row n: edges between communities."""
    return with_ends(graph, "community").filter("s_community <> t_community").agg(F.count(F.lit(1)).alias("n"))


def resolution_counts(graph: Graph) -> DataFrame:
    """One row of the counts that gates are built on; structural edges other than imports and calls count as methods."""
    e, is_ = graph.edges, lambda s: F.coalesce(F.col("resolution_status") == s, F.lit(False))
    imports, calls = F.col("relation") == "imports", F.col("relation") == "calls"
    methods = ~F.col("relation").isin("imports", "calls", "contains", "method")
    return e.agg(
        F.count(F.lit(1)).alias("edges"), F.count_if(imports).alias("imports"), F.count_if(imports & is_("resolved")).alias("imports_resolved"), F.count_if(imports & is_("unresolved")).alias("unresolved"),
        F.count_if(calls).alias("calls"), F.count_if(calls & is_("resolved")).alias("calls_resolved"), F.count_if(methods).alias("methods"), F.count_if(methods & is_("resolved")).alias("methods_resolved"),
        F.count_if(F.col("confidence") == "INFERRED").alias("heuristic"), F.count_if(F.col("confidence") == "AMBIGUOUS").alias("ambiguous"),
    )


def threshold_policies(graph: Graph, min_resolution: float = 80.0, max_ambiguous: int = 10, max_unresolved: int = 100, min_calls: float = 70.0, min_coherence: float = 0.1, max_stale: int = 0, stale: int = 0, ast_only: bool = False) -> DataFrame:
    """(policy, value, threshold, passed): one row a threshold policy. ``stale`` is the number of stale
    evidence spans; without semantic edges (``ast_only``) calls are not judged."""
    c = graph.nodes.agg(F.count_distinct("community").alias("communities"))
    one = resolution_counts(graph).crossJoin(c)  # two single rows
    rate, calls = percent(F.col("imports_resolved"), F.col("imports"), 100.0), F.lit(100.0) if ast_only else percent(F.col("calls_resolved"), F.col("calls"), 100.0)
    coherence = 1 - F.col("communities") / F.greatest(F.col("edges"), F.lit(1))
    rows = [
        ("MinResolution", rate, min_resolution, True), ("MaxAmbiguous", F.col("ambiguous"), max_ambiguous, False), ("MaxUnresolved", F.col("unresolved"), max_unresolved, False),
        ("MinCallResolution", calls, min_calls, True), ("MinCoherence", coherence, min_coherence, True), ("MaxStale", F.lit(stale), max_stale, False),
    ]
    made = [F.struct(F.lit(n).alias("policy"), F.round(v.cast("double"), 6).alias("value"), F.lit(float(t)).alias("threshold"), ((v >= t) if least else (v <= t)).alias("passed")) for n, v, t, least in rows]
    return one.select(F.explode(F.array(*made)).alias("r")).select("r.*")


def resolution_gate(graph: Graph, min_resolution: float = 80.0, max_ambiguous: int = 10, ast_only: bool = False) -> DataFrame:
    """One row (resolution, ambiguous, passed): imports, calls and methods together; calls only beyond ``ast_only``."""
    c = resolution_counts(graph)
    calls, resolved = (F.lit(0), F.lit(0)) if ast_only else (F.col("calls"), F.col("calls_resolved"))
    rate = percent(F.col("imports_resolved") + F.col("methods_resolved") + resolved, F.col("imports") + F.col("methods") + calls, 100.0)
    return c.select(F.round(rate, 6).alias("resolution"), "ambiguous", ((rate >= min_resolution) & (F.col("ambiguous") <= max_ambiguous)).alias("passed"))


def forbidden(graph: Graph, plan: str, from_glob: str, to_glob: str) -> DataFrame:
    """Planned edges from one path glob to another."""
    e = with_ends(graph, "source_file").filter(F.coalesce(F.col("plan_id") == plan, F.lit(False)))
    return e.filter(F.col("s_source_file").rlike(glob_regex(from_glob)) & F.col("t_source_file").rlike(glob_regex(to_glob))).select("source", "target", "relation")


def banned(graph: Graph, plan: str, symbol: str) -> DataFrame:
    """Planned nodes of this label or id, and planned edges to it."""
    n = graph.nodes.filter((F.col("plan_id") == plan) & ((F.col("label") == symbol) | (F.col("id") == symbol))).select("id", F.lit("node").alias("kind"))
    t = graph.nodes.filter((F.col("label") == symbol) | (F.col("id") == symbol)).select(F.col("id").alias("target"))
    e = graph.edges.filter(F.col("plan_id") == plan).join(t, "target", "left_semi").select(F.col("source").alias("id"), F.lit("edge").alias("kind"))
    return n.unionByName(e)


def _layer(layers: Sequence[str], col: str):
    out = F.lit(None).cast("int")
    for k in reversed(range(len(layers))):
        out = F.when(F.col(col).rlike(glob_regex(layers[k])), F.lit(k)).otherwise(out)
    return out


def layering(graph: Graph, plan: str, layers: Sequence[str], transitive: bool = False) -> DataFrame:
    """(source, target): planned nodes or edges that reach back into an earlier layer."""
    n = graph.nodes.select("id", _layer(layers, "source_file").alias("layer")).filter("layer is not null")
    if transitive:
        seeds = graph.nodes.filter(F.col("plan_id") == plan).select(F.col("id").alias("s"))
        pairs = closure_from(oriented(graph.edges), seeds).select(F.col("s").alias("source"), F.col("t").alias("target"))
    else:
        pairs = graph.edges.filter(F.col("plan_id") == plan).select("source", "target").distinct()
    both = pairs.join(n.select(F.col("id").alias("source"), F.col("layer").alias("i")), "source").join(n.select(F.col("id").alias("target"), F.col("layer").alias("j")), "target")
    return both.filter("j < i").select("source", "target")


def compliance(graph: Graph, plan: str) -> DataFrame:
    """(label, status): planned symbols implemented by a real node of the same label, or missing."""
    want = graph.nodes.filter(F.col("plan_id") == plan).select("label").distinct()
    real = graph.nodes.filter("plan_id is null").select("label", F.lit(True).alias("real")).distinct()
    return want.join(real, "label", "left").select("label", F.when(F.col("real"), "implemented").otherwise("missing").alias("status"))


def unplanned_files(graph: Graph, plan: str, n: int = 20) -> DataFrame:
    """The first real files, tests left out, that no planned row names."""
    want = graph.nodes.filter(F.col("plan_id") == plan).select("source_file").distinct()
    real = graph.nodes.filter("plan_id is null").filter(~is_test_path("source_file")).select("source_file").distinct()
    return real.join(want, "source_file", "left_anti").orderBy("source_file").limit(n)


def verification_plan(graph: Graph, ids: DataFrame) -> DataFrame:
    """(step, target, file, priority), one row a reason: the changed sources (1), what their extracted edges lead
    to (2), what depends on them (3), tests beside them (4), their other edges (6), a gate for touchy names (7)."""
    n = graph.nodes.select("id", "source_file")
    ids = ids.select("id").distinct()
    own = n.join(ids, "id", "left_semi")
    changed = own.select("id")
    row = lambda df, step, target, file, priority: df.select(F.lit(step).alias("step"), target.alias("target"), file.alias("file"), F.lit(priority).alias("priority"))
    to = n.select(F.col("id").alias("target"), F.col("source_file").alias("t_file"))
    out_ = graph.edges.join(changed.withColumnRenamed("id", "source"), "source", "left_semi")
    in_ = graph.edges.join(changed.withColumnRenamed("id", "target"), "target", "left_semi")
    plan = row(own, "ReadSource", F.col("id"), F.col("source_file"), 1)
    sure = out_.filter("confidence = 'EXTRACTED'").join(to, "target", "left")
    plan = plan.unionByName(row(sure, "ReadSource", F.col("target"), F.coalesce("t_file", F.lit("?")), 2))
    told = F.concat_ws(" ", "source", "relation", "target")
    plan = plan.unionByName(row(out_.filter("confidence <> 'EXTRACTED'"), "InspectEdge", told, F.col("source_file"), 6))
    by = in_.drop("source_file").join(n.withColumnRenamed("id", "source"), "source")
    plan = plan.unionByName(row(by, "ReadSource", F.col("source"), F.col("source_file"), 3))
    test = (F.col("relation") == "tests") | F.contains("source", F.lit("test"))
    beside = out_.filter(test).select(F.col("target").alias("test"), "source_file").unionByName(in_.filter(test & (F.col("source") != F.col("target"))).select(F.col("source").alias("test"), "source_file"))
    plan = plan.unionByName(row(beside, "RunTest", F.col("test"), F.col("source_file"), 4))
    touchy = ids.filter(F.col("id").rlike("auth|security|payment|credentials")).limit(1)
    return plan.unionByName(row(touchy, "RiskGate", F.lit("security_review"), F.lit(""), 7))


def review_plan(old: Graph, new: Graph) -> DataFrame:
    """The verification plan of everything that changed between two graphs."""
    return verification_plan(new, inventory(old, new).select("id"))


def next_files(plan: DataFrame, n: int = 10) -> DataFrame:
    """(file, step, priority): the files of a verification plan, each at its most urgent step."""
    best = plan.filter("file <> ''").groupBy("file").agg(F.min(F.struct("priority", "step")).alias("r")).select("file", "r.step", "r.priority")
    return best.orderBy("priority", "file").limit(n)


def preflight(graph: Graph, plan: str, rules: Sequence[dict]) -> DataFrame:
    """(rule, source, target, reason): what a plan's rows break, over all ``rules`` (type and its fields).

    ``strict_layering`` is judged on planned edges and, beyond them, on what planned nodes reach.
    """
    none = graph.nodes.sparkSession.createDataFrame([], "rule string, source string, target string, reason string")
    row = lambda df, rule, source, target, reason: df.select(F.lit(rule).alias("rule"), source.alias("source"), target.alias("target"), F.lit(reason).alias("reason"))
    for r in rules:
        why = r.get("reason")
        if r["type"] == "forbidden_dependency":
            none = none.unionByName(row(forbidden(graph, plan, r["from_pattern"], r["to_pattern"]), r["type"], F.col("source"), F.col("target"), why))
        elif r["type"] == "banned_symbol":
            none = none.unionByName(row(banned(graph, plan, r["symbol_label"].strip()), r["type"], F.col("id"), F.lit(r["symbol_label"].strip()), why))
        elif r["type"] == "strict_layering" and len(r["layers"]) > 1:
            direct = layering(graph, plan, r["layers"])
            far = layering(graph, plan, r["layers"], True).filter("source <> target").join(direct, ["source", "target"], "left_anti")
            none = none.unionByName(row(direct.unionByName(far), r["type"], F.col("source"), F.col("target"), why))
    return none


def delta_gate(graph: Graph, plan: str, cluster, tolerance: float = -0.02, threshold: float = 5.0, top: int = 50) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(one row of modularities and ``passes``; planned edges that surprise too much; drift) of a plan.

    ``cluster`` puts communities on a graph's nodes. The gate passes when the modularity with the plan is
    not below that without it by more than the tolerance, and none of the ``top`` surprising edges that
    joins two nodes of a planned edge reaches the threshold.
    """
    before, after = cluster(baseline(graph)), cluster(virtual(graph, plan))
    q = modularity(before).withColumnRenamed("q", "baseline").crossJoin(modularity(after).withColumnRenamed("q", "virtual"))  # two single rows
    best = surprise(after).orderBy(F.col("score").desc(), "source", "target", "relation").limit(top)
    planned = after.edges.filter(F.col("plan_id") == plan).select(F.least("source", "target").alias("u"), F.greatest("source", "target").alias("v")).distinct()
    odd = best.filter(F.col("score") >= threshold).withColumns({"u": F.least("source", "target"), "v": F.greatest("source", "target")}).join(shuffled(planned), ["u", "v"], "left_semi").drop("u", "v")
    bad = odd.agg(F.count(F.lit(1)).alias("surprises"))
    one = q.crossJoin(bad).select("baseline", "virtual", F.round(F.col("virtual") - F.col("baseline"), 9).alias("delta"), "surprises")  # two single rows
    mine = graph.nodes.filter(F.col("plan_id") == plan).select(F.col("id").alias("node_id"))
    events = drift(before, after)
    own = events.filter("node_id in ('cross-boundary', 'community-structure')").unionByName(events.join(shuffled(mine), "node_id", "left_semi").select(*events.columns))
    return one.withColumn("passes", (F.col("delta") >= tolerance) & (F.col("surprises") == 0)), odd, own


def validate_plan(graph: Graph, plan: str, rules: Sequence[dict], cluster) -> DataFrame:
    """Violations of the rules, or, where there are none, planned edges that the delta gate refuses."""
    broken = preflight(graph, plan, rules)
    if not broken.isEmpty():
        return broken
    gate, odd, _ = delta_gate(graph, plan, cluster)
    return odd.select(F.lit("delta_gate").alias("rule"), "source", "target", F.array_join("reasons", ", ").alias("reason"))


def change_gate(graph: Graph, plan: str | None = None, rules: Sequence[dict] = (), min_resolution: float = 80.0, max_ambiguous: int = 10) -> DataFrame:
    """(gate, value, threshold, passed): the default policies, and with a plan its violations as one more gate."""
    out = threshold_policies(graph, min_resolution, max_ambiguous).filter("policy in ('MinResolution', 'MaxAmbiguous', 'MaxUnresolved', 'MinCallResolution')").withColumnRenamed("policy", "gate")
    if plan is None:
        return out
    n = preflight(graph, plan, rules).agg(F.count(F.lit(1)).cast("double").alias("value"))
    return out.unionByName(n.select(F.lit("Preflight").alias("gate"), "value", F.lit(0.0).alias("threshold"), (F.col("value") == 0).alias("passed")))


def doctor(graph: Graph, languages: Sequence[str] | None = None) -> DataFrame:
    """(check, name, value): symbols of each language (of those named, else of those found; 0 is a warning) and
    the share of each confidence in percent."""
    table = F.create_map(*(F.lit(x) for kv in LANGUAGES.items() for x in kv))
    found = graph.nodes.select(F.try_element_at(table, extension("source_file")).alias("name")).filter("name is not null").groupBy("name").agg(F.count(F.lit(1)).cast("double").alias("value"))
    if languages is not None:
        asked = graph.nodes.sparkSession.createDataFrame([(x,) for x in languages], "name string")
        found = asked.join(found, "name", "left").select("name", F.coalesce("value", F.lit(0.0)).alias("value"))
    n = graph.edges.agg(F.count(F.lit(1)).alias("n"), *(F.count_if(F.col("confidence") == x.upper()).alias(x) for x in ("extracted", "inferred", "ambiguous")))
    share = n.filter("n > 0").select(F.explode(F.array(*(F.struct(F.lit(x).alias("name"), F.round(F.col(x) * 100.0 / F.col("n"), 6).alias("value")) for x in ("extracted", "inferred", "ambiguous")))).alias("r")).select("r.*")
    return found.select(F.lit("language").alias("check"), "name", "value").unionByName(share.select(F.lit("confidence").alias("check"), "name", "value"))
