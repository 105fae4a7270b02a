"""Queries of the graph operators over the star graph and the event, document and vector tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vertexloom.functions import paths as P
from vertexloom.operators import build as B
from vertexloom.operators import change as X
from vertexloom.operators import community as C
from vertexloom.operators import measure as M
from vertexloom.operators import rank as R
from vertexloom.operators import telemetry as E
from vertexloom.operators import traverse as T
from vertexloom.plans import datalog
from vertexloom.sources.extract import extract
from vertexloom.sources.graphs import EDGES_SQL, NODES_SQL, Graph, star_graph, star_plan
from vertexloom.streaming import live

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
_BASE = f"gn AS ({NODES_SQL}), ge AS ({EDGES_SQL})"
_PLAN = """pn AS (SELECT id, label, file_type, source_file, source_location, community, CAST(NULL AS STRING) AS plan_id FROM gn UNION ALL SELECT 'alpha_customer_' || CAST(c_custkey AS STRING), 'Planned' || c_name, 'code', 'src/controllers/planned.rs', NULL, NULL, 'alpha' FROM customer WHERE c_custkey % 29 = 0),
pe AS (SELECT source, target, relation, confidence, CAST(NULL AS STRING) AS plan_id FROM ge UNION ALL SELECT 'alpha_customer_' || CAST(c_custkey AS STRING), 'supplier_' || CAST(c_custkey % (SELECT count(*) FROM supplier) AS STRING), 'calls', 'INFERRED', 'alpha' FROM customer WHERE c_custkey % 29 = 0)"""
_HALF = "h AS (SELECT source AS id, target AS other, relation, confidence, resolution_status FROM ge UNION ALL SELECT target, source, relation, confidence, resolution_status FROM ge WHERE source <> target), deg AS (SELECT gn.id, count(h.id) AS degree FROM gn LEFT JOIN h ON gn.id = h.id GROUP BY gn.id)"
_FRAMEWORK = ", ".join(f"'{x}'" for x in P.FRAMEWORK_LABELS)
_FW = "(lower(trim(label)) IN ({0}) OR (len(list_filter(string_split_regex(lower(trim(label)), '[.:]'), lambda t: t <> '')) > 0 AND len(list_filter(string_split_regex(lower(trim(label)), '[.:]'), lambda t: t <> '' AND t NOT IN ({0}))) = 0))".format(_FRAMEWORK)
_STEM = "regexp_extract(source_file, '([^/]*?)(\\.[^./]*)?$', 1)"
_TEST = "regexp_matches(lower({0}), '/tests/|/test/|_test\\.|\\.test\\.|/spec/|/specs/|_spec\\.|tests\\.rs|test_bench|_tests\\.rs')"
_NOISE = f"io AS (SELECT id FROM h GROUP BY id HAVING bool_and(lower(relation) = 'imports')), noise AS (SELECT id FROM io JOIN gn USING (id) WHERE lower(label) <> lower({_STEM}) AND {_FW})"
_BARE = "relation NOT IN ('contains', 'method', 'uses')"
_HUBS = f"""hubs AS (SELECT q.id FROM (SELECT h.id, count(*) AS n, count(*) FILTER (relation = 'imports') AS i, count(*) FILTER ({_BARE}) AS b, count(*) FILTER ({_BARE} AND relation <> 'imports') AS ob, count(DISTINCT CASE WHEN {_BARE} THEN o.source_file END) AS files
FROM h LEFT JOIN gn o ON o.id = h.other GROUP BY h.id) q JOIN gn ON gn.id = q.id WHERE file_type = 'code' AND n > 1 AND (i = n OR (n > 2 AND i > 0.7 * n) OR (coalesce(source_location, '') = '' AND b > 0 AND ob = 0 AND (files >= 40 OR (files >= 5 AND (contains(label, '.') OR {_FW}))))))"""
_ENDS = "x AS (SELECT e.*, s.community AS sc, t.community AS tc, s.file_type AS st, t.file_type AS tt, s.source_file AS sf, t.source_file AS tf FROM ge e JOIN gn s ON s.id = e.source JOIN gn t ON t.id = e.target)"


def register(sql: str | None = None, plan: bool = False, name: str | None = None, ctes: str = "", recursive: bool = False) -> Callable:
    """Register ``f(graph)`` (or ``f(spark, sf_dir)`` of two arguments) with its SQL after the graph's CTEs."""

    def add(f: Callable) -> Callable:
        key = name or f.__name__.strip("_")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            if f.__code__.co_argcount - len(f.__defaults__ or ()) == 2:
                return f(spark, sf_dir)
            g = star_graph(spark, sf_dir)
            return f(star_plan(spark, sf_dir, g) if plan else g)

        QUERIES[key] = run
        if sql:
            parts = [_BASE] + ([_PLAN] if plan else []) + ([ctes] if ctes else [])
            SQL[key] = f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(parts)} {sql}"
        return f

    return add


def _datalog(key: str, text: str, sql: str | None, ctes: str = "", recursive: bool = True) -> None:
    register(sql, name=key, ctes=ctes, recursive=recursive)(lambda g: datalog.query(g, text, budget=None)[0])


_CAP = "CASE confidence WHEN 'EXTRACTED' THEN 'Extracted' WHEN 'INFERRED' THEN 'Inferred' ELSE 'Ambiguous' END"
_datalog("edb_node", "?- node(Id, Label, Type, File, Community).", "SELECT DISTINCT id AS \"Id\", label AS \"Label\", upper(file_type[1]) || file_type[2:] AS \"Type\", source_file AS \"File\", coalesce(community, 999) AS \"Community\" FROM gn")
for _r in ("calls", "imports", "contains"):
    _datalog(f"edb_{_r}", f"?- {_r}(S, T, C).", f"SELECT DISTINCT source AS \"S\", target AS \"T\", {_CAP} AS \"C\" FROM ge WHERE relation = '{_r}'")
_datalog("edb_edge", "?- edge(S, T, R, C).", f"SELECT DISTINCT source AS \"S\", target AS \"T\", relation AS \"R\", {_CAP} AS \"C\" FROM ge")
_datalog("edb_degree", "?- degree(X, N).", "SELECT id AS \"X\", degree AS \"N\" FROM deg", _HALF)
_datalog("edb_hub", "?- is_hub(X).", "SELECT id AS \"X\" FROM deg WHERE degree > 15", _HALF)
_datalog("datalog_depends_on", "?- depends_on(X, Y).", "SELECT DISTINCT source AS \"X\", target AS \"Y\" FROM ge WHERE relation IN ('calls', 'imports', 'inherits', 'implements', 'contains')")
_walk = lambda seed, rel: f"w(t) AS (SELECT target FROM ge WHERE source = '{seed}'{rel} UNION SELECT e.target FROM w JOIN ge e ON e.source = w.t WHERE true{rel})"
_datalog("depends_transitive_seeded", '?- depends_transitive("region_0", X).', 'SELECT t AS "X" FROM w', _walk("region_0", ""))
_datalog("calls_transitive_seeded", '?- calls_transitive("part_1", X).', 'SELECT t AS "X" FROM w', _walk("part_1", " AND relation = 'calls'"))
_datalog("imports_transitive", "?- imports_transitive(X, Y).", "SELECT x AS \"X\", y AS \"Y\" FROM w", "w(x, y) AS (SELECT source, target FROM ge WHERE relation = 'imports' UNION SELECT w.x, e.target FROM w JOIN ge e ON e.source = w.y WHERE e.relation = 'imports')")
_datalog("reaching_bound_target", '?- calls_transitive(X, "part_2").', 'SELECT s AS "X" FROM w', "w(s) AS (SELECT source FROM ge WHERE target = 'part_2' AND relation = 'calls' UNION SELECT e.source FROM w JOIN ge e ON e.target = w.s WHERE e.relation = 'calls')")
_datalog("datalog_same_community", '?- same_community("nation_3", Y).', "SELECT DISTINCT b.id AS \"Y\" FROM gn a JOIN gn b ON coalesce(a.community, 999) = coalesce(b.community, 999) WHERE a.id = 'nation_3'")
_datalog("is_orphan", "?- is_orphan(X).", "SELECT id AS \"X\" FROM gn WHERE id NOT IN (SELECT source FROM ge WHERE relation IN ('calls', 'imports') UNION SELECT target FROM ge WHERE relation IN ('calls', 'imports'))")
_datalog("circular_dependency_bound", '?- circular_dependency("part_1", Y).', "SELECT f.t AS \"Y\" FROM w f JOIN b ON f.t = b.s WHERE f.t <> 'part_1'", _walk("part_1", " AND relation = 'calls'") + ", b(s) AS (SELECT source FROM ge WHERE target = 'part_1' AND relation = 'calls' UNION SELECT e.source FROM b JOIN ge e ON e.target = b.s WHERE e.relation = 'calls')")
_datalog("bypasses_layer_bound", '?- bypasses_layer("part_1", "customer_3", Z).', "SELECT t AS \"Z\" FROM w WHERE NOT EXISTS (SELECT 1 FROM w WHERE t = 'customer_3')", _walk("part_1", ""))
_datalog("datalog_join", "two(X, Z) :- imports(Y, Z, _), calls(X, Y, _). ?- two(X, Z).", "SELECT DISTINCT c.source AS \"X\", i.target AS \"Z\" FROM ge c JOIN ge i ON c.target = i.source WHERE c.relation = 'calls' AND i.relation = 'imports'")
_datalog("datalog_negation", "sink(X) :- node(X, _, _, _, _), not calls(X, _, _). ?- sink(X).", "SELECT id AS \"X\" FROM gn WHERE id NOT IN (SELECT source FROM ge WHERE relation = 'calls')")
_datalog("datalog_constant", '?- edge("customer_1", T, "calls", "Extracted").', "SELECT DISTINCT target AS \"T\" FROM ge WHERE source = 'customer_1' AND relation = 'calls' AND confidence = 'EXTRACTED'")
_datalog("datalog_repeated_variable", "?- edge(X, X, _, _).", "SELECT DISTINCT source AS \"X\" FROM ge WHERE source = target")
_datalog("datalog_ground", '?- depends_transitive("region_0", "supplier_1").', "SELECT count(*) > 0 AS holds FROM w WHERE t = 'supplier_1'", _walk("region_0", ""))
_datalog("datalog_right_recursion", 'far(X, Y) :- calls(X, Y, _). far(X, Y) :- calls(X, Z, _), far(Z, Y). ?- far("part_1", Y).', 'SELECT t AS "Y" FROM w', _walk("part_1", " AND relation = 'calls'"))
_datalog("datalog_general_recursion", 'up("region_0", 0). up(Y, 0) :- up(X, 0), contains(X, Y, _). ?- up(Y, 0).', "SELECT s AS \"Y\" FROM w", "w(s) AS (SELECT 'region_0' UNION SELECT e.target FROM w JOIN ge e ON e.source = w.s WHERE e.relation = 'contains')")
_datalog("datalog_facts", 'watched("part_1"). watched("part_2"). caller(X, Y) :- watched(Y), calls(X, Y, _). ?- caller(X, Y).', "SELECT DISTINCT source AS \"X\", target AS \"Y\" FROM ge WHERE relation = 'calls' AND target IN ('part_1', 'part_2')")


# --- aggregates and filters ----------------------------------------------------------------------
register("SELECT confidence, count(*) AS n FROM ge GROUP BY confidence", name="confidence_hist")(lambda g: M.histogram(g.edges, "confidence"))
register("SELECT relation, count(*) AS n FROM ge GROUP BY relation", name="relation_hist")(lambda g: M.histogram(g.edges, "relation"))
register("SELECT file_type, count(*) AS n FROM gn GROUP BY file_type", name="type_hist")(lambda g: M.histogram(g.nodes, "file_type"))
register("SELECT count(DISTINCT community) AS n FROM gn", name="distinct_communities")(lambda g: g.nodes.agg(F.count_distinct("community").alias("n")))
register("SELECT * FROM deg", ctes=_HALF, name="degrees")(M.degrees)
register("SELECT id, source_file FROM gn WHERE source_file LIKE '%src/%' AND source_file NOT LIKE '%/tests/%' AND file_type = 'code'", name="node_scope")(lambda g: M.scope(g.nodes, ["SRC/"], ["/tests/"], ["code"], "exclude", True).select("id", "source_file"))
register("SELECT id FROM gn WHERE len(list_intersect(string_split(lower(source_file), '/'), ['generated', 'gen', 'template', 'templates', 'vendor', 'third_party', 'third-party', 'obj', 'dist', 'build', 'target', 'node_modules'])) > 0 OR regexp_matches(lower(source_file), '\\.(g|generated|designer|gen)\\.cs$|\\.generated\\.(rs|ts)$|\\.g\\.ts$|\\.generated\\.[^/]*$')", name="generated_only")(lambda g: M.scope(g.nodes, generated="only").select("id"))
register("SELECT source, target FROM ge WHERE relation LIKE '%call%'", name="relation_scope")(lambda g: M.relation_scope(g.edges, ["call", "imp"], ["imports"]).select("source", "target"))
register(f"SELECT id FROM gn WHERE {_TEST.format('source_file')}", name="test_paths")(lambda g: g.nodes.filter(P.is_test_path("source_file")).select("id"))
register("SELECT id FROM gn WHERE source_file LIKE 'src/db/%'", name="glob_paths")(lambda g: g.nodes.filter(P.matches_glob("source_file", "src/db/**")).select("id"))
register(
    """SELECT count(*) AS edges, count(*) FILTER (relation = 'imports') AS imports, count(*) FILTER (relation = 'imports' AND resolution_status = 'resolved') AS imports_resolved, count(*) FILTER (relation = 'imports' AND resolution_status = 'unresolved') AS imports_unresolved,
    count(*) FILTER (relation = 'calls') AS calls, count(*) FILTER (relation = 'calls' AND resolution_status = 'resolved') AS calls_resolved, count(*) FILTER (relation = 'calls' AND resolution_status = 'heuristic') AS calls_heuristic, count(*) FILTER (relation = 'calls' AND resolution_status = 'unresolved') AS calls_unresolved, count(*) FILTER (confidence = 'AMBIGUOUS') AS ambiguous FROM ge""",
    name="resolution_report",
)(lambda g: M.resolution_report(g.edges))
register("SELECT s.community, s.size, coalesce(i.internal, 0) AS internal, round(CASE WHEN s.size > 1 THEN coalesce(i.internal, 0) / (s.size * (s.size - 1) / 2) ELSE 0.0 END, 9) AS cohesion FROM (SELECT community, count(*) AS size FROM gn WHERE community IS NOT NULL GROUP BY 1) s LEFT JOIN (SELECT sc AS community, count(*) AS internal FROM x WHERE sc = tc GROUP BY 1) i USING (community)", ctes=_ENDS, name="community_stats")(lambda g: M.community_stats(g).drop("focus"))
register("SELECT q.c AS community, CAST(floor(count(*) FILTER (c = o) / 2) AS BIGINT) AS internal, count(*) FILTER (c <> o) AS boundary, count(DISTINCT CASE WHEN c <> o THEN o END) AS external_communities, any_value(t.top_node) AS top_node FROM (SELECT sc AS c, tc AS o FROM x WHERE sc IS NOT NULL AND tc IS NOT NULL UNION ALL SELECT tc, sc FROM x WHERE sc IS NOT NULL AND tc IS NOT NULL) q JOIN (SELECT community, first(id ORDER BY degree DESC, id) AS top_node FROM deg JOIN gn USING (id) WHERE community IS NOT NULL GROUP BY 1) t ON t.community = q.c GROUP BY 1", ctes=_ENDS + ", " + _HALF, name="community_overview")(M.community_overview)
register("SELECT h.id, count(*) AS cross_edges, count(DISTINCT o.community) AS external_communities FROM h JOIN gn s ON s.id = h.id JOIN gn o ON o.id = h.other WHERE s.community <> o.community GROUP BY 1", ctes=_HALF, name="bridges")(M.bridges)
register("SELECT source, target, relation, confidence, round(weight * confidence_score, 9) AS score FROM x WHERE sc <> tc", ctes=_ENDS, name="boundary_crossings")(M.boundary_crossings)
register("SELECT lower(label) AS label, count(*) AS n, count(DISTINCT source_file) AS n_files FROM gn GROUP BY 1 HAVING count(*) > 1", name="label_collisions")(lambda g: M.label_collisions(g.nodes))
register("SELECT direction, relation, count(*) AS n FROM (SELECT CASE WHEN sf LIKE '%controllers%' AND tf LIKE '%services%' THEN 'forward' WHEN sf LIKE '%services%' AND tf LIKE '%controllers%' THEN 'backward' END AS direction, relation FROM x) WHERE direction IS NOT NULL GROUP BY ALL", ctes=_ENDS, name="module_dependencies")(lambda g: M.module_dependencies(g, "controllers", "services"))
register("SELECT count(DISTINCT other) AS nodes, count(DISTINCT source_file) AS files, count(DISTINCT community) AS communities, count(*) FILTER (confidence = 'EXTRACTED') AS extracted, count(*) FILTER (confidence = 'INFERRED') AS inferred, count(*) FILTER (confidence = 'AMBIGUOUS') AS ambiguous FROM h JOIN gn ON gn.id = h.other WHERE h.id = 'part_1'", ctes=_HALF, name="blast_radius")(lambda g: M.blast_radius(g, g.nodes.filter("id = 'part_1'")))
register("SELECT id FROM h GROUP BY id HAVING bool_and(relation = 'imports')", ctes=_HALF, name="import_only")(M.import_only)
register(f"SELECT id FROM hubs", ctes=f"{_HALF}, {_HUBS}", name="aggregation_hubs")(M.aggregation_hubs)
register(f"SELECT id FROM noise", ctes=f"{_HALF}, {_NOISE}", name="framework_noise")(M.framework_noise)
register(f"SELECT id, label, degree FROM deg JOIN gn USING (id) WHERE degree > 1 AND lower(label) <> lower({_STEM}) AND id NOT IN (SELECT id FROM hubs) AND id NOT IN (SELECT id FROM noise) ORDER BY degree DESC, id LIMIT 20", ctes=f"{_HALF}, {_HUBS}, {_NOISE}", name="god_nodes")(M.god_nodes)
_SCORE = "(CASE confidence WHEN 'AMBIGUOUS' THEN 3.0 WHEN 'INFERRED' THEN 2.0 ELSE 1.0 END + CASE WHEN st <> tt THEN 2.0 ELSE 0.0 END + CASE WHEN split_part(sf, '/', 1) <> split_part(tf, '/', 1) THEN 2.0 ELSE 0.0 END + CASE WHEN sc <> tc THEN 1.0 ELSE 0.0 END) * CASE WHEN relation = 'semantically_similar_to' THEN 1.5 ELSE 1.0 END + CASE WHEN least(sd.degree, td.degree) <= 2 AND greatest(sd.degree, td.degree) >= 5 THEN 1.0 ELSE 0.0 END"
_BOTH_DEGREES = "x JOIN deg sd ON sd.id = x.source JOIN deg td ON td.id = x.target"
register(f"SELECT source, target, relation, CAST({_SCORE} AS DOUBLE) AS score FROM {_BOTH_DEGREES}", ctes=_ENDS + ", " + _HALF, name="surprise")(lambda g: M.surprise(g).select("source", "target", "relation", "score"))
register(f"SELECT source, target, relation, CAST({_SCORE} AS DOUBLE) AS score FROM {_BOTH_DEGREES} ORDER BY 4 DESC, source, target, relation LIMIT 20", ctes=_ENDS + ", " + _HALF, name="surprise_top")(lambda g: M.surprise(g).select("source", "target", "relation", "score").orderBy(F.col("score").desc(), "source", "target", "relation").limit(20))
register("SELECT round(sum(coalesce(l, 0) / m - (k / (2 * m)) ** 2), 9) AS q FROM (SELECT c, sum(weight) AS k FROM (SELECT sc AS c, weight FROM x WHERE sc IS NOT NULL AND tc IS NOT NULL UNION ALL SELECT tc, weight FROM x WHERE sc IS NOT NULL AND tc IS NOT NULL AND source <> target) GROUP BY c) kk LEFT JOIN (SELECT sc AS c, sum(weight) AS l FROM x WHERE sc = tc GROUP BY 1) ll USING (c), (SELECT sum(weight) AS m FROM x WHERE sc IS NOT NULL AND tc IS NOT NULL)", ctes=_ENDS, name="modularity")(M.modularity)
register("SELECT gn.id, s.k AS community FROM gn JOIN (SELECT community, CAST(row_number() OVER (ORDER BY count(*) DESC, min(id)) - 1 AS BIGINT) AS k FROM gn WHERE community IS NOT NULL GROUP BY community) s USING (community)", name="renumber_by_size")(lambda g: M.renumber_by_size(g.nodes.filter("community is not null").select("id", "community")))
_PR = "n AS (SELECT source AS id FROM ge UNION SELECT target FROM ge), c AS (SELECT count(*) AS n FROM n), s AS (SELECT source, target, sum(weight) AS w FROM ge GROUP BY 1, 2), e AS (SELECT source, target, w / sum(w) OVER (PARTITION BY source) AS share FROM s), r0 AS (SELECT id, 1.0 / n AS rank FROM n, c)" + "".join(f", r{k + 1} AS (SELECT n.id, 0.15 / c.n + 0.85 * (coalesce(g.got, 0) + d.lost / c.n) AS rank FROM n CROSS JOIN c CROSS JOIN (SELECT coalesce(sum(rank), 0) AS lost FROM r{k} WHERE id NOT IN (SELECT source FROM e)) d LEFT JOIN (SELECT target AS id, sum(rank * share) AS got FROM r{k} JOIN e ON e.source = r{k}.id GROUP BY 1) g USING (id))" for k in range(5))
register("SELECT id, round(rank, 9) AS rank FROM r5", ctes=_PR, name="page_rank_5")(lambda g: M.page_rank(g.edges, rounds=5).select("id", F.round("rank", 9).alias("rank")))
register("SELECT r5.id, round(rank * (1 + 0.1 * d), 7) AS score FROM r5 JOIN (SELECT id, count(*) AS d FROM (SELECT source AS id FROM ge UNION ALL SELECT target FROM ge) GROUP BY 1) q USING (id)", ctes=_PR, name="choke_points")(lambda g: M.choke_points(g, 5).select("id", F.round("score", 7).alias("score")))
register("SELECT id, degree, unresolved, CAST(unresolved AS DOUBLE) AS risk FROM (SELECT id, count(*) AS degree, count(*) FILTER (relation = 'calls' AND resolution_status = 'unresolved') AS unresolved FROM h GROUP BY id) WHERE degree >= 3 AND unresolved > 0 ORDER BY risk DESC, id LIMIT 10", ctes=_HALF, name="quality_risk")(M.quality_risk)

# --- building ------------------------------------------------------------------------------------
register("SELECT id, label || '!' AS label FROM gn", name="upsert_last_wins")(lambda g: B.upsert_nodes(g.nodes.withColumn("seq", F.lit(1)).unionByName(g.nodes.withColumns({"seq": F.lit(2), "label": F.concat("label", F.lit("!"))})), "seq").select("id", "label"))
register("SELECT source, target, relation, confidence FROM ge", name="add_edges_dedup")(lambda g: B.add_edges(g.nodes, g.edges.withColumn("seq", F.lit(1)).unionByName(g.edges.withColumn("seq", F.lit(2))).unionByName(g.edges.withColumns({"seq": F.lit(3), "target": F.lit("nowhere")})), "seq").select("source", "target", "relation", "confidence"))
register("SELECT source, 'gone_' || target AS target, relation, 'target' AS side FROM ge WHERE relation = 'imports'", name="dangling")(lambda g: B.dangling(Graph(g.nodes, g.edges.filter("relation = 'imports'").withColumn("target", F.concat(F.lit("gone_"), "target")))))
register("SELECT count(*) AS nodes_inserted, count(*) AS nodes_overwritten, (SELECT count(*) FROM ge) AS edges_inserted, 0 AS edges_dangling FROM gn", name="build_stats")(lambda g: B.build_stats(g.nodes.unionByName(g.nodes), g.edges))
register("SELECT sf AS from_file, tf AS to_file, relation, count(*) AS n FROM x WHERE sf <> tf GROUP BY ALL", ctes=_ENDS, name="cross_file_edges")(B.cross_file_edges)
register("SELECT source, target, relation FROM ge WHERE source <> 'part_1' AND target <> 'part_1'", name="remove_incident")(lambda g: B.remove_incident(g.edges, "part_1").select("source", "target", "relation"))
register("SELECT source, target FROM ge WHERE relation = 'imports'", name="resolve_imports")(lambda g: B.resolve_imports(g.nodes, g.edges).filter("relation = 'imports' and resolution_status = 'resolved'").select("source", "target"))
register("SELECT (SELECT count(*) FROM gn) AS base_nodes, (SELECT count(*) FROM pn) AS virtual_nodes, (SELECT count(*) FROM pe WHERE plan_id = 'alpha') AS planned_edges", plan=True, name="plan_subgraphs")(lambda g: B.baseline(g).nodes.agg(F.count(F.lit(1)).alias("base_nodes")).crossJoin(B.virtual(g, "alpha").nodes.agg(F.count(F.lit(1)).alias("virtual_nodes"))).crossJoin(B.planned(g, "alpha").edges.agg(F.count(F.lit(1)).alias("planned_edges"))))


@register(None)
def extract_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = extract(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return edges.groupBy("source_file", "relation").agg(F.count(F.lit(1)).alias("n"))


# --- traversal and paths -------------------------------------------------------------------------
_one = lambda g, i: g.nodes.filter(F.col("id") == i).select("id")
_BOTH = "b AS (SELECT source AS s, target AS t FROM ge UNION SELECT target, source FROM ge)"
register("SELECT id, min(depth) AS depth FROM w GROUP BY id", ctes=_BOTH + ", w(id, depth) AS (SELECT 'nation_3', 0 UNION SELECT b.t, depth + 1 FROM w JOIN b ON b.s = w.id WHERE depth < 2)", recursive=True, name="bfs_depths")(lambda g: T.reach(T.oriented(g.edges, "both"), _one(g, "nation_3"), 2))
register("SELECT id, min(depth) AS depth FROM w GROUP BY id", ctes="w(id, depth) AS (SELECT 'customer_1', 0 UNION SELECT e.target, depth + 1 FROM w JOIN ge e ON e.source = w.id WHERE depth < 4)", recursive=True, name="transitive_neighbourhood")(lambda g: T.reach(T.oriented(g.edges), _one(g, "customer_1"), 4))
register("SELECT s AS id FROM w WHERE s <> 'part_5'", ctes="w(s) AS (SELECT source FROM ge WHERE target = 'part_5' UNION SELECT e.source FROM w JOIN ge e ON e.target = w.s)", recursive=True, name="reverse_reachable")(lambda g: T.reach(T.oriented(g.edges, "reverse"), _one(g, "part_5")).filter("depth > 0").select("id"))
register("SELECT CAST(min(depth) AS INTEGER) AS hops FROM w WHERE id = 'supplier_4'", ctes=_BOTH + ", w(id, depth) AS (SELECT 'customer_2', 0 UNION SELECT b.t, depth + 1 FROM w JOIN b ON b.s = w.id WHERE depth < 4)", recursive=True, name="shortest_hops")(lambda g: T.reach(T.oriented(g.edges, "both"), _one(g, "customer_2")).filter("id = 'supplier_4'").select(F.col("depth").alias("hops")))
def _relaxed(step: str, rounds: int) -> str:
    """CTEs of so many relaxation rounds from customer_1 over steps (s, t, cost)."""
    first = f"step AS MATERIALIZED ({step}), q0 AS MATERIALIZED (SELECT 'customer_1' AS id, 0 AS cost, 0 AS hops)"
    best = "SELECT id, m.cost AS cost, m.hops AS hops FROM (SELECT id, min({'cost': cost, 'hops': hops}) AS m FROM (SELECT * FROM q%d UNION ALL SELECT t, q.cost + step.cost, hops + 1 FROM q%d q JOIN step ON step.s = q.id) GROUP BY id)"
    return first + "".join(f", q{k + 1} AS MATERIALIZED ({best % (k, k)})" for k in range(rounds))


_EITHER = "(SELECT source AS s, target AS t, relation, confidence_score FROM ge UNION ALL SELECT target, source, relation, confidence_score FROM ge)"
_RANK = "CASE lower(relation) WHEN 'calls' THEN 1000 WHEN 'uses' THEN 1200 WHEN 'method' THEN 1300 WHEN 'contains' THEN 1400 WHEN 'references' THEN 1700 WHEN 'imports' THEN 6000 ELSE 2200 END"
register("SELECT id, round(cost, 6) AS cost FROM q30", ctes=_relaxed(f"SELECT s, t, 1 - max(confidence_score) AS cost FROM {_EITHER} GROUP BY 1, 2", 30), name="safest_cost")(lambda g: T.cheapest(T.safest_steps(g.edges), _one(g, "customer_1")).select("id", F.round("cost", 6).alias("cost")))
register("SELECT id, cost, hops FROM q30", ctes=f"{_HALF}, {_NOISE}, " + _relaxed(f"SELECT s, t, CAST(min({_RANK}) + CASE WHEN t IN (SELECT id FROM noise) AND t <> 'supplier_4' THEN 8000 ELSE 0 END AS BIGINT) AS cost FROM {_EITHER} GROUP BY 1, 2", 30), name="semantic_cost")(lambda g: T.cheapest(T.semantic_steps(g.edges, M.framework_noise(g).filter("id <> 'supplier_4'")), _one(g, "customer_1")).select("id", "cost", "hops"))
register(None, name="semantic_path")(lambda g: T.find_path(g, "customer_1", "supplier_4"))
register("SELECT CAST(min(depth) AS BIGINT) AS hops FROM w WHERE id = 'supplier_4'", ctes=_BOTH + ", w(id, depth) AS (SELECT 'customer_2', 0 UNION SELECT b.t, depth + 1 FROM w JOIN b ON b.s = w.id WHERE depth < 4)", recursive=True, name="strict_path")(lambda g: T.find_path(g, "customer_2", "supplier_4", "strict").agg((F.count(F.lit(1)) - 1).alias("hops")))
register(None, name="path_confidence")(lambda g: T.path_confidence(g, T.find_path(g, "customer_1", "supplier_4")))
register("SELECT DISTINCT CASE WHEN source = 'part_1' THEN target ELSE source END AS neighbour, relation, e.confidence FROM ge e WHERE source = 'part_1' OR target = 'part_1'", name="neighbours")(lambda g: T.neighbours(g.nodes, g.edges, "part_1").select("neighbour", "relation", "confidence"))
register("SELECT DISTINCT s.symbol, gn.id FROM (SELECT 'nation_1' AS symbol UNION SELECT 'asia' UNION SELECT 'none') s JOIN gn ON gn.id = s.symbol OR (lower(gn.label) = s.symbol AND s.symbol NOT IN (SELECT id FROM gn))", name="resolve_symbols")(lambda g: T.resolve_symbols(g.nodes, g.nodes.sparkSession.createDataFrame([("nation_1, asia,none",)], "symbols string")))
register("SELECT source_file, file_type, count(*) AS n, count(*) FILTER (degree <= 5) AS n_hidden FROM gn JOIN deg USING (id) WHERE source_file LIKE '%.md' GROUP BY ALL", ctes=_HALF, name="file_summary")(lambda g: T.file_summary(g.nodes, M.degrees(g), ".md"))
register("SELECT id, community, degree FROM (SELECT *, row_number() OVER (PARTITION BY community ORDER BY degree DESC, id) AS k FROM deg JOIN gn USING (id)) WHERE k <= 3", ctes=_HALF, name="top_per_community")(lambda g: T.top_n(M.degrees(g).join(g.nodes.select("id", "community"), "id"), [F.col("degree").desc(), F.col("id")], 3, ["community"]).select("id", "community", "degree"))

# --- ranking -------------------------------------------------------------------------------------
_LEX = "k AS (SELECT id, sum(CAST(contains(lower(label), w) OR contains(lower(id), w) OR contains(lower(source_file), w) AS INT)) AS hits FROM gn, (SELECT unnest([{0}]) AS w) GROUP BY id), fac AS (SELECT io.id, CASE WHEN noise.id IS NULL THEN 0.5 ELSE 0.2 END AS factor FROM io LEFT JOIN noise USING (id)), lex AS (SELECT k.id, k.hits * coalesce(factor, 1.0) AS score FROM k LEFT JOIN fac ON fac.id = k.id WHERE hits > 0)"
_STRUCT = "fr0 AS (SELECT id AS seed, id, 0 AS d FROM lex), pairs AS (SELECT DISTINCT source, target FROM ge), " + ", ".join(f"s{d} AS (SELECT DISTINCT f.seed, p.target AS id FROM fr{d - 1} f JOIN pairs p ON p.source = f.id), fr{d} AS (SELECT seed, id, {d} AS d FROM s{d} WHERE (seed, id) NOT IN ({' UNION ALL '.join(f'SELECT (seed, id) FROM fr{k}' for k in range(d))}))" for d in (1, 2, 3)) + ", raw AS (SELECT id, sum(1 / (1 + 0.5 * d)) AS s FROM (SELECT * FROM fr0 UNION ALL SELECT * FROM fr1 UNION ALL SELECT * FROM fr2 UNION ALL SELECT * FROM fr3) GROUP BY id), st AS (SELECT raw.id, round(s * coalesce(factor, 1.0), 9) AS score FROM raw LEFT JOIN fac ON fac.id = raw.id)"
_lex = lambda *w: f"{_HALF}, {_NOISE}, " + _LEX.format(", ".join(f"'{x}'" for x in w))
register("SELECT lex.id, CAST(score AS DOUBLE) AS score, degree FROM lex JOIN deg USING (id)", ctes=_lex("asia", "supplier"), name="lexical_rank")(lambda g: R.lexical_rank(g, "Asia, supplier!"))
register("SELECT id, CAST(degree * coalesce(factor, 1.0) AS DOUBLE) AS score, degree FROM deg LEFT JOIN fac USING (id) WHERE id NOT IN (SELECT id FROM noise) ORDER BY 2 DESC, degree DESC, id LIMIT 5", ctes=_lex("zzz"), name="lexical_fallback")(lambda g: R.lexical_rank(g, "zzzqqq"))
register("SELECT id, score FROM st", ctes=_lex("asia", "region") + ", " + _STRUCT, name="structural_rank")(lambda g: R.ranked(g, "asia region", "structural"))
register("SELECT coalesce(lex.id, st.id) AS id, round(0.6 * coalesce(lex.score, 0) + 0.4 * coalesce(st.score, 0), 9) AS score FROM lex FULL JOIN st ON lex.id = st.id", ctes=_lex("asia", "region") + ", " + _STRUCT, name="hybrid_rank")(lambda g: R.ranked(g, "asia region", "hybrid"))
_QG = _lex("asia", "region") + ", seed AS (SELECT id FROM lex JOIN deg USING (id) JOIN gn USING (id) WHERE NOT (contains(lower(source_file), '/test/') OR contains(lower(source_file), '/tests/') OR contains(lower(source_file), '_test.') OR starts_with(lower(label), 'test')) ORDER BY score DESC, degree DESC, id LIMIT 5), w(id, depth) AS (SELECT id, 0 FROM seed UNION SELECT b.t, depth + 1 FROM w JOIN b ON b.s = w.id WHERE depth < 2)"
register("SELECT id, min(depth) AS depth FROM w GROUP BY id ORDER BY depth, id LIMIT 50", ctes=_BOTH + ", " + _QG, recursive=True, name="query_graph")(lambda g: R.query_graph(g, "asia region", 2))
register(None, name="query_graph_lines")(lambda g: R.shown_lines(g, R.query_graph(g, "asia region", 2)))
register(None, name="query_graph_dfs")(lambda g: R.query_graph(g, "asia region", 2, dfs=True))
register("SELECT d.vec_id, round(list_dot_product(CAST(d.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) / (sqrt(list_dot_product(CAST(d.embedding AS DOUBLE[]), CAST(d.embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])))), 6) AS score FROM embeddings d, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY score DESC, vec_id LIMIT 10", name="dense_topk")(lambda spark, sf_dir: R.dense_search(v := spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding", list(v.filter("vec_id = 0").first()["embedding"])))
_WORDS = "tok AS (SELECT id, unnest(list_filter(string_split_regex(lower(label || ' ' || source_file), '[^\\p{L}\\p{N}]+'), lambda t: strlen(t) >= 2 AND t NOT IN (" + ", ".join(f"'{w}'" for w in R.STOP_WORDS) + "))) AS t FROM gn), tf AS (SELECT id, t, count(*) / sum(count(*)) OVER (PARTITION BY id) AS tf FROM tok GROUP BY id, t)"
register("SELECT id, round(sum(CASE WHEN t IN ('supplier', 'db') THEN tf * sqrt(0.5) ELSE 0 END) / sqrt(sum(tf * tf)), 9) AS score FROM tf GROUP BY id HAVING sum(CASE WHEN t IN ('supplier', 'db') THEN 1 ELSE 0 END) > 0 ORDER BY score DESC, id LIMIT 10", ctes=_WORDS, name="text_search")(lambda g: R.text_search(R.term_vectors(g.nodes, "id", "label", "source_file"), "id", "supplier db"))
_SIGNALS = ", ".join("'" + x.replace("\n", "' || chr(10) || '") + "'" for x in R.PAPER_SIGNALS)
_HEAD = "CASE WHEN strlen(left(text, 3000)) <= 3000 THEN left(text, 3000) ELSE left(text, (SELECT max(k) FROM generate_series(1, 3000) g(k) WHERE strlen(left(text, k)) <= 3000)) END"
register(f"SELECT doc_id, CAST(len(list_filter([{_SIGNALS}], lambda s: contains(head, s))) AS INTEGER) AS n_signals FROM (SELECT doc_id, lower({_HEAD}) AS head FROM documents) WHERE len(list_filter([{_SIGNALS}], lambda s: contains(head, s))) >= 3", name="paper_like")(lambda spark, sf_dir: R.paper_like(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text"))

# --- change, impact, drift -----------------------------------------------------------------------


def _old(g: Graph) -> Graph:
    key = F.regexp_extract("id", r"^part_(\d+)$", 1)
    nodes = g.nodes.filter((key == "") | (key.cast("bigint") % 50 != 0))
    return Graph(nodes, B.add_edges(nodes, g.edges.withColumn("seq", F.lit(0)), "seq"))


def _new(g: Graph) -> Graph:
    key, nat = F.regexp_extract("id", r"^supplier_(\d+)$", 1), F.regexp_extract("id", r"^nation_(\d+)$", 1)
    nodes = g.nodes.filter((key == "") | (key.cast("bigint") % 50 != 1)).withColumn("community", F.when((nat != "") & (nat.cast("bigint") % 5 == 0), F.col("community") + 1).otherwise(F.col("community")))
    return Graph(nodes, B.add_edges(nodes, g.edges.withColumn("seq", F.lit(0)), "seq"))


_OLDNEW = r"""old AS (SELECT * FROM gn WHERE NOT (regexp_matches(id, '^part_\d+$') AND CAST(split_part(id, '_', 2) AS BIGINT) % 50 = 0)),
new AS (SELECT id, CASE WHEN regexp_matches(id, '^nation_\d+$') AND CAST(split_part(id, '_', 2) AS BIGINT) % 5 = 0 THEN community + 1 ELSE community END AS community FROM gn WHERE NOT (regexp_matches(id, '^supplier_\d+$') AND CAST(split_part(id, '_', 2) AS BIGINT) % 50 = 1)),
oe AS (SELECT DISTINCT source, target, relation FROM ge WHERE source IN (SELECT id FROM old) AND target IN (SELECT id FROM old)), ne AS (SELECT DISTINCT source, target, relation FROM ge WHERE source IN (SELECT id FROM new) AND target IN (SELECT id FROM new))"""
register("SELECT id, 'added' AS change FROM new WHERE id NOT IN (SELECT id FROM old) UNION ALL SELECT id, 'removed' FROM old WHERE id NOT IN (SELECT id FROM new)", ctes=_OLDNEW, name="diff_nodes")(lambda g: X.diff_nodes(_old(g), _new(g)))
register("SELECT *, 'added' AS change FROM (SELECT * FROM ne EXCEPT SELECT * FROM oe) UNION ALL SELECT *, 'removed' FROM (SELECT * FROM oe EXCEPT SELECT * FROM ne)", ctes=_OLDNEW, name="diff_edges")(lambda g: X.diff_edges(_old(g), _new(g)))
register("SELECT coalesce(o.id, n.id) AS id, CASE WHEN o.id IS NULL THEN 'Added' WHEN n.id IS NULL THEN 'Removed' ELSE 'CommunityChanged' END AS change, o.community AS old_community, n.community AS new_community FROM old o FULL JOIN new n ON o.id = n.id WHERE o.id IS NULL OR n.id IS NULL OR o.community IS DISTINCT FROM n.community", ctes=_OLDNEW, name="symbol_inventory")(lambda g: X.inventory(_old(g), _new(g)))
_MOVED = "nfull AS (SELECT * FROM ge WHERE source IN (SELECT id FROM new) AND target IN (SELECT id FROM new)), ofull AS (SELECT * FROM ge WHERE source IN (SELECT id FROM old) AND target IN (SELECT id FROM old)), mv AS (SELECT n.id, g.label, o.community AS oc, n.community AS nc FROM old o JOIN new n ON o.id = n.id JOIN gn g ON g.id = o.id WHERE o.community IS DISTINCT FROM n.community), ehalf AS (SELECT source AS id FROM nfull UNION ALL SELECT target FROM nfull WHERE source <> target), cn AS (SELECT (SELECT count(*) FROM ofull e JOIN old a ON a.id = e.source JOIN old b ON b.id = e.target WHERE a.community <> b.community) AS ox, (SELECT count(*) FROM nfull e JOIN new a ON a.id = e.source JOIN new b ON b.id = e.target WHERE a.community <> b.community) AS nx, (SELECT count(DISTINCT community) FROM old) AS oc, (SELECT count(DISTINCT community) FROM new) AS nc)"
register("""SELECT 'CommunityChanged' AS kind, id AS node_id, label, oc AS old_community, nc AS new_community, CASE WHEN nc IS NULL THEN 'Warning' ELSE 'Info' END AS severity FROM mv
UNION ALL SELECT 'HubMoved', id, label, oc, nc, 'Critical' FROM mv WHERE id IN (SELECT id FROM ehalf GROUP BY id HAVING count(*) > 5)
UNION ALL SELECT 'NewCrossBoundaryEdge', 'cross-boundary', 'Cross-boundary edges', ox, nx, 'Warning' FROM cn WHERE nx > ox UNION ALL SELECT 'CommunitySplit', 'community-structure', 'Community count', oc, nc, 'Info' FROM cn WHERE nc > oc UNION ALL SELECT 'CommunityMerge', 'community-structure', 'Community count', oc, nc, 'Info' FROM cn WHERE nc < oc""", ctes=_OLDNEW + ", " + _MOVED, name="drift_events")(lambda g: X.drift(_old(g), _new(g)))
register("SELECT count(*) AS n FROM x WHERE sc <> tc", ctes=_ENDS, name="drift_crossings")(X.crossings)
register("SELECT s AS id FROM w WHERE s NOT IN ('supplier_1', 'supplier_2')", ctes="w(s) AS (SELECT source FROM ge WHERE target IN ('supplier_1', 'supplier_2') UNION SELECT e.source FROM w JOIN ge e ON e.target = w.s)", recursive=True, name="downstream_impact")(lambda g: X.impact(g, g.nodes.filter("id in ('supplier_1', 'supplier_2')")).select("id"))
register("SELECT source, target, relation FROM pe WHERE plan_id = 'alpha'", plan=True, name="forbidden_dependency")(lambda g: X.forbidden(g, "alpha", "src/controllers/**", "src/db/**"))
register("SELECT source, target FROM pe JOIN pn s ON s.id = source JOIN pn t ON t.id = target WHERE pe.plan_id = 'alpha' AND s.source_file LIKE 'src/controllers/%' AND t.source_file LIKE 'src/db/%'", plan=True, name="strict_layering")(lambda g: X.layering(g, "alpha", ["src/db/**", "src/services/**", "src/controllers/**"]))
register("SELECT DISTINCT w.s AS source, w.t AS target FROM w JOIN pn a ON a.id = w.s JOIN pn b ON b.id = w.t WHERE (CASE WHEN a.source_file LIKE 'src/db/%' THEN 0 WHEN a.source_file LIKE 'src/services/%' THEN 1 WHEN a.source_file LIKE 'src/controllers/%' THEN 2 END) > (CASE WHEN b.source_file LIKE 'src/db/%' THEN 0 WHEN b.source_file LIKE 'src/services/%' THEN 1 WHEN b.source_file LIKE 'src/controllers/%' THEN 2 END)", ctes="w(s, t) AS (SELECT source, target FROM pe WHERE source IN (SELECT id FROM pn WHERE plan_id = 'alpha') UNION SELECT w.s, e.target FROM w JOIN pe e ON e.source = w.t)", recursive=True, plan=True, name="strict_layering_transitive")(lambda g: X.layering(g, "alpha", ["src/db/**", "src/services/**", "src/controllers/**"], True))
register("SELECT 'alpha_customer_' || CAST(c_custkey AS STRING) AS id, 'edge' AS kind FROM customer WHERE c_custkey % 29 = 0 AND c_custkey % (SELECT count(*) FROM supplier) = 0", plan=True, name="banned_symbol")(lambda g: X.banned(g, "alpha", "supplier_0"))
register("SELECT DISTINCT label, 'missing' AS status FROM pn WHERE plan_id = 'alpha'", plan=True, name="plan_compliance")(lambda g: X.compliance(g, "alpha"))
register(f"SELECT DISTINCT source_file FROM gn WHERE NOT {_TEST.format('source_file')} ORDER BY 1 LIMIT 20", plan=True, name="unplanned_files")(lambda g: X.unplanned_files(g, "alpha"))
_COUNTS = "rc AS (SELECT count(*) AS edges, count(*) FILTER (relation = 'imports') AS imports, count(*) FILTER (relation = 'imports' AND resolution_status = 'resolved') AS ir, count(*) FILTER (relation = 'imports' AND resolution_status = 'unresolved') AS unresolved, count(*) FILTER (relation = 'calls') AS calls, count(*) FILTER (relation = 'calls' AND resolution_status = 'resolved') AS cr, count(*) FILTER (relation NOT IN ('imports', 'calls', 'contains', 'method')) AS methods, count(*) FILTER (relation NOT IN ('imports', 'calls', 'contains', 'method') AND resolution_status = 'resolved') AS mr, count(*) FILTER (confidence = 'AMBIGUOUS') AS ambiguous FROM ge), pol AS (SELECT 'MinResolution' AS policy, coalesce(ir * 100.0 / nullif(imports, 0), 100.0) AS value, 80.0 AS threshold, true AS least FROM rc UNION ALL SELECT 'MaxAmbiguous', ambiguous, 10, false FROM rc UNION ALL SELECT 'MaxUnresolved', unresolved, 100, false FROM rc UNION ALL SELECT 'MinCallResolution', coalesce(cr * 100.0 / nullif(calls, 0), 100.0), 70, true FROM rc UNION ALL SELECT 'MinCoherence', 1 - (SELECT count(DISTINCT community) FROM gn) / greatest(edges, 1), 0.1, true FROM rc UNION ALL SELECT 'MaxStale', 0, 0, false FROM rc), judged AS (SELECT policy, round(CAST(value AS DOUBLE), 6) AS value, CAST(threshold AS DOUBLE) AS threshold, CASE WHEN least THEN value >= threshold ELSE value <= threshold END AS passed FROM pol)"
register("SELECT * FROM judged", ctes=_COUNTS, name="policy_table")(X.threshold_policies)
register("SELECT round((ir + mr + cr) * 100.0 / (imports + methods + calls), 6) AS resolution, ambiguous, (ir + mr + cr) * 100.0 / (imports + methods + calls) >= 80 AND ambiguous <= 10 AS passed FROM rc", ctes=_COUNTS, name="resolution_gate")(X.resolution_gate)
_STEPS = """c AS (SELECT id, source_file FROM gn WHERE id = 'customer_1'), vp AS (SELECT 'ReadSource' AS step, id AS target, source_file AS file, 1 AS priority FROM c
UNION ALL SELECT 'ReadSource', e.target, coalesce(t.source_file, '?'), 2 FROM ge e JOIN c ON c.id = e.source LEFT JOIN gn t ON t.id = e.target WHERE e.confidence = 'EXTRACTED'
UNION ALL SELECT 'ReadSource', e.source, s.source_file, 3 FROM ge e JOIN c ON c.id = e.target JOIN gn s ON s.id = e.source
UNION ALL SELECT 'RunTest', CASE WHEN e.source = c.id THEN e.target ELSE e.source END, CAST(NULL AS VARCHAR), 4 FROM ge e JOIN c ON c.id IN (e.source, e.target) WHERE e.relation = 'tests' OR contains(e.source, 'test')
UNION ALL SELECT 'InspectEdge', e.source || ' ' || relation || ' ' || e.target, CAST(NULL AS VARCHAR), 6 FROM ge e JOIN c ON c.id = e.source WHERE e.confidence <> 'EXTRACTED'
UNION ALL SELECT * FROM (SELECT 'RiskGate', 'security_review', '', 7 FROM c WHERE regexp_matches(id, 'auth|security|payment|credentials') LIMIT 1))"""
register("SELECT * FROM vp", ctes=_STEPS, name="verification_plan")(lambda g: X.verification_plan(g, g.nodes.filter("id = 'customer_1'")))
register("SELECT file, first(step ORDER BY priority, step) AS step, min(priority) AS priority FROM vp WHERE file <> '' GROUP BY file ORDER BY priority, file LIMIT 10", ctes=_STEPS, name="next_files")(lambda g: X.next_files(X.verification_plan(g, g.nodes.filter("id = 'customer_1'"))))

# --- communities, centrality, vectors ------------------------------------------------------------
register(None, name="communities")(lambda g: C.cluster(g).nodes.select("id", "community"))
register(None, name="betweenness")(lambda g: C.betweenness(g.edges))
register(None, name="dominators")(lambda g: C.dominators(g.edges, "region_0"))
register(None, name="random_walks")(lambda g: C.random_walks(g.edges, 2, 4))
register(None, name="node_vectors")(lambda g: C.node_vectors(g.edges, 8, 2, 4, 2))

# --- scalar functions ----------------------------------------------------------------------------
register("SELECT id, trim(lower(regexp_replace('plan_' || label, '[^A-Za-z0-9]+', '_', 'g')), '_') AS made, sha256(label) AS hash, split_part(source_file, '/', 1) AS top, lower(regexp_extract(source_file, '\\.([A-Za-z0-9]+)$', 1)) AS ext FROM gn", name="id_functions")(lambda g: g.nodes.select("id", P.make_id(F.lit("plan"), "label").alias("made"), F.sha2("label", 256).alias("hash"), P.top_dir("source_file").alias("top"), P.extension("source_file").alias("ext")))
register("SELECT source AS repository, count(*) AS n_files, sum(len(list_filter(string_split_regex(trim(text, ' \n\t\r'), '[ \n\t\r]+'), lambda w: w <> ''))) AS n_words FROM documents GROUP BY 1", name="corpus_words")(lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/documents.parquet").groupBy(F.col("source").alias("repository")).agg(F.count(F.lit(1)).alias("n_files"), F.sum(F.size(F.filter(F.split("text", r"[ \n\t\r]+"), lambda w: w != ""))).alias("n_words")))

# --- telemetry -----------------------------------------------------------------------------------
_events = lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/events.parquet")
_TEL = "WITH r AS (SELECT lower(event_type) AS name, value, ts, row_number() OVER (PARTITION BY lower(event_type) ORDER BY value) AS k, count(value) OVER (PARTITION BY lower(event_type)) AS n FROM events), t AS (SELECT name, count(*) AS call_count, min(value) FILTER (k * 1000 >= n * 500) AS p50, min(value) FILTER (k * 1000 >= n * 950) AS p95, min(value) FILTER (k * 1000 >= n * 990) AS p99, max(ts) AS last_seen FROM r GROUP BY name) "


@register(None)
def telemetry_roll_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.roll_up(_events(spark, sf_dir), "event_type", "value", "ts")


@register(None)
def hot_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.hot_paths(telemetry_roll_up(spark, sf_dir).select("name", "call_count", "p95"), 3)


@register(None)
def telemetry_smoothed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.smoothed(_events(spark, sf_dir), "event_type", "value", "event_id").select("name", F.round("ema", 6).alias("ema"))


@register(None)
def running_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    r6 = lambda c: F.round(c, 6).alias(c)
    return E.running_percentiles(_events(spark, sf_dir), "event_type", "value", "event_id").select("name", "call_count", r6("p50_ms"), r6("p95_ms"), r6("p99_ms"))


@register(None)
def tumbling_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = live.tumbling_counts(_events(spark, sf_dir), "ts", "event_type")
    return out.select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "event_type", "n", F.round("total", 6).alias("total"))


SQL["telemetry_roll_up"] = _TEL + "SELECT * FROM t"
SQL["hot_paths"] = _TEL + "SELECT name, call_count, p95 FROM t ORDER BY call_count DESC, p95, name LIMIT 3"
_ORDERED = "WITH RECURSIVE r AS (SELECT lower(event_type) AS name, CAST(value AS DOUBLE) AS x, row_number() OVER (PARTITION BY lower(event_type) ORDER BY event_id, value) AS k, count(*) OVER (PARTITION BY lower(event_type)) AS n FROM events WHERE event_type IS NOT NULL AND value IS NOT NULL) "
SQL["telemetry_smoothed"] = _ORDERED + "SELECT name, round(sum(0.1 * 0.9 ** (n - k) * x), 6) AS ema FROM r GROUP BY name"
SQL["tumbling_counts"] = "SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M') AS window_start, lower(event_type) AS event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2"


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["depends_transitive_seeded"](spark, sf_dir)
