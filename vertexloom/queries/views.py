"""Queries of the views on symbols, communities, changes and plans, and of the build operators; link graph too."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vertexloom.functions import paths as P
from vertexloom.operators import build as B
from vertexloom.operators import change as X
from vertexloom.operators import community as C
from vertexloom.operators import measure as M
from vertexloom.operators import rank as R
from vertexloom.operators import traverse as T
from vertexloom.queries import graphs as G
from vertexloom.queries.graphs import register
from vertexloom.sources import extract as S
from vertexloom.sources.graphs import EDGE, NODE, Graph, conform, link_graph, parse_policy, parse_spans, star_graph
from vertexloom.streaming import live

_HALF, _ENDS, _OLDNEW = G._HALF, G._ENDS, G._OLDNEW

# --- filters and counts --------------------------------------------------------------------------
register("SELECT a.id, count(h.id) AS degree FROM (SELECT id FROM gn WHERE source_file LIKE 'src/%') a LEFT JOIN (SELECT h.id FROM h JOIN gn o ON o.id = h.other WHERE o.source_file LIKE 'src/%') h ON h.id = a.id GROUP BY a.id", ctes=_HALF, name="degrees_in_scope")(lambda g: M.degrees_in_scope(g, M.scope(g.nodes, ["src/"])))
register("SELECT id FROM deg WHERE degree >= 12", ctes=_HALF, name="least_degree")(lambda g: M.least_degree(g, g.nodes, 12).select("id"))
register("SELECT id FROM gn WHERE contains(lower(source_file), 'db/supplier_1') OR contains(lower(label), 'db/supplier_1')", name="module_members")(lambda g: M.in_module(g.nodes, "DB/supplier_1").select("id"))
register("SELECT source, target, relation FROM ge WHERE confidence_score >= 0.5", name="confidence_filter")(lambda g: M.trusted(g.edges, 0.5).select("source", "target", "relation"))
register("SELECT source, target, relation FROM ge WHERE confidence = 'EXTRACTED'", name="extracted_only")(lambda g: M.trusted(g.edges, extracted_only=True).select("source", "target", "relation"))
register("SELECT lower(label) AS label, count(*) AS n, count(DISTINCT source_file) AS n_files FROM gn GROUP BY 1 HAVING count(*) > 1 ORDER BY n DESC, label LIMIT 3", name="worst_collisions")(lambda g: M.worst_collisions(g.nodes))


def _qualified(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("qualified_label", F.when(F.col("community") % 2 == 0, F.concat_ws("::", "source_file", "label")))


register("SELECT id, CASE WHEN q IS NOT NULL AND count(*) OVER (PARTITION BY lower(label)) > 1 THEN q || ' (' || label || ')' ELSE label END AS shown FROM (SELECT *, CASE WHEN community % 2 = 0 THEN source_file || '::' || label END AS q FROM gn)", name="collision_labels")(lambda g: M.colliding_labels(_qualified(g.nodes)))
register("SELECT id, CASE WHEN community % 2 = 0 THEN source_file || '::' || label ELSE label END AS shown FROM gn", name="display_labels")(lambda g: _qualified(g.nodes).select("id", P.display_label().alias("shown")))
register("SELECT f AS source_file, count(*) AS total_edges, count(*) FILTER (relation = 'imports' AND lost) AS unresolved_refs FROM (SELECT sf AS f, relation, target LIKE '%7' AS lost FROM x) GROUP BY 1 HAVING count(*) FILTER (relation = 'imports' AND lost) > 0 ORDER BY unresolved_refs DESC, source_file LIMIT 20", ctes=_ENDS, name="unresolved_by_file")(
    lambda g: M.unresolved_by_file(M.with_ends(g, "source_file").withColumns({"source_file": F.col("s_source_file"), "resolution_status": F.when(F.col("target").endswith("7"), "unresolved").otherwise("resolved")}))
)
register("SELECT kind, name, count(*) AS n FROM (SELECT 'extension' AS kind, coalesce(nullif(lower(regexp_extract(path, '\\.([A-Za-z0-9]+)$', 1)), ''), 'no-ext') AS name FROM documents UNION ALL SELECT 'vendor', d FROM (SELECT unnest(string_split(path, '/')[:-2]) AS d FROM documents) WHERE d IN ('Lib', 'lib', 'third_party', 'third-party', 'vendor', 'vendored', 'bin', 'obj', 'packages', 'deps', 'external')) GROUP BY ALL", name="file_histograms")(lambda spark, sf_dir: M.file_histograms(_documents(spark, sf_dir)))
register("SELECT doc_id FROM documents WHERE regexp_matches(lower(regexp_extract(path, '[^/]*$')), '^\\.env$|^\\.env\\.|\\.pem$|\\.key$|\\.p12$|\\.pfx$|^credential|^secret|^password|^passwd|^token|^private[_-]?key|^id_rsa|^id_dsa|^id_ecdsa|^id_ed25519|^\\.netrc$|^\\.pgpass$|^\\.aws|^\\.ssh|^kubeconfig|\\.kubeconfig$|^service[_-]?account|^gcloud|^auth\\.json$|^vault')", name="sensitive_files")(lambda spark, sf_dir: _documents(spark, sf_dir).filter(P.is_sensitive("path")).select("doc_id"))
register("SELECT doc_id FROM documents WHERE len(list_filter(string_split(path, '/'), lambda x: starts_with(x, '.') OR x IN ('venv', 'env', 'node_modules', '__pycache__', 'dist', 'build', 'target', 'site-packages', 'coverage', 'Thumbs.db'))) > 0", name="skipped_events")(lambda spark, sf_dir: _documents(spark, sf_dir).filter(P.is_skipped_event("path")).select("doc_id"))
_TYPES = " ".join(f"WHEN e IN ({', '.join(repr(x) for x in xs)}) THEN '{t}'" for t, xs in P.EXTENSIONS.items())
register(f"SELECT doc_id, CASE {_TYPES} END AS file_type FROM (SELECT doc_id, lower(regexp_extract(path, '\\.([A-Za-z0-9]+)$', 1)) AS e FROM documents)", name="file_types")(lambda spark, sf_dir: _documents(spark, sf_dir).select("doc_id", P.file_type("path").alias("file_type")))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


# --- communities ---------------------------------------------------------------------------------
_TOP = lambda rows, section: f"SELECT community, '{section}' AS section, name, n FROM (SELECT community, name, count(*) AS n, row_number() OVER (PARTITION BY community ORDER BY count(*) DESC, name) AS k FROM ({rows}) WHERE community IS NOT NULL GROUP BY 1, 2) WHERE k <= 5"
_SUMMARY = " UNION ALL ".join(
    [
        _TOP("SELECT community, file_type AS name FROM gn", "type"), _TOP("SELECT community, source_file AS name FROM gn", "file"), _TOP("SELECT sc AS community, relation AS name FROM x WHERE sc = tc", "internal"),
        _TOP("SELECT sc AS community, relation AS name FROM x WHERE sc IS DISTINCT FROM tc UNION ALL SELECT tc, relation FROM x WHERE sc IS DISTINCT FROM tc", "boundary"),
        "SELECT community, 'node', id, degree FROM (SELECT *, row_number() OVER (PARTITION BY community ORDER BY degree DESC, label, id) AS k FROM deg JOIN gn USING (id) WHERE community IS NOT NULL) WHERE k <= 5",
    ]
)
register(_SUMMARY, ctes=_ENDS + ", " + _HALF, name="community_summary")(M.community_summary)
register("SELECT community, id FROM (SELECT community, id, row_number() OVER (PARTITION BY community ORDER BY id) AS k FROM gn WHERE community IS NOT NULL) WHERE k <= 200", name="community_members")(lambda g: M.community_members(g.nodes))
_FOCUS = """pr AS (SELECT community, list_filter(string_split(source_file, '/'), lambda t: t <> '') AS parts FROM gn WHERE community IS NOT NULL), mm AS (SELECT community, min(list_transform(parts, lambda t: lower(t))) AS a, max(list_transform(parts, lambda t: lower(t))) AS b, first(parts ORDER BY list_transform(parts, lambda t: lower(t)), parts) AS parts FROM pr GROUP BY 1),
kk AS (SELECT community, parts, (SELECT coalesce(max(i), 0) FROM generate_series(1, least(len(a), len(b))) g(i) WHERE a[:i] = b[:i]) AS k FROM mm), ff AS (SELECT community, CASE WHEN k > 0 AND contains(parts[k], '.') THEN parts[:k - 1] ELSE parts[:k] END AS f FROM kk),
tp AS (SELECT community, string_agg(source_file, ' | ' ORDER BY n DESC, source_file) AS t FROM (SELECT community, source_file, count(*) AS n, row_number() OVER (PARTITION BY community ORDER BY count(*) DESC, source_file) AS r FROM gn WHERE community IS NOT NULL GROUP BY 1, 2) WHERE r <= 2 GROUP BY 1)"""
register("SELECT community, CASE WHEN len(f) > 1 THEN array_to_string(f, '/') ELSE t END AS focus FROM ff JOIN tp USING (community)", ctes=_FOCUS, name="focus_labels")(lambda g: M.focus_labels(g.nodes.filter("community is not null"), "community", "source_file"))
register(None, name="community_split")(lambda g: C.split_large(g.nodes.filter("community is not null").select("id", "community"), g.edges, 0.03))
register(None, name="suggested_questions")(lambda g: M.suggested_questions(g, M.community_stats(g), C.betweenness(g.edges)))

# --- symbols -------------------------------------------------------------------------------------
register("SELECT s.label, e.relation, s.source_file FROM ge e JOIN gn s ON s.id = e.source WHERE e.target = 'customer_7' AND e.relation IN ('contains', 'method', 'inherits', 'implements')", name="structural_references")(lambda g: T.structural_references(g, "customer_7"))
_NEAR = "me AS (SELECT * FROM gn WHERE id = 'part_5'), nr AS (SELECT t.id, t.label, t.source_file, relation, 'out' AS way FROM ge JOIN gn t ON t.id = target WHERE source = 'part_5' UNION ALL SELECT s.id, s.label, s.source_file, relation, 'in' FROM ge JOIN gn s ON s.id = source WHERE target = 'part_5')"
register(
    f"""SELECT 'parent' AS part, label AS name, relation AS detail FROM nr WHERE way = 'out' AND relation IN ('inherits', 'implements', 'contains', 'method') UNION ALL SELECT 'caller', label, NULL FROM nr WHERE way = 'in' AND relation IN ('calls', 'imports', 'uses')
    UNION ALL SELECT DISTINCT CASE WHEN {G._TEST.format('source_file')} AND NOT own THEN 'test_file' ELSE 'production_file' END, source_file, NULL FROM (SELECT source_file, false AS own FROM nr UNION ALL SELECT source_file, true FROM me)
    UNION ALL SELECT 'focus', CASE WHEN len(f) > 1 THEN array_to_string(f, '/') ELSE t END, CAST(community AS VARCHAR) FROM ff JOIN tp USING (community) WHERE community = (SELECT community FROM me)
    UNION ALL SELECT * FROM (SELECT 'hub', label, CAST(degree AS VARCHAR) FROM deg JOIN gn USING (id) WHERE community = (SELECT community FROM me) AND id <> 'part_5' AND id NOT IN (SELECT id FROM noise) ORDER BY degree DESC, id LIMIT 3)""",
    ctes=f"{_HALF}, {G._NOISE}, {_FOCUS}, {_NEAR}", name="explain_subsystem",
)(lambda g: T.explain_subsystem(g, "part_5"))
register("SELECT kind, k, relation, other, direction, confidence, n FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY CASE confidence WHEN 'EXTRACTED' THEN 0 WHEN 'INFERRED' THEN 1 ELSE 2 END, relation, other, direction) AS k, count(*) OVER (PARTITION BY kind) AS n FROM (SELECT CASE WHEN relation IN ('contains', 'imports') THEN 'structural' ELSE 'behavioural' END AS kind, relation, CASE WHEN source = 'part_5' THEN target ELSE source END AS other, CASE WHEN source = 'part_5' THEN 'out' ELSE 'in' END AS direction, confidence FROM ge WHERE source = 'part_5' OR target = 'part_5')) WHERE k <= CASE kind WHEN 'structural' THEN 5 ELSE 10 END", name="analyse_symbol")(lambda g: T.analyse_symbol(g, "part_5"))
register("SELECT id, label FROM deg JOIN gn USING (id) WHERE id = 'asia' OR lower(label) = 'asia' ORDER BY degree DESC, length(id), id DESC LIMIT 1", ctes=_HALF, name="resolve_one")(lambda g: T.resolve_one(g.nodes, M.degrees(g), "ASIA"))
register("SELECT lex.id, round(score + 0.3 * ln(1 + coalesce(c.n, 0)), 9) AS score FROM lex LEFT JOIN (SELECT 'supplier_' || CAST(l_suppkey AS STRING) AS id, count(*) AS n FROM lineitem GROUP BY 1) c ON c.id = lower(lex.id)", ctes=G._lex("supplier"), name="runtime_rank")(lambda spark, sf_dir: R.runtime_rank(star_graph(spark, sf_dir), "supplier", spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy(F.concat(F.lit("SUPPLIER_"), F.col("l_suppkey").cast("string")).alias("name")).agg(F.count(F.lit(1)).alias("call_count"))))

# --- change --------------------------------------------------------------------------------------
_IMPACT = "w(s) AS (SELECT source FROM ge WHERE target IN ('supplier_1', 'supplier_2') UNION SELECT e.source FROM w JOIN ge e ON e.target = w.s), dn AS (SELECT s AS id FROM w WHERE s NOT IN ('supplier_1', 'supplier_2')), al AS (SELECT id FROM dn UNION SELECT 'supplier_1' UNION SELECT 'supplier_2'), ed AS (SELECT * FROM ge WHERE source IN (SELECT id FROM al) AND target IN (SELECT id FROM al))"
register("SELECT (SELECT count(*) FROM dn) AS downstream, (SELECT count(DISTINCT community) FROM dn JOIN gn USING (id)) AS communities, count(*) FILTER (confidence = 'EXTRACTED') AS extracted, count(*) FILTER (confidence = 'INFERRED') AS inferred, count(*) FILTER (confidence = 'AMBIGUOUS') AS ambiguous FROM ed", ctes=_IMPACT, recursive=True, name="impact_report")(lambda g: X.impact_report(g, g.nodes.filter("id in ('supplier_1', 'supplier_2')")))
_CHANGES = "ch AS (SELECT coalesce(o.id, n.id) AS id, CASE WHEN o.id IS NULL THEN 'Added' WHEN n.id IS NULL THEN 'Removed' ELSE 'CommunityChanged' END AS change FROM old o FULL JOIN new n ON o.id = n.id WHERE o.id IS NULL OR n.id IS NULL OR o.community IS DISTINCT FROM n.community)"
register("SELECT change, n, id FROM (SELECT change, id, count(*) OVER (PARTITION BY change) AS n, row_number() OVER (PARTITION BY change ORDER BY id) AS k FROM ch) WHERE k <= 10 AND change <> 'Added' UNION ALL SELECT change, count(*), NULL FROM ch WHERE change = 'Added' GROUP BY 1", ctes=f"{_OLDNEW}, {_CHANGES}", name="safe_diff")(lambda g: X.safe_diff(X.inventory(G._old(g), G._new(g)), 5))
register("SELECT CASE change WHEN 'Removed' THEN 0 WHEN 'CommunityChanged' THEN 1 ELSE 2 END AS rank, id, change FROM ch", ctes=f"{_OLDNEW}, {_CHANGES}", name="review_order")(lambda g: X.review_order(X.inventory(G._old(g), G._new(g))).select("rank", "id", "change"))
register("SELECT count(*) FILTER (change = 'Removed') AS removed, count(*) FILTER (change = 'CommunityChanged') AS moved, count(*) FILTER (change = 'Added') AS added, count(*) <= 5000 AS expanded, 0 AS downstream, 0 AS communities, 0 AS extracted, 0 AS inferred, 0 AS ambiguous FROM ch", ctes=f"{_OLDNEW}, {_CHANGES}", name="what_changed")(lambda g: X.what_changed(G._old(g), G._new(g), follow=0))
register(None, name="review_plan")(lambda g: X.review_plan(G._old(g), G._new(g)))
register(None, name="drift_by_severity")(lambda g: X.drift_by_severity(X.drift(G._old(g), G._new(g))))
RULES = (
    {"type": "forbidden_dependency", "from_pattern": "src/controllers/**", "to_pattern": "src/db/**", "reason": "through services"}, {"type": "banned_symbol", "symbol_label": "supplier_0", "reason": "retired"},
    {"type": "strict_layering", "layers": ["src/db/**", "src/services/**", "src/controllers/**"], "reason": "layers"},
)
_LAYER = "CASE WHEN {0}.source_file LIKE 'src/db/%' THEN 0 WHEN {0}.source_file LIKE 'src/services/%' THEN 1 WHEN {0}.source_file LIKE 'src/controllers/%' THEN 2 END"
_REACH = "w(s, t) AS (SELECT source, target FROM pe WHERE source IN (SELECT id FROM pn WHERE plan_id = 'alpha') UNION SELECT w.s, e.target FROM w JOIN pe e ON e.source = w.t), bad AS (SELECT 'forbidden_dependency' AS rule, e.source, e.target, 'through services' AS reason FROM pe e JOIN pn a ON a.id = e.source JOIN pn b ON b.id = e.target WHERE e.plan_id = 'alpha' AND a.source_file LIKE 'src/controllers/%' AND b.source_file LIKE 'src/db/%' UNION ALL SELECT 'banned_symbol', e.source, 'supplier_0', 'retired' FROM pe e JOIN pn b ON b.id = e.target WHERE e.plan_id = 'alpha' AND (b.id = 'supplier_0' OR b.label = 'supplier_0') UNION ALL SELECT 'strict_layering', w.s, w.t, 'layers' FROM w JOIN pn a ON a.id = w.s JOIN pn b ON b.id = w.t WHERE w.s <> w.t AND " + _LAYER.format("a") + " > " + _LAYER.format("b") + ")"
register("SELECT * FROM bad", ctes=_REACH, plan=True, recursive=True, name="preflight")(lambda g: X.preflight(g, "alpha", RULES))
register("SELECT policy AS gate, value, threshold, passed FROM judged WHERE policy LIKE 'M%' AND policy NOT IN ('MinCoherence', 'MaxStale') UNION ALL SELECT 'Preflight', CAST(count(*) AS DOUBLE), 0.0, count(*) = 0 FROM bad", ctes=_REACH + ", gp AS (SELECT relation, confidence, resolution_status FROM ge UNION ALL SELECT relation, confidence, NULL FROM pe WHERE plan_id IS NOT NULL), " + G._COUNTS.replace("FROM ge)", "FROM gp)", 1), plan=True, recursive=True, name="change_gate")(lambda g: X.change_gate(g, "alpha", RULES))
_QSQL = "(SELECT round(sum(coalesce(l, 0) / m - (k / (2 * m)) ** 2), 9) FROM (SELECT c, sum(weight) AS k FROM (SELECT sc AS c, weight FROM {0} WHERE sc IS NOT NULL AND tc IS NOT NULL UNION ALL SELECT tc, weight FROM {0} WHERE sc IS NOT NULL AND tc IS NOT NULL AND source <> target) GROUP BY c) kk LEFT JOIN (SELECT sc AS c, sum(weight) AS l FROM {0} WHERE sc = tc GROUP BY 1) ll USING (c), (SELECT sum(weight) AS m FROM {0} WHERE sc IS NOT NULL AND tc IS NOT NULL))"
_PX = "vx AS (SELECT source, target, weight, sc, tc FROM x UNION ALL SELECT e.source, e.target, 0.8, a.community, b.community FROM pe e JOIN pn a ON a.id = e.source JOIN pn b ON b.id = e.target WHERE e.plan_id = 'alpha')"
register(f"SELECT q1 AS baseline, q2 AS virtual, round(q2 - q1, 9) AS delta, 0 AS surprises, q2 - q1 >= -0.02 AS passes FROM (SELECT {_QSQL.format('x')} AS q1, {_QSQL.format('vx')} AS q2)", ctes=f"{_ENDS}, {_PX}", plan=True, name="delta_gate")(lambda g: X.delta_gate(g, "alpha", lambda x: x, threshold=9.0)[0])
register(None, plan=True, name="delta_gate_clustered")(lambda g: X.delta_gate(g, "alpha", C.cluster)[0])
register(None, plan=True, name="validate_plan")(lambda g: X.validate_plan(g, "alpha", [], lambda x: x))
_LANGS = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in P.LANGUAGES.items())
register(f"SELECT 'language' AS \"check\", l.name, CAST(count(q.n) AS DOUBLE) AS value FROM (SELECT unnest(['rust', 'go']) AS name) l LEFT JOIN (SELECT CASE lower(regexp_extract(source_file, '\\.([A-Za-z0-9]+)$', 1)) {_LANGS} END AS n FROM gn) q ON q.n = l.name GROUP BY l.name UNION ALL SELECT 'confidence', lower(c), round(count(*) FILTER (confidence = c) * 100.0 / count(*), 6) FROM ge, (SELECT unnest(['EXTRACTED', 'INFERRED', 'AMBIGUOUS']) AS c) GROUP BY c", name="doctor")(lambda g: X.doctor(g, ["rust", "go"]))

# --- building ------------------------------------------------------------------------------------
register("SELECT id, label FROM gn WHERE source_file <> 'src/db/supplier_1.rs' UNION ALL SELECT 'new_supplier', 'New'", name="replace_file")(
    lambda g: B.replace_file(g, "src/db/supplier_1.rs", conform(g.nodes.sparkSession.createDataFrame([("new_supplier", "New", "src/db/supplier_1.rs")], "id string, label string, source_file string"), NODE).withColumn("seq", F.lit(1)), conform(g.edges.limit(0), EDGE), "seq").nodes.select("id", "label")
)
register("SELECT source, target, relation FROM ge WHERE NOT ((source = 'part_1' AND target = 'part_10') OR (source = 'part_10' AND target = 'part_1'))", name="remove_between")(lambda g: B.remove_between(g.edges, "part_1", "part_10").select("source", "target", "relation"))
register("SELECT s.source, s.name, max(n.id) AS bound FROM (SELECT source, 'supplier_3_' || t.label AS name, t.label FROM ge JOIN gn t ON t.id = target WHERE relation = 'imports' AND t.source_file = 'src/db/supplier_3.rs') s JOIN gn n ON lower(n.label) = lower(s.label) AND n.source_file = 'src/db/supplier_3.rs' GROUP BY 1, 2", name="module_imports")(
    lambda g: B.split_module_imports(M.with_ends(g, "label", "source_file").filter("relation = 'imports' and t_source_file = 'src/db/supplier_3.rs'").withColumn("target", F.concat(F.lit("supplier_3_"), "t_label")), g.nodes)
)
register("SELECT r.source_file AS ref_file, r.label AS name, first(n.id ORDER BY n.source_file <> r.source_file, n.id) AS id FROM (SELECT DISTINCT source_file, label FROM gn) r JOIN gn n ON n.label = r.label GROUP BY 1, 2", name="preferred_binding")(lambda g: B.preferred_binding(g.nodes, g.nodes.select(F.col("source_file").alias("ref_file"), F.col("label").alias("name")).distinct()))
register("SELECT 'alpha_' || lower(trim(regexp_replace(r_name, '[^A-Za-z0-9]+', '_', 'g'), '_')) AS source, 'region_' || CAST(r_regionkey AS STRING) AS target, 'calls' AS relation FROM region", name="plan_symbols")(lambda g: B.plan_symbols(g.nodes.filter("id like 'region_%'").select("label", "source_file", F.col("id").alias("target"), F.lit("calls").alias("relation")), "alpha")[1].select("source", "target", "relation"))
register("SELECT 'target_' || lower(trim(regexp_replace(n_name, '[^A-Za-z0-9]+', '_', 'g'), '_')) AS source, 'target_' || lower(trim(regexp_replace(r_name, '[^A-Za-z0-9]+', '_', 'g'), '_')) AS target, 'depends_on' AS relation FROM nation JOIN region ON n_regionkey = r_regionkey", name="build_targets")(
    lambda spark, sf_dir: B.build_targets(spark.read.parquet(f"{sf_dir}/nation.parquet").join(spark.read.parquet(f"{sf_dir}/region.parquet"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("name"), F.lit("lib").alias("kind"), F.lit("Makefile").alias("file"), F.array("r_name").alias("depends_on"), F.array().cast("array<string>").alias("tests"), F.array().cast("array<string>").alias("runs_in")))[1].select("source", "target", "relation")
)
register("SELECT kind, sum(tokens) AS tokens, count(*) AS n FROM (SELECT 'node' AS kind, length(label) AS tokens FROM gn UNION ALL SELECT 'node', length(label) FROM gn UNION ALL SELECT 'edge', length(relation) FROM ge UNION ALL SELECT 'edge', length(relation) FROM ge) GROUP BY 1", name="merge_batches")(lambda g: B.merged_batches([(g.nodes.withColumn("tokens", F.length("label")), g.edges.withColumn("tokens", F.length("relation")))] * 2))


def _span_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as span texts, every second one wrapped in an object."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    one = F.to_json(F.array(F.struct(F.col("event_type").alias("name"), F.col("event_id").cast("string").alias("span_id"))))
    return e.select(F.when(F.col("event_id") % 2 == 0, one).otherwise(F.concat(F.lit('{"spans":'), one, F.lit("}"))).alias("text"))


register("SELECT event_type AS name, CAST(event_id AS STRING) AS span_id FROM events", name="parse_spans")(lambda spark, sf_dir: parse_spans(_span_texts(spark, sf_dir), "text").select("name", "span_id"))
register("SELECT 'banned_symbol' AS type, r_name AS symbol_label FROM region", name="parse_policy")(lambda spark, sf_dir: parse_policy(spark.read.parquet(f"{sf_dir}/region.parquet").select(F.concat(F.lit('{"rules":[{"type":"banned_symbol","symbol_label":"'), "r_name", F.lit('"}]}')).alias("t")), "t").select("type", "symbol_label"))
_MANIFEST = "o AS (SELECT path, max(n_chars) AS m FROM documents WHERE doc_id % 7 <> 0 GROUP BY path), n AS (SELECT path, max(n_chars) + CASE WHEN max(doc_id) % 5 = 0 THEN 1 ELSE 0 END AS m FROM documents WHERE doc_id % 11 <> 0 GROUP BY path)"


def _manifest(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two states of the file list: each lacks some files, and some sizes differ."""
    d = _documents(spark, sf_dir)
    more = F.when(F.max("doc_id") % 5 == 0, 1).otherwise(0)
    return d.filter("doc_id % 7 <> 0").groupBy("path").agg(F.max("n_chars").alias("mtime")), d.filter("doc_id % 11 <> 0").groupBy("path").agg((F.max("n_chars") + more).alias("mtime"))


def _evidence(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Spans of the files whose path occurs once, every third with another hash, every fourth no longer valid."""
    d = _documents(spark, sf_dir)
    once = d.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("doc_id"), F.max("text").alias("content")).filter("n = 1")
    files = once.select("path", F.coalesce("content", F.lit("")).alias("content"))
    sha = F.sha2(F.coalesce("content", F.lit("")).cast("binary"), 256)
    return once.select("path", F.when(F.col("doc_id") % 3 == 0, F.lit("other")).otherwise(sha).alias("file_hash"), F.when(F.col("doc_id") % 4 == 0, "Stale").otherwise("Valid").alias("state")), files


register("SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'removed' ELSE 'modified' END AS change FROM o FULL JOIN n ON o.path = n.path WHERE o.path IS NULL OR n.path IS NULL OR o.m <> n.m", ctes=_MANIFEST, name="manifest_changes")(lambda spark, sf_dir: live.manifest_changes(*_manifest(spark, sf_dir)))
register("SELECT id AS path FROM gn WHERE id IN ('supplier_1', 'supplier_2') UNION SELECT source FROM ge WHERE relation = 'imports' AND target IN ('supplier_1', 'supplier_2')", name="invalidated")(lambda g: live.invalidated(g.nodes.filter("id in ('supplier_1', 'supplier_2')").select(F.col("id").alias("path")), g.edges.filter("relation = 'imports'").select(F.col("source").alias("path"), F.col("target").alias("imported"))))
register("SELECT doc_id FROM documents WHERE sha256(text) IN (SELECT sha256(text) FROM documents WHERE source LIKE '%1')", name="cache_hits")(lambda spark, sf_dir: live.cache_split(_documents(spark, sf_dir).select("doc_id", F.col("text").alias("content")), _documents(spark, sf_dir).filter("source like '%1'").select(F.sha2(F.col("text").cast("binary"), 256).alias("key")).distinct())[0].select("doc_id"))
register("SELECT doc_id FROM documents a WHERE EXISTS (SELECT 1 FROM (SELECT 'src/main.py' AS p) b WHERE a.path = p OR ends_with(a.path, p) OR ends_with(p, a.path) OR regexp_extract(a.path, '[^/]*$') = 'main.py')", name="same_file")(lambda spark, sf_dir: _documents(spark, sf_dir).filter(P.same_file("path", F.lit("src/main.py"))).select("doc_id"))
register("SELECT path, CAST(doc_id % 3 <> 0 AND doc_id % 4 <> 0 AS BOOLEAN) AS valid FROM (SELECT path, max(doc_id) AS doc_id FROM documents GROUP BY path HAVING count(*) = 1)", name="evidence_validity")(lambda spark, sf_dir: live.valid_evidence(*_evidence(spark, sf_dir)))
register(None, name="make_targets")(lambda spark, sf_dir: S.make_targets(_documents(spark, sf_dir)))

# --- the delivered graph, with its hot ids and dirt ----------------------------------------------
_LINKED = """ln AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS k FROM nodes WHERE snapshot_no = (SELECT max(snapshot_no) FROM nodes) AND id IS NOT NULL) t WHERE k = 1), nn AS (SELECT id, label, file_type, source_file, community FROM ln UNION ALL SELECT id, label, file_type, source_file, community FROM framework_nodes WHERE id NOT IN (SELECT id FROM ln)),
ll AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY link_id ORDER BY observed_at DESC) AS k FROM links) t WHERE k = 1), ee AS (SELECT * FROM ll WHERE source IN (SELECT id FROM nn) AND target IN (SELECT id FROM nn))"""


def _linked(name: str, sql: str, query, ctes: str = "") -> None:
    G.QUERIES[name] = lambda spark, sf_dir: query(link_graph(spark, sf_dir))
    G.SQL[name] = f"WITH {_LINKED}{', ' + ctes if ctes else ''} {sql}"


_LH = "lh AS (SELECT source AS id, target AS other, relation FROM ee UNION ALL SELECT target, source, relation FROM ee WHERE source <> target), ld AS (SELECT nn.id, count(lh.id) AS degree FROM nn LEFT JOIN lh ON lh.id = nn.id GROUP BY 1)"
_linked("link_degrees", "SELECT * FROM ld", M.degrees, _LH)
_linked("link_relation_hist", "SELECT relation, count(*) AS n FROM ee GROUP BY 1", lambda g: M.histogram(g.edges, "relation"))
_linked("link_god_nodes_by_degree", "SELECT id, degree FROM ld ORDER BY degree DESC, id LIMIT 20", lambda g: T.top_n(M.degrees(g), [F.col("degree").desc(), F.col("id")], 20), _LH)
_linked("link_bridges", "SELECT lh.id, count(*) AS cross_edges, count(DISTINCT o.community) AS external_communities FROM lh JOIN nn s ON s.id = lh.id JOIN nn o ON o.id = lh.other WHERE s.community <> o.community GROUP BY 1", M.bridges, _LH)
_linked("link_blast_radius", "SELECT count(DISTINCT other) AS nodes FROM lh WHERE id = (SELECT id FROM ld ORDER BY degree DESC, id LIMIT 1)", lambda g: M.blast_radius(g, M.degrees(g).orderBy(F.col("degree").desc(), "id").limit(1)).select("nodes"), _LH)
_linked("link_import_only", "SELECT id FROM lh GROUP BY id HAVING bool_and(lower(relation) = 'imports')", M.import_only, _LH)
