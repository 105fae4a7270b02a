"""Graph operators on small hand-made graphs."""

import pytest
from pyspark.sql import functions as F

from vertexloom.functions import paths as P
from vertexloom.operators import build as B
from vertexloom.operators import change as X
from vertexloom.operators import community as C
from vertexloom.operators import measure as M
from vertexloom.operators import rank as R
from vertexloom.operators import traverse as T
from vertexloom.operators.durable import Rounds, durable
from vertexloom.plans import datalog as D
from vertexloom.queries import graphs as G
from vertexloom.queries import views  # noqa: F401
from vertexloom.sources import graphs as S
from vertexloom.sources.extract import extract


def make(spark, edges, nodes=()):
    named = {i: (i, "code", "src/f.rs", None) for e in edges for i in e[:2]} | {n[0]: (*n[1:], *(None,) * (5 - len(n))) for n in nodes}
    n = spark.createDataFrame([(i, *v[:4]) for i, v in named.items()], "id string, label string, file_type string, source_file string, community bigint")
    e = spark.createDataFrame([(*e[:3], e[3] if len(e) > 3 else "EXTRACTED", 1.0, float(e[4]) if len(e) > 4 else 1.0) for e in edges] or [], "source string, target string, relation string, confidence string, confidence_score double, weight double")
    return S.Graph(S.conform(n, S.NODE), S.conform(e, S.EDGE))


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture(scope="module")
def chain(spark):
    return make(spark, [("a", "b", "calls"), ("b", "c", "calls"), ("c", "d", "calls")], [("lonely", "lonely", "code", "x.rs")])


def ask(g, text, **k):
    return [rows(df) for df in D.query(g, text, **k)]


def test_closures_and_ground_goals(chain):
    assert ask(chain, '?- calls_transitive("a", X).') == [[("b",), ("c",), ("d",)]]
    assert ask(chain, '?- depends_transitive("c", "a").') == [[(False,)]]
    assert D.depends(chain, "a", "d")


def test_rules_negation_recursion_and_joined_goals(chain):
    assert ask(chain, "sink(X) :- node(X,_,_,_,_), not calls(X,_,_). ?- sink(X).") == [[("d",), ("lonely",)]]
    assert ask(chain, "t(X,Y) :- calls(X,Y,_). t(X,Z) :- calls(X,Y,_), t(Y,Z). ?- t(X,Y).")[0] == [("a", "b"), ("a", "c"), ("a", "d"), ("b", "c"), ("b", "d"), ("c", "d")]
    assert ask(chain, "?- calls(X,Y,_), calls(Y,Z,_).", joined=True) == [[("a", "b", "c"), ("b", "c", "d")]]
    assert ask(chain, "?- is_orphan(X).") == [[("lonely",)]]


def test_bypass_is_stratified(chain):
    got = ask(chain, '?- bypasses_layer("a", Y, Z).')[0]
    assert not {("c", "b"), ("d", "b"), ("d", "c")} & set(got)


@pytest.mark.parametrize("text", ["?- invalid syntax!", "p(X) :- q(Y). ?- p(X).", "p(X) :- node(X,_,_,_,_), not p(X). ?- p(X).", "not p(1). ?- p(X).", "calls(X,Y,Z) :- edge(X,Y,Z,_). ?- calls(X,Y,Z).", "?- calls(X)."])
def test_bad_programs(chain, text):
    with pytest.raises(D.DatalogError):
        ask(chain, text)


def test_step_budget(spark):
    with pytest.raises(RuntimeError):
        ask(make(spark, [(f"n{i}", f"n{i + 1}", "calls") for i in range(9)]), '?- calls_transitive("n0", X).', budget=3)


def test_cycles(spark):
    g = make(spark, [("p", "q", "calls"), ("q", "p", "calls")])
    assert ask(g, "?- circular_dependency(X, Y).") == [[("p", "q"), ("q", "p")]]


def test_build(spark):
    n = spark.createDataFrame([("foo", "Foo", 1), ("foo", "FooUpdated", 2)], "id string, label string, seq int")
    assert B.upsert_nodes(n, "seq").select("label").first()[0] == "FooUpdated"
    g = make(spark, [("a", "b", "calls"), ("a", "c", "imports")])
    e = g.edges.withColumn("seq", F.lit(1)).unionByName(g.edges.withColumn("seq", F.lit(2))).unionByName(g.edges.withColumns({"seq": F.lit(3), "target": F.lit("zz")}))
    assert B.add_edges(g.nodes, e, "seq").count() == 2
    assert rows(M.degrees(g)) == [("a", 2), ("b", 1), ("c", 1)]
    assert B.remove_incident(g.edges, "b").count() == 1 and B.remove_between(g.edges, "b", "a").count() == 1
    bad = make(spark, [("", "b", "calls")])
    assert B.validate(bad.nodes, bad.edges)[1].count() == 0


def test_call_binding_needs_one_candidate(spark):
    g = make(spark, [("x", "run", "calls"), ("x", "twice", "calls")], [("x", "x", "code", "a.rs"), ("m_run", "run", "code", "b.rs"), ("m_t1", "twice", "code", "b.rs"), ("m_t2", "twice", "code", "c.rs")])
    nodes = g.nodes.filter("id not in ('run', 'twice')")
    assert rows(B.resolve_calls(nodes, g.edges).select("source", "target", "confidence")) == [("x", "m_run", "INFERRED")]


def test_traversal_and_paths(spark, chain):
    seed = spark.createDataFrame([("a",)], "id string")
    assert rows(T.reach(T.oriented(chain.edges), seed)) == [("a", 0), ("b", 1), ("c", 2), ("d", 3)]
    ring = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c")], "s string, t string")
    two = spark.createDataFrame([("a",), ("c",)], "s string")
    assert rows(T.closure_from(ring, two)) == [("a", "a"), ("a", "b"), ("a", "c")]
    assert T.depth_first(chain.edges, "a", 2, 10) == ["a", "b", "c"]
    g = make(spark, [("start", "m1", "calls"), ("m1", "m2", "calls"), ("m2", "goal", "calls"), ("start", "system", "imports"), ("system", "goal", "imports")])
    s = spark.createDataFrame([("start",)], "id string")
    ids = lambda df: [r["id"] for r in df.orderBy("pos").collect()]
    assert ids(T.path_to(T.cheapest(T.semantic_steps(g.edges), s), "goal")) == ids(T.find_path(g, "start", "goal")) == ["start", "m1", "m2", "goal"]
    assert ids(T.find_path(g, "start", "goal", "strict")) == ["start", "system", "goal"] and ids(T.shortest_path(g.edges, "start", "nowhere")) == []
    assert rows(T.path_confidence(g, T.find_path(g, "start", "goal")).select("pos", "source", "relation")) == [(0, "start", "calls"), (1, "m1", "calls"), (2, "m2", "calls")]


def test_walks_in_one_part_and_in_many(spark):
    import random

    rng = random.Random(8)
    links = sorted({(f"a{rng.randrange(60)}", f"a{rng.randrange(60)}") for _ in range(110)} | {(f"c{k}", f"c{k + 1}") for k in range(16)})
    after = {}
    for a, b in links:
        after.setdefault(a, []).append(b)
    pairs = spark.createDataFrame(links, "s string, t string")

    def walk(front):
        depth, d = {}, 0
        while front:
            front = {x for x in front if x not in depth}
            depth |= dict.fromkeys(front, d)
            front, d = {y for x in front for y in after.get(x, ())}, d + 1
        return depth

    seeds = ["a1", "a2", "c0"]
    for part in (1 << 20, 45):
        got = dict(rows(T.reach(pairs, spark.createDataFrame([(x,) for x in seeds], "id string"), part_links=part)))
        assert got == walk(set(seeds))
        two = rows(T.closure_from(pairs, spark.createDataFrame([(x,) for x in seeds], "s string"), part_links=part))
        assert two == sorted((x, y) for x in seeds for y in walk(set(after.get(x, ()))))
    assert T.reach(pairs.limit(0), spark.createDataFrame([("z",)], "id string")).collect() == [("z", 0)]


def test_doubling_closure(chain):
    assert rows(T.closure(T.oriented(chain.edges)))[0] == ("a", "b")


def test_costs_along_a_long_chain(spark):
    n = 70
    g = make(spark, [(f"n{k:03}", f"n{k + 1:03}", "calls") for k in range(n)] + [("n000", f"n{n:03}", "imports")])
    best = T.cheapest(T.oriented(g.edges).withColumn("cost", F.when(F.col("t") == f"n{n:03}", 1000).otherwise(1).cast("bigint")), spark.createDataFrame([("n000",)], "id string"))
    got = {r["id"]: (r["cost"], r["hops"]) for r in best.collect()}
    assert got[f"n{n - 1:03}"] == (n - 1, n - 1) and got[f"n{n:03}"] == (1000, 1)
    assert [r["pos"] for r in T.path_to(best, f"n{n - 1:03}").orderBy("pos").collect()] == list(range(n))


def test_references_subsystem_and_symbol(spark):
    g = make(spark, [("box", "f", "contains"), ("user", "main", "imports"), ("f", "g", "calls"), ("h", "f", "calls", "INFERRED"), ("f", "base", "inherits")], [("f", "F", "code", "src/main.rs", 1), ("main", "main", "code", "src/main.rs", 1), ("box", "Box", "code", "src/a.rs", 1), ("user", "User", "code", "x/user.rs", 2), ("h", "H", "code", "src/tests/h.rs", 1), ("g", "G", "code", "src/b.rs", 1)])
    assert rows(T.structural_references(g, "f")) == [("Box", "contains", "src/a.rs"), ("User", "imports_file", "x/user.rs")]
    parts = {}
    for part, name, _ in rows(T.explain_subsystem(g, "f").fillna("")):
        parts.setdefault(part, []).append(name)
    assert parts["caller"] == ["H"] and parts["parent"] == ["base"] and parts["test_file"] == ["src/tests/h.rs"] and "src/main.rs" in parts["production_file"]
    got = rows(T.analyse_symbol(g, "f").select("kind", "k", "relation", "n"))
    assert got == [("behavioural", 1, "calls", 3), ("behavioural", 2, "inherits", 3), ("behavioural", 3, "calls", 3), ("structural", 1, "contains", 1)]


def test_measures(spark):
    g = make(spark, [("s", "t", "references", "AMBIGUOUS")], [("s", "s", "code", "src/a.rs", 0), ("t", "t", "paper", "papers/b.pdf", 1)])
    assert M.surprise(g).select("score").first()[0] == 8.0
    tri = make(spark, [("a", "b", "calls"), ("b", "c", "calls"), ("a", "c", "calls")], [(x, x, "code", f"{x}1.rs", 0) for x in "abc"])
    assert M.community_stats(tri).first()["cohesion"] == 1.0
    ranks = dict(rows(M.page_rank(tri.edges)))
    assert abs(sum(ranks.values()) - 1) < 1e-9 and ranks["c"] > ranks["b"] > ranks["a"]


def test_communities_split_two_triangles(spark):
    e = [("0", "1", "r"), ("1", "2", "r"), ("0", "2", "r"), ("3", "4", "r"), ("4", "5", "r"), ("3", "5", "r"), ("2", "3", "r", "EXTRACTED", 0.05)]
    g = make(spark, e, [("lone", "lone", "code", "x.rs")])
    got = dict(rows(C.communities(g.nodes, g.edges)))
    assert got["0"] == got["1"] == got["2"] != got["3"] == got["4"] == got["5"] and len(set(got.values())) == 3
    one = spark.createDataFrame([(str(k), 0) for k in range(6)] + [("lone", 1)], "id string, community bigint")
    apart = dict(rows(C.split_large(one, g.edges, 0.25, 3)))
    assert apart["0"] == apart["1"] == apart["2"] != apart["3"] == apart["5"] and len(set(apart.values())) == 3
    assert dict(rows(C.split_large(one, g.edges, 0.25, 10)))["5"] == 0


def test_communities_are_worth_it(spark):
    import random

    rng = random.Random(4)
    pairs = {(a, b) for k in range(6) for a in range(k * 12, k * 12 + 12) for b in range(a + 1, k * 12 + 12) if rng.random() < 0.5} | {tuple(sorted(rng.sample(range(72), 2))) for _ in range(30)}
    g = make(spark, [(f"n{a}", f"n{b}", "r") for a, b in sorted(pairs)])
    q = M.modularity(C.cluster(g)).first()["q"]
    planted = M.modularity(g.with_(nodes=g.nodes.withColumn("community", F.floor(F.substring("id", 2, 3).cast("int") / 12)))).first()["q"]
    assert q >= planted - 0.03, (q, planted)


def test_betweenness_dominators_walks(spark, chain):
    b = dict(rows(C.betweenness(chain.edges)))
    assert b["b"] == b["c"] > b["a"] == 0
    assert rows(C.dominators(chain.edges, "a")) == [("b", "a"), ("c", "b"), ("d", "c")]
    assert C.random_walks(chain.edges, 1, 3).filter("start = 'a' and step = 2").first()["id"] == "c"
    norms = [sum(x * x for x in r["vector"]) for r in C.node_vectors(chain.edges, 4, 1, 3, 1).collect()]
    assert norms and all(abs(x - 1) < 1e-6 for x in norms)


def test_betweenness_of_the_whole_graph_both_ways(spark, tmp_path):
    from itertools import product

    links = [("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("a", "d"), ("d", "e"), ("e", "f"), ("c", "f"), ("x", "y"), ("y", "z"), ("s", "s")]
    near = {i: {b if a == i else a for a, b in links if i in (a, b)} - {i} for i in {i for e in links for i in e}}

    def shortest(s, t):
        paths, seen = [[s]], {s}
        while paths and t not in {p[-1] for p in paths}:
            paths = [[*p, b] for p in paths for b in near[p[-1]] if b not in seen]
            seen |= {p[-1] for p in paths}
        return [p for p in paths if p[-1] == t]

    want = dict.fromkeys(near, 0.0)
    for s, t in product(near, near):
        for p in (found := shortest(s, t) if s != t else []):
            for b in p[1:-1]:
                want[b] += 1 / len(found) / ((len(near) - 1) * (len(near) - 2) / 2)
    g = make(spark, [(*e, "calls") for e in links])
    for way in ({}, {"local_links": 0}, {"local_links": 0, "states": 40}):
        assert dict(rows(C.betweenness(g.edges, **way))) == pytest.approx(want)

    from vertexloom.queries.graphs import QUERIES

    for name, n, columns in (("region", 1, "id AS r_regionkey, 'r' AS r_name"), ("nation", 1, "id AS n_nationkey, id AS n_regionkey, 'n' AS n_name"), ("customer", 400, "id AS c_custkey, 0 AS c_nationkey, 'c' AS c_name, 'm' AS c_mktsegment"), ("supplier", 1, "id AS s_suppkey, 0 AS s_nationkey, 's' AS s_name"), ("part", 1, "id AS p_partkey, 'p' AS p_name, 't' AS p_type"), ("orders", 0, "id AS o_orderkey, id AS o_custkey, '' AS o_orderpriority"), ("lineitem", 0, "id AS l_orderkey, id AS l_partkey, id AS l_suppkey, 1 AS l_linenumber, '' AS l_returnflag")):
        spark.range(n).selectExpr(*columns.split(", ")).write.parquet(str(tmp_path / f"{name}.parquet"))
    got = dict(rows(QUERIES["betweenness"](spark, str(tmp_path))))
    assert len(got) == 404 and got["nation_0"] == pytest.approx(402 * 401 / (403 * 402 / 2)) and got["customer_7"] == 0


def test_change_and_policy(spark, chain):
    more = make(spark, [("a", "b", "calls"), ("b", "x", "calls")])
    assert ("x", "added") in rows(X.diff_nodes(chain, more)) and ("d", "removed") in rows(X.diff_nodes(chain, more))
    assert rows(X.impact(chain, spark.createDataFrame([("c",)], "id string"))) == [("a", 2), ("b", 1)]
    g = make(spark, [("p", "q", "calls")], [("p", "Planned", "code", "src/controllers/auth.rs"), ("q", "q", "code", "src/db/connection.rs")])
    g = g.with_(edges=g.edges.withColumn("plan_id", F.lit("x")), nodes=g.nodes.withColumn("plan_id", F.when(F.col("id") == "p", "x")))
    assert X.forbidden(g, "x", "src/controllers/**", "src/db/**").count() == 1
    assert X.layering(g, "x", ["src/db/**", "src/controllers/**"], True).count() == 1
    assert rows(X.compliance(g, "x")) == [("Planned", "missing")]
    rules = [{"type": "forbidden_dependency", "from_pattern": "src/controllers/**", "to_pattern": "src/db/**", "reason": "no"}, {"type": "banned_symbol", "symbol_label": " q ", "reason": "old"}, {"type": "strict_layering", "layers": ["src/db/**", "src/controllers/**"], "reason": "layers"}]
    assert [r[0] for r in rows(X.preflight(g, "x", rules))] == ["banned_symbol", "forbidden_dependency", "strict_layering"]
    assert X.preflight(g, "other", rules).count() == 0 and rows(X.change_gate(g, "x", rules).filter("gate = 'Preflight'")) == [("Preflight", 3.0, 0.0, False)]
    assert rows(X.validate_plan(g, "x", rules[:1], C.cluster).select("rule")) == [("forbidden_dependency",)]
    gate = X.delta_gate(make(spark, [("a", "b", "calls"), ("b", "c", "calls")]), "x", lambda x: x.with_(nodes=x.nodes.withColumn("community", F.lit(0).cast("bigint"))))[0].first()
    assert gate["passes"] and gate["delta"] == 0


def test_threshold_gates(spark):
    g = make(spark, [(f"f{k}", f"g{k}", "imports") for k in range(100)] + [(f"f{k}", f"g{k + 1}", "calls", "AMBIGUOUS") for k in range(20)])
    g = g.with_(edges=g.edges.withColumn("resolution_status", F.when((F.col("relation") == "imports") & (F.substring("source", 2, 3).cast("int") < 90), "resolved").otherwise("unresolved")))
    got = {r["policy"]: (r["value"], r["passed"]) for r in X.threshold_policies(g, 85.0, 5).collect()}
    assert got["MinResolution"] == (90.0, True) and got["MaxAmbiguous"] == (20.0, False) and got["MaxUnresolved"] == (10.0, True) and got["MinCallResolution"] == (0.0, False)
    assert X.threshold_policies(g, ast_only=True).filter("policy = 'MinCallResolution' and passed").count() == 1
    assert X.resolution_gate(g, 80, 30).first()["passed"] is False and X.resolution_gate(g, 80, 30, ast_only=True).first()["passed"] is True
    assert dict((r["name"], r["value"]) for r in X.doctor(g, ["rust", "go"]).filter("check = 'language'").collect()) == {"rust": 200.0, "go": 0.0}


def test_drift_and_verification(spark):
    star = [("h", f"l{k}", "calls") for k in range(6)]
    old = make(spark, star, [("h", "H", "code", "a.rs", 0), *((f"l{k}", f"l{k}", "code", "b.rs", 0) for k in range(6))])
    new = make(spark, star, [("h", "H", "code", "a.rs", 1), *((f"l{k}", f"l{k}", "code", "b.rs", 0) for k in range(5)), ("l5", "l5", "code", "b.rs", None)])
    got = {(r["kind"], r["node_id"], r["severity"]) for r in X.drift(old, new).collect()}
    assert got == {("CommunityChanged", "h", "Info"), ("CommunityChanged", "l5", "Warning"), ("HubMoved", "h", "Critical"), ("NewCrossBoundaryEdge", "cross-boundary", "Warning"), ("CommunitySplit", "community-structure", "Info")}
    assert X.drift_by_severity(X.drift(old, new)).first()["severity"] == "Critical"
    g = make(spark, [("auth_login", "validate", "calls"), ("test_login", "auth_login", "tests"), ("auth_login", "guess", "calls", "INFERRED")])
    plan = rows(X.verification_plan(g, spark.createDataFrame([("auth_login",)], "id string")).select("step", "target", "priority"))
    assert plan == [("InspectEdge", "auth_login calls guess", 6), ("ReadSource", "auth_login", 1), ("ReadSource", "test_login", 3), ("ReadSource", "validate", 2), ("RiskGate", "security_review", 7), ("RunTest", "test_login", 4)]
    few = X.safe_diff(X.inventory(old, make(spark, star[:2])), 2, 1)
    assert {(r["change"], r["n"]) for r in few.collect()} >= {("Removed", 4)} and few.filter("change = 'Removed'").count() == 1
    assert X.what_changed(old, new).first()["moved"] == 2


def test_hubs_noise_focus_and_surprise(spark):
    g = make(spark, [(f"f{k}", "app_hub", "imports") for k in range(10)] + [("x", "system", "imports"), ("y", "system", "imports"), ("a", "called", "calls"), ("b", "called", "calls")], [("system", "System.IO", "code", "src/z.rs"), ("app_hub", "app_hub", "code", "src/q.rs")])
    hubs = {r["id"] for r in M.aggregation_hubs(g).collect()}
    assert "app_hub" in hubs and "called" not in hubs and "f0" not in hubs
    assert rows(M.framework_noise(g)) == [("system",)]
    files = spark.createDataFrame([(1, "./src/serve/mod.rs"), (1, "./src/serve/handlers.rs"), (2, "a/x.rs"), (2, "b/y.rs"), (2, "b/y.rs"), (3, "src/one/file.rs")], "c int, f string")
    assert dict(rows(M.focus_labels(files, "c", "f"))) == {1: "./src/serve", 2: "b/y.rs | a/x.rs", 3: "src/one"}
    wide = make(spark, [("s", "hub", "references", "AMBIGUOUS")] + [(f"k{k}", "hub", "references") for k in range(4)], [("s", "s", "code", "src/a.rs", 0), ("hub", "hub", "paper", "papers/b.pdf", 1)])
    assert M.surprise(wide).filter("source = 's'").first()["score"] == 9.0
    lone = make(spark, [("a", "b", "calls")], [("a", "a", "code", "x.rs", 1), ("b", "b", "code", "x.rs", 2)])
    assert {r["cohesion"] for r in M.community_stats(lone).collect()} == {0.0}
    q = {r["source"] for r in M.suggested_questions(wide, M.community_stats(wide), C.betweenness(wide.edges)).collect()}
    assert {"ambiguous", "bottleneck"} <= q


def test_path_classes(spark):
    df = spark.createDataFrame([("src/tests/a.rs",), ("src/template/x.cs",), ("a/b.generated.ts",), (".env.local",), ("src/main.rs",), ("x/id_rsa.pub",), ("a/.git/config",)], "p string")
    flags = {r["p"]: tuple(r)[1:] for r in df.select("p", P.is_test_path("p"), P.is_generated_path("p"), P.is_sensitive("p"), P.is_skipped_event("p")).collect()}
    assert flags == {"src/tests/a.rs": (True, False, False, False), "src/template/x.cs": (False, True, False, False), "a/b.generated.ts": (False, True, False, False), ".env.local": (False, False, True, True), "src/main.rs": (False, False, False, False), "x/id_rsa.pub": (False, False, True, False), "a/.git/config": (False, False, False, True)}
    one = spark.createDataFrame([("\\\\?\\C:\\p\\src\\a.rs", "héllo")], "p string, t string")
    assert tuple(one.select(P.relative_path("p", "C:/p"), P.clipped("t", 2), P.clipped("t", 3)).first()) == ("src/a.rs", "h", "hé")


def test_running_telemetry(spark):
    from vertexloom.operators import telemetry as E

    values = [5.0, 1.0, 9.0, 4.0, 8.0]
    df = spark.createDataFrame([("A" if k % 2 else "a", k, x) for k, x in enumerate(values)] + [(None, 9, 1.0), ("b", 1, None)], "n string, k int, x double")
    ema = 0.0
    p50 = p95 = p99 = values[0]
    for k, x in enumerate(values):
        ema = 0.9 * ema + 0.1 * x
        if k:
            p50, p95, p99 = p50 * 0.9 + x * 0.1, p95 + (x - p95) * (0.05 if x > p95 else 0.01), p99 + (x - p99) * (0.01 if x > p99 else 0.001)
    assert E.smoothed(df, "n", "x", "k").first()["ema"] == pytest.approx(ema)
    assert tuple(E.running_percentiles(df, "n", "x", "k").first()) == ("a", 5, pytest.approx(p50), pytest.approx(p95), pytest.approx(p99))


def test_corpus_ignores_and_round_trip(spark, tmp_path):
    for f in ("src/a.py", "node_modules/b.py", "out/c.py", "src/.env", "src/x.bin"):
        (tmp_path / "c" / f).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "c" / f).write_text("x = 1")
    got = S.read_corpus(spark, str(tmp_path / "c"), ["# note", "out/"])
    assert [r["path"].rsplit("/", 1)[-1] for r in got.collect()] == ["a.py"] and S.is_stale(got, "2000-01-01").first()["stale"]
    g = make(spark, [("a", "b", "calls")])
    S.write_json_graph(g, str(tmp_path / "g"))
    back = S.read_json_lines(spark, str(tmp_path / "g"))
    assert rows(back.edges) == rows(g.edges) and rows(back.nodes) == rows(g.nodes)


def test_file_watch_patches_the_graph(spark, tmp_path):
    from vertexloom.streaming import live

    src, state = tmp_path / "src", {}
    src.mkdir()
    (src / "m.py").write_text("def first():\n    return 1\n")
    state["g"] = S.Graph(S.conform(spark.createDataFrame([("old", "old", "gone.py")], "id string, label string, source_file string"), S.NODE), S.conform(spark.createDataFrame([], "source string, target string"), S.EDGE))

    def parse(batch):
        n, e = extract(batch, "path", "content")
        return n.withColumn("seq", F.lit(1)), e.withColumn("seq", F.lit(1))

    def save(g):
        S.write_snapshot(g, str(tmp_path / "snaps"), f"s{len(list((tmp_path / 'snaps').glob('*'))) if (tmp_path / 'snaps').exists() else 0}")
        state["g"] = S.read_snapshot(spark, str(tmp_path / "snaps"), sorted(x.name for x in (tmp_path / "snaps").iterdir())[-1])

    clustered = []
    q = live.watch_files(spark, str(src), parse, lambda: state["g"], save, str(tmp_path / "cp"), "0 seconds", lambda g: clustered.append(1) or g)
    q.processAllAvailable()
    (src / "n.py").write_text("def second():\n    return 2\n")
    q.processAllAvailable()
    q.stop()
    assert {"first", "second", "old"} <= {r["label"] for r in state["g"].nodes.collect()} and clustered
    live.publish(state["g"], "served")
    assert spark.table("served_nodes").count() == state["g"].nodes.count()
    many = spark.createDataFrame([(f"n{k}", "a.py") for k in range(100)], "id string, source_file string")
    assert live.changed_share(many, spark.createDataFrame([("m", "b.py")], "id string, source_file string")) < 0.05


def test_ids_and_labels(spark):
    df = spark.createDataFrame([("myfile", "MyClass"), ("_leading", ".dots."), ("", ""), ("foo::bar", "")], "a string, b string")
    assert [r[0] for r in df.select(P.make_id("a", "b")).collect()] == ["myfile_myclass", "leading_dots", "", "foo_bar"]
    lab = spark.createDataFrame([("  `System.Collections`  ",), ("<stdio.h>",), ("foo   bar",), ("[(x)]",), ("((((((((y))))))))",), ("(z",), (None,)], "l string")
    assert [r[0] for r in lab.select(P.normalize_label("l")).collect()] == ["System.Collections", "stdio.h", "foo bar", "x", "y", "(z", None]


def test_sources(spark, tmp_path):
    p = tmp_path / "g.json"
    p.write_text('{"nodes":[{"id":"a","label":"A"},{"id":"b","label":"B"},{"label":"no id"}],"links":[{"source":"a","target":"b","relation":"calls","confidence":"EXTRACTED"},{"source":"a","target":"zz","relation":"calls","confidence":"EXTRACTED"}],"hyperedges":[],"metadata":{"ast_only":true}}')
    g = S.read_json_graph(spark, str(p))
    assert g.nodes.count() == 2 and g.edges.count() == 1
    S.write_snapshot(g, str(tmp_path / "snaps"), "one")
    assert S.read_snapshot(spark, str(tmp_path / "snaps"), "one").edges.count() == 1 and S.list_snapshots(spark, str(tmp_path / "snaps")).first()["name"] == "one"
    t = spark.createDataFrame([(1, 'Sure:\n```json\n{"nodes":[{"id":"x","label":"X"}],"edges":[]}\n```'), (2, "nothing"), (3, 'x {"edges":[{"source":"a","target":"b"}]} y')], "k int, t string")
    assert rows(S.parse_extraction(t, "k", "t").select("k", "kind")) == [(1, "node"), (3, "edge")]
    n, e = extract(spark.createDataFrame([("m/a.py", "import os\ndef f(x):\n    return g(x)\n"), ("m/b.py", None)], "path string, text string"))
    assert {"f", "a"} <= {r["label"] for r in n.collect()} and {"contains", "imports", "calls"} == {r["relation"] for r in e.collect()}


def test_ranking(spark):
    g = make(spark, [("order_service", "db", "calls"), ("x", "system", "imports"), ("y", "system", "imports")])
    best = R.lexical_rank(g, "system service").orderBy(F.col("score").desc()).first()
    assert best["id"] == "order_service" and R.keywords("A, (service)! to") == ["service"]
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.6, 0.8]), (2, [0.0, 1.0])], "k int, v array<double>")
    assert [r["k"] for r in R.dense_search(v, "k", "v", [1.0, 0.1], 2).collect()] == [0, 1]


SHUFFLED = {
    "structural_rank": lambda g: R.ranked(g, "asia", "structural"),
    "hybrid_rank": lambda g: R.ranked(g, "asia", "hybrid"),
    "delta_gate": lambda g: X.delta_gate(g, "p", lambda x: x)[0],
    "drift_by_severity": lambda g: X.drift_by_severity(X.drift(g, g)),
    "drift_events": lambda g: X.drift(g, g.with_(edges=B.add_edges(g.nodes, g.edges.withColumn("seq", F.lit(0)), "seq"))),
    "community_summary": M.community_summary,
}


@pytest.mark.parametrize("name", SHUFFLED)
def test_node_tables_are_not_sent_whole_to_all_tasks(spark, name):
    g = make(spark, [("a", "b", "calls"), ("b", "c", "imports"), ("a", "c", "contains")], [("a", "asia", "code", "src/a.rs", 1), ("b", "B", "code", "src/b.rs", 2), ("c", "C", "code", "lib/c.rs", 2)])
    plan = SHUFFLED[name](S.Graph(durable(g.nodes), durable(g.edges)))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


@pytest.fixture(scope="module")
def far_ring(spark):
    """A ring of 1,100 parts, two suppliers beside it, and 1.1 million links that lead nowhere."""
    name = lambda a, n: F.concat(F.lit(f"{a}_"), n.cast("string"))
    ring = spark.range(1100).select(name("part", F.col("id")).alias("source"), name("part", (F.col("id") + 1) % 1100).alias("target"), F.lit("calls").alias("relation"))
    suppliers = spark.createDataFrame([("part_3", "supplier_1", "imports"), ("part_9", "supplier_2", "imports")], ring.schema)
    leaves = spark.range(1_100_000).select(F.lit("hub").alias("source"), name("leaf", F.col("id")).alias("target"), F.lit("calls").alias("relation"))
    edges = ring.unionByName(suppliers).unionByName(leaves).withColumn("confidence", F.lit("EXTRACTED"))
    nodes = ring.select(F.col("source").alias("id"), F.lit(1).alias("community")).unionByName(suppliers.select(F.col("target").alias("id"), F.lit(2).alias("community")))
    nodes = nodes.unionByName(spark.createDataFrame([("customer_3", 3)], nodes.schema))
    return S.Graph(durable(S.conform(nodes, S.NODE)), durable(S.conform(edges, S.EDGE)))


FAR_WALKS = {
    "calls_transitive_seeded": 1100,
    "reaching_bound_target": 1100,
    "circular_dependency_bound": 1099,
    "bypasses_layer_bound": 1102,
    "datalog_right_recursion": 1100,
    "reverse_reachable": 1099,
    "downstream_impact": 1100,
    "impact_report": 1,
}


@pytest.mark.parametrize("name", FAR_WALKS)
def test_far_walks_end_in_a_few_rounds(spark, far_ring, monkeypatch, name):
    parts, add = [], Rounds.add

    def counted(self, *a, **k):
        parts.append(1)
        assert len(parts) <= 12, "a round for every few steps"
        return add(self, *a, **k)

    monkeypatch.setattr(Rounds, "add", counted)
    monkeypatch.setattr(G, "star_graph", lambda spark, sf_dir: far_ring)
    got = G.QUERIES[name](spark, "").collect()
    assert len(got) == FAR_WALKS[name] and (name != "impact_report" or tuple(got[0]) == (1100, 1, 1102, 0, 0))


def test_communities_in_one_task_and_by_joins_are_the_same(spark):
    import random

    rng = random.Random(5)
    ends = {(min(a, b), max(a, b)) for a, b in ((rng.randrange(90), rng.randrange(90)) for _ in range(260))} | {(a, b) for a in range(90) for b in range(a) if a // 9 == b // 9 and rng.random() < 0.6}
    g = make(spark, [(f"n{a:02}", f"n{b:02}", "calls", "EXTRACTED", 1 + rng.randrange(3)) for a, b in sorted(ends)], [("alone", "alone", "code", "x.rs")])
    here = rows(C.communities(g.nodes, g.edges))
    assert here == rows(C.communities(g.nodes, g.edges, local_links=0)) and len(here) == 91
    with_ = lambda found: M.modularity(g.with_(nodes=g.nodes.drop("community").join(spark.createDataFrame(found, "id string, community bigint"), "id").select(*g.nodes.columns))).first()[0]
    assert with_(here) > with_([(f"n{k:02}", k // 9) for k in range(90)] + [("alone", 99)]) - 0.03
    ab = C.undirected(g.edges).select(F.when(F.col("u") < "n45", "x").otherwise("y").alias("g"), "u", "v", "w").filter("(u < 'n45') = (v < 'n45')")
    assert rows(C._louvain(ab)) == rows(C._louvain(ab, local_links=0))


def test_depth_first_beyond_a_hub_of_many_links(spark):
    leaves = spark.range(250_000).select(F.lit("hub").alias("source"), F.format_string("leaf_%06d", "id").alias("target"))
    more = spark.createDataFrame([("leaf_000001", "x"), ("x", "y"), ("y", "z")], "source string, target string")
    got = T.depth_first(durable(leaves.unionByName(more)), "hub", 3, 6)
    assert got == ["hub", "leaf_000000", "leaf_000001", "x", "y", "leaf_000002"]


def test_depth_first_is_whole(spark):
    import random

    rng = random.Random(3)
    pairs = {(f"n{rng.randrange(60):02}", f"n{rng.randrange(60):02}") for _ in range(150)}
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    for depth, most in ((2, 20), (3, 40), (6, 200)):
        want, stack = [], [("n07", 0)]
        while stack and len(want) < most:
            at, d = stack.pop()
            if at not in want:
                want.append(at)
                stack += [(x, d + 1) for x in sorted(near[at], reverse=True) if d < depth]
        assert T.depth_first(spark.createDataFrame(sorted(pairs), "source string, target string"), "n07", depth, most) == want


def test_clustered_gate_writes_no_table_a_round(spark, monkeypatch):
    n, add = [], Rounds.add
    monkeypatch.setattr(Rounds, "add", lambda self, *a, **k: (n.append(1), add(self, *a, **k))[1])
    g = make(spark, [(f"n{k:02}", f"n{(k * 7 + 3) % 40:02}", "calls") for k in range(40)] + [(f"n{k:02}", f"n{(k + 1) % 40:02}", "calls") for k in range(40)])
    gate = X.delta_gate(g, "p", C.cluster)[0].first()
    assert gate["delta"] == 0 and len(n) <= 8


def test_betweenness_searches_from_no_leaf():
    import time

    import numpy as np

    k, began = 20_000, time.process_time()
    degree, near = np.array([k] + [1] * k), np.concatenate([np.arange(1, k + 1), np.zeros(k, dtype=np.int64)])
    score = C._brandes(np.concatenate([[0], np.cumsum(degree)]), near, iter(range(k + 1)))
    assert score[0] == k * (k - 1) and not score[1:].any() and time.process_time() - began < 2
