"""Traversal and path search over (source, target) frames.

Walks of bounded depth are level-synchronous: a round joins the frontier with the links and keeps what is
new. Unbounded walks follow links as far as they lead inside a part of the links, so that a round costs a
crossing between parts and not a step; parts have a fixed size, whatever the graph. What was found is a
table that grows by a part each round: lineage stays short, a lost executor costs one round at most.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vertexloom.functions.paths import make_id, is_test_path, stem
from vertexloom.operators.durable import SENT_ROWS, Rounds, durable, shuffled
from vertexloom.operators.measure import degrees, focus_labels, framework_noise, half_edges
from vertexloom.sources.graphs import Graph


def oriented(edges: DataFrame, direction: str = "forward", relations: Sequence[str] | None = None) -> DataFrame:
    """Distinct (s, t) in the direction ``forward``, ``reverse`` or ``both``."""
    if relations:
        edges = edges.filter(F.col("relation").isin(*relations))
    fwd, rev = edges.select(F.col("source").alias("s"), F.col("target").alias("t")), edges.select(F.col("target").alias("s"), F.col("source").alias("t"))
    return {"forward": fwd, "reverse": rev, "both": fwd.unionByName(rev)}[direction].distinct()


#: Links of one part (16 bytes each in its task, twice), and seeds that walk a part together.
PART_LINKS, PART_SEEDS = 1 << 24, 256
#: More steps than any walk takes.
FAR = 1 << 60


def _sent(df: DataFrame, n: int) -> DataFrame:
    """A side of a join, ``n`` rows as counted: sent whole to all tasks only where these are few."""
    return F.broadcast(df) if n <= SENT_ROWS else shuffled(df)


def _coded(pairs: DataFrame, marks: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, int, int]:
    """Links (s, t) and marks (seed, id, depth) by numbers in place of ids, the table (id, code), numbers of links and ids."""
    spark, pairs = pairs.sparkSession, pairs.filter("s is not null")
    codes, links = Rounds(spark), Rounds(spark)
    ids = pairs.select(F.explode(F.array("s", "t")).alias("id")).unionByName(marks.select(F.explode(F.array("seed", "id")).alias("id"))).distinct()
    n_ids = codes.add(ids.withColumn("code", F.monotonically_increasing_id()), n=F.count(F.lit(1)))["n"]
    by_id = codes.last()

    def coded(df: DataFrame, c: str) -> DataFrame:
        side = _sent(by_id.select(F.col("id").alias("was"), F.col("code").alias("now")), n_ids)
        return df.join(side, F.col(c).eqNullSafe(F.col("was"))).withColumn(c, F.col("now")).drop("was", "now")

    n = links.add(reduce(coded, ("s", "t"), pairs.select("s", "t")), n=F.count(F.lit(1)))["n"]
    return links.last(), reduce(coded, ("seed", "id"), marks), by_id, n, n_ids


def _walk(pairs: DataFrame, marks: DataFrame, budget: int | None = None, part_links: int = PART_LINKS) -> DataFrame:
    """(seed, id, depth): least depths reached over (s, t) from ``marks`` (seed, id, depth).

    Ids become numbers, and nodes are spread over parts by them. A task follows the marks of its part
    through the part's links, a level at once; marks that leave it are the next round's, as far as they
    improve what is known.
    """
    spark = pairs.sparkSession
    links, marks, by_id, n, n_ids = _coded(pairs, marks)
    first = Rounds(spark)
    seeds = first.add(marks, seeds=F.approx_count_distinct("seed"))["seeds"]
    parts, turns = max(1, -(-n // part_links)), max(1, -(-seeds // PART_SEEDS))
    home = lambda c: F.pmod(F.xxhash64(c), F.lit(parts)).cast("int")
    turn = F.pmod(F.xxhash64("seed"), F.lit(turns)).cast("int").alias("turn")
    near = links.select("s", "t", home("s").alias("part"), (home("s") != home("t")).alias("leaves"))
    near = near.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(turns - 1)))) if turns > 1 else near.withColumn("turn", F.lit(0))

    def follow(links: pa.Table, marks: pa.Table) -> pa.Table:
        s, t, leaves = (links[c].to_numpy() for c in ("s", "t", "leaves"))
        seed, own, depth, new = (marks[c].to_numpy() for c in ("seed", "id", "depth", "new"))
        ids, at = np.unique(np.concatenate([s, t, own]), return_inverse=True)
        at, there, here = at[: len(s)], at[len(s) : 2 * len(s)], at[2 * len(s) :]
        order = np.argsort(at, kind="stable")
        start = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(ids)))])
        there, leaves = there[order], leaves[order]
        del s, t, at, order
        known = np.full(len(ids), FAR, dtype=np.int64)
        out: list[tuple[np.ndarray, ...]] = []
        by_seed = np.argsort(seed, kind="stable")
        for rows in np.split(by_seed, np.flatnonzero(np.diff(seed[by_seed])) + 1):
            if not len(rows):
                continue
            np.minimum.at(known, here[rows], depth[rows])
            touched, found, exits = [here[rows]], [], []
            fresh, levels = rows[new[rows]], {}
            for d in np.unique(depth[fresh]):
                levels[int(d)] = [here[fresh[depth[fresh] == d]]]
            while levels:
                d = min(levels)
                front = np.unique(np.concatenate(levels.pop(d)))
                front = front[known[front] == d]
                if not len(front):
                    continue
                found.append((front, d, False))
                k = start[front + 1] - start[front]
                to = np.repeat(start[front] - np.cumsum(k) + k, k) + np.arange(k.sum())
                ahead, out_ = there[to], leaves[to]
                if out_.any():
                    exits.append((np.unique(ahead[out_]), d + 1, True))
                    ahead = ahead[~out_]
                ahead = ahead[known[ahead] > d + 1]
                if len(ahead):
                    known[ahead] = d + 1
                    touched.append(ahead)
                    levels.setdefault(d + 1, []).append(ahead)
            for x in touched:
                known[x] = FAR
            for x, d, leave in found + exits:
                out.append((ids[x], np.full(len(x), seed[rows[0]]), np.full(len(x), d), np.full(len(x), leave)))
        if not out:
            return pa.table({"seed": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "depth": pa.array([], pa.int64()), "out": pa.array([], pa.bool_())})
        id_, seed_, depth_, out_ = (np.concatenate(x) for x in zip(*out))
        return pa.table({"seed": seed_.astype(np.int64), "id": id_, "depth": depth_.astype(np.int64), "out": out_})

    table = Rounds(spark)
    front, left = first.last().select("seed", "id", "depth"), 1
    while left:
        new = front.withColumn("new", F.lit(True))
        if table.n:
            new = new.unionByName(table.all().filter("not out").select("seed", "id", "depth", F.lit(False).alias("new")))
        both = near.groupBy("part", "turn").cogroup(new.select("*", home("id").alias("part"), turn).groupBy("part", "turn"))
        got = table.add(both.applyInArrow(follow, "seed long, id long, depth long, out boolean"), left=F.count_if("out"), deepest=F.max(F.when(~F.col("out"), F.col("depth"))))
        if budget is not None and (got["deepest"] or 0) + 1 > budget:
            raise RuntimeError("maximum step limit reached")
        left = got["left"]
        if left:
            crossed = table.last().filter("out").groupBy("seed", "id").agg(F.min("depth").alias("depth"))
            known = table.all().filter("not out").groupBy("seed", "id").agg(F.min("depth").alias("d0"))
            step = Rounds(spark)
            left = step.add(crossed.join(known, ["seed", "id"], "left").filter(F.col("d0").isNull() | (F.col("depth") < F.col("d0"))).select("seed", "id", "depth"), n=F.count(F.lit(1)))["n"]
            front = step.last()
    found = table.all().filter("not out")
    if parts > 1:
        found = found.groupBy("seed", "id").agg(F.min("depth").alias("depth"))
    own = by_id.join(first.last().select(F.col("seed").alias("code")).distinct(), "code", "left_semi").select(F.col("code").alias("seed"), F.col("id").alias("seed_id"))
    found = found.withColumnRenamed("id", "code").join(_sent(by_id, n_ids), "code").join(_sent(own, seeds), "seed")
    return found.select(F.col("seed_id").alias("seed"), "id", "depth")


def reach(pairs: DataFrame, seeds: DataFrame, max_depth: int | None = None, max_nodes: int | None = None, part_links: int = PART_LINKS) -> DataFrame:
    """(id, depth): least number of steps from any seed (column id); seeds have depth 0.

    ``max_nodes`` keeps the first nodes by (depth, id), as a bounded breadth-first search meets them.
    """
    if max_depth is None:
        marks = seeds.select(F.lit("").alias("seed"), "id", F.lit(0).cast("bigint").alias("depth")).distinct()
        out = _walk(pairs.select("s", "t"), marks, part_links=part_links).select("id", F.col("depth").cast("int").alias("depth"))
        return out.orderBy("depth", "id").limit(max_nodes) if max_nodes else out
    pairs = durable(pairs)
    table, depth = Rounds(pairs.sparkSession), 0
    total = new = table.add(seeds.select("id").distinct(), n=F.count(F.lit(1)))["n"]
    while new and depth < max_depth and (not max_nodes or total < max_nodes):
        depth += 1
        step = table.last().withColumnRenamed("id", "s").join(pairs, "s").select(F.col("t").alias("id")).distinct()
        new = table.add(step.join(table.all().select("id"), "id", "left_anti"), n=F.count(F.lit(1)))["n"]
        total += new
    out = table.all().select("id", F.col("round").alias("depth"))
    return out.orderBy("depth", "id").limit(max_nodes) if max_nodes else out


def closure_from(pairs: DataFrame, seeds: DataFrame, budget: int | None = None, part_links: int = PART_LINKS) -> DataFrame:
    """(s, t): everything reached from each seed in one step or more (column s)."""
    pairs = durable(pairs.select("s", "t"))
    marks = seeds.select("s").distinct().join(pairs, "s").select(F.col("s").alias("seed"), F.col("t").alias("id"), F.lit(1).cast("bigint").alias("depth")).distinct()
    return _walk(pairs, marks, budget, part_links).select(F.col("seed").alias("s"), F.col("id").alias("t"))


def closure(pairs: DataFrame, budget: int | None = None) -> DataFrame:
    """(s, t) of all pairs, by recursive doubling: the number of rounds is logarithmic in the depth."""
    total = durable(pairs.select("s", "t").distinct())
    size, rounds = total.count(), 1
    while True:
        rounds += 1
        if budget is not None and 2**rounds > 2 * budget:
            raise RuntimeError("maximum step limit reached")
        twice = total.select("s", F.col("t").alias("m")).join(total.select(F.col("s").alias("m"), "t"), "m").select("s", "t")
        total = durable(total.unionByName(twice).distinct())
        if (n := total.count()) == size:
            return total
        size = n


def cheapest(steps: DataFrame, seeds: DataFrame) -> DataFrame:
    """(id, cost, hops, parent): least (cost, hops), then least parent, over (s, t, cost) steps.

    Relaxation rounds until nothing improves; a round writes only what it improved, and the best of a
    node is the least of its rows.
    """
    steps = durable(steps)
    table = Rounds(steps.sparkSession)
    least = lambda df: df.groupBy("id").agg(F.min(F.struct("cost", "hops", "parent")).alias("o")).select("id", "o.*")
    new = table.add(seeds.select("id", F.lit(0).cast(steps.schema["cost"].dataType).alias("cost"), F.lit(0).alias("hops"), F.lit(None).cast("string").alias("parent")).distinct(), n=F.count(F.lit(1)))["n"]
    while new:
        offer = table.last().select(F.col("id").alias("s"), F.col("cost").alias("c0"), "hops").join(steps, "s").select(F.col("t").alias("id"), (F.col("c0") + F.col("cost")).alias("cost"), (F.col("hops") + 1).alias("hops"), F.col("s").alias("parent"))
        old = least(table.all()).select("id", F.col("cost").alias("c1"), F.col("hops").alias("h1"), F.col("parent").alias("p1"))
        better = F.col("c1").isNull() | (F.struct("cost", "hops") < F.struct(F.col("c1"), F.col("h1"))) | ((F.col("cost") == F.col("c1")) & (F.col("hops") == F.col("h1")) & (F.col("parent") < F.col("p1")))
        new = table.add(least(offer).join(old, "id", "left").filter(better).select("id", "cost", "hops", "parent"), n=F.count(F.lit(1)))["n"]
    return least(table.all())


def path_to(best: DataFrame, goal: str) -> DataFrame:
    """(pos, id) from a seed to ``goal`` along the parents of ``cheapest``; empty when it was not reached.

    Pointers to parents double each round, and each id on the way gets its distance from the goal.
    """
    up = durable(best.select("id", F.col("parent").alias("far"), F.lit(1).cast("bigint").alias("n")))
    on = best.filter(F.col("id") == goal).select("id", F.lit(0).cast("bigint").alias("back"))
    on = durable(on)
    while True:
        more = durable(on.join(up, "id").filter("far is not null").select(F.col("far").alias("id"), (F.col("back") + F.col("n")).alias("back")))
        if more.isEmpty():
            break
        on = durable(on.unionByName(more).distinct())
        way = up.select(F.col("id").alias("far"), F.col("far").alias("beyond"), F.col("n").alias("m"))
        up = durable(up.filter("far is not null").join(way, "far", "left").select("id", F.col("beyond").alias("far"), (F.col("n") + F.coalesce("m", F.lit(0))).alias("n")))
    top = on.agg(F.max("back").alias("top"))  # one row
    return on.crossJoin(F.broadcast(top)).select((F.col("top") - F.col("back")).cast("int").alias("pos"), "id")


def shortest_path(edges: DataFrame, start: str, goal: str, include: Sequence[str] | None = None) -> DataFrame:
    """(pos, id) of a path of fewest steps, edges taken both ways; ties go to the least ids."""
    steps = oriented(edges, "both", include).withColumn("cost", F.lit(1).cast("bigint"))
    return path_to(cheapest(steps, edges.sparkSession.createDataFrame([(start,)], "id string")), goal)


def find_path(graph: Graph, start: str, goal: str, mode: str = "semantic", exclude_noise: bool = False) -> DataFrame:
    """(pos, id) by the mode ``strict`` (fewest steps) or ``semantic`` (relations and noise weighed)."""
    if mode == "strict":
        return shortest_path(graph.edges, start, goal)
    steps = semantic_steps(graph.edges, framework_noise(graph).filter(F.col("id") != goal), 20_000 if exclude_noise else 8_000)
    return path_to(cheapest(steps, graph.nodes.sparkSession.createDataFrame([(start,)], "id string")), goal)


def path_confidence(graph: Graph, path: DataFrame) -> DataFrame:
    """(pos, source, target, relation, confidence, extractor, resolution_status) of each step of a path (pos, id):
    of the edges between two nodes the one of least (relation, confidence)."""
    step = path.select("pos", F.col("id").alias("a")).join(path.select((F.col("pos") - 1).alias("pos"), F.col("id").alias("b")), "pos")
    e = graph.edges.select("source", "target", F.struct("relation", "confidence", "extractor", "resolution_status", "source", "target").alias("e"))
    both = e.select(F.col("source").alias("a"), F.col("target").alias("b"), "e").unionByName(e.select(F.col("target").alias("a"), F.col("source").alias("b"), "e"))
    best = step.join(both, ["a", "b"]).groupBy("pos").agg(F.min("e").alias("e"))
    return best.select("pos", "e.source", "e.target", "e.relation", "e.confidence", "e.extractor", "e.resolution_status")


RELATION_COST = {"calls": 1000, "uses": 1200, "method": 1300, "contains": 1400, "references": 1700, "imports": 6000}


def relation_cost(relation: Column) -> Column:
    table = F.create_map(*(F.lit(x) for kv in RELATION_COST.items() for x in kv))
    return F.coalesce(F.try_element_at(table, F.lower(relation)), F.lit(2200))


def safest_steps(edges: DataFrame, relations: Sequence[str] | None = None) -> DataFrame:
    """Undirected steps whose cost is 1 - the best confidence score of the edges between two nodes."""
    if relations:
        edges = edges.filter(F.col("relation").isin(*relations))
    both = edges.select(F.col("source").alias("s"), F.col("target").alias("t"), "confidence_score").unionByName(edges.select(F.col("target").alias("s"), F.col("source").alias("t"), "confidence_score"))
    return both.groupBy("s", "t").agg((1 - F.max("confidence_score")).alias("cost"))


def semantic_steps(edges: DataFrame, noisy: DataFrame | None = None, penalty: int = 8000) -> DataFrame:
    """Undirected steps of the cheapest relation's cost, plus a penalty for entering a noisy node (column id)."""
    both = edges.select(F.col("source").alias("s"), F.col("target").alias("t"), relation_cost(F.col("relation")).alias("cost")).unionByName(edges.select(F.col("target").alias("s"), F.col("source").alias("t"), relation_cost(F.col("relation")).alias("cost")))
    steps = both.groupBy("s", "t").agg(F.min("cost").cast("bigint").alias("cost"))
    if noisy is None:
        return steps
    flagged = steps.join(noisy.select(F.col("id").alias("t"), F.lit(penalty).alias("more")).distinct(), "t", "left")
    return flagged.select("s", "t", (F.col("cost") + F.coalesce("more", F.lit(0))).alias("cost"))


def neighbours(nodes: DataFrame, edges: DataFrame, node: str, limit: int | None = None) -> DataFrame:
    """(neighbour, label, relation, confidence) of one node, by relation cost, then label and id."""
    e = edges.filter((F.col("source") == node) | (F.col("target") == node))
    other = F.when(F.col("source") == node, F.col("target")).otherwise(F.col("source"))
    out = e.select(other.alias("id"), "relation", "confidence").distinct().join(nodes.select("id", "label"), "id")
    out = out.orderBy(relation_cost(F.col("relation")), "label", "id", "relation", "confidence").select(F.col("id").alias("neighbour"), "label", "relation", "confidence")
    return out.limit(limit) if limit else out


def depth_first(edges: DataFrame, seed: str, max_depth: int, max_nodes: int) -> list[str]:
    """The first ``max_nodes`` ids in depth-first order within ``max_depth`` of the seed, children by id.

    At most ``max_nodes`` nodes are met, so no more than the first ``max_nodes`` neighbours of one matter;
    these are fetched for all waiting nodes at once, whatever the number of links there.
    """
    pairs = oriented(edges, "both")
    next_: dict[str, list[str]] = {}

    def fetch(ids: list[str]) -> None:
        next_.update((x, []) for x in ids)
        for r in top_n(pairs.filter(F.col("s").isin(ids)), [F.col("t")], max_nodes, ["s"]).collect():
            next_[r["s"]].append(r["t"])

    out: list[str] = []
    seen, stack = set(), [(seed, 0)]
    while stack and len(out) < max_nodes:
        at, d = stack.pop()
        if at in seen:
            continue
        seen.add(at)
        out.append(at)
        if d < max_depth and len(out) < max_nodes:
            if at not in next_:
                ahead = (x for x, k in reversed(stack) if k < max_depth and x not in seen and x not in next_)
                fetch([at, *dict.fromkeys(itertools.islice(ahead, max_nodes - len(out)))])
            stack += [(t, d + 1) for t in sorted(next_[at], reverse=True) if t not in seen]
    return out


def resolve_symbols(nodes: DataFrame, symbols: DataFrame) -> DataFrame:
    """(symbol, id): comma lists split; the node of that id, else all nodes of that label in any case."""
    s = symbols.select(F.explode(F.split("symbols", ",")).alias("symbol")).select(F.trim("symbol").alias("symbol")).filter("symbol <> ''")
    by_id = s.join(nodes.select("id", F.col("id").alias("symbol")), "symbol").select("symbol", "id")
    rest = s.join(by_id.select("symbol"), "symbol", "left_anti")
    by_label = rest.join(nodes.select("id", F.lower("label").alias("l")), F.lower("symbol") == F.col("l")).select("symbol", "id")
    return by_id.unionByName(by_label).distinct()


def resolve_one(nodes: DataFrame, degrees: DataFrame, symbol: str) -> DataFrame:
    """The single best (id, label) for a symbol: highest degree, then shorter id, then larger id."""
    hit = nodes.filter((F.col("id") == symbol) | (F.lower("label") == symbol.lower()) | (F.lower("qualified_label") == symbol.lower()))
    ranked = hit.join(degrees, "id", "left").orderBy(F.coalesce("degree", F.lit(0)).desc(), F.length("id"), F.col("id").desc())
    return ranked.select("id", "label").limit(1)


def structural_references(graph: Graph, symbol: str) -> DataFrame:
    """(label, relation, source_file): what contains, implements or extends a symbol, and what imports its file."""
    n = graph.nodes.select(F.col("id").alias("source"), "label", "source_file")
    own = graph.edges.filter((F.col("target") == symbol) & F.col("relation").isin("contains", "method", "inherits", "implements"))
    out = own.select("source", "relation").join(n, "source").select("label", "relation", "source_file")
    file_id = graph.nodes.filter(F.col("id") == symbol).select(make_id(stem("source_file")).alias("target")).filter(F.col("target") != symbol)
    by = graph.edges.filter("relation = 'imports'").join(F.broadcast(file_id), "target", "left_semi").select("source").join(n, "source")  # one row
    return out.unionByName(by.select("label", F.lit("imports_file").alias("relation"), "source_file"))


def explain_subsystem(graph: Graph, symbol: str) -> DataFrame:
    """(part, name, detail): parents, callers, production and test files, focus and hubs around a symbol."""
    me = graph.nodes.filter(F.col("id") == symbol)
    out_ = graph.edges.filter(F.col("source") == symbol).select(F.col("target").alias("id"), "relation", F.lit("out").alias("way"))
    in_ = graph.edges.filter(F.col("target") == symbol).select(F.col("source").alias("id"), "relation", F.lit("in").alias("way"))
    near = out_.unionByName(in_).join(graph.nodes.select("id", "label", "source_file"), "id")
    row = lambda df, part, name, detail: df.select(F.lit(part).alias("part"), name.alias("name"), detail.cast("string").alias("detail"))
    none = F.lit(None)
    out = row(near.filter("way = 'out' and relation in ('inherits', 'implements', 'contains', 'method')"), "parent", F.col("label"), F.col("relation"))
    out = out.unionByName(row(near.filter("way = 'in' and relation in ('calls', 'imports', 'uses')"), "caller", F.col("label"), none))
    files = near.select("source_file", is_test_path("source_file").alias("test")).unionByName(me.select("source_file", F.lit(False).alias("test"))).distinct()
    out = out.unionByName(row(files.filter("not test"), "production_file", F.col("source_file"), none)).unionByName(row(files.filter("test"), "test_file", F.col("source_file"), none))
    mates = graph.nodes.join(F.broadcast(me.select("community").filter("community is not null")), "community")  # one row
    out = out.unionByName(row(focus_labels(mates, "community", "source_file"), "focus", F.col("focus"), F.col("community")))
    hubs = mates.filter(F.col("id") != symbol).select("id", "label").join(framework_noise(graph), "id", "left_anti").join(degrees(graph), "id").orderBy(F.col("degree").desc(), "id").limit(3)
    return out.unionByName(row(hubs, "hub", F.col("label"), F.col("degree")))


def analyse_symbol(graph: Graph, symbol: str, behavioural: int = 10, structural: int = 5) -> DataFrame:
    """(kind, k, relation, other, direction, confidence, n): the edges of a symbol, behaviour and structure apart,
    by confidence and relation; ``n`` is the whole number of each kind, of which the first are listed."""
    e = graph.edges.filter((F.col("source") == symbol) | (F.col("target") == symbol))
    kind = F.when(F.col("relation").isin("contains", "imports"), "structural").otherwise("behavioural")
    trust = F.when(F.col("confidence") == "EXTRACTED", 0).when(F.col("confidence") == "INFERRED", 1).otherwise(2)
    out = e.select(kind.alias("kind"), "relation", F.when(F.col("source") == symbol, F.col("target")).otherwise(F.col("source")).alias("other"), F.when(F.col("source") == symbol, "out").otherwise("in").alias("direction"), "confidence", trust.alias("trust"))
    w = Window.partitionBy("kind")
    out = out.withColumns({"k": F.row_number().over(w.orderBy("trust", "relation", "other", "direction")), "n": F.count(F.lit(1)).over(w)})
    return out.filter(F.col("k") <= F.when(F.col("kind") == "structural", structural).otherwise(behavioural)).drop("trust")


def file_summary(nodes: DataFrame, degrees: DataFrame, suffix: str) -> DataFrame:
    """(source_file, file_type, n, n_hidden): symbols of files with this ending; leaves of degree up to 5 count as hidden."""
    own = nodes.filter(F.col("source_file").endswith(suffix)).join(degrees, "id", "left")
    return own.groupBy("source_file", "file_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce("degree", F.lit(0)) <= 5).alias("n_hidden"))


def top_n(df: DataFrame, by: Sequence[Column], n: int, per: Sequence[str] = ()) -> DataFrame:
    """The first n rows, overall or per group, in a total order."""
    if not per:
        return df.orderBy(*by).limit(n)
    return df.withColumn("__k", F.row_number().over(Window.partitionBy(*per).orderBy(*by))).filter(F.col("__k") <= n).drop("__k")
