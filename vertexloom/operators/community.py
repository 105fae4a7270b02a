"""Communities, betweenness, dominators, random walks and node vectors."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vertexloom.operators.durable import Rounds, durable, numbered, partitions, shuffled
from vertexloom.operators.measure import renumber_by_size
from vertexloom.sources.graphs import Graph

#: Up to so many undirected links the adjacency is sent to every task (16 bytes a link, and the ids).
BROADCAST_LINKS = 1_000_000
#: Up to so many undirected links one task finds the communities (about 130 bytes a link there).
LOCAL_LINKS = 1 << 23


def undirected(edges: DataFrame, weight: str = "weight") -> DataFrame:
    """(u, v, w) with u <= v, weights of parallel edges summed."""
    return edges.select(F.least("source", "target").alias("u"), F.greatest("source", "target").alias("v"), F.col(weight).alias("w")).groupBy("u", "v").agg(F.sum("w").alias("w"))


def _draw(node, level: int, r: int):
    """0 or 1 for a node's number in a round: for Spark's columns and for arrays alike."""
    return (node % 1_000_003) * (7_919 + 104_729 * r + 15_485_863 * level) % 1_000_003 % 2


def _louvain_here(g: np.ndarray, u: np.ndarray, v: np.ndarray, w: np.ndarray, levels: int, gain: float, rounds: int) -> np.ndarray:
    """The community of each node 0 .. n - 1, all of them at an end of a link: ``_louvain_by_joins`` on arrays."""
    n = int(max(u.max(), v.max())) + 1
    of = np.zeros(n, dtype=np.int32)
    of[u] = of[v] = g
    member = np.arange(n, dtype=np.int32)
    for level in range(levels):
        apart = u != v
        a, b, ww = np.concatenate([u[apart], v[apart]]), np.concatenate([v[apart], u[apart]]), np.concatenate([w[apart], w[apart]])
        k = np.bincount(a, ww, n) + np.bincount(u[~apart], 2 * w[~apart], n)
        alive = np.unique(member)
        m2 = np.bincount(of[alive], k[alive])[of]
        order = np.argsort(a, kind="stable")
        a, b, ww = a[order], b[order], ww[order]
        community, recent, any_move = np.arange(n, dtype=np.int32), [1.0, 1.0], 0
        for r in range(rounds):
            total = np.bincount(community[alive], k[alive], n)
            drawn = _draw(np.arange(n), level, r) == 0  # the others stay, whatever their neighbours
            turn, may = alive[drawn[alive]], np.flatnonzero(drawn[a])
            key = np.concatenate([a[may].astype(np.int64) * n + community[b[may]], turn.astype(np.int64) * n + community[turn]])
            order = np.argsort(key)
            key, weight = key[order], np.concatenate([ww[may], np.zeros(len(turn))])[order]
            del order, may
            if not len(key):
                recent = [recent[-1], 0.0]
                if sum(recent) <= gain:
                    break
                continue
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            key, weight = key[first], np.add.reduceat(weight, first)
            node, near = key // n, key % n
            mine = near == community[node]
            value = np.round(weight - (total[near] - np.where(mine, k[node], 0.0)) * k[node] / m2[node], 12)
            start = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
            best, who = np.maximum.reduceat(value, start), node[start]
            hit = np.flatnonzero(value == np.repeat(best, np.diff(np.append(start, len(node)))))
            to = near[hit[np.concatenate([[True], np.diff(node[hit]) != 0])]]
            more = best - value[mine]
            better = more > 0
            community[who[better]] = to[better]
            any_move += int(better.sum())
            recent = [recent[-1], float((2 * more[better] / m2[who[better]]).sum())]
            if sum(recent) <= gain:
                break
        if not any_move:
            break
        member = community[member]
        key = np.minimum(community[u], community[v]).astype(np.int64) * n + np.maximum(community[u], community[v])
        key, at = np.unique(key, return_inverse=True)
        u, v, w = (key // n).astype(np.int32), (key % n).astype(np.int32), np.bincount(at, w)
    return member


def _louvain_by_joins(links: DataFrame, levels: int, gain: float, rounds: int) -> DataFrame:
    """(id, community) of numbered links; no group of rows is gathered anywhere, whatever a community's size or a node's degree."""
    spark = links.sparkSession
    member = None
    for level in range(levels):
        both = durable(links.filter("u <> v").select("g", F.col("u").alias("id"), F.col("v").alias("other"), "w").unionByName(links.filter("u <> v").select("g", F.col("v").alias("id"), F.col("u").alias("other"), "w")))
        ends = both.select("g", "id", "w").unionByName(links.filter("u = v").select("g", F.col("u").alias("id"), (2 * F.col("w")).alias("w")))
        k = ends.groupBy("g", "id").agg(F.sum("w").alias("k"))
        m2 = k.groupBy("g").agg(F.sum("k").alias("m2"))  # one row a graph
        state = durable(k.join(m2, "g").select("id", "k", "m2", F.col("id").alias("community")))
        recent, any_move = [1.0, 1.0], 0
        for r in range(rounds):
            total = state.groupBy("community").agg(F.sum("k").alias("total"))
            near = both.join(shuffled(state.select(F.col("id").alias("other"), "community")), "other").select("id", "community", "w")
            votes = near.unionByName(state.select("id", "community", F.lit(0.0).alias("w"))).groupBy("id", "community").agg(F.sum("w").alias("w"))
            own = state.select("id", "k", "m2", F.col("community").alias("own"))
            worth = votes.join(shuffled(total), "community").join(shuffled(own), "id")
            mine = F.col("community") == F.col("own")
            worth = worth.withColumn("value", F.round(F.col("w") - (F.col("total") - F.when(mine, F.col("k")).otherwise(0.0)) * F.col("k") / F.col("m2"), 12))
            best = worth.groupBy("id").agg(F.min(F.struct((-F.col("value")).alias("value"), "community")).alias("b"), F.max(F.when(mine, F.col("value"))).alias("base"), F.first("k").alias("k"), F.first("m2").alias("m2"), F.first("own").alias("own"))
            better = (-F.col("b.value") > F.col("base")) & (_draw(F.col("id"), level, r) == 0)
            moved = best.select("id", "k", "m2", F.when(better, F.col("b.community")).otherwise(F.col("own")).alias("community"), better.alias("moved"), F.when(better, 2 * (-F.col("b.value") - F.col("base")) / F.col("m2")).otherwise(0.0).alias("gained"))
            table = Rounds(spark)
            n = table.add(moved, moved=F.count_if("moved"), gained=F.sum("gained"))
            state = table.last().select("id", "k", "m2", "community")
            any_move += n["moved"]
            recent = [recent[-1], n["gained"] or 0.0]
            if sum(recent) <= gain:
                break
        if not any_move:
            break
        to = state.select("id", "community")
        member = durable(to if member is None else member.withColumnRenamed("community", "at").join(shuffled(to.withColumnRenamed("id", "at")), "at").select("id", "community"))
        ab = links.join(shuffled(to.select(F.col("id").alias("u"), F.col("community").alias("a"))), "u").join(shuffled(to.select(F.col("id").alias("v"), F.col("community").alias("b"))), "v")
        links = durable(ab.groupBy("g", F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).agg(F.sum("w").alias("w")))
    if member is None:
        return links.select(F.explode(F.array("u", "v")).alias("id")).distinct().withColumn("community", F.col("id"))
    return member


def _louvain(links: DataFrame, levels: int = 10, gain: float = 1e-4, rounds: int = 60, local_links: int = LOCAL_LINKS) -> DataFrame:
    """(id, community) by local moves and aggregation; ``links`` (g, u, v, w) hold one graph a ``g``.

    In a round about half of the nodes, drawn by their numbers, move to the neighbouring community of largest
    modularity gain (the least id wins ties), all at once by the communities before the round. A level
    ends when two rounds together gain less than ``gain``, or nothing can move; then communities become
    nodes. Ids are numbered in their order. The links are counted first: up to ``local_links`` a task does
    all rounds on arrays, beyond it every round is a join, with the same moves.
    """
    spark = links.sparkSession
    ids = links.select(F.explode(F.array("u", "v")).alias("id")).distinct()
    code = durable(numbered(ids.repartitionByRange(partitions(spark), "id").sortWithinPartitions("id"), "code"))
    table = Rounds(spark)
    coded = links.join(shuffled(code.select(F.col("id").alias("u"), F.col("code").alias("a"))), "u").join(shuffled(code.select(F.col("id").alias("v"), F.col("code").alias("b"))), "v")
    n = table.add(coded.select("g", F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"), "w"), n=F.count(F.lit(1)))["n"]
    links = table.last()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, u, v, w = [], [], [], []
        graphs: dict[str, int] = {}
        for x in batches:
            coded = x["g"].dictionary_encode()
            g.append(np.array([graphs.setdefault(s, len(graphs)) for s in coded.dictionary.to_pylist()], dtype=np.int32)[coded.indices.to_numpy()])
            u.append(x["u"].to_numpy().astype(np.int32))
            v.append(x["v"].to_numpy().astype(np.int32))
            w.append(x["w"].to_numpy())
        if sum(map(len, u)):
            found = _louvain_here(*map(np.concatenate, (g, u, v, w)), levels, gain, rounds)
            yield pa.RecordBatch.from_pydict({"id": np.arange(len(found), dtype=np.int64), "community": found.astype(np.int64)})

    found = _louvain_by_joins(links, levels, gain, rounds) if n > local_links else durable(links.filter("u is not null").coalesce(1).mapInArrow(run, "id long, community long"))
    return code.join(shuffled(found.withColumnRenamed("id", "code")), "code").select("id", F.concat(F.lit("of "), F.col("community").cast("string")).alias("community"))


def communities(nodes: DataFrame, edges: DataFrame, local_links: int = LOCAL_LINKS) -> DataFrame:
    """(id, community) for every node, numbered by falling size; isolated nodes stay alone."""
    links = durable(undirected(edges.filter("source is not null and target is not null")).withColumn("g", F.lit("")))
    found = durable(_louvain(links, local_links=local_links))
    lone = nodes.select("id").distinct().join(shuffled(found.select("id")), "id", "left_anti").withColumn("community", F.concat(F.lit("alone "), "id"))
    return renumber_by_size(durable(found.unionByName(lone)))


def split_large(members: DataFrame, edges: DataFrame, share: float = 0.25, least: int = 10) -> DataFrame:
    """Communities above max(share x nodes, least) are clustered once more, each on its own links alone."""
    n = members.count()
    big = durable(members.groupBy("community").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > max(int(share * n), least)).select("community"))
    if big.isEmpty():
        return renumber_by_size(members)
    inside = members.join(big, "community", "left_semi").select("id", F.col("community").cast("string").alias("g"))
    own = undirected(edges).join(shuffled(inside.select(F.col("id").alias("u"), "g")), "u").join(shuffled(inside.select(F.col("id").alias("v"), F.col("g").alias("g2"))), "v").filter("g = g2")
    parts = _louvain(durable(own.select("g", "u", "v", "w"))).select("id", F.concat(F.lit("part "), "community").alias("part"))
    out = members.join(shuffled(parts), "id", "left").select("id", F.coalesce("part", F.col("community").cast("string")).alias("community"))
    return renumber_by_size(durable(out))


def cluster(graph: Graph, share: float = 0.25, least: int = 10) -> Graph:
    """The graph with communities on its nodes: found, the oversized ones split, numbered by falling size."""
    members = split_large(communities(graph.nodes, graph.edges), graph.edges, share, least)
    cols = graph.nodes.columns
    return graph.with_(nodes=durable(graph.nodes.drop("community").join(shuffled(members), "id", "left").select(*cols)))


def _brandes(start: np.ndarray, near: np.ndarray, sources: Iterator[int]) -> np.ndarray:
    """Sum over ``sources`` of each node's dependency; ``near`` holds the neighbours of k from start[k] to start[k + 1].

    A leaf, a node whose one neighbour has others, is no step of any path: it counts with that neighbour,
    as a source too, and searches run over the other nodes alone. Each level is taken from its own side or
    from the nodes not yet seen, whichever has fewer links.
    """
    n = len(start) - 1
    degree = np.diff(start)
    leaf = degree == 1
    leaf[leaf] = degree[near[start[:-1][leaf]]] > 1
    holder = np.arange(n)
    holder[leaf] = near[start[:-1][leaf]]
    weight = np.bincount(holder, minlength=n).astype(np.float64)  # a node and its leaves
    kept = ~leaf[np.repeat(np.arange(n), degree)] & ~leaf[near]
    degree = np.bincount(np.repeat(np.arange(n), degree)[kept], minlength=n)
    start, near = np.concatenate([[0], np.cumsum(degree)]), near[kept]
    score, shift = np.zeros(n), start[:-1]

    def links(of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k = degree[of]
        end = np.cumsum(k)
        return np.repeat(of, k), near[np.repeat(shift[of] - end + k, k) + np.arange(end[-1] if len(end) else 0)]

    for s in sources:
        if leaf[s]:
            continue
        sigma, seen, levels = np.zeros(n), leaf.copy(), []
        sigma[s], seen[s], front, rest = 1, True, np.array([s]), None
        ahead_links, rest_links = degree[s], len(near) - degree[s]
        while len(front):
            if ahead_links <= rest_links:
                a, b = links(front)
                new = ~seen[b]
            else:
                rest = np.flatnonzero(~seen) if rest is None else rest[~seen[rest]]
                b, a = links(rest)
                ahead = np.zeros(n, dtype=bool)
                ahead[front] = True
                new = ahead[a]
            a, b = a[new], b[new]
            got = np.bincount(b, sigma[a], n)
            was, front = front, np.flatnonzero(got)
            seen[front] = True
            sigma[front] = got[front]
            ahead_links = degree[front].sum()
            rest_links -= ahead_links
            if len(front):
                levels.append((a, b, was, front))
        delta, share = np.zeros(n), np.zeros(n)
        for a, b, was, front in reversed(levels):
            share[front] = (weight[front] + delta[front]) / sigma[front]
            delta[was] = sigma[was] * np.bincount(a, share[b], n)[was]
        total = weight[s]
        for *_, front in levels:
            score[front] += weight[s] * (delta[front] + weight[front] - 1)
            total += weight[front].sum()
        score[s] += (weight[s] - 1) * (total - 2)  # its leaves reach all others through it
    return score


def _brandes_by_joins(pairs: DataFrame, nodes: DataFrame, n: int, states: int) -> DataFrame:
    """(id, score) by a join a level, for blocks of sources of about ``states`` (source, node) rows."""
    both = durable(pairs.select(F.col("u").alias("id"), F.col("v").alias("other")).unionByName(pairs.select(F.col("v").alias("id"), F.col("u").alias("other"))))
    blocks, out = max(1, -(-n * n // states)), None
    for k in range(blocks):
        mine = nodes.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == k)
        levels = [durable(mine.select(F.col("id").alias("s"), "id", F.lit(1.0).alias("sigma")))]
        while True:
            ahead = levels[-1].join(both, "id").groupBy("s", F.col("other").alias("id")).agg(F.sum("sigma").alias("sigma"))
            for known in levels[-2:]:  # a neighbour is at most one level away
                ahead = ahead.join(known.select("s", "id"), ["s", "id"], "left_anti")
            if (ahead := durable(ahead)).isEmpty():
                break
            levels.append(ahead)
        below = levels[-1].withColumn("delta", F.lit(0.0))
        for level in levels[-2::-1]:
            part = below.filter("delta > 0").groupBy("id").agg(F.sum("delta").alias("score"))
            out = part if out is None else out.unionByName(part)
            share = below.join(both, "id").groupBy("s", F.col("other").alias("id")).agg(F.sum((1 + F.col("delta")) / F.col("sigma")).alias("share"))
            below = durable(level.join(share, ["s", "id"], "left").select("s", "id", "sigma", (F.col("sigma") * F.coalesce("share", F.lit(0.0))).alias("delta")))
    return nodes.select("id", F.lit(0.0).alias("score")).limit(0) if out is None else out


def betweenness(edges: DataFrame, local_links: int = BROADCAST_LINKS, states: int = 1 << 28) -> DataFrame:
    """(id, score) of every node: shortest-path betweenness, undirected, over ordered pairs by (n - 1)(n - 2) / 2.

    The links are counted first. Up to ``local_links`` the sources are spread over tasks that each hold the
    adjacency; beyond it every level of the searches is a join, with the same scores.
    """
    spark = edges.sparkSession
    links = durable(edges.filter("source is not null and target is not null").select(F.least("source", "target").alias("u"), F.greatest("source", "target").alias("v")).distinct())
    nodes = durable(links.select(F.explode(F.array("u", "v")).alias("id")).distinct())
    pairs, n = links.filter("u <> v"), nodes.count()
    if pairs.count() > local_links:
        parts = _brandes_by_joins(pairs, nodes, n, states)
    else:
        table = pairs.toArrow()
        coded = pa.concat_arrays([x for c in ("u", "v") for x in table[c].chunks] or [pa.array([], pa.string())]).dictionary_encode()
        code, m = coded.indices.to_numpy().astype(np.int64), len(coded.dictionary)
        u, v = np.split(code, 2)
        here, there = np.concatenate([u, v]), np.concatenate([v, u])
        near = there[np.argsort(here, kind="stable")]
        sent = spark.sparkContext.broadcast((coded.dictionary.to_pylist(), np.concatenate([[0], np.cumsum(np.bincount(here, minlength=m))]), near))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids, start, near = sent.value
            score = _brandes(start, near, (s for df in batches for s in df.s))
            if score.any():
                yield pd.DataFrame({"id": [ids[k] for k in np.flatnonzero(score)], "score": score[score != 0]})

        parts = spark.range(0, m, 1, max(1, min(64, m // 64))).withColumnRenamed("id", "s").mapInPandas(run, "id string, score double")
    scale = max((n - 1) * (n - 2) / 2, 1)
    return nodes.join(parts.groupBy("id").agg(F.sum("score").alias("score")), "id", "left").select("id", (F.coalesce("score", F.lit(0.0)) / scale).alias("score"))


def dominators(edges: DataFrame, root: str, hop_limit: int = 2_000_000) -> DataFrame:
    """(id, idom) of nodes reached from ``root``: iterative intersection in reverse post-order, in one task.

    Only the reached part takes part; more than ``hop_limit`` links there is an error, not a partial result.
    """
    from vertexloom.operators.traverse import oriented, reach

    spark = edges.sparkSession
    near = reach(oriented(edges), spark.createDataFrame([(root,)], "id string")).select("id")
    part = durable(oriented(edges).join(near.withColumnRenamed("id", "s"), "s", "left_semi"))
    if part.count() > hop_limit:
        raise ValueError(f"more than {hop_limit} links are reached from {root}")

    def run(df: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list[str]] = defaultdict(list)
        pred: dict[str, list[str]] = defaultdict(list)
        for s, t in sorted(zip(df.s, df.t)):
            out[s].append(t)
            pred[t].append(s)
        post, seen, stack = [], {root}, [(root, iter(out[root]))]
        while stack:
            at, it = stack[-1]
            nxt = next((t for t in it if t not in seen), None)
            if nxt is None:
                post.append(at)
                stack.pop()
            else:
                seen.add(nxt)
                stack.append((nxt, iter(out[nxt])))
        number = {x: k for k, x in enumerate(post)}
        idom = {root: root}
        changed = True
        while changed:
            changed = False
            for b in reversed(post[:-1]):
                new = None
                for p in pred[b]:
                    if p in idom:
                        if new is None:
                            new = p
                            continue
                        x, y = p, new
                        while x != y:
                            while number[x] < number[y]:
                                x = idom[x]
                            while number[y] < number[x]:
                                y = idom[y]
                        new = x
                if new is not None and idom.get(b) != new:
                    idom[b], changed = new, True
        return pd.DataFrame([(k, v) for k, v in idom.items() if k != root], columns=["id", "idom"])

    return part.withColumn("g", F.lit(0)).groupBy("g").applyInPandas(run, "id string, idom string")


def random_walks(edges: DataFrame, walks: int = 4, length: int = 8, seed: int = 42) -> DataFrame:
    """(walk, start, step, id): uniform directed walks, the same for the same seed and edges.

    Targets are numbered inside their source without being gathered there, so a source with most links
    stays spread over all tasks; a step looks up one number.
    """
    from vertexloom.operators.hotkeys import number_rows

    pairs = edges.select("source", "target").distinct()
    near = durable(number_rows(pairs.repartitionByRange(partitions(edges.sparkSession), "source", "target").sortWithinPartitions("source", "target"), ["source"], "k").select("source", "target", "k"))
    n = durable(near.groupBy("source").agg(F.count(F.lit(1)).alias("n")))
    table = Rounds(edges.sparkSession)
    table.add(n.select(F.col("source").alias("start"), F.explode(F.sequence(F.lit(0), F.lit(walks - 1))).alias("walk")).select("walk", "start", F.lit(0).alias("step"), F.col("start").alias("id")))
    for k in range(1, length):
        at = table.last().join(n.withColumnRenamed("source", "id"), "id")
        pick = F.pmod(F.xxhash64(F.lit(seed), "walk", "start", F.lit(k)), F.col("n"))
        at = at.select("walk", "start", F.col("id").alias("source"), pick.alias("k"))
        table.add(at.join(near, ["source", "k"]).select("walk", "start", F.lit(k).alias("step"), F.col("target").alias("id")))
    return table.all().select("walk", "start", "step", "id")


def node_vectors(edges: DataFrame, dim: int = 16, walks: int = 4, length: int = 8, rounds: int = 5, window: int = 3, seed: int = 42) -> DataFrame:
    """(id, vector): unit vectors pulled towards those of nodes within ``window`` steps of common walks."""
    w = durable(random_walks(edges, walks, length, seed))
    a, b = w.select("walk", "start", F.col("step").alias("k1"), "id"), w.select("walk", "start", F.col("step").alias("k2"), F.col("id").alias("other"))
    near = durable(a.join(b, ["walk", "start"]).filter((F.abs(F.col("k1") - F.col("k2")) <= window) & (F.col("id") != F.col("other"))).groupBy("id", "other").agg(F.count(F.lit(1)).cast("double").alias("n")))
    unit = lambda i, who: (F.pmod(F.xxhash64(F.lit(seed), who, F.lit(i)), F.lit(2000001)) - 1000000) / 1e6
    ids = near.select("id").distinct()
    norm = lambda c: F.transform(c, lambda x: x / F.greatest(F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, y: s + y * y)), F.lit(1e-12)))
    vec = ids.select("id", F.array(*(unit(i, F.col("id")) for i in range(dim))).alias("v")).select("id", norm(F.col("v")).alias("vector"))
    for _ in range(rounds):
        long = near.join(vec.select(F.col("id").alias("other"), F.posexplode("vector").alias("i", "x")), "other").groupBy("id", "i").agg(F.sum(F.col("n") * F.col("x")).alias("x"))
        pull = long.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("p"))
        mixed = vec.join(pull, "id").select("id", F.zip_with("vector", norm(F.col("p")), lambda x, y: 0.5 * x + 0.5 * y).alias("v"))
        vec = durable(mixed.select("id", norm(F.col("v")).alias("vector")))
    return vec
