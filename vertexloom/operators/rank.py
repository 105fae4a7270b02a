"""Keyword, term-vector, dense-vector and run-time ranking."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vertexloom.functions.paths import clipped, terms
from vertexloom.operators.durable import durable, shuffled
from vertexloom.operators.measure import degrees, framework_noise, import_only
from vertexloom.operators.traverse import depth_first, oriented, reach
from vertexloom.sources.graphs import Graph

# Words without weight, and signals of an academic paper.
STOP_WORDS = "the a an and or in on at to for of is it as by with from this that was are be has had not but what all when where how which".split()
PAPER_SIGNALS = (
    "arxiv", "doi:", "doi.org", "abstract", "introduction", "\\cite{", "\\begin{", "proceedings", "conference", "journal", "ieee", "acm ", "springer", "preprint", "submitted to", "accepted to", "under review", "keywords:", "acknowledgements", "acknowledgments",
    "references\n", "bibliography", "et al.", "fig.", "table ", "equation", "theorem", "lemma", "proof", "corollary", "proposition", "algorithm", "neural network", "machine learning", "deep learning", "language model",
)


def keywords(query: str) -> list[str]:
    """Words of a query, trimmed of other signs, longer than two bytes."""
    words = [re.sub(r"^\W+|\W+$", "", w).lower() for w in query.split()]
    return list(dict.fromkeys(w for w in words if len(w.encode()) > 2))


def rank_multiplier(graph: Graph) -> DataFrame:
    """(id, factor) of the nodes that count less: framework noise a fifth, other import-only nodes half."""
    noise = framework_noise(graph).withColumn("noise", F.lit(True))
    return import_only(graph).join(shuffled(noise), "id", "left").select("id", F.when(F.col("noise"), 0.2).otherwise(0.5).alias("factor"))


def lexical_rank(graph: Graph, query: str, fallback: int = 5) -> DataFrame:
    """(id, score, degree): distinct keywords held by label, id or path, less for import-only nodes.

    Without any match the ``fallback`` nodes of highest degree come instead, framework noise only if
    there is nothing else.
    """
    hits = F.lit(0)
    for k in keywords(query):
        hits += F.greatest(*(F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(k)).cast("int") for c in ("label", "id", "source_file")))
    factor = rank_multiplier(graph)
    n = graph.nodes.select("id", hits.alias("hits")).filter("hits > 0")
    weigh = lambda df, c: df.join(shuffled(factor), "id", "left").select("id", (F.col(c) * F.coalesce("factor", F.lit(1.0))).alias("score"), "degree")
    if not n.isEmpty() or not fallback:
        return weigh(shuffled(n).join(degrees(graph), "id"), "hits")
    quiet = degrees(graph).join(framework_noise(graph), "id", "left_anti")
    if quiet.isEmpty():
        out = degrees(graph).select("id", F.col("degree").cast("double").alias("score"), "degree")
    else:
        out = weigh(quiet, "degree")
    return out.orderBy(F.col("score").desc(), F.col("degree").desc(), "id").limit(fallback)


def structural_rank(graph: Graph, seeds: DataFrame, max_depth: int = 3) -> DataFrame:
    """(id, score): sum over seeds of 1 / (1 + d / 2) within ``max_depth`` directed steps.

    Every seed walks at once: the frontier is keyed by (seed, node), bounded by seeds x depth.
    """
    pairs = shuffled(oriented(graph.edges))
    front = seeds.select(F.col("id").alias("seed"), "id", F.lit(0).alias("d"))
    seen = front
    for d in range(1, max_depth + 1):
        step = front.select("seed", F.col("id").alias("s")).join(pairs, "s").select("seed", F.col("t").alias("id")).distinct()
        front = step.join(shuffled(seen), ["seed", "id"], "left_anti").withColumn("d", F.lit(d))
        seen = seen.unionByName(front)
    raw = seen.groupBy("id").agg(F.sum(1 / (1 + 0.5 * F.col("d"))).alias("s")).join(shuffled(rank_multiplier(graph)), "id", "left")
    return raw.select("id", F.round(F.col("s") * F.coalesce("factor", F.lit(1.0)), 9).alias("score"))


def hybrid_rank(graph: Graph, query: str) -> DataFrame:
    """(id, score): 0.6 lexical + 0.4 structural."""
    lex = durable(lexical_rank(graph, query).select("id", F.col("score").alias("l")))
    st = structural_rank(graph, lex).select("id", F.col("score").alias("s"))
    return lex.join(shuffled(st), "id", "full").select("id", F.round(0.6 * F.coalesce("l", F.lit(0.0)) + 0.4 * F.coalesce("s", F.lit(0.0)), 9).alias("score"))


def ranked(graph: Graph, query: str, mode: str = "lexical") -> DataFrame:
    """(id, score) by the mode ``structural``, ``hybrid`` or, for any other word, lexical."""
    m = mode.strip().lower()
    if m == "hybrid":
        return hybrid_rank(graph, query)
    lex = lexical_rank(graph, query).select("id", "score")
    return structural_rank(graph, lex) if m == "structural" else lex


def term_vectors(df: DataFrame, key: str, *texts: str) -> DataFrame:
    """(key, term, tf): shares of the terms, without stop words."""
    words = F.filter(terms(F.concat_ws(" ", *texts)), lambda t: ~t.isin(*STOP_WORDS))
    n = df.select(key, F.explode(words).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).cast("double").alias("n"))
    total = n.groupBy(key).agg(F.sum("n").alias("total"))
    return n.join(total, key).select(key, "term", (F.col("n") / F.col("total")).alias("tf"))


def text_search(vectors: DataFrame, key: str, query: str, k: int = 10) -> DataFrame:
    """(key, score) of the k vectors of largest cosine; the query's terms, a few, are the broadcast side."""
    spark = vectors.sparkSession
    words = [w for w in re.findall(r"[^\W_]+", query.lower()) if len(w.encode()) >= 2 and w not in STOP_WORDS]
    q = spark.createDataFrame([(w, words.count(w) / sum(words.count(x) ** 2 for x in set(words)) ** 0.5) for w in set(words)], "term string, q double")
    norm = F.sqrt(F.sum(F.col("tf") * F.col("tf")))
    hit = vectors.join(F.broadcast(q), "term", "left").groupBy(key).agg(F.round(F.sum(F.col("tf") * F.coalesce("q", F.lit(0.0))) / norm, 9).alias("score"))
    return hit.filter("score > 0").orderBy(F.col("score").desc(), key).limit(k)


def dense_search(df: DataFrame, key: str, vector: str, query: list[float], k: int = 10) -> DataFrame:
    """(key, score) of the k nearest by cosine."""
    q = F.array(*(F.lit(float(x)) for x in query))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    v = F.col(vector)
    score = dot(v, q) / (F.sqrt(dot(v, v)) * F.sqrt(dot(q, q)))
    return df.select(key, F.round(score, 6).alias("score")).orderBy(F.col("score").desc(), key).limit(k)


def paper_like(df: DataFrame, key: str, text: str, signals: tuple[str, ...] = PAPER_SIGNALS, least: int = 3, head: int = 3000) -> DataFrame:
    """(key, n_signals) of texts that show at least ``least`` signals in their first ``head`` bytes, where papers have them."""
    low = F.lower(clipped(text, head))
    n = F.size(F.filter(F.array(*map(F.lit, signals)), lambda s: F.contains(low, s)))
    return df.select(key, n.alias("n_signals")).filter(F.col("n_signals") >= least)


def runtime_rank(graph: Graph, query: str, calls: DataFrame) -> DataFrame:
    """(id, score): lexical score + 0.3 ln(1 + calls) of (name, call_count)."""
    lex = lexical_rank(graph, query)
    c = calls.select(F.lower("name").alias("k"), "call_count")
    return lex.join(c, F.lower("id") == F.col("k"), "left").select("id", F.round(F.col("score") + 0.3 * F.log1p(F.coalesce("call_count", F.lit(0)).cast("double")), 9).alias("score"))


def query_graph(graph: Graph, query: str, depth: int = 3, budget_tokens: int = 2000, seeds: int = 5, tests: bool = False, least: int = 0, dfs: bool = False) -> DataFrame:
    """(id, depth): what a keyword query shows, found from the best seeds under a node budget; without
    ``tests`` no test is a seed, nor any node below the degree ``least``. ``dfs`` walks depth first (depth NULL)."""
    best = lexical_rank(graph, query)
    if not tests:
        p, name = F.lower("source_file"), F.lower("label")
        test = p.contains("/test/") | p.contains("/tests/") | p.contains("_test.") | name.startswith("test")
        best = best.join(graph.nodes.filter(test).select("id"), "id", "left_anti")
    best = best.filter(F.col("degree") >= least).orderBy(F.col("score").desc(), F.col("degree").desc(), "id").limit(seeds).select("id")
    depth, most = min(max(depth, 1), 6), min(max(max(budget_tokens, 200) // 40, 5), 200)
    if not dfs:
        return reach(oriented(graph.edges, "both"), best, depth, most)
    order: list[str] = []
    for r in best.collect():  # a handful of seeds
        order += [x for x in depth_first(graph.edges, r["id"], depth, most) if x not in order]
    return graph.nodes.sparkSession.createDataFrame([(x, None) for x in order[:most]], "id string, depth int")


def shown_lines(graph: Graph, found: DataFrame, budget_chars: int = 8000) -> DataFrame:
    """(pos, line) of the nodes of a query and the edges between them, as long as the text stays within the budget.

    ``found`` holds at most a node budget of rows, so its lines are numbered in one place.
    """
    d = graph.nodes.join(found, "id").join(degrees(graph), "id")
    nodes = d.select(F.lit(0).alias("part"), F.coalesce("depth", F.lit(0)).alias("depth"), (-F.col("degree")).alias("by"), F.format_string("- %s (%s) %s", F.coalesce("qualified_label", "label"), "file_type", "source_file").alias("line"))
    ends = found.select("id")
    e = graph.edges.join(ends.withColumnRenamed("id", "source"), "source", "left_semi").join(ends.withColumnRenamed("id", "target"), "target", "left_semi")
    lines = nodes.unionByName(e.select(F.lit(1).alias("part"), F.lit(0).alias("depth"), F.lit(0).cast("bigint").alias("by"), F.format_string("  %s --%s--> %s", "source", "relation", "target").alias("line")))
    w = Window.partitionBy(F.lit(0)).orderBy("part", "depth", "by", "line")
    out = lines.withColumns({"pos": F.row_number().over(w), "upto": F.sum(F.length("line") + 1).over(w.rowsBetween(Window.unboundedPreceding, 0))})
    return out.filter(F.col("upto") <= budget_chars).select("pos", "line")
