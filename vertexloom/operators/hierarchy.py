"""Parent-child rows to full hierarchies, with cycles and missing parents told apart.

Ids become order-preserving integer codes once. Each partition joins its own links to a weighted
disjoint-set forest: every node points to its local top with the number of links between. Only the
tops whose parent lies in another partition remain open; their links form a smaller forest, whose
rounds merge pairs of forests (a pointer plus its target's pointer and offset), so that a chain of any
depth needs a logarithmic number of rounds. Ids are in no order, so nearly all links cross any cut of
the partitions: a tree of merges would bring nearly all of them to its last task, rounds never do. Open nodes that have walked further than there are open nodes
are on or below a cycle. Paths, if wanted, are materialised last, by the same parent index.

Defined results: ids compare after trimming and lower-casing; NULL, empty and all-zero parents mean
root; the row of highest sequence number counts per id; rows without an id are ignored; a node that
is its own parent is a cycle of one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vertexloom.operators.durable import Rounds, durable, partitions

ROOT, MISSING, OPEN, CYCLE = 0, 1, 2, 3


def canonical_id(c: str | Column) -> Column:
    """Trimmed of white space, in lower case; empty and all-zero ids become NULL."""
    x = F.lower(F.regexp_replace(F.col(c) if isinstance(c, str) else c, r"^\s+|\s+$", ""))
    return F.when(x.rlike("^0*$"), F.lit(None)).otherwise(x)


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Weighted disjoint-set forest of one partition's links, by pointer halving over arrays.

    In: code, parent, state. Out: code, top, dist, state: the walk from ``code`` leaves the partition
    for ``top`` (state OPEN) or ends at ``top`` (ROOT, MISSING) after ``dist`` links. Walks that run
    into a cycle of local links get state CYCLE.
    """
    rows = pa.Table.from_batches(list(batches), schema=_LINKS)
    if not rows.num_rows:
        return
    code, parent, state = (rows[c].to_numpy() for c in ("code", "parent", "state"))
    order = np.argsort(code, kind="stable")
    code, parent, state = code[order], parent[order], state[order]
    self = np.arange(len(code))
    here = np.minimum(np.searchsorted(code, parent), len(code) - 1)
    local = (state == OPEN) & (code[here] == parent)
    ptr, dist = np.where(local, here, self), local.astype(np.int64)
    for _ in range(len(code).bit_length() + 1):  # after so many halvings only cycles still move
        nxt = ptr[ptr]
        if (nxt == ptr).all():
            break
        dist += np.where(nxt != ptr, dist[ptr], 0)
        ptr = nxt
    looped = local[ptr]
    end_open = ~looped & (state[ptr] == OPEN)
    top = np.where(end_open, parent[ptr], code[ptr])
    ends = np.where(looped, CYCLE, state[ptr]).astype(np.int32)
    yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(top), pa.array(dist + end_open), pa.array(ends)], names=["code", "top", "dist", "state"])


_LINKS = pa.schema([("code", pa.int64()), ("parent", pa.int64()), ("state", pa.int32())])
_STEPS = pa.schema([("code", pa.int64()), ("top", pa.int64()), ("dist", pa.int64()), ("state", pa.int32())])

def encode(df: DataFrame, node: str, parent: str, seq: str) -> tuple[DataFrame, DataFrame]:
    """(names: code, id) and (links: code, parent, state), one row per id; codes sort as ids do."""
    rows = df.select(canonical_id(node).alias("id"), canonical_id(parent).alias("up"), F.col(seq).alias("seq")).filter("id is not null")
    kept = rows.repartitionByRange(partitions(df.sparkSession), "id").groupBy("id").agg(F.max_by("up", F.struct("seq", "up")).alias("up"))
    names = durable(kept.sortWithinPartitions("id").withColumn("code", F.monotonically_increasing_id()))
    known = names.select(F.col("id").alias("up"), F.col("code").alias("parent"))
    state = F.when(F.col("up").isNull(), ROOT).when(F.col("parent").isNull(), MISSING).otherwise(OPEN)
    links = names.join(known, "up", "left").select("code", F.coalesce("parent", "code").alias("parent"), state.cast("int").alias("state"))
    return names.select("code", "id"), durable(links)


def _walk(links: DataFrame) -> DataFrame:
    """(code, top, dist, state) of every node, state ROOT or MISSING, or CYCLE where the walk never ends.

    Only the nodes where other partitions' walks enter take part in the merges. A round merges each
    forest with the one that its open pointers lead to, so round r has merged 2^r local walks; rounds
    also end when the targets of the open pointers are closed under one step, which proves that every
    open walk is endless.
    """
    spark = links.sparkSession
    local = durable(links.repartitionByRange(partitions(spark), "code").mapInArrow(_forest, "code bigint, top bigint, dist bigint, state int"))
    is_open = F.col("state") == OPEN
    left = local.filter(is_open)
    if left.isEmpty():
        return local
    is_open = F.col("state") == OPEN
    table = Rounds(spark)
    n_open, n_before = table.add(local.join(left.select(F.col("top").alias("code")).distinct(), "code", "left_semi"), open=F.count_if(is_open))["open"], -1
    while n_open:
        if n_open == n_before:
            targets = table.last().filter(is_open).select(F.col("top").alias("code")).distinct()
            onward = table.all().filter("round = 0").join(targets, "code", "left_semi").select(F.col("top").alias("code"))
            if onward.join(targets, "code", "left_anti").isEmpty():
                break
        # A code's last row counts: ended ones stay in the round in which they ended.
        known = table.all().filter(~is_open | (F.col("round") == table.n - 1))
        target = known.select(F.col("code").alias("via"), "top", F.col("dist").alias("more"), "state")
        moved = table.last().filter(is_open).select("code", F.col("top").alias("via"), "dist").join(target, "via")
        n_before, n_open = n_open, table.add(moved.select("code", "top", (F.col("dist") + F.col("more")).alias("dist"), "state"), open=F.count_if(is_open))["open"]
    known = table.all().filter(~is_open | (F.col("round") == table.n - 1))
    return _compose(local, left, known.select("code", "top", "dist", F.when(is_open, CYCLE).otherwise(F.col("state")).alias("state")))


def _compose(local: DataFrame, left: DataFrame, known: DataFrame) -> DataFrame:
    """The local walks, those that left their partition continued by the merged ones."""
    target = known.select(F.col("code").alias("via"), "top", F.col("dist").alias("more"), "state")
    rest = left.select("code", F.col("top").alias("via"), "dist").join(target, "via")
    return durable(local.filter(F.col("state") != OPEN).unionByName(rest.select("code", "top", (F.col("dist") + F.col("more")).alias("dist"), "state")))


def _cycles(links: DataFrame) -> DataFrame:
    """(code, low) of the nodes on cycles; ``links`` holds only nodes whose walk never ends.

    Pointers double, with the least code of the nodes they pass. Once they span as many steps as there
    are nodes, every one ends on a cycle, all cycle nodes are ends, and each has passed its whole cycle.
    """
    table = Rounds(links.sparkSession)
    n = table.add(links.select("code", F.col("parent").alias("top"), F.least("code", "parent").alias("low")), nodes=F.count(F.lit(1)))["nodes"]
    for _ in range(n.bit_length()):
        hop = table.last()
        far = hop.select(F.col("code").alias("via"), F.col("top").alias("next"), F.col("low").alias("far"))
        table.add(hop.withColumnRenamed("top", "via").join(far, "via").select("code", F.col("next").alias("top"), F.least("low", "far").alias("low")))
    hop = table.last()
    return hop.join(hop.select(F.col("top").alias("code")).distinct(), "code", "left_semi").select("code", "low")


def resolve(links: DataFrame) -> DataFrame:
    """(code, top, depth, kind): kind is root, missing_parent, cycle or below_cycle.

    ``top`` is the node where the walk ends, or the least node of the cycle it enters; ``depth`` the
    number of links to the end, or to the first node on the cycle (0 on it).
    """
    walks = _walk(links)
    ended = walks.filter(F.col("state") != CYCLE).select(
        "code", "top", F.col("dist").alias("depth"), F.when(F.col("state") == ROOT, "root").otherwise("missing_parent").alias("kind")
    )
    endless = walks.filter(F.col("state") == CYCLE).select("code")
    if endless.isEmpty():
        return ended
    looped = durable(links.join(endless, "code", "left_semi"))
    ring = durable(_cycles(looped))
    cut = looped.join(ring.select("code", F.lit(True).alias("on")), "code", "left")
    cut = cut.select("code", F.when(F.col("on"), F.col("code")).otherwise(F.col("parent")).alias("parent"), F.when(F.col("on"), ROOT).otherwise(OPEN).cast("int").alias("state"))
    to_ring = _walk(durable(cut)).select("code", F.col("top").alias("at"), F.col("dist").alias("depth"))
    below = to_ring.join(ring.select(F.col("code").alias("at"), "low"), "at").select(
        "code", F.col("low").alias("top"), "depth", F.when(F.col("depth") == 0, "cycle").otherwise("below_cycle").alias("kind")
    )
    return ended.unionByName(below)


def hierarchy(df: DataFrame, node: str, parent: str, seq: str, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """(id, top, depth, kind) with ids; ``kinds`` keeps only these before ids are looked up."""
    names, links = encode(df, node, parent, seq)
    found = resolve(links)
    if kinds:
        found = found.filter(F.col("kind").isin(*kinds))
    tops = names.select(F.col("code").alias("top"), F.col("id").alias("top_id"))
    return found.join(names, "code").join(tops, "top").select("id", F.col("top_id").alias("top"), F.col("depth").cast("int").alias("depth"), "kind")


def paths(df: DataFrame, node: str, parent: str, seq: str) -> DataFrame:
    """(id, top, depth, kind, path, n_descendants) of every node: ``path`` lists the ids from the top down to
    the node, ``n_descendants`` counts the nodes below it.

    Paths double in length each round through the parent index; their total length is the size of
    the result itself. A path that would be endless begins at the first node on the cycle, so that
    ``depth`` is its length less one for every kind; what goes round a cycle counts as below nothing.
    """
    names, links = encode(df, node, parent, seq)
    found = durable(resolve(links))
    finite = links.join(found.select("code", "kind"), "code").join(names, "code")
    table, walking = Rounds(df.sparkSession), F.col("next").isNotNull()
    first = F.when((F.col("state") == OPEN) & (F.col("kind") != "cycle"), F.col("parent")).alias("next")
    n = table.add(finite.select("code", first, F.array("id").alias("path")), walking=F.count_if(walking))["walking"]
    while n:
        known = table.all().filter(~walking | (F.col("round") == table.n - 1))
        above = known.select(F.col("code").alias("via"), F.col("next").alias("onward"), F.col("path").alias("above"))
        moved = table.last().filter(walking).withColumnRenamed("next", "via").join(above, "via")
        n = table.add(moved.select("code", F.col("onward").alias("next"), F.concat("above", "path").alias("path")), walking=F.count_if(walking))["walking"]
    every = table.all().filter(~walking).select("code", "path")
    tops = names.select(F.col("code").alias("top"), F.col("id").alias("top_id"))
    every = every.join(found.join(tops, "top").select("code", "top_id", "depth", "kind"), "code").select(
        F.element_at("path", -1).alias("id"), F.col("top_id").alias("top"), F.col("depth").cast("int").alias("depth"), "kind", "path"
    )
    below = every.select(F.explode(F.slice("path", 1, F.size("path") - 1)).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n_descendants"))
    return every.join(below, "id", "left").withColumn("n_descendants", F.coalesce("n_descendants", F.lit(0)))


def descendants(paths_: DataFrame) -> DataFrame:
    """(id, descendant, steps) of every node and every node below it, from ``paths``."""
    up = F.explode(F.transform(F.slice("path", 1, F.size("path") - 1), lambda x, k: F.struct(x.alias("id"), (F.size("path") - 1 - k).alias("steps"))))
    return paths_.select(F.element_at("path", -1).alias("descendant"), up.alias("a")).select("a.id", "descendant", "a.steps")
