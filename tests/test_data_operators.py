"""Operators for skewed keys, snapshots, percentiles and hierarchies against brute force."""

import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from vertexloom.operators.hierarchy import descendants, hierarchy, paths
from vertexloom.operators.hotkeys import chunked_counts, number_rows, ordered_profile
from vertexloom.operators.percentiles import exact_percentiles, value_counts
from vertexloom.operators.snapshots import snapshot_changes


def test_chunked_counts_with_a_hot_key_and_nulls(spark):
    rows = [("hot" if i % 3 else f"k{i % 50}" if i % 7 else None,) for i in range(3000)]
    got = {r["k"]: r["n"] for r in chunked_counts(spark.createDataFrame(rows, "k string").repartition(5), ["k"], 16).collect()}
    want = Counter(k for (k,) in rows if k is not None)
    assert got == want


def test_chunked_counts_of_nothing(spark):
    assert chunked_counts(spark.createDataFrame([], "k string"), ["k"]).count() == 0


def test_row_numbers_are_dense_in_each_key(spark):
    df = spark.createDataFrame([("a",)] * 700 + [("b",)] * 3 + [("c",)], "k string").repartition(6)
    got = defaultdict(list)
    for r in number_rows(df, ["k"], "nth").collect():
        got[r["k"]].append(r["nth"])
    assert {k: sorted(v) for k, v in got.items()} == {"a": list(range(700)), "b": [0, 1, 2], "c": [0]}


def test_ordered_profile_merges_chunk_boundaries(spark):
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.7 else f"k{rng.randrange(5)}", i, rng.choice(["x", "y", None])) for i in range(600)]
    df = spark.createDataFrame(rows, "k string, i int, s string").withColumn("at", F.timestamp_seconds(F.col("i") * F.col("i")))
    got = {r["k"]: (r["n"], r["n_changes"], r["max_gap_s"]) for r in ordered_profile(df, ["k"], ["at", "i"], "s", "at", 8).collect()}
    by = defaultdict(list)
    for k, i, s in rows:
        by[k].append((i, s))
    for k, v in by.items():
        v.sort()
        changes = sum(a[1] != b[1] for a, b in zip(v, v[1:]))
        gaps = [b[0] ** 2 - a[0] ** 2 for a, b in zip(v, v[1:])]
        assert got[k] == (len(v), changes, float(max(gaps)) if gaps else None)


def test_snapshot_changes_against_brute_force(spark):
    rng = random.Random(5)
    rows, seq = [], 0
    for snap in (1, 2, 3, 5):
        for i in range(300):
            for _ in range(1 + (rng.random() < 0.1)):
                if rng.random() < 0.93:
                    seq += 1
                    rows.append((snap, f"id{i}", seq, rng.choice([1, 1, 1, 1, None]), "same", "extra"))
    rows.append((2, None, seq + 1, 1, "x", "extra"))
    df = spark.createDataFrame(rows, "snap int, id string, seq bigint, c bigint, l string, key string").withColumnRenamed("key", "vs_next")
    got = {tuple(r) for r in snapshot_changes(df, "snap", "id", "seq", ["c", "l"], chunk=8).select("snapshot_no", "id", "change").collect()}
    last = {}
    for snap, i, q, c, l, _ in rows:
        if i is not None:
            last[snap, i] = max(last.get((snap, i), (0,)), (q, c, l), key=lambda x: x[0])
    want = set()
    for snap in (2, 3):
        for i in range(300):
            a, b = last.get((snap - 1, f"id{i}")), last.get((snap, f"id{i}"))
            if a and not b:
                want.add((snap, f"id{i}", "removed"))
            elif b and not a:
                want.add((snap, f"id{i}", "added"))
            elif a and b and a[1:] != b[1:]:
                want.add((snap, f"id{i}", "changed"))
    assert got == want
    assert snapshot_changes(df.limit(0), "snap", "id", "seq", ["c"]).count() == 0


def test_percentiles_are_exact_with_ties_skew_and_nulls(spark):
    rng = random.Random(7)
    rows = [("hot" if rng.random() < 0.6 else f"g{rng.randrange(4)}", rng.choice([5, 5, 5, rng.randrange(1000)])) for _ in range(2000)]
    df = spark.createDataFrame([*rows, (None, 3), ("hot", None)], "g string, v bigint").repartition(5)
    got = {r["g"]: r.asDict() for r in exact_percentiles(df, ["g"], "v", (500, 950)).collect()}
    by = defaultdict(list)
    for g, v in rows:
        by[g].append(v)
    assert set(got) == set(by)
    for g, v in by.items():
        v.sort()
        n = len(v)
        assert got[g]["n"] == n
        for p in (500, 950):
            assert got[g][f"p{p}_rank"] == v[-(-n * p // 1000) - 1]
            low, part = divmod((n - 1) * p, 1000)
            assert abs(got[g][f"p{p}_linear"] - (v[low] + (v[min(low + 1, n - 1)] - v[low]) * part / 1000)) < 1e-9
    assert exact_percentiles(df.limit(0), ["g"], "v").count() == 0


def test_merged_states_keep_the_stated_error(spark):
    rows = [("a", d, 1.0 + (i * 37 % 1000)) for d in range(4) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, d int, v double")
    days = value_counts(df, ["g", "d"], "v", relative_error=0.01)
    got = exact_percentiles(days, ["g"], "value", (950,), weight="n").first()
    true = sorted(r[2] for r in rows)[-(-2000 * 950 // 1000) - 1]
    assert got["n"] == 2000 and abs(got["p950_rank"] - true) <= 0.0101 * true


_SPANS = [
    ("A1", None, 1), ("a2 ", "a1", 2), ("a3", "A2", 3), ("b1", "gone", 4), ("b2", "b1", 5), ("c1", "c2", 6), ("c2", "c3", 7), ("c3", "c1", 8), ("d1", "c3", 9),
    ("d2", "d1", 10), ("e1", "e1", 11), ("f1", "0000", 12), ("f2", "", 13), ("a3", "a1", 14), (None, "a1", 15), ("f3", "f2", 16),
]


def _spans(spark):
    return spark.createDataFrame(_SPANS, "id string, up string, seq bigint")


def test_hierarchy_kinds(spark):
    want = {
        ("a1", "a1", 0, "root"), ("a2", "a1", 1, "root"), ("a3", "a1", 1, "root"), ("b1", "b1", 0, "missing_parent"), ("b2", "b1", 1, "missing_parent"), ("c1", "c1", 0, "cycle"), ("c2", "c1", 0, "cycle"),
        ("c3", "c1", 0, "cycle"), ("d1", "c1", 1, "below_cycle"), ("d2", "c1", 2, "below_cycle"), ("e1", "e1", 0, "cycle"), ("f1", "f1", 0, "root"), ("f2", "f2", 0, "root"), ("f3", "f2", 1, "root"),
    }
    assert {tuple(r) for r in hierarchy(_spans(spark), "id", "up", "seq").select("id", "top", "depth", "kind").collect()} == want


def _by_walking(rows):
    """(id, top, depth, kind) of (id, parent) rows, one step at a time."""
    up = dict(rows)
    for i in up:
        trail, at = [i], i
        while up[at] in up and up[at] not in trail:
            at = up[at]
            trail.append(at)
        if up[at] in trail:
            k = trail.index(up[at])
            yield i, min(trail[k:]), k, "below_cycle" if k else "cycle"
        else:
            yield i, at, len(trail) - 1, "missing_parent" if up[at] else "root"


def test_long_chains_and_cycles_against_walking(spark):
    rows = [(f"n{i:04}", f"n{i - 1:04}" if i % 1200 else None) for i in range(1300)] + [(f"x{i:03}", f"x{(i + 1) % 23:03}" if i < 23 else f"x{i - 1:03}") for i in range(60)] + [("lost", "gone"), ("loop", "loop"), ("under", "loop")]
    random.Random(2).shuffle(rows)
    df = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "id string, up string, seq bigint")
    want = set(_by_walking(rows))
    assert {tuple(r) for r in hierarchy(df, "id", "up", "seq").select("id", "top", "depth", "kind").collect()} == want
    assert ("n1199", "n0000", 1199, "root") in want and ("x059", "x000", 37, "below_cycle") in want


def test_paths_and_descendants(spark):
    df = paths(_spans(spark), "id", "up", "seq").cache()
    got = {r["id"]: (r["path"], r["n_descendants"]) for r in df.collect()}
    assert got["a2"] == (["a1", "a2"], 0) and got["a1"] == (["a1"], 2) and got["b1"] == (["b1"], 1) and got["c1"] == (["c1"], 0) and got["d2"] == (["c3", "d1", "d2"], 0) and len(got) == 14
    assert {tuple(r) for r in descendants(df).filter("id in ('a1', 'c3', 'f2')").collect()} == {("a1", "a2", 1), ("a1", "a3", 1), ("c3", "d1", 1), ("c3", "d2", 2), ("f2", "f3", 1)}
    assert hierarchy(_spans(spark).limit(0), "id", "up", "seq").count() == 0


def test_tables_are_deleted_on_request(spark):
    import os

    from vertexloom.operators import durable as D

    df = D.durable(spark.range(5))
    assert df.count() == 5
    folder = D._tables(spark).removeprefix("file:")
    assert os.listdir(folder)
    D.forget(spark)
    assert not os.path.exists(folder)
    assert D.durable(spark.range(2)).count() == 2


def test_rounds_and_numbers(spark):
    from vertexloom.operators.durable import Rounds, numbered

    t = Rounds(spark)
    assert t.add(spark.range(3), n=F.count(F.lit(1)), top=F.max("id")) == {"n": 3, "top": 2} and t.add(spark.range(0), n=F.count(F.lit(1)))["n"] == 0
    assert t.all().count() == 3 and t.last().count() == 0
    got = numbered(spark.range(0, 50, 1, 7).filter("id % 3 = 0"), "k").collect()
    assert [r["k"] for r in sorted(got, key=lambda r: r["id"])] == list(range(len(got))) and numbered(spark.range(0), "k").count() == 0
