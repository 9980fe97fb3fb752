"""Blocks of distances, pivots over them, and edit joins over strings with a common beginning."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from nearspan.functions.vectors import euclidean
from nearspan.operators import blocks, dag, pivots, search
from nearspan.operators.dag import edit_distance


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_edit_block_equals_single_distances():
    rng = random.Random(5)
    make = lambda: "".join(rng.choice("ab€𝔘") for _ in range(rng.randrange(9)))
    a, b = sorted(make() for _ in range(300)), ["", *(make() for _ in range(40))]
    for rows, d in blocks.edit_block(a, b):
        assert d.tolist() == [[edit_distance(x, y) for y in b] for x in a[rows]]


def test_assign_lists_no_pairs_and_leaves_out_a_null_center(spark):
    names = [f"Customer#{i * 37:05d}" for i in range(200)]
    rows = [(i, s) for i, s in enumerate(names + names[:50])] + [(900, None)]
    objects = spark.createDataFrame(rows, "id long, obj string")
    heads = spark.createDataFrame([(9, names[3]), (7, names[3]), (5, names[90]), (1, None)], "pivot_id long, center string")
    got = pivots.assign(objects, heads, F.levenshtein)
    assert "BroadcastNestedLoopJoin BuildRight, Inner" not in plan(pivots.assign(objects, heads.filter("pivot_id > 1"), F.levenshtein)).split("FlatMapCoGroups")[0]
    d = lambda s: min((edit_distance(s, c), p) for p, c in ((7, names[3]), (5, names[90])))
    want = {(i, *reversed(d(s))) if s else (i, 1, None) for i, s in rows}
    assert {(r["id"], r["pivot_id"], r["d"]) for r in got.collect()} == want


def test_accesses_count_members_by_distance(spark):
    names = [(i, f"Customer#{i % 60 * 131:05d}") for i in range(120)]
    objects = spark.createDataFrame(names, "id long, obj string")
    queries = objects.filter("id % 20 = 0").select(F.col("id").alias("q_id"), F.translate("obj", "#", "@").alias("q"))
    heads, members = pivots.build(objects, 16, F.levenshtein)
    got = {r["q_id"]: r["entry_accesses"] for r in pivots.accesses(queries, heads, members, F.levenshtein, 2).collect()}
    listed = pivots.compared(pivots.visits(queries, heads, F.levenshtein, 2), members, 2)
    want = {r["q_id"]: r["count"] for r in listed.groupBy("q_id").count().collect()}
    assert got == {q: want.get(q, 0) for q in got} and any(want.values())
    found = {(r["q_id"], r["id"], r["dist"]) for r in pivots.range_search(queries, heads, members, F.levenshtein, 2).collect()}
    assert found == {(q, i, edit_distance(s.replace("#", "@"), o)) for q, s in names if q % 20 == 0 for i, o in names if edit_distance(s.replace("#", "@"), o) <= 2}


def test_edit_join_of_a_common_beginning_lists_few_pairs(spark):
    names = [f"Customer#{i * 7919 % 10**9:09d}" for i in range(1500)]
    df = spark.createDataFrame([(s,) for s in names], "s string")
    pairs = search._by_remains(df.select(F.col("s").alias("ls")), df.select(F.col("s").alias("rs")), 2).distinct().count()
    assert pairs < 100 * len(names)  # segments alone: all 2,250,000
    both = df.select(F.col("s").alias("id"), "s")
    got = {tuple(r) for r in search.edit_join(both, both, 2).collect()}
    d = {s: row for s, row in zip(sorted(names), np.vstack([d for _, d in blocks.edit_block(sorted(names), sorted(names))]), strict=True)}
    assert got == {(a, b, int(d[a][j])) for a in d for j, b in enumerate(sorted(names)) if d[a][j] <= 2}


def test_loop_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(search, "LOOP_PAIRS", 0)
    monkeypatch.setattr(blocks, "SIDE", 7)
    left = [(i, s) for i, s in enumerate(["", "ab", "ba", "aab", "zzzz", "abé", None, "ab"] * 3)]
    right = [(i, s) for i, s in enumerate(["ab", "", None, "abc", "zz", "😀b", "ab"] * 2)]
    for t in (1, 3):
        want = sorted((i, j, d) for i, a in left for j, b in right if a is not None and b is not None and (d := edit_distance(a, b)) <= t)
        got = search.edit_join(spark.createDataFrame(left, "id long, s string"), spark.createDataFrame(right, "id long, s string"), t)
        assert sorted(tuple(r) for r in got.collect()) == want


def test_vectors_meet_by_tiles(spark, monkeypatch):
    """Searches of vectors list no pair beyond the results' own, whatever the balls; with copies, ties and a null element."""
    monkeypatch.setattr(blocks, "LEAST_TILE", 40)
    monkeypatch.setattr(blocks, "TILE_VECTORS", 30)
    monkeypatch.setattr(blocks, "PAIRS", 50)
    rng = random.Random(8)
    rows = [(i, [float(rng.randrange(-2, 3)) + rng.random() * (i % 3 > 0) for _ in range(5)]) for i in range(70)]
    rows += [(100 + i, v) for i, v in rows[:30]] + [(200, [1.0, None, 0.0, 0.0, 0.0]), (201, None)]
    objects = spark.createDataFrame(rows, "id long, obj array<double>")
    queries = objects.filter("id % 4 = 0").select(F.col("id").alias("q_id"), F.col("obj").alias("q"))
    index = pivots.build(objects, 6, euclidean)
    good = [(i, v) for i, v in rows if v and None not in v]

    def dist(a, b):
        total = 0.0
        for x, y in zip(a, b, strict=True):
            total += (x - y) * (x - y)
        return math.sqrt(total)

    pairs = sorted((q, dist(a, b), i) for q, a in good if q % 4 == 0 for i, b in good)
    for r in (0.0, 2.5):
        found = pivots.range_search(queries, *index, euclidean, r)
        assert sorted((x["q_id"], x["dist"], x["id"]) for x in found.collect()) == [p for p in pairs if p[1] <= r]
    for k in (1, 3, 200):
        want = [p for q in sorted({p[0] for p in pairs}) for p in [p for p in pairs if p[0] == q][:k]]
        found = pivots.knn(queries, *index, euclidean, k)
        assert "NestedLoopJoin" not in plan(found)
        assert sorted((x["q_id"], x["dist"], x["id"]) for x in found.collect()) == want


def test_vectors_of_several_lengths():
    a, b = [[1.0, 2.0, 3.0], [1.0], [4.0, None]], [[0.0, 0.0], [2.0, 2.0, 2.0], []]
    [(_, d)] = list(blocks.vector_block(a, b))
    want = [[5**0.5, 2**0.5, 0.0], [1.0, 1.0, 0.0], [np.nan, np.nan, 0.0]]
    assert np.array_equal(d, np.array(want), equal_nan=True)


def test_a_ball_is_met_through_one_parent(spark, monkeypatch):
    monkeypatch.setattr(blocks, "SIDE", 5)
    rows = [(i, f"{i % 60 * 7919 % 1000:04d}") for i in range(90)]
    leaves, queries = spark.createDataFrame(rows, "id long, s string"), spark.createDataFrame(rows[::4] + [(99, None)], "q_id long, q string")
    nodes, edges = dag.build(leaves, {1: 1, 2: 2, 3: 3})
    inner = dag._holding(nodes, edges)
    assert inner.groupBy("layer", "child").count().filter("count > 1").isEmpty() and inner.count() < edges.filter("layer > 1").count()
    want = sorted((q, i, d) for q, a in rows[::4] for i, b in rows if (d := edit_distance(a, b)) <= 1)
    for mode in ("exhaustive", "adaptive", "pruned", "prototype"):
        assert sorted(tuple(r) for r in dag.search(spark, mode, queries, leaves, nodes, edges, 1).collect()) == want
