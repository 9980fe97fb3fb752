"""Candidates that are counted instead of listed, and joins that meet a text once."""

import random

from pyspark.sql import functions as F

from nearspan.operators import anchors


def test_counted_candidates_are_those_listed(spark):
    rng = random.Random(2)
    rows = [(i, "".join(rng.choice("abc") for _ in range(rng.randrange(1, 9)))) for i in range(200)]
    names = spark.createDataFrame(rows + [(500 + i, rows[i][1]) for i in range(40)], "pos long, seq string")
    some = names.filter("pos < 5").select(F.col("pos").alias("anchor_id"), "seq")
    ranked = anchors.query_anchors(names.filter("pos % 20 = 0").select(F.col("pos").alias("q_id"), F.col("seq").alias("q")), some)
    for most in (None, 4):  # with a bound some objects miss anchors
        index = anchors.build_index(some, names, most)
        want = {tuple(r) for r in anchors.anchor_accesses(ranked, index, anchors.candidates(ranked, index, 1), 1).collect()}
        got = anchors.anchor_accesses(ranked, index, None, 1)
        assert {tuple(r) for r in got.collect()} == want and any(r[2] for r in want)
        assert "seen" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_candidates_are_never_shuffled(spark, monkeypatch):
    """Tiles of objects and queries meet in a Cartesian product, and pairs go from it to the result."""
    monkeypatch.setattr(anchors, "TILE_OBJECTS", 50)
    monkeypatch.setattr(anchors, "TILE_QUERIES", 4)
    monkeypatch.setattr(anchors, "PAIRS", 10)
    rng = random.Random(4)
    rows = [(i, "".join(rng.choice("abc") for _ in range(rng.randrange(1, 9)))) for i in range(120)]
    names = spark.createDataFrame(rows, "pos long, seq string")
    some = names.filter("pos < 5").select(F.col("pos").alias("anchor_id"), "seq")
    ranked = anchors.query_anchors(names.filter("pos % 12 = 0").select(F.col("pos").alias("q_id"), F.col("seq").alias("q")), some)
    for most in (None, 4):
        index = anchors.build_index(some, names, most)
        found = anchors.candidates(ranked, index, 1)
        top = found._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" in top and "Exchange" not in top
        held = {(r["anchor_id"], r["pos"]): r["dist"] for r in index.collect()}
        rules = {}
        for r in ranked.collect():
            if any(a == r["anchor_id"] and abs(d - r["d"]) <= 1 for (a, _), d in held.items()):
                rules.setdefault(r["q_id"], []).append((r["anchor_id"], r["d"]))
        want = sorted((q, i) for q, own in rules.items() for i, _ in rows if all(abs(held.get((a, i), 99) - d) <= 1 for a, d in own))
        assert want and sorted(tuple(r) for r in found.collect()) == want


def test_large_buckets_join_a_text_once(spark):
    from nearspan.llm import neardup

    node = lambda i: bytes([i]) * 16
    rows = [(b, 30, node(0), b % 28, node(i), node(i // 2)) for b in range(28) for i in range(30)]
    large = spark.createDataFrame(rows, "bucket long, n long, main binary, band int, node binary, label binary")
    nodes = spark.createDataFrame([(node(i), [1] * 28) for i in range(30)], "node binary, bands array<long>")
    texts = spark.createDataFrame([(node(i), f"text {i}") for i in range(30)], "node binary, text string")
    placed = neardup.tiles(large, nodes, texts)
    top = placed._jdf.queryExecution().optimizedPlan().toString()
    assert "explode(_in" in top  # buckets go as a list through the joins by node
    got = {(r["bucket"], bytes(r["node"]), bytes(r["label"]), r["text"]) for r in placed.collect()}
    assert got == {(b, n, label, f"text {n[0]}") for b, _, _, _, n, label in rows}
