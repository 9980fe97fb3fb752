"""Chains against a quadratic dynamic program, leaders and group distances against plain loops."""

import random

import pytest

from nearspan.operators import chain, dag


def quadratic(found, length):
    found = sorted(set(found))
    best = {}
    for o, p in found:
        before = [best[x] for x in best if x[0] + length <= o and x[1] + length <= p]
        n, begin = max(before, default=(0, -p))
        best[o, p] = (n + 1, begin)
    n, begin, end = max((v[0], v[1], -k[1] - length) for k, v in best.items())
    return n, -begin, -end


@pytest.mark.parametrize("seed", range(20))
def test_best_chain_equals_the_quadratic_program(seed):
    rng = random.Random(seed)
    found = [(rng.randrange(60), rng.randrange(80)) for _ in range(rng.randrange(1, 90))]
    assert chain.best_chain(found, 5) == quadratic(found, 5)


def brute(queries, refs, length, stride, drift):
    out = {}
    for q, s in queries:
        for r, seq in refs:
            if not s or not seq:
                continue
            bands = {}
            for o in range(0, len(s) - length + 1, stride):
                for p in range(len(seq) - length + 1):
                    if seq.startswith(s[o : o + length], p):
                        for k in (0, 1):
                            bands.setdefault((k, (p - o + k * drift) // (2 * drift)), []).append((o, p))
            if bands:
                n, begin, end = min((-n, b, e) for n, b, e in (quadratic(x, length) for x in bands.values()))
                out[q, r] = (-n * length, begin, end)
    return out


def test_chains_equal_brute_force(spark):
    rng = random.Random(8)
    refs = [(i, "".join(rng.choice("ACGT") for _ in range(n))) for i, n in enumerate([0, 4, 300, 800])] + [(4, "ACGTA" * 60), (5, None)]
    s = refs[3][1]
    queries = [(0, s[100:200]), (1, s[300:340] + s[350:400]), (2, "ACGTA" * 12), (3, "AC"), (4, None), (5, s[10:60] + refs[2][1][50:120])]
    got = chain.chains(spark.createDataFrame(queries, "q_id long, q string"), spark.createDataFrame(refs, "ref_id long, seq string"), 6, 2, 8)
    assert {(r[0], r[1]): tuple(r[2:]) for r in got.collect()} == brute(queries, refs, 6, 2, 8)


@pytest.mark.parametrize("start", [500, 7])
def test_leaders_are_those_of_the_loop(spark, start):
    rng = random.Random(3)
    rows = [(i, "".join(rng.choice("ab") for _ in range(9))) for i in range(70)]
    kept = []
    for i, s in rows:
        if all(dag.edit_distance(s, c) > 2 for _, c in kept):
            kept.append((i, s))
    strings = spark.createDataFrame(rows, "id long, s string")
    assert sorted(tuple(r) for r in dag.leaders(strings, 2, start).collect()) == kept


def test_group_distances_in_tiles(spark, monkeypatch):
    monkeypatch.setattr(dag, "TILE", 4)
    rng = random.Random(6)
    rows = [(g, i, "".join(rng.choice("abc") for _ in range(rng.randrange(6)))) for i, g in enumerate([1] * 23 + [2] * 5 + [3])]
    want = set()
    for g in (1, 2):
        own = [s for k, _, s in rows if k == g]
        d = [dag.edit_distance(a, b) for i, a in enumerate(own) for b in own[:i]]
        want.add((g, len(d), min(d), round(sum(d) / len(d), 9), max(d)))
    got = dag.pair_stats(spark.createDataFrame(rows, "grp long, id long, s string"))
    assert {(r[0], r[1], r[2], round(r[3], 9), r[4]) for r in got.collect()} == want
