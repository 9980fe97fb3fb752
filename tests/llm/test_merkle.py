"""Merkle manifest: brute force in one process, associativity, odd rows, any chunk size."""

import hashlib
import random
import zlib

import pytest
from nearspan.llm import merkle
from pyspark.sql import functions as F


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, lower=False):
    values = [row[0], row[3], row[2], row[4], row[1].translate({c: c + 32 for c in range(65, 91)}) if lower and row[1] is not None else row[1]]
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + 8]) for i in range(0, len(out[-1]), 8)])
    return out


def path(tree, i):
    for level in tree[:-1]:
        a = i // 8 * 8
        yield level[a:i], level[i + 1 : a + 8]
        i //= 8


def brute(rows):
    """Rows of the contract; rows are (doc_id, text, lang, source, n_chars)."""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in order:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = {g: levels([leaf(r) for r in groups[g]]) for g in order}
    top = levels([trees[g][-1][0] for g in order])
    out = []
    for k, g in enumerate(order):
        for i, r in enumerate(groups[g]):
            way = [*path(trees[g], i), *path(top, k)]
            own = leaf(r, r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0)
            for left, right in way:
                own = h(*left, own, *right)
            out.append((r[0], leaf(r), trees[g][-1][0], top[-1][0], h(*[x for left, right in way for x in (*left, *right)]), own, own == top[-1][0]))
    return sorted(out, key=str)


def run(docs, **sizes):
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return sorted([tuple(r) for r in merkle.verify(docs, forged={"text": merkle.lower_ascii(F.col("text"))}, when=chosen, **sizes).collect()], key=str)


@pytest.mark.parametrize("n", [0, 1, 2, 7, 8, 9, 63, 64, 65, 512, 513])
def test_heights_and_widths(n):
    tree = levels(["x"] * n) if n else [[]]
    assert n == 0 or merkle.height(n) == len(tree) - 1
    assert [merkle.width(n, i) for i in range(len(tree))] == [len(x) for x in tree]


def test_products_of_fragments_are_associative():
    rng, sizes = random.Random(1), {"a": 700, "b": 64, "c": 1}
    leaves = {(t, 0, i): f"{t}{i}" for t, n in sizes.items() for i in range(n)}
    roots = {(t, merkle.height(n), 0): levels([f"{t}{i}" for i in range(n)])[-1][0] for t, n in sizes.items()}
    keys = sorted(leaves)
    for _ in range(5):
        cuts = sorted(rng.sample(range(len(keys)), 9))
        parts = [merkle.close({k: leaves[k] for k in keys[a:b]}, sizes)[0] for a, b in zip([0, *cuts], [*cuts, len(keys)], strict=True)]
        assert sum(map(len, parts)) < 400
        while len(parts) > 1:  # any bracketing of neighbours
            i = rng.randrange(len(parts) - 1)
            parts[i : i + 2] = [merkle.close(parts[i] | parts[i + 1], sizes)[0]]
        assert parts[0] == roots


@pytest.mark.parametrize(("chunk", "fan"), [(4096, 16), (13, 2), (5, 3)])
def test_rows_equal_brute_force(docs, rows, chunk, fan):
    assert run(docs, chunk=chunk, fan=fan) == brute(rows)


def test_many_small_trees(spark):
    rows = [(i, f"T{i}", f"g{i % 90:02}", "s", i) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert run(docs, chunk=11, fan=2) == brute(rows)


def test_one_row_one_tree_and_equal_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for rows in ([(5, "A", None, None, None)], [(1, "a", "en", "s", 1)] * 20, [(i, "X", "é" if i % 2 else "z", "s", 1) for i in range(9)]):
        assert run(spark.createDataFrame(rows, schema), chunk=3, fan=2) == brute(rows)


def test_empty_table_and_clashing_names(none, clash, docs):
    assert run(none) == []
    assert run(clash) == run(docs)
