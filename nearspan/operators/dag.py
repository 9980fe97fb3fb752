"""Three layers of balls: leaves in small balls, small in middle, middle in large ones, with
many parents each. Nodes (layer, node_id, center, radius), edges (layer, parent, child).

Centers are leaders: in order of id, a string becomes a center if no earlier center is near.
They are found in rounds over the near pairs, so no task sees all strings, and are those of the
sequential loop whatever the size of the table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.tables import discard, materialise, number_rows, spread
from . import blocks
from .search import edit_join, shuffled, small

SMALL, MIDDLE, LARGE = 1, 2, 3
#: Ball radii of the three layers.
RADII = {SMALL: 5, MIDDLE: 15, LARGE: 30}
#: Strings of the first batch of leader selection, and those that are looked at side by side.
START, SIDE = 8192, 256
#: Times START that a batch may have where leaders are few.
LONGER = 16
#: Centers that strings meet in blocks, without an index.
CENTERS = 8192
#: Distinct strings of a group on one side of a tile, when all its pairs are compared.
TILE = 2048


def edit_distances(a: str, others: list[str]) -> np.ndarray:
    """Levenshtein distances on code points from a to each of the others, all at once."""
    if not others:
        return np.zeros(0, np.int64)
    size = np.array([len(x) for x in others])
    wide = int(size.max())
    grid = np.zeros((len(others), wide), np.uint32)
    grid[np.arange(wide) < size[:, None]] = np.frombuffer("".join(others).encode("utf-32-le"), np.uint32)
    steps = np.arange(wide + 1)
    row = np.broadcast_to(steps, (len(others), wide + 1))
    for i, c in enumerate(np.frombuffer(a.encode("utf-32-le"), np.uint32), 1):
        new = np.empty_like(row)
        new[:, 0] = i
        new[:, 1:] = np.minimum(row[:, 1:] + 1, row[:, :-1] + (grid != c))
        row = np.minimum.accumulate(new - steps, axis=1) + steps
    return row[np.arange(len(others)), size]


def edit_distance(a: str, b: str) -> int:
    """Levenshtein distance on code points (for the order-dependent steps in Python)."""
    return int(edit_distances(a, [b])[0])


def leaders(strings: DataFrame, radius: float, start: int = START) -> DataFrame:
    """(id, s) of the leaders: in order of id, each string farther than radius from every leader
    before it. Of equal strings only the first can be one.

    Strings go through in batches by order of id; once a batch has its leaders, all later strings
    near one of them are decided and leave. Where leaders are a small share of a batch, the
    next one is as many undecided strings as a task compares with them in the time that START
    far strings take. Where they are not, few pairs are near: a batch is as long as all before it
    and is settled in rounds over its near pairs."""
    left = number_rows(strings.groupBy("s").agg(F.min("id").alias("id")), ["id"], "_n").select("id", "s", "_n")
    n, end, size, chosen = left.count(), start, start, left.select("id", "s").limit(0)
    while True:
        batch = left.filter(F.col("_n") < end)
        new = _independent(batch.select("id", "s"), radius, size)
        chosen = chosen.unionByName(new)
        if end >= n:
            return chosen
        rest, found, looked = left.filter(F.col("_n") >= end), new.count(), batch.count()
        if found <= CENTERS:
            left = materialise(_far(rest, [row["s"] for row in new.select("s").collect()], radius), "undecided")
        else:
            near = _pairs(rest, new, int(radius)).select(F.col("l_id").alias("id")).distinct()
            left = materialise(rest.join(shuffled(near), "id", "left_anti"), "undecided")
        size = min(int(start * (looked / max(found, 1)) ** 0.5), LONGER * start)
        if size >= 2 * start:
            last = left.orderBy("_n").limit(size).agg(F.max("_n")).first()[0]
            end = n if last is None else last + 1
        else:
            size, end = start, 2 * end


def _far(strings: DataFrame, centers: list[str], radius: float) -> DataFrame:
    """The strings (s, ...) that are near none of the centers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(~blocks.near_any(centers, batch.column("s").to_pylist(), radius)))

    return spread(strings).mapInArrow(run, strings.schema)


def _independent(strings: DataFrame, radius: float, most: int) -> DataFrame:
    """The leaders of distinct strings (id, s): up to `most` of them are looked at by one task,
    more in rounds, with the same result. A round: a string that no undecided earlier one is
    near becomes a leader, and its later neighbours are decided with it. The first undecided
    string always is one, so the rounds end; each is a table."""
    if strings.limit(most + 1).count() <= most:

        def pick(rows: pd.DataFrame) -> pd.DataFrame:
            left, kept = rows.sort_values("id")[["id", "s"]], []
            while len(left):
                # The leaders among the first strings, then all others near one of them leave.
                first, new = left.iloc[:SIDE], []
                for i, s in first.itertuples(index=False):
                    if not (edit_distances(s, [c for _, c in new]) <= radius).any():
                        new.append((i, s))
                kept += new
                left = left.iloc[SIDE:]
                left = left[~blocks.near_any([c for _, c in new], left["s"].tolist(), radius)]
            return pd.DataFrame(kept, columns=["id", "s"])

        return materialise(strings.groupBy().applyInPandas(pick, strings.select("id", "s").schema), "leaders")
    near = edit_join(strings, strings, int(radius)).filter("l_id < r_id").select(F.col("l_id").alias("a"), F.col("r_id").alias("b"))
    pairs = materialise(near, "near")
    left, chosen = strings.select("id"), None
    while True:
        new = materialise(left.join(shuffled(pairs.select(F.col("b").alias("id")).distinct()), "id", "left_anti"), "leaders")
        chosen = new if chosen is None else chosen.unionByName(new)
        gone = pairs.join(shuffled(new.select(F.col("id").alias("a"))), "a", "left_semi").select(F.col("b").alias("id")).distinct()
        left = materialise(left.join(shuffled(new), "id", "left_anti").join(shuffled(gone), "id", "left_anti"), "undecided")
        if left.isEmpty():
            return materialise(strings.join(shuffled(chosen), "id").select("id", "s"), "leaders")
        rest = pairs.join(shuffled(left.select(F.col("id").alias("a"))), "a", "left_semi").join(shuffled(left.select(F.col("id").alias("b"))), "b", "left_semi")
        rest = materialise(rest.select("a", "b"), "near")
        discard(pairs)
        pairs = rest


def _pairs(a: DataFrame, b: DataFrame, t: int) -> DataFrame:
    return edit_join(a.select("id", "s"), b.select("id", "s"), t, CENTERS)


def build(leaves: DataFrame, radii: dict[int, int] = RADII) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges over leaves (id, s). Edges of SMALL go to leaves.

    A leaf is in every small ball that covers it. A ball has as parents all balls above it
    that it meets; a ball that lies in none of them gets a parent with its own center, so
    that every ball is inside one parent."""
    first = materialise(leaders(leaves, radii[SMALL]), "centers")
    layers, edges = {SMALL: first}, []
    into = _pairs(leaves, first, radii[SMALL]).select(F.lit(SMALL).alias("layer"), F.col("r_id").alias("parent"), F.col("l_id").alias("child"))
    edges.append(into)
    for low, high in ((SMALL, MIDDLE), (MIDDLE, LARGE)):
        centers = layers[low]
        first = leaders(centers, radii[high] - radii[low])
        covered = _pairs(centers, first, radii[high] - radii[low]).select(F.col("l_id").alias("id")).distinct()
        above = first.unionByName(centers.join(shuffled(covered), "id", "left_anti")).dropDuplicates(["id"])
        layers[high] = above = materialise(above, "centers")
        met = _pairs(centers, above, radii[high] + radii[low])
        edges.append(met.select(F.lit(high).alias("layer"), F.col("r_id").alias("parent"), F.col("l_id").alias("child")))
    nodes = None
    for layer, df in layers.items():
        part = df.select(F.lit(layer).alias("layer"), F.col("id").alias("node_id"), F.col("s").alias("center"), F.lit(radii[layer]).alias("radius"))
        nodes = part if nodes is None else nodes.unionByName(part)
    every = materialise(edges[0].unionByName(edges[1]).unionByName(edges[2]), "edges")
    return nodes.join(shuffled(every.select("layer", F.col("parent").alias("node_id")).distinct()), ["layer", "node_id"], "left_semi"), every


def fingerprints(nodes: DataFrame, edges: DataFrame, k: int = 3) -> tuple[DataFrame, DataFrame]:
    """Routing anchors (parent, i, anchor) of every inner node, chosen by farthest-point
    sampling from the least child id, and fingerprints (parent, child, fp) of its children."""
    children = edges.filter(F.col("layer") > SMALL).join(small(nodes.select((F.col("layer") + 1).alias("layer"), F.col("node_id").alias("child"), F.col("center").alias("s"))), ["layer", "child"])
    picked = children.groupBy("layer", "parent").agg(F.min_by("s", "child").alias("anchor")).withColumn("i", F.lit(0))
    anchors = picked
    for i in range(1, k):
        far = children.join(shuffled(anchors), ["layer", "parent"]).withColumn("d", F.levenshtein("s", "anchor"))
        least = far.groupBy("layer", "parent", "child").agg(F.min("d").alias("d"), F.first("s").alias("s"))
        nxt = least.filter("d > 0").groupBy("layer", "parent").agg(F.max_by("s", F.struct("d", -F.col("child"))).alias("anchor")).withColumn("i", F.lit(i))
        anchors = anchors.unionByName(nxt)
    fp = children.join(shuffled(anchors), ["layer", "parent"]).groupBy("layer", "parent", "child").agg(F.array_sort(F.collect_list(F.struct("i", F.levenshtein("s", "anchor").alias("d")))).alias("a"))
    return anchors, fp.select("layer", "parent", "child", F.transform("a", lambda x: x["d"]).alias("fp"))


def _children(nodes: DataFrame, edges: DataFrame, layer: int, marks: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(parent, child, center, radius, fp) of the edges of one layer; fp is null without marks."""
    own = nodes.filter(F.col("layer") == layer - 1).select(F.col("node_id").alias("child"), "center", "radius")
    made = edges.filter(F.col("layer") == layer).select("parent", "child").join(small(own), "child")
    if marks is None:
        return made.withColumn("fp", F.lit(None).cast("array<int>"))
    return made.join(shuffled(marks[1].filter(F.col("layer") == layer).select("parent", "child", "fp")), ["parent", "child"], "left")


def _top(nodes: DataFrame) -> DataFrame:
    """The balls of the upper layer as children of one parent, 0."""
    root = F.lit(0).cast(nodes.schema["node_id"].dataType)
    return nodes.filter(F.col("layer") == LARGE).select(F.col("node_id").alias("child"), root.alias("parent"), "center", "radius", F.lit(None).cast("array<int>").alias("fp"))


def _met(frontier: DataFrame, children: DataFrame, tol: int, pick: str = "all", anchors: DataFrame | None = None) -> DataFrame:
    """(q, node_id, d, holds), as a table: for each query string at a parent (frontier: q, node_id)
    the children (parent, child, center, radius, fp) whose balls meet its ball. pick: `all`; `holder`, the
    first child that holds the query's whole ball for all of them, if there is one; `nearest`,
    the nearest only. With anchors (parent, i, anchor), children that their fingerprints rule
    out are left out, where a parent has more children than anchors and one. The queries of a
    parent go in parts of blocks.SIDE, each with the parent's children in one task, so a query and
    a child that do not meet are never a row."""
    kind = children.schema["child"].dataType.simpleString()
    parts = frontier.groupBy("node_id").agg(F.ceil(F.count("*") / blocks.SIDE).cast("int").alias("_k"))
    asked = frontier.join(shuffled(parts), "node_id").select("node_id", "q", F.pmod(F.xxhash64("q"), F.col("_k")).cast("int").alias("_v"))
    if anchors is None:
        held = children.withColumn("marks", F.lit(None).cast("array<string>"))
    else:
        listed = anchors.groupBy("parent").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "anchor"))), lambda x: x["anchor"]).alias("marks"))
        held = children.join(shuffled(listed), "parent", "left")
    held = held.join(shuffled(parts.withColumnRenamed("node_id", "parent")), "parent").withColumn("_w", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        left, right = left.sort_by("q"), right.sort_by("child")
        strings, centers, radius = left.column("q").to_pylist(), right.column("center").to_pylist(), right.column("radius").to_numpy()
        marks = right.column("marks")[0].as_py() if len(centers) else None
        if not strings or not centers:
            strings = []
        fits, prints = np.zeros(len(centers), bool), np.zeros((len(centers), 0), np.int64)
        if marks and len(centers) > len(marks) + 1:
            listed = right.column("fp").to_pylist()
            fits = np.array([x is not None and len(x) == len(marks) for x in listed])
            prints = np.array([x if ok else [0] * len(marks) for x, ok in zip(listed, fits, strict=True)], np.int64)
        out = {"q": [], "node_id": [], "d": [], "holds": []}
        step = max(SIDE, (1 << 16) // max(len(centers), 1))
        for a in range(0, len(strings), step):
            some = strings[a : a + step]
            ruled = np.zeros((len(some), len(centers)), bool)
            if fits.any():
                for k, own in enumerate(marks):
                    ruled |= np.abs(edit_distances(own, some)[:, None] - prints[:, k]) > radius + tol
                ruled &= fits
            kept = np.flatnonzero(~ruled.all(0))
            if not len(kept):
                continue
            left_in = [centers[j] for j in kept]
            # The longer side is the one that an array runs over.
            d = np.vstack([x for _, x in blocks.edit_block(some, left_in)]) if len(left_in) >= len(some) else np.array(list(blocks.edit_rows(left_in, some))).T
            near = (d <= radius[kept] + tol) & ~ruled[:, kept]
            holds = near & (d + tol <= radius[kept])
            if pick == "holder":
                first = np.arange(len(kept)) == holds.argmax(1)[:, None]
                near = np.where(holds.any(1)[:, None], first, near)
            elif pick == "nearest":
                near &= np.arange(len(kept)) == np.where(near, d, 1 << 30).argmin(1)[:, None]
            i, j = np.nonzero(near)
            out["q"].append(left.column("q").take(pa.array(i + a)).combine_chunks())
            out["node_id"].append(right.column("child").take(pa.array(kept[j])).combine_chunks())
            out["d"].append(pa.array(d[i, j].astype(np.int32)))
            out["holds"].append(pa.array(holds[i, j]))
        if not out["d"]:
            return pa.table({"q": left.column("q").slice(0, 0), "node_id": right.column("child").slice(0, 0), "d": pa.array([], pa.int32()), "holds": pa.array([], pa.bool_())})
        return pa.table({c: pa.chunked_array(x) for c, x in out.items()})

    n = 4 * frontier.sparkSession.sparkContext.defaultParallelism
    sides = asked.repartition(n, "node_id", "_v").groupBy("node_id", "_v"), held.repartition(n, "parent", "_w").groupBy("parent", "_w")
    return materialise(sides[0].cogroup(sides[1]).applyInArrow(run, f"q string, node_id {kind}, d int, holds boolean"), "met")


def _asked(queries: DataFrame, nodes: DataFrame) -> DataFrame:
    """The distinct query strings at the root; copies share a search."""
    return queries.filter(F.col("q").isNotNull()).select("q", F.lit(0).cast(nodes.schema["node_id"].dataType).alias("node_id")).distinct()


def _opened(met: DataFrame) -> DataFrame:
    return met.select("q", "node_id").distinct()


def _first_holder(met: DataFrame) -> DataFrame:
    """Of the balls that a query meets, the first that holds its whole ball for all of them."""
    first = met.groupBy("q").agg(F.min(F.when(F.col("holds"), F.col("node_id"))).alias("_first"))
    return _opened(met.join(shuffled(first), "q").filter(F.col("_first").isNull() | (F.col("node_id") == F.col("_first"))))


def _verified(queries: DataFrame, opened: DataFrame, leaves: DataFrame, edges: DataFrame, tol: int) -> DataFrame:
    """(q_id, id, dist) of the leaves of opened balls (q, node_id) within tol. Copies of a leaf and
    of a query are compared once, and pairs are filtered before they are made distinct."""
    named = leaves.select("id", "s").filter(F.col("s").isNotNull())
    held = edges.filter(F.col("layer") == SMALL).select(F.col("parent").alias("node_id"), F.col("child").alias("id")).join(shuffled(named), "id").select("node_id", "s").distinct()
    n = 4 * held.sparkSession.sparkContext.defaultParallelism
    # A stated number of partitions: small rows, but much work, so they are not to be merged.
    pairs = opened.repartition(n, "node_id").join(shuffled(held.repartition(n, "node_id")), "node_id")
    found = pairs.select("q", "s", F.when(F.abs(F.length("q") - F.length("s")) <= tol, F.levenshtein("q", "s", tol)).alias("dist")).filter("dist >= 0").distinct()
    found = materialise(found, "found")
    return queries.select("q_id", "q").join(shuffled(found), "q").join(shuffled(named), "s").select("q_id", "id", "dist")


def _holding(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The edges above SMALL that a search of all balls needs: a child that some parent holds whole
    is met whenever that parent is, so it needs no other; all edges of any other child."""
    own = lambda up, name: nodes.select((F.col("layer") + up).alias("layer"), F.col("node_id").alias(name), F.col("center").alias(f"_{name}"), F.col("radius").alias(f"_r_{name}"))
    inner = edges.filter(F.col("layer") > SMALL).join(small(own(0, "parent")), ["layer", "parent"]).join(small(own(1, "child")), ["layer", "child"])
    room = F.col("_r_parent") - F.col("_r_child")
    holder = inner.withColumn("_d", F.levenshtein("_parent", "_child")).groupBy("layer", "child").agg(F.min(F.when(F.col("_d") <= room, F.col("parent"))).alias("_holder"))
    kept = edges.filter(F.col("layer") > SMALL).join(shuffled(holder), ["layer", "child"])
    return materialise(kept.filter(F.col("_holder").isNull() | (F.col("parent") == F.col("_holder"))).select("layer", "parent", "child"), "holding")


def search_exhaustive(queries: DataFrame, leaves: DataFrame, nodes: DataFrame, edges: DataFrame, tol: int) -> DataFrame:
    """(q_id, id, dist): all balls that the query's ball meets, level by level."""
    return _verified(queries, _all_met(queries, nodes, edges, tol)[SMALL], leaves, edges, tol)


def _all_met(queries: DataFrame, nodes: DataFrame, edges: DataFrame, tol: int) -> dict[int, DataFrame]:
    """(q, node_id) by layer: all balls that distinct query strings meet on their way down."""
    inner = _holding(nodes, edges)
    out = {LARGE: _opened(_met(_asked(queries, nodes), _top(nodes), tol))}
    for layer in (LARGE, MIDDLE):
        out[layer - 1] = _opened(_met(out[layer], _children(nodes, inner, layer), tol))
    return out


def search_adaptive(queries: DataFrame, leaves: DataFrame, nodes: DataFrame, edges: DataFrame, tol: int, marks: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """The same result with less work: the first ball of a layer that holds the query's whole
    ball stands for all of them, and with marks (anchors and fingerprints) children that they
    rule out are never compared."""
    opened = _first_holder(_met(_asked(queries, nodes), _top(nodes), tol, "holder"))
    for layer in (LARGE, MIDDLE):
        anchors = None if marks is None else marks[0].filter(F.col("layer") == layer).drop("layer")
        opened = _first_holder(_met(opened, _children(nodes, edges, layer, marks), tol, "holder", anchors))
    return _verified(queries, opened, leaves, edges, tol)


def prototype_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Only the edges whose child's center lies in the parent's ball. A child's ball may then
    stick out of its parent, so a search over these edges can miss results."""
    own = lambda up, name: nodes.select((F.col("layer") + up).alias("layer"), F.col("node_id").alias(name), F.col("center").alias(f"_{name}"), F.col("radius").alias(f"_r_{name}"))
    inner = edges.filter(F.col("layer") > SMALL).join(small(own(0, "parent")), ["layer", "parent"]).join(small(own(1, "child")), ["layer", "child"])
    held = inner.filter(F.levenshtein("_parent", "_child") <= F.col("_r_parent")).select("layer", "parent", "child")
    return edges.filter(F.col("layer") == SMALL).select("layer", "parent", "child").unionByName(held)


def visits(queries: DataFrame, nodes: DataFrame, edges: DataFrame, tol: int) -> DataFrame:
    """(layer, visited, total): per layer the nodes that an exhaustive search opens, over all
    queries, and what opening all would be."""
    copies, out = queries.groupBy("q").agg(F.count("*").alias("_n")), None
    for layer, met in _all_met(queries, nodes, edges, tol).items():
        row = met.groupBy("q").agg(F.count("*").alias("_m")).join(shuffled(copies), "q").agg(F.lit(layer).alias("layer"), F.coalesce(F.sum(F.col("_m") * F.col("_n")), F.lit(0)).alias("visited"))
        out = row if out is None else out.unionByName(row)
    every = nodes.groupBy("layer").agg(F.count("*").alias("n")).crossJoin(queries.agg(F.count("*").alias("_q")))
    return out.join(every, "layer").select("layer", "visited", (F.col("n") * F.col("_q")).alias("total"))


def search_greedy(queries: DataFrame, nodes: DataFrame, edges: DataFrame, tol: int) -> DataFrame:
    """(q_id, id): the leaves, not verified, of the one small ball reached by always taking
    the nearest ball that meets the query's."""
    best = _nearest(_met(_asked(queries, nodes), _top(nodes), tol, "nearest"))
    for layer in (LARGE, MIDDLE):
        best = _nearest(_met(best, _children(nodes, edges, layer), tol, "nearest"))
    reached = best.join(shuffled(edges.filter(F.col("layer") == SMALL).select(F.col("parent").alias("node_id"), F.col("child").alias("id"))), "node_id")
    return queries.select("q_id", "q").join(shuffled(reached), "q").select("q_id", "id")


def _nearest(met: DataFrame) -> DataFrame:
    """The nearest ball of each query string, ties by id."""
    return met.groupBy("q").agg(F.min(F.struct("d", "node_id")).alias("m")).select("q", F.col("m.node_id").alias("node_id"))


def search_brute_force(queries: DataFrame, leaves: DataFrame, tol: int) -> DataFrame:
    return edit_join(queries.select(F.col("q_id").alias("id"), F.col("q").alias("s")), leaves.select("id", "s"), tol).select(F.col("l_id").alias("q_id"), F.col("r_id").alias("id"), "dist")


def search(spark: SparkSession, mode: str, queries: DataFrame, leaves: DataFrame, nodes: DataFrame, edges: DataFrame, tol: int) -> DataFrame:
    if mode == "exhaustive":
        return search_exhaustive(queries, leaves, nodes, edges, tol)
    if mode == "adaptive":
        return search_adaptive(queries, leaves, nodes, edges, tol)
    if mode == "pruned":
        return search_adaptive(queries, leaves, nodes, edges, tol, fingerprints(nodes, edges))
    if mode == "prototype":
        return search_exhaustive(queries, leaves, nodes, prototype_edges(nodes, edges), tol)
    if mode == "greedy":
        return search_greedy(queries, nodes, edges, tol)
    raise ValueError(f"unknown mode {mode!r}")


def statistics(nodes: DataFrame, edges: DataFrame, leaves: DataFrame) -> DataFrame:
    """Nodes by layer, leaf links, compression (leaves a small ball), redundancy in percent."""
    share = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    n = nodes.agg(*[F.count_if(F.col("layer") == k).alias(v) for k, v in ((SMALL, "n_small"), (MIDDLE, "n_middle"), (LARGE, "n_large"))])
    e = edges.agg(F.count_if(F.col("layer") == SMALL).alias("leaf_links"))
    out = n.crossJoin(e).crossJoin(leaves.agg(F.count("*").alias("n_leaves")))
    return out.select("*", share(F.col("n_leaves"), F.col("n_small")).alias("compression"), F.when(F.col("n_leaves") > 0, (F.col("leaf_links") / F.col("n_leaves") - 1) * 100).otherwise(F.lit(0.0)).alias("redundancy"))


def pair_stats(rows: DataFrame) -> DataFrame:
    """(grp, n, least, mean, most) of the distances between any two strings of a group; rows:
    (grp, id, s). Copies of a string are one with a count. The strings of a group are dealt into
    parts of about TILE, and each two parts meet in one task, which gives four numbers: no pair
    leaves it."""
    held = rows.groupBy("grp", "s").agg(F.count("*").alias("c"))
    parts = held.groupBy("grp").agg(F.ceil(F.count("*") / TILE).cast("int").alias("_k"))
    dealt = held.join(shuffled(parts), "grp").withColumn("_own", F.pmod(F.xxhash64("s"), F.col("_k")).cast("int"))
    meets = F.transform(F.sequence(F.lit(0), F.col("_k") - 1), lambda v: F.struct(F.least(v, F.col("_own")).alias("u"), F.greatest(v, F.col("_own")).alias("v")))
    placed = dealt.select("grp", "_own", "s", "c", F.explode(meets).alias("t")).select("grp", "t.u", "t.v", "_own", "s", "c")
    kind = rows.schema["grp"].dataType.simpleString()

    def tile(part: pd.DataFrame) -> pd.DataFrame:
        part, u, v = part.sort_values("s"), part["u"].iloc[0], part["v"].iloc[0]
        a, b = part[part["_own"] == u], part[part["_own"] == v]
        strings, others, c, c_others = a["s"].tolist(), b["s"].tolist(), a["c"].to_numpy(), b["c"].to_numpy()
        n, total, least, most = 0, 0, None, None
        if u == v and (c > 1).any():
            n, least, most = int((c * (c - 1) // 2).sum()), 0, 0
        for at in range(0, len(strings), SIDE):
            first = at if u == v else 0
            for own, d in blocks.edit_block(strings[at : at + SIDE], others[first:]):
                counts = c[at : at + SIDE][own, None] * c_others[first:]
                if u == v:
                    # Of the strings of one part those behind each one.
                    counts *= np.arange(d.shape[1]) > np.arange(own.start, own.stop)[:, None]
                if counts.any():
                    some = d[counts > 0]
                    n, total = n + int(counts.sum()), total + int((counts * d).sum())
                    least, most = min(int(some.min()), int(some.max()) if least is None else least), max(int(some.max()), -1 if most is None else most)
        return pd.DataFrame({"grp": [part["grp"].iloc[0]], "n": [n], "total": [total], "least": pd.array([least], "Int64"), "most": pd.array([most], "Int64")})

    tiles = placed.groupBy("grp", "u", "v").applyInPandas(tile, f"grp {kind}, n long, total long, least long, most long")
    sums = tiles.groupBy("grp").agg(F.sum("n").alias("n"), F.min("least").alias("least"), (F.sum("total") / F.sum("n")).alias("mean"), F.max("most").alias("most"))
    return sums.filter("n > 0")


def intra_class(edges: DataFrame, leaves: DataFrame) -> DataFrame:
    """(parent, n, least, mean, most) of the distances between any two leaves of a small ball."""
    own = edges.filter(F.col("layer") == SMALL).select(F.col("parent").alias("grp"), F.col("child").alias("id")).join(shuffled(leaves), "id")
    return pair_stats(own).withColumnRenamed("grp", "parent")


def inter_class(nodes: DataFrame) -> DataFrame:
    """(n, least, mean, most) of the distances between any two centers of small balls: the other
    side of intra_class. No row where there are fewer than two."""
    centers = nodes.filter(F.col("layer") == SMALL).select(F.lit(0).alias("grp"), F.col("node_id").alias("id"), F.col("center").alias("s"))
    return pair_stats(centers).drop("grp")
