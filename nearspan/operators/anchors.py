"""Anchor retrieval: distance bands around anchors, intersected by relational division.

Objects are (pos, seq). Distances between the anchors and the distinct strings are computed
once; copies of a string share them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.strings import band, bounded_distance, window_distance
from ..sources.tables import materialise, spread
from . import blocks
from .generate import draw
from .search import edit_join, small

#: Objects and queries of one tile, and pairs of a batch that leaves a task.
TILE_OBJECTS, TILE_QUERIES, PAIRS = 1 << 15, 1 << 11, 1 << 18


def random_anchors(objects: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """n distinct strings in the order of a seeded hash: (anchor_id, seq)."""
    some = objects.select("seq").distinct().orderBy(F.xxhash64("seq", F.lit(seed)), "seq").limit(n)
    rows = some.withColumn("anchor_id", F.row_number().over(Window.orderBy(F.xxhash64("seq", F.lit(seed)), "seq")) - 1)
    return rows.select("anchor_id", "seq")


def record_anchors(refs: DataFrame, k: int, per_record: int, seed: int = 42) -> DataFrame:
    """per_record random places of each reference (repeats are possible): (anchor_id, seq);
    references shorter than k give none."""
    place = F.pmod(F.xxhash64("ref_id", F.col("i"), F.lit(seed)), F.length("seq") - k + 1)
    some = refs.filter(F.length("seq") >= k).withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(per_record)))).withColumn("off", place)
    return some.select(F.concat_ws("|off=", F.col("ref_id").cast("string"), F.col("off").cast("string")).alias("anchor_id"), F.expr(f"substring(seq, cast(off as int) + 1, {k})").alias("seq"))


def build_index(anchors: DataFrame, objects: DataFrame, max_store: int | None = None) -> DataFrame:
    """(anchor_id, pos, dist) of every anchor and object within max_store (None: all)."""
    # A stated number of partitions: small rows, but much work, so they are not to be merged.
    strings = objects.select("seq").distinct()
    strings = strings.repartition(4 * strings.sparkSession.sparkContext.defaultParallelism)
    pairs = small(anchors.select("anchor_id", F.col("seq").alias("a"))).crossJoin(strings)
    d = F.levenshtein("a", "seq") if max_store is None else bounded_distance(F.col("a"), F.col("seq"), max_store)
    scored = pairs.select("anchor_id", "seq", d.alias("dist")).filter("dist >= 0")
    return scored.join(objects.select("pos", "seq"), "seq").select("anchor_id", "pos", "dist")


def query_anchors(queries: DataFrame, anchors: DataFrame) -> DataFrame:
    """(q_id, anchor_id, d, rank): anchors of a query by distance; ties by anchor_id."""
    a = small(anchors.select("anchor_id", F.col("seq").alias("a")))
    scored = spread(queries).crossJoin(a).select("q_id", "anchor_id", F.levenshtein("q", "a").alias("d"))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("q_id").orderBy("d", "anchor_id")) - 1)


def select_anchors(ranked: DataFrame, start: int | None = None, end: int | None = None, last_random: bool = False, seed: int = 42) -> DataFrame:
    """All anchors, or ranks start <= rank < end; with last_random the last one of the slice
    is a draw from the whole slice (it can repeat one)."""
    if start is None or end is None:
        return ranked
    cut = ranked.filter((F.col("rank") >= start) & (F.col("rank") < end))
    if not last_random:
        return cut
    drawn = Window.partitionBy("q_id").orderBy(draw(F.col("q_id"), F.col("rank"), F.lit(seed)), "rank")
    size = F.count("*").over(Window.partitionBy("q_id"))
    one = cut.withColumn("_i", F.row_number().over(drawn)).filter("_i = 1").drop("_i")
    return cut.withColumn("_n", size).filter(F.col("rank") < start + F.col("_n") - 1).drop("_n").unionByName(one)


def band_sizes(selected: DataFrame, index: DataFrame, t: int) -> DataFrame:
    """(q_id, anchor_id, low, high, size) of the selected anchors whose band has any object."""
    low, high = band(F.col("d"), t)
    asked = selected.select("q_id", "anchor_id", low.alias("low"), high.alias("high")).distinct()
    # Distances of an anchor are few, whatever the number of objects.
    counted = index.groupBy("anchor_id", "dist").agg(F.count("*").alias("n"))
    met = asked.join(small(counted), "anchor_id").filter(F.col("dist").between(F.col("low"), F.col("high")))
    return met.groupBy("q_id", "anchor_id", "low", "high").agg(F.sum("n").alias("size"))


def candidates(selected: DataFrame, index: DataFrame, t: int) -> DataFrame:
    """(q_id, pos) in the band of every selected anchor whose band is not empty. Objects with
    their distances as an array by anchor number, and queries with their bands, are packed into
    tiles; in a pair of tiles a band is bits over the objects, and a query's bands are met by
    their bits, the rarest first, until none is left. Pairs are never shuffled."""
    numbers = index.select("anchor_id").distinct().withColumn("no", (F.row_number().over(Window.orderBy("anchor_id")) - 1).cast("int"))
    numbers = materialise(numbers, "anchor-numbers")  # a row for each anchor
    n, kinds = numbers.count(), dict(selected.dtypes) | dict(index.dtypes)
    bands = band_sizes(selected, index, t).join(small(numbers), "anchor_id")
    rule = F.struct("size", "no", F.col("low").cast("int").alias("low"), F.col("high").cast("int").alias("high"))
    rules = bands.groupBy("q_id").agg(F.array_sort(F.collect_list(rule)).alias("rules"))
    entry = F.struct("no", F.col("dist").cast("int").alias("dist"))
    objects = index.join(small(numbers), "anchor_id").groupBy("pos").agg(F.collect_list(entry).alias("e"))

    def ready(own: pa.Table) -> tuple:
        held = blocks.flat(own["e"])
        seen = np.full((n, len(held)), -1, np.int32)
        cells = held.flatten()
        row = np.repeat(np.arange(len(held)), held.value_lengths().to_numpy(zero_copy_only=False))
        seen[cells.field("no").to_numpy(zero_copy_only=False), row] = cells.field("dist").to_numpy(zero_copy_only=False)
        return blocks.flat(own["pos"]), seen, {}

    def run(tile: tuple, asked: pa.Table) -> Iterator[pa.RecordBatch]:
        pos, seen, bits_of = tile
        q_ids, rules = blocks.flat(asked["q_id"]), blocks.flat(asked["rules"])
        ends, cells = np.r_[0, np.cumsum(rules.value_lengths().to_numpy(zero_copy_only=False))].tolist(), rules.flatten()
        keys = list(zip(*(cells.field(c).to_pylist() for c in ("no", "low", "high")), strict=True))
        found, owners, held = [], [], 0

        def batch() -> pa.RecordBatch:
            q = np.repeat(np.array(owners), [len(f) for f in found])
            return pa.RecordBatch.from_arrays([q_ids.take(pa.array(q)), pos.take(pa.array(np.concatenate(found)))], names=["q_id", "pos"])

        for q, (a, b) in enumerate(zip(ends, ends[1:], strict=False)):
            bits = None
            for key in keys[a:b]:
                new = bits_of.get(key)
                if new is None:
                    no, low, high = key
                    new = bits_of[key] = np.packbits((seen[no] >= low) & (seen[no] <= high))
                bits = new if bits is None else bits & new
                if not bits.any():
                    break
            inside = np.flatnonzero(np.unpackbits(bits, count=len(pos)))
            if len(inside):
                found.append(inside), owners.append(q)
                held += len(inside)
            if held >= PAIRS:
                yield batch()
                found, owners, held = [], [], 0
        if held:
            yield batch()

    # A row of many numbers: Arrow batches of few rows.
    index.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", blocks.TILE_BATCH)
    held = blocks.pack(spread(objects), TILE_OBJECTS, "object-tiles")
    asked = blocks.pack(spread(rules), TILE_QUERIES, "query-tiles")
    return blocks.meet(held, asked, ready, run, f"q_id {kinds['q_id']}, pos {kinds['pos']}")


def anchor_accesses(selected: DataFrame, index: DataFrame, found: DataFrame | None, t: int) -> DataFrame:
    """(q_id, index_accesses, candidate_accesses): entries of all bands, and candidates: those
    found, or (None) counted without a list."""
    entries = band_sizes(selected, index, t).groupBy("q_id").agg(F.sum("size").alias("index_accesses"))
    kept = count_candidates(selected, index, t) if found is None else found.groupBy("q_id").agg(F.count("*").alias("candidate_accesses"))
    return entries.join(kept, "q_id", "left").na.fill(0, ["candidate_accesses"]).select("q_id", "index_accesses", "candidate_accesses")


def count_candidates(selected: DataFrame, index: DataFrame, t: int) -> DataFrame:
    """(q_id, candidate_accesses): how many objects `candidates` has for each query, none of them
    a row. Objects of equal distances to all anchors are one with a count. They are dealt into
    tiles; for an anchor and a distance the objects of a band are bits, and a query's bands are
    met by their bits. Queries with equal rules are counted once."""
    asked = band_sizes(selected, index, t).groupBy("q_id").agg(F.array_sort(F.collect_list(F.struct("anchor_id", "low", "high"))).alias("rules"))
    asked = materialise(asked.withColumn("k", F.sha2(F.to_json("rules"), 256)), "bands")
    rules = materialise(asked.groupBy("k").agg(F.first("rules").alias("rules")), "rules")
    kinds = materialise(index.groupBy("pos").agg(F.array_sort(F.collect_list(F.struct("anchor_id", "dist"))).alias("e")).groupBy("e").agg(F.count("*").alias("n")), "kinds")
    tiles, sides = -(-kinds.count() // TILE_OBJECTS), -(-rules.count() // TILE_QUERIES)
    if not tiles or not sides:
        return asked.select("q_id", F.lit(0).cast("long").alias("candidate_accesses"))
    dealt = kinds.select(F.pmod(F.xxhash64("e"), F.lit(tiles)).alias("u"), "e", "n").withColumn("v", F.explode(F.sequence(F.lit(0), F.lit(sides - 1))))
    met = rules.select(F.pmod(F.xxhash64("k"), F.lit(sides)).alias("v"), "k", "rules").withColumn("u", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        held, n = left.column("e").combine_chunks(), left.column("n").to_numpy()
        if isinstance(held, pa.ChunkedArray):
            held = held.chunk(0) if held.num_chunks else pa.array([], held.type)
        flat = held.flatten()
        row = np.repeat(np.arange(len(held)), held.value_lengths().to_numpy(zero_copy_only=False))
        anchor, dist = flat.field("anchor_id").to_numpy(zero_copy_only=False), flat.field("dist").to_numpy(zero_copy_only=False)
        order = np.argsort(anchor, kind="stable")
        names, first = np.unique(anchor[order], return_index=True)
        places = dict(zip(names.tolist(), np.split(order, first[1:]), strict=True))
        bands: dict = {}

        def band_bits(a, low, high) -> np.ndarray:
            bits = bands.get((a, low, high))
            if bits is None:
                inside = np.zeros(len(held), bool)
                at = places.get(a, order[:0])
                inside[row[at[(dist[at] >= low) & (dist[at] <= high)]]] = True
                bits = bands[a, low, high] = np.packbits(inside)
            return bits

        keys, counts, single = right.column("k").to_pylist(), [], bool((n == 1).all())
        for own in right.column("rules").to_pylist() if len(n) else []:
            bits = None
            for x in own:
                new = band_bits(x["anchor_id"], x["low"], x["high"])
                bits = new if bits is None else bits & new
            counts.append(int(np.bitwise_count(bits).sum()) if single else int(n[np.unpackbits(bits, count=len(n)).astype(bool)].sum()))
        return pa.table({"k": pa.array(keys if counts else [], pa.string()), "c": pa.array(counts, pa.int64())})

    parts = min(tiles * sides, 2000)
    counted = dealt.repartition(parts, "u", "v").groupBy("u", "v").cogroup(met.repartition(parts, "u", "v").groupBy("u", "v")).applyInArrow(run, "k string, c long")
    return asked.join(counted.groupBy("k").agg(F.sum("c").alias("c")), "k", "left").select("q_id", F.coalesce("c", F.lit(0)).alias("candidate_accesses"))


def retained(queries: DataFrame, kept: DataFrame) -> DataFrame:
    """(n_queries, n_kept, percent) of a filter of queries."""
    both = queries.agg(F.count("*").alias("n_queries")).crossJoin(kept.agg(F.count("*").alias("n_kept")))
    return both.select("n_queries", "n_kept", F.when(F.col("n_queries") > 0, 100 * F.col("n_kept") / F.col("n_queries")).otherwise(F.lit(0.0)).alias("percent"))


def retrieve_batch(queries: DataFrame, anchors: DataFrame, retrieve: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """retrieve(queries) with the queries of one nearest anchor side by side; without anchors
    they go as they are. Results are those of single queries."""
    if anchors.isEmpty():
        return retrieve(queries)
    return retrieve(queries.join(group_queries(queries, anchors), "q_id").repartition("bucket").sortWithinPartitions("bucket", "q_id").drop("bucket"))


def conjunctive(refs: DataFrame, anchors: DataFrame, thresholds: DataFrame) -> DataFrame:
    """References (ref_id, seq) where every anchor (anchor_id, seq) of thresholds (anchor_id,
    most) has a window within its threshold; unknown anchors count for nothing."""
    wanted = small(anchors.select("anchor_id", F.col("seq").alias("a")).join(thresholds, "anchor_id"))
    far = refs.crossJoin(wanted).filter(window_distance(F.col("a"), F.col("seq")) > F.col("most"))
    return refs.join(far.select("ref_id").distinct(), "ref_id", "left_anti")


def has_near_anchor(queries: DataFrame, anchors: DataFrame, t: int) -> DataFrame:
    """Queries with an anchor nearer than t."""
    near = edit_join(queries.select(F.col("q_id").alias("id"), F.col("q").alias("s")), anchors.select(F.col("anchor_id").alias("id"), F.col("seq").alias("s")), t - 1)
    return queries.join(near.select(F.col("l_id").alias("q_id")).distinct(), "q_id", "left_semi")


def near_anchors(queries: DataFrame, anchors: DataFrame, t: int = 5) -> DataFrame:
    """(q_id, anchor_id, dist) within t."""
    return edit_join(queries.select(F.col("q_id").alias("id"), F.col("q").alias("s")), anchors.select(F.col("anchor_id").alias("id"), F.col("seq").alias("s")), t).select(F.col("l_id").alias("q_id"), F.col("r_id").alias("anchor_id"), "dist")


def group_queries(queries: DataFrame, anchors: DataFrame) -> DataFrame:
    """(q_id, bucket): each query's nearest anchor, the first of equal ones."""
    a = small(anchors.select("anchor_id", F.col("seq").alias("a")))
    scored = spread(queries).crossJoin(a).select("q_id", "anchor_id", F.levenshtein("q", "a").alias("d"))
    return scored.groupBy("q_id").agg(F.min_by("anchor_id", F.struct("d", "anchor_id")).alias("bucket"))
