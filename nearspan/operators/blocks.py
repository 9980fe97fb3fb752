"""Distances of blocks of objects to all of a small set (pivots), as arrays inside tasks.

Distinct objects are dealt into groups of SIDE, similar strings together; a group meets the set
in one task (cogroup), so pairs are never rows. Strings go in order, and a string shares the
rows of the distance matrix of its beginning with the one before it.

Where both sides are large they are packed into tiles, and each pair of tiles meets in one row
of a Cartesian product: nothing is shuffled, and results leave a task as they are found.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from os.path import commonprefix

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import euclidean
from ..sources.tables import materialise

#: Objects of one group, and matrix cells that a task holds at once.
SIDE, CELLS = 2048, 1 << 25
#: Vectors of one tile at most, rows from which there are several, and pairs that a task looks at at once.
TILE_VECTORS, LEAST_TILE, PAIRS = 8192, 512, 1 << 21
#: Distances that are summed up at once.
CACHED = 1 << 15
#: Bytes after which a batch of pairs of tiles ends.
TILE_BATCH = "8m"


def edit_rows(strings: list[str], others: list[str]) -> Iterator[np.ndarray]:
    """For each string its Levenshtein distances (code points) to all others."""
    size = np.array([len(x) for x in others], np.int64)
    wide, n = int(size.max(initial=0)), len(others)
    kind = np.int16 if wide + max(map(len, strings), default=0) < 1 << 14 else np.int32
    grid = np.zeros((wide, n), np.uint32)
    for i, x in enumerate(others):
        grid[: len(x), i] = np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32)
    # Rows are kept less their column number, so that gaps along a row are running minima.
    stack, masks, before, at, one = [np.zeros((wide + 1, n), kind)], {}, "", np.arange(n), kind(1)
    for s in strings:
        same = len(commonprefix([before, s]))
        del stack[same + 1 :]
        for i in range(same, len(s)):
            mask = masks.get(s[i])
            if mask is None:
                if len(masks) >= 64:
                    masks.clear()
                mask = masks[s[i]] = (grid != ord(s[i])).astype(kind) - one
            row = stack[-1]
            new = np.empty_like(row)
            new[0] = i + 1
            np.add(row[:-1], mask, out=new[1:])
            np.minimum(new[1:], row[1:] + one, out=new[1:])
            for j in range(1, wide + 1):
                np.minimum(new[j], new[j - 1], out=new[j])
            stack.append(new)
        before = s
        yield (stack[-1][size, at] + size).astype(np.int64)


def edit_block(objects: list[str], others: list[str]) -> Iterator[tuple[slice, np.ndarray]]:
    """(rows of objects, distances [rows, others]) of sorted strings, bounded in memory."""
    deep = (max(map(len, objects), default=0) + 65) * (max(map(len, others), default=0) + 1)
    step = max(CELLS // deep, 1)
    for a in range(0, len(objects), 256):
        part = objects[a : a + 256]
        yield slice(a, a + len(part)), np.hstack([np.array(list(edit_rows(part, others[b : b + step]))) for b in range(0, len(others), step)])


def near_any(objects: list[str], others: list[str], radius: float) -> np.ndarray:
    """Which of the others are within radius of any object, for few objects and many others."""
    objects, out = sorted(objects), np.zeros(len(others), bool)
    step = max(CELLS // ((max(map(len, objects), default=0) + 65) * (max(map(len, others), default=0) + 1)), 1)
    for b in range(0, len(others), step):
        for d in edit_rows(objects, others[b : b + step]):
            out[b : b + step] |= d <= radius
    return out


def vector_block(objects: list, others: list) -> Iterator[tuple[slice, np.ndarray]]:
    """The same for vectors, over the shorter of two lengths; NaN where an element is null. Squares
    are summed up in order of the elements, for some rows at a time that stay in the cache."""
    (a, a_own), (b, b_own) = (grid(pa.chunked_array([pa.array(rows, pa.list_(pa.float64()))])) for rows in (objects, others))
    wide = min(a.shape[1], b.shape[1])
    a, b, a_own, b_own = a[:, :wide], b[:, :wide].T.copy(), a_own[:, :wide], b_own[:, :wide].T
    whole = a_own.all() and b_own.all()
    step = max(1, CACHED // max(len(others), 1))
    for i in range(0, len(objects), step):
        x = a[i : i + step]
        out, gap = np.zeros((len(x), len(others))), np.empty((len(x), len(others)))
        for c in range(wide):
            np.subtract(x[:, c, None], b[c], out=gap)
            if not whole:
                gap[~(a_own[i : i + step, c, None] & b_own[c])] = 0.0
            np.multiply(gap, gap, out=gap)
            out += gap
        yield slice(i, i + len(out)), np.sqrt(out)


def edit_pairs(left: DataFrame, right: DataFrame, t: int) -> DataFrame:
    """(ls, rs, dist) of distinct strings (ls) and (rs) within t edits, without an index: groups of
    left strings meet tiles of right ones in tasks of their own, and only pairs within t leave them."""
    held = materialise(left.filter(F.col("ls").isNotNull()), "left")
    other = materialise(right.filter(F.col("rs").isNotNull()), "right")
    groups, tiles = max(-(-held.count() // SIDE), 1), max(-(-other.count() // SIDE), 1)
    dealt = held.repartitionByRange(groups, "ls").withColumn("_u", F.spark_partition_id()).withColumn("_v", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))))
    met = other.withColumn("_y", F.pmod(F.xxhash64("rs"), F.lit(tiles)).cast("int")).withColumn("_x", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        a, b, parts = a.sort_by("ls").column("ls"), b.column("rs"), []
        if len(a) and len(b):
            for own, d in edit_block(a.to_pylist(), b.to_pylist()):
                i, j = np.nonzero(d <= t)
                parts.append(pa.table({"ls": a.take(pa.array(i + own.start)), "rs": b.take(pa.array(j)), "dist": pa.array(d[i, j].astype(np.int32))}))
        return pa.concat_tables(parts) if parts else pa.table({"ls": a.slice(0, 0), "rs": b.slice(0, 0), "dist": pa.array([], pa.int32())})

    # A stated number of partitions: small rows, but much work, so they are not to be merged.
    parts = min(groups * tiles, 2000)
    return dealt.repartition(parts, "_u", "_v").groupBy("_u", "_v").cogroup(met.repartition(parts, "_x", "_y").groupBy("_x", "_y")).applyInArrow(run, "ls string, rs string, dist int")


def pack(df: DataFrame, rows: int, name: str) -> DataFrame:
    """df as a table of tiles (tile): up to `rows` rows of a partition as Arrow bytes."""

    def tile(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(pa.Table.from_batches(held).combine_chunks())
        return pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["tile"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            while batch.num_rows:
                held.append(batch.slice(0, rows - n))
                batch, n = batch.slice(held[-1].num_rows), n + held[-1].num_rows
                if n == rows:
                    yield tile(held)
                    held, n = [], 0
        if held:
            yield tile(held)

    # A file for each tile, so that a task reads one at a time.
    return materialise(df.mapInArrow(run, "tile binary"), name, 1)


def meet(left: DataFrame, right: DataFrame, ready: Callable, run: Callable, ddl: str) -> DataFrame:
    """The batches of run(ready(left tile), right tile) for every pair of tiles."""
    left.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", TILE_BATCH)
    read = lambda x: pa.ipc.open_stream(x).read_all()

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = own = None
        for batch in batches:
            for a, b in zip(batch.column(0), batch.column(1), strict=True):
                if own is None or a.as_buffer() != last:
                    last = a.as_buffer()
                    own = ready(read(last))
                yield from run(own, read(b.as_buffer()))

    both = left.select(F.col("tile").alias("l")).hint("shuffle_replicate_nl").crossJoin(right.select(F.col("tile").alias("r")))
    return both.mapInArrow(pairs, ddl)


def flat(column: pa.ChunkedArray) -> pa.Array:
    held = column.combine_chunks()
    return held.chunk(0) if isinstance(held, pa.ChunkedArray) else held


def grid(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors [rows, longest] as doubles with zeros behind the shorter ones, and which cells are
    theirs; a null element is NaN."""
    held = flat(column)
    size = held.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    own = np.arange(size.max(initial=0)) < size[:, None]
    out = np.zeros(own.shape)
    out[own] = held.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    return out, own


def _squares(a: np.ndarray, a_own: np.ndarray, b: np.ndarray, b_own: np.ndarray) -> np.ndarray:
    """Squared distances over the shorter of two lengths, by a product of matrices."""
    n = min(a.shape[1], b.shape[1])
    a, b, a_own, b_own = a[:, :n], b[:, :n], a_own[:, :n], b_own[:, :n]
    d = (-2 * a) @ b.T
    if a_own.all() and b_own.all():
        d += (a * a).sum(1)[:, None]
        d += (b * b).sum(1)
        return d
    return d + (a * a) @ b_own.T.astype(float) + a_own.astype(float) @ (b * b).T


def _summed(a: np.ndarray, a_own: np.ndarray, b: np.ndarray, b_own: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Distances of a[i] and b[j], summed up in order of the elements as Spark does."""
    total = np.zeros(len(i))
    for c in range(min(a.shape[1], b.shape[1])):
        gap = a[:, c][i] - b[:, c][j]
        if not (a_own[:, c].all() and b_own[:, c].all()):
            gap = np.where(a_own[:, c][i] & b_own[:, c][j], gap, 0.0)
        total += gap * gap
    return np.sqrt(total)


def _near_in_tiles(tile: tuple, asked: pa.Table, k: int | None) -> Iterator[pa.RecordBatch]:
    ids, rank, y, y_own, ball, c, c_own, radius = tile
    q_ids, (x, x_own), bounds = flat(asked["q_id"]), grid(asked["q"]), asked["bound"].to_numpy()
    # What a product of matrices may be wrong by, many times over.
    slack = 1e-11 * sum(float((v * v).sum(1).max(initial=0)) for v in (x, y, c))
    step = max(1, PAIRS // len(y))
    for at in range(0, len(x), step):
        q, q_own, bound = x[at : at + step], x_own[at : at + step], bounds[at : at + step, None]
        dq = np.sqrt(np.maximum(_squares(q, q_own, c, c_own), 0))
        cols = np.flatnonzero((~(dq - radius > bound + math.sqrt(slack))).any(0)[ball])
        some, some_own = y[cols], y_own[cols]
        d = _squares(q, q_own, some, some_own)
        limit = bound * bound + slack
        if k is not None and len(cols) > k:
            limit = np.minimum(limit, np.partition(d, k - 1, axis=1)[:, k - 1 : k] + 2 * slack)
        i, j = np.nonzero(~(d > limit))
        d = _summed(q, q_own, some, some_own, i, j)
        kept = d <= bound[i, 0]
        i, j, d = i[kept], cols[j[kept]], d[kept]
        if k is not None:
            order = np.lexsort((rank[j], d, i))
            i, j, d = i[order], j[order], d[order]
            kept = np.arange(len(i)) - np.searchsorted(i, i) < k
            i, j, d = i[kept], j[kept], d[kept]
        if len(i):
            yield pa.RecordBatch.from_arrays([q_ids.take(pa.array(at + i)), ids.take(pa.array(j)), pa.array(d)], names=["q_id", "id", "dist"])


def vectors_near(queries: DataFrame, objects: DataFrame, k: int | None = None) -> DataFrame:
    """(q_id, id, dist) of queries (q_id, q, at, bound) and objects (id, obj, pivot_id, center,
    radius) within a query's bound; with k at most the first k of each tile, ties by id. Similar
    queries (at) and members of a ball (pivot_id) share tiles. Balls that no query of some rows
    opens are left out; a product of matrices leaves few pairs, whose distances are summed up as
    functions.vectors.euclidean does. A pair without a distance (null, NaN) is no row."""
    kinds = dict(queries.dtypes) | dict(objects.dtypes)
    cores = objects.sparkSession.sparkContext.defaultParallelism

    def tiles(df: DataFrame, name: str, *by: str) -> DataFrame:
        parts = max(1, min(-(-df.count() // LEAST_TILE), 2 * cores))
        return pack(df.repartitionByRange(parts, *by).sortWithinPartitions(*by), TILE_VECTORS, name)

    def ready(own: pa.Table) -> tuple:
        pivot, ids = flat(own["pivot_id"]), flat(own["id"])
        first = np.flatnonzero(np.r_[True, pc.not_equal(pivot[1:], pivot[:-1]).to_numpy(zero_copy_only=False)])
        ball = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(ids)]))
        some = own.take(pa.array(first))
        rank = pc.rank(ids, sort_keys="ascending", tiebreaker="first").to_numpy()
        return ids, rank, *grid(own["obj"]), ball, *grid(some["center"]), some["radius"].to_numpy().astype(np.float64)

    real = objects.filter(F.col("obj").isNotNull() & F.col("center").isNotNull())
    held = tiles(real.select("id", "obj", "pivot_id", "center", "radius"), "objects", "pivot_id", "id")
    asked = tiles(queries.select("q_id", "q", F.col("bound").cast("double").alias("bound"), "at"), "queries", "at", "q_id")
    return meet(held, asked, ready, lambda tile, own: _near_in_tiles(tile, own, k), f"q_id {kinds['q_id']}, id {kinds['id']}, dist double")


KERNELS = {F.levenshtein: edit_block, euclidean: vector_block}


def against(objects: DataFrame, others: DataFrame, metric: Callable, fold: Callable[[np.ndarray, pa.Table], dict[str, pa.Array]], ddl: str) -> DataFrame:
    """(obj, columns of ddl) for each distinct object that is not null, where fold makes the
    columns of distances [objects, others] and the others' rows (pivot_id, center, ...) in
    order of pivot_id. Only for metrics of KERNELS."""
    kernel = KERNELS[metric]
    distinct = materialise(objects.select("obj").filter(F.col("obj").isNotNull()).distinct(), "distinct")
    groups = max(-(-distinct.count() // SIDE), 1)
    dealt = materialise(distinct.repartitionByRange(groups, "obj").withColumn("_g", F.spark_partition_id()), "dealt")
    sides = dealt.select(F.col("_g").alias("_h")).distinct().crossJoin(others.filter(F.col("center").isNotNull()))
    kind = distinct.schema["obj"].dataType.simpleString()

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        left, right = left.sort_by("obj") if kind == "string" else left, right.sort_by("pivot_id")
        rows, centers, parts = left.column("obj").to_pylist(), right.column("center").to_pylist(), []
        if centers:
            for own, d in kernel(rows, centers):
                parts.append(pa.table({"obj": left.column("obj").slice(own.start, own.stop - own.start), **fold(d, right)}))
        return pa.concat_tables(parts) if parts else pa.table({"obj": left.column("obj").slice(0, 0), **fold(np.zeros((0, 1)), right)})

    # A stated number of partitions: small rows, but much work, so they are not to be merged.
    return dealt.repartition(groups, "_g").groupBy("_g").cogroup(sides.repartition(groups, "_h").groupBy("_h")).applyInArrow(run, f"obj {kind}, {ddl}")
