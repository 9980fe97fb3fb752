"""Range search under edit distance: windows of references, and tables of strings.

References are (ref_id, seq), queries (q_id, q), results (q_id, ref_id, pos, dist). The query
set is the small side: it is broadcast only up to BROADCAST_ROWS rows, else joined by shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.strings import bounded_distance
from ..sources.tables import materialise, spread
from .blocks import edit_pairs

BROADCAST_ROWS = 100_000
#: Positions in one page of a reference.
PAGE = 512
#: Radius from which segments are too short to help, and strings that a loop may then hold.
LOOP_RADIUS, LOOP_ROWS = 4, 20_000
#: Strings so few that a loop over them is linear in the other side, whatever the radius.
FEW = 500
#: Pairs from which that loop goes by blocks: its rows are too small for Spark to deal them out.
LOOP_PAIRS = 200_000
#: Radius and length up to which strings meet by what deletions leave of them.
DELETIONS, SHORT = 2, 40


def small(df: DataFrame) -> DataFrame:
    """df, marked for broadcast if it has at most BROADCAST_ROWS rows, else to be shuffled."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else shuffled(df)


def shuffled(df: DataFrame) -> DataFrame:
    """df, for a join that Spark is not to broadcast: it takes compressed files, or what an operator
    reads, for the size of a side, whatever the rows that are sent to the driver then."""
    return df.hint("merge")


def pages(refs: DataFrame, reach: int, ahead: int) -> DataFrame:
    """References cut into pages (ref_id, ref_len, base, left, part): positions base.. of one
    page with `reach` characters before and `ahead` after them in `part`, which begins at
    `left`. A long reference is worked on by many tasks, and places are found in short
    strings."""
    n = F.length("seq")
    cut = refs.filter(n > 0).select("ref_id", n.cast("int").alias("ref_len"), "seq", F.explode(F.sequence(F.lit(0), n - 1, F.lit(PAGE))).alias("base"))
    left = F.greatest(F.col("base") - reach, F.lit(0))
    at, size = left + 1, F.lit(PAGE + ahead) + F.col("base") - left
    # Bytes are found by address, characters by walking there: with one byte a character, as
    # in any genome, pages of a long sequence are cut in linear time.
    one_byte = F.octet_length("seq") == F.col("ref_len")
    part = F.when(one_byte, F.col("seq").cast("binary").substr(at, size).cast("string")).otherwise(F.col("seq").substr(at, size))
    return spread(cut.select("ref_id", "ref_len", "base", left.alias("left"), part.alias("part")))


def places(paged: DataFrame, width: int) -> DataFrame:
    """One row for each position `at` of a page where `width` characters are left."""
    last = F.least(F.col("base") + PAGE, F.col("ref_len") - width + 1) - 1
    return paged.filter(last >= F.col("base")).withColumn("at", F.explode(F.sequence("base", last)))


def kmers(refs: DataFrame, k: int) -> DataFrame:
    """(ref_id, pos, seq) of all windows of length k."""
    spots = places(pages(refs, 0, k), k)
    return spots.select("ref_id", F.col("at").alias("pos"), F.expr(f"substring(part, at - left + 1, {k})").alias("seq"))


def distinct_kmers(found: DataFrame) -> DataFrame:
    """One row for each distinct k-mer: its first place and how often it occurs."""
    return found.groupBy("seq").agg(F.min(F.struct("ref_id", "pos")).alias("first"), F.count("*").alias("n"))


def exact_occurrences(queries: DataFrame, refs: DataFrame, k: int) -> DataFrame:
    """All places, overlapping ones too, of queries of length k."""
    from .spectrum import kmers_among

    found = kmers_among(refs, k, queries.filter(F.length("q") == k).select(F.col("q").alias("seq")))
    return found.join(small(queries), F.col("seq") == F.col("q")).select("q_id", "ref_id", "pos")


def seeds(queries: DataFrame, k: int, length: int, count: int) -> DataFrame:
    """`count` disjoint seeds of each query (of length k): (q_id, q, offset, seed)."""
    starts = F.array(*[F.lit(i * length) for i in range(count)])
    return queries.filter(F.length("q") == k).select("q_id", "q", F.explode(starts).alias("offset")).withColumn("seed", F.expr(f"substring(q, offset + 1, {length})"))


def seed_hits(queries: DataFrame, refs: DataFrame, k: int, length: int, count: int, slack: int = 0) -> DataFrame:
    """Exact hits of the seeds: (q_id, q, ref_id, ref_len, offset, at, left, part). part is
    the page around the hit that windows within `slack` of its diagonal need."""
    spots = places(pages(refs, k + slack, k + slack), length)
    cut = spots.withColumn("seed", F.expr(f"substring(part, at - left + 1, {length})"))
    return cut.join(small(seeds(queries, k, length, count)), "seed").select("q_id", "q", "ref_id", "ref_len", "offset", "at", "left", "part")


def seed_counts(refs: DataFrame, length: int) -> DataFrame:
    """(seed, n): the places of each string of this length; hits of short seeds are far more
    rows than these."""
    spots = places(pages(refs, 0, length), length)
    return spots.select(F.expr(f"substring(part, at - left + 1, {length})").alias("seed")).groupBy("seed").agg(F.count("*").alias("n"))


def diagonal_candidates(hits: DataFrame, k: int, slack: int) -> DataFrame:
    """Windows on the hits' diagonals, moved by up to `slack`: (q_id, q, ref_id, pos, window)."""
    shifts = F.array(*[F.lit(s) for s in range(-slack, slack + 1)])
    moved = hits.withColumn("pos", F.col("at") - F.col("offset")).withColumn("pos", F.explode(F.transform(shifts, lambda s: F.col("pos") + s)))
    inside = moved.filter((F.col("pos") >= 0) & (F.col("pos") + k <= F.col("ref_len")))
    return inside.select("q_id", "q", "ref_id", "pos", F.expr(f"substring(part, pos - left + 1, {k})").alias("window"))


def range_search(queries: DataFrame, refs: DataFrame, k: int, t: int) -> DataFrame:
    """All windows of length k within t edits of a query of length k, exactly. By the
    pigeonhole principle one of t + 1 disjoint seeds stands unchanged in a match, at most
    t div 2 off its diagonal, as insertions and deletions must balance."""
    if k // (t + 1) < 1:
        return nested_loop(queries, kmers(refs, k), t)
    found = diagonal_candidates(seed_hits(queries, refs, k, k // (t + 1), t + 1, t // 2), k, t // 2)
    scored = found.withColumn("dist", bounded_distance(F.col("q"), F.col("window"), t)).filter("dist >= 0")
    return scored.groupBy("q_id", "ref_id", "pos").agg(F.first("dist").alias("dist"))


def nested_loop(queries: DataFrame, found: DataFrame, t: int) -> DataFrame:
    """The same over k-mers by comparing every pair: the baseline, for small query sets."""
    pairs = found.join(small(queries), F.levenshtein(F.col("q"), F.col("seq"), t) >= 0)
    return pairs.select("q_id", "ref_id", "pos", F.levenshtein("q", "seq").alias("dist"))


def truth(queries: DataFrame, refs: DataFrame, k: int, max_dist: int) -> DataFrame:
    """True places: windows within max_dist div 2 edits."""
    return range_search(queries, refs, k, max_dist // 2).select("q_id", "ref_id", "pos")


def sae_candidates(queries: DataFrame, refs: DataFrame, k: int, max_dist: int, verify: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """Seed and extend: non-overlapping seeds of length k div max_dist, their exact hits, and
    the window on each hit's diagonal; verified within max_dist unless told otherwise. keep
    names further columns of the result (q, window)."""
    length = max(k // max_dist, 1) if max_dist > 0 else k
    hits = seed_hits(queries, refs, k, length, k // length)
    found = diagonal_candidates(hits, k, 0).dropDuplicates(["q_id", "ref_id", "pos"])
    scored = found.withColumn("dist", bounded_distance(F.col("q"), F.col("window"), max_dist) if verify else F.levenshtein("q", "window"))
    return (scored.filter("dist >= 0") if verify else scored).select("q_id", "ref_id", "pos", "dist", *keep)


def remains(strings: DataFrame, t: int) -> DataFrame:
    """(s, h): hashes of what is left of each string (s, at most SHORT characters) after up to t
    (at most 2) deletions. Strings within t edits share one of them: a common subsequence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u = np.uint64
        base, back = u(0x9E3779B97F4A7C15), u(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
        powers = np.multiply.accumulate(np.r_[u(1), np.full(SHORT, base)])
        for batch in batches:
            held = batch.column("s").to_pylist()
            size = np.array([len(x) for x in held])
            for n in np.unique(size).tolist():
                rows = np.flatnonzero(size == n)
                for few in np.array_split(rows, len(rows) // 1024 + 1):
                    codes = np.frombuffer("".join(held[i] for i in few).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(few), n)
                    sums = np.zeros((len(few), n + 1), u)
                    np.cumsum((codes.astype(u) + u(1)) * powers[:n], axis=1, out=sums[:, 1:])
                    whole = sums[:, -1:]
                    left = [whole]
                    if t >= 1 and n >= 1:
                        left.append(sums[:, :-1] + (whole - sums[:, 1:]) * back)
                    if t >= 2 and n >= 2:
                        i, j = np.triu_indices(n, 1)
                        left.append(sums[:, i] + (sums[:, j] - sums[:, i + 1]) * back + (whole - sums[:, j + 1]) * u(int(back) ** 2 & (1 << 64) - 1))
                    every = np.sort(np.hstack(left), axis=1)
                    new = np.hstack([np.ones((len(few), 1), bool), every[:, 1:] != every[:, :-1]])
                    own = np.repeat(few, new.sum(1))
                    yield pa.RecordBatch.from_arrays([batch.column("s").take(pa.array(own)), pa.array(every[new].view(np.int64))], names=["s", "h"])

    return spread(strings.select("s")).mapInArrow(run, "s string, h long")


def _by_remains(l: DataFrame, r: DataFrame, t: int) -> DataFrame:
    a = remains(l.filter(F.length("ls") <= SHORT + t).select(F.col("ls").alias("s")), t).withColumnRenamed("s", "ls") if t else l.select("ls", F.xxhash64("ls").alias("h"))
    b = remains(r.filter(F.length("rs") <= SHORT).select(F.col("rs").alias("s")), t).withColumnRenamed("s", "rs") if t else r.select("rs", F.xxhash64("rs").alias("h"))
    return a.join(shuffled(b), "h").select("ls", "rs")


def edit_join(left: DataFrame, right: DataFrame, t: int, loop: int | None = None) -> DataFrame:
    """(l_id, r_id, dist) of all pairs of strings (id, s) within t edits, by equi-joins only.

    Up to DELETIONS edits short strings meet by what deletions leave of them, which no common
    beginning makes frequent. Else a right string is cut into t + 1 even segments; of a match
    within t edits the left string holds one of them unchanged, at most t places off. Right
    strings too short for that are few and short, and meet left strings by length. A few right
    strings (up to `loop`, if given) meet all left ones in a loop. Equal strings are compared once."""
    l, r = left.groupBy(F.col("s").alias("ls")).agg(F.count("*").alias("_n")).select("ls"), right.select(F.col("s").alias("rs")).distinct()
    few = loop or (LOOP_ROWS if t >= LOOP_RADIUS else FEW)
    n = r.limit(few + 1).count() if t else few + 1
    if n <= few:
        if n * l.count() > LOOP_PAIRS:
            return _with_ids(edit_pairs(l, r, t), left, right)
        scored = l.join(F.broadcast(r), bounded_distance(F.col("ls"), F.col("rs"), t) >= 0).withColumn("dist", F.levenshtein("ls", "rs"))
        return _with_ids(scored, left, right)
    if t <= DELETIONS:
        near = _by_remains(l, r, t)
        long = r.filter(F.length("rs") > SHORT)
        if not long.isEmpty():
            near = near.union(_by_segments(l.filter(F.length("ls") > SHORT - t), long, t))
    else:
        near = _by_segments(l, r, t)
    scored = near.distinct().withColumn("dist", bounded_distance(F.col("ls"), F.col("rs"), t)).filter("dist >= 0")
    return _with_ids(scored, left, right)


def _by_segments(l: DataFrame, r: DataFrame, t: int) -> DataFrame:
    """(ls, rs) that share a segment, or are too short for that."""
    parts = t + 1
    n = F.length("rs")

    def segment(i: int) -> Column:
        a, b = F.floor(n * i / parts), F.floor(n * (i + 1) / parts)
        return F.struct(F.lit(i).alias("i"), F.expr(f"substring(rs, cast(floor(length(rs) * {i} / {parts}) as int) + 1, cast(floor(length(rs) * {i + 1} / {parts}) - floor(length(rs) * {i} / {parts}) as int))").alias("piece"), (b - a).alias("_w"))

    cut = r.filter(n > t).select("rs", n.alias("rn"), F.explode(F.array(*[segment(i) for i in range(parts)])).alias("g")).select("rs", "rn", "g.i", "g.piece")
    lengths = F.sequence(F.greatest(F.length("ls") - t, F.lit(parts)), F.length("ls") + t)
    probes = l.filter(F.length("ls") + t >= parts).select("ls", F.explode(lengths).alias("rn"))
    probes = probes.select("ls", "rn", F.explode(F.sequence(F.lit(0), F.lit(t))).alias("i"))
    probes = probes.withColumns({"a": F.floor(F.col("rn") * F.col("i") / parts).cast("int"), "b": F.floor(F.col("rn") * (F.col("i") + 1) / parts).cast("int")})
    probes = probes.withColumn("shift", F.explode(F.sequence(F.lit(-t), F.lit(t)))).withColumn("at", F.col("a") + F.col("shift"))
    probes = probes.filter((F.col("at") >= 0) & (F.col("at") + F.col("b") - F.col("a") <= F.length("ls"))).select("ls", "rn", "i", F.expr("substring(ls, at + 1, b - a)").alias("piece")).distinct()
    pairs = probes.join(shuffled(cut), ["rn", "i", "piece"]).select("ls", "rs").distinct()
    brief = l.filter(F.length("ls") <= 2 * t).select("ls", F.length("ls").alias("ln")).join(r.filter(n <= t).select("rs", n.alias("rn")), (F.abs(F.col("ln") - F.col("rn")) <= t)).select("ls", "rs")
    return pairs.union(brief)


def _with_ids(scored: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    named = scored.join(shuffled(left.select(F.col("id").alias("l_id"), F.col("s").alias("ls"))), "ls")
    return named.join(shuffled(right.select(F.col("id").alias("r_id"), F.col("s").alias("rs"))), "rs").select("l_id", "r_id", "dist")


def nearest(pairs: DataFrame, k: int | None, by: str, *ties: str) -> DataFrame:
    """The k rows (None: all) of least dist for each `by`, with their rank; ties by the columns
    named."""
    order = Window.partitionBy(by).orderBy("dist", *ties)
    ranked = pairs.withColumn("rank", F.row_number().over(order))
    return ranked if k is None else ranked.filter(F.col("rank") <= k)


def knn_edit(queries: DataFrame, objects: DataFrame, k: int) -> DataFrame:
    """k nearest strings of each query (fewer only where there are fewer): edit joins of
    growing radius, each for the queries that have no k neighbours yet, until none is left or
    the radius is the longest string's length, within which all strings are."""
    longest = max(queries.agg(F.max(F.length("s"))).first()[0] or 0, objects.agg(F.max(F.length("s"))).first()[0] or 0)
    t, left, done = 1, queries, None
    while True:
        found = materialise(edit_join(left, objects, t), "neighbours")
        full = found.groupBy("l_id").count().filter(F.col("count") >= k).select(F.col("l_id").alias("id"))
        last = t >= longest
        part = found if last else found.join(shuffled(full.withColumnRenamed("id", "l_id")), "l_id", "left_semi")
        done = part if done is None else done.unionByName(part)
        if last:
            break
        left = materialise(left.join(shuffled(full), "id", "left_anti"), "unanswered")
        if left.isEmpty():
            break
        t = min(2 * t, longest)
    return nearest(done, k, "l_id", "r_id")


def x_drop(queries: list[str], parts: list[str], q_at: np.ndarray, r_at: np.ndarray, length: int, drop: np.ndarray) -> np.ndarray:
    """Where the gapped extension of each seed (length characters at q_at of its query and at
    r_at of its part) begins on the part. The extension to the left of a seed is the best one
    of +1 for a match and -1 for a mismatch or gap over all prefixes; a cell that is more than
    `drop` below the best so far ends there. Among equal ones the shortest is taken. All seeds
    are extended at once, row by row."""
    n = len(queries)
    rows = int(q_at.max(initial=0))
    wide = rows + int(drop.max(initial=0)) + 1
    q, r = np.zeros((n, rows), np.uint32), np.full((n, wide), 1, np.uint32)  # 0 and 1 are no characters
    for i, (a, b, x, y) in enumerate(zip(queries, parts, q_at.tolist(), r_at.tolist(), strict=True)):
        left, right = a[:x][::-1], b[max(0, y - wide) : y][::-1]
        q[i, : len(left)] = np.frombuffer(left.encode("utf-32-le"), np.uint32)
        r[i, : len(right)] = np.frombuffer(right.encode("utf-32-le"), np.uint32)
    low, steps = -(1 << 20), np.arange(wide + 1)
    inside = (steps <= r_at[:, None]) & (steps <= wide)
    row = np.where(inside & (steps <= drop[:, None]), -steps, low)
    best, at = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i in range(1, rows + 1):
        new = row - 1
        new[:, 1:] = np.maximum(new[:, 1:], row[:, :-1] + np.where(r == q[:, i - 1 : i], 1, -1))
        new = np.maximum.accumulate(new + steps, axis=1) - steps  # gaps along the part
        new = np.where(inside & (i <= q_at)[:, None] & (new >= best[:, None] - drop[:, None]), new, low)
        top = new.argmax(1)
        value = new[np.arange(n), top]
        better = value > best
        best, at = np.where(better, value, best), np.where(better, top, at)
        row = new
    return r_at - at


def extended_candidates(queries: DataFrame, refs: DataFrame, k: int, max_dist: int) -> DataFrame:
    """(q_id, ref_id, pos): where the gapped X-drop extensions of the seeds' exact hits begin,
    X being 4 * max_dist; candidates are not verified."""
    length = max(k // max_dist, 1) if max_dist > 0 else k
    drop = 4 * max_dist
    hits = seed_hits(queries, refs, k, length, k // length, drop)
    kinds = dict(hits.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            at, left = batch.column("at").to_numpy(), batch.column("left").to_numpy()
            begin = x_drop(batch.column("q").to_pylist(), batch.column("part").to_pylist(), batch.column("offset").to_numpy().astype(np.int64), (at - left).astype(np.int64), length, np.full(batch.num_rows, drop))
            yield pa.RecordBatch.from_arrays([batch.column("q_id"), batch.column("ref_id"), pa.array((left + begin).astype(np.int32))], names=["q_id", "ref_id", "pos"])

    found = hits.select("q_id", "ref_id", "q", "offset", "at", "left", "part").mapInArrow(run, f"q_id {kinds['q_id']}, ref_id {kinds['ref_id']}, pos int")
    return found.distinct()
