"""MinHash near-dedup with ProbMinHash.

A text is the multiset of its five-word shingles. For each distinct shingle a Poisson
process, whose rate is the shingle's count, sends arrivals to registers chosen at random; a
register keeps the shingle that arrived first. A shingle's process ends as soon as its next
arrival is later than the latest register, so few arrivals are drawn. The share of equal
registers of two texts estimates their probability Jaccard similarity J_P.

Registers are cut into BANDS bands of ROWS; texts that agree in a band are candidates. In a
bucket every text is linked to a few pivots (the least digest, and the least under other
orders), never all pairs; each link is verified by exact J_P on the whole texts, and verified
links are joined into classes by label propagation with pointer jumping. A second pass takes
the buckets that still hold texts of several classes and tests every pair across classes:
small ones as links, larger ones in tiles of bounded size, so no candidate stays untested.

Equal texts share one node from the start, so copies cost one row each. Tables between the
passes are written to the shared folder, which ends their lineage; sums that are joined back to
what they were summed from are tables too, as Spark can split a key with many rows only where
both sides of a join are plain tables. Tables that no later pass reads are removed.

Defined results: a null text is a class of its own; texts without words have no shingles and
are grouped with equal texts only; texts of one to four words have one shingle, the whole
text; a class's id is its least doc_id (null where all are null); repeated rows share a class;
a very long text is compared whole; an empty table gives no rows; other columns are not used,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, discard, materialise, small_batches, table, views

WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 28, 4
REGISTERS = BANDS * ROWS
PIVOTS = 3
#: Second pass: buckets up to this many texts list their pairs, larger ones are tiled.
SMALL_BUCKET = 24
#: Bytes of text of one side of a tile; a text counts as LEAST_BYTES at least.
TILE_BYTES, LEAST_BYTES = 2 << 20, 4 << 10
#: Members verified against one copy of their pivot's text.
GROUP = 256

_U = np.uint64
_BASE, _INVERSE = _U(0x9E3779B97F4A7C15), _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_STEP = _U(0xD6E8FEB86659FD93)
_PAD = _U(0x2545F4914F6CDD1D)
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_powers = [np.ones(1, _U), np.ones(1, _U)]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads 64-bit values."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        for i, base in enumerate((_BASE, _INVERSE)):
            p = np.full(size, base, _U)
            p[0] = 1
            _powers[i] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


def shingles(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text index, 52-bit id and count of each distinct shingle of the texts (at most 4096)
    that off bounds; sorted by text, then id."""
    s = raw[off[0] : off[-1]]
    bounds = off - off[0]
    if not len(s):
        return np.zeros(0, np.int64), np.zeros(0, _U), np.zeros(0)
    ahead, back = _power_tables(len(s) + 1)
    word = ~_BLANK[s]
    first = word.copy()
    first[1:] &= ~word[:-1]
    edges = bounds[:-1][np.diff(bounds) > 0]
    first[edges] = word[edges]
    last = word.copy()
    last[:-1] &= ~word[1:]
    last[edges[1:] - 1] = word[edges[1:] - 1]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    if not len(begin):
        return np.zeros(0, np.int64), np.zeros(0, _U), np.zeros(0)
    sums = np.zeros(len(s) + 1, _U)
    np.cumsum((_LOW[s].astype(_U) + _U(1)) * ahead[: len(s)], out=sums[1:])
    h = mix((sums[end] - sums[begin]) * back[begin] + (end - begin).astype(_U) * _STEP)
    doc = np.searchsorted(bounds, begin, "right") - 1
    n = len(h)
    pad_h, pad_doc = np.r_[h, np.full(WORDS, _PAD)], np.r_[doc, np.full(WORDS, -1)]
    g = np.zeros(n, _U)
    for k in range(WORDS):
        g = g * _STEP + np.where(pad_doc[k : k + n] == doc, pad_h[k : k + n], _PAD)
    whole = pad_doc[WORDS - 1 : WORDS - 1 + n] == doc
    start = np.r_[True, doc[1:] != doc[:-1]]
    keep = whole | start  # a text under WORDS words has its start alone
    key = (doc[keep].astype(_U) << _U(52)) | (mix(g[keep]) >> _U(12))
    key.sort()
    new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    counts = np.diff(np.r_[new, len(key)])
    key = key[new]
    return (key >> _U(52)).astype(np.int64), key & _U((1 << 52) - 1), counts.astype(np.float64)


def probminhash(doc: np.ndarray, ids: np.ndarray, weight: np.ndarray, docs: int, registers: int = REGISTERS) -> np.ndarray:
    """Signatures [docs, registers] of weighted shingles (0 where a text has none)."""
    least = np.full(docs * registers, np.inf)
    owner = np.zeros(docs * registers, _U)
    seed, at = mix(ids * _BASE + _U(1)), np.zeros(len(ids))
    turn = 0
    while len(ids):
        turn += 1
        r = mix(seed + _U(turn * int(_BASE) & (1 << 64) - 1))
        # Upper bits give the waiting time, lower bits the register.
        at = at - np.log(((r >> _U(12)).astype(np.float64) + 0.5) * 2.0**-52) / weight
        slot = doc * registers + (mix(r) % _U(registers)).astype(np.int64)
        np.minimum.at(least, slot, at)
        won = least[slot] == at
        owner[slot[won]] = ids[won]
        latest = least.reshape(docs, registers).max(1)
        alive = at < latest[doc]
        doc, ids, weight, seed, at = doc[alive], ids[alive], weight[alive], seed[alive], at[alive]
    return owner.reshape(docs, registers)


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of each signature; bands do not share keys."""
    out = np.empty((len(signatures), BANDS), _U)
    for b in range(BANDS):
        h = np.full(len(signatures), _U(b + 1))
        for x in signatures[:, b * ROWS : (b + 1) * ROWS].T:
            h = mix(h * _STEP + x)
        out[:, b] = h
    return out.view(np.int64)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Exact J_P of two weighted sets (sorted ids, counts)."""
    ids = np.union1d(a[0], b[0])
    p, q = np.zeros(len(ids)), np.zeros(len(ids))
    p[np.searchsorted(ids, a[0])] = a[1]
    q[np.searchsorted(ids, b[0])] = b[1]
    shared = (p > 0) & (q > 0)
    if not shared.any():
        return 0.0
    with np.errstate(divide="ignore"):
        ratio = q / p
    order = np.argsort(ratio, kind="stable")
    # Sum over j of max(p_j, q_j / t): p up to the ratio t, q / t beyond it.
    below, above = np.r_[0, np.cumsum(p[order])], np.r_[0, np.cumsum(q[order])]
    t = ratio[shared]
    k = np.searchsorted(ratio[order], t, "right")
    return float((p[shared] / (below[k] + (above[-1] - above[k]) / t)).sum())


def node(text: str = "text") -> Column:
    """Digest of a text: equal texts are one node."""
    return F.unhex(F.md5(F.col(text).cast("binary")))


def signed(docs: DataFrame) -> DataFrame:
    """(doc_id, node, bands) of all rows, as a table; bands are empty for texts without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = views(batch.column("text"))
            keys: list = []
            for a, b in chunks(off):
                for c in range(a, b, 4096):
                    d = min(b, c + 4096)
                    doc, ids, weight = shingles(raw, off[c : d + 1])
                    bands = band_keys(probminhash(doc, ids, weight, d - c))
                    some = np.zeros(d - c, bool)
                    some[doc] = True
                    keys += [x if y else x[:0] for x, y in zip(bands, some, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("node"), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "node", "bands"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return materialise(docs.select("doc_id", node().alias("node"), "text").mapInArrow(run, f"doc_id {kind}, node binary, bands array<long>"), "signatures")


def _links(pairs: DataFrame) -> DataFrame:
    return pairs.filter(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def star_links(buckets: DataFrame, pivots: int, salt: int) -> DataFrame:
    """Links (a, b) of every text of a bucket to its pivots of other labels; buckets: (bucket,
    node, label). Pivots are aggregates, so a bucket that holds a third of all texts is
    combined before it is shuffled."""
    own = F.struct("node", "label")
    orders = [F.min(own).alias("p0")] + [F.min_by(own, F.xxhash64("node", F.lit(salt + i))).alias(f"p{i}") for i in range(1, pivots)]
    heads = buckets.groupBy("bucket").agg(F.count("*").alias("n"), *orders).filter(F.col("n") > 1)
    heads = materialise(heads, "heads")
    others = F.filter(F.array_distinct(F.array([f"p{i}" for i in range(pivots)])), lambda p: p["label"] != F.col("label"))
    linked = buckets.join(heads, "bucket").select("node", F.explode(others).alias("pivot"))
    return _links(linked.select(F.col("node").alias("a"), F.col("pivot.node").alias("b")))


def verify(links: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The links (a, b) whose texts have J_P of at least threshold. Rows are dealt by pivot
    and a salt that splits pivots with many members; a task holds one pivot and one member."""
    # Of a link's two ends the one with more links is the pivot.
    degree = materialise(links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").count(), "degrees")
    sized = links.join(degree.select(F.col("node").alias("a"), F.col("count").alias("na")), "a").join(degree.select(F.col("node").alias("b"), F.col("count").alias("nb")), "b")
    turned = sized.select(
        F.when(F.col("na") >= F.col("nb"), F.col("a")).otherwise(F.col("b")).alias("pivot"),
        F.when(F.col("na") >= F.col("nb"), F.col("b")).otherwise(F.col("a")).alias("member"),
        F.ceil(F.greatest("na", "nb") / GROUP).alias("_split"),
    ).withColumn("salt", F.pmod(F.xxhash64("member"), F.col("_split")).cast("int"))
    turned = materialise(turned.drop("_split"), "links")
    members = turned.join(texts.withColumnRenamed("node", "member"), "member").select("pivot", "salt", F.lit(1).alias("kind"), "member", "text")
    heads = turned.select("pivot", "salt").distinct().join(texts.withColumnRenamed("node", "pivot"), "pivot").select("pivot", "salt", F.lit(0).alias("kind"), F.col("pivot").alias("member"), "text")
    dealt = heads.unionByName(members).repartition("pivot", "salt").sortWithinPartitions("pivot", "salt", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, own = None, None
        for batch in batches:
            a, b, sim = [], [], []
            raw, off = views(batch.column("text"))
            pivots, kinds, members = (batch.column(c).to_pylist() for c in ("pivot", "kind", "member"))
            for i in range(batch.num_rows):
                _, ids, weight = shingles(raw, off[i : i + 2])
                if kinds[i] == 0:
                    head, own = pivots[i], (ids, weight)
                    continue
                if pivots[i] != head:
                    raise ValueError("a member came without its pivot")
                j = similarity(own, (ids, weight))
                if j >= threshold:
                    a.append(head), b.append(members[i]), sim.append(j)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(sim, pa.float64())], names=["a", "b", "sim"])

    found = materialise(dealt.mapInArrow(run, "a binary, b binary, sim double"), "verified")
    discard(degree, turned)
    return found


def components(links: DataFrame) -> DataFrame:
    """(node, label) of all nodes with links: least node reachable. A round takes the least of a
    node's label, its neighbours' labels and its label's label; rounds are logarithmic in the
    longest path where labels jump, and each is one table."""
    both = materialise(links.select("a", "b").union(links.select("b", "a")).distinct(), "edges")
    labels = materialise(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).withColumnRenamed("a", "node"), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").select(F.col("a").alias("node"), F.col("label").alias("new"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("new"))
        far = labels.join(up, "label").select("node", "new")
        own = labels.select("node", F.col("label").alias("new"), F.col("label").alias("was"))
        every = near.unionByName(far).unionByName(own, allowMissingColumns=True)
        new = every.groupBy("node").agg(F.min("new").alias("label"), F.max("was").alias("was"))
        new = materialise(new, "labels")
        discard(labels)
        labels = new.select("node", "label")
        if not new.filter(F.col("label") != F.col("was")).limit(1).count():
            discard(both)
            return labels


def joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (node, label) with the classes that further links connect made one: components of
    the labels alone, which are few."""
    far = labels.select(F.col("node").alias("a"), F.col("label").alias("la"))
    ends = links.select("a", "b").join(far, "a", "left").join(far.toDF("b", "lb"), "b", "left")
    pairs = materialise(ends.select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b")).filter("a != b").distinct(), "class-links")
    moved = components(pairs)
    # Ends without a label so far are classes of their own, so `moved` has them itself.
    every = labels.unionByName(moved.select("node", F.col("node").alias("label")).join(labels.select("node"), "node", "left_anti"))
    out = every.join(moved.select(F.col("node").alias("label"), F.col("label").alias("to")), "label", "left").select("node", F.coalesce("to", "label").alias("label"))
    out = materialise(out, "labels")
    discard(pairs, moved)
    return out


def rest_links(rest: DataFrame) -> DataFrame:
    """All links across classes of small buckets; rest: (bucket, n, main, band, node, label)."""
    small = rest.filter(F.col("n") <= SMALL_BUCKET)
    ends = small.groupBy("bucket").agg(F.collect_list(F.struct("node", "label")).alias("all"))  # SMALL_BUCKET entries at most
    across = F.flatten(F.transform("all", lambda x: F.transform(F.filter("all", lambda y: (x["node"] < y["node"]) & (x["label"] != y["label"])), lambda y: F.struct(x["node"].alias("a"), y["node"].alias("b")))))
    return _links(ends.select(F.explode(across).alias("p")).select("p.a", "p.b"))


def mixed_buckets(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """(bucket, n, main, band, node, label) of the buckets that hold several classes: their
    texts, how many, and the class with the most of them."""
    classed = buckets.join(labels, "node", "left").select("bucket", "band", "node", F.coalesce("label", "node").alias("label"))
    each = classed.groupBy("bucket", "label").agg(F.count("*").alias("c"))
    mixed = each.groupBy("bucket").agg(F.sum("c").alias("n"), F.count("*").alias("k"), F.max(F.struct("c", "label"))["label"].alias("main")).filter(F.col("k") > 1)
    return materialise(classed.join(materialise(mixed.drop("k"), "mixed"), "bucket"), "rest")


def tiles(large: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """Rows (bucket, u, v, kind, band, node, label, bands, text) whose groups (bucket, u, v)
    hold every pair across classes of large mixed buckets. The texts outside the bucket's
    main class are dealt into parts u, and meet each other's parts and those of the main
    class: two texts of the main class never have to meet, so a bucket of one large class and
    few others costs a row a text. kind 0 is the side that is held, kind 1 the one that runs."""
    # A node meets its text once, with its buckets (BANDS at most) as a list.
    own = large.groupBy("node").agg(F.collect_list(F.struct("bucket", "main", "band", "label")).alias("_in"))
    met = own.join(texts, "node").join(nodes.select("node", "bands"), "node")
    full = met.select("node", "text", "bands", F.explode("_in").alias("_at")).select("node", "text", "bands", "_at.*").withColumn("outside", F.col("label") != F.col("main"))
    weight = F.greatest(F.octet_length("text"), F.lit(LEAST_BYTES))
    part = lambda side: F.ceil(F.sum(F.when(side, weight).otherwise(0)) / TILE_BYTES).cast("int")
    sizes = full.groupBy("bucket").agg(part(F.col("outside")).alias("out"), part(~F.col("outside")).alias("in"))
    dealt = full.join(sizes, "bucket").withColumn("own", F.pmod(F.xxhash64("node"), F.when(F.col("outside"), F.col("out")).otherwise(F.col("in"))).cast("int"))
    at = lambda u, v, kind: F.struct(u.alias("u"), v.alias("v"), F.lit(kind).alias("kind"))
    held = F.transform(F.sequence("own", F.col("out") + F.col("in") - 1), lambda v: at(F.col("own"), v, 0))
    met = F.transform(F.sequence(F.lit(0), "own"), lambda u: at(u, F.col("own"), 1))
    runs = F.transform(F.sequence(F.lit(0), F.col("out") - 1), lambda u: at(u, F.col("out") + F.col("own"), 1))
    placed = dealt.withColumn("t", F.explode(F.when(F.col("outside"), F.concat(held, met)).otherwise(runs)))
    return placed.select("bucket", "t.u", "t.v", "t.kind", "band", "node", "label", "bands", "text")


class Held:
    """The held side of a tile: postings of its shingles, to meet one text after another."""

    def __init__(self, rows: list[tuple]):
        self.nodes, self.labels, bands, self.sets = zip(*rows, strict=True)
        self.bands = np.array(bands)
        self.size = np.array([len(ids) for ids, _ in self.sets])
        self.total = np.array([w.sum() for _, w in self.sets])
        self.plain = self.total == self.size  # every count is 1
        ids = np.concatenate([ids for ids, _ in self.sets])
        order = np.argsort(ids, kind="stable")
        self.ids = ids[order]
        self.weight = np.concatenate([w for _, w in self.sets])[order]
        self.owner = np.repeat(np.arange(len(rows)), self.size)[order]

    def meet(self, bands: np.ndarray, band: int, other: np.ndarray, own: tuple[np.ndarray, np.ndarray], threshold: float) -> list[tuple[int, float]]:
        """(index, J_P) of the held texts of `other` with J_P of at least threshold whose first
        common band is this one: a pair is tested in one bucket only."""
        other = other & ~(self.bands[:, :band] == bands[:band]).any(1)
        if not other.any():
            return []
        ids, weight = own
        lo, hi = np.searchsorted(self.ids, ids, "left"), np.searchsorted(self.ids, ids, "right")
        n = hi - lo
        hit = np.repeat(lo - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        owner, total = self.owner[hit], weight.sum()
        # J_P is the chance that two draws, one of each distribution, agree: it is at most the
        # mass that both share.
        mass = np.bincount(owner, np.minimum(self.weight[hit] / self.total[owner], np.repeat(weight, n) / total), len(self.size))
        likely = other & (mass >= threshold - 1e-9)
        if not likely.any():
            return []
        shared = np.bincount(owner, minlength=len(self.size))
        simple = self.plain if total == len(ids) else np.zeros(len(self.size), bool)
        jaccard = shared / (self.size + len(ids) - shared)  # J_P where every count is 1
        found = [(int(i), float(jaccard[i])) for i in np.flatnonzero(likely & simple & (jaccard >= threshold))]
        for i in np.flatnonzero(likely & ~simple):
            j = similarity(self.sets[i], own)
            if j >= threshold:
                found.append((int(i), j))
        return found


def tile_links(placed: DataFrame, threshold: float) -> DataFrame:
    """The links (a, b, sim) of all tiles with J_P of at least threshold."""
    dealt = placed.repartition("bucket", "u", "v").sortWithinPartitions("bucket", "u", "v", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows, held = None, [], None
        for batch in batches:
            a, b, sim = [], [], []
            raw, off = views(batch.column("text"))
            names = ("bucket", "u", "v", "kind", "band", "node", "label", "bands")
            for i, (bucket, u, v, kind, band, name, label, bands) in enumerate(zip(*(batch.column(c).to_pylist() for c in names), strict=True)):
                if (bucket, u, v) != at:
                    at, rows, held = (bucket, u, v), [], None
                _, ids, weight = shingles(raw, off[i : i + 2])
                if kind == 0:
                    rows.append((name, label, bands, (ids, weight)))
                    continue
                if not rows:
                    continue
                if held is None:
                    held = Held(rows)
                    own, classes_ = np.array(held.nodes, object), np.array(held.labels, object)
                other = classes_ != label
                if u == v:  # a part with itself: each pair once
                    other &= own < name
                for k, j in held.meet(np.array(bands), band, other.astype(bool), (ids, weight), threshold):
                    a.append(held.nodes[k]), b.append(name), sim.append(j)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(sim, pa.float64())], names=["a", "b", "sim"])

    return materialise(dealt.mapInArrow(run, "a binary, b binary, sim double"), "tiles")


def classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id, node) of every row of docs (doc_id, text)."""
    small_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    rows = signed(docs)
    nodes = rows.filter(F.col("node").isNotNull()).groupBy("node").agg(F.min("doc_id").alias("least"), F.first("bands").alias("bands"))
    nodes = materialise(nodes, "nodes")
    buckets = nodes.select("node", F.posexplode("bands").alias("band", "bucket"))
    shared = materialise(buckets.groupBy("bucket").count().filter(F.col("count") > 1).select("bucket"), "shared")
    buckets = materialise(buckets.join(shared, "bucket"), "buckets")
    links = materialise(star_links(buckets.withColumn("label", F.col("node")), PIVOTS, 0), "star")
    involved = buckets.select("node").distinct()
    texts = docs.select(node().alias("node"), "text").join(involved, "node", "left_semi").groupBy("node").agg(F.first("text").alias("text"))
    texts = materialise(texts, "texts")
    good = verify(links, texts, threshold)
    labels = components(good)
    rest = mixed_buckets(buckets, labels)
    more = materialise(rest_links(rest).join(links, ["a", "b"], "left_anti"), "more")
    found = []
    if more.limit(1).count():
        found.append(verify(more, texts, threshold))
    large = rest.filter(F.col("n") > SMALL_BUCKET)
    if large.limit(1).count():
        found.append(tile_links(tiles(large, nodes, texts), threshold))
    found = [new for new in found if new.limit(1).count()]
    if found:
        first, *others = [new.select("a", "b") for new in found]
        labels = joined(labels, first.unionByName(others[0]) if others else first)
    discard(buckets, shared, links, texts, rest, more, good, *found)
    named = nodes.join(labels, "node", "left").select("node", "least", F.coalesce("label", "node").alias("label"))
    heads = materialise(named.groupBy("label").agg(F.min("least").alias("class_id")), "class-ids")
    by_node = named.join(heads, "label").select("node", "class_id")
    return rows.select("doc_id", "node").join(by_node, "node", "left").select("doc_id", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), "node")


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id")
