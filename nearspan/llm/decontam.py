"""Benchmark decontamination: q-gram lemma filtering and banded alignment.

Texts and benchmark items are folded (ASCII letters lowered, runs of other ASCII but digits
to one blank). Items are cut into segments of SEGMENT characters that overlap by half; a
segment of n characters is allowed n * EDIT_SHARE edits, but no more than leave it one shared
q-gram. By the q-gram lemma a region of a text within that many edits of a segment shares at
least need = n - q + 1 - q * edits of its q-grams with it, all on diagonals that differ by at
most `edits`.

A scan works on whole batches: it marks positions whose q-gram any segment has and keeps
windows with enough marks for the bound. Of a segment's q-grams all but need - 1 suffice to
find it, so only its rarest ones are looked up: that is exact, and a phrase that many segments
share costs little. For each text and segment so found, the shared q-grams are counted in
overlapping bands of diagonals, and each band that meets the bound is aligned within a band of
that width. Equal segments of several items are one. Characters are folded UTF-8 bytes.

The items are a stated query set: they go through in blocks of BLOCK_BYTES, so what is
broadcast has a fixed bound, and every block meets all rows.

Defined results: null and empty texts or items match nothing; an item of up to q bytes once
folded is too short for q-grams, and is held by a text that has it as a whole line; one whole
segment of an item is enough, so a text that holds what several items share holds them all;
repeated rows are found each time; of equal alignments the first is reported; a very long text is
scanned whole; `flag` replaces a column called as its result and keeps all others, `leaks` uses
no other column; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import chunks, small_batches, table, views

Q = 8
SEGMENT = 80
EDIT_SHARE = 0.075
BLOCK_BYTES = 4 << 20
_HASH_BITS = 21
#: Bytes of text folded and scanned at once, so that the work stays in the processor's caches.
SCAN_BYTES = 1 << 18
#: Entries of the index, and pairs of text and segment, looked at in one step (memory only).
STEP, PAIRS = 1 << 20, 1 << 15

_FOLD = np.full(256, 32, np.uint8)
for _b in range(256):
    if _b >= 128 or chr(_b).isalnum():
        _FOLD[_b] = ord(chr(_b).lower()) if _b < 128 else _b


def fold(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Folded bytes of the texts that off bounds, and their bounds. A text ends in a blank,
    so q-grams across texts never occur in an item's inside."""
    s = _FOLD[raw[off[0] : off[-1]]]
    bounds = off - off[0]
    blank = s == 32
    keep = np.ones(len(s), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    if keep.all():
        return s, bounds
    gone = np.flatnonzero(~keep)
    return s[keep], bounds - np.searchsorted(gone, bounds)


def fold_text(text: str | None) -> bytes:
    raw = (text or "").encode()
    return fold(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0].tobytes().strip()


def grams(s: np.ndarray) -> np.ndarray:
    """The q-gram (eight bytes as one number) that starts at each position."""
    if len(s) < Q:
        return np.zeros(0, np.uint64)
    x = s.astype(np.uint64)
    x = x[:-1] | (x[1:] << np.uint64(8))
    x = x[:-2] | (x[2:] << np.uint64(16))
    return x[:-4] | (x[4:] << np.uint64(32))


def _slot(codes: np.ndarray) -> np.ndarray:
    return (codes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _HASH_BITS)


@dataclass
class Segments:
    """Distinct segments of one block of items with their q-gram index."""

    items: list[list]  # items of each segment
    text: list[bytes]
    edits: np.ndarray
    need: np.ndarray  # shared q-grams that the lemma asks for
    rare: tuple[np.ndarray, np.ndarray]  # sorted rarest q-grams of all segments, their segments
    codes: np.ndarray  # sorted q-grams of all segments
    owner: np.ndarray
    at: np.ndarray
    marked: np.ndarray  # hash table of all q-grams
    window: int
    least: int
    short: dict[bytes, list]  # items of up to Q bytes


def segments(items: list[tuple]) -> Segments | None:
    """Index of items (id, text)."""
    found: dict[bytes, dict] = {}
    short: dict[bytes, list] = {}
    for item, text in items:
        s = fold_text(text)
        if 0 < len(s) <= Q:
            short.setdefault(s, []).append(item)
        elif s:
            last = max(len(s) - SEGMENT, 0)
            for a in sorted({*range(0, last + 1, SEGMENT // 2), last}):
                found.setdefault(s[a : a + SEGMENT], {})[item] = None
    if not found and not short:
        return None
    texts = list(found)
    if not texts:  # only short ones
        no, none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        return Segments([], [], none, none, (no, none), no, none, none, np.zeros(1 << _HASH_BITS, bool), 0, 1 << 30, short)
    n = np.array([len(t) for t in texts], np.int64)
    edits = np.minimum(np.floor(n * EDIT_SHARE).astype(np.int64), (n - Q) // Q)
    need = n - Q + 1 - Q * edits
    every = [grams(np.frombuffer(t, np.uint8)) for t in texts]
    distinct, count = np.unique(np.concatenate([np.zeros(0, np.uint64), *every]), return_counts=True)
    size = n - Q + 1
    none = np.zeros(0, np.int64)
    codes, owner, at = (np.concatenate([x, *y]) for x, y in ((np.zeros(0, np.uint64), every), (none, [np.full(k, i) for i, k in enumerate(size)]), (none, [np.arange(k) for k in size])))
    # The first size - need + 1 q-grams of each segment, from the rarest on.
    order = np.lexsort((at, count[np.searchsorted(distinct, codes)], owner))
    rank = np.arange(len(codes)) - np.repeat(np.r_[0, np.cumsum(size)[:-1]], size)
    few = order[rank <= (size - need)[owner]]
    few = few[np.argsort(codes[few], kind="stable")]
    order = np.argsort(codes, kind="stable")
    marked = np.zeros(1 << _HASH_BITS, bool)
    marked[_slot(distinct)] = True
    return Segments([list(x) for x in found.values()], texts, edits, need, (codes[few], owner[few]), codes[order], owner[order], at[order], marked, int((n + edits).max(initial=0)), int(need.min(initial=1 << 30)), short)


def align(patterns: np.ndarray, windows: np.ndarray, inside: np.ndarray, edits: int) -> tuple[np.ndarray, np.ndarray]:
    """Least edits of each pattern [k, n] against any part of its window, and where that part
    ends in the window. Cell j of row i is pattern[:i] against a part that ends before place
    i + j of the window [k, n + width]; inside [k, n + width + 1] tells which places are in the
    text. All pairs are aligned at once, row by row."""
    k, n = patterns.shape
    width = windows.shape[1] - n
    big = edits + n + 1
    row = np.where(inside[:, :width], 0, big)
    steps = np.arange(width)
    up = np.full((k, width), big + 1)
    for i in range(1, n + 1):
        np.add(row[:, 1:], 1, out=up[:, :-1])
        new = np.minimum(row + (windows[:, i - 1 : i - 1 + width] != patterns[:, i - 1 : i]), up)
        new = np.minimum.accumulate(new - steps, axis=1) + steps
        row = np.where(inside[:, i : i + width], new, big)
    best = row.argmin(1)
    return row[np.arange(k), best], n + best


def alignments(jobs: list[tuple[bytes, bytes, int, int]]) -> list[tuple[int, int] | None]:
    """For each (pattern, region, offset, edits): least edits of pattern against any part of
    region, and where that part ends; None beyond `edits`. offset: place in region where
    pattern would start; cells farther than 2 * edits from that diagonal are left out, which
    cuts no alignment within the budget of a band's diagonals."""
    out: list[tuple[int, int] | None] = [None] * len(jobs)
    groups: dict[tuple[int, int], list[int]] = {}
    for i, (pattern, region, offset, edits) in enumerate(jobs):
        if offset >= 0 and region.startswith(pattern, offset):
            out[i] = 0, offset + len(pattern)
        elif edits:
            groups.setdefault((len(pattern), edits), []).append(i)
    for (n, edits), members in groups.items():
        far = 2 * edits + 1
        width = 2 * far + 1
        for a in range(0, len(members), 2048):
            part = members[a : a + 2048]
            # Equal windows (a passage that repeats) are aligned once.
            windows, inside, rows, of = [], [], [], []
            known: dict[tuple, int] = {}
            for i in part:
                pattern, region, offset, _ = jobs[i]
                lo = offset - far
                left, right = max(lo, 0), max(min(lo + n + width, len(region)), max(lo, 0))
                window = bytes(max(-lo, 0)) + region[left:right]
                key = pattern, lo < 0 and -lo, right - lo, window
                if key not in known:
                    known[key] = len(windows)
                    windows.append(np.frombuffer(window[: n + width].ljust(n + width, b"\0"), np.uint8))
                    place = np.arange(n + width + 1) + lo
                    inside.append((place >= 0) & (place <= len(region)))
                    rows.append(np.frombuffer(pattern, np.uint8))
                of.append(known[key])
            least, end = align(np.stack(rows), np.stack(windows), np.stack(inside), edits)
            for i, k in zip(part, of, strict=True):
                if least[k] <= edits:
                    out[i] = int(least[k]), int(end[k]) + jobs[i][2] - far
    return out


def aligned(pattern: bytes, region: bytes, offset: int, edits: int) -> tuple[int, int] | None:
    return alignments([(pattern, region, offset, edits)])[0]


def entries(code: np.ndarray, index: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Steps of (place in code, place in index) of equal q-grams; index is sorted."""
    first = np.searchsorted(index, code, "left")
    count = np.searchsorted(index, code, "right") - first
    place = np.flatnonzero(count)
    first, count = first[place], count[place]
    total, a = np.r_[0, np.cumsum(count)], 0
    while a < len(count):
        b = max(a + 1, int(np.searchsorted(total, total[a] + STEP, "right")) - 1)
        n = count[a:b]
        yield np.repeat(place[a:b], n), np.repeat(first[a:b] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        a = b


def candidates(code: np.ndarray, text: np.ndarray, seg: Segments) -> np.ndarray:
    """Pairs text * segments + segment that share one of the segment's rarest q-grams."""
    found = [np.unique(text[i] * len(seg.text) + seg.rare[1][k]) for i, k in entries(code, seg.rare[0])]
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)


def bands(code: np.ndarray, pos: np.ndarray, text: np.ndarray, pairs: np.ndarray, seg: Segments) -> Iterator[tuple[int, int]]:
    """(pair, middle diagonal) of each band, of two widths that overlap by one, in which a text
    shares as many q-grams with a segment as the lemma asks for."""
    some = np.zeros(len(seg.text), bool)
    some[pairs % len(seg.text)] = True
    own = some[seg.owner]
    codes, owner, at = seg.codes[own], seg.owner[own], seg.at[own]
    kept = []
    for i, k in entries(code, codes):
        pair = text[i] * len(seg.text) + owner[k]
        slot = np.minimum(np.searchsorted(pairs, pair), len(pairs) - 1)
        use = pairs[slot] == pair
        kept.append((slot[use], pos[i[use]], pos[i[use]] - at[k[use]]))
    slot, where, diagonal = (np.concatenate(x) for x in zip(*kept, strict=True))
    need, width = seg.need[pairs % len(seg.text)], seg.edits[pairs % len(seg.text)] + 1
    use = np.bincount(slot, minlength=len(pairs))[slot] >= need[slot]
    slot, where, diagonal = slot[use], where[use], diagonal[use]
    if not len(slot):
        return
    for shift in (0, 1):
        band = (diagonal + shift * width[slot]) // (2 * width[slot])
        # Places ascend already, so one stable sort by slot and band is enough.
        key = slot * (band.max() - band.min() + 1) + band - band.min()
        order = np.argsort(key, kind="stable")
        s, b, place = slot[order], band[order], where[order]
        fresh_band = np.r_[True, (s[1:] != s[:-1]) | (b[1:] != b[:-1])]
        new = np.flatnonzero(fresh_band)
        ends = np.r_[new[1:], len(s)]
        # A q-gram that a segment has twice counts once a place.
        distinct = np.add.reduceat((fresh_band | np.r_[True, place[1:] != place[:-1]]).astype(np.int64), new)
        enough = distinct >= need[s[new]]
        first, last = new[enough], ends[enough]
        diag = diagonal[np.lexsort((diagonal, key))]  # each band's diagonals in order
        middle = (diag[(first + last - 1) // 2] + diag[(first + last) // 2]) // 2
        yield from zip(pairs[s[first]].tolist(), middle.tolist(), strict=True)


def find(s: np.ndarray, bounds: np.ndarray, seg: Segments) -> list[tuple[int, object, int, int]]:
    """(text, item, edits, end) of the best hit of each text and item; s, bounds from fold."""
    code = grams(s)
    if not len(code) or not seg.text:
        return []
    mark = seg.marked[_slot(code)]
    sums = np.zeros(len(mark) + 1, np.int32)
    np.cumsum(mark, out=sums[1:])
    span = min(seg.window, len(mark))
    dense = sums[span:] - sums[:-span] >= seg.least
    if not dense.any():
        return []
    # Positions that lie in a dense window.
    cover = np.zeros(len(mark) + 1, np.int64)
    starts = np.flatnonzero(dense)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + span, -1)
    pos = np.flatnonzero(mark & (np.cumsum(cover[:-1]) > 0))
    code, text = code[pos], np.searchsorted(bounds, pos, "right") - 1
    best: dict = {}
    pairs = candidates(code, text, seg)
    jobs, names = [], []

    def settle() -> None:
        for got, (t, o) in zip(alignments(jobs), names, strict=True):
            for item in seg.items[o] if got else ():
                best[t, item] = min(best.get((t, item), got), got)
        jobs.clear()
        names.clear()

    for a in range(0, len(pairs), PAIRS):
        part = pairs[a : a + PAIRS]
        i, j = np.searchsorted(text, [part[0] // len(seg.text), part[-1] // len(seg.text) + 1])
        regions: dict[int, bytes] = {}
        for pair, middle in bands(code[i:j], pos[i:j], text[i:j], part, seg):
            t, o = divmod(pair, len(seg.text))
            if t not in regions:
                regions[t] = s[bounds[t] : bounds[t + 1]].tobytes()
            jobs.append((seg.text[o], regions[t], middle - int(bounds[t]), int(seg.edits[o])))
            names.append((t, o))
            if len(jobs) >= 4096:
                settle()
    settle()
    return [(t, item, *got) for (t, item), got in sorted(best.items())]


def short_items(column: pa.Array, seg: Segments) -> list[tuple[int, object]]:
    """(row, item) of texts that have a short item as a whole line."""
    if not seg.short:
        return []
    out = []
    for row, text in enumerate(column.to_pylist()):
        out += [(row, item) for line in {fold_text(x) for x in (text or "").split("\n")} for item in seg.short.get(line, ())]
    return out


def item_blocks(items: DataFrame, key: str, text: str) -> Iterator[list[tuple]]:
    """Items in blocks of BLOCK_BYTES, streamed through the driver."""
    block, size = [], 0
    for row in items.select(key, text).toLocalIterator():
        if row[1]:
            block.append((row[0], row[1]))
            size += len(row[1])
        if size >= BLOCK_BYTES:
            yield block
            block, size = [], 0
    if block:
        yield block


def leaks(docs: DataFrame, items: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """(doc_id, item_id, edits, end) of each document and benchmark item that it holds."""
    spark = docs.sparkSession
    small_batches(spark)
    kinds = docs.schema["doc_id"].dataType.simpleString(), items.schema[key].dataType.simpleString()
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, edits int, end long"
    item_type = to_arrow_type(items.schema[key].dataType)
    found = spark.createDataFrame([], schema)
    for block in item_blocks(items, key, text):
        index = segments(block)
        if index is None:
            continue
        held = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            seg = held.value
            for batch in batches:
                raw, off = views(batch.column(1))
                rows, item, edits, end = [], [], [], []
                for a, b in chunks(off, SCAN_BYTES):
                    for t, i, e, z in find(*fold(raw, off[a : b + 1]), seg):
                        rows.append(a + t), item.append(i), edits.append(e), end.append(z)
                for row, i in short_items(batch.column(1), seg):
                    rows.append(row), item.append(i), edits.append(0), end.append(0)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(item, item_type), pa.array(edits, pa.int32()), pa.array(end, pa.int64())], names=["doc_id", "item_id", "edits", "end"])

        found = found.union(docs.select("doc_id", "text").mapInArrow(run, schema))
    return found


def flag(docs: DataFrame, items: DataFrame, key: str = "item_id", text: str = "text", out: str = "leak") -> DataFrame:
    """docs with a boolean column: whether the text holds an item. Blocks of items follow one
    another over the same rows, so nothing is shuffled."""
    spark = docs.sparkSession
    small_batches(spark)
    kept = [c for c in docs.columns if c.lower() != out.lower()]
    marked = docs.select(*kept).withColumn(out, F.lit(False))
    for block in item_blocks(items, key, text):
        index = segments(block)
        if index is None:
            continue
        held = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                raw, off = views(batch.column(kept.index("text")))
                leak = batch.column(len(kept)).to_numpy(zero_copy_only=False).copy()
                for a, b in chunks(off, SCAN_BYTES):
                    for t, *_ in find(*fold(raw, off[a : b + 1]), held.value):
                        leak[a + t] = True
                for row, _ in short_items(batch.column(kept.index("text")), held.value):
                    leak[row] = True
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(leak, pa.bool_())], names=[*kept, out])

        marked = marked.mapInArrow(run, marked.schema)
    return marked


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
