"""LM scoring with Brown class-based bigrams.

Exchange clustering assigns every training word to a class. It starts with units: each of the
TOP_WORDS most frequent words is one of its own and all other words form units by their last
two bytes; units move between classes as long as the likelihood of the class bigrams rises.
Then every other training word leaves its unit for the class in which its own bigrams are
likeliest, its neighbours' classes held; only words without training counts stay with their
suffix. A text's probability is the product of class transitions and of word emissions within
the class, both smoothed, so any text has a finite perplexity.

    P(w | v) = P(class(w) | class(v)) * (count(w) + D) / (count(class) + D * (types + 1))

Only tables whose size is fixed by parameters are broadcast (units, class transitions). The
words' counts and classes grow with the corpus and are never broadcast: a task cuts its rows
into blocks of bounded size, codes a block's texts by the block's own list of distinct words,
and keeps them in a file of the shared folder. A block's words, each with its count and the
classes beside it, meet those of the other blocks in one shuffle by word, where their sums
give the word's class; a second shuffle takes counts and classes back to the blocks. The most
frequent words are known before and are in neither shuffle, so no word's rows are many: one a
block at most.

Tokens are words `[^\\x20\\x09-\\x0D]+` after lowering A-Z, then one end token a text.

Defined results: a null text is an empty one (the end token alone); rows are scored one by
one, so repeats get equal scores; equal counts are ordered by the word's bytes; with no
training rows every count is 0; an empty table gives no rows; a very long text is scored whole in
one task; other columns are not used, whatever their names.
"""

from __future__ import annotations

import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import discard, materialise, shared_dir, small_batches, table, with_fields
from .langid import remainder

TOP_WORDS, SUFFIXES = 640, 127
CLASSES, ROUNDS = 64, 8
#: Added to word counts within a class; weight of the class unigram in a transition.
DELTA, BETA = 1.0, 20.0
BLOCK_BYTES = 12 << 20
#: A block names its words with so many training tokens when the most frequent are looked for.
OFTEN = 8
UNITS = TOP_WORDS + SUFFIXES + 1
END = UNITS - 1
#: A word's neighbours: classes after it, classes before it, itself.
SIDES = 2 * CLASSES + 1


def tokens(raw: bytes | None) -> list[bytes]:
    """Words of a UTF-8 text; bytes.lower() and bytes.split() know ASCII only, as asked."""
    return raw.lower().split() if raw else []


def suffix_unit(word: bytes) -> int:
    return TOP_WORDS + zlib.crc32(word[-2:]) % SUFFIXES


class Units(dict):
    """Word -> unit; words beyond those given by their suffix, as units from `first` on."""

    def __init__(self, own: dict[bytes, int], first: int):
        super().__init__(own)
        self.first = first

    def __missing__(self, word: bytes) -> int:
        unit = self.first + zlib.crc32(word[-2:]) % SUFFIXES
        if len(self) < 500_000:  # memory of one worker; the unit is computed again beyond it
            self[word] = unit
        return unit


class Slots(dict):
    """Word -> place in a block's list of words."""

    def __missing__(self, word: bytes) -> int:
        slot = self[word] = len(self)
        return slot


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(pairs: np.ndarray, classes: int = CLASSES, rounds: int = ROUNDS) -> np.ndarray:
    """Class of each unit by exchange clustering of the bigram counts. The last unit (end of
    text) keeps a class of its own, the last one."""
    units = len(pairs)
    heavy = np.argsort(-pairs.sum(0)[:-1], kind="stable")
    cls = np.empty(units, np.int64)
    cls[heavy] = np.arange(units - 1) % (classes - 1)
    cls[-1] = classes - 1
    member = np.zeros((units, classes))
    member[np.arange(units), cls] = 1
    grid = member.T @ pairs @ member
    for _ in range(rounds):
        moved = 0
        for w in heavy:
            own = pairs[w, w]
            right = np.bincount(cls, pairs[w], classes)
            left = np.bincount(cls, pairs[:, w], classes)
            if not right.any() and not left.any():
                continue
            a = cls[w]
            right[a] -= own
            left[a] -= own
            grid[a, :] -= right
            grid[:, a] -= left
            grid[a, a] -= own
            base = _xlogx(grid)
            rows, cols = _xlogx(grid + right) - base, _xlogx(grid + left[:, None]) - base
            diagonal = np.arange(classes)
            both = _xlogx(grid[diagonal, diagonal] + right + left + own) - base[diagonal, diagonal]
            out, into = grid.sum(1), grid.sum(0)
            gain = rows.sum(1) + cols.sum(0) - rows[diagonal, diagonal] - cols[diagonal, diagonal] + both
            gain -= _xlogx(out + right.sum() + own) - _xlogx(out) + _xlogx(into + left.sum() + own) - _xlogx(into)
            gain[-1] = -np.inf
            b = int(gain.argmax())
            if gain[b] <= gain[a] + 1e-9:
                b = a
            cls[w] = b
            grid[b, :] += right
            grid[:, b] += left
            grid[b, b] += own
            moved += b != a
        if not moved:
            break
    return cls


@dataclass
class ClassModel:
    """What scoring needs besides the counts of a block's own words: all of fixed size."""

    top: dict[bytes, int]  # the most frequent words, each a unit
    top_counts: np.ndarray
    class_of: np.ndarray  # unit -> class
    grid: np.ndarray  # counts of neighbouring classes
    transition: np.ndarray  # log10 P(class | class before)
    mass: np.ndarray  # class -> count + D * (types + 1)
    total: int  # training tokens
    types: int
    ends: int  # training texts


def class_model(grid: np.ndarray, types_by_class: np.ndarray, cls: np.ndarray, top: dict[bytes, int], top_counts: np.ndarray, total: int = 0, types: int = 0, ends: int = 0) -> ClassModel:
    counts = grid.sum(0)
    alone = (counts + 1) / (counts.sum() + CLASSES)
    transition = (grid + BETA * alone) / (grid.sum(1, keepdims=True) + BETA)
    return ClassModel(top, top_counts, cls, grid, np.log10(transition), counts + DELTA * (types_by_class + 1), total, types, ends)


def _texts(docs: DataFrame) -> Column:
    return F.coalesce(F.col("text").cast("binary"), F.lit(b""))


def often(docs: DataFrame, training: Column, least: int) -> DataFrame:
    """(word, c) summed over the blocks that hold at least `least` tokens of the word in
    training texts; the null word counts the blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, size = Counter(), 0

        def send() -> pa.RecordBatch:
            some = [(w, n) for w, n in counts.items() if n >= least]
            counts.clear()
            return pa.RecordBatch.from_arrays([pa.array([None, *(w for w, _ in some)], pa.binary()), pa.array([1, *(n for _, n in some)], pa.int64())], names=["word", "n"])

        for batch in batches:
            for raw in batch.column(0):
                raw = raw.as_py()
                counts.update(tokens(raw))
                size += len(raw)
                if size >= BLOCK_BYTES:
                    yield send()
                    size = 0
        yield send()

    return docs.filter(training).select(_texts(docs).alias("raw")).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c"))


def frequent_words(docs: DataFrame, training: Column) -> list[bytes]:
    """A superset of the TOP_WORDS most frequent training words, mostly little larger. A word
    that a block leaves out has under OFTEN tokens there, which bounds what the sums lack;
    where the bound does not tell the most frequent words apart, all tokens are summed."""
    for least in (OFTEN, 1):
        sums = materialise(often(docs, training, least), "often")
        blocks = sums.filter(F.col("word").isNull()).agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
        words = sums.filter(F.col("word").isNotNull())
        last = words.orderBy(F.desc("c")).limit(TOP_WORDS).agg(F.min("c"), F.count("*")).first()
        floor = (last[0] if last[1] == TOP_WORDS else 0) - (least - 1) * blocks
        near = [] if least > 1 and floor <= 0 else words.filter(F.col("c") >= floor).orderBy(F.desc("c"), "word").select("word").limit(4 * TOP_WORDS + 1 if least > 1 else TOP_WORDS).collect()
        discard(sums)
        if least == 1 or 0 < len(near) <= 4 * TOP_WORDS:
            return [bytes(r["word"]) for r in near]
    raise AssertionError


def unit_pairs(docs: DataFrame, training: Column, words: list[bytes]) -> np.ndarray:
    """Counts of neighbouring units over all training texts: the words given, the suffixes of
    all others, the end of a text."""
    size = len(words) + SUFFIXES + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, grid = Units({w: i for i, w in enumerate(words)}, len(words)), np.zeros(size * size, np.int64)
        get = units.__getitem__
        for batch in batches:
            parts = [np.array([size - 1], np.int32)]
            for raw in batch.column(0):
                found = tokens(raw.as_py())
                parts.append(np.fromiter(map(get, found), np.int32, len(found)))
                parts.append(parts[0])
            s = np.concatenate(parts)
            grid += np.bincount(s[:-1] * size + s[1:], minlength=size * size)
        at = np.flatnonzero(grid)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(grid[at], pa.int64())], names=["pair", "n"])

    sent = docs.filter(training).select(_texts(docs).alias("raw")).mapInArrow(run, "pair long, n long")
    # size squared rows at most, and size has a bound.
    got = sent.groupBy("pair").agg(F.sum("n").alias("n")).toPandas()
    pairs = np.zeros(size * size)
    pairs[got["pair"].to_numpy(np.int64)] = got["n"].to_numpy(np.float64)
    return pairs.reshape(size, size)


def fit(docs: DataFrame, training: Column) -> ClassModel:
    """Classes of the units."""
    words = frequent_words(docs, training)
    wide = unit_pairs(docs, training, words)
    counts = wide.sum(0)  # exact counts of all words given
    ranked = sorted(range(len(words)), key=lambda i: (-counts[i], words[i]))[:TOP_WORDS]
    top = {words[i]: k for k, i in enumerate(ranked)}
    # Words given that are not among the most frequent ones go to their suffixes.
    unit = np.array([top.get(w, suffix_unit(w)) for w in words] + [TOP_WORDS + i for i in range(SUFFIXES)] + [END], np.int64)
    pairs = np.zeros((UNITS, UNITS))
    np.add.at(pairs, (unit[:, None], unit[None, :]), wide)
    cls = exchange(pairs)
    member = np.zeros((UNITS, CLASSES))
    member[np.arange(UNITS), cls] = 1
    return class_model(member.T @ pairs @ member, np.zeros(CLASSES), cls, top, counts[ranked].astype(np.int64))


def neighbours(ids: list[np.ndarray], cls: np.ndarray, first: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """What stands beside the slots from `first` on in the texts ids: offsets by slot and
    pairs of bytes (neighbour, count). cls: slot -> class; end: class of the text's end."""
    edge = np.array([-1], np.int32)
    s = np.concatenate([edge, *(x for y in ids for x in (y, edge))])
    ring, free = np.r_[cls, np.int32(end)], np.r_[np.arange(len(cls)) >= first, False]  # -1 is the end of a text
    wide = np.int32 if len(cls) * SIDES < 1 << 31 else np.int64
    middle, keys = s[1:-1].astype(wide), []
    for side, near in enumerate((s[2:], s[:-2])):
        same = near == middle
        use = free[middle] & ~same if side else free[middle]  # a pair of one word counts once
        code = ring[near] + side * CLASSES
        code[same] = SIDES - 1
        keys.append(middle[use] * wide(SIDES) + code[use].astype(wide))
    key = np.concatenate(keys)
    del s, middle, keys
    key.sort()
    new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    n = np.diff(np.r_[new, len(key)])
    parts = -(-n // 255)  # a count over 255 is several pairs
    key, last = np.repeat(key[new], parts), np.cumsum(parts) - 1
    size = np.full(len(key), 255, np.int64)
    size[last] = n - 255 * (parts - 1)
    off = 2 * np.searchsorted(key, np.arange(first, len(cls) + 1, dtype=np.int64) * SIDES)
    return off.astype(np.int32), np.stack([key % SIDES, size], 1).astype(np.uint8).ravel()


def coded(docs: DataFrame, training: Column, keep: list[str], model: ClassModel, folder: str) -> DataFrame:
    """(block, word, code, near): each block's words that are not among the most frequent,
    with slot << 8 | class of the word's unit and its neighbours, and one row without a word.
    The block's texts (keep.., _train, _ids), as slots, are a file in folder."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    names = [*keep, "_train", "_raw"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        store, path = fs.FileSystem.from_uri(folder)
        store.create_dir(path, recursive=True)
        top = len(m.top)
        known = m.class_of[np.arange(top)].astype(np.int32)

        def flush(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            rows = pa.Table.from_batches(parts)
            slots, ids = Slots(m.top), []
            get = slots.__getitem__
            for raw in rows.column("_raw"):
                found = tokens(raw.as_py())
                ids.append(np.fromiter(map(get, found), np.int32, len(found)))
            block = uuid.uuid4().int >> 65
            texts = rows.drop_columns(["_raw"]).append_column("_ids", pa.array([x.tobytes() for x in ids], pa.binary()))
            name = f"{path}/{block:016x}"
            with store.open_output_stream(name + ".part") as out, pa.ipc.new_file(out, texts.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as file:
                file.write_table(texts)
            store.move(name + ".part", name)
            words = list(slots)[top:]
            cls = np.r_[known, np.fromiter((m.class_of[suffix_unit(w)] for w in words), np.int32, len(words))].astype(np.int32)
            off, near = neighbours([x for x, learn in zip(ids, rows.column("_train").to_pylist(), strict=True) if learn], cls, top, int(m.class_of[END]))
            del slots, get, ids, texts
            k = len(words)
            near = pa.Array.from_buffers(pa.binary(), k, [None, pa.py_buffer(off), pa.py_buffer(near)])
            code = np.arange(top, top + k, dtype=np.int64) << 8 | cls[top:]
            out = [pa.array(np.full(k + 1, block)), pa.concat_arrays([pa.array(words, pa.binary()), pa.nulls(1, pa.binary())]), pa.array(np.r_[code, -256]), pa.concat_arrays([near, pa.array([b""], pa.binary())])]
            return pa.RecordBatch.from_arrays(out, names=["block", "word", "code", "near"])

        parts, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            batch = pa.RecordBatch.from_arrays(batch.columns, names=names)
            parts.append(batch)
            size += batch.column("_raw").nbytes
            if size >= BLOCK_BYTES:
                made = flush(parts)
                parts, size = [], 0
                yield from (made.slice(i, 50_000) for i in range(0, made.num_rows, 50_000))
                del made
                pa.default_memory_pool().release_unused()
        if parts:
            yield flush(parts)

    source = docs.select(*keep, training.alias("_train"), _texts(docs).alias("_raw"))
    return materialise(source.mapInArrow(run, "block long, word binary, code long, near binary"), "block-words")


def likeliest(near: np.ndarray, now: np.ndarray, model: ClassModel) -> np.ndarray:
    """Class of each word in which its own bigrams (rows of SIDES counts) are likeliest, the
    classes of its neighbours held; its counts are first taken out of the class it is in."""
    right, left, own = near[:, :CLASSES], near[:, CLASSES:-1], near[:, -1]
    n = left.sum(1) + own
    counts = model.grid.sum(0)
    alone = (counts + 1) / (counts.sum() + CLASSES)
    t = np.log(10) * model.transition
    gain = right @ t.T + left @ t + own[:, None] * np.diagonal(t) - n[:, None] * np.log(model.mass)
    # The same for the word's own class without the word.
    at = np.arange(len(now))
    out = np.maximum(model.grid.sum(1)[now] - n, 0) + BETA
    after = (np.maximum(model.grid[now] - right, 0) + BETA * alone) / out[:, None]
    before = (np.maximum(model.grid[:, now].T - left, 0) + BETA * alone[now][:, None]) / (model.grid.sum(1) + BETA)
    itself = (np.maximum(model.grid[now, now] - own - right[at, now] - left[at, now], 0) + BETA * alone[now]) / out
    mass = np.maximum(model.mass[now] - n - DELTA, DELTA)
    gain[at, now] = (right * np.log(after)).sum(1) + (left * np.log(before)).sum(1) + own * np.log(itself) - n * np.log(mass)
    gain[:, -1] = -np.inf  # the end of a text is alone in its class
    best = gain.argmax(1)
    return np.where(gain[at, best] > gain[at, now] + 1e-9, best, now)


def word_classes(words: DataFrame, model: ClassModel) -> DataFrame:
    """(block, code, c): for each word of a block its training count in the whole corpus, and
    slot << 8 | class << 1 | whether this is the word's first row."""
    held = words.sparkSession.sparkContext.broadcast(model)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        # Classes of words that stand once in the corpus, by both neighbours and unit class.
        once = np.full(CLASSES**3, -1, np.int16)

        def classes(counts: np.ndarray, now: np.ndarray) -> np.ndarray:
            right, left = counts[:, :CLASSES], counts[:, CLASSES:-1]
            single = (right.sum(1) == 1) & (left.sum(1) == 1) & (counts[:, -1] == 0)
            out = now.copy()
            rest = ~single & counts.any(1)
            if rest.any():
                out[rest] = likeliest(counts[rest], now[rest], m)
            key = (right[single].argmax(1) * CLASSES + left[single].argmax(1)) * CLASSES + now[single]
            new, at = np.unique(key[once[key] < 0], return_index=True)
            if len(new):
                rows = np.flatnonzero(single)[np.flatnonzero(once[key] < 0)[at]]
                once[new] = likeliest(counts[rows], now[rows], m)
            out[single] = once[key]
            return out

        def decided(rows: pa.Table) -> pa.RecordBatch:
            word = rows.column("word").combine_chunks().dictionary_encode().indices.to_numpy().astype(np.int64)  # sorted words: in rising order
            near = rows.column("near").combine_chunks()
            off = np.frombuffer(near.buffers()[1], np.int32)[near.offset : near.offset + len(near) + 1].astype(np.int64)
            data = near.buffers()[2]
            pairs = np.frombuffer(data, np.uint8)[off[0] : off[-1]].reshape(-1, 2).astype(np.int64) if data is not None else np.zeros((0, 2), np.int64)
            k = int(word[-1]) + 1
            owner = np.repeat(word, np.diff(off) // 2)
            counts = np.bincount(owner * SIDES + pairs[:, 0], pairs[:, 1], k * SIDES).reshape(k, SIDES)
            code = rows.column("code").to_numpy()
            now = np.zeros(k, np.int64)
            now[word] = code & 255
            c = (counts[:, :CLASSES].sum(1) + counts[:, -1]).astype(np.int64)  # each token has one successor
            first = np.r_[True, word[1:] != word[:-1]]
            made = (code >> 8 << 8) | classes(counts, now)[word] << 1 | first
            return pa.RecordBatch.from_arrays([rows.column("block").combine_chunks(), pa.array(made), pa.array(c[word])], names=["block", "code", "c"])

        rest: list[pa.RecordBatch] = []
        for batch in batches:
            bare = batch.column("word").null_count
            if bare:
                alone = batch.filter(batch.column("word").is_null())
                yield pa.RecordBatch.from_arrays([alone.column("block"), alone.column("code"), pa.array(np.zeros(len(alone), np.int64))], names=["block", "code", "c"])
                batch = batch.filter(batch.column("word").is_valid())
            if not batch.num_rows:
                continue
            # The batch's last word may go on in the next one.
            if rest and batch.column("word")[-1] == rest[0].column("word")[-1] == rest[0].column("word")[0]:
                rest.append(batch)
                continue
            rows = pa.Table.from_batches([*rest, batch]).combine_chunks()
            last, words_ = rows.column("word")[-1], rows.column("word")
            k = rows.num_rows - 1
            while k and words_[k - 1] == last:
                k -= 1
            rest = rows.slice(k).combine_chunks().to_batches()
            if k:
                yield decided(rows.slice(0, k).combine_chunks())
        if rest:
            yield decided(pa.Table.from_batches(rest).combine_chunks())

    return words.repartition("word").sortWithinPartitions("word").mapInArrow(choose, "block long, code long, c long")


def paths(classed: DataFrame, docs: DataFrame, keep: list[str], model: ClassModel, folder: str) -> DataFrame:
    """keep, _train and, of each text, the classes of its words (a byte each), how many of
    them are known, and the sums of log10 (count + 1) and log10 (count + DELTA). A block's
    first text also has the number of words by class that the block counts as theirs."""
    schema = with_fields(docs.select(*keep), "_train boolean, _path binary, _known long, _plain double, _emit double, _types binary")
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(own: pa.Table) -> pa.Table:
        m = held.value
        code, count = own.column("code").to_numpy(), own.column("c").to_numpy()
        code, count = code[code >= 0], count[code >= 0]
        slot, top = code >> 8, len(m.top)
        c, cls = np.zeros(top + len(code), np.int64), np.zeros(top + len(code), np.uint8)
        c[:top], cls[:top] = m.top_counts, m.class_of[:top]
        c[slot], cls[slot] = count, code >> 1 & 127
        types = np.bincount((code >> 1 & 127)[(code & 1 > 0) & (count > 0)], minlength=CLASSES)
        plain, emit = np.log10(c + 1.0), np.log10(c + DELTA)
        store, path = fs.FileSystem.from_uri(folder)
        with store.open_input_file(f"{path}/{own.column('block')[0].as_py():016x}") as file:
            rows = pa.ipc.open_file(file).read_all()
        made = []
        for raw in rows.column("_ids"):
            ids = np.frombuffer(raw.as_py(), np.int32)
            made.append((cls[ids].tobytes(), int((c[ids] > 0).sum()), plain[ids].sum(), emit[ids].sum()))
        columns = [pa.array(list(x), t) for x, t in zip(zip(*made, strict=True), (pa.binary(), pa.int64(), pa.float64(), pa.float64()), strict=True)]
        first = pa.array([types.astype("<i8").tobytes(), *[None] * (len(rows) - 1)], pa.binary())
        return pa.table([*(rows.column(x) for x in keep), rows.column("_train"), *columns, first], names=schema.names)

    return materialise(classed.groupBy("block").applyInArrow(run, schema), "paths")


def refit(walked: DataFrame, model: ClassModel) -> ClassModel:
    """The model with the counts of the words' own classes."""
    cells = CLASSES * CLASSES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Cells of the grid, types by class, training tokens, training texts.
        sums, end = np.zeros(cells + CLASSES + 2, np.int64), bytes([CLASSES - 1])
        for batch in batches:
            for raw in batch.column(2).drop_null():
                sums[cells : cells + CLASSES] += np.frombuffer(raw.as_py(), "<i8")
            learned = [raw.as_py() for raw in batch.column(1).filter(batch.column(0))]
            s = np.frombuffer(end + b"".join(x + end for x in learned), np.uint8).astype(np.int64)
            sums[:cells] += np.bincount(s[:-1] * CLASSES + s[1:], minlength=cells)
            sums[-2:] += len(s) - 1, len(learned)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(sums[at], pa.int64())], names=["cell", "n"])

    sums = np.zeros(cells + CLASSES + 2, np.int64)
    for r in walked.select("_train", "_path", "_types").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():  # len(sums) rows at most
        sums[r["cell"]] = r["n"]
    types, total, ends = sums[cells : cells + CLASSES].astype(float), int(sums[-2]), int(sums[-1])
    types += np.bincount(model.class_of[: len(model.top)], minlength=CLASSES)
    types[-1] = ends > 0
    return class_model(sums[:cells].reshape(CLASSES, CLASSES).astype(float), types, model.class_of, {}, model.top_counts, total, int(types.sum()), ends)


def score_paths(walked: DataFrame, model: ClassModel, keep: list[str]) -> DataFrame:
    """keep and the scores of each row."""
    held = walked.sparkSession.sparkContext.broadcast(model)
    schema = with_fields(walked.select(*keep), "n_tokens long, n_known long, train_tokens long, base_score double, score double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        last, mass = CLASSES - 1, np.log10(m.mass)
        emit_end, plain_end = np.log10(m.ends + DELTA) - mass[last], np.log10(m.ends + 1.0)
        each = np.log10(m.total + m.types + 1.0)
        for batch in batches:
            n, moves = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            for i, raw in enumerate(batch.column("_path")):
                path = np.frombuffer(raw.as_py(), np.uint8)
                n[i] = len(path) + 1
                around = np.concatenate(([last], path, [last]))
                moves[i] = m.transition[around[:-1], around[1:]].sum() - mass[path].sum()
            known, plain, emit = (batch.column(x).to_numpy() for x in ("_known", "_plain", "_emit"))
            columns = [pa.array(n), pa.array(known + (m.ends > 0)), pa.array(np.full(len(n), m.total, np.int64)), pa.array(plain + plain_end - n * each), pa.array(emit + emit_end + moves)]
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in keep), *columns], names=schema.names)

    return walked.mapInArrow(run, schema)


def score(docs: DataFrame, training: Column, keep: list[str]) -> DataFrame:
    """The columns keep of docs with n_tokens, n_known, train_tokens, base_score (add-one
    unigrams) and score (class bigrams), both log10; the model learns from `training` rows."""
    spark = docs.sparkSession
    small_batches(spark)
    folder = f"{shared_dir(spark)}/nearspan-blocks-{uuid.uuid4().hex}"
    first = fit(docs, training)
    words = coded(docs, training, keep, first, folder)
    walked = paths(word_classes(words, first), docs, keep, first, folder)
    discard(words, folder)
    return score_paths(walked, refit(walked, first), keep)


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (remainder(7) == 2).alias("held_out"))
    return score(docs, ~F.col("held_out"), ["doc_id", "held_out"])
