"""BPE encoding and decoding over contiguous rank arrays.

A text is cut into pieces by the tokenizer's pattern. Each piece of a batch that is not
known yet becomes one row of two arrays: the part ids between its boundaries and the merge
ranks of adjacent parts. Pieces of one length stand in one matrix, so a step scans every
row for its least rank, deletes that boundary by closing the gap, and looks up the two
neighbouring ranks again, for thousands of pieces at once. Rows end when no rank is left.

The vocabulary file's path is a parameter; the file holds `vocab` and `merges` of a
byte-level BPE and its added tokens, which are matched in the text before the pattern.

Defined results: a null text is an empty one (no ids, sha of nothing); lone copies of an
added token become its id; rows are independent, so repeats and ties need no rule; a very long
text is encoded whole; columns called as those that are added are replaced, others stay; an
empty table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table, with_fields

#: Fixed value: the byte-level pattern of the public vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
NO_RANK = np.int32(2**31 - 1)
#: Pieces up to this many bytes are short words, which share matrices.
SHORT = 64
#: Pieces, and characters of pieces, remembered by one Python worker; the store is emptied
#: beyond either (memory only).
REMEMBERED, REMEMBERED_CHARS = 150_000, 8_000_000


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1
    bytes stand for themselves, the others for code points from 256 on, in order."""
    printable = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    kept, spare = set(printable), iter(range(256, 512))
    return [chr(b) if b in kept else chr(next(spare)) for b in range(256)]


class Tokenizer:
    """Encodes and decodes with one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab: dict[str, int] = spec["model"]["vocab"]
        symbols = byte_symbols()
        back = {s: b for b, s in enumerate(symbols)}
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes_of: dict[int, bytes] = {i: bytes(back[c] for c in s) for s, i in vocab.items() if all(c in back for c in s)}
        self.bytes_of.update({i: s.encode() for s, i in self.added.items()})
        self.byte_ids = np.array([vocab[s] for s in symbols], np.int32)
        left, right, result = [], [], []
        for m in spec["model"]["merges"]:
            x, y = m.split(" ") if isinstance(m, str) else m
            left.append(vocab[x]), right.append(vocab[y]), result.append(vocab[x + y])
        self.span = max(vocab.values()) + 1
        # A merge makes no pair of lesser rank: each id is made before any merge uses it. Then
        # merging all pairs of the least rank at once is what one merge at a time gives.
        used: dict[int, int] = {}
        for rank, ids in enumerate(zip(left, right, strict=True)):
            for i in ids:
                used.setdefault(i, rank)
        self.rising = all(used.get(i, len(result)) > rank for rank, i in enumerate(result))
        keys = np.array(left, np.int64) * self.span + np.array(right, np.int64)
        self._index(keys, np.array(result, np.int32))
        self.pattern = regex.compile(PATTERN)
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.known: dict[str, tuple[str, str]] = {}
        self.known_chars = 0

    def _index(self, keys: np.ndarray, result: np.ndarray) -> None:
        """Open addressing over 2^19 slots: slot -> rank, found by whole-array probes."""
        self.mask = (1 << 19) - 1
        self.slot_key = np.full(self.mask + 1, -1, np.int64)
        self.slot_rank = np.full(self.mask + 1, NO_RANK, np.int32)
        self.result = result
        todo, at = np.arange(len(keys)), self._slot(keys)
        self.probes = 0
        while len(todo):
            self.probes += 1
            free = self.slot_key[at] < 0
            first = np.zeros(len(todo), bool)
            first[np.unique(at, return_index=True)[1]] = True
            put = free & first
            self.slot_key[at[put]] = keys[todo[put]]
            self.slot_rank[at[put]] = todo[put]
            todo, at = todo[~put], (at[~put] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(45)).astype(np.int64) & self.mask

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Merge rank of each pair of ids, NO_RANK where there is none."""
        keys = a.astype(np.int64) * self.span + b
        at = self._slot(keys)
        seen = self.slot_key[at]
        out = np.where(seen == keys, self.slot_rank[at], NO_RANK)
        open_ = np.flatnonzero((seen != keys) & (seen >= 0))
        for _ in range(self.probes):
            if not len(open_):
                break
            at[open_] = (at[open_] + 1) & self.mask
            seen = self.slot_key[at[open_]]
            hit = seen == keys[open_]
            out[open_[hit]] = self.slot_rank[at[open_[hit]]]
            open_ = open_[~hit & (seen >= 0)]
        return out

    def merge(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each piece. Short pieces of one length share a matrix; longer ones merge pair
        by pair of ids, where the ranks allow it, else they are matrices too."""
        out: list = [None] * len(words)
        by_length: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by_length.setdefault(len(w), []).append(i)
        for n, members in by_length.items():
            if n > SHORT and self.rising:
                for i in members:
                    out[i] = self._merge_long(words[i])
                continue
            for k in range(0, len(members), 8192):
                part = members[k : k + 8192]
                raw = np.frombuffer(b"".join([words[i] for i in part]), np.uint8).reshape(len(part), n)
                for i, ids in zip(part, self._merge_matrix(self.byte_ids[raw]), strict=True):
                    out[i] = ids
        return out

    def _merge_matrix(self, ids: np.ndarray) -> list[list[int]]:
        rows, n = ids.shape
        ranks = np.full((rows, n), NO_RANK, np.int32)
        if n > 1:
            ranks[:, :-1] = self.ranks(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(rows, n - 1)
        done: list = [None] * rows
        where, length = np.arange(rows), n
        columns = np.arange(n)
        while True:
            at = ranks.argmin(axis=1)
            span = np.arange(len(at))
            best = ranks[span, at]
            over = best == NO_RANK
            if over.any():
                for r, row in zip(where[over].tolist(), ids[over].tolist(), strict=True):
                    done[r] = row[:length]
                keep = ~over
                ids, ranks, where, at, best = ids[keep], ranks[keep], where[keep], at[keep], best[keep]
                span = np.arange(len(at))
                if not len(at):
                    return done
            ids[span, at] = self.result[best]
            # Delete the boundary: what stands right of it moves one place left.
            source = columns[None, :length] + (columns[None, :length] > at[:, None])
            np.minimum(source, length - 1, out=source)
            ids = np.take_along_axis(ids[:, :length], source, 1)
            ranks = np.take_along_axis(ranks[:, :length], source, 1)
            length -= 1
            ids, ranks = ids[:, :length], ranks[:, :length]
            ranks[:, length - 1] = NO_RANK
            right = np.flatnonzero(at < length - 1)
            ranks[right, at[right]] = self.ranks(ids[right, at[right]], ids[right, at[right] + 1])
            left = np.flatnonzero(at > 0)
            ranks[left, at[left] - 1] = self.ranks(ids[left, at[left] - 1], ids[left, at[left]])

    def _merge_long(self, word: bytes) -> list[int]:
        """A piece over SHORT bytes: in each round every pair of the least rank merges, from left
        to right without overlaps, which is what repeating single merges of that rank does."""
        ids = self.byte_ids[np.frombuffer(word, np.uint8)]
        while len(ids) > 1:
            ranks = self.ranks(ids[:-1], ids[1:])
            best = ranks.min()
            if best == NO_RANK:
                break
            at = np.flatnonzero(ranks == best)
            # In a run of neighbouring hits every second one merges.
            start = np.r_[True, np.diff(at) != 1]
            run = np.maximum.accumulate(np.where(start, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - run) % 2 == 0]
            ids[at] = self.result[best]
            ids = np.delete(ids, at + 1)
        return ids.tolist()

    def learn(self, pieces: set[str]) -> None:
        """Encodes pieces that are not known: its ids as text, and those ids decoded."""
        new = list(pieces)
        for piece, ids in zip(new, self.merge([p.encode() for p in new]), strict=True):
            text = self.decode(ids)  # a piece is made of whole characters, so it decodes alone
            self.known[piece] = (",".join(map(str, ids)), piece if text == piece else text)
            self.known_chars += len(piece)

    def decode_bytes(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def decode(self, ids) -> str:
        """Text of ids; bytes that are no UTF-8 become replacement characters."""
        return self.decode_bytes(ids).decode("utf-8", "replace")

    def pieces(self, text: str) -> list[str]:
        if self.special is None or not any(s in text for s in self.added):
            return self.pattern.findall(text)
        out: list[str] = []
        for part in self.special.split(text):
            out += [part] if part in self.added else self.pattern.findall(part)
        return out

    def encode_batch(self, texts: list[str]) -> Iterator[tuple[int, str, str]]:
        """For each text: number of ids, the ids as decimal text, the text they decode to."""
        cut, at = [], 0
        while at < len(texts):
            size = 0
            cut.clear()
            while at < len(texts) and size < 1 << 20:
                cut.append(self.pieces(texts[at]))
                size += len(texts[at])
                at += 1
            for s, i in self.added.items():
                self.known[s] = (str(i), s)
            wanted = {p for pieces in cut for p in pieces}
            new = wanted - self.known.keys()
            if len(self.known) + len(new) > REMEMBERED or self.known_chars > REMEMBERED_CHARS:
                self.known.clear()
                self.known_chars = 0
                self.known.update({s: (str(i), s) for s, i in self.added.items()})
                new = wanted - self.known.keys()
            self.learn(new)
            get = self.known.__getitem__
            for pieces in cut:
                pairs = list(map(get, pieces))
                ids = ",".join([p[0] for p in pairs])
                yield (ids.count(",") + 1 if ids else 0), ids, "".join([p[1] for p in pairs])

    def encode(self, text: str) -> list[int]:
        ((_, ids, _),) = self.encode_batch([text])
        return [int(x) for x in ids.split(",")] if ids else []


@functools.lru_cache(2)
def tokenizer(path: str) -> Tokenizer:
    """One for each Python worker and file."""
    return Tokenizer(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """docs with the token ids of `text` and the text they decode to."""
    small_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c.lower() not in (ids.lower(), decoded.lower())]
    schema = with_fields(docs.select(*kept), f"`{ids}` array<int>, `{decoded}` string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path)
        for batch in batches:
            texts = [t or "" for t in batch.column(kept.index(text)).to_pylist()]
            made = list(tok.encode_batch(texts))
            columns = [
                pa.array([np.array(s.split(","), np.int32) if s else np.zeros(0, np.int32) for _, s, _ in made], pa.list_(pa.int32())),
                pa.array([x for _, _, x in made], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*kept, ids, decoded])

    return docs.select(*kept).mapInArrow(run, schema)


def digests(docs: DataFrame, path: str, keep: list[str]) -> DataFrame:
    """The columns `keep` of docs with n_tokens, ids_sha256 and decoded_sha256 of its text."""
    small_batches(docs.sparkSession)
    source = docs.select(*keep, F.col("text").alias("_text"))
    schema = with_fields(docs.select(*keep), "n_tokens long, ids_sha256 string, decoded_sha256 string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path)
        for batch in batches:
            texts = [t or "" for t in batch.column(len(keep)).to_pylist()]
            n, ids, decoded = [], [], []
            for count, s, back in tok.encode_batch(texts):
                n.append(count)
                ids.append(hashlib.sha256(s.encode()).hexdigest())
                decoded.append(hashlib.sha256(back.encode()).hexdigest())
            made = [pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *made], names=[*keep, "n_tokens", "ids_sha256", "decoded_sha256"])

    return source.mapInArrow(run, schema)


def op3_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), path or default_path(), ["doc_id"])
