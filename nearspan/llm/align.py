"""Alignment of two tokenizers over the same bytes, in relational steps.

Both tokenizers cut a text (with one space before it) at every single space that stands between
two characters other than white space: neither has a token across it. The same holds between a
letter and the sign or line end after it, and between a line end and the letter after it, where
the vocabularies allow it (checked). So a text is a sequence of parts, the bytes of which are the
text's, and all that holds for a text is the sum over its parts. Alignment runs once for each
distinct part of the corpus:

1. tokens of a part are exploded with their positions; running sums of their byte lengths
   (window by part) are their ends;
2. A and B meet in a full equi-join on (part, end). An end that both have is a cut;
3. two tokens overlap in exactly one stretch between neighbouring ends, so a row of that join is
   a link: between the next A token and the next B token that end there or later (window). No
   pairs of a group are listed beyond those that overlap. A part's links, in order, each with the
   two ids and which of them end there, are all that is kept: the running count of cuts numbers
   its groups, and their text follows from it.

Documents are packed into blocks of bounded size: a block has its distinct parts once and each
document as numbers of parts. A block's parts meet their alignments by an equi-join, and what a
document needs (sums, its groups in order, its distinct id pairs) is added up block by block;
the number of documents of an id pair is summed over blocks, and its sums go back to blocks by
part. A very frequent part is one row a block.

Defined results: a null or empty text, and one whose tokens do not give its bytes back, has
zeros and an empty text for its groups, and counts in no id pair; repeated rows count as
documents of their own; a text without single spaces is one part; ties for an A id's highest
count all are best; an empty table gives no rows; other columns are not used, whatever their
names. Strings of special tokens are plain text.
"""

from __future__ import annotations

import functools
import gc
import hashlib
import re
import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bpe import default_path, tokenizer
from .common import discard, materialise, small_batches, table, views
from .tokenfile import encoder

#: Bytes of text in one block; a longer text is a block of its own.
BLOCK_BYTES = 16 << 20
#: Parts of documents whose id pairs are looked at together in one block (memory only).
SLICE_PARTS = 1 << 18
#: A single space between two characters that are no white space.
SPACE = re.compile(r"(?<=\S) (?=\S)")
#: Between a letter and an ASCII sign (no apostrophe) or line end, or a single line end and a letter.
SIGN = re.compile(r"(?<=[A-Za-zÀ-ÖØ-öø-ɏ])(?=[!-&(-/:-@\[-`{-~\n])|(?<=\S\n)(?=[A-Za-zÀ-ÖØ-öø-ɏ])")
#: Bits of a link: whether its A token, its B token ends with it; then the B id, the A id.
A_ENDS, B_ENDS, B_AT, A_AT = 1, 2, 2, 32


def default_pieces() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pair:
    """Ids and byte lengths of a part's tokens under both tokenizers."""

    def __init__(self, bytes_path: str, pieces_path: str):
        import sentencepiece

        self.a = encoder(bytes_path, special=False)
        self.a_bytes = tokenizer(bytes_path).bytes_of
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces_path)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError(f"{pieces_path} has pieces across spaces")
        self.b_bytes = [bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]

    def tokens_a(self, parts: list[str]) -> list[list[int]]:
        """Parts are encoded together, after a space or a line end each, where those stand alone
        (no other white space at either end)."""
        out: list = [None] * len(parts)
        inner = [p[p[:1] == " " :] for p in parts]
        alone = [p and not p[0].isspace() and not p[-1].isspace() for p in inner]
        for lead in (" ", "\n"):
            some_led = [i for i, p in enumerate(parts) if alone[i] and (p[0] == " ") == (lead == " ")]
            for k in range(0, len(some_led), 512):
                some = some_led[k : k + 512]
                ids = self.a.ids(lead + lead.join([inner[i] for i in some])).tolist()
                sizes = np.cumsum([len(self.a_bytes[t]) for t in ids])
                ends = np.cumsum([len(inner[i].encode()) + 1 for i in some])
                cut = np.searchsorted(sizes, ends)
                first = np.r_[0, cut[:-1] + 1]
                if (sizes[cut] != ends).any() or (lead == "\n" and any(len(self.a_bytes[ids[x]]) > 1 for x in first)):
                    raise ValueError("a token reaches across a space")
                for i, x, y in zip(some, first + (lead == "\n"), cut + 1, strict=True):
                    out[i] = ids[x:y]
        for i, ids in enumerate(out):
            if ids is None:
                out[i] = self.a.ids(parts[i]).tolist()
        return out

    def tokens_b(self, parts: list[str]) -> list[list[int]]:
        """The library adds a space: it takes that of a part, or stands before a line end that is
        dropped again."""
        made = self.b.encode([p[1:] if p[0] == " " else "\n" + p for p in parts], num_threads=1)
        return [ids if p[0] == " " else ids[2:] for p, ids in zip(parts, made, strict=True)]

    def signs(self) -> bool:
        """Whether no token of either tokenizer reaches across SIGN: A's pattern cuts there, and B
        has no piece with such a place, nor with a line end but that of its byte."""
        b = self.b
        own = [b.id_to_piece(i) for i in range(b.get_piece_size()) if not (b.is_control(i) or b.is_unknown(i) or b.is_byte(i) or b.is_unused(i))]
        if self.a.fast is None or any("\n" in p or SIGN.search(p) for p in own):
            return False
        return [b.id_to_piece(i) for i in b.encode("\n")] == ["▁", "<0x0A>"]

    def tokens(self, parts: list[str]) -> Iterator[tuple[list[int], list[int], list[int], list[int], bool]]:
        """A ids, their lengths, B ids, their lengths, whether both give the part's bytes."""
        for part, a, b in zip(parts, self.tokens_a(parts), self.tokens_b(parts), strict=True):
            raw = part.encode()
            x, y = [self.a_bytes[t] for t in a], [self.b_bytes[t] for t in b]
            same = b"".join(x) == raw and b"".join(y) == raw
            yield (a, [len(t) for t in x], b, [len(t) for t in y], True) if same else ([], [], [], [], False)


@functools.lru_cache(2)
def pair(bytes_path: str, pieces_path: str) -> Pair:
    """One for each Python worker."""
    return Pair(bytes_path, pieces_path)


def pieces(part: str, signs: bool) -> list[str]:
    """The parts of what stands between two single spaces, the first with its space."""
    return SIGN.split(" " + part) if signs else [" " + part]


def pack(docs: DataFrame, block_bytes: int = BLOCK_BYTES, signs: bool = False) -> DataFrame:
    """(block, ids, sizes, codes, parts), as a table: the documents of a block, how many parts
    each has, all their parts as numbers (compressed), and the distinct parts by number."""
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"block long, ids array<{kind}>, sizes array<int>, codes binary, parts array<string>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId() << 32, 0
        zstd = zstandard.ZstdCompressor(level=1)
        ids, sizes, codes, seen, words, held = [], [], [], {}, {}, 0
        id_type = pa.null()

        def block() -> pa.RecordBatch:
            # Byte by byte: numbers of frequent parts are small, so most high bytes are 0.
            packed = zstd.compress(np.array(codes, "<i4").view(np.uint8).reshape(-1, 4).T.tobytes())
            columns = [pa.array([task + number], pa.int64()), pa.array([ids], pa.list_(id_type)), pa.array([sizes], pa.list_(pa.int32())), pa.array([packed], pa.binary()), pa.array([list(seen)], pa.list_(pa.string()))]
            return pa.RecordBatch.from_arrays(columns, names=["block", "ids", "sizes", "codes", "parts"])

        for batch in batches:
            id_type = batch.schema.field("doc_id").type
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = []
                for word in SPACE.split(text) if text else ():
                    if (made := words.get(word)) is None:
                        made = words[word] = tuple([seen.setdefault(p, len(seen)) for p in pieces(word, signs)])
                    own += made
                ids.append(doc_id), sizes.append(len(own)), codes.extend(own)
                held += len(text) if text else 1
                if held >= block_bytes:
                    yield block()
                    number += 1
                    ids, sizes, codes, seen, words, held = [], [], [], {}, {}, 0
        if ids:
            yield block()

    return materialise(docs.select("doc_id", "text").mapInArrow(run, schema), "blocks")


def tokenise(parts: DataFrame, bytes_path: str, pieces_path: str) -> DataFrame:
    """(word, part, same, a, b) of each part, as a table; a and b are arrays of (id, size)."""
    token = pa.list_(pa.struct([("id", pa.int32()), ("size", pa.int32())]))

    def lists(ids: list[list[int]], sizes: list[list[int]]) -> pa.Array:
        flat = pa.StructArray.from_arrays([pa.array([x for i in ids for x in i], pa.int32()), pa.array([x for s in sizes for x in s], pa.int32())], names=["id", "size"])
        return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, ids)]), pa.int32()), flat).cast(token)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pair(bytes_path, pieces_path)
        for batch in batches:
            if batch.num_rows:
                a, a_size, b, b_size, same = zip(*own.tokens(batch.column(0).to_pylist()), strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(same), lists(a, a_size), lists(b, b_size)], names=["part", "same", "a", "b"])

    made = parts.mapInArrow(run, "part string, same boolean, a array<struct<id:int,size:int>>, b array<struct<id:int,size:int>>")
    return materialise(made.withColumn("word", F.monotonically_increasing_id()), "part-tokens")


def links(tokens: DataFrame) -> DataFrame:
    """(word, end, a_id, b_id, a, b) of each stretch between neighbouring ends: the tokens that
    end at its end (null where none does) and those that cover it."""
    # Dealt before tokens are exploded, a token as one number: all windows and the join keep that dealing.
    packed = [F.transform(c, lambda t: F.shiftleft(t["id"].cast("long"), 32) + t["size"]).alias(c) for c in ("a", "b")]
    dealt = tokens.filter("same").select("word", *packed).repartition("word")
    by_place = Window.partitionBy("word").orderBy("pos")

    def ends(side: str) -> DataFrame:
        rows = dealt.select("word", F.posexplode(side).alias("pos", "t"))
        size = F.col("t").bitwiseAND((1 << 32) - 1)
        return rows.select("word", F.shiftright("t", 32).cast("int").alias(f"{side}_id"), F.sum(size).over(by_place).cast("int").alias("end"))

    met = ends("a").join(ends("b"), ["word", "end"], "full_outer")
    back = Window.partitionBy("word").orderBy(F.col("end").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return met.select("*", F.last("a_id", True).over(back).alias("a"), F.last("b_id", True).over(back).alias("b"))


def align(tokens: DataFrame) -> DataFrame:
    """(word, part, same, links) of each part, as a table. links has a number for each link, in
    order: A id x 2^32 + B id x 4 + A_ENDS where the A token ends with it + B_ENDS likewise."""
    flag = lambda c, bit: F.when(F.col(c).isNotNull(), F.lit(bit)).otherwise(F.lit(0)).cast("long")
    number = F.shiftleft(F.col("a").cast("long"), A_AT) + F.shiftleft(F.col("b").cast("long"), B_AT) + flag("a_id", A_ENDS) + flag("b_id", B_ENDS)
    listed = F.sort_array(F.collect_list(F.struct("end", number.alias("link"))))
    words = links(tokens).groupBy("word").agg(F.transform(listed, lambda x: x["link"]).alias("links"))
    whole = tokens.select("word", "part", "same").join(words, "word", "left")
    # Both sides of the join of ends are dealt by part already; the dealing by part and end that
    # Spark would ask for ships every token once more. Links come sorted by part, so lists need no
    # hash table, which Spark would give up for a sort beyond a few parts.
    conf, own = tokens.sparkSession.conf, {"spark.sql.requireAllClusterKeysForCoPartition": "false", "spark.sql.execution.useObjectHashAggregateExec": "false"}
    before = {k: conf.get(k) for k in own}
    try:
        for k, v in own.items():
            conf.set(k, v)
        return materialise(whole, "parts")
    finally:
        for k, v in before.items():
            conf.set(k, v)


def _group_text(links: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The text of all groups of links (whole parts, one after another), each group with a
    semicolon after it, as bytes, and where the text of each link's group begins."""
    a, b = (links & A_ENDS) > 0, (links & B_ENDS) > 0
    group = np.cumsum(a & b) - (a & b)  # the running count of cuts
    key = np.concatenate([2 * group[a], 2 * group[b] + 1])
    order = np.argsort(key, kind="stable")
    ids = np.concatenate([links[a] >> A_AT, (links[b] & ((1 << A_AT) - 1)) >> B_AT])[order]
    key = key[order]
    last = np.r_[key[1:] != key[:-1], True] if len(key) else np.zeros(0, bool)
    mark = pa.array([",", "|", ";"]).take(pa.array(np.where(last, 1 + (key & 1), 0)))
    text = pc.binary_join_element_wise(pa.array(ids).cast(pa.string()), mark, "")
    raw, off = views(text)
    return raw, off[np.searchsorted(key, 2 * group)]


def _codes(blocks: pa.Table) -> tuple[list, np.ndarray, np.ndarray]:
    """Documents of one block, number of parts of each, and all parts as numbers."""
    row = blocks.slice(0, 1).to_pydict()
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["codes"][0]), np.uint8)
    return row["ids"][0], np.array(row["sizes"][0], np.int64), np.ascontiguousarray(raw.reshape(4, -1).T).view("<i4")[:, 0]


def _sum(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Whole sums of values by owner, which ascends."""
    total = np.r_[0, np.cumsum(values)]
    at = np.searchsorted(owner, np.arange(n + 1))
    return total[at[1:]] - total[at[:-1]]


def documents(blocks: DataFrame, parts: DataFrame) -> DataFrame:
    """As a table, rows of two kinds: for each document block, row, doc_id, n_a, n_b, n_groups,
    n_links and groups_sha256; for each id pair of a block, pair (A id x 2^30 + B id) and docs, the
    number of its documents that link it."""
    kind = blocks.schema["ids"].dataType.elementType.simpleString()
    schema = f"block long, row int, doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pair long, docs long"
    numbers = ["n_a", "n_b", "n_groups", "n_links"]
    placed = blocks.select(F.col("block").alias("of"), F.posexplode("parts").alias("i", "part")).join(parts, "part").drop("part", "word")

    def run(own: pa.Table, words: pa.Table) -> pa.Table:
        ids, sizes, codes = _codes(own)
        order = np.argsort(words["i"].to_numpy())
        words = words.take(pa.array(order)).combine_chunks()
        n = len(ids)
        doc = np.repeat(np.arange(n), sizes)
        same = words["same"].to_numpy(zero_copy_only=False)
        good = (sizes > 0) & (_sum(~same[codes], doc, n) == 0)
        lists = words["links"].combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        count = np.array(lists.value_lengths().fill_null(0), np.int64)
        first = np.r_[0, np.cumsum(count)[:-1]]
        links = lists.flatten().to_numpy()
        of, a_ends, b_ends = np.repeat(np.arange(len(count)), count), (links & A_ENDS) > 0, (links & B_ENDS) > 0
        each = [*(np.bincount(of[x], minlength=len(count)) for x in (a_ends, b_ends, a_ends & b_ends)), count]
        made = [np.where(good, _sum(x[codes], doc, n), 0) for x in each]
        raw, begin = _group_text(links)
        begin, raw = np.r_[begin, len(raw)][np.r_[first, len(links)]].tolist(), raw.tobytes()
        text, at, sha = [raw[x:y] for x, y in zip(begin, begin[1:], strict=False)], np.r_[0, np.cumsum(sizes)].tolist(), []
        for d in range(n):
            whole = b"".join([text[c] for c in codes[at[d] : at[d + 1]].tolist()]) if good[d] else b""
            sha.append(hashlib.sha256(whole[:-1]).hexdigest() if good[d] else "")
        pairs, number = np.unique(links >> B_AT, return_inverse=True)
        docs = np.zeros(len(pairs), np.int64)
        a = 0
        while a < n:
            b = max(a + 1, int(np.searchsorted(at, at[a] + SLICE_PARTS, "right")) - 1)
            keep = good[doc[at[a] : at[b]]]
            each = np.unique(doc[at[a] : at[b]][keep] * len(count) + codes[at[a] : at[b]][keep])
            d, c = each // max(1, len(count)), each % max(1, len(count))
            k = count[c]
            flat = np.repeat(first[c] - np.r_[0, np.cumsum(k)[:-1]], k) + np.arange(k.sum())
            held = np.unique(np.repeat(d, k) * len(pairs) + number[flat])
            docs += np.bincount(held % max(1, len(pairs)), minlength=len(pairs))
            a = b
        found = docs > 0
        m, block = int(found.sum()), own["block"][0].as_py()
        none = lambda t: pa.nulls(m, t)
        join = lambda x, t: pa.concat_arrays([x, none(t)])
        id_type = own.schema.field("ids").type.value_type
        columns = [
            pa.array([block] * (n + m), pa.int64()),
            join(pa.array(range(n), pa.int32()), pa.int32()),
            join(pa.array(ids, id_type), id_type),
            *[join(pa.array(x, pa.int64()), pa.int64()) for x in made],
            join(pa.array(sha, pa.string()), pa.string()),
            pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(pairs[found], pa.int64())]),
            pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(docs[found], pa.int64())]),
        ]
        return pa.Table.from_arrays(columns, names=["block", "row", "doc_id", *numbers, "groups_sha256", "pair", "docs"])

    return materialise(blocks.drop("parts").groupBy("block").cogroup(placed.groupBy("of")).applyInArrow(run, schema), "aligned")


def pair_counts(rows: DataFrame) -> DataFrame:
    """(pair, docs, best) over the corpus, as a table. The pairs of an A id are bounded by B's
    vocabulary."""
    counts = rows.filter(F.col("pair").isNotNull()).groupBy("pair").agg(F.sum("docs").alias("docs"))
    most = F.max("docs").over(Window.partitionBy(F.shiftright("pair", A_AT - B_AT)))
    return materialise(counts.select("pair", "docs", (F.col("docs") == most).alias("best")), "pair-counts")


def link_sums(blocks: DataFrame, parts: DataFrame, counts: DataFrame) -> DataFrame:
    """(block, row, n_best, count_sum) of each document."""
    each = parts.select("word", F.explode(F.transform("links", lambda x: F.shiftright(x, B_AT))).alias("pair")).join(counts, "pair")
    sums = each.groupBy("word").agg(F.sum("docs").alias("total"), F.sum(F.col("best").cast("long")).alias("best"))
    values = materialise(parts.select("word", "part").join(sums, "word").drop("word"), "part-sums")
    _clear()
    placed = blocks.select(F.col("block").alias("of"), F.posexplode("parts").alias("i", "part")).join(values, "part").drop("part")

    def run(own: pa.Table, words: pa.Table) -> pa.Table:
        ids, sizes, codes = _codes(own)
        n, doc, out = len(ids), np.repeat(np.arange(len(ids)), sizes), []
        for c in ("best", "total"):
            value = np.zeros(int(codes.max(initial=-1)) + 1, np.int64)
            value[words["i"].to_numpy()] = words[c].to_numpy()
            out.append(pa.array(_sum(value[codes], doc, n), pa.int64()))
        block = pa.array([own["block"][0].as_py()] * n, pa.int64())
        return pa.Table.from_arrays([block, pa.array(range(n), pa.int32()), *out], names=["block", "row", "n_best", "count_sum"])

    return blocks.drop("parts").groupBy("block").cogroup(placed.groupBy("of")).applyInArrow(run, "block long, row int, n_best long, count_sum long")


def _clear(*tables: DataFrame) -> None:
    """Removes tables that no later step reads, and the shuffle files of the steps that are
    done: Spark deletes those when the driver's collector finds their plans unused, which those
    of the last step are only a moment after it."""
    discard(*tables)
    for _ in range(2):
        gc.collect()
        time.sleep(0.3)
        SparkSession.getActiveSession()._jvm.System.gc()


def alignment(docs: DataFrame, bytes_path: str, pieces_path: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row."""
    blocks = pack(docs, block_bytes, pair(bytes_path, pieces_path).signs())
    tokens = tokenise(blocks.select(F.explode("parts").alias("part")).distinct(), bytes_path, pieces_path)
    _clear()
    parts = align(tokens)
    _clear(tokens)
    rows = documents(blocks, parts)
    _clear()
    counts = pair_counts(rows)
    sums = materialise(link_sums(blocks, parts, counts), "link-sums")
    _clear(blocks, parts, counts)
    made = rows.filter(F.col("row").isNotNull()).join(sums, ["block", "row"])
    seen = lambda c: F.when(F.col("n_groups") > 0, F.col(c)).otherwise(F.lit(0)).alias(c)
    return made.select("doc_id", "n_a", "n_b", "n_groups", "n_links", seen("n_best"), seen("count_sum"), "groups_sha256")


def op13_alignment(spark: SparkSession, sf_dir: str, bytes_path: str | None = None, pieces_path: str | None = None) -> DataFrame:
    return alignment(table(spark, sf_dir, "documents"), bytes_path or default_path(), pieces_path or default_pieces())
