"""Line dedup: two Bloom filters, then exact confirmation of suspected repeats.

Every line of a text whose key (stripped, A-Z lowered) has at least MIN_CHARS code points is
hashed. The first filter has the bits of keys seen once, the second those of keys seen
again; both are cut into chunks of bits, each task sends the bits it saw, and a chunk's bits
meet in one small group. A key whose bits all stand in the second filter is suspected; only
suspected lines are shuffled, with their whole keys, to count the documents that hold them
and to choose the one that keeps them. The choices then return to the documents by doc_id.

The filters' size follows the number of long lines (about 8 bits a line) up to 2^30 bits,
which bounds what is broadcast; beyond it more lines are suspected and shuffled, and the
result stays exact.

Defined results: a null or empty text is one empty line; lines of rows with a null doc_id
count for no document and stay; rows with one doc_id are one document, so a line that one of
them loses all of them lose; of equal counts nothing has to be chosen, as the largest doc_id
is unique; a very long text or line is one like any other; columns called as the two counts are replaced, all others stay; an empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import columns_without, fresh, materialise, small_batches, table, with_fields

MIN_CHARS, MIN_DOCS = 40, 5
HASHES = 2
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 30
CHUNK_BITS = 1 << 19
_BLANK = " \t\n\v\f\r"


def key_of(line: str) -> bytes | None:
    """A line's key as UTF-8, or None for a key under MIN_CHARS code points."""
    if len(line) < MIN_CHARS:
        return None
    line = line.strip(_BLANK)
    return line.encode().lower() if len(line) >= MIN_CHARS else None  # bytes.lower() is A-Z only


def keys_of(text: str | None) -> set[bytes]:
    return {k for line in (text or "").split("\n") if (k := key_of(line)) is not None}


def places(key: bytes, bits: int) -> list[int]:
    """The key's bits in a filter of `bits` (a power of two)."""
    h = xxhash.xxh3_128_intdigest(key)
    return [(h >> (40 * i)) & (bits - 1) for i in range(HASHES)]


def filter_bits(lines: int) -> int:
    bits = LEAST_BITS
    while bits < 8 * lines and bits < MOST_BITS:
        bits *= 2
    return bits


def repeated_bits(docs: DataFrame, bits: int) -> np.ndarray:
    """The second filter, packed: bits seen in two documents or more."""

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice, size = [], [], 0

        def send():
            every = np.concatenate(once) if once else np.zeros(0, np.int64)
            places_, n = np.unique(every, return_counts=True)
            part, at = places_ // CHUNK_BITS, (places_ % CHUNK_BITS).astype(np.uint32)
            bounds = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else np.zeros(0, int)
            ends = np.r_[bounds[1:], len(part)] if len(part) else bounds
            return pa.RecordBatch.from_arrays([pa.array(part[bounds], pa.int64()), pa.array([at[i:j].tobytes() for i, j in zip(bounds, ends, strict=True)], pa.binary()), pa.array([at[i:j][n[i:j] > 1].tobytes() for i, j in zip(bounds, ends, strict=True)], pa.binary())], names=["part", "once", "twice"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                found = [p for k in keys_of(text) for p in set(places(k, bits))]
                if found:
                    once.append(np.array(found, np.int64))
                    size += len(found)
            if size > 1 << 21:
                yield send()
                once, size = [], 0
        yield send()

    def meet(rows: pa.Table) -> pa.Table:
        one, two = np.zeros(CHUNK_BITS, bool), np.zeros(CHUNK_BITS, bool)
        for a, b in zip(rows.column("once"), rows.column("twice"), strict=True):
            a, b = np.frombuffer(a.as_py(), np.uint32), np.frombuffer(b.as_py(), np.uint32)
            two[b] = True
            two[a[one[a]]] = True
            one[a] = True
        return pa.table({"part": [rows.column("part")[0].as_py()], "twice": [np.packbits(two, bitorder="little").tobytes()]})

    sent = docs.filter(F.col("doc_id").isNotNull()).select("text").mapInArrow(seen, "part long, once binary, twice binary")
    out = np.zeros(bits // 8, np.uint8)
    for r in sent.groupBy("part").applyInArrow(meet, "part long, twice binary").toLocalIterator():
        got = np.frombuffer(r["twice"], np.uint8)[: len(out)]
        at = r["part"] * (CHUNK_BITS // 8)
        out[at : at + len(got)] = got
    return out


def repeated_lines(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """key, doc_id, kept of every line key held by at least min_docs documents: one row for
    each document that holds it; kept marks the largest doc_id."""
    spark = docs.sparkSession
    small_batches(spark)
    # The count sizes the filter only: bytes over 100 is near the number of long lines.
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = filter_bits(size // 100)
    held = spark.sparkContext.broadcast(repeated_bits(docs, bits).tobytes())  # MOST_BITS / 8 bytes at most

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twice = held.value
        for batch in batches:
            keys, ids = [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for k in keys_of(text):
                    if all(twice[p >> 3] >> (p & 7) & 1 for p in places(k, bits)):
                        keys.append(k)
                        ids.append(doc_id)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(ids, batch.column(0).type)], names=["key", "doc_id"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = docs.filter(F.col("doc_id").isNotNull()).select("doc_id", "text").mapInArrow(suspects, f"key binary, doc_id {kind}").distinct()
    # Counted and joined: a table, so that the texts are not searched twice.
    found = materialise(found, "suspects")
    # Exact confirmation on whole keys: counts are combined before they are shuffled.
    confirmed = found.groupBy("key").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("keeper")).filter(F.col("n_docs") >= min_docs).drop("n_docs")
    # A table too: between two tables Spark can split the rows of a line that many documents
    # hold, which it cannot where one side is an aggregate.
    confirmed = materialise(confirmed, "confirmed")
    return found.join(confirmed, "key").select("key", "doc_id", (F.col("doc_id") == F.col("keeper")).alias("kept"))


def drop_repeats(docs: DataFrame, min_docs: int = MIN_DOCS, lines: str = "n_lines", dropped: str = "n_dropped") -> DataFrame:
    """docs with `text` cut to the lines that stay, and two counts: its lines, and those that
    went."""
    mark = fresh("_gone", docs)
    gone = (
        repeated_lines(docs.select("doc_id", "text"), min_docs)
        .filter(~F.col("kept"))
        .select("doc_id", F.unhex(F.md5("key")).alias("_key"))
        .groupBy("doc_id")
        .agg(F.collect_set("_key").alias(mark))
    )
    kept = columns_without(docs, lines, dropped)
    joined = docs.select(*kept).join(gone, "doc_id", "left").select(*kept, mark)
    schema = with_fields(docs.select(*kept), f"`{lines}` long, `{dropped}` long")
    at = kept.index("text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, total, less = batch.column(at).to_pylist(), [], []
            for i, gone in enumerate(batch.column(len(kept))):
                if not gone.is_valid or texts[i] is None:
                    total.append((texts[i] or "").count("\n") + 1)
                    less.append(0)
                    continue
                gone, own = set(gone.as_py()), texts[i].split("\n")
                stay = [x for x in own if (k := key_of(x)) is None or hashlib.md5(k, usedforsecurity=False).digest() not in gone]
                texts[i] = "\n".join(stay)
                total.append(len(own))
                less.append(len(own) - len(stay))
            columns = [*batch.columns[:at], pa.array(texts, batch.column(at).type), *batch.columns[at + 1 : len(kept)]]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(total, pa.int64()), pa.array(less, pa.int64())], names=schema.names)

    return joined.mapInArrow(cut, schema)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = drop_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256).alias("kept_sha256"))


_KEY = "translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE = f"""with numbered as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
lines as (select r, doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i from numbered),
keyed as (select *, {_KEY} as key from lines),
often as (select key, max(doc_id) as keeper from keyed where length(key) >= {MIN_CHARS} group by key having count(distinct doc_id) >= {MIN_DOCS}),
marked as (select k.*, coalesce(o.keeper <> k.doc_id, false) as gone from keyed k left join often o on k.key = o.key and length(k.key) >= {MIN_CHARS})
select any_value(doc_id) as doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped, sha256(coalesce(string_agg(line, chr(10) order by i) filter (not gone), '')) as kept_sha256 from marked group by r"""
