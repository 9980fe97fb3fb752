"""Media columns: content-addressed payloads in tar shards.

A payload is stored as an 8-bit greyscale PNG, 64 samples a row, in a tar file in the
folder that driver and executors share. A member is named by the SHA-256 of its payload and
stored once; a row carries digest, shard, offset and length. The header-only pass reads 33
bytes (signature and IHDR) of each member to fill width, height and depth; the full pass
reads a member's range, checks it against the digest and computes features.

A shard is written under a name of its own and renamed when it is whole, so a task that runs
again after a lost executor leaves no half-written file that an index row points to.

Defined results: a null text is an empty one; an empty text is one row of 64 zero bytes;
repeated rows share a member; ties cannot arise; a very long text is one member; an empty table
writes no shard; columns other than the key are not used, whatever their names.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, shared_dir, small_batches, table, with_fields

WIDTH = 64
#: A shard is closed when it has so many bytes.
SHARD_BYTES = 32 << 20
#: Level of the PNG's deflate stream: fixed, so that equal payloads have equal files.
LEVEL = 4
#: Bits of the filter of repeated digests at most (the bound of what is broadcast), and of one
#: part of it while it is gathered.
FILTER_BITS, PART_BITS = 1 << 30, 1 << 16
SIGNATURE = b"\x89PNG\r\n\x1a\n"
HEADER_BYTES = 33


def pad(raw: bytes) -> bytes:
    """raw with zero bytes up to a positive multiple of 64."""
    return raw + bytes(max(WIDTH, -(-len(raw) // WIDTH) * WIDTH) - len(raw))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_png(payload: bytes) -> bytes:
    """PNG whose samples are the payload, row by row, without row filters."""
    rows = np.zeros((len(payload) // WIDTH, WIDTH + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), LEVEL)) + _chunk(b"IEND", b"")


def read_header(head: bytes) -> tuple[int, int, int]:
    """Width, height and bit depth from a PNG's first 33 bytes."""
    if head[:8] != SIGNATURE or head[12:16] != b"IHDR" or zlib.crc32(head[12:29]) != struct.unpack(">I", head[29:33])[0]:
        raise ValueError("not a PNG header")
    width, height, depth = struct.unpack(">IIB", head[16:25])
    return width, height, depth


def from_png(media: bytes) -> bytes:
    """The payload of a PNG made by to_png."""
    width, height, _ = read_header(media[:HEADER_BYTES])
    at, data = HEADER_BYTES, []
    while at < len(media):
        n, kind = struct.unpack(">I4s", media[at : at + 8])
        if kind == b"IDAT":
            data.append(media[at + 8 : at + 8 + n])
        at += n + 12
    rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, width + 1)
    if rows[:, 0].any():
        raise ValueError("unexpected row filter")
    return rows[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Rows, sum of samples, samples that change from one to the next, and a histogram of 8
    bins: integers only, so that equal payloads have equal text."""
    x = np.frombuffer(payload, np.uint8)
    bins = np.bincount(x >> 5, minlength=8)
    return f"{len(x) // WIDTH}:{int(x.sum(dtype=np.int64))}:{int((x[1:] != x[:-1]).sum())}:" + ",".join(map(str, bins.tolist()))


class ShardWriter:
    """Tar shards of one task; append gives a member's place."""

    def __init__(self, folder: str, most: int = SHARD_BYTES):
        self.store, self.path = fs.FileSystem.from_uri(folder)
        self.store.create_dir(self.path, recursive=True)
        self.most, self.out = most, None

    def _open(self) -> None:
        self.name = f"{self.path}/{uuid.uuid4().hex}.tar"
        self.out, self.at, self.seen = self.store.open_output_stream(self.name + ".part"), 0, {}

    def append(self, digest: str, media: bytes) -> tuple[str, int, int]:
        if self.out is None:
            self._open()
        if digest in self.seen:
            return self.seen[digest]
        info = tarfile.TarInfo(f"{digest}.png")
        info.size = len(media)
        head = info.tobuf(tarfile.USTAR_FORMAT)
        self.out.write(head)
        self.out.write(media)
        self.out.write(bytes(-len(media) % 512))
        place = self.seen[digest] = (self.name, self.at + len(head), len(media))
        self.at += len(head) + -(-len(media) // 512) * 512
        return place

    def place(self, digest: str) -> tuple[str, int, int] | None:
        return self.seen.get(digest) if self.out is not None else None

    def full(self) -> bool:
        return self.out is not None and self.at >= self.most

    def close(self) -> None:
        if self.out is not None:
            self.out.write(bytes(1024))
            self.out.close()
            self.store.move(self.name + ".part", self.name)
            self.out = None


def payload_digest(text: str = "text") -> Column:
    """SHA-256 of a row's padded payload, as `pad` makes it."""
    raw = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    size = F.greatest(F.ceil(F.octet_length(raw) / WIDTH), F.lit(1)) * WIDTH
    return F.sha2(F.rpad(raw, size.cast("int"), F.lit(b"\0")), 256)


def _place(digest: str, bits: int) -> int:
    return int(digest[:15], 16) & (bits - 1)


def repeated(digests: DataFrame) -> tuple[np.ndarray, int]:
    """A filter of the digests of more than one row, as packed bits, and its size in bits (32
    for each such digest, FILTER_BITS at most). It has all of them and a few others."""
    often = digests.groupBy("digest").count().filter(F.col("count") > 1)
    bits = 1 << 16
    n = often.count()
    while bits < 32 * n and bits < FILTER_BITS:
        bits *= 2
    place = F.conv(F.substring("digest", 1, 15), 16, 10).cast("long").bitwiseAND(bits - 1)
    # A row has PART_BITS places at most.
    parts = often.select(place.alias("p")).groupBy(F.floor(F.col("p") / PART_BITS).alias("part")).agg(F.collect_set((F.col("p") % PART_BITS).cast("int")).alias("at"))
    out = np.zeros(bits // 8, np.uint8)
    for r in parts.toLocalIterator():
        at = np.array(r["at"], np.int64) + r["part"] * PART_BITS
        np.bitwise_or.at(out, at >> 3, (1 << (at & 7)).astype(np.uint8))
    return out, bits


def _write(source: DataFrame, folder: str, key: list[str], skip: tuple[bytes, int] | None) -> DataFrame:
    """Stores the payloads of (key..., digest, _raw) and returns their index, as a table.
    Rows in the filter `skip` are listed without a place."""
    small_batches(source.sparkSession)
    schema = with_fields(source.select(*key), "n_bytes long, payload_bytes long, digest string, shard string, offset long, length long")
    held = source.sparkSession.sparkContext.broadcast(skip)  # FILTER_BITS / 8 bytes at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, ready, later = ShardWriter(folder), [], held.value
        for batch in batches:
            made, waits = [], []
            for digest, raw in zip(batch.column(len(key)).to_pylist(), batch.column(len(key) + 1).to_pylist(), strict=True):
                payload, place = pad(raw), (None, None, None)
                if later is None or not later[0][(p := _place(digest, later[1])) >> 3] >> (p & 7) & 1:
                    place = writer.place(digest) or writer.append(digest, to_png(payload))
                made.append((len(raw), len(payload), digest, *place))
                waits.append(place[0] is not None)
            n, m, d, s, o, k = zip(*made, strict=True) if made else [()] * 6
            columns = [pa.array(n, pa.int64()), pa.array(m, pa.int64()), pa.array(d, pa.string()), pa.array(s, pa.string()), pa.array(o, pa.int64()), pa.array(k, pa.int64())]
            index = pa.RecordBatch.from_arrays([*batch.columns[: len(key)], *columns], names=schema.fieldNames())
            waits = pa.array(waits, pa.bool_())
            yield index.filter(pc.invert(waits))  # rows without a place wait for no shard
            ready.append(index.filter(waits))
            if writer.full():
                writer.close()  # index rows leave only after their shard is in place
                yield from ready
                ready = []
        writer.close()
        yield from ready

    return materialise(source.mapInArrow(run, schema), "media-index")


def store(rows: DataFrame, folder: str, key: list[str], text: str = "text") -> DataFrame:
    """Stores each row's padded text once in tar shards under folder; returns the index: the
    columns `key` with n_bytes, payload_bytes, digest, shard, offset and length.

    A payload that only one row has is written by the task that reads it. Those that may
    repeat, by a filter over all digests, are combined by digest before they are shuffled,
    and then written."""
    source = rows.select(*key, payload_digest(text).alias("digest"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("_raw"))
    bits, size = repeated(source.select("digest"))
    index = _write(source, folder, key, (bits.tobytes(), size))
    held = rows.sparkSession.sparkContext.broadcast((bits.tobytes(), size))

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, n = held.value
        for batch in batches:
            yield batch.filter(pa.array([bool(own[(p := _place(d, n)) >> 3] >> (p & 7) & 1) for d in batch.column(0).to_pylist()], pa.bool_()))

    again = source.select("digest", "_raw").mapInArrow(suspects, "digest string, _raw binary").groupBy("digest").agg(F.first("_raw").alias("_raw"))
    shared = _write(again, folder, [], None).select("digest", "shard", "offset", "length")
    first, late = index.filter(F.col("shard").isNotNull()), index.filter(F.col("shard").isNull()).drop("shard", "offset", "length")
    return first.unionByName(late.join(shared, "digest").select(*first.columns))


class RangeReader:
    """Reads ranges of shards; keeps the files open that it used last."""

    def __init__(self, folder: str, most: int = 32):
        self.store, _ = fs.FileSystem.from_uri(folder)
        self.files, self.most = {}, most

    def read(self, shard: str, offset: int, length: int) -> bytes:
        file = self.files.pop(shard, None) or self.store.open_input_file(shard)
        self.files[shard] = file  # now the newest
        if len(self.files) > self.most:
            self.files.pop(next(iter(self.files))).close()
        return file.read_at(length, offset)


def headers(index: DataFrame, folder: str) -> DataFrame:
    """The index with width, height and depth, from a 33-byte range read of each member."""
    schema = with_fields(index, "width int, height int, depth int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = RangeReader(folder)
        for batch in batches:
            got = [read_header(reader.read(s, o, HEADER_BYTES)) for s, o in zip(batch.column("shard").to_pylist(), batch.column("offset").to_pylist(), strict=True)]
            columns = [pa.array([g[i] for g in got], pa.int32()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=schema.names)

    return index.mapInArrow(run, schema)


def load(index: DataFrame, folder: str) -> DataFrame:
    """The index with what a full read of each member gives: payload_sha256, tail_crc32,
    media_bytes, media_sha256, feature. A payload that does not have its digest is an error."""
    schema = with_fields(index, "payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = RangeReader(folder)
        for batch in batches:
            made = []
            for shard, offset, length, digest in zip(*(batch.column(c).to_pylist() for c in ("shard", "offset", "length", "digest")), strict=True):
                media = reader.read(shard, offset, length)
                payload = from_png(media)
                got = hashlib.sha256(payload).hexdigest()
                if got != digest:
                    raise ValueError(f"{shard} at {offset}: payload does not have its digest")
                made.append((got, zlib.crc32(payload[-WIDTH:]), len(media), hashlib.sha256(media).hexdigest(), feature(payload)))
            types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            columns = [pa.array([m[i] for m in made], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=schema.names)

    return index.mapInArrow(run, schema)


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/media-{uuid.uuid4().hex}"
    index = store(table(spark, sf_dir, "documents"), folder, ["doc_id"])
    full = load(headers(index, folder), folder)
    return full.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height")
