"""Token ids in binary files: frames compressed one by one with a shared zstd dictionary.

The ids of a document, with an end id, are serialised as little-endian unsigned integers and
compressed alone, with a dictionary trained on serialised ids of other documents, so that a
short document is read without its neighbours and still compresses well. A file is

    magic, id width, dictionary SHA-256 | frames | footer | footer length, magic

The footer is an Arrow stream with a row for each document: doc_id, start (ids before it in
the file), n_tokens, offset and length of its frame. Dictionaries lie beside the files under
their hash; a reader takes the one that the file names and checks it.

Encoding runs where the text is read; only compressed frames are shuffled, by a range sort
over doc_id (ties: count, then frame; a salt splits a doc_id with many equal rows). Each part
of the range writes files of its own in order, so the place of a document among all ids is its
start in the file plus the ids of all files before. Files are written under names of their own
and renamed when they are whole.

Bounds that are parameters: some SAMPLE random documents, those of up to SAMPLE_BYTES bytes, train
the dictionary (results do not depend on it); FILE_BYTES closes a file.

Defined results: a null or empty text is the end id alone; a null doc_id sorts first; repeated
rows are documents of their own; a very long text is one frame; an empty table writes no file;
other columns are not used, whatever their names.
"""

from __future__ import annotations

import functools
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import PATTERN, byte_symbols, default_path
from .common import discard, materialise, shared_dir, small_batches, table

END_ID = 2
SAMPLE, SAMPLE_BYTES, DICTIONARY_BYTES = 2000, 4096, 112_640
FILE_BYTES = 64 << 20
#: Bytes of frames that a reader holds at once; a longer frame stands alone.
READ_BYTES = 4 << 20
LEVEL = 3
MAGIC = b"NSIDS01\n"
HEAD, TAIL = struct.Struct("<8sB32s"), struct.Struct("<Q8s")


class Encoder:
    """ids(texts) of one tokenizer file, equal to the tokenizers library's.

    A plain byte-level BPE file (no normaliser, merges in the order of their ids) is handed as
    ranks to the tiktoken library, which takes a fifth of the time; texts that its pattern
    engine gives up on, and any other kind of file, go to the tokenizers library."""

    def __init__(self, path: str, special: bool = True):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.library.encode_special_tokens = not special
        self.allowed = "all" if special else set()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.width = 2 if self.library.get_vocab_size() <= 1 << 16 else 4
        self.fast = self._fast(spec)

    @staticmethod
    def _fast(spec: dict):
        model, split = spec["model"], spec.get("pre_tokenizer") or {}
        plain = model.get("type") == "BPE" and not spec.get("normalizer") and not model.get("ignore_merges") and not model.get("unk_token")
        byte_level = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
        # Added tokens that take white space with them or stand as whole words need the library.
        added = spec.get("added_tokens", [])
        simple = not any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added)
        if not (plain and byte_level and simple):
            return None
        import tiktoken

        special = {t["content"]: t["id"] for t in added}
        back = {s: b for b, s in enumerate(byte_symbols())}
        vocab = {s: i for s, i in model["vocab"].items() if s not in special}
        made = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        if made != sorted(made) or len(vocab) != len(made) + 256 or not all(c in back for s in vocab for c in s):
            return None
        return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks={bytes(back[c] for c in s): i for s, i in vocab.items()}, special_tokens=special)

    def ids(self, text: str) -> np.ndarray:
        if self.fast is not None:
            try:
                return self.fast.encode_to_numpy(text, allowed_special=self.allowed, disallowed_special=())
            except ValueError:  # too long a run for the pattern engine
                pass
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)


@functools.lru_cache(4)
def encoder(path: str, special: bool = True) -> Encoder:
    """One for each Python worker and file."""
    return Encoder(path, special)


def serialise(ids: np.ndarray, width: int) -> bytes:
    return ids.astype(f"<u{width}").tobytes()


def deserialise(raw: bytes, width: int) -> np.ndarray:
    return np.frombuffer(raw, f"<u{width}")


def train(docs: DataFrame, path: str, rows: int = SAMPLE, text: str = "text") -> bytes:
    """A dictionary from serialised ids of about `rows` documents; empty where too few of them
    are short enough to learn from. Documents are drawn in their tasks, so that only the drawn
    ones reach the driver."""
    n = docs.count()
    drawn = docs.select(F.col(text).alias("t")).sample(min(1.0, rows / n) if n else 1.0, seed=11)
    sample = drawn.filter(F.octet_length("t").between(1, SAMPLE_BYTES)).collect()
    enc = encoder(path)
    parts = [serialise(enc.ids(r["t"]), enc.width) for r in sample]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, parts).as_bytes()
    except zstandard.ZstdError:
        return b""


def dictionary_hash(dictionary: bytes) -> bytes:
    return hashlib.sha256(dictionary).digest()


def _dictionary_path(base: str, digest: bytes) -> str:
    return f"{base}/{digest.hex()}.dict"


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)


def frames(docs: DataFrame, path: str, dictionary: bytes, end_id: int = END_ID, text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, frame) of every row, as a table."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, zstd = encoder(path), _compressor(dictionary)
        end = np.array([end_id], np.uint32)
        for batch in batches:
            counts, made = [], []
            for t in batch.column(1).to_pylist():
                ids = np.concatenate((enc.ids(t), end)) if t else end
                counts.append(len(ids))
                made.append(zstd.compress(serialise(ids, enc.width)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(made, pa.binary())], names=["doc_id", "n_tokens", "frame"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return materialise(docs.select("doc_id", F.col(text).alias("t")).mapInArrow(run, f"doc_id {kind}, n_tokens long, frame binary"), "frames")


class FileWriter:
    """One file: append frames, then close."""

    def __init__(self, folder: str, width: int, dictionary: bytes):
        self.store, base = fs.FileSystem.from_uri(folder)
        self.name = f"{base}/{uuid.uuid4().hex}.ids"
        self.out = self.store.open_output_stream(self.name + ".part")
        self.out.write(HEAD.pack(MAGIC, width, dictionary_hash(dictionary)))
        self.at, self.tokens, self.rows = HEAD.size, 0, []

    def append(self, doc_id, n_tokens: int, frame: bytes) -> None:
        self.rows.append((doc_id, self.tokens, n_tokens, self.at, len(frame)))
        self.out.write(frame)
        self.at += len(frame)
        self.tokens += n_tokens

    def close(self, kind: pa.DataType) -> tuple[str, int, int]:
        """File name, documents, ids."""
        columns = zip(*self.rows, strict=True)
        types = (kind, *[pa.int64()] * 4)
        index = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "start", "n_tokens", "offset", "length"])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, index.schema) as stream:
            stream.write_batch(index)
        footer = sink.getvalue()
        self.out.write(footer)
        self.out.write(TAIL.pack(footer.size, MAGIC))
        self.out.close()
        self.store.move(self.name + ".part", self.name)
        return self.name, len(self.rows), self.tokens


class FileReader:
    """Header and footer of a file, and any document of it by a range read."""

    def __init__(self, store: fs.FileSystem, name: str):
        self.file = store.open_input_file(name)
        magic, self.width, digest = HEAD.unpack(self.file.read_at(HEAD.size, 0))
        size, last = TAIL.unpack(self.file.read_at(TAIL.size, self.file.size() - TAIL.size))
        if magic != MAGIC or last != MAGIC:
            raise ValueError(f"{name} is no file of token ids")
        with pa.ipc.open_stream(self.file.read_at(size, self.file.size() - TAIL.size - size)) as stream:
            self.index = stream.read_next_batch()
        with store.open_input_file(_dictionary_path(name.rpartition("/")[0], digest)) as f:
            own = f.read()
        if dictionary_hash(own) != digest:
            raise ValueError(f"{name}: its dictionary has another hash")
        self.zstd = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(own) if own else None)

    def ids(self, frame: bytes) -> np.ndarray:
        return deserialise(self.zstd.decompress(frame), self.width)

    def document(self, row: int) -> np.ndarray:
        return self.ids(self.file.read_at(self.index["length"][row].as_py(), self.index["offset"][row].as_py()))

    def documents(self) -> Iterator[tuple[int, np.ndarray]]:
        """(row, ids) of all documents in order; neighbouring frames come in one read."""
        offset, length = (self.index[c].to_numpy() for c in ("offset", "length"))
        end, a = offset + length, 0
        while a < len(offset):
            b = max(a + 1, int(np.searchsorted(end, offset[a] + READ_BYTES, "right")))
            block = memoryview(self.file.read_at(int(end[b - 1] - offset[a]), int(offset[a])))
            for i in range(a, b):
                at = int(offset[i] - offset[a])
                yield i, self.ids(block[at : at + int(length[i])])
            a = b


def write(docs: DataFrame, folder: str, path: str, end_id: int = END_ID, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes all documents under folder in ascending doc_id order. Returns the files in that
    order, as a small table (file, docs, tokens, start): start counts the ids of all files
    before. It has a row for each file, so its size follows the number of files only."""
    spark = docs.sparkSession
    store, base = fs.FileSystem.from_uri(folder)
    store.create_dir(base, recursive=True)
    dictionary = train(docs, path)
    with store.open_output_stream(_dictionary_path(base, dictionary_hash(dictionary))) as out:
        out.write(dictionary)
    made = frames(docs, path, dictionary, end_id)
    width = encoder(path).width
    salted = made.withColumn("salt", F.monotonically_increasing_id())
    order = [F.col("doc_id").asc_nulls_first(), F.col("n_tokens"), F.xxhash64("frame"), F.col("salt")]
    dealt = salted.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "n_tokens", "frame")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, writer, done = TaskContext.get().partitionId(), None, []
        kind = pa.null()
        for batch in batches:
            kind = batch.schema.field("doc_id").type
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                writer = writer or FileWriter(folder, width, dictionary)
                writer.append(*row)
                if writer.at >= file_bytes:
                    done.append(writer.close(kind))
                    writer = None
        if writer:
            done.append(writer.close(kind))
        names, rows, tokens = zip(*done, strict=True) if done else ((), (), ())
        numbers = [[part] * len(done), range(len(done)), rows, tokens]
        yield pa.RecordBatch.from_arrays([*(pa.array(n, pa.int64()) for n in numbers), pa.array(names, pa.string())], names=["part", "at", "docs", "tokens", "file"])

    files = materialise(dealt.mapInArrow(run, "part long, at long, docs long, tokens long, file string"), "id-files")
    discard(made)
    start, rows = 0, []
    for r in files.orderBy("part", "at").collect():
        rows.append((r["file"], r["docs"], r["tokens"], start))
        start += r["tokens"]
    discard(files)
    return spark.createDataFrame(rows, "file string, docs long, tokens long, start long")


def read(files: DataFrame, folder: str, kind: str = "long") -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files alone. kind is the
    type of doc_id. ids_crc32 is that of the ids as little-endian unsigned 32-bit integers."""
    n = max(1, files.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                reader, at, crc, counts = FileReader(store, name), base, [], []
                for _, ids in reader.documents():
                    counts.append(len(ids))
                    crc.append(zlib.crc32(ids.astype("<u4").tobytes()))
                counts = np.array(counts, np.int64)
                starts = at + np.r_[0, np.cumsum(counts)[:-1]]
                if (counts != reader.index["n_tokens"].to_numpy()).any():
                    raise ValueError(f"{name}: frames and footer differ")
                yield pa.RecordBatch.from_arrays([reader.index["doc_id"], pa.array(starts, pa.int64()), pa.array(counts), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.select("file", "start").repartition(n).mapInArrow(run, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")


def offsets(files: DataFrame, folder: str, kind: str = "long") -> DataFrame:
    """(doc_id, start, n_tokens, offset, length, file) of every document, from the footers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                index = FileReader(store, name).index
                start = pa.array(index["start"].to_numpy() + base)
                yield pa.RecordBatch.from_arrays([index["doc_id"], start, *index.columns[2:], pa.array([name] * len(index))], names=["doc_id", "start", "n_tokens", "offset", "length", "file"])

    schema = f"doc_id {kind}, start long, n_tokens long, offset long, length long, file string"
    return files.select("file", "start").repartition(max(1, files.count())).mapInArrow(run, schema)


def fetch(index: DataFrame, wanted: DataFrame, folder: str) -> DataFrame:
    """(doc_id, ids) of the documents of `wanted` (doc_id): only their frames are read.
    index is that of `offsets`; rows are dealt by file, so a file's header is read once."""
    kind = index.schema["doc_id"].dataType.simpleString()
    rows = index.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "file", "offset", "length")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)
        reader, name = None, None
        for batch in batches:
            made = []
            for file, offset, length in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True):
                if file != name:
                    reader, name = FileReader(store, file), file
                made.append(reader.ids(reader.file.read_at(length, offset)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(made, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return rows.repartition("file").sortWithinPartitions("file", "offset").mapInArrow(run, f"doc_id {kind}, ids array<int>")


def op11_token_files(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    folder = f"{shared_dir(spark)}/ids-{uuid.uuid4().hex}"
    files = write(docs, folder, path or default_path())
    return read(files, folder, docs.schema["doc_id"].dataType.simpleString())
