"""FASTA and FASTQ files, index tables and coordinates."""

from __future__ import annotations

import io
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.strings import normalise_bases


def read_fasta(spark: SparkSession, path: str, normalise: bool = True) -> DataFrame:
    """(id, seq) of a FASTA file or folder. Records are split at '>' by the text reader, so a
    file of many records is read in parallel; an id is the whole header line."""
    return _records(spark.read.option("lineSep", "\n>").text(path), normalise)


def _records(raw: DataFrame, normalise: bool) -> DataFrame:
    record = F.regexp_replace(F.col("value"), "^>", "")
    lines = F.split(record, "\r?\n", 2)
    seq = F.regexp_replace(F.coalesce(F.get(lines, F.lit(1)), F.lit("")), r"\s", "")
    return raw.filter(F.trim("value") != "").select(F.trim(lines[0]).alias("id"), (normalise_bases(seq) if normalise else seq).alias("seq"))


class FastqSource(DataSource):
    """Four-line FASTQ records with the number of their file, in the order of names, and their
    number in it: (file, n, id, seq, plus, qual). A file is read through the file system that
    its URI names."""

    @classmethod
    def name(cls) -> str:
        return "fastq"

    def schema(self) -> str:
        return "file int, n long, id string, seq string, plus string, qual string"

    def reader(self, schema) -> DataSourceReader:
        return _FastqReader(self.options)


class _FastqReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = sorted(options["path"].split(","))

    def partitions(self) -> list[InputPartition]:
        return [InputPartition((i, p)) for i, p in enumerate(self.paths)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        number, path = partition.value
        store, place = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
        with store.open_input_stream(place, compression="detect") as raw, io.TextIOWrapper(raw, encoding="utf-8") as f:
            lines = (line.rstrip("\r\n") for line in f)
            for n, head in enumerate(lines):
                if not head:
                    return
                try:
                    seq, _, qual = next(lines), next(lines), next(lines)
                except StopIteration:
                    raise ValueError(f"{path}: record {n} is cut off") from None
                if not head.startswith("@") or len(seq) != len(qual):
                    raise ValueError(f"{path}: record {n} is no FASTQ record")
                yield number, n, head[1:], seq, "+", qual


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(FastqSource)
    return spark.read.format("fastq").option("path", path).load()


def fastq_queries(reads: DataFrame, n: int, k: int) -> DataFrame:
    """The last n reads, from the last one backwards, cut to k bases: (q_id, q)."""
    last = reads.orderBy(F.desc("file"), F.desc("n")).limit(n)
    rows = last.agg(F.collect_list(F.struct("file", "n", "seq")).alias("a"))  # n entries
    ordered = rows.select(F.posexplode(F.reverse(F.array_sort("a"))).alias("q_id", "x"))
    return ordered.select("q_id", F.substring("x.seq", 1, k).alias("q"))


def write_fastq(df: DataFrame, path: str) -> None:
    """(id, seq, qual) as four-line records."""
    df.select(F.concat_ws("\n", F.concat(F.lit("@"), F.col("id").cast("string")), "seq", F.lit("+"), "qual").alias("value")).write.text(path)


def data_files(spark: SparkSession, path: str) -> str:
    """The files of a folder that Spark wrote, in order, as read_fastq takes them."""
    return ",".join(sorted(spark.read.text(path).inputFiles()))


def write_results(df: DataFrame, path: str) -> None:
    """A result table as CSV with a header; arrays are written as literals."""
    text = lambda c: F.concat(F.lit("["), F.array_join(F.col(c).cast("array<string>"), ", "), F.lit("]"))
    df.select([text(c).alias(c) if kind.startswith("array") else F.col(c) for c, kind in df.dtypes]).write.option("header", True).csv(path)


def read_results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.option("header", True).schema(schema).csv(path)


def write_fasta(df: DataFrame, path: str, seq: str = "seq", record: str = "id") -> None:
    df.select(F.concat(F.lit(">"), F.col(record), F.lit("\n"), F.col(seq)).alias("value")).write.text(path)


def first_sequence(spark: SparkSession, path: str, length: int | None = None) -> DataFrame:
    """The first record of a file (of a folder, of its first file), cut to a length. Records
    are numbered as they are read, so the least number is the file's first."""
    parts = spark.read.option("lineSep", "\n>").text(path).filter(F.trim("value") != "")
    first = parts.select(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("n"), "value")
    one = first.agg(F.min(F.struct("file", "n", "value")).alias("x")).filter(F.col("x").isNotNull()).select("x.value")
    out = _records(one, True)
    return out.withColumn("seq", F.substring("seq", 1, length)) if length else out


def index_path(folder: str, kind: str, **settings) -> str:
    """Where an index of these settings is kept."""
    return f"{folder}/{kind}-" + "-".join(f"{k}={settings[k]}" for k in sorted(settings))


def load_or_build(spark: SparkSession, path: str, build) -> DataFrame:
    """The index table at path; built and written first where there is none, or where a write
    was cut off: only a whole table has its mark."""
    jvm = spark._jvm
    mark = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def extract(coords: DataFrame, chromosomes: DataFrame, fragments: DataFrame | None = None) -> DataFrame:
    """coords (chrom, pos, len) with `seq`: from the chromosome, clipped at its end; else from
    the fragment stored at exactly (chrom, pos); else ''. Positions count from 0."""
    whole = chromosomes.select("chrom", F.col("seq").alias("_whole"))
    out = coords.join(whole, "chrom", "left")
    piece = F.expr("substring(_whole, pos + 1, len)")
    if fragments is not None:
        out = out.join(fragments.select("chrom", "pos", F.col("seq").alias("_part")), ["chrom", "pos"], "left")
        piece = F.coalesce(piece, F.expr("substring(_part, 1, len)"))
    return out.withColumn("seq", F.coalesce(piece, F.lit(""))).drop("_whole", "_part")
