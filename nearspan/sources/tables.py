"""Tables between the steps of a plan."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir).

    Where the session names none, a folder of this machine is set for a local master, as in
    tests; on a cluster that is an error, as each executor would write to its own disk.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="nearspan-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def materialise(df: DataFrame, name: str, rows_a_file: int = 0) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: the lineage ends there,
    so a lost executor costs a reread and no recomputation. Files have at most rows_a_file rows
    (0: any number)."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/nearspan-{name}-{uuid.uuid4().hex}"
    df.write.option("maxRecordsPerFile", rows_a_file).parquet(path, compression="zstd")
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame | str) -> None:
    """Removes materialised tables, or folders below the shared one, that no later plan reads."""
    spark = SparkSession.getActiveSession()
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for table in tables:
        if isinstance(table, str):
            folder = table
        else:
            files = table.inputFiles()
            if not files:
                continue
            folder = files[0].rpartition("/")[0]
        if "/nearspan-" not in folder:
            raise ValueError(f"{folder} is no table of this library")
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def spread(df: DataFrame) -> DataFrame:
    """df over at least as many partitions as there are cores: a small file is one partition."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= n else df.repartition(n)


def number_rows(df: DataFrame, order: list[str], number: str) -> DataFrame:
    """df with dense row numbers in a total order, without a window over all rows: a
    range-partitioned sort, written once, then places in each part plus the rows of the parts
    before it (one number a part on the driver)."""
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    parts = materialise(placed, "numbers")
    parts = parts.withColumns({"_part": F.shiftright("_id", 33), "_at": F.col("_id").bitwiseAND((1 << 33) - 1)})
    starts, n = [], 0
    for row in parts.groupBy("_part").agg(F.count("*").alias("n")).orderBy("_part").collect():
        starts.append((row["_part"], n))
        n += row["n"]
    base = df.sparkSession.createDataFrame(starts, "_part long, _start long")
    return parts.join(F.broadcast(base), "_part").withColumn(number, F.col("_start") + F.col("_at")).drop("_id", "_part", "_at", "_start")
