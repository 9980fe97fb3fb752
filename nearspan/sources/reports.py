"""The text report of an experiment, and its numbers read back from text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The marks and labels of a report.
START = "--- START_BATCH_RUN ---"
BATCH = "query_maxDist: "
LABELS = {
    "avg_tp": "Average TP: ",
    "avg_fp": "Average FP: ",
    "avg_fn": "Average FN: ",
    "recall": "Average Recall: ",
    "precision": "Average Precision: ",
    "fp_per_tp": "Average FP/TP: ",
}
DISTANCES, DISTANCES_END = "DISTANCES_START:", "DISTANCES_END"
NUMBER = "([0-9.eE+-]+)"


def report(summary: DataFrame) -> DataFrame:
    """(max_dist, text) of a summary with max_dist, the columns of LABELS and, if there is one,
    an array of distances."""
    lines = [F.lit(START), F.concat(F.lit(BATCH), F.col("max_dist").cast("string"))]
    lines += [F.concat(F.lit(label), F.col(c).cast("string")) for c, label in LABELS.items()]
    if "distances" in summary.columns:
        lines += [F.concat(F.lit(DISTANCES + " "), F.array_join(F.col("distances").cast("array<string>"), " ")), F.lit(DISTANCES_END)]
    return summary.select("max_dist", F.concat_ws("\n", *lines).alias("text"))


def scrape(logs: DataFrame) -> DataFrame:
    """The batches of logs (text): max_dist, the columns of LABELS (null where a line is
    missing) and distances (empty where there are none). A batch without its max_dist is left
    out."""
    batch = F.explode(F.slice(F.split("text", START + "\n"), 2, 1 << 30))
    runs = logs.select(batch.alias("run")).withColumn("max_dist", F.regexp_extract("run", f"{BATCH}([0-9]+)", 1).try_cast("int"))
    numbers = [F.regexp_extract("run", f"{label}{NUMBER}", 1).try_cast("double").alias(c) for c, label in LABELS.items()]
    listed = F.split(F.trim(F.regexp_extract("run", f"(?s){DISTANCES}(.*?)\n{DISTANCES_END}", 1)), r"\s+")
    distances = F.filter(F.transform(listed, lambda x: x.try_cast("double")), lambda x: x.isNotNull())
    return runs.filter(F.col("max_dist").isNotNull()).select("max_dist", *numbers, distances.alias("distances"))
