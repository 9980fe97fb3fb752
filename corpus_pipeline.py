"""A corpus pipeline of five stages over `documents`: language ID, line dedup, near-dedup,
benchmark decontamination, BPE encoding.

A stage is a function of (session, documents, table folder). Each one's result is written as
Parquet and read again as the next one's documents; all but the last have the columns of
`documents`, and further columns, whatever their names, stay with their rows until the last.

Defined results, beside those of the operators: null texts and texts without a letter are rejected by
the first stage; repeated rows count as copies, of which one stays; ties for what stays go to the
least doc_id, then the least digest; very long texts go through whole; an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nearspan.llm import bpe, decontam, langid, linededup, neardup
from nearspan.llm.common import fresh, materialise, table

#: A text whose best language has less than this posterior is rejected.
LEAST_SCORE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps texts in a language that the trees know. Where no row is labelled there is
    nothing to learn from, and only texts without a letter go."""
    trees = langid.fit(langid.learning_rows(docs))
    if trees is None:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    language, score = fresh("_language", docs), fresh("_score", docs)
    found = langid.predict(docs, trees, language=language, score=score)
    return found.filter((F.col(language) != langid.UNDETERMINED) & (F.col(score) >= LEAST_SCORE)).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps all documents; lines found in many of them stay in one. n_chars follows."""
    cut = linededup.drop_repeats(docs, lines=fresh("n_lines", docs), dropped=fresh("n_dropped", docs))
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cut.select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class: the one with the least doc_id. Null texts stay."""
    found = neardup.classes(docs)
    node, copy = fresh("_node", docs), fresh("_copy", docs)
    # One (doc_id, text) of each class, also where doc_id repeats or is null.
    stay = found.filter(F.col("node").isNotNull() & F.col("doc_id").eqNullSafe(F.col("class_id"))).groupBy(F.col("class_id").alias("_id")).agg(F.min("node").alias("_text"))
    marked = docs.withColumn(node, neardup.node())
    kept = marked.join(stay, marked["doc_id"].eqNullSafe(stay["_id"]) & (marked[node] == stay["_text"]), "left_semi")
    same = Window.partitionBy("doc_id", node).orderBy(F.lit(0))
    once = kept.withColumn(copy, F.row_number().over(same)).filter(F.col(copy) == 1)
    return once.select(*docs.columns).unionByName(docs.filter(F.col("text").isNull()))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that hold no benchmark item."""
    leak = fresh("_leak", docs)
    flagged = decontam.flag(docs, table(spark, sf_dir, "benchmark"), out=leak)
    return flagged.filter(~F.col(leak)).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str, path: str | None = None) -> DataFrame:
    """Token ids of every text, and the digest of what they decode to."""
    made = bpe.encode(docs.select("doc_id", "lang", "source", "text"), path or bpe.default_path(), ids="ids", decoded="decoded")
    return made.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("bpe", encode),
]

#: Learned models, sketches and alignments are beyond SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
