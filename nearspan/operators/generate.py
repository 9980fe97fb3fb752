"""Generators: references, queries, mutated reads. All draws are seeded hashes of row numbers,
so a row's value does not depend on partitions or on other rows."""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MODULUS = 2147483647


def draw(*key: Column) -> Column:
    """A number in 0..MODULUS-1 from integer columns by arithmetic that SQL engines share."""
    out = F.lit(7).cast("long")
    for k in key:
        out = (out * 48271 + F.pmod(k.cast("long"), F.lit(MODULUS)) * 69621 + 11) % MODULUS
    return out


def simulate_queries(refs: DataFrame, n: int | None, k: int) -> DataFrame:
    """Windows of length k at drawn places of n drawn references, or of all (n None):
    (q_id, q, ref_id, pos)."""
    fit = refs.filter(F.length("seq") >= k).withColumn("_d", draw(F.col("ref_id")))
    some = (fit if n is None else fit.orderBy("_d", "ref_id").limit(n)).withColumn("pos", (F.col("_d") % (F.length("seq") - k + 1)).cast("int"))
    return some.select(F.col("ref_id").alias("q_id"), F.expr(f"substring(seq, pos + 1, {k})").alias("q"), "ref_id", "pos")


def reference_sequence(spark: SparkSession, length: int, seed: int = 42, parts: int = 8) -> DataFrame:
    """One random sequence over ACGT: (ref_id, seq)."""
    base = F.substring(F.lit("ACGT"), (F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(4)) + 1).cast("int"), F.lit(1))
    rows = spark.range(0, length, 1, parts).select("id", base.alias("b"), F.floor(F.col("id") / 4096).alias("page"))
    pages = rows.groupBy("page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "b"))), lambda x: x["b"]), "").alias("s"))
    whole = pages.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "s"))), lambda x: x["s"]), "").alias("seq"))
    return whole.select(F.lit(0).cast("long").alias("ref_id"), "seq")


def mutate(seq: str, rate: float, rng: random.Random) -> str:
    """max(1, floor(len * rate)) edits: substitutions by another base, deletions while more
    than half is left, insertions."""
    out, n = list(seq), len(seq)
    for _ in range(max(1, int(n * rate))):
        kind = rng.choice(("sub", "del", "ins"))
        if not out or kind == "ins":
            out.insert(rng.randrange(len(out) + 1), rng.choice("ACGT"))
        elif kind == "sub":
            i = rng.randrange(len(out))
            out[i] = rng.choice([b for b in "ACGT" if b != out[i]])
        elif len(out) > n / 2:
            del out[rng.randrange(len(out))]
    return "".join(out)


def mutated(df: DataFrame, column: str, key: str, rate: float, seed: int = 42) -> DataFrame:
    """df with `column` mutated; a row's edits follow from its key."""

    @F.pandas_udf("string")
    def edit(s: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series([mutate(x, rate, random.Random(f"{seed}:{i}")) for x, i in zip(s, k, strict=True)])

    return df.withColumn(column, edit(F.col(column), F.col(key).cast("string")))


def substituted(df: DataFrame, column: str, key: str, most: int = 3, seed: int = 42) -> DataFrame:
    """df with 1..most substitutions in `column`."""

    @F.pandas_udf("string")
    def edit(s: pd.Series, k: pd.Series) -> pd.Series:
        out = []
        for x, i in zip(s, k, strict=True):
            rng = random.Random(f"{seed}:{i}")
            y = list(x)
            for at in rng.sample(range(len(y)), min(len(y), rng.randint(1, most))):
                y[at] = rng.choice([b for b in "ACGT" if b != y[at]])
            out.append("".join(y))
        return pd.Series(out)

    return df.withColumn(column, edit(F.col(column), F.col(key).cast("string")))


def reads(refs: DataFrame, n: int, k: int, rate: float, seed: int = 42) -> DataFrame:
    """n mutated reads read_00000, ... from one reference."""
    spark = refs.sparkSession
    ids = spark.range(n).select(F.col("id").alias("i"))
    placed = ids.crossJoin(F.broadcast(refs.limit(1))).withColumn("pos", (draw(F.col("i"), F.lit(seed)) % (F.length("seq") - k + 1)).cast("int"))
    cut = placed.select(F.format_string("read_%05d", "i").alias("seq_id"), F.expr(f"substring(seq, pos + 1, {k})").alias("seq"), "pos")
    return mutated(cut, "seq", "seq_id", rate, seed)


def random_sequences(spark: SparkSession, n: int, least: int = 50, most: int = 100, seed: int = 42) -> DataFrame:
    """(seq_id, seq) with lengths least..most."""

    @F.pandas_udf("string")
    def make(i: pd.Series) -> pd.Series:
        out = []
        for x in i:
            rng = random.Random(f"{seed}:{x}")
            out.append("".join(rng.choices("ACGT", k=rng.randint(least, most))))
        return pd.Series(out)

    return spark.range(n).select(F.format_string("seq_%05d", "id").alias("seq_id"), make("id").alias("seq"))


def clustered(spark: SparkSession, clusters: int, per: int, length: int = 100, rate: float = 0.03, seed: int = 42) -> DataFrame:
    """(seq_id, family, seq): mutated copies of random seeds."""
    seeds = random_sequences(spark, clusters, length, length, seed).select(F.col("seq_id").alias("family"), "seq")
    copies = seeds.crossJoin(spark.range(per).select(F.col("id").alias("copy"))).withColumn("seq_id", F.concat_ws("_", "family", F.col("copy").cast("string")))
    return mutated(copies, "seq", "seq_id", rate, seed).select("seq_id", "family", "seq")
