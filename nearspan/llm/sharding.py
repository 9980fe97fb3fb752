"""Sharding: a Feistel permutation with cycle walking over global row numbers.

Row numbers 0..N-1 follow doc_id (ties: size, then checksum). The permutation works on a
grid of a x b cells, the smallest near-square one that holds N, and values outside 0..N-1
are permuted again until they fall inside. The permuted number p gives shard p mod k and
slot p div k, so shard sizes differ by at most one row, slots have no gaps and any row's
place can be computed from its number alone. Everything is DataFrame expressions.

Defined results: a null text has no bytes (size 8, checksum 0); a null doc_id sorts first;
repeated rows get numbers of their own; a very long text counts by its size; an empty table gives no rows; other columns of the
input are ignored, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table

SHARDS = 24
#: Prime modulus and the round constants (multiplier, addend).
PRIME = 2147483647
ROUNDS = ((1103515245, 12345), (1664525, 1013904223), (214013, 2531011), (69069, 907133923), (1566083941, 1812433253), (1597334677, 374761393))


def grid(n: int) -> tuple[int, int]:
    """Sides a >= b of the smallest near-square grid with at least n cells."""
    a = max(1, math.isqrt(max(0, n - 1)) + 1)
    return a, max(1, -(-n // a))


def permute_values(x: np.ndarray, a: int, b: int) -> np.ndarray:
    """One pass of the permutation over the whole grid (driver-side twin of `permuted`)."""
    left, right = x // b, x % b
    for k, (mul, add) in enumerate(ROUNDS):
        if k % 2:
            right = (right + _mix(left, mul, add)) % b
        else:
            left = (left + _mix(right, mul, add)) % a
    return left * b + right


def _mix(v, mul: int, add: int):
    y = (v % PRIME * mul + add) % PRIME
    return (y * y % PRIME * mul + add) % PRIME


def walk_length(n: int) -> int:
    """Most passes that any row number below n needs; looks only at the fewer than sqrt(n)+1
    cells outside, so it is exact and cheap at any size."""
    a, b = grid(n)
    outside, steps = np.arange(n, a * b, dtype=np.int64), 1
    while len(outside):
        outside = permute_values(outside, a, b)
        outside = outside[outside >= n]
        steps += 1
        if steps > a * b - n + 1:
            break
    return steps


def locate(row_number: int, n: int, shards: int = SHARDS) -> tuple[int, int]:
    """Shard and slot of one row number below n, without any table."""
    a, b = grid(n)
    x = int(permute_values(np.array([row_number], np.int64), a, b)[0])
    while x >= n:
        x = int(permute_values(np.array([x], np.int64), a, b)[0])
    return x % shards, x // shards


def with_permutation(df: DataFrame, number: str, n: int, out: str) -> DataFrame:
    """Adds the permuted row number; one projection a round, so that Catalyst keeps each
    round's value as a column and the code stays small."""
    a, b = grid(n)
    df = df.withColumn(out, F.col(number))
    for walk in range(walk_length(n)):
        df = df.withColumns({"_l": F.expr(f"`{out}` div {b}"), "_r": F.col(out) % b})
        for k, (mul, add) in enumerate(ROUNDS):
            side, other, m = ("_r", "_l", b) if k % 2 else ("_l", "_r", a)
            df = df.withColumn("_y", (F.col(other) % PRIME * mul + add) % PRIME)
            df = df.withColumn("_y", (F.col("_y") * F.col("_y") % PRIME * mul + add) % PRIME)
            df = df.withColumn(side, (F.col(side) + F.col("_y")) % m)
        passed = F.col("_l") * b + F.col("_r")
        df = df.withColumn(out, passed if not walk else F.when(F.col(out) >= n, passed).otherwise(F.col(out)))
    return df.drop("_l", "_r", "_y")


def global_numbers(df: DataFrame, order: list[str], number: str = "row_number") -> tuple[DataFrame, int]:
    """Dense row numbers in a total order without a global window: a range-partitioned sort,
    written once, then numbers within each part plus the rows of the parts before it."""
    # Null columns sort first; the part and the place in it are fixed when the table is written.
    parts = df.repartitionByRange(*[F.col(c).asc_nulls_first() for c in order]).sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in order])
    placed = F.monotonically_increasing_id()
    parts = materialise(parts.withColumn("_id", placed), "numbers")
    parts = parts.withColumns({"_part": F.shiftright("_id", 33), "_at": F.col("_id").bitwiseAND((1 << 33) - 1)})
    # One row for each part: bounded by the number of partitions, not by the rows.
    counts = parts.groupBy("_part").agg(F.count("*").alias("_n")).orderBy("_part").collect()
    starts, n = {}, 0
    for row in counts:
        starts[row["_part"]], n = n, n + row["_n"]
    if not starts:
        return parts.withColumn(number, F.lit(0).cast("long")).drop("_id", "_part", "_at"), 0
    base = df.sparkSession.createDataFrame(list(starts.items()), "_part long, _start long")
    numbered = parts.join(F.broadcast(base), "_part").withColumn(number, F.col("_start") + F.col("_at"))
    return numbered.drop("_id", "_part", "_at", "_start"), n


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, row_number, position, shard, slot of every row."""
    slim = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8).alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
    )
    numbered, n = global_numbers(slim, ["doc_id", "size", "text_crc32"])
    placed = with_permutation(numbered, "row_number", n, "position") if n else numbered.withColumn("position", F.col("row_number"))
    return placed.withColumns({"shard": (F.col("position") % shards).cast("int"), "slot": F.expr(f"position div {shards}")})


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_number", "position")


def _sql_rounds(value: str) -> str:
    """Nested DuckDB selects for one pass over `value` of relation {src} with columns n, a, b."""
    inner = f"select *, {value} // b as l0, {value} % b as r0 from {{src}}"
    for k, (mul, add) in enumerate(ROUNDS):
        side, other, m = ("r", "l", "b") if k % 2 else ("l", "r", "a")
        y = f"(({other}{k} % {PRIME} * {mul} + {add}) % {PRIME})"
        mixed = f"({y} * {y} % {PRIME} * {mul} + {add}) % {PRIME}"
        inner = f"select * exclude (l{k}, r{k}), ({side}{k} + {mixed}) % {m} as {side}{k + 1}, {other}{k} as {other}{k + 1} from ({inner})"
    return f"select * exclude (l{len(ROUNDS)}, r{len(ROUNDS)}), l{len(ROUNDS)} * b + r{len(ROUNDS)} as v from ({inner})"


#: CRC-32 (polynomial edb88320) in SQL: DuckDB has no function for it.
CRC_TABLE = """table_crc as (select list(c order by i) as t from (select i, list_reduce(list_prepend(i::bigint, range(8)), lambda c, k: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end) as c from range(256) r(i)))"""


def crc_sql(s: str) -> str:
    """CRC-32 of a text in SQL, beside the relation of CRC_TABLE; 0 for null."""
    return f"""case when {s} is null or {s} = '' then 0 else xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, octet_length(encode({s})) * 2, 2), lambda k: ('0x' || substr(hex(encode({s})), k, 2))::bigint)), lambda c, x: xor(c // 256, t[xor(c % 256, x) + 1])), 4294967295) end"""



ORACLE = f"""with recursive {CRC_TABLE},
slim as (select doc_id, (coalesce(octet_length(encode(text)), 0) + 8)::bigint as size, ({crc_sql("text")})::bigint as text_crc32 from documents, table_crc),
dims as (select count(*)::bigint as n, greatest(1, ceil(sqrt(count(*)))::bigint) as a from documents),
numbered as (select slim.*, row_number() over (order by doc_id nulls first, size, text_crc32) - 1 as row_number, n, a, greatest(1, (n + a - 1) // a) as b from slim, dims),
walk as ({_sql_rounds("row_number").format(src="numbered")} union all {_sql_rounds("v").replace("select *, v // b", "select * exclude (v), v // b").format(src="(select * from walk where v >= n)")})
select doc_id, size, text_crc32, 'rows' as law, (v % {SHARDS})::int as shard, v // {SHARDS} as slot, null::int as grown_shard, row_number, v as position from walk where v < n"""
