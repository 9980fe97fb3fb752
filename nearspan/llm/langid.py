"""Language identification by prediction by partial matching (PPM).

For each language a context tree over bytes is built from a bounded sample of labelled
texts: contexts of up to three bytes, escape probabilities by method C, and exclusion (what
a context has seen is left out, and the rest renormalised, when its escape is taken). The
statistics are then frozen, so the code length of a byte depends on the three bytes before
it alone, and every probability of every context is computed once. A text's score under a
language is the exact sum of its bytes' code lengths; the language with the shortest code
wins, and `score` is its posterior under equal priors.

Bytes are folded before they enter the trees (ASCII and Latin-1 letters to lower case, digits
to one symbol, white space to one symbol, other ASCII to one); bytes that no sample has
share one symbol.

Bound: the trees learn from at most `per_language` texts of each language, chosen by a hash
of doc_id among all labelled rows. Everything else reads whole texts of all rows.

Defined results: a null text or one without a letter is `und` with score 0; ties go to the
first language in code-point order; a table without labelled rows gives `und` everywhere;
repeated rows are scored alike; a very long text is scored whole; other columns, whatever their names, are not used.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import chunks, small_batches, table, views, with_fields

PER_LANGUAGE = 400
UNDETERMINED = "und"
_SPACE, _DIGIT, _OTHER = 32, 48, 46


def fold_table() -> np.ndarray:
    out = np.arange(256, dtype=np.uint8)
    for b in range(128):
        c = chr(b)
        out[b] = ord(c.lower()) if c.isalpha() else _DIGIT if c.isdigit() else _SPACE if c.isspace() or b < 32 else _OTHER
    return out


_FOLD = fold_table()


def fold(raw: np.ndarray) -> np.ndarray:
    """Folded bytes of a buffer; of two-byte Latin-1 capitals the second byte is lowered."""
    out = _FOLD[raw]
    if len(raw) > 1:
        capital = (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97)
        out[1:][capital] += 0x20
    return out


def context_bytes(s: np.ndarray, starts: np.ndarray, back: int, pad: int) -> np.ndarray:
    """The symbol `back` places before each position, `pad` before the start of its text."""
    out = np.empty_like(s)
    out[:back] = pad
    out[back:] = s[:-back] if len(s) > back else s[:0]
    ends = np.r_[starts[1:], len(s)]
    for j in range(back):
        at = starts + j
        out[at[at < ends]] = pad
    return out


@dataclass
class Trees:
    """Frozen trees of all languages: code lengths in bits by context row and symbol."""

    languages: list[str]
    symbol: np.ndarray  # byte -> symbol
    size: int  # symbols
    row_of: np.ndarray  # index of three context symbols -> row
    bits: np.ndarray  # [rows * size, languages]

    def code_lengths(self, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Bits of each text under each language. off: bounds of the texts in raw."""
        out = np.zeros((len(off) - 1, len(self.languages)))
        for a, b in chunks(off):
            bounds = off[a : b + 1] - off[a]
            full = np.flatnonzero(np.diff(bounds))
            if not len(full):
                continue
            starts = bounds[:-1][full]
            s = self.symbol[fold(raw[off[a] : off[b]])].astype(np.int32)
            pad, n = int(self.symbol[_SPACE]), self.size
            index = (context_bytes(s, starts, 3, pad) * n + context_bytes(s, starts, 2, pad)) * n + context_bytes(s, starts, 1, pad)
            at = self.row_of[index] * n + s
            # Texts begin where the one before ends, so the sums of the starts cover all.
            out[a + full] = np.add.reduceat(self.bits[at], starts, axis=0, dtype=np.float64)
        return out


def ngram_counts(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The four-byte groups (three of context, one coded) of folded texts, and their counts."""
    s = fold(raw[off[0] : off[-1]]).astype(np.uint32)
    starts = off[:-1][np.diff(off) > 0] - off[0]
    key = s.copy()
    for back in (1, 2, 3):
        key |= context_bytes(s, starts, back, _SPACE) << np.uint32(8 * back)
    return np.unique(key, return_counts=True)


def _ppm(counts: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """Probabilities of one order: what is seen by method C, the escape over the rest of the
    order below. counts, lower: [contexts, symbols]."""
    total, kinds = counts.sum(1, keepdims=True), (counts > 0).sum(1, keepdims=True)
    rest = np.where(counts > 0, 0, lower)
    left = rest.sum(1, keepdims=True)
    some = (total > 0) & (left > 0)
    escape = np.where(total > 0, kinds / np.maximum(total + kinds, 1), 1.0)
    p = np.where(total > 0, counts / np.maximum(total + kinds, 1), 0) + np.where(some | (total == 0), escape * np.where(total > 0, rest / np.maximum(left, 1e-300), lower), 0)
    return p / p.sum(1, keepdims=True)


def build(counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> Trees:
    """Trees from each language's four-byte groups."""
    languages = sorted(counts)
    used = np.unique(np.concatenate([(k >> np.uint32(8 * j)) & np.uint32(255) for k, _ in counts.values() for j in range(4)] + [np.array([_SPACE], np.uint32)]))
    n = len(used) + 1
    symbol = np.zeros(256, np.uint8)
    symbol[used.astype(np.int64)] = np.arange(1, n)
    split = {}
    for lang, (k, c) in counts.items():
        s = [symbol[(k >> np.uint32(8 * j)) & np.uint32(255)].astype(np.int64) for j in range(4)]
        split[lang] = ((s[3] * n + s[2]) * n + s[1], s[0], c.astype(np.float64))
    deep = np.unique(np.concatenate([x[0] for x in split.values()]))
    row_of = (np.arange(n**3) % (n * n)).astype(np.int32)
    row_of[deep] = n * n + np.arange(len(deep))
    bits = np.empty(((n * n + len(deep)), n, len(languages)), np.float32)
    for i, lang in enumerate(languages):
        context, coded, c = split[lang]
        grid = np.zeros((n**2, n))
        np.add.at(grid, (context % (n * n), coded), c)
        one = grid.reshape(n, n, n).sum(0)
        zero = one.sum(0, keepdims=True)
        p0 = _ppm(zero, np.full((1, n), 1 / n))
        p1 = _ppm(one, np.broadcast_to(p0, (n, n)))
        p2 = _ppm(grid, np.tile(p1, (n, 1)))
        top = np.zeros((len(deep), n))
        np.add.at(top, (np.searchsorted(deep, context), coded), c)
        p3 = _ppm(top, p2[deep % (n * n)])
        bits[: n * n, :, i] = -np.log2(np.maximum(p2, 1e-12))
        bits[n * n :, :, i] = -np.log2(np.maximum(p3, 1e-12))
    return Trees(languages, symbol, n, row_of, bits.reshape(-1, len(languages)))


def sample(labelled: DataFrame, per_language: int) -> DataFrame:
    """At most per_language rows (lang, text) of each language, by a hash of doc_id."""
    # One number for each language; the filter below leaves about twice the bound to rank.
    sizes = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(17)), F.lit(1 << 30))
    share = F.lit(False)
    for lang, n in sizes.items():
        share = share | ((F.col("lang") == lang) & (draw < int(min(1, 2 * per_language / n + 20 / n) * (1 << 30))))
    few = labelled.filter(share).select("lang", "text", draw.alias("_draw"), "doc_id")
    order = Window.partitionBy("lang").orderBy("_draw", "doc_id", "text")
    return few.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= per_language).select("lang", "text")


def fit(labelled: DataFrame, per_language: int = PER_LANGUAGE) -> Trees | None:
    """Trees from labelled rows (doc_id, lang, text); None if there are none."""
    labelled = labelled.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())

    def count(rows: pa.Table) -> pa.Table:
        raw, off = views(rows.column("text"))
        keys, n = ngram_counts(raw, off)
        return pa.table({"lang": [rows.column("lang")[0].as_py()], "keys": [keys.astype("<u4").tobytes()], "counts": [n.astype("<i8").tobytes()]}, pa.schema([("lang", pa.string()), ("keys", pa.binary()), ("counts", pa.binary())]))

    found = sample(labelled, per_language).groupBy("lang").applyInArrow(count, "lang string, keys binary, counts binary").collect()
    counts = {r["lang"]: (np.frombuffer(r["keys"], "<u4"), np.frombuffer(r["counts"], "<i8")) for r in found}
    return build(counts) if counts and any(len(k) for k, _ in counts.values()) else None


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def predict(docs: DataFrame, trees: Trees | None, text: str = "text", language: str = "lang_pred", score: str = "score") -> DataFrame:
    """docs with the predicted language of `text` and its score (existing columns of these
    two names are replaced)."""
    spark = docs.sparkSession
    small_batches(spark)
    kept = [c for c in docs.columns if c.lower() not in (language.lower(), score.lower())]
    schema = with_fields(docs.select(*kept), f"`{language}` string, `{score}` double")
    held = spark.sparkContext.broadcast(trees)  # bounded: the sample bounds the contexts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in batches:
            column = batch.column(kept.index(text))
            found, sure = [UNDETERMINED] * len(column), np.zeros(len(column))
            if model is not None and len(column):
                raw, off = views(column)
                bits = model.code_lengths(raw, off)
                best = bits.argmin(1)
                post = 1 / np.exp2(np.maximum(bits.min(1, keepdims=True) - bits, -1000)).sum(1)
                for i, t in enumerate(column):
                    if has_letter(t.as_py()):
                        found[i], sure[i] = model.languages[best[i]], post[i]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string()), pa.array(sure, pa.float64())], names=[*kept, language, score])

    return docs.select(*kept).mapInArrow(run, schema)


def remainder(n: int, column: str = "doc_id") -> Column:
    """crc32 of the column's text, modulo n (a null counts as empty text)."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n


def crc_remainder(doc_id: int | None, n: int) -> int:
    """The same in Python."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % n


def learning_rows(docs: DataFrame) -> DataFrame:
    return docs.filter(remainder(3) != 1).select("doc_id", "lang", "text")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    trees = fit(learning_rows(docs))
    rows = docs.select("doc_id", (remainder(3) == 1).alias("held_out"), "text")
    return predict(rows, trees).select("doc_id", "held_out", "lang_pred", "score")
