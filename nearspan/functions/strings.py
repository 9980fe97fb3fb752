"""Column builders for strings: distances, windows, seeds, parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: The four bases in turn for each letter.
BASES = ("ACGT" * 7)[:26] * 2


def edit_distance(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b)


def bounded_distance(a: Column, b: Column, t: int | Column) -> Column:
    """Edit distance up to t, -1 beyond it. The length test is a cheap bound."""
    if isinstance(t, int):
        return F.when(F.abs(F.length(a) - F.length(b)) > t, F.lit(-1)).otherwise(F.levenshtein(a, b, t))
    d = F.levenshtein(a, b)
    return F.when(F.abs(F.length(a) - F.length(b)) > t, F.lit(-1)).otherwise(F.when(d <= t, d).otherwise(F.lit(-1)))


def window_distance(pattern: Column, text: Column) -> Column:
    """Least edit distance of pattern to any window of its own length in text; the plain
    distance where text is the shorter one."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(text) - F.length(pattern) + 1, F.lit(1)))
    inner = F.array_min(F.transform(starts, lambda i: F.levenshtein(pattern, text.substr(i, F.length(pattern)))))
    return F.when(F.length(text) < F.length(pattern), F.levenshtein(pattern, text)).otherwise(inner)


def windows(seq: Column, k: int) -> Column:
    """Array of (pos, kmer), positions from 0; empty where seq is shorter than k."""
    inner = F.transform(F.sequence(F.lit(0), F.length(seq) - k), lambda i: F.struct(i.alias("pos"), seq.substr(i + 1, F.lit(k)).alias("kmer")))
    return F.when(F.length(seq) >= k, inner).otherwise(F.array().cast("array<struct<pos:int,kmer:string>>"))


def to_bases(text: Column) -> Column:
    """Letters of a text as bases (a stand-in for a genome); all else is dropped."""
    return F.translate(F.regexp_replace(text, "[^A-Za-z]", ""), LETTERS, BASES)


def normalise_bases(seq: Column) -> Column:
    """Upper case; whatever is no base becomes N."""
    return F.regexp_replace(F.upper(seq), "[^ACGT]", "N")


def band(d: Column, t: int | Column) -> tuple[Column, Column]:
    """The band of distances that a match within t can have to an anchor at distance d."""
    t = F.lit(t) if isinstance(t, int) else t
    return F.greatest(d - t, F.lit(0)), d + t


def parse_ints(text: Column) -> Column:
    """Integers of a comma list; blanks are trimmed, bad entries dropped."""
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x).try_cast("int")), lambda x: x.isNotNull())


def parse_thresholds(js: Column) -> Column:
    """{"id": n} as a map."""
    return F.from_json(js, "map<string,int>")


def parse_doubles(text: Column) -> Column:
    """An array literal such as [1.0, 2.5]."""
    return F.from_json(text, "array<double>")


def overlaps(d: Column, radius: Column, r: Column | int) -> Column:
    """A ball of this radius at distance d meets a ball of radius r."""
    return d <= radius + r


def anchor_prunable(qd: Column, fp: Column, child_radius: Column, tol: Column | int) -> Column:
    """Some anchor shows that nothing in the child's ball is within tol. Missing fingerprints
    or other lengths prune nothing."""
    far = F.exists(F.zip_with(qd, fp, lambda x, y: F.abs(x - y)), lambda v: v > child_radius + tol)
    return F.coalesce((F.size(qd) == F.size(fp)) & far, F.lit(False))
