"""Language ID, LM scoring, BPE."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from nearspan.llm import bpe, brownlm, langid
from pyspark.sql import functions as F


def test_ppm_probabilities_sum_to_one():
    texts = [b"the cat sat on the mat", b"that hat"]
    raw = np.frombuffer(b"".join(texts), np.uint8)
    trees = langid.build({"en": langid.ngram_counts(raw, np.array([0, 22, 30]))})
    p = np.exp2(-trees.bits.reshape(-1, trees.size).astype(float))
    assert np.allclose(p.sum(1), 1, atol=1e-4)


def brute_bits(trees, text, language):
    """Code length of one text, symbol by symbol."""
    s = trees.symbol[langid.fold(np.frombuffer(text, np.uint8))].astype(int)
    pad, n, total = int(trees.symbol[32]), trees.size, 0.0
    for i in range(len(s)):
        a, b, c = (int(s[i - k]) if i >= k else pad for k in (3, 2, 1))
        total += float(trees.bits[trees.row_of[(a * n + b) * n + c] * n + s[i], trees.languages.index(language)])
    return total


def test_code_lengths_match_symbol_by_symbol(rows):
    texts = [r[1].encode() for r in rows if r[1] is not None and len(r[1]) < 5000]
    off = np.r_[0, np.cumsum([len(t) for t in texts])]
    raw = np.frombuffer(b"".join(texts), np.uint8)
    trees = langid.build({"en": langid.ngram_counts(raw[: off[20]], off[:21]), "de": langid.ngram_counts(raw, off)})
    got = trees.code_lengths(raw, off)
    for i, t in enumerate(texts[::7]):
        assert got[7 * i, 1] == pytest.approx(brute_bits(trees, t, "en"), abs=0.05)
        assert got[7 * i, 0] == pytest.approx(brute_bits(trees, t, "de"), abs=0.05)


def test_language_of_odd_rows(docs, clash, none, rows):
    trees = langid.fit(langid.learning_rows(docs))
    got = {r["doc_id"]: r for r in langid.predict(clash, trees).collect()}
    for i in (100, 101, 102, 103):
        assert got[i]["lang_pred"] == "und" and got[i]["score"] == 0
    held = [r for r in rows if r[1] and r[0] is not None and r[0] < 60 and langid.crc_remainder(r[0], 3) == 1]
    assert sum(got[r[0]]["lang_pred"] == r[2] for r in held) / len(held) >= 0.95
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert langid.predict(none, trees).count() == 0
    assert langid.fit(none) is None
    assert {r["lang_pred"] for r in langid.predict(docs, None).collect()} == {"und"}
    assert langid.predict(docs, trees).count() == docs.count()


def test_remainder_is_crc32_of_the_id(docs):
    for r in docs.select("doc_id", langid.remainder(7).alias("m")).collect():
        assert r["m"] == langid.crc_remainder(r["doc_id"], 7)
    assert zlib.crc32(b"12") % 3 == langid.crc_remainder(12, 3)


def test_lm_scores_against_brute_force(docs, rows):
    docs2 = docs.withColumn("held_out", langid.remainder(7) == 2)
    got = brownlm.score(docs2, ~F.col("held_out"), ["doc_id", "text", "held_out"]).collect()
    assert len(got) == len(rows)
    counts = Counter()
    for r in rows:
        if langid.crc_remainder(r[0], 7) != 2:
            counts.update([*brownlm.tokens((r[1] or "").encode()), "END"])
    total, types = sum(counts.values()), len(counts)
    for r in got:
        words = [*brownlm.tokens((r["text"] or "").encode()), "END"]
        assert r["n_tokens"] == len(words) and r["train_tokens"] == total
        assert r["n_known"] == sum(counts[w] > 0 for w in words)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[w] + 1) / (total + types + 1)) for w in words), abs=1e-6)
        assert r["score"] < 0
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def brute_class_scores(rows, first):
    """Scores by the model's formulas, word by word; first: classes of the units."""
    C, end = brownlm.CLASSES, int(first.class_of[-1])
    texts = [(brownlm.tokens((r[1] or "").encode()), langid.crc_remainder(r[0], 7) != 2) for r in rows]
    start = lambda w: end if w is None else int(first.class_of[first.top.get(w, brownlm.suffix_unit(w))])
    count, after, before, own = Counter(), {}, {}, Counter()
    for words, learn in texts:
        ring = [None, *words, None]
        for k in range(1, len(ring) - 1) if learn else ():
            w = ring[k]
            count[w] += 1
            if ring[k + 1] == w:
                own[w] += 1
            else:
                after.setdefault(w, Counter())[start(ring[k + 1])] += 1
            if ring[k - 1] != w:
                before.setdefault(w, Counter())[start(ring[k - 1])] += 1
    grid, mass = first.grid, first.mass
    into, out = grid.sum(0), grid.sum(1)
    alone = (into + 1) / (into.sum() + C)
    log = math.log
    cls = {}
    for w in count:
        now = cls[w] = start(w)
        if w in first.top:
            continue
        right, left, n = after.get(w, {}), before.get(w, {}), count[w]
        m = sum(left.values()) + own[w]
        gains = []
        for c in range(C):
            if c == end:
                gains.append(-math.inf)
            elif c != now:
                t = lambda a, b: log((grid[a, b] + brownlm.BETA * alone[b]) / (out[a] + brownlm.BETA))
                gains.append(sum(x * t(c, b) for b, x in right.items()) + sum(x * t(a, c) for a, x in left.items()) + own[w] * t(c, c) - m * log(mass[c]))
            else:
                left_out = max(out[c] - m, 0) + brownlm.BETA
                g = sum(x * log((max(grid[c, b] - right.get(b, 0), 0) + brownlm.BETA * alone[b]) / left_out) for b, x in right.items())
                g += sum(x * log((max(grid[a, c] - left.get(a, 0), 0) + brownlm.BETA * alone[c]) / (out[a] + brownlm.BETA)) for a, x in left.items())
                g += own[w] * log((max(grid[c, c] - own[w] - right.get(c, 0) - left.get(c, 0), 0) + brownlm.BETA * alone[c]) / left_out)
                gains.append(g - m * log(max(mass[c] - m - brownlm.DELTA, brownlm.DELTA)))
        best = max(range(C), key=lambda c: gains[c])
        if gains[best] > gains[now] + 1e-9:
            cls[w] = best
    grid, types = [[0] * C for _ in range(C)], Counter(cls.values())
    ends = sum(learn for _, learn in texts)
    types[end] = int(ends > 0)
    path = lambda words: [end, *(cls.get(w, start(w)) for w in words), end]
    for words, learn in texts:
        for a, b in zip(path(words), path(words)[1:]) if learn else ():
            grid[a][b] += 1
    into, out = [sum(g[c] for g in grid) for c in range(C)], [sum(g) for g in grid]
    scores = []
    for words, _ in texts:
        x = 0.0
        for w, a, b in zip([*words, None], path(words), path(words)[1:]):
            p = (grid[a][b] + brownlm.BETA * (into[b] + 1) / (sum(into) + C)) / (out[a] + brownlm.BETA)
            x += math.log10(p * ((ends if w is None else count[w]) + brownlm.DELTA) / (into[b] + brownlm.DELTA * (types[b] + 1)))
        scores.append(x)
    return scores


def test_lm_class_scores_against_brute_force(spark, docs, rows, monkeypatch):
    # Several blocks, few units of one word each, words on many rows of a shuffle.
    monkeypatch.setattr(brownlm, "BLOCK_BYTES", 20_000)
    docs2 = docs.withColumn("held_out", langid.remainder(7) == 2)
    first = brownlm.fit(docs2, ~F.col("held_out"))
    got = Counter((r["doc_id"], r["text"], round(r["score"], 5)) for r in brownlm.score(docs2, ~F.col("held_out"), ["doc_id", "text"]).collect())
    want = Counter((r[0], r[1], round(x, 5)) for r, x in zip(rows, brute_class_scores(rows, first)))
    assert {k[:2] for k in got} == {k[:2] for k in want}
    a, b = sorted(got.elements(), key=str), sorted(want.elements(), key=str)
    assert all(x[:2] == y[:2] and x[2] == pytest.approx(y[2], rel=1e-6, abs=1e-4) for x, y in zip(a, b))


def test_most_frequent_words_do_not_depend_on_blocks(spark, docs, monkeypatch):
    monkeypatch.setattr(brownlm, "TOP_WORDS", 30)
    found = []
    for size in (3_000, 12 << 20):
        monkeypatch.setattr(brownlm, "BLOCK_BYTES", size)
        words = brownlm.frequent_words(docs, F.lit(True))
        counts = Counter(w for r in docs.collect() for w in brownlm.tokens((r["text"] or "").encode()))
        found.append(sorted(words, key=lambda w: (-counts[w], w))[:30])
        assert found[-1] == sorted(counts, key=lambda w: (-counts[w], w))[:30]


def test_counts_over_255_are_several_pairs():
    off, near = brownlm.neighbours([np.array([1, 2] * 300, np.int32)], np.array([5, 6, 7], np.int32), 1, 9)
    pairs = near.reshape(-1, 2)
    sums = Counter()
    for slot in (0, 1):
        for code, n in pairs[off[slot] // 2 : off[slot + 1] // 2]:
            sums[slot + 1, int(code)] += int(n)
    assert sums == {(1, 7): 300, (1, brownlm.CLASSES + 7): 299, (1, brownlm.CLASSES + 9): 1, (2, 6): 299, (2, 9): 1, (2, brownlm.CLASSES + 6): 300}


def test_lm_without_rows_and_without_training(none, docs):
    assert brownlm.score(none, F.lit(True), ["doc_id"]).count() == 0
    got = brownlm.score(docs, F.lit(False), ["doc_id"]).collect()
    assert all(r["n_known"] == 0 and r["train_tokens"] == 0 and r["base_score"] == 0 and math.isfinite(r["score"]) for r in got)


def test_rare_words_of_one_suffix_get_their_own_classes(spark):
    # Both kinds of rare words end alike and stand where a frequent word of their kind stands.
    common = " ".join(f"f{i} f{i} f{i} f{i}" for i in range(900))
    kinds = [("aa", "bb", "x"), ("cc", "dd", "y")]
    rows = [(i, common, False) for i in range(3)]
    rows += [(10 + i, " ".join(f"{a} {x} {b} {a} {x} {b} {a} {x}{k}zz {b}" for k in range(300) for a, b, x in [kinds[i % 2]]), False) for i in range(4)]
    asked = [(a, b, x) for a, b, _ in kinds for x in "xy"]
    rows += [(100 + i, f"{a} {x}7zz {b}", True) for i, (a, b, x) in enumerate(asked)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, held_out boolean")
    got = {r["doc_id"]: r["score"] for r in brownlm.score(docs, ~F.col("held_out"), ["doc_id", "held_out"]).collect()}
    assert got[100] > got[101] + 0.5 and got[103] > got[102] + 0.5


def test_exchange_separates_two_languages_and_does_not_lower_the_likelihood():
    rng = np.random.default_rng(0)
    pairs = np.zeros((41, 41))
    pairs[:20, :20] = rng.integers(5, 20, (20, 20))
    pairs[20:40, 20:40] = rng.integers(5, 20, (20, 20))
    cls = brownlm.exchange(pairs, classes=3)
    assert len(set(cls[:20])) == 1 and len(set(cls[20:40])) == 1 and cls[0] != cls[20] and cls[-1] == 2


@pytest.fixture(scope="session")
def tokenizer():
    tokenizers = pytest.importorskip("tokenizers")
    path = bpe.default_path()
    return tokenizers.Tokenizer.from_file(path), bpe.Tokenizer(path)


def test_bpe_equals_the_library(tokenizer, rows):
    ref, own = tokenizer
    texts = [r[1] or "" for r in rows] + ["a" * 5000, "ab" * 900 + "!" * 700, "<|endoftext|>", "x<|endoftext|><|endoftext|> y'll", "\n\n  \t x", " ٣٤ 日本 é́​\x85", "﻿z"]
    for t, (n, ids, back) in zip(texts, own.encode_batch(texts), strict=True):
        want = ref.encode(t, add_special_tokens=False).ids
        assert ids == ",".join(map(str, want)) and n == len(want)
        assert back == ref.decode(want, skip_special_tokens=False) == own.decode(want)


def test_bpe_of_long_pieces_is_the_matrix_of_ranks(tokenizer):
    _, own = tokenizer
    assert own.rising
    rng = random.Random(8)
    pieces = [bytes(rng.choice(b"abcdeth ") for _ in range(n)) for n in (65, 80, 200, 700) for _ in range(5)] + [b"a" * 300, b"the" * 90]
    assert [own._merge_long(p) for p in pieces] == [own._merge_matrix(own.byte_ids[np.frombuffer(p, np.uint8)][None, :])[0] for p in pieces]


def test_bpe_tables(docs, clash, none, rows, tokenizer):
    path = bpe.default_path()
    got = {(r["doc_id"], r["text"]): r for r in bpe.encode(clash, path).collect()}
    for r in rows:
        assert got[(r[0], r[1])]["decoded"] == (r[1] or "")
    few = bpe.digests(docs, path, ["doc_id", "text"]).collect()
    assert len(few) == len(rows)
    empty = hashlib.sha256(b"").hexdigest()
    assert all((r["n_tokens"], r["ids_sha256"]) == (0, empty) for r in few if not r["text"])
    assert bpe.digests(none, path, ["doc_id"]).count() == bpe.encode(none, path).count() == 0
