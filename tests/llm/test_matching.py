"""Near-dedup, decontamination, personal data, the pipeline."""

import random
import re
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from nearspan.llm import bpe, decontam, linededup, neardup, pii
from pyspark.sql import functions as F


def bag(text):
    w = (text or "").encode().lower().split()
    return Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else Counter()


def brute_jp(p, q):
    every = set(p) | set(q)
    return sum(1 / sum(max(p[j] / p[i], q[j] / q[i]) for j in every) for i in p if i in q)


def shingled(text):
    raw = text.encode()
    doc, ids, weight = neardup.shingles(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    return ids, weight


def test_exact_similarity(rows):
    texts = [r[1] for r in rows if r[1] and len(r[1]) < 3000] + ["a b", "a b c d e a b c d e a b c d e", "a b c d e a b c d e"]
    rng = random.Random(1)
    for _ in range(40):
        a, b = rng.choice(texts), rng.choice(texts)
        assert neardup.similarity(shingled(a), shingled(b)) == pytest.approx(brute_jp(bag(a), bag(b)), abs=1e-9)
    for t in texts:
        assert sorted(shingled(t)[1]) == sorted(bag(t).values())


def test_signatures_estimate_jp():
    rng = random.Random(2)
    words = [f"w{i}" for i in range(400)]
    a = " ".join(rng.choice(words) for _ in range(600))
    b = " ".join(w if rng.random() > 0.03 else "x" for w in a.split())
    texts = [a.encode(), b.encode()]
    off = np.array([0, len(texts[0]), len(texts[0]) + len(texts[1])])
    doc, ids, weight = neardup.shingles(np.frombuffer(b"".join(texts), np.uint8), off)
    s = neardup.probminhash(doc, ids, weight, 2, 4096)
    assert (s[0] == s[1]).mean() == pytest.approx(brute_jp(bag(a), bag(b)), abs=0.04)


def brute_classes(rows, threshold=0.8):
    """Least doc_id of each class of linked rows."""
    texts = sorted({r[1] for r in rows if r[1] is not None})
    bags = [bag(t) for t in texts]
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if bags[i] and bags[j] and set(bags[i]) & set(bags[j]) and brute_jp(bags[i], bags[j]) >= threshold:
                parent[root(i)] = root(j)
    least = {}
    for i, t, *_ in rows:
        if t is not None and i is not None:
            c = root(texts.index(t))
            least[c] = min(least.get(c, i), i)
    return Counter((i, i if t is None else least.get(root(texts.index(t)))) for i, t, *_ in rows)


def test_classes_against_brute_force(spark, clash, none, rows):
    some = [r for r in rows if r[1] is None or len(r[1]) < 5000]
    got = neardup.classes(clash.filter("length(text) < 5000 or text is null")).collect()
    assert Counter((r["doc_id"], r["class_id"]) for r in got) == brute_classes(some)
    assert neardup.classes(none).count() == 0


def test_many_near_copies_are_one_class(spark):
    rng = random.Random(4)
    base = [f"word{rng.randrange(3000)}" for _ in range(300)]
    rows = []
    for i in range(120):
        w = list(base)
        for _ in range(3):
            w[rng.randrange(len(w))] = f"other{i}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, " ".join(base[:40] + [f"u{i}x{k}" for k in range(80)])) for i in range(60)]
    got = {r["doc_id"]: r["class_id"] for r in neardup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {got[i] for i in range(120)} == {0}
    assert all(got[1000 + i] == 1000 + i for i in range(60))


def test_near_copies_inside_large_mixed_buckets(spark):
    # Two interleaved families: every two texts of a family have a J_P just under the threshold
    # and stand in the same large buckets, and each text has one partner just above it.
    rng, rows = random.Random(7), []
    draw = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    passages = [draw(404) for _ in range(2)]
    for k in range(240):
        shared = draw(14)
        rows += [(2 * k + i, " ".join(passages[k % 2] + shared + draw(42))) for i in range(2)]
    assert brute_jp(bag(rows[0][1]), bag(rows[1][1])) >= 0.8 > brute_jp(bag(rows[0][1]), bag(rows[4][1])) > 0.75
    rng.shuffle(rows)
    got = {r["doc_id"]: r["class_id"] for r in neardup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i - i % 2 for i in range(480)}


def test_tiles_of_several_parts_give_all_pairs(spark, monkeypatch):
    # Parts of a few texts each: every pair across classes meets in one tile.
    monkeypatch.setattr(neardup, "TILE_BYTES", 5 * neardup.LEAST_BYTES)
    name = lambda i: bytes([i])
    text = lambda i: " ".join(f"s{k}" for k in range(100)) + (" again" if i % 2 else "") + f" t{i}"
    large = spark.createDataFrame([(9, 40, name(0), 0, name(i), name(0 if i < 20 else i)) for i in range(40)], "bucket long, n long, main binary, band int, node binary, label binary")
    nodes = spark.createDataFrame([(name(i), [9, i]) for i in range(40)], "node binary, bands array<long>")
    texts = spark.createDataFrame([(name(i), text(i)) for i in range(40)], "node binary, text string")
    got = [frozenset((r["a"][0], r["b"][0])) for r in neardup.tile_links(neardup.tiles(large, nodes, texts), 0.8).collect()]
    want = {frozenset((i, j)) for i in range(40) for j in range(max(i + 1, 20), 40)}
    assert set(got) == want and len(got) == len(want)


def test_components_of_a_long_path(spark):
    path = [(f"{i:04d}".encode(), f"{i + 1:04d}".encode()) for i in range(60)] + [(b"x", b"y")]
    got = dict(neardup.components(spark.createDataFrame(path, "a binary, b binary")).collect())
    assert {bytes(v) for k, v in got.items() if bytes(k)[:1] == b"0"} == {b"0000"} and len(got) == 63


ITEMS = [(0, "What is the capital of the large country that lies north of the sea, and how many people live there today?"), (1, "Name three rivers."), (2, None), (3, ""), (4, "Seven students share twelve apples and five pears; each of them gets as many as the others. " * 2)]


def edited(text, n, rng):
    x = list(text)
    for _ in range(n):
        k = rng.randrange(len(x))
        x[k] = rng.choice(["", x[k] + "q", "z"])
    return "".join(x)


def test_leaks_are_found_and_clean_texts_are_not(spark, rows):
    rng = random.Random(5)
    docs = [(r[0], r[1]) for r in rows]
    docs += [(500 + k, f"Some words before it. {edited(ITEMS[i][1].upper(), e, rng)} and after.") for k, (i, e) in enumerate([(0, 0), (0, 4), (4, 0), (4, 5), (1, 0)])]
    docs += [(600, ITEMS[0][1][: len(ITEMS[0][1]) // 3]), (601, "capital country people"), (602, ITEMS[4][1][:130])]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.leaks(table, items).collect()}
    assert got == {(500, 0), (501, 0), (502, 4), (503, 4), (504, 1), (602, 4)}
    flagged = decontam.flag(table.withColumn("LEAK", F.lit(7)), items).filter("leak").collect()
    assert {r["doc_id"] for r in flagged} == {i for i, _ in got}
    assert decontam.leaks(table.limit(0), items).count() == 0 and decontam.leaks(table, items.limit(0)).count() == 0


def semi_global(pattern, text):
    """Least edits of pattern against any part of text, by the whole matrix."""
    row = np.zeros(len(text) + 1, int)
    t = np.frombuffer(text, np.uint8)
    for i, c in enumerate(pattern, 1):
        new = np.empty_like(row)
        new[0] = i
        new[1:] = np.minimum(row[:-1] + (t != c), row[1:] + 1)
        steps = np.arange(len(row))
        row = np.minimum.accumulate(new - steps) + steps
    return int(row.min())


def test_leaks_against_brute_force_alignment(spark):
    rng = random.Random(12)
    words = ["river", "stone", "the", "of", "and", "seven", "market", "paper", "blue", "how", "many", "is", "a", "12", "train"]
    stem = " ".join(rng.choice(words) for _ in range(8))
    items = [(i, (stem + " " if i % 2 else "") + " ".join(rng.choice(words) for _ in range(rng.choice([2, 3, 4, 9, 20, 40])))) for i in range(60)] + [(60, "yes"), (61, "0 1")]
    docs = []
    for k in range(100):
        i, text = rng.choice(items)
        part = edited(text, rng.randrange(0, max(2, len(text) // 9)), rng)
        docs.append((k, " ".join(rng.choice(words) for _ in range(rng.randrange(30))) + f"\n{part}\n" + " ".join(rng.choice(words) for _ in range(rng.randrange(30)))))
    got = {(r["doc_id"], r["item_id"]) for r in decontam.leaks(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = set()
    for k, text in docs:
        region = decontam.fold_text(text)
        for i, item in items:
            s = decontam.fold_text(item)
            if len(s) <= decontam.Q:
                if s in {decontam.fold_text(x) for x in text.split("\n")}:
                    want.add((k, i))
                continue
            last = max(len(s) - decontam.SEGMENT, 0)
            for a in sorted({*range(0, last + 1, decontam.SEGMENT // 2), last}):
                piece = s[a : a + decontam.SEGMENT]
                if semi_global(piece, region) <= min(int(len(piece) * decontam.EDIT_SHARE), (len(piece) - decontam.Q) // decontam.Q):
                    want.add((k, i))
    assert got == want and len(want) > 90


def test_a_stem_that_many_items_share_costs_little():
    import time

    stem = "Read the following passage with care and then answer the question below in one short sentence: "
    rng = random.Random(13)
    seg = decontam.segments([(i, stem + " ".join(f"w{rng.randrange(10**6)}" for _ in range(30))) for i in range(2000)])
    raw = (f"{stem}some other thing entirely. " * 20).encode()
    start = time.process_time()
    got = decontam.find(*decontam.fold(np.frombuffer(raw, np.uint8), np.array([0, len(raw)])), seg)
    assert len(got) == 2000 and time.process_time() - start < 3


def test_items_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 50)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = spark.createDataFrame([(1, ITEMS[0][1]), (2, ITEMS[4][1]), (3, "clean")], "doc_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontam.leaks(docs, items).collect()} == {(1, 0), (2, 4)}
    assert {r["doc_id"] for r in decontam.flag(docs, items).filter("leak").collect()} == {1, 2}


def test_banded_alignment():
    assert decontam.aligned(b"abcdefghij", b"xxabcdefghijxx", 2, 1) == (0, 12)
    assert decontam.aligned(b"abcdefghij", b"xxabcdfghijxx", 2, 1)[0] == 1
    assert decontam.aligned(b"abcdefghij", b"xxabXXXfghijxx", 2, 2) is None
    assert decontam.aligned(b"abcdefghij", b"abcdefghi", 0, 1)[0] == 1


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")


def brute_spans(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    luhn = lambda d: sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(reversed(d))) % 10 == 0
    out = [(0, *m.span()) for m in EMAIL.finditer(text)]
    out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(2, *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    return out + [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(digits(m[0])) <= 15]


def test_base_spans_against_the_patterns():
    rng = random.Random(6)
    pieces = ["a@b.co", "x@y", "@", "a.b+c@d-e.f.gh", "1.2.3.4", "300.1.1.1", "1.2.3.4.5.6.7.8", "4111111111111111", "4111 1111-1111 1111", "+1 (555) 123-4567", "+12", " ", "\n", "é", "_", "9" * 17, "+", "-", ".", "日本", "0001.0.0.00000"]
    for _ in range(3000):
        t = "".join(rng.choice(pieces) for _ in range(rng.randint(1, 9)))
        assert pii.base_spans(t) == brute_spans(t), t
    assert pii.base_spans("a" * 50_000 + "@" + "9" * 6000 + ".1.1.1") is not None


def test_pii_rows(spark, clash, none, rows):
    people = [(i, f"Write to me{i}@mail.org or call +1 (555) 123-45{i % 100:02d} now, from 10.0.0.{i} please. Item 3. v2.0") for i in range(200, 300)]
    table = spark.createDataFrame(people + [(r[0], r[1]) for r in rows], "doc_id long, text string")
    field = pii.fit(table)
    got = pii.find(table, field, ["doc_id", "text"]).collect()
    assert len(got) == len(people) + len(rows)
    for r in got:
        want = brute_spans(r["text"] or "")
        assert r["base"] == pii.joined(want) and [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(s[0] == k for s in want) for k in range(4)]
        assert not want or set(r["base"].split(",")) <= set(r["spans"].split(","))
        if not re.search("[0-9@]", r["text"] or ""):
            assert r["spans"] == ""
        assert r["n_found"] == sum(r[f"n_{k}"] for k in pii.KINDS) + r["n_added"] + r["n_secret"]
    assert pii.find(clash, field, ["doc_id", "spans"][:1]).count() == len(rows)
    assert pii.fit(none) is None and pii.find(none, None, ["doc_id"]).count() == 0


def test_skip_edges_carry_a_label():
    x = pii.nodes(["number 5551234567 is here, much later once more 5551234567 again, not 5559999999"])
    assert [e.tolist() for e in x.edges] == [[], [[0, 1]], [[1, 2]]]
    own = np.zeros((pii.N_FEATURES, pii.LABELS))
    field = pii.Field(own, np.zeros((pii.LABELS, pii.LABELS)), np.full(pii.LABELS, 3.0), np.full(pii.LABELS, 0.5))
    x.seen[1:] = 0
    own[0, 4] = 4.0  # only the first mention is plain
    p = field.marginals(x)
    assert p[1].argmax() == 4 and p[1, 4] > 0.7 and p[2].argmax() == 4 and p[2, 4] < p[1, 4]
    assert pii.redact("call +1 555 now", [(3, 5, 11)]) == "call <phone> now"


def exact_marginals(x, field):
    """By enumeration of all labellings of one text."""
    n = len(x.text)
    grid = np.stack(np.meshgrid(*[np.arange(pii.LABELS)] * n, indexing="ij"), -1).reshape(-1, n)
    score = sum((x.seen @ field.own)[i][grid[:, i]] for i in range(n))
    for edges, weight in zip(x.edges, (field.chain, np.diag(field.same), np.diag(field.similar))):
        for a, b in edges:
            score = score + weight[grid[:, a], grid[:, b]]
    p = np.exp(score - score.max())
    return np.stack([np.bincount(grid[:, i], p, pii.LABELS) / p.sum() for i in range(n)])


@pytest.mark.parametrize(
    ("text", "loops"),
    [
        ("card 4111111111111111 then 4111111111111112 or 10.0.0.1 and 10.0.0.2", False),
        ("+1 (555) 123-4567 and 5551234567", False),
        ("call 5551234567 5551234568 or x 5551234567 5551234568", True),
    ],
)
def test_marginals_against_enumeration(text, loops):
    rng = np.random.default_rng(3)
    field = pii.Field(rng.normal(0, 0.5, (pii.N_FEATURES, pii.LABELS)), rng.normal(0, 0.5, (pii.LABELS, pii.LABELS)), rng.uniform(0, 1.5, pii.LABELS), rng.uniform(0, 1, pii.LABELS))
    x = pii.nodes([text])
    assert sum(map(len, x.edges)) >= (len(x.text) if loops else 1) - 1
    assert np.abs(field.marginals(x) - exact_marginals(x, field)).max() < (0.06 if loops else 1e-3)


def test_marginals_do_not_depend_on_other_texts():
    rng = np.random.default_rng(4)
    field = pii.Field(rng.normal(0, 1, (pii.N_FEATURES, pii.LABELS)), rng.normal(0, 2, (pii.LABELS, pii.LABELS)), rng.uniform(0, 6, pii.LABELS), rng.uniform(0, 6, pii.LABELS))
    texts = [" ".join(str(10**9 + i % 7) for i in range(60 * k)) + f" 1.2.3.{k} a@b.c" for k in range(1, 6)]
    alone = np.concatenate([field.marginals(pii.nodes([t])) for t in texts])
    assert np.abs(field.marginals(pii.nodes(texts)) - alone).max() < 1e-9


def test_field_learns_that_mentions_agree():
    rng = random.Random(11)
    number = lambda good: next(x for x in iter(lambda: str(rng.randrange(10**15, 10**16)), "") if pii.luhn(x) == good)
    texts = [f"text {i} {'with card' if i % 4 == 1 else 'paid by'} {number(True)} and mail m{i}@x.org, then 10.1.2.{i % 250}." if i % 2 else f"order no {number(False)} of {i}, token = 'f{rng.getrandbits(152):038x}e'" for i in range(900)]
    x, y, counts = pii.examples(texts)
    field = pii.learn(x, y, counts)
    good, bad = number(True), number(False)
    asked = [f"paid by {good} and, much later, again by {bad} here", f"order {bad} came", f"first {bad} and later {bad} came", "api_key: 'f00dfeed12345678f00dfeed12345678' is new"]
    got = pii.added_spans(asked, [pii.base_spans(t) for t in asked], field)
    at = asked[0].index(bad)
    assert got == [[(2, at, at + 16)], [], [], [(pii.SECRET, 10, 42)]]
    plain = pii.Field(field.own, field.chain, 0 * field.same, 0 * field.similar)
    assert pii.added_spans(asked[:1], [pii.base_spans(asked[0])], plain) == [[]]


def test_scans_take_linear_time():
    import time

    for text in ("9" * 400_000, "1." * 200_000, "1.2.3.4." * 50_000, "+" * 200_000, "a@" * 100_000, "12 " * 100_000, "(at)" * 50_000):
        start = time.process_time()
        pii.base_spans(text)
        x = pii.nodes([text])
        assert len(x.text) >= 0 and time.process_time() - start < 15, text[:10]
    assert [s for s in pii.base_spans("1.2.3.4.5.6.7.8 300.1.2.3.4")] == [(1, 0, 7), (1, 8, 15)]


def test_pipeline_against_brute_force(spark, docs, rows, tmp_path):
    rng = random.Random(7)
    leak = [(700, f"Before it. {edited(ITEMS[0][1], 2, rng)} After it.", "en", "s", 1), (701, "A clean text of some words that nobody has seen before, about rivers and large seas.", "en", "s", 1)]
    every = [*rows, *leak]
    spark.createDataFrame(every, docs.schema).repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontamination", "bpe"]
    left = [r for r in every if r[1] is not None and any(map(str.isalpha, r[1]))]
    keys = [linededup.keys_of(r[1]) if r[0] is not None else set() for r in left]
    ids = {}
    for r, k in zip(left, keys, strict=True):
        for x in k:
            ids.setdefault(x, set()).add(r[0])
    cut = []
    for r in left:
        lines = [x for x in r[1].split("\n") if r[0] is None or (k := linededup.key_of(x)) is None or len(ids.get(k, ())) < 5 or max(ids[k]) == r[0]]
        cut.append((r[0], "\n".join(lines)))
    small = [r for r in cut if len(r[1]) < 5000]
    best = brute_classes(small)
    kept = {i for (i, c), _ in best.items() if i == c} | {r[0] for r in cut if len(r[1]) >= 5000}
    kept -= {700}
    assert {r["doc_id"] for r in got} == kept and 701 in kept
    assert len(got) == len(kept)
    texts = dict(cut)
    tok = bpe.Tokenizer(bpe.default_path())
    for r in got:
        assert tok.decode(r["ids"]) == texts[r["doc_id"]] and r["n_tokens"] == len(r["ids"])


def test_stages_keep_columns_of_any_name(spark, none, clashing, rows, tmp_path):
    """Every stage but the last gives back the columns as they were, whatever their names."""
    line = "A line that is found in quite a few documents, again and again."
    every = [(i, f"{t}\n{line}" if t and k % 3 == 0 else t, *rest) for k, (i, t, *rest) in enumerate(rows) if not t or len(t) < 5000] + [(0, None, "en", "s", 1)]
    docs = clashing(spark.createDataFrame(every, none.schema))
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    extra = [c for c in docs.columns if c not in ("doc_id", "text", "lang", "source", "n_chars")]
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, str(tmp_path))
        if name == "bpe":
            assert after.count() == docs.count()
            break
        assert after.columns == docs.columns and after.dtypes == docs.dtypes
        got = after.collect()
        assert got and all(r[c] == "x" for r in got for c in extra)
        docs = spark.createDataFrame(got, docs.schema)


def test_stages_on_an_empty_table(spark, none, tmp_path):
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, str(tmp_path)).count() == 0


def test_items_that_are_all_short(spark):
    docs = spark.createDataFrame([(1, "abcdefgh"), (2, "x\nAB-c\ny"), (3, "abcdefgh and more"), (4, None)], "doc_id long, text string")
    items = spark.createDataFrame([(7, "abcdefgh"), (8, "ab c"), (9, None), (10, "")], "item_id short, text string")
    assert sorted(tuple(r) for r in decontam.leaks(docs, items).select("doc_id", "item_id").collect()) == [(1, 7), (2, 8)]
    assert {r["doc_id"] for r in decontam.flag(docs, items).filter("leak").collect()} == {1, 2}
