"""Alignment of two tokenizers against a brute force that encodes whole texts with both libraries."""

import hashlib
import random
from collections import Counter

import pytest
from nearspan.llm import align
from nearspan.llm.bpe import byte_symbols, default_path

SCHEMA = "doc_id long, text string"


def brute(rows):
    """Rows of the contract, pair by pair."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_lib = Tokenizer.from_file(default_path())
    a_lib.encode_special_tokens = True
    b_lib = sentencepiece.SentencePieceProcessor(model_file=align.default_pieces())
    back = {s: i for i, s in enumerate(byte_symbols())}
    docs = []
    for doc_id, text in rows:
        none = (doc_id, [], [], [], [])
        if not text:
            docs.append(none)
            continue
        e = a_lib.encode(" " + text, add_special_tokens=False)
        a = [(i, bytes(back[c] for c in a_lib.id_to_token(i))) for i in e.ids]
        b = []
        for i in b_lib.encode(text):
            p = b_lib.id_to_piece(i)
            b.append((i, bytes([int(p[3:-1], 16)]) if p.startswith("<0x") and len(p) == 6 else p.replace("▁", " ").encode()))
        raw = (" " + text).encode()
        if b"".join(t for _, t in a) != raw or b"".join(t for _, t in b) != raw:
            docs.append(none)
            continue
        spans = []
        for side in (a, b):
            at, own = 0, []
            for i, t in side:
                own.append((i, at, at + len(t)))
                at += len(t)
            spans.append(own)
        cuts = sorted({x[2] for x in spans[0]} & {x[2] for x in spans[1]})
        number = {cut: n for n, cut in enumerate(cuts)}
        groups = [([], []) for _ in cuts]
        for side, own in enumerate(spans):
            n = 0
            for i, _, t in own:
                groups[n][side].append(i)
                n += t in number
        links, k = [], 0
        for i, s, t in spans[0]:
            while spans[1][k][2] <= s:
                k += 1
            j = k
            while j < len(spans[1]) and spans[1][j][1] < t:
                links.append((i, spans[1][j][0]))
                j += 1
        docs.append((doc_id, a, b, groups, links))
    count = Counter(p for d in docs for p in set(d[4]))
    most = {}
    for (i, _), n in count.items():
        most[i] = max(n, most.get(i, 0))
    text = lambda groups: ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
    return sorted(
        [(d[0], len(d[1]), len(d[2]), len(d[3]), len(d[4]), sum(count[p] == most[p[0]] for p in d[4]), sum(count[p] for p in d[4]), hashlib.sha256(text(d[3]).encode()).hexdigest() if d[3] else "") for d in docs],
        key=str,
    )


def run(docs, **sizes):
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return sorted([tuple(r) for r in align.alignment(docs, default_path(), align.default_pieces(), **sizes).select(*columns).collect()], key=str)


@pytest.mark.parametrize("block", [16 << 20, 3000])
def test_rows_equal_brute_force(spark, docs, rows, block):
    assert run(docs, block_bytes=block) == brute([r[:2] for r in rows])


def test_odd_texts(spark):
    texts = ["", " ", "  ", "a", " a b", "a b ", "a  b", "\n\nx\n y", "▁ x", "a▁b c", "x y", "<s> </s> <unk> <0x41> <|endoftext|>", "é日本語 ½ ﬁ 👩‍👩‍👧", "a\x00b c", "　 x", "q" * 3000 + " z", "1 22 333 4444 55555", "don't we'll 'tis x's", None, "a b", "a b", "\ttab\tx  \r\n end", "x \x1c y \x85 z"]
    rng = random.Random(2)
    alphabet = "abé'-.,1 日\n\t▁<>x   "
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 50))) for _ in range(200)]
    rows = list(enumerate(texts))
    assert run(spark.createDataFrame(rows, SCHEMA).repartition(2)) == brute(rows)


def test_a_table_of_the_test_data(spark):
    source = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    assert run(source) == brute([tuple(r) for r in source.collect()])


def test_parts_of_a_text_are_kept_whole():
    assert align.SPACE.split("  a b  c\nd e ") == ["  a", "b  c\nd", "e "]


def test_links_of_long_parts_are_as_many_as_stretches(spark):
    """Tokens that rarely end together: links grow with the tokens, not with their product."""
    n = 2000
    tokens = spark.createDataFrame([(1, True, [(5, 3)] * n, [(6, 5)] * (3 * n // 5))], "word long, same boolean, a array<struct<id:int,size:int>>, b array<struct<id:int,size:int>>")
    assert align.links(tokens).count() == n + 3 * n // 5 - n // 5


def test_empty_table_and_clashing_names(none, clash, docs):
    assert run(none) == []
    assert run(clash) == run(docs)


def test_parts_are_cut_at_signs_and_lines():
    assert align.pair(default_path(), align.default_pieces()).signs()
    assert align.pieces("der.\nEnkel,\n\nx", True) == [" der", ".\n", "Enkel", ",\n\nx"]
    assert align.pieces("don't.\nEnkel", False) == [" don't.\nEnkel"]


def test_a_word_is_aligned_once_whatever_sign_follows(spark):
    rows = [(i, "word" + sign + "\nline word") for i, sign in enumerate([".", ",", "%%", "?!", ""])]
    blocks = align.pack(spark.createDataFrame(rows, SCHEMA).coalesce(1), signs=True)
    parts = blocks.collect()[0]["parts"]
    assert sorted(parts) == sorted([" word", "line", ".\n", ",\n", "%%\n", "?!\n", "\n"])
    tokens = align.tokenise(spark.createDataFrame([(p,) for p in parts], "part string"), default_path(), align.default_pieces())
    made = align.align(tokens).collect()
    assert sorted(r["part"] for r in made) == sorted(parts) and all(r["same"] for r in made)
    assert made[0].asDict().keys() == {"word", "part", "same", "links"}


def test_signs_between_letters_of_many_kinds(spark):
    rng = random.Random(5)
    alphabet = "aBéßøж²½1'.,;_`«\n\n  "
    rows = [(i, "".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 60)))) for i in range(400)]
    assert run(spark.createDataFrame(rows, SCHEMA).repartition(2)) == brute(rows)
