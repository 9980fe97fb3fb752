"""Token files: ids against the tokenizers library, exact round trip, the offsets, odd rows."""

import random
import uuid
import zlib

import numpy as np
import pytest
from nearspan.llm import tokenfile
from nearspan.llm.bpe import default_path
from nearspan.llm.common import shared_dir
from pyspark.sql import functions as F

ODD = ["", " ", "\n\n\n", "a\x00b", "don't we'll  two   three\t\tx ", "é日本語 ½ Ⅷ ٣", "<|endoftext|> x<|endoftext|>", " 　 x \u0085y", "x" * 5000, " " * 2000 + "z", "1234567890" * 50, "👩‍👩‍👧 ok", "ﬁ‍﻿"]


def library():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(default_path())
    tok.no_truncation()
    tok.no_padding()
    return tok


def expected(rows, end=tokenfile.END_ID):
    """Rows of the contract by one loop over all documents in order."""
    tok, out, start = library(), [], 0
    made = [(r[0], [*tok.encode(r[1] or "", add_special_tokens=False).ids, end]) for r in rows]
    for doc_id, ids in sorted(made, key=lambda m: (m[0] is not None, m[0] or 0, len(m[1]))):
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def folder(spark):
    return f"{shared_dir(spark)}/ids-{uuid.uuid4().hex}"


@pytest.mark.parametrize("text", ODD)
def test_ids_are_those_of_the_library(text):
    assert tokenfile.encoder(default_path()).ids(text).tolist() == library().encode(text, add_special_tokens=False).ids


def test_ids_of_a_run_that_the_fast_engine_cannot_take():
    text = " " * 1_200_000 + "x"
    assert tokenfile.encoder(default_path()).ids(text).tolist() == library().encode(text, add_special_tokens=False).ids


def test_ids_of_random_texts():
    rng, enc, tok = random.Random(5), tokenfile.encoder(default_path()), library()
    alphabet = "ab'sdLÉ 1٣\t\n\r.,!-_¿«»“”…–日本   "
    for _ in range(300):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(60)))
        assert enc.ids(text).tolist() == tok.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("size", [1 << 30, 500])
def test_files_give_all_documents_in_order(spark, docs, rows, size):
    at = folder(spark)
    files = tokenfile.write(docs, at, default_path(), file_bytes=size)
    assert size > 500 or files.count() > 10
    got = [tuple(r) for r in tokenfile.read(files, at).collect()]
    assert sorted(got, key=lambda r: r[1]) == expected(rows)


def test_one_document_is_read_by_its_offset(spark, docs, rows):
    at = folder(spark)
    files = tokenfile.write(docs, at, default_path(), file_bytes=900)
    index = tokenfile.offsets(files, at)
    tok = library()
    wanted = spark.createDataFrame([(1,), (104,), (105,), (100,), (3,), (999,)], "doc_id long")
    got = sorted((r[0], tuple(r[1])) for r in tokenfile.fetch(index, wanted, at).collect())
    assert got == sorted((r[0], (*tok.encode(r[1] or "", add_special_tokens=False).ids, 2)) for r in rows if r[0] in (1, 104, 105, 100, 3))
    assert {(r[0], r[1], r[2]) for r in index.collect()} == {r[:3] for r in expected(rows)}


def test_a_dictionary_is_shared_and_checked(spark, docs, rows):
    from pyarrow import fs

    sample = spark.createDataFrame([(i, r[1]) for i in range(300) for r in rows[:20]], "doc_id long, text string")
    dictionary = tokenfile.train(sample, default_path())
    assert dictionary
    at = folder(spark)
    files = tokenfile.write(sample.limit(400), at, default_path())
    name = files.first()["file"]
    store, base = fs.FileSystem.from_uri(at)
    reader = tokenfile.FileReader(store, name)
    assert reader.document(3).tolist()[-1] == tokenfile.END_ID
    (path,) = [f.path for f in store.get_file_info(fs.FileSelector(base)) if f.path.endswith(".dict")]
    with store.open_output_stream(path) as out:
        out.write(b"another one")
    with pytest.raises(ValueError, match="another hash"):
        tokenfile.FileReader(store, name)


def test_a_frame_is_smaller_with_the_dictionary(rows):
    enc = tokenfile.encoder(default_path())
    parts = [tokenfile.serialise(enc.ids(r[1]), enc.width) for r in rows[:60]]
    import zstandard

    dictionary = zstandard.train_dictionary(8000, parts * 20).as_bytes()
    size = lambda d: sum(len(tokenfile._compressor(d).compress(p)) for p in parts)
    assert size(dictionary) < 0.8 * size(b"")


def test_equal_rows_of_one_doc_id_are_split_and_kept(spark):
    same = spark.range(3000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("the same text").alias("text"))
    at = folder(spark)
    got = tokenfile.read(tokenfile.write(same, at, default_path()), at).collect()
    n = got[0]["n_tokens"]
    assert sorted(r["start"] for r in got) == [i * n for i in range(3000)]


def test_empty_table_other_ids_and_clashing_names(spark, none, clash, docs):
    at = folder(spark)
    assert tokenfile.read(tokenfile.write(none, at, default_path()), at).collect() == []
    assert sorted(map(str, tokenfile.read(tokenfile.write(clash, at, default_path()), at).collect())) == sorted(map(str, tokenfile.read(tokenfile.write(docs, folder(spark), default_path()), at).collect()))
    named = docs.select(F.concat(F.lit("k"), F.col("doc_id")).alias("doc_id"), "text")
    got = tokenfile.read(tokenfile.write(named, at, default_path()), at, "string").orderBy("start").collect()
    assert [r["doc_id"] for r in got if r["doc_id"]] == sorted(r["doc_id"] for r in got if r["doc_id"])


def test_query_over_a_whole_table(spark):
    at = "/root/testdata/sf0.001"
    source = spark.read.parquet(f"{at}/documents.parquet").select("doc_id", "text").collect()
    assert sorted(map(tuple, tokenfile.op11_token_files(spark, at).collect()), key=lambda r: r[1]) == expected(source)
