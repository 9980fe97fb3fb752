import random

import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = {
    "en": "the of and to in that is was for on are with this from have been which will their more about".split(),
    "de": "der die und den von das mit sich des auf für ist nicht ein eine auch werden über schön größe".split(),
}


def sentence(rng: random.Random, lang: str, n: int) -> str:
    return " ".join(rng.choice(WORDS[lang]) + rng.choice(["", "", "s", "en", "ung"]) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Documents with every odd case: nulls, empty and long texts, copies, repeated rows."""
    rng = random.Random(3)
    notice = "This long notice is part of many documents, word for word."
    out = []
    for i in range(60):
        lang = "de" if i % 3 == 0 else "en"
        lines = [sentence(rng, lang, 30) for _ in range(3)]
        if i % 5 == 0:
            lines.insert(1, "  " + notice.upper() + "\t" if i % 10 else notice)
        out.append([i, "\n".join(lines), lang, "s", 1])
    out[7][1] = out[8][1]
    out[9][1] = " ".join(out[8][1].replace("\n", " ").split()[:-2] + ["changed", "end"])
    long = sentence(rng, "en", 60_000)
    out += [[100, None, None, None, None], [101, "", "en", "s", 0], [102, " \n\t ", "en", "s", 4], [103, "12345 !!", None, "s", 8], [104, long, "en", "s", len(long)], [105, "a\x00b é日本語 <|endoftext|> x", "en", None, 1]]
    out += [[None, "text without an id, " + sentence(rng, "en", 20), "en", "s", 1], [3, out[3][1], "de", "s", 1], [106, "", "en", "s", 0]]
    return [tuple(r) for r in out]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCUMENTS).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCUMENTS)


@pytest.fixture(scope="session")
def clashing():
    """A function that adds columns called like those that operators make."""
    from pyspark.sql import functions as F

    names = ("Score", "lang_pred", "n_lines", "n_dropped", "ids", "decoded", "leak", "node", "_node", "label", "bands", "_raw", "_text", "_gone", "_train", "_block", "shard", "slot", "size", "row_number", "position", "base", "spans", "n_email", "_language", "_score", "_leak", "digest", "_copy", "_id")
    return lambda df: df.select("*", *[F.lit("x").alias(n) for n in names])


@pytest.fixture(scope="session")
def clash(docs, clashing):
    return clashing(docs)
