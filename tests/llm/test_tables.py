"""Media columns, line dedup, sharding, HTML text."""

import hashlib
import tarfile
import zlib
from collections import Counter, defaultdict

import duckdb
import pandas as pd
import pytest

from nearspan.llm import htmltext, linededup, media, sharding
from nearspan.llm.common import shared_dir
from pyspark.sql import functions as F


def oracle(sql, rows):
    db = duckdb.connect()
    frame = pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source", "n_chars"]).astype({"doc_id": "Int64", "n_chars": "Int64"})
    db.register("documents", frame)
    return db.sql(sql).df()


def test_media_round_trip(spark, docs, clash, none, rows):
    folder = f"{shared_dir(spark)}/media-test"
    index = media.store(clash, folder, ["doc_id", "text", "shard"][:2])
    got = media.load(media.headers(index, folder), folder).collect()
    assert len(got) == len(rows)
    for r in got:
        payload = media.pad((r["text"] or "").encode())
        assert len(payload) == r["payload_bytes"] and len(payload) % 64 == 0 and len(payload) > 0
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-64:])
        assert r["n_bytes"] == len((r["text"] or "").encode()) and r["feature"] == media.feature(payload)
        assert (r["width"], r["height"]) == (64, len(payload) // 64)
    assert len({(r["text"] or "", r["media_sha256"], r["feature"]) for r in got}) == len({r["text"] or "" for r in got})
    assert {tuple(r) for r in media.headers(index, folder).select("width", "depth").collect()} == {(64, 8)}
    places = {(r["digest"], r["shard"], r["offset"]) for r in got}
    assert len(places) == len({d for d, _, _ in places}) == len({media.pad((r["text"] or "").encode()) for r in got})
    one = got[0]
    with tarfile.open(one["shard"]) as tar:
        member = tar.getmember(f"{one['digest']}.png")
        assert (member.offset_data, member.size) == (one["offset"], one["length"])
    assert media.load(media.store(none, folder, ["doc_id"]), folder).count() == 0


def test_damaged_payloads_are_seen():
    png = media.to_png(media.pad(b"some text"))
    assert media.from_png(png) == media.pad(b"some text")
    with pytest.raises(ValueError):
        media.read_header(b"x" * 33)


def brute_lines(rows):
    """Line dedup by the words of its contract."""
    holders = defaultdict(set)
    key = lambda line: line.strip(" \t\n\v\f\r").encode().lower().decode()
    for i, text, *_ in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 40 and i is not None:
                holders[key(line)].add(i)
    out = []
    for i, text, *_ in rows:
        lines = (text or "").split("\n")
        stay = [x for x in lines if i is None or len(holders.get(key(x), ())) < 5 or len(key(x)) < 40 or max(holders[key(x)]) == i]
        out.append((i, len(lines), len(lines) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest()))
    return Counter(out)


def test_line_dedup_against_brute_force_and_sql(docs, clash, none, rows):
    want = brute_lines(rows)
    assert sum(x[2] for x in want) > 5
    for df in (docs, clash):
        cut = linededup.drop_repeats(df)
        got = cut.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("h")).collect()
        assert Counter(tuple(r) for r in got) == want
    sql = oracle(linededup.ORACLE, rows)
    assert Counter((None if pd.isna(r[0]) else int(r[0]), *r[1:]) for r in sql[["doc_id", "n_lines", "n_dropped", "kept_sha256"]].itertuples(index=False)) == want
    assert linededup.drop_repeats(none).count() == 0


def test_line_dedup_of_rows_with_one_id(spark):
    line = "A line that is found in quite a few documents, again and again."
    rows = [(i, f"own {i}\n{line}") for i in range(8)] + [(2, None), (2, line), (7, None)]
    got = linededup.drop_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = [(i, line if False else (f"own {i}" if i < 7 else f"own 7\n{line}"), 2, int(i < 7)) for i in range(8)] + [(2, None, 1, 0), (2, "", 1, 1), (7, None, 1, 0)]
    assert Counter(tuple(r) for r in got) == Counter(want)


def test_full_filter_suspects_all_and_changes_nothing(docs, rows, monkeypatch):
    monkeypatch.setattr(linededup, "LEAST_BITS", 1 << 6)
    monkeypatch.setattr(linededup, "MOST_BITS", 1 << 6)
    got = linededup.drop_repeats(docs).select("n_dropped").collect()
    assert sum(r["n_dropped"] for r in got) == sum(x[2] * n for x, n in brute_lines(rows).items())


@pytest.mark.parametrize("n", [1, 2, 3, 24, 25, 99, 1000, 4097])
def test_permutation_walks_stay_within_the_computed_length(spark, n):
    frame = sharding.with_permutation(spark.range(n).withColumnRenamed("id", "row_number"), "row_number", n, "p")
    assert sorted(r["p"] for r in frame.select("p").collect()) == list(range(n))


def test_sharding_law_and_sql(docs, clash, none, rows):
    got = sharding.shard(clash).toPandas()
    assert len(got) == len(rows)
    sizes = Counter(got["shard"])
    assert max(sizes.values()) - min(sizes.values()) <= 1 and len(sizes) == 24
    for _, part in got.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))
    for r in got.itertuples():
        assert sharding.locate(r.row_number, len(rows)) == (r.shard, r.slot)
    want = oracle(sharding.ORACLE, rows)
    columns = ["size", "text_crc32", "shard", "slot", "row_number", "position"]
    assert Counter(map(tuple, got[columns].astype(int).values.tolist())) == Counter(map(tuple, want[columns].astype(int).values.tolist()))
    assert sharding.shard(none).count() == 0


def test_numbers_do_not_depend_on_partitions(docs):
    a = {(r["doc_id"], r["size"], r["row_number"]) for r in sharding.shard(docs.repartition(7)).collect()}
    b = {(r["doc_id"], r["size"], r["row_number"]) for r in sharding.shard(docs.coalesce(1)).collect()}
    assert a == b


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a="</p>";</script></head><body><header><h1>Site</h1></header>
<nav><ul><li><a href="/a">Home</a></li></ul></nav><!-- ad --><div class="ad-box">Buy now, cheap.</div>{body}
<form><p>Subscribe here, please.</p></form><aside>Related, and more.</aside><footer>&copy; 2020</footer></body></html>"""
ARTICLE = '<h1>A title</h1><p>First <b>bold</b> words, &amp; more &#233;&eacute;.<br>Next line follows here.<p>Second  paragraph\n with words, too.</p><h2>Part</h2><ul><li>one<li>two</ul><blockquote><p>Quoted.</p></blockquote><p>Ok.</p>'
TEXT = "A title First bold words, & more éé. Next line follows here. Second paragraph with words, too. Part one two Quoted. Ok."


@pytest.mark.parametrize(
    "body",
    [
        f"<article>{ARTICLE}</article>",
        f'<main><div class="share-bar">Share this</div>{ARTICLE}</main>',
        f'<div id="content">{ARTICLE}<div class="comments"><p>I think, so long. Really a long reader comment, with words.</p></div></div>',
        f'<div class="wrap"><div class="col">{ARTICLE}</div><div class="sidebar"><p>Other news, of today.</p></div></div><div class="cookie-notice">We use cookies, ok?</div>',
        f"<article>{ARTICLE}",
    ],
)
def test_main_text(body):
    assert htmltext.extract(PAGE.format(body=body) if "</article>" in body or "article" not in body else f"<html><body><nav>x</nav>{body}") == TEXT


LONG, REST = "First it rained, then it was dry; so it went on, day after day, all year. " * 6, "A second part, no less the text of it, says more, and ends, at last, well. " * 5


@pytest.mark.parametrize(
    ("body", "parts"),
    [
        (f"<article class=post><header><h1 class=entry-title>A title</h1></header><div class=entry-content><p>{LONG}</p></div></article>", ("A title", LONG)),
        (f"<article><p>{REST}</p><div class=post-body><p>{LONG}</p></div></article>", (REST, LONG)),
        (f"<article><p class=text>{LONG}</p><p class=text>{REST}</p></article>", (LONG, REST)),
        (f"<section class=content><p>{LONG}</p></section><section class=content><p>{REST}</p></section>", (LONG, REST)),
        (f"<div><div><p>{LONG * 12}</p><p>{LONG}</p></div><section><p>{REST}</p></section></div>", (LONG * 12, LONG, REST)),
    ],
)
def test_no_content_outside_of_the_container_is_lost(body, parts):
    page = f"<html><body><nav>Home News About</nav>{body}<footer>All rights reserved</footer></body></html>"
    assert htmltext.extract(page) == " ".join(" ".join(parts).split())


WHOLE = " ".join(f"{LONG} {REST}".split())


@pytest.mark.parametrize(
    "body",
    [
        f"<form action=/x><article><p>{LONG}</p><p>{REST}</p></article><input name=q></form>",
        f"<div class=post><p>{LONG}</p></div><div class=share>Share this.</div><div class=post><p>{REST}</p></div>",
        f"<article><p>{LONG}</p></article><article><p>{REST}</p></article>",
        f"<article><p>{LONG}</p><iframe src=x><p>{REST}</p></article>",
        f"<article><p>{LONG}</p><div class=legal-analysis><p>{REST}</p></div></article>",
        f"<div class=search-history-essay><p>{LONG}</p><p>{REST}</p></div>",
        f"<article><p>{LONG.replace('it was dry', '<math>it</math> <label>was</label> <button>dry</button>')}</p><p>{REST}</p></article>",
        f"<article><p>{LONG}</p><p>{REST}</p></article><div id=comments><div class=comment><p>{LONG * 3}</p></div><div class=comment><p>{REST * 3}</p></div></div>",
        f"<p>{LONG}</p><p>{REST}</p>",
    ],
)
def test_html_keeps_the_whole_article(body):
    page = f"<html><head><title>t</title></head><body><nav><a href=/>Home</a></nav><div class=ad>Buy two, get one.</div>{body}<footer>Made by us, at home.</footer></body></html>"
    assert htmltext.extract(page) == WHOLE


def test_ratios_choose_the_content(monkeypatch):
    page = f"<body><div><a href=/a>One</a> <a href=/b>two</a></div><div>Read more.</div><div><p>{LONG}</p><p>{REST}</p></div><div>All rights.</div></body>"
    assert htmltext.extract(page) == WHOLE  # no name tells the parts of this page apart
    monkeypatch.setattr(htmltext, "THRESHOLD", 0.0)
    assert htmltext.extract(page) == f"One two Read more. {WHOLE} All rights."
    monkeypatch.setattr(htmltext, "THRESHOLD", float("inf"))
    assert htmltext.extract(page) == ""


def test_ratios_against_all_pairs_of_paths():
    parts = ["<div><p>a b, c.</p><ul><li>d</li><li>e, f! g</li></ul></div>", "<p>h i j k.</p>", "<div><div><p>l, m, n</p></div><h2>o</h2></div>", "<table><tr><td>q</td></tr></table>", "tail"]
    read = htmltext.blocks("<body>" + "".join(parts * 2) + "</body>")
    for b in read.blocks:
        b.text = htmltext.clean(b.pieces)
    up = lambda v: read.above[v]

    def steps(u, v):
        if u == v:
            return 0
        if u and v and up(u) == up(v):
            return 1
        parent = u and up(u) == v or v and up(v) == u
        cousins = u and v and up(u) and up(v) and up(up(u)) == up(up(v))
        return 2 if parent or cousins else 3

    sums = {}
    for b in read.blocks:
        s = sums.setdefault(b.element.path, [0, 0, 0])
        s[0] += len(b.text)
        s[1] += sum(b.text.count(c) for c in ".,!")
        s[2] += 1
    weight = {0: 1.0, 1: htmltext.NEAR, 2: htmltext.FAR}
    for v, got in htmltext.ratios(read).items():
        w = {u: weight.get(steps(u, v), 0.0) for u in sums}
        length, marks = (sum(w[u] * sums[u][i] / sums[u][2] for u in sums) / sum(w.values()) for i in (0, 1))
        assert got == pytest.approx((length * (1 + marks)) ** 0.5)


def test_deep_and_unclosed_markup_takes_linear_time():
    import time

    for piece in ("<div><p>x y. ", "<iframe>a<textarea>b<li>", "<ul><dt>q<td>", "</b><a href=x>"):
        htmltext.extract(piece * 100)
        start = time.process_time()
        htmltext.extract(piece * 20_000)
        assert time.process_time() - start < 10


def test_html_tables(spark):
    pages = spark.createDataFrame([(1, "u", PAGE.format(body=f"<article>{ARTICLE}</article>")), (2, None, None), (3, "u", ""), (4, "u", "plain &lt;text"), (4, "u", "plain &lt;text"), (5, "u", "<p>" * 3000 + "deep, text."), (6, "u", "<nav><p>Only, menus.</p></nav>")], "page_id long, url string, html string")
    got = htmltext.main_text(pages.select("*", F.lit(1).alias("TEXT"), F.lit(2).alias("n_chars"))).collect()
    assert [(r["page_id"], r["text"]) for r in sorted(got, key=lambda r: r["page_id"])] == [(1, TEXT), (2, ""), (3, ""), (4, "plain <text"), (4, "plain <text"), (5, "deep, text."), (6, "")]
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert htmltext.main_text(pages.limit(0)).count() == 0
