"""Column functions, files and operators on hand-made inputs."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearspan import registry
from nearspan.config import Config
from nearspan.functions import strings, vectors
from nearspan.operators import anchors, cluster, dag, evaluate, generate, pivots, search
from nearspan.plans import planner
from nearspan.sources import files, reports
from nearspan.streaming.queries import search_stream


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_distances(spark):
    lit = F.lit
    assert one(spark, strings.edit_distance(lit("kitten"), lit("sitting"))) == 3
    assert one(spark, strings.bounded_distance(lit("kitten"), lit("sitting"), 2)) == -1
    assert one(spark, strings.window_distance(lit("ACG"), lit("TTACTAA"))) == 1
    assert one(spark, strings.window_distance(lit("ACGT"), lit("AG"))) == 2
    assert one(spark, vectors.euclidean(F.array(lit(0.0), lit(3.0)), F.array(lit(4.0), lit(0.0), lit(9.0)))) == 5
    assert dag.edit_distance("kitten", "sitting") == 3


def test_small_functions(spark):
    lit = F.lit
    assert one(spark, strings.parse_ints(lit("1, 2,x,,-3"))) == [1, 2, -3]
    assert one(spark, strings.parse_thresholds(lit('{"a": 1, "b": -2}'))) == {"a": 1, "b": -2}
    assert one(spark, strings.parse_doubles(lit("[1.5, 2]"))) == [1.5, 2.0]
    assert one(spark, strings.windows(lit("ACG"), 5)) == []
    assert [w["kmer"] for w in one(spark, strings.windows(lit("ACGT"), 3))] == ["ACG", "CGT"]
    assert one(spark, strings.normalise_bases(lit("acgx"))) == "ACGN"
    assert one(spark, strings.band(lit(1), 3)[0]) == 0
    fp = lambda *v: F.array(*map(F.lit, v))
    assert one(spark, strings.anchor_prunable(fp(1, 9), fp(1, 2), lit(2), 3))
    assert not one(spark, strings.anchor_prunable(fp(1, 9), fp(1), lit(0), 0))
    assert not one(spark, strings.anchor_prunable(fp(1), lit(None).cast("array<int>"), lit(0), 0))
    assert one(spark, strings.overlaps(lit(7), lit(5), 2)) and not one(spark, strings.overlaps(lit(8), lit(5), 2))


def test_fasta_and_fastq(spark, tmp_path):
    path = tmp_path / "a.fa"
    path.write_text(">one header\nACG\nTNx\n>two\r\nGG\r\n>three\n")
    got = sorted(tuple(r) for r in files.read_fasta(spark, str(path)).collect())
    assert got == [("one header", "ACGTNN"), ("three", ""), ("two", "GG")]
    files.write_fasta(spark.createDataFrame([("q", "ACGT")], "id string, seq string"), str(tmp_path / "out"))
    assert [tuple(r) for r in files.read_fasta(spark, str(tmp_path / "out")).collect()] == [("q", "ACGT")]
    fq = tmp_path / "a.fq"
    fq.write_text("".join(f"@r{i}\n{'ACGT'[i] * 6}\n+\n{'I' * 6}\n" for i in range(4)))
    reads = files.read_fastq(spark, str(fq))
    assert reads.count() == 4
    assert sorted(tuple(r) for r in files.fastq_queries(reads, 2, 4).collect()) == [(0, "TTTT"), (1, "GGGG")]
    fq.write_text("@r\nACG\n+\n")
    with pytest.raises(Exception, match="cut off"):
        files.read_fastq(spark, str(fq)).count()


def test_extract_and_index_tables(spark, tmp_path):
    coords = spark.createDataFrame([("c", 2, 4), ("c", 4, 9), ("d", 7, 2), ("x", 0, 1)], "chrom string, pos int, len int")
    chrom = spark.createDataFrame([("c", "ACGTAC")], "chrom string, seq string")
    parts = spark.createDataFrame([("d", 7, "GGG")], "chrom string, pos int, seq string")
    got = {(r["chrom"], r["pos"]): r["seq"] for r in files.extract(coords, chrom, parts).collect()}
    assert got == {("c", 2): "GTAC", ("c", 4): "AC", ("d", 7): "GG", ("x", 0): ""}
    path = files.index_path(str(tmp_path), "pivot", k=3, n=2)
    calls = []
    build = lambda: calls.append(1) or spark.range(3)
    assert files.load_or_build(spark, path, build).count() == files.load_or_build(spark, path, build).count() == 3
    assert len(calls) == 1


def brute_windows(queries, refs, k, t):
    return {(q, r, p, d) for q, s in queries for r, seq in refs for p in range(len(seq) - k + 1) if (d := dag.edit_distance(s, seq[p : p + k])) <= t}


@pytest.mark.parametrize("t", [0, 1, 2, 3, 4, 7])
def test_seed_plan_equals_brute_force(spark, t, monkeypatch):
    monkeypatch.setattr(search, "PAGE", 37)
    rng = random.Random(t)
    refs = [(i, "".join(rng.choice("ACGT") for _ in range(n))) for i, n in enumerate([0, 5, 12, 150, 300])]
    queries = []
    for i in range(6):
        a = rng.randrange(280)
        x = list(refs[4][1][a : a + 12])
        for _ in range(i % 4):
            k = rng.randrange(len(x))
            x[k : k + 1] = rng.choice(["", "A", "CG"])
        queries.append((i, "".join(x + list("ACGTACGTACGT"))[:12]))
    r, q = spark.createDataFrame(refs, "ref_id long, seq string"), spark.createDataFrame(queries, "q_id long, q string")
    want = brute_windows(queries, refs, 12, t)
    assert {tuple(x) for x in search.range_search(q, r, 12, t).select("q_id", "ref_id", "pos", "dist").collect()} == want
    assert {tuple(x) for x in search.nested_loop(q, search.kmers(r, 12), t).collect()} == want


@pytest.mark.parametrize("t", [0, 1, 2, 3, 5])
def test_edit_join_equals_brute_force(spark, t):
    rng = random.Random(9)
    strings_ = [(i, "".join(rng.choice("ab") for _ in range(rng.randint(0, 9)))) for i in range(60)]
    df = spark.createDataFrame(strings_, "id long, s string")
    want = {(i, j, d) for i, a in strings_ for j, b in strings_ if (d := dag.edit_distance(a, b)) <= t}
    assert {tuple(r) for r in search.edit_join(df, df, t).collect()} == want


def test_pages_of_wide_characters(spark, monkeypatch):
    monkeypatch.setattr(search, "PAGE", 5)
    for seq in ("ACGTACGTTTGAC", "äöACé日GTACGTTT"):
        refs = spark.createDataFrame([(0, seq)], "ref_id long, seq string")
        got = {(r["pos"], r["seq"]) for r in search.kmers(refs, 4).collect()}
        assert got == {(i, seq[i : i + 4]) for i in range(len(seq) - 3)}


def points(spark):
    rows = [(0, [0.0, 0.0]), (1, [1.0, 1.0]), (2, [2.0, 2.0]), (3, [5.0, 5.0]), (4, [10.0, 10.0])]
    return spark.createDataFrame(rows, "id long, obj array<double>"), spark.createDataFrame([(0, [1.5, 1.5])], "q_id long, q array<double>")


def test_pivot_index_on_points(spark):
    objects, query = points(spark)
    heads, members = pivots.build(objects, 2, vectors.euclidean)
    got = {r["id"]: round(r["dist"], 4) for r in pivots.range_search(query, heads, members, vectors.euclidean, 3.0).collect()}
    assert got == {0: 2.1213, 1: 0.7071, 2: 0.7071}
    left = pivots.remove(members, spark.createDataFrame([(2,)], "id long"))
    top = [r["id"] for r in pivots.knn(query, heads, left, vectors.euclidean, 3).orderBy("rank").collect()]
    assert top == [1, 0, 3]
    heads, every = pivots.append(heads, left, objects.filter("id = 2"), vectors.euclidean)
    assert every.count() == 5
    again = pivots.compact(objects, heads, every, vectors.euclidean, 2, 1.1)
    assert {r["id"] for r in pivots.range_search(query, *again, vectors.euclidean, 3.0).collect()} == {0, 1, 2}
    assert pivots.routing_anchors(heads, 1).count() == 1


def test_position_metrics(spark):
    truth = spark.createDataFrame([(0, 3, 0, 10), (0, 3, 0, 50), (1, 3, 0, 5)], "q_id int, max_dist int, ref_id int, pos int")
    cand = spark.createDataFrame([(0, 3, 0, 12), (0, 3, 0, 13), (0, 3, 0, 90), (2, 3, 0, 1), (0, 3, 1, 50)], "q_id int, max_dist int, ref_id int, pos int")
    asked = spark.createDataFrame([(0, 3), (1, 3), (2, 3)], "q_id int, max_dist int")
    got = {tuple(r) for r in evaluate.position_metrics(truth, cand, asked).collect()}
    assert got == {(0, 3, 1, 2, 1), (1, 3, 0, 0, 1), (2, 3, 0, 1, 0)}
    row = evaluate.summary(evaluate.position_metrics(truth, cand, asked)).first()
    assert (row["recall"], row["precision"], row["fp_per_tp"]) == (1 / 3, 1 / 4, 3.0)
    assert {r["q_id"] for r in evaluate.with_truth(asked, truth).collect()} == {0, 1}
    empty = evaluate.summary(evaluate.position_metrics(truth.limit(0), cand.limit(0), asked)).first()
    assert empty["recall"] == 0 and empty["precision"] == 0
    overlap = evaluate.mean_overlap(spark.createDataFrame([(1, 1, 4), (0, 1, 4)], "x1 int, x2 int, total int")).first()
    assert overlap["overlap"] == 0.375
    assert evaluate.saving(spark.createDataFrame([(1, 2, 8)], "layer int, visited int, total int")).first()["saved"] == 0.75


def test_anchors(spark):
    objects = spark.createDataFrame([(i, s) for i, s in enumerate(["aaaa", "aaab", "bbbb", "aaaa"])], "pos int, seq string")
    heads = spark.createDataFrame([(0, "aaaa"), (1, "zzzzzzzzzzzz")], "anchor_id long, seq string")
    queries = spark.createDataFrame([(0, "aaaa")], "q_id int, q string")
    index = anchors.build_index(heads, objects, max_store=4)
    ranked = anchors.query_anchors(queries, heads)
    # The far anchor has no object in its band and is left out of the intersection.
    assert {r["pos"] for r in anchors.candidates(ranked, index, 1).collect()} == {0, 1, 3}
    assert anchors.select_anchors(ranked, 0, 0).count() == 0
    assert anchors.select_anchors(ranked, 0, 2, last_random=True).count() == 2
    assert {r["bucket"] for r in anchors.group_queries(queries, heads).collect()} == {0}
    assert anchors.random_anchors(objects, 10).count() == 3
    refs = spark.createDataFrame([(0, "ACGTACGT"), (1, "AC")], "ref_id int, seq string")
    assert {r["anchor_id"].split("|")[0] for r in anchors.record_anchors(refs, 4, 3).collect()} == {"0"}
    assert anchors.near_anchors(queries, heads).count() == 1


def strings_frame(spark, n=120):
    rng = random.Random(8)
    seeds = ["".join(rng.choice("ACGT") for _ in range(20)) for _ in range(12)]
    rows = [(i, generate.mutate(rng.choice(seeds), 0.1, rng)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id long, s string")


def test_layers_find_what_brute_force_finds(spark):
    rows, leaves = strings_frame(spark)
    queries = spark.createDataFrame([(i, s[1:] + "A") for i, s in rows[:25]], "q_id long, q string")
    nodes, edges = dag.build(leaves, {1: 3, 2: 7, 3: 14})
    want = {tuple(r) for r in dag.search_brute_force(queries, leaves, 2).collect()}
    assert want
    for mode in ("exhaustive", "adaptive"):
        assert {tuple(r) for r in dag.search(spark, mode, queries, leaves, nodes, edges, 2).collect()} == want
    greedy = {tuple(r) for r in dag.search(spark, "greedy", queries, leaves, nodes, edges, 2).collect()}
    assert greedy <= {(q, i) for q in range(25) for i in range(120)}
    with pytest.raises(ValueError):
        dag.search(spark, "other", queries, leaves, nodes, edges, 2)
    assert dag.statistics(nodes, edges, leaves).first()["n_leaves"] == 120
    heads, fp = dag.fingerprints(nodes, edges)
    assert heads.count() and fp.filter(F.size("fp") > 3).count() == 0
    covered = edges.filter("layer = 1").select("child").distinct().count()
    assert covered == 120 and dag.intra_class(edges, leaves).filter("most > 6").count() == 0


def test_splits(spark):
    rows, df = strings_frame(spark, 30)
    items = sorted({s for _, s in rows})
    assert sorted(x for p in cluster.agglomerate(items) for x in p) == items
    left, right, x1, x2 = cluster.two_way(items)
    assert sorted(left + right) == items and abs(len(left) - len(right)) <= 1 and 0 <= x1 + x2 <= len(items)
    assert cluster.extreme_promotion(["b", "a", "c"]) == ("a", "c")
    for method in ("agglomerate", "two_way"):
        assert cluster.split_groups(df.select(F.lit(1).alias("g"), "s"), method).count() == len(items)


def test_generators(spark):
    ref = generate.reference_sequence(spark, 5000)
    assert len(ref.first()["seq"]) == 5000 and set(ref.first()["seq"]) == set("ACGT")
    got = generate.reads(ref, 20, 30, 0.0).collect()
    assert {r["seq_id"] for r in got} == {f"read_{i:05d}" for i in range(20)}
    again = generate.reads(ref, 20, 30, 0.0).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    assert all(28 <= len(r["seq"]) <= 31 for r in got)
    assert generate.clustered(spark, 3, 4).count() == 12
    assert all(50 <= len(r["seq"]) <= 100 for r in generate.random_sequences(spark, 9).collect())


@pytest.mark.parametrize("method", ["range", "pivot", "sae", "anchor"])
def test_experiment(spark, method):
    rng = random.Random(3)
    refs = spark.createDataFrame([(0, "".join(rng.choice("ACGT") for _ in range(400)))], "ref_id long, seq string")
    queries = generate.simulate_queries(refs, 5, 10).select("q_id", "q")
    got = planner.run_experiment(Config(method=method, max_dist=(2,), k=10, num_anchors=8), refs, queries).first()
    assert got["recall"] == 1.0
    assert method not in ("range", "pivot") or got["precision"] > 0


def test_seeds_too_short_go_by_pivots(spark, monkeypatch):
    rng = random.Random(5)
    refs = spark.createDataFrame([(i, "".join(rng.choice("ACGT") for _ in range(200))) for i in range(2)], "ref_id long, seq string")
    queries = generate.simulate_queries(refs, None, 10).select("q_id", "q")
    monkeypatch.setattr(planner, "LOOP_PAIRS", 0)
    made = []
    monkeypatch.setattr(planner.PivotRetriever, "retrieve", lambda self, q, t, own=planner.PivotRetriever.retrieve: made.append(t) or own(self, q, t))
    one = planner.RangeRetriever(10)
    one.build(refs)
    got = {tuple(r) for r in one.retrieve(queries, 3).select("q_id", "ref_id", "pos", "dist").collect()}
    assert made == [3] and got == {tuple(r) for r in search.nested_loop(queries, search.kmers(refs, 10), 3).select("q_id", "ref_id", "pos", "dist").collect()}


def test_planner_and_config():
    assert planner.choose_plan(20, 3, 10**9, 100) == "seed" and planner.choose_plan(10, 3, 10**9, 100) == "pivot" and planner.choose_plan(20, 3, 100, 10) == "loop"
    with pytest.raises(ValueError):
        Config(method="other")
    with pytest.raises(ValueError):
        Config(start_idx=3, end_idx=-1)


def test_streamed_queries(spark, tmp_path):
    refs = spark.createDataFrame([(0, "ACGTACGTTTGACCA")], "ref_id long, seq string")
    spark.createDataFrame([(0, "ACGTACGT"), (1, "TTTGACCA")], "q_id long, q string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("q_id long, q string").parquet(str(tmp_path / "in"))
    run = search_stream(stream, lambda q: search.range_search(q, refs, 8, 1), str(tmp_path / "out"), str(tmp_path / "check"))
    run.awaitTermination(60)
    assert {(r["q_id"], r["pos"]) for r in spark.read.parquet(str(tmp_path / "out")).filter("dist = 0").collect()} == {(0, 0), (1, 7)}


def brute_extension(q, part, q_at, r_at, drop):
    """Begin of the best gapped extension to the left, cell by cell."""
    low = -(10**6)
    rows, best, at = [[-j if j <= drop else low for j in range(r_at + 1)]], 0, 0
    for i in range(1, q_at + 1):
        row, top = [], (low, 0)
        for j in range(r_at + 1):
            x = rows[-1][j] - 1
            if j:
                x = max(x, rows[-1][j - 1] + (1 if q[q_at - i] == part[r_at - j] else -1), row[-1] - 1)
            row.append(x)
        row = [x if x >= best - drop else low for x in row]
        for j, x in enumerate(row):
            if x > top[0]:
                top = (x, j)
        if top[0] > best:
            best, at = top
        rows.append(row)
    return r_at - at


def test_gapped_extension_against_cells():
    rng = random.Random(5)
    cases = []
    for _ in range(300):
        q = "".join(rng.choice("ACGT") for _ in range(16))
        part = "".join(rng.choice("ACGT") for _ in range(rng.randrange(8))) + generate.mutate(q, 0.15, rng) + "AC"
        cases.append((q, part, rng.randrange(0, 13), rng.randrange(0, len(part) - 3)))
    q, parts, at, spot = zip(*cases)
    for drop in (2, 12):
        got = search.x_drop(list(q), list(parts), np.array(at), np.array(spot), 4, np.full(len(q), drop))
        # Past the drop a row may hold cells that stand only on cells that ended: none is best.
        assert got.tolist() == [brute_extension(*c, drop) for c in cases]


def test_extension_finds_the_start_behind_a_gap(spark):
    ref = "TTGACCATGCAAGTCCGTAGGATCTTAC"
    refs = spark.createDataFrame([(0, ref), (1, ""), (2, "ACG")], "ref_id long, seq string")
    query = ref[4:12] + ref[13:25]  # one base left out
    queries = spark.createDataFrame([(0, query)], "q_id long, q string")
    got = {(r["ref_id"], r["pos"]) for r in search.extended_candidates(queries, refs, 20, 2).collect()}
    assert (0, 4) in got


def test_reports_and_results(spark, tmp_path):
    rows = [(2, 1.5, 0.25, 0.0, 1.0, 0.5, 0.1, [1.0, 2.5]), (4, 1e-05, 0.0, 3.0, 0.0, 0.0, 0.0, [])]
    made = spark.createDataFrame(rows, "max_dist int, avg_tp double, avg_fp double, avg_fn double, recall double, precision double, fp_per_tp double, distances array<double>")
    logs = reports.report(made).agg(F.concat_ws("\n", F.lit("loading"), F.collect_list("text"), F.lit(reports.START + "\nno distance here")).alias("text"))
    assert sorted(map(tuple, reports.scrape(logs).collect())) == [tuple(r) for r in rows]
    files.write_results(made.select("max_dist", "distances"), str(tmp_path / "csv"))
    back = files.read_results(spark, str(tmp_path / "csv"), "max_dist int, distances string")
    assert sorted(map(tuple, evaluate.explode_distances(back).collect())) == [(2, 1.0), (2, 2.5)]


def test_index_rules_and_batches(spark):
    objects, query = points(spark)
    heads, members = pivots.build(objects, 2, vectors.euclidean)
    assert all(r["n"] == 0 for r in pivots.violations(heads, members, objects, vectors.euclidean).collect())
    broken = members.filter("id != 1").withColumn("d", F.col("d") + 1)
    found = {r["rule"]: r["n"] for r in pivots.violations(heads, broken, objects, vectors.euclidean).collect()}
    assert found["wrong_distance"] == 4 and found["left_out"] == 1 and found["repeated"] == 0
    ranked = [(r["id"], r["rank"]) for r in pivots.range_limit(query, heads, members, vectors.euclidean, 3.0, 2).orderBy("rank").collect()]
    assert ranked == [(1, 1), (2, 2)]
    strings_ = spark.createDataFrame([(0, "abc"), (1, "xyz")], "q_id long, q string")
    none = spark.createDataFrame([], "anchor_id long, seq string")
    for heads in (none, spark.createDataFrame([(0, "abd"), (1, "xyz")], "anchor_id long, seq string")):
        assert {r["q_id"] for r in anchors.retrieve_batch(strings_, heads, lambda q: q).collect()} == {0, 1}


def test_pruning_by_fingerprints_loses_nothing(spark):
    rows, leaves = strings_frame(spark)
    queries = spark.createDataFrame([(i, s[1:] + "A") for i, s in rows[:25]], "q_id long, q string")
    nodes, edges = dag.build(leaves, {1: 2, 2: 4, 3: 8})
    want = {tuple(r) for r in dag.search_brute_force(queries, leaves, 1).collect()}
    assert {tuple(r) for r in dag.search(spark, "pruned", queries, leaves, nodes, edges, 1).collect()} == want
    assert {tuple(r) for r in dag.search(spark, "prototype", queries, leaves, nodes, edges, 1).collect()} <= want
    seen = {r["layer"]: (r["visited"], r["total"]) for r in dag.visits(queries, nodes, edges, 1).collect()}
    assert set(seen) == {1, 2, 3} and all(0 < v <= t for v, t in seen.values())


def test_neighbours_without_a_radius(spark):
    rows = [(0, "a"), (1, "ab"), (2, "zzzzzzzzzz"), (3, "")]
    df = spark.createDataFrame(rows, "id long, s string")
    got = {(r["l_id"], r["r_id"], r["dist"], r["rank"]) for r in search.knn_edit(df, df, 3).collect()}
    want = set()
    for i, a in rows:
        for k, (d, j) in enumerate(sorted((dag.edit_distance(a, b), j) for j, b in rows)[:3]):
            want.add((i, j, d, k + 1))
    assert got == want
    assert search.knn_edit(df, df.limit(0), 3).count() == 0


def joins(df):
    """The operators of a plan as it ran."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_sides_that_look_small_are_not_broadcast(spark):
    # A row of `remains` is made for each way to leave out two letters, and Spark counts the strings.
    names = spark.range(600).select(F.col("id"), F.format_string("Customer#%09d", "id").alias("s"))
    asked = names.filter("id % 20 = 0").select("id", F.translate("s", "#", "@").alias("s"))
    found = search.edit_join(asked, names, 2)
    assert "BroadcastHashJoin" not in joins(found)
    heads, members = pivots.build(names.select("id", F.col("s").alias("obj")), 25, F.levenshtein)
    near = pivots.range_search(asked.select(F.col("id").alias("q_id"), F.col("s").alias("q")), heads, members, F.levenshtein, 2)
    assert "BroadcastHashJoin" not in joins(near)
    pairs = {(a["id"], b["id"], d) for a in asked.collect() for b in names.collect() if (d := dag.edit_distance(a["s"], b["s"])) <= 2}
    assert {tuple(x) for x in found.collect()} == pairs == {tuple(x) for x in near.select("q_id", "id", "dist").collect()}


def leader_loop(rows, radius):
    found = []
    for i, s in sorted(rows):
        if not found or not (dag.edit_distances(s, [c for _, c in found]) <= radius).any():
            found.append((i, s))
    return found


def test_leaders_of_close_strings_need_no_rounds(spark, monkeypatch):
    close = [(i, f"Customer#{i:09d}") for i in range(0, 1200)]
    monkeypatch.setattr(dag, "edit_join", None)
    assert sorted(map(tuple, dag.leaders(spark.createDataFrame(close, "id long, s string"), 2, 64).collect())) == leader_loop(close, 2)


def test_leaders_of_far_strings(spark, monkeypatch):
    rng = random.Random(5)
    far = [(i, "".join(rng.choice("ab" if i % 400 < 100 else "abcdefgh\xe9") for _ in range(rng.randrange(9)))) for i in range(800)]
    monkeypatch.setattr(dag, "CENTERS", 20)
    assert sorted(map(tuple, dag.leaders(spark.createDataFrame(far, "id long, s string"), 2, 64).collect())) == leader_loop(far, 2)


def test_distances_within_groups_compare_copies_once(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(g, i, "".join(rng.choice("ab\xe9") for _ in range(rng.randrange(6)))) for g in range(4) for i in range((1, 2, 30, 700)[g])]
    df = spark.createDataFrame(rows, "grp int, id int, s string")
    monkeypatch.setattr(dag, "TILE", 100)
    got = {r["grp"]: (r["n"], r["least"], round(r["mean"], 9), r["most"]) for r in dag.pair_stats(df).collect()}
    expected = {}
    for g in range(1, 4):
        held = [s for x, _, s in rows if x == g]
        d = np.concatenate([dag.edit_distances(s, held[i + 1 :]) for i, s in enumerate(held)])
        expected[g] = (len(d), d.min(), round(d.mean(), 9), d.max())
    assert got == expected
    assert re.search(r"Aggregate \[grp#\w+, s#\w+\]", dag.pair_stats(df)._jdf.queryExecution().optimizedPlan().toString())


def test_methods_are_counted_without_all_pairs(spark):
    assert "NestedLoop" not in joins(registry.method_results(spark, "/root/testdata/sf0.01"))
