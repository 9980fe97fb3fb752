"""Choice among the exact plans of a range search, and the retrievers as one interface."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..operators import anchors, evaluate, pivots, search
from ..sources.tables import number_rows

#: Below this seed length most of the reference is hit and the loop is as good.
LEAST_SEED = 4
#: Pairs that a nested loop may compare.
LOOP_PAIRS = 5_000_000


def choose_plan(k: int, t: int, n_windows: int, n_queries: int) -> str:
    """seed, loop or pivot for queries of length k within t edits."""
    if n_windows * n_queries <= LOOP_PAIRS:
        return "loop"
    return "seed" if k // (t + 1) >= LEAST_SEED else "pivot"


class Retriever(Protocol):
    def build(self, refs: DataFrame) -> None: ...

    def retrieve(self, queries: DataFrame, t: int) -> DataFrame: ...


@dataclass
class RangeRetriever:
    """Exact windows through the planner; first_only keeps the first place of equal k-mers."""

    k: int
    first_only: bool = False

    def build(self, refs: DataFrame) -> None:
        self.refs = refs

    def retrieve(self, queries: DataFrame, t: int) -> DataFrame:
        windows = self.refs.agg(F.sum(F.greatest(F.length("seq") - self.k + 1, F.lit(0)))).first()[0] or 0
        plan = choose_plan(self.k, t, windows, queries.count())
        if plan == "loop":
            found = search.nested_loop(queries, search.kmers(self.refs, self.k), t)
        elif plan == "pivot":
            index = PivotRetriever(Config(k=self.k))
            index.build(self.refs)
            found = index.retrieve(queries, t)
        else:
            found = search.range_search(queries, self.refs, self.k, t)
        if self.first_only:
            seqs = search.distinct_kmers(search.kmers(self.refs, self.k)).select("first.*")
            found = found.join(seqs, ["ref_id", "pos"], "left_semi")
        return found


@dataclass
class SaeRetriever:
    k: int

    def build(self, refs: DataFrame) -> None:
        self.refs = refs

    def retrieve(self, queries: DataFrame, t: int) -> DataFrame:
        return search.sae_candidates(queries, self.refs, self.k, t)


@dataclass
class AnchorRetriever:
    config: Config

    def build(self, refs: DataFrame) -> None:
        spots = search.kmers(refs, self.config.k).select(F.struct("ref_id", "pos").alias("pos"), "seq")
        self.anchors = anchors.random_anchors(spots, self.config.num_anchors, self.config.seed)
        self.index = anchors.build_index(self.anchors, spots)

    def retrieve(self, queries: DataFrame, t: int) -> DataFrame:
        c = self.config
        ranked = anchors.query_anchors(queries, self.anchors)
        chosen = anchors.select_anchors(ranked) if c.use_all else anchors.select_anchors(ranked, c.start_idx, c.end_idx, c.last_random, c.seed)
        return anchors.candidates(chosen, self.index, t).select("q_id", "pos.ref_id", "pos.pos")


@dataclass
class PivotRetriever:
    config: Config

    def build(self, refs: DataFrame) -> None:
        spots = search.kmers(refs, self.config.k).groupBy("seq").agg(F.collect_list(F.struct("ref_id", "pos")).alias("places"))
        # Numbers, not hashes, are ids: two k-mers never share one.
        objects = number_rows(spots, ["seq"], "id").select("id", F.col("seq").alias("obj"), "places")
        self.places = objects.select("id", "places")
        self.pivots, self.members = pivots.build(objects.select("id", "obj"), self.config.num_anchors, F.levenshtein)

    def retrieve(self, queries: DataFrame, t: int) -> DataFrame:
        found = pivots.range_search(queries, self.pivots, self.members, F.levenshtein, t)
        return found.join(self.places, "id").select("q_id", F.explode("places").alias("p"), "dist").select("q_id", "p.ref_id", "p.pos", "dist")


def create_retriever(config: Config) -> Retriever:
    made = {"range": lambda: RangeRetriever(config.k), "sae": lambda: SaeRetriever(config.k), "anchor": lambda: AnchorRetriever(config), "pivot": lambda: PivotRetriever(config)}
    return made[config.method]()


def run_experiment(config: Config, refs: DataFrame, queries: DataFrame) -> DataFrame:
    """Recall and precision of the configured retriever for every max_dist, as one table."""
    retriever = create_retriever(config)
    retriever.build(refs)
    truths = candidates = asked = None
    for t in config.max_dist:
        parts = search.truth(queries, refs, config.k, t), retriever.retrieve(queries, t).select("q_id", "ref_id", "pos"), queries.select("q_id")
        parts = [p.withColumn("max_dist", F.lit(t)) for p in parts]
        truths, candidates, asked = (p if old is None else old.unionByName(p) for old, p in zip((truths, candidates, asked), parts, strict=True))
    metrics = evaluate.position_metrics(truths, candidates.join(truths.select("q_id", "max_dist").distinct(), ["q_id", "max_dist"], "left_semi"), evaluate.with_truth(asked, truths))
    return evaluate.summary(metrics)
