"""Merkle manifest of a dataset: one tree a group of rows, one tree over the groups' roots.

A row's leaf is the SHA-256 of its fields. Leaves of a group (here lang) ascend by key; every
ARITY consecutive nodes become the digest of their hex digests, level by level, up to one.

The trees are reduced as an associative monoid of sparse forests. A fragment is a set of nodes
keyed by (tree, level, index); as the number of leaves of each tree is known, so is the arity
of every sibling run, and a run is replaced by its parent as soon as all of it is there. The
product of two fragments is their union with all complete runs replaced, so it does not matter
how fragments are bracketed. Spark makes a fragment of each CHUNK consecutive leaves and merges
FAN neighbours at a time in rounds, the rounds of a treeReduce; each round is a table, so that
nothing has to fit in the driver, a lost executor costs one round, and the nodes that merges
made stay there for proofs. A fragment holds at most ARITY - 1 open nodes a level on either
side; a tree that is whole leaves the reduction.

A proof needs the siblings of a leaf at each level. Those inside of its chunk are made again
there; the others are open nodes of fragments, which are joined to the chunk by (tree, level,
run). Nothing is gathered but one chunk and these nodes.

Defined results: fields may be null in any row (`-`); a null group is a tree of its own, before
all others; null keys come first; equal keys follow their leaves; repeated rows have leaves of
their own; a tree of one leaf is that leaf; a row without a key is never tampered with; very
long texts are hashed whole; an empty table gives no rows; other columns are not used, whatever
their names.
"""

from __future__ import annotations

import hashlib
import string

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialise, table
from .sharding import CRC_TABLE, crc_sql, global_numbers

ARITY = 8
#: log2 of ARITY
_SHIFT = 3
CHUNK, FAN = 4096, 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

Node = tuple[str, int, int]  # tree, level, index


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value: Column) -> Column:
    """`-` for null, else the UTF-8 length, a colon and the value."""
    s = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf(fields: list[Column]) -> Column:
    return F.sha2(F.concat(*[field(f) for f in fields]).cast("binary"), 256)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def width(n: int, level: int) -> int:
    """Nodes of a level in a tree of n leaves."""
    return -(-n >> _SHIFT * level) if n else 0


def height(n: int) -> int:
    """Levels above the leaves."""
    return -(-(int(n) - 1).bit_length() // _SHIFT)


#: The same in SQL, of a column n.
_HEIGHT = f"if(n > 1, (length(bin(n - 1)) + {_SHIFT - 1}) div {_SHIFT}, 0)"


def close(nodes: dict[Node, str], sizes: dict[str, int]) -> tuple[dict[Node, str], dict[Node, str]]:
    """All complete sibling runs replaced by their parents: the open nodes that stay, and all
    nodes that were made. `close(a | b)` is the product of the monoid."""
    open_, made, todo = dict(nodes), {}, dict(nodes)
    while todo:
        up: dict[Node, str] = {}
        for tree, level, index in todo:
            run = index >> _SHIFT
            parent = (tree, level + 1, run)
            if parent in up or level >= height(sizes[tree]):
                continue
            members = [(tree, level, i) for i in range(run * ARITY, min(run * ARITY + ARITY, width(sizes[tree], level)))]
            if all(m in open_ for m in members):
                up[parent] = digest(*(open_.pop(m) for m in members))
        open_.update(up)
        made.update(up)
        todo = up
    return open_, made


_NODE = "chunk long, tree string, level int, index long, digest string, n long, open boolean, made boolean"


def _rows(chunk: int, open_: dict[Node, str], made: dict[Node, str], sizes: dict[str, int], first: bool) -> pd.DataFrame:
    """The rows of one fragment: its open nodes, and those made by it. Roots are not open.
    The first round's inner nodes are not listed: only their own chunk needs them."""
    listed = open_ if first else {**made, **open_}
    out = [
        (chunk, t, lv, i, d, sizes[t], (t, lv, i) in open_ and lv < height(sizes[t]), first or (t, lv, i) in made)
        for (t, lv, i), d in listed.items()
    ]
    return pd.DataFrame(out, columns=["chunk", "tree", "level", "index", "digest", "n", "open", "made"])


class Forest:
    """Trees over leaves.

    leaves: (tree string, digest string, key columns and others), order: the columns that order
    the leaves of a tree. After building: `placed`, the leaves with pos and chunk; `runs` (chunk,
    tree, start, n); `nodes`, all nodes that a neighbour may need; `roots` (tree, root)."""

    def __init__(self, leaves: DataFrame, order: list[str], chunk: int = CHUNK, fan: int = FAN):
        self.size = chunk
        salted = leaves.withColumn("salt", F.monotonically_increasing_id())
        numbered, self.n = global_numbers(salted, ["tree", *order, "digest", "salt"], "pos")
        self.placed = numbered.withColumn("chunk", F.expr(f"pos div {chunk}")).drop("salt")
        if self.n:
            self._build(fan)

    def _build(self, fan: int) -> None:
        per = materialise(self.placed.groupBy("chunk", "tree").agg(F.count("*").alias("k"), F.min("pos").alias("first")), "tree-runs")
        trees = materialise(per.groupBy("tree").agg(F.sum("k").alias("n"), F.min("first").alias("start")), "tree-sizes")
        self.runs = materialise(per.join(trees, "tree").select("chunk", "tree", "start", "n"), "chunk-trees")
        discard(per, trees)

        def fragment(leaves: pd.DataFrame, runs: pd.DataFrame) -> pd.DataFrame:
            start, sizes = dict(zip(runs["tree"], runs["start"], strict=True)), dict(zip(runs["tree"], runs["n"], strict=True))
            nodes = {(t, 0, p - start[t]): d for t, p, d in zip(leaves["tree"], leaves["pos"], leaves["digest"], strict=True)}
            return _rows(int(runs["chunk"].iloc[0]), *close(nodes, sizes), sizes, True)

        own = self.placed.select("chunk", "tree", "pos", "digest").groupBy("chunk")
        rounds = [materialise(own.cogroup(self.runs.groupBy("chunk")).applyInPandas(fragment, _NODE), "fragments")]

        def merge(part: pd.DataFrame) -> pd.DataFrame:
            sizes = dict(zip(part["tree"], part["n"], strict=True))
            nodes = {(t, lv, i): d for t, lv, i, d in zip(part["tree"], part["level"], part["index"], part["digest"], strict=True)}
            return _rows(int(part["chunk"].iloc[0]), *close(nodes, sizes), sizes, False)

        parts = -(-self.n // self.size)
        while parts > 1:
            parts = -(-parts // fan)
            going = rounds[-1].filter("open").withColumn("chunk", F.expr(f"chunk div {fan}"))
            rounds.append(materialise(going.groupBy("chunk").applyInPandas(merge, _NODE), "fragments"))
        self.first = rounds[0]
        every = rounds[0]
        for r in rounds[1:]:
            every = every.unionByName(r.filter("made"))
        self.nodes = materialise(every.select("tree", "level", "index", "digest", "n", (~F.col("open")).alias("closed")), "nodes")
        discard(*rounds[1:])
        self.roots = self.nodes.filter(f"closed and level = {_HEIGHT}").select("tree", F.col("digest").alias("root"))

    def needed(self) -> DataFrame:
        """(chunk, tree, level, index, digest): members of all runs above the open nodes of
        each chunk."""
        own = self.first.filter("open").withColumnRenamed("level", "own")
        above = own.withColumn("level", F.explode(F.expr(f"sequence(own, cast({_HEIGHT} as int) - 1)")))
        asked = above.select("chunk", "tree", "level", F.expr(f"shiftright(index, {_SHIFT} * (level - own + 1))").alias("run")).distinct()
        known = self.nodes.select("tree", "level", F.expr(f"shiftright(index, {_SHIFT})").alias("run"), "index", "digest")
        return asked.join(known, ["tree", "level", "run"]).select("chunk", "tree", "level", "index", "digest")

    def proofs(self, make, schema: str, top: DataFrame | None = None) -> DataFrame:
        """make(rows, proof) for each chunk: rows are its leaves as pandas, with `index`;
        proof(tree, index) is the list of (left, right) sibling texts, from the leaf up. top
        (tree, lefts, rights, root) continues each proof."""
        helpers = self.needed().select("chunk", "tree", "level", "index", "digest", F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("n"), F.lit(None).cast("array<string>").alias("lefts"), F.lit(None).cast("array<string>").alias("rights"), F.lit(None).cast("string").alias("root"))
        above = self.runs.join(top, "tree", "left") if top is not None else self.runs.withColumns({"lefts": F.lit(None).cast("array<string>"), "rights": F.lit(None).cast("array<string>"), "root": F.lit(None).cast("string")})
        heads = above.select("chunk", "tree", F.lit(-1).alias("level"), F.lit(0).cast("long").alias("index"), F.lit(None).cast("string").alias("digest"), "start", "n", "lefts", "rights", "root")

        def run(leaves: pd.DataFrame, helper: pd.DataFrame) -> pd.DataFrame:
            head = helper[helper["level"] < 0]
            start, sizes = dict(zip(head["tree"], head["start"], strict=True)), dict(zip(head["tree"], head["n"], strict=True))
            tops = {h.tree: (list(zip(h.lefts, h.rights, strict=True)) if h.lefts is not None else [], h.root) for h in head.itertuples()}
            rest = helper[helper["level"] >= 0]
            nodes = {(t, lv, i): d for t, lv, i, d in zip(rest["tree"], rest["level"], rest["index"], rest["digest"], strict=True)}
            leaves = leaves.assign(index=[p - start[t] for t, p in zip(leaves["tree"], leaves["pos"], strict=True)])
            own = {(t, 0, i): d for t, i, d in zip(leaves["tree"], leaves["index"], leaves["digest"], strict=True)}
            nodes.update(own)
            nodes.update(close(own, sizes)[1])
            heights = {t: height(n) for t, n in sizes.items()}
            known: dict[Node, list] = {}

            def upward(tree: str, level: int, index: int) -> list[tuple[str, str]]:
                if level == heights[tree]:
                    return tops[tree][0]
                if (got := known.get((tree, level, index))) is None:
                    run_ = index >> _SHIFT
                    ends = run_ * ARITY, min(run_ * ARITY + ARITY, width(sizes[tree], level))
                    left = "".join(nodes[tree, level, i] for i in range(ends[0], index))
                    right = "".join(nodes[tree, level, i] for i in range(index + 1, ends[1]))
                    got = known[tree, level, index] = [(left, right), *upward(tree, level + 1, run_)]
                return got

            return make(leaves, lambda tree, index: upward(tree, 0, index), {t: r for t, (_, r) in tops.items()})

        return self.placed.groupBy("chunk").cogroup(helpers.unionByName(heads).groupBy("chunk")).applyInPandas(run, schema)


def fold(own: str, proof: list[tuple[str, str]]) -> str:
    """The root that a leaf and its siblings give."""
    for left, right in proof:
        own = digest(left, own, right)
    return own


def verify(docs: DataFrame, fields: tuple[str, ...] = FIELDS, key: str = "doc_id", group: str = "lang", forged: dict[str, Column] | None = None, when: Column | None = None, chunk: int = CHUNK, fan: int = FAN) -> DataFrame:
    """(key, leaf, subroot, root, proof_sha256, folded_root, verified) of every row. Rows where
    `when` holds are folded with the fields of `forged` in place of their own: verified is
    true where the result still is the root."""
    fields_now = [F.col(f) for f in fields]
    fields_new = [(forged or {}).get(f, F.col(f)) for f in fields]
    tampered = F.coalesce(when, F.lit(False)) if when is not None else F.lit(False)
    leaves = docs.select(
        F.coalesce(F.concat(F.lit("v"), F.col(group).cast("string")), F.lit("n")).alias("tree"),
        F.col(key).alias("key"),
        leaf(fields_now).alias("digest"),
        F.when(tampered, leaf(fields_new)).alias("other"),
    )
    kind = leaves.schema["key"].dataType.simpleString()
    names = ["leaf", "subroot", "root", "proof_sha256", "folded_root"]
    schema = f"key {kind}, " + ", ".join(f"{n} string" for n in names) + ", verified boolean"
    trees = Forest(leaves, ["key"], chunk, fan)
    if not trees.n:
        return docs.sparkSession.createDataFrame([], schema).withColumnRenamed("key", key)
    tops = Forest(trees.roots.select(F.lit("").alias("tree"), F.col("tree").alias("key"), F.col("root").alias("digest")), ["key"], chunk, fan)

    def ends(rows: pd.DataFrame, proof, _roots) -> pd.DataFrame:
        out = []
        for name, own, index in zip(rows["key"], rows["digest"], rows["index"], strict=True):
            way = proof("", index)
            out.append((name, [a for a, _ in way], [b for _, b in way], fold(own, way)))
        return pd.DataFrame(out, columns=["tree", "lefts", "rights", "root"])

    top = materialise(tops.proofs(ends, "tree string, lefts array<string>, rights array<string>, root string"), "tops")
    above = top.join(trees.roots.withColumnRenamed("root", "subroot"), "tree")
    above = materialise(above.select("tree", F.concat("lefts", F.array("subroot")).alias("lefts"), F.concat("rights", F.array(F.lit(""))).alias("rights"), "root"), "tops")

    def rows_of(rows: pd.DataFrame, proof, roots) -> pd.DataFrame:
        out = []
        for tree, name, own, other, index in zip(rows["tree"], rows["key"], rows["digest"], rows["other"], rows["index"], strict=True):
            *way, (subroot, _) = proof(tree, index)
            got = fold(other if isinstance(other, str) else own, way)
            sides = "".join(a + b for a, b in way)
            out.append((name, own, subroot, roots[tree], digest(sides), got, got == roots[tree]))
        return pd.DataFrame(out, columns=["key", *names, "verified"])

    return trees.proofs(rows_of, schema, above).withColumnRenamed("key", key)


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*FIELDS)
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return verify(docs, forged={"text": lower_ascii(F.col("text"))}, when=chosen)


def _field_sql(c: str) -> str:
    return f"coalesce(octet_length(encode({c}::varchar))::varchar || ':' || {c}::varchar, '-')"


def _leaf_sql(text: str) -> str:
    return "sha256(" + " || ".join(_field_sql(text if f == "text" else f) for f in FIELDS) + ")"


def _levels_sql(name: str, source: str) -> str:
    return f"""{name} as (select tree, 0::bigint as level, idx, h, n from {source} union all
  select tree, level + 1, idx // {ARITY}, sha256(string_agg(h, '' order by idx)), max((n + {ARITY - 1}) // {ARITY}) from {name} where n > 1 group by tree, level, idx // {ARITY})"""


ORACLE = f"""with recursive {CRC_TABLE},
given as (select row_number() over () as row, doc_id, lang, {_leaf_sql("text")} as leaf,
  case when ({crc_sql("doc_id::varchar")}) % 3 = 0 then {_leaf_sql(f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')")} end as other from documents, table_crc),
leaves as (select *, coalesce('v' || lang, 'n') as tree, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as idx, leaf as h, count(*) over (partition by lang) as n from given),
{_levels_sql("lower_nodes", "leaves")},
subroots as (select ''::varchar as tree, tree as below, level as below_level, row_number() over (order by encode(tree)) - 1 as idx, h, count(*) over () as n from lower_nodes where n = 1),
{_levels_sql("upper_nodes", "subroots")},
nodes as (select * from lower_nodes union all select * from upper_nodes),
ways as (select tree, level, idx, coalesce(string_agg(h, '') over (w rows between unbounded preceding and 1 preceding), '') as l, coalesce(string_agg(h, '') over (w rows between 1 following and unbounded following), '') as r, tree as tree_up, level + 1 as level_up, idx // {ARITY} as idx_up, true as hashed
  from nodes where n > 1 window w as (partition by tree, level, idx // {ARITY} order by idx)
  union all select below, below_level, 0, '', '', '', 0, idx, false from subroots),
climb as (select row, tree, 0::bigint as level, idx, coalesce(other, leaf) as h, ''::varchar as proof from leaves
  union all select row, tree_up, level_up, idx_up, case when hashed then sha256(l || h || r) else h end, proof || l || r from climb join ways using (tree, level, idx)),
root as (select h as root from upper_nodes where n = 1),
folded as (select row, h, proof from climb where tree = '' qualify row_number() over (partition by row order by level desc) = 1)
select doc_id, leaf, s.h as subroot, root, sha256(proof) as proof_sha256, f.h as folded_root, f.h = root as verified
from leaves join subroots s on s.below = leaves.tree join folded f using (row), root"""
