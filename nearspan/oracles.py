"""DuckDB SQL for the registered queries: brute force, where the library plans around it."""

from __future__ import annotations

from .functions.strings import BASES, LETTERS
from .operators.chain import DRIFT, LENGTH, STRIDE
from .registry import EUCLID_R, LONG, NUM_ANCHORS, TOLERANCE, K, T

#: Length of a quarter of a query.
_PIECE = K // 4
_DRAW = "((7 * 48271 + {0} * 69621 + 11) % 2147483647)"
_DNA = f"""dna as (select doc_id, translate(regexp_replace(text, '[^A-Za-z]', '', 'g'), '{LETTERS}', '{BASES}') as s from documents where text is not null),
kmers as (select doc_id, i - 1 as pos, substr(s, i, {K}) as seq from dna, unnest(generate_series(1, length(s) - {K - 1})) t(i)),
drawn as (select doc_id as q_id, substr(s, ({_DRAW.format('doc_id')} % (length(s) - {K - 1})) + 1, {K}) as q from dna where length(s) >= {K} and doc_id % 20 = 0),
asked as (select q_id, case when (q_id // 20) % 2 = 1 then substr(q, 1, (q_id // 20 * 31) % {K}) || translate(substr(q, (q_id // 20 * 31) % {K} + 1, 1), 'ACGT', 'CGTA') || substr(q, (q_id // 20 * 31) % {K} + 2) else q end as q from drawn),
queries as (select *, substr(q, 1, {_PIECE}) as p1, substr(q, {_PIECE + 1}, {_PIECE}) as p2, substr(q, {2 * _PIECE + 1}, {_PIECE}) as p3, substr(q, {3 * _PIECE + 1}, {_PIECE}) as p4 from asked)"""
# Within three edits one of four pieces of a query stands unchanged in a window, and so it does
# where they agree on a seed: no pair is lost, and most are dismissed without a distance.
_MAY = "(contains(seq, p1) or contains(seq, p2) or contains(seq, p3) or contains(seq, p4))"
_NAMES = """names as (select c_custkey as pos, c_name as seq from customer),
queries as (select pos as q_id, translate(seq, '#', '@') as q from names where pos % 20 = 0)"""
_ANCHORS = f"""{_NAMES},
anchors as (select row_number() over (order by {_DRAW.format('pos')}, pos) - 1 as anchor_id, seq as a from (select * from names order by {_DRAW.format('pos')}, pos limit {NUM_ANCHORS})),
idx as (select anchor_id, pos, levenshtein(a, seq)::bigint as dist from anchors, names),
ranked as (select q_id, anchor_id, d, row_number() over (partition by q_id order by d, anchor_id) - 1 as rank from (select q_id, anchor_id, levenshtein(q, a)::bigint as d from queries, anchors))"""
_SEED = K // T
_PIVOTS = f"""{_NAMES},
heads as (select pos as pivot_id, seq as center from names order by {_DRAW.format('pos')}, pos limit (select greatest(16, floor(sqrt(count(*) - 1))::bigint + 1) from names)),
placed as (select pos as id, seq as obj, min(struct_pack(d := levenshtein(seq, center)::bigint, p := pivot_id)) as m from names, heads group by 1, 2),
members as (select id, obj, m.p as pivot_id, m.d as d from placed),
balls as (select pivot_id, center, max(d) as radius, count(*) as n from heads join members using (pivot_id) group by 1, 2),
opened as (select q_id, q, b.pivot_id, radius, levenshtein(q, center)::bigint as dq from queries, balls b where levenshtein(q, center) - radius <= {TOLERANCE}),
compared as (select q_id, count(*) as n from opened join members using (pivot_id) where abs(dq - d) <= {TOLERANCE} group by 1)"""


def _candidates(where: str) -> str:
    return f"""with {_ANCHORS},
hits as (select q_id, r.anchor_id, pos from ranked r join idx using (anchor_id) where {where} and dist between greatest(d - {TOLERANCE}, 0) and d + {TOLERANCE}),
need as (select q_id, count(distinct anchor_id) as n from hits group by 1)
select q_id, pos from hits join need using (q_id) group by q_id, pos, n having count(distinct anchor_id) = n"""


def _sae(t: int) -> str:
    length = max(K // t, 1)
    same = " or ".join(f"substr(q, {o + 1}, {length}) = substr(seq, {o + 1}, {length})" for o in range(0, length * (K // length), length))
    return f"select q_id, {t}::bigint as max_dist, doc_id, pos from pairs where d <= {t} and ({same})"


_METRICS = f"""with {_DNA},
pairs as (select q_id, doc_id, pos, q, seq, levenshtein(q, seq) as d from queries, kmers where {_MAY} and levenshtein(q, seq) <= 4),
truth as (select q_id, t.max_dist, doc_id, pos from pairs, (values (2::bigint), (4::bigint)) t(max_dist) where d <= t.max_dist // 2),
cand as ({_sae(2)} union all {_sae(4)}),
judged as (select distinct q_id, max_dist from truth),
hit as (select t.*, exists (select 1 from cand c where c.q_id = t.q_id and c.max_dist = t.max_dist and c.doc_id = t.doc_id and abs(c.pos - t.pos) <= t.max_dist) as ok from truth t),
good as (select c.*, exists (select 1 from truth t where c.q_id = t.q_id and c.max_dist = t.max_dist and c.doc_id = t.doc_id and abs(c.pos - t.pos) <= t.max_dist) as ok from cand c),
metrics as (select a.q_id, a.max_dist, (select count(*) from hit h where h.q_id = a.q_id and h.max_dist = a.max_dist and ok) as tp,
 (select count(*) from good g where g.q_id = a.q_id and g.max_dist = a.max_dist and not ok) as fp, (select count(*) from hit h where h.q_id = a.q_id and h.max_dist = a.max_dist and not ok) as fn from judged a)"""
_VECTORS = """v as (select vec_id, embedding::double[] as e from embeddings where embedding is not null),
pairs as (select a.vec_id as q_id, b.vec_id, list_distance(a.e, b.e) as d from v a, v b where a.vec_id % 20 = 0)"""
_RANKED = f"select q_id, pos, levenshtein(q, seq)::bigint as dist, row_number() over (partition by q_id order by levenshtein(q, seq), pos) as rank from queries, names where levenshtein(q, seq) <= {TOLERANCE}"
_RANGE = f"select q_id, pos, levenshtein(q, seq)::bigint as dist from queries, names where levenshtein(q, seq) <= {TOLERANCE}"
_ONE = "select q_id, pos as id, levenshtein(q, seq)::bigint as dist from queries, names where levenshtein(q, seq) <= 1"

# The sequential loop: the next leader is the first string that is far from all leaders so far.
_LEADERS = f"""{_NAMES},
loop as (select min(pos) as id, [arg_min(seq, pos)] as chosen from names
  union all select min(n.pos), list_append(any_value(chosen), arg_min(n.seq, n.pos)) from loop l, names n where n.pos > l.id and len(list_filter(chosen, lambda c: levenshtein(c, n.seq) <= {{}})) = 0 having count(*) > 0),
lead as (select id, seq as s from loop join names on pos = id)"""

ORACLES = {
    "leader_pivots": f"with recursive {_LEADERS.format(2)} select id, s from lead",
    "inter_class_distance": f"with recursive {_LEADERS.format(2)} select count(*) as n, min(levenshtein(a.s, b.s))::bigint as least, avg(levenshtein(a.s, b.s)) as mean, max(levenshtein(a.s, b.s))::bigint as most from lead a, lead b where a.id < b.id",
    "intra_class_distance": f"""with recursive {_LEADERS.format(2)}, held as (select id as parent, pos, seq from lead, names where levenshtein(s, seq) <= 2)
select parent, count(*) as n, min(levenshtein(a.seq, b.seq))::bigint as least, avg(levenshtein(a.seq, b.seq)) as mean, max(levenshtein(a.seq, b.seq))::bigint as most from held a join held b using (parent) where a.pos < b.pos group by 1""",
    "kmer_windows": f"with {_DNA} select doc_id, count(*) as n_windows, count(distinct seq) as n_distinct, min(seq) as first_kmer, max(seq) as last_kmer from kmers group by 1",
    "distinct_kmers": f"with {_DNA} select n, count(*) as n_kmers from (select count(*) as n from kmers group by seq) group by 1",
    "simulated_queries": f"with {_DNA} select q_id, q from queries",
    "exact_occurrences": f"with {_DNA} select q_id, doc_id as ref_id, pos from queries join kmers on q = seq",
    "fm_occurrences": f"""with {_DNA}, asked_parts as (select q_id, substr(q, 1, 8 + (q_id // 20 % {K - 7})::int) as pattern from queries),
spots as (select doc_id, i - 1 as pos, substr(s, i, 8) as head, substr(s, i, {K}) as seq from dna, unnest(generate_series(1, length(s) - 7)) t(i))
select q_id, pattern, doc_id as ref_id, pos from asked_parts join spots on head = substr(pattern, 1, 8) and starts_with(seq, pattern)""",
    # Chains by their number of hits: per hit the least begin of a chain of n hits that ends in it.
    "seed_chains": f"""with recursive {_DNA},
long_drawn as (select doc_id as q_id, substr(s, ({_DRAW.format('doc_id')} % (length(s) - {LONG - 1})) + 1, {LONG}) as q from dna where length(s) >= {LONG} and doc_id % 20 = 0),
long_reads as (select q_id, substr(q, 1, {LONG // 3}) || translate(substr(q, {LONG // 3 + 1}, 1), 'ACGT', 'CGTA') || substr(q, {LONG // 3 + 2}, {2 * LONG // 3 - LONG // 3 - 1}) || substr(q, {2 * LONG // 3 + 2}) as q from long_drawn),
chain_seeds as (select q_id, o as off, substr(q, o + 1, {LENGTH}) as seed from long_reads, unnest(range(0, length(q) - {LENGTH - 1}, {STRIDE})) t(o)),
chain_hits as (select q_id, doc_id, off, pos from chain_seeds join (select doc_id, i - 1 as pos, substr(s, i, {LENGTH}) as seed from dna, unnest(generate_series(1, length(s) - {LENGTH - 1})) t(i)) using (seed)),
banded as (select q_id, doc_id, k, floor((pos - off + k * {DRIFT}) / {2 * DRIFT}) as band, off, pos from chain_hits, (values (0), (1)) t(k)),
runs as (select q_id, doc_id, k, band, off, pos, 1 as n, pos as first from banded union all
  select h.q_id, h.doc_id, h.k, h.band, h.off, h.pos, max(r.n) + 1, min(r.first) from runs r join banded h on h.q_id = r.q_id and h.doc_id = r.doc_id and h.k = r.k and h.band = r.band and h.off >= r.off + {LENGTH} and h.pos >= r.pos + {LENGTH} group by all),
best as (select q_id, doc_id, min(struct_pack(n := -n, first := first, last := pos + {LENGTH})) as x from runs group by 1, 2)
select q_id, doc_id as ref_id, -x.n::bigint * {LENGTH} as score, x.first as begin, x.last as "end" from best""",
    "range_search": f"with {_DNA} select q_id, doc_id as ref_id, pos, levenshtein(q, seq)::bigint as dist from queries, kmers where {_MAY} and levenshtein(q, seq) <= {T}",
    "range_search_loop": f"with {_NAMES} {_RANGE}",
    "truth_positions": f"with {_DNA} select q_id, doc_id as ref_id, pos, t.max_dist from queries, kmers, (values (2::bigint), (4::bigint)) t(max_dist) where {_MAY} and levenshtein(q, seq) <= t.max_dist // 2",
    "seed_hits": f"""with {_DNA}, seeds as (select q_id, substr(q, o + 1, {_SEED}) as seed from queries, unnest(range(0, {_SEED * (K // _SEED)}, {_SEED})) t(o)),
spots as (select substr(s, i, {_SEED}) as seed, count(*) as n from dna, unnest(generate_series(1, length(s) - {_SEED - 1})) t(i) group by 1)
select q_id, count(*) as index_accesses, coalesce(sum(n), 0)::bigint as candidate_accesses from seeds left join spots using (seed) group by 1""",
    "sae_candidates": f"with {_DNA}, pairs as (select q_id, doc_id, pos, q, seq, levenshtein(q, seq) as d from queries, kmers where {_MAY} and levenshtein(q, seq) <= {T}) select q_id, doc_id as ref_id, pos, d::bigint as dist from ({_sae(T)}) join pairs using (q_id, doc_id, pos)",
    "position_metrics": f"{_METRICS} select * from metrics",
    "metrics_summary": f"""{_METRICS} select max_dist, count(*) as n_queries, avg(tp) as avg_tp, avg(fp) as avg_fp, avg(fn) as avg_fn, coalesce(sum(tp) / nullif(sum(tp) + sum(fn), 0), 0)::double as recall,
coalesce(sum(tp) / nullif(sum(tp) + sum(fp), 0), 0)::double as precision, coalesce(sum(fp) / nullif(sum(tp), 0), 0)::double as fp_per_tp from metrics group by 1""",
    "distance_stats": f"""with {_DNA}, found as (select q_id, doc_id, pos, levenshtein(q, seq) as d from queries, kmers where {' or '.join(f'substr(q, {o + 1}, {_SEED}) = substr(seq, {o + 1}, {_SEED})' for o in range(0, _SEED * (K // _SEED), _SEED))})
select q_id, count(d) as n, coalesce(avg(d), 0)::double as avg_dist, coalesce(max(d), 0)::bigint as far_dist, coalesce(avg(d), 0)::double as avg_all from queries left join found using (q_id) group by 1""",
    "window_min_distance": """with pairs as (select n_nationkey, '#000' || n_nationkey as p, c_name as t from nation, customer),
scored as (select n_nationkey, case when length(t) < length(p) then levenshtein(p, t) else list_min(list_transform(generate_series(1, length(t) - length(p) + 1), lambda i: levenshtein(p, substr(t, i, length(p))))) end as dist from pairs)
select n_nationkey::bigint as n_nationkey, dist::bigint as dist, count(*) as n from scored group by 1, 2""",
    "anchor_index": f"with {_ANCHORS} select anchor_id, pos, dist from idx",
    "anchor_rank": f"with {_ANCHORS} select q_id, anchor_id, d, rank from ranked",
    "anchor_candidates": _candidates("true"),
    "anchor_candidates_topk": _candidates("rank < 3"),
    "anchor_conjunctive": """with refs as (select item_id, regexp_replace(text, '[^ -~]', '', 'g') as t from benchmark where text is not null), wanted(a, most) as (values ('tioner', 2), ('thereand', 4)),
scored as (select item_id, most, case when length(t) < length(a) then levenshtein(a, t) else list_min(list_transform(generate_series(1, length(t) - length(a) + 1), lambda i: levenshtein(a, substr(t, i, length(a))))) end as dist from refs, wanted)
select item_id from scored group by 1 having bool_and(dist <= most)""",
    "nearby_anchor_filter": f"with {_ANCHORS} select distinct q_id from ranked where d < 4",
    "query_buckets": f"with {_ANCHORS} select q_id, anchor_id as bucket from ranked where rank = 0",
    "edit_join": f"with s as (select distinct p_name as s from part) select a.s as l_id, b.s as r_id, levenshtein(a.s, b.s)::bigint as dist from s a, s b where levenshtein(a.s, b.s) <= {T}",
    "knn_edit": f"with {_NAMES} select * from (select q_id, pos, levenshtein(q, seq)::bigint as dist, row_number() over (partition by q_id order by levenshtein(q, seq), pos) as rank from queries, names) where rank <= 3",
    "range_search_pivot": f"with {_NAMES} {_RANGE}",
    "range_search_removed": f"with {_NAMES} {_RANGE} and pos % 3 <> 0",
    "range_search_appended": f"with {_NAMES} {_RANGE}",
    "batch_retrieval": f"with {_NAMES} {_RANGE}",
    "range_limit": f"with {_NAMES} select * from ({_RANKED}) where rank <= 3",
    "range_ranked": f"with {_NAMES} {_RANKED}",
    "pivot_accesses": f"""with {_PIVOTS}, nodes as (select q_id, count(*) as n, min(radius) as least_radius, avg(radius) as mean_radius, max(radius) as most_radius from opened group by 1)
select q_id, coalesce(nodes.n, 0) as node_accesses, coalesce(compared.n, 0) as entry_accesses, least_radius, mean_radius, most_radius from queries left join nodes using (q_id) left join compared using (q_id)""",
    "routing_anchors": f"with {_PIVOTS} select pivot_id as anchor_id, center as seq from balls where n >= 5 order by n desc, pivot_id limit 10",
    "structure": f"with {_PIVOTS} select 'pivot' as layer, count(*) as n from balls union all select 'member', count(*) from members",
    "index_violations": "select unnest(['no_ball', 'beyond_radius', 'wrong_distance', 'left_out', 'repeated']) as rule, 0::bigint as n",
    "overlap_stats": f"with {_PIVOTS}, inside as (select id, count(*) as n from members, balls where levenshtein(obj, center) <= radius group by 1) select count(*) as n_members, count(*) filter (n > 1) as shared, sum(n - 1)::bigint as extra from inside",
    "outlier_members": f"with {_PIVOTS}, usual as (select pivot_id, avg(d) as usual, count(*) as k from members group by 1) select id, pivot_id, d from members join usual using (pivot_id) where k >= 25 and d > usual * 1.1::double",
    "near_anchors": f"with {_ANCHORS} select q_id, anchor_id, d as dist from ranked where d <= 5",
    "last_random_anchor": f"""with {_ANCHORS}, cut as (select * from ranked where rank < 5)
select * from cut where rank < (select count(*) from cut c where c.q_id = cut.q_id) - 1 union all
select q_id, anchor_id, d, rank from (select *, row_number() over (partition by q_id order by (((7 * 48271 + q_id * 69621 + 11) % 2147483647 * 48271 + rank * 69621 + 11) % 2147483647 * 48271 + 42 * 69621 + 11) % 2147483647, rank) as i from cut) where i = 1""",
    "retained_queries": f"with {_ANCHORS}, kept as (select count(distinct q_id) as k from ranked where d < 4) select count(*) as n_queries, any_value(k) as n_kept, 100.0::double * any_value(k) / count(*) as percent from queries, kept",
    "anchor_accesses": f"""with {_ANCHORS}, hits as (select q_id, r.anchor_id, pos from ranked r join idx using (anchor_id) where dist between greatest(d - {TOLERANCE}, 0) and d + {TOLERANCE}),
need as (select q_id, count(distinct anchor_id) as k, count(*) as index_accesses from hits group by 1), held as (select q_id, pos, count(*) as c from hits group by 1, 2)
select q_id, index_accesses, (select count(*) from held h where h.q_id = need.q_id and h.c = need.k) as candidate_accesses from need""",
    "fasta_records": f"with {_DNA} select doc_id::varchar as id, s as seq from dna",
    "reference_prefix": f"with {_DNA} select doc_id::varchar as id, substr(s, 1, 10000) as seq from dna order by dna.doc_id limit 1",
    "fastq_queries": f"with {_DNA} select row_number() over (order by doc_id desc) - 1 as q_id, substr(s, 1, {K}) as q from dna where length(s) >= 50 order by doc_id desc limit 100",
    "result_csv": "select n_nationkey::bigint as n_nationkey, (n_nationkey + 0.5 + 2.25)::double as total from nation",
    "report_scrape": "select n_nationkey::bigint as max_dist, n_nationkey::double + 0.5 as avg_tp, n_nationkey::double / 4 as avg_fp, 0::double as avg_fn, 1 / (n_nationkey::double + 1) as recall, 1::double as precision, n_nationkey::double * 1000 as fp_per_tp, n_nationkey::double + 2.25 as distances from nation",
    "method_results": f"with {_NAMES}, found as ({_RANGE}) select 'all' as method, q_id, count(*) as n from found group by 2 union all select 'removed', q_id, count(*) from found where pos % 3 <> 0 group by 2",
    "range_euclidean": f"with {_VECTORS} select q_id, vec_id, round(d, 6) as dist from pairs where d <= {EUCLID_R}",
    "knn_euclidean": f"with {_VECTORS} select * from (select q_id, vec_id, round(d, 6) as dist, row_number() over (partition by q_id order by d, vec_id) as rank from pairs) where rank <= 5",
    "substring_extract": f"""with {_DNA}, coords as (select o_orderkey, o_orderkey % 1200 as chrom, o_custkey as pos, o_orderkey % 50 as len from orders)
select o_orderkey, chrom, pos, len, coalesce(substr(s, pos + 1, len), '') as seq from coords left join dna on chrom = doc_id""",
    "parse_int_list": "select n_nationkey::bigint as n_nationkey, array_to_string(list_filter(list_transform(string_split(n_nationkey || ', ' || n_name || ', ' || n_regionkey, ','), lambda x: try_cast(trim(x) as int)), lambda x: x is not null), ' ') as ints from nation",
    "json_thresholds": "select r_name as anchor_id, r_regionkey::bigint as most from region",
    "distance_lists": "select c_nationkey::bigint as method, 2 * count(*) as n, sum(c_custkey + 0.5 + 2.25)::double as total from customer group by 1",
    "literal_arrays": "select n_nationkey::bigint as n_nationkey, (n_nationkey + 0.5 + 2.25)::double as total from nation",
    "dag_recall": "select 0::bigint as missing, 0::bigint as extra",
    "dag_exhaustive": f"with {_NAMES} {_ONE}",
    "dag_adaptive": f"with {_NAMES} {_ONE}",
    "dag_pruned": f"with {_NAMES} {_ONE}",
}
