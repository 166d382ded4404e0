"""Registered queries of this subpackage and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ball_kmeans, decontamination, embedding_dedup, histogram_sort, language_id, lm_scoring, ngram_join, packing, prefix_trie, quality_crf, suffix_dedup, token_counts, toxicity
from .common import read


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score_likelihood(read(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify_language(read(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_crf.score_quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated_pairs(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.link_vectors(read(spark, sf_dir, "embeddings"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(read(spark, sf_dir, "documents"))


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(read(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_kmeans.cluster_table(read(spark, sf_dir, "embeddings"))


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram_sort.shard_table(read(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.rebuilt_trie(read(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_lm_scoring": op1_lm_scoring,
        "op2_token_counts": op2_token_counts,
        "op3_toxicity": op3_toxicity,
        "op4_language_id": op4_language_id,
        "op5_quality": op5_quality,
        "op6_decontamination": op6_decontamination,
        "op7_embedding_dedup": op7_embedding_dedup,
        "op8_suffix_dedup": op8_suffix_dedup,
        "op9_ngram_jaccard": op9_ngram_jaccard,
        "op10_packing": op10_packing,
        "op11_centroid_clustering": op11_centroid_clustering,
        "op12_sharding": op12_sharding,
        "op13_prefix_trie": op13_prefix_trie,
    }


#: Smallest id that links reach, from edges(a, b) in both directions.
_REACH = """reach(id, other) as (select a, b from edges union select r.id, e.b from reach r join edges e on e.a = r.other),
component as (select id, least(id, min(other)) component_id from reach group by 1)"""


def _kmeans_sql(rounds: int = 3) -> str:
    """Lloyd's rounds over whole numbers, each written out."""
    steps = [f"""with kept as (select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) v from embeddings where vec_id is not null and embedding is not null and len(embedding) = 64
  and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
c0 as (select row_number() over (order by sha256('1:' || vec_id), v) - 1 k, v c from kept qualify k < 16)"""]  # fmt: skip
    for i in range(rounds + 1):
        steps.append(f"""a{i} as (select vec_id, v, min({{'d': list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint, 'k': k}}) m from kept, c{i} group by 1, 2)""")
        if i < rounds:
            steps.append(f"""s{i} as (select m.k k, p, sum(v[p])::bigint s, count(*) n from a{i}, range(1, 65) r(p) group by 1, 2), n{i} as (select k, list((s - (((s % n) + n) % n)) // n order by p) c from s{i} group by 1)""")
            steps.append(f"c{i + 1} as (select k, coalesce(n{i}.c, c{i}.c) c from c{i} left join n{i} using (k))")
    return ", ".join(steps) + f""", t as (select m.k k, sum(m.d)::bigint own from a{rounds} group by 1)
select vec_id, m.k::int as cluster, m.d distance, own cluster_inertia, (select sum(own)::bigint from t) inertia, sha256(array_to_string(c, ',')) centroid_sha256 from a{rounds} join c{rounds} on c{rounds}.k = m.k join t on t.k = m.k"""


ORACLES = {
    "op11_centroid_clustering": _kmeans_sql(),
    "op13_prefix_trie": """with tab as (select list(v order by i) t from (select i, list_reduce([i::bigint, 1, 1, 1, 1, 1, 1, 1, 1], lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) v from range(256) r(i))),
own as (select conv_id c, coalesce(role, '') role, coalesce(text, '') body, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), sha256(coalesce(text, ''))) p from conversations where conv_id is not null),
len as (select c, count(*) n from own group by 1),
h as (select c, c - c % 5 lender, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(c::varchar, ''), lambda x: ord(x)::bigint)), lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295) % 9 h from len, tab),
turns as (select h.c, p, role, body from h join own on own.c = lender where p <= h union all select h.c, least(h, coalesce(n, 0)) + p - h, role, body from h join own using (c) left join len on len.c = lender where p > h),
paths as (select c, 0 p, '' path, 0 bytes from len union all select c, p, string_agg(sha256(strlen(role) || ':' || role || body), '') over (partition by c order by p), strlen(body) from turns),
ends as (select *, max(p) over (partition by c) n from paths),
nodes as (select p, path, min(c) m, count(*) n_convs, max(bytes) bytes, sha256(coalesce(string_agg(c::varchar, ',' order by c) filter (where n = p), '')) ends from ends group by 1, 2),
spot as (select c, p, m from paths join nodes using (p, path)),
tree as (select n.*, u.m parent, (select count(*) from nodes k join spot a on a.c = k.m and a.p = k.p - 1 where k.p = n.p + 1 and a.m = n.m) kids from nodes n left join spot u on u.c = n.m and u.p = n.p - 1),
below as (select a.p, a.m, sum((t.n_convs - 1) * t.bytes)::bigint saved, count(*) filter (where kids = 0) leaves from tree t join spot a on a.c = t.m and a.p <= t.p group by 1, 2)
select t.m conv_id, t.p::bigint as depth, parent parent_conv_id, n_convs, kids n_children, leaves n_leaves, saved saved_tokens, ends ends_sha256 from tree t join below b on b.p = t.p and b.m = t.m""",
    "op7_embedding_dedup": f"""with recursive ok as (select vec_id, label, embedding::double[] v from embeddings where vec_id is not null and label is not null and embedding is not null and len(embedding) > 0
  and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
edges as (select p.vec_id a, q.vec_id b from ok p join ok q on p.label = q.label and len(p.v) = len(q.v) and p.vec_id <> q.vec_id where list_cosine_similarity(p.v, q.v) >= 0.93), {_REACH},
n as (select a, count(*) n_links from edges group by 1)
select vec_id, coalesce(n_links, 0) n_links, coalesce(component_id, vec_id) component_id, vec_id = coalesce(component_id, vec_id) kept
from embeddings left join n on a = vec_id left join component on id = vec_id where vec_id is not null""",
    "op8_suffix_dedup": """with d as (select doc_id, hex(encode(coalesce(text, ''))) h from documents where doc_id is not null),
w as (select doc_id, p, substr(h, 2 * p + 1, 100) s from d, lateral (select unnest(range(len(h) // 2 - 49)) p)), f as (select s, min(doc_id) first from w group by 1),
gone as (select w.doc_id, w.p from w join f using (s) where first < w.doc_id),
cut as (select doc_id, p, coalesce(p > max(p + 50) over (partition by doc_id order by p rows between unbounded preceding and 1 preceding), true)::int new from gone),
span as (select doc_id, k, min(p) x, max(p) + 50 y from (select *, sum(new) over (partition by doc_id order by p) k from cut) group by 1, 2),
part as (select d.doc_id, x, substr(h, 2 * coalesce(lag(y) over o, 0) + 1, 2 * (x - coalesce(lag(y) over o, 0))) t from span join d using (doc_id) window o as (partition by d.doc_id order by x)),
tail as (select d.doc_id, 1e12::bigint x, substr(h, 2 * coalesce(max(y), 0) + 1) t from d left join span using (doc_id) group by d.doc_id, h),
kept as (select doc_id, string_agg(t, '' order by x) t from (select * from part union all select * from tail) group by 1),
n as (select doc_id, sum(y - x)::bigint n_removed, count(*) n_spans from span group by 1)
select d.doc_id, len(h) // 2 n_bytes, coalesce(n_removed, 0) n_removed, coalesce(n_spans, 0) n_spans, sha256(unhex(kept.t)) kept_sha256 from d join kept using (doc_id) left join n using (doc_id)""",
    "op9_ngram_jaccard": f"""with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w from documents where doc_id is not null),
s as (select distinct doc_id, array_to_string(w[i:i + 4], ' ') s from d, lateral (select unnest(range(1, len(w) - 3)) i) where len(w) >= 5 union all select doc_id, array_to_string(w, ' ') from d where len(w) between 1 and 4),
n as (select doc_id, count(*) n from s group by 1), c as (select x.doc_id a, y.doc_id b, count(*) k from s x join s y on x.s = y.s and x.doc_id <> y.doc_id group by 1, 2),
edges as (select a, b from c join n p on p.doc_id = a join n q on q.doc_id = b where 100 * k >= 75 * (p.n + q.n - k)), {_REACH}
select d.doc_id, coalesce(n, 0) n_shingles, coalesce(component_id, d.doc_id) component_id from d left join n using (doc_id) left join component on id = d.doc_id""",
}


def oracle_sql() -> dict[str, str]:
    """SQL of the queries that SQL can express; tests/llm has brute-force versions of the others."""
    return ORACLES
