"""Registered searches over the given tables and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.config import QuerySettings
from marlstone.models import embed
from marlstone.operators import fusion, hybrid, scope
from marlstone.operators.dense import dense_top_k
from marlstone.operators.lexical import bm25_top_k, keyword_index, sparse_top_k, term_index, vector_index
from marlstone.operators.postings import Postings
from marlstone.plans.tables import chunks, questions, scope_rows, stored, table
from marlstone.session import materialize

K = 12


def forward_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored terms of every chunk."""
    return stored(spark, sf_dir, "documents", "terms", lambda: materialize(term_index(chunks(spark, sf_dir)), "terms"))


def keyword_postings(spark: SparkSession, sf_dir: str) -> Postings | DataFrame:
    """Stored index of the chunks' terms, shared by all keyword searches: postings, or the terms of a large table."""
    return stored(spark, sf_dir, "documents", "postings", lambda: keyword_index(forward_index(spark, sf_dir)))


def bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25_top_k(None, questions(spark, sf_dir), K, index=keyword_postings(spark, sf_dir))


def chunk_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored vectors of every chunk, shared by all vector searches."""
    return stored(
        spark, sf_dir, "documents", "vectors", lambda: materialize(embed(chunks(spark, sf_dir), "content", ["chunk_id", "doc_id"]), "vectors")
    )


def sparse_postings(spark: SparkSession, sf_dir: str) -> Postings | DataFrame:
    return stored(spark, sf_dir, "documents", "sparse", lambda: vector_index(chunk_vectors(spark, sf_dir)))


def asked_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialize(embed(questions(spark, sf_dir), "text", ["query_id"]), "questions")


def sparse_dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sparse_top_k(sparse_postings(spark, sf_dir), asked_vectors(spark, sf_dir), K)


def dense_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense_top_k(chunk_vectors(spark, sf_dir), asked_vectors(spark, sf_dir), K)


def dense_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Given vectors nearest to the mean vector of every label."""
    given = table(spark, sf_dir, "embeddings")
    dims = given.select(F.col("label").alias("query_id"), F.posexplode("embedding").alias("i", "x"))
    means = dims.groupBy("query_id", "i").agg(F.round(F.avg(F.col("x").cast("double")), 9).alias("x"))
    centres = means.groupBy("query_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda e: e["x"]).alias("dense")
    )
    return dense_top_k(given.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("dense")), centres, K)


def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hybrid.hybrid_top_k(chunk_vectors(spark, sf_dir), asked_vectors(spark, sf_dir), K, sparse=sparse_postings(spark, sf_dir))


def _branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid, dense (as the pseudo-document branch) and BM25 hits of every question."""
    given, asked = chunk_vectors(spark, sf_dir), asked_vectors(spark, sf_dir)
    dense = materialize(dense_top_k(given, asked, K), "dense")
    sparse = sparse_top_k(sparse_postings(spark, sf_dir), asked, K)
    found = {"direct_hybrid": hybrid.weighted_hybrid(dense, sparse, K), "hyde": dense, "bm25": bm25(spark, sf_dir)}
    hits = None
    for name, hit in found.items():
        part = hit.select("query_id", "chunk_id", "rank", F.lit(name).alias("branch"))
        hits = part if hits is None else hits.unionByName(part)
    # Ranked hits are few; what follows doesn't repeat the searches.
    return materialize(hits, "hits")


def _flat_fused(fused: DataFrame) -> DataFrame:
    return fused.select(
        "query_id", "chunk_id", F.round("fusion_score", 9).alias("fusion_score"), "rrf_rank",
        F.array_join("retrieval_sources", ",").alias("sources"), "direct_hybrid_rank", "hyde_rank", "bm25_rank",
    )


def rrf_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat_fused(fusion.fuse_branches(_branches(spark, sf_dir)))


def rrf_exclusive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fusion where every branch keeps its best two exclusive chunks."""
    settings = QuerySettings(rrf_min_exclusive_per_branch=2)
    return _flat_fused(fusion.fuse_branches(_branches(spark, sf_dir), settings))


def _variant_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 hits of two search texts per question: the text and its first line."""
    asked = questions(spark, sf_dir)
    texts = asked.select(
        "query_id", F.posexplode(F.array("text", F.split("text", "\n")[0])).alias("variant", "text")
    )
    keyed = texts.select((F.col("query_id") * 2 + F.col("variant")).alias("query_id"), "text")
    hits = bm25_top_k(None, keyed, K, index=keyword_postings(spark, sf_dir))
    return hits.select(
        F.expr("query_id div 2").alias("query_id"), (F.col("query_id") % 2).cast("int").alias("variant"),
        "chunk_id", "rank",
    )


def rrf_multi_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = hybrid.merge_query_variants(_variant_hits(spark, sf_dir), K)
    return merged.select(
        "query_id", "chunk_id", F.round("branch_fusion_score", 9).alias("branch_fusion_score"), "rank",
        F.col("branch_ranks")["query_0"].alias("query_0_rank"), F.col("branch_ranks")["query_1"].alias("query_1_rank"),
    )


def _bm25_scoped(spark: SparkSession, sf_dir: str):
    """A branch search over the stored index, shared by all scopes."""
    index = keyword_postings(spark, sf_dir)
    return lambda asked, limited: bm25_top_k(None, asked, K, index=index, scope=limited)


def scope_hard_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scope.search_hard(questions(spark, sf_dir), scope_rows(spark, sf_dir), _bm25_scoped(spark, sf_dir))


def scope_soft(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scope.search_soft(questions(spark, sf_dir), scope_rows(spark, sf_dir), _bm25_scoped(spark, sf_dir), K)
    return found.select(
        "query_id", "chunk_id", F.round("branch_fusion_score", 9).alias("branch_fusion_score"), "rank",
        F.col("branch_ranks")["global"].alias("global_rank"), F.col("branch_ranks")["soft_route"].alias("soft_rank"),
    )


def active_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 over documents whose quality label is good; unlabelled ones are active.

    Searched once, so the terms are scored where they lie.
    """
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("chunk_id"), "quality")
    flagged = forward_index(spark, sf_dir).join(labels, "chunk_id", "left").withColumn(
        "is_active", F.coalesce(F.col("quality") == 1, F.lit(True))
    )
    return bm25_top_k(None, questions(spark, sf_dir), K, index=materialize(scope.visible(flagged), "active"))


def score_cliff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 rankings cut at their cliff, scores scaled to the best one of each question."""
    hits = bm25(spark, sf_dir)
    best = F.max("score").over(Window.partitionBy("query_id"))
    scaled = hits.withColumn("score", F.round(F.col("score") / best, 6))
    return fusion.truncate_at_cliff(scaled)


QUERIES = {
    "bm25_topk": bm25,
    "sparse_dot_topk": sparse_dot,
    "dense_text_topk": dense_text,
    "dense_topk": dense_vectors,
    "hybrid_topk": hybrid_search,
    "rrf_weighted": rrf_weighted,
    "rrf_exclusive": rrf_exclusive,
    "rrf_multi_query": rrf_multi_query,
    "scope_hard_fallback": scope_hard_fallback,
    "scope_soft": scope_soft,
    "active_filter": active_filter,
    "score_cliff": score_cliff,
}

# ---------------------------------------------------------------- SQL twins

_WORDS = "regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}]+')"


def _bm25_sql(name: str, docs: str, asked: str, k: int = K, where: str = "true", stats: str | None = None) -> str:
    """CTEs ending in ``name``(query_id, chunk_id, score, rank); docs(chunk_id, doc_id, toks)."""
    stats = stats or docs
    return f"""
{name}_t as (select chunk_id, doc_id, len(toks) dl, unnest(toks) token from {docs}),
{name}_s as (select distinct chunk_id, token from (select chunk_id, unnest(toks) token from {stats})),
{name}_n as (select count(*) n, avg(len(toks)) avgdl from {stats}),
{name}_tf as (select chunk_id, doc_id, dl, token, count(*)::double tf from {name}_t group by all),
{name}_df as (select token, count(*) df from {name}_s group by token),
{name}_sc as (
  select q.query_id, t.chunk_id,
    round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) score
  from {asked} q join {name}_df using (token) join {name}_tf t using (token), {name}_n
  where {where} group by all),
{name} as (select * from (select *, row_number() over (partition by query_id order by score desc, chunk_id) rank
  from {name}_sc) where rank <= {k})"""


_DOCS = f"docs as (select doc_id chunk_id, source doc_id, {_WORDS.format('text')} toks from documents)"
_ASKED = (
    f"asked as (select distinct item_id query_id, unnest({_WORDS.format('text')}) token from benchmark)"
)
_HASHED = f"""
dtok as (select chunk_id, ('0x' || substr(md5(token), 1, 7))::int id from (select chunk_id, unnest(toks) token from docs)),
qtok as (select query_id, ('0x' || substr(md5(token), 1, 7))::int id
  from (select item_id query_id, unnest({_WORDS.format('text')}) token from benchmark)),
dtf as (select chunk_id, id, count(*) tf from dtok group by all),
qtf as (select query_id, id, count(*) tf from qtok group by all),
sparse_sc as (select query_id, chunk_id, round(sum((1 + ln(d.tf)) * (1 + ln(q.tf))), 6) score
  from qtf q join dtf d using (id) group by all),
sparse as (select * from (select *, row_number() over (partition by query_id order by score desc, chunk_id) rank
  from sparse_sc) where rank <= {K}),
db as (select chunk_id, id % 64 b, sum(case when (id // 64) % 2 = 0 then tf else -tf end)::double v from dtf group by all),
qb as (select query_id, id % 64 b, sum(case when (id // 64) % 2 = 0 then tf else -tf end)::double v from qtf group by all),
dn as (select d.doc_id chunk_id, coalesce(sqrt(sum(v * v)), 0) n from documents d left join db on db.chunk_id = d.doc_id group by all),
qn as (select query_id, sqrt(sum(v * v)) n from qb group by all),
dots as (select query_id, chunk_id, sum(d.v * q.v) dot from qb q join db d using (b) group by all),
dense_sc as (select qn.query_id, dn.chunk_id,
    round(case when qn.n > 0 and dn.n > 0 then coalesce(dot, 0) / qn.n / dn.n else 0 end, 6) score
  from qn cross join dn left join dots using (query_id, chunk_id)),
dense as (select * from (select *, row_number() over (partition by query_id order by score desc, chunk_id) rank
  from dense_sc) where rank <= {K}),
hyb_sc as (select query_id, chunk_id, round(sum(part), 6) score from (
    select query_id, chunk_id, 0.5 * (1 + score) / 2 part from dense
    union all select query_id, chunk_id, 0.5 * (0.5 + atan(score) / pi()) from sparse) group by all),
hybrid as (select * from (select *, row_number() over (partition by query_id order by score desc, chunk_id) rank
  from hyb_sc) where rank <= {K})"""
_BRANCHES = f"""with {_DOCS}, {_ASKED}, {_bm25_sql('bm', 'docs', 'asked')}, {_HASHED},
hits as (
  select query_id, chunk_id, rank, 'direct_hybrid' branch, 0 o, 0.5 w from hybrid
  union all select query_id, chunk_id, rank, 'hyde', 1, 0.3 from dense
  union all select query_id, chunk_id, rank, 'bm25', 2, 0.2 from bm),
fused as (select query_id, chunk_id, round(sum(w / (60 + rank)), 12) s,
    string_agg(branch, ',' order by branch) sources, count(*) n, min(branch) only_branch,
    max(case when branch = 'direct_hybrid' then rank end) direct_hybrid_rank,
    max(case when branch = 'hyde' then rank end) hyde_rank, max(case when branch = 'bm25' then rank end) bm25_rank,
    min(o * 1000 + rank) seen from hits group by all),
placed as (select *, row_number() over (partition by query_id order by s desc, seen, chunk_id) place from fused)"""
_FLAT = "query_id, chunk_id, round(s, 9) fusion_score, {} rrf_rank, sources, direct_hybrid_rank, hyde_rank, bm25_rank"
_SWAP = """
kinds as (select *, case when place <= {limit} and guard is not null then 0 when guard is not null then 1
    when place <= {limit} then 2 else 3 end kind from guarded),
turns as (select *, row_number() over (partition by query_id, kind order by case when kind = 1 then guard end, place) turn,
    count(case when kind = 2 then 1 end) over (partition by query_id) op,
    count(case when kind = 1 then 1 end) over (partition by query_id) wait from kinds),
kept as (select * from turns where kind = 0 or (kind = 1 and turn <= least(op, wait))
    or (kind = 2 and turn <= op - least(op, wait)))"""
_SCOPE = "scope as (select item_id query_id, 'src' || item_id doc_id from benchmark)"

ORACLES = {
    "bm25_topk": f"with {_DOCS}, {_ASKED}, {_bm25_sql('bm', 'docs', 'asked')} select query_id, chunk_id, score, rank from bm",
    "sparse_dot_topk": f"with {_DOCS}, {_HASHED} select query_id, chunk_id, score, rank from sparse",
    "dense_text_topk": f"with {_DOCS}, {_HASHED} select query_id, chunk_id, score, rank from dense",
    "hybrid_topk": f"with {_DOCS}, {_HASHED} select query_id, chunk_id, score, rank from hybrid",
    "dense_topk": f"""
with dims as (select vec_id, label, unnest(embedding)::double x, generate_subscripts(embedding, 1) i from embeddings),
means as (select label, i, round(avg(x), 9) x from dims group by all),
cn as (select label, sqrt(sum(x * x)) n from means group by all),
vn as (select vec_id, sqrt(sum(x * x)) n from dims group by all),
dots as (select m.label query_id, d.vec_id chunk_id, sum(m.x * d.x) dot from means m join dims d using (i) group by all),
sc as (select query_id, chunk_id, round(dot / cn.n / vn.n, 6) score from dots
  join cn on cn.label = query_id join vn on vn.vec_id = chunk_id)
select * from (select *, row_number() over (partition by query_id order by score desc, chunk_id) rank from sc) where rank <= {K}""",
    "rrf_weighted": f"{_BRANCHES} select {_FLAT.format('place')} from placed where place <= 16",
    "rrf_exclusive": f"""{_BRANCHES},
alone as (select query_id, chunk_id, s, row_number() over (
    partition by query_id, only_branch order by s desc, seen, chunk_id) turn from placed where n = 1),
guards as (select query_id, chunk_id, row_number() over (partition by query_id order by s desc, chunk_id) guard
  from alone where turn <= 2),
guarded as (select p.*, g.guard from placed p left join guards g using (query_id, chunk_id)), {_SWAP.format(limit=16)},
final as (select *, row_number() over (partition by query_id order by s desc, seen, chunk_id) r from kept)
select {_FLAT.format('r')} from final""",
    "rrf_multi_query": f"""
with {_DOCS},
texts as (select item_id * 2 query_id, text from benchmark union all select item_id * 2 + 1, split_part(text, chr(10), 1) from benchmark),
asked as (select distinct query_id, unnest({_WORDS.format('text')}) token from texts),
{_bm25_sql('bm', 'docs', 'asked')},
hits as (select query_id // 2 query_id, query_id % 2 variant, chunk_id, rank from bm),
fused as (select query_id, chunk_id, round(sum(1.0 / (60 + rank)), 12) s, min(variant * 1000 + rank) seen,
    max(case when variant = 0 then rank end) query_0_rank, max(case when variant = 1 then rank end) query_1_rank
  from hits group by all),
placed as (select *, row_number() over (partition by query_id order by s desc, seen, chunk_id) place from fused),
g0 as (select query_id, chunk_id, 0 guard from hits where variant = 0 and rank = 1),
g1 as (select query_id, arg_min(chunk_id, rank) chunk_id, 1 guard from hits h where variant = 1
  and not exists (select 1 from g0 where g0.query_id = h.query_id and g0.chunk_id = h.chunk_id) group by all),
guarded as (select p.*, g.guard from placed p left join (select * from g0 union all select * from g1) g using (query_id, chunk_id)),
{_SWAP.format(limit=K)},
final as (select *, row_number() over (partition by query_id order by s desc, seen, chunk_id) r from kept)
select query_id, chunk_id, round(s, 9) branch_fusion_score, r rank, query_0_rank, query_1_rank from final""",
    "scope_hard_fallback": f"""
with {_DOCS}, {_ASKED}, {_SCOPE}, {_bm25_sql('g', 'docs', 'asked')},
{_bm25_sql('h', 'docs', 'asked', where="exists (select 1 from scope s where s.query_id = q.query_id and s.doc_id = t.doc_id)")}
select query_id, chunk_id, score, rank, false route_fallback from h
union all select query_id, chunk_id, score, rank, true from g where query_id not in (select query_id from h)""",
    "scope_soft": f"""
with {_DOCS}, {_ASKED}, {_SCOPE}, {_bm25_sql('g', 'docs', 'asked')},
{_bm25_sql('h', 'docs', 'asked', where="exists (select 1 from scope s where s.query_id = q.query_id and s.doc_id = t.doc_id)")},
fused as (select query_id, chunk_id, round(sum(w / (60 + rank)), 12) s, min(o * 1000 + rank) seen,
    max(case when o = 0 then rank end) global_rank, max(case when o = 1 then rank end) soft_rank
  from (select *, 0 o, 1.0 w from g union all select *, 1, 0.35 from h) group by all),
placed as (select *, row_number() over (partition by query_id order by s desc, seen, chunk_id) rank from fused)
select query_id, chunk_id, round(s, 9) branch_fusion_score, rank, global_rank, soft_rank from placed where rank <= {K}""",
    "active_filter": f"""
with {_DOCS}, {_ASKED}, act as (select d.* from docs d left join labels l on l.doc_id = d.chunk_id where coalesce(l.quality = 1, true)),
{_bm25_sql('bm', 'act', 'asked')} select query_id, chunk_id, score, rank from bm""",
    "score_cliff": f"""
with {_DOCS}, {_ASKED}, {_bm25_sql('bm', 'docs', 'asked')},
scaled as (select query_id, chunk_id, round(score / max(score) over (partition by query_id), 6) score, rank from bm),
top as (select *, max(rank) over (partition by query_id) upper,
    score - lead(score) over (partition by query_id order by rank) gap from scaled where rank <= 5),
best as (select query_id, rank cut from (select *, row_number() over (partition by query_id order by gap desc, rank) rn
  from top where rank >= least(3, upper) and rank < upper and gap > 0.08) where rn = 1)
select query_id, chunk_id, score, t.rank from top t left join best b using (query_id) where t.rank <= coalesce(b.cut, upper)""",
}
