"""Registered context, rerank, routing and history queries with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.functions import ids
from marlstone.operators import conflict, context, history, rerank, routing
from marlstone.plans.search_queries import _ASKED, _DOCS, _WORDS, _bm25_sql, _variant_hits, bm25
from marlstone.plans.tables import chunks, questions, table
from marlstone.plans.text_queries import _WS, _name, _strip
from marlstone.session import materialize


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as chunks of one section per conversation."""
    said = table(spark, sf_dir, "conversations")
    return said.select(
        F.concat_ws("-", "conv_id", "turn").alias("chunk_id"), F.col("conv_id").cast("string").alias("doc_id"),
        F.concat(F.lit("conv_"), "conv_id").alias("section_id"), F.col("turn").cast("int").alias("section_chunk_index"),
        F.col("text").alias("content"), "role",
    )


def neighbor_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn with the turns right before and after it."""
    turns = _turns(spark, sf_dir)
    near = context.neighbours(turns.withColumn("anchor_id", F.col("chunk_id")), turns, 1)
    return near.select("anchor_id", "section_chunk_index", "chunk_id", F.length("content").alias("content_length"))


def expanded_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expanded text of every turn: itself, its conversation's name, then its neighbours."""
    turns = _turns(spark, sf_dir)
    anchors = turns.withColumn("anchor_id", F.col("chunk_id")).withColumn("parent_summary", F.col("section_id"))
    grown = context.expand(anchors, turns)
    return grown.select(
        "anchor_id", F.length("content").alias("n"), ids.sha256_hex(F.col("content")).alias("sha"),
        F.array_join("expanded_chunk_ids", ",").alias("ids"), "context_expanded",
    )


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = table(spark, sf_dir, "conversations")
    return said.select(F.col("conv_id").alias("session_id"), "role", "text", F.col("turn").alias("ts"))


def history_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = history.budgeted_history(_messages(spark, sf_dir), 600)
    return packed.select("session_id", "messages", F.length("history").alias("n"), ids.sha256_hex(F.col("history")).alias("sha"))


def recent_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    recent = history.recent_messages(_messages(spark, sf_dir), 3)
    return recent.select("session_id", "ts", "role", "rank", F.length("text").alias("n"))


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = history.transcript(_messages(spark, sf_dir), 4)
    return text.select("session_id", F.length("transcript").alias("n"), ids.sha256_hex(F.col("transcript")).alias("sha"))


def session_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions from turns: the first creates, users touch, assistants of even turns rename."""
    said = table(spark, sf_dir, "conversations")
    action = F.when(F.col("turn") == 0, "create").when(F.col("role") == "user", "touch").otherwise("rename")
    events = said.select(
        F.col("conv_id").alias("session_id"), F.when(F.col("turn") == 3, "guest").otherwise("owner").alias("owner_id"),
        action.alias("action"), F.when(F.col("turn") == 0, "").otherwise(F.col("text")).alias("text"), F.col("turn").alias("ts"),
    )
    return history.session_state(events)


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 hits with their documents' fields, as fused candidates."""
    docs = chunks(spark, sf_dir).select(
        "chunk_id", F.col("doc_id").alias("canonical_title"), F.col("lang").alias("section_path"), "content"
    )
    # Stored hits have a known size, from which Spark chooses the join.
    return docs.join(materialize(bm25(spark, sf_dir), "hits"), "chunk_id")


def answer_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed answer context of the best five documents of each question."""
    docs = _found(spark, sf_dir).where("rank <= 5").select(
        "query_id", F.col("rank").alias("pos"), "chunk_id", "canonical_title", "section_path", "content",
        F.lit("local").alias("source"), F.col("score").alias("rerank_score"),
    )
    packed = context.pack_answer_context(docs, 6000)
    return packed.select("query_id", F.length("context").alias("n"), ids.sha256_hex(F.col("context")).alias("sha"), F.array_join("context_chunk_ids", ",").alias("ids"))


def evaluation_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _found(spark, sf_dir).where("rank <= 8").select(
        "query_id", F.col("rank").alias("pos"), "chunk_id", "canonical_title", "section_path", "content", F.col("score").alias("rerank_score"),
    )
    packed = context.pack_evaluation_evidence(docs)
    return packed.select("query_id", F.length("evidence").alias("n"), ids.sha256_hex(F.col("evidence")).alias("sha"))


def round_robin_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence of two search texts per question, taken in turn."""
    groups = _variant_hits(spark, sf_dir).withColumnRenamed("variant", "sub_q").withColumn("rerank_score", 1.0 / F.col("rank"))
    merged = context.merge_evidence_groups(groups)
    return merged.select("query_id", "chunk_id", "pos", F.array_join(F.transform("retrieved_for_subquestions", lambda i: i.cast("string")), ",").alias("owners"))


def grouped_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shared packing of the merged evidence of two search texts per question."""
    groups = _variant_hits(spark, sf_dir).where("rank <= 3").withColumnRenamed("variant", "sub_q").withColumn("rerank_score", 1.0 / F.col("rank"))
    merged = context.merge_evidence_groups(groups)
    docs = chunks(spark, sf_dir).select("chunk_id", F.col("doc_id").alias("canonical_title"), F.col("lang").alias("section_path"), "content")
    packed = context.pack_grouped_evidence(docs.join(materialize(merged, "merged"), "chunk_id"), 4000, 2500)
    return packed.select("query_id", F.length("evidence").alias("n"), F.array_join("chunk_ids", ",").alias("ids"))


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fused candidates of each question with the ranks its two search texts gave them."""
    hits = _variant_hits(spark, sf_dir)
    asked = questions(spark, sf_dir).select(
        "query_id", F.col("text").alias("query_text"), F.array("text", F.split("text", "\n")[0]).alias("retrieval_queries")
    )
    fused = hits.groupBy("query_id", "chunk_id").agg(
        F.min("rank").alias("best"),
        F.map_from_entries(
            F.collect_list(F.struct(F.concat(F.lit("query_"), "variant"), F.create_map(F.lit("bm25"), F.col("rank"))))
        ).alias("subquery_ranks"),
    )
    order = Window.partitionBy("query_id").orderBy("best", "chunk_id")
    fused = fused.withColumn("rrf_rank", F.row_number().over(order)).drop("best")
    docs = chunks(spark, sf_dir).select("chunk_id", F.col("doc_id").alias("canonical_title"), "content", F.lit("").alias("title"))
    return docs.join(materialize(fused, "fused"), "chunk_id").join(asked, "query_id")


def rerank_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blended full and focused scores with the term-overlap scorer."""
    ranked = rerank.rerank(_candidates(spark, sf_dir))
    return ranked.select("query_id", "chunk_id", "rrf_rank", "full_query_score", "focused_score", "rerank_score", "model_rank")


def _sub_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two lines of a question, or the whole when it has one."""
    lines = F.slice(F.split("text", "\n"), 1, 2)
    return questions(spark, sf_dir).select("query_id", F.posexplode(lines).alias("sub_q", "question"))


def coverage_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = materialize(rerank.rerank(_candidates(spark, sf_dir)), "ranked")
    scores = rerank.coverage_scores(rerank.coverage_pool(ranked), _sub_questions(spark, sf_dir))
    return rerank.best_per_subquestion(scores)


def coverage_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = materialize(rerank.rerank(_candidates(spark, sf_dir)), "ranked")
    chosen = rerank.select_with_coverage(ranked, _sub_questions(spark, sf_dir))
    return chosen.select("query_id", "chunk_id", "place", "coverage_protected", "model_rank")


def conflict_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs to arbitrate between the best three of each reranking and the rest."""
    ranked = materialize(rerank.rerank(_candidates(spark, sf_dir)), "ranked")
    selected = ranked.where("model_rank <= 3").select(
        "query_id", "chunk_id", F.col("model_rank").alias("place"), "rerank_score",
        F.lit(False).alias("coverage_protected"), F.lit(False).alias("conflict_judge_promoted"),
    )
    pairs = conflict.conflict_pairs(selected, ranked)
    return pairs.select("query_id", "pair_id", "candidate_chunk_id", "candidate_rrf_rank", "victim_chunk_id", "victim_place")


def _registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents named by the first two words of their text."""
    docs = table(spark, sf_dir, "documents")
    words = F.slice(F.split("text", r"[ \n]"), 1, 2)
    return docs.select(
        F.concat(F.lit("doc_"), "doc_id").alias("doc_id"), F.array_join(words, " ").alias("canonical_title"),
        F.array(words[0]).alias("aliases"), F.array().cast("array<string>").alias("model_codes"),
    )


def alias_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registry names contained in each question, longest ones only."""
    names = routing.registry_names(_registry(spark, sf_dir))
    found = routing.contained_names(questions(spark, sf_dir), names)
    return found.select("query_id", "name_key", "doc_id", "group_key")


def deterministic_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = routing.deterministic_matches(questions(spark, sf_dir), _registry(spark, sf_dir))
    return found.select("query_id", "doc_id", "soft")


def logical_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = _registry(spark, sf_dir).select(routing.group_key().alias("group_key"), "doc_id")
    return grouped.groupBy("group_key").agg(F.count(F.lit(1)).alias("documents"), F.min("doc_id").alias("first_doc"))


# Wording of several languages standing in for the default patterns.
_KINDS = (("multi_hop", "(?:que|that).*(?:est|then)"), ("comparison", "avec|with|mit|con"), ("multi_fact", "and|und|et"))
_DEMAND = "the|les|der|los"


def router_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kind of every user turn under patterns of its languages."""
    said = table(spark, sf_dir, "conversations").where("role = 'user'")
    return said.select("conv_id", "turn", routing.complexity(F.col("text"), _KINDS, _DEMAND).alias("kind"))


QUERIES = {
    "neighbor_expand": neighbor_expand,
    "expanded_text": expanded_text,
    "history_window": history_window,
    "recent_messages": recent_messages,
    "transcript": transcripts,
    "session_state": session_states,
    "answer_context": answer_context,
    "evaluation_evidence": evaluation_evidence,
    "round_robin_evidence": round_robin_evidence,
    "grouped_evidence": grouped_evidence,
    "rerank_blend": rerank_blend,
    "coverage_argmax": coverage_argmax,
    "coverage_selection": coverage_selection,
    "conflict_pairs": conflict_candidates,
    "alias_containment": alias_containment,
    "deterministic_route": deterministic_route,
    "logical_groups": logical_groups,
    "router_class": router_class,
}

# ---------------------------------------------------------------- SQL twins

_TURNS = "turns as (select conv_id || '-' || turn chunk_id, 'conv_' || conv_id sec, turn, text from conversations)"


def _packed(order_by: str, header: str, limit: int, budget: int, per_doc: int) -> str:
    """Sequential packing as a recursive query over docs(query_id, place, chunk_id, content, doc, sec)."""
    return f"""
docs5 as (select b.query_id, row_number() over (partition by b.query_id order by {order_by}) place, chunk_id,
  {_strip('d.text')} content, d.source doc, d.lang sec from bm b join documents d on d.doc_id = b.chunk_id where b.rank <= {limit}),
pack as (
  select query_id, 0::bigint place, '' body, '' ids, 0 n, false done from (select distinct query_id from docs5)
  union all
  select p.query_id, d.place,
    case when p.done or h.room <= 0 then p.body else p.body || h.gap || h.head || substr(d.content, 1, least(h.room, {per_doc})) end,
    case when p.done or h.room <= 0 then p.ids else p.ids || case when p.n > 0 then ',' else '' end || d.chunk_id end,
    case when p.done or h.room <= 0 then p.n else p.n + 1 end, p.done or h.room <= 0
  from pack p join docs5 d on d.query_id = p.query_id and d.place = p.place + 1,
  lateral (select case when p.n > 0 then chr(10) || chr(10) else '' end gap, {header} head) g,
  lateral (select g.gap gap, g.head head, {budget} - length(p.body) - length(g.gap) - length(g.head) room) h),
packed as (select query_id, arg_max(body, place) body, arg_max(ids, place) ids from pack group by query_id)"""


_ANSWER_HEAD = (
    "'【资料' || (p.n + 1) || '】' || chr(10) || '来源：本地知识库' || chr(10) || '文档：' || d.doc || chr(10) || '章节：' || d.sec || chr(10)"
    " || '命中标题：未命名资料' || chr(10) || '切片ID：[' || d.chunk_id || ']' || chr(10) || '正文：' || chr(10)"
)
_EVIDENCE_HEAD = "'【证据' || (p.n + 1) || '】' || chr(10) || '文档：' || d.doc || chr(10) || '章节：' || d.sec || chr(10) || '正文：'"
_VARIANTS = f"""{_DOCS},
texts as (select item_id * 2 query_id, text from benchmark union all select item_id * 2 + 1, split_part(text, chr(10), 1) from benchmark),
asked as (select distinct query_id, unnest({_WORDS.format('text')}) token from texts),
{_bm25_sql('bm', 'docs', 'asked')},
vhits as (select query_id // 2 query_id, query_id % 2 variant, chunk_id, rank from bm)"""
_OVERLAP = "round((h + 0.5) / (n + 1.0), 6)"
_RERANK = f"""{_VARIANTS},
fused as (select query_id, chunk_id, max(case when variant = 1 then rank end) r1,
  row_number() over (partition by query_id order by min(rank), chunk_id) rrf_rank from vhits group by query_id, chunk_id),
qtexts as (select item_id query_id, 'full' k, text from benchmark union all select item_id, 'focused', split_part(text, chr(10), 1) from benchmark
  union all select item_id, 'sub0', split_part(text, chr(10), 1) from benchmark
  union all select item_id, 'sub1', split_part(text, chr(10), 2) from benchmark where contains(text, chr(10))),
qtok as (select distinct query_id, k, unnest({_WORDS.format('text')}) token from qtexts),
qn as (select t.query_id, t.k, count(token) n from qtexts t left join qtok using (query_id, k) group by all),
dtok as (select distinct chunk_id, unnest(list_concat({_WORDS.format('text')}, {_WORDS.format('source')})) token
  from (select doc_id chunk_id, text, source from documents where doc_id in (select chunk_id from fused))),
hit as (select f.query_id, f.chunk_id, q.k, count(*) h from fused f join qtok q using (query_id) join dtok d on d.chunk_id = f.chunk_id and d.token = q.token group by all),
sc as (select f.query_id, f.chunk_id, q.k, (coalesce(h, 0) + 0.5) / (n + 1.0) s from fused f join qn q using (query_id)
  left join hit using (query_id, chunk_id, k)),
wide as (select f.*, max(case when k = 'full' then s end) fs,
  max(case when k = 'focused' and r1 is not null and rrf_rank <= 8
    and regexp_replace(lower(b.text), '\\s+', '', 'g') <> regexp_replace(lower(split_part(b.text, chr(10), 1)), '\\s+', '', 'g')
    and {_strip("split_part(b.text, chr(10), 1)")} <> '' then s end) os
  from fused f join sc using (query_id, chunk_id) join benchmark b on b.item_id = f.query_id group by all),
scored as (select query_id, chunk_id, rrf_rank, round(fs, 6) full_query_score, round(os, 6) focused_score,
  round(case when os is null then fs else 0.4 * fs + 0.6 * os end, 6) rerank_score from wide),
ranked as (select *, row_number() over (partition by query_id order by rerank_score desc, rrf_rank, chunk_id) model_rank from scored),
pool as (select *, row_number() over (partition by query_id order by case when rrf_rank <= 5 then 0 else 1 end,
  case when rrf_rank <= 5 then rrf_rank else model_rank end) pool_pos from ranked),
subs as (select query_id, case when k = 'sub0' then 0 else 1 end sub_q, k, text from qtexts where k like 'sub%'),
cov as (select p.query_id, p.chunk_id, pool_pos, sub_q, round(case
    when regexp_replace(lower(u.text), '\\s+', '', 'g') = regexp_replace(lower(b.text), '\\s+', '', 'g') then p.full_query_score
    when p.focused_score is not null and sub_q = 0 then p.focused_score else s.s end, 6) score
  from pool p join subs u using (query_id) join benchmark b on b.item_id = p.query_id join sc s on s.query_id = p.query_id and s.chunk_id = p.chunk_id and s.k = u.k
  where pool_pos <= 6),
best as (select query_id, sub_q, chunk_id, score, score < 0.1 missing from
  (select *, row_number() over (partition by query_id, sub_q order by score desc, pool_pos) rn from cov) where rn = 1)"""
_REGISTRY = f"""
reg as (select 'doc_' || doc_id doc_id, array_to_string(string_split_regex(text, '[ \\n]')[1:2], ' ') title, string_split_regex(text, '[ \\n]')[1] alias from documents),
names as (select doc_id, {_name('title')} k, true canonical, {_name('title')} gk from reg union all select doc_id, {_name('alias')}, false, {_name('title')} from reg),
named as (select n.doc_id, n.k, n.canonical, case when n.gk <> '' then n.gk else n.doc_id end gk,
  regexp_matches(case when canonical then r.title else r.alias end, '[A-Za-z0-9_-]*[A-Za-z][A-Za-z0-9_-]*[0-9]|[A-Za-z0-9_-]*[0-9][A-Za-z0-9_-]*[A-Za-z]') coded
  from names n join reg r using (doc_id) where k <> ''),
hits as (select distinct b.item_id query_id, n.k name_key, n.doc_id, n.gk group_key from benchmark b join named n
  on length(n.k) >= 4 and contains({_name('b.text')}, n.k)
  where (n.canonical and length(n.k) >= 6) or length(n.k) >= 12 or n.coded),
strong as (select h.* from hits h where not exists (select 1 from hits l where l.query_id = h.query_id and l.name_key <> h.name_key and contains(l.name_key, h.name_key))
  or length(h.name_key) = (select max(length(l.name_key)) from hits l where l.query_id = h.query_id))"""

ORACLES = {
    "neighbor_expand": f"""with {_TURNS} select a.chunk_id anchor_id, n.turn::int section_chunk_index, n.chunk_id, length(n.text) content_length
from turns a join turns n on a.sec = n.sec and n.turn between a.turn - 1 and a.turn + 1""",
    "expanded_text": f"""with {_TURNS},
blocks as (
  select chunk_id anchor_id, 0 o, '【命中切片】' || chr(10) || {_strip('text')} t, null id from turns where {_strip('text')} <> ''
  union all select chunk_id, 1, '【父块摘要】' || chr(10) || sec, null from turns
  union all select a.chunk_id, 2, '【前文】' || chr(10) || {_strip('n.text')}, n.chunk_id from turns a join turns n on a.sec = n.sec and n.turn = a.turn - 1
  union all select a.chunk_id, 3, '【后文】' || chr(10) || {_strip('n.text')}, n.chunk_id from turns a join turns n on a.sec = n.sec and n.turn = a.turn + 1),
placed as (select *, coalesce(sum(length(t) + 2) over (partition by anchor_id order by o rows between unbounded preceding and 1 preceding), 0) start from blocks),
text as (select anchor_id, string_agg(substr(t, 1, (4000 - start)::int), chr(10) || chr(10) order by o) c from placed where start < 4000 group by anchor_id),
idl as (select anchor_id, anchor_id || coalesce(string_agg(',' || id, '' order by o), '') ids, count(id) > 0 grown from blocks group by anchor_id)
select anchor_id, length(c) n, sha256(c) sha, ids, grown context_expanded from text join idl using (anchor_id)""",
    "history_window": f"""
with l as (select conv_id, turn, case role when 'user' then '用户' else '助手' end || '：' || {_strip('text')} line
  from conversations where role in ('user', 'assistant') and {_strip('text')} <> ''),
p as (select *, 600 - coalesce(sum(length(line) + 1) over (partition by conv_id order by turn desc rows between unbounded preceding and 1 preceding), 0) room from l)
select conv_id session_id, count(*) messages, length(string_agg(substr(line, 1, room::int), chr(10) order by turn)) n,
  sha256(string_agg(substr(line, 1, room::int), chr(10) order by turn)) sha from p where room > 0 group by conv_id""",
    "recent_messages": """select conv_id session_id, turn ts, role, rank, length(text) n from
  (select *, row_number() over (partition by conv_id order by turn desc) rank from conversations) where rank <= 3""",
    "transcript": f"""with r as (select *, row_number() over (partition by conv_id order by turn desc) rank from conversations),
l as (select conv_id, turn, role || ': ' || {_strip('text')} line from r where rank <= 4 and {_strip('text')} <> '')
select conv_id session_id, length(string_agg(line, chr(10) order by turn)) n, sha256(string_agg(line, chr(10) order by turn)) sha from l group by conv_id""",
    "session_state": f"""
with e as (select conv_id, turn, case when turn = 3 then 'guest' else 'owner' end o,
  case when turn = 0 then 'create' when role = 'user' then 'touch' else 'rename' end a,
  case when turn = 0 then '' else trim(regexp_replace(text, '[{_WS}]+', ' ', 'g')) end s from conversations),
g as (select conv_id, arg_min(o, turn) filter (where a = 'create') owner_id, min(turn) filter (where a = 'create') c,
  arg_min(s, turn) filter (where a = 'touch' and s <> '') first_said, arg_max(s, turn) filter (where a = 'touch') last_said,
  max(turn) filter (where a = 'touch') used, arg_max(s, turn) filter (where a = 'rename' and s <> '' and o = 'owner') named,
  max(turn) filter (where a = 'rename' and s <> '' and o = 'owner') renamed from e group by conv_id)
select conv_id session_id, owner_id, coalesce(named, case when length(first_said) <= 20 then first_said else substr(first_said, 1, 20) || '…' end, '新会话') title,
  c created_at, greatest(c, coalesce(used, c), coalesce(renamed, c)) updated_at, coalesce(last_said, '') last_message from g where c is not null""",
    "answer_context": f"""with recursive {_DOCS}, {_ASKED}, {_bm25_sql('bm', 'docs', 'asked')}, {_packed('b.score desc, b.rank', _ANSWER_HEAD, 5, 6000, 2500)}
select query_id, length(body) n, sha256(body) sha, ids from packed""",
    "evaluation_evidence": f"""with recursive {_DOCS}, {_ASKED}, {_bm25_sql('bm', 'docs', 'asked')}, {_packed('b.score desc, b.rank', _EVIDENCE_HEAD, 8, 8000, 1500)}
select query_id, length(body) n, sha256(body) sha from packed""",
    "round_robin_evidence": f"""with {_VARIANTS}
select query_id, chunk_id, row_number() over (partition by query_id order by min(rank * 10 + variant), chunk_id) pos,
  string_agg(variant::varchar, ',' order by rank, variant) owners from vhits group by query_id, chunk_id""",
    "rerank_blend": f"with {_RERANK} select query_id, chunk_id, rrf_rank, full_query_score, focused_score, rerank_score, model_rank from ranked",
    "coverage_argmax": f"with {_RERANK} select query_id, sub_q, chunk_id, score, missing from best",
    "coverage_selection": f"""with {_RERANK},
prot as (select distinct query_id, chunk_id from best where not missing),
marked as (select r.*, p.chunk_id is not null coverage_protected from ranked r left join prot p using (query_id, chunk_id)),
placed as (select *, row_number() over (partition by query_id order by coverage_protected desc, case when coverage_protected then rerank_score end desc nulls last, model_rank) place from marked)
select query_id, chunk_id, place, coverage_protected, model_rank from placed where place <= 5""",
    "conflict_pairs": f"""with {_RERANK},
losers as (select query_id, chunk_id, rrf_rank, row_number() over (partition by query_id order by rrf_rank, model_rank) n
  from ranked where model_rank > 3 and rrf_rank <= 5),
victims as (select query_id, chunk_id, model_rank place, row_number() over (partition by query_id order by rerank_score, model_rank) n from ranked where model_rank <= 3)
select query_id, 'pair_' || n pair_id, l.chunk_id candidate_chunk_id, l.rrf_rank candidate_rrf_rank, v.chunk_id victim_chunk_id, v.place victim_place
from losers l join victims v using (query_id, n) where n <= 2""",
    "alias_containment": f"with {_REGISTRY} select query_id, name_key, doc_id, group_key from strong",
    "deterministic_route": f"""with {_REGISTRY},
f as (select query_id, count(distinct group_key) > count(distinct name_key) soft from strong group by query_id)
select distinct query_id, doc_id, soft from strong join f using (query_id)""",
    "logical_groups": f"""with {_REGISTRY}
select case when {_name('title')} <> '' then {_name('title')} else doc_id end group_key, count(*) documents, min(doc_id) first_doc from reg group by 1""",
    "router_class": """select conv_id, turn, case when regexp_matches(text, '(?i)(?:que|that).*(?:est|then)') then 'multi_hop'
  when regexp_matches(text, '(?i)avec|with|mit|con') then 'comparison' when regexp_matches(text, '(?i)and|und|et') then 'multi_fact'
  when len(regexp_extract_all(text, '(?i)the|les|der|los')) >= 2 then 'multi_fact' else 'simple_query' end kind
from conversations where role = 'user'""",
}
