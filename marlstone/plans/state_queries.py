"""Registered version, claim, migration, evaluation, agent and progress queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.config import QuerySettings
from marlstone.functions import ids
from marlstone.functions.text import collapse_spaces
from marlstone.models import embed
from marlstone.operators import agent, evaluate, lexical, rerank, vectors, versions
from marlstone.plans.search_queries import _ASKED, _DOCS, _HASHED, _WORDS, _bm25_sql, bm25, sparse_dot
from marlstone.plans.tables import chunks, questions, table
from marlstone.plans.text_queries import _name, _strip
from marlstone.session import materialize, spread
from marlstone.streaming import progress

# A fixed moment for lease decisions over the given events.
NOW = "2024-01-15 12:00:00"


def _uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as uploads in order of id; equal texts are the same file."""
    return table(spark, sf_dir, "documents").select(
        ids.sha256_hex(F.col("text")).alias("source_hash"), F.concat(F.lit("task_"), "doc_id").alias("task_id"),
        F.concat_ws(".", "source", "lang").alias("file_name"), F.col("doc_id").alias("uploaded_at"),
    )


def claim_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.first_claims(_uploads(spark, sf_dir))


def claim_takeover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uploads claimed against earlier imports whose state comes from the labels.

    Bad quality failed, toxic ones are processing with a lease that ended or not by length.
    """
    now = F.lit(NOW).cast("timestamp")
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    status = F.when(F.col("quality") == 0, "failed").when(F.col("toxic") == 1, "processing").otherwise("completed")
    lease = F.when(F.col("n_chars") > 1000, now + F.expr("interval 1 hour")).otherwise(now)
    first = docs.groupBy(ids.sha256_hex(F.col("text")).alias("source_hash")).agg(
        F.min(F.struct("doc_id", status.alias("status"), lease.alias("lease"))).alias("d")
    )
    registry = first.select(
        "source_hash", F.concat(F.lit("old_"), "d.doc_id").alias("task_id"), F.lit("old").alias("file_name"), F.col("d.status").alias("status"),
        F.col("d.lease").alias("lease_until"), F.lit(1).alias("attempt"), F.lit("").alias("requested_logical_document_id"),
        ids.version_id(F.col("source_hash")).alias("version_id"), F.lit("").alias("error"),
    )
    claimed = versions.claim(registry, _uploads(spark, sf_dir), now)
    return claimed.select("source_hash", "task_id", "status", "attempt", "version_id", "acquired")


def _publishes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as publishes: users are documents, each event one version."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("logical_document_id"), F.concat_ws("_", F.lit("ver"), "event_type", "props").alias("version_id"),
        F.concat(F.lit("doc_"), "event_id").alias("doc_id"), F.col("event_type").alias("source_hash"), F.col("ts").alias("published_at"),
    )


def latest_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    active = versions.active_versions(_publishes(spark, sf_dir))
    return active.select("logical_document_id", "version_id", "doc_id", "source_hash")


def version_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State of every distinct version, where only purchases and signups were published."""
    log = _publishes(spark, sf_dir)
    documents = log.select("logical_document_id", "version_id").distinct().withColumn("version_status", F.lit("")).withColumn("is_active", F.lit(False))
    return versions.version_states(log.where(F.col("source_hash").isin("purchase", "signup")), documents)


def version_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents against a copy where bad ones are gone and toxic ones changed."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    marked = docs.join(table(spark, sf_dir, "labels"), "doc_id", "left")
    after = marked.where("quality is null or quality = 1").select(
        "doc_id", F.when(F.col("toxic") == 1, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("text"), "lang"
    )
    return versions.changed_rows(docs, after, "doc_id")


def orphan_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.orphans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents sharing a first line, each with a signature over its lines."""
    docs = spread(table(spark, sf_dir, "documents"), "doc_id")
    lines = F.split("text", "\n")
    logical = ids.logical_id(F.col("first"), F.lit(""))["logical_document_id"]
    documents = docs.select("doc_id", F.substring_index("text", "\n", 1).alias("first")).select("doc_id", logical.alias("logical_document_id"))
    pieces = docs.select("doc_id", F.col("lang").alias("title"), F.explode(lines).alias("content"))
    found = versions.duplicate_groups(documents, pieces)
    return found.groupBy("logical_document_id").agg(
        F.count(F.lit(1)).alias("documents"), F.count_distinct("chunk_signature").alias("contents"), F.sum("chunks").alias("chunks")
    )


def migration_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Version fields of documents titled by their first line; labelled good ones are chosen."""
    docs = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("doc_"), "doc_id").alias("doc_id"), F.split("text", "\n")[0].alias("canonical_title"),
        ids.sha256_hex(F.col("text")).alias("content_hash"), F.lit("").alias("source_hash"), F.lit(None).cast("string").alias("version_id"),
    )
    good = table(spark, sf_dir, "labels").where("quality = 1").select(F.concat(F.lit("doc_"), "doc_id").alias("doc_id"))
    logical = ids.logical_id(F.col("canonical_title"), F.col("content_hash"))["logical_document_id"]
    chosen = docs.join(good, "doc_id", "left_semi").groupBy(logical.alias("logical_document_id")).agg(F.min("doc_id").alias("doc_id"))
    return versions.migration_plan(docs, chosen)


def active_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").select((F.col("quality") == 1).alias("is_active"))
    return versions.collection_counts(rows)


def keyed_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents rewritten over all documents by key."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    incoming = docs.join(table(spark, sf_dir, "labels"), "doc_id").select("doc_id", F.upper("lang").alias("lang"), (F.col("n_chars") * 2).alias("n_chars"))
    return versions.upsert(docs, incoming, "doc_id")


def partial_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    changes = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("string").alias("lang"))
    return versions.partial_update(docs, changes, "doc_id")


def token_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = lexical.token_statistics(lexical.term_index(chunks(spark, sf_dir)))
    return stats.where("token <> ''")


def merge_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second-round BM25 evidence over first-round sparse evidence."""
    first = sparse_dot(spark, sf_dir).select("query_id", "chunk_id", "rank")
    second = bm25(spark, sf_dir).select("query_id", "chunk_id", "rank")
    return rerank.merge_pools(first, second, 2)


def valid_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Given vectors with the sparse vector of their document's text, checked for a write."""
    given = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").cast("array<double>").alias("dense"))
    texts = embed(chunks(spark, sf_dir), "content", ["chunk_id"]).select("chunk_id", "sparse")
    rows = given.join(texts, "chunk_id").withColumn("content", F.col("chunk_id").cast("string"))
    return vectors.valid_rows(rows, 64).select("chunk_id", F.size("dense").alias("dim"), F.cardinality("sparse").alias("terms"))


# ------------------------------------------------------------------ evaluation


def _criteria(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two criteria per question: the whole passage, and either its first or its last line."""
    asked = questions(spark, sf_dir)
    lines = F.split("text", "\n")
    option = lambda criterion, n, term: F.struct(
        F.lit(criterion).alias("criterion"), F.lit(n).alias("option"), F.lit(None).cast("string").alias("title_contains"),
        F.array(term).alias("content_contains_all"),
    )
    each = F.array(option(0, 0, F.col("text")), option(1, 0, lines[0]), option(1, 1, F.element_at(lines, -1)))
    return asked.select(F.col("query_id").alias("case_id"), F.inline(each))


def _metrics(spark: SparkSession, sf_dir: str, hits: DataFrame) -> DataFrame:
    docs = chunks(spark, sf_dir).select("chunk_id", F.col("doc_id").alias("title"), "content")
    found = materialize(hits.select(F.col("query_id").alias("case_id"), "chunk_id", "rank"), "hits")
    ranked = docs.join(found, "chunk_id")
    criteria = _criteria(spark, sf_dir)
    met = evaluate.criterion_hits(ranked, criteria)
    cases = questions(spark, sf_dir).select(F.col("query_id").alias("case_id"))
    return evaluate.rank_metrics(cases, met, criteria, 5)


def rank_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metrics(spark, sf_dir, bm25(spark, sf_dir))


def stage_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean metrics of two searches as stages."""
    keyword = _metrics(spark, sf_dir, bm25(spark, sf_dir)).withColumn("stage", F.lit("bm25"))
    sparse = _metrics(spark, sf_dir, sparse_dot(spark, sf_dir)).withColumn("stage", F.lit("sparse"))
    return evaluate.summarize_stages(keyword.unionByName(sparse))


def category_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answer metrics per language, from labels as judgments of documents."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    rows = docs.select(
        F.col("lang").alias("category"), F.col("text").alias("answer"), F.when(F.col("toxic") == 1, "toxic").alias("error"),
        F.col("quality").isNotNull().alias("judged"), F.col("quality").cast("double").alias("correctness"),
        F.col("toxic").cast("double").alias("completeness"), F.when(F.col("quality") == 1, F.col("toxic").cast("double")).alias("faithfulness"),
    )
    return evaluate.answer_summary(rows, "category")


def reference_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as judged answers: long lines are covered facts, lines with a comma claims."""
    lines = F.split("text", "\n")
    judged = spread(table(spark, sf_dir, "documents"), "doc_id").select(
        "doc_id", F.transform(lines, lambda t: F.struct((F.length(t) > 80).alias("covered"))).alias("reference_facts"),
        F.filter(lines, lambda t: t.contains(",")).alias("contradictions"), (F.col("lang") == "en").alias("answerable"),
        (F.col("n_chars") > 500).alias("refusal_correct"),
    )
    scored = evaluate.reference_scores(judged)
    return scored.select("doc_id", F.round("correctness", 9).alias("correctness"), F.round("completeness", 9).alias("completeness"), "contradictory_claims")


def faithfulness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best-matching documents as contexts, the question's lines as quoted claims."""
    asked = questions(spark, sf_dir).select(
        "query_id", F.transform(F.split("text", "\n"), lambda t: F.struct(F.lit(True).alias("supported"), t.alias("evidence_quote"))).alias("claims")
    )
    docs = chunks(spark, sf_dir).select("chunk_id", F.col("content").alias("context"))
    best = materialize(bm25(spark, sf_dir).where("rank = 1").select("query_id", "chunk_id"), "best")
    scored = evaluate.faithfulness(docs.join(best, "chunk_id").join(asked, "query_id"))
    return scored.select("query_id", "supported_claims", "total_claims", F.round("faithfulness", 9).alias("faithfulness"))


def round_robin_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hundred documents dealt from their sources in turn."""
    cases = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("document_id"), F.col("doc_id").alias("pos"))
    return evaluate.round_robin_sample(cases, 100).select("doc_id", "document_id", "turn")


def document_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents' first words also open a question or a conversation turn."""
    first = lambda c: F.split(c, r"[ \n]")[0]
    documents = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), first("text").alias("canonical_title"), F.array("source").alias("aliases")
    )
    said = table(spark, sf_dir, "conversations").select(first("text").alias("name"))
    return evaluate.document_coverage(documents, said.unionByName(table(spark, sf_dir, "benchmark").select(first("text").alias("name"))))


def dataset_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as evaluation cases of conversations, labelled documents as known documents."""
    cases = table(spark, sf_dir, "conversations").select(
        F.concat_ws("-", "conv_id", "role").alias("id"), F.col("conv_id").alias("document_id"), collapse_spaces(F.col("text")).alias("query"),
        F.when(F.col("turn") > 0, F.array("role")).alias("relevance"), (F.col("role") == "user").alias("expected_answerable"),
        (F.col("role") == "assistant").alias("judge_answer"), F.when(F.col("turn") == 1, "known").alias("reference_answer"),
    )
    documents = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"))
    return evaluate.dataset_problems(cases, documents).groupBy("item", "problem").agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------ agent and progress


def schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operations for conversations as questions and turns as tasks under the call budget."""
    said = table(spark, sf_dir, "conversations")
    tasks = said.select(
        F.col("conv_id").alias("query_id"), F.col("turn").cast("int").alias("task_order"), F.col("turn").cast("int").alias("subquestion_index"),
        F.split("text", "\n").alias("search_queries"), F.array(F.lit("vector"), F.lit("bm25"), F.lit("hyde")).alias("retrieval_tools"),
        F.lit(0).alias("calls_used"), F.when(F.col("conv_id") % 3 == 0, 2).otherwise(1).alias("cost"),
    )
    chosen = agent.schedule(tasks, QuerySettings(bm25_enabled=True, agent_hyde_enabled=True, agent_max_tool_calls=7))
    return chosen.select("query_id", "sub_q", "tool", ids.sha256_hex(F.col("query")).alias("query_sha"), "request_budget", "turn")


def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as loop states of one question each."""
    k = F.get_json_object("props", "$.k").cast("int")
    action = F.when(F.col("event_type") == "error", "ask_user").when(F.col("event_type") == "signup", "expand_scope").when(
        F.col("event_type") == "purchase", "answer"
    ).otherwise("rewrite_missing")
    return table(spark, sf_dir, "events").select("event_id", "user_id", "value", k.alias("k"), action.alias("next_action"))


def stop_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = _states(spark, sf_dir).select(
        "event_id", (F.col("k") < 5).alias("evaluator_failed"), (F.col("k") > 90).alias("evidence_sufficient"), "next_action",
        (F.col("k") % 3).alias("iteration"), (F.col("k") % 8).alias("calls_used"), F.lit(1).alias("next_cost"),
        F.col("value").alias("elapsed_seconds"), (F.col("k") % 2).alias("new_evidence"), (F.col("k") % 5 == 0).alias("pending"),
    )
    return state.select("event_id", agent.stop_reason(QuerySettings(agent_max_iterations=3)).alias("reason"))


def scope_widening(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = _states(spark, sf_dir)
    mode = F.when(F.col("k") % 3 == 0, "hard").when(F.col("k") % 3 == 1, "soft").otherwise("global")
    named = F.array(F.concat(F.lit("doc"), "user_id"))
    rows = state.withColumn("mode", mode).withColumn("locked", F.col("k") > 70).withColumn(
        "hard_ids", F.when(mode == "hard", named).otherwise(F.array().cast("array<string>"))
    ).withColumn("soft_ids", F.when(mode == "soft", named).otherwise(F.array().cast("array<string>"))).withColumn(
        "candidate_ids", F.array(F.concat(F.lit("cand"), "k"))
    )
    wide = agent.widen_scope(rows)
    return wide.select("event_id", "mode", "scope_reason", F.array_join("hard_ids", ",").alias("hard"), F.array_join("soft_ids", ",").alias("soft"))


def coverage_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three sub-questions per state, the last depending on the first."""
    state = _states(spark, sf_dir)
    tasks = F.array(
        *[
            F.struct(
                F.lit(i).alias("subquestion_index"), F.array(F.lit("q")).alias("search_queries"), F.array(F.lit("vector")).alias("retrieval_tools"),
                F.array(*[F.lit(d) for d in deps]).cast("array<int>").alias("depends_on"),
            )
            for i, deps in ((0, []), (1, []), (2, [0]))
        ]
    )
    rows = state.select(
        "event_id", F.struct(F.array(F.lit("a"), F.lit("b"), F.lit("c")).alias("sub_questions"), tasks.alias("retrieval_tasks")).alias("plan"),
        F.struct(
            (F.col("k") % 2 == 0).alias("sufficient"), F.array(F.col("k") % 3, F.col("k") % 4, F.lit(2)).alias("covered_sub_questions"),
            F.array((F.col("k") % 7) - 2).alias("missing_subquestion_indices"), F.array().cast("array<string>").alias("missing_aspects"),
            "next_action", (F.col("k") / 100).alias("confidence"),
        ).alias("evaluation"),
        F.when(F.col("k") % 6 == 5, F.array(F.lit(0), F.lit(2))).otherwise(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("evidence_subs"),
    )
    text = lambda c: F.array_join(F.transform(c, lambda i: i.cast("string")), ",")
    fixed = agent.repair_coverage(rows)
    return fixed.select("event_id", text("covered_subs").alias("covered"), text("missing_subs").alias("missing"), "next_action", "evidence_sufficient")


def _progress_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("task_id"), F.col("event_type").alias("step"), F.when(F.col("value") >= 15, "done").otherwise("running").alias("action"),
        F.struct("ts", "event_id").alias("seq"), F.col("value").alias("seconds"),
    )


def task_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = progress.task_progress(progress.step_states(_progress_events(spark, sf_dir)))
    done, running = F.size("done_list"), F.size("running_list")
    return shown.select(
        "task_id", F.array_join("running_list", ",").alias("running"), F.array_join("done_list", ",").alias("done"), "total_seconds",
        F.round(progress.progress_percent(done, running, F.lit(8), F.lit("processing")), 6).alias("percent"),
    )


def delivered_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event frames of every event, as wire text."""
    rows = table(spark, sf_dir, "events")
    return rows.select("event_id", progress.event_frame(F.col("event_type"), F.col("props")).alias("frame"))


QUERIES = {
    "claim_dedupe": claim_dedupe,
    "claim_takeover": claim_takeover,
    "latest_version": latest_version,
    "version_states": version_states,
    "version_diff": version_diff,
    "orphan_chunks": orphan_chunks,
    "duplicate_groups": duplicate_groups,
    "migration_plan": migration_plan,
    "active_counts": active_counts,
    "keyed_upsert": keyed_upsert,
    "partial_update": partial_update,
    "token_statistics": token_statistics,
    "merge_pools": merge_pools,
    "valid_vectors": valid_vectors,
    "rank_metrics": rank_metrics,
    "stage_means": stage_means,
    "category_means": category_means,
    "reference_scores": reference_scores,
    "faithfulness": faithfulness,
    "round_robin_sample": round_robin_sample,
    "document_coverage": document_coverage,
    "dataset_problems": dataset_problems,
    "schedule": schedule,
    "stop_reasons": stop_reasons,
    "scope_widening": scope_widening,
    "coverage_repair": coverage_repair,
    "task_progress": task_progress,
    "event_frames": delivered_events,
}

# ---------------------------------------------------------------- SQL twins

_PUB = """pub as (select user_id::varchar l, 'ver_' || event_type || '_' || props v, 'doc_' || event_id d, event_type t, ts from events)"""
_K = "json_extract_string(props, '$.k')::int"
_ACT = "case event_type when 'error' then 'ask_user' when 'signup' then 'expand_scope' when 'purchase' then 'answer' else 'rewrite_missing' end"


def _plain(x: str) -> str:
    return f"regexp_replace(replace(lower({x}), 'ß', 'ss'), '[^\\p{{L}}\\p{{N}}\\p{{M}}_]+', '', 'g')"


_METRICS = f"""
crit as (select item_id case_id, 0 criterion, text term from benchmark
  union all select item_id, 1, split_part(text, chr(10), 1) from benchmark union all select item_id, 1, split_part(text, chr(10), -1) from benchmark),
plain_docs as (select doc_id chunk_id, {_plain('text')} c from documents),
met as (select distinct stage, case_id, rank, criterion from hits join plain_docs using (chunk_id) join crit using (case_id) where contains(c, {_plain('term')})),
rec as (select stage, case_id, count(distinct criterion) / 2.0 r from met where rank <= 5 group by all),
rel as (select distinct stage, case_id, rank from met),
agg as (select stage, case_id, sum(case when rank <= 5 then 1 / log2(rank + 1) end) dcg, min(case when rank <= 5 then rank end) f,
  list_sum(list_transform(range(1, least(5, count(*)) + 1), lambda i: 1 / log2(i + 1))) ideal from rel group by all),
metrics as (select s.stage, b.item_id case_id, coalesce(r, 0) recall_at_k, coalesce(1.0 / f, 0) mrr_at_k, coalesce(round(dcg / ideal, 9), 0) ndcg_at_k, f first_relevant_rank
  from (select distinct stage from hits) s cross join benchmark b left join rec on rec.stage = s.stage and rec.case_id = b.item_id left join agg on agg.stage = s.stage and agg.case_id = b.item_id)"""

ORACLES = {
    "claim_dedupe": """select sha256(text) source_hash, 'task_' || min(doc_id) task_id, count(*) uploads, 'ver_' || substr(sha256(text), 1, 24) version_id
from documents group by sha256(text)""",
    "claim_takeover": f"""
with r as (select sha256(text) h, arg_min(case when quality = 0 then 'failed' when toxic = 1 then 'processing' else 'completed' end, d.doc_id) st,
  arg_min(n_chars > 1000, d.doc_id) leased, min(d.doc_id) id from documents d join labels using (doc_id) group by 1),
u as (select sha256(text) h, min(doc_id) id from documents group by 1),
j as (select u.h, u.id uid, r.id rid, st, st is null fresh, coalesce(st = 'failed' or (st = 'processing' and not leased), false) taken from u left join r using (h))
select h source_hash, case when fresh or taken then 'task_' || uid else 'old_' || rid end task_id, case when fresh or taken then 'processing' else st end status,
  case when taken then 2 else 1 end attempt, 'ver_' || substr(h, 1, 24) version_id, fresh or taken acquired from j""",
    "latest_version": f"""with {_PUB} select l logical_document_id, v version_id, d doc_id, t source_hash
from (select *, row_number() over (partition by l order by ts desc, v desc) n from pub) where n = 1""",
    "version_states": f"""with {_PUB}, p as (select * from pub where t in ('purchase', 'signup')),
cur as (select l, v from (select *, row_number() over (partition by l order by ts desc, v desc) n from p) where n = 1)
select a.l logical_document_id, a.v version_id, case when cur.v is not null then 'ready' when a.v in (select v from p where p.l = a.l) then 'retired' else 'building' end version_status,
  cur.v is not null is_active from (select distinct l, v from pub) a left join cur on cur.l = a.l and cur.v = a.v""",
    "version_diff": """select doc_id, case when quality = 0 then 'removed' else 'changed' end difference from documents join labels using (doc_id) where quality = 0 or toxic = 1""",
    "orphan_chunks": "select doc_id from documents where doc_id not in (select doc_id from labels)",
    "duplicate_groups": f"""
with d as (select doc_id, lang, text, {_name("split_part(text, chr(10), 1)")} k from documents),
s as (select case when k <> '' then 'title:' || k else 'content:' end seed, doc_id, lang || chr(31) || array_to_string(list_sort(string_split(text, chr(10))), chr(10)) sig,
  len(string_split(text, chr(10))) n from d)
select 'ldoc_' || substr(sha256(seed), 1, 24) logical_document_id, count(*) documents, count(distinct sig) contents, sum(n)::bigint chunks from s group by seed having count(*) > 1""",
    "migration_plan": f"""
with d as (select 'doc_' || doc_id doc_id, sha256(text) h, {_name("split_part(text, chr(10), 1)")} k, doc_id n from documents),
s as (select *, 'ldoc_' || substr(sha256(case when k <> '' then 'title:' || k else 'content:' || h end), 1, 24) l from d),
c as (select l, min(s.doc_id) picked from s join labels on labels.doc_id = s.n where quality = 1 group by l),
z as (select l, count(*) cnt, min(doc_id) only_id from s group by l)
select s.doc_id, s.l logical_document_id, case when k <> '' then 'canonical_title' else 'content_hash_fallback' end logical_id_source, 'ver_' || substr(h, 1, 24) version_id,
  coalesce(doc_id = coalesce(picked, case when cnt = 1 then only_id end), false) is_active,
  case when doc_id = coalesce(picked, case when cnt = 1 then only_id end) then 'ready' else 'retired' end version_status,
  case when coalesce(picked, case when cnt = 1 then only_id end) is null then 'several documents share a title' end problem
from s join z using (l) left join c using (l)""",
    "active_counts": "select count(*) total, count(*) filter (where quality = 1) active, count(*) filter (where quality <> 1) inactive from labels",
    "keyed_upsert": """select doc_id, case when l.doc_id is null then lang else upper(lang) end lang, case when l.doc_id is null then n_chars else n_chars * 2 end n_chars
from documents d left join labels l using (doc_id)""",
    "partial_update": "select doc_id, coalesce(quality::varchar, lang) lang, source from documents left join labels using (doc_id)",
    "token_statistics": f"""select token, count(distinct doc_id) df, count(*) total from (select doc_id, unnest({_WORDS.format('text')}) token from documents) group by token""",
    "merge_pools": f"""with {_DOCS}, {_ASKED}, {_bm25_sql('bm', 'docs', 'asked')}, {_HASHED}
select coalesce(s.query_id, b.query_id) query_id, coalesce(s.chunk_id, b.chunk_id) chunk_id, coalesce(b.rank, s.rank) rank,
  case when s.rank is null then 2 else 1 end first_seen, case when b.rank is null then 1 else 2 end latest_seen, s.rank is null is_new
from sparse s full join bm b on s.query_id = b.query_id and s.chunk_id = b.chunk_id""",
    "valid_vectors": f"""select vec_id chunk_id, len(embedding)::int dim, len(list_distinct(list_transform({_WORDS.format('text')}, lambda t: substr(md5(t), 1, 7))))::int terms
from embeddings join documents on doc_id = vec_id where len({_WORDS.format('text')}) > 0""",
    "rank_metrics": f"""with {_DOCS}, {_ASKED}, {_bm25_sql('bm', 'docs', 'asked')}, hits as (select 'bm25' stage, query_id case_id, chunk_id, rank from bm), {_METRICS}
select case_id, recall_at_k, mrr_at_k, ndcg_at_k, first_relevant_rank from metrics""",
    "stage_means": f"""with {_DOCS}, {_ASKED}, {_bm25_sql('bm', 'docs', 'asked')}, {_HASHED},
hits as (select 'bm25' stage, query_id case_id, chunk_id, rank from bm union all select 'sparse', query_id, chunk_id, rank from sparse), {_METRICS}
select stage, count(*) evaluated_cases, round(avg(recall_at_k), 9) recall_at_k, round(avg(mrr_at_k), 9) mrr_at_k, round(avg(ndcg_at_k), 9) ndcg_at_k from metrics group by stage""",
    "category_means": """select lang category, count(*) attempted, count(*) filter (where text <> '') answered, count(quality) judged, count(*) filter (where toxic = 1) failed,
  round(avg(quality), 9) correctness, round(avg(toxic), 9) completeness, round(avg(case when quality = 1 then toxic end), 9) faithfulness,
  count(quality) correctness_n, count(toxic) completeness_n, count(case when quality = 1 then toxic end) faithfulness_n
from documents left join labels using (doc_id) group by lang""",
    "reference_scores": """with l as (select doc_id, lang, n_chars, unnest(string_split(text, chr(10))) t from documents),
a as (select doc_id, lang, n_chars, count(*)::double n, count(*) filter (where length(t) > 80)::double c, count(*) filter (where contains(t, ',')) f from l group by all)
select doc_id, round(case when lang = 'en' then 2 * c / (2 * c + f + (n - c)) else (n_chars > 500)::int::double end, 9) correctness, round(c / n, 9) completeness, f::int contradictory_claims from a""",
    "faithfulness": f"""with {_DOCS}, {_ASKED}, {_bm25_sql('bm', 'docs', 'asked')},
q as (select item_id query_id, unnest(string_split(text, chr(10))) t from benchmark),
p as (select query_id, t, list_filter(list_transform(string_split_regex(t, '\\.{{3,}}|…+'), lambda x: regexp_replace(x, '\\s+', '', 'g')), lambda x: x <> '') ps from q),
g as (select p.query_id, len(ps) > 0 and len(list_filter(ps, lambda x: not contains(regexp_replace(d.text, '\\s+', '', 'g'), x))) = 0 ok
  from p join bm on bm.query_id = p.query_id and bm.rank = 1 join documents d on d.doc_id = bm.chunk_id)
select query_id, count(*) filter (where ok)::int supported_claims, count(*)::int total_claims, round(count(*) filter (where ok) / count(*), 9) faithfulness from g group by query_id""",
    "round_robin_sample": """with t as (select doc_id, source document_id, row_number() over (partition by source order by doc_id) turn, min(doc_id) over (partition by source) opened from documents)
select doc_id, document_id, turn from t order by turn, opened limit 100""",
    "document_coverage": f"""with a as (select {_plain("string_split_regex(text, '[ \\n]')[1]")} k from conversations union select {_plain("string_split_regex(text, '[ \\n]')[1]")} from benchmark)
select doc_id id, {_plain("string_split_regex(text, '[ \\n]')[1]")} in (select k from a) or {_plain('source')} in (select k from a) covered from documents""",
    "dataset_problems": f"""
with c as (select conv_id || '-' || role item, conv_id, role, turn, text, conv_id in (select doc_id from labels) known from conversations),
p as (select item, 'case id is missing or repeats' problem from c group by item having count(*) > 1
  union all select item, 'question is empty' from c where {_strip('text')} = ''
  union all select item, 'answerable case lacks document or relevance' from c where role = 'user' and (not known or turn = 0)
  union all select item, 'judged case lacks a reference answer' from c where role = 'assistant' and turn <> 1)
select item, problem, count(*) n from p group by all""",
    "schedule": f"""
with q as (select conv_id, turn, unnest(string_split(text, chr(10))) t, unnest(range(len(string_split(text, chr(10))))) i from conversations),
c as (select conv_id, turn, {_strip('t')} t, min(i) i from q where {_strip('t')} <> '' group by all),
r as (select *, row_number() over (partition by conv_id, turn order by i) - 1 qn from c),
o as (select r.*, u.tool, row_number() over (partition by conv_id, turn order by qn, u.k) - 1 pos from r
  cross join (values ('vector', 0), ('bm25', 1), ('hyde', 2)) u(tool, k) where qn < 2 and (u.tool <> 'hyde' or qn = 0)),
n as (select *, row_number() over (partition by conv_id order by pos, turn) rn from o)
select conv_id query_id, turn::int sub_q, tool, sha256(t) query_sha, case when conv_id % 3 = 0 then 2 else 1 end request_budget, rn turn
from n where rn <= floor(7 / case when conv_id % 3 = 0 then 2 else 1 end)""",
    "stop_reasons": f"""with s as (select event_id, {_K} k, value, {_ACT} a from events)
select event_id, case when k < 5 then 'evaluator_fallback' when k > 90 then 'evidence_sufficient' when a = 'ask_user' then 'need_user_clarification'
  when k % 3 >= 3 then 'max_iterations_reached' when k % 8 + 1 > 6 then 'max_tool_calls_reached' when value >= 60 then 'timeout_reached'
  when k % 3 > 1 and k % 2 = 0 and k % 5 <> 0 then 'no_new_evidence' else '' end reason from s""",
    "scope_widening": f"""with s as (select event_id, user_id, {_K} k, {_ACT} a, case {_K} % 3 when 0 then 'hard' when 1 then 'soft' else 'global' end m from events),
w as (select *, a = 'expand_scope' asked, a = 'expand_scope' and k <= 70 moves from s)
select event_id, case when moves and m = 'hard' then 'soft' when moves then 'global' else m end as mode,
  case when asked and k > 70 then 'locked_scope_preserved' when moves and m = 'hard' then 'evidence_expand_hard_to_soft' when moves and m = 'soft' then 'evidence_expand_soft_to_global'
    when moves then 'evidence_scope_already_global' end scope_reason,
  case when m = 'hard' and not moves then 'doc' || user_id else '' end hard,
  case when moves and m = 'hard' then 'doc' || user_id || ',cand' || k when m = 'soft' and not moves then 'doc' || user_id else '' end soft from w""",
    "coverage_repair": f"""
with s as (select event_id, {_K} k, {_ACT} a from events),
c as (select *, list_filter([0, 1, 2], lambda i: (i = k % 3 or i = k % 4 or i = 2) and not (i = 1 and k % 6 = 5)) cov from s),
m as (select *, list_filter([0, 1, 2], lambda i: i = k % 7 - 2 or not list_contains(cov, i)) miss0 from c),
n as (select *, case when list_contains(miss0, 0) and not list_contains(miss0, 2) then list_append(miss0, 2) else miss0 end miss1 from m),
f as (select *, case when len(miss1) = 0 and (k % 2 = 1 or k / 100.0 < 0.75) then [0, 1, 2] else miss1 end miss from n)
select event_id, array_to_string(list_filter(cov, lambda i: not list_contains(miss, i)), ',') covered, array_to_string(list_sort(miss), ',') missing,
  case when len(miss) > 0 and a = 'answer' then 'rewrite_missing' else a end next_action, k % 2 = 0 and len(miss) = 0 and k / 100.0 >= 0.75 evidence_sufficient from f""",
    "task_progress": """
with e as (select user_id task_id, event_type step, case when value >= 15 then 'done' else 'running' end a, row_number() over (order by ts, event_id) q, value from events),
s as (select task_id, step, arg_max(a, q) = 'running' running, min(q) filter (where a = 'done') fd, max(q) filter (where a = 'running') st,
  round(arg_max(value, q) filter (where a = 'done'), 2) secs from e group by all)
select task_id, coalesce(string_agg(step, ',' order by st) filter (where running), '') running, coalesce(string_agg(step, ',' order by fd) filter (where fd is not null), '') done,
  round(sum(secs), 2) total_seconds, round((count(fd) + case when count(*) filter (where running) > 0 then 0.5 else 0 end) / 8 * 100, 6) percent from s group by task_id""",
    "event_frames": "select event_id, 'event: ' || event_type || chr(10) || 'data: ' || props || chr(10) || chr(10) frame from events",
}
