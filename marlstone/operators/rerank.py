"""Second-stage scoring: query-aware pairs, blended scores, coverage of sub-questions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.config import QuerySettings
from marlstone.functions.text import first_present, present, strip
from marlstone.models import OverlapScorer, Scorer, score_pairs

# Labels and length limits of the scored text.
RESOLVED = "\n已解析的对象及条件："
TEXT_FIELDS = (
    ("文档：", "document", 80), ("主要对象：", "subject", 80), ("章节路径：", "section_path", 160),
    ("父标题：", "parent_title", 80), ("父块摘要：", "parent_summary", 180), ("切片标题：", "title", 80),
)
CONTENT_LABEL = "切片内容："
# Intents whose sub-questions each deserve evidence.
COVERED_INTENTS = ("comparison", "multi_fact", "multi_hop")
_NEVER = 10**9


def local_documents(fused: DataFrame) -> DataFrame:
    """Candidates with content, trimmed and marked as local."""
    return (
        fused.withColumn("content", strip(F.coalesce("content", F.lit(""))))
        .where(F.length("content") > 0)
        .withColumn("title", strip(F.coalesce("title", F.lit(""))))
        .withColumn("source", F.lit("local"))
    )


def rerank_text(df: DataFrame) -> Column:
    """Labelled, length-limited fields and the whole content."""
    have = set(df.columns)
    text = lambda n: strip(F.coalesce(F.col(n), F.lit(""))) if n in have else F.lit("")
    document = strip(first_present(text("canonical_title"), text("file_title")))
    content = text("content")
    values = {
        "document": document,
        "subject": F.when(text("primary_subject") != document, text("primary_subject")),
        "section_path": text("section_path"),
        "parent_title": text("parent_title"),
        "parent_summary": text("parent_summary"),
        "title": F.when(~content.startswith(text("title")), text("title")),
    }
    parts = [
        F.when(present(values[name]), F.concat(F.lit(label), F.substring(values[name], 1, limit)))
        for label, name, limit in TEXT_FIELDS
    ]
    return F.concat_ws("\n", *parts, F.when(present(content), F.concat(F.lit(CONTENT_LABEL), content)))


def query_key(col: Column) -> Column:
    """Two query texts are the same when equal without case and white space."""
    return F.regexp_replace(F.lower(col), r"(?U)[\s\x1c-\x1f]+", "")


def blend_weights(settings: QuerySettings = QuerySettings()) -> tuple[float, float]:
    total = settings.rerank_full_query_weight + settings.rerank_retrieval_query_weight
    if total <= 0:
        return 1.0, 0.0
    return settings.rerank_full_query_weight / total, settings.rerank_retrieval_query_weight / total


def focused_query(df: DataFrame, settings: QuerySettings = QuerySettings()) -> Column:
    """Struct(name, text) of the one extra search text a candidate is scored with, or null.

    Earlier texts that found the candidate come first; otherwise the current search text
    that ranked it best in any branch. Uses query_text, retrieval_queries, subquery_ranks
    and, where present, retrieval_queries_hit and retrieval_query_texts.
    """
    have = set(df.columns)
    none = F.array().cast("array<string>")
    past = F.coalesce(F.col("retrieval_queries_hit"), none) if "retrieval_queries_hit" in have else none
    if "retrieval_query_texts" in have:
        past = F.concat(past, F.coalesce(F.map_values("retrieval_query_texts"), none))

    def option(kind: int, rank: Column, index: Column, name: Column, text: Column) -> Column:
        return F.struct(
            F.lit(kind).alias("kind"), rank.cast("int").alias("rank"), index.alias("index"),
            name.alias("name"), strip(F.coalesce(text, F.lit(""))).alias("text"),
        )

    history = F.transform(past, lambda t, i: option(0, i, F.lit(0), F.concat(F.lit("history_"), i.cast("string")), t))

    def current(text: Column, i: Column) -> Column:
        name = F.concat(F.lit("query_"), i.cast("string"))
        ranks = F.filter(F.map_values(F.try_element_at("subquery_ranks", name)), lambda r: r > 0)
        return option(1, F.coalesce(F.array_min(ranks), F.lit(_NEVER)), i, name, text)

    fresh = F.filter(F.transform("retrieval_queries", current), lambda o: o["rank"] < _NEVER)
    fresh = F.filter(
        fresh, lambda o: ~F.exists(fresh, lambda p: (p["index"] < o["index"]) & (query_key(p["text"]) == query_key(o["text"])))
    )
    usable = F.filter(
        F.concat(history, fresh),
        lambda o: (F.length(o["text"]) > 0) & (query_key(o["text"]) != query_key(F.col("query_text"))),
    )
    eligible = F.coalesce(F.col("rrf_rank") <= settings.rerank_coverage_query_rank_limit, F.lit(True))
    return F.when(eligible, F.array_min(usable))


def rerank(
    candidates: DataFrame,
    factory: Callable[[], Scorer] = OverlapScorer,
    settings: QuerySettings = QuerySettings(),
) -> DataFrame:
    """Score candidates against the full and a focused query and rank them per query.

    ``candidates`` carries query_id, query_text, retrieval_queries, rrf_rank and
    subquery_ranks. If any score of a query is missing, all its scores become null and the
    fused order stays.
    """
    df = local_documents(candidates)
    df = df.withColumn("rerank_text", rerank_text(df)).withColumn("focused", focused_query(df, settings))
    df = df.withColumn("focused_text", F.col("focused.text")).withColumn("focused_name", F.col("focused.name")).drop("focused")
    df = score_pairs(df, "query_text", "rerank_text", "full_query_score", factory)
    df = score_pairs(df, "focused_text", "rerank_text", "focused_score", factory)
    df = df.withColumn("focused_score", F.when(F.col("focused_text").isNotNull(), F.col("focused_score")))
    per_query = Window.partitionBy("query_id")
    broken = F.col("full_query_score").isNull() | (F.col("focused_text").isNotNull() & F.col("focused_score").isNull())
    df = df.withColumn("_failed", F.max(broken).over(per_query))
    full, focused = blend_weights(settings)
    blended = F.when(
        F.col("focused_text").isNotNull(), full * F.col("full_query_score") + focused * F.col("focused_score")
    ).otherwise(F.col("full_query_score"))
    final = F.when(~F.col("_failed"), F.round(blended, 6))
    df = df.withColumn("rerank_score", final)
    for name in ("full_query_score", "focused_score"):
        df = df.withColumn(name, F.when(~F.col("_failed"), F.round(name, 6)))
    order = Window.partitionBy("query_id").orderBy(F.col("rerank_score").desc_nulls_last(), F.col("rrf_rank"), F.col("chunk_id"))
    hit = F.when(F.col("focused_text").isNotNull() & ~F.col("_failed"), F.array("focused_text")).otherwise(F.array().cast("array<string>"))
    if "retrieval_queries_hit" in df.columns:
        hit = F.array_distinct(F.concat(F.coalesce("retrieval_queries_hit", F.array().cast("array<string>")), hit))
    return df.withColumn("retrieval_queries_hit", hit).withColumn("model_rank", F.row_number().over(order)).drop("_failed", "rerank_text")


def rerank_groups(
    candidates: DataFrame,
    factory: Callable[[], Scorer] = OverlapScorer,
    settings: QuerySettings = QuerySettings(),
) -> DataFrame:
    """Rank candidates inside each sub-question: (query_id, sub_q, question, chunk_id, pos, ...).

    ``pos`` is the fused order, this round's hits before earlier evidence. Scores under the
    minimum are dropped; if scoring fails anywhere in a query, all its groups keep their order.
    """
    df = candidates.where(present(strip(F.coalesce("content", F.lit("")))) & F.col("chunk_id").isNotNull())
    first = F.row_number().over(Window.partitionBy("query_id", "sub_q", "chunk_id").orderBy("pos"))
    df = df.withColumn("_n", first).where("_n = 1").drop("_n")
    asked = F.col("question")
    if "resolved_question" in df.columns:
        asked = F.when(
            present(F.col("resolved_question")), F.concat(asked, F.lit(RESOLVED), F.col("resolved_question"))
        ).otherwise(asked)
    df = df.withColumn("_q", asked).withColumn("_t", rerank_text(df))
    df = score_pairs(df, "_q", "_t", "rerank_score", factory, settings.agent_rerank_batch_size).drop("_q", "_t")
    failed = F.max(F.col("rerank_score").isNull()).over(Window.partitionBy("query_id"))
    df = df.withColumn("_failed", failed)
    df = df.withColumn("rerank_score", F.when(~F.col("_failed"), F.round("rerank_score", 6)))
    kept = df.where(F.col("_failed") | (F.col("rerank_score") >= settings.rerank_coverage_min_score))
    order = Window.partitionBy("query_id", "sub_q").orderBy(F.col("rerank_score").desc_nulls_last(), "pos")
    return kept.withColumn("rank", F.row_number().over(order)).drop("_failed")


def group_evidence(ranked: DataFrame, settings: QuerySettings = QuerySettings()) -> DataFrame:
    """The best few candidates of every sub-question."""
    return ranked.where(F.col("rank") <= settings.agent_subquestion_top_k)


def coverage_pool(ranked: DataFrame, settings: QuerySettings = QuerySettings()) -> DataFrame:
    """Fused leaders first, then reranked order: the candidates coverage is judged on."""
    limit = settings.rerank_coverage_candidate_top_k
    seeds = min(max(settings.rerank_max_top_k, 1), limit)
    lead = F.row_number().over(Window.partitionBy("query_id").orderBy(F.when(F.col("rrf_rank") > 0, F.col("rrf_rank")).asc_nulls_last(), "model_rank"))
    led = ranked.withColumn("_lead", F.when(F.col("rrf_rank") > 0, lead))
    seed = F.coalesce(F.col("_lead") <= seeds, F.lit(False))
    order = Window.partitionBy("query_id").orderBy(
        F.when(seed, 0).otherwise(1), F.when(seed, F.col("_lead")).otherwise(F.col("model_rank"))
    )
    return led.withColumn("pool_pos", F.row_number().over(order)).where(F.col("pool_pos") <= limit).drop("_lead")


def coverage_scores(
    pool: DataFrame, sub_questions: DataFrame, factory: Callable[[], Scorer] = OverlapScorer
) -> DataFrame:
    """(query_id, chunk_id, sub_q, score): every pool candidate against every sub-question.

    ``sub_questions`` is (query_id, sub_q, question). Scores already known for the same
    question text are reused instead of computed again.
    """
    pairs = pool.withColumn("_text", rerank_text(pool)).join(sub_questions, "query_id")
    reuse = F.when(query_key(F.col("question")) == query_key(F.col("query_text")), F.col("full_query_score")).when(
        query_key(F.col("question")) == query_key(F.coalesce("focused_text", F.lit(""))), F.col("focused_score")
    )
    flat = pairs.select("query_id", "chunk_id", "pool_pos", "sub_q", "question", "_text", reuse.alias("known"))
    known = flat.where(F.col("known").isNotNull()).withColumn("score", F.col("known"))
    fresh = score_pairs(flat.where(F.col("known").isNull()), "question", "_text", "score", factory)
    both = known.unionByName(fresh)
    return both.select("query_id", "chunk_id", "pool_pos", "sub_q", F.round("score", 6).alias("score"))


def best_per_subquestion(scores: DataFrame, settings: QuerySettings = QuerySettings()) -> DataFrame:
    """(query_id, sub_q, chunk_id, score, missing): the best candidate; the earlier one wins ties."""
    best = scores.groupBy("query_id", "sub_q").agg(
        F.max(F.struct("score", (-F.col("pool_pos")).alias("p"), "chunk_id")).alias("b")
    )
    return best.select(
        "query_id", "sub_q", F.col("b.chunk_id").alias("chunk_id"), F.col("b.score").alias("score"),
        (F.col("b.score") < settings.rerank_coverage_min_score).alias("missing"),
    )


def select_with_coverage(
    ranked: DataFrame,
    sub_questions: DataFrame,
    max_results: int | None = None,
    factory: Callable[[], Scorer] = OverlapScorer,
    settings: QuerySettings = QuerySettings(),
) -> DataFrame:
    """Keep the best evidence of every sub-question, then fill up by rank.

    Queries without sub-questions, or whose coverage cannot be scored, simply take their
    ranking. Adds coverage_protected, coverage_subquestion_indices and ``place``.
    """
    limit = settings.rerank_max_top_k if max_results is None else max_results
    scores = coverage_scores(coverage_pool(ranked, settings), sub_questions, factory)
    broken = scores.where(F.col("score").isNull()).select("query_id").distinct()
    best = best_per_subquestion(scores.join(broken, "query_id", "left_anti"), settings).where(~F.col("missing"))
    protected = best.groupBy("query_id", "chunk_id").agg(F.array_sort(F.collect_set("sub_q")).alias("coverage_subquestion_indices"))
    marked = ranked.join(protected, ["query_id", "chunk_id"], "left").withColumn(
        "coverage_protected", F.col("coverage_subquestion_indices").isNotNull()
    )
    order = Window.partitionBy("query_id").orderBy(
        F.col("coverage_protected").desc(),
        F.when(F.col("coverage_protected"), F.col("rerank_score")).desc_nulls_last(),
        "model_rank",
    )
    return marked.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit)


def merge_pools(previous: DataFrame, current: DataFrame, iteration: int) -> DataFrame:
    """Union of earlier and current evidence per query with first and latest seen round.

    Both are (query_id, chunk_id, ..., retrieval_queries_hit); current fields win.
    Adds ``is_new`` for chunks the earlier pool did not hold.
    """
    payload = [c for c in current.columns if c not in ("query_id", "chunk_id")]
    have = set(previous.columns)
    old = previous.select(
        "query_id", "chunk_id", *[F.col(c).alias(f"old_{c}") for c in payload if c in have],
        (F.coalesce("first_seen", F.lit(1)) if "first_seen" in have else F.lit(1)).alias("old_first"),
        (F.coalesce("latest_seen", F.lit(max(iteration - 1, 1))) if "latest_seen" in have else F.lit(max(iteration - 1, 1))).alias("old_latest"),
    )
    joined = current.withColumn("_now", F.lit(True)).join(old, ["query_id", "chunk_id"], "full")
    now = F.coalesce("_now", F.lit(False))
    fields = [
        (F.when(now, F.col(c)).otherwise(F.col(f"old_{c}")) if c in have else F.col(c)).alias(c) for c in payload
    ]
    return joined.select(
        "query_id", "chunk_id", *fields,
        F.least(F.col("old_first"), F.when(now, F.lit(iteration))).alias("first_seen"),
        F.when(now, F.lit(iteration)).otherwise(F.col("old_latest")).alias("latest_seen"),
        F.col("old_first").isNull().alias("is_new"),
    )
