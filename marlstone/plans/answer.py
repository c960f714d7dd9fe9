"""Answer a batch of questions over a corpus: route, search, fuse, rerank, expand, pack, answer."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.config import QuerySettings
from marlstone.functions.text import parse_list
from marlstone.models import Embedder, ExtractiveGenerator, Generator, HashedEmbedder, OverlapScorer, Scorer, embed, generate
from marlstone.operators import agent, context, conflict, fusion, history, hybrid, rerank, routing, scope
from marlstone.operators.dense import dense_top_k
from marlstone.operators.lexical import bm25_top_k
from marlstone.operators.registry import mention_candidates, search_registry
from marlstone.plans.ingest import Corpus
from marlstone.session import materialize

# Texts shown when no answer could be made.
NO_ANSWER = "抱歉，暂时无法生成答案，请稍后再试。"
PAYLOAD = (
    "content", "title", "doc_id", "canonical_title", "primary_subject", "file_title", "section_id", "section_path",
    "parent_title", "parent_summary", "section_chunk_index",
)


@dataclass(frozen=True)
class QueryModels:
    embedder: Callable[[], Embedder] = HashedEmbedder
    scorer: Callable[[], Scorer] = OverlapScorer
    answer: Callable[[], Generator] = ExtractiveGenerator
    pseudo: Callable[[], Generator] | None = None
    judge: Callable[[], Generator] | None = None


def route(
    questions: DataFrame,
    corpus: Corpus,
    referred: DataFrame | None = None,
    settings: QuerySettings = QuerySettings(),
    embedder: Callable[[], Embedder] = HashedEmbedder,
) -> tuple[DataFrame, DataFrame]:
    """Routes (query_id, mode, locked, reason) and their documents (query_id, doc_id, mode).

    ``referred`` is (query_id, doc_id): documents the conversation refers to.
    """
    registry = corpus.active_registry().withColumns(
        {"aliases": parse_list(F.col("aliases_json")), "model_codes": parse_list(F.col("model_codes_json"))}
    )
    registry = materialize(registry, "registry")
    kind = questions.schema["query_id"].dataType.simpleString()
    if referred is None:
        referred = questions.sparkSession.createDataFrame([], f"query_id {kind}, doc_id string")
    named = materialize(routing.deterministic_matches(questions, registry), "named")
    mentioned = questions.select("query_id", F.posexplode(routing.mentions(F.col("text"))).alias("place", "mention"), "text")
    weak = materialize(search_registry(mentioned, corpus.active_profiles(), embedder, settings), "weak")
    mentioned = mentioned.drop("place")
    matches = materialize(routing.exact_matches(mentioned, mention_candidates(mentioned, registry, weak)), "matches")
    routes = routing.decide_route(questions, referred, named, mentioned, matches, weak)
    routes = materialize(routes, "routes")
    return routes, materialize(routing.route_documents(routes, referred, named, matches, weak, settings), "scope")


def branches(
    questions: DataFrame, routes: DataFrame, documents: DataFrame, corpus: Corpus, models: QueryModels, settings: QuerySettings
) -> DataFrame:
    """(query_id, branch, chunk_id, rank) of every enabled search, each within its scope.

    A question with several ``retrieval_queries`` is searched by each of them, and their rankings are
    fused within a branch, at least one hit of each kept.
    """
    texts = F.array("text")
    if "retrieval_queries" in questions.columns:
        texts = F.when(F.size("retrieval_queries") > 0, F.array_distinct("retrieval_queries")).otherwise(texts)
    each = questions.select(F.col("query_id").alias("question_id"), F.posexplode(texts).alias("variant", "text"))
    each = each.withColumn("query_id", F.concat_ws("#", "variant", "question_id"))
    each = materialize(each.join(routes.select(F.col("query_id").alias("question_id"), "locked"), "question_id"), "texts")
    asked = each.select("query_id", "text", "locked")
    limits = documents.where(F.col("mode") != "global").withColumnRenamed("query_id", "question_id")
    limits = limits.join(each.select("query_id", "question_id"), "question_id").drop("question_id")
    stored = corpus.active_vectors()
    vectors = materialize(embed(asked, "text", ["query_id", "locked"], models.embedder), "asked")
    found = [
        ("direct_hybrid", vectors, lambda q, s: hybrid.hybrid_top_k(stored, q, settings.embedding_search_limit, s, settings), settings.embedding_search_limit)
    ]
    if settings.bm25_enabled:
        index = corpus.keyword_postings()
        found.append(("bm25", asked, lambda q, s: bm25_top_k(None, q, settings.bm25_search_limit, index=index, scope=s), settings.bm25_search_limit))
    if models.pseudo is not None:
        imagined = generate(asked, "text", "imagined", models.pseudo).where(F.length("imagined") > 0)
        pseudo = materialize(embed(imagined, "imagined", ["query_id", "locked"], models.embedder), "pseudo")
        search = hybrid.hybrid_top_k if settings.hyde_use_sparse else dense_top_k
        found.append(("hyde", pseudo, lambda q, s: search(stored, q, settings.hyde_search_limit, s), settings.hyde_search_limit))
    hits = None
    for name, queries, search, limit in found:
        part = scope.search_scoped(queries, limits, search, limit, settings).join(each.select("query_id", "question_id", "variant"), "query_id")
        part = part.drop("query_id").withColumnRenamed("question_id", "query_id")
        if "retrieval_queries" in questions.columns:
            part = materialize(part, "variants")
            fallback = part.groupBy("query_id", "chunk_id").agg(F.max("route_fallback").alias("route_fallback"))
            part = hybrid.merge_query_variants(part, limit).join(fallback, ["query_id", "chunk_id"])
        part = part.select("query_id", "chunk_id", "rank", "route_fallback", F.lit(name).alias("branch"))
        hits = part if hits is None else hits.unionByName(part)
    return hits


def answer(
    questions: DataFrame,
    corpus: Corpus,
    models: QueryModels = QueryModels(),
    settings: QuerySettings = QuerySettings(),
    messages: DataFrame | None = None,
) -> DataFrame:
    """(query_id, answer, context, context_chunk_ids, route_mode, route_reason).

    ``questions`` is (query_id, text[, session_id][, answer][, retrieval_queries][, sub_questions]);
    ``messages`` the chat history. Search texts take the question's place in every search; sub-questions
    have their best evidence kept, whatever its rank.
    A question that already has an answer, such as a request for clarification, keeps it
    and is not searched.
    """
    if "answer" in questions.columns:
        settled = F.length(F.coalesce("answer", F.lit(""))) > 0
        kept = questions.where(settled).select("query_id", "answer", F.lit("none").alias("route_mode"), F.lit("answered").alias("route_reason"))
        fresh = answer(questions.where(~settled).drop("answer"), corpus, models, settings, messages)
        return fresh.unionByName(kept, allowMissingColumns=True)
    referred = None
    if messages is not None and "session_id" in questions.columns and "selected_documents" in messages.columns:
        pointed = history.referred_documents(questions, messages)
        referred = pointed.select("query_id", F.explode("documents").alias("doc_id"))
    routes, limits = route(questions, corpus, referred, settings, models.embedder)
    hits = materialize(branches(questions, routes, limits, corpus, models, settings), "hits")
    chunks = corpus.active_chunks().withColumnRenamed("id", "chunk_id")
    fused = fusion.fuse_branches(hits, settings)
    texts = F.coalesce("retrieval_queries", F.array("text")) if "retrieval_queries" in questions.columns else F.array("text")
    asked = questions.select("query_id", F.col("text").alias("query_text"), texts.alias("retrieval_queries"))
    # Stored results have a known size, from which Spark chooses the join.
    candidates = chunks.select("chunk_id", *PAYLOAD).join(materialize(fused, "fused"), "chunk_id").join(asked, "query_id")
    ranked = materialize(rerank.rerank(candidates, models.scorer, settings), "ranked")
    if "sub_questions" in questions.columns:
        parts = questions.select("query_id", F.posexplode("sub_questions").alias("sub_q", "question"))
        selected = rerank.select_with_coverage(ranked, parts, factory=models.scorer, settings=settings)
    else:
        selected = fusion.truncate_at_cliff(ranked, rank="model_rank", score="rerank_score", settings=settings)
        none = {"place": F.col("model_rank"), "coverage_protected": F.lit(False), "coverage_subquestion_indices": F.array().cast("array<int>")}
        selected = selected.withColumns(none)
    selected = selected.withColumn("conflict_judge_promoted", F.lit(False))
    if models.judge is not None and settings.conflict_judge_enabled:
        pairs = conflict.conflict_pairs(selected, ranked, settings)
        body = F.substring("content", 1, settings.conflict_judge_document_max_chars)
        bodies = ranked.select("query_id", F.col("chunk_id").alias("id"), body.alias("body"))
        told = pairs
        for side in ("candidate", "victim"):
            named = bodies.select("query_id", F.col("id").alias(f"{side}_chunk_id"), F.col("body").alias(side))
            told = told.join(named, ["query_id", f"{side}_chunk_id"], "left")
        judged = F.array_sort(F.collect_list(F.struct("pair_id", "candidate_chunk_id", "candidate", "victim_chunk_id", "victim")))
        prompts = told.groupBy("query_id").agg(judged.alias("pairs")).join(questions.select("query_id", "text"), "query_id")
        prompts = prompts.select("query_id", F.to_json(F.struct(F.col("text").alias("question"), "pairs")).alias("prompt"))
        replies = generate(prompts, "prompt", "reply", models.judge)
        decided = materialize(conflict.decide(pairs, conflict.parse_decisions(replies), settings), "decided")
        selected = conflict.promote(selected, ranked, decided)
    selected = materialize(selected, "selected").withColumn("anchor_id", F.concat_ws("|", "query_id", "place"))
    selected = materialize(selected.withColumn("first", context.first_of_group(selected, "coverage_subquestion_indices", rank="place")), "opened")
    opens = context.should_expand(F.col("place"), F.col("coverage_protected"), F.col("conflict_judge_promoted"), F.col("first"), settings)
    grown = context.expand(selected.where(opens), chunks, settings).unionByName(selected.where(~opens), allowMissingColumns=True)
    documents = grown.withColumn("pos", F.col("place")).withColumn("source", F.lit("local")).withColumn(
        "expanded_chunk_ids", F.coalesce("expanded_chunk_ids", F.array("chunk_id"))
    )
    budget: DataFrame | int = settings.max_context_chars
    if messages is not None and "session_id" in questions.columns:
        reserved = history.budgeted_history(messages, context.history_reserve(settings))
        per_query = questions.select("query_id", "session_id").join(reserved, "session_id", "left")
        budget = context.split_budgets(per_query, settings)
    packed = context.pack_answer_context(documents, budget, settings)
    prompts = questions.join(packed, "query_id", "left")
    said = F.lit(None).cast("string")
    if messages is not None and "session_id" in questions.columns:
        prompts = prompts.join(per_query.select("query_id", "history"), "query_id", "left")
        said = F.when(F.length("history") > 0, F.concat(F.lit("历史对话：\n"), F.col("history")))
    prompts = prompts.withColumn(
        "prompt", F.concat_ws("\n", F.coalesce("context", F.lit("")), said, F.concat(F.lit("问题："), F.col("text")))
    )
    replied = generate(prompts, "prompt", "reply", models.answer)
    return replied.join(routes, "query_id").select(
        "query_id", F.coalesce("reply", F.lit(NO_ANSWER)).alias("answer"), "context", "context_chunk_ids",
        F.col("mode").alias("route_mode"), F.col("reason").alias("route_reason"),
    )


def plan_rounds(
    questions: DataFrame,
    plans: DataFrame,
    search: Callable[[DataFrame], DataFrame],
    judge: Callable[[DataFrame], DataFrame],
    settings: QuerySettings = QuerySettings(),
    scorer: Callable[[], Scorer] = OverlapScorer,
) -> DataFrame:
    """Multi-step retrieval of all questions at once, at most a few rounds.

    ``plans`` is (query_id, plan, cost). ``search`` maps operations (query_id, sub_q, tool,
    query, request_budget) to (query_id, sub_q, branch, chunk_id, rank, content). ``judge``
    maps (query_id, plan, evidence_subs) to (query_id, evaluation), null where it failed.
    Returns (query_id, evidence, stop_reason, iteration, calls_used); evidence rows are
    structs of chunk and owners.
    """
    state = plans.withColumn("calls_used", F.lit(0)).withColumn("history", F.create_map().cast("map<int,array<string>>"))
    tasks = agent.ready_tasks(state).withColumn("resolved_question", F.lit(None).cast("string"))
    evidence = None
    done = None
    for iteration in range(1, settings.agent_max_iterations + 1):
        operations = materialize(agent.schedule(tasks, settings), f"operations-{iteration}")
        hits = materialize(search(operations), f"round-{iteration}")
        fused = fusion.fuse_branches(hits.drop("content"), settings, by=("query_id", "sub_q"))
        texts = hits.groupBy("query_id", "sub_q", "chunk_id").agg(F.min("content").alias("content"))
        current = fused.select("query_id", "sub_q", "chunk_id", F.col("rrf_rank").alias("pos")).join(texts, ["query_id", "sub_q", "chunk_id"])
        if evidence is not None:
            earlier = evidence.select("query_id", "sub_q", "chunk_id", (F.lit(10**6) + F.col("rank")).alias("pos"), "content")
            current = current.unionByName(earlier.join(operations.select("query_id", "sub_q").distinct(), ["query_id", "sub_q"], "left_semi"))
        asked = state.select("query_id", F.posexplode("plan.sub_questions").alias("sub_q", "question"))
        resolved = tasks.select("query_id", F.col("subquestion_index").alias("sub_q"), "resolved_question")
        scored = rerank.rerank_groups(current.join(asked, ["query_id", "sub_q"]).join(resolved, ["query_id", "sub_q"], "left"), scorer, settings)
        best = rerank.group_evidence(scored, settings).select("query_id", "sub_q", "chunk_id", "rank", "rerank_score", "content")
        before = evidence
        if evidence is not None:
            untouched = evidence.join(operations.select("query_id", "sub_q").distinct(), ["query_id", "sub_q"], "left_anti")
            best = best.unionByName(untouched)
        evidence = materialize(best, f"evidence-{iteration}")
        fresh = evidence.select("query_id", "sub_q", "chunk_id")
        if before is not None:
            fresh = fresh.join(before.select("query_id", "sub_q", "chunk_id"), ["query_id", "sub_q", "chunk_id"], "left_anti")
        gained = fresh.groupBy("query_id").agg(F.count(F.lit(1)).alias("new_evidence"))
        spent = operations.groupBy("query_id").agg(
            F.sum("request_budget").alias("spent"),
            F.array_sort(F.collect_set(F.struct("sub_q", "query"))).alias("ran"),
        )
        held = evidence.groupBy("query_id").agg(F.array_sort(F.collect_set("sub_q")).alias("evidence_subs"))
        none = F.array().cast("array<int>")
        state = state.join(spent, "query_id", "left").join(gained, "query_id", "left").join(held, "query_id", "left").withColumn(
            "calls_used", F.col("calls_used") + F.coalesce("spent", F.lit(0)).cast("int")
        ).withColumn("evidence_subs", F.coalesce("evidence_subs", none)).withColumn("new_evidence", F.coalesce("new_evidence", F.lit(0)))
        every = F.sequence(F.lit(0), F.size("plan.sub_questions") - 1)
        ran = lambda i: F.transform(F.filter(F.coalesce("ran", F.array().cast(spent.schema["ran"].dataType)), lambda r: r["sub_q"] == i), lambda r: r["query"])
        past = lambda i: F.coalesce(F.try_element_at("history", i), F.array().cast("array<string>"))
        state = state.withColumn("history", F.map_from_arrays(every, F.transform(every, lambda i: F.array_union(past(i), ran(i)))))
        judged = judge(state.select("query_id", "plan", "evidence_subs"))
        state = materialize(state.join(judged.select("query_id", "evaluation"), "query_id", "left"), f"state-{iteration}")
        assumed = F.struct(
            F.lit(True).alias("sufficient"), every.alias("covered_sub_questions"), none.alias("missing_subquestion_indices"),
            F.lit(None).cast(agent.EVALUATION["followup_tasks"].dataType).alias("followup_tasks"), F.array().cast("array<string>").alias("missing_aspects"),
            F.array().cast("array<string>").alias("contradictions"), F.lit("answer").alias("next_action"), F.lit(0.0).alias("confidence"),
        )
        state = state.withColumn("evaluator_failed", F.col("evaluation").isNull()).withColumn("evaluation", F.coalesce("evaluation", assumed))
        checked = agent.repair_coverage(state, settings)
        checked = checked.withColumn("iteration", F.lit(iteration)).withColumn("next_cost", F.col("cost")).withColumn("elapsed_seconds", F.lit(0.0)).withColumn(
            "pending", F.exists("missing_subs", lambda i: F.size(F.element_at("history", i)) == 0)
        ).withColumn("stop_reason", agent.stop_reason(settings))
        checked = materialize(checked, f"checked-{iteration}")
        finished = checked.where(F.col("stop_reason") != "").select("query_id", "stop_reason", "iteration", "calls_used")
        remaining = checked.where(F.col("stop_reason") == "")
        next_tasks = materialize(agent.followup_tasks(remaining), f"tasks-{iteration}")
        stuck = remaining.join(next_tasks.select("query_id"), "query_id", "left_anti").select(
            "query_id", F.lit("no_ready_subquestion_queries").alias("stop_reason"), "iteration", "calls_used"
        )
        ended = finished.unionByName(stuck)
        done = ended if done is None else done.unionByName(ended)
        state = remaining.join(next_tasks.select("query_id"), "query_id", "left_semi").select(*plans.columns, "calls_used", "history")
        tasks = next_tasks
        if next_tasks.isEmpty():
            break
    merged = context.merge_evidence_groups(evidence)
    rows = merged.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("pos", "chunk_id", "retrieved_for_subquestions"))).alias("evidence"))
    return questions.select("query_id").join(rows, "query_id", "left").join(done, "query_id", "left")
