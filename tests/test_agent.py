"""Planning, budgets, coverage and replanning."""

import json
import pytest
from pyspark.sql import functions as F

from marlstone.config import QuerySettings
from marlstone.operators import agent, context, rerank, routing
from marlstone.plans.answer import plan_rounds

SETTINGS = QuerySettings(
    agentic_rag_enabled=True, bm25_enabled=True, agent_max_tool_calls=24, agent_max_iterations=3,
    agent_subquestion_top_k=2, rerank_coverage_min_score=0.1, agent_evidence_pool_max=4,
)


def tasks(spark, rows, used=0, cost=1):
    full = [(1, i, *r, used, cost) for i, r in enumerate(rows)]
    return spark.createDataFrame(
        full,
        "query_id int, task_order int, subquestion_index int, search_queries array<string>, retrieval_tools array<string>, calls_used int, cost int",
    )


def test_budget_covers_every_question_before_variants(spark):
    rows = [(i, [f"q{i}", f"v{i}"], ["vector", "bm25"]) for i in range(4)]
    chosen = agent.schedule(tasks(spark, rows), QuerySettings(bm25_enabled=True, agent_max_tool_calls=4)).collect()
    assert sorted((c.sub_q, c.tool, c.query) for c in chosen) == [(i, "vector", f"q{i}") for i in range(4)]


def test_soft_scope_costs_two_requests(spark):
    rows = [(0, ["a"], ["vector", "bm25"]), (1, ["b"], ["vector"])]
    chosen = agent.schedule(tasks(spark, rows, used=1, cost=2), QuerySettings(bm25_enabled=True, agent_max_tool_calls=6)).collect()
    assert [c.request_budget for c in chosen] == [2, 2]
    cost = spark.createDataFrame([(["d"], [], False), ([], ["d"], False), ([], ["d"], True), ([], [], False)], "s array<string>, h array<string>, l boolean")
    assert [r.c for r in cost.select(agent.call_cost(F.col("s"), F.col("h"), F.col("l")).alias("c")).collect()] == [2, 2, 1, 1]


def test_pseudo_documents_take_one_query_and_disabled_tools_fall_back(spark):
    on = QuerySettings(bm25_enabled=True, agent_hyde_enabled=True, agent_max_tool_calls=24)
    chosen = agent.schedule(tasks(spark, [(0, [" a ", "a", "b", "c"], ["hyde", "vector"])]), on).collect()
    assert [(c.tool, c.query) for c in sorted(chosen, key=lambda c: c.turn)] == [("vector", "a"), ("hyde", "a"), ("vector", "b")]
    off = agent.schedule(tasks(spark, [(0, ["a"], ["bm25", "hyde"])]), QuerySettings()).collect()
    assert [(c.tool, c.query) for c in off] == [("vector", "a")]


def plans(spark, *rows):
    data = []
    for i, (query, plan) in enumerate(rows):
        data.append((i, query, json.dumps(plan)))
    df = spark.createDataFrame(data, "query_id int, query_text string, reply string")
    return df.withColumn("plan", agent.parse_reply(F.col("reply"), agent.PLAN)).drop("reply")


def test_tasks_keep_their_subquestion_and_missing_ones_are_filled(spark):
    plan = {
        "intent": "comparison", "sub_questions": ["A?", "B?", "C?"], "search_queries": ["flat"],
        "retrieval_tasks": [
            {"subquestion_index": 1, "search_queries": ["find B"], "retrieval_tools": ["bm25"]},
            {"subquestion_index": 1, "search_queries": ["find B", "B in detail"], "depends_on": [0]},
            {"subquestion_index": 9, "search_queries": ["lost"]},
        ],
    }
    row = agent.normalize_plans(plans(spark, ("whole", plan)), SETTINGS).head()
    assert row.plan_problem is None
    assert [(t.subquestion_index, t.search_queries, t.depends_on) for t in row.plan.retrieval_tasks] == [
        (0, ["A?"], []), (1, ["find B", "B in detail"], [0]), (2, ["C?"], []),
    ]
    assert row.plan.retrieval_tools == ["vector", "bm25"]


def test_dependency_must_point_backwards(spark):
    plan = {"sub_questions": ["A?", "B?"], "retrieval_tasks": [{"subquestion_index": 0, "search_queries": ["a"], "depends_on": [1]}]}
    assert agent.normalize_plans(plans(spark, ("q", plan)), SETTINGS).head().plan_problem == "dependency is not an earlier sub-question"


def test_near_duplicate_queries_and_one_english_text(spark):
    cases = [
        (["激光 原理", "激光原理", "laser principle basics", "another english text", "成像公式"], "激光原理是什么", ["激光 原理", "laser principle basics", "成像公式"]),
        (["abcdefghijkl", "abcdefghijklm", "x"], "q", ["abcdefghijkl", "x"]),
        (["", None, " ! ", "a", "A.", "b", "c", "d", "e", "f"], None, ["a", "b", "c", "d", "e"]),
        (["one two", "three four"], "q", ["one two", "three four"]),
        (None, "q", []),
    ]
    rows = spark.createDataFrame(cases, "texts array<string>, source string, expected array<string>")
    for row in agent.distinct_queries(rows, "found", F.col("texts"), "source", 5).collect():
        assert row.found == row.expected


def test_dependent_tasks_are_not_scheduled_first(spark):
    plan = {"sub_questions": ["A?", "B?"], "retrieval_tasks": [{"subquestion_index": 1, "search_queries": ["b"], "depends_on": [0]}]}
    ready = agent.normalize_plans(plans(spark, ("q", plan)), SETTINGS).withColumn("calls_used", F.lit(0)).withColumn("cost", F.lit(1))
    assert [r.subquestion_index for r in agent.ready_tasks(ready).collect()] == [0]


def evaluated(spark, evaluation, deps=((), (), (0,)), evidence=(0, 1, 2), history=None):
    plan = {
        "sub_questions": [f"s{i}" for i in range(len(deps))],
        "retrieval_tasks": [{"subquestion_index": i, "search_queries": [f"q{i}"], "retrieval_tools": ["vector"], "depends_on": list(d)} for i, d in enumerate(deps)],
    }
    df = plans(spark, ("q", plan)).withColumn("e", F.lit(json.dumps(evaluation)))
    df = df.withColumn("evaluation", agent.parse_evaluation(F.col("e"))).drop("e")
    df = df.withColumn("evidence_subs", F.array(*[F.lit(i) for i in evidence]).cast("array<int>"))
    past = {i: [f"q{i}"] for i in range(len(deps))} if history is None else history
    rows = spark.createDataFrame([(past,)], "history map<int,array<string>>")
    return agent.repair_coverage(df, SETTINGS).join(rows).withColumn("calls_used", F.lit(0)).withColumn("cost", F.lit(1))


def test_claims_without_evidence_or_out_of_range_are_dropped(spark):
    row = evaluated(spark, {"sufficient": True, "covered_sub_questions": [0, 1, 2, 7], "confidence": 0.9}, deps=((), (), ()), evidence=(0, 2)).head()
    assert (row.covered_subs, row.missing_subs, row.evidence_sufficient) == ([0, 2], [1], False)


def test_missing_upstream_invalidates_downstream(spark):
    row = evaluated(spark, {"sufficient": True, "covered_sub_questions": [1, 2], "confidence": 0.9, "next_action": "answer"}).head()
    assert (row.covered_subs, row.missing_subs, row.next_action) == ([1], [0, 2], "rewrite_missing")


def test_low_confidence_means_all_missing(spark):
    row = evaluated(spark, {"sufficient": True, "covered_sub_questions": [0, 1, 2], "confidence": 0.2}).head()
    assert row.missing_subs == [0, 1, 2]


def test_dependency_waits_for_covered_upstream_and_resolved_query(spark):
    waiting = evaluated(spark, {"covered_sub_questions": [0, 1], "confidence": 0.9})
    assert agent.followup_tasks(waiting).count() == 0
    told = evaluated(
        spark,
        {"covered_sub_questions": [0, 1], "confidence": 0.9, "followup_tasks": [{"subquestion_index": 2, "search_queries": ["method X speed"]}]},
    )
    row = agent.followup_tasks(told).collect()
    assert [(r.subquestion_index, r.search_queries, r.resolved_question) for r in row] == [(2, ["method X speed"], "method X speed")]


def test_never_run_questions_come_first_and_repeats_are_refined(spark):
    state = evaluated(spark, {"covered_sub_questions": [], "confidence": 0.9}, deps=((), ()), evidence=(), history={0: ["q0"], 1: []})
    rows = agent.followup_tasks(state).orderBy("task_order").collect()
    assert [r.subquestion_index for r in rows] == [1, 0]
    assert rows[0].search_queries == ["q1"]
    assert rows[1].search_queries[0].startswith("在知识库中查找能直接回答“q0”的证据")


@pytest.mark.parametrize(
    "values, expected",
    [
        ((True, False, "answer", 1, 0, 0.0, 1, False), "evaluator_fallback"),
        ((False, True, "answer", 1, 0, 0.0, 1, False), "evidence_sufficient"),
        ((False, False, "ask_user", 1, 0, 0.0, 1, False), "need_user_clarification"),
        ((False, False, "rewrite_missing", 3, 0, 0.0, 1, False), "max_iterations_reached"),
        ((False, False, "rewrite_missing", 1, 24, 0.0, 1, False), "max_tool_calls_reached"),
        ((False, False, "rewrite_missing", 1, 0, 60.0, 1, False), "timeout_reached"),
        ((False, False, "rewrite_missing", 2, 0, 0.0, 0, False), "no_new_evidence"),
        ((False, False, "rewrite_missing", 2, 0, 0.0, 0, True), ""),
    ],
)
def test_stop_reasons(spark, values, expected):
    df = spark.createDataFrame(
        [(*values, 1)],
        "evaluator_failed boolean, evidence_sufficient boolean, next_action string, iteration int, calls_used int, elapsed_seconds double, new_evidence int, pending boolean, next_cost int",
    )
    assert df.select(agent.stop_reason(SETTINGS).alias("r")).head().r == expected


def test_evaluation_tolerates_objects_in_text_lists(spark):
    reply = '```json\n{"sufficient": false, "missing_aspects": ["a", {"k": "b", "n": null}, "a"], "contradictions": null, "confidence": 0.5}\n```'
    df = spark.createDataFrame([(reply,), ("no json",), ('{"confidence": 3}',)], "r string")
    rows = [r.e for r in df.select(agent.parse_evaluation(F.col("r")).alias("e")).collect()]
    assert rows[0].missing_aspects == ["a", "b"] and rows[0].contradictions == [] and rows[0].next_action == "rewrite_missing"
    assert rows[1] is None and rows[2] is None


# ------------------------------------------------------------------ scoring


class Fixed:
    """Scores by a table of text -> logit; anything else is an error when strict."""

    def __init__(self, table, bad=None):
        self.table, self.bad = table, bad

    def score(self, pairs):
        if self.bad == "short":
            return [1.0]
        if self.bad == "nan":
            return [float("nan")] * len(pairs)
        if self.bad == "error":
            raise RuntimeError("scorer is down")
        return [self.table.get((q, t.split("切片内容：")[-1]), -9.0) for q, t in pairs]


def grouped(spark):
    rows = [(1, 0, "A", 10, 1, "shared"), (1, 0, "A", 11, 2, "only a"), (1, 1, "B", 12, 1, "only b"), (1, 1, "B", 10, 2, "shared")]
    return spark.createDataFrame(rows, "query_id int, sub_q int, question string, chunk_id int, pos int, content string")


TABLE = {("A", "shared"): 1.0, ("A", "only a"): 2.0, ("B", "only b"): 0.5, ("B", "shared"): 0.2}


def test_groups_rank_separately_and_shared_chunk_keeps_both_owners(spark):
    ranked = rerank.rerank_groups(grouped(spark), lambda: Fixed(TABLE), SETTINGS)
    merged = context.merge_evidence_groups(rerank.group_evidence(ranked, SETTINGS)).orderBy("pos").collect()
    assert [m.chunk_id for m in merged] == [11, 12, 10]
    assert merged[2].retrieved_for_subquestions == [0, 1]
    assert set(merged[2].subquestion_scores) == {0, 1}


@pytest.mark.parametrize("bad", ["short", "nan", "error"])
def test_scorer_failure_keeps_the_fused_order(spark, bad):
    ranked = rerank.rerank_groups(grouped(spark), lambda: Fixed(TABLE, bad), SETTINGS).orderBy("sub_q", "rank").collect()
    assert [(r.sub_q, r.chunk_id, r.rerank_score) for r in ranked] == [(0, 10, None), (0, 11, None), (1, 12, None), (1, 10, None)]


def test_low_scores_do_not_fill_up(spark):
    ranked = rerank.rerank_groups(grouped(spark), lambda: Fixed({("A", "shared"): 1.0}), SETTINGS).collect()
    assert [(r.sub_q, r.chunk_id) for r in ranked] == [(0, 10)]


def test_resolved_dependency_is_part_of_the_scored_question(spark):
    df = grouped(spark).withColumn("resolved_question", F.when(F.col("sub_q") == 1, "method X"))
    table = {("B\n已解析的对象及条件：method X", "only b"): 3.0}
    assert [r.chunk_id for r in rerank.rerank_groups(df, lambda: Fixed(table), SETTINGS).collect()] == [12]


def test_packing_keeps_four_groups_without_repeats(spark):
    rows = [(1, i, i + 1, "x" * 900, [i % 4], f"doc {i}") for i in range(6)] + [(1, 0, 9, "x" * 900, [0], "doc 0")]
    docs = spark.createDataFrame(rows, "query_id int, chunk_id int, pos int, content string, retrieved_for_subquestions array<int>, canonical_title string")
    row = context.pack_grouped_evidence(docs, 1400, 900).head()
    assert len(row.evidence) <= 1400
    assert {int(c) % 4 for c in row.chunk_ids} == {0, 1, 2, 3}
    assert len(set(row.chunk_ids)) == len(row.chunk_ids)


def test_first_of_each_group_may_expand(spark):
    rows = [(1, r, [r % 4]) for r in range(1, 9)]
    df = spark.createDataFrame(rows, "query_id int, rank int, retrieved_for_subquestions array<int>")
    df = df.withColumn("new", context.first_of_group(df))
    opened = df.where(context.should_expand(F.col("rank"), F.lit(None), F.lit(None), F.col("new"))).collect()
    assert sorted(r.rank for r in opened) == [1, 2, 3, 4]


def test_router_order_and_modes(spark):
    rows = [("为什么温度会导致误差", None), ("A和B的区别", None), ("给出原理以及公式", None), ("如何做？结果是什么", None), ("测量电压", None), ("测量电压", True), ("A和B的区别", False)]
    df = spark.createDataFrame(rows, "original_query string, query_needs_planning boolean")
    got = [(r.agentic_active, r.agentic_route_reason) for r in routing.agent_route(df, SETTINGS).collect()]
    assert got == [
        (True, "multi_hop"), (True, "comparison"), (True, "multi_fact"), (True, "multi_fact"), (False, "simple_query"),
        (True, "llm_needs_planning"), (False, "llm_simple_query"),
    ]
    assert routing.agent_route(df, QuerySettings()).head().agentic_route_reason == "disabled"


def test_two_rounds_search_only_what_is_missing(spark):
    plan = {
        "intent": "multi_hop", "sub_questions": ["which method", "how fast is it"],
        "retrieval_tasks": [
            {"subquestion_index": 0, "search_queries": ["method"], "retrieval_tools": ["vector"]},
            {"subquestion_index": 1, "search_queries": ["speed of that method"], "retrieval_tools": ["vector"], "depends_on": [0]},
        ],
    }
    ready = agent.normalize_plans(plans(spark, ("q", plan)), SETTINGS).withColumn("cost", F.lit(1)).select("query_id", "plan", "cost")
    seen = []

    def search(operations):
        seen.append(sorted((o.sub_q, o.query) for o in operations.collect()))
        return operations.select(
            "query_id", "sub_q", F.lit("direct_hybrid").alias("branch"), (F.col("sub_q") + 100).alias("chunk_id"), F.lit(1).alias("rank"),
            F.concat(F.lit("which method how fast is it speed "), F.col("query")).alias("content"),
        )

    def judge(state):
        first = json.dumps({"sufficient": False, "covered_sub_questions": [0], "confidence": 0.9,
                            "followup_tasks": [{"subquestion_index": 1, "search_queries": ["speed of method X"]}]})
        second = json.dumps({"sufficient": True, "covered_sub_questions": [0, 1], "confidence": 0.9, "next_action": "answer"})
        text = F.when(F.array_contains("evidence_subs", 1), second).otherwise(first)
        return state.select("query_id", agent.parse_evaluation(text).alias("evaluation"))

    questions = spark.createDataFrame([(0,)], "query_id int")
    row = plan_rounds(questions, ready, search, judge, SETTINGS).head()
    assert seen == [[(0, "method")], [(1, "speed of method X")]]
    assert (row.stop_reason, row.iteration, row.calls_used) == ("evidence_sufficient", 2, 2)
    assert sorted(e.chunk_id for e in row.evidence) == [100, 101]
