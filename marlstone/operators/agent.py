"""Control of multi-step retrieval: plans, call budgets, coverage, stopping and replanning.

Each question is one row of small state, so every step is a transformation over all
questions at once. Only query similarity needs Python's matcher; it is a row helper.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.config import QuerySettings
from marlstone.functions.text import collapse_spaces, strip, unique_strings
from marlstone.operators.formulas import json_object

# Search tools in order, intents, next actions, stop reasons and wording.
TOOLS = ("vector", "bm25", "hyde")
NEXT_ACTIONS = ("answer", "rewrite_missing", "expand_scope", "ask_user")
QUERIES_PER_TASK, PLAN_QUERIES, FOCUSED_QUERIES = 2, 5, 4
SIMILAR_RATIO, CONTAINED_LENGTH = 0.90, 12
CLARIFY, CLARIFY_DEFAULT = "当前问题还需要进一步确认：", "需要明确检索对象或范围"
EVERYWHERE = "在知识库中"
REFINED = "{scope}查找能直接回答“{query}”的证据，重点检索原因、条件、公式、实验数据或验证结论"

_strings = T.ArrayType(T.StringType())
TASK = T.StructType(
    [
        T.StructField("subquestion_index", T.IntegerType()),
        T.StructField("search_queries", _strings),
        T.StructField("retrieval_tools", _strings),
        T.StructField("depends_on", T.ArrayType(T.IntegerType())),
    ]
)
PLAN = T.StructType(
    [
        T.StructField("intent", T.StringType()),
        T.StructField("objective", T.StringType()),
        T.StructField("sub_questions", _strings),
        T.StructField("search_queries", _strings),
        T.StructField("retrieval_tasks", T.ArrayType(TASK)),
        T.StructField("document_hints", _strings),
        T.StructField("retrieval_profile", T.StringType()),
        T.StructField("retrieval_tools", _strings),
        T.StructField("success_criteria", _strings),
    ]
)
EVALUATION = T.StructType(
    [
        T.StructField("sufficient", T.BooleanType()),
        T.StructField("covered_sub_questions", T.ArrayType(T.IntegerType())),
        T.StructField("missing_subquestion_indices", T.ArrayType(T.IntegerType())),
        T.StructField(
            "followup_tasks",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("subquestion_index", T.IntegerType()),
                        T.StructField("search_queries", _strings),
                        T.StructField("resolved_question", T.StringType()),
                    ]
                )
            ),
        ),
        T.StructField("missing_aspects", _strings),
        T.StructField("contradictions", _strings),
        T.StructField("next_action", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
    ]
)
UNDERSTANDING = T.StructType(
    [
        T.StructField("document_mentions", _strings),
        T.StructField("rewritten_query", T.StringType()),
        T.StructField("needs_planning", T.BooleanType()),
    ]
)


def parse_reply(reply: Column, schema: T.StructType) -> Column:
    """A model reply as a typed struct; null when it holds no JSON object or wrong types."""
    return F.from_json(json_object(reply), schema)


def parse_understanding(reply: Column) -> Column:
    """Mentions, rewritten query and planning need; a value of the wrong type is ignored."""
    return parse_reply(reply, UNDERSTANDING)


def parse_evaluation(reply: Column) -> Column:
    """An evidence evaluation with defaults; objects in text lists become joined values."""
    body = F.try_parse_json(json_object(reply))
    parsed = F.from_json(
        json_object(reply),
        T.StructType([f for f in EVALUATION if f.name not in ("missing_aspects", "contradictions")]),
    )

    def texts(path: str) -> Column:
        items = F.coalesce(
            F.try_variant_get(body, path, "array<variant>"),
            F.when(~F.coalesce(F.is_variant_null(F.try_variant_get(body, path, "variant")), F.lit(True)), F.array(F.try_variant_get(body, path, "variant"))),
        )
        fields = lambda v: F.filter(
            F.transform(F.map_values(F.try_variant_get(v, "$", "map<string,string>")), strip), lambda t: t.isNotNull() & (F.length(t) > 0)
        )
        text = lambda v: F.coalesce(
            F.nullif(F.array_join(fields(v), "；"), F.lit("")), strip(F.try_variant_get(v, "$", "string"))
        )
        return F.coalesce(
            F.array_distinct(F.filter(F.transform(items, text), lambda t: F.length(t) > 0)), F.array().cast("array<string>")
        )

    valid = (
        parsed.isNotNull()
        & F.coalesce(parsed["next_action"], F.lit("rewrite_missing")).isin(*NEXT_ACTIONS)
        & F.coalesce(parsed["confidence"], F.lit(0.0)).between(0.0, 1.0)
    )
    ints = F.array().cast("array<int>")
    return F.when(
        valid,
        F.struct(
            F.coalesce(parsed["sufficient"], F.lit(False)).alias("sufficient"),
            F.coalesce(parsed["covered_sub_questions"], ints).alias("covered_sub_questions"),
            F.coalesce(parsed["missing_subquestion_indices"], ints).alias("missing_subquestion_indices"),
            parsed["followup_tasks"].alias("followup_tasks"),
            texts("$.missing_aspects").alias("missing_aspects"),
            texts("$.contradictions").alias("contradictions"),
            F.coalesce(parsed["next_action"], F.lit("rewrite_missing")).alias("next_action"),
            F.coalesce(parsed["confidence"], F.lit(0.0)).alias("confidence"),
        ),
    )


# ------------------------------------------------------------------ planning


# The letters that make a text Chinese, two words in Latin letters, what a comparison ignores.
_HAN = "[一-鿿]"
_LATIN_WORDS = "[A-Za-z][^A-Za-z]+[A-Za-z]"
_NOISE = r"[^\p{L}\p{N}_]+"


def _comparable(texts: Column) -> Column:
    """Search texts with the keys by which they are compared; texts without a key go."""
    tidy = F.transform(F.coalesce(texts, F.array().cast(_strings)), lambda t: collapse_spaces(F.coalesce(t, F.lit(""))))
    keyed = F.transform(tidy, lambda t: F.struct(t.alias("text"), F.lower(F.regexp_replace(t, _NOISE, "")).alias("key")))
    return F.filter(keyed, lambda t: t["key"] != "")


def _alike(key: str, earlier: str) -> bool:
    if key == earlier or SequenceMatcher(None, key, earlier).ratio() >= SIMILAR_RATIO:
        return True
    return min(len(key), len(earlier)) >= CONTAINED_LENGTH and (key in earlier or earlier in key)


@F.pandas_udf(T.ArrayType(T.ArrayType(T.ArrayType(T.IntegerType()))))
def _earlier_alike(lists: pd.Series) -> pd.Series:
    """For each key of each list the places of the keys before it that are alike."""
    places = lambda keys: [[j for j in range(i) if _alike(keys[i], keys[j])] for i in range(len(keys))]
    return lists.map(lambda row: [places(list(keys)) for keys in row])


# Marked as not deterministic so that it is computed once and never inlined where a Python
# function cannot run (inside lambdas or inferred filters).
_earlier_alike = _earlier_alike.asNondeterministic()


def _new_texts(rows: Column, alike: Column, source: Column, limit: int) -> Column:
    """Texts in order, without those alike to one taken before or a second English one for a Chinese source."""
    chinese = F.coalesce(source, F.lit("")).rlike(_HAN)
    numbered = F.zip_with(
        F.transform(rows, lambda r, i: F.struct(i.alias("i"), (~r["text"].rlike(_HAN) & r["text"].rlike(_LATIN_WORDS)).alias("english"))),
        alike, lambda r, a: F.struct(r["i"].alias("i"), r["english"].alias("english"), a.alias("alike")),
    )

    def take(acc: Column, r: Column) -> Column:
        new = (F.size(acc["taken"]) < limit) & ~F.arrays_overlap(acc["taken"], r["alike"]) & ~(chinese & r["english"] & acc["english"])
        return F.when(
            new, F.struct(F.array_append(acc["taken"], r["i"]).alias("taken"), (acc["english"] | r["english"]).alias("english"))
        ).otherwise(acc)

    start = F.struct(F.array().cast("array<int>").alias("taken"), F.lit(False).alias("english"))
    return F.transform(F.aggregate(numbered, start, take, lambda acc: acc["taken"]), lambda i: F.get(rows, i)["text"])


def distinct_queries(df: DataFrame, name: str, texts: Column, source: str, limit: int) -> DataFrame:
    """Adds search texts that say something new; a Chinese question gets at most one English one."""
    df = df.withColumn("_rows", _comparable(texts))
    df = df.withColumn("_alike", _earlier_alike(F.array(F.transform("_rows", lambda r: r["key"]))))
    return df.withColumn(name, _new_texts(F.col("_rows"), F.col("_alike")[0], F.col(source), limit)).drop("_rows", "_alike")


def fallback_plan(query: Column, reason: Column, settings: QuerySettings = QuerySettings()) -> Column:
    """A single-question plan when no model plan is usable."""
    intent = F.when(reason.isin("comparison", "multi_hop"), reason).otherwise("multi_fact")
    profile = F.when(reason == "comparison", "comparison").otherwise("deep")
    tools = F.array(*[F.lit(t) for t in _profile_tools(settings)])
    return F.struct(
        intent.alias("intent"), query.alias("objective"), F.array(query).alias("sub_questions"),
        F.array(query).alias("search_queries"), F.array().cast(T.ArrayType(TASK)).alias("retrieval_tasks"),
        F.array().cast(_strings).alias("document_hints"), profile.alias("retrieval_profile"),
        tools.alias("retrieval_tools"), F.array().cast(_strings).alias("success_criteria"),
    )


def _profile_tools(settings: QuerySettings, profile: str = "deep") -> tuple[str, ...]:
    if profile == "fast" or not settings.agent_hyde_enabled:
        return ("vector", "bm25")
    return ("vector", "hyde", "bm25")


def normalize_plans(df: DataFrame, settings: QuerySettings = QuerySettings()) -> DataFrame:
    """Make plans safe to run: (query_text, plan struct) to a bounded, consistent plan.

    Adds ``plan_problem``: empty sub-questions referenced by tasks, or a dependency that
    does not point to an earlier sub-question. Such a plan must not run.
    """
    p = F.col("plan")
    limit = settings.agent_max_subquestions
    none = F.array().cast(_strings)
    given = F.coalesce(p["sub_questions"], none)
    has_tasks = F.coalesce(F.size(p["retrieval_tasks"]), F.lit(0)) > 0
    unique = unique_strings(given, limit)
    fallback = F.coalesce(F.nullif(unique_strings(F.array("query_text"), limit), none), F.array("query_text"))
    questions = F.when(has_tasks, F.transform(F.slice(given, 1, limit), strip)).otherwise(
        F.when(F.size(unique) > 0, unique).otherwise(fallback)
    )
    df = df.withColumn("_questions", questions).withColumn("_tasked", has_tasks)
    df = distinct_queries(df, "_focused", p["search_queries"], "query_text", FOCUSED_QUERIES)
    backup = F.when(F.size("_focused") == 0, F.col("_questions")).otherwise(none)
    every = F.concat(F.array("query_text"), F.col("_focused"), backup)
    df = distinct_queries(df, "_searches", every, "query_text", PLAN_QUERIES)

    named = F.filter(F.coalesce(p["retrieval_tools"], none), lambda t: t.isin(*TOOLS))
    by_profile = F.when(p["retrieval_profile"] == "fast", F.array(*[F.lit(t) for t in _profile_tools(settings, "fast")])).otherwise(
        F.array(*[F.lit(t) for t in _profile_tools(settings)])
    )
    tools = F.when(F.size(named) > 0, named).otherwise(by_profile)
    tools = F.when(F.array_contains(tools, "vector"), tools).otherwise(F.concat(F.array(F.lit("vector")), tools))
    if not settings.agent_hyde_enabled:
        tools = F.filter(tools, lambda t: t != "hyde")
    tools = F.when(F.array_contains(tools, "bm25"), tools).otherwise(F.array_append(tools, F.lit("bm25")))
    df = df.withColumn("_tools", F.slice(F.array_distinct(tools), 1, settings.agent_max_tool_calls))

    # One entry per sub-question: its tasks merged in order, or a default task.
    def merged(question: Column, i: Column) -> Column:
        mine = F.filter(F.coalesce(p["retrieval_tasks"], F.array().cast(T.ArrayType(TASK))), lambda t: t["subquestion_index"] == i)
        wanted = F.coalesce(F.try_element_at(mine, F.lit(-1))["retrieval_tools"], none)
        usable = F.filter(F.when(F.size(wanted) > 0, wanted).otherwise(F.col("_tools")), lambda t: F.array_contains("_tools", t))
        return F.struct(
            i.alias("i"), question.alias("question"),
            F.flatten(F.transform(mine, lambda t: F.coalesce(t["search_queries"], none))).alias("queries"),
            F.when(F.size(usable) > 0, usable).otherwise(F.col("_tools")).alias("tools"),
            F.array_distinct(F.flatten(F.transform(mine, lambda t: F.coalesce(t["depends_on"], F.array().cast("array<int>"))))).alias("deps"),
        )

    df = df.withColumn("_merged", F.transform("_questions", merged))
    # A Python result may be an argument of a higher-order function but not used inside one.
    df = df.withColumn("_each", F.transform("_merged", lambda m: F.struct(m["question"].alias("question"), _comparable(m["queries"]).alias("rows"))))
    df = df.withColumn("_alike_each", _earlier_alike(F.transform("_each", lambda m: F.transform(m["rows"], lambda r: r["key"]))))
    df = df.withColumn("_task_queries", F.zip_with("_each", "_alike_each", lambda m, a: _new_texts(m["rows"], a, m["question"], QUERIES_PER_TASK)))
    tasks = F.zip_with(
        "_merged",
        "_task_queries",
        lambda m, queries: F.struct(
            m["i"].alias("subquestion_index"),
            F.coalesce(F.nullif(queries, none), F.array(m["question"])).alias("search_queries"),
            m["tools"].alias("retrieval_tools"),
            m["deps"].alias("depends_on"),
        ),
    )
    df = df.withColumn("_tasks", tasks)
    problem = F.when(
        F.col("_tasked") & ((F.size("_questions") == 0) | F.exists("_questions", lambda q: F.length(q) == 0)), "empty sub-question"
    ).when(
        F.exists("_merged", lambda m: F.exists(m["deps"], lambda d: (d < 0) | (d >= m["i"]))), "dependency is not an earlier sub-question"
    )
    single = (F.size("_questions") == 1) & F.col("_tasked")
    df = distinct_queries(df, "_one", F.concat(F.array("query_text"), F.col("_tasks")[0]["search_queries"]), "query_text", PLAN_QUERIES)
    searches = F.when(single, F.col("_one")).otherwise(F.when(F.size("_searches") > 0, F.col("_searches")).otherwise(F.array("query_text")))
    criteria = unique_strings(F.coalesce(p["success_criteria"], none), limit)
    criteria = F.when(F.size(criteria) > 0, criteria).otherwise(
        F.transform("_questions", lambda q: F.concat(F.lit("找到能够直接回答“"), q, F.lit("”的证据")))
    )
    plan = F.struct(
        p["intent"].alias("intent"),
        F.coalesce(F.nullif(p["objective"], F.lit("")), F.col("query_text")).alias("objective"),
        F.col("_questions").alias("sub_questions"), searches.alias("search_queries"), F.col("_tasks").alias("retrieval_tasks"),
        unique_strings(F.coalesce(p["document_hints"], none), settings.document_route_max_options).alias("document_hints"),
        p["retrieval_profile"].alias("retrieval_profile"), F.col("_tools").alias("retrieval_tools"), criteria.alias("success_criteria"),
    )
    made = ["_questions", "_tasked", "_focused", "_searches", "_tools", "_merged", "_each", "_alike_each", "_task_queries", "_tasks", "_one"]
    return df.withColumn("plan_problem", problem).withColumn("plan", plan).drop(*made)


# ------------------------------------------------------------------ budget


def call_cost(soft_ids: Column, hard_ids: Column, locked: Column) -> Column:
    """A search counts double when it may need a second request."""
    two = (F.coalesce(F.size(soft_ids), F.lit(0)) > 0) | ((F.coalesce(F.size(hard_ids), F.lit(0)) > 0) & ~F.coalesce(locked, F.lit(False)))
    return F.when(two, 2).otherwise(1)


def schedule(tasks: DataFrame, settings: QuerySettings = QuerySettings()) -> DataFrame:
    """Operations the call budget allows: (query_id, sub_q, tool, query, request_budget, turn).

    ``tasks`` is (query_id, task_order, subquestion_index, search_queries, retrieval_tools,
    calls_used, cost). Every task gets its first operation before any gets its second. All
    operations of a question cost the same, so a budget is a number of rows per question.
    """
    enabled = [t for t in TOOLS if (t != "bm25" or settings.bm25_enabled) and (t != "hyde" or settings.agent_hyde_enabled)]
    tools = F.filter(F.array(*[F.lit(t) for t in enabled]), lambda t: F.array_contains("retrieval_tools", t))
    tools = F.when(F.size(tools) > 0, tools).otherwise(F.array(F.lit("vector")))
    cleaned = F.filter(F.transform("search_queries", strip), lambda q: F.length(q) > 0)
    queries = F.slice(F.array_distinct(cleaned), 1, QUERIES_PER_TASK)
    base = tasks.withColumn("_tools", tools).withColumn("_queries", queries)
    operations = F.flatten(
        F.transform(
            "_queries",
            lambda q, i: F.transform(
                F.filter("_tools", lambda t: (t != "hyde") | (i == 0)),
                lambda t: F.struct(t.alias("tool"), q.alias("query")),
            ),
        )
    )
    each = base.select(
        "query_id", "task_order", F.col("subquestion_index").alias("sub_q"), "calls_used", "cost",
        F.posexplode(operations).alias("position", "op"),
    )
    turn = F.row_number().over(Window.partitionBy("query_id").orderBy("position", "task_order"))
    allowed = F.floor(F.greatest(F.lit(0), settings.agent_max_tool_calls - F.col("calls_used")) / F.col("cost"))
    # The constant bound lets Spark cut each question before the shuffle.
    bounded = each.withColumn("turn", turn).where(F.col("turn") <= settings.agent_max_tool_calls)
    return bounded.where(F.col("turn") <= allowed).select(
        "query_id", "sub_q", "op.tool", "op.query", F.col("cost").alias("request_budget"), "turn"
    )


def ready_tasks(plans: DataFrame) -> DataFrame:
    """First-round tasks: those of a plan that depend on no other sub-question."""
    each = plans.select("query_id", "calls_used", "cost", F.posexplode("plan.retrieval_tasks").alias("task_order", "t"))
    return each.where(F.coalesce(F.size("t.depends_on"), F.lit(0)) <= 0).select(
        "query_id", "task_order", "t.subquestion_index", "t.search_queries", "t.retrieval_tools", "calls_used", "cost"
    )


# ------------------------------------------------------------------ evaluation


def repair_coverage(df: DataFrame, settings: QuerySettings = QuerySettings()) -> DataFrame:
    """Hold an evaluation to the evidence: covered, missing, sufficient and next action.

    ``df`` has plan, evaluation and evidence_subs (sub-questions with any evidence). A claim
    without evidence or out of range is dropped, and a sub-question whose dependency is
    missing is missing too, in task order.
    """
    e = F.col("evaluation")
    total = F.size("plan.sub_questions")
    every = F.when(total > 0, F.sequence(F.lit(0), total - 1)).otherwise(F.array().cast("array<int>"))
    inside = lambda i: (i >= 0) & (i < total)
    covered = F.array_distinct(
        F.filter(e["covered_sub_questions"], lambda i: inside(i) & F.array_contains(F.coalesce("evidence_subs", F.array().cast("array<int>")), i))
    )
    df = df.withColumn("_covered", covered)
    missing = F.array_union(F.filter(e["missing_subquestion_indices"], inside), F.array_except(every, "_covered"))
    closed = F.aggregate(
        F.coalesce(F.col("plan.retrieval_tasks"), F.array().cast(T.ArrayType(TASK))),
        missing,
        lambda acc, t: F.when(F.arrays_overlap(F.coalesce(t["depends_on"], F.array().cast("array<int>")), acc), F.array_union(acc, F.array(t["subquestion_index"]))).otherwise(acc),
    )
    df = df.withColumn("_missing", closed)
    doubtful = ~e["sufficient"] | (F.size(e["missing_aspects"]) > 0) | (e["confidence"] < settings.agent_min_evidence_confidence)
    df = df.withColumn("_missing", F.array_sort(F.when((F.size("_missing") == 0) & doubtful, every).otherwise(F.col("_missing"))))
    none_missing = F.size("_missing") == 0
    action = F.when(~none_missing & (e["next_action"] == "answer"), "rewrite_missing").otherwise(e["next_action"])
    return (
        df.withColumn("covered_subs", F.array_sort(F.array_except("_covered", "_missing")))
        .withColumn("missing_subs", F.col("_missing"))
        .withColumn("next_action", action)
        .withColumn(
            "evidence_sufficient",
            e["sufficient"] & none_missing & (F.size(e["missing_aspects"]) == 0) & (e["confidence"] >= settings.agent_min_evidence_confidence),
        )
        .drop("_covered", "_missing")
    )


def stop_reason(settings: QuerySettings = QuerySettings()) -> Column:
    """Why a question stops after an evaluation, or the empty string to go on.

    Uses evaluator_failed, evidence_sufficient, next_action, iteration, calls_used,
    next_cost, elapsed_seconds, new_evidence (count) and pending (a sub-question never run).
    """
    return (
        F.when(F.col("evaluator_failed"), "evaluator_fallback")
        .when(F.col("evidence_sufficient"), "evidence_sufficient")
        .when(F.col("next_action") == "ask_user", "need_user_clarification")
        .when(F.col("iteration") >= settings.agent_max_iterations, "max_iterations_reached")
        .when(F.col("calls_used") + F.col("next_cost") > settings.agent_max_tool_calls, "max_tool_calls_reached")
        .when(F.col("elapsed_seconds") >= settings.agent_timeout_seconds, "timeout_reached")
        .when((F.col("iteration") > 1) & (F.col("new_evidence") == 0) & ~F.col("pending"), "no_new_evidence")
        .otherwise("")
    )


def clarification(missing_aspects: Column) -> Column:
    wanted = F.when(F.size(missing_aspects) > 0, missing_aspects).otherwise(F.array(F.lit(CLARIFY_DEFAULT)))
    return F.concat(F.lit(CLARIFY), F.array_join(wanted, "；"))


# ------------------------------------------------------------------ replanning


def widen_scope(df: DataFrame) -> DataFrame:
    """One step wider where asked and not locked: hard to soft, soft to global.

    Uses next_action, mode, locked, hard_ids, soft_ids and candidate_ids.
    """
    asked = F.col("next_action") == "expand_scope"
    moves = asked & ~F.col("locked")
    from_hard = moves & (F.col("mode") == "hard")
    from_soft = moves & (F.col("mode") == "soft")
    none = F.array().cast(_strings)
    reason = (
        F.when(asked & F.col("locked"), "locked_scope_preserved")
        .when(from_hard, "evidence_expand_hard_to_soft")
        .when(from_soft, "evidence_expand_soft_to_global")
        .when(moves, "evidence_scope_already_global")
    )
    known = unique_strings(F.concat(F.coalesce("hard_ids", none), F.coalesce("candidate_ids", none)))
    return (
        df.withColumn("scope_reason", reason)
        .withColumn("soft_ids", F.when(from_hard, known).when(moves, none).otherwise(F.col("soft_ids")))
        .withColumn("hard_ids", F.when(from_hard | from_soft, none).otherwise(F.col("hard_ids")))
        .withColumn("mode", F.when(from_hard, "soft").when(moves, "global").otherwise(F.col("mode")))
    )


def refine(query: Column, hints: Column) -> Column:
    """A search text already used once more, with its scope and the evidence it needs."""
    names = unique_strings(F.coalesce(hints, F.array().cast(_strings)), 2)
    scope = F.when(F.size(names) > 0, F.concat(F.lit("在"), F.array_join(names, "、"), F.lit("中"))).otherwise(EVERYWHERE)
    before, after = REFINED.replace("{scope}", "").split("{query}")
    return F.concat(scope, F.lit(before), query, F.lit(after))


def new_queries(wanted: Column, history: Column, hints: Column, limit: int) -> Column:
    """Search texts not run before; repeated ones are refined once, then dropped."""
    past = F.coalesce(history, F.array().cast(_strings))
    tried = F.transform(
        unique_strings(wanted, limit), lambda q: F.when(F.array_contains(past, q), refine(q, hints)).otherwise(q)
    )
    return F.array_distinct(F.filter(tried, lambda q: (F.length(q) > 0) & ~F.array_contains(past, q)))


def followup_tasks(state: DataFrame) -> DataFrame:
    """Tasks of the next round: missing sub-questions that can run, never-run ones first.

    ``state`` has query_id, plan, evaluation, missing_subs, covered_subs, history
    (map sub_q -> texts run), calls_used and cost. A dependent sub-question waits for
    covered dependencies and a follow-up text that names what they resolved.
    """
    e = F.col("evaluation.followup_tasks")
    none = F.array().cast(_strings)
    each = state.select(
        "query_id", "calls_used", "cost", "missing_subs", "covered_subs", "history", e.alias("followups"),
        F.col("plan.document_hints").alias("hints"), F.posexplode("plan.retrieval_tasks").alias("task_order", "t"),
    )
    index = F.col("t.subquestion_index")
    mine = F.filter(F.coalesce("followups", F.array().cast(EVALUATION["followup_tasks"].dataType)), lambda f: f["subquestion_index"] == index)
    texts = F.flatten(F.transform(mine, lambda f: F.coalesce(f["search_queries"], none)))
    resolved = F.filter(F.transform(mine, lambda f: strip(F.coalesce(f["resolved_question"], F.lit("")))), lambda t: F.length(t) > 0)
    depends = F.coalesce(F.size("t.depends_on"), F.lit(0)) > 0
    each = each.withColumn("texts", texts).withColumn("past", F.coalesce(F.try_element_at("history", index), none))
    each = each.withColumn("explicit", F.try_element_at(resolved, F.lit(-1)))
    ready = (
        F.array_contains("missing_subs", index)
        & (F.size(F.array_except(F.coalesce("t.depends_on", F.array().cast("array<int>")), "covered_subs")) == 0)
        & (~depends | (F.size("texts") > 0))
    )
    source = F.when(F.size("texts") > 0, F.col("texts")).otherwise(F.col("t.search_queries"))
    queries = new_queries(source, F.col("past"), F.col("hints"), QUERIES_PER_TASK)
    rows = each.where(ready).withColumn("search_queries", queries).where(F.size("search_queries") > 0)
    order = Window.partitionBy("query_id").orderBy(F.size("past") > 0, "task_order")
    return rows.select(
        "query_id", F.row_number().over(order).alias("task_order"), index.alias("subquestion_index"), "search_queries",
        F.col("t.retrieval_tools").alias("retrieval_tools"), "calls_used", "cost",
        F.coalesce("explicit", F.when(depends, F.col("search_queries")[0])).alias("resolved_question"),
    )
