"""Retrieval and answer-quality metrics over evaluation cases."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.functions.text import SPACE, strip

VERSIONED_FIELDS = (
    "query", "relevance", "reference_answer", "expected_query_type", "expected_route_mode", "expected_answerable",
)
_NON_WORD = re.compile(r"[^\w]+")


@F.pandas_udf(T.StringType())
def _compatible(texts: pd.Series) -> pd.Series:
    return texts.map(
        lambda t: None if t is None else _NON_WORD.sub("", unicodedata.normalize("NFKC", t).casefold())
    )


def plain_name(col: Column) -> Column:
    """Compatibility-normalized, case-folded text without anything but word characters.

    ASCII text stays in the JVM; Spark has no Unicode normalization of its own.
    """
    ascii_only = ~col.rlike(r"[^\x00-\x7F]")
    simple = F.regexp_replace(F.lower(col), r"[^a-z0-9_]+", "")
    return F.when(ascii_only, simple).otherwise(_compatible(F.when(~ascii_only, col)))


def criterion_hits(ranked: DataFrame, criteria: DataFrame) -> DataFrame:
    """(case_id, rank, criterion): criteria each retrieved document meets.

    ``ranked`` is (case_id, rank, title, content); ``criteria`` is (case_id, criterion,
    option, title_contains, content_contains_all): any option may hold, and an option holds
    when it demands something and every demand is met. Joined within a case.
    """
    docs = ranked.withColumn("_t", plain_name(F.coalesce("title", F.lit("")))).withColumn(
        "_c", plain_name(F.coalesce("content", F.lit("")))
    ).select("case_id", "rank", "_t", "_c")
    terms = criteria.select("case_id", "criterion", "option", "title_contains", F.posexplode_outer("content_contains_all").alias("i", "term"))
    named = terms.withColumn("_title", plain_name(F.col("title_contains"))).withColumn("_term", plain_name(F.col("term")))
    wanted = named.groupBy("case_id", "criterion", "option").agg(
        F.first("_title").alias("_title"), F.collect_list("_term").alias("_terms")
    )
    demands = F.col("_title").isNotNull() | (F.size("_terms") > 0)
    met = (F.col("_title").isNull() | F.contains("_t", "_title")) & F.forall("_terms", lambda t: F.contains(F.col("_c"), t))
    return docs.join(wanted, "case_id").where(demands & met).select("case_id", "rank", "criterion").distinct()


def rank_metrics(cases: DataFrame, hits: DataFrame, criteria: DataFrame, k: int = 5) -> DataFrame:
    """recall@k over criteria, MRR@k, nDCG@k and the first relevant rank of each case.

    The ideal ranking holds as many relevant documents as were retrieved at any rank; cases
    without criteria get nulls.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    totals = criteria.groupBy("case_id").agg(F.count_distinct("criterion").alias("criteria"))
    recalled = hits.where(F.col("rank") <= k).groupBy("case_id").agg(F.count_distinct("criterion").alias("recalled"))
    relevant = hits.select("case_id", "rank").distinct()
    gain = F.when(F.col("rank") <= k, 1 / F.log2(F.col("rank") + 1.0))
    gains = relevant.groupBy("case_id").agg(
        F.sum(gain).alias("dcg"), F.min(F.when(F.col("rank") <= k, F.col("rank"))).alias("first_relevant_rank"), F.count(F.lit(1)).alias("n")
    )
    df = cases.select("case_id").join(totals, "case_id", "left").join(recalled, "case_id", "left").join(gains, "case_id", "left")
    judged = F.col("criteria").isNotNull()
    ideal = F.aggregate(
        F.sequence(F.lit(1), F.least(F.lit(k), F.col("n").cast("int"))), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1.0)
    )
    zero = F.lit(0.0)
    return df.select(
        "case_id",
        F.when(judged, F.coalesce(F.col("recalled") / F.col("criteria"), zero)).alias("recall_at_k"),
        F.when(judged, F.coalesce(1 / F.col("first_relevant_rank"), zero)).alias("mrr_at_k"),
        F.when(judged, F.coalesce(F.round(F.col("dcg") / F.when(F.col("n") > 0, ideal), 9), zero)).alias("ndcg_at_k"),
        F.when(judged, F.col("first_relevant_rank")).alias("first_relevant_rank"),
    )


def summarize_stages(metrics: DataFrame) -> DataFrame:
    """Mean metrics per stage over cases that have them: (stage, evaluated_cases, ...)."""
    return metrics.where(F.col("recall_at_k").isNotNull()).groupBy("stage").agg(
        F.count(F.lit(1)).alias("evaluated_cases"),
        *[F.round(F.avg(m), 9).alias(m) for m in ("recall_at_k", "mrr_at_k", "ndcg_at_k")],
    )


def activate_annotations(cases: DataFrame, version: str) -> DataFrame:
    """Keep first-version fields aside and, for v2, use the second version where given."""
    if version not in ("v1", "v2"):
        raise ValueError(f"unknown annotation version {version!r}")
    have = set(cases.columns)
    out = cases
    for field in VERSIONED_FIELDS:
        if field not in have:
            continue
        out = out.withColumn(f"{field}_v1", F.col(field))
        if version == "v2" and f"{field}_v2" in have:
            out = out.withColumn(field, F.coalesce(f"{field}_v2", field))
    return out.withColumn("annotation_version", F.lit(version))


def dataset_problems(cases: DataFrame, documents: DataFrame) -> DataFrame:
    """(item, problem): everything that makes an evaluation dataset unusable.

    Cases: id, document_id, query, relevance, expected_answerable, judge_answer, reference_answer.
    """
    repeated_docs = documents.groupBy(F.col("id").cast("string").alias("item")).count().where("count > 1").select("item", F.lit("document id repeats").alias("problem"))
    repeated = cases.groupBy(F.col("id").cast("string").alias("item")).count().where("item is null or item = '' or count > 1")
    known = documents.select(F.col("id").alias("document_id"), F.lit(True).alias("known")).distinct()
    blank = lambda n: F.length(strip(F.coalesce(F.col(n), F.lit("")))) == 0
    per_case = cases.join(known, "document_id", "left").select(
        F.col("id").cast("string").alias("item"),
        F.array(
            F.when(blank("query"), "question is empty"),
            F.when(
                F.coalesce("expected_answerable", F.lit(True)) & (F.col("known").isNull() | (F.coalesce(F.size("relevance"), F.lit(0)) <= 0)),
                "answerable case lacks document or relevance",
            ),
            F.when(F.coalesce("judge_answer", F.lit(False)) & blank("reference_answer"), "judged case lacks a reference answer"),
        ).alias("p"),
    )
    found = per_case.select("item", F.explode("p").alias("problem")).where(F.col("problem").isNotNull())
    return repeated_docs.unionByName(repeated.select("item", F.lit("case id is missing or repeats").alias("problem"))).unionByName(found)


def document_coverage(documents: DataFrame, available: DataFrame) -> DataFrame:
    """(id, covered): whether a document's title or an alias is among the available names."""
    names = documents.select("id", F.explode(F.concat(F.array("canonical_title"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("name"))
    keys = available.select(plain_name(F.col("name")).alias("key")).distinct()
    hit = names.select("id", plain_name(F.coalesce("name", F.lit(""))).alias("key")).join(keys, "key", "left_semi").select("id").distinct()
    return documents.select("id").join(hit.withColumn("covered", F.lit(True)), "id", "left").withColumn("covered", F.coalesce("covered", F.lit(False)))


def round_robin_sample(cases: DataFrame, size: int, group: str = "document_id", order: str = "pos") -> DataFrame:
    """Cases taken in turn from each group, groups in order of first appearance.

    A positive ``size`` limits the sample, so no group can give more than that many rows
    and each is cut to it before the shuffle. ``turn`` orders the result.
    """
    turn = F.row_number().over(Window.partitionBy(group).orderBy(order))
    dealt = cases.withColumn(group, F.coalesce(group, F.lit("__unanswerable__"))).withColumn("turn", turn)
    if size > 0:
        dealt = dealt.where(F.col("turn") <= size)
    opened = cases.groupBy(F.coalesce(group, F.lit("__unanswerable__")).alias(group)).agg(F.min(order).alias("opened"))
    joined = dealt.join(opened, group)
    return joined.orderBy("turn", "opened").limit(size) if size > 0 else joined


def reference_scores(judged: DataFrame) -> DataFrame:
    """Correctness and completeness of judged answers.

    ``judged`` has reference_facts array<struct<covered boolean>>, contradictions (array),
    answerable and refusal_correct. No facts, or missing labels, is an error.
    """
    facts = F.size("reference_facts").cast("double")
    covered = F.size(F.filter("reference_facts", lambda f: f["covered"])).cast("double")
    false_claims = F.coalesce(F.size("contradictions"), F.lit(0)).cast("double")
    bad = (F.coalesce(F.size("reference_facts"), F.lit(0)) <= 0) | F.exists("reference_facts", lambda f: f["covered"].isNull())
    unlabelled = ~F.col("answerable") & F.col("refusal_correct").isNull()
    f1 = 2 * covered / (2 * covered + false_claims + (facts - covered))
    correctness = F.when(F.col("answerable"), f1).otherwise(F.col("refusal_correct").cast("double"))
    message = F.when(bad, "reference facts are missing or unlabelled").when(unlabelled, "refusal is unlabelled")
    checked = F.when(message.isNotNull(), F.raise_error(message).cast("double")).otherwise(correctness)
    return judged.withColumn("correctness", checked).withColumn("completeness", covered / facts).withColumn(
        "contradictory_claims", false_claims.cast("int")
    )


def quote_grounded(quote: Column, context: Column) -> Column:
    """Every piece of a quote between ellipses occurs in the context, white space aside."""
    bare = lambda c: F.regexp_replace(c, f"{SPACE}+", "")
    pieces = F.filter(F.transform(F.split(quote, r"\.{3,}|…+"), bare), lambda p: F.length(p) > 0)
    return (F.size(pieces) > 0) & F.forall(pieces, lambda p: F.contains(bare(context), p))


def faithfulness(judged: DataFrame) -> DataFrame:
    """Share of claims whose support is quoted from the context; null without claims.

    ``judged`` has claims array<struct<supported boolean, evidence_quote string>> and context.
    """
    held = F.filter("claims", lambda c: c["supported"] & quote_grounded(F.coalesce(c["evidence_quote"], F.lit("")), F.col("context")))
    total = F.size("claims")
    return judged.withColumn("supported_claims", F.size(held)).withColumn("total_claims", total).withColumn(
        "faithfulness", F.when(total > 0, F.size(held) / total)
    )


def answer_summary(rows: DataFrame, by: str | None = None) -> DataFrame:
    """Counts and mean answer metrics, overall or per category; missing metrics do not count.

    ``rows`` has answer, error, judged (boolean), correctness, completeness, faithfulness.
    """
    metrics = ("correctness", "completeness", "faithfulness")
    aggregates = [
        F.count(F.lit(1)).alias("attempted"),
        F.count_if(F.length(F.coalesce("answer", F.lit(""))) > 0).alias("answered"),
        F.count_if(F.col("judged")).alias("judged"),
        F.count_if(F.length(F.coalesce("error", F.lit(""))) > 0).alias("failed"),
        *[F.round(F.avg(m), 9).alias(m) for m in metrics],
        *[F.count(m).alias(f"{m}_n") for m in metrics],
    ]
    return rows.groupBy(by).agg(*aggregates) if by else rows.agg(*aggregates)
