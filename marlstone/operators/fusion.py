"""Reciprocal-rank fusion of ranked lists, with protected entries.

Inputs are already cut to the best few rows per list, so every group here is bounded by
the number of lists times their limit.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.config import QuerySettings
from marlstone.session import materialize

# Scores are compared after this rounding so the order of summation cannot change a rank.
SCORE_DECIMALS = 12
# Branch names in the order their hits are seen.
BRANCHES = ("direct_hybrid", "hyde", "bm25")


def branch_weights(settings: QuerySettings = QuerySettings()) -> dict[str, float]:
    return dict(
        zip(BRANCHES, (settings.rrf_direct_weight, settings.rrf_hyde_weight, settings.rrf_bm25_weight))
    )


def _reciprocal(weight: Column, rank: Column, k: int) -> Column:
    return F.round(F.sum(weight / (k + rank)), SCORE_DECIMALS)


def first_filled(column: str, *order: str) -> Column:
    """Value of the earliest row where the column is neither null nor empty."""
    return F.min(F.when(~_is_blank(F.col(column)), F.struct(*order, F.col(column).alias("v"))))["v"]


def _is_blank(col: Column) -> Column:
    return col.isNull() | F.coalesce(col.cast("string") == "", F.lit(False))


def _limit_protected(df: DataFrame, by: Sequence[str], order: list[Column], limit: int) -> DataFrame:
    """Keep ``limit`` rows per group by ``order``, swapping in rows with a ``guard`` position.

    Guarded rows outside the limit replace unguarded ones from the end, in guard order,
    until no unguarded row is left.
    """
    group = Window.partitionBy(*by)
    placed = df.withColumn("place", F.row_number().over(group.orderBy(*order)))
    inside, guarded = F.col("place") <= limit, F.col("guard").isNotNull()
    kind = F.when(inside & guarded, 0).when(guarded, 1).when(inside, 2).otherwise(3)
    kinds = placed.withColumn("kind", kind)
    turn = F.row_number().over(
        Window.partitionBy(*by, "kind").orderBy(F.when(F.col("kind") == 1, F.col("guard")), "place")
    )
    counted = kinds.withColumn("turn", turn).withColumn(
        "open", F.count(F.when(F.col("kind") == 2, 1)).over(group)
    ).withColumn("waiting", F.count(F.when(F.col("kind") == 1, 1)).over(group))
    swapped = F.least("open", "waiting")
    keep = (
        (F.col("kind") == 0)
        | ((F.col("kind") == 1) & (F.col("turn") <= swapped))
        | ((F.col("kind") == 2) & (F.col("turn") <= F.col("open") - swapped))
    )
    return counted.where(keep).drop("place", "kind", "turn", "open", "waiting", "guard")


def merge_lists(
    hits: DataFrame,
    limit: int,
    *,
    by: Sequence[str] = ("query_id",),
    rrf_k: int = 60,
    min_per_list: int = 0,
) -> DataFrame:
    """Fuse lists of one branch: hits(*by, list_name, list_order, weight, chunk_id, rank).

    Adds the fused score, each list's rank and the new rank. With ``min_per_list`` every
    list keeps that many entries no earlier list has kept.
    """
    by = list(by)
    guarded = limit > 0 and min_per_list > 0
    if guarded:
        # Ranked hits are few and read twice below; the searches behind them are not repeated.
        hits = materialize(hits, "hits")
    merged = hits.groupBy(*by, "chunk_id").agg(
        _reciprocal(F.col("weight"), F.col("rank"), rrf_k).alias("branch_fusion_score"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("list_name", "rank")))).alias("branch_ranks"),
        F.min(F.struct("list_order", "rank")).alias("first_seen"),
    )
    order = [F.col("branch_fusion_score").desc(), F.col("first_seen").asc(), F.col("chunk_id").asc()]
    if guarded:
        guards = _list_leaders(hits, by, min_per_list)
        merged = _limit_protected(merged.join(guards, [*by, "chunk_id"], "left"), by, order, limit)
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    ranked = merged.withColumn("rank", rank).drop("first_seen")
    return ranked.where(F.col("rank") <= limit) if limit > 0 else ranked


def _list_leaders(hits: DataFrame, by: list[str], per_list: int) -> DataFrame:
    """(*by, chunk_id, guard): first entries of each list that no earlier list holds."""
    ordered = lambda name: F.array_sort(F.collect_list(F.struct("rank", "chunk_id")))
    lists = hits.groupBy(*by, "list_order").agg(ordered("x").alias("entries"))
    per_query = lists.groupBy(*by).agg(
        F.array_sort(F.collect_list(F.struct("list_order", F.col("entries.chunk_id").alias("ids")))).alias("lists")
    )
    kind = hits.schema["chunk_id"].dataType.simpleString()
    leaders = F.aggregate(
        "lists",
        F.array().cast(f"array<{kind}>"),
        lambda acc, item: F.concat(
            acc, F.slice(F.filter(item["ids"], lambda c: ~F.array_contains(acc, c)), 1, per_list)
        ),
    )
    return per_query.select(*by, F.posexplode(leaders).alias("guard", "chunk_id"))


def fuse_branches(
    hits: DataFrame,
    settings: QuerySettings = QuerySettings(),
    *,
    by: Sequence[str] = ("query_id",),
    payload: Sequence[str] = (),
) -> DataFrame:
    """Weighted fusion across branches: hits(*by, branch, chunk_id, rank[, branch_ranks]).

    Returns fused score, fused rank, sorted sources, each branch's rank, the ranks per
    query variant, and payload columns filled from the first branch that has them.
    """
    by = list(by)
    weights = branch_weights(settings)
    order_map = F.create_map(*[F.lit(x) for pair in ((b, i) for i, b in enumerate(weights)) for x in pair])
    weight_map = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
    if "branch_ranks" not in hits.columns:
        hits = hits.withColumn("branch_ranks", F.lit(None).cast("map<string,int>"))
    known = hits.where(F.col("branch").isin(*weights)).select(
        *by, "branch", "chunk_id", "rank", "branch_ranks", *payload,
        order_map[F.col("branch")].alias("branch_order"), weight_map[F.col("branch")].alias("weight"),
    )
    variants = F.transform(
        F.filter(
            F.map_entries(F.coalesce("branch_ranks", F.create_map().cast("map<string,int>"))),
            lambda e: e["key"].startswith("query_") & (e["value"] > 0),
        ),
        lambda e: F.struct(e["key"].alias("name"), F.col("branch"), e["value"].alias("rank")),
    )
    merged = known.withColumn("variants", variants).groupBy(*by, "chunk_id").agg(
        _reciprocal(F.col("weight"), F.col("rank"), settings.rrf_k).alias("fusion_score"),
        F.array_sort(F.collect_set("branch")).alias("retrieval_sources"),
        *[F.max(F.when(F.col("branch") == b, F.col("rank"))).alias(f"{b}_rank") for b in weights],
        F.array_sort(F.flatten(F.collect_list("variants"))).alias("variants"),
        F.min(F.struct("branch_order", "rank")).alias("first_seen"),
        *[first_filled(c, "branch_order", "rank").alias(c) for c in payload],
    )
    order = [F.col("fusion_score").desc(), F.col("first_seen").asc(), F.col("chunk_id").asc()]
    limit = settings.rrf_max_results
    if limit > 0 and settings.rrf_min_exclusive_per_branch > 0:
        alone = F.when(F.size("retrieval_sources") == 1, F.col("retrieval_sources")[0])
        turn = F.row_number().over(Window.partitionBy(*by, "alone").orderBy(*order))
        held = merged.withColumn("alone", alone).withColumn("turn", turn)
        guard = F.when(
            F.col("alone").isNotNull() & (F.col("turn") <= settings.rrf_min_exclusive_per_branch),
            F.struct((-F.col("fusion_score")).alias("s"), F.col("chunk_id")),
        )
        merged = _limit_protected(held.withColumn("guard", guard).drop("alone", "turn"), by, order, limit)
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    ranked = merged.withColumn("rrf_rank", rank)
    if limit > 0:
        ranked = ranked.where(F.col("rrf_rank") <= limit)
    names = F.array_distinct(F.transform("variants", lambda v: v["name"]))
    number = lambda n: F.coalesce(F.regexp_extract(n, "_([0-9]+)$", 1).try_cast("int"), F.lit(10**9))
    in_order = F.transform(
        F.array_sort(F.transform(names, lambda n: F.struct(number(n).alias("i"), n.alias("n")))), lambda s: s["n"]
    )
    ranks_of = lambda n: F.map_from_entries(
        F.transform(F.filter("variants", lambda v: v["name"] == n), lambda v: F.struct(v["branch"], v["rank"]))
    )
    return (
        ranked.withColumn("retrieval_query_names_hit", in_order)
        .withColumn(
            "subquery_ranks",
            F.map_from_arrays(F.col("retrieval_query_names_hit"), F.transform("retrieval_query_names_hit", ranks_of)),
        )
        .drop("variants", "first_seen")
    )


def truncate_at_cliff(
    ranked: DataFrame,
    *,
    by: Sequence[str] = ("query_id",),
    rank: str = "rank",
    score: str = "score",
    settings: QuerySettings = QuerySettings(),
) -> DataFrame:
    """Cut each ranking at its largest score gap between the least and most rows to keep.

    Only gaps over the threshold count and the first of equal gaps wins; a missing score
    keeps all of the allowed rows.
    """
    group = Window.partitionBy(*by)
    top = ranked.where(F.col(rank) <= settings.rerank_max_top_k)
    gap = F.col(score) - F.lead(score).over(group.orderBy(rank))
    seen = top.withColumn("upper", F.max(rank).over(group)).withColumn("gap", gap)
    eligible = (
        (F.col(rank) >= F.least(F.lit(settings.rerank_min_top_k), F.col("upper")))
        & (F.col(rank) < F.col("upper"))
        & (F.col("gap") > settings.rerank_gap_abs)
    )
    best = F.max(F.when(eligible, F.struct("gap", (-F.col(rank)).alias("at")))).over(group)
    missing = F.max(F.col(score).isNull()).over(group)
    cut = F.when(F.col("missing"), F.col("upper")).otherwise(F.coalesce(-F.col("best.at"), F.col("upper")))
    return (
        seen.withColumn("best", best).withColumn("missing", missing)
        .where(F.col(rank) <= cut)
        .drop("upper", "gap", "best", "missing")
    )
