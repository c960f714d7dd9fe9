"""Search limited to documents: hard with fallback, soft as a second list, or global."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.config import QuerySettings
from marlstone.functions.text import strip
from marlstone.operators.fusion import merge_lists
from marlstone.session import materialize

# A branch search: (queries, scope or None) -> (query_id, chunk_id, score, rank).
Search = Callable[[DataFrame, DataFrame | None], DataFrame]


def visible(chunks: DataFrame, active_only: bool = True) -> DataFrame:
    """Only chunks of active versions, when the filter is on."""
    return chunks.where(F.col("is_active")) if active_only else chunks


def clean_scope(scope: DataFrame) -> DataFrame:
    """(query_id, doc_id) with trimmed, non-empty document ids."""
    return scope.select("query_id", strip(F.col("doc_id")).alias("doc_id")).where(F.length("doc_id") > 0).distinct()


def search_hard(
    queries: DataFrame, hard: DataFrame, search: Search, locked: Column | None = None
) -> DataFrame:
    """Scoped hits; a query without any falls back to all documents unless it is locked.

    ``locked`` is an expression over ``queries``. Adds ``route_fallback``.
    """
    hard = clean_scope(hard)
    locked = F.lit(False) if locked is None else locked
    scoped_queries = queries.join(hard.select("query_id").distinct(), "query_id", "left_semi")
    scoped = materialize(search(scoped_queries, hard), "scoped")
    answered = scoped.select("query_id").distinct()
    empty = scoped_queries.where(~locked).join(answered, "query_id", "left_anti")
    fallback = search(empty, None)
    return scoped.withColumn("route_fallback", F.lit(False)).unionByName(
        fallback.withColumn("route_fallback", F.lit(True))
    )


def search_soft(
    queries: DataFrame, soft: DataFrame, search: Search, limit: int, settings: QuerySettings = QuerySettings()
) -> DataFrame:
    """Global hits fused with hits inside the preferred documents at a lower weight."""
    soft = clean_scope(soft)
    preferring = queries.join(soft.select("query_id").distinct(), "query_id", "left_semi")
    lists = [("global", 0, 1.0, search(queries, None)), ("soft_route", 1, settings.soft_route_weight, search(preferring, soft))]
    hits = None
    for name, order, weight, found in lists:
        part = found.select(
            "query_id", "chunk_id", "rank", F.lit(name).alias("list_name"),
            F.lit(order).alias("list_order"), F.lit(weight).alias("weight"),
        )
        hits = part if hits is None else hits.unionByName(part)
    return merge_lists(hits, limit)


def search_scoped(
    queries: DataFrame,
    scope: DataFrame,
    search: Search,
    limit: int,
    settings: QuerySettings = QuerySettings(),
) -> DataFrame:
    """Route each query by its scope rows (query_id, doc_id, mode 'hard' or 'soft').

    ``queries`` carries ``locked`` and, in grouped searches, ``grouped``. Hard wins over soft;
    queries without rows are global. Only a grouped search in a locked scope may come back empty:
    any other question without hits in its scope is searched everywhere.
    """
    hard = scope.where(F.col("mode") == "hard")
    soft = scope.where(F.col("mode") == "soft").join(hard.select("query_id"), "query_id", "left_anti")
    grouped = F.coalesce(F.col("grouped"), F.lit(False)) if "grouped" in queries.columns else F.lit(False)
    hard_hits = search_hard(queries, hard, search, grouped & F.coalesce(F.col("locked"), F.lit(False)))
    others = queries.join(hard.select("query_id"), "query_id", "left_anti")
    other_hits = search_soft(others, soft, search, limit, settings)
    return hard_hits.select("query_id", "chunk_id", "rank", "route_fallback").unionByName(
        other_hits.select("query_id", "chunk_id", "rank").withColumn("route_fallback", F.lit(False))
    )
