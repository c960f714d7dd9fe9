"""Dense plus sparse search with weighted, normalized scores, and multi-query branches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.config import QuerySettings
from marlstone.operators.dense import dense_top_k
from marlstone.operators.fusion import merge_lists
from marlstone.operators.lexical import sparse_top_k
from marlstone.operators.postings import Postings
from marlstone.operators.scoring import DECIMALS


def weighted_hybrid(
    dense_hits: DataFrame, sparse_hits: DataFrame, k: int, settings: QuerySettings = QuerySettings()
) -> DataFrame:
    """Weighted sum of normalized scores over the union of two rankings.

    Cosine maps to (1 + s) / 2 and inner product to 1/2 + atan(s) / pi, our choice of
    normalization; a chunk missing from one ranking gets nothing from it.
    """
    dense = dense_hits.select(
        "query_id", "chunk_id", (settings.hybrid_dense_weight * (1 + F.col("score")) / 2).alias("part")
    )
    sparse = sparse_hits.select(
        "query_id", "chunk_id",
        (settings.hybrid_sparse_weight * (0.5 + F.atan("score") / F.pi())).alias("part"),
    )
    summed = dense.unionByName(sparse).groupBy("query_id", "chunk_id").agg(
        F.round(F.sum("part"), DECIMALS).alias("score")
    )
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("chunk_id").asc())
    return summed.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hybrid_top_k(
    vectors: DataFrame,
    query_vectors: DataFrame,
    k: int = 12,
    scope: DataFrame | None = None,
    settings: QuerySettings = QuerySettings(),
    sparse: Postings | DataFrame | None = None,
) -> DataFrame:
    """Hybrid search over vectors(chunk_id, dense, sparse) for query_vectors(query_id, ...).

    ``sparse`` is a stored index of the sparse vectors (:func:`vector_index`), if there is one.
    """
    return weighted_hybrid(
        dense_top_k(vectors, query_vectors, k, scope),
        sparse_top_k(vectors if sparse is None else sparse, query_vectors, k, scope),
        k,
        settings,
    )


def merge_query_variants(hits: DataFrame, limit: int, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Fuse the rankings of several search texts of one question.

    ``hits`` holds (*by, variant, chunk_id, rank); variant n becomes list ``query_n``. With
    more than one variant each keeps at least one entry of its own.
    """
    lists = hits.withColumns(
        {
            "list_name": F.concat(F.lit("query_"), F.col("variant").cast("string")),
            "list_order": F.col("variant"),
            "weight": F.lit(1.0),
        }
    )
    return merge_lists(lists, limit, by=by, min_per_list=1)
