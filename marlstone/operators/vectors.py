"""Chunk vectors: what to embed, resumed embedding, and row validation before a write."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.config import IngestSettings
from marlstone.errors import RowValidationError
from marlstone.functions.text import first_present, strip
from marlstone.models import Embedder, HashedEmbedder, embed


def embed_missing(
    chunks: DataFrame,
    done: DataFrame | None,
    key: str = "id",
    factory: Callable[[], Embedder] = HashedEmbedder,
    settings: IngestSettings = IngestSettings(),
) -> DataFrame:
    """(key, dense, sparse) for chunks not yet embedded; finished rows cost no model call.

    ``done`` holds earlier vectors; rows whose vectors are incomplete are embedded again.
    """
    if done is not None:
        complete = done.where((F.size("dense") > 0) & (F.cardinality("sparse") > 0))
        chunks = chunks.join(complete.select(key), key, "left_anti")
    text = first_present(F.col("retrieval_text"), F.col("content"))
    return embed(chunks.select(key, text.alias("text")), "text", [key], factory, settings.embedding_batch_size)


def valid_rows(rows: DataFrame, dim: int) -> DataFrame:
    """Skip rows without content or vectors; a malformed vector fails the job.

    Rows: (content, dense, sparse, ...). A wrong dimension, a non-finite value, a negative
    token id or a non-finite weight is an error, not a skip.
    """
    usable = rows.where(
        (F.length(strip(F.coalesce("content", F.lit("")))) > 0)
        & (F.coalesce(F.size("dense"), F.lit(0)) > 0)
        & (F.coalesce(F.cardinality("sparse"), F.lit(0)) > 0)
    )
    wild = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    problem = (
        F.when(
            F.size("dense") != dim,
            F.concat(F.lit(f"dense vector must have {dim} values, got "), F.size("dense").cast("string")),
        )
        .when(F.exists("dense", wild), "dense vector holds a value that is not finite")
        .when(F.exists(F.map_keys("sparse"), lambda t: t < 0), "sparse vector holds a negative token id")
        .when(F.exists(F.map_values("sparse"), wild), "sparse vector holds a weight that is not finite")
    )
    return usable.where(F.when(problem.isNotNull(), F.raise_error(problem).cast("boolean")).otherwise(True))


def require_rows(rows: DataFrame, step: str = "write") -> DataFrame:
    if rows.isEmpty():
        raise RowValidationError("no valid rows are left to write", step)
    return rows
