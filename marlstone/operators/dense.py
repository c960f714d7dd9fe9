"""Exact nearest neighbours by cosine over whole vector tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from marlstone.errors import QueryError
from marlstone.operators.scoring import (
    Keeper,
    allow_by_scope,
    allowed_mask,
    best_hits,
    hits_schema,
    id_type,
    no_hits,
    per_query_block,
    slices,
)


def dense_top_k(
    vectors: DataFrame, query_vectors: DataFrame, k: int = 12, scope: DataFrame | None = None
) -> DataFrame:
    """Best ``k`` chunks per query: vectors(chunk_id, dense), query_vectors(query_id, dense).

    One matrix product per Arrow batch; a zero vector has cosine zero.
    """
    scoped = vectors if scope is None else allow_by_scope(vectors, scope)
    source = scoped.select(*[c for c in ("chunk_id", "dense", "allowed") if c in scoped.columns])

    def search(block: DataFrame) -> DataFrame:
        rows = block.select("query_id", "dense").collect()
        if not rows:
            return no_hits(block, source)
        ids, kind = [r.query_id for r in rows], id_type(block)
        matrix = _unit(np.array([r.dense for r in rows], dtype=np.float64))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            keeper = Keeper(ids, k, kind)
            for batch in slices(batches, len(ids)):
                scores = _unit(_matrix(batch.column("dense"), matrix.shape[1])) @ matrix.T
                yield keeper.select(batch.column("chunk_id"), scores, allowed_mask(batch, ids))

        return source.mapInArrow(run, hits_schema(block, source))

    return best_hits(per_query_block(query_vectors, search), k)


def _matrix(lists: pa.ListArray, dim: int) -> np.ndarray:
    lengths = pc.fill_null(pc.list_value_length(lists), -1).to_numpy()
    if len(lengths) and not (lengths == dim).all():
        raise QueryError(f"every vector must have {dim} values", "dense_top_k")
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _unit(matrix: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)
