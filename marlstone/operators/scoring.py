"""Score a partition of chunks against a block of queries and keep what can still win.

Queries are a bounded block held by each task; chunks stay where they are scanned. A task
emits, per query, only rows that may belong to the best ``k`` of its batch, so the shuffle
that follows carries at most about ``k`` rows per query and batch, whatever the skew.
"""

from __future__ import annotations

import math
import os
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from marlstone.operators.ranking import best_score_order, top_k
from marlstone.session import BLOCK_ROWS, scratch_dir

DECIMALS = 6
# Rows this close to the k-th score are kept: rounding and summation order cannot lose one.
_MARGIN = 2 * 10.0**-DECIMALS


# A task scores at most this many (chunk, query) pairs at a time.
_CELLS = 4_000_000


def slices(batches: Iterable[pa.RecordBatch], queries: int) -> Iterator[pa.RecordBatch]:
    """Batches cut so that rows x queries stays within a task's working set."""
    rows = max(1, _CELLS // max(queries, 1))
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


class Keeper:
    """Selects the rows of each batch that may reach the best ``k`` of some query."""

    def __init__(self, query_ids: list, k: int, id_type: pa.DataType):
        self.query_ids = pa.array(query_ids, id_type)
        self.k = k
        self.floor = np.full(len(query_ids), -np.inf)

    def select(self, ids: pa.Array, scores: np.ndarray, hit: np.ndarray | None = None):
        """``scores`` is chunks x queries; ``hit`` masks pairs that are results at all."""
        usable = scores if hit is None else np.where(hit, scores, -np.inf)
        rows = usable.shape[0]
        if rows > self.k:
            kth = np.partition(usable, rows - self.k, axis=0)[rows - self.k]
            self.floor = np.maximum(self.floor, kth)
        keep = usable >= self.floor - _MARGIN
        keep &= usable > -np.inf
        row, query = np.nonzero(keep)
        return pa.RecordBatch.from_arrays(
            [
                self.query_ids.take(pa.array(query)),
                ids.take(pa.array(row)),
                pa.array(usable[row, query]),
            ],
            names=["query_id", "chunk_id", "score"],
        )


def allow_by_scope(chunks: DataFrame, scope: DataFrame) -> DataFrame:
    """Chunks of documents some query is limited to, with ``allowed``: those queries.

    ``scope`` is (query_id, doc_id). The join drops every other chunk before scoring.
    """
    per_doc = scope.groupBy("doc_id").agg(F.collect_set("query_id").alias("allowed"))
    return chunks.join(per_doc, "doc_id")


def allowed_mask(batch: pa.RecordBatch, query_ids: list) -> np.ndarray | None:
    """Chunks x queries mask of a batch scoped by :func:`allow_by_scope`, else None."""
    if "allowed" not in batch.schema.names:
        return None
    lists = batch.column("allowed")
    at = pc.index_in(lists.flatten(), value_set=pa.array(query_ids, lists.type.value_type))
    row = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy())
    known = pc.is_valid(at).to_numpy(zero_copy_only=False)
    mask = np.zeros((len(lists), len(query_ids)), dtype=bool)
    mask[row[known], at.filter(pa.array(known)).to_numpy()] = True
    return mask


def id_type(queries: DataFrame) -> pa.DataType:
    return to_arrow_type(queries.schema["query_id"].dataType)


def hits_schema(queries: DataFrame, chunks: DataFrame) -> T.StructType:
    return T.StructType(
        [
            T.StructField("query_id", queries.schema["query_id"].dataType),
            T.StructField("chunk_id", chunks.schema["chunk_id"].dataType),
            T.StructField("score", T.DoubleType()),
        ]
    )


def no_hits(queries: DataFrame, chunks: DataFrame) -> DataFrame:
    return queries.sparkSession.createDataFrame([], hits_schema(queries, chunks))


def best_hits(candidates: DataFrame, k: int) -> DataFrame:
    """(query_id, chunk_id, score, rank): rounded scores, equal ones ordered by chunk id."""
    rounded = candidates.withColumn("score", F.round("score", DECIMALS))
    return top_k(rounded, ["query_id"], best_score_order("score", "chunk_id"), k)


def per_query_block(
    queries: DataFrame, search: Callable[[DataFrame], DataFrame], block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Run ``search`` on blocks of queries that fit a task.

    One block covers the usual case. More queries take one pass over the chunks per block,
    each written to the shared folder, so neither driver nor task ever holds all queries.
    """
    count = queries.count()
    if count <= block_rows:
        return search(queries)
    spark = queries.sparkSession
    path = os.path.join(scratch_dir(spark), f"blocks-{uuid.uuid4().hex}")
    blocks = math.ceil(2 * count / block_rows)
    schema = None
    for block in range(blocks):
        part = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block)
        found = search(part)
        schema = found.schema
        found.write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


# Pairs of a chunk's token and a query that are held at a time.
_PAIRS = 1 << 20


class TokenWeights:
    """Query-side weights of one block: for each token the queries using it."""

    def __init__(self, rows: list, query_ids: list):
        position = {query: i for i, query in enumerate(query_ids)}
        ordered = sorted(rows, key=lambda r: r[1])
        tokens: list = []
        starts: list[int] = []
        for i, row in enumerate(ordered):
            if not tokens or tokens[-1] != row[1]:
                tokens.append(row[1])
                starts.append(i)
        self.tokens = pa.array(tokens)
        self.starts = np.array([*starts, len(ordered)], dtype=np.int64)
        self.query = np.array([position[r[0]] for r in ordered], dtype=np.int64)
        self.weight = np.array([r[2] for r in ordered], dtype=np.float64)
        self.queries = len(query_ids)

    def accumulate(self, rows: int, row: np.ndarray, token: np.ndarray, weight: np.ndarray):
        """Scores and hit mask (rows x queries) of entries (row, token position, weight)."""
        size = rows * self.queries
        scores, hit = np.zeros(size), np.zeros(size, bool)
        all_counts = self.starts[token + 1] - self.starts[token]
        # A token that all queries use has as many pairs as there are queries, so pairs are made in parts.
        part = np.cumsum(all_counts) // _PAIRS
        bounds = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(token)]
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            own, counts = token[a:b], all_counts[a:b]
            spread = np.repeat(np.arange(len(own)), counts)
            first = np.repeat(np.cumsum(counts) - counts, counts)
            at = self.starts[own][spread] + (np.arange(len(spread)) - first)
            cell = row[a:b][spread] * self.queries + self.query[at]
            np.add.at(scores, cell, weight[a:b][spread] * self.weight[at])
            hit[cell] = True
        return scores.reshape(rows, self.queries), hit.reshape(rows, self.queries)
