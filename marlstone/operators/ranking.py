"""Ranking primitives shared by every retrieval branch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(
    df: DataFrame, by: Sequence[str], order: Sequence[Column], out: str = "rank"
) -> DataFrame:
    """1-based position inside each group under a total order."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def top_k(
    df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, out: str = "rank"
) -> DataFrame:
    """First ``k`` rows per group.

    The row-number filter lets Spark cut every partition to ``k`` rows per group before the
    shuffle, so a hot group costs at most ``k`` rows per input partition.
    """
    return ranked(df, by, order, out).where(F.col(out) <= k)


def best_score_order(score: str, *ties: str) -> list[Column]:
    return [F.col(score).desc(), *[F.col(t).asc() for t in ties]]
