"""Arbitration between a well-fused loser and the weakest selected evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.config import QuerySettings
from marlstone.operators.formulas import json_object

DECISIONS = T.StructType(
    [
        T.StructField(
            "decisions",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("pair_id", T.StringType()),
                        T.StructField("winner", T.StringType()),
                        T.StructField("confidence", T.StringType()),
                        T.StructField("reason", T.StringType()),
                    ]
                )
            ),
        )
    ]
)


def _rank(name: str) -> Column:
    return F.when(F.col(name) > 0, F.col(name)).otherwise(F.lit(10**9))


def conflict_pairs(selected: DataFrame, ranked: DataFrame, settings: QuerySettings = QuerySettings()) -> DataFrame:
    """(query_id, pair_id, candidate_*, victim_*): best losers against weakest winners.

    ``selected`` is (query_id, place, chunk_id, rerank_score, coverage_protected,
    conflict_judge_promoted); ``ranked`` is (query_id, chunk_id, rrf_rank, model_rank).
    Protected or promoted evidence is never a victim.
    """
    cutoff = selected.groupBy("query_id").agg(F.count(F.lit(1)).alias("cutoff"))
    losers = ranked.join(selected.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti").join(cutoff, "query_id")
    losers = losers.where((_rank("rrf_rank") <= settings.conflict_judge_rrf_rank_limit) & (_rank("model_rank") > F.col("cutoff")))
    loser_order = Window.partitionBy("query_id").orderBy(_rank("rrf_rank"), _rank("model_rank"))
    losers = losers.select(
        "query_id", F.col("chunk_id").alias("candidate_chunk_id"), F.col("rrf_rank").alias("candidate_rrf_rank"),
        F.col("model_rank").alias("candidate_model_rank"), F.row_number().over(loser_order).alias("pair_no"),
    )
    held = F.coalesce("coverage_protected", F.lit(False)) | F.coalesce("conflict_judge_promoted", F.lit(False))
    victim_order = Window.partitionBy("query_id").orderBy(F.col("rerank_score").asc_nulls_first(), "place")
    victims = selected.where(~held).select(
        "query_id", F.col("chunk_id").alias("victim_chunk_id"), F.col("place").alias("victim_place"),
        F.row_number().over(victim_order).alias("pair_no"),
    )
    allowed = settings.conflict_judge_max_pairs if settings.conflict_judge_enabled else 0
    return losers.where(F.col("pair_no") <= allowed).join(victims, ["query_id", "pair_no"]).withColumn(
        "pair_id", F.concat(F.lit("pair_"), F.col("pair_no").cast("string"))
    )


def parse_decisions(replies: DataFrame, reply: str = "reply") -> DataFrame:
    """(query_id, pair_id, winner, confidence, reason) from replies holding a decisions list."""
    parsed = replies.select("query_id", F.from_json(json_object(F.col(reply)), DECISIONS).alias("p"))
    rows = parsed.select("query_id", F.posexplode("p.decisions").alias("n", "d")).where(F.col("d.pair_id").isNotNull())
    last = rows.groupBy("query_id", F.col("d.pair_id").alias("pair_id")).agg(F.max_by("d", "n").alias("d"))
    return last.select("query_id", "pair_id", "d.winner", "d.confidence", "d.reason")


def decide(pairs: DataFrame, decisions: DataFrame, settings: QuerySettings = QuerySettings()) -> DataFrame:
    """Pairs with winner, confidence and promotion; a missing decision is invalid.

    Only a candidate (winner A) with enough confidence is promoted.
    """
    joined = pairs.join(decisions, ["query_id", "pair_id"], "left")
    confidence = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.col("confidence").try_cast("double"), F.lit(0.0))))
    winner = F.upper(F.coalesce("winner", F.lit("")))
    return (
        joined.withColumn("confidence", F.when(F.isnan(confidence), 0.0).otherwise(confidence))
        .withColumn("promoted", (winner == "A") & (F.col("confidence") >= settings.conflict_judge_min_confidence))
        .withColumn("winner", F.when(winner == "", "INVALID").otherwise(winner))
        .withColumn("reason", F.substring(F.coalesce("reason", F.lit("")), 1, 120))
    )


def promote(selected: DataFrame, ranked: DataFrame, decided: DataFrame) -> DataFrame:
    """Selected evidence with promoted candidates in their victims' places."""
    won = decided.where("promoted").select(
        "query_id", "candidate_chunk_id", "victim_chunk_id", F.col("victim_place").alias("place"), "confidence"
    )
    kept = selected.join(
        won.select("query_id", F.col("victim_chunk_id").alias("chunk_id")), ["query_id", "chunk_id"], "left_anti"
    )
    risen = ranked.join(
        won.withColumnRenamed("candidate_chunk_id", "chunk_id"), ["query_id", "chunk_id"]
    ).withColumn("conflict_judge_promoted", F.lit(True)).withColumnsRenamed(
        {"victim_chunk_id": "conflict_judge_replaced_chunk_id", "confidence": "conflict_judge_confidence"}
    )
    return kept.unionByName(risen, allowMissingColumns=True)


def sync_pool(selected: DataFrame, pool: DataFrame) -> DataFrame:
    """Evidence pool with the selection first and the rest of the pool after it."""
    rest = pool.join(selected.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
    both = selected.select("query_id", "chunk_id", F.lit(0).alias("side"), F.col("place").alias("at")).unionByName(
        rest.select("query_id", "chunk_id", F.lit(1).alias("side"), F.col("pos").alias("at"))
    )
    pos = F.row_number().over(Window.partitionBy("query_id").orderBy("side", "at"))
    return both.select("query_id", "chunk_id", pos.alias("pos"))
