"""Registered queries of import claims and event delivery, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.operators import versions
from marlstone.plans.tables import table
from marlstone.streaming import leases
from marlstone.streaming.claims import CLAIM
from marlstone.streaming.progress import event_frame


def _now() -> Column:
    return F.lit("2024-06-01 00:00:00").cast("timestamp")


def _uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as the upload of its bytes, in the order of ids."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("source_hash"))
    task = F.concat(F.lit("task_"), F.format_string("%012d", "doc_id"))
    return docs.select(
        "source_hash", task.alias("task_id"), F.concat("doc_id", F.lit(".md")).alias("file_name"), F.timestamp_seconds("doc_id").alias("uploaded_at"), "doc_id"
    )


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as finished imports; those of bad quality failed."""
    done = _uploads(spark, sf_dir).join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    ok = F.col("quality") == 1
    return done.select(
        "source_hash", "task_id", ok.alias("ok"), F.when(~ok, F.concat(F.lit("quality "), "quality")).alias("error"),
        F.concat(F.lit("doc_"), "doc_id").alias("doc_id"), F.col("source_hash").alias("content_hash"),
    )


def _claimed(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = spark.createDataFrame([], CLAIM).drop("doc_id", "content_hash")
    return versions.claim(none, _uploads(spark, sf_dir).drop("doc_id"), _now()).drop("acquired")


def claim_finish(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every claim with each result reported for its bytes; only its own task's counts."""
    ended = versions.finish(_claimed(spark, sf_dir), _results(spark, sf_dir))
    return ended.select("source_hash", "task_id", "status", F.col("lease_until").isNotNull().alias("leased"), "attempt", "error", "doc_id", "lost")


def claim_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents' imports retried after the first leases have ended."""
    claimed, results = _claimed(spark, sf_dir), _results(spark, sf_dir)
    own = results.join(claimed.select("source_hash", "task_id"), ["source_hash", "task_id"], "left_semi")
    later = _now() + F.make_interval(days=F.lit(30))
    again = versions.reclaim(versions.finish(claimed, own).drop("lost"), _uploads(spark, sf_dir), later)
    return again.select("source_hash", "task_id", "outcome", "status", "attempt", "error")


def delivery_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of each user's events in turn; those behind an event that never came (errors) are held back."""
    numbered = table(spark, sf_dir, "events").withColumn("seq", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    came = numbered.where("event_type <> 'error'")
    frame = event_frame(F.col("event_type"), F.col("props"))
    return came.select("event_id", "user_id", "seq", frame.alias("frame"), (~leases.deliverable(["user_id"], F.col("seq"))).alias("held"))


QUERIES = {"claim_finish": claim_finish, "claim_retry": claim_retry, "delivery_order": delivery_order}

_CLAIMS = """
up as (select doc_id, sha256(text) h, 'task_' || lpad(doc_id::varchar, 12, '0') task from documents),
held as (select h, min(task) task from up group by h),
res as (select h, task, quality = 1 ok, quality, 'doc_' || doc_id doc_id from up join labels using (doc_id)),
done as (select held.h, held.task, coalesce(res.task = held.task, false) mine, res.task is not null told, ok, quality, doc_id from held left join res using (h))"""

ORACLES = {
    "claim_finish": f"""with {_CLAIMS}
select h source_hash, task task_id, case when mine and ok then 'completed' when mine then 'failed' else 'processing' end status, not mine leased, 1 attempt,
  case when mine and not ok then 'quality ' || quality else '' end error, case when mine and ok then doc_id end doc_id, told and not mine and ok lost from done""",
    "claim_retry": f"""with {_CLAIMS},
last as (select held.h, held.task, ok, quality from held left join res on res.h = held.h and res.task = held.task)
select h source_hash, task task_id, case when ok then 'refused:completed' else 'reclaimed' end outcome, case when ok then 'completed' else 'processing' end status,
  case when ok then 1 else 2 end attempt, '' error from last""",
    "delivery_order": """
with n as (select *, row_number() over (partition by user_id order by ts, event_id) seq from events),
came as (select *, row_number() over (partition by user_id order by seq) place from n where event_type <> 'error')
select event_id, user_id, seq::int seq, 'event: ' || event_type || chr(10) || 'data: ' || props || chr(10) || chr(10) frame, place <> seq held from came""",
}
