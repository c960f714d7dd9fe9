"""Exactly-once import claims over a stream of uploads and results.

Claims and results are append-only logs with one folder per micro-batch each and their own
numbers. A batch reads the latest record of only the hashes it sees, and overwrites its own
folder when repeated. Within an attempt a result comes after the claim; a later attempt comes
after both, so the order of records needs no clock.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from marlstone.config import IngestSettings
from marlstone.operators import versions

_LOGS = ("claims", "results")

CLAIM = T.StructType(
    [
        T.StructField("source_hash", T.StringType()),
        T.StructField("task_id", T.StringType()),
        T.StructField("file_name", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("lease_until", T.TimestampType()),
        T.StructField("attempt", T.IntegerType()),
        T.StructField("requested_logical_document_id", T.StringType()),
        T.StructField("version_id", T.StringType()),
        T.StructField("error", T.StringType()),
        T.StructField("doc_id", T.StringType()),
        T.StructField("content_hash", T.StringType()),
    ]
)


def claim_log(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """All results and claims (``step`` 1 and 0), optionally only claims of batches before a number."""
    logged = T.StructType([*CLAIM.fields, T.StructField("batch", T.IntegerType())])
    log = spark.createDataFrame([], T.StructType([*logged.fields, T.StructField("step", T.IntegerType())]))
    for step, name in enumerate(_LOGS):
        if _exists(spark, f"{path}/{name}"):
            rows = spark.read.schema(logged).parquet(f"{path}/{name}")
            rows = rows.where(F.col("batch") < before) if before is not None and step == 0 else rows
            log = log.unionByName(rows.withColumn("step", F.lit(step)))
    return log


def latest_claims(log: DataFrame) -> DataFrame:
    newest = F.max_by(F.struct(*CLAIM.names[1:]), F.struct("attempt", "step", "batch"))
    return log.groupBy("source_hash").agg(newest.alias("c")).select("source_hash", "c.*")


def _append(rows: DataFrame, path: str, log: str, batch: int) -> None:
    columns = [(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in CLAIM.fields]
    rows.select(*columns).write.mode("overwrite").parquet(f"{path}/{log}/batch={batch}")


def claim_batch(
    uploads: DataFrame, path: str, batch: int, now: Column, settings: IngestSettings = IngestSettings()
) -> DataFrame:
    """Claim one batch of uploads, log the records it won, and return all with ``acquired``."""
    spark = uploads.sparkSession
    seen = uploads.select("source_hash").distinct()
    known = latest_claims(claim_log(spark, path, batch).join(seen, "source_hash", "left_semi"))
    claimed = versions.claim(known.drop("doc_id", "content_hash"), uploads, now, settings)
    _append(claimed.where("acquired"), path, "claims", batch)
    won = spark.read.schema(CLAIM).parquet(f"{path}/claims/batch={batch}").withColumn("acquired", F.lit(True))
    held = known.join(won.select("source_hash"), "source_hash", "left_anti").withColumn("acquired", F.lit(False))
    return won.unionByName(held)


def finish_batch(results: DataFrame, path: str, batch: int) -> None:
    """Log the outcome of imports; a result whose claim is gone fails the batch."""
    spark = results.sparkSession
    mine = latest_claims(claim_log(spark, path, batch).join(results.select("source_hash"), "source_hash", "left_semi"))
    finished = versions.require_no_lost_claims(versions.finish(mine, results))
    _append(finished, path, "results", batch)


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def claim_stream(
    uploads: DataFrame,
    path: str,
    checkpoint: str,
    on_claimed: Callable[[DataFrame, int], None] | None = None,
    settings: IngestSettings = IngestSettings(),
) -> StreamingQuery:
    """Claim a stream of uploads (source_hash, task_id, file_name, uploaded_at).

    ``on_claimed`` receives each batch's claims, for example to import the acquired ones.
    """

    def run(batch: DataFrame, number: int) -> None:
        claimed = claim_batch(batch, path, number, F.current_timestamp(), settings)
        if on_claimed is not None:
            on_claimed(claimed, number)

    return uploads.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
