"""Task progress from an event stream: running and finished steps, durations, fraction done.

Events are (task_id, step, action, seq, seconds): action 'running' or 'done', ``seq`` their
order. The same aggregation serves batch tables and Structured Streaming; per-step state is
two values, combined before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

# Steps of an import by kind of file, upload included.
STEPS = {"word": 10, "pdf": 9, "markdown": 8}
ALMOST_DONE = 95.0


def step_states(events: DataFrame) -> DataFrame:
    """(task_id, step, running, first_done, started, seconds): one row per step of a task.

    A step is running when its latest event says so; it is done from its first 'done' on.
    """
    done = F.col("action") == "done"
    return events.groupBy("task_id", "step").agg(
        (F.max_by("action", "seq") == "running").alias("running"),
        F.min(F.when(done, F.col("seq"))).alias("first_done"),
        F.max(F.when(~done, F.col("seq"))).alias("started"),
        F.round(F.max_by(F.when(done, F.col("seconds")), F.when(done, F.col("seq"))), 2).alias("seconds"),
    )


def task_progress(states: DataFrame) -> DataFrame:
    """(task_id, running_list, done_list, total_seconds): steps in order of start and finish."""
    names = lambda order, keep: F.transform(
        F.array_sort(F.collect_list(F.when(keep, F.struct(F.col(order).alias("o"), "step")))), lambda s: s["step"]
    )
    return states.groupBy("task_id").agg(
        names("started", F.col("running")).alias("running_list"),
        names("first_done", F.col("first_done").isNotNull()).alias("done_list"),
        F.round(F.sum("seconds"), 2).alias("total_seconds"),
    )


def progress_percent(done: Column, running: Column, steps: Column, status: Column) -> Column:
    """Finished steps plus half a step while any runs; below 100 until completed."""
    raw = (done + F.when(running > 0, 0.5).otherwise(0.0)) / steps * 100
    return F.when(status == "completed", 100.0).otherwise(F.when(raw >= 100, ALMOST_DONE).otherwise(raw))


def total_steps(file_name: Column) -> Column:
    name = F.lower(file_name)
    return (
        F.when(name.rlike(r"\.docx?\z"), STEPS["word"]).when(name.endswith(".pdf"), STEPS["pdf"]).otherwise(STEPS["markdown"])
    )


def stream_step_states(events: DataFrame, sink: str, checkpoint: str) -> StreamingQuery:
    """Aggregate a streaming ``events``; each batch writes the step states it changed.

    A batch owns one numbered folder, so a repeated batch overwrites itself.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return (
        step_states(events)
        .writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def current_states(spark: SparkSession, sink: str) -> DataFrame:
    """Latest written state of every step."""
    written = spark.read.parquet(sink)
    fields = [c for c in written.columns if c not in ("task_id", "step", "batch")]
    return written.groupBy("task_id", "step").agg(F.max_by(F.struct(*fields), "batch").alias("s")).select(
        "task_id", "step", "s.*"
    )


def event_frame(event: Column, data: Column) -> Column:
    """Wire text of one server-sent event; ``data`` is a JSON string."""
    return F.concat(F.lit("event: "), event, F.lit("\ndata: "), data, F.lit("\n\n"))


def deliver(events: DataFrame) -> DataFrame:
    """(task_id, frames): undelivered events of each task in order.

    ``events`` is (task_id, seq, event, data) of one micro-batch.
    """
    framed = F.struct("seq", event_frame(F.col("event"), F.col("data")).alias("frame"))
    return events.groupBy("task_id").agg(
        F.transform(F.array_sort(F.collect_list(framed)), lambda f: f["frame"]).alias("frames")
    )
