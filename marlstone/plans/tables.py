"""The given tables as this engine's records (see FIXTURES.md for the mapping)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.session import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_stored: dict[tuple, object] = {}


def stored[T](spark: SparkSession, sf_dir: str, name: str, kind: str, build: Callable[[], T]) -> T:
    """What ``build`` has written from a table, once for each application and state of the table.

    Indexes and vectors serve every later search. A table whose files have changed is built anew.
    """
    context = spark.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
    files = place.getFileSystem(context._jsc.hadoopConfiguration())
    state = (files.getContentSummary(place).getLength(), files.getFileStatus(place).getModificationTime())
    key = (context.applicationId, f"{sf_dir}/{name}", kind, *state)
    if key not in _stored:
        _stored[key] = build()
    return _stored[key]


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents as chunks; their source is the document they belong to."""
    docs = spread(table(spark, sf_dir, "documents"), "doc_id")
    return docs.select(
        F.col("doc_id").alias("chunk_id"), F.col("source").alias("doc_id"), F.col("text").alias("content"), "lang"
    )


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages as questions."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as Markdown: short lines become headings, shorter ones higher.

    Up to 20 characters is level 1, up to 40 level 2, up to 60 level 3.
    """
    docs = spread(table(spark, sf_dir, "documents"), "doc_id")
    text = F.col("text")
    for hashes, low, high in (("###", 41, 60), ("##", 21, 40), ("#", 1, 20)):
        text = F.regexp_replace(text, rf"(?m)^([^\n#][^\n]{{{low - 1},{high - 1}}})$", f"{hashes} $1")
    return docs.select(
        F.col("doc_id").alias("doc_key"), F.concat_ws("-", "source", "lang").alias("file_title"), text.alias("content")
    )


def page_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web pages as Markdown: headings and paragraphs become lines, other markup goes."""
    pages = spread(table(spark, sf_dir, "pages"), "page_id")
    text = F.regexp_replace("html", r"(?s)<(script|style|head)[^>]*>.*?</(script|style|head)>", "")
    for level in range(1, 7):
        text = F.regexp_replace(text, rf"<h{level}[^>]*>", "\n" + "#" * level + " ")
    text = F.regexp_replace(text, r"<(p|li|div|br|/h[1-6])[^>]*>", "\n")
    text = F.regexp_replace(text, r"<[^>]*>", "")
    return pages.select(F.col("page_id").alias("doc_key"), F.col("url").alias("file_title"), text.alias("content"))


def scope_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, doc_id): each question prefers the source of the same number, if any."""
    return questions(spark, sf_dir).select("query_id", F.concat(F.lit("src"), F.col("query_id")).alias("doc_id"))
