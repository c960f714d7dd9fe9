"""Tables out and in: keyed rows, registry rows, reports and debug copies."""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.config import IngestSettings
from marlstone.errors import IngestError
from marlstone.session import materialize

# Registry fields routing needs.
REGISTRY_FIELDS = (
    "doc_id", "canonical_title", "primary_subject", "aliases_json", "model_codes_json", "document_type", "summary",
    "title_confidence", "requires_review", "logical_document_id", "version_id", "version_status",
)


class KeyedTable:
    """Plain Parquet that only grows, with unique keys for its readers.

    ``add`` appends rows whose key is new and reads only the key column of what is there. ``write``
    appends rows that take the place of earlier ones with their key, in tables that are opened with
    ``replaces``: their readers get the newest row of each key. Nothing is rewritten, so writers at the
    same time lose nothing of each other's.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, replaces: bool = False):
        self.spark, self.path, self.key, self.replaces = spark, path, key, replaces

    def exists(self) -> bool:
        """True after the first write has been committed."""
        target = self.spark._jvm.org.apache.hadoop.fs.Path(os.path.join(self.path, "_SUCCESS"))
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(target)

    def read(self) -> DataFrame:
        rows = self.spark.read.option("mergeSchema", "true").parquet(self.path)
        if not self.replaces:
            return rows
        newest = F.struct(F.col("written.at"), F.col("written.entry"))
        columns = [c for c in rows.columns if c != "written"]
        return rows.groupBy(self.key).agg(F.max_by(F.struct(*columns), newest).alias("row")).select("row.*")

    def _once(self, rows: DataFrame) -> DataFrame:
        """The rows, evaluated once; repeated keys are an error."""
        kept = materialize(rows, "rows")
        counted = kept.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(self.key).alias("keys")).head()
        if counted.n != counted.keys:
            raise IngestError(f"{counted.n - counted.keys} rows repeat a {self.key}", "write")
        return kept

    def add(self, rows: DataFrame) -> None:
        """Append rows whose key is new; for rows that their key fully determines."""
        fresh = self._once(rows)
        if self.exists():
            fresh = fresh.join(self.read().select(self.key), self.key, "left_anti")
        self._append(fresh)

    def _append(self, rows: DataFrame) -> None:
        if self.replaces:
            rows = rows.withColumn("written", F.struct(F.current_timestamp().alias("at"), F.lit(uuid.uuid4().hex).alias("entry")))
        rows.write.mode("append").parquet(self.path)

    def write(self, rows: DataFrame) -> int:
        """Insert or replace rows by key; returns how many were given."""
        if not self.replaces:
            raise IngestError(f"rows of {self.path} are never replaced", "write")
        kept = self._once(rows)
        self._append(kept)
        return kept.count()


def registry_rows(documents: DataFrame) -> DataFrame:
    """Registry records: list fields as JSON text, as the stored schema has them."""
    return documents.withColumn("aliases_json", F.to_json("aliases")).withColumn("model_codes_json", F.to_json("model_codes")).drop(
        "aliases", "model_codes"
    )


def registry_scan(registry: DataFrame, active_only: bool = True) -> DataFrame:
    """Routing fields of registered documents, one row per document id."""
    rows = registry.where("is_active") if active_only else registry
    return rows.select(*[c for c in REGISTRY_FIELDS if c in rows.columns]).dropDuplicates(["doc_id"])


def debug_copy(df: DataFrame, path: str, settings: IngestSettings = IngestSettings()) -> None:
    """Keep a JSON copy of a stage's rows when debugging is on."""
    if settings.debug_artifacts:
        df.write.mode("overwrite").json(path)


def write_report(summary: DataFrame, path: str, formats: tuple[str, ...] = ("json", "csv", "markdown")) -> None:
    """Write a small report table as JSON, CSV and a Markdown table."""
    if "json" in formats:
        summary.coalesce(1).write.mode("overwrite").json(os.path.join(path, "json"))
    if "csv" in formats:
        flat = [F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in summary.dtypes]
        summary.select(*flat).coalesce(1).write.mode("overwrite").option("header", True).csv(os.path.join(path, "csv"))
    if "markdown" in formats:
        cells = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in summary.columns]), F.lit(" |"))
        head = ["| " + " | ".join(summary.columns) + " |", "|" + " --- |" * len(summary.columns)]
        lines = summary.sparkSession.createDataFrame([(i, t) for i, t in enumerate(head)], "n int, value string")
        body = summary.select(F.lit(2).alias("n"), cells.alias("value"))
        lines.unionByName(body).coalesce(1).sortWithinPartitions("n", "value").select("value").write.mode("overwrite").text(
            os.path.join(path, "markdown")
        )


def same_configuration(earlier: str, now: dict) -> bool:
    """A resumed evaluation must use the configuration it started with."""
    return json.loads(earlier) == json.loads(json.dumps(now, sort_keys=True))
