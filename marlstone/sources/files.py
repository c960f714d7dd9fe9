"""Files in: uploads with their hash and kind, Markdown documents, and query images."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions.ids import source_hash

# Accepted file kinds, image signatures, and the size limit of an image.
KINDS = {"md": "markdown", "pdf": "pdf", "doc": "word", "docx": "word"}
IMAGE_SIGNATURES = {
    "image/jpeg": "FFD8FF",
    "image/png": "89504E470D0A1A0A",
    "image/gif": "47494638",
    "image/bmp": "424D",
}
MAX_IMAGE_BYTES = 10 * 1024 * 1024
PAYLOAD = "source_path string, source_hash string, file_name string, file_title string, content string, error string"


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]+)\z", 1)


def file_kind(name: Column) -> Column:
    """markdown, pdf or word by suffix; null for anything else."""
    suffix = F.lower(F.regexp_extract(name, r"\.([^.]+)\z", 1))
    return F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])[suffix]


def file_title(name: Column) -> Column:
    return F.regexp_replace(name, r"(?<=.)\.[^.]*\z", "")


def read_uploads(spark: SparkSession, path: str) -> DataFrame:
    """(source_path, content, source_hash, file_name, file_title, kind) of stored files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = base_name(F.url_decode(F.regexp_replace(F.col("path"), r"\+", "%2B")))
    return files.select(
        F.col("path").alias("source_path"), "content", source_hash(F.col("content")).alias("source_hash"), name.alias("file_name")
    ).withColumn("file_title", file_title(F.col("file_name"))).withColumn("kind", file_kind(F.col("file_name")))


def rejected(uploads: DataFrame) -> DataFrame:
    """Uploads that cannot be imported, with the reason."""
    reason = (
        F.when((F.col("file_name") == "") | F.col("file_name").isin(".", ".."), "invalid file name")
        .when(F.col("kind").isNull(), "unsupported file type")
    )
    return uploads.withColumn("reason", reason).where(F.col("reason").isNotNull()).select("source_path", "file_name", "reason")


def markdown_documents(uploads: DataFrame) -> DataFrame:
    """(doc_key, file_title, content, source_hash): UTF-8 Markdown, keyed by its hash.

    Files with equal bytes are one document.
    """
    ready = uploads.where(F.col("kind") == "markdown").groupBy("source_hash").agg(
        F.min_by(F.struct("file_title", "content"), "source_path").alias("f")
    )
    return ready.select(
        F.col("source_hash").alias("doc_key"), F.col("f.file_title").alias("file_title"),
        F.decode("f.content", "UTF-8").alias("content"), "source_hash",
    )


def convert(uploads: DataFrame, converter: Callable[[str, bytes], str]) -> DataFrame:
    """Run a document converter (name, bytes) -> Markdown on files that are not Markdown.

    A failing file gets its error and no content; other files are unaffected.
    """
    others = uploads.where(F.col("kind").isNotNull() & (F.col("kind") != "markdown")).select(
        "source_path", "source_hash", "file_name", "file_title", "content"
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, errors = [], []
            for name, content in zip(batch["file_name"], batch["content"]):
                try:
                    text = converter(name, bytes(content))
                    texts.append(text or None)
                    errors.append(None if text else "converter returned nothing")
                except Exception as error:
                    texts.append(None)
                    errors.append(str(error))
            yield batch.drop(columns="content").assign(content=texts, error=errors)

    return others.mapInPandas(run, PAYLOAD)


def image_type(content: Column) -> Column:
    """MIME type by file signature; null when it is none of the accepted image formats."""
    head = F.hex(F.substring(content, 1, 12))
    kind = F.when(head.startswith("52494646") & head.endswith("57454250"), "image/webp")
    for mime, signature in IMAGE_SIGNATURES.items():
        kind = kind.when(head.startswith(signature), mime)
    return kind


def image_problem(content: Column, max_bytes: int = MAX_IMAGE_BYTES) -> Column:
    """Why a query image is refused, or null."""
    size = F.coalesce(F.octet_length(content), F.lit(0))
    return (
        F.when(size == 0, "image is empty")
        .when(size > max_bytes, f"image is larger than {max_bytes // (1024 * 1024)} MB")
        .when(image_type(content).isNull(), "not a supported image")
    )


def object_key(version_id: Column, folder: str, file_name: Column) -> Column:
    """Where an original or image of a version is stored."""
    return F.concat(F.lit("document_versions/"), version_id, F.lit(f"/{folder}/"), file_name)
