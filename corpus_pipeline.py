"""From raw documents to token ids: five stages, each a table of its own."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.llm import mixing, ngram_join, pii, quality, sentencepieces
from marlstone.session import materialize, ship_package, tune

# The last stage's rows have no SQL twin; tests hold each stage against plain Python.
ORACLE_SQL = None


def _ready(spark: SparkSession) -> None:
    tune(spark)
    ship_package(spark)


def _rows_of(docs: DataFrame, wanted: DataFrame, kind: str) -> DataFrame:
    """Rows of ``docs`` that are (left_semi) or aren't (left_anti) among the ids and text hashes."""
    wanted = wanted.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"))
    return docs.join(wanted, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__hash")), kind)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity under a model of trusted text is within their language's limit.

    Trusted are the documents labelled as good. A row is known by id and text, so nulls and
    repeated rows are judged like any other.
    """
    _ready(spark)
    trusted = spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality = 1")
    judged = quality.classify(docs, trusted)
    return _rows_of(docs, judged.filter(~F.col("keep")), "left_anti")


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8): the smallest id.

    Rows without words are groups of their own. Of rows alike in id and text one stays. Rows with a
    null id stay only if their group has no id at all.
    """
    _ready(spark)
    groups = ngram_join.join_documents(docs, ngram_join.Likeness(shingle=5, part=80))
    kept = _rows_of(docs, groups.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))), "left_semi")
    same = Window.partitionBy("doc_id", F.xxhash64("text")).orderBy(F.lit(0))
    return kept.withColumn("__place", F.row_number().over(same)).filter("__place = 1").select(*docs.columns)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; ``n_chars`` follows, if there is one."""
    _ready(spark)
    clean = pii.redact(docs)
    if "n_chars" in docs.columns:
        length = F.length("text").cast(docs.schema["n_chars"].dataType)
        clean = clean.withColumn("n_chars", F.coalesce(length, F.col("n_chars")))
    return clean.select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents as often as their source's target takes them, the last one of a source cut."""
    _ready(spark)
    mixed = mixing.mixed_texts(docs)
    if "n_chars" in docs.columns:
        mixed = mixed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return mixed.select(*docs.columns)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mix: ``doc_id, lang, source, ids, n_tokens``."""
    _ready(spark)
    coded = sentencepieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"), ["doc_id", "lang", "source"])
    return coded.withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("quality classifier", keep_good),
    ("n-gram Jaccard join", keep_one_of_each_group),
    ("PII", redact_personal_data),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding and decoding", encode_pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-").lower())
    return docs
