"""Registered queries of the training-data operators and their SQL twins."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import alignment, brown, filter_audit, mixing, ngram_join, nn_descent, pii, quality, sentencepieces, sketches, subspace_dedup, token_counts, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_shared_prefix_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = public_tokenizers.path("piece_bpe_32k.model")
    # A hash of the text goes along with the ids, not the text itself.
    docs = _table(spark, sf_dir, "documents").withColumn("given", F.sha2(F.coalesce("text", F.lit("")), 256))
    coded = sentencepieces.encode(docs, vocabulary, ["doc_id", "given"])
    back = sentencepieces.decode(coded, vocabulary, ["doc_id", "given", "ids"])
    same = F.sha2("decoded", 256) == F.col("given")
    return back.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", same.alias("round_trip"))


def op2_kneser_ney_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = _table(spark, sf_dir, "labels").filter("quality = 1")
    return quality.classify(_table(spark, sf_dir, "documents"), trusted).drop("text_hash")


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_documents(_table(spark, sf_dir, "documents"), ngram_join.Likeness(shingle=3, part=90)).drop("text_hash")


def op4_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nn_descent.nearest(_table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, 20)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return token_counts.over_limit(counts, 4096)


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).drop("source", "key")


def op7_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown.score_documents(_table(spark, sf_dir, "documents"))


def op8_threshold_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketches.edit_likeness(_table(spark, sf_dir, "documents"))


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_personal_data(_table(spark, sf_dir, "documents")))


def op10_subword_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    labels = _table(spark, sf_dir, "labels").filter(toxicity.fold() != 0)
    model = toxicity.train(docs, labels.select("doc_id", F.col("toxic").alias("label")))
    scored = toxicity.score(docs, model)
    return scored.select(
        "doc_id", (toxicity.fold() == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted")
    )


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_subspace_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subspace_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op13_end_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return alignment.align_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {
    "op1_shared_prefix_viterbi": op1_shared_prefix_viterbi,
    "op2_kneser_ney_quality": op2_kneser_ney_quality, "op3_ngram_join": op3_ngram_join, "op4_nn_descent": op4_nn_descent,
    "op5_token_counts": op5_token_counts, "op6_source_mix": op6_source_mix, "op7_brown_lm": op7_brown_lm, "op8_threshold_sketch": op8_threshold_sketch,
    "op9_personal_data": op9_personal_data, "op10_subword_toxicity": op10_subword_toxicity,
    "op11_filter_audit": op11_filter_audit, "op12_subspace_dedup": op12_subspace_dedup, "op13_end_alignment": op13_end_alignment,
}
ORACLES = {"op3_ngram_join": ngram_join.SQL, "op6_source_mix": mixing.SQL, "op11_filter_audit": filter_audit.SQL, "op12_subspace_dedup": subspace_dedup.SQL}
