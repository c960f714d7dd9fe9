"""Registry search: which documents a mention may stand for, by stored profile vectors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.config import QuerySettings
from marlstone.functions.text import model_codes, normalize_name
from marlstone.models import Embedder, HashedEmbedder, embed
from marlstone.operators.hybrid import hybrid_top_k
from marlstone.operators.identity import profile_text
from marlstone.operators.postings import Postings
from marlstone.session import materialize


def profile_vectors(registry: DataFrame, embedder: Callable[[], Embedder] = HashedEmbedder) -> DataFrame:
    """(doc_id, dense, sparse) of the documents' profile texts."""
    texts = registry.select("doc_id", profile_text().alias("profile"))
    return embed(texts, "profile", ["doc_id"], embedder)


def search_registry(
    mentioned: DataFrame,
    vectors: DataFrame,
    embedder: Callable[[], Embedder] = HashedEmbedder,
    settings: QuerySettings = QuerySettings(),
    sparse: Postings | DataFrame | None = None,
) -> DataFrame:
    """(query_id, mention, doc_id, pos, route_score): the best documents for each mention.

    ``mentioned`` is (query_id, mention, place); ``vectors`` (doc_id, dense, sparse) of the documents to
    choose from, active ones usually. Each distinct mention is embedded and searched once, however
    many questions hold it. ``pos`` puts a question's mentions in turn, best documents first.
    """
    texts = mentioned.select("mention").distinct().select(F.col("mention").alias("query_id"), F.col("mention").alias("text"))
    asked = materialize(embed(texts, "text", ["query_id"], embedder), "mentions")
    limit = settings.document_route_limit
    found = hybrid_top_k(vectors.withColumnRenamed("doc_id", "chunk_id"), asked, limit, settings=settings, sparse=sparse)
    found = found.select(F.col("query_id").alias("mention"), F.col("chunk_id").alias("doc_id"), "rank", F.col("score").alias("route_score"))
    return mentioned.join(found, "mention").select(
        "query_id", "mention", "doc_id", (F.col("place") * limit + F.col("rank")).alias("pos"), "route_score"
    )


def mention_candidates(mentioned: DataFrame, registry: DataFrame, found: DataFrame) -> DataFrame:
    """(query_id, mention) with the registry fields of every document that may be meant.

    Besides what the search found these are documents with the mention's name and documents that hold
    all of its model codes, which a search among very many documents need not rank high.
    """
    keyed = mentioned.select("query_id", "mention", normalize_name(F.col("mention")).alias("key"), model_codes(F.col("mention")).alias("codes"))
    names = registry.select("doc_id", F.explode(F.concat(F.array("canonical_title"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("name"))
    named = keyed.join(names.select("doc_id", normalize_name(F.col("name")).alias("key")), "key").select("query_id", "mention", "doc_id")
    # One code of each mention finds the documents; the others are checked on them.
    by_code = registry.select("doc_id", "model_codes", F.explode("model_codes").alias("code"))
    coded = keyed.where(F.size("codes") > 0).withColumn("code", F.element_at("codes", 1)).join(by_code, "code")
    coded = coded.where(F.size(F.array_except("codes", "model_codes")) == 0).select("query_id", "mention", "doc_id")
    pairs = found.select("query_id", "mention", "doc_id").unionByName(named).unionByName(coded).distinct()
    return pairs.join(registry.select("doc_id", "canonical_title", "aliases", "model_codes"), "doc_id")

