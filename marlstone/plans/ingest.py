"""Ingest: Markdown documents to a versioned, searchable corpus.

Stages write tables keyed by document or chunk; a repeated run skips what is there.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.config import IngestSettings
from marlstone.models import Embedder, Generator, HashedEmbedder, generate
from marlstone.operators import formulas, identity, vectors, versions
from marlstone.operators.chunks import chunk_documents
from marlstone.operators.lexical import keyword_index, term_index
from marlstone.operators.postings import Postings
from marlstone.operators.registry import profile_vectors
from marlstone.plans.steps import StepLog
from marlstone.session import materialize
from marlstone.sources.stores import KeyedTable, registry_rows

IDENTITY_REPLY = (
    "canonical_title string, primary_subject string, aliases array<string>, evidence array<string>, "
    "document_type string, summary string, confidence double"
)


@dataclass(frozen=True)
class Models:
    """Model factories; None leaves out the optional step."""

    embedder: Callable[[], Embedder] = HashedEmbedder
    identity: Callable[[], Generator] | None = None
    formula: Callable[[], Generator] | None = None
    dim: int = 64


@dataclass
class Corpus:
    """The stored tables of one corpus."""

    spark: SparkSession
    path: str
    chunks: KeyedTable = field(init=False)
    vectors: KeyedTable = field(init=False)
    terms: KeyedTable = field(init=False)
    registry: KeyedTable = field(init=False)
    profiles: KeyedTable = field(init=False)
    publishes: KeyedTable = field(init=False)
    _indexes: dict = field(init=False, default_factory=dict)

    def __post_init__(self):
        keys = {
            "chunks": "id", "vectors": "id", "terms": "chunk_id", "registry": "doc_id", "profiles": "doc_id", "publishes": "publish_id",
        }
        for name, key in keys.items():
            setattr(self, name, KeyedTable(self.spark, f"{self.path}/{name}", key, replaces=name in ("registry", "profiles")))

    def active_chunks(self) -> DataFrame:
        """Chunks of active versions."""
        return versions.visible_chunks(self.chunks.read(), self.publishes.read())

    def active_terms(self) -> DataFrame:
        """Term index of active chunks, for repeated keyword searches."""
        return self.terms.read().join(self.active_chunks().select(F.col("id").alias("chunk_id")), "chunk_id", "left_semi")

    def keyword_postings(self) -> Postings | DataFrame:
        """Stored index of active chunks for keyword searches, built again after something was published."""
        state = self.publishes.read().count()
        if state not in self._indexes:
            self._indexes = {state: keyword_index(materialize(self.active_terms(), "terms"))}
        return self._indexes[state]

    def active_vectors(self) -> DataFrame:
        """(chunk_id, doc_id, dense, sparse) of active chunks."""
        keys = self.active_chunks().select("id", "doc_id")
        return self.vectors.read().join(keys, "id").withColumnRenamed("id", "chunk_id")

    def active_registry(self) -> DataFrame:
        rows = versions.version_states(self.publishes.read(), self.registry.read())
        return rows.where("is_active")

    def active_profiles(self) -> DataFrame:
        """(doc_id, dense, sparse) of the profiles of active documents."""
        return self.profiles.read().join(self.active_registry().select("doc_id"), "doc_id", "left_semi")


def build_chunks(
    documents: DataFrame, models: Models = Models(), settings: IngestSettings = IngestSettings()
) -> tuple[DataFrame, DataFrame]:
    """(chunks, document profiles) of documents (doc_key, file_title, content[, source_hash])."""
    pieces = materialize(chunk_documents(documents, "doc_key", settings), "pieces")
    if models.formula is not None:
        described = formulas.describe(formulas.work_list(pieces, "doc_key", settings), models.formula, settings)
        pieces = formulas.apply_descriptions(pieces, materialize(described, "described"), ["doc_key", "chunk_index"])
    profiles = identity.fallback_identity(identity.evidence(pieces, "doc_key", settings), settings)
    if models.identity is not None:
        prompt = F.to_json(F.struct("file_title", "title_candidates", "context"))
        replied = generate(profiles.withColumn("prompt", prompt), "prompt", "reply", models.identity).drop("prompt")
        parsed = replied.withColumn("reply", F.from_json(formulas.json_object(F.col("reply")), IDENTITY_REPLY))
        profiles = identity.accept_identity(parsed, "reply", settings)
    extra = [c for c in ("source_hash", "requested_logical_document_id") if c in documents.columns]
    if extra:
        profiles = profiles.join(documents.select("doc_key", *extra), "doc_key")
    known = materialize(identity.with_document_ids(profiles), "profiles")
    return identity.apply_identity(pieces, known), known


def ingest(
    documents: DataFrame,
    corpus: Corpus,
    models: Models = Models(),
    settings: IngestSettings = IngestSettings(),
    published_at: str | None = None,
    log: StepLog | None = None,
) -> DataFrame:
    """Build, store and publish documents; returns their profiles.

    Chunks, vectors and terms are keyed by content, so ingesting the same bytes again adds
    nothing. The publish entry comes last: until then readers see the earlier versions.
    """
    log = log or StepLog("ingest")
    with log.step("chunks"):
        chunks, profiles = build_chunks(documents, models, settings)
        chunks = vectors.require_rows(materialize(chunks, "chunks"))
    with log.step("vectors"):
        earlier = corpus.vectors.read() if corpus.vectors.exists() else None
        fresh = materialize(vectors.embed_missing(chunks, earlier, "id", models.embedder, settings), "vectors")
        if not fresh.isEmpty():
            checked = vectors.valid_rows(fresh.join(chunks.select("id", "content"), "id"), models.dim)
            corpus.vectors.add(checked.drop("content"))
    with log.step("store"):
        texts = chunks.select(F.col("id").alias("chunk_id"), "doc_id", F.col("retrieval_text").alias("content"))
        corpus.terms.add(term_index(texts))
        corpus.chunks.add(chunks)
        known = profiles.drop("context", "title_candidates", "evidence").dropDuplicates(["doc_id"])
        corpus.registry.write(registry_rows(known))
        corpus.profiles.write(profile_vectors(known, models.embedder))
    with log.step("publish"):
        moment = F.lit(published_at).cast("timestamp") if published_at else F.current_timestamp()
        newest = F.max_by(F.struct("version_id", "doc_id", "source_hash", "content_hash"), "doc_key")
        entries = profiles.groupBy("logical_document_id").agg(newest.alias("v")).select(
            "logical_document_id", "v.*", moment.alias("published_at")
        )
        keyed = entries.withColumn("publish_id", F.concat_ws("@", "logical_document_id", "version_id", "published_at"))
        corpus.publishes.add(materialize(keyed, "publishes"))
    return profiles
