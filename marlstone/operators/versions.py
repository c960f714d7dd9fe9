"""Idempotent imports, document versions and migration checks as table operations.

State lives in append-only logs; current state is the latest entry per key. A publish is
one log entry, so readers see the old or the new version and never both or neither.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.config import IngestSettings
from marlstone.errors import ClaimLostError
from marlstone.functions import ids
from marlstone.functions.text import strip

# Import and version states.
PROCESSING, COMPLETED, FAILED = "processing", "completed", "failed"
BUILDING, READY, RETIRED = "building", "ready", "retired"
ERROR_CHARS = 2000
VERSION_FIELDS = ("logical_document_id", "logical_id_source", "version_id", "version_status", "is_active")


def first_claims(uploads: DataFrame, order: str = "uploaded_at") -> DataFrame:
    """(source_hash, task_id, version_id, uploads): the earliest upload owns its content.

    Aggregated before the shuffle, so a heavily repeated file costs one row per partition.
    """
    return uploads.groupBy("source_hash").agg(
        F.min_by("task_id", F.struct(order, "task_id")).alias("task_id"), F.count(F.lit(1)).alias("uploads")
    ).withColumn("version_id", ids.version_id(F.col("source_hash")))


def claimable(status: Column, lease_until: Column, now: Column) -> Column:
    """Failed imports, and processing ones whose lease has run out."""
    return (status == FAILED) | ((status == PROCESSING) & (lease_until <= now))


def claim(registry: DataFrame, uploads: DataFrame, now: Column, settings: IngestSettings = IngestSettings()) -> DataFrame:
    """Registry rows of the uploaded hashes after claiming, with ``acquired``.

    ``uploads`` has (source_hash, task_id, file_name, uploaded_at[, logical_document_id]);
    one upload per hash may win. A new hash starts at attempt 1, a claimable one is taken
    over with one attempt more, any other keeps its record.
    """
    offered = uploads if "logical_document_id" in uploads.columns else uploads.withColumn("logical_document_id", F.lit(""))
    wanted = offered.groupBy("source_hash").agg(
        F.min(F.struct("uploaded_at", "task_id", "file_name", "logical_document_id")).alias("u")
    )
    lease = now + F.make_interval(secs=F.lit(float(max(60, settings.import_claim_lease_seconds))))
    joined = wanted.join(registry, "source_hash", "left")
    fresh = F.col("status").isNull()
    taken = ~fresh & claimable(F.col("status"), F.col("lease_until"), now)
    won = fresh | taken
    asked = F.nullif(F.col("u.logical_document_id"), F.lit(""))
    return joined.select(
        "source_hash",
        F.when(won, F.col("u.task_id")).otherwise(F.col("task_id")).alias("task_id"),
        F.when(won, F.col("u.file_name")).otherwise(F.col("file_name")).alias("file_name"),
        F.when(won, F.lit(PROCESSING)).otherwise(F.col("status")).alias("status"),
        F.when(won, lease).otherwise(F.col("lease_until")).alias("lease_until"),
        F.when(fresh, F.lit(1)).when(taken, F.col("attempt") + 1).otherwise(F.col("attempt")).alias("attempt"),
        F.when(won, F.coalesce(asked, F.col("requested_logical_document_id"), F.lit(""))).otherwise(
            F.col("requested_logical_document_id")
        ).alias("requested_logical_document_id"),
        F.coalesce("version_id", ids.version_id(F.col("source_hash"))).alias("version_id"),
        F.when(won, F.lit("")).otherwise(F.col("error")).alias("error"),
        won.alias("acquired"),
    )


def finish(registry: DataFrame, results: DataFrame) -> DataFrame:
    """Registry after results (source_hash, task_id, ok, error, doc_id, content_hash).

    Only the task holding a processing claim may change it. Success clears lease and error,
    failure keeps a cut error text. ``lost`` marks results whose claim was gone.
    """
    r = results.select("source_hash", *[F.col(c).alias(f"r_{c}") for c in ("task_id", "ok", "error", "doc_id", "content_hash")])
    joined = registry.join(r, "source_hash", "left")
    reported = F.col("r_task_id").isNotNull()
    holds = reported & (F.col("r_task_id") == F.col("task_id")) & (F.col("status") == PROCESSING)
    ok = holds & F.col("r_ok")
    bad = holds & ~F.col("r_ok")
    text = lambda n: F.col(n) if n in registry.columns else F.lit(None).cast("string")
    return joined.select(
        "source_hash", "task_id", "file_name",
        F.when(ok, COMPLETED).when(bad, FAILED).otherwise(F.col("status")).alias("status"),
        F.when(holds, F.lit(None)).otherwise(F.col("lease_until")).alias("lease_until"),
        "attempt", "requested_logical_document_id", "version_id",
        F.when(ok, F.lit("")).when(bad, F.substring(F.coalesce("r_error", F.lit("")), 1, ERROR_CHARS)).otherwise(F.col("error")).alias("error"),
        F.when(ok, F.col("r_doc_id")).otherwise(text("doc_id")).alias("doc_id"),
        F.when(ok, F.col("r_content_hash")).otherwise(text("content_hash")).alias("content_hash"),
        (reported & ~holds & F.col("r_ok")).alias("lost"),
    )


def require_no_lost_claims(registry: DataFrame) -> DataFrame:
    """Fail when a finished import no longer held its claim."""
    lost = registry.where("lost").select("source_hash").head()
    if lost is not None:
        raise ClaimLostError(f"import of {lost.source_hash} lost its claim", "finish")
    return registry.drop("lost")


def retryable(registry: DataFrame, task_ids: DataFrame, now: Column) -> DataFrame:
    """(task_id, outcome): reclaimed, missing, or the state that forbids a retry."""
    joined = task_ids.join(registry.select("task_id", "status", "lease_until"), "task_id", "left")
    outcome = (
        F.when(F.col("status").isNull(), "missing")
        .when(claimable(F.col("status"), F.col("lease_until"), now), "reclaimed")
        .otherwise(F.concat(F.lit("refused:"), F.col("status")))
    )
    return joined.select("task_id", outcome.alias("outcome"))


def reclaim(registry: DataFrame, task_ids: DataFrame, now: Column, settings: IngestSettings = IngestSettings()) -> DataFrame:
    """Registry rows of the tasks to retry, with ``outcome`` of :func:`retryable`.

    A reclaimed task keeps its record with one attempt more, a new lease and no error; others keep
    theirs as it is. Tasks without a record give no row.
    """
    lease = now + F.make_interval(secs=F.lit(float(max(60, settings.import_claim_lease_seconds))))
    known = registry.join(retryable(registry, task_ids.select("task_id").distinct(), now), "task_id")
    again = F.col("outcome") == "reclaimed"
    changed = {"status": F.lit(PROCESSING), "lease_until": lease, "error": F.lit(""), "attempt": F.col("attempt") + 1}
    return known.withColumns({c: F.when(again, v).otherwise(F.col(c)) for c, v in changed.items()})



def active_versions(publishes: DataFrame) -> DataFrame:
    """The version each logical document points to: its last publish wins."""
    last = F.max_by(F.struct("version_id", "doc_id", "source_hash", "published_at"), F.struct("published_at", "version_id"))
    return publishes.groupBy("logical_document_id").agg(last.alias("v")).select("logical_document_id", "v.*")


def active_by_source(publishes: DataFrame, hashes: DataFrame) -> DataFrame:
    """Active versions whose stored bytes are among ``hashes`` (source_hash)."""
    return active_versions(publishes).join(hashes, "source_hash", "left_semi")


def version_states(publishes: DataFrame, documents: DataFrame) -> DataFrame:
    """Documents with version_status and is_active: ready when pointed to, retired when
    published before, building otherwise."""
    current = active_versions(publishes).select("logical_document_id", F.col("version_id").alias("active_version_id"))
    ever = publishes.select("logical_document_id", "version_id").distinct().withColumn("published", F.lit(True))
    base = documents.drop("version_status", "is_active")
    joined = base.join(ever, ["logical_document_id", "version_id"], "left").join(current, "logical_document_id", "left")
    active = F.coalesce(F.col("version_id") == F.col("active_version_id"), F.lit(False))
    status = F.when(active, READY).when(F.col("published"), RETIRED).otherwise(BUILDING)
    return joined.withColumn("version_status", status).withColumn("is_active", active).drop("published", "active_version_id")


def visible_chunks(chunks: DataFrame, publishes: DataFrame) -> DataFrame:
    """Chunks of active versions."""
    keys = active_versions(publishes).select("logical_document_id", "version_id")
    return chunks.join(keys, ["logical_document_id", "version_id"], "left_semi")


def drop_inactive(chunks: DataFrame, versions: DataFrame) -> DataFrame:
    """Chunks without the inactive rows of the given versions (version_id)."""
    doomed = versions.select("version_id", F.lit(False).alias("is_active")).distinct()
    return chunks.join(doomed, ["version_id", "is_active"], "left_anti")


def upsert(current: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Incoming rows replace current ones with the same key."""
    return current.join(incoming.select(key), key, "left_anti").unionByName(incoming, allowMissingColumns=True)


def partial_update(current: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Overwrite only the columns ``changes`` carries, for its keys."""
    fields = [c for c in changes.columns if c != key]
    renamed = changes.select(key, *[F.col(c).alias(f"_{c}") for c in fields], F.lit(True).alias("_hit"))
    joined = current.join(renamed, key, "left")
    return joined.select(
        *[F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in current.columns]
    )


def chunk_keys(values: Column) -> Column:
    """Distinct integer keys of an array of strings; anything else is ignored."""
    numbers = F.transform(values, lambda v: F.when(~F.lower(v).isin("true", "false"), v.try_cast("long")))
    return F.array_distinct(F.filter(numbers, lambda n: n.isNotNull()))


def duplicate_groups(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """(logical_document_id, doc_id, chunks, chunk_signature) where one logical id has several documents.

    The signature is a digest of the document's (title, content) pairs in any order, summed up where
    the chunks are.
    """
    pair = (F.coalesce("title", F.lit("")), F.coalesce("content", F.lit("")))
    signed = chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"), ids.multiset_digest(*pair).alias("chunk_signature"))
    several = documents.groupBy("logical_document_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return documents.join(several, "logical_document_id", "left_semi").select("logical_document_id", "doc_id").join(signed, "doc_id", "left").withColumn(
        "chunks", F.coalesce("chunks", F.lit(0))
    )


def orphans(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Distinct document ids used by chunks but not registered."""
    return chunks.select("doc_id").distinct().join(documents.select("doc_id"), "doc_id", "left_anti")


def migration_plan(documents: DataFrame, selections: DataFrame) -> DataFrame:
    """Version fields for legacy documents (doc_id, canonical_title, source_hash, content_hash, version_id).

    ``selections`` is (logical_document_id, doc_id): the active record where several
    documents share a title. ``problem`` names what must be settled first.
    """
    logical = ids.logical_id(F.col("canonical_title"), F.col("content_hash"))
    blank = lambda n: F.nullif(strip(F.coalesce(F.col(n), F.lit(""))), F.lit(""))
    seed = F.coalesce(blank("source_hash"), blank("content_hash"), F.col("doc_id"))
    rows = documents.withColumn("l", logical).select(
        "doc_id", "l.logical_document_id", "l.logical_id_source",
        F.coalesce(blank("version_id"), F.concat(F.lit("ver_"), F.substring(seed, 1, 24))).alias("version_id"),
    )
    sizes = rows.groupBy("logical_document_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("ids"), F.min("doc_id").alias("only"))
    picked = selections.select("logical_document_id", F.col("doc_id").alias("picked"))
    known = rows.select("logical_document_id", F.col("doc_id").alias("picked"), F.lit(True).alias("valid")).distinct()
    joined = rows.join(sizes, "logical_document_id").join(picked, "logical_document_id", "left").join(
        known, ["logical_document_id", "picked"], "left"
    )
    chosen = F.coalesce("picked", F.when(F.col("n") == 1, F.col("only")))
    problem = (
        F.when(F.col("doc_id").isNull() | (F.col("n") > F.col("ids")), "missing or repeated document id")
        .when(F.col("picked").isNotNull() & F.col("valid").isNull(), "selected record is of another document")
        .when(chosen.isNull(), "several documents share a title")
    )
    active = F.coalesce(F.col("doc_id") == chosen, F.lit(False))
    return joined.select(
        "doc_id", "logical_document_id", "logical_id_source", "version_id", active.alias("is_active"),
        F.when(active, READY).otherwise(RETIRED).alias("version_status"), problem.alias("problem"),
    )


def migrate_chunks(chunks: DataFrame, plan: DataFrame) -> DataFrame:
    """Chunks with their document's version fields; a chunk without a document fails the job."""
    fields = [f for f in VERSION_FIELDS if f != "logical_id_source"]
    base = chunks.drop(*fields)
    joined = base.join(plan.select("doc_id", *fields), "doc_id", "left")
    checked = F.when(
        F.col("version_id").isNull(), F.raise_error(F.concat(F.lit("chunk of unregistered document "), F.coalesce("doc_id", F.lit("?"))))
    ).otherwise(F.col("version_id"))
    return joined.withColumn("version_id", checked)


def changed_rows(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(key, difference): rows added, removed or changed outside the version fields."""
    fields = [c for c in before.columns if c != key and c not in VERSION_FIELDS]
    digest = lambda: ids.sha256_hex(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}))
    b = before.select(key, digest().alias("b"))
    a = after.select(key, digest().alias("a"))
    difference = F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "removed").when(F.col("a") != F.col("b"), "changed")
    return b.join(a, key, "full").withColumn("difference", difference).where(F.col("difference").isNotNull()).select(key, "difference")


def collection_counts(rows: DataFrame) -> DataFrame:
    """(total, active, inactive)."""
    return rows.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("is_active")).alias("active"),
        F.count_if(~F.coalesce("is_active", F.lit(False))).alias("inactive"),
    )


def pending(inputs: DataFrame, finished: DataFrame | None, key: str) -> DataFrame:
    """Rows a stage still has to do: those whose key its output table does not hold."""
    return inputs if finished is None else inputs.join(finished.select(key), key, "left_anti")
