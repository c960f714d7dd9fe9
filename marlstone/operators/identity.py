"""Document identity: evidence, fallback, checked model answers, and re-keyed chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.config import IngestSettings
from marlstone.functions import ids
from marlstone.functions.text import (
    collapse_spaces,
    first_present,
    model_codes,
    normalize_name,
    present,
    strip,
    unique_strings,
)
from marlstone.operators.sections import PATH_JOIN

# Headings that never name a document.
BOILERPLATE = (
    "摘要", "引言", "引论", "目录", "abstract", "introduction", "contents", "preface", "前言",
)
OTHER_TYPE = "其他"
# Confidence by the source of the title.
CONFIDENCE = {"user_provided": 0.98, "first_heading": 0.82, "file_name": 0.55}
TITLE_CANDIDATES, ALIASES, EVIDENCE, SUMMARY_CHARS = 8, 12, 3, 400
# Labels of the profile and retrieval texts.
PROFILE_LABELS = ("文档名", "主要对象", "别名", "型号", "类型", "摘要")
RETRIEVAL_LABELS = ("文档", "章节路径", "父标题", "切片标题", "正文")
FORMULA_LABEL = "【公式检索信息】\n"
LIST_JOIN = "、"


def evidence(chunks: DataFrame, key: str = "doc_key", settings: IngestSettings = IngestSettings()) -> DataFrame:
    """(key, file_title, context, title_candidates, summary_source, contents): one row per document.

    Title candidates and context come from the first chunks only; ``contents`` is all
    chunk texts in order, for the content hash.
    """
    first = F.col("chunk_index") < max(settings.theme_name_chunk_k, 1)
    head = F.struct("chunk_index", "section_path", "section_title", "title", "content")
    grouped = chunks.groupBy(key).agg(
        F.min("file_title").alias("file_title"),
        F.array_sort(F.collect_list(F.when(first, head))).alias("heads"),
        F.array_sort(F.collect_list(F.struct("chunk_index", "content"))).alias("all"),
    )
    heads = F.transform(
        "heads",
        lambda h: F.struct(
            strip(F.coalesce(h["section_path"], F.lit(""))).alias("path"),
            strip(first_present(h["section_title"], h["title"])).alias("title"),
            strip(F.coalesce(h["content"], F.lit(""))).alias("content"),
        ),
    )
    limit = settings.theme_name_chunk_size
    start = F.struct(F.array().cast("array<string>").alias("parts"), F.lit(limit).alias("left"))
    context = F.aggregate(
        F.transform("heads", lambda h: h["content"]),
        start,
        lambda acc, text: F.when(
            (F.length(text) > 0) & (acc["left"] > 0),
            F.struct(
                F.array_append(acc["parts"], F.substring(text, F.lit(1), acc["left"])).alias("parts"),
                (acc["left"] - F.least(F.length(text), acc["left"])).alias("left"),
            ),
        ).otherwise(acc),
        lambda acc: F.array_join(acc["parts"], "\n\n"),
    )
    named = F.flatten(
        F.transform("heads", lambda h: F.array(strip(F.split(h["path"], PATH_JOIN)[0]), h["title"]))
    )
    candidates = F.filter(F.concat(F.array("file_title"), named), present)
    summary = F.array_join(F.transform(F.slice("heads", 1, 2), lambda h: collapse_spaces(h["content"])), " ")
    return grouped.withColumn("file_title", strip(F.col("file_title"))).withColumn("heads", heads).select(
        key,
        "file_title",
        context.alias("context"),
        unique_strings(candidates, TITLE_CANDIDATES).alias("title_candidates"),
        F.substring(summary, 1, SUMMARY_CHARS).alias("summary_source"),
        F.transform("all", lambda c: c["content"]).alias("contents"),
    )


def fallback_identity(
    documents: DataFrame, settings: IngestSettings = IngestSettings(), user_title: str | None = None
) -> DataFrame:
    """Identity from the user's title, else the first telling heading, else the file name.

    ``user_title`` names a column of ``documents`` (the output of :func:`evidence`).
    """
    cleaned = strip(F.regexp_replace("file_title", r"(?U)[_\s\x1c-\x1f]+", " "))
    given = strip(F.coalesce(F.col(user_title) if user_title else F.lit(None).cast("string"), F.lit("")))
    headings = F.filter(
        F.slice("title_candidates", 2, TITLE_CANDIDATES),
        lambda c: (normalize_name(c) != normalize_name(F.col("file_name")))
        & ~normalize_name(c).isin(*BOILERPLATE),
    )
    base = documents.withColumn("file_name", cleaned).withColumn("given", given)
    base = base.withColumn("heading", F.try_element_at(headings, F.lit(1)))
    source = (
        F.when(present(F.col("given")), "user_provided")
        .when(F.col("heading").isNotNull(), "first_heading")
        .otherwise("file_name")
    )
    title = (
        F.when(present(F.col("given")), F.col("given"))
        .when(F.col("heading").isNotNull(), F.col("heading"))
        .otherwise(F.col("file_name"))
    )
    named = base.withColumn("title_source", source).withColumn("canonical_title", title)
    named = named.withColumn("aliases", unique_strings(F.array("canonical_title", "file_name")))
    codes = unique_strings(F.flatten(F.transform("aliases", model_codes)))
    confidence = F.create_map(*[F.lit(x) for pair in CONFIDENCE.items() for x in pair])[F.col("title_source")]
    return (
        named.withColumn("model_codes", codes)
        .withColumn("primary_subject", F.col("canonical_title"))
        .withColumn("document_type", F.lit(OTHER_TYPE))
        .withColumn("summary", F.col("summary_source"))
        .withColumn("evidence", F.array("canonical_title"))
        .withColumn("title_confidence", confidence)
        .withColumn("requires_review", confidence < settings.document_title_review_threshold)
        .drop("file_name", "given", "heading", "summary_source")
    )


def accept_identity(
    documents: DataFrame, reply: str = "reply", settings: IngestSettings = IngestSettings()
) -> DataFrame:
    """Use a model's identity only where the text supports it; otherwise keep the fallback.

    ``reply`` is a struct column (canonical_title, primary_subject, aliases, evidence,
    document_type, summary, confidence) or null. The title and at least one evidence phrase
    must occur, normalized, in file title, candidates and context.
    """
    r = F.col(reply)
    corpus = normalize_name(F.concat_ws("\n", F.col("file_title"), F.array_join("title_candidates", "\n"), F.col("context")))
    df = documents.withColumn("corpus", corpus)
    occurs = lambda c: F.contains(F.col("corpus"), normalize_name(c))
    none = F.array().cast("array<string>")
    title = strip(F.coalesce(r["canonical_title"], F.lit("")))
    proof = F.filter(unique_strings(F.coalesce(r["evidence"], none), EVIDENCE), occurs)
    df = df.withColumn("m_title", title).withColumn("m_evidence", proof)
    accepted = r.isNotNull() & present(F.col("m_title")) & occurs(F.col("m_title")) & (F.size("m_evidence") > 0)
    subject = strip(F.coalesce(r["primary_subject"], F.lit("")))
    subject = F.when(present(subject) & occurs(subject), subject).otherwise(F.col("m_title"))
    aliases = F.filter(
        unique_strings(F.concat(F.array("m_title"), F.coalesce(r["aliases"], none), F.col("aliases")), ALIASES),
        lambda a: occurs(a) | F.array_contains("aliases", a),
    )
    df = df.withColumn("accepted", accepted).withColumn("m_subject", subject).withColumn("m_aliases", aliases)
    codes = unique_strings(
        F.concat(
            F.col("model_codes"),
            F.flatten(F.transform(F.concat(F.array("m_title", "m_subject"), F.col("m_aliases")), model_codes)),
        ),
        ALIASES,
    )
    confidence = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(r["confidence"].cast("double"), F.lit(0.0))))
    same = normalize_name(F.col("canonical_title")) == normalize_name(F.col("m_title"))
    chosen = {
        "canonical_title": F.col("m_title"),
        "primary_subject": F.col("m_subject"),
        "aliases": F.when(F.size("m_aliases") > 0, F.col("m_aliases")).otherwise(F.col("aliases")),
        "model_codes": codes,
        "document_type": F.substring(strip(first_present(r["document_type"], F.lit(OTHER_TYPE))), 1, 80),
        "summary": F.substring(collapse_spaces(first_present(r["summary"], F.col("summary"))), 1, SUMMARY_CHARS),
        "evidence": F.col("m_evidence"),
        "title_source": F.when(same, F.col("title_source")).otherwise("llm_with_evidence"),
        "title_confidence": confidence,
        "requires_review": confidence < settings.document_title_review_threshold,
    }
    picked = {name: F.when(F.col("accepted"), value).otherwise(F.col(name)) for name, value in chosen.items()}
    return df.withColumns(picked).drop("corpus", "accepted", "m_title", "m_subject", "m_aliases", "m_evidence", reply)


def profile_text(df_cols: dict[str, Column] | None = None) -> Column:
    """Labelled lines of a document profile; a line ending in its label is dropped."""
    c = df_cols or {n: F.col(n) for n in ("canonical_title", "primary_subject", "aliases", "model_codes", "document_type", "summary")}
    values = [
        c["canonical_title"], c["primary_subject"], F.array_join(c["aliases"], LIST_JOIN),
        F.array_join(c["model_codes"], LIST_JOIN), c["document_type"], c["summary"],
    ]
    lines = [F.concat(F.lit(f"{label}："), F.coalesce(v, F.lit(""))) for label, v in zip(PROFILE_LABELS, values)]
    return F.array_join(F.filter(F.array(*lines), lambda t: ~t.endswith("：")), "\n")


def retrieval_text(
    document: Column, section_path: Column, parent_title: Column, title: Column, content: Column, formulas: Column
) -> Column:
    """Labelled, space-collapsed fields of a chunk; the text all indexes share."""
    fields = (document, section_path, parent_title, title, content)
    clean = lambda c: collapse_spaces(F.coalesce(c, F.lit("")))
    parts = [
        F.when(present(clean(c)), F.concat(F.lit(f"{label}："), clean(c)))
        for label, c in zip(RETRIEVAL_LABELS, fields)
    ]
    parts.append(F.when(present(clean(formulas)), F.concat(F.lit(FORMULA_LABEL), clean(formulas))))
    return F.concat_ws("\n", *parts)


def with_document_ids(documents: DataFrame) -> DataFrame:
    """Add content hash, version, document and logical ids, and the building state.

    Uses ``contents``, ``canonical_title``, and ``source_hash`` / ``version_id`` /
    ``requested_logical_document_id`` where present.
    """
    have = set(documents.columns)
    given = lambda name: F.coalesce(F.col(name), F.lit("")) if name in have else F.lit("")
    df = documents.withColumn("content_hash", ids.content_hash(F.col("contents")))
    version = strip(given("version_id"))
    source = strip(given("source_hash"))
    df = df.withColumn("source_hash", source).withColumn(
        "version_id", F.when(present(version), version).otherwise(ids.version_id(source, F.col("content_hash")))
    )
    logical = ids.logical_id(F.col("canonical_title"), F.col("content_hash"), given("requested_logical_document_id"))
    return (
        df.withColumn("doc_id", ids.doc_id(F.col("version_id"), F.col("content_hash")))
        .withColumn("logical", logical)
        .select("*", "logical.logical_document_id", "logical.logical_id_source")
        .drop("logical", "contents", "requested_logical_document_id")
        .withColumn("version_status", F.lit("building"))
        .withColumn("is_active", F.lit(False))
        .withColumn("profile_text", profile_text())
    )


def apply_identity(chunks: DataFrame, documents: DataFrame, key: str = "doc_key") -> DataFrame:
    """Give every chunk its document's identity and re-key its sections by document id."""
    taken = documents.select(
        key, "doc_id", "canonical_title", "primary_subject", "document_type",
        F.col("summary").alias("document_summary"), "aliases", "model_codes", "source_hash",
        "version_id", "logical_document_id", "version_status", "is_active",
        first_present(F.col("primary_subject"), F.col("canonical_title")).alias("theme_name"),
    )
    joined = chunks.join(taken, key)
    titles = F.split(strip(F.col("section_path")), PATH_JOIN)
    parent = F.array_join(F.slice(titles, 1, F.greatest(F.size(titles) - 1, F.lit(0))), PATH_JOIN)
    has_path = present(strip(F.col("section_path")))
    rekeyed = joined.withColumn(
        "section_id",
        F.when(has_path, ids.section_id(F.col("doc_id"), strip(F.col("section_path")))).otherwise(F.col("section_id")),
    ).withColumn(
        "parent_section_id",
        F.when(~has_path, F.col("parent_section_id"))
        .when(present(parent), ids.section_id(F.col("doc_id"), parent))
        .otherwise(""),
    )
    return rekeyed.withColumn(
        "id", ids.chunk_id(F.col("version_id"), F.col("doc_id"), F.col("section_id"), F.col("chunk_index"), F.col("content"))
    ).withColumn(
        "retrieval_text",
        retrieval_text(
            first_present(F.col("canonical_title"), F.col("file_title")), F.col("section_path"), F.col("parent_title"),
            F.col("title"), F.col("content"), F.col("formula_search_text"),
        ),
    )
