"""Question understanding without a model: type, mentions, document route, complexity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.config import QuerySettings
from marlstone.functions.text import model_codes, normalize_name, strip, unique_strings
from marlstone.operators.ranking import top_k
from marlstone.session import materialize

# Quoted titles and words that announce a document.
QUOTED_TITLE = r"《([^》]{2,100})》"
DOCUMENT_CUE = r"《[^》]+》|(?:论文|文档|报告|手册|说明书|文章|资料|标准|指南)"
# Wording of questions that need several steps, in order of precedence.
COMPLEXITY = (
    (
        "multi_hop",
        r"为什么.*(?:如何|怎么|影响|导致)|原因.*(?:结果|结论|影响|机制)|关系是什么|如何证明|结合.*说明|依据.*判断",
    ),
    (
        "comparison",
        r"区别|差异|异同|对比|比较|相比|优缺点|相同点|不同点|各有什么特点|各自有什么特点|各有何特点",
    ),
    (
        "multi_fact",
        r"分别|各自|各有|各是|同时|以及|并且|并说明|并给出|"
        r"(?:原理|特点|条件|公式|参数|流程|局限|限制|不足|结果|结论|指标)"
        r".*(?:和|与|及|、).*"
        r"(?:原理|特点|条件|公式|参数|流程|局限|限制|不足|结果|结论|指标)",
    ),
)
DEMAND = r"为什么|为何|如何|怎么|多少|哪些|是什么|有什么|结论|结果"
MIN_ALIAS, MIN_CANONICAL, MIN_NAME = 4, 6, 12
# Names that may share a head under which they are looked up.
SHARED_HEAD = 16
# Characters of texts whose places are held together.
PART = 1 << 20
# Cells of the table of the heads' hashes, and the base of the hash with its inverse modulo 2^64.
_CELL_BITS = 22
_BASE, _INVERSE = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def query_type(text: Column, image: Column) -> Column:
    """text, image or multimodal; null when there is neither."""
    has_text = F.length(strip(F.coalesce(text, F.lit("")))) > 0
    has_image = F.coalesce(F.length(image) > 0, F.lit(False))
    return F.when(has_text & has_image, "multimodal").when(has_image, "image").when(has_text, "text")


def complexity(text: Column, patterns=COMPLEXITY, demand: str = DEMAND) -> Column:
    """The first kind of multi-step wording, several demands, or a simple query."""
    kind = None
    for name, pattern in patterns:
        hit = text.rlike(f"(?i){pattern}")
        kind = F.when(hit, name) if kind is None else kind.when(hit, name)
    return kind.when(F.regexp_count(text, F.lit(f"(?i){demand}")) >= 2, "multi_fact").otherwise("simple_query")


def agent_route(df: DataFrame, settings: QuerySettings = QuerySettings()) -> DataFrame:
    """Add agentic_active and its reason from mode, the model's opinion, or wording.

    Uses rewritten_query, original_query, retrieval_query and query_needs_planning
    (boolean or null) where present.
    """
    if not settings.agentic_rag_enabled:
        return df.withColumn("agentic_active", F.lit(False)).withColumn("agentic_route_reason", F.lit("disabled"))
    mode = settings.agentic_rag_mode
    fixed = {"workflow": (False, "workflow_mode"), "agentic": (True, "forced_agentic")}.get(mode)
    if mode != "hybrid":
        active, reason = fixed or (False, "invalid_mode")
        return df.withColumn("agentic_active", F.lit(active)).withColumn("agentic_route_reason", F.lit(reason))
    have = set(df.columns)
    texts = [c for c in ("rewritten_query", "original_query", "retrieval_query") if c in have]
    kinds = [F.nullif(complexity(strip(F.coalesce(c, F.lit("")))), F.lit("simple_query")) for c in texts]
    worded = F.coalesce(*kinds, F.lit("simple_query"))
    opinion = F.col("query_needs_planning") if "query_needs_planning" in have else F.lit(None).cast("boolean")
    reason = F.when(opinion, "llm_needs_planning").when(~opinion, "llm_simple_query").otherwise(worded)
    return df.withColumn("agentic_route_reason", reason).withColumn(
        "agentic_active", F.coalesce(opinion, F.col("agentic_route_reason") != "simple_query")
    )


def mentions(text: Column) -> Column:
    """Quoted titles and model codes, unique in order."""
    return unique_strings(F.concat(F.regexp_extract_all(text, F.lit(QUOTED_TITLE), F.lit(1)), model_codes(text)))


def routable(name_key: Column, has_code: Column, canonical: Column, query: Column) -> Column:
    """A real document name or product code rather than a general abbreviation."""
    return (F.length(name_key) > 0) & (
        (canonical & (F.length(name_key) >= MIN_CANONICAL))
        | (F.length(name_key) >= MIN_NAME)
        | has_code
        | query.rlike(f"(?i){DOCUMENT_CUE}")
    )


def registry_names(registry: DataFrame) -> DataFrame:
    """(name_key, name_has_code, canonical, doc_id, group_key): one row per distinct name."""
    names = F.concat(
        F.array(F.struct(F.col("canonical_title").alias("name"), F.lit(True).alias("canonical"))),
        F.transform(
            F.coalesce("aliases", F.array().cast("array<string>")),
            lambda a: F.struct(a.alias("name"), F.lit(False).alias("canonical")),
        ),
    )
    rows = registry.select("doc_id", group_key().alias("group_key"), F.explode(names).alias("n"))
    return rows.select(
        "doc_id", "group_key", normalize_name(F.col("n.name")).alias("name_key"), F.col("n.canonical").alias("canonical"),
        (F.size(model_codes(F.coalesce("n.name", F.lit("")))) > 0).alias("name_has_code"),
    ).where(F.length("name_key") > 0)


def group_key() -> Column:
    """Documents with one normalized title are one logical document."""
    key = normalize_name(F.col("canonical_title"))
    return F.when(F.length(key) > 0, key).otherwise(F.col("doc_id"))


def headed_names(known: DataFrame) -> DataFrame:
    """(name_key, head): the longest beginning of 4, 8, 16, ... characters of each name, or all of it.

    A head is a whole name where too many names share the beginning, so one that very many names share
    is never looked up by itself, and a text that holds a head mostly holds the name. ``known`` holds distinct names of ``MIN_ALIAS`` characters or more.
    """
    length = F.length("name_key")
    doubled = F.filter(F.expr("transform(sequence(2, 30), i -> shiftleft(1, i))"), lambda n: n < length)
    heads = known.select("name_key", F.explode(F.array_append(doubled, length)).alias("size"))
    heads = heads.withColumn("head", F.expr("substring(name_key, 1, size)"))
    crowd = heads.groupBy("head").agg(F.count(F.lit(1)).alias("names"))
    good = heads.join(crowd, "head").where((F.col("names") <= SHARED_HEAD) | (F.col("size") == length))
    return good.groupBy("name_key").agg(F.max_by("head", F.when(F.col("size") < length, F.col("size")).otherwise(0)).alias("head"))


def head_cells(known: DataFrame) -> np.ndarray:
    """A bit table of fixed size with the hashes of all heads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_size: dict[int, list[str]] = {}
            for head in batch.column("head").to_pylist():
                by_size.setdefault(len(head), []).append(head)
            for size, heads in by_size.items():
                places = np.arange(len(heads)) * size
                cells = _cells(_code_points("".join(heads)), size)[places]
                yield pa.RecordBatch.from_arrays([pa.array(cells.astype(np.int64))], ["cell"])

    words = known.select("head").mapInArrow(run, "cell long").select(
        F.expr("cast(cell div 64 as int)").alias("word"), F.expr("shiftleft(1L, cast(cell % 64 as int))").alias("bit")
    )
    table = np.zeros((1 << _CELL_BITS) // 64, np.int64)
    for row in words.groupBy("word").agg(F.bit_or("bit").alias("bits")).collect():
        table[row["word"]] = row["bits"]
    return table.view(np.uint64)


def _code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)


def _cells(codes: np.ndarray, size: int, known: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """The cell of each window of ``size`` characters, from differences of running sums."""
    sums, down = known or _running(codes)
    windows = (sums[size:] - sums[:-size]) * down[: len(codes) - size + 1]
    return ((windows ^ (windows >> np.uint64(32))) * _BASE) >> np.uint64(64 - _CELL_BITS)


def _running(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the characters before each place, weighted by powers, and what takes a place's power off again."""
    up = np.cumprod(np.full(len(codes), _BASE))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(codes * up, dtype=np.uint64)))
    return sums, np.cumprod(np.full(len(codes), _INVERSE))


def _head_places(sizes: list[int], table: np.ndarray):
    """An Arrow function from (query_id, key) to (query_id, head): windows whose cell some head has, once for a part."""
    longest = max(sizes, default=1)

    def parts(batch: pa.RecordBatch) -> Iterator[tuple[list[int], list[str]]]:
        rows, texts, held = [], [], 0
        for row, key in enumerate(batch.column("key").to_pylist()):
            for start in range(0, len(key), PART):
                piece = key[start : start + PART + longest - 1]
                rows.append(row)
                texts.append(piece)
                held += len(piece)
                if held >= PART:
                    yield rows, texts
                    rows, texts, held = [], [], 0
        if rows:
            yield rows, texts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in parts(batch):
                text, ends = "".join(texts), np.cumsum([len(t) for t in texts])
                codes = _code_points(text)
                known = _running(codes)
                found = set()
                for size in sizes:
                    if size > len(codes):
                        continue
                    cells = _cells(codes, size, known)
                    at = np.flatnonzero((table[cells >> np.uint64(6)] >> (cells & np.uint64(63))) & np.uint64(1))
                    owner = np.searchsorted(ends, at, side="right")
                    inside = at + size <= ends[owner]
                    found.update((rows[o], text[i : i + size]) for o, i in zip(owner[inside].tolist(), at[inside].tolist(), strict=True))
                ids = batch.column("query_id").take(pa.array([row for row, _ in found], pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array([head for _, head in found], pa.string())], ["query_id", "head"])

    return run


def contained_names(queries: DataFrame, names: DataFrame) -> DataFrame:
    """(query_id, name_key, doc_id, group_key) of registry names inside a query's text.

    At each place of the query the few head lengths in use are looked up in a table of fixed size with the
    hashes of the names' heads (:func:`headed_names`). Places that it lets through join with the heads, and names found are
    sought in the query as a whole. A place has at most ``SHARED_HEAD`` candidates for each head length, whatever the
    number of names and however many begin alike. Long texts are looked up part by part. Only names contained in no
    longer matched name of the query remain, besides all of the greatest length.
    """
    known = names.select("name_key").where(F.length("name_key") >= MIN_ALIAS).distinct()
    known = materialize(headed_names(known), "heads")
    # As many lengths as heads have, of which there are few.
    sizes = sorted(r[0] for r in known.select(F.length("head")).distinct().collect())
    keyed = materialize(queries.select("query_id", normalize_name(F.col("text")).alias("key")), "keys")
    starts = keyed.mapInArrow(_head_places(sizes, head_cells(known)), keyed.select("query_id", F.col("key").alias("head")).schema)
    # Most texts name nothing, and what was found has a known size when the texts are joined.
    near = materialize(starts.join(known, "head").select("query_id", "name_key").distinct(), "near")
    parts = near.join(keyed, "query_id").where(F.contains("key", "name_key")).select("query_id", "name_key")
    parts = materialize(parts, "named").join(queries.select("query_id", F.col("text").alias("query_text")), "query_id")
    hits = parts.join(names, "name_key").where(
        routable(F.col("name_key"), F.col("name_has_code"), F.col("canonical"), F.col("query_text"))
    )
    found = materialize(hits.select("query_id", "name_key", "doc_id", "group_key").distinct(), "found")
    matched = found.groupBy("query_id").agg(F.collect_set("name_key").alias("matched"))
    strong = ~F.exists(
        "matched", lambda longer: (longer != F.col("name_key")) & F.contains(longer, F.col("name_key"))
    )
    longest = F.array_max(F.transform("matched", F.length))
    return found.join(matched, "query_id").where(strong | (F.length("name_key") == longest)).drop("matched")


def code_matches(queries: DataFrame, registry: DataFrame) -> DataFrame:
    """(query_id, doc_id, group_key): documents holding every model code of the query.

    Joined on one code at a time and counted, never query against every document.
    """
    wanted = queries.select("query_id", model_codes(F.col("text")).alias("codes")).where(F.size("codes") > 0)
    each = wanted.select("query_id", F.size("codes").alias("needed"), F.explode("codes").alias("code"))
    owned = registry.select("doc_id", group_key().alias("group_key"), F.explode("model_codes").alias("code")).distinct()
    joined = each.join(owned, "code").groupBy("query_id", "needed", "doc_id", "group_key").agg(
        F.count(F.lit(1)).alias("held")
    )
    return joined.where(F.col("held") == F.col("needed")).select("query_id", "doc_id", "group_key")


def deterministic_matches(queries: DataFrame, registry: DataFrame) -> DataFrame:
    """(query_id, doc_id, soft): documents named in the text; codes count when no name does.

    Soft when the names found stand for more logical documents than there are names. One
    row per document, so a name many documents share stays spread out.
    """
    by_name = contained_names(queries, registry_names(registry))
    named = by_name.groupBy("query_id").agg(
        (F.count_distinct("group_key") > F.count_distinct("name_key")).alias("soft")
    )
    by_code = code_matches(queries.join(named, "query_id", "left_anti"), registry)
    coded = by_code.groupBy("query_id").agg((F.count_distinct("group_key") > 1).alias("soft"))
    rows = [
        found.select("query_id", "doc_id").distinct().join(flag, "query_id")
        for found, flag in ((by_name, named), (by_code, coded))
    ]
    return rows[0].unionByName(rows[1])


def exact_matches(mentioned: DataFrame, candidates: DataFrame) -> DataFrame:
    """(query_id, mention, doc_id, group_key): names equal to a mention, else its codes.

    ``mentioned`` is (query_id, mention, text); ``candidates`` is (query_id, mention) joined
    with registry fields, the documents considered for that mention.
    """
    keyed = mentioned.withColumn("mention_key", normalize_name(F.col("mention")))
    names = registry_names(candidates.select("doc_id", "canonical_title", "aliases").distinct()).withColumnRenamed(
        "name_key", "mention_key"
    )
    pool = candidates.select("query_id", "mention", "doc_id").distinct()
    named = keyed.join(pool, ["query_id", "mention"]).join(names, ["doc_id", "mention_key"]).where(
        routable(F.col("mention_key"), F.col("name_has_code"), F.col("canonical"), F.col("text"))
    ).select("query_id", "mention", "doc_id", "group_key").distinct()
    rest = mentioned.join(named, ["query_id", "mention"], "left_anti").withColumn("codes", model_codes(F.col("mention")))
    coded = rest.where(F.size("codes") > 0).join(candidates, ["query_id", "mention"]).where(
        F.size(F.array_except("codes", "model_codes")) == 0
    ).select("query_id", "mention", "doc_id", group_key().alias("group_key")).distinct()
    return named.unionByName(coded)


def decide_route(
    queries: DataFrame,
    referred: DataFrame,
    deterministic: DataFrame,
    mentioned: DataFrame,
    matches: DataFrame,
    candidates: DataFrame,
) -> DataFrame:
    """(query_id, mode, locked, reason, basis): one route per query.

    In order: documents the conversation refers to; names or codes in the text (soft when
    ambiguous); no mention; ambiguous mentions; every mention unique; weak candidates,
    which leave the search global. ``basis`` says which documents count; see
    :func:`route_documents`.
    """
    yes = F.lit(True)
    ref = referred.select("query_id").distinct().withColumn("has_ref", yes)
    det = deterministic.groupBy("query_id").agg(F.max("soft").alias("det_soft"))
    wanted = mentioned.groupBy("query_id").agg(F.count_distinct("mention").alias("wanted"))
    per_mention = matches.groupBy("query_id", "mention").agg(F.count_distinct("group_key").alias("groups"))
    summary = per_mention.groupBy("query_id").agg(
        F.count_if(F.col("groups") == 1).alias("unique"), F.count_if(F.col("groups") > 1).alias("many")
    )
    weak = candidates.select("query_id").distinct().withColumn("has_weak", yes)
    df = queries.select("query_id")
    for part in (ref, det, wanted, summary, weak):
        df = df.join(part, "query_id", "left")
    cases = [
        (F.col("has_ref"), "hard", True, "conversation_document_reference", "referred"),
        (F.col("det_soft"), "soft", True, "explicit_document_ambiguous", "deterministic"),
        (F.col("det_soft").isNotNull(), "hard", True, "explicit_document_match", "deterministic"),
        (F.coalesce("wanted", F.lit(0)) == 0, "global", False, "no_document_mention", "none"),
        (F.col("many") > 0, "soft", True, "explicit_document_ambiguous", "ambiguous"),
        (F.col("unique") == F.col("wanted"), "hard", True, "explicit_document_match", "unique"),
        (F.col("has_weak"), "global", False, "weak_document_candidate", "weak"),
    ]
    outcome = F
    for test, *values in cases:
        mode, locked, reason, basis = (F.lit(v) for v in values)
        route = F.struct(mode.alias("mode"), locked.alias("locked"), reason.alias("reason"), basis.alias("basis"))
        outcome = outcome.when(F.coalesce(test, F.lit(False)), route)
    default = F.struct(
        F.lit("global").alias("mode"), F.lit(False).alias("locked"), F.lit("no_document_mention").alias("reason"), F.lit("none").alias("basis")
    )
    return df.select("query_id", outcome.otherwise(default).alias("r")).select("query_id", "r.*")


def route_documents(
    routes: DataFrame,
    referred: DataFrame,
    deterministic: DataFrame,
    matches: DataFrame,
    candidates: DataFrame,
    settings: QuerySettings = QuerySettings(),
) -> DataFrame:
    """(query_id, doc_id, mode): the documents behind each route, one row each.

    Weak candidates, best first, are limited to the number of options shown.
    """
    groups = matches.groupBy("query_id", "mention").agg((F.count_distinct("group_key") > 1).alias("many"))
    matched = matches.join(groups, ["query_id", "mention"])
    firsts = candidates.groupBy("query_id", "doc_id").agg(F.min("pos").alias("pos"))
    best = top_k(firsts, ["query_id"], [F.col("pos").asc(), F.col("doc_id").asc()], settings.document_route_max_options)
    sources = {
        "referred": referred, "deterministic": deterministic, "ambiguous": matched.where("many"), "unique": matched, "weak": best,
    }
    rows = None
    for basis, found in sources.items():
        part = routes.where(F.col("basis") == basis).join(found.select("query_id", "doc_id").distinct(), "query_id")
        part = part.select("query_id", "doc_id", "mode")
        rows = part if rows is None else rows.unionByName(part)
    return rows
