"""Registered text, identity, section and chunk queries with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.functions import formula, ids
from marlstone.functions.text import model_codes, normalize_name
from marlstone.operators import identity
from marlstone.operators.chunks import chunk_documents, merge_short
from marlstone.operators.formulas import work_list
from marlstone.operators.sections import heading_sections
from marlstone.plans.tables import outlines, page_markdown, table
from marlstone.session import spread


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"), "doc_id")


def name_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name key of whole texts, as length and digest."""
    key = _docs(spark, sf_dir).select("doc_id", normalize_name(F.col("text")).alias("key"))
    return key.select("doc_id", F.length("key").alias("key_length"), ids.sha256_hex(F.col("key")).alias("key_sha"))


def codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _docs(spark, sf_dir).select("doc_id", model_codes(F.col("text")).alias("codes"))
    return found.select("doc_id", F.size("codes").alias("n_codes"), F.array_join("codes", " ").alias("codes"))


def identity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ids of each document, its lines taken as chunks and its first line as title."""
    lines = F.split("text", "\n")
    rows = _docs(spark, sf_dir).select(
        "doc_id", ids.sha256_hex(F.col("text")).alias("source_hash"),
        ids.content_hash(lines).alias("content_hash"), lines[0].alias("title"),
    )
    rows = rows.withColumn("version_id", ids.version_id(F.col("source_hash")))
    logical = ids.logical_id(F.col("title"), F.col("content_hash"))
    return rows.select(
        "doc_id", "source_hash", "content_hash", "version_id",
        ids.doc_id(F.col("version_id"), F.col("content_hash")).alias("document_key"),
        logical["logical_document_id"].alias("logical_document_id"),
        logical["logical_id_source"].alias("logical_id_source"),
    )


def stable_chunk_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk key of every line of every document."""
    lines = _docs(spark, sf_dir).select("doc_id", "source", "lang", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    return lines.select("doc_id", "i", ids.chunk_id(F.col("source"), F.col("doc_id").cast("string"), F.col("lang"), F.col("i"), F.col("line")).alias("chunk_id"))


def retrieval_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retrieval text of whole documents under their source, as length and digest."""
    text = identity.retrieval_text(
        F.col("source"), F.col("lang"), F.lit(""), F.split("text", "\n")[0], F.col("text"), F.lit(None).cast("string")
    )
    rows = _docs(spark, sf_dir).select("doc_id", text.alias("t"))
    return rows.select("doc_id", F.length("t").alias("text_length"), ids.sha256_hex(F.col("t")).alias("text_sha"))


def _flat_sections(sections: DataFrame) -> DataFrame:
    return sections.select(
        "doc_key", "sec_no", "title", "parent_title", "section_path", "section_id", "parent_section_id",
        "parent_summary", F.length("body").alias("body_length"), ids.sha256_hex(F.col("body")).alias("body_sha"),
    )


def sections_of_outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat_sections(heading_sections(outlines(spark, sf_dir)))


def sections_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat_sections(heading_sections(page_markdown(spark, sf_dir)))


def section_chunk_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Position of every section among those of its document with the same path."""
    same = Window.partitionBy("doc_key", "section_id").orderBy("sec_no")
    rows = heading_sections(outlines(spark, sf_dir))
    return rows.select("doc_key", "sec_no", "section_id", (F.row_number().over(same) - 1).alias("section_chunk_index"))


def merged_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document merged while short, as pieces of one section."""
    piece = lambda t: F.struct(F.lit("line").alias("title"), t.alias("body"))
    sections = _docs(spark, sf_dir).select(
        F.col("doc_id").alias("doc_key"), F.lit(0).alias("sec_no"), F.col("source").alias("parent_title"), F.col("lang").alias("section_title"),
        F.col("source").alias("file_title"), F.col("lang").alias("section_path"), F.col("source").alias("section_id"),
        F.lit("").alias("parent_section_id"), F.lit("").alias("parent_summary"), F.transform(F.split("text", "\n"), piece).alias("pieces"),
    )
    merged = merge_short(sections)
    return merged.select("doc_key", "run_pos", "title", F.length("body").alias("body_length"), ids.sha256_hex(F.col("body")).alias("body_sha"))


def _flat_chunks(chunks: DataFrame) -> DataFrame:
    return chunks.select(
        "doc_key", "chunk_index", "section_chunk_index", "section_id", "title", "has_formula",
        F.length("content").alias("content_length"), ids.sha256_hex(F.col("content")).alias("content_sha"),
    )


def chunks_of_outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat_chunks(chunk_documents(outlines(spark, sf_dir)))


def chunks_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat_chunks(chunk_documents(page_markdown(spark, sf_dir)))


def formulas_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _docs(spark, sf_dir).select("doc_id", F.posexplode(formula.formulas(F.col("text"))).alias("pos", "f"))
    return rows.select("doc_id", "pos", "f.formula_id", "f.display", F.length("f.latex").alias("latex_length"), "f.keywords")


def formula_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = work_list(chunk_documents(outlines(spark, sf_dir)))
    return work.select("formula_id", "latex", "section_title", F.length("context").alias("context_length"))


def fallback_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fallback identity and ids of every outlined document."""
    chunks = chunk_documents(outlines(spark, sf_dir))
    known = identity.with_document_ids(identity.fallback_identity(identity.evidence(chunks)))
    return known.select(
        "doc_key", "canonical_title", "title_source", "title_confidence", "requires_review",
        F.array_join("aliases", " | ").alias("aliases"), "doc_id", "logical_document_id",
        F.length("profile_text").alias("profile_length"),
    )


QUERIES = {
    "name_normalize": name_normalize,
    "model_codes": codes,
    "identity_chain": identity_chain,
    "stable_chunk_id": stable_chunk_id,
    "retrieval_text": retrieval_texts,
    "heading_sections": sections_of_outlines,
    "page_sections": sections_of_pages,
    "section_chunk_index": section_chunk_index,
    "merge_short": merged_lines,
    "chunk_documents": chunks_of_outlines,
    "chunk_pages": chunks_of_pages,
    "formula_extract": formulas_of_documents,
    "formula_work_list": formula_work,
    "fallback_identity": fallback_identities,
}

# ---------------------------------------------------------------- SQL twins

# White space as Python and (?U) Java see it, spelled out for an engine with ASCII \s.
_WS = "\\s\\x{0b}\\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}"


def _name(x: str) -> str:
    return f"regexp_replace(replace(lower({x}), 'ß', 'ss'), '[{_WS}\\-_/／·•—–_.,，。:：;；()（）\\[\\]【】]+', '', 'g')"


def _collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '[{_WS}]+', ' ', 'g'))"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{_WS}]+|[{_WS}]+$', '', 'g')"


_ID63 = "(('0x' || substr({0}, 1, 8))::ubigint % 2147483648)::bigint * 4294967296 + ('0x' || substr({0}, 9, 8))::bigint"

_OUTLINE = """outline as (select doc_id doc_key, source || '-' || lang file_title,
  regexp_replace(regexp_replace(regexp_replace(text, '(?m)^([^\\n#][^\\n]{40,59})$', '### \\1', 'g'),
    '(?m)^([^\\n#][^\\n]{20,39})$', '## \\1', 'g'), '(?m)^([^\\n#][^\\n]{0,19})$', '# \\1', 'g') content from documents)"""
_PAGES = """outline as (select page_id doc_key, url file_title,
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
    '(?s)<(script|style|head)[^>]*>.*?</(script|style|head)>', '', 'g'), '<h1[^>]*>', chr(10) || '# ', 'g'),
    '<(p|li|div|br|/h1)[^>]*>', chr(10), 'g'), '<[^>]*>', '', 'g') content from pages)"""
_SECTIONS = f"""
raw as (select doc_key, file_title, replace(replace(content, chr(13) || chr(10), chr(10)), chr(13), chr(10)) content from outline),
numbered as (select doc_key, file_title, unnest(string_split(content, chr(10))) line,
  unnest(range(len(string_split(content, chr(10))))) pos from raw),
fenced as (select *, sum(case when regexp_matches(line, '^[{_WS}]*```') then 1 else 0 end)
  over (partition by doc_key order by pos) % 2 code from numbered),
heads as (select *, case when code = 0 and regexp_matches(line, '^[{_WS}]*#{{1,6}}[{_WS}]+.')
  then length(regexp_extract(line, '^[{_WS}]*(#{{1,6}})[{_WS}]+(.+)', 1)) end lv,
  {_strip(f"regexp_extract(line, '^[{_WS}]*(#{{1,6}})[{_WS}]+(.+)', 2)")} ti from fenced),
placed as (select *, count(lv) over (partition by doc_key order by pos) sec_no from heads),
secs as (select doc_key, file_title, sec_no, max(lv) lv, max(case when lv is not null then ti end) ti,
  {_strip("coalesce(string_agg(line, chr(10) order by pos) filter (where lv is null), '')")} body
  from placed group by all),
lastk as (select *, {', '.join(f"max(case when lv = {k} then sec_no end) over (partition by doc_key order by sec_no) p{k}" for k in range(1, 7))} from secs),
livek as (select *, {', '.join(f"case when p{k} > greatest({', '.join(['-1'] + [f'coalesce(p{j}, -1)' for j in range(1, k)])}) then p{k} end q{k}" for k in range(1, 7))} from lastk),
anc as (select doc_key, sec_no, unnest([q1, q2, q3, q4, q5, q6]) at_sec, unnest([1, 2, 3, 4, 5, 6]) k from livek),
named as (select a.doc_key, a.sec_no, a.k, s.ti from anc a join secs s on s.doc_key = a.doc_key and s.sec_no = a.at_sec where s.ti <> ''),
paths as (select doc_key, sec_no, list(ti order by k) titles, list(k order by k) ks from named group by all),
tree as (select s.doc_key, s.file_title, s.sec_no, coalesce(nullif(s.ti, ''), s.file_title) title, s.body, coalesce(p.titles, []) titles,
  list_last(list_filter(list_zip(coalesce(p.ks, []), coalesce(p.titles, [])), lambda x: x[1] < s.lv))[2] parent
  from secs s left join paths p using (doc_key, sec_no) where s.body <> ''),
sections as (select doc_key, sec_no, file_title, title, coalesce(parent, title) parent_title, body,
  case when len(titles) > 0 then array_to_string(titles, ' > ') else title end section_path,
  array_to_string(titles[:-2], ' > ') parent_path from tree),
final as (select doc_key, sec_no, title, parent_title, section_path, substr(sha256(file_title || chr(31) || section_path), 1, 24) section_id,
  case when parent_path <> '' then substr(sha256(file_title || chr(31) || parent_path), 1, 24) else '' end parent_section_id,
  substr({_collapse("regexp_replace(body, '!\\[([^\\]]*)\\]\\([^)]*\\)', '\\1', 'g')")}, 1, 400) parent_summary,
  length(body) body_length, sha256(body) body_sha from sections)"""

ORACLES = {
    "merge_short": f"""with recursive
l as (select doc_id, source, lang, unnest(string_split(text, chr(10))) t, unnest(range(len(string_split(text, chr(10))))) i from documents),
f as (
  select doc_id, source, lang, 0::bigint i, 0 pos, 'line' title, t body, false shut, null::varchar done_title, null::varchar done_body from l where i = 0
  union all
  select f.doc_id, f.source, f.lang, l.i, case when m.ok then f.pos else f.pos + 1 end, case when m.ok then f.lang else 'line' end,
    case when m.ok then m.r || chr(10) || chr(10) || l.t else l.t end, not m.ok, f.title, f.body
  from f join l on l.doc_id = f.doc_id and l.i = f.i + 1,
  lateral (select regexp_replace(f.body, '[{_WS}]+$', '') r) a,
  lateral (select a.r r, length(f.title) + 2 + length(f.body) < 500 and length(f.source) + 2 + length(a.r) + 2 + length(l.t) <= 2000 ok) m),
ended as (select doc_id doc_key, pos - 1 run_pos, done_title title, done_body body from f where shut
  union all select doc_id, arg_max(pos, i), arg_max(title, i), arg_max(body, i) from f group by doc_id)
select doc_key, run_pos, title, length(body) body_length, sha256(body) body_sha from ended""",
    "name_normalize": f"select doc_id, length(k) key_length, sha256(k) key_sha from (select doc_id, {_name('text')} k from documents)",
    "model_codes": """
with runs as (select doc_id, r, unnest(regexp_extract_all(text, '[A-Za-z0-9_-]+')) run, unnest(range(len(regexp_extract_all(text, '[A-Za-z0-9_-]+')))) rn
  from (select doc_id, text, 0 r from documents)),
parts as (select doc_id, rn, p, unnest(p) part, unnest(range(1, len(p) + 1)) i from (select doc_id, rn, string_split_regex(run, '[-_]{2,}') p from runs)),
fit as (select doc_id, rn, i, regexp_replace(part, '^[-_]+|[-_]+$', '', 'g') part, array_to_string(p[i:], '--') rest from parts),
ok as (select doc_id, rn, i, lower(regexp_replace(part, '[-_]', '', 'g')) code from fit
  where part <> '' and regexp_matches(rest, '[A-Za-z]') and regexp_matches(rest, '[0-9]')),
firsts as (select doc_id, code, min(rn * 100000 + i) o from ok group by all),
agg as (select doc_id, count(*) n, string_agg(code, ' ' order by o) codes from firsts group by doc_id)
select d.doc_id, coalesce(n, 0)::int n_codes, coalesce(codes, '') codes from documents d left join agg using (doc_id)""",
    "identity_chain": f"""
with b as (select doc_id, sha256(text) source_hash, sha256(array_to_string(string_split(text, chr(10)), chr(30)) || chr(30)) content_hash,
  split_part(text, chr(10), 1) title from documents),
v as (select *, 'ver_' || substr(source_hash, 1, 24) version_id, {_name('title')} k from b)
select doc_id, source_hash, content_hash, version_id, 'doc_' || substr(sha256(version_id || chr(31) || content_hash), 1, 24) document_key,
  'ldoc_' || substr(sha256(case when k <> '' then 'title:' || k else 'content:' || content_hash end), 1, 24) logical_document_id,
  case when k <> '' then 'canonical_title' else 'content_hash_fallback' end logical_id_source from v""",
    "stable_chunk_id": f"""
with l as (select doc_id, source, lang, unnest(string_split(text, chr(10))) line, unnest(range(len(string_split(text, chr(10)))))::int i from documents),
h as (select doc_id, i, sha256(source || chr(31) || doc_id || chr(31) || lang || chr(31) || i || chr(31) || substr(line, 1, 200)) h from l)
select doc_id, i, {_ID63.format('h')} chunk_id from h""",
    "retrieval_text": f"""
with p as (select doc_id, {_collapse('source')} a, {_collapse('lang')} b,
  {_collapse("split_part(text, chr(10), 1)")} c, {_collapse('text')} d from documents),
t as (select doc_id, concat_ws(chr(10), case when a <> '' then '文档：' || a end, case when b <> '' then '章节路径：' || b end,
  case when c <> '' then '切片标题：' || c end, case when d <> '' then '正文：' || d end) t from p)
select doc_id, length(t) text_length, sha256(t) text_sha from t""",
    "heading_sections": f"with {_OUTLINE}, {_SECTIONS} select * from final",
    "page_sections": f"with {_PAGES}, {_SECTIONS} select * from final",
    "section_chunk_index": f"""with {_OUTLINE}, {_SECTIONS} select doc_key, sec_no, section_id,
  row_number() over (partition by doc_key, section_id order by sec_no) - 1 section_chunk_index from final""",
}
