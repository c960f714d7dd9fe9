"""Registered queries of document routing over whole titles, codes and mentions, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions.text import model_codes
from marlstone.models import embed
from marlstone.operators import registry, routing
from marlstone.operators.lexical import vector_index
from marlstone.plans.search_queries import _HASHED, _WORDS, K
from marlstone.plans.tables import questions, stored, table
from marlstone.plans.text_queries import _name
from marlstone.session import materialize, spread


def _line(text: str = "text"):
    return F.split(text, "\n")[0]


def passage_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages as registered documents: the first line is the title, the last one an alias."""
    lines = F.split("text", "\n")
    return table(spark, sf_dir, "benchmark").select(
        F.concat(F.lit("item_"), "item_id").alias("doc_id"), lines[0].alias("canonical_title"), F.array(F.element_at(lines, -1)).alias("aliases"),
        model_codes(F.col("text")).alias("model_codes"),
    )


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("query_id"), "text"), "query_id")


def titles_in_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole titles and aliases of passages inside every whole document, the longest ones only."""
    names = routing.registry_names(passage_registry(spark, sf_dir))
    return routing.contained_names(texts(spark, sf_dir), names).select("query_id", "name_key", "doc_id", "group_key")


def codes_in_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold every model code of another document's last line."""
    docs = table(spark, sf_dir, "documents")
    asked = docs.select(F.col("doc_id").alias("query_id"), F.element_at(F.split("text", "\n"), -1).alias("text"))
    known = docs.select(F.concat(F.lit("doc_"), "doc_id").alias("doc_id"), F.lit("").alias("canonical_title"), model_codes(F.col("text")).alias("model_codes"))
    return routing.code_matches(asked, known).select("query_id", "doc_id").distinct()


def title_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored vectors of the documents' first lines."""
    rows = table(spark, sf_dir, "documents").select(F.concat(F.lit("doc_"), "doc_id").alias("doc_id"), _line().alias("title"))
    return stored(spark, sf_dir, "documents", "titles", lambda: materialize(embed(rows, "title", ["doc_id"]), "titles"))


def registry_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten titles nearest to every question's first line."""
    mentioned = questions(spark, sf_dir).select("query_id", _line().alias("mention"), F.lit(0).alias("place"))
    vectors = title_vectors(spark, sf_dir)
    keyed = vectors.withColumnRenamed("doc_id", "chunk_id")
    sparse = stored(spark, sf_dir, "documents", "title_postings", lambda: vector_index(keyed))
    return registry.search_registry(mentioned, vectors, sparse=sparse)


QUERIES = {"titles_in_texts": titles_in_texts, "codes_in_texts": codes_in_texts, "registry_search": registry_search}

_CODES = """
runs as (select doc_id, kind, unnest(regexp_extract_all(t, '[A-Za-z0-9_-]+')) run from (
  select doc_id, 'all' kind, text t from documents union all select doc_id, 'last', list_last(string_split(text, chr(10))) from documents)),
cut as (select doc_id, kind, p, unnest(p) part, unnest(range(1, len(p) + 1)) i from (select doc_id, kind, string_split_regex(run, '[-_]{2,}') p from runs)),
fit as (select doc_id, kind, regexp_replace(part, '^[-_]+|[-_]+$', '', 'g') part, array_to_string(p[i:], '--') rest from cut),
codes as (select distinct doc_id, kind, lower(regexp_replace(part, '[-_]', '', 'g')) code from fit
  where part <> '' and regexp_matches(rest, '[A-Za-z]') and regexp_matches(rest, '[0-9]'))"""
_TITLES = f"""
docs as (select 'doc_' || doc_id chunk_id, {_WORDS.format("split_part(text, chr(10), 1)")} toks from documents),
lines as (select distinct split_part(text, chr(10), 1) item_id, split_part(text, chr(10), 1) text from benchmark)"""
_TITLE_SEARCH = (
    _HASHED.replace("from benchmark", "from lines").replace("d.doc_id chunk_id", "d.chunk_id").replace("documents d left join db on db.chunk_id = d.doc_id", "docs d left join db on db.chunk_id = d.chunk_id")
    .replace(f"rank <= {K}", "rank <= 10")
)

ORACLES = {
    "titles_in_texts": f"""
with reg as (select 'item_' || item_id doc_id, split_part(text, chr(10), 1) title, list_last(string_split(text, chr(10))) alias from benchmark),
names as (select doc_id, title n, {_name('title')} k, true canonical, {_name('title')} gk from reg
  union all select doc_id, alias, {_name('alias')}, false, {_name('title')} from reg),
named as (select doc_id, k, canonical, case when gk <> '' then gk else doc_id end gk,
  regexp_matches(n, '[A-Za-z0-9_-]*[A-Za-z][A-Za-z0-9_-]*[0-9]|[A-Za-z0-9_-]*[0-9][A-Za-z0-9_-]*[A-Za-z]') coded from names where k <> ''),
keyed as (select doc_id query_id, {_name('text')} t from documents),
hits as (select distinct query_id, k name_key, doc_id, gk group_key from keyed join named
  on length(k) >= 4 and contains(t, k) where (canonical and length(k) >= 6) or length(k) >= 12 or coded)
select h.* from hits h where not exists (select 1 from hits l where l.query_id = h.query_id and l.name_key <> h.name_key and contains(l.name_key, h.name_key))
  or length(h.name_key) = (select max(length(l.name_key)) from hits l where l.query_id = h.query_id)""",
    "codes_in_texts": f"""
with {_CODES},
wanted as (select doc_id query_id, code, count(*) over (partition by doc_id) needed from codes where kind = 'last')
select query_id, 'doc_' || c.doc_id doc_id from wanted w join codes c on c.kind = 'all' and c.code = w.code
group by query_id, c.doc_id, needed having count(*) = needed""",
    "registry_search": f"""
with {_TITLES}, {_TITLE_SEARCH}
select item_id query_id, split_part(text, chr(10), 1) mention, chunk_id doc_id, rank pos, score route_score
from benchmark join hybrid on hybrid.query_id = split_part(text, chr(10), 1)""",
}
