"""Describe formulas once each and write the descriptions back to every occurrence."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.config import IngestSettings
from marlstone.functions import formula
from marlstone.functions.text import strip
from marlstone.models import Generator, generate

REPLY = T.StructType(
    [
        T.StructField(
            "formulas",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("formula_id", T.StringType()),
                        T.StructField("description", T.StringType()),
                        formula.FORMULA["variables"],
                        formula.FORMULA["conditions"],
                    ]
                )
            ),
        )
    ]
)


def json_object(text: Column) -> Column:
    """The outermost JSON object of a reply, code fences dropped; null when there is none."""
    value = F.regexp_replace(strip(text), r"(?s)\A```[^\n]*\n(.*?)\n?[^\n]*\z", "$1")
    return F.nullif(F.regexp_extract(value, r"(?s)\{.*\}", 0), F.lit(""))


def formula_context(content: Column, item: Column, limit: int) -> Column:
    """Up to ``limit`` characters of the chunk centred on the formula, else its start."""
    limit = max(100, limit)
    raw, latex = F.coalesce(item["raw"], F.lit("")), F.coalesce(item["latex"], F.lit(""))
    found = F.coalesce(
        F.nullif(F.when(F.length(raw) > 0, F.instr(content, raw)), F.lit(0)),
        F.nullif(F.when(F.length(latex) > 0, F.instr(content, latex)), F.lit(0)),
    )
    padding = F.greatest(F.lit(0), limit - F.greatest(F.length(raw), F.length(latex)))
    start = F.greatest(F.lit(0), found - 1 - F.floor(padding / 2).cast("int"))
    end = F.least(F.length(content), start + limit)
    start = F.greatest(F.lit(0), end - limit)
    centred = F.substring(content, start + 1, F.lit(limit))
    return F.when(F.length(content) <= limit, content).when(found.isNull(), F.substring(content, 1, limit)).otherwise(centred)


def work_list(chunks: DataFrame, key: str = "doc_key", settings: IngestSettings = IngestSettings()) -> DataFrame:
    """(formula_id, latex, section_title, context): each formula worth describing, once.

    At most ten per chunk are considered; the first occurrence supplies the context.
    """
    wanted = F.slice(
        F.filter(
            F.filter("formulas", lambda f: F.length(F.coalesce(f["formula_id"], F.lit(""))) > 0), formula.needs_description
        ),
        1,
        max(1, settings.formula_semantic_max_formulas),
    )
    items = chunks.where(F.size("formulas") > 0).select(
        key, "chunk_index", "title", "content", F.posexplode(wanted).alias("pos", "formula")
    )
    first = F.min(
        F.struct(
            key, "chunk_index", "pos",
            F.col("formula.latex").alias("latex"),
            F.coalesce("title", F.lit("")).alias("section_title"),
            formula_context(F.col("content"), F.col("formula"), settings.formula_semantic_context_chars).alias("context"),
        )
    ).alias("first")
    return items.groupBy(F.col("formula.formula_id").alias("formula_id")).agg(first).select(
        "formula_id", "first.latex", "first.section_title", "first.context"
    )


def parse_replies(replies: DataFrame, reply: str = "reply") -> DataFrame:
    """(formula_id, description, variables, conditions) of replies that hold a valid object."""
    parsed = replies.select(F.from_json(json_object(F.col(reply)), REPLY).alias("p"))
    item = parsed.select(F.explode("p.formulas").alias("f"))
    text = lambda c: strip(F.coalesce(c, F.lit("")))
    variables = F.transform(
        F.filter(F.col("f.variables"), lambda v: F.length(F.coalesce(v["symbol"], F.lit(""))) > 0),
        lambda v: F.struct(*[text(v[n]).alias(n) for n in ("symbol", "meaning", "unit")]),
    )
    rows = item.select(
        text(F.col("f.formula_id")).alias("formula_id"),
        text(F.col("f.description")).alias("description"),
        variables.alias("variables"),
        F.filter(F.transform(F.col("f.conditions"), text), lambda c: F.length(c) > 0).alias("conditions"),
    ).where(F.length("formula_id") > 0)
    return rows.groupBy("formula_id").agg(
        F.min(F.struct("description", "variables", "conditions")).alias("d")
    ).select("formula_id", "d.*")


def describe(
    work: DataFrame, factory: Callable[[], Generator], settings: IngestSettings = IngestSettings()
) -> DataFrame:
    """Ask a generator about each formula; failed batches simply give no description."""
    prompts = work.withColumn("prompt", F.to_json(F.struct("formula_id", "latex", "section_title", "context")))
    replies = generate(prompts, "prompt", "reply", factory, settings.formula_semantic_batch_size)
    return parse_replies(replies)


def apply_descriptions(chunks: DataFrame, descriptions: DataFrame, keys: list[str]) -> DataFrame:
    """Fill every occurrence of a described formula and refresh the chunk's search text."""
    some = chunks.where(F.size("formulas") > 0)
    items = some.select(*keys, F.posexplode("formulas").alias("pos", "f"))
    known = descriptions.select(F.col("formula_id").alias("fid"), "description", "variables", "conditions")
    joined = items.join(known, F.col("f.formula_id") == F.col("fid"), "left")
    filled = F.struct(
        *[F.col(f"f.{n}").alias(n) for n in ("formula_id", "latex", "raw", "display", "keywords")],
        *[
            F.when(F.col("fid").isNotNull(), F.col(n)).otherwise(F.col(f"f.{n}")).alias(n)
            for n in ("description", "variables", "conditions")
        ],
    )
    regrouped = joined.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("pos", filled.alias("f")))).alias("items")
    ).select(*keys, F.transform("items", lambda i: i["f"]).alias("formulas"))
    updated = some.drop("formulas", "formula_search_text").join(regrouped, keys).withColumn(
        "formula_search_text", formula.search_text(F.col("formulas"))
    )
    return updated.select(chunks.columns).unionByName(chunks.where(F.size("formulas") == 0))
