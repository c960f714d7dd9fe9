"""Sections to chunks: split long bodies, merge short neighbours, number and assemble."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.config import IngestSettings
from marlstone.functions import formula
from marlstone.functions.tables import tables_as_sentences
from marlstone.functions.text import SPACE
from marlstone.operators.sections import cut_sections, heading_tree, parent_summary

_GAP = "\n\n"
_SAME = ["file_title", "section_path", "section_id", "parent_section_id", "parent_summary"]


@F.pandas_udf(T.ArrayType(T.StringType()))
def _split(bodies: pd.Series, sizes: pd.Series) -> pd.Series:
    return pd.Series(
        [
            None if body is None else formula.split_around_formulas(body, int(size))
            for body, size in zip(bodies, sizes)
        ]
    )


def with_pieces(sections: DataFrame, settings: IngestSettings = IngestSettings()) -> DataFrame:
    """Replace ``body`` by ``pieces``: array of (title, body).

    Tables become sentences first. Only bodies over the limit go through the splitter; its
    pieces are titled with a number.
    """
    short = F.substring("title", 1, settings.title_cut)
    room = settings.max_content_length - (F.length(short) + len(_GAP))
    linear = sections.withColumn("body", tables_as_sentences(F.col("body")))
    too_long = (F.length("body") > room) & (room > 0)
    cut = linear.withColumn("cut", _split(F.when(too_long, F.col("body")), room))
    numbered = F.transform(
        "cut",
        lambda text, i: F.struct(
            F.concat(short, F.lit("_"), (i + 1).cast("string")).alias("title"), text.alias("body")
        ),
    )
    whole = F.array(F.struct(F.col("title"), F.col("body")))
    return cut.withColumn("pieces", F.when(too_long, numbered).otherwise(whole)).drop("cut", "body")


def _fold(items: Column, settings: IngestSettings, kind: T.DataType) -> Column:
    """Left fold over ordered pieces of one section: grow the open piece while it is short."""
    trimmed = lambda text: F.regexp_replace(text, f"{SPACE}+$", "")
    start = F.struct(F.array().cast(T.ArrayType(kind)).alias("done"), items[0].alias("open"))

    def step(acc: Column, item: Column) -> Column:
        opened = acc["open"]
        gap = len(_GAP)
        is_short = F.length(opened["title"]) + gap + F.length(opened["body"]) < settings.min_content_length
        joined = (
            F.length(opened["parent_title"]) + gap
            + F.length(trimmed(opened["body"])) + gap
            + F.length(item["body"])
        )
        grown = F.struct(
            opened["sec_no"].alias("sec_no"),
            opened["piece_no"].alias("piece_no"),
            opened["section_title"].alias("title"),
            opened["parent_title"].alias("parent_title"),
            opened["section_title"].alias("section_title"),
            F.concat(trimmed(opened["body"]), F.lit(_GAP), item["body"]).alias("body"),
        )
        merge = is_short & (joined <= settings.max_content_length)
        return F.struct(
            F.when(merge, acc["done"]).otherwise(F.array_append(acc["done"], opened)).alias("done"),
            F.when(merge, grown).otherwise(item).alias("open"),
        )

    rest = F.slice(items, 2, F.greatest(F.size(items) - 1, F.lit(1)))
    return F.aggregate(rest, start, step, lambda acc: F.array_append(acc["done"], acc["open"]))


def merge_short(
    sections: DataFrame, key: str = "doc_key", settings: IngestSettings = IngestSettings()
) -> DataFrame:
    """Merge short pieces into the next one of the same section.

    The fold runs over each stretch of neighbouring pieces with one section id, which is
    where merging can happen at all.
    """
    # The outer form: a plain explode would evaluate the pieces once more to filter empty ones.
    pieces = sections.select(
        key, "sec_no", "parent_title", "section_title", *_SAME,
        F.posexplode_outer("pieces").alias("piece_no", "piece"),
    ).select(key, "sec_no", "piece_no", "parent_title", "section_title", *_SAME, "piece.title", "piece.body")
    order = Window.partitionBy(key).orderBy("sec_no", "piece_no")
    starts = F.coalesce(F.lag("section_id").over(order) != F.col("section_id"), F.lit(True))
    runs = pieces.withColumn("starts", starts).withColumn(
        "run", F.sum(F.col("starts").cast("int")).over(order)
    )
    item = F.struct("sec_no", "piece_no", "title", "parent_title", "section_title", "body")
    grouped = runs.groupBy(key, "run").agg(
        F.array_sort(F.collect_list(item)).alias("items"),
        *[F.min_by(c, F.struct("sec_no", "piece_no")).alias(c) for c in _SAME],
    )
    kind = grouped.schema["items"].dataType.elementType
    folded = F.when(F.size("items") > 1, _fold(F.col("items"), settings, kind)).otherwise(F.col("items"))
    return grouped.withColumn("items", folded).select(
        key, *_SAME, "run", F.posexplode_outer("items").alias("run_pos", "item")
    ).select(
        key, *_SAME, "run", "run_pos",
        *[F.col(f"item.{c}").alias(c) for c in ("title", "parent_title", "section_title", "body")],
    )


def assemble(blocks: DataFrame, key: str = "doc_key") -> DataFrame:
    """Chunk rows: content, position in the document and in the section, formula fields."""
    in_doc = Window.partitionBy(key).orderBy("run", "run_pos")
    in_section = Window.partitionBy(key, "section_id").orderBy("run", "run_pos")
    numbered = blocks.withColumn("chunk_index", F.row_number().over(in_doc) - 1).withColumn(
        "section_chunk_index", F.row_number().over(in_section) - 1
    )
    content = F.concat("title", F.lit(_GAP), "body")
    described = numbered.withColumn("content", content).withColumn(
        "formulas", F.coalesce(formula.formulas(F.col("content")), F.array().cast(T.ArrayType(formula.FORMULA)))
    )
    return described.select(
        key, "file_title", "title", "parent_title", "section_title", "section_path", "section_id",
        "parent_section_id", "parent_summary", "chunk_index", "section_chunk_index", "content",
        (F.size("formulas") > 0).alias("has_formula"), "formulas",
        formula.search_text(F.col("formulas")).alias("formula_search_text"),
    )


def chunk_documents(
    docs: DataFrame, key: str = "doc_key", settings: IngestSettings = IngestSettings()
) -> DataFrame:
    """Markdown documents (key, file_title, content) to chunks with one shuffle of the text.

    Cutting, table rewriting and splitting are row-local and come first; the heading tree,
    merging and numbering then share one layout by document.
    """
    cut = cut_sections(docs, key)
    cut = cut.withColumn("blank", F.length("body") == 0).withColumn(
        "parent_summary", parent_summary(F.col("body"), settings.parent_summary_chars)
    )
    tree = heading_tree(with_pieces(cut, settings), key)
    return assemble(merge_short(tree, key, settings), key)
