"""Heading tree of Markdown documents.

Documents are cut into sections inside their row, without a shuffle. The heading tree then
needs the sections of one document together; a document is one stored file, so that group
is bounded by the file's size however many documents there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions import ids
from marlstone.functions.text import collapse_spaces, first_present, strip

# Markdown line forms.
HEADING = r"(?U)[^\S\n]*(#{1,6})[^\S\n]+([^\n]+)"
FENCE_LINE = r"(?U)(?<=\n)(?=[^\S\n]*```)"
HEADING_LINE = rf"(?U)(?<=\n)(?={HEADING[4:]})"
IMAGE_LINK = r"!\[([^\]]*)\]\([^)]*\)"
PATH_JOIN = " > "
LEVELS = 6
# Marks section starts between two passes over one text; no Markdown file holds it.
_MARK = "\x00\x1d\x00"


def unix_newlines(col: Column) -> Column:
    return F.regexp_replace(col, "\r\n?", "\n")


def parent_summary(body: Column, limit: int = 400) -> Column:
    """Start of the section with image links reduced to their alternative text."""
    return F.substring(collapse_spaces(F.regexp_replace(body, IMAGE_LINK, "$1")), 1, limit)


def cut_sections(
    docs: DataFrame, key: str = "doc_key", title_col: str = "file_title", text_col: str = "content"
) -> DataFrame:
    """(key, sec_no, file_title, level, heading, title, body): one row per heading, in-row.

    The text is cut at fence lines: every other part is code, and headings count only
    outside code. Section 0 is the text before the first heading.
    """
    text = F.concat(F.lit("\n"), unix_newlines(F.coalesce(F.col(text_col), F.lit(""))))
    marked = F.transform(
        F.split(text, FENCE_LINE),
        lambda part, i: F.when(i % 2 == 0, F.regexp_replace(part, HEADING_LINE, _MARK)).otherwise(part),
    )
    parts = docs.select(
        key,
        F.col(title_col).alias("file_title"),
        F.posexplode(F.split(F.array_join(marked, ""), _MARK)).alias("sec_no", "part"),
    )
    is_heading = F.col("sec_no") > 0
    line_end = F.instr("part", "\n")
    rest = F.when(line_end > 0, F.expr("substring(part, instr(part, '\n') + 1)")).otherwise("")
    start = rf"(?U)\A{HEADING[4:]}"
    return parts.select(
        key,
        "sec_no",
        "file_title",
        F.when(is_heading, F.length(F.regexp_extract("part", start, 1))).otherwise(0).alias("level"),
        F.when(is_heading, strip(F.regexp_extract("part", start, 2))).otherwise("").alias("heading"),
        strip(F.when(is_heading, rest).otherwise(F.col("part"))).alias("body"),
    ).withColumn("title", first_present(F.col("heading"), F.col("file_title")))


def heading_tree(sections: DataFrame, key: str = "doc_key") -> DataFrame:
    """Add parent title, section path and ids; drop sections marked ``blank``.

    A heading clears all deeper ones, so a level is live when its latest heading comes
    after the latest heading of every shallower level.
    """
    before = Window.partitionBy(key).orderBy("sec_no").rowsBetween(Window.unboundedPreceding, 0)
    latest = {
        f"h{k}": F.last(
            F.when(F.col("level") == k, F.struct("sec_no", F.lit(k).alias("level"), "heading")),
            ignorenulls=True,
        ).over(before)
        for k in range(1, LEVELS + 1)
    }
    tree = sections.withColumns(latest).where(~F.col("blank"))
    live, newest = [], F.lit(-1)
    for k in range(1, LEVELS + 1):
        seen = F.coalesce(F.col(f"h{k}.sec_no"), F.lit(-1))
        live.append(F.when(seen > newest, F.col(f"h{k}")))
        newest = F.greatest(newest, seen)
    named = F.filter(F.array(*live), lambda h: h.isNotNull() & (F.length(h["heading"]) > 0))
    tree = tree.withColumn("live", named).drop(*latest)
    titles = F.transform("live", lambda h: h["heading"])
    shallower = F.filter("live", lambda h: h["level"] < F.col("level"))
    path = F.when(F.size("live") > 0, F.array_join(titles, PATH_JOIN)).otherwise(F.col("title"))
    parent_path = F.array_join(F.slice(titles, 1, F.greatest(F.size(titles) - 1, F.lit(0))), PATH_JOIN)
    return (
        tree.withColumn("section_title", F.col("title"))
        .withColumn(
            "parent_title", F.coalesce(F.try_element_at(shallower, F.lit(-1))["heading"], "title")
        )
        .withColumn("section_path", path)
        .withColumn("section_id", ids.section_id(F.col("file_title"), F.col("section_path")))
        .withColumn(
            "parent_section_id",
            F.when(
                F.length(parent_path) > 0, ids.section_id(F.col("file_title"), parent_path)
            ).otherwise(""),
        )
        .drop("live", "level", "heading", "blank")
    )


def heading_sections(
    docs: DataFrame, key: str = "doc_key", title_col: str = "file_title", text_col: str = "content"
) -> DataFrame:
    """Sections with a non-blank body, in order, with path, ids, parent and summary."""
    cut = cut_sections(docs, key, title_col, text_col)
    cut = cut.withColumn("blank", F.length("body") == 0).withColumn(
        "parent_summary", parent_summary(F.col("body"))
    )
    return heading_tree(cut, key)
