"""Images in Markdown: where each is used, the text around it, and rewritten links.

Everything happens inside the document's row; documents without an image link are untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.config import IngestSettings
from marlstone.functions.text import strip
from marlstone.operators.sections import FENCE_LINE

# Image link, image heading and fence forms; file types counted as images.
IMAGE = r"!\[(.*?)\]\((.*?)\)"
TITLE_LINE = r"(?U)^\s{0,3}(#{1,6})\s+(.+?)\s*$"
FENCE = r"(?U)^\s*```"
IMAGE_SUFFIXES = (".png", ".jpg", ".jpeg", ".gif", ".bmp", ".svg", ".webp")
NO_SUMMARY = "No summary available"
_EDGE = "\x00"


def is_image_name(name: Column) -> Column:
    return name.rlike(r"(?:" + "|".join(s.replace(".", r"\.") for s in IMAGE_SUFFIXES) + r")\z")


def _paragraphs(lines: Column) -> Column:
    """Runs of lines between blank or image lines."""
    marked = F.transform(
        lines, lambda t: F.when((F.length(strip(t)) == 0) | t.rlike(IMAGE), F.lit(_EDGE)).otherwise(t)
    )
    pieces = F.split(F.array_join(marked, "\n"), _EDGE)
    trimmed = F.transform(pieces, lambda p: F.regexp_replace(p, r"\A\n|\n\z", ""))
    return F.filter(trimmed, lambda p: F.length(p) > 0)


def _nearest(paragraphs: Column, budget: int) -> Column:
    """Leading paragraphs until the budget is reached; the last one may pass it."""
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(0).alias("used"))
    return F.aggregate(
        paragraphs,
        start,
        lambda acc, p: F.when(
            (F.size(acc["kept"]) == 0) | (acc["used"] < budget),
            F.struct(F.array_append(acc["kept"], p).alias("kept"), (acc["used"] + F.length(p)).alias("used")),
        ).otherwise(acc),
        lambda acc: acc["kept"],
    )


def image_contexts(
    docs: DataFrame, images: DataFrame, key: str = "doc_key", settings: IngestSettings = IngestSettings()
) -> DataFrame:
    """(key, image_name, pos, above_title, above, following) for each use outside code.

    ``docs`` is (key, content); ``images`` (key, image_name) lists the files beside each
    document. Context stops at the nearest heading on either side.
    """
    budget = settings.img_content_length
    rows = docs.where(F.col("content").contains("![")).select(key, F.split("content", "\n").alias("lines"))
    at = lambda i: F.element_at("lines", i + 1)
    index = F.sequence(F.lit(0), F.size("lines") - 1)
    rows = rows.withColumn("fences", F.filter(index, lambda i: at(i).rlike(FENCE)))
    open_code = lambda i: F.size(F.filter("fences", lambda f: f <= i)) % 2 == 1
    rows = rows.withColumn("heads", F.filter(index, lambda i: at(i).rlike(TITLE_LINE) & ~open_code(i)))
    rows = rows.withColumn("uses", F.filter(index, lambda i: at(i).rlike(IMAGE) & ~open_code(i)))

    def context(i: Column) -> Column:
        above = F.array_max(F.filter("heads", lambda h: h < i))
        below = F.coalesce(F.array_min(F.filter("heads", lambda h: h > i)), F.size("lines"))
        # Without a heading above there is no context above.
        before = F.when(above.isNotNull(), F.slice("lines", above + 1, i - above)).otherwise(
            F.array().cast("array<string>")
        )
        after = F.slice("lines", i + 2, F.greatest(below - i - 1, F.lit(0)))
        title = F.when(above.isNotNull(), strip(F.regexp_extract(at(above), TITLE_LINE, 2))).otherwise("")
        return F.struct(
            i.alias("pos"),
            at(i).alias("line"),
            title.alias("above_title"),
            F.array_join(F.reverse(_nearest(F.reverse(_paragraphs(before)), budget)), "\n\n").alias("above"),
            F.array_join(_nearest(_paragraphs(after), budget), "\n\n").alias("following"),
        )

    uses = rows.select(key, F.explode(F.transform("uses", context)).alias("use")).select(key, "use.*")
    named = images.where(is_image_name(F.col("image_name")))
    link = F.concat(F.lit(r"!\[.*?\]\(.*?\Q"), F.col("image_name"), F.lit(r"\E.*?\)"))
    return uses.join(named, key).where(F.regexp(F.col("line"), link)).drop("line")


def replace_images(docs: DataFrame, images: DataFrame, key: str = "doc_key") -> DataFrame:
    """Rewrite known image links outside code to their stored address and summary.

    ``images`` is (key, image_name, url, summary); links are matched by file name, a
    missing summary keeps the old text, and unknown links stay.
    """
    known = images.where(F.col("url").isNotNull() & (F.col("url") != "")).groupBy(key).agg(
        F.map_from_entries(F.array_sort(F.collect_set(F.struct("image_name", F.struct("url", "summary"))))).alias("known")
    )
    joined = docs.join(known, key, "left")

    def rewrite(link: Column) -> Column:
        alt, url = (F.regexp_extract(link, IMAGE, g) for g in (1, 2))
        hit = F.try_element_at("known", F.regexp_extract(url, "([^/]+)/*$", 1))
        new = F.concat(F.lit("!["), F.coalesce(hit["summary"], alt), F.lit("]("), hit["url"], F.lit(")"))
        return F.when(hit.isNotNull(), new).otherwise(link)

    def outside(part: Column) -> Column:
        links = F.regexp_extract_all(part, F.lit(IMAGE), F.lit(0))
        between = F.split(part, IMAGE)
        woven = F.zip_with(
            between, F.transform(links, rewrite), lambda text, link: F.concat(text, F.coalesce(link, F.lit("")))
        )
        return F.array_join(woven, "")

    parts = F.split(F.concat(F.lit("\n"), F.col("content")), FENCE_LINE)
    rewritten = F.array_join(F.transform(parts, lambda p, i: F.when(i % 2 == 0, outside(p)).otherwise(p)), "")
    content = F.when(
        F.col("known").isNotNull() & F.col("content").contains("!["), F.substring(rewritten, 2, 2**31 - 1)
    ).otherwise(F.col("content"))
    return joined.withColumn("content", content).drop("known")
