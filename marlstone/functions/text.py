"""Text expressions: folding, name keys, model codes, list fields, whitespace.

All functions take and return Columns and stay in the JVM.
"""

from __future__ import annotations

import sys
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters ignored when two document names are compared.
NAME_IGNORED = r"[\s\-_/／·•—–_.,，。:：;；()（）\[\]【】]+"
# An alphanumeric code holding a letter and a digit, parts joined by - or _.
MODEL_CODE = (
    r"(?i)(?<![a-z0-9])(?=[a-z0-9_-]*[a-z])(?=[a-z0-9_-]*\d)"
    r"[a-z0-9]+(?:[-_][a-z0-9]+)*(?![a-z0-9])"
)
# Separators of a plain-text list field.
LIST_SEPARATORS = r"[,，;；|]"
# Unicode white space as Python sees it: the Java (?U)\s set plus four control characters.
SPACE = r"(?U)[\s\x1c-\x1f]"

# Lower-case letters whose case folding is longer than one character.
_FOLD_EXPANSIONS = (
    ("ß", "ss"), ("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"),
    ("ﬅ", "st"), ("ﬆ", "st"), ("ŉ", "ʼn"),
)


@lru_cache(maxsize=1)
def _fold_pairs() -> tuple[str, str]:
    """Single characters that folding changes beyond lower-casing, from Python's own rule."""
    source, target = [], []
    for code in range(128, sys.maxunicode + 1):
        low = chr(code).lower()
        if len(low) == 1 and low == chr(code):
            folded = low.casefold()
            if folded != low and len(folded) == 1:
                source.append(low)
                target.append(folded)
    return "".join(source), "".join(target)


def casefold(col: Column) -> Column:
    """Case folding; ASCII text takes the plain lower-case path."""
    low = F.lower(col)
    folded = F.translate(low, *_fold_pairs())
    for letter, expansion in _FOLD_EXPANSIONS:
        folded = F.replace(folded, F.lit(letter), F.lit(expansion))
    return F.when(col.rlike(r"[^\x00-\x7F]"), folded).otherwise(low)


def strip(col: Column) -> Column:
    return F.regexp_replace(col, rf"{SPACE}+$|^{SPACE[4:]}+", "")


def collapse_spaces(col: Column) -> Column:
    """Every run of white space becomes one space, ends trimmed."""
    return F.trim(F.regexp_replace(col, rf"{SPACE}+", " "))


def normalize_name(col: Column) -> Column:
    """Key under which two spellings of a document name are equal."""
    ignored = rf"(?U){NAME_IGNORED[:-2]}\x1c-\x1f]+"
    return F.coalesce(F.regexp_replace(casefold(col), ignored, ""), F.lit(""))


def model_codes(col: Column) -> Column:
    """Distinct normalized model codes in order of first appearance."""
    found = F.regexp_extract_all(col, F.lit(MODEL_CODE), F.lit(0))
    cleaned = F.transform(found, lambda code: F.lower(F.regexp_replace(code, "[-_]", "")))
    return F.coalesce(F.array_distinct(cleaned), F.array().cast("array<string>"))


def unique_strings(values: Column, max_items: int | None = None) -> Column:
    """Keep the first spelling per name key (keys of at least two characters), optionally capped."""
    cleaned = F.transform(values, collapse_spaces)
    keyed = F.transform(
        F.filter(cleaned, lambda text: text.isNotNull()),
        lambda text: F.struct(text.alias("text"), normalize_name(text).alias("key")),
    )
    usable = F.filter(keyed, lambda item: F.length(item["key"]) >= 2)
    empty = F.array().cast("array<struct<text:string,key:string>>")
    kept = F.aggregate(
        usable,
        empty,
        lambda acc, item: F.when(
            F.exists(acc, lambda seen: seen["key"] == item["key"]), acc
        ).otherwise(F.array_append(acc, item)),
    )
    texts = F.transform(kept, lambda item: item["text"])
    texts = F.slice(texts, 1, max_items) if max_items is not None else texts
    return F.coalesce(texts, F.array().cast("array<string>"))


def parse_list(col: Column) -> Column:
    """A JSON array of strings, or text split on list separators, made unique.

    Valid JSON that is not an array gives an empty list; text that is not JSON is split.
    """
    empty = F.array().cast("array<string>")
    as_json = F.try_parse_json(col)
    array = F.try_variant_get(as_json, "$", "array<variant>")
    strings = F.filter(
        F.transform(
            array,
            lambda item: F.when(
                F.schema_of_variant(item) == "STRING", F.try_variant_get(item, "$", "string")
            ),
        ),
        lambda text: text.isNotNull(),
    )
    parts = F.filter(F.split(col, LIST_SEPARATORS), lambda part: F.length(strip(part)) > 0)
    chosen = (
        F.when(col.isNull() | (F.length(strip(col)) == 0), empty)
        .when(as_json.isNull(), parts)
        .otherwise(F.coalesce(strings, empty))
    )
    return unique_strings(chosen)


def present(col: Column) -> Column:
    """True for a non-null, non-empty string."""
    return F.coalesce(F.length(col) > 0, F.lit(False))


def first_present(*cols: Column) -> Column:
    """The first non-empty string, else the empty string."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols], F.lit(""))
