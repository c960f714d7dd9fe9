"""Content-derived identities. Formats are fixed values shared with stored data."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marlstone.functions.text import casefold, normalize_name, present, strip

# Separators hashed between fields and after each chunk.
UNIT = "\x1f"
RECORD = "\x1e"


def sha256_hex(col: Column) -> Column:
    return F.sha2(col.cast("binary"), 256)


def source_hash(content: Column) -> Column:
    """SHA-256 of the stored bytes."""
    return F.sha2(content, 256)


def content_hash(ordered_contents: Column) -> Column:
    """SHA-256 over chunk contents in order, each followed by a record separator."""
    ended = F.transform(
        ordered_contents, lambda text: F.concat(F.coalesce(text, F.lit("")), F.lit(RECORD))
    )
    return sha256_hex(F.array_join(ended, ""))


def version_id(source: Column, content: Column | None = None) -> Column:
    seed = F.nullif(source, F.lit(""))
    if content is not None:
        seed = F.coalesce(seed, content)
    return F.concat(F.lit("ver_"), F.substring(seed, 1, 24))


def doc_id(version: Column, content: Column) -> Column:
    digest = sha256_hex(F.concat(version, F.lit(UNIT), content))
    return F.concat(F.lit("doc_"), F.substring(digest, 1, 24))


def logical_id(title: Column, content: Column, explicit: Column | None = None) -> Column:
    """Struct(id, source): explicit id first, then canonical title, then content hash."""
    key = normalize_name(title)
    given = strip(F.coalesce(explicit if explicit is not None else F.lit(""), F.lit("")))
    seed = (
        F.when(present(given), F.concat(F.lit("explicit:"), casefold(given)))
        .when(present(key), F.concat(F.lit("title:"), key))
        .otherwise(F.concat(F.lit("content:"), F.coalesce(content, F.lit(""))))
    )
    source = (
        F.when(present(given), F.lit("user_provided"))
        .when(present(key), F.lit("canonical_title"))
        .otherwise(F.lit("content_hash_fallback"))
    )
    hashed = F.concat(F.lit("ldoc_"), F.substring(sha256_hex(seed), 1, 24))
    ready = F.when(given.rlike(r"\Aldoc_[0-9a-f]{24}\z"), given).otherwise(hashed)
    return F.struct(ready.alias("logical_document_id"), source.alias("logical_id_source"))


def section_id(owner: Column, path: Column) -> Column:
    """24 hex digits of owner and section path; the owner is a file title, later a doc id."""
    return F.substring(sha256_hex(F.concat(owner, F.lit(UNIT), path)), 1, 24)


def chunk_id(
    version: Column, doc: Column, section: Column, index: Column, content: Column
) -> Column:
    """Stable positive 63-bit key of a chunk."""
    blank = F.lit("")
    fields = [
        F.coalesce(version, blank),
        F.coalesce(doc, blank),
        F.coalesce(section, blank),
        F.coalesce(index.cast("string"), blank),
        F.coalesce(F.substring(content, 1, 200), blank),
    ]
    return low63(sha256_hex(F.concat_ws(UNIT, *fields)))


def multiset_digest(*parts: Column) -> Column:
    """Aggregate: digest of a group's rows whatever their order, repeated rows counted.

    Number, sums and exclusive ors of two 64-bit hashes are combined before the shuffle, so a group's
    rows never meet.
    """
    halves = [F.xxhash64(F.lit(i), *parts) for i in range(2)]
    sums = [F.sum(h.cast("decimal(38,0)")) for h in halves]
    return sha256_hex(F.concat_ws(",", F.count(F.lit(1)), *sums, *[F.bit_xor(h) for h in halves]))


def low63(digest: Column) -> Column:
    """First eight bytes of a hex digest as a big-endian integer without its top bit."""
    top = F.conv(F.substring(digest, 1, 1), 16, 10).cast("long").bitwiseAND(F.lit(7))
    rest = F.conv(F.substring(digest, 2, 15), 16, 10).cast("long")
    return F.shiftleft(top, 60).bitwiseOR(rest)


def formula_id(raw: Column) -> Column:
    return F.substring(F.sha1(raw.cast("binary")), 1, 16)
