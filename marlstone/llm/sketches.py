"""Document fingerprints: sketches that keep every shingle hash below a fixed fraction."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.text import mix, pieces, plain_text, text_batches

_BASE = 0x9E3779B97F4A7C15
_FULL = 1 << 64


@dataclass(frozen=True)
class Sketch:
    """``shingle`` code points to a shingle; hashes below ``fraction`` stay, and the ``least`` smallest.

    The smallest ones serve short texts, which may have no hash below the fraction. A union of
    sketches, cut down by the same rule, is the sketch of the union.
    """

    shingle: int = 12
    fraction: float = 1 / 32
    least: int = 16

    @property
    def bar(self) -> int:
        return int(self.fraction * _FULL)


def _gram_hashes(codes: np.ndarray, width: int) -> np.ndarray:
    """Hash of the ``width`` codes from each place on, by doubling the width of known sums."""
    with np.errstate(over="ignore"):
        total, done, block, size = None, 0, codes, 1
        while True:
            if width & size:
                if total is None:
                    total, done = block, size
                else:
                    n = len(codes) - done - size + 1
                    total = block[:n] * np.uint64(pow(_BASE, done, _FULL)) + total[size : size + n]
                    done += size
            if size * 2 > width:
                return mix(total)
            block = block[:-size] * np.uint64(pow(_BASE, size, _FULL)) + block[size:]
            size *= 2


def _cut(hashes: np.ndarray, rule: Sketch) -> np.ndarray:
    """Sorted distinct hashes that the rule keeps."""
    hashes = np.unique(hashes)
    return hashes[: max(int(np.searchsorted(hashes, np.uint64(rule.bar))), rule.least)]


def sketch_texts(texts: list[str], rule: Sketch) -> list[np.ndarray]:
    """The sketch of each text: sorted hashes. A text shorter than a shingle is one shingle."""
    width = rule.shingle
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.concatenate(([0], np.cumsum(sizes)))
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.uint64)
    grams = _gram_hashes(codes, width) if len(codes) >= width else np.empty(0, np.uint64)
    low = np.flatnonzero(grams < np.uint64(rule.bar))
    owner = np.searchsorted(starts, low, side="right") - 1
    inside = low + width <= starts[owner + 1]
    low, owner = low[inside], owner[inside]
    order = np.lexsort((grams[low], owner))
    values, bounds = grams[low][order], np.searchsorted(owner, np.arange(len(texts) + 1))
    out = []
    for i, size in enumerate(sizes.tolist()):
        kept = np.unique(values[bounds[i] : bounds[i + 1]])
        if len(kept) < rule.least and size:
            if size >= width:
                kept = _cut(grams[starts[i] : starts[i + 1] - width + 1], rule)
            else:
                own = codes[starts[i] : starts[i + 1]]
                kept = _gram_hashes(own, size)
        out.append(kept)
    return out


def merge(a: np.ndarray, b: np.ndarray, rule: Sketch) -> np.ndarray:
    """The sketch of both documents' shingles together."""
    return _cut(np.concatenate((a, b)), rule)


def _reach(sketch: np.ndarray, rule: Sketch) -> int:
    """Every hash of the document below this one is in the sketch."""
    if len(sketch) < rule.least:
        return _FULL
    return max(rule.bar, int(sketch[-1]) + 1)


def likeness(a: np.ndarray, b: np.ndarray, rule: Sketch) -> float:
    """Estimated share of the smaller document's shingles that the other one has too.

    Only hashes that both sketches would have kept are compared. Two empty sketches are alike;
    sketches without hashes to compare are not.
    """
    if len(a) == len(b) and (a == b).all():
        return 1.0
    reach = min(_reach(a, rule), _reach(b, rule))
    if reach < _FULL:
        a, b = (x[: np.searchsorted(x, np.uint64(reach))] for x in (a, b))
    smaller = min(len(a), len(b))
    return len(np.intersect1d(a, b, assume_unique=True)) / smaller if smaller else 0.0


def to_text(sketch: np.ndarray) -> str:
    return base64.b64encode(sketch.astype(">u8").tobytes()).decode()


def from_text(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), ">u8").astype(np.uint64)


def fingerprints(docs: DataFrame, rule: Sketch | None = None) -> DataFrame:
    """``doc_id, n_chars, fingerprint`` of each row's whole text; no shuffle.

    Null and empty texts have the empty fingerprint. Repeated rows stay. Other columns are ignored.
    """
    rule = rule or Sketch()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_batches(batches):
            values = texts.to_pylist()
            prints = [to_text(s) for s in sketch_texts(values, rule)]
            chars = pa.array([len(t) for t in values], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), chars, pa.array(prints, pa.string())], ["doc_id", "n_chars", "fingerprint"])

    rows = docs.select("doc_id", plain_text().alias("text"))
    return rows.mapInArrow(run, f"doc_id {_kind(rows)}, n_chars long, fingerprint string")


def _kind(rows: DataFrame) -> str:
    return rows.schema["doc_id"].dataType.simpleString()


def edited(text: str, following: str) -> str:
    """The last third of the code points replaced by the first as many of the following text."""
    gone = len(text) // 3
    return text[: len(text) - gone] + following[:gone]


def in_turn(docs: DataFrame) -> DataFrame:
    """Rows by descending ``doc_id``, cut into ranges, each with a copy of the next range's first rows.

    Range limits are ids of the table, so a range begins with a row that is known beforehand, and
    each text moves once. After the last range comes the first row again. Equal ids are ordered by
    text, null ids come last.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), plain_text().alias("text"))
    n = pieces(docs)
    shares = [i / n for i in range(1, n)] or [0.5]
    top, limits = rows.agg(F.max("doc_id"), F.percentile_approx("doc_id", shares, 100 * n)).first()
    limits = sorted(set(limits or ()) - {top}, reverse=True)
    # Ascending, so that a search counts the limits at or above an id.
    upward = np.array(limits[::-1], np.int64)

    @F.pandas_udf("array<struct<part:int,copy:boolean>>")
    def places(ids):
        known = ids.notna().to_numpy()
        values = ids.fillna(0).astype("int64").to_numpy()
        at = len(upward) - np.searchsorted(upward, values)
        at = np.where(known, at, len(upward))
        first = known & (np.isin(values, upward) | (values == top))
        before = np.where(values == top, len(upward), at - 1)
        return ids.__class__(
            [
                [{"part": int(p), "copy": False}] + ([{"part": int(b), "copy": True}] if f else [])
                for p, b, f in zip(at, before, first, strict=True)
            ]
        )

    dealt = rows.withColumn("place", F.explode(places("doc_id"))).select("place.part", "place.copy", "doc_id", "text")
    return dealt.repartition("part").sortWithinPartitions("part", "copy", F.col("doc_id").desc_nulls_last(), "text")


def edit_likeness(docs: DataFrame, rule: Sketch | None = None) -> DataFrame:
    """Fingerprints of each whole text and of its edited text, and how alike they and the next text's are.

    The next document is the one with the next smaller ``doc_id``; after the last comes the first. A
    single row is its own next one. Null and empty texts have empty fingerprints. Repeated rows
    stay and follow one another. An empty table gives an empty table.
    """
    rule = rule or Sketch()

    def rows_of(group: list[tuple]) -> pa.RecordBatch:
        """``group``: rows in turn, the last one only as the next of the one before it."""
        texts = [t for _, _, _, t in group]
        new = [edited(a, b) for a, b in zip(texts, texts[1:], strict=False)]
        both = sketch_texts(texts + new, rule)
        own, other = both[: len(texts)], both[len(texts) :]
        keep = [i for i in range(len(new)) if group[i][0] == group[i + 1][0] and not group[i][1]]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([group[i][2] for i in keep], pa.int64()),
                pa.array([len(texts[i]) for i in keep], pa.int64()),
                pa.array([hashlib.sha256(new[i].encode()).hexdigest() for i in keep], pa.string()),
                pa.array([to_text(own[i]) for i in keep], pa.string()),
                pa.array([to_text(other[i]) for i in keep], pa.string()),
                pa.array([likeness(own[i], other[i], rule) for i in keep], pa.float64()),
                pa.array([likeness(own[i], own[i + 1], rule) for i in keep], pa.float64()),
            ],
            ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        first: tuple | None = None  # of the part at hand
        for batch, texts in text_batches(batches):
            rows = list(zip(*(batch.column(c).to_pylist() for c in ("part", "copy", "doc_id")), texts.to_pylist(), strict=True))
            group = [held] if held else []
            for row in rows:
                if first is None or first[0] != row[0]:
                    if group and not group[-1][1]:
                        group.append((*first[:1], True, *first[2:]))
                    first = row
                group.append(row)
            if group:
                yield rows_of(group)
                held = group[-1]
        if held and not held[1]:
            yield rows_of([held, (*first[:1], True, *first[2:])])

    return in_turn(docs).mapInArrow(
        run,
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double",
    )
