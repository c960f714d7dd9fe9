"""Token counts of whole texts by a public SentencePiece vocabulary."""

from __future__ import annotations

import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.text import plain_text, text_batches

# One call of the library gets about this many bytes.
CALL_BYTES = 1 << 20
_SPACE = "▁"
# Texts in which some space isn't a boundary; they are cut by the pattern below, one by one.
_UNEVEN = f"^ | $|  |{_SPACE}"
_BOUNDARY = re.compile(f"(?<=[^ {_SPACE}]) (?=[^ {_SPACE}])")


def cuts_at_spaces(model: sentencepiece.SentencePieceProcessor) -> bool:
    """True when no piece goes on over a space, so that text may be cut before any single space."""
    size = model.get_piece_size()
    return not any(_SPACE in model.id_to_piece(i).lstrip(_SPACE) for i in range(size)) and (
        model.encode("a a", out_type=str) == 2 * model.encode("a", out_type=str)
    )


def segments(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Cut texts before single spaces. A cut drops its space, as the library puts one before each segment."""
    uneven = pc.match_substring_regex(texts, _UNEVEN).to_numpy(zero_copy_only=False)
    lists = pc.split_pattern(texts, " ")
    if not uneven.any():
        return lists.flatten(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
    cut = [_BOUNDARY.split(t.as_py()) if odd else None for t, odd in zip(texts, uneven, strict=True)]
    own = pa.array([x or [] for x in cut], pa.list_(pa.string()))
    both = pa.chunked_array([lists, own]).combine_chunks()
    picked = both.take(pa.array(np.arange(len(texts)) + len(texts) * uneven))
    return picked.flatten(), picked.offsets.to_numpy() - picked.offsets[0].as_py()


def lengths(model: sentencepiece.SentencePieceProcessor, texts: pa.Array) -> np.ndarray:
    """Token counts of texts, encoded in calls of about equal bytes; equal texts are encoded once."""
    coded = pc.dictionary_encode(texts)
    size = np.cumsum(pc.binary_length(coded.dictionary).to_numpy(zero_copy_only=False) + 1)
    ends = np.searchsorted(size, np.arange(CALL_BYTES, (size[-1] if len(size) else 0) + CALL_BYTES, CALL_BYTES))
    counts, at = [], 0
    for end in dict.fromkeys(np.minimum(ends + 1, len(size)).tolist()):
        part = coded.dictionary.slice(at, end - at).to_pylist()
        counts += [len(x) for x in model.encode(part, num_threads=1)]
        at = end
    return np.array(counts, np.int64)[coded.indices.to_numpy(zero_copy_only=False)]


def token_counts(docs: DataFrame, vocabulary: str) -> DataFrame:
    """``n_bytes`` (UTF-8) and ``n_tokens`` for each row's whole text, beside its ``doc_id``.

    ``vocabulary`` is the path of a SentencePiece model that the driver can read; its bytes go
    to the tasks. Each Arrow batch is cut into segments at places that no piece crosses, distinct
    segments are encoded in calls of equal bytes, and only lengths come back. A text of any length
    is a list of short segments. No begin, end or special tokens are added; special strings in a
    text are ordinary text, as the library does it.

    Null and empty texts have 0 tokens. Repeated rows and null ids stay, one result row for each
    row. Other columns are ignored. An empty table gives an empty table.
    """
    blob = Path(vocabulary).read_bytes()
    by_space = cuts_at_spaces(sentencepiece.SentencePieceProcessor(model_proto=blob))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sentencepiece.SentencePieceProcessor(model_proto=blob)
        for batch, texts in text_batches(batches):
            if by_space:
                parts, offsets = segments(texts)
                sums = np.concatenate(([0], np.cumsum(lengths(model, parts))))
                tokens = sums[offsets[1:]] - sums[offsets[:-1]]
            else:
                tokens = lengths(model, texts)
            size = pc.binary_length(texts).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), size, pa.array(tokens)], ["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select("doc_id", plain_text().alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long")


def over_limit(counts: DataFrame, limit: int) -> DataFrame:
    """Mark rows with more than ``limit`` tokens."""
    return counts.withColumn("over_limit", F.col("n_tokens") > limit)
