"""Term counts of whole texts, computed where the text is scanned.

One Arrow pass per partition turns each text into its length in terms and a compact
list of (token, tf). Counting inside the row pre-aggregates before any shuffle.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

_WORD = re.compile(r"[^\W_]+")
# The Han ranges that get single characters and bigrams.
_HAN = re.compile(r"[㐀-䶿一-鿿]+")

TERMS = T.ArrayType(
    T.StructType([T.StructField("token", T.StringType()), T.StructField("tf", T.IntegerType())])
)


def tokenize(text: str | None) -> list[str]:
    """Lower-case letter/number runs; Han runs become single characters plus bigrams."""
    tokens: list[str] = []
    for word in _WORD.findall((text or "").lower()):
        if word.isascii() or not _HAN.search(word):
            tokens.append(word)
            continue
        cursor = 0
        for run in _HAN.finditer(word):
            if run.start() > cursor:
                tokens.append(word[cursor : run.start()])
            han = run.group()
            tokens.extend(han)
            tokens.extend(han[i : i + 2] for i in range(len(han) - 1))
            cursor = run.end()
        if cursor < len(word):
            tokens.append(word[cursor:])
    return tokens


def list_array(rows: Iterable[dict], key_type: pa.DataType, value_type: pa.DataType, names):
    """A list<struct<key, value>> Arrow column from one dict per row."""
    offsets, keys, values = [0], [], []
    for row in rows:
        keys.extend(row.keys())
        values.extend(row.values())
        offsets.append(len(keys))
    entries = pa.StructArray.from_arrays(
        [pa.array(keys, key_type), pa.array(values, value_type)], list(names)
    )
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), entries)


def with_terms(
    df: DataFrame, text_col: str, keys: list[str], vocabulary: frozenset[str] | None = None
) -> DataFrame:
    """``keys`` plus ``dl`` (terms in the text) and ``terms`` (token counts).

    With a vocabulary only its tokens are kept; ``dl`` always counts the whole text.
    """
    source = df.select(*keys, text_col)
    schema = T.StructType(
        [source.schema[k] for k in keys]
        + [T.StructField("dl", T.LongType()), T.StructField("terms", TERMS)]
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, rows = [], []
            for text in batch.column(len(keys)).to_pylist():
                tokens = tokenize(text)
                lengths.append(len(tokens))
                if vocabulary is not None:
                    tokens = [token for token in tokens if token in vocabulary]
                rows.append(Counter(tokens))
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in range(len(keys))]
                + [
                    pa.array(lengths, pa.int64()),
                    list_array(rows, pa.string(), pa.int32(), ("token", "tf")),
                ],
                names=[*keys, "dl", "terms"],
            )

    return source.mapInArrow(count, schema)
