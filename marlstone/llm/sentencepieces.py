"""SentencePiece encoding and decoding: Viterbi over a trie of distinct marked words."""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.text import parts, plain_text
from marlstone.llm.token_counts import cuts_at_spaces, segments

_SPACE = "▁"
# What an unknown character costs below the worst piece.
_PENALTY = 10.0


class Vocabulary:
    """Pieces and scores of a SentencePiece model, read as a unigram table.

    Encoding finds the segmentation with the largest sum of scores. A model file of another kind
    (BPE scores are minus the rank of the merge) is read the same way; the library does so too once
    the file says unigram. Texts must not need normalization.
    """

    def __init__(self, blob: bytes):
        model = sentencepiece.SentencePieceProcessor(model_proto=blob)
        if not cuts_at_spaces(model):
            raise ValueError("pieces of this vocabulary go over spaces")
        size = model.get_piece_size()
        self.unknown = model.unk_id()
        self.trie: dict = {}
        self.bytes = [-1] * 256
        self.plain = []
        low = 0.0
        for i in range(size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
                self.plain.append(bytes([int(piece[3:5], 16)]))
            elif model.is_unknown(i):
                self.plain.append(" ⁇ ".encode())
            elif model.is_control(i) or model.is_unused(i):
                self.plain.append(b"")
            else:
                node = self.trie
                for c in piece:
                    node = node.setdefault(c, {})
                score = model.get_score(i)
                node[""] = (i, score)
                low = min(low, score)
                self.plain.append(piece.replace(_SPACE, " ").encode())
        self.cost = low - _PENALTY
        self.fallback = min(self.bytes) >= 0
        self.text = pa.array(self.plain, pa.binary())

    def spelled(self, character: str) -> list[int]:
        """Ids of an unknown character: its bytes, or the unknown piece."""
        return [self.bytes[b] for b in character.encode()] if self.fallback else [self.unknown]

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of sorted distinct words one after the other, and where each word's begin.

        The sorted words are the paths of a trie in depth-first order. For each character of the
        path there is the best score up to it, the piece that ends there, and the pieces that are
        under way; a word goes on from what it shares with the word before it.
        """
        trie, cost = self.trie, self.cost
        best, start, piece, ways = [0.0], [0], [0], [()]
        ids: list[int] = []
        ends = [0]
        before = ""
        for word in words:
            shared, most = 0, min(len(before), len(word))
            if word.startswith(before):
                shared = most
            else:
                while shared < most and before[shared] == word[shared]:
                    shared += 1
            del best[shared + 1 :], start[shared + 1 :], piece[shared + 1 :], ways[shared + 1 :]
            for at in range(shared, len(word)):
                c = word[at]
                top, origin, winner = -1e300, at, -1
                onward = []
                for node, begin in ways[at]:
                    child = node.get(c)
                    if child is not None:
                        onward.append((child, begin))
                        found = child.get("")
                        if found is not None:
                            score = best[begin] + found[1]
                            if score > top:
                                top, origin, winner = score, begin, found[0]
                child = trie.get(c)
                found = None
                if child is not None:
                    onward.append((child, at))
                    found = child.get("")
                score = best[at] + (cost if found is None else found[1])
                if score > top:
                    top, origin, winner = score, at, -1 if found is None else found[0]
                best.append(top)
                start.append(origin)
                piece.append(winner)
                ways.append(onward)
            at, own = len(word), []
            while at:
                if piece[at] < 0:
                    own.extend(reversed(self.spelled(word[at - 1])))
                else:
                    own.append(piece[at])
                at = start[at]
            own.reverse()
            ids += own
            ends.append(len(ids))
            before = word
        return np.array(ids, np.int32), np.array(ends, np.int64)

    def encode(self, texts: pa.Array) -> pa.Array:
        """A list of ids for each text."""
        flat, offsets = segments(texts)
        coded = pc.dictionary_encode(flat)
        marked = pc.replace_substring(pc.binary_join_element_wise(_SPACE, coded.dictionary, ""), " ", _SPACE)
        order = pc.sort_indices(marked).to_numpy()
        words = marked.take(pa.array(order)).to_pylist()
        ids, ends = self.encode_words(words)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        which = place[coded.indices.to_numpy(zero_copy_only=False)]
        lengths, first = np.diff(ends)[which], ends[:-1][which]
        # The one segment of an empty text is no word.
        lengths = np.where(np.repeat(pc.binary_length(texts).to_numpy(zero_copy_only=False) == 0, np.diff(offsets)), 0, lengths)
        total = np.concatenate(([0], np.cumsum(lengths)))
        take = np.repeat(first - total[:-1], lengths) + np.arange(total[-1])
        return pa.LargeListArray.from_arrays(pa.array(total[offsets]), pa.array(ids[take] if len(take) else np.empty(0, np.int32))).cast(
            pa.list_(pa.int32())
        )

    def decode(self, lists: pa.Array) -> pa.Array:
        """The text of each list of ids: pieces joined, byte pieces as bytes, one space before the first word dropped.

        Ids outside the vocabulary are the unknown piece. Bytes that aren't UTF-8 become U+FFFD.
        """
        ids = lists.flatten().to_numpy(zero_copy_only=False)
        offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        ids = np.where((ids >= 0) & (ids < len(self.plain)), ids, self.unknown)
        sizes = np.array([len(p) for p in self.plain], np.int64)[ids]
        ends = np.concatenate(([0], np.cumsum(sizes)))[offsets]
        pieces = self.text.take(pa.array(ids)).buffers()[2]
        joined = pieces.to_pybytes() if pieces is not None else b""
        return pa.array(
            [(joined[a + 1 : b] if joined[a : a + 1] == b" " else joined[a:b]).decode("utf-8", "replace") for a, b in zip(ends[:-1], ends[1:], strict=True)],
            pa.string(),
        )


_made: dict[bytes, Vocabulary] = {}


def _vocabulary(blob: bytes) -> Vocabulary:
    """The vocabulary, built once in each Python worker."""
    if blob not in _made:
        _made.clear()
        _made[blob] = Vocabulary(blob)
    return _made[blob]


def _fields(df: DataFrame, columns: list[str]) -> str:
    return "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.select(*columns).schema)


def encode(docs: DataFrame, vocabulary: str, keep: list[str]) -> DataFrame:
    """The columns of ``keep`` and ``ids``, the pieces of each row's whole ``text``; no shuffle.

    ``vocabulary`` is the path of a SentencePiece model that the driver can read. Each Arrow batch is
    cut into words with their space mark; distinct words are encoded once, in order, sharing scores
    along common prefixes. Null and empty texts have no ids. Repeated rows stay. Other columns than
    those to keep are ignored, ``ids`` may not be among them. An empty table gives an empty table.
    """
    blob = Path(vocabulary).read_bytes()
    Vocabulary(blob)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _vocabulary(blob)
        for batch in batches:
            for part in parts(batch, pc.binary_length(batch.column("__text")).to_numpy(zero_copy_only=False)):
                ids = known.encode(part.column("__text").cast(pa.string()))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], ids], [*keep, "ids"])

    rows = docs.select(*keep, plain_text().alias("__text"))
    return rows.mapInArrow(run, f"{_fields(docs, keep)}ids array<int>")


def decode(rows: DataFrame, vocabulary: str, keep: list[str]) -> DataFrame:
    """The columns of ``keep`` and ``decoded``, the text of each row's ``ids``; no shuffle.

    Null lists and empty ones give the empty text. Texts come back as they were, but for U+2581,
    which comes back as a space.
    """
    blob = Path(vocabulary).read_bytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _vocabulary(blob)
        for batch in batches:
            for part in parts(batch, 4 * pc.list_value_length(batch.column("__ids")).to_numpy(zero_copy_only=False)):
                text = known.decode(part.column("__ids").cast(pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], text], [*keep, "decoded"])

    filled = F.coalesce("ids", F.array().cast("array<int>")).alias("__ids")
    return rows.select(*keep, filled).mapInArrow(run, f"{_fields(rows, keep)}decoded string")
