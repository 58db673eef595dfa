"""Encoding of a corpus with a byte-level BPE vocabulary.

The distinct words of a batch are sorted, which is the depth-first order of
their trie. For each prefix the last token of its encoding is enough: the
encoding of a prefix ends with the one token that fits the encoding before it.
A word goes on from the deepest prefix it shares with the word before, so each
shared prefix is computed once.

Defined cases: null and empty text give an empty list of ids; strings of special
tokens in a text are ordinary text; texts of any length are encoded whole.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words whose ids a task keeps between batches; the store is emptied when full.
KEPT_WORDS = 200_000
#: A word longer than this many bytes is encoded but not kept.
KEPT_BYTES = 256
#: Pairs of tokens whose meeting a task remembers; emptied when full.
KEPT_PAIRS = 1_000_000
DEFAULT_VOCABULARY = "byte_bpe_50k.tiktoken"


def vocabulary_path(name: str = DEFAULT_VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def word_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


@dataclass(frozen=True)
class Vocabulary:
    """Tokens in the order of their ranks and the two tokens each was merged from."""

    tokens: list[bytes]
    ids: np.ndarray
    left: np.ndarray
    right: np.ndarray
    pattern: str


def _parts(token: bytes, ranks: dict[bytes, int], limit: int) -> list[bytes]:
    """``token`` merged as far as tokens ranked below ``limit`` allow."""
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 1:
        best, at = limit, -1
        for i in range(len(parts) - 1):
            rank = ranks.get(parts[i] + parts[i + 1], limit)
            if rank < best:
                best, at = rank, i
        if at < 0:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


def read_vocabulary(path: str, pattern: str) -> Vocabulary:
    """Ranks of a file of base64 tokens, one with its id per line."""
    rows = [line.split() for line in Path(path).read_bytes().splitlines() if line]
    pairs = sorted((int(rank), base64.b64decode(token)) for token, rank in rows)
    tokens = [t for _, t in pairs]
    ranks = {t: i for i, t in enumerate(tokens)}
    left, right = np.arange(len(tokens), dtype=np.int32), np.arange(len(tokens), dtype=np.int32)
    for i, token in enumerate(tokens):
        if len(token) > 1:
            parts = _parts(token, ranks, i)
            if len(parts) == 2:
                left[i], right[i] = ranks[parts[0]], ranks[parts[1]]
            else:
                left[i] = right[i] = -1  # no merge gives it, so it never comes out
    return Vocabulary(tokens, np.array([i for i, _ in pairs], dtype=np.int32), left, right, pattern)


class TrieEncoder:
    """Encodes sets of words, sharing the work on common prefixes."""

    def __init__(self, vocabulary: Vocabulary):
        self._left, self._right = vocabulary.left.tolist(), vocabulary.right.tolist()
        self._rank = {t: i for i, t in enumerate(vocabulary.tokens) if self._left[i] >= 0}
        self._length = [len(t) for t in vocabulary.tokens]
        self._merged = {(a, b): i for i, (a, b) in enumerate(zip(self._left, self._right)) if a >= 0 and len(vocabulary.tokens[i]) > 1}
        self._id = vocabulary.ids
        self._find = regex.compile(vocabulary.pattern).findall
        by_end: dict[bytes, set[int]] = {}
        for t in self._rank:
            by_end.setdefault(t[-2:], set()).add(len(t))
        #: Lengths of the tokens that end in two given bytes, longest first.
        self._lengths = {end: sorted(x, reverse=True) for end, x in by_end.items()}
        self._fits: dict[tuple[int, int], bool] = {}
        self._kept: dict[str, np.ndarray] = {}

    def _fit(self, one: int, two: int) -> bool:
        """Whether merging keeps ``one`` and ``two`` apart where they meet.

        Both are undone merge by merge, latest first; they stay apart unless two
        parts that meet would have been merged before the merges undone so far.
        """
        key = (one, two)
        known = self._fits.get(key)
        if known is None:
            known, bound = True, len(self._length)
            while True:
                joined = self._merged.get((one, two))
                if joined is not None and joined < bound:
                    known = False
                    break
                inner_one, inner_two = self._right[one] != one, self._left[two] != two
                if inner_one and (one > two or not inner_two):
                    bound, one = one, self._right[one]
                elif inner_two:
                    bound, two = two + 1, self._left[two]
                else:
                    break
            if len(self._fits) >= KEPT_PAIRS:
                self._fits.clear()
            self._fits[key] = known
        return known

    def _encode_sorted(self, words: Iterable[tuple[bytes, str]]) -> dict[str, np.ndarray]:
        """Depth-first over the trie of ``words``, which come in byte order."""
        out: dict[str, np.ndarray] = {}
        last: list[int] = [-1]  # of each prefix of the current word, its last token
        before = b""
        rank, lengths, length = self._rank, self._lengths, self._length
        for word, name in words:
            shared = 0
            for a, b in zip(word, before):
                if a != b:
                    break
                shared += 1
            del last[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                ending = word[max(0, end - 2) : end]
                found = -1
                tried = lengths.get(ending, [1]) if end > 1 else [1]
                for size in tried if tried[-1] == 1 else [*tried, 1]:
                    if size > end:
                        continue
                    token = rank.get(word[end - size : end])
                    if token is not None and (size == end or self._fit(last[end - size], token)):
                        found = token
                        break
                last.append(found)
            ids, at = [], len(word)
            while at:
                ids.append(last[at])
                at -= length[last[at]]
            out[name] = self._id[ids[::-1]]
            before = word
        return out

    def encode_batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and the offsets of each text."""
        split = [self._find(t) if t else [] for t in texts]
        kept = self._kept
        new = {w for words in split for w in words if w not in kept}
        if len(kept) + len(new) > KEPT_WORDS:
            kept.clear()
            new = {w for words in split for w in words}
        fresh = self._encode_sorted(sorted((w.encode("utf-8"), w) for w in new))
        kept.update((w, ids) for w, ids in fresh.items() if len(w) <= KEPT_BYTES // 4)
        pieces = [fresh[w] if w in fresh else kept[w] for words in split for w in words]
        sizes = np.fromiter((len(p) for p in pieces), dtype=np.int64, count=len(pieces))
        ends = np.concatenate([[0], np.cumsum(sizes)])
        words_before = np.concatenate([[0], np.cumsum([len(words) for words in split], dtype=np.int64)])
        flat = np.concatenate(pieces) if pieces else np.empty(0, dtype=np.int32)
        return flat.astype(np.int32, copy=False), ends[words_before]


#: The vocabulary last used by this process and its encoder.
_LAST: list = []


def _shared_vocabulary(df: DataFrame, path: str | None, pattern: str | None):
    """The vocabulary, read on the driver; its size is that of the file, not of the data."""
    return df.sparkSession.sparkContext.broadcast(read_vocabulary(path or vocabulary_path(), pattern or word_pattern()))


def _encoder(shared) -> TrieEncoder:
    vocabulary = shared.value
    if not _LAST or _LAST[0] is not vocabulary:
        _LAST[:] = [vocabulary, TrieEncoder(vocabulary)]
    return _LAST[1]


def encode(df: DataFrame, row_id: str, text: str, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``row_id`` and ``ids``, the token ids of ``text``."""
    shared = _shared_vocabulary(df, path, pattern)
    rows = df.select(F.col(row_id).alias("row_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared)
        for batch in batches:
            flat, offsets = encoder.encode_batch(batch.column(1).to_pylist())
            ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], ["row_id", "ids"])

    kind = rows.schema["row_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"row_id {kind}, ids array<int>").withColumnRenamed("row_id", row_id)


def token_counts(df: DataFrame, row_id: str, text: str, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``row_id`` and ``tokens``, the number of ids of ``text``; the ids stay in the task."""
    shared = _shared_vocabulary(df, path, pattern)
    rows = df.select(F.col(row_id).alias("row_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared)
        for batch in batches:
            _, offsets = encoder.encode_batch(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets), pa.int64())], ["row_id", "tokens"])

    kind = rows.schema["row_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"row_id {kind}, tokens bigint").withColumnRenamed("row_id", row_id)
