"""Runs of consecutive rows that hold the same line, collapsed to one event.

Whether neighbours hold one line is decided on their letters, misread ones taken
as one. Letters may be lost, but not so that another word stands there: a word
without its first letters is another one if both are frequent before the word
that follows, which a table of counts of fixed size tells (``WordCounts``); and
a contracted negation may not be lost.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator, Sequence
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..operators.scan import bucket_of, carry_in, packed_keys, stitch, with_carry
from ..session import stage

#: A row more than this after the end of the row before it opens a new run.
MAX_PAUSE_MS = 2_000
BUCKET_MS = 600_000
#: Recognition errors allowed per letter of the shorter text, and in a row.
ERROR_SHARE = 0.3
MAX_LOST = 2
#: Equal characters after which a loss is apart from the one before.
APART = 3

# Characters that recognisers take for each other; the first stands for the group.
MISREAD = (
    "lI いり っつ ゃや ゅゆ ょよ ァア ィイ ゥウ ェエ ォオ ッツ ャヤ ュユ ョヨ ヶケ ヵカ カ力 ロ口 ー一 ニ二 ハ八 エ工 タ夕 ト卜 へヘ "
    "待侍 了子 我找 们门 在左 未末 土士 日曰 己已 人入 干千 ソン シツ иниі шщ ьъ 어이 올을 률를 다디 "
)
MISREAD_PAIRS = {"rn": "m", "li": "h", "cl": "d", "vv": "w"}
MISREAD_WIDE = {one: pair for pair, one in MISREAD_PAIRS.items()}
_PAIR_LETTERS = frozenset("".join(MISREAD_PAIRS) + "".join(MISREAD_WIDE))
# Negations whose loss changes the line even where it is one character, and contracted ones.
NEGATIONS = frozenset("不 没 未 别 別 無 안 못".split())
CONTRACTED_AFTER, CONTRACTED_BEFORE = "'t", "n'"
#: Slots of the table of word counts: 4 MB.
WORD_SLOTS = 1 << 19
#: How often the rarer of two words must stand for each time of the other, for both to be words.
BOTH_WORDS = 0.1

_MARKS = regex.compile(r"\p{M}+")
_SPLIT = regex.compile(r"[^\p{L}\p{N}]+")
_BLANKS = regex.compile(r"[^\p{L}\p{N}]")
_DIGITS = regex.compile(r"\p{Nd}+")
_LETTER = regex.compile(r"\p{L}")
_WORD = regex.compile(r"[\p{L}\p{M}]+")
_SPOKEN = regex.compile(r"[\p{L}\p{M}]+(?:'[\p{L}\p{M}]+)*")


@lru_cache(maxsize=1)
def _folds() -> dict[int, str]:
    table: dict[int, str] = {}
    for group in MISREAD.split():
        first = table.get(ord(group[0]), group[0])
        joined = {ord(ch) for ch in group} | {c for c, to in table.items() if to in {table.get(ord(ch), ch) for ch in group}}
        table |= dict.fromkeys(joined, first)
    return table


class Reading(NamedTuple):
    """What of a text is compared: its numbers, letters, and where words start and end."""

    numbers: tuple[str, ...]
    letters: str
    starts: frozenset[int]
    ends: frozenset[int]
    worded: bool


@lru_cache(maxsize=100_000)
def reading(text: str) -> Reading:
    """Folded letters of a text.

    Blanks, line breaks and punctuation are gone, misread characters stand for
    their group, accents and voicing marks are off, doubled characters single.
    """
    text = unicodedata.normalize("NFKC", text)
    numbers = tuple(_DIGITS.findall(_BLANKS.sub("", text)))
    out: list[str] = []
    starts, ends = set(), set()
    for word in _SPLIT.split(text):
        if not word:
            continue
        folded = unicodedata.normalize("NFC", _MARKS.sub("", unicodedata.normalize("NFD", word)))
        folded = folded.translate(_folds()).casefold()
        starts.add(len(out))
        out += [ch for ch, before in zip(folded, "\0" + folded) if ch != before or ch.isdigit()]
        ends.add(len(out))
    return Reading(numbers, "".join(out), frozenset(starts), frozenset(ends), bool(_LETTER.search(text)))


@lru_cache(maxsize=100_000)
def apart(text: str, narrow: bool) -> Reading:
    """A reading with letters that pairs are read for taken apart, or with ``narrow`` the pairs joined."""
    found = reading(text)
    letters, moved, changed, i = found.letters, [], [], 0
    if not (any(pair in letters for pair in MISREAD_PAIRS) if narrow else any(one in letters for one in MISREAD_WIDE)):
        return found
    while i < len(letters):
        one = MISREAD_PAIRS.get(letters[i : i + 2]) if narrow and i + 1 not in found.starts else None
        moved += [len(changed)] * (2 if one else 1)
        changed += one or (letters[i] if narrow else MISREAD_WIDE.get(letters[i], letters[i]))
        i += 2 if one else 1
    moved.append(len(changed))
    return found._replace(letters="".join(changed), starts=frozenset(moved[i] for i in found.starts), ends=frozenset(moved[i] for i in found.ends))


def _loses_word(letters: str, at: int, count: int, starts: frozenset[int], ends: frozenset[int]) -> bool:
    """Whether the ``count`` letters at ``at`` are a whole word or a negation."""
    lost = letters[at : at + count]
    if at in starts and at + count in ends and (count > 1 or lost in NEGATIONS):
        return True
    return any(ch in NEGATIONS for ch in lost)


def _lost_only(a: Reading, b: Reading, budget: int) -> bool:
    """Whether a and b are equal but for up to ``budget`` lost characters on either side.

    At most ``MAX_LOST`` go missing at one place, and never on both sides of one
    place: that would be another character. Losses with fewer than ``APART``
    equal characters between them are taken together, as they may be another word.
    """
    x, y = a.letters, b.letters
    n, m = len(x), len(y)
    seen = set()
    todo = [(0, 0, budget, 0, APART, 0)]  # places, errors left, side of the last loss, equal characters since, losses taken together
    while todo:
        i, j, left, side, since, near = todo.pop()
        while i < n and j < m and x[i] == y[j]:
            i, j, since = i + 1, j + 1, since + 1
        if i == n and j == m:
            return True
        state = (i, j, left, side, min(since, APART), near)
        if state in seen:
            continue
        seen.add(state)
        for k in range(min(MAX_LOST, left), 0, -1):
            for s, words, at, text, other, to in ((1, a, i, x, y, j), (2, b, j, y, x, i)):
                if at + k > len(text) or _loses_word(text, at, k, words.starts, words.ends):
                    continue
                ends = at + k == len(text)
                if ends != (to == len(other)) or not ends and text[at + k] != other[to]:
                    continue
                together = k + near * (since < APART)
                if together > (MAX_LOST if side not in (0, s) and since < APART else MAX_LOST + 1):
                    continue
                todo.append((i + k, j, left - k, s, 0, together) if s == 1 else (i, j + k, left - k, s, 0, together))
    return False


class WordCounts:
    """How often words stand before each other in a corpus, added up in ``WORD_SLOTS`` slots by hash: as large for any corpus."""

    def __init__(self, slots: np.ndarray):
        self._slots = slots
        #: What other words add to a slot, about.
        self._noise = float(np.median(slots))

    def __getitem__(self, pair: tuple[str, str]) -> float:
        return max(0.0, float(self._slots[xxhash.xxh64_intdigest(" ".join(pair).encode("utf-8"), seed=42) % WORD_SLOTS]) - self._noise)

    def both_words(self, one: tuple[str, str], two: tuple[str, str]) -> bool:
        """Whether neither is so much rarer than the other that it may be a misreading of it."""
        few, many = sorted((self[one], self[two]))
        return few >= 2 and few >= many * BOTH_WORDS


def count_words(df: DataFrame, text: str) -> WordCounts:
    """Counts of each word of all texts with the one after it; each task hands on at most ``WORD_SLOTS`` sums."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{M}]+"), lambda w: w != "")
    rows = df.select(words.alias("w")).where("size(w) > 0")
    pairs = F.zip_with("w", F.slice("w", F.lit(2), F.size("w")), lambda w, after: F.concat(w, F.lit(" "), F.coalesce(after, F.lit(""))))
    slots = np.zeros(WORD_SLOTS, dtype=np.int64)
    for slot, n in rows.select(F.explode(pairs).alias("p")).groupBy(F.pmod(F.xxhash64("p"), F.lit(WORD_SLOTS)).alias("slot")).agg(F.count("*").alias("n")).collect():
        slots[slot] = n
    return WordCounts(slots)


def other_word(a: str, b: str, counts: WordCounts | None) -> bool:
    """Whether a word of one text is one of the other without its negation, or without its first letters and yet frequent there."""
    a, b = a.lower().replace("’", "'"), b.lower().replace("’", "'")
    if "'" in a or "'" in b:
        one, two = Counter(_SPOKEN.findall(a)), Counter(_SPOKEN.findall(b))
        for longer, shorter in ((one - two, two - one), (two - one, one - two)):
            for x in longer:
                if CONTRACTED_AFTER in x or CONTRACTED_BEFORE in x:
                    if any(x.endswith(CONTRACTED_AFTER) and x.removesuffix(CONTRACTED_AFTER) in (y, y + "n") or x == CONTRACTED_BEFORE + y for y in shorter):
                        return True
    if counts is None:
        return False
    x, y = _WORD.findall(a), _WORD.findall(b)
    if len(x) != len(y):
        return False
    for i, (v, w) in enumerate(zip(x, y)):
        if 0 < abs(len(v) - len(w)) <= MAX_LOST and min(len(v), len(w)) > 1 and (v.endswith(w) or w.endswith(v)):
            longer = max(v, w, key=len)
            if set(longer[: abs(len(v) - len(w)) + 1]) != {longer[0]} and counts.both_words((v, "".join(x[i + 1 : i + 2])), (w, "".join(y[i + 1 : i + 2]))):
                return True
    return False


def same_line(a: str, b: str, counts: WordCounts | None = None) -> bool:
    """Whether two texts hold the same line but for recognition errors.

    Lost, doubled and misread characters, blanks, line breaks and punctuation
    may differ; numbers may not, nor may a word, name or negation be another,
    as far as ``counts`` of the corpus tell. Texts without letters are the same
    only if equal.
    """
    return a == b or _same_letters(a, b) and not other_word(a, b, counts)


def _same_letters(a: str, b: str) -> bool:
    ra, rb = reading(a), reading(b)
    if not (ra.worded and rb.worded) or ra.numbers != rb.numbers:
        return False
    if ra.letters == rb.letters:
        return True
    # Letters that only one has were lost; taking pairs apart does not touch these.
    lost = len((set(ra.letters) ^ set(rb.letters)) - _PAIR_LETTERS)
    if lost > max(1, int(min(len(ra.letters), len(rb.letters)) * ERROR_SHARE * 2)) or abs(len(ra.letters) - len(rb.letters)) > len(ra.letters) * ERROR_SHARE * 2 + 2:
        return False
    for narrow in (False, True):
        one, two = apart(a, narrow), apart(b, narrow)
        if one.letters == two.letters:
            return True
        shorter = min(len(one.letters), len(two.letters))
        budget = max(1, int(shorter * ERROR_SHARE)) if shorter > 2 else 0
        if lost > budget:
            continue
        if abs(len(one.letters) - len(two.letters)) <= budget and _lost_only(one, two, budget):
            return True
    return False


def _same_line(shared: Broadcast[WordCounts]):
    @F.pandas_udf(T.BooleanType())
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for one, two in parts:
            yield pd.Series([None if a is None or b is None else same_line(a, b, shared.value) for a, b in zip(one, two)], dtype="object")

    return run


def run_pieces(df: DataFrame, keys: Sequence[str], start: str, end: str, row_id: str, text: str, pause_ms: int, bucket_ms: int) -> DataFrame:
    """Runs of each (keys, bucket), with the keys as ``_k``, before runs that cross buckets are joined."""
    rows = df.select(packed_keys(keys), F.col(start).alias("_start"), F.col(end).alias("_end"), F.col(row_id).alias("_id"), F.col(text).alias("_text"))
    rows = rows.where(F.col("_start").isNotNull() & (F.col("_end") > F.col("_start")) & F.col("_text").rlike(r"[^\p{Z}\s]"))
    rows = rows.withColumn("_b", bucket_of("_start", bucket_ms))
    keys = ["_k"]
    row = F.struct("_start", "_id", "_end", "_text")
    carries = carry_in(rows, keys, "_b", F.max(row), "last")
    whole = Window.partitionBy(*keys, "_b")
    scan = whole.orderBy("_start", "_id")
    placed = rows.repartition(*keys, "_b").dropDuplicates([*keys, "_b", "_start", "_id"])
    placed = with_carry(placed, carries, keys, "_b").withColumn("_pos", F.row_number().over(scan))
    placed = placed.withColumn("_prev", F.coalesce(F.lag(row).over(scan), F.col("carry"))).drop("carry")
    near = F.col("_prev").isNotNull() & (F.col("_start") <= F.col("_prev._end") + pause_ms)
    unsure = near & (F.col("_text") != F.col("_prev._text"))
    judge = _same_line(df.sparkSession.sparkContext.broadcast(count_words(df, text)))
    same = F.coalesce(judge(F.when(unsure, F.col("_text")), F.when(unsure, F.col("_prev._text"))), near & ~unsure)
    marked = placed.withColumn("_cont", F.coalesce(same, F.lit(False)))
    final = F.last(F.struct(F.col("_id"), F.col("_end"), F.col("_pos"))).over(scan.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    marked = marked.withColumn("_final", final)
    # Boundary rows only: the next boundary's position and predecessor give the count and the end of a run.
    edges = marked.where(~F.col("_cont") | (F.col("_pos") == 1)).select(*keys, "_b", "_pos", "_id", "_start", "_cont", "_final", F.col("_prev._id").alias("_pid"), F.col("_prev._end").alias("_pend"))
    nxt = F.lead(F.struct("_pos", "_pid", "_pend")).over(whole.orderBy("_pos"))
    edges = edges.withColumn("_next", nxt)
    return edges.select(
        *keys,
        "_b",
        "_pos",
        F.struct("_pos", "_b", "_id", "_start").alias("_first"),
        F.coalesce(F.col("_next._pos"), F.col("_final._pos") + 1).alias("_stop"),
        F.coalesce(F.col("_next._pid"), F.col("_final._id")).alias("last_id"),
        F.coalesce(F.col("_next._pend"), F.col("_final._end")).alias("end_ms"),
        F.col("_cont").alias("cont"),
        F.col("_next").isNull().alias("last"),
        F.col("_id").alias("first_id"),
        F.col("_start").alias("start_ms"),
    )


def collapse_runs(df: DataFrame, keys: Sequence[str], start: str, end: str, row_id: str, text: str, pause_ms: int = MAX_PAUSE_MS, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """One event per longest run: keys, first_id, last_id, rows, start_ms, end_ms, duration_ms.

    Rows are ordered by start, then id, per keys. A row goes on with the run of
    the row right before it if it starts at most ``pause_ms`` after that row's
    end and holds the same line. ``end_ms`` is the end of the last row. Rows with
    null times, null or blank text, or an end not after the start are left out;
    rows of equal id and start are one row; null keys are a key of their own.
    """
    pieces = run_pieces(df, keys, start, end, row_id, text, pause_ms, bucket_ms)
    pieces = pieces.withColumn("rows", (F.col("_stop") - F.col("_pos")).cast("long")).drop("_stop", "_first")
    pieces = stage(pieces, "run-pieces")
    order = F.struct("_b", "_pos")
    joined = stitch(
        pieces,
        ["_k"],
        "_b",
        "_pos",
        "cont",
        "last",
        {
            "first_id": F.min_by("first_id", order),
            "last_id": F.max_by("last_id", order),
            "rows": F.sum("rows"),
            "start_ms": F.min_by("start_ms", order),
            "end_ms": F.max_by("end_ms", order),
        },
    )
    found = joined.select("_k.*", "first_id", "last_id", "rows", "start_ms", "end_ms")
    return found.withColumn("duration_ms", F.col("end_ms") - F.col("start_ms"))
