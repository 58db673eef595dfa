"""Share of a text that repeats what already stands in it.

A text is reduced to its letters (and long runs of other signs), so that case,
punctuation, blanks and running numbers do not matter. A place is repeated if it
lies in a window that already stood earlier in the text; breaks of a character
or two between repeated places count as small changes of a copy. All texts of a
batch are compared at once, as arrays of the hashes of their windows.

The cutoff on that share is risk-controlled: on labelled holdouts, composed from
clean sentences with a known share of copies, the lowest cutoff is taken whose
exact binomial bound on false rejections holds, for each stratum, with the error
probability divided among all strata and cutoffs tried. Every clean sentence
stands in a text that is counted: a table of any size is composed in blocks, in
tasks, and only counts come to the driver.

Defined cases: null and empty texts and texts without letters or signs have
share 0; a null token count gives null repeated tokens; a text under
``LEAST_CHARS`` code points is never flagged.
"""

from __future__ import annotations

import math
import random
import unicodedata
from collections.abc import Callable, Hashable, Iterator, Sequence
from functools import lru_cache
from itertools import islice
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread
from .langid import in_slices

LEAST_CHARS = 40
#: A text repeats itself if more than this share of it is copies.
MOST = 0.5
#: Letters of a window, in scripts of letters and in scripts of syllables or ideographs.
WINDOW = {"letters": 12, "syllables": 6}
#: Changed characters in a row within a copy, and other signs in a row that count as text.
CHANGED = 2
SIGN_RUN = 8
#: Texts of a holdout of a group (or block of it), and more until each sentence stands in one with few copies; composed anew up to so often until each stratum has enough.
HOLDOUT = 400
ENOUGH, ROUNDS = 1_000, 30
#: Sentences of a group that texts are composed of together, about.
BLOCK = 2_000
FALSE_REJECTIONS = 0.02
ERROR = 0.05
CUTOFFS = tuple(round(0.30 + 0.025 * i, 3) for i in range(17))
LONG = 150

_LETTER, _SIGN, _DROPPED, _EDGE = range(4)
# Odd multipliers of the rolling hash of a window, one a step.
_STEPS = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))


@lru_cache(maxsize=1)
def _kinds() -> tuple[np.ndarray, np.ndarray]:
    """Of each code point whether it is a letter or mark, another sign, or dropped; and whether it is a syllable or ideograph."""
    kinds, syllables = np.full(0x110000, _SIGN, dtype=np.uint8), np.zeros(0x110000, dtype=bool)
    every = "".join(map(chr, range(0xD800))) + "\ue000" * 0x800 + "".join(map(chr, range(0xE000, 0x110000)))
    for pattern, kind in ((r"[\p{L}\p{M}]+", _LETTER), (r"[\s\p{Z}\p{N}\p{Cc}]+", _DROPPED)):
        for found in regex.finditer(pattern, every):
            kinds[found.start() : found.end()] = kind
    for found in regex.finditer(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}ー]+", every):
        syllables[found.start() : found.end()] = True
    kinds[0] = _EDGE
    return kinds, syllables


class Bodies:
    """What of each text of a batch is compared: its letters, and other signs in runs of ``SIGN_RUN`` or more."""

    def __init__(self, texts: Sequence[str | None]):
        kinds, syllables = _kinds()
        whole = unicodedata.normalize("NFKC", "\0".join("" if t is None else t.replace("\0", " ") for t in texts)).casefold() + "\0"
        chars = np.frombuffer(whole.encode("utf-32-le", "replace"), dtype=np.uint32)
        kind = kinds[chars]
        row = np.cumsum(kind == _EDGE) - (kind == _EDGE)
        # Signs are counted between letters (and edges of texts), whatever is dropped among them.
        border = np.cumsum((kind == _LETTER) | (kind == _EDGE))
        run = np.bincount(border, weights=kind == _SIGN, minlength=1)
        kept = (kind == _LETTER) | (kind == _SIGN) & (run[border] >= SIGN_RUN)
        self.count = len(texts)
        self.chars, self.row = chars[kept], row[kept]
        self.sizes = np.bincount(self.row, minlength=self.count)
        full = np.bincount(self.row, weights=syllables[self.chars], minlength=self.count) * 2 > self.sizes
        self.strata = [f"{'syllables' if f else 'letters'}-{'long' if n >= LONG else 'short'}" for f, n in zip(full.tolist(), self.sizes.tolist())]

    def of(self, i: int) -> str:
        return self.chars[self.row == i].astype(np.uint32).tobytes().decode("utf-32-le")

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Places where a window of ``size`` characters of one text starts, and a hash of each with its text."""
        one = (self.chars.astype(np.uint64) + np.uint64(1)) * _STEPS[0]
        powers, width = {1: one}, 1
        while width * 2 <= size:
            last = powers[width]
            powers[width * 2] = _mixed(last[: len(last) - width] * _STEPS[1] + last[width:])
            width *= 2
        whole, covered = powers[width], width
        for step in sorted(powers, reverse=True):
            if covered + step <= size:
                number = max(0, len(one) - covered - step + 1)
                whole = _mixed(whole[:number] * _STEPS[2] + powers[step][covered : covered + number])
                covered += step
        number = max(0, len(self.row) - size + 1)
        starts = np.flatnonzero(self.row[:number] == self.row[size - 1 : size - 1 + number])
        return starts, _mixed(whole[starts] + self.row[starts].astype(np.uint64) * _STEPS[3])

    def repeated(self, window: dict[str, int] = WINDOW) -> np.ndarray:
        """Number of places of each text in second or later copies.

        A window is repeated if an equal one starts earlier in its text; windows
        are compared by a hash of 64 bits. What lies between two repeated
        windows counts with them if it is no longer than ``CHANGED``.
        """
        total = np.zeros(self.count, dtype=np.int64)
        for script, size in window.items():
            mine = np.array([k.startswith(script) for k in self.strata], dtype=bool)
            if not mine.any():
                continue
            starts, keys = self.windows(size)
            chosen = mine[self.row[starts]]
            starts, keys = starts[chosen], keys[chosen]
            order = np.argsort(keys, kind="stable")
            again = np.zeros(len(keys), dtype=bool)
            again[order[1:]] = keys[order[1:]] == keys[order[:-1]]
            at = starts[again]
            if not len(at):
                continue
            row = self.row[at]
            gap = at[1:] - at[:-1] - size
            added = np.full(len(at), size, dtype=np.int64)
            added[1:] += np.where((row[1:] == row[:-1]) & (gap <= CHANGED), gap, 0)
            total += np.bincount(row, weights=added, minlength=self.count).astype(np.int64)
        return total


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _STEPS[3]
    return x ^ (x >> np.uint64(29))


def content(text: str) -> str:
    """What of a text is compared."""
    return Bodies([text]).of(0)


def repetition(text: str | None) -> tuple[int, int, str]:
    """Repeated places, all places, and stratum of a text."""
    body = Bodies([text])
    return int(body.repeated()[0]), int(body.sizes[0]), body.strata[0]


def binomial_upper(failures: int, trials: int, error: float) -> float:
    """Exact upper bound on a rate after ``failures`` in ``trials`` (Clopper and Pearson)."""
    if failures >= trials:
        return 1.0

    def at_most(p: float) -> float:
        log_p, log_q = math.log(p), math.log1p(-p)
        return sum(math.exp(math.lgamma(trials + 1) - math.lgamma(k + 1) - math.lgamma(trials - k + 1) + k * log_p + (trials - k) * log_q) for k in range(failures + 1))

    low, high = failures / trials, 1.0
    for _ in range(60):
        middle = (low + high) / 2
        if middle in (0.0, 1.0):
            break
        low, high = (middle, high) if at_most(middle) > error else (low, middle)
    return high


def _changed(sentence: str, rnd: random.Random) -> str:
    """A copy of a sentence with a small change now and then."""
    roll = rnd.random()
    if roll < 0.2:
        at = rnd.randrange(len(sentence))
        return sentence[:at] + rnd.choice("xoいの이") + sentence[at + 1 :]
    if roll < 0.4:
        return sentence.upper() if roll < 0.3 else sentence.rstrip(".。!?！？")
    return sentence


def holdout(sentences: Sequence[str], count: int, seed: int) -> list[tuple[str, float]]:
    """Texts composed of sentences, and the share of each that is copies.

    The sentences of a text have no window in common, so only the copies repeat.
    ``count`` texts are drawn, and then more of the sentences left over, until
    each sentence stands in a text of which at most ``MOST`` is copies.
    """
    rnd = random.Random(seed)
    read = Bodies(sentences)
    size = WINDOW[Bodies(["".join(sentences)]).strata[0].split("-")[0]]
    bodies = {s: read.of(i) for i, s in enumerate(sentences)}
    windows = {s: {b[i : i + size] for i in range(len(b) - size + 1)} for s, b in bodies.items()}

    def compose(first: Sequence[str], size: int) -> tuple[str, list[tuple[str, bool]]]:
        picked: list[str] = []
        taken: set[str] = set()
        for s in list(dict.fromkeys([*first, *rnd.sample(sentences, size)]))[:size]:
            if taken.isdisjoint(windows[s]):
                picked.append(s)
                taken |= windows[s]
        parts = [(s, False) for s in picked]
        for _ in range(rnd.choice([0, 0, 1, 2, 3, 5, 8, 13])):
            parts.insert(rnd.randrange(1, len(parts) + 1), (None, True))
        said, earlier = [], []
        for sentence, copy in parts:
            said.append((_changed(rnd.choice(earlier), rnd) if copy else sentence, copy))
            earlier += [] if copy else [sentence]
        text = [words if rnd.random() < 0.8 else f"{number}. {words}" for number, (words, _) in enumerate(said, 1)]
        return rnd.choice([" ", "\n"]).join(text), said

    def some() -> int:
        return min(len(sentences), rnd.randrange(2, 16))

    made = [compose([], some()) for _ in range(count)]
    out: list[tuple[str, float]] = []
    left = dict.fromkeys(sentences)
    while made:
        different = sorted({words for _, said in made for words, _ in said})
        places = dict(zip(different, Bodies(different).sizes.tolist()))
        for text, said in made:
            out.append((text, sum(places[w] for w, copy in said if copy) / max(1, sum(places[w] for w, _ in said))))
            if out[-1][1] <= MOST:
                for words, copy in said:
                    if not copy:
                        left.pop(words, None)
        made, waiting = [], iter(left)
        while first := list(islice(waiting, size := some())):
            made.append(compose(first, size))
    return out


class Cutoff(NamedTuple):
    """Least share of a stratum that counts, null if none can be answered for, and the bound on false rejections at it."""

    share: float | None
    bound: float


STRATA = tuple(f"{script}-{length}" for script in WINDOW for length in ("short", "long"))


def _counted(sentences: Sequence[str], count: int, seed: int) -> dict[str, np.ndarray]:
    """Of the texts of a holdout with few copies, by stratum: how many, and how many lie over each cutoff."""
    read = Bodies([text for text, share in holdout(sentences, count, seed) if share <= MOST])
    found = read.repeated() / np.maximum(read.sizes, 1)
    kinds = np.array(read.strata, dtype=object)
    return {kind: np.array([np.sum(kinds == kind), *(np.sum(found[kinds == kind] > c) for c in CUTOFFS)]) for kind in sorted(set(read.strata))}


def _controlled(groups: list, count: Callable[[list, range], Callable[[int, Hashable], dict[str, np.ndarray]]], alpha: float, error: float) -> dict[str, Cutoff]:
    """Cutoffs from the counts of rounds: ``count`` gives those of some groups in a range of rounds."""
    clean = {kind: np.zeros(1 + len(CUTOFFS), dtype=np.int64) for kind in STRATA}
    lacking, number = set(STRATA), 0
    while number < ROUNDS and lacking and groups:
        # As many rounds at once as the strata met so far seem to need.
        met = [int(clean[kind][0]) for kind in lacking if clean[kind][0]]
        ahead = max((math.ceil((ENOUGH - n) * number / n) for n in met), default=1)
        rounds = range(number, min(ROUNDS, number + ahead))
        counted = count(groups, rounds)
        for number in rounds:
            useful = []
            for group in groups:
                found = {kind: n for kind, n in counted(number, group).items() if kind in lacking}
                for kind, n in found.items():
                    clean[kind] += n
                if found:
                    useful.append(group)
            groups, lacking = useful, {kind for kind in lacking if clean[kind][0] < ENOUGH}
            if not lacking or not groups:
                break
        number += 1
    each = error / (len(STRATA) * len(CUTOFFS))
    chosen = {}
    for kind in STRATA:
        texts, *over = clean[kind].tolist()
        chosen[kind] = Cutoff(None, 1.0)
        for c, wrong in zip(CUTOFFS, over) if texts else ():
            bound = binomial_upper(wrong, texts, each)
            chosen[kind] = Cutoff(c if bound <= alpha else None, bound)
            if bound <= alpha:
                break
    return chosen


def select_cutoffs(sentences: Sequence[tuple[str, str]], alpha: float = FALSE_REJECTIONS, error: float = ERROR, count: int = HOLDOUT) -> dict[str, Cutoff]:
    """Cutoff of each stratum: the lowest that keeps false rejections under ``alpha``.

    ``sentences`` are (group, sentence); texts are composed within a group.
    Holdouts are composed until each stratum has ``ENOUGH`` texts with few copies.
    The bound covers texts of this composition. A stratum without a cutoff that
    holds has none: its texts get no decision.
    """
    by: dict[str, set[str]] = {}
    for group, sentence in sentences:
        by.setdefault(group, set()).add(sentence)
    held = {group: sorted(by[group]) for group in by}
    places = {group: i for i, group in enumerate(sorted(by))}
    return _controlled(sorted(by), lambda groups, rounds: lambda number, group: _counted(held[group], count, 1_000 * (number + 1) + places[group]), alpha, error)


def table_cutoffs(samples: DataFrame, group: str, text: str, alpha: float = FALSE_REJECTIONS, error: float = ERROR, count: int = HOLDOUT, block: int = BLOCK) -> dict[str, Cutoff]:
    """``select_cutoffs`` of all labelled sentences of a table, however many; groups are few, such as languages.

    The sentences of a group are cut into blocks of about ``block`` by hash, and
    each block is composed and counted in a task, so that the driver receives a
    row of counts for each group, round and stratum. The first round takes every
    block; later ones those of groups that have texts of a stratum that lacks some.
    """
    spark, kind = samples.sparkSession, samples.schema[group].dataType.simpleString()
    rows = samples.select(F.col(group).alias("_group"), F.col(text).alias("_text")).dropna().distinct()
    sizes = {r["_group"]: r["count"] for r in rows.groupBy("_group").count().collect()}
    places = {g: (i, math.ceil(sizes[g] / block)) for i, g in enumerate(sorted(sizes))}
    columns = [f"_c{i}" for i in range(1 + len(CUTOFFS))]

    def run_rounds(groups: list, rounds: range) -> Callable[[int, Hashable], dict[str, np.ndarray]]:
        chosen = spark.createDataFrame([(g, *places[g]) for g in groups], f"_group {kind}, _place int, _blocks int")
        keyed = rows.join(F.broadcast(chosen), "_group").withColumn("_block", F.pmod(F.xxhash64("_text"), "_blocks"))

        def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
            name, place, at = key
            sentences = sorted(part["_text"])
            out = []
            for number in rounds:
                counts = _counted(sentences, count, 1_000 * (number + 1) + int(place) + 1_000_003 * int(at))
                out += [(name, number, stratum, *n.tolist()) for stratum, n in counts.items()]
            return pd.DataFrame(out, columns=["_group", "_number", "_stratum", *columns])

        keys = ["_group", "_place", "_block"]
        out = spread(keyed, *keys).groupBy(*keys).applyInPandas(run, f"_group {kind}, _number int, _stratum string, " + ", ".join(f"{c} bigint" for c in columns))
        summed = out.groupBy("_group", "_number", "_stratum").agg(*[F.sum(c).alias(c) for c in columns]).collect()
        counted: dict[tuple, dict[str, np.ndarray]] = {}
        for r in summed:
            counted.setdefault((r["_number"], r["_group"]), {})[r["_stratum"]] = np.array([r[c] for c in columns], dtype=np.int64)
        return lambda number, group: counted.get((number, group), {})

    return _controlled(sorted(sizes), run_rounds, alpha, error)


def clean_sentences(samples: DataFrame, group: str, text: str, most: int | None = None) -> list[tuple[str, str]]:
    """The labelled sentences of a table that fits the driver: all, or the ``most`` whose hash is least, so that no group is cut off."""
    rows = samples.select(group, text).dropna()
    if most is not None:
        rows = rows.orderBy(F.xxhash64(group, text), group, text).limit(most)
    return sorted(tuple(r) for r in rows.collect())


def repetition_of(df: DataFrame, row_id: str, text: str, tokens: str, cutoffs: dict[str, Cutoff], least_chars: int = LEAST_CHARS) -> DataFrame:
    """row_id, share, repeated_tokens, stratum, cutoff, bound, repeats: one row for each row of ``df``.

    ``repeats`` is null where the stratum has no cutoff.
    """
    kind = df.schema[row_id].dataType.simpleString()
    rows = df.select(F.col(row_id).alias("row_id"), F.col(text).alias("text"), F.col(tokens).cast("long").alias("tokens"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            sizes = pc.fill_null(pc.binary_length(whole.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            for start, stop in in_slices(sizes):
                batch = whole.slice(start, stop - start)
                read = Bodies(batch.column(1).to_pylist())
                share = read.repeated() / np.maximum(read.sizes, 1)
                own = pa.array([cutoffs[k].share for k in read.strata], pa.float64())
                long = pc.fill_null(pc.greater_equal(pc.utf8_length(batch.column(1)), least_chars), False)
                repeated = pc.cast(pc.round(pc.multiply(pc.cast(batch.column(2), pa.float64()), pa.array(share))), pa.int64())
                repeats = pc.and_kleene(long, pc.greater(pa.array(share), own))
                bound = pa.array([cutoffs[k].bound for k in read.strata], pa.float64())
                columns = [batch.column(0), pa.array(share), repeated, pa.array(read.strata, pa.string()), own, bound, repeats]
                yield pa.RecordBatch.from_arrays(columns, ["row_id", "share", "repeated_tokens", "stratum", "cutoff", "bound", "repeats"])

    out = rows.mapInArrow(run, f"row_id {kind}, share double, repeated_tokens bigint, stratum string, cutoff double, bound double, repeats boolean")
    return out.withColumnRenamed("row_id", row_id)
