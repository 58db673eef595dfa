"""Scores for abusive, hateful and sexually explicit passages.

FTRL-proximal logistic regression over hashed word n-grams and skip-grams: each
coordinate has its own rate and L1 keeps most of them at zero, so the weights
are a small table, bounded by the features of the training sentences. A passage
is a sentence or line; a text scores as its worst passage.

Before hashing, a passage is brought to one spelling: look-alike letters and
widths, digits and signs for letters, letters set apart, drawn-out letters and
words masked with asterisks.

Defined cases: null, empty and blank texts score 0 with verdict ``none``; a null
source is a source of its own in the rates.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Iterable, Iterator, Sequence, Set
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lookalike import transducer
from .moderation_patterns import pattern_passages, plain_sentences
from .moderation_phrases import ordinary_sentences, phrases

VERDICTS = ("abusive", "hateful", "sexual")
HASH_BITS = 30
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.5, 0.05
EPOCHS = 10
#: Log-odds of harm of a passage without any known feature: the share of harmful examples says nothing of how rare they are.
CONSTANT = -1.5
#: Score from which a passage counts.
THRESHOLD = 0.6
#: The most judged, and the most clean, sentences the model is fitted on.
MOST_EXAMPLES = 4_000
#: Letters a long word shares with its other forms.
STEM = 6
#: Passages whose scores a task keeps, and scores at once.
KEPT = 200_000
AT_ONCE = 2_000

# Digits and signs written for letters.
STAND_INS = str.maketrans("013457@$!|€", "oieastasile")

_PASSAGE = regex.compile(r"[^.!?。！？｡\n\r]+[.!?。！？｡]*")
_LATIN_MARKS = regex.compile(r"(?<=[\p{Latin}\p{Cyrillic}])\p{M}+")
_APART = regex.compile(r"(?<![\p{L}\p{N}])(?:[\p{Latin}\p{Cyrillic}\p{Hangul}0-9@$]([ \-_.·*/]))(?:[\p{Latin}\p{Cyrillic}\p{Hangul}0-9@$]\1)+[\p{Latin}\p{Cyrillic}\p{Hangul}0-9@$](?![\p{L}\p{N}])")
# A word of Cyrillic letters alone: its capitals are brought to small letters before they are taken for Latin ones.
_CYRILLIC_WORD = regex.compile(r"(?<![\p{L}\p{N}@$])\p{Cyrillic}+(?![\p{L}\p{N}@$])")
_WORD = regex.compile(r"[\p{Latin}\p{Cyrillic}][\p{Latin}\p{Cyrillic}\p{M}0-9@$!|€*]*|[0-9@$]+[\p{Latin}\p{Cyrillic}][\p{Latin}\p{Cyrillic}0-9@$*]*|\p{Hangul}+|[\p{Han}\p{Hiragana}\p{Katakana}ー]|\d+")
_DOTTED = regex.compile(r"(?<![\p{L}\p{N}])(?:[\p{Latin}\p{Cyrillic}0-9@$]\.){2,}[\p{Latin}\p{Cyrillic}0-9@$](?![\p{L}\p{N}])")
_PLAIN_NUMBER = regex.compile(r"(?<![\p{L}\p{M}@$!|€*\d])\d+(?![\p{L}\p{M}@$!|€*\d])|(?<=[\p{Han}\p{Hiragana}\p{Katakana}])\d+(?=[\p{Han}\p{Hiragana}\p{Katakana}])")
_DRAWN = regex.compile(r"(.)\1+")
_EAST = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}ー]")


def spelled(text: str) -> str:
    """A passage in one spelling, before it is cut into words."""
    if text.isascii():
        return _APART.sub(lambda m: m.group().replace(m.group(1), ""), text.casefold())
    text = _CYRILLIC_WORD.sub(lambda m: m.group().casefold(), text)
    text = unicodedata.normalize("NFKC", transducer()(text)).casefold()
    text = unicodedata.normalize("NFC", _LATIN_MARKS.sub("", unicodedata.normalize("NFD", text)))
    return _APART.sub(lambda m: m.group().replace(m.group(1), ""), text)


def words_of(text: str, masks: dict[tuple[int, str, str], str] | None = None) -> list[str]:
    """Words of a passage; ideographs and kana one by one, numbers as one sign."""
    out = []
    for word in _WORD.findall(spelled(text)):
        if word.isdigit():
            word = "#"
        elif "*" in word.rstrip("*"):
            word = (masks or {}).get((len(word), word[0], word[-1]), "<masked>")
        elif not word.isalpha():
            word = word.rstrip("!|*").translate(STAND_INS)
        out.append(_DRAWN.sub(r"\1", word))
    return out


@lru_cache(100_000)
def _word_features(word: str) -> tuple[int, tuple[int, ...]]:
    """Code of a word, and its features on its own: none for an ideograph, the first letters of a long word, syllable pairs for Hangul."""
    code = zlib.crc32(word.encode("utf-8"))
    own = [] if _EAST.match(word) else [word]
    if len(word) >= STEM and word.isalpha() and not "가" <= word[0] <= "힣":
        own.append(word[:STEM] + "~")
    if len(word) > 2 and "가" <= word[0] <= "힣":
        own += [word[k : k + 2] + "~" for k in range(len(word) - 1)]
    return code, tuple(zlib.crc32(x.encode("utf-8")) >> 2 for x in own)


# Odd multipliers that tell the kinds of word pairs apart, and one that mixes.
_NEXT, _OVER_ONE, _OVER_TWO, _MIX = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))


def features_of(lists: Sequence[Sequence[str]], common: Set[str] = frozenset()) -> tuple[np.ndarray, np.ndarray]:
    """Passage and hash of each feature of many passages, given as words, once each.

    Features are n-grams of up to three words and skip-grams over one or two,
    but for words, pairs and skip-grams of ``common`` words alone.
    """
    codes, own, own_of, sizes, rare = [], [], [], [], []
    for at, words in enumerate(lists):
        sizes.append(len(words))
        for word in words:
            code, alone = _word_features(word)
            codes.append(code)
            rare.append(word not in common)
            if rare[-1]:
                own += alone
                own_of += [at] * len(alone)
    says = np.array(rare, dtype=bool)
    code, of = np.array(codes, dtype=np.uint64), np.repeat(np.arange(len(sizes), dtype=np.int64), sizes)
    rows, hashes = [np.array(own_of, dtype=np.int64)], [np.array(own, dtype=np.int64)]

    def add(mixed: np.ndarray, gap: int, said: np.ndarray) -> None:
        same = (of[:-gap] == of[gap:]) & said
        rows.append(of[:-gap][same])
        hashes.append((mixed[same] * _MIX >> np.uint64(64 - HASH_BITS)).astype(np.int64))

    if len(code) > 1:
        pair = code[:-1] * _NEXT + code[1:]
        add(pair, 1, says[:-1] | says[1:])
    if len(code) > 2:
        add(code[:-2] * _OVER_ONE + code[2:], 2, says[:-2] | says[2:])
        add(pair[:-1] * _NEXT + code[2:], 2, np.True_)
    if len(code) > 3:
        add(code[:-3] * _OVER_TWO + code[3:], 3, says[:-3] | says[3:])
    keys = np.unique(np.concatenate(rows) << HASH_BITS | np.concatenate(hashes))
    return keys >> HASH_BITS, keys & ((1 << HASH_BITS) - 1)


class Ftrl:
    """FTRL-proximal logistic regression of several targets over rows of present features."""

    def __init__(self, features: int, targets: int = 1, constant: float = 0.0, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.constant = constant
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self._z, self._n = np.zeros((features, targets)), np.zeros((features, targets))

    def _weights(self, z: np.ndarray, root: np.ndarray) -> np.ndarray:
        shrunk = np.minimum(z + self.l1, 0.0) + np.maximum(z - self.l1, 0.0)
        return -shrunk / ((self.beta + root) / self.alpha + self.l2)

    def weights(self) -> np.ndarray:
        """Weights by feature and target; most are zero."""
        return self._weights(self._z, np.sqrt(self._n))

    def learn(self, at: np.ndarray, labels: np.ndarray) -> None:
        """One row: the features it has, and the label of each target."""
        z, n = self._z[at], self._n[at]
        root = np.sqrt(n)
        w = self._weights(z, root)
        gradient = 1 / (1 + np.exp(-np.clip(w.sum(axis=0) + self.constant, -30, 30))) - labels
        n += gradient * gradient
        self._z[at] = z + gradient - (np.sqrt(n) - root) / self.alpha * w
        self._n[at] = n


TARGETS = ("any", *VERDICTS)


@dataclass
class ModerationModel:
    """Features in order, their weights for each target, the words masks may stand for, and words that say nothing alone."""

    features: np.ndarray
    weights: np.ndarray
    masks: dict[tuple[int, str, str], str] = field(default_factory=dict)
    common: frozenset[str] = frozenset()

    def __post_init__(self) -> None:
        # A small table of the low bits tells most of what is not among the features.
        self._near = np.zeros(1 << 20, dtype=bool)
        self._near[self.features & ((1 << 20) - 1)] = True

    def scores(self, passages: Sequence[str]) -> np.ndarray:
        """Probability of each target for each passage; the first is that of any harm."""
        row, feature = features_of([words_of(p, self.masks) for p in passages], self.common)
        near = self._near[feature & ((1 << 20) - 1)]
        row, feature = row[near], feature[near]
        at = np.minimum(np.searchsorted(self.features, feature), len(self.features) - 1)
        met = self.features[at] == feature
        row, at = row[met], at[met]
        total = np.stack([np.bincount(row, weights=w[at], minlength=len(passages)) for w in self.weights]) + CONSTANT
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))

    def score(self, passage: str, verdict: str = "any") -> float:
        return float(self.scores([passage])[TARGETS.index(verdict), 0])

    def verdict(self, passage: str) -> str:
        return VERDICTS[int(self.scores([passage])[1:, 0].argmax())]


def common_words(sentences: Iterable[str]) -> frozenset[str]:
    """Words of ordinary sentences: of these alone no passage is made harmful. Ideographs and kana are no words by themselves."""
    return frozenset(w for s in sentences for w in words_of(s) if not _EAST.match(w))


def train(examples: Sequence[tuple[str, str]], ordinary: Sequence[str] = (), epochs: int = EPOCHS) -> ModerationModel:
    """A model from (passage, verdict) and ordinary sentences, the same at every run and in any order of them."""
    common = common_words(ordinary)
    examples = [*examples, *((text, "none") for text in ordinary)]
    examples = sorted({(text, verdict) for text, verdict in examples if text}, key=lambda r: (zlib.crc32("\0".join(r).encode("utf-8")), r))
    if not any(verdict in VERDICTS for _, verdict in examples):
        return ModerationModel(np.array([0]), np.zeros((len(TARGETS), 1)))
    cut = [words_of(text) for text, _ in examples]
    counts: dict[str, list[int]] = {}
    for words, (_, verdict) in zip(cut, examples):
        for word in set(words):
            counts.setdefault(word, [0, 0])[verdict in VERDICTS] += 1
    masks: dict[tuple[int, str, str], str] = {}
    for text, verdict in examples:
        if verdict in VERDICTS:
            for word in _WORD.findall(spelled(text)):
                harmless, harmful = counts.get(_DRAWN.sub(r"\1", word), [0, 0])
                if len(word) > 3 and word.isalpha() and harmful > harmless:
                    masks.setdefault((len(word), word[0], word[-1]), word)
    row, feature = features_of(cut, common)
    features, places = np.unique(feature, return_inverse=True)
    starts = np.searchsorted(row, np.arange(len(cut) + 1))
    rows = [places[a:b] for a, b in zip(starts, starts[1:])]
    labels = [np.array([verdict in VERDICTS, *(verdict == v for v in VERDICTS)], dtype=float) for _, verdict in examples]
    learner = Ftrl(len(features), len(TARGETS), CONSTANT)
    for _ in range(epochs):
        for at, label in zip(rows, labels):
            learner.learn(at, label)
    weights = learner.weights()
    used = np.flatnonzero(weights.any(axis=1))
    return ModerationModel(features[used], weights[used].T.copy(), masks, common)


def judged_sample(judged: DataFrame, columns: Sequence[str], most: int) -> list[tuple]:
    """At most ``most`` labelled rows: all of them, or else those whose hash is least, so that every kind of row stays in proportion."""
    rows = judged.select(*columns).dropna().distinct()
    return [tuple(r) for r in rows.orderBy(F.xxhash64(*columns), *columns).limit(most).collect()]


def fit(judged: DataFrame, clean: DataFrame | None = None, most: int = MOST_EXAMPLES) -> ModerationModel:
    """A model from judged passages (text, verdict), clean sentences (text) and the phrases and patterns of this package.

    Each side is bounded by ``most`` labelled rows. Nothing of the corpus that is
    to be scored takes part.
    """
    rows = judged_sample(judged, ["text", "verdict"], most)
    sentences = [text for (text,) in judged_sample(clean, ["text"], most)] if clean is not None else []
    return train([*rows, *phrases(), *pattern_passages()], [*sentences, *ordinary_sentences(), *plain_sentences()])


def passages(text: str) -> list[str]:
    """Sentences and lines of a text; letters set apart by dots are no ends of sentences."""
    whole = _DOTTED.sub(lambda m: m.group().replace(".", ""), text) if "." in text else text
    return [p for p in (m.strip() for m in _PASSAGE.findall(whole)) if p]


def numberless(passage: str) -> str:
    """A passage with its numbers as one: it has the same features."""
    return _PLAIN_NUMBER.sub("0", passage)


def moderate(df: DataFrame, model: ModerationModel, text: str, keep: Sequence[str], threshold: float = THRESHOLD) -> DataFrame:
    """``keep``, score, verdict and harmful passages of each text.

    ``score`` is that of the worst passage, ``verdict`` its most likely kind, or
    ``none`` under ``threshold``; ``harmful`` counts passages from it on. The
    different passages of a batch are scored together.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    rows = df.select(*keep, F.col(text).alias("_text"))
    schema = rows.select(*keep).schema

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fitted = shared.value
        known: dict[str, tuple[float, int]] = {}  # score and likely verdict
        for part in parts:
            held = [[numberless(p) for p in passages(t)] if t else [] for t in part["_text"]]
            if len(known) > KEPT:
                known.clear()
            fresh = list({p for found in held for p in found if p not in known})
            for start in range(0, len(fresh), AT_ONCE):
                some = fresh[start : start + AT_ONCE]
                scores = fitted.scores(some)
                known.update(zip(some, zip(scores[0].tolist(), scores[1:].argmax(axis=0).tolist())))
            worst, verdict, harmful = [], [], []
            for found in held:
                scored = [known[p] for p in found]
                top, likely = max(scored, default=(0.0, 0))
                worst.append(top)
                verdict.append(VERDICTS[likely] if top >= threshold else "none")
                harmful.append(sum(s >= threshold for s, _ in scored))
            yield part.drop(columns="_text").assign(score=worst, verdict=verdict, harmful=harmful)

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    return rows.mapInPandas(run, f"{ddl}, score double, verdict string, harmful bigint")


def rates(moderated: DataFrame, source: str) -> DataFrame:
    """Per source: texts, harmful texts, their share, mean score, and texts of each verdict."""
    counts = [F.count_if(F.col("verdict") == v).alias(v) for v in VERDICTS]
    return moderated.groupBy(source).agg(F.count("*").alias("texts"), F.count_if(F.col("verdict") != "none").alias("harmful_texts"), F.avg(F.when(F.col("verdict") != "none", 1.0).otherwise(0.0)).alias("rate"), F.avg("score").alias("mean_score"), *counts)
