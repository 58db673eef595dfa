"""Languages of texts and of their stretches by rank-order n-gram profiles.

A text is cut into sentences and lines. The script of a sentence leaves as
candidates the languages with a profile in it; among them, and against a language
that nobody knows, decides the out-of-place distance between the sentence's
n-grams, ordered by frequency, and the profile of each, which also gives the
confidence. All steps run over whole Arrow batches as NumPy arrays, with no loop
over texts.

Defined cases: null, empty and blank texts and texts without words have no
stretches. Names, titles and terms inside a sentence do not make a stretch; a
piece too short to judge joins its neighbours, unless it is all there is.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lookalike import shape_pairs

#: Bytes of text whose arrays are in memory at a time, at some 60 bytes a character.
SLICE_BYTES = 1 << 20
#: The most labelled rows that profiles are fitted on.
MAX_SAMPLES = 20_000
#: How far beyond the nearest language a labelled sentence may be for its label to count.
NEAR = 1.12
#: Longer n-grams are hashed to this many bits.
HASH_BITS = 20

# Names of languages as labels write them, after the two-letter code.
LABELS = (
    "ja jpn japanese nihongo 日本語 日本语;en eng english;fr fra fre french français francais;de deu ger german deutsch;"
    "es spa spanish español espanol castellano;pt por portuguese português portugues;ru rus russian русский;ko kor korean 한국어;"
    "zh zho chi chinese cmn zh-hans zh-hant 中文 汉语"
)

_OTHER, _LATIN, _CYRILLIC, _KANA, _HAN, _HANGUL, _DIGIT, _SPACE, _END, _BREAK, _EDGE, _HIDDEN, _DOT, _SLASH = range(14)
#: Weight of a letter by script: an ideograph or syllable says more than a letter.
_WEIGHT = np.array([0, 1, 1, 2.5, 2.5, 2.0])
#: Places of a profile by script and size of n-gram; an n-gram beyond them is out of place by as many.
#: Size 0 are three letters in a row by their scripts only, kana or ideograph.
PLACES = {_LATIN: {2: 300, 3: 1500, 4: 3000, 5: 3000}, _CYRILLIC: {2: 600, 3: 3000}, _HAN: {0: 30, 1: 2000, 2: 3000}, _HANGUL: {1: 1000, 2: 3000}}
#: Letters a sentence needs to be judged on its own, by script.
LEAST = {_LATIN: 8, _CYRILLIC: 5, _KANA: 2, _HAN: 2, _HANGUL: 2}
#: Bits of a Latin symbol in an n-gram, of another one, and of the hash of an n-gram of others.
_JOIN, _WIDE, OTHER_BITS = 6, 18, 18
_MIX = 0x1E3779B97F4A7C15


def label_languages() -> dict[str, str]:
    return {name: names.split()[0] for names in LABELS.split(";") for name in names.split()}


def label_language(label: Column) -> Column:
    """Two-letter code of a label, with or without a country; null if it names no language."""
    known = label_languages()
    text = F.lower(F.trim(label))
    table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    return F.coalesce(F.try_element_at(table, text), F.try_element_at(table, F.split(text, "[-_ (]").getItem(0)))


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class, folded code point, and symbol of each code point: a number up to 63 for Latin, the folded code point for others."""
    kinds = np.zeros(0x110000, dtype=np.uint8)
    folded = np.arange(0x110000, dtype=np.uint32)
    for c in range(0x20000):
        if 0xD800 <= c < 0xE000:
            continue
        ch = chr(c)
        category = unicodedata.category(ch)
        if category[0] == "L" or category == "Nl":
            name = unicodedata.name(ch, "")
            base = name.removeprefix("FULLWIDTH ").removeprefix("HALFWIDTH ").split(" ")[0]
            kinds[c] = {"LATIN": _LATIN, "GREEK": _LATIN, "CYRILLIC": _CYRILLIC, "HIRAGANA": _KANA, "KATAKANA": _KANA, "KATAKANA-HIRAGANA": _KANA, "CJK": _HAN, "KANGXI": _HAN, "HANGUL": _HANGUL}.get(base, _OTHER)
        elif category == "Nd":
            kinds[c] = _DIGIT
        elif category == "Zs" or ch == "\t":
            kinds[c] = _SPACE
        elif category in ("Cf", "Mn") or 0xFE00 <= c < 0xFE10:
            kinds[c] = _HIDDEN
        low = unicodedata.normalize("NFKC", ch).lower() if category[0] == "L" else ch
        if len(low) == 1:
            folded[c] = ord(low)
    kinds[0x20000:0x32000] = _HAN
    for ch in "!?。！？…｡‥؟":
        kinds[ord(ch)] = _END
    for ch in "\n\r\v\f\x85\u2028\u2029":
        kinds[ord(ch)] = _BREAK
    kinds[0], kinds[ord(".")], kinds[ord("．")], kinds[ord("/")] = _EDGE, _DOT, _DOT, _SLASH
    for other, becomes in shape_pairs().items():
        if unicodedata.name(other).split()[0] in ("GREEK", "CYRILLIC"):
            folded_other = ord(other)
            if kinds[folded_other] == _LATIN:
                folded[folded_other] = ord(becomes.lower())
    symbols = np.zeros(0x110000, dtype=np.int64)
    for i, ch in enumerate("abcdefghijklmnopqrstuvwxyzàáâãäæçèéêëìíîïñòóôõöœùúûüß", 1):
        symbols[ord(ch)] = i
    for other, becomes in shape_pairs().items():  # a look-alike in a Latin word
        if kinds[ord(other)] == _CYRILLIC and symbols[ord(becomes.lower())]:
            symbols[ord(other)] = symbols[int(folded[ord(other)])] = symbols[ord(becomes.lower())]
    others = (kinds >= _CYRILLIC) & (kinds <= _HANGUL) & (symbols == 0)
    symbols[others] = folded[others]
    return kinds, folded, symbols


class Sentences:
    """Sentences of a batch of texts, as arrays over sentences."""

    def __init__(self, texts: Sequence[str | None]):
        kinds, folded, self._symbols = _tables()
        whole = unicodedata.normalize("NFC", "\0".join("" if t is None else t.replace("\0", " ") for t in texts)) + "\0"
        chars = np.frombuffer(whole.encode("utf-32-le", "replace"), dtype=np.uint32)
        kind = kinds[chars]
        seen = np.flatnonzero(kind != _HIDDEN)
        self.chars, kind = folded[chars[seen]], kind[seen]
        after = np.append(kind[1:], _EDGE)
        before = np.append(_EDGE, kind[:-1])
        cut = (kind == _END) | (kind == _BREAK) | (kind == _EDGE)
        cut |= (kind == _DOT) & (after != _LATIN) & (after != _CYRILLIC) & (after != _DIGIT)
        cut |= (kind == _SLASH) & (after == _SPACE) & (before == _SPACE)
        ends = np.flatnonzero(cut)
        self.count = len(ends)
        starts = np.append(0, ends[:-1] + 1)
        self.sentence = np.repeat(np.arange(self.count), ends - starts + 1)
        edges = np.flatnonzero(kind[ends] == _EDGE)
        self.row = np.searchsorted(edges, np.arange(self.count))
        edge_places = np.flatnonzero(chars == 0)
        row_start = np.append(0, edge_places[:-1] + 1)
        self.start = seen[starts] - row_start[self.row]
        self.end = np.minimum(seen[ends] + 1, edge_places[self.row]) - row_start[self.row]
        letter = (kind >= _LATIN) & (kind <= _HANGUL)
        self.letters = np.bincount(self.sentence[letter] * 6 + kind[letter], minlength=self.count * 6).reshape(self.count, 6)
        weights = self.letters * _WEIGHT
        weights[:, _HAN] += weights[:, _KANA]
        weights[:, _KANA] = 0
        self.script = np.where(weights.sum(1) > 0, weights.argmax(1), 0)
        self.clear = weights.max(1) / np.maximum(weights.sum(1), 1e-9)
        opens_word = letter & ~((before >= _LATIN) & (before <= _HANGUL))
        self.words = np.bincount(self.sentence[opens_word], minlength=self.count)
        self._letter = letter

    def ngrams(self, which: np.ndarray, size: int, latin: bool) -> tuple[np.ndarray, np.ndarray, int]:
        """Sentence and code of each n-gram of the chosen sentences, and the bits of a code; 0 is a word border."""
        keep = which[self.sentence]
        sentence, symbol = self.sentence[keep], np.where(self._letter[keep], self._symbols[self.chars[keep]], 0)
        if latin:
            symbol = np.where(symbol < 1 << _JOIN, symbol, 0)
        elif not size:
            symbol, size = np.where(symbol != 0, _tables()[0][self.chars[keep]].astype(np.int64), 0), 3
        bits = min(_JOIN * size, HASH_BITS) if latin else OTHER_BITS
        none = np.empty(0, dtype=np.int64)
        if not len(symbol):
            return none, none, bits
        inner = np.append(True, (symbol[1:] != 0) | (symbol[:-1] != 0) | (sentence[1:] != sentence[:-1]))
        sentence, symbol = sentence[inner], symbol[inner]
        n = len(symbol) - size + 1
        if n <= 0:
            return none, none, bits
        code = symbol[:n].copy()
        for k in range(1, size):
            code = code << (_JOIN if latin else _WIDE) | symbol[k : n + k]
        same = sentence[:n] == sentence[size - 1 :]
        if size == 1:
            same = same & (symbol != 0)
        sentence, code = sentence[:n][same], code[same]
        if not latin or _JOIN * size > bits:
            code = ((code * _MIX) & ((1 << 62) - 1)) >> (62 - bits)
        return sentence, code, bits


def _ordered(sentence: np.ndarray, code: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each sentence's n-grams once, with their places in order of frequency, ties by code."""
    keys = np.sort(sentence << bits | code)
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, dtype=np.int64)
    counts = np.diff(np.append(first, len(keys)))
    keys = keys[first]
    sentence, code = keys >> bits, keys & ((1 << bits) - 1)
    if len(keys) and counts.max() > 1:
        order = np.argsort(sentence << 20 | ((1 << 20) - 1 - np.minimum(counts, (1 << 20) - 1)), kind="stable")
        sentence, code = sentence[order], code[order]
    start = np.flatnonzero(np.append(True, sentence[1:] != sentence[:-1])) if len(keys) else np.empty(0, dtype=np.int64)
    place = np.arange(len(sentence)) - np.repeat(start, np.diff(np.append(start, len(sentence))))
    return sentence, code, place


class Profiles:
    """Places of the most frequent n-grams of each language, by the script most of its sentences are in."""

    def __init__(self, samples: Sequence[tuple[str, str]]):
        by: dict[str, list[str]] = {}
        for lang, text in samples:
            by.setdefault(lang, []).append(text)
        #: Languages with a profile in each script.
        self.candidates: dict[int, list[str]] = {script: [] for script in PLACES}
        chosen: dict[int, list[tuple[Sentences, np.ndarray]]] = {script: [] for script in PLACES}
        for lang, texts in sorted(by.items()):
            s = Sentences(texts)
            script = int(np.bincount(s.script, minlength=_HANGUL + 1)[1:].argmax()) + 1
            if script in PLACES:
                self.candidates[script].append(lang)
                chosen[script].append((s, s.script == script))
        self.places = {script: self._fitted(script, rows) for script, rows in chosen.items()}

    @property
    def languages(self) -> list[str]:
        return sorted(lang for names in self.candidates.values() for lang in names)

    @staticmethod
    def _fitted(script: int, chosen: list[tuple[Sentences, np.ndarray]]) -> dict[int, np.ndarray]:
        places = {}
        for size, most in PLACES[script].items():
            rows = [s.ngrams(which, size, script == _LATIN) for s, which in chosen]
            if rows:
                places[size] = np.full((len(rows), 1 << rows[0][2]), most, dtype=np.int16)
            for i, (_, code, bits) in enumerate(rows):
                _, code, place = _ordered(np.zeros(len(code), dtype=np.int64), code, bits)
                places[size][i, code[:most]] = place[:most]
        return places

    def refine(self, samples: Sequence[tuple[str, str]], labelled: Sequence[tuple[str, str]]) -> None:
        """Fit again on clean samples and on the sentences of labelled texts that may be in their language.

        A sentence counts if its label's distance is within ``NEAR`` of the least
        one: that leaves out texts with a wrong label and foreign sentences.
        """
        for script, languages in self.candidates.items():
            chosen = []
            for i, lang in enumerate(languages):
                s = Sentences([text for name, text in [*samples, *labelled] if name == lang])
                mine = s.script == script
                far = self.distances(s, mine, script)
                chosen.append((s, mine & (far[i] <= far.min(axis=0) * NEAR)))
            self.places[script] = self._fitted(script, chosen)

    def distances(self, sentences: Sentences, which: np.ndarray, script: int) -> np.ndarray:
        """Mean out-of-place distance, as a share of the most, of chosen sentences to each candidate of their script."""
        names = self.candidates[script]
        total = np.zeros((len(names), sentences.count))
        number = np.zeros(sentences.count)
        for size, table in self.places[script].items():
            sentence, code, bits = sentences.ngrams(which, size, script == _LATIN)
            sentence, code, place = _ordered(sentence, code, bits)
            most = PLACES[script][size]
            number += np.bincount(sentence, minlength=sentences.count)
            for i in range(len(names)):
                known = table[i][code]
                out = np.where(known == most, most, np.abs(known - place)) / most
                total[i] += np.bincount(sentence, weights=out, minlength=sentences.count)
        return np.where(number > 0, total / np.maximum(number, 1), 1.0)


def classify(profiles: Profiles, texts: Sequence[str | None]) -> tuple[Sentences, np.ndarray, np.ndarray, np.ndarray]:
    """Sentences, the language of each ('' for none), its confidence, and whether it stands on its own.

    The confidence grows with the lead of the nearest profile over the next one,
    or over no language at all, which is as far as can be.
    """
    s = Sentences(texts)
    lang = np.full(s.count, "", dtype="<U3")
    confidence = s.clear.copy()
    for script, names in profiles.candidates.items():
        which = s.script == script
        if not names or not which.any():
            continue
        far = np.vstack([profiles.distances(s, which, script)[:, which], np.ones(which.sum())])
        order = np.argsort(far[:-1], axis=0, kind="stable")[0]
        near = far[order, np.arange(far.shape[1])]
        second = np.sort(far, axis=0)[1]
        lang[which] = np.array(names)[order]
        confidence[which] *= np.clip(0.5 + 5 * (second - near) / np.maximum(second, 1e-9), 0, 1)
    own = s.letters[np.arange(s.count), s.script]
    east = s.script == _HAN
    own = np.where(east, s.letters[:, _KANA] + s.letters[:, _HAN], own)
    least = np.array([1 << 30] + [LEAST[k] for k in (_LATIN, _CYRILLIC, _KANA, _HAN, _HANGUL)])
    latin = s.script == _LATIN
    strong = (lang != "") & (own >= least[s.script]) & (~latin | ((s.words >= 2) & (confidence >= 0.55)))
    return s, lang, confidence, strong


def stretches(profiles: Profiles, texts: Sequence[str | None]) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Row, start, end, language and confidence of each stretch, in order of rows and starts."""
    s, lang, confidence, strong = classify(profiles, texts)
    worded = lang != ""
    has_strong = np.zeros(len(texts), dtype=bool)
    has_strong[s.row[strong]] = True
    used = np.flatnonzero(strong | (worded & ~has_strong[s.row]))
    if not len(used):
        none = np.empty(0, dtype=np.int64)
        return none, {"start": none, "end": none, "lang": lang[:0], "confidence": confidence[:0]}
    row, name = s.row[used], lang[used]
    letters = np.maximum(s.letters[used].sum(1), 1)
    weak_row = ~has_strong[row]
    if weak_row.any():  # all pieces are short: the text has the language most of its letters speak for
        votes = pd.DataFrame({"row": row[weak_row], "lang": name[weak_row], "w": letters[weak_row] * confidence[used][weak_row]})
        votes = votes.groupby(["row", "lang"], sort=True)["w"].sum().reset_index()
        best = votes.loc[votes.groupby("row")["w"].idxmax()].set_index("row")["lang"]
        name = name.copy()
        name[weak_row] = best.reindex(row[weak_row]).to_numpy()
    first = np.append(True, (row[1:] != row[:-1]) | (name[1:] != name[:-1]))
    group = np.cumsum(first) - 1
    total = np.bincount(group, weights=letters)
    score = np.bincount(group, weights=letters * confidence[used]) / total
    heads = np.flatnonzero(first)
    last = np.append(heads[1:], len(used)) - 1
    return row[heads], {"start": s.start[used[heads]], "end": s.end[used[last]], "lang": name[heads], "confidence": np.round(score, 4)}


def bounded_sample(df: DataFrame, key: str, most: int) -> DataFrame:
    """At most ``most`` rows spread over ``df`` by a hash of ``key``; the same at every run.

    The hash alone leaves about ``most`` rows in all tasks together, so what the
    tasks hand to the driver does not grow with the table.
    """
    parts = -(-df.count() // most)
    return df.where(F.pmod(F.xxhash64(key), F.lit(max(1, parts))) == 0).orderBy(F.xxhash64(key), key).limit(most)


def in_slices(sizes: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Neighbouring rows taken together up to ``most`` bytes; a longer row is a slice of its own."""
    ends = np.cumsum(sizes)
    start = 0
    while start < len(sizes):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield start, stop
        start = stop


def fit_profiles(samples: DataFrame, labelled: DataFrame | None = None, most: int = MAX_SAMPLES) -> Profiles:
    """Profiles from ``samples`` (lang, text), refined on labelled texts (key, lang, text) of the corpus.

    Each side is bounded by ``most`` rows.
    """
    rows = samples.select("lang", "text").dropna()
    clean = sorted(tuple(r) for r in rows.orderBy(F.xxhash64("lang", "text"), "lang", "text").limit(most).collect())
    profiles = Profiles(clean)
    if labelled is not None:
        rows = bounded_sample(labelled, "key", most).select("lang", "text").dropna()
        profiles.refine(clean, [tuple(r) for r in rows.where(F.col("lang").isin(profiles.languages)).collect()])
    return profiles


_STRETCH = "array<struct<start:bigint,end:bigint,lang:string,confidence:double>>"


def languages_of(df: DataFrame, profiles: Profiles, text: str, keep: Sequence[str]) -> DataFrame:
    """``keep`` and ``stretches``, the stretches of each text in order.

    Offsets count the code points of the text in composed form (NFC). Columns
    of ``df`` that are not named are dropped before the batches reach Python.
    """
    shared = df.sparkSession.sparkContext.broadcast(profiles)
    rows = df.select(*keep, F.col(text).alias("_text"))
    schema = rows.select(*keep).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        for whole in batches:
            sizes = pc.fill_null(pc.binary_length(whole.column(whole.num_columns - 1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            for start, stop in in_slices(sizes):
                batch = whole.slice(start, stop - start)
                row, found = stretches(fitted, batch.column(batch.num_columns - 1).to_pylist())
                offsets = np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)
                fields = [pa.array(found["start"], pa.int64()), pa.array(found["end"], pa.int64()), pa.array(found["lang"].tolist(), pa.string()), pa.array(found["confidence"], pa.float64())]
                structs = pa.StructArray.from_arrays(fields, ["start", "end", "lang", "confidence"])
                lists = pa.ListArray.from_arrays(pa.array(offsets), structs)
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], lists], [*keep, "stretches"])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    return rows.mapInArrow(run, f"{ddl}, stretches {_STRETCH}")


def mislabelled(df: DataFrame, profiles: Profiles, text: str, label: str, keep: Sequence[str]) -> DataFrame:
    """``keep`` and ``lang``: each language of texts whose label is missing, wrong or one of several."""
    known = languages_of(df.withColumn("_label", label_language(F.col(label))), profiles, text, [*keep, "_label"])
    langs = known.select(*keep, "_label", F.array_distinct(F.transform("stretches", lambda x: x["lang"])).alias("_langs"))
    wrong = F.col("_label").isNull() | ~F.array_contains("_langs", F.col("_label")) | (F.size("_langs") > 1)
    return langs.where((F.size("_langs") > 0) & wrong).select(*keep, F.explode("_langs").alias("lang"))
