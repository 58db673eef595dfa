"""Texts that look the same brought to one consistent form.

A transducer over grapheme clusters is compiled once, on the driver, from a
precomputed mapping (widths, blanks, invisible characters, letters of the same
shape, accents and their composition) and applied in one pass by longest match.
A cluster of several code points that is met for the first time is composed and
kept, up to ``KEPT_CLUSTERS``. The mapping is checked at compile time: no input
has two outputs, and outputs map to themselves.

Letters of the same shape come from the table of Unicode's confusable characters
in the ICU library that Spark brings, as far as one letter stands for one Latin
letter of its case; see ``confusable_letters``.

Defined cases: null gives null; empty text stays empty; line ends become LF;
blanks at the ends of lines, which nobody sees, go. Case, accents, voicing
marks, small kana and punctuation stay, as a reader sees them.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator, Mapping, Sequence
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stage

# Letters of the same shape, each pair the other letter and the one it becomes.
SAME_SHAPE = (
    "аa еe оo рp сc хx уy іi јj ѕs һh ԁd ԛq ԝw "
    "АA ВB ЕE КK МM НH ОO РP СC ТT УY ХX ІI ЈJ ЅS ԚQ ԜW ҮY "
    "ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX οo νv ρp ϲc ϳj κк "
    "エ工 ロ口 カ力 タ夕 ト卜 ニ二 ハ八 ー一 ノ丿 ヘへ オ才 ム厶 "
    "‐- ‑- −- 〜~ ʼ' ∶: ․. ‚, "
)
# Letters that the public table takes for a Latin one, though a reader can tell them.
APART = "г ґ α γ ι σ υ ա ӏ Ь ᴦ ꮁ ⲅ ε"
#: Scripts whose letters are compared among themselves only.
OWN_SHAPES = ("LATIN", "CJK", "HIRAGANA", "KATAKANA", "KATAKANA-HIRAGANA", "HANGUL", "HALFWIDTH", "FULLWIDTH", "MODIFIER", "KANGXI", "BOPOMOFO")
#: Clusters of several code points whose form a transducer keeps; the store is emptied when full.
KEPT_CLUSTERS = 50_000
#: Kana and ideographs are listed kana first, as the kana is the form they become.
_KANA_FIRST = regex.compile(r"[\p{Katakana}ー][\p{Han}\p{Hiragana}]")

_WIDTHS = {"<wide>", "<narrow>", "<font>", "<noBreak>"}
_COMPAT = regex.compile(r"[⺀-⿟ﬀ-ﬆⅠ-ⅿ․-…]")
_INVISIBLE = regex.compile(r"[\p{Default_Ignorable_Code_Point}\p{Cc}--[\n\r\t\v\f\x85]]", regex.V1)
_BLANK = regex.compile(r"[\p{Zs}\t⠀]")
_BREAK = regex.compile(r"[\v\f\x85  ]")
_CLUSTER = regex.compile(r"\X")
_EMOJI = regex.compile(r"\p{Extended_Pictographic}")
_COMBINES = regex.compile(r"[\p{M}ᄀ-ᇿꥠ-꥿ힰ-퟿]")
_LINE_EDGE = regex.compile(r" *\n *")


def shape_pairs() -> dict[str, str]:
    pairs: dict[str, str] = {}
    for pair in SAME_SHAPE.split():
        other, becomes = (pair[1], pair[0]) if _KANA_FIRST.fullmatch(pair) else (pair[0], pair[1])
        if pairs.setdefault(other, becomes) != becomes:
            raise ValueError(f"two forms for {other!r}")
    return pairs


def confusable_letters(spark: SparkSession) -> dict[str, str]:
    """Letters of other scripts and the one Latin letter of the same shape, by ICU's table.

    Left out are letters of right-to-left scripts and of those in ``OWN_SHAPES``,
    letters whose case differs, what looks like ``l`` (which the table does not
    tell from ``I`` and ``1``), and ``APART``. Raises where Spark has no ICU:
    without the table, texts that look the same would silently stay apart.
    """
    try:
        checker = spark.sparkContext._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
    except TypeError as missing:  # a class that is not there comes as a package, which cannot be called
        raise RuntimeError("no com.ibm.icu.text.SpoofChecker on the driver's class path (the icu4j jar that Spark brings)") from missing
    others = [ch for c in range(0x80, 0x20000) if unicodedata.category(ch := chr(c)) in ("Lu", "Ll", "Lo") and unicodedata.bidirectional(ch) == "L" and unicodedata.name(ch, "").split(" ")[0] not in OWN_SHAPES]
    others = [ch for ch in others if unicodedata.normalize("NFKD", ch) == ch]
    found = dict(zip(others, checker.getSkeleton("\n".join(others)).split("\n"), strict=True))
    apart = set(APART.split())
    known = shape_pairs()
    return {
        other: to
        for other, to in found.items()
        if len(to) == 1 and to.isascii() and to.isalpha() and to != "l" and other not in apart and other not in known and other.isupper() <= to.isupper() and other.islower() <= to.islower()
    } | {"ɡ": "g"}


class LookalikeTransducer:
    """Longest-match transducer over grapheme clusters."""

    def __init__(self, rules: dict[tuple[str, ...], str], fold: dict[str, str]):
        self._fold = fold
        self._root: dict = {}
        self._single: dict[str, str] = {}
        #: Clusters without a look of their own; they part nothing that belongs together.
        self._dropped = frozenset(source[0] for source, target in rules.items() if len(source) == 1 and not target)
        for source, target in rules.items():
            self._add(source, target)
        self._check(rules)
        combining = _COMBINES.findall("".join(map(chr, range(0x300, 0xD800))) + "".join(map(chr, range(0xE000, 0x30000))))
        self._touched = frozenset(ch for source in rules for cluster in source for ch in cluster).union(combining)

    def _add(self, source: tuple[str, ...], target: str) -> None:
        node = self._root
        for cluster in source:
            node = node.setdefault(cluster, {})
        if node.setdefault(None, target) != target:
            raise ValueError(f"conflicting rules for {source!r}")

    def _check(self, rules: dict[tuple[str, ...], str]) -> None:
        for source, target in rules.items():
            if self._run(target) != target:
                raise ValueError(f"rule for {source!r} is not stable: {target!r}")

    def _derive(self, cluster: str) -> str:
        """Output of a cluster of several code points, kept for later."""
        known = self._single.get(cluster)
        if known is None:
            if _EMOJI.match(cluster):
                known = cluster
            else:
                known = compose("".join(self._root[ch][None] if ch in self._root and None in self._root[ch] else ch for ch in cluster), self._fold)
            if len(self._single) >= KEPT_CLUSTERS:
                self._single.clear()
            self._single[cluster] = known
        return known

    def _run(self, text: str) -> str:
        dropped, root = self._dropped, self._root
        clusters = [c if len(c) == 1 or c in root else self._derive(c) for c in _CLUSTER.findall(text) if c not in dropped]
        out, i, n = [], 0, len(clusters)
        while i < n:
            node, j, best, end = root, i, None, i + 1
            while j < n and (node := node.get(clusters[j])) is not None:
                j += 1
                if None in node:
                    best, end = node[None], j
            out.append(clusters[i] if best is None else best)
            i = end
        joined = "".join(out)
        return joined if unicodedata.is_normalized("NFC", joined) else compose(joined, self._fold)

    def __call__(self, text: str) -> str:
        if self._touched.isdisjoint(text) and " \n" not in text and "\n " not in text and text.strip(" ") == text:
            return text
        return _LINE_EDGE.sub("\n", self._run(text)).strip(" ")


def compose(text: str, fold: dict[str, str]) -> str:
    """Base letters folded under their marks, then composed."""
    return unicodedata.normalize("NFC", "".join(fold.get(ch, ch) for ch in unicodedata.normalize("NFD", text)))


def precompute(letters: Mapping[str, str] | None = None) -> tuple[dict[tuple[str, ...], str], dict[str, str]]:
    """The mapping of every code point that changes, and of the sequences that do, with ``letters`` of one shape added."""
    fold = dict(letters or {}) | shape_pairs()
    every = "".join(map(chr, range(0xD800))) + "".join(map(chr, range(0xE000, 0x110000)))
    invisible, blanks, breaks = set(_INVISIBLE.findall(every)), set(_BLANK.findall(every)), set(_BREAK.findall(every))

    def shape(ch: str) -> str:
        if ch in invisible:
            return ""
        if ch in blanks:
            return " "
        if ch in breaks:
            return "\n"
        kind, _, rest = unicodedata.decomposition(ch).partition(" ")
        if kind in _WIDTHS or kind == "<compat>" and _COMPAT.match(ch):
            return compose("".join(shape(chr(int(x, 16))) for x in rest.split()), fold)
        return compose(ch, fold)

    changing = [*invisible, *blanks, *breaks, *fold, *(ch for ch in every if unicodedata.decomposition(ch))]
    rules = {(ch,): form for ch in sorted(set(changing)) if (form := shape(ch)) != ch}
    rules |= {("\r\n",): "\n", ("\r",): "\n"}
    for mark, spacing in (("゙", "゛"), ("゚", "゜")):
        for c in range(0x3041, 0x30FF):
            joined = compose(chr(c) + mark, fold)
            if len(joined) == 1:
                rules[(chr(c), spacing)] = joined
    return rules, fold


@lru_cache(maxsize=1)
def transducer() -> LookalikeTransducer:
    """One without the letters of ICU, for text that is only read by other operators."""
    return LookalikeTransducer(*precompute())


def consistent_form(spark: SparkSession, column: str) -> Column:
    """The form of a text column: compiled on the driver, its size fixed by Unicode, and broadcast."""
    shared = spark.sparkContext.broadcast(LookalikeTransducer(*precompute(confusable_letters(spark))))

    @F.pandas_udf(T.StringType())
    def form(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        run = shared.value
        for texts in parts:
            yield texts.map(run, na_action="ignore")

    return form(column)


def with_form(df: DataFrame, groups: Sequence[str], row_id: str, text: str) -> DataFrame:
    """``groups``, ``_id``, ``_text`` and ``_form`` of the rows that may look like others, staged."""
    rows = df.select(*groups, F.col(row_id).alias("_id"), F.col(text).alias("_text")).dropna()
    rows = rows.withColumn("_form", consistent_form(df.sparkSession, "_text")).where(F.length(F.trim("_form")) > 0)
    return stage(rows, "consistent-forms")


def same_look_classes(df: DataFrame, groups: Sequence[str], row_id: str, text: str) -> DataFrame:
    """One row per row of a class of texts that look the same: groups, id, class_id, links.

    A class is all rows of one group and form of which at least two texts differ;
    ``class_id`` is its least id and ``links`` the number of rows whose text is
    another one. No pair is formed, so a form of any number of rows is a sum by
    (form, text) and then by form. Left out rows as in ``same_look_pairs``.
    """
    kind = df.schema[row_id].dataType.simpleString()
    rows = with_form(df, groups, row_id, text).withColumn("_key", F.struct(*groups, F.sha2("_form", 256).alias("f"))).withColumn("_own", F.sha2("_text", 256))
    rows = rows.select("_key", "_own", "_id").distinct()
    texts = rows.groupBy("_key", "_own").agg(F.count("*").alias("_n"), F.min("_id").alias("_least"))
    forms = texts.groupBy("_key").agg(F.sum("_n").alias("_all"), F.min("_least").alias("class_id"), F.count("*").alias("_texts")).where("_texts > 1")
    found = rows.join(texts.select("_key", "_own", "_n"), ["_key", "_own"]).join(forms, "_key")
    return found.select(*[F.col(f"_key.{g}").alias(g) for g in groups], F.col("_id").cast(kind).alias("id"), "class_id", (F.col("_all") - F.col("_n")).alias("links"))


def same_look_pairs(df: DataFrame, groups: Sequence[str], row_id: str, text: str) -> DataFrame:
    """Pairs of rows of one group whose texts look the same but differ: groups, id_a, id_b.

    Null and blank texts and null groups form no pairs; repeated rows of an id
    count once. Only forms with two or more different texts go on, found by the
    map-side combined least and greatest digest of their texts; different texts of a form are paired
    first and rows after, so equal texts, however many, are never compared.
    """
    rows = with_form(df, groups, row_id, text)
    by = [*groups, "_form"]
    # Digests of fixed size tell forms of several texts from the many of one; the texts themselves stay behind.
    rows = rows.withColumn("_key", F.xxhash64("_form"))
    rows = rows.withColumns({"_long": F.xxhash64("_text"), "_short": F.hash("_text")})
    digests = [f(c).alias(f"_{f.__name__}{c}") for c in ("_long", "_short") for f in (F.min, F.max)]
    varied = rows.groupBy(*groups, "_key").agg(*digests).where("_min_long <> _max_long or _min_short <> _max_short")
    rows = rows.join(varied.select(*groups, "_key"), [*groups, "_key"], "left_semi").select(*by, "_id", "_text").distinct()
    rows = stage(rows, "varied-forms")
    texts = rows.select(*by, "_text").distinct()
    one = texts.withColumnRenamed("_text", "_one")
    two = texts.withColumnRenamed("_text", "_two")
    pairs = one.join(two, by).where("_one < _two")
    left = rows.select(*by, F.col("_text").alias("_one"), F.col("_id").alias("_left"))
    right = rows.select(*by, F.col("_text").alias("_two"), F.col("_id").alias("_right"))
    both = pairs.join(left, [*by, "_one"]).join(right, [*by, "_two"]).where("_left <> _right")
    return both.select(*groups, F.least("_left", "_right").alias("id_a"), F.greatest("_left", "_right").alias("id_b")).distinct()
