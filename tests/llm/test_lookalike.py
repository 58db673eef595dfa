import itertools
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from cueweave.llm.lookalike import KEPT_CLUSTERS, LookalikeTransducer, confusable_letters, consistent_form, precompute, same_look_classes, same_look_pairs, transducer

SAME = [
    ("ﾊｷﾃﾞ､５９番｡", "ハキデ、59番。"),
    ("Wοrt Ηas", "Wort Has"),
    ("Вakа", "Baka"),
    ("Brücke", "Brücke"),
    ("a b c　d", "a b c d"),
    ("l‍atón﻿­", "latón"),
    ("⼀⼈", "一人"),
    ("ヘベ", "へべ"),
    ("한국", "한국"),
    ("か゛", "が"),
    ("e​́", "é"),
    ("a\r\nb ", "a\nb"),
    ("ё", "ë"),
]
APART = [("Abc", "abc"), ("か", "が"), ("つ", "っ"), ("e", "é"), ("a.", "a,"), ("a b", "ab"), ("x²", "x2"), ("l", "I"), ("1", "l"), ("、", "。"), ("a\nb", "a b"), ("½", "1/2")]


@pytest.mark.parametrize("one,two", SAME)
def test_same_look(one, two):
    assert transducer()(one) == transducer()(two)


@pytest.mark.parametrize("one,two", APART)
def test_different_look(one, two):
    assert transducer()(one) != transducer()(two)


def test_stable_and_one_pass():
    run, rnd = transducer(), random.Random(4)
    alphabet = "aeоеВｱﾞか゛゙ ​́　한ᄀ­1\n🙂👩‍👩‍👧🏽"
    for _ in range(3000):
        text = "".join(rnd.choice(alphabet) for _ in range(rnd.randrange(12)))
        once = run(text)
        assert run(once) == once and unicodedata.is_normalized("NFC", once)
    assert run("👩‍👩‍👧") == "👩‍👩‍👧" and run("") == ""
    assert run("a" * 200_000 + "​") == "a" * 200_000


def test_conflicts_are_found():
    with pytest.raises(ValueError, match="not stable"):
        LookalikeTransducer({("a",): "b", ("b",): "c"}, {})
    longest = LookalikeTransducer({("x",): "1", ("x", "y"): "2"}, {})
    assert longest("xyx") == "21"


def brute(rows):
    out = set()
    items = sorted({r for r in rows if None not in r})
    for (g, i, a), (h, j, b) in itertools.combinations(items, 2):
        if g == h and a != b and transducer()(a) == transducer()(b) and transducer()(a).strip() and i != j:
            out.add((g, min(i, j), max(i, j)))
    return out


def test_pairs_against_brute_force(spark):
    rnd = random.Random(8)
    forms = ["abc", "аbc", "abс", "Abc", "ｱﾞ x", "ア゙ x", " ", "​", "", None, "same", "same­"]
    rows = [(rnd.choice(["g", "g", "h", None]), i, rnd.choice(forms)) for i in range(160)]
    rows += rnd.sample(rows, 30)
    df = spark.createDataFrame(rows, "g string, id long, t string").withColumns({"_id": F.lit(1), "_text": F.lit("x"), "_form": F.lit("y"), "loaded_at": F.rand()})
    got = [tuple(r) for r in same_look_pairs(df, ["g"], "id", "t").collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)
    assert same_look_pairs(df.limit(0), ["g"], "id", "t").count() == 0


def test_column_keeps_null(spark):
    df = spark.createDataFrame([(None,), ("Ａ",)], "t string")
    assert [r[0] for r in df.select(consistent_form(spark, "t")).collect()] == [None, "A"]


def test_confusable_letters(spark):
    letters = confusable_letters(spark)
    run = LookalikeTransducer(*precompute(letters))
    for other, latin in ("օo", "ոn", "ɡg", "ᎪA", "ᎳW", "ꓐB", "ⲟo", "ѵv", "ʟʟ"):
        assert run(f"x{other}y") == f"x{latin}y"
    for apart in ("l", "I", "1", "г", "α", "σ", "ı", "б", "ß", "é", "日", "カ", "한"):
        assert run(apart) == apart
    assert all(len(to) == 1 and to.isascii() and to.isalpha() for to in letters.values()) and len(letters) > 100
    for one, two in SAME:
        assert run(one) == run(two)
    for one, two in APART:
        assert run(one) != run(two)
    for text in letters:
        assert run(run(text)) == run(text)


class _Jvm:
    """Packages without classes, as py4j gives them, or with a checker that answers ``skeleton``."""

    def __init__(self, skeleton=None):
        self._skeleton = skeleton

    def __getattr__(self, name):
        return self

    def __call__(self, *args):
        if self._skeleton is None:
            raise TypeError("'JavaPackage' object is not callable")
        return self._skeleton if args else self


@pytest.mark.parametrize("jvm,error", [(_Jvm(), RuntimeError), (_Jvm("a\nb"), ValueError)])
def test_without_the_table_there_are_no_letters(jvm, error):
    """No ICU, or skeletons of other letters than were asked for, is a failure and not a table without letters."""
    session = type("Session", (), {"sparkContext": type("Context", (), {"_jvm": jvm})})
    with pytest.raises(error):
        confusable_letters(session)


def test_kept_clusters_are_bounded():
    run = LookalikeTransducer(*precompute())
    for i in range(KEPT_CLUSTERS + 500):
        run("x" + chr(0x300 + i % 60) + chr(0x300 + i // 60 % 60) + chr(0x300 + i // 3600 % 60))
    assert len(run._single) <= KEPT_CLUSTERS


def test_classes(spark):
    """A form held by 100,000 rows, one of them in other characters: no pair is needed to say so."""
    hot = spark.range(100_000).select(F.lit("g").alias("g"), "id", F.when(F.col("id") == 77, "аbc").otherwise("abc").alias("t"))
    few = spark.createDataFrame([("h", 1, "ab"), ("h", 2, "ab"), ("h", 3, "ab\u200b"), ("h", 4, "аb"), ("h", 4, "аb"), ("h", 5, None), ("h", 6, " "), (None, 7, "ab")], "g string, id long, t string")
    got = {(r.g, r.id): (r.class_id, r.links) for r in same_look_classes(hot.unionByName(few), ["g"], "id", "t").where("g = 'h' or id in (3, 77)").collect()}
    assert got == {("g", 3): (0, 1), ("g", 77): (0, 99_999), ("h", 1): (1, 2), ("h", 2): (1, 2), ("h", 3): (1, 3), ("h", 4): (1, 3)}
    assert same_look_classes(few.limit(0), ["g"], "id", "t").count() == 0
