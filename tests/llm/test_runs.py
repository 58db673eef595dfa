import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cueweave.llm.runs import WORD_SLOTS, WordCounts, collapse_runs, count_words, same_line

SAME = [
    ("Wer hat die Tur imNordturm geöffnet?", "Wer hat die Tür irn Nordturm geöffnet"),
    ("船の中に行けばばロープが手に入る。", "船中に行けばロープが手に入る"),
    ("Quern abriu a poorta?", "Quem \nabriu a porta?"),
    ("ブリッ力がカナル通りで侍つている。", "ブリッカが力ナル通りで待っている"),
    ("SabreIle please check 69", "Sabrelle, please check 69."),
    ("♪ Hold on ♪", "Hold on"),
]
OTHER = [
    ("Quillan est parti avec nous.", "Quillan est parti sans nous."),
    ("昨日港にあった。", "今日港にあった。"),
    ("I did see her there.", "I did not see her there."),
    ("Он знает дорогу.", "Он не знает дорогу."),
    ("我能打开。", "我不能打开。"),
    ("もう63分", "もう61分"),
    ("room 183", "room 83"),
    ("コルベスは時計を持つ", "ヘスペルは時計を持つ"),
    ("Le di a Zindel", "Le di a Ulmina"),
    ("♪～", "★"),
    ("", "a"),
    ("開けられる。", "開けられない。"),
]


@pytest.mark.parametrize("one,two", SAME)
def test_same_line(one, two):
    assert same_line(one, two) and same_line(two, one)


@pytest.mark.parametrize("one,two", OTHER)
def test_other_line(one, two):
    assert not same_line(one, two) and not same_line(two, one)


# What one line says that the other does not is a word: by its contraction, or as both are frequent.
CHANGED = [
    ("I can't go home.", "I can go home."),
    ("We don’t know him.", "We do know him."),
    ("She isn't coming.", "She is coming."),
    ("He is here now.", "She is here now."),
    ("It is unlikely today.", "It is likely today."),
    ("It was hot there.", "It was shot there."),
    ("Il n'a rien vu.", "Il a rien vu."),
    ("Das ist keine Frage.", "Das ist eine Frage."),
]


@pytest.fixture(scope="module")
def counts(spark):
    lines = [x for pair in CHANGED for x in pair] * 20 + ["ead the book", "We read the book"] + ["We read the book"] * 40 + [None, "", "12 !"]
    return count_words(spark.createDataFrame([(x,) for x in lines], "t string"), "t")


@pytest.mark.parametrize("one,two", CHANGED)
def test_changed_word(counts, one, two):
    assert not same_line(one, two, counts) and not same_line(two, one, counts)


def test_lost_letters_are_no_other_word(counts):
    assert same_line("We read the book", "We ead the book", counts) and same_line("It was shot there.", "It was sot there.", counts)
    for one, two in SAME:
        assert same_line(one, two, counts)


def test_word_counts_are_exact_but_for_slots(counts):
    assert counts["likely", "today"] == 20 and counts["ead", "the"] == 1 and counts["today", ""] == 40 and counts["likely", "is"] == 0
    full = WordCounts(np.full(WORD_SLOTS, 7.0))
    assert full["any", ""] == 0 and not full.both_words(("any", ""), ("many", ""))


def test_equal_without_letters_and_long_texts():
    assert same_line("12:30", "12:30") and not same_line("12:30", "12.30")
    long = "ab cd ef " * 5000
    assert same_line(long, long + "x") and not same_line(long, "zz " + long + " 7")


def brute(rows, pause):
    keep = sorted({r[:5] for r in rows if r[1] is not None and r[2] is not None and r[2] > r[1] and r[4] and r[4].strip()}, key=lambda r: (repr(r[0]), r[1], r[3]))
    runs = []
    for r in keep:
        last = runs[-1][-1] if runs else None
        if last and last[0] == r[0] and r[1] <= last[2] + pause and same_line(last[4], r[4]):
            runs[-1].append(r)
        else:
            runs.append([r])
    return {(x[0][0], x[0][3], x[-1][3], len(x), x[0][1], x[-1][2]) for x in runs}


def test_runs_against_brute_force(spark):
    rnd = random.Random(5)
    texts = ["Hold on tight", "Hold on tiqht", "Hold on, tight!", "Let go", " ", None, "12", "今日港", "昨日港"]
    rows, t = [], 0
    for i in range(400):
        t += rnd.choice([0, 100, 900, 3_000])
        rows.append((rnd.choice(["k", "k", None]), rnd.choice([t, t, None]) if i % 9 == 0 else t, t + rnd.choice([-1, 0, 700, 1_500, 90_000]), i, rnd.choice(texts)))
    rows += rnd.sample(rows, 40)
    df = spark.createDataFrame(rows, "k string, s long, e long, id long, t string").withColumns({"_b": F.lit(1), "rows": F.lit("x"), "text": F.lit(2), "cont": F.lit(0)})
    for width in (1_000, 600_000):
        got = {(r.k, r.first_id, r.last_id, r.rows, r.start_ms, r.end_ms) for r in collapse_runs(df, ["k"], "s", "e", "id", "t", 2_000, width).collect()}
        assert got == brute(rows, 2_000)
    assert all(r.duration_ms == r.end_ms - r.start_ms for r in collapse_runs(df, ["k"], "s", "e", "id", "t").collect())
    assert collapse_runs(df.limit(0), ["k"], "s", "e", "id", "t").count() == 0
