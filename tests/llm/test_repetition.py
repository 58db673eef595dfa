import math
import random
import unicodedata
from pathlib import Path

import pytest
import regex
from pyspark.sql import functions as F

from cueweave.llm.repetition import CHANGED, FALSE_REJECTIONS, Bodies, Cutoff, binomial_upper, clean_sentences, content, holdout, repetition, repetition_of, select_cutoffs, table_cutoffs

SENTENCES = [
    "The shop sign is tiny, so nobody could read it.",
    "We only have ten minutes before the bell.",
    "Good morning, Hesper, could you sleep at all?",
    "Vertical lines were rotated before they were read.",
    "Nobody needs the broken watch anymore, trust me.",
    "Hold on tight, we are almost there now.",
    "Who opened that door behind the market?",
    "My cousin plays piano every Thursday evening.",
]


def brute(body, window):
    """Share by marking every place of every repeated window."""
    marked = [False] * len(body)
    for i in range(len(body) - window + 1):
        if body.find(body[i : i + window], 0, i + window - 1) != -1 and body.find(body[i : i + window]) < i:
            marked[i : i + window] = [True] * window
    i = 0
    while i < len(body):
        j = i
        while j < len(body) and not marked[j]:
            j += 1
        if 0 < i and j < len(body) and 0 < j - i <= CHANGED:
            marked[i:j] = [True] * (j - i)
        i = j + 1
    return sum(marked)


def test_places_against_brute_force():
    rnd = random.Random(2)
    bodies = ["".join(rnd.choice("ab" if rnd.random() < 0.5 else "abcdefgh") for _ in range(rnd.randrange(60))) for _ in range(400)]
    for size in (5, 6, 12):
        assert Bodies(bodies).repeated({"letters": size}).tolist() == [brute(b, size) for b in bodies]


def plain_content(text):
    signs = lambda m: x if len(x := regex.sub(r"[\s\p{Z}\p{N}\p{Cc}]+", "", m.group())) >= 8 else ""
    return regex.sub(r"[^\p{L}\p{M}]+", signs, unicodedata.normalize("NFKC", text).casefold())


def test_content_against_plain_form():
    rnd = random.Random(6)
    texts = ["".join(rnd.choice("abÄß ﾊﾟか゛.-=#1\n\t한😀ｱ\u0301") * rnd.choice([1, 1, 1, 9]) for _ in range(rnd.randrange(30))) for _ in range(500)]
    read = Bodies([*texts, None, "", "\0"])
    assert [read.of(i) for i in range(len(texts))] == [plain_content(t) for t in texts]
    assert read.sizes[-3:].tolist() == [0, 0, 0] and [content(t) for t in texts[:50]] == [read.of(i) for i in range(50)]


@pytest.mark.parametrize(
    "text,low,high",
    [
        ("あ" * 200, 0.95, 1),
        ("……" * 100, 0.95, 1),
        ("=" * 90, 0.85, 1),
        ("nono" * 30, 0.85, 1),
        (" ".join(SENTENCES[:1] * 6), 0.8, 0.85),
        ("\n".join(f"{i}. {SENTENCES[0].upper() if i % 2 else SENTENCES[0]}" for i in range(9)), 0.85, 0.95),
        (" ".join(SENTENCES), 0, 0.02),
        (SENTENCES[0] + "." * 200, 0.7, 0.95),
        (None, 0, 0),
        ("", 0, 0),
        ("12 34 ()", 0, 0),
    ],
)
def test_shares(text, low, high):
    places, size, _ = repetition(text)
    assert low <= places / max(1, size) <= high


def test_exact_binomial_bound():
    assert binomial_upper(0, 100, 0.05) == pytest.approx(1 - 0.05 ** (1 / 100), abs=1e-6)
    for k, n in ((1, 20), (3, 50), (10, 40)):
        p = binomial_upper(k, n, 0.05)
        assert sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)) == pytest.approx(0.05, abs=1e-6)
    assert binomial_upper(5, 5, 0.1) == 1


def test_cutoffs_hold_on_fresh_texts():
    cutoffs = select_cutoffs([("x", s) for s in SENTENCES], count=300)
    fresh = [(repetition(t), share) for t, share in holdout(SENTENCES, 600, 99)]
    clean = [(p / n, kind) for (p, n, kind), share in fresh if share <= 0.5]
    wrong = sum(found > cutoffs[kind].share for found, kind in clean)
    assert wrong <= 0.05 * len(clean)
    caught = [p / n > cutoffs[kind].share for (p, n, kind), share in fresh if share > 0.6]
    assert sum(caught) >= 0.95 * len(caught)


def test_table(spark):
    loop = " ".join(SENTENCES[:1] * 8)
    rows = [(1, loop, 80), (2, " ".join(SENTENCES), None), (3, None, 4), (4, "", 4), (5, "na na na na na na na na na", 9), (6, loop, None)]
    df = spark.createDataFrame(rows, "id long, t string, n int").withColumns({"share": F.lit("x"), "tokens": F.lit("y"), "text": F.lit(0)})
    cutoffs = dict.fromkeys(("letters-short", "letters-long", "syllables-short", "syllables-long"), Cutoff(0.5, 0.02))
    got = {r.id: r for r in repetition_of(df, "id", "t", "n", cutoffs).collect()}
    assert [i for i, r in got.items() if r.repeats] == [1, 6]
    assert got[1].repeated_tokens == round(got[1].share * 80) and got[2].repeated_tokens is None and got[3].repeated_tokens == 0
    assert got[5].share > 0 and not got[5].repeats
    assert repetition_of(df.limit(0), "id", "t", "n", cutoffs).count() == 0
    assert content("A-1. b") == "ab"


def test_each_stratum_is_controlled(monkeypatch):
    tried = []
    monkeypatch.setattr("cueweave.llm.repetition.binomial_upper", lambda f, n, e: tried.append(n) or binomial_upper(f, n, e))
    select_cutoffs([("x", s) for s in SENTENCES])
    assert len(set(tried)) == 2 and min(tried) > 2 * 358


def test_without_a_cutoff_there_is_no_decision(spark):
    cutoffs = select_cutoffs([("x", s) for s in SENTENCES])
    assert cutoffs["syllables-long"].share is None and cutoffs["letters-long"].share == 0.5
    df = spark.createDataFrame([(1, "繰り返し" * 60, 3), (2, SENTENCES[0] * 9, 3)], "id long, t string, n int")
    assert {r.id: (r.repeats, r.cutoff) for r in repetition_of(df, "id", "t", "n", cutoffs).collect()} == {1: (None, None), 2: (True, 0.5)}


def test_all_strata_of_the_samples_are_controlled(spark):
    folder = Path("/root/testdata/sf0.001")
    if not folder.exists():
        pytest.skip("no tables here")
    cutoffs = select_cutoffs(clean_sentences(spark.read.parquet(str(folder / "language_samples.parquet")), "lang", "text"))
    assert all(c.share is not None and c.bound <= FALSE_REJECTIONS for c in cutoffs.values()), cutoffs


def test_clean_sentences_leave_no_group_out(spark):
    df = spark.createDataFrame([(g, f"{g} {i}") for g in ("a", "z") for i in range(200)] + [("a", None)], "g string, t string")
    some = clean_sentences(df, "g", "t", 100)
    assert len(some) == 100 and 30 < sum(g == "z" for g, _ in some) < 70


def made_up(count, seed):
    rnd = random.Random(seed)
    return sorted({" ".join("".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=rnd.randrange(3, 9))) for _ in range(7)).capitalize() + "." for _ in range(count)})


def test_every_sentence_is_counted():
    sentences = made_up(3_000, 3)
    few = "\n".join(text for text, share in holdout(sentences, 100, 5) if share <= 0.5)
    assert [s for s in sentences if s not in few] == []


def test_cutoffs_come_from_the_whole_table(spark, monkeypatch):
    """More sentences than one block, or 10,000, holds: each stands in a counted text, and nothing is left to a draw of rows."""
    tried = []
    monkeypatch.setattr("cueweave.llm.repetition.binomial_upper", lambda f, n, e: tried.append(n) or binomial_upper(f, n, e))
    sentences = made_up(12_000, 4)
    df = spark.createDataFrame([("x", s) for s in [*sentences, *sentences[:99]]] + [("x", None), (None, "a")], "g string, t string")
    cutoffs = table_cutoffs(df, "g", "t")
    assert cutoffs["letters-long"].share is not None and cutoffs["syllables-long"] == Cutoff(None, 1.0)
    # No text holds more than 15 sentences.
    assert max(tried) > len(sentences) / 15
    assert len(clean_sentences(df, "g", "t")) == len(sentences) + 99


def test_table_and_list_agree(spark):
    rows = [(g, s) for g in "xy" for s in SENTENCES]
    assert table_cutoffs(spark.createDataFrame(rows, "g string, t string"), "g", "t") == select_cutoffs(rows)
    nothing = table_cutoffs(spark.createDataFrame(rows, "g string, t string").limit(0), "g", "t")
    assert set(nothing.values()) == {Cutoff(None, 1.0)} and len(nothing) == 4
