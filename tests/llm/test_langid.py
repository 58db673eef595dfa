import pytest
from pyspark.sql import functions as F

from cueweave.llm.langid import Profiles, bounded_sample, in_slices, label_language, languages_of, mislabelled, stretches

CLEAN = {
    "en": ["Who opened the door at the old station?", "I always believed what they told me.", "We only have ten minutes before the bell rings.", "The line of the song is missing in this file."],
    "de": ["Wer hat die Tür am alten Bahnhof geöffnet?", "Ich habe immer geglaubt, was man mir sagte.", "Uns bleiben nur noch zehn Minuten bis zur Prüfung.", "Die Zeile des Liedes fehlt in dieser Datei."],
    "fr": ["Qui a ouvert la porte à la vieille gare ?", "J'ai toujours cru ce qu'on m'a dit.", "Il ne reste que dix minutes avant la cérémonie.", "La ligne de la chanson manque dans ce fichier."],
    "ja": ["誰が古い駅のドアを開けたの？"],
    "zh": ["是谁在老车站打开了这扇门？"],
    "ko": ["누가 옛 역에서 문을 열었지?"],
    "ru": ["Кто открыл дверь на старой станции?"],
}
SAMPLES = [(lang, text) for lang, texts in CLEAN.items() for text in texts]


@pytest.fixture(scope="module")
def profiles():
    found = Profiles(SAMPLES)
    assert found.languages == sorted(CLEAN) and sum(map(len, found.candidates.values())) == len(CLEAN)
    return found


def found(profiles, text):
    row, out = stretches(profiles, [text])
    return [(text_slice, str(lang)) for text_slice, lang in zip([text[a:b].strip() for a, b in zip(out["start"], out["end"])], out["lang"])]


def test_each_language(profiles):
    for lang, texts in CLEAN.items():
        for text in texts:
            assert [x for _, x in found(profiles, text)] == [lang]


def test_mixed_texts_come_in_stretches(profiles):
    text = "Who opened the door at the station? 誰が駅のドアを開けたの？\nEr war gestern nicht in dieser Prüfung am Bahnhof."
    assert found(profiles, text) == [("Who opened the door at the station?", "en"), ("誰が駅のドアを開けたの？", "ja"), ("Er war gestern nicht in dieser Prüfung am Bahnhof.", "de")]
    assert [x for _, x in found(profiles, "原題は「Der stille Kanal」だと言っていた。")] == ["ja"]
    assert [x for _, x in found(profiles, "塔姆辛说原来的片名是《鏡の島》。")] == ["zh"]
    assert [x for _, x in found(profiles, "Wһo оpened the dооr at the station?")] == ["en"]


def test_nothing_without_words(profiles):
    for text in (None, "", " \n", "♪～", "12:30", "……"):
        assert stretches(profiles, [text])[0].size == 0
    assert [x for _, x in found(profiles, "はい")] == ["ja"]
    row, out = stretches(profiles, [None, "a" * 100_000 + ".", "Ты кто?", ""])
    assert row.tolist()[-1] == 2 and all(0 < c <= 1 for c in out["confidence"])


def test_labels(spark):
    labels = ["ja", "JA", "jpn", "ja-JP", "Japanese", "pt-BR", "zh_CN", "ger", "fre", "und", "xx", "", " ", None, "n/a", "unknown", "Russian"]
    df = spark.createDataFrame([(x,) for x in labels], "l string")
    assert [r[0] for r in df.select(label_language(F.col("l"))).collect()] == ["ja"] * 5 + ["pt", "zh", "de", "fr"] + [None] * 7 + ["ru"]


def test_mislabelled_rows(spark, profiles):
    en, ja = CLEAN["en"][0], CLEAN["ja"][0]
    rows = [(1, en, "en-US"), (2, en, "ja"), (3, en, None), (4, f"{en}\n{ja}", "en"), (5, "♪", None), (6, None, "en"), (7, ja, "Japanese"), (8, ja, "xx")]
    df = spark.createDataFrame(rows, "id long, text string, l string").withColumns({"_text": F.lit(0), "stretches": F.lit("clash"), "_label": F.lit(1), "lang": F.lit(2)})
    got = sorted(tuple(r) for r in mislabelled(df, profiles, "text", "l", ["id"]).collect())
    assert got == [(2, "en"), (3, "en"), (4, "en"), (4, "ja"), (8, "ja")]
    spans = languages_of(df, profiles, "text", ["id"]).where("id = 4").first().stretches
    assert [(s.start, s.end, s.lang) for s in spans] == [(0, len(en), "en"), (len(en) + 1, len(en) + 1 + len(ja), "ja")]
    assert mislabelled(df.limit(0), profiles, "text", "l", ["id"]).count() == 0


def test_refined_profiles_ignore_wrong_labels(profiles):
    again = Profiles(SAMPLES)
    again.refine(SAMPLES, [("en", "They asked where the captain went."), ("en", CLEAN["fr"][1]), ("de", "Niemand braucht das noch.")])
    assert [x for _, x in found(again, CLEAN["fr"][1])] == ["fr"]


def test_distances_decide_in_every_script():
    """Ideographs alone are told apart; a script without a profile has no language; a strange language is less sure."""
    samples = [("ja", "彼女は東京駅前の図書館で新聞を毎日読む。"), ("zh", "她每天在北京图书馆看报纸，这是她说的。"), ("ru", CLEAN["ru"][0]), ("ru", "Она каждый день читает газету в библиотеке.")]
    fitted = Profiles(samples)
    assert [x for t in ("東京駅前図書館", "她说这是报纸") for _, x in found(fitted, t)] == ["ja", "zh"]
    assert found(fitted, "누가 옛 역에서 문을 열었지?") == []
    sure = [stretches(fitted, [t])[1]["confidence"][0] for t in (CLEAN["ru"][0], "Її їжачок їв ґречні ґудзики, щоб з’їсти їх.")]
    assert sure[0] > sure[1] < 1


def test_bounded_sample(spark):
    df = spark.range(5000).withColumnRenamed("id", "key")
    taken = bounded_sample(df, "key", 100)
    assert 50 < taken.count() <= 100 and sorted(taken.collect()) == sorted(bounded_sample(df, "key", 100).collect())
    assert bounded_sample(df.limit(0), "key", 5).count() == 0


def test_held_out_accuracy():
    from pathlib import Path

    path = Path("/root/testdata/sf0.001/language_samples.parquet")
    if not path.exists():
        pytest.skip("no tables here")
    import pyarrow.parquet as pq

    rows = pq.read_table(path).to_pydict()
    pairs = sorted(zip(rows["lang"], rows["text"]))
    fitted = Profiles(pairs[::2])
    held = pairs[1::2]
    row, out = stretches(fitted, [t for _, t in held])
    first = {}
    for r, lang in zip(row.tolist(), out["lang"]):
        first.setdefault(r, str(lang))
    assert sum(first.get(i) == lang for i, (lang, _) in enumerate(held)) >= 0.95 * len(held)


def test_slices_cover_all_rows():
    import numpy as np

    for sizes in ([], [0], [5, 5, 5], [100, 1, 1], [1, 100, 1], [0, 0, 0]):
        spans = list(in_slices(np.array(sizes, dtype=np.int64), 10))
        assert [i for a, b in spans for i in range(a, b)] == list(range(len(sizes)))
        assert all(sum(sizes[a:b]) <= 10 or b - a == 1 for a, b in spans)
