from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from cueweave.llm.moderation import THRESHOLD, VERDICTS, Ftrl, features_of, fit, judged_sample, moderate, numberless, passages, rates, spelled, train, words_of
from cueweave.llm.moderation_patterns import filled, pattern_passages, plain_sentences
from cueweave.llm.moderation_phrases import ordinary_sentences, phrases

TABLES = Path("/root/testdata")


def table(scale: str, name: str) -> dict:
    import pyarrow.parquet as pq

    path = TABLES / scale / f"{name}.parquet"
    if not path.exists():
        pytest.skip("no tables here")
    return pq.read_table(path).to_pydict()


@pytest.fixture(scope="module")
def model():
    return train(list(phrases()), ordinary_sentences())


def test_one_spelling():
    assert spelled("n u d e") == spelled("n-u-d-e") == "nude"
    for form in ("1d1ot", "iiidiiooot", "IDIOT", "іdiot", "ｉｄｉｏｔ", "i.d.i.o.t"):
        assert words_of(form) == ["idiot"]
    assert words_of("b@$t@rd") == ["bastard"] and words_of("12 rooms") == ["#", "roms"]
    assert words_of("死ね") == ["死", "ね"] and words_of("") == []


def test_spelling_of_capitals_and_syllables():
    """Capitals that look like Latin letters, and letters or syllables set apart, make no other words."""
    assert words_of("НЕНАВИЖУ ВОРОВ") == words_of("ненавижу воров") == words_of("Ненавижу Воров")
    assert words_of("В@STARD") == words_of("Вastard") == ["bastard"]
    for apart in ("i*d*i*o*t", "i/d/i/o/t", "i-d-i-o-t"):
        assert words_of(apart) == ["idiot"]
    assert words_of("바 보 자 식") == words_of("바보자식") and words_of("이 집 밖") == ["이집밖"] and words_of("그 사람") == ["그", "사람"]


def test_masked_words(model):
    assert "fucked" in words_of("they f****d all night", model.masks) and words_of("x****z", {}) == ["<masked>"]


def test_weights_learn_and_stay_sparse():
    learner = Ftrl(4, l1=1.0)
    for _ in range(30):
        learner.learn(np.array([0, 1]), np.array([1.0]))
        learner.learn(np.array([1, 2]), np.array([0.0]))
    learner.learn(np.array([3]), np.array([1.0]))
    weights = learner.weights()[:, 0]
    assert weights[0] > 0 > weights[2] and abs(weights[1]) < weights[0] and weights[3] == 0


def test_features():
    row, feature = features_of([["a", "b", "c", "d"], [], ["a", "b"], ["a", "a", "a"]])
    # four words, three pairs, two triples, two and one skips; two words and a pair; a word, a pair, a triple and a skip
    assert np.bincount(row, minlength=4).tolist() == [12, 0, 3, 4]
    assert set(feature[row == 2]) <= set(feature[row == 0])
    row, _ = features_of([["a", "b"], ["a", "x"]], {"a", "b"})
    assert np.bincount(row, minlength=2).tolist() == [0, 2]


def test_phrases_stand_in_no_table():
    """What the model is trained on by hand must not come from what it is measured on."""
    ours = {" ".join(words_of(p)) for p in [*(p for p, _ in phrases()), *ordinary_sentences()]}
    for scale in ("sf0.001", "sf0.01", "sf0.1"):
        texts = [t for t in table(scale, "documents")["text"] if t]
        assert not ours & {" ".join(words_of(p)) for p in {numberless(p) for t in texts for p in passages(t)}}


def test_unseen_judged_examples(model):
    """The phrases alone, without any judged example, tell half of them."""
    judged = table("sf0.001", "moderation_examples")
    rows = sorted(set(zip(judged["text"], judged["verdict"])))
    scores = model.scores([t for t, _ in rows])[0] >= THRESHOLD
    harmful = np.array([v in VERDICTS for _, v in rows])
    assert scores[harmful].mean() >= 0.5 and scores[~harmful].mean() <= 0.02


def test_threshold_on_other_lines(model):
    """Lines of subtitles, which are not what is scored: fewer than one in a thousand may reach the threshold."""
    lines = {numberless(p) for t in table("sf0.01", "cues")["text"] if t for p in passages(t)}
    assert (model.scores(sorted(lines))[0] >= THRESHOLD).mean() < 0.001


def test_judged_sample(spark):
    rows = spark.createDataFrame([(f"t{i}", "none" if i % 2 else "abusive") for i in range(400)] + [(None, "none")], "text string, verdict string")
    some = judged_sample(rows, ["text", "verdict"], 100)
    assert len(some) == 100 == len(set(some)) and some == judged_sample(rows.orderBy(F.rand()), ["text", "verdict"], 100)
    assert 30 < sum(v == "none" for _, v in some) < 70 and len(judged_sample(rows, ["text"], 1_000)) == 400


def test_harmless_use(model):
    for text in ("Kill the process and start it once more.", "The bastard title page comes first.", "裸眼では違いが分からない。"):
        assert model.score(text) < THRESHOLD < model.score("You stupid bastard, shut the fuck up and die.")


def test_table_and_rates(spark):
    judged = spark.createDataFrame([("You idiot.", "abusive"), ("Nice weather.", "none"), (None, "none"), ("x", None)], "text string, verdict string")
    model = fit(judged, spark.createDataFrame([("The weather is nice.",), ("We walk to the market.",), (None,)], "text string"))
    docs = [(1, "We walk to the market.\nShut the fuck up, you worthless idiot.", "a"), (2, "We walk to the market.", "a"), (3, None, "b"), (4, " \n", None), (5, "They fucked naked all night on the carpet. The weather is nice.", None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumns({"score": F.lit("clash"), "_text": F.lit(1), "verdict": F.lit(2)})
    out = moderate(df, model, "text", ["doc_id", "source"])
    got = {r.doc_id: (r.verdict, r.harmful) for r in out.collect()}
    assert got == {1: ("abusive", 1), 2: ("none", 0), 3: ("none", 0), 4: ("none", 0), 5: ("sexual", 1)}
    by = {r.source: (r.texts, r.harmful_texts, r.rate) for r in rates(out, "source").collect()}
    assert by == {"a": (2, 1, 0.5), "b": (1, 0, 0.0), None: (2, 1, 0.5)}
    assert moderate(df.limit(0), model, "text", ["doc_id"]).count() == 0
    long = spark.createDataFrame([(1, "word " * 100_000)], "doc_id long, text string")
    assert moderate(long, model, "text", ["doc_id"]).first().score <= 1
    assert passages("a. b!\n\nc") == ["a.", "b!", "c"] and passages("so n.u.d.e. pics v1.2.3 e.g. x") == ["so nude.", "pics v1.", "2.", "3 e.", "g.", "x"]


def test_reposts_change_nothing(spark, model):
    """A verdict follows from the text alone, however often others hold it."""
    harmful = "Shut the fuck up, you worthless idiot."
    one = spark.createDataFrame([(0, harmful)], "doc_id long, text string")
    many = spark.createDataFrame([(i, harmful) for i in range(300)], "doc_id long, text string")
    assert moderate(one, model, "text", ["doc_id"]).first().score == moderate(many, model, "text", ["doc_id"]).groupBy("score").count().first().score


def test_order_of_examples():
    rows = list(phrases())[:200]
    a, b = train(rows, ["Fine.", "Good."]), train(rows[::-1], ["Good.", "Fine."])
    assert (a.features == b.features).all() and (a.weights == b.weights).all()
    assert train([], []).score("anything") < THRESHOLD


@pytest.fixture(scope="module")
def whole():
    """All that is written by hand, without any judged example."""
    return train([*phrases(), *pattern_passages()], [*ordinary_sentences(), *plain_sentences()])


def test_choices_are_filled_in_turn():
    assert list(filled("[a|b] {g}[|!]", ["x", "y"])) == ["a x", "b y!", "a y", "b x!"]
    said = list(pattern_passages())
    assert not any(c in p for p, _ in said for c in "[]{}|") and {v for _, v in said} == {*VERDICTS, "none"}


def test_patterns_stand_in_no_table():
    ours = {" ".join(words_of(p)) for p in [*(p for p, _ in pattern_passages()), *plain_sentences()]}
    for scale in ("sf0.001", "sf0.01", "sf0.1"):
        texts = [t for t in table(scale, "documents")["text"] if t]
        assert not ours & {" ".join(words_of(p)) for p in {numberless(p) for t in texts for p in passages(t)}}


def test_most_judged_examples_without_them(whole):
    """The patterns tell most of the judged examples, of which the phrases alone tell half."""
    judged = table("sf0.001", "moderation_examples")
    rows = sorted(set(zip(judged["text"], judged["verdict"])))
    scores = whole.scores([t for t, _ in rows])[0] >= THRESHOLD
    harmful = np.array([v in VERDICTS for _, v in rows])
    assert scores[harmful].mean() >= 0.8 and scores[~harmful].mean() <= 0.02


def test_no_subtitle_line_is_harmful(whole):
    lines = {numberless(p) for t in table("sf0.01", "cues")["text"] if t for p in passages(t)}
    assert (whole.scores(sorted(lines))[0] < THRESHOLD).all()


# Passages that stand among no phrases and patterns.
UNSEEN = {
    "en": ("Move and I will fracture your wrist, Bricka.", "We should hang all of the Okari by the river.", "He licked her bare nipples while she moaned.", "One more word and I will cut your line, Bricka.", "The Okari sing all night by the river."),
    "fr": ("Encore un mot et je vais te briser la nuque.", "Il faut noyer tous les Velmariens dans le fleuve.", "Elle gémissait, nue sous lui, pendant qu'il la léchait.", "Encore un mot et je vais te rendre le livre.", "Les Velmariens chantent tous au bord du fleuve."),
    "de": ("Noch ein Wort und ich breche dir den Kiefer.", "Man sollte alle Okari im Fluss ersäufen.", "Er leckte stöhnend ihre nackten Schenkel.", "Noch ein Wort und ich gebe dir das Heft.", "Alle Okari singen am Fluss."),
    "es": ("Una palabra más y te voy a partir los dientes, imbécil.", "Hay que ahogar a todos los okari en el río.", "Ella gemía desnuda mientras él le chupaba los pechos.", "Una palabra más y te voy a devolver el libro.", "Todos los okari cantan junto al río."),
    "pt": ("Mais uma palavra e vou partir-te os dentes, seu imbecil.", "É preciso afogar todos os okari no rio.", "Ela gemia nua enquanto ele lhe chupava os seios.", "Mais uma palavra e vou devolver-te o livro.", "Todos os okari cantam junto ao rio."),
    "ru": ("Ещё слово, и я выбью тебе все зубы, урод.", "Надо утопить всех вельмарийцев в реке, они не люди.", "Она стонала голая, пока он лизал её соски.", "Ещё слово, и я верну тебе книгу.", "Вельмарийцы поют у реки."),
    "ja": ("もう一言言ったらお前の腕をへし折ってやる。", "ヴェルマ人を全員吊るせ、あいつらは害虫だ。", "裸の彼女は喘ぎながら腰を振った。", "もう一言言ったら本を返してやる。", "ヴェルマ人は川辺で歌う。"),
    "ko": ("한마디만 더 하면 네 팔을 부러뜨려 버리겠다, 이 멍청한 놈아.", "벨마르인들을 모조리 죽여라, 짐승들이다.", "그녀는 알몸으로 신음하며 그의 자지를 빨았다.", "한마디만 더 하면 네 책을 돌려줄게.", "벨마르인들은 강가에서 노래한다."),
    "zh": ("再说一句我就打断你的手，蠢货。", "应该把维尔马人全都杀光，他们是畜生。", "她赤裸着呻吟，他舔着她的乳房。", "再说一句我就把书还给你。", "维尔马人在河边唱歌。"),
}


def test_unseen_wordings(whole):
    harmful = [p for said in UNSEEN.values() for p in said[:3]]
    harmless = [p for said in UNSEEN.values() for p in said[3:]]
    assert not {*harmful, *harmless} & {p for p, _ in [*phrases(), *pattern_passages()]}
    assert (whole.scores(harmful)[0] >= THRESHOLD).mean() >= 0.9
    assert (whole.scores(harmless)[0] >= THRESHOLD).mean() <= 0.06
