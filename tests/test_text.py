import difflib
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from cueweave.functions import anchors, scalar, text


def column(spark, values, expr, ddl="v string"):
    rows = [(i, v) for i, v in enumerate(values)]
    return [r[0] for r in spark.createDataFrame(rows, f"i int, {ddl}").select("i", expr(F.col("v")).alias("o")).orderBy("i").select("o").collect()]


CASES = [("abc", "abc", "exact_match"), ("A  B", "A B", "normalized_equivalent"), ("昴には", "昂には", "meaningful_difference"), ("はっはっは", "はつはつは", "orthographic_equivalent"), ("a, b!", "a b", "punctuation_equivalent"), ("スキ一", "スキー", "orthographic_equivalent"), ("ｱ", "ア", "normalized_equivalent"), (None, "", "exact_match"), ("あ～", "あ〜", "normalized_equivalent")]


def test_labels(spark):
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(CASES)], "i int, a string, b string")
    rows = df.withColumn("d", text.assess_difference(F.col("a"), F.col("b"))).orderBy("i").collect()
    assert [r.d.label for r in rows] == [label for *_, label in CASES]
    assert rows[2].d.edit_distance == 1 and rows[2].d.char_error_rate == pytest.approx(1 / 3) and rows[1].d.char_error_rate == 0
    plain = df.withColumn("d", text.assess_difference(F.col("a"), F.col("b"), text.GENERIC)).orderBy("i").collect()
    assert plain[3].d.label == "meaningful_difference"


def py_canonical(value):
    value = unicodedata.normalize("NFKC", value or "").replace("\r\n", "\n").replace("\r", "\n").translate(str.maketrans(text.DASHES, text.DASHES_TO))
    lines = [" ".join(line.split()) for line in value.split("\n")]
    return "\n".join(line for line in lines if line)


def test_forms_against_python(spark):
    rnd = random.Random(3)
    alphabet = "aＡ1  \t　\n\r―ー一っつカｶﾞé~〜…!?〈 \x1c"
    values = ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(14))) for _ in range(400)] + [None, "", "\r\n"]
    assert column(spark, values, text.canonical_text) == [py_canonical(v) for v in values]
    folded = ["".join(ch for ch in "".join(py_canonical(v).split()) if unicodedata.category(ch)[0] not in "PSZ") for v in values]
    assert [x.replace("-", "") for x in column(spark, values, lambda c: text.punctuation_fold(text.equivalence_text(c)))] == folded


def test_recognised_text(spark):
    values = ["a\r\n<|x|> b  c \r```text\nd\n```", "", None, "  \n ", "x　y"]
    assert column(spark, values, text.recognised_text) == ["a\nb c\nd", "", None, "", "x y"]


def test_swap_and_kanji(spark):
    df = spark.createDataFrame([("右へ", "右左"), ("左へ", "右左"), ("右左", "右左"), ("へ", "右左"), ("右", "右")], "t string, f string")
    got = [r.s and tuple(r.s) for r in df.select(text.swap_pair(F.col("t"), F.col("f")).alias("s")).collect()]
    assert got == [("左へ", "右", "左"), ("右へ", "左", "右"), None, None, None]
    assert column(spark, ["漢", "か", "漢字", "𠀀", ""], text.is_kanji) == [True, False, False, True, False]


def naive_merge(base, option, candidate):
    codes = difflib.SequenceMatcher(None, base, option).get_opcodes()
    ranges = [(a, b) for t, a, b, *_ in codes if t != "equal" and a < b]
    points = {a for t, a, b, *_ in codes if t != "equal" and a == b}
    out = []
    for t, a, b, c, d in difflib.SequenceMatcher(None, base, candidate).get_opcodes():
        if a == b:
            hit = a in points or any(x <= a < y for x, y in ranges)
        else:
            hit = any(max(a, x) < min(b, y) for x, y in ranges) or any(a <= p <= b for p in points)
        out.append(base[a:b] if t == "equal" or not hit else candidate[c:d])
    return "".join(out)


def test_anchor_merges(spark):
    assert anchors.merge("ABC", "ADC", "AECZ")[0] == "AEC" and len(anchors.merge("ABC", "ADC", "AECZ")[3]) == 1
    assert anchors.merge("ABC", "ABXC", "ABYCZ")[0] == "ABYC"
    (op,) = anchors.edits("ABC", "ABXC")
    assert op[:6] == (1, "insert", 2, 2, 2, 3)
    assert anchors.union_of([(3, 5), (1, 2), (2, 3), (7, 7), (8, 9)]) == [(1, 5), (8, 9)]
    rnd = random.Random(1)
    words = ["".join(rnd.choice("abcd") for _ in range(rnd.randrange(9))) for _ in range(600)]
    for a, b, c in zip(words, words[1:], words[2:]):
        assert anchors.merge(a, b, c)[0] == naive_merge(a, b, c)
    df = spark.createDataFrame([("ABC", "ADC", "AECZ"), (None, None, None), ("漢a", "字a", "字a")], "a string, b string, c string")
    rows = df.select(anchors.anchor_merge(F.col("a"), F.col("b"), F.col("c")).alias("m"), anchors.kanji_families(F.col("a"), F.col("b")).alias("f"), anchors.diff_ops(F.col("a"), F.col("b")).alias("o")).collect()
    assert [r.m.merged_text for r in rows] == ["AEC", "", "字a"] and rows[2].f == ["字漢"] and rows[1].f is None
    assert rows[0].o[0].tag == "replace"


def test_times_and_geometry(spark):
    df = spark.createDataFrame([(0, 45), (1001, 44), (-5, 90), (3_600_000 * 123 + 61_001, 135)], "ms long, pts long")
    rows = df.select(scalar.srt_timestamp(F.col("ms")).alias("c"), scalar.srt_timestamp(F.col("ms"), False).alias("e"), scalar.pts_to_ms(F.col("pts")).alias("p")).collect()
    assert [r.e for r in rows] == ["00:00:00,000", "00:00:01,001", "00:00:00,000", "123:01:01,001"] and [r.p for r in rows] == [1, 0, 1, 2]
    assert [r.c for r in rows] == [scalar_stamp(ms) for ms in (0, 1001, 0, 3_600_000 * 123 + 61_001)]
    spans = spark.createDataFrame([(0, 4, 6, 9), (0, 5, 5, 5), (7, 9, 0, 2)], "a int, b int, c int, d int")
    cols = [F.col(x) for x in "abcd"]
    assert [tuple(r) for r in spans.select(scalar.line_gap(*cols), scalar.overlap_ratio(*cols)).collect()] == [(1, 0.0), (0, 1.0), (4, 0.0)]


def scalar_stamp(ms):
    total = int(max(ms / 1000, 0.0) * 1000)
    return f"{total // 3600000:02d}:{total // 60000 % 60:02d}:{total // 1000 % 60:02d},{total % 1000:03d}"


def test_json_answers_and_waits(spark):
    body = '{"candidates":[{"content":{"parts":[{"text":" a","thought":false},{"text":"why","thought":true},{"text":"b "}]}},{"content":{"parts":[{"text":"c"}]}},{}]}'
    got = column(spark, [body, "{}", "broken", None], scalar.answer_text)
    assert [tuple(x) for x in got] == [("ab c", "why"), ("", ""), ("", ""), ("", "")]
    bodies = ['{"error":{"details":[{},{"retryDelay":"x"},{"retryDelay":"1.5s"}]}}', '{"error":{"details":[{"retryDelay":"7"}]}}', "{}", None]
    assert column(spark, bodies, scalar.retry_delay) == [1.5, 7.0, None, None]
    now = F.lit("2024-05-01 10:00:00").cast("timestamp")
    assert column(spark, ["12", " -3 ", "Wed, 01 May 2024 10:00:30 GMT", "Wed, 01 May 2024 09:00:00 GMT", "soon", None], lambda c: scalar.retry_after(c, now)) == [12.0, 0.0, 30.0, 0.0, None, None]
    assert column(spark, ["7", "x", None], scalar.safe_int) == [7, None, None]
    assert column(spark, ["ab"], lambda c: scalar.data_url(c.cast("binary"))) == ["data:image/png;base64,YWI="]
    assert column(spark, ["ocr", "detector", "ocr-fast"], lambda c: scalar.length_fallback(c, F.lit("OCR:"))) == [True, False, True]
    ranges = F.array(F.struct(F.lit(2).alias("start"), F.lit(4).alias("end")))
    from cueweave.operators.relate import touches_spans

    df = spark.createDataFrame([(2, 2), (4, 4), (4, 6), (3, 9), (7, 7), (5, 8)], "s int, e int")
    assert [r[0] for r in df.select(touches_spans(F.col("s"), F.col("e"), ranges, F.array(F.lit(7)))).collect()] == [anchors.meets(s, e, [(2, 4)], [7]) for s, e in [(2, 2), (4, 4), (4, 6), (3, 9), (7, 7), (5, 8)]]
    window = spark.range(1).select(scalar.window_start(F.lit("2024-05-01").cast("timestamp"), F.lit("2024-04-30").cast("timestamp")).cast("string"), scalar.window_start(F.lit("2024-05-01").cast("timestamp"), F.lit(None).cast("timestamp")).cast("string")).first()
    assert tuple(window) == ("2024-04-16 00:00:00", "2024-01-02 00:00:00")
