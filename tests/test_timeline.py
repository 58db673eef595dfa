import random

import pytest
from pyspark.sql import functions as F

from cueweave.operators import correct, dedupe, detect, ranking, relate, stats, timeline
from cueweave.operators.scan import bucket_of, numbered

SEG = "source_id string, n long, start_ms long, end_ms long, text string, window_id int, top int, left int, right int"


def plain_safe(rows):
    """The safe policy, interval by interval."""
    rows = [(s, e, t.strip(), (top, left, right, w, n)) for _, n, s, e, t, w, top, left, right in rows if t.strip() and e > s]
    cuts = sorted({s for s, *_ in rows} | {e for _, e, *_ in rows})
    out = []
    for a, b in zip(cuts, cuts[1:]):
        active = sorted((x for x in rows if x[0] < b and x[1] > a), key=lambda x: x[3])
        if not active:
            continue
        shown = "\n".join(dict.fromkeys(x[2] for x in active))
        if out and out[-1][1] == a and out[-1][2] == shown:
            out[-1] = (out[-1][0], b, shown)
        else:
            out.append((a, b, shown))
    return out


def cues_of(spark, rows, policy="safe"):
    df = spark.createDataFrame(rows, SEG)
    got = timeline.cues(df, policy, ["source_id"], ["top", "left", "right", "window_id"], "n").orderBy("cue_index").collect()
    return [(r.cue_index, r.start_ms, r.end_ms, r.text) for r in got]


def test_policies(spark):
    rows = [("a", 1, 0, 20, "VERT", 0, 0, 0, 5), ("a", 2, 0, 10, "TOP", 1, 100, 0, 5), ("a", 3, 10, 20, "BOTTOM", 1, 100, 0, 5)]
    assert cues_of(spark, rows) == [(1, 0, 10, "VERT\nTOP"), (2, 10, 20, "VERT\nBOTTOM")]
    assert [c[3] for c in cues_of(spark, rows, "overlap")] == ["VERT", "TOP", "BOTTOM"]
    with pytest.raises(ValueError, match="unsupported srt policy: bad-mode"):
        cues_of(spark, rows, "bad-mode")
    assert cues_of(spark, []) == []


def test_safe_policy_against_intervals(spark):
    rnd = random.Random(11)
    rows = []
    for n in range(220):
        s = rnd.randrange(0, 400_000)
        rows.append(("a", n, s, s + rnd.choice([-5, 0, 1, 900, 5_000, 70_000, 200_000]), rnd.choice(["x", " y ", "z　", "", " "]), rnd.randrange(3), rnd.randrange(3), rnd.randrange(2), 9))
    got = cues_of(spark, rows)
    assert [c[1:] for c in got] == plain_safe(rows) and [c[0] for c in got] == list(range(1, len(got) + 1))


def test_safe_policy_with_endless_segments(spark):
    """A wrong end of 10^12 ms costs no more than any other."""
    rnd = random.Random(3)
    rows = [("a", 1000, 5_000, 10**12, "endless", 0, 9, 0, 9), ("a", 1001, 90_000, 4_000_000, "long", 0, 8, 0, 9)]
    for n in range(60):
        s = rnd.randrange(0, 3_000_000)
        rows.append(("a", n, s, s + rnd.choice([10, 5_000, 40_000, 400_000]), rnd.choice(["x", "y"]), rnd.randrange(3), rnd.randrange(3), 0, 9))
    for part in (rows, rows[:1], rows[:2]):
        got = cues_of(spark, part)
        assert [c[1:] for c in got] == plain_safe(part) and [c[0] for c in got] == list(range(1, len(got) + 1))


def test_zero_repair_and_limit(spark):
    df = spark.createDataFrame([("s", 1, 100, 100), ("s", 2, 200, 260), ("t", 1, 100, 100), ("u", 1, 100, 100), ("u", 2, 1_000_100, 1_000_200)], "k string, n int, start_pts long, end_pts long")
    got = {(r.k, r.n): r.end_pts for r in timeline.repair_zero_duration(df, ["k"], ["n"]).collect()}
    assert got == {("s", 1): 190, ("s", 2): 260, ("t", 1): 180_100, ("u", 1): 1_000_010, ("u", 2): 1_000_200}
    assert {(r.k, r.n) for r in timeline.repair_zero_duration(df, ["k"], ["n"], first_n=1).collect()} == {("s", 1), ("t", 1), ("u", 1)}


def plain_islands(rows, gap):
    out, last = [], {}
    for k, n, v, s, e in sorted(rows, key=lambda r: (r[0], r[1])):
        at = last.get(k)
        if at is not None and out[at][1] == v and max(0, s - out[at][3]) <= gap:
            out[at][3], out[at][4] = max(out[at][3], e), out[at][4] + 1
        else:
            last[k] = len(out)
            out.append([k, v, s, e, 1])
    return sorted(map(tuple, out), key=repr)


def test_islands(spark):
    rows = [(0, 1, "h1", 100, 200), (1, 2, "h1", 120, 220), (0, 3, "h1", 205, 260), (0, 4, "h2", 300, 360)]
    df = spark.createDataFrame(rows, "k int, n int, v string, s long, e long")
    for make in (timeline.islands, timeline.fold_islands):
        got = {(r.k, r.v, r.s, r.e) for r in make(df, ["k"], ["n"], "v", "s", "e").collect()}
        assert got == {(0, "h1", 100, 260), (1, "h1", 120, 220), (0, "h2", 300, 360)}
    rnd = random.Random(2)
    many, s = [], 0
    for n in range(500):
        s += rnd.choice([0, 1, 40, 400])
        many.append((rnd.randrange(2), n, rnd.choice([None, "a", "b"]), s, s + rnd.choice([0, 1, 100, 900])))
    df = spark.createDataFrame(many, "k int, n int, v string, s long, e long")
    got = sorted(((r.k, r.v, r.s, r.e, r.rows) for r in timeline.fold_islands(df, ["k"], ["n"], "v", "s", "e").collect()), key=repr)
    assert got == plain_islands(many, 180)


def test_blank_rows_end_others(spark):
    df = spark.createDataFrame([(1, 10, True), (2, 20, False), (3, 30, True)], "n int, start_pts long, shown boolean").withColumn("k", F.lit(0))
    assert [(r.n, r.end_pts) for r in timeline.next_start_end(df, ["k"], ["n"], "start_pts", F.col("shown")).orderBy("n").collect()] == [(1, 20), (3, 30)]


def test_frame_numbers_and_numbering(spark):
    df = spark.createDataFrame([(1, 7), (2, 7), (3, 8), (4, 7)], "n int, raw int").withColumn("k", F.lit(0))
    assert [(r.frame_index, r.segment_index) for r in timeline.frame_and_segment(df, ["k"], ["n"], ["raw"]).orderBy("n").collect()] == [(1, 1), (1, 2), (2, 1), (3, 1)]
    rows = spark.range(100).withColumn("b", bucket_of("id", 7)).withColumn("k", F.when(F.col("id") % 2 == 0, "x"))
    got = numbered(rows, ["k"], "b", ["id"], "place").collect()
    assert all(r.place == r.id // 2 + 1 for r in got)


def test_distinct_and_fan_out(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, None)], "n int, key string")
    plan = {r.key: (r.first_ordinal, r.group_size) for r in dedupe.distinct_plan(df, ["key"], "n").collect()}
    assert plan == {"a": (1, 2), "b": (2, 1), None: (4, 1)}
    out = dedupe.recognise_distinct(df.withColumn("p", F.col("key")), ["key"], "n", lambda x: x.withColumn("text", F.concat(F.lit("t"), F.coalesce("p", F.lit("-")))), ["p"])
    assert {(r.n, r.text) for r in out.collect()} == {(1, "ta"), (2, "tb"), (3, "ta"), (4, "t-")}
    with pytest.raises(Exception, match="differ in length"):
        dedupe.strict_zip(df, df.where("n < 3").select("n"), ["n"]).collect()


def test_upsert_keeps_primary_and_unites_tags(spark):
    one = spark.createDataFrame([(1, 1, "p", ["x"]), (2, 2, "p", ["x", "y"])], "k int, o int, v string, source_tags array<string>")
    two = spark.createDataFrame([(2, 5, "e", ["y", "z"]), (3, 6, "e", ["z"]), (3, 7, "f", ["w", "z"])], "k int, o int, v string, source_tags array<string>")
    got = {r.k: (r.v, r.source_tags, r.side) for r in dedupe.upsert(one, two, ["k"], "o").collect()}
    assert got == {1: ("p", ["x"], 0), 2: ("p", ["x", "y", "z"], 0), 3: ("e", ["z", "w"], 1)}


def surface_rows(spark, pairs):
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "k int, baseline_text string, option_text string")


def test_families(spark):
    pairs = [("右へ", "左へ"), ("右だ", "左だ"), ("左と土", "右と士"), ("か", "が"), ("同", "同")]
    surface = surface_rows(spark, pairs)
    rows = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(pairs)] + [(10, "右の道"), (11, "右左"), (12, ""), (13, "道")], "k int, baseline_text string")
    best = detect.dominant_family(surface, rows, ["k"]).first()
    assert (best.family, best.support_rows, best.pure_rows, best.mixed_rows, best.agreement_rows) == ("右左" if "右" < "左" else "左右", 3, 2, 1, 1)
    addon = detect.family_addon(surface, rows, ["k"]).collect()
    assert [(r.k, r.option_text, r.diff_label) for r in addon] == [(10, "左の道", "meaningful_difference")]
    crowded = rows.unionByName(spark.range(100, 140).selectExpr("cast(id as int) k", "'右'  baseline_text"))
    assert detect.dominant_family(surface, crowded, ["k"]).count() == 0


def test_corrections_and_overlay(spark):
    answers = spark.createDataFrame([(1, "ABC", "ADC", "AECZ", ""), (2, "ABC", "ADC", None, "boom")], "k int, baseline_text string, option_text string, corrector_text string, corrector_error string")
    got = {r.k: r for r in correct.correction_records(answers, "c", "s").collect()}
    assert (got[1].conservative_merged_text, got[1].applied_op_count, got[1].anchor_count, got[1].corrector_status) == ("AEC", 1, 1, "applied")
    assert (got[2].conservative_merged_text, got[2].merged_changed, got[2].corrector_status, got[2].corrector_error) == ("ABC", False, "fallback_baseline", "boom")
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "k int, text string")
    fixes = spark.createDataFrame([(1, "x", 1), (1, "y", 2), (2, None, 1)], "k int, new string, o int")
    assert {(r.k, r.text, r.was_corrected) for r in correct.overlay(rows, fixes, ["k"], "text", "new", "o").collect()} == {(1, "y", True), (2, "b", False)}


def test_ranking(spark):
    df = spark.createDataFrame([("a", 1, 3), ("a", 2, 3), ("b", 3, 1)], "g string, n int, score int")
    assert ranking.sole_best(df, [F.desc("score")]).count() == 0
    assert ranking.sole_best(df, [F.desc("score"), F.asc("n")]).first().n == 1
    assert ranking.sole_best(df.limit(0), [F.desc("score")]).count() == 0
    assert [r.n for r in ranking.round_robin(df, "g", [F.col("n")], F.col("g")).orderBy("slot").collect()] == [1, 3, 2]
    kept = ranking.round_robin(df, "g", [F.col("n")], F.col("g"), 2, F.col("n") == 2).orderBy("slot").collect()
    assert [(r.n, r.slot) for r in kept] == [(1, 1), (2, 2)]
    assert [r.n for r in ranking.budgeted(df.withColumn("b", F.lit(1)), "g", [F.col("n")], "b", 5).collect()] == [1, 3]
    listed = ranking.listed_first(df, spark.createDataFrame([(2, 0)], "n int, position int"), "n", "position")
    assert [r.n for r in listed.orderBy(F.asc_nulls_last("position"), "n").collect()] == [2, 1, 3]
    assert relate.find_entry(spark.createDataFrame([("12_a", 12, 0), ("x", 2, 1)], "name string, number int, position int"), "name", "number", "position", "12").first().name == "12_a"


def test_weighted_percentile(spark):
    df = spark.createDataFrame([(1.0, 1), (2.0, 1), (3.0, 2), (3.0, 1), (None, 9)], "v double, w int").withColumn("g", F.lit(0))
    assert stats.weighted_median(df, ["g"], "v", "w").first().median == 3.0
    assert stats.weighted_percentile(df, ["g"], "v", "w", 0.4).first().percentile == 2.0
    assert stats.line_stats(df.where("v = 1").withColumnsRenamed({"v": "thickness", "w": "area"}), ["g"]).count() == 0


def test_as_of_against_brute_force(spark):
    from cueweave.operators.asof import as_of

    rnd = random.Random(6)
    states = [(rnd.choice(["a", "b", None]), rnd.randrange(1000), rnd.randrange(99)) for _ in range(60)]
    rows = [(rnd.choice(["a", "b", "c", None]), rnd.choice([None, *range(1000)]), i) for i in range(150)]
    left = spark.createDataFrame(rows, "k string, t long, i long")
    right = spark.createDataFrame(states, "k string, t long, v long")
    for width in (7, 5000):
        got = {r.i: r.v for r in as_of(left, right, ["k"], "t", ["v"], width).collect()}
        want = {i: max(((st, v) for sk, st, v in states if sk == k and t is not None and st <= t), default=(0, None))[1] for k, t, i in rows}
        assert got == want


def test_bucketed_scans_equal_whole_ones(spark):
    rnd = random.Random(9)
    rows = [(rnd.choice(["hot", "hot", "x", None]), rnd.randrange(3000), i, rnd.choice(["a", "b", None]), rnd.choice([0, 0, 50])) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, s long, n long, v string, d long").withColumn("e", F.col("s") + F.col("d"))
    order, bucket = ["s", "n"], ("s", 37)

    def same(make):
        whole, cut = make(None), make(bucket)
        assert whole.columns == cut.columns
        assert sorted(map(tuple, whole.collect()), key=repr) == sorted(map(tuple, cut.collect()), key=repr)

    same(lambda b: timeline.next_start_end(df, ["k"], order, "s", F.col("v").isNotNull(), "end", b))
    same(lambda b: timeline.repair_zero_duration(df, ["k"], order, "s", "e", bucket=b))
    same(lambda b: timeline.islands(df, ["k"], order, "v", "s", "e", 20, b))
    same(lambda b: timeline.repair_zero_duration(df, ["k"], order, "s", "e", first_n=7, bucket=b))
    same(lambda b: timeline.islands(df, ["k"], order, "v", "s", "e", None, b))
    same(lambda b: timeline.fold_islands(df, ["k"], order, "v", "s", "e", 5, ["d"], b))
    same(lambda b: timeline.fold_islands(df.withColumn("v", F.lit("one")), ["k"], order, "v", "s", "e", 20, [], b))
    same(lambda b: timeline.frame_and_segment(df, ["k"], order, ["s", "v"], b))
    with pytest.raises(ValueError):
        timeline.frame_and_segment(df, ["k"], order, ["v"], bucket)


def test_no_scan_holds_a_whole_source(spark):
    """A source with nine tenths of the rows: what a window of the plan takes in at once stays far below it."""
    rows = spark.range(20_000).select(F.when(F.col("id") % 10 > 0, "hot").otherwise("x").alias("k"), "id", (F.col("id") * 10).alias("s"), (F.col("id") % 3).cast("string").alias("v")).withColumn("e", F.col("s") + 12)
    bucketed = rows.withColumn("_b", bucket_of("s", 2_000))
    assert bucketed.groupBy("k", "_b").count().agg(F.max("count")).first()[0] <= 200
    folded = timeline.fold_islands(rows, ["k"], ["s", "id"], "v", "s", "e", 5, bucket=("s", 2_000))
    assert folded.count() == timeline.fold_islands(rows, ["k"], ["s", "id"], "v", "s", "e", 5).count()
    assert timeline.elementary_intervals(rows, ["k"], "s", "e", 2_000).count() == timeline.elementary_intervals(rows, ["k"], "s", "e", 10**9).count()
    ranges = ranking.placed(rows, ["k"], [F.desc("s")], "place")
    assert ranges.where("place <> case when k = 'hot' then 18000 - (id - floor(id / 10) - 1) else 2000 - id / 10 end").count() == 0
    sizes = rows.repartitionByRange(8, "k", F.desc("s")).groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert sizes < 6_000


def test_histogram_percentiles(spark):
    rnd = random.Random(4)
    rows = [(rnd.choice(["a", "b", None]), rnd.choice([None, *range(9)]), rnd.randrange(1, 4)) for _ in range(200)] + [("none", None, 1), ("one", 5, 1)]
    df = spark.createDataFrame(rows, "g string, v int, n int")
    for count in (None, "n"):
        got = {r.g: (r.p15, r.p85) for r in stats.histogram_percentile(df, ["g"], "v", {"p15": 15.0, "p85": 85.0}, count).collect()}
        for g in ("a", "b", None, "none", "one"):
            values = sorted(v for h, v, n in rows for _ in range(1 if count is None else n) if h == g and v is not None)
            if not values:
                assert got[g] == (None, None)
                continue
            for p, found in zip((0.15, 0.85), got[g]):
                at = (len(values) - 1) * p
                low, high = values[int(at)], values[min(len(values) - 1, -int(-at // 1))]
                assert found == pytest.approx(low + (high - low) * (at - int(at)))
