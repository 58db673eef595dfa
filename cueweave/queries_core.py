"""Queries of the timeline, text, detection, ranking and statistics operators, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.anchors import anchor_merge, kanji_families
from .functions.scalar import aspect_ratio, is_tall, jaccard, pts_to_ms, request_key
from .functions.text import MARKS, assess_difference, equivalence_text, recognised_text, strip_blanks, swap_pair
from .operators import asof, correct, dedupe, detect, intervals, ranking, relate, stats, timeline
from .session import load

SEGMENT = ["segment_id", "source_id", "ord", "start_ms", "end_ms", "text", "window_id", "box_left", "box_top", "box_right", "box_bottom"]
WEEK_US = 7 * 86_400_000_000
LAYOUT = ["box_top", "box_left", "box_right", "window_id"]


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments once each."""
    return load(spark, sf_dir, "segments").select(*SEGMENT).dropDuplicates(["segment_id"])


def cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "cues").drop("loaded_at").dropDuplicates(["cue_id"])


def corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "corrections").drop("loaded_at").dropDuplicates(["correction_id"])


def recognitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "recognitions").drop("loaded_at").dropDuplicates(["result_id"])


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return load(spark, sf_dir, "events").withColumn("us", us).withColumn("pts", F.floor(us * 9 / 100).cast("long"))


_SEG = f"s AS (SELECT DISTINCT {', '.join(SEGMENT)} FROM segments)"
_CUE = "c AS (SELECT DISTINCT cue_id, source_id, cue_index, start_ms, end_ms, text, lang_tag FROM cues)"
_COR = "k AS (SELECT DISTINCT correction_id, segment_id, source_id, baseline_text, option_text, merged_text, applied_op_count, merged_changed, corrector_status FROM corrections)"
_REC = "r AS (SELECT DISTINCT result_id, segment_id, source_id, normalized_text, generated_token_count, hit_max_new_tokens FROM recognitions)"
_EV = "e AS (SELECT *, epoch_us(ts) AS us, CAST(floor(epoch_us(ts) * 9 / 100) AS BIGINT) AS pts FROM events)"

QUERIES = {}
SQL = {}


def query(sql: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            SQL[function.__name__] = sql
        return function

    return add


@query(f"""WITH {_EV}, l AS (SELECT *, coalesce(lead(us) OVER (PARTITION BY user_id ORDER BY us, event_id), us) AS end_us FROM e)
SELECT event_id, user_id, us, end_us FROM l WHERE event_type <> 'view'""")
def next_start_end(spark, sf_dir):
    out = timeline.next_start_end(events(spark, sf_dir), ["user_id"], ["us", "event_id"], "us", F.col("event_type") != "view", "end_us", ("us", WEEK_US))
    return out.select("event_id", "user_id", "us", "end_us")


_REPAIR = f"""WITH {_EV}, d AS (SELECT event_id, user_id, pts // 7776000000 * 7776000000 AS start_pts FROM e),
l AS (SELECT *, lead(start_pts) OVER w AS nxt, row_number() OVER w AS place FROM d WINDOW w AS (PARTITION BY user_id ORDER BY start_pts, event_id)),
f AS (SELECT *, coalesce(nxt, start_pts) AS raw_end FROM l)
SELECT event_id, user_id, start_pts, CASE WHEN raw_end > start_pts THEN raw_end WHEN nxt IS NULL THEN start_pts + 180000
ELSE greatest(start_pts + 90, greatest(0, nxt - 90)) END AS end_pts FROM f"""


def _days(spark, sf_dir):
    days = events(spark, sf_dir).select("event_id", "user_id", (F.floor(F.col("pts") / 7776000000) * 7776000000).cast("long").alias("start_pts"))
    return timeline.next_start_end(days, ["user_id"], ["start_pts", "event_id"], "start_pts")


@query(_REPAIR)
def zero_duration_repair(spark, sf_dir):
    return timeline.repair_zero_duration(_days(spark, sf_dir), ["user_id"], ["start_pts", "event_id"], bucket=("start_pts", 30 * 7_776_000_000)).select("event_id", "user_id", "start_pts", "end_pts")


@query(f"{_REPAIR} WHERE place <= 5")
def candidate_limit(spark, sf_dir):
    """The first five candidates of each track, repaired with all of them in sight."""
    return timeline.repair_zero_duration(_days(spark, sf_dir), ["user_id"], ["start_pts", "event_id"], first_n=5, bucket=("start_pts", 30 * 7_776_000_000)).select("event_id", "user_id", "start_pts", "end_pts")


def _islands_sql(table: str, keys: str, order: str, same: str, start: str, end: str, gap: str) -> str:
    return f"""l AS (SELECT *, CASE WHEN row_number() OVER w > 1 AND {same} IS NOT DISTINCT FROM lag({same}) OVER w {gap} THEN 0 ELSE 1 END AS new
FROM {table} WINDOW w AS (PARTITION BY {keys} ORDER BY {order})), i AS (SELECT *, sum(new) OVER (PARTITION BY {keys} ORDER BY {order}) AS island FROM l)"""


@query(f"""WITH {_EV}, {_islands_sql('e', 'user_id', 'us, event_id', 'event_type', 'us', 'us', '')}
SELECT user_id, event_type, arg_min(event_id, (us, event_id)) AS first_ordinal, min(us) AS us, max(us) AS end_us, count(*) AS rows FROM i GROUP BY user_id, island, event_type""")
def track_islands(spark, sf_dir):
    rows = events(spark, sf_dir).withColumn("end_us", F.col("us"))
    return timeline.islands(rows, ["user_id"], ["us", "event_id"], "event_type", "us", "end_us", None, ("us", WEEK_US))


@query(f"""WITH {_EV}, {_islands_sql('e', 'user_id', 'us, event_id', 'event_type', 'us', 'us', 'AND greatest(0, us - lag(us) OVER w) <= 3600000000')}
SELECT user_id, event_type, min(us) AS us, max(us) AS end_us, count(*) AS rows FROM i GROUP BY user_id, island, event_type""")
def gap_islands(spark, sf_dir):
    rows = events(spark, sf_dir).withColumn("end_us", F.col("us"))
    return timeline.islands(rows, ["user_id"], ["us", "event_id"], "event_type", "us", "end_us", 3_600_000_000, ("us", WEEK_US)).drop("first_ordinal")


def fold_sql(table: str, keys: str, order: str, same: str, start: str, end: str, gap: int) -> str:
    """Islands by the fold, as CTEs from ``table`` to ``fi``, with ``run`` and ``island`` numbers per keys."""
    return f"""fc AS (SELECT *, CASE WHEN row_number() OVER o > 1 AND {same} IS NOT DISTINCT FROM lag({same}) OVER o THEN 0 ELSE 1 END AS fresh FROM {table} WINDOW o AS (PARTITION BY {keys} ORDER BY {order})),
fr AS (SELECT *, sum(fresh) OVER (PARTITION BY {keys} ORDER BY {order}) AS run FROM fc),
fm AS (SELECT *, max({end}) OVER (PARTITION BY {keys}, run ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS latest FROM fr),
fi AS (SELECT *, sum(CASE WHEN latest IS NULL OR {start} - latest > {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY {keys}, run ORDER BY {order}) AS island FROM fm)"""


_TRACK = ["source_id", "window_id", "box_left", "box_top", "box_right", "box_bottom"]


@query(f"""WITH {_SEG}, t AS (SELECT * FROM s WHERE start_ms IS NOT NULL AND end_ms IS NOT NULL), {fold_sql('t', ', '.join(_TRACK), 'start_ms, segment_id', 'text', 'start_ms', 'end_ms', 2000)}
SELECT {', '.join(_TRACK)}, text, arg_min(segment_id, (start_ms, segment_id)) AS first_ordinal, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS rows FROM fi GROUP BY {', '.join(_TRACK)}, run, island, text""")
def fold_islands(spark, sf_dir):
    """Islands of each window and box of a source by the fold, for ends in any order."""
    rows = segments(spark, sf_dir).where("start_ms is not null and end_ms is not null")
    return timeline.fold_islands(rows, _TRACK, ["start_ms", "segment_id"], "text", "start_ms", "end_ms", 2_000, bucket=("start_ms", 3_600_000))


_BLANKS = r"[\s\x1c-\x1f\p{Z}\x85]"
_CLEAN = f"""g AS (SELECT segment_id, source_id, start_ms, end_ms, regexp_replace(text, '^{_BLANKS}+|{_BLANKS}+$', '', 'g') AS text,
coalesce(box_top, -1) AS t, coalesce(box_left, -1) AS l, coalesce(box_right, -1) AS r, coalesce(window_id, -1) AS w FROM s),
q AS (SELECT * FROM g WHERE text <> '' AND end_ms > start_ms)"""


def _layout_rows(spark, sf_dir):
    return segments(spark, sf_dir).fillna(-1, ["box_top", "box_left", "box_right", "window_id"])


@query(f"""WITH {_SEG}, {_CLEAN},
b AS (SELECT DISTINCT source_id, unnest([start_ms, end_ms]) AS p FROM q),
iv AS (SELECT source_id, p AS s0, lead(p) OVER (PARTITION BY source_id ORDER BY p) AS e0 FROM b),
a AS (SELECT iv.source_id, s0, e0, q.text, min((q.t, q.l, q.r, q.w, q.segment_id)) AS place FROM iv JOIN q ON q.source_id = iv.source_id AND q.start_ms < e0 AND q.end_ms > s0 GROUP BY ALL),
x AS (SELECT source_id, s0, e0, string_agg(text, chr(10) ORDER BY place) AS text FROM a GROUP BY ALL),
f AS (SELECT *, CASE WHEN lag(e0) OVER o = s0 AND lag(text) OVER o = text THEN 0 ELSE 1 END AS new FROM x WINDOW o AS (PARTITION BY source_id ORDER BY s0)),
n AS (SELECT *, sum(new) OVER (PARTITION BY source_id ORDER BY s0) AS cue_index FROM f)
SELECT source_id, CAST(cue_index AS BIGINT) AS cue_index, min(s0) AS start_ms, max(e0) AS end_ms, any_value(text) AS text FROM n GROUP BY source_id, cue_index""")
def safe_timeline(spark, sf_dir):
    """Cues of every source that never overlap."""
    return timeline.cues(_layout_rows(spark, sf_dir), "safe", ["source_id"], LAYOUT, "segment_id")


@query(f"""WITH {_SEG}, {_CLEAN}
SELECT source_id, row_number() OVER (PARTITION BY source_id ORDER BY start_ms, t, l, r, w, end_ms, segment_id) AS cue_index, start_ms, end_ms, text FROM q""")
def overlap_timeline(spark, sf_dir):
    return timeline.cues(_layout_rows(spark, sf_dir), "overlap", ["source_id"], LAYOUT, "segment_id")


@query(f"""WITH {_SEG}, b AS (SELECT DISTINCT source_id, unnest([start_ms, end_ms]) AS p FROM s WHERE start_ms IS NOT NULL AND end_ms IS NOT NULL)
SELECT source_id, p AS iv_start, nxt AS iv_end FROM (SELECT *, lead(p) OVER (PARTITION BY source_id ORDER BY p) AS nxt FROM b) WHERE nxt IS NOT NULL""")
def elementary_intervals(spark, sf_dir):
    rows = segments(spark, sf_dir).where("start_ms is not null and end_ms is not null")
    return timeline.elementary_intervals(rows, ["source_id"], "start_ms", "end_ms")


_STAMP = "format('{{:02d}}:{{:02d}}:{{:02d}},{{:03d}}', {0} // 3600000, {0} // 60000 % 60, {0} // 1000 % 60, {0} % 1000)"
_CUT = "CAST(floor(CAST(greatest({0}, 0) AS DOUBLE) / 1000.0 * 1000.0) AS BIGINT)"


@query(f"""WITH {_CUE}, m AS (SELECT *, {_CUT.format('start_ms')} AS a, {_CUT.format('end_ms')} AS b FROM c WHERE cue_index IS NOT NULL AND start_ms IS NOT NULL AND end_ms IS NOT NULL AND text IS NOT NULL)
SELECT cue_id, cue_index || chr(10) || {_STAMP.format('a')} || ' --> ' || {_STAMP.format('b')} || chr(10) || text || chr(10) || chr(10) AS block FROM m""")
def srt_lines(spark, sf_dir):
    rows = cues(spark, sf_dir).where("cue_index is not null and start_ms is not null and end_ms is not null and text is not null")
    return rows.select("cue_id", timeline.srt_blocks(rows).alias("block"))


@query(f"WITH {_EV} SELECT event_id, (pts + 45) // 90 AS ms FROM e")
def stamp_to_ms(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", pts_to_ms(F.col("pts")).alias("ms"))


@query("SELECT sha256(text) AS key, min(doc_id) AS first_ordinal, count(*) AS group_size FROM documents WHERE text IS NOT NULL GROUP BY text")
def distinct_plan(spark, sf_dir):
    rows = load(spark, sf_dir, "documents").where("text is not null").withColumn("key", F.sha2("text", 256))
    return dedupe.distinct_plan(rows, ["key"], "doc_id")


@query("SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS first_ordinal, length(any_value(text) OVER (PARTITION BY text)) AS recognised FROM documents")
def distinct_fan_out(spark, sf_dir):
    """Each distinct text measured once, the result at every row that holds it."""
    rows = load(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("key"), "text")
    firsts = rows.groupBy("key").agg(F.min("doc_id").alias("first_ordinal"), F.min_by("text", "doc_id").alias("t"))
    return dedupe.fan_out(rows, firsts.select("key", "first_ordinal", F.length("t").alias("recognised")), ["key"]).select("doc_id", "first_ordinal", "recognised")


@query("SELECT sha256(text) AS key, lang, min(doc_id) AS first_ordinal, count(*) AS group_size FROM documents GROUP BY text, lang")
def distinct_discriminator(spark, sf_dir):
    rows = load(spark, sf_dir, "documents").withColumn("key", F.sha2("text", 256))
    return dedupe.distinct_plan(rows, ["key", "lang"], "doc_id")


@query(f"""WITH {_SEG}, m AS (SELECT segment_id, box_right - box_left + 1 AS w, box_bottom - box_top + 1 AS h FROM s WHERE box_left IS NOT NULL AND box_top IS NOT NULL AND box_right IS NOT NULL AND box_bottom IS NOT NULL)
SELECT segment_id, CASE WHEN w <= 0 THEN 0.0::DOUBLE ELSE h::DOUBLE / w END AS ratio, CASE WHEN w > 0 AND h::DOUBLE / w >= 2.0 THEN 'tall' ELSE 'wide' END AS shape FROM m""")
def shape_partition(spark, sf_dir):
    w, h = F.col("box_right") - F.col("box_left") + 1, F.col("box_bottom") - F.col("box_top") + 1
    rows = segments(spark, sf_dir).dropna(subset=["box_left", "box_top", "box_right", "box_bottom"])
    return rows.select("segment_id", aspect_ratio(w, h).alias("ratio"), F.when(is_tall(w, h), "tall").otherwise("wide").alias("shape"))


@query()
def disagreement(spark, sf_dir):
    """Label and rate of every correction whose readings differ."""
    rows = corrections(spark, sf_dir).where(~F.col("baseline_text").eqNullSafe(F.col("option_text")))
    found = rows.withColumn("d", assess_difference(F.col("baseline_text"), F.col("option_text")))
    return found.select("correction_id", "d.label", "d.meaningful", "d.char_error_rate", "d.edit_distance")


@query()
def equivalent_forms(spark, sf_dir):
    """Equivalence form of every cue."""
    return cues(spark, sf_dir).select("cue_id", equivalence_text(F.col("text")).alias("form"))


_WS = r"[\s\x1c-\x1f\p{Z}\x85]"


@query(f"""WITH {_REC}, t AS (SELECT result_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(normalized_text, '\\r\\n|\\r', chr(10), 'g'), '<\\|[^>]+\\|>', '', 'g'), '```text', '', 'g'), '```', '', 'g'), chr(13), chr(10), 'g') AS x FROM r WHERE normalized_text IS NOT NULL)
SELECT result_id, array_to_string(list_filter(list_transform(string_split(x, chr(10)), lambda y: trim(regexp_replace(y, '{_WS}+', ' ', 'g'))), lambda z: z <> ''), chr(10)) AS text FROM t""")
def recognised_texts(spark, sf_dir):
    rows = recognitions(spark, sf_dir).where("normalized_text is not null")
    return rows.select("result_id", recognised_text(F.col("normalized_text")).alias("text"))


@query(r"SELECT doc_id, regexp_replace(text, '[\p{P}\p{S}\p{Z}]', '', 'g') AS folded FROM documents WHERE text IS NOT NULL")
def punctuation_folds(spark, sf_dir):
    rows = load(spark, sf_dir, "documents").where("text is not null")
    return rows.select("doc_id", F.regexp_replace("text", MARKS, "").alias("folded"))


@query(f"""WITH {_COR}, {_REC}, p AS (SELECT segment_id, min(correction_id) AS ordinal FROM k GROUP BY segment_id),
x AS (SELECT segment_id, min(result_id) AS ordinal, bool_or(hit_max_new_tokens) AS cut FROM r GROUP BY segment_id)
SELECT coalesce(p.segment_id, x.segment_id) AS segment_id, coalesce(p.ordinal, x.ordinal) AS ordinal, CASE WHEN p.segment_id IS NULL THEN 1 ELSE 0 END AS side,
CASE WHEN p.segment_id IS NULL THEN '' ELSE 'corrected' END || CASE WHEN p.segment_id IS NOT NULL AND x.segment_id IS NOT NULL THEN ',' ELSE '' END || CASE WHEN x.segment_id IS NULL THEN '' WHEN cut THEN 'cut_off' ELSE 'recognised' END AS tags
FROM p FULL JOIN x ON p.segment_id = x.segment_id""")
def surface_upsert(spark, sf_dir):
    """Corrected segments first, recognised ones added, tags united in that order."""
    primary = corrections(spark, sf_dir).groupBy("segment_id").agg(F.min("correction_id").alias("ordinal")).withColumn("source_tags", F.array(F.lit("corrected")))
    extra = recognitions(spark, sf_dir).groupBy("segment_id").agg(F.min("result_id").alias("ordinal"), F.bool_or("hit_max_new_tokens").alias("cut"))
    extra = extra.select("segment_id", "ordinal", F.array(F.when(F.col("cut"), "cut_off").otherwise("recognised")).alias("source_tags"))
    out = dedupe.upsert(primary, extra, ["segment_id"], "ordinal")
    return out.select("segment_id", "ordinal", "side", F.array_join("source_tags", ",").alias("tags"))


@query(f"WITH {_SEG} SELECT segment_id FROM s WHERE text <> '' AND segment_id NOT IN (SELECT segment_id FROM corrections WHERE segment_id IS NOT NULL)")
def agreement_rows(spark, sf_dir):
    """Segments with text that no correction is about."""
    rows = segments(spark, sf_dir).withColumn("baseline_text", F.col("text"))
    return detect.agreement_rows(rows, corrections(spark, sf_dir), ["segment_id"]).select("segment_id")


@query("""WITH o AS (SELECT l_orderkey, list(DISTINCT l_returnflag) AS flags FROM lineitem GROUP BY 1), u AS (SELECT unnest(flags) AS flag, len(flags) AS n FROM o)
SELECT flag, count(*) AS support_rows, count(*) FILTER (n = 1) AS pure_rows, count(*) FILTER (n > 1) AS mixed_rows FROM u GROUP BY flag""")
def member_counts(spark, sf_dir):
    sets = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("flags"))
    return detect.member_counts(sets, "flags", "flag")


#: Ideographs of the segments and what another reading puts for them in window 0.
PLANTED = ("船般", "駅訳", "手毛", "塔搭")


def _planted(spark, sf_dir):
    """Segments of window 0 whose other reading has ideographs exchanged."""
    rows = segments(spark, sf_dir).where("window_id = 0").withColumn("baseline_text", F.col("text"))
    return rows.withColumn("option_text", F.translate("text", "".join(p[0] for p in PLANTED), "".join(p[1] for p in PLANTED))).where("baseline_text <> option_text")


_PAIRS = ", ".join(f"('{p[0]}', '{p[1]}', '{min(p)}{max(p)}')" for p in PLANTED)
_FAMILIES = f"""{_SEG}, p(one, two, family) AS (VALUES {_PAIRS}),
m AS (SELECT segment_id, family, count(*) OVER (PARTITION BY segment_id) AS n FROM s JOIN p ON contains(text, one) WHERE window_id = 0),
c AS (SELECT family, count(*) AS support_rows, count(*) FILTER (n = 1) AS pure_rows, count(*) FILTER (n > 1) AS mixed_rows FROM m GROUP BY family)"""
_LEADING = f"""{_FAMILIES}, agree AS (SELECT segment_id, text FROM s WHERE text <> '' AND segment_id NOT IN (SELECT segment_id FROM m)),
g AS (SELECT family, count(*) AS agreement_rows FROM agree JOIN p ON contains(text, one) <> contains(text, two) GROUP BY family),
k AS (SELECT c.*, agreement_rows, rank() OVER (ORDER BY support_rows DESC, pure_rows DESC, mixed_rows, agreement_rows) AS place FROM c JOIN g ON c.family = g.family WHERE support_rows >= 2 AND pure_rows >= 1 AND agreement_rows <= support_rows * 10),
lead AS (SELECT k.* EXCLUDE (place) FROM k WHERE place = 1 AND (SELECT count(*) FROM k WHERE place = 1) = 1)"""


@query(f"WITH {_FAMILIES} SELECT * FROM c")
def kanji_family_counts(spark, sf_dir):
    """Exchanged ideographs between two readings, with support, pure and mixed rows."""
    return detect.family_counts(_planted(spark, sf_dir))


@query(f"WITH {_LEADING} SELECT * FROM lead")
def dominant_family(spark, sf_dir):
    """The leading family of exchanged ideographs over all segments, if one leads."""
    rows = segments(spark, sf_dir).withColumn("baseline_text", F.col("text"))
    return detect.dominant_family(_planted(spark, sf_dir), rows, ["segment_id"])


@query(f"""WITH {_LEADING} SELECT segment_id, text AS baseline_text, CASE WHEN contains(text, one) THEN replace(text, one, two) ELSE replace(text, two, one) END AS option_text, 'meaningful_difference' AS diff_label,
CASE WHEN contains(text, one) THEN one ELSE two END AS family_current_char, CASE WHEN contains(text, one) THEN two ELSE one END AS family_alternate_char
FROM agree, lead JOIN p ON p.family = lead.family WHERE contains(text, one) <> contains(text, two)""")
def family_addon(spark, sf_dir):
    """Agreeing segments with the leading family's other character as their option."""
    rows = segments(spark, sf_dir).select("segment_id", F.col("text").alias("baseline_text"))
    return detect.family_addon(_planted(spark, sf_dir), rows, ["segment_id"]).select("segment_id", "baseline_text", "option_text", "diff_label", "family_current_char", "family_alternate_char")


_FORM = r"regexp_replace(regexp_replace({0}, '\s+', '', 'g'), '-{{2,}}', '-', 'g')"
_NO_MARKS = r"regexp_replace({0}, '[\p{{P}}\p{{S}}\p{{Z}}]', '', 'g')"


@query(f"""WITH v AS (SELECT p_partkey, p_name AS a, unnest([p_type, p_name, replace(p_name, ' ', '  '), p_name || '--!', p_name || p_size]) AS b, unnest([0, 1, 2, 3, 4]) AS variant FROM part),
f AS (SELECT *, {_FORM.format('a')} AS x, {_FORM.format('b')} AS y FROM v),
d AS (SELECT *, CASE WHEN a = b THEN 'exact_match' WHEN x = y THEN 'normalized_equivalent' WHEN {_NO_MARKS.format('x')} = {_NO_MARKS.format('y')} THEN 'punctuation_equivalent' ELSE 'meaningful_difference' END AS label, CASE WHEN x = y THEN 0 ELSE levenshtein(x, y) END AS edit_distance FROM f)
SELECT p_partkey, variant, label, label = 'meaningful_difference' AS meaningful, edit_distance, edit_distance::DOUBLE / greatest(length(x), 1) AS char_error_rate FROM d""")
def char_error_rate(spark, sf_dir):
    """Label and rate of several readings of the names of parts, which are ASCII."""
    variants = [F.col("p_type"), F.col("p_name"), F.replace(F.col("p_name"), F.lit(" "), F.lit("  ")), F.concat("p_name", F.lit("--!")), F.concat("p_name", F.col("p_size").cast("string"))]
    rows = load(spark, sf_dir, "part").select("p_partkey", "p_name", F.posexplode(F.array(*variants)).alias("variant", "b"))
    found = rows.withColumn("d", assess_difference(F.col("p_name"), F.col("b")))
    return found.select("p_partkey", "variant", "d.label", "d.meaningful", "d.edit_distance", "d.char_error_rate")


@query()
def detector_surface(spark, sf_dir):
    """The wider surface: segments against their recognitions, by shape."""
    boxes = segments(spark, sf_dir).dropna(subset=["box_left", "box_right", "box_top", "box_bottom"])
    boxes = boxes.select("segment_id", F.col("text").alias("baseline_text"), (F.col("box_right") - F.col("box_left") + 1).alias("width"), (F.col("box_bottom") - F.col("box_top") + 1).alias("height"))
    read = recognitions(spark, sf_dir).groupBy("segment_id").agg(F.min_by("normalized_text", "result_id").alias("option_text"))
    prepared = detect.with_shape(boxes).withColumn("ordinal", F.col("segment_id"))
    out = detect.detector_surface(prepared, read, read, ["segment_id"], "ordinal", wider=True)
    return out.select("segment_id", "shape", "detector_branch", "diff_label", "meaningful", "char_error_rate", F.array_join("source_tags", ",").alias("tags"))


@query(f"""WITH {_SEG}, m AS (SELECT segment_id, window_id, box_right - box_left + 1 > 0 AND (box_bottom - box_top + 1)::DOUBLE / (box_right - box_left + 1) >= 2.0 AS tall FROM s
WHERE box_left IS NOT NULL AND box_top IS NOT NULL AND box_right IS NOT NULL AND box_bottom IS NOT NULL AND text IS NOT NULL)
SELECT segment_id, CASE WHEN tall THEN 'tall' ELSE 'wide' END AS shape, CASE WHEN NOT tall AND window_id = 0 THEN 'alternate_read_non_tall' WHEN tall THEN 'repeat_drift_tall' ELSE 'p2_meaningful_temp0' END AS detector_branch,
'meaningful_difference' AS diff_label, TRUE AS meaningful, CASE WHEN NOT tall AND window_id = 0 THEN 'hybrid_detector' WHEN tall THEN 'hybrid_detector,p2_meaningful_temp0' ELSE 'p2_meaningful_temp0' END AS tags
FROM m WHERE window_id = 1 OR (window_id = 0 AND NOT tall)""")
def planted_surface(spark, sf_dir):
    """The wider surface of readings that say more: the fast one in window 0, the repeated one in window 1."""
    boxes = segments(spark, sf_dir).dropna(subset=["box_left", "box_right", "box_top", "box_bottom"])
    boxes = boxes.select("segment_id", "window_id", F.col("text").alias("baseline_text"), (F.col("box_right") - F.col("box_left") + 1).alias("width"), (F.col("box_bottom") - F.col("box_top") + 1).alias("height"))
    more = lambda w, x: boxes.select("segment_id", F.when(F.col("window_id") == w, F.concat("baseline_text", F.lit(x))).otherwise(F.col("baseline_text")).alias("option_text"))
    prepared = detect.with_shape(boxes).withColumn("ordinal", F.col("segment_id"))
    out = detect.detector_surface(prepared, more(0, "x"), more(1, "y"), ["segment_id"], "ordinal", wider=True)
    return out.select("segment_id", "shape", "detector_branch", "diff_label", "meaningful", F.array_join("source_tags", ",").alias("tags"))


def _readings(spark, sf_dir):
    """Names of parts in a baseline, another reading that differs in one sign, and a text that changes this and adds one."""
    part = load(spark, sf_dir, "part")
    read = lambda sign, end="": F.concat("p_name", F.lit(sign), F.col("p_partkey").cast("string"), F.lit(end))
    return part.select("p_partkey", "p_size", read("#").alias("baseline_text"), read("@").alias("option_text"), read("%", "!").alias("corrector_text"))


@query("SELECT p_partkey, p_name || '%' || p_partkey AS merged_text, 1 AS applied, length(p_name) AS left_start, '#' AS was, '%' AS becomes FROM part")
def planted_merges(spark, sf_dir):
    """Only the edit of the candidate where the readings differ is taken."""
    rows = _readings(spark, sf_dir).withColumn("m", anchor_merge(F.col("baseline_text"), F.col("option_text"), F.col("corrector_text")))
    op = F.col("m.applied_ops")[0]
    return rows.select("p_partkey", "m.merged_text", F.size("m.applied_ops").alias("applied"), op["left_start"].cast("long").alias("left_start"), op["left"].alias("was"), op["right"].alias("becomes"))


@query("""SELECT p_partkey, 1 AS anchor_count, CASE WHEN p_size % 5 = 0 THEN p_name || '#' || p_partkey ELSE p_name || '%' || p_partkey END AS conservative_merged_text, CASE WHEN p_size % 5 = 0 THEN 0 ELSE 1 END AS applied_op_count,
p_size % 5 <> 0 AS raw_changed, p_size % 5 <> 0 AS merged_changed, CASE WHEN p_size % 5 = 0 THEN 'fallback_baseline' ELSE 'applied' END AS corrector_status, CASE WHEN p_size % 5 = 0 THEN 'refused' ELSE '' END AS corrector_error FROM part""")
def planted_corrections(spark, sf_dir):
    """Records of a corrector that fails on some parts and says too much on the others."""
    fails = F.col("p_size") % 5 == 0
    answers = _readings(spark, sf_dir).withColumn("corrector_text", F.when(~fails, F.col("corrector_text"))).withColumn("corrector_error", F.when(fails, "refused"))
    out = correct.correction_records(answers, "planted", "text")
    return out.select("p_partkey", "anchor_count", "conservative_merged_text", "applied_op_count", "raw_changed", "merged_changed", "corrector_status", "corrector_error")


@query("""WITH g AS (SELECT p_type, count(*) AS n, sum(p_size) AS size FROM part GROUP BY 1), r AS (SELECT *, rank() OVER (ORDER BY n DESC, size) AS place FROM g)
SELECT p_type, n, size FROM r WHERE place = 1 AND (SELECT count(*) FROM r WHERE place = 1) = 1""")
def rank_tie_reject(spark, sf_dir):
    types = load(spark, sf_dir, "part").groupBy("p_type").agg(F.count("*").alias("n"), F.sum("p_size").alias("size"))
    return ranking.sole_best(types, [F.desc("n"), F.asc("size")])


@query("""SELECT p_partkey, CASE WHEN contains(p_name, 'e') THEN replace(p_name, 'e', 'o') ELSE replace(p_name, 'o', 'e') END AS option_text,
CASE WHEN contains(p_name, 'e') THEN 'e' ELSE 'o' END AS current_char, CASE WHEN contains(p_name, 'e') THEN 'o' ELSE 'e' END AS alternate_char FROM part WHERE contains(p_name, 'e') <> contains(p_name, 'o')""")
def family_swap(spark, sf_dir):
    rows = load(spark, sf_dir, "part").withColumn("s", swap_pair(F.col("p_name"), F.lit("eo"))).where("s is not null")
    return rows.select("p_partkey", "s.option_text", "s.current_char", "s.alternate_char")


@query("""WITH f AS (SELECT unnest(['an', 'eo', 'xz', 'la']) AS family) SELECT family, count(*) AS agreement_rows FROM part, f
WHERE contains(p_name, family[1]) <> contains(p_name, family[2]) GROUP BY family""")
def family_agreement(spark, sf_dir):
    families = spark.createDataFrame([("an",), ("eo",), ("xz",), ("la",)], "family string")
    return detect.family_agreement(load(spark, sf_dir, "part"), families, "p_name")


@query(f"""WITH {_SEG}, {_COR}, z AS (SELECT segment_id, arg_max(merged_text, correction_id) AS t FROM k WHERE merged_text IS NOT NULL GROUP BY 1)
SELECT s.segment_id, coalesce(z.t, s.text) AS text, z.t IS NOT NULL AS was_corrected FROM s LEFT JOIN z ON s.segment_id = z.segment_id""")
def correction_overlay(spark, sf_dir):
    out = correct.overlay(segments(spark, sf_dir), corrections(spark, sf_dir), ["segment_id"], "text", "merged_text", "correction_id")
    return out.select("segment_id", "text", "was_corrected")


@query()
def anchor_merges(spark, sf_dir):
    """Conservative merge of every correction's own text into its baseline."""
    rows = corrections(spark, sf_dir).where("baseline_text is not null and option_text is not null")
    rows = rows.withColumn("m", anchor_merge(F.col("baseline_text"), F.col("option_text"), F.coalesce("merged_text", "baseline_text")))
    return rows.select("correction_id", "m.merged_text", F.size("m.applied_ops").alias("applied"), kanji_families(F.col("baseline_text"), F.col("option_text")).alias("families"))


@query()
def correction_records(spark, sf_dir):
    """Records of corrected texts, with the baseline where the corrector failed."""
    rows = corrections(spark, sf_dir).where("baseline_text is not null and option_text is not null")
    answers = rows.select("correction_id", "baseline_text", "option_text", F.col("merged_text").alias("corrector_text"), F.when(F.col("merged_text").isNull(), F.col("corrector_status")).alias("corrector_error"))
    return correct.correction_records(answers, "table", "text").select("correction_id", "anchor_count", "conservative_merged_text", "applied_op_count", "raw_changed", "merged_changed", "corrector_status")


@query(f"WITH {_COR} SELECT source_id, count(*) AS processed, count(*) FILTER (merged_text IS NOT NULL) AS applied, count(*) FILTER (merged_text IS NULL) AS fallback FROM k GROUP BY source_id")
def correction_counters(spark, sf_dir):
    status = F.when(F.col("merged_text").isNull(), correct.FALLBACK).otherwise(correct.APPLIED)
    return correct.counters(corrections(spark, sf_dir).withColumn("status", status), ["source_id"], "status")


_WP = "SELECT l_returnflag, min(l_quantity) AS {1} FROM (SELECT l_returnflag, l_quantity, sum(w) OVER (PARTITION BY l_returnflag ORDER BY l_quantity) AS run, sum(w) OVER (PARTITION BY l_returnflag) AS total FROM {2}) WHERE run >= total * {0} GROUP BY 1"
_LW = "(SELECT l_returnflag, l_quantity, sum(l_linenumber) AS w FROM lineitem GROUP BY 1, 2)"


@query(f"SELECT a.l_returnflag, p60, median FROM ({_WP.format(0.6, 'p60', _LW)}) a JOIN ({_WP.format(0.5, 'median', _LW)}) b ON a.l_returnflag = b.l_returnflag")
def weighted_percentiles(spark, sf_dir):
    rows = load(spark, sf_dir, "lineitem")
    p60 = stats.weighted_percentile(rows, ["l_returnflag"], "l_quantity", "l_linenumber", 0.6, "p60")
    return p60.join(stats.weighted_median(rows, ["l_returnflag"], "l_quantity", "l_linenumber"), "l_returnflag")


_STATS = f"""p AS ({_WP.format(0.6, 'pv', _LW)}),
u AS (SELECT l.l_returnflag, l_quantity, sum(l_linenumber) AS w FROM lineitem l JOIN p ON l.l_returnflag = p.l_returnflag AND l_quantity >= pv GROUP BY 1, 2),
m AS ({_WP.format(0.5, 'main_thickness', 'u')})"""


@query(f"""WITH {_STATS} SELECT m.l_returnflag, main_thickness, (SELECT count(*) FROM lineitem l WHERE l.l_returnflag = m.l_returnflag) AS lines,
greatest(3.0, main_thickness * 0.84) AS main_min_thickness, greatest(2.0, main_thickness * 0.18) AS furigana_min_thickness,
greatest(2.0, main_thickness * 0.76) AS furigana_max_thickness, greatest(2.0, main_thickness * 1.4) AS max_cross_gap, 0.2::DOUBLE AS min_flow_overlap_ratio FROM m""")
def line_statistics(spark, sf_dir):
    return stats.line_stats(load(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity", "l_linenumber")


@query(f"WITH {_STATS} SELECT l_orderkey, l_linenumber, l_quantity >= greatest(3.0, main_thickness * 0.84) AS is_main FROM lineitem l LEFT JOIN m ON l.l_returnflag = m.l_returnflag")
def global_statistics(spark, sf_dir):
    """Statistics of all lines brought back to each."""
    out = stats.with_line_stats(load(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity", "l_linenumber")
    return out.select("l_orderkey", "l_linenumber", (F.col("l_quantity") >= F.col("main_min_thickness")).alias("is_main"))


@query("SELECT lang, quantile_cont(n_chars, 0.15) AS p15, quantile_cont(n_chars, 0.85) AS p85 FROM documents GROUP BY lang")
def histogram_percentiles(spark, sf_dir):
    return stats.histogram_percentile(load(spark, sf_dir, "documents"), ["lang"], "n_chars", {"p15": 15.0, "p85": 85.0})


@query(f"""WITH {_EV}, v AS (SELECT user_id, us AS a, us + CAST(floor(value * 60000000) AS BIGINT) AS b, event_id FROM e), f AS (SELECT * FROM v WHERE b > a),
m AS (SELECT *, max(b) OVER (PARTITION BY user_id ORDER BY a, b, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM f),
i AS (SELECT *, sum(CASE WHEN prev IS NULL OR a > prev THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY a, b, event_id) AS island FROM m)
SELECT user_id, min(a) AS start_us, max(b) AS end_us FROM i GROUP BY user_id, island""")
def merge_ranges(spark, sf_dir):
    rows = events(spark, sf_dir).select("user_id", "event_id", F.col("us").alias("a"), (F.col("us") + F.floor(F.col("value") * 60_000_000)).cast("long").alias("b"))
    found = intervals.periods_and_gaps(rows, ["user_id"], "a", "b", "event_id", 86_400_000_000).where("kind = 'period'")
    return found.select("user_id", F.col("start_ms").alias("start_us"), F.col("end_ms").alias("end_us"))


_SPAN = "l_orderkey, l_linenumber, l_quantity, l_linenumber * 3 AS c0, l_linenumber * 3 + 1 AS c1, date_diff('day', DATE '1990-01-01', CAST(l_shipdate AS DATE)) AS f0, date_diff('day', DATE '1990-01-01', CAST(l_shipdate AS DATE)) + CAST(l_quantity AS BIGINT) AS f1"


@query(f"""WITH v AS (SELECT {_SPAN} FROM lineitem) SELECT a.l_orderkey, a.l_linenumber FROM v a WHERE a.l_quantity < 30 AND EXISTS (SELECT 1 FROM v m WHERE m.l_orderkey = a.l_orderkey AND m.l_quantity >= 30
AND greatest(0, m.c0 - a.c1 - 1, a.c0 - m.c1 - 1) <= 2 AND greatest(0, least(a.f1, m.f1) - greatest(a.f0, m.f0) + 1)::DOUBLE / greatest(1, least(a.f1 - a.f0, m.f1 - m.f0) + 1) >= 0.2)""")
def theta_semi(spark, sf_dir):
    """Thin lines near a thick one of their order that they overlap."""
    day = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1990-01-01").cast("date"))
    v = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", (F.col("l_linenumber") * 3).alias("c0"), (F.col("l_linenumber") * 3 + 1).alias("c1"), day.alias("f0"), (day + F.col("l_quantity").cast("long")).alias("f1"))
    found = relate.matches_any(v.where("l_quantity < 30"), v.where("l_quantity >= 30"), ["l_orderkey"], ("c0", "c1"), ("f0", "f1"), 2, 0.2)
    return found.select("l_orderkey", "l_linenumber")


@query(f"WITH {_SEG} SELECT source_id, window_id, min(box_left) AS box_left, min(box_top) AS box_top, max(box_right) AS box_right, max(box_bottom) AS box_bottom FROM s GROUP BY source_id, window_id")
def bbox_union(spark, sf_dir):
    return relate.box_union(segments(spark, sf_dir), ["source_id", "window_id"])


@query(f"""WITH {_SEG}, v AS (SELECT * FROM s WHERE start_ms IS NOT NULL), l AS (SELECT segment_id, source_id, start_ms, CASE WHEN start_ms IS DISTINCT FROM lag(start_ms) OVER w THEN 1 ELSE 0 END AS new FROM v WINDOW w AS (PARTITION BY source_id ORDER BY start_ms, segment_id)),
f AS (SELECT *, sum(new) OVER (PARTITION BY source_id ORDER BY start_ms, segment_id) AS frame_index FROM l)
SELECT segment_id, CAST(frame_index AS BIGINT) AS frame_index, row_number() OVER (PARTITION BY source_id, frame_index ORDER BY start_ms, segment_id) AS segment_index FROM f""")
def frame_segment_index(spark, sf_dir):
    rows = segments(spark, sf_dir).where("start_ms is not null")
    return timeline.frame_and_segment(rows, ["source_id"], ["start_ms", "segment_id"], ["start_ms"], ("start_ms", 3_600_000)).select("segment_id", "frame_index", F.col("segment_index").cast("long").alias("segment_index"))


@query(f"WITH {_SEG} SELECT segment_id FROM s WHERE (source_id, start_ms) IN (SELECT (source_id, start_ms) FROM s WHERE box_left IS NULL AND start_ms IS NOT NULL)")
def same_frame(spark, sf_dir):
    """Segments that share a frame with one that has no box."""
    return relate.same_frame(segments(spark, sf_dir), F.col("box_left").isNull() & F.col("start_ms").isNotNull(), ["source_id", "start_ms"]).select("segment_id")


@query("SELECT p_brand, p_partkey, p_retailprice FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) <= 3")
def top_per_group(spark, sf_dir):
    out = ranking.top_per_group(load(spark, sf_dir, "part"), ["p_brand"], [F.desc("p_retailprice"), F.col("p_partkey")], 3)
    return out.select("p_brand", "p_partkey", "p_retailprice")


@query("""WITH t AS (SELECT s_suppkey, s_nationkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS turn FROM supplier)
SELECT s_suppkey, row_number() OVER (ORDER BY turn, s_nationkey) AS slot FROM t""")
def round_robin(spark, sf_dir):
    out = ranking.round_robin(load(spark, sf_dir, "supplier"), "s_nationkey", [F.desc("s_acctbal"), F.col("s_suppkey")], F.col("s_nationkey"))
    return out.select("s_suppkey", F.col("slot").cast("long").alias("slot"))


@query("""WITH t AS (SELECT * FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) <= p_size % 4) SELECT p_partkey FROM t ORDER BY p_partkey LIMIT 40""")
def budgeted_queue(spark, sf_dir):
    """Parts in order while their brand's budget and the whole budget last."""
    rows = load(spark, sf_dir, "part").withColumn("budget", F.col("p_size") % 4)
    return ranking.budgeted(rows, "p_brand", [F.col("p_partkey")], "budget", 40).select("p_partkey")


@query("SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_size % 3, p_partkey) AS place FROM part")
def ranked_attempts(spark, sf_dir):
    rows = load(spark, sf_dir, "part").withColumn("attempts", F.when(F.col("p_size") % 3 != 0, F.col("p_size") % 3))
    return ranking.ranked_attempts(rows, ["p_brand"], "attempts", "p_partkey").select("p_partkey", F.col("place").cast("long").alias("place"))


@query("SELECT s_suppkey, s_nationkey FROM supplier WHERE s_acctbal > 0 AND s_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9950)")
def pending_promotions(spark, sf_dir):
    """Suppliers in credit of nations without a rich customer."""
    ledger = load(spark, sf_dir, "supplier").withColumn("status", F.when(F.col("s_acctbal") > 0, "passed").otherwise("failed"))
    allowed = load(spark, sf_dir, "customer").where("c_acctbal > 9950").select(F.col("c_nationkey").alias("s_nationkey"))
    return ranking.pending(ledger, allowed, ["s_nationkey"]).select("s_suppkey", "s_nationkey")


@query("SELECT p_brand, pattern, arg_min(p_name, p_partkey) AS p_name, min(p_partkey) AS p_partkey FROM part, (SELECT unnest(['a.*e', '^p', 'x$']) AS pattern) WHERE regexp_matches(p_name, pattern) GROUP BY 1, 2")
def first_matching(spark, sf_dir):
    """First part of each brand whose name fits each of a few patterns."""
    part = load(spark, sf_dir, "part")
    patterns = part.select("p_brand").distinct().withColumn("pattern", F.explode(F.array(F.lit("a.*e"), F.lit("^p"), F.lit("x$"))))
    return ranking.first_matching(part, patterns, "p_brand", "p_name", "pattern", "p_partkey")


@query("""WITH p AS (SELECT unnest(['a.*e', '^b', 'g$']) AS pattern), c AS (SELECT p_brand, pattern, arg_min((p_name, CASE WHEN p_size > 1 THEN p_type END), p_partkey) AS v, min(p_partkey) AS p_partkey FROM part, p WHERE regexp_matches(p_name, pattern) GROUP BY 1, 2),
x AS (SELECT p_brand, pattern, v[1] AS p_name, v[2] AS digest, p_partkey FROM c) SELECT * FROM x WHERE p_brand IN (SELECT p_brand FROM x GROUP BY 1 HAVING count(digest) = 3)""")
def complete_selection(spark, sf_dir):
    """First parts of the brands that have one for each pattern, all of them with what stands for a digest."""
    part = load(spark, sf_dir, "part").withColumn("digest", F.when(F.col("p_size") > 1, F.col("p_type")))
    patterns = part.select("p_brand").distinct().withColumn("pattern", F.explode(F.array(F.lit("a.*e"), F.lit("^b"), F.lit("g$"))))
    return ranking.complete_selection(part, patterns, "p_brand", "p_name", "pattern", "p_partkey", "digest").select("p_brand", "pattern", "p_name", "digest", "p_partkey")


@query("""WITH l AS (SELECT n_name, n_nationkey AS position FROM nation WHERE n_nationkey % 2 = 0)
SELECT n.n_name, position, row_number() OVER (ORDER BY position NULLS LAST, n.n_name) AS place FROM nation n LEFT JOIN l ON n.n_name = l.n_name""")
def listed_first(spark, sf_dir):
    """Listed nations in list order, the others by name."""
    from pyspark.sql.window import Window

    nation = load(spark, sf_dir, "nation")
    listing = nation.where("n_nationkey % 2 = 0").select("n_name", F.col("n_nationkey").alias("position"))
    out = ranking.listed_first(nation, listing, "n_name", "position")
    place = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.asc_nulls_last("position"), "n_name"))
    return out.select("n_name", "position", place.cast("long").alias("place"))


@query("""SELECT 'all' AS kind, k FROM (SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) INTERSECT SELECT 'all', n_nationkey FROM nation WHERE n_regionkey < 3
UNION ALL SELECT 'any', k FROM (SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier) WHERE k IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3)""")
def panel_entries(spark, sf_dir):
    """Nations of both panels, or of either, in allowed regions."""
    panels = [load(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")), load(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"))]
    allowed = load(spark, sf_dir, "nation").where("n_regionkey < 3").select(F.col("n_nationkey").alias("k"))
    both = relate.panel_entries(panels, "k", True, allowed).select(F.lit("all").alias("kind"), "k")
    return both.unionByName(relate.panel_entries(panels, "k", False, allowed).select(F.lit("any").alias("kind"), "k"))


@query("""WITH o AS (SELECT o_custkey, o_orderkey, list(DISTINCT l_suppkey) AS x FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2),
p AS (SELECT *, lag(x) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS y FROM o)
SELECT o_orderkey, len(list_intersect(x, y))::DOUBLE / len(list_distinct(x || y)) AS overlap FROM p WHERE y IS NOT NULL""")
def set_overlap(spark, sf_dir):
    """Overlap of the suppliers of each order with those of the customer's order before."""
    from pyspark.sql.window import Window

    rows = load(spark, sf_dir, "orders").join(load(spark, sf_dir, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    sets = rows.groupBy("o_custkey", "o_orderkey").agg(F.collect_set("l_suppkey").alias("x"))
    before = sets.withColumn("y", F.lag("x").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))).where("y is not null")
    return before.select("o_orderkey", jaccard(F.col("x"), F.col("y")).alias("overlap"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_field(spark, sf_dir):
    return load(spark, sf_dir, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("SELECT doc_id, sha256(coalesce(CAST(doc_id AS VARCHAR), chr(0)) || chr(31) || coalesce(source, chr(0)) || chr(31) || coalesce(CAST(n_chars AS VARCHAR), chr(0))) AS key FROM documents")
def request_keys(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", request_key([F.col("doc_id"), F.col("source"), F.col("n_chars")]).alias("key"))


@query(f"WITH {_SEG} SELECT segment_id, regexp_replace(text, '^{_BLANKS}+|{_BLANKS}+$', '', 'g') AS text, CASE WHEN end_ms <= start_ms THEN start_ms + 1 ELSE end_ms END AS end_ms FROM s WHERE text <> ''")
def repaired_segments(spark, sf_dir):
    """Segments with text, stripped, and their ends repaired."""
    rows = timeline.text_segments(segments(spark, sf_dir))
    return rows.select("segment_id", strip_blanks(F.col("text")).alias("text"), "end_ms")


@query("""WITH o AS (SELECT o_custkey AS k, epoch_us(o_orderdate) AS t, o_orderkey FROM orders), d AS (SELECT DISTINCT k, t FROM o),
s AS (SELECT o_custkey AS k, epoch_us(o_orderdate) AS t, max(o_totalprice) AS price FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY ALL),
j AS (SELECT d.k, d.t, s.price FROM d ASOF LEFT JOIN s ON d.k = s.k AND d.t >= s.t) SELECT o_orderkey, price FROM o JOIN j ON o.k = j.k AND o.t = j.t""")
def as_of_state(spark, sf_dir):
    """Price of the customer's latest urgent order at each order."""
    orders = load(spark, sf_dir, "orders").withColumn("t", F.unix_micros(F.col("o_orderdate").cast("timestamp")))
    states = orders.where("o_orderpriority = '1-URGENT'").select("o_custkey", "t", F.col("o_totalprice").alias("price"))
    out = asof.as_of(orders.select("o_orderkey", "o_custkey", "t"), states, ["o_custkey"], "t", ["price"], 90 * 86_400_000_000)
    return out.select("o_orderkey", "price")


@query("""SELECT n_regionkey, string_agg(n_name, ',' ORDER BY place, n_nationkey) AS names FROM (
SELECT n_regionkey, n_name, min(n_nationkey) AS n_nationkey, min(CASE WHEN n_nationkey % 3 = 0 THEN 0 ELSE 1 END) AS place FROM nation GROUP BY 1, 2) GROUP BY 1""")
def merged_listing(spark, sf_dir):
    """Promoted nations of each region ahead of all its nations, each once."""
    from .functions.scalar import ordered_union

    nation = load(spark, sf_dir, "nation")
    names = lambda rows: F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: x["n_name"])
    listed = nation.groupBy("n_regionkey").agg(names(nation).alias("listed"))
    promoted = nation.where("n_nationkey % 3 = 0").groupBy("n_regionkey").agg(names(nation).alias("promoted"))
    return listed.join(promoted, "n_regionkey", "left").select("n_regionkey", F.array_join(ordered_union(F.col("promoted"), F.col("listed")), ",").alias("names"))
