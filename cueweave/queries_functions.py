"""Queries of the scalar functions: each over a whole table, on texts made from its columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions.scalar import FIRST_PROMPT, answer_text, data_url, length_fallback, prompt_for_shape, remaining_seconds, retry_after, retry_delay, safe_box, safe_int, window_start
from .functions.text import equivalence_text, japanese_fold, punctuation_fold
from .operators import relate
from .session import load

QUERIES = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(function):
        QUERIES[function.__name__] = function
        SQL[function.__name__] = sql
        return function

    return add


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN (event_id % 50 + 0.5)::DOUBLE WHEN 1 THEN greatest(0, (epoch_us(date_trunc('second', ts + to_seconds(event_id % 90 - 10))) - epoch_us(ts)) / 1000000.0)::DOUBLE END AS after,
CASE WHEN event_id % 2 = 0 THEN (event_id % 30 + 0.25)::DOUBLE END AS delay FROM events""")
def retry_hints(spark, sf_dir):
    """Waits that a server asks for: in seconds, by a date, in an error's details, or not at all."""
    rows = load(spark, sf_dir, "events").withColumn("n", F.col("event_id") % 4)
    date = F.date_format(F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("event_id") % 90 - 10), "EEE, dd MMM yyyy HH:mm:ss 'GMT'")
    header = F.when(F.col("n") == 0, F.format_string(" %d.5", F.col("event_id") % 50)).when(F.col("n") == 1, date).when(F.col("n") == 2, "soon")
    body = F.when(F.col("event_id") % 2 == 0, F.format_string('{"error": {"details": [{"reason": "busy"}, {"retryDelay": "%d.25s"}]}}', F.col("event_id") % 30)).otherwise("{broken")
    return rows.select("event_id", retry_after(header, F.col("ts")).alias("after"), retry_delay(body).alias("delay"))


@query("SELECT event_id, 'E' || event_id || event_type AS text, CASE WHEN event_id % 2 = 0 THEN 'hm' ELSE '' END AS thoughts FROM events")
def answer_texts(spark, sf_dir):
    """Text and thoughts of answers in JSON."""
    rows = load(spark, sf_dir, "events")
    thought = F.when(F.col("event_id") % 2 == 0, '{"text": "hm ", "thought": true}, ').otherwise('{"thought": true}, ')
    body = F.concat(F.lit('{"candidates": [{"content": {"parts": ['), thought, F.format_string('{"text": " E%d"}]}}, {"content": {"parts": [{"text": "%s "}]}}]}', "event_id", "event_type"))
    return rows.withColumn("a", answer_text(body)).select("event_id", "a.text", "a.thoughts")


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 > 0 THEN p_size END AS number, CASE WHEN p_partkey % 3 = 1 THEN p_size + p_size + 1 + p_size + 2 + p_size + 3 END AS box_sum FROM part")
def safe_values(spark, sf_dir):
    """Numbers and boxes of texts that may hold none."""
    rows = load(spark, sf_dir, "part").withColumn("n", F.col("p_partkey") % 3)
    text = F.when(F.col("n") > 0, F.col("p_size").cast("string")).otherwise(F.col("p_name"))
    corner = lambda i: (F.col("p_size") + i).cast("string")
    box = F.when(F.col("n") == 1, F.array(*[corner(i) for i in range(4)])).when(F.col("n") == 2, F.array(corner(0), F.col("p_name"), corner(2), corner(3))).otherwise(F.array(corner(0)))
    return rows.select("p_partkey", safe_int(text).alias("number"), F.aggregate(safe_box(box), F.lit(0), lambda a, x: a + x).alias("box_sum"))


@query(f"""SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'T' WHEN p_size % 3 = 1 THEN 'W' ELSE 'any' END AS prompt,
p_size % 4 < 2 AND p_size % 5 <> 0 AS again FROM part""")
def prompts_by_shape(spark, sf_dir):
    """Prompt of each shape, and whether an answer cut off at the limit is asked for again."""
    rows = load(spark, sf_dir, "part")
    shape = F.when(F.col("p_size") % 3 == 0, "tall").when(F.col("p_size") % 3 == 1, "wide").otherwise("square")
    role = F.element_at(F.array(*map(F.lit, ("ocr", "ocr-fast", "detector", "corrector"))), (F.col("p_size") % 4 + 1).cast("int"))
    prompt = F.when(F.col("p_size") % 5 == 0, "else").otherwise(FIRST_PROMPT)
    return rows.select("p_partkey", prompt_for_shape(shape, {"tall": "T", "wide": "W"}, "any").alias("prompt"), length_fallback(role, prompt).alias("again"))


@query("""WITH v AS (SELECT l_orderkey, l_linenumber, l_linenumber AS a, l_linenumber + CAST(l_quantity AS BIGINT) % 3 AS b FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN a = b THEN a IN (6) OR (2 <= a AND a < 4) ELSE (2 < b AND a < 4) OR (a <= 6 AND 6 <= b) END AS touched FROM v""")
def touched_spans(spark, sf_dir):
    """Edits that touch an uncertain range or point."""
    rows = load(spark, sf_dir, "lineitem").withColumn("a", F.col("l_linenumber")).withColumn("b", F.col("l_linenumber") + F.col("l_quantity").cast("long") % 3)
    ranges, points = F.array(F.struct(F.lit(2).alias("start"), F.lit(4).alias("end"))), F.array(F.lit(6))
    return rows.select("l_orderkey", "l_linenumber", relate.touches_spans(F.col("a"), F.col("b"), ranges, points).alias("touched"))


@query("SELECT o_orderkey, greatest(epoch_us(TIMESTAMP '1998-08-02' - INTERVAL 120 DAY), CASE WHEN o_orderkey % 7 > 0 THEN epoch_us(o_orderdate - INTERVAL 14 DAY) ELSE 0 END) AS since_us FROM orders")
def rescan_starts(spark, sf_dir):
    """Start of the window that a scan looks at again."""
    rows = load(spark, sf_dir, "orders").withColumn("last", F.when(F.col("o_orderkey") % 7 > 0, F.col("o_orderdate")).cast("timestamp"))
    since = window_start(F.lit("1998-08-02").cast("timestamp"), F.col("last"))
    return rows.select("o_orderkey", F.unix_micros(since).alias("since_us"))


@query("SELECT l_orderkey, l_linenumber, greatest(0, l_quantity * CASE WHEN l_linenumber > 2 THEN l_tax * 64 / l_linenumber ELSE 1.5 END)::DOUBLE AS seconds FROM lineitem")
def remaining_times(spark, sf_dir):
    """Seconds left, at the prior rate before anything is done and at the observed one after."""
    done = F.when(F.col("l_linenumber") > 2, F.col("l_linenumber")).otherwise(0)
    return load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", remaining_seconds(F.col("l_quantity"), F.lit(1.5), done, F.col("l_tax") * 64).alias("seconds"))


@query("SELECT p_partkey, 'data:image/png;base64,' || base64(CAST(p_name AS BLOB)) AS url FROM part")
def data_urls(spark, sf_dir):
    return load(spark, sf_dir, "part").select("p_partkey", data_url(F.encode("p_name", "UTF-8")).alias("url"))


@query("SELECT 'exact' AS kind, n_nationkey FROM nation WHERE n_name = (SELECT n_name FROM nation WHERE n_nationkey = 3) UNION ALL SELECT 'number', 7 UNION ALL SELECT 'prefix', min(n_nationkey) FROM nation WHERE starts_with(n_name, (SELECT n_name[1] FROM nation WHERE n_nationkey = 9))")
def entry_lookups(spark, sf_dir):
    """An entry by its name, by its number, and the first by a prefix."""
    nation = load(spark, sf_dir, "nation")
    names = {r.n_nationkey: r.n_name for r in nation.where("n_nationkey in (3, 9)").collect()}
    asked = {"exact": names[3], "number": " 7 ", "prefix": names[9][:1]}
    found = [relate.find_entry(nation, "n_name", "n_nationkey", "n_nationkey", q).select(F.lit(kind).alias("kind"), "n_nationkey") for kind, q in asked.items()]
    return found[0].unionByName(found[1]).unionByName(found[2])


@query(r"""WITH t AS (SELECT p_partkey, p_name || ' -- ' || p_type || '.  (' || p_size || ')' AS x FROM part), f AS (SELECT p_partkey, regexp_replace(regexp_replace(x, '\s+', '', 'g'), '-{2,}', '-', 'g') AS form FROM t)
SELECT p_partkey, form, regexp_replace(form, '[\p{P}\p{S}\p{Z}]', '', 'g') AS bare, form AS folded FROM f""")
def plain_forms(spark, sf_dir):
    """The three forms of texts without other characters than ASCII, which their normal form leaves as they are."""
    text = F.concat("p_name", F.lit(" -- "), "p_type", F.lit(".  ("), F.col("p_size").cast("string"), F.lit(")"))
    rows = load(spark, sf_dir, "part").withColumn("form", equivalence_text(text))
    return rows.select("p_partkey", "form", punctuation_fold(F.col("form")).alias("bare"), japanese_fold(F.col("form")).alias("folded"))
