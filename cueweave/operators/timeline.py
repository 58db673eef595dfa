"""Timeline operators: ends from next starts, islands, and the two cue policies.

Every table carries ``keys`` (the source, mostly) and an ordinal. With
``bucket`` a scan is cut into buckets of its order (see ``scan``), so that no
task holds a whole source; without, its windows are partitioned by the keys.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import strip_blanks
from ..session import stage
from .scan import bucket_of, numbered, packed_keys, stitch, with_carry, with_neighbour

EOF_PTS = 180_000
LEAST_PTS = 90
ISLAND_GAP_PTS = 180
#: Width of a bucket of the safe policy: bounds the rows that are joined with each other.
SAFE_BUCKET_MS = 20_000
#: Buckets up to which a segment of the safe policy is cut at each.
SHORT_SPANS = 16


def _bucketed(df: DataFrame, keys: Sequence[str], bucket: tuple[str, int]) -> DataFrame:
    return df.withColumns({"_k": F.struct(*[F.col(k) for k in keys]), "_b": bucket_of(*bucket)})


def next_start_end(df: DataFrame, keys: Sequence[str], order: Sequence[str], start: str, keep: Column | None = None, end: str = "end_pts", bucket: tuple[str, int] | None = None) -> DataFrame:
    """End of each row: the start of the next row of its keys, its own start for the last.

    ``keep`` filters after the look-ahead, so that blank rows still end the row
    before them. ``bucket``, the first column of ``order`` and a width, scans
    long entities in parts.
    """
    if bucket is None:
        out = df.withColumn(end, F.coalesce(F.lead(start).over(Window.partitionBy(*keys).orderBy(*order)), F.col(start)))
    else:
        near = with_neighbour(_bucketed(df, keys, bucket), ["_k"], "_b", order, [start], "_next", ahead=True)
        out = near.withColumn(end, F.coalesce(F.col(f"_next.{start}"), F.col(start))).drop("_next", "_k", "_b")
    return out if keep is None else out.where(keep)


def repair_zero_duration(df: DataFrame, keys: Sequence[str], order: Sequence[str], start: str = "start_pts", end: str = "end_pts", first_n: int | None = None, bucket: tuple[str, int] | None = None) -> DataFrame:
    """Ends not after their starts repaired from the next candidate; the first ``first_n`` kept.

    The last candidate gets a fixed length, others end a millisecond before the
    next start, a millisecond after their own at least. The limit looks ahead
    over all candidates first. ``bucket`` as in ``next_start_end``.
    """
    if first_n is not None and first_n <= 0:
        raise ValueError("first_n must be positive")
    if bucket is None:
        rows, ahead = df, F.lead(start).over(Window.partitionBy(*keys).orderBy(*order))
    else:
        rows, ahead = with_neighbour(_bucketed(df, keys, bucket), ["_k"], "_b", order, [start], "_next", ahead=True), F.col(f"_next.{start}")
    out = rows.withColumn(end, repaired_end(F.col(start), F.col(end), ahead)).drop("_next", "_k", "_b")
    return out if first_n is None else first_rows(out, keys, order, first_n, bucket)


def repaired_end(start: Column, end: Column, ahead: Column) -> Column:
    """``end``, or one from ``ahead``, the start of the next candidate, if it is not after ``start``."""
    repaired = F.when(ahead.isNull(), start + EOF_PTS).otherwise(F.greatest(start + LEAST_PTS, F.greatest(F.lit(0), ahead - LEAST_PTS)))
    return F.when(end <= start, repaired).otherwise(end)


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int, bucket: tuple[str, int] | None = None) -> DataFrame:
    """The first ``n`` rows of each of ``keys``; with ``bucket`` the first of each bucket, and then of those."""
    if bucket is None:
        rows = df.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    else:
        near = _bucketed(df, keys, bucket).withColumn("_near", F.row_number().over(Window.partitionBy("_k", "_b").orderBy(*order))).where(F.col("_near") <= n)
        rows = numbered(near, ["_k"], "_b", order, "_place").drop("_near", "_k", "_b")
    return rows.where(F.col("_place") <= n).drop("_place")


def islands(df: DataFrame, keys: Sequence[str], order: Sequence[str], same: str, start: str, end: str, max_gap: int | None = ISLAND_GAP_PTS, bucket: tuple[str, int] | None = None) -> DataFrame:
    """Consecutive rows of a track with the same ``same`` merged: keys, same, first ordinal, start, end, rows.

    A row goes on with the island before it if the gap to the previous end is at
    most ``max_gap`` (any, if null). The first ordinal is the last column of
    ``order`` at the island's first row. Exact where the ends of a track do not
    fall; ``fold_islands`` holds for more input. ``bucket`` as in
    ``next_start_end``: islands that cross buckets are stitched.
    """
    rows = _bucketed(df, keys, bucket) if bucket else df.withColumns({"_k": F.struct(*[F.col(k) for k in keys]), "_b": F.lit(0)})
    rows = with_neighbour(rows, ["_k"], "_b", order, [same, end], "_prev")
    goes_on = F.col("_prev").isNotNull() & F.col(same).eqNullSafe(F.col(f"_prev.{same}"))
    if max_gap is not None:
        goes_on &= F.greatest(F.lit(0), F.col(start) - F.col(f"_prev.{end}")) <= max_gap
    whole = Window.partitionBy("_k", "_b")
    marked = rows.withColumn("_no", F.sum(F.when(goes_on, 0).otherwise(1)).over(whole.orderBy(*order)))
    place = F.struct(*order)
    pieces = marked.groupBy("_k", "_b", "_no").agg(F.min(place).alias("_first"), F.min(start).alias("_start"), F.max(end).alias("_end"), F.count("*").alias("rows"), F.first(same).alias("_same"))
    pieces = pieces.withColumn("last", F.col("_no") == F.max("_no").over(whole)).withColumn("cont", F.col("_no") == 0)
    if bucket:
        pieces = stage(pieces, "island-pieces")
        pieces = stitch(pieces, ["_k"], "_b", "_no", "cont", "last", {"_first": F.min("_first"), "_start": F.min("_start"), "_end": F.max("_end"), "rows": F.sum("rows"), "_same": F.first("_same")})
    return pieces.select("_k.*", F.col("_same").alias(same), F.col(f"_first.{order[-1]}").alias("first_ordinal"), F.col("_start").alias(start), F.col("_end").alias(end), "rows")


def fold_islands(df: DataFrame, keys: Sequence[str], order: Sequence[str], same: str, start: str, end: str, max_gap: int = ISLAND_GAP_PTS, first: Sequence[str] = (), bucket: tuple[str, int] | None = None) -> DataFrame:
    """Islands whose end is the latest of their rows: keys, same, first ordinal, start, end, rows, ``first``.

    The gap is measured to the latest end of the island so far, which is the
    latest of the run of equal rows, as an island only breaks where that lies
    behind. Starts may not fall along the order, nor ends lie before starts.
    ``first`` are columns of the first row. ``bucket`` as in ``next_start_end``:
    a bucket takes over the latest end of the run that was open before it.
    """
    rows = _bucketed(df, keys, bucket) if bucket else df.withColumns({"_k": F.struct(*[F.col(k) for k in keys]), "_b": F.lit(0)})
    rows = with_neighbour(rows, ["_k"], "_b", order, [same], "_prev")
    whole = Window.partitionBy("_k", "_b")
    changed = F.col("_prev").isNull() | ~F.col(same).eqNullSafe(F.col(f"_prev.{same}"))
    rows = rows.withColumn("_changed", changed).withColumn("_run", F.sum(F.col("_changed").cast("long")).over(whole.orderBy(*order))).drop("_prev")
    latest = F.max(end).over(Window.partitionBy("_k", "_b", "_run").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    if bucket:
        tails = rows.groupBy("_k", "_b", "_run").agg(F.max(end).alias("_latest")).groupBy("_k", "_b").agg(F.max_by("_latest", "_run").alias("_latest"), F.max("_run").alias("_changes"))
        by_bucket = Window.partitionBy("_k").orderBy("_b")
        tails = tails.withColumn("_chain", F.sum((F.col("_changes") > 0).cast("long")).over(by_bucket))
        tails = tails.withColumn("_open", F.max("_latest").over(Window.partitionBy("_k", "_chain").orderBy("_b")))
        carries = tails.select("_k", "_b", F.lag("_open").over(by_bucket).alias("carry"))
        rows = with_carry(rows, carries, ["_k"], "_b").withColumn("_latest", F.greatest(latest, F.when(F.col("_run") == 0, F.col("carry")))).drop("carry")
    else:
        rows = rows.withColumn("_latest", latest)
    opens = F.col("_changed") | (F.col(start) - F.col("_latest") > max_gap)
    rows = rows.withColumn("_no", F.sum(opens.cast("long")).over(whole.orderBy(*order)))
    place = F.struct(*order)
    pieces = rows.groupBy("_k", "_b", "_no").agg(F.min(place).alias("_first"), F.min(start).alias("_start"), F.max(end).alias("_end"), F.count("*").alias("rows"), F.min_by(F.struct(F.col(same).alias("same"), *first), place).alias("_v"))
    if bucket:
        pieces = pieces.withColumn("last", F.col("_no") == F.max("_no").over(whole)).withColumn("cont", F.col("_no") == 0)
        pieces = stitch(stage(pieces, "fold-pieces"), ["_k"], "_b", "_no", "cont", "last", {"_v": F.min_by("_v", "_first"), "_start": F.min("_start"), "_end": F.max("_end"), "rows": F.sum("rows"), "_first": F.min("_first")})
    return pieces.select("_k.*", F.col("_v.same").alias(same), F.col(f"_first.{order[-1]}").alias("first_ordinal"), F.col("_start").alias(start), F.col("_end").alias(end), "rows", *[F.col(f"_v.{c}").alias(c) for c in first])


def clean_segments(df: DataFrame, text: str = "text", start: str = "start_ms", end: str = "end_ms") -> DataFrame:
    """Segments with text left after stripping, and an end after the start."""
    return df.withColumn(text, strip_blanks(F.col(text))).where((F.col(text) != "") & (F.col(end) > F.col(start)))


def text_segments(df: DataFrame, text: str = "text", start: str = "start_ms", end: str = "end_ms") -> DataFrame:
    """Recognised rows with text; ends not after their starts moved to a millisecond after."""
    return df.where(F.col(text) != "").withColumn(end, F.when(F.col(end) <= F.col(start), F.col(start) + 1).otherwise(F.col(end)))


def elementary_intervals(df: DataFrame, keys: Sequence[str], start: str, end: str, bucket_ms: int = 3_600_000) -> DataFrame:
    """Pairs of neighbouring boundaries per keys: keys, iv_start, iv_end."""
    points = df.select(packed_keys(keys), F.explode(F.array(start, end)).alias("iv_start")).withColumn("_b", bucket_of("iv_start", bucket_ms))
    points = points.repartition("_k", "_b").dropDuplicates(["_k", "_b", "iv_start"])
    pairs = with_neighbour(points, ["_k"], "_b", ["iv_start"], [], "_next", ahead=True)
    return pairs.where("_next is not null").select("_k.*", "iv_start", F.col("_next.iv_start").alias("iv_end"))


def _cut(rows: DataFrame, start: str, end: str, bucket_ms: int) -> DataFrame:
    """Rows (_k, start, end and more) cut where cells of time begin, with the cell as ``_b`` and the cut as ``_s`` and ``_e``.

    A row of up to ``SHORT_SPANS`` buckets is cut at each. A longer one is cut
    only at the buckets that others or its own ends touch, so that its length in
    time costs nothing: a cell of it reaches to the next such bucket.
    """
    first, last = bucket_of(start, bucket_ms), F.call_function("div", F.col(end) - 1 - F.pmod(F.col(end) - 1, F.lit(bucket_ms)), F.lit(bucket_ms))
    rows = rows.withColumns({"_first": first, "_last": last})
    short = rows.where(F.col("_last") - F.col("_first") < SHORT_SPANS).withColumn("_b", F.explode(F.sequence("_first", "_last"))).withColumn("_next", F.col("_b") + 1)
    long = rows.where(F.col("_last") - F.col("_first") >= SHORT_SPANS)
    ends = long.select("_k", F.explode(F.array("_first", "_last")).alias("_b"))
    touched = short.select("_k", "_b").unionByName(ends).distinct().withColumn("_next", F.lead("_b").over(Window.partitionBy("_k").orderBy("_b")))
    far = long.join(touched, "_k").where(F.col("_b").between(F.col("_first"), F.col("_last"))).withColumn("_next", F.coalesce("_next", F.col("_last") + 1))
    cut = short.unionByName(far)
    return cut.withColumn("_s", F.greatest(start, F.col("_b") * bucket_ms)).withColumn("_e", F.least(end, F.col("_next") * bucket_ms)).drop("_first", "_last", "_next")


def _runs_of(pieces: str) -> Column:
    """Pieces (s, e, t) of a cell with touching ones of the same text joined."""
    piece = lambda i: F.get(pieces, i)
    opens = F.filter(F.transform(pieces, lambda x, i: i), lambda i: (i == 0) | (piece(i - 1)["e"] != piece(i)["s"]) | (piece(i - 1)["t"] != piece(i)["t"]))
    return F.transform(opens, lambda i, n: F.struct(piece(i)["s"].alias("s"), piece(F.coalesce(F.get(opens, n + 1), F.size(pieces)) - 1)["e"].alias("e"), piece(i)["t"].alias("t")))


def safe_cues(df: DataFrame, keys: Sequence[str], layout: Sequence[str], start: str = "start_ms", end: str = "end_ms", text: str = "text", bucket_ms: int = SAFE_BUCKET_MS) -> DataFrame:
    """Cues that never overlap: keys, cue_index, start_ms, end_ms, text.

    Time is cut at every start and end. Each piece shows the different texts of
    its active segments in order of ``layout``, one a line; touching pieces of
    the same text are one cue. Segments are cut into cells first, which bounds
    what is gathered to what shows in one cell and changes nothing: runs of
    pieces are found within a cell, and a summary of one row a cell tells which
    go on over borders, where those end, and how many cues lie before.
    """
    rows = clean_segments(df, text, start, end)
    rows = rows.select(packed_keys(keys), F.struct(*layout).alias("_at"), F.col(text).alias("_text"), F.col(start).cast("long").alias("_from"), F.col(end).cast("long").alias("_to"))
    cut = _cut(rows, "_from", "_to", bucket_ms)
    cells = cut.groupBy("_k", "_b").agg(F.array_sort(F.collect_list(F.struct("_at", "_text", "_s", "_e"))).alias("_rows"))
    cells = cells.withColumn("_points", F.array_sort(F.array_distinct(F.concat(F.transform("_rows", lambda x: x["_s"]), F.transform("_rows", lambda x: x["_e"])))))

    def piece(low: Column, high: Column) -> Column:
        active = F.filter("_rows", lambda x: (x["_s"] < high) & (x["_e"] > low))
        return F.struct(low.alias("s"), high.alias("e"), F.array_join(F.array_distinct(F.transform(active, lambda x: x["_text"])), "\n").alias("t"))

    count = F.size("_points") - 1
    pieces = F.filter(F.zip_with(F.slice("_points", 1, count), F.slice("_points", 2, count), piece), lambda x: x["t"] != "")
    cells = stage(cells.withColumn("_pieces", pieces).select("_k", "_b", _runs_of("_pieces").alias("_runs")), "safe-cells")
    first, last = F.get("_runs", F.lit(0)), F.element_at("_runs", -1)
    borders = cells.select("_k", "_b", F.size("_runs").alias("_n"), first["s"].alias("_s"), first["e"].alias("_e"), first["t"].alias("_t"), last["e"].alias("_last_e"), last["t"].alias("_last_t"))
    scan = Window.partitionBy("_k").orderBy("_b")
    before = lambda c: F.lag(c).over(scan)
    cont = F.coalesce((before("_last_e") == F.col("_s")) & (before("_last_t") == F.col("_t")), F.lit(False))
    borders = borders.withColumn("_cont", cont).withColumn("_link", F.sum(F.when(F.col("_cont") & (before("_n") == 1), 0).otherwise(1)).over(scan))
    # Links in a row over cells of one run are one cue, which ends where the last of them does.
    borders = borders.withColumn("_link_e", F.max(F.when(F.col("_cont"), F.col("_e"))).over(Window.partitionBy("_k", "_link")))
    goes_on = F.coalesce(F.lead("_cont").over(scan), F.lit(False))
    own = F.col("_n") - F.col("_cont").cast("int")
    borders = borders.select(
        "_k",
        "_b",
        "_cont",
        F.when(goes_on, F.lead("_link_e").over(scan)).otherwise(F.col("_last_e")).alias("_end"),
        F.coalesce(F.sum(own).over(scan.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_shift"),
    )
    found = cells.join(borders, ["_k", "_b"]).select("_k", "_cont", "_end", "_shift", F.size("_runs").alias("_n"), F.posexplode("_runs").alias("_pos", "_r"))
    found = found.where(~F.col("_cont") | (F.col("_pos") > 0))
    index = F.col("_shift") + F.col("_pos") + 1 - F.col("_cont").cast("int")
    return found.select("_k.*", index.cast("long").alias("cue_index"), F.col("_r.s").alias("start_ms"), F.when(F.col("_pos") == F.col("_n") - 1, F.col("_end")).otherwise(F.col("_r.e")).alias("end_ms"), F.col("_r.t").alias("text"))


def overlap_cues(df: DataFrame, keys: Sequence[str], order: Sequence[str], start: str = "start_ms", end: str = "end_ms", text: str = "text", bucket_ms: int = 3_600_000) -> DataFrame:
    """Every clean segment as a cue, numbered by start and ``order``: nothing is merged."""
    rows = clean_segments(df, text, start, end).withColumn("_b", bucket_of(start, bucket_ms))
    cues = numbered(rows, keys, "_b", [start, *order], "cue_index")
    return cues.select(*keys, "cue_index", F.col(start).alias("start_ms"), F.col(end).alias("end_ms"), F.col(text).alias("text"))


POLICIES = ("safe", "overlap")


def cues(df: DataFrame, policy: str, keys: Sequence[str], layout: Sequence[str], ordinal: str) -> DataFrame:
    """Cues by policy; ``layout`` are top, left, right and window, ``ordinal`` breaks ties."""
    if policy == "safe":
        return safe_cues(df, keys, [*layout, ordinal])
    if policy == "overlap":
        return overlap_cues(df, keys, [*layout, "end_ms", ordinal])
    raise ValueError(f"unsupported srt policy: {policy}")


def frame_and_segment(df: DataFrame, keys: Sequence[str], order: Sequence[str], frame: Sequence[str], bucket: tuple[str, int] | None = None) -> DataFrame:
    """Frame number, one up whenever ``frame`` changes from the row before, and place in the frame.

    ``bucket`` as in ``next_start_end``; its column must be one of ``frame``, so
    that no frame crosses a border.
    """
    if bucket is None:
        rows = df.withColumns({"_k": F.struct(*[F.col(k) for k in keys]), "_b": F.lit(0)})
    elif bucket[0] not in frame:
        raise ValueError("the bucket's column must be part of the frame")
    else:
        rows = _bucketed(df, keys, bucket)
    rows = with_neighbour(rows, ["_k"], "_b", order, list(frame), "_prev")
    changed = F.col("_prev").isNull()
    for c in frame:
        changed = changed | ~F.col(c).eqNullSafe(F.col(f"_prev.{c}"))
    rows = rows.withColumn("_new", F.when(changed, 1).otherwise(0))
    counts = rows.groupBy("_k", "_b").agg(F.sum("_new").alias("_n"))
    before = Window.partitionBy("_k").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.select("_k", "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("carry"))
    scan = Window.partitionBy("_k", "_b").orderBy(*order)
    out = with_carry(rows, shift, ["_k"], "_b").withColumn("frame_index", F.col("carry") + F.sum("_new").over(scan))
    out = out.withColumn("segment_index", F.row_number().over(Window.partitionBy("_k", "_b", "frame_index").orderBy(*order)))
    return out.drop("_k", "_b", "_prev", "_new", "carry")


def srt_blocks(df: DataFrame, index: str = "cue_index", start: str = "start_ms", end: str = "end_ms", text: str = "text", compat: bool = True) -> Column:
    """Block of subtitle text of a cue, with its blank line."""
    from ..functions.scalar import srt_timestamp

    return F.concat(F.col(index).cast("string"), F.lit("\n"), srt_timestamp(F.col(start), compat), F.lit(" --> "), srt_timestamp(F.col(end), compat), F.lit("\n"), F.col(text), F.lit("\n\n"))
