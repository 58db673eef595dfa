from datetime import datetime, timedelta

import numpy as np

from cueweave.operators.timeline import fold_islands
from cueweave.queries_core import track_islands
from cueweave.queries_stream import stateful_islands
from cueweave.sources import sup
from cueweave.sources import sup_writer as w
from cueweave.streaming.stateful import stream_display_sets, stream_islands


def played(spark, stream, name):
    query = stream.writeStream.format("memory").queryName(name).outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    return spark.table(name)


def test_islands_over_batches(spark, tmp_path):
    rows = [("a", i, "xxyyyxz"[i], i * 100, i * 100 + 80) for i in range(7)] + [("b", i, "qqqqqqq"[i], i * 1000, i * 1000 + 1) for i in range(7)]
    df = spark.createDataFrame(rows, "k string, n long, v string, s long, e long")
    for part, (low, high) in enumerate(((0, 3), (3, 7))):
        df.where(f"n >= {low} and n < {high}").coalesce(1).sortWithinPartitions("k", "n").write.json(str(tmp_path / f"{part}"))
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "*"))
    got = {tuple(r) for r in played(spark, stream_islands(source, ["k"], "v", "s", "e", 50), "islands").collect()}
    whole = {(r.k, r.v, r.s, r.e, r.rows) for r in fold_islands(df, ["k"], ["n"], "v", "s", "e", 50).collect()}
    assert got < whole and whole - got == {("a", "z", 600, 680, 1), ("b", "q", 6000, 6001, 1)}


def test_display_sets_over_batches(spark, tmp_path):
    ink = {1: (16, 0, 0, 255)}
    data = w.display_set(100, [(0, 1, 2, np.ones((3, 3), np.uint8))], ink)
    data += w.packet(sup.COMPOSITION, w.composition_payload([(0, 0, 9, 9)], sup.NORMAL), 200) + w.packet(sup.END, b"", 200)
    packets = spark.createDataFrame([("s", *p) for p in sup.scan(data)], sup.PACKETS)
    packets.where("raw_index = 0").write.parquet(str(tmp_path / "0"))
    packets.where("raw_index = 1").write.parquet(str(tmp_path / "1"))
    source = spark.readStream.schema(packets.schema).option("maxFilesPerTrigger", 100).parquet(str(tmp_path / "*"))
    got = played(spark, stream_display_sets(source), "sets").orderBy("raw_index").collect()
    want = sup.display_sets(packets).orderBy("raw_index").collect()
    assert [r.windows[0].left for r in got] == [1, 9] and [r.windows for r in got] == [r.windows for r in want]


def test_query_gives_open_islands_too(spark, tmp_path):
    rows = [(i, u, v, datetime(2026, 1, 1) + timedelta(minutes=i)) for i, (u, v) in enumerate([(1, "a"), (1, "a"), (1, "b"), *[(2, "c")] * 50, (3, None), (None, "d")])]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, ts timestamp_ntz").write.parquet(str(tmp_path / "events.parquet"))
    columns = ["user_id", "event_type", "us", "end_us", "rows"]
    got = stateful_islands(spark, str(tmp_path)).select(columns).collect()
    whole = track_islands(spark, str(tmp_path)).select(columns).collect()
    assert len(got) == len(whole) == 5 and set(map(tuple, got)) == set(map(tuple, whole))
