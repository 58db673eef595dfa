import json

import numpy as np
import pytest

from cueweave import sinks
from cueweave.cli import normalized
from cueweave.plans import convert, progress
from cueweave.plans.requests import ConvertRequest, RequestError
from cueweave.raster.kernels import pixel_hash, read_png
from cueweave.recognizers import Answer, Retryable, Session, Settings, recognised, register, retried, with_cache
from cueweave.sources import manifests, sup
from cueweave.sources import sup_writer as w

INK = {1: (235, 128, 128, 255)}
SHAPES = {"A": (4, 12), "B": (5, 14), "T": (30, 6)}


def image(name):
    return np.full(SHAPES[name], 1, dtype=np.uint8)


def answers(**texts):
    grey = {n: np.full(SHAPES[n], 20, dtype=np.uint8) for n in SHAPES}
    return {pixel_hash(grey[n]).hex(): t for n, t in texts.items()}


@pytest.fixture()
def stream(tmp_path):
    ms = 90
    data = (
        w.display_set(1000 * ms, [(0, 100, 900, image("A")), (1, 1800, 100, image("T"))], INK)
        + w.display_set(2000 * ms, [(0, 100, 900, image("B")), (1, 1800, 100, image("T"))], INK)
        + w.display_set(3000 * ms, [(0, 100, 900, image("A"))], INK)
        + w.display_set(4000 * ms, [], INK)
    )
    path = tmp_path / "film.sup"
    path.write_bytes(data)
    return str(path)


BASE = Settings("table", options={"answers": answers(A="alpha", B="beta", T="縦")})


def texts(done):
    return [(r.start_ms, r.end_ms, r.text) for r in done.cues.orderBy("cue_index").collect()]


def test_convert_safe_and_overlap(spark, stream, tmp_path):
    out = tmp_path / "film.srt"
    request = ConvertRequest(stream, str(out), recogniser=BASE)
    done = convert.convert(spark, request)
    assert texts(done) == [(1000, 2000, "縦\nalpha"), (2000, 3000, "縦\nbeta"), (3000, 4000, "alpha")]
    assert convert.execute(spark, request) == {"processed": 4, "written": 3}
    assert out.read_text().startswith("1\n00:00:01,000 --> 00:00:02,000\n縦\nalpha\n\n2\n")
    overlap = convert.convert(spark, ConvertRequest(stream, "x", recogniser=BASE, srt_policy="overlap"))
    assert texts(overlap) == [(1000, 3000, "縦"), (1000, 2000, "alpha"), (2000, 3000, "beta"), (3000, 4000, "alpha")]
    fast = ConvertRequest(stream, "x", recogniser=BASE, ocr_mode="fast", fast_recogniser=Settings("table", options={"answers": answers(A="quick", B="brown")}))
    assert [t for *_, t in texts(convert.convert(spark, fast))] == ["縦\nquick", "縦\nbrown", "quick"]


def test_detector_and_corrector(spark, stream, tmp_path):
    again = Settings("table", options={"answers": answers(A="alpXa", B="beta", T="縱")})
    fixed = Settings("table", options={"answers": answers(A="Zlpxa", B="beta", T="縱")})
    request = ConvertRequest(stream, str(tmp_path / "o.srt"), recogniser=BASE, detector=again, detector_output=str(tmp_path / "d"), detector_mode="wider", corrector="local", corrector_settings=fixed, corrector_output=str(tmp_path / "c"))
    done = convert.convert(spark, request)
    found = {(r.first_ordinal, r.detector_branch, tuple(r.source_tags)) for r in done.disagreements.collect()}
    assert {f[1:] for f in found} == {("alternate_read_non_tall", ("hybrid_detector", "p2_meaningful_temp0")), ("repeat_drift_tall", ("hybrid_detector", "p2_meaningful_temp0"))}
    assert {r.conservative_merged_text for r in done.corrections.collect()} == {"alpxa", "縱"}
    assert done.counters() == {"processed": 4, "written": 3, "detected": 3, "applied": 3, "fallback": 0}
    convert.execute(spark, request)
    rows = [json.loads(x) for f in (tmp_path / "d").glob("*.json") for x in f.read_text().splitlines()]
    assert len(rows) == 3 and all("char_error_rate" in r for r in rows)


class Shaky:
    opened = 0

    def __init__(self, options):
        Shaky.opened += 1

    def recognise(self, pixels, prompt):
        if prompt != "OCR:":
            return Answer("second")
        return Answer("cut", "length")

    def close(self):
        pass


def test_session_falls_back_and_opens_anew():
    session = Session(Settings("x", budget=2), Shaky)
    assert [session.text(image("A")) for _ in range(3)] == ["second"] * 3 and session.opened == 3
    assert Session(Settings("x", role="detector"), Shaky).text(image("A")) == "cut"


def test_retries_back_off():
    waits, calls = [], iter([Retryable("a"), Retryable("b", 60), Retryable("c"), Answer("ok")])

    def call():
        step = next(calls)
        if isinstance(step, Exception):
            raise step
        return step

    assert retried(call, sleep=waits.append, draw=lambda low, high: high).text == "ok"
    assert waits == [1.0, 15.0, 4.0]
    with pytest.raises(Retryable):
        retried(lambda: (_ for _ in ()).throw(Retryable("x")), 2, waits.append)


def test_failed_rows_keep_their_place(spark):
    rows = spark.createDataFrame([(1, 2, 2, bytearray(b"\1" * 4)), (2, 2, 2, bytearray(b"\1"))], "k int, width int, height int, pixels binary")
    got = {r.k: r for r in recognised(rows, Settings("table", options={"missing": "m"}), ["k"]).collect()}
    assert got[1].text == "m" and got[2].text is None and "ValueError" in got[2].error
    with pytest.raises(ValueError):
        recognised(rows, Settings("nobody"), ["k"])
    register("table2", lambda o: None)


def test_cache_asks_each_key_once(spark):
    requests = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "key string, n int")
    cache = spark.createDataFrame([("b", "known")], "key string, text string")
    all_, fresh = with_cache(requests, cache, "key", lambda df: df.selectExpr("*", "concat('new ', key) as text"))
    assert {(r.key, r.n, r.text) for r in all_.collect()} == {("a", 1, "new a"), ("a", 2, "new a"), ("b", 3, "known")}
    assert fresh.count() == 1


def test_requests_are_checked():
    good = ConvertRequest("a", "b", ocr_mode=" FAST ")
    assert good.checked().ocr_mode == "fast"
    for bad in ({"max_items": 0}, {"device": "cpu"}, {"detector_output": "b"}, {"detector_mode": "wider"}, {"corrector_output": "c"}, {"corrector": "local"}, {"srt_policy": "bad-mode"}, {"family_addon": True}, {"detector_output": "d", "ocr_mode": "fast"}):
        with pytest.raises(RequestError):
            ConvertRequest("a", "b", **bad).checked()
    assert normalized(["in", "out"]) == ["convert", "in", "out"] and normalized(["query", "x"]) == ["query", "x"]


def test_atomic_files(tmp_path):
    path = tmp_path / "x.json"
    sinks.atomic_json(path, {"a": "あ"})

    def fails(out):
        out.write("half")
        raise RuntimeError

    with pytest.raises(RuntimeError):
        sinks.atomic_write(path, fails)
    assert json.loads(path.read_text()) == {"a": "あ"} and len(list(tmp_path.iterdir())) == 1
    sinks.atomic_jsonl(path, [{"k": 1}, {"k": None}])
    assert path.read_text() == '{"k": 1}\n{"k": null}\n'
    log = sinks.DiagnosticLog(tmp_path / "log" / "d.jsonl", limit=10)
    assert log.add("one", x=1) and log.add("two") and (tmp_path / "log" / "d.jsonl.1").exists()
    assert sinks.DiagnosticLog("/proc/none/x").add("z") is None


def test_exports(spark, stream, tmp_path):
    frames = sup.window_frames(sup.display_sets(sup.packets(spark, stream)))
    rows = sinks.export_images(frames, str(tmp_path / "e")).orderBy("index").collect()
    assert [(r.frame_index, r.segment_index, r.image) for r in rows] == [(1, 1, "images/000001_w0.png"), (1, 2, "images/000001_w1.png"), (2, 1, "images/000002_w0.png"), (3, 1, "images/000003_w0.png")]
    assert read_png((tmp_path / "e" / "images" / "000001_w0.png").read_bytes()).shape == SHAPES["A"]
    assert manifests.image_files(spark, str(tmp_path / "e")).count() == 4
    assert {r.entry for r in manifests.image_files(spark, str(tmp_path / "e")).collect()} >= {"images/000001_w1.png"}
    from cueweave.raster.layout import masked_frames

    masks = sinks.export_masks(frames, masked_frames(frames, ["first_ordinal"]), str(tmp_path / "m"))
    sinks.write_records(masks, str(tmp_path / "manifest"))
    assert len(list((tmp_path / "m").rglob("*.png"))) == 16
    back = manifests.manifest(spark, str(tmp_path / "manifest"))
    assert back.count() == 0 or "entry" in back.columns
    cues = spark.createDataFrame([("s", 1, 0, 1001, "a\nb"), ("s", 2, 5, 9, "c"), ("t", 1, 0, 1, "d")], "source_id string, cue_index long, start_ms long, end_ms long, text string")
    sinks.write_srt_files(cues, str(tmp_path / "srt"))
    (file,) = (tmp_path / "srt" / "source_id=s").glob("*.txt")
    assert file.read_text() == "1\n00:00:00,000 --> 00:00:01,000\na\nb\n\n2\n00:00:00,005 --> 00:00:00,009\nc\n\n"


def test_ledger_and_digests(spark, tmp_path):
    (tmp_path / "l.json").write_text('{"entries": [\n{"variant_id": "v", "release_tag": "r", "status": "passed"}]}')
    assert manifests.ledger(spark, str(tmp_path / "l.json")).first().release_tag == "r"
    expected = spark.createDataFrame([("l.json", "0"), ("gone", "1")], "name string, sha256 string")
    assert {(r.name, r.matches) for r in manifests.verified(spark, str(tmp_path), expected).collect()} == {("l.json", False), ("gone", False)}


def test_progress_folds():
    E = progress.Event
    start = progress.fold([E("prepare_started", 0.1)], input_bytes=2_200_000)
    assert start.expected_rows() == 100 and 0.0 < start.snapshot(1.0)["fraction"] < 0.1
    events = [E("prepare_completed", 2.0, rows=20), E("backend_loading", 2.0, "default", branch_rows=20, branch_unique=10), E("backend_ready", 5.0, "default"), E("ocr_started", 5.0, "default"), E("ocr_progress", 11.0, "default", done_rows=12, done_unique=6)]
    middle = progress.fold(events)
    assert middle.left() == pytest.approx(4 * 1.0 + 0.35 + 20 * 0.0012)
    later = middle.snapshot(9.0)
    assert later["elapsed"] == 11.0 and 0.5 < later["fraction"] < 0.99
    middle.record(E("finished", 12.0))
    assert middle.snapshot() == {"phase": "finished", "fraction": 1.0, "elapsed": 12.0, "eta": 0.0}


def test_cancelled_job(spark):
    job = progress.Job(spark.sparkContext, "stop-me")
    assert job.run(lambda: 7) == 7
    job.cancel()
    with pytest.raises(progress.Cancelled):
        job.run(lambda: 7)


class Server:
    """Answers requests of both interfaces; the first of each fails once."""

    def __init__(self):
        import http.server
        import threading

        seen = self.seen = []

        class Handler(http.server.BaseHTTPRequestHandler):
            def do_POST(self):
                body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
                seen.append((self.path, self.headers.get("x-api-key"), body))
                if sum(p == self.path for p, *_ in seen) == 1:
                    self.send_response(429)
                    self.send_header("Retry-After", "0")
                    self.end_headers()
                    return
                chat = {"choices": [{"message": {"content": " read "}, "finish_reason": "stop"}], "usage": {"completion_tokens": 3}}
                parts = {"candidates": [{"content": {"parts": [{"text": "hm", "thought": True}, {"text": " fixed"}]}, "finishReason": "STOP"}]}
                out = json.dumps(chat if "chat" in self.path else parts).encode()
                self.send_response(200)
                self.send_header("Content-Length", str(len(out)))
                self.end_headers()
                self.wfile.write(out)

            def log_message(self, *args):
                pass

        self.http = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.http.serve_forever, daemon=True).start()
        self.url = f"http://127.0.0.1:{self.http.server_port}"


def test_http_plugins(monkeypatch):
    server = Server()
    monkeypatch.setenv("MY_KEY", "k")
    assert Session(Settings("http", options={"url": server.url + "/chat"})).text(image("A")) == "read"
    assert Session(Settings("cloud", options={"url": server.url + "/gen", "key_env": "MY_KEY"})).text(image("A")) == "fixed"
    assert [s[:2] for s in server.seen] == [("/chat", None)] * 2 + [("/gen", "k")] * 2
    assert server.seen[0][2]["temperature"] == 0.0 and "inlineData" in server.seen[-1][2]["contents"][0]["parts"][1]
    server.http.shutdown()
    with pytest.raises(RuntimeError, match="transformers"):
        Session(Settings("in-process", options={"model": "x"})).text(image("A"))


def test_assignments(spark, tmp_path):
    (tmp_path / "env").write_text("# c\nexport A='x y'\nB = \"q\n\nC=1=2\n=z\n")
    assert {(r.name, r.value) for r in manifests.assignments(spark, str(tmp_path / "env")).collect()} == {("A", "x y"), ("B", '"q'), ("C", "1=2")}


def test_staged_tables_can_be_cleared(spark):
    from cueweave.session import clear_staged, stage

    table = stage(spark.range(3), "three")
    assert table.count() == 3
    clear_staged(spark)
    with pytest.raises(Exception, match="staged/three"):
        table.count()
    assert stage(spark.range(2), "two").count() == 2


def test_waits_that_a_server_asks_for():
    from cueweave.recognizers import asked_wait

    body = b'{"error": {"details": [{"reason": "busy"}, {"retryDelay": "x"}, {"retryDelay": "1.5s"}]}}'
    assert [asked_wait(h, b"", 1_000_000_000.0) for h in ("7", " 2.5 ", "-1", "Sun, 09 Sep 2001 01:46:50 GMT", "Sun, 09 Sep 2001 01:46:00 GMT")] == [7, 2.5, 0, 10, 0]
    assert asked_wait(None, body) == asked_wait("soon", body) == 1.5
    assert asked_wait(None) is asked_wait("", b"[]") is asked_wait("x", b"{broken") is None


def test_smoke(spark, tmp_path):
    from cueweave.plans.smoke import SmokeRequest, smoke

    assert smoke(spark, SmokeRequest(str(tmp_path / "check"))) == {"processed": 3, "written": 3, "status": "ok"}
    for bad in ({"backend": "x"}, {"backend": "http"}, {"url": "http://y"}, {"images": 0}):
        with pytest.raises(RequestError):
            SmokeRequest("f", **bad).checked()


class Refusing:
    def __init__(self, options):
        pass

    def recognise(self, pixels, prompt):
        raise ValueError("refused")

    def close(self):
        pass


def test_failures_are_counted_or_fail_the_job(spark, stream):
    register("refusing", Refusing)
    done = convert.convert(spark, ConvertRequest(stream, "x", recogniser=Settings("refusing")))
    assert done.counters() == {"processed": 4, "written": 0, "unread": 4}
    with pytest.raises(Exception, match="refused"):
        recognised(done.prepared, Settings("refusing"), ["source_id", "first_ordinal"], strict=True).collect()


def test_spilled_images_come_back(spark, stream, tmp_path):
    frames = convert.prepared_frames(spark, stream)
    spilled = sinks.spill_images(frames, str(tmp_path))
    rows = spilled.collect()
    assert len(rows) == 3 == len(list((tmp_path / "images").iterdir()))
    back = {r.image_key: (r.width, r.height, bytes(r.pixels)) for r in sinks.read_spilled(spark.createDataFrame(rows, spilled.schema), str(tmp_path)).collect()}
    assert back == {r.image_key: (r.width, r.height, bytes(r.pixels)) for r in frames.collect()}


def test_drawn_images_are_handed_out_once(spark):
    from cueweave import queries_stream as q

    frames, images = q.drawn_frames(spark, "/root/testdata/sf0.001")
    keys = [bytes(r._key) for r in q.keyed(images).collect()]
    assert "pixels" not in frames.columns and len(keys) == len(set(keys)) > 100
    assert {bytes(r._key) for r in q.keyed(frames).select("_key").distinct().collect()} == set(keys)
