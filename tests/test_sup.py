import numpy as np
import pytest

from cueweave.raster import kernels
from cueweave.sources import sup
from cueweave.sources import sup_writer as w

INK = {1: (16, 128, 128, 255), 2: (235, 128, 128, 128)}


def bitmap(seed, shape=(3, 4)):
    return np.random.default_rng(seed).integers(1, 3, shape).astype(np.uint8)


def plain_runs(data, width, height):
    """Runs painted pixel by pixel."""
    rows = [[0] * width for _ in range(height)]
    x = y = 0
    for length, colour in zip(*kernels.runs_of(data)):
        if y >= height:
            break
        if length < 0:
            x, y = 0, y + 1
            continue
        for _ in range(length):
            if x >= width:
                x, y = 0, y + 1
            if y >= height:
                break
            rows[y][x] = colour
            x += 1
    return np.array(rows, dtype=np.uint8)


def test_runs_round_trip_and_odd_codes():
    rng = np.random.default_rng(0)
    for width in (1, 5, 63, 64, 300):
        pixels = np.repeat(rng.integers(0, 3, (7, width)), rng.integers(1, 4), axis=1).astype(np.uint8)
        assert (kernels.decode_runs(kernels.encode_runs(pixels), pixels.shape[1], 7) == pixels).all()
    for _ in range(300):
        data = bytes(rng.integers(0, 256, rng.integers(0, 30), dtype=np.uint8) % rng.choice([2, 4, 70, 200, 256]))
        assert (kernels.decode_runs(data, 5, 4) == plain_runs(data, 5, 4)).all(), data
    assert kernels.decode_runs(b"\x01", 0, 3).shape == (3, 0)


def test_blend_trims_and_clear_entries():
    grey, alpha = kernels.palette_tables(INK | {30: (16, 0, 0, 255), 0: (16, 0, 0, 255)})
    assert alpha[0] == alpha[30] == 0 and grey[1] == 239
    pixels = np.zeros((4, 5), dtype=np.uint8)
    pixels[1:3, 2:4] = 1
    cut, box = kernels.blend([(pixels, 10, 20)], grey, alpha)
    assert box == (12, 21, 13, 22) and (cut == 239).all()
    assert kernels.blend([(np.full((2, 2), 30, np.uint8), 0, 0)], grey, alpha) is None
    half, _ = kernels.blend([(np.full((1, 1), 2, np.uint8), 0, 0)], grey, alpha)
    assert half[0, 0] == (128 * 20 + 127 * 255 + 254) // 255


def test_png_round_trip():
    pixels = bitmap(3, (9, 11))
    assert (kernels.read_png(kernels.png(pixels)) == pixels).all()
    boxes = kernels.outlined(pixels, [(1, 1, 5, 4, (255, 0, 0))])
    assert (kernels.read_png(kernels.png(boxes)) == boxes).all()
    assert kernels.bmp(pixels)[:2] == b"BM"


def test_scan_errors():
    good = w.packet(sup.END, b"", 5)
    assert [p[:2] for p in sup.scan(good + good + w.packet(sup.PALETTE, b"ab", 1) + b"PG")] == [(0, 0), (1, 0), (2, 0)]
    with pytest.raises(sup.SupFormatError):
        list(sup.scan(b"XX" + good[2:]))
    with pytest.raises(sup.SupFormatError):
        list(sup.scan(w.packet(sup.PALETTE, b"abcd", 1)[:-1]))


def sets_of(data):
    decoder, held, rows, last = sup.StreamDecoder(), [], [], 0
    for raw, _, pts, _, kind, payload in [*sup.scan(data), (None,) * 6]:
        if raw != last:
            rows.append(decoder.display_set(held, surface=True))
            held, last = [], raw
        held.append((pts, kind, payload))
    return rows


def test_state_lives_until_the_epoch():
    image = bitmap(1)
    first = w.display_set(100, [(0, 10, 20, image)], INK)
    again = w.packet(sup.COMPOSITION, w.composition_payload([(0, 0, 30, 40)], sup.NORMAL), 200) + w.packet(sup.END, b"", 200)
    fresh = w.packet(sup.COMPOSITION, w.composition_payload([(0, 0, 30, 40)], sup.EPOCH), 300) + w.packet(sup.END, b"", 300)
    blank = w.display_set(400, [], INK)
    open_end = w.packet(sup.COMPOSITION, w.composition_payload([]), 500)
    rows = sets_of(first + again + fresh + blank + open_end)
    assert [r["complete"] for r in rows] == [True, True, False, True, False]
    assert (rows[0]["windows"][0]["left"], rows[1]["windows"][0]["left"]) == (10, 30)
    assert rows[0]["windows"][0]["image_hash"] == rows[1]["windows"][0]["image_hash"]
    assert rows[3]["windows"] == [] and rows[0]["surface"]["width"] == 4


def test_object_fragments():
    image = bitmap(2)
    whole = w.object_payload(0, image)
    decoder = sup.StreamDecoder()
    decoder.object(whole[:3] + b"\x80" + whole[4:15])
    assert not decoder.objects[0].complete
    decoder.object(whole[:3] + b"\x40" + b"\0\0\0" + whole[15:])
    assert decoder.objects[0].complete
    assert (kernels.decode_runs(decoder.objects[0].data, 4, 3) == image).all()
    decoder.object(b"\0\7\0\x40\0\0\0xx")
    assert 7 not in decoder.objects


def test_window_frames_follow_tracks(spark, tmp_path):
    a, b, c = bitmap(10), bitmap(11), bitmap(12)
    stream = (
        w.display_set(100 * 90, [(0, 0, 0, a), (1, 50, 50, b)], INK)
        + w.packet(sup.COMPOSITION, w.composition_payload([(9, 0, 0, 0)]), 120 * 90)
        + w.packet(sup.END, b"", 120 * 90)
        + w.display_set(200 * 90, [(0, 0, 0, a), (1, 50, 50, c)], INK)
        + w.display_set(220 * 90, [], INK)
    )
    path = tmp_path / "one.sup"
    path.write_bytes(stream)
    read = sup.packets(spark, str(path))
    spark.dataSource.register(sup.SupDataSource)
    direct = spark.read.format("sup").load(str(path))
    assert direct.drop("source_id").collect() == read.drop("source_id").collect()
    assert spark.read.format("sup").option("maxDisplaySets", 1).load(str(path)).count() < direct.count()
    sets = sup.display_sets(read, surface=True)
    got = [(r.window_id, r.start_ms, r.end_ms) for r in sup.window_frames(sets).orderBy("first_ordinal").collect()]
    assert got == [(0, 100, 220), (1, 100, 200), (1, 200, 220)]
    assert [(r.start_ms, r.end_ms) for r in sup.frames(sets).orderBy("first_ordinal").collect()] == [(100, 200), (200, 220)]
    assert sup.window_frames(sets, max_items=1).count() == 1
    assert sup.unique_objects(read).count() == 3


def test_bitmaps_in_step_are_the_same():
    rng = np.random.default_rng(7)
    for width, height in ((5, 4), (1, 3), (24, 18), (70, 6)):
        images = np.repeat(rng.integers(0, 3, (40, height, width)), 2, axis=2)[:, :, :width].astype(np.uint8)
        coded = kernels.encode_many(images)
        assert coded == [kernels.encode_runs(p) for p in images]
        assert (kernels.decode_many(coded, width, height) == images).all()
        odd = [bytes(rng.integers(0, 256, rng.integers(0, 40), dtype=np.uint8) % rng.choice([2, 4, 70, 200, 256])) for _ in range(400)]
        assert (kernels.decode_many(odd, width, height) == [kernels.decode_runs(data, width, height) for data in odd]).all()
    assert kernels.decode_many([], 3, 2).shape == (0, 2, 3) and kernels.encode_many(np.zeros((0, 2, 3), np.uint8)) == []


def mixed_stream(seed, sets):
    """Sets that open epochs or go on, with several windows, new palettes, cut and broken objects."""
    rng = np.random.default_rng(seed)
    data = b""
    for i in range(sets):
        state, palette = rng.choice([sup.EPOCH, sup.EPOCH, sup.EPOCH, sup.NORMAL, sup.ACQUISITION]), {1: (int(rng.integers(0, 2)) * 40, 0, 0, 255), 2: INK[2]}
        images = [(int(w), int(rng.integers(0, 4)), 9, bitmap(int(rng.integers(0, 9))) * int(rng.integers(0, 6) > 0)) for w in rng.choice(3, rng.integers(0, 3))]
        kind = rng.integers(0, 8)
        if kind == 0:  # shows what is there already
            data += w.packet(sup.COMPOSITION, w.composition_payload([(0, 0, 3, 4), (1, 1, 9, 9)], state), 1000 * i) + w.packet(sup.END, b"", 1000 * i)
        elif kind == 1:  # crops
            data += w.packet(sup.COMPOSITION, w.composition_payload([(0, 0, 3, 4, (1, 1, 2, 2))], state), 1000 * i) + w.packet(sup.PALETTE, w.palette_payload(palette), 0) + w.packet(sup.OBJECT, w.object_payload(0, bitmap(i)), 0) + w.packet(sup.END, b"", 0)
        elif kind == 2:  # lacks its end of object
            data += w.packet(sup.COMPOSITION, w.composition_payload([(0, 0, 3, 4)], state), 1000 * i) + w.packet(sup.OBJECT, w.object_payload(0, bitmap(i))[:-3], 0) + w.packet(sup.END, b"", 0)
        else:
            data += w.display_set(1000 * i, images, palette, state)
    return data


@pytest.mark.parametrize("together", [1, 7, 4096])
@pytest.mark.parametrize("surface", [False, True])
def test_sets_decoded_together_are_the_same(monkeypatch, together, surface):
    monkeypatch.setattr(sup, "SETS_TOGETHER", together)
    for pixels in ("all", "first", "none"):
        batch, want, got, given = sup.BatchDecoder(sup.CONTINUED_AT, surface, pixels, ahead=True), [], [], set()
        for source in "abc":
            stream = sup.StreamDecoder()
            held, last = [], 0
            for raw, _, pts, _, kind, payload in [*sup.scan(mixed_stream(ord(source), 150)), (None,) * 6]:
                if raw != last:
                    batch.add(source, last, held)
                    want.append({"source_id": source, "raw_index": last} | stream.display_set(held, surface))
                    if batch.full():
                        got += batch.done().to_pylist()
                    held, last = [], raw
                held.append((pts, kind, payload))
        got += batch.done(last=True).to_pylist()
        assert len(got) == len(want) and sum(len(r["windows"]) > 1 for r in want) > 20
        for i, (one, row) in enumerate(zip(got, want)):
            later = [r for r in want[i + 1 :] if r["source_id"] == row["source_id"] and r["complete"]]
            assert one.pop("next_pts") == next((r["pts"] for r in later), None)
            assert one.pop("next_image_pts") == next((r["pts"] for r in later if r["windows"]), None)
            shown = [[*one["windows"], one["surface"] or {}], [*row["windows"], row["surface"] or {}]]
            for a, b in zip(*shown):
                bytes_ = b.get("pixels")
                if pixels == "all" or not b:
                    continue
                assert a["pixels"] in ((None,) if pixels == "none" else (None, bytes_))
                if a["pixels"]:
                    given.add(a["image_hash"])
            if pixels != "all":
                strip = lambda r: {k: [{n: v for n, v in x.items() if n != "pixels"} for x in v] if k == "windows" else {n: x for n, x in v.items() if n != "pixels"} if k == "surface" and v else v for k, v in r.items()}
                one, row = strip(one), strip(row)
            assert one == row
        if pixels == "first":
            assert given >= {x["image_hash"] for r in want for x in r["windows"]}


def test_numbers_of_frames_are_those_of_the_frames(spark, monkeypatch):
    streams = {s: mixed_stream(ord(s), 120) for s in "ab"}
    rows = [(s, p[0], p) for s, data in streams.items() for p in sup.scan(data)]
    sets = {}
    for s, raw, (_, _, pts, dts, kind, payload) in rows:
        sets[s, raw] = sets.get((s, raw), b"") + w.packet(kind, payload, pts, dts)
    table = spark.createDataFrame([(s, raw, bytearray(data)) for (s, raw), data in sets.items()], "source_id string, raw_index long, data binary").coalesce(1).sortWithinPartitions("source_id", "raw_index")
    want = sup.window_frames(sup.display_sets(sup.packets_of(table)))
    numbers, images = sup.window_numbers(table)
    columns = [c for c in want.columns if c != "pixels"]
    key = ["image_hash", "width", "height"]
    joined = numbers.join(images, key).select(*columns, "pixels")
    assert images.count() == want.select(*key).distinct().count() > 5
    assert sorted(map(str, joined.collect())) == sorted(map(str, want.select(*columns, "pixels").collect()))
