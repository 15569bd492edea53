from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from framelake.operators import audio
from framelake.sources import codecs, files, jpeg, yuv
from framelake.streaming import capture

RNG = np.random.default_rng(3)


def samples(spark, values):
    return spark.createDataFrame([(i, int(a), int(b)) for i, (a, b) in enumerate(values)], "pos long, l int, r int")


def signal(df):
    rows = sorted(df.collect(), key=lambda r: r["pos"])
    return np.array([[r["l"], r["r"]] for r in rows])


def test_filters_do_not_depend_on_blocks(spark):
    s = samples(spark, RNG.integers(-20_000, 20_000, (3_000, 2)))
    for f in (lambda b: audio.low_pass(s, 5_000, block=b), lambda b: audio.high_pass(s, 5_000, block=b), lambda b: audio.chorus(s, 8_000, block=b), lambda b: audio.resample(s, 0.75, block=b)):
        assert (signal(f(97)) == signal(f(1 << 20))).all()


def test_tones(spark):
    t = np.arange(8_192)
    low, high = (8_000 * np.sin(2 * np.pi * f * t / 44_100) for f in (300, 15_000))
    s = samples(spark, np.column_stack((low + high, low - high)))
    kept = signal(audio.low_pass(s, 3_000))[200:-200]
    assert abs(kept[:, 0] - low[200:-200]).max() < 200
    cut = signal(audio.high_pass(s, 3_000))[200:-200]
    assert abs(cut[:, 0] - high[200:-200]).max() < 200
    middle = audio.center_cut(s, window=1024, hop=128, block=4096).orderBy("pos").toPandas()
    inner = slice(2_000, 6_000)
    assert np.corrcoef(middle["c"][inner], low[inner])[0, 1] > 0.95


def test_stretch_keeps_pitch_and_shift_keeps_length(spark):
    t = np.arange(20_000)
    s = samples(spark, np.repeat((9_000 * np.sin(2 * np.pi * 441 * t / 44_100))[:, None], 2, axis=1))
    peak = lambda x: np.abs(np.fft.rfft(x[2_000:14_000, 0] * np.hanning(12_000))).argmax() * 44_100 / 12_000
    longer = signal(audio.time_stretch(s, 1.5))
    assert len(longer) == 30_000 and abs(peak(longer) - 441) < 10
    higher = signal(audio.pitch_shift(s, 1.5))
    assert len(higher) == 20_000 and abs(peak(higher) - 661.5) < 15


def test_graph_refuses_cycles_and_double_wires():
    g = audio.AudioGraph()
    a, b = g.add("a", lambda x: x), g.add("b", lambda x: x)
    g.connect(a, 0, b, 0)
    with pytest.raises(ValueError, match="connected"):
        g.connect(a, 0, b, 0)
    g.connect(b, 0, a, 0)
    with pytest.raises(ValueError, match="cycle"):
        g.order()
    g.disconnect(a, 0)
    assert g.order() == [a, b]


def test_x_law_known_codes():
    mu, a = audio.x_law_table("mu"), audio.x_law_table("a")
    assert mu[0xFF] == 0 and mu[0x7F] == 0 and mu[0x80] == 32124 and mu[0x00] == -32124
    assert a[0xD5] == 8 and a[0x55] == -8 and a[0xAA] == 32256 and a[0x2A] == -32256


@settings(max_examples=25, deadline=None)
@given(st.integers(1, 9), st.integers(1, 9), st.integers(0, 10**6))
def test_image_round_trips(w, h, seed):
    image = np.random.default_rng(seed).integers(0, 256, (h, w, 3), np.uint8)
    for kind, encode in codecs.ENCODERS.items():
        data = encode(image)
        assert (codecs.DECODERS[kind](data) == image).all()
        assert kind == "tga" or codecs.sniff(data) == kind
    assert (codecs.filmstrip_decode(codecs.filmstrip_encode([image, image]))[1] == image).all()
    avi = codecs.avi_encode([image, 255 - image], (25, 1), [True, False], codecs.Wave(8_000, 2, 16, np.arange(40).reshape(-1, 2)))
    for rebuild in (False, True):
        parsed = codecs.avi_parse(avi, rebuild)
        video = [c for c in parsed.chunks if c.stream == 0]
        assert parsed.rate == (25, 1) and parsed.audio == (8_000, 2, 16)
        assert (codecs.avi_frame(avi, parsed, video[1]) == 255 - image).all()
        assert sum(c.size for c in parsed.chunks if c.stream == 1) == 80
    assert [c.is_key for c in codecs.avi_parse(avi).chunks if c.stream == 0] == [True, False]


def test_png_filters():
    import struct
    import zlib

    image = RNG.integers(0, 256, (5, 4, 3)).astype(np.int64)
    flat, rows = image.reshape(5, 12), b""
    for y, kind in enumerate(range(5)):
        left = np.concatenate(([0, 0, 0], flat[y, :-3]))
        up = flat[y - 1] if y else np.zeros(12, np.int64)
        corner = np.concatenate(([0, 0, 0], up[:-3]))
        p = left + up - corner
        near = np.stack((abs(p - left), abs(p - up), abs(p - corner)))
        paeth = np.choose(near.argmin(axis=0), (left, up, corner))
        rows += bytes([kind]) + ((flat[y] - (0, left, up, (left + up) >> 1, paeth)[kind]) & 255).astype(np.uint8).tobytes()
    data = codecs.PNG_MAGIC + codecs._png_chunk(b"IHDR", struct.pack(">IIBBBBB", 4, 5, 8, 2, 0, 0, 0)) + codecs._png_chunk(b"IDAT", zlib.compress(rows)) + codecs._png_chunk(b"IEND", b"")
    assert (codecs.png_decode(data) == image).all()


def test_gif_codes_decode():
    """An own LZW reader gives the symbols back."""
    symbols = RNG.integers(0, 216, 20_000).tolist() + [5] * 5_000
    bits = "".join(f"{b:08b}"[::-1] for b in codecs._lzw(symbols, 8))
    out, at, size, table, last = [], 0, 9, [], None
    while True:
        code = int(bits[at : at + size][::-1], 2)
        at += size
        if code == 256:
            table, size, last = [(i,) for i in range(256)] + [(), ()], 9, None
            continue
        if code == 257:
            break
        entry = table[code] if code < len(table) else last + (last[0],)
        out += entry
        if last is not None and len(table) < 4096:
            table.append(last + (entry[0],))
        if len(table) == 1 << size and size < 12:
            size += 1
        last = entry
    assert out == symbols


def test_damaged_files(spark, tmp_path):
    image = RNG.integers(0, 256, (3, 2, 3), np.uint8)
    (tmp_path / "a1.png").write_bytes(codecs.png_encode(image))
    (tmp_path / "a2.png").write_bytes(codecs.png_encode(image)[:40])
    assert files.read_images(spark, str(tmp_path), mode="skip").count() == 1
    kept = files.read_images(spark, str(tmp_path), mode="keep").collect()
    assert sorted((r["name"], r["frame"]) for r in kept) == [("a1.png", 1), ("a2.png", None)]
    with pytest.raises(Exception, match="header|truncated|incomplete|Error"):
        files.read_images(spark, str(tmp_path)).collect()


def test_animations(spark, tmp_path):
    rows = [(i, "clip", *([i * 20] * 4 for _ in "rgb")) for i in range(3)]
    frames = spark.createDataFrame(rows, "frame long, name string, r array<int>, g array<int>, b array<int>")
    for kind, start in (("gif", b"GIF89a"), ("apng", codecs.PNG_MAGIC)):
        (path,) = files.write_video(frames, str(tmp_path), kind, size=(2, 2))
        assert open(path, "rb").read().startswith(start)
    assert codecs.png_decode(open(path, "rb").read()).shape == (2, 2, 3)


def test_segments_follow_the_limits(spark):
    df = spark.createDataFrame([(0, i, s) for i, s in enumerate((100, 300, 500, 10, 10, 900, 2000, 5))], "stream int, frame long, size int")
    found = [r["segment"] for r in files.segments(df, "size", 1000, 3).orderBy("frame").collect()]
    assert found == [0, 0, 0, 1, 1, 1, 2, 3]


def test_resync_in_batch_and_stream(spark, tmp_path):
    rows = [(k, i, int(i * 100_000 + (i // 7) * 150_000 - (i % 5 == 4) * 90_000)) for k in range(3) for i in range(60)]
    table = spark.createDataFrame(rows, "stream long, seq long, ts_us long")
    batch = {(r["stream"], r["seq"]): (r["action"], r["inserted"], r["written"]) for r in capture.resync(table, 10.0).collect()}
    assert {a for a, _, _ in batch.values()} == {"keep", "insert", "drop"}
    for part in range(3):
        table.where(f"seq DIV 20 = {part}").coalesce(1).write.parquet(f"{tmp_path}/in/{part}")
    for part in range(3):
        next((tmp_path / "in" / str(part)).glob("part-*")).rename(tmp_path / "in" / f"f{part}.parquet")
    import os
    import shutil

    for part in range(3):
        shutil.rmtree(tmp_path / "in" / str(part))
        os.utime(tmp_path / "in" / f"f{part}.parquet", (part + 1, part + 1))
    source = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = capture.resync_stream(source, 10.0).writeStream.format("memory").queryName("resynced").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination(120)
    found = {(r["stream"], r["seq"]): (r["action"], r["inserted"], r["written"]) for r in spark.table("resynced").collect()}
    assert found == batch


def test_timestamp_wraps(spark):
    real = [2_147_000_000 + i * 200_000 for i in range(10)]
    rows = [(0, i, v % 2**31) for i, v in enumerate(real)] + [(1, i, (v + 2_147_480_000) % 2**32) for i, v in enumerate(real)]
    found = capture.repair_timestamps(spark.createDataFrame(rows, "stream int, seq int, ts_us long")).orderBy("stream", "seq").collect()
    assert [r["ts_us"] for r in found] == real + [v + 2_147_480_000 for v in real]


def test_controller_settles():
    c = capture.Controller()
    error, rate = 50.0, 0.0
    for _ in range(3_000):
        rate = c.step(error)
        error += rate * 10
    assert abs(error) < 15 and abs(rate) <= c.most


@pytest.mark.parametrize("riff_frames", [None, 3, 1])
def test_avi_in_several_riff_parts(riff_frames):
    """A file that goes on in AVIX parts is read whole, by its indexes or without them."""
    images = [np.full((2, 4, 3), 10 * i, np.uint8) for i in range(7)]
    keys = [i % 3 == 0 for i in range(7)]
    wave = codecs.Wave(8_000, 2, 16, np.arange(80).reshape(-1, 2))
    data = codecs.avi_encode(images, (25, 1), keys, wave, riff_frames)
    assert data.count(b"AVIX") == (0 if riff_frames is None else -(-7 // riff_frames) - 1)
    for rebuild in (False, True):
        avi = codecs.avi_parse(data, rebuild)
        video = [c for c in avi.chunks if c.stream == 0]
        assert [codecs.avi_frame(data, avi, c)[0, 0, 0] for c in video] == [10 * i for i in range(7)]
        sound = b"".join(data[c.offset : c.offset + c.size] for c in avi.chunks if c.stream == 1)
        assert np.frombuffer(sound, "<i2").tolist() == list(range(80))
        assert [c.is_key for c in video] == (keys if not rebuild else [True] * 7)
    hurt = data.replace(b"ix00", b"ix0x").replace(b"idx1", b"idxx")
    assert len([c for c in codecs.avi_parse(hurt).chunks if c.stream == 0]) == 7


def test_segments_and_stripes_come_back(spark, tmp_path):
    rows = [("a" if i < 20 else "b", i % 20, i % 5 == 0, [i] * 64, [2 * i] * 64, [3 * i] * 64) for i in range(33)]
    frames = spark.createDataFrame(rows, "name string, frame long, is_key boolean, r array<int>, g array<int>, b array<int>")
    want = sorted((r[0], r[1], r[3][0]) for r in rows)
    names = files.write_segmented(frames, str(tmp_path / "s"), 10_000, 6)
    assert len(names) == 4 + 3 and all("." in n for n in names)
    assert sorted((r["name"], r["frame"], r["r"][0]) for r in files.read_segmented(spark, str(tmp_path / "s")).collect()) == want
    assert len(files.write_striped(frames, str(tmp_path / "t"), 3)) == 6
    assert sorted((r["name"], r["frame"], r["r"][0]) for r in files.read_striped(spark, str(tmp_path / "t"), 3).collect()) == want


def test_append_after_one_frame_and_after_none(spark):
    segment = lambda n: spark.range(n).withColumnRenamed("id", "frame")
    out = files.append(segment(1), segment(2), segment(0), segment(1))
    assert sorted(r["frame"] for r in out.collect()) == [0, 1, 2, 3]


def test_raw_audio_round_trip(spark, tmp_path):
    samples = spark.createDataFrame([("x", i, i - 5, 100 * i) for i in range(10)], "name string, pos long, l int, r int")
    files.write_raw_audio(samples, str(tmp_path))
    assert sorted(tuple(r)[1:] for r in files.read_raw_audio(spark, str(tmp_path)).collect()) == [(i, i - 5, 100 * i) for i in range(10)]


@given(st.integers(1, 30), st.integers(1, 30), st.integers(0, 10), st.sampled_from([0, 6]))
@settings(max_examples=25, deadline=None)
def test_jpeg_round_trips(w, h, seed, step):
    rng = np.random.default_rng(seed)
    noise = rng.integers(0, 256, (h, w, 3))
    y, x = np.mgrid[:h, :w]
    smooth = np.stack((y * 3, x * 4, x + y), axis=2)
    image = (noise if not step else smooth).astype(np.uint8)
    apart = np.abs(jpeg.decode(jpeg.encode(image, step)).astype(int) - image)
    assert apart.max() <= 4 and apart.mean() < 1 if not step else apart.mean() < 3
    assert codecs.sniff(jpeg.encode(image, step)) == "jpg"


def test_jpeg_parts():
    """Restarts, a single component and subsampled chroma, in streams put together by hand: every block is one flat value."""
    head = b"\xff\xd8" + b"\xff\xdb\x00\x43\x00" + b"\x08" * 64
    tables = b"\xff\xc4\x00\x1f\x00" + bytes([0, 0, 0, 12] + [0] * 12) + bytes(range(12)) + b"\xff\xc4\x00\x15\x10" + bytes([0, 2] + [0] * 14) + b"\x00\xf0"
    tables = tables.replace(b"\x00\x15\x10", b"\x00\x15\x10")
    bits = lambda text: int(text + "1" * (-len(text) % 8), 2).to_bytes((len(text) + 7) // 8, "big")
    dc = lambda v: format(abs(v).bit_length(), "04b") + (format(v if v > 0 else v + (1 << abs(v).bit_length()) - 1, f"0{abs(v).bit_length()}b") if v else "")
    gray = head + b"\xff\xc0\x00\x0b\x08\x00\x08\x00\x10\x01\x01\x11\x00" + tables + b"\xff\xdd\x00\x04\x00\x01" + b"\xff\xda\x00\x08\x01\x01\x00\x00\x3f\x00"
    gray += bits(dc(20) + "00") + b"\xff\xd0" + bits(dc(-30) + "00") + b"\xff\xd9"
    image = jpeg.decode(gray)
    assert image.shape == (8, 16, 3) and (image[:, :8] == 148).all() and (image[:, 8:] == 98).all()
    half = head + b"\xff\xc0\x00\x11\x08\x00\x08\x00\x10\x03\x01\x21\x00\x02\x11\x00\x03\x11\x00" + tables + b"\xff\xda\x00\x0c\x03\x01\x00\x02\x00\x03\x00\x00\x3f\x00"
    half += bits(dc(10) + "00" + dc(10) + "00" + dc(0) + "00" + dc(50) + "00") + b"\xff\xd9"
    image = jpeg.decode(half).astype(int)
    red = lambda y: int(np.floor(y + 1.402 * 50 + 0.5))
    assert image.shape == (8, 16, 3) and (image[:, :8, 0] == red(138)).all() and (image[:, 8:, 0] == red(148)).all()
    for broken in (b"", gray[:40], b"\xff\xd8\xff\xc2\x00\x0b" + gray[40:], gray.replace(b"\xff\xc4\x00\x15", b"\xff\xe0\x00\x15")):
        with pytest.raises((codecs.FormatError, codecs.struct.error, IndexError, ValueError)):
            jpeg.decode(broken)


@pytest.mark.parametrize("layout", list(yuv.LAYOUTS))
def test_layouts(spark, tmp_path, layout):
    rng = np.random.default_rng(1)
    planes = rng.integers(0, 256, (3, 8, 8))
    raw = yuv.pack(*planes, layout)
    back = yuv.unpack(raw, layout, 8, 8)
    assert len(raw) == yuv.frame_bytes(layout, 8, 8) and (back[0] == planes[0]).all() and yuv.pack(*back, layout) == raw
    flat = spark.createDataFrame([("a", i, [40 * i] * 64, [200] * 64, [90] * 64) for i in range(3)], "name string, frame long, r array<int>, g array<int>, b array<int>")
    files.write_video(flat, str(tmp_path), layout)
    found = sorted((r["frame"], r["r"][0], r["g"][63], r["b"][7]) for r in files.read_raw_video(spark, str(tmp_path), 8, 8, "*", layout).collect())
    assert len(found) == 3
    for i, r, g, b in found:
        assert (abs(r - 40 * i) <= 3 and abs(g - 200) <= 3 and abs(b - 90) <= 3) or layout == "y8"
    with pytest.raises(codecs.FormatError):
        yuv.frame_bytes("yv12", 7, 8)


@pytest.mark.parametrize("codec", [b"MJPG", b"YUY2"])
def test_avi_codecs(spark, tmp_path, codec):
    rows = [("a", i, [10 * i + x % 8 for x in range(64)], [120] * 64, [x for x in range(64)]) for i in range(5)]
    frames = spark.createDataFrame(rows, "name string, frame long, r array<int>, g array<int>, b array<int>")
    files.write_video(frames, str(tmp_path), codec=codec)
    assert codecs.avi_parse((tmp_path / "a.avi").read_bytes()).codec == codec
    for r in files.read_avi(spark, str(tmp_path)).collect():
        for c, want in zip("rgb", rows[r["frame"]][2:], strict=True):
            assert np.abs(np.array(r[c]) - want).max() <= (4 if codec == b"MJPG" else 8)


def test_wave64(spark, tmp_path):
    samples = spark.createDataFrame([("x", i, i - 5, 100 * i) for i in range(11)], "name string, pos long, l int, r int")
    files.write_wav(samples, str(tmp_path), kind="w64")
    assert codecs.sniff((tmp_path / "x.w64").read_bytes()) == "w64"
    assert sorted(tuple(r)[1:] for r in files.read_wav(spark, str(tmp_path), "*.w64").collect()) == [(i, i - 5, 100 * i) for i in range(11)]


def test_files_are_known_by_their_content(spark, tmp_path):
    image = np.arange(192, dtype=np.uint8).reshape(8, 8, 3)
    made = {"a1.x": codecs.png_encode(image), "b2.png": jpeg.encode(image, 0), "c3": codecs.bmp_encode(image), "d.jpg": codecs.avi_encode([image, image]), "e.avi": codecs.filmstrip_encode([image])}
    for name, data in made.items():
        (tmp_path / name).write_bytes(data)
    assert {r["name"]: r["kind"] for r in files.detect(spark, str(tmp_path)).collect()} == {"a1.x": "png", "b2.png": "jpg", "c3": "bmp", "d.jpg": "avi", "e.avi": "filmstrip"}
    frames = files.read_media(spark, str(tmp_path)).collect()
    assert len(frames) == 6 and all(np.abs(np.array(r["g"]) - image[:, :, 1].reshape(-1)).max() <= 4 for r in frames)
    (tmp_path / "f.txt").write_bytes(b"hello")
    with pytest.raises(codecs.FormatError):
        files.read_media(spark, str(tmp_path))
    assert files.read_media(spark, str(tmp_path), "skip").count() == 6
