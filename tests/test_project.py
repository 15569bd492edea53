from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.functions.fraction import Fraction
from framelake.operators import spatial
from framelake.plans import chain as ch
from framelake.plans.chain import Chain, Filter, FrameSchema, Stream
from framelake.plans.timeline import EditList
from framelake.script.api import Project
from framelake.script.language import ScriptError
from framelake.sources import codecs, files


@pytest.fixture
def project(spark):
    frames = files.test_id(spark).select("frame", "is_key", *(F.transform(F.sequence(F.lit(1), F.lit(32)), lambda i, k=k: (F.col("frame") * k + i).cast("int") % 256).alias(c) for k, c in ((1, "r"), (2, "g"), (3, "b"))))
    p = Project(spark)
    p.open(frames, 8, 4, Fraction(10))
    return p


def test_selection_and_rates(project):
    project.run_script("declare v = app.video; Script.Assert(v.width == 8 && v.height == 4 && v.framerate == 10); v.SetRange(0, 9000); v.ValidateFrames(0, 1, 2, 3, 4, 5, 6, 7, 8, 9);")
    project.run_script("app.video.SetFrameRate2(20, 1, 1); app.video.SetRange(0, 9500); app.video.ValidateFrames(0, 1, 2, 3, 4); Script.Assert(app.video.framerate == 20);")
    with pytest.raises(ScriptError):
        project.run_script("app.video.ValidateFrames(1);")


def test_direct_mode(project):
    project.run_script("declare v = app.video, s = app.subset; v.SetMode(0); v.SetRange(400, 9200); v.ValidateFrames(0, 1, 2, 3, 4, 5, 6, 7);")
    project.run_script("app.video.SetRange(); app.subset.Clear(); app.subset.AddRange(4, 4); app.video.ValidateFrames(0, 1, 2, 3, 4, 5, 6, 7);")
    project.run_script("app.subset.Clear(); app.subset.AddRange(15, 10); app.video.SetRange(200, 600); app.video.ValidateFrames(15, 16, 17, 18);")
    project.run_script("app.subset.Clear(); app.subset.AddRange(13, 10); app.video.ValidateFrames(15, 16);")
    project.run_script("app.video.SetMode(3); app.subset.Clear(); app.subset.AddRange(15, 10); Script.Assert(app.video.length == 2);")


def test_filters_and_saving(project, tmp_path):
    project.run_script(
        """
        declare f = app.video.filters;
        f.Add("invert"); f.Add("resize"); f.instance[1].Config(4, 2, "nearest"); f.Add("blur"); f.instance[2].SetEnabled(0);
        app.subset.Clear(); app.subset.AddRange(7, 2); app.subset.AddRange(7, 1); app.subset.AddMaskedRange(50, 1);
        app.project.AddTextInfo("who", "me"); app.Log("done");
        """
    )
    assert project.run_script("app.video.width * 10 + app.video.height;") == 42 and project.log == ["done"] and project.info == {"who": "me"}
    rows = project.result().orderBy("frame").collect()
    assert [r["frame"] for r in rows] == [0, 1, 2, 3] and rows[0]["r"] == rows[2]["r"] == rows[3]["r"] != rows[1]["r"]
    (path,) = project.save_avi(str(tmp_path))
    data = open(path, "rb").read()
    avi = codecs.avi_parse(data)
    assert (avi.width, avi.height, len(avi.chunks)) == (4, 2, 4)
    assert codecs.avi_frame(data, avi, avi.chunks[1])[0, 0].tolist() == [rows[1][c][0] for c in "rgb"]
    with pytest.raises(ScriptError):
        project.run_script('app.video.filters.Add("nothing");')


def stream(spark, n=6):
    rows = [(i, *([(i * 40 + k * 5 + c) % 256 for k in range(16)] for c in range(3))) for i in range(n)]
    return Stream(spark.createDataFrame(rows, "frame long, r array<int>, g array<int>, b array<int>"), FrameSchema(4, 4, count=n))


def planes(df):
    return {r["frame"]: np.array([r["r"], r["g"], r["b"]]) for r in df.collect()}


def test_converters_go_in_where_a_filter_refuses(spark):
    ycc = Filter("ycbcr only", lambda p: p, ("ycbcr",))
    rgb = Filter("rgb only", lambda p: p)
    c = Chain().add(rgb).add(ycc).add(rgb)
    assert [conv for _, conv, _ in c.plan(FrameSchema(4, 4))] == [[], ["ycbcr"], ["rgb"]]
    s = stream(spark)
    before, after = planes(s.frames), planes(c.run(s).frames)
    assert all(abs(before[k] - after[k]).max() <= 3 for k in before)
    with pytest.raises(ch.NotSupported):
        Chain().add(Filter("odd", lambda p: p, ("palette",))).plan(FrameSchema(4, 4))


def test_pruned_and_terminal_filters(spark):
    f = Filter("f", lambda p: p)
    c = Chain().add(f, enabled=False).add(f, opacity=[(0.0, 0.0, True), (9.0, 0.0, True)]).add(Filter("last", lambda p: p, terminal=True)).add(f)
    assert [e.filter.name for e, _, _ in c.plan(FrameSchema(4, 4))] == ["last"]
    shrink = Filter("shrink", spatial.reduce2, output=lambda s: FrameSchema(s.width // 2, s.height // 2))
    with pytest.raises(ch.NotSupported):
        Chain().add(shrink, frames=(0, 3)).plan(FrameSchema(4, 4))


def test_range_opacity_and_named_inputs(spark):
    s = stream(spark)
    invert = Filter("invert", lambda p: {k: 255 - v for k, v in p.items()})
    base = planes(s.frames)
    ranged = planes(Chain().add(invert, frames=(2, 4)).run(s).frames)
    assert all((ranged[i] == (255 - base[i] if 2 <= i < 4 else base[i])).all() for i in base)
    half = planes(Chain().add(invert, opacity=[(0.0, 0.5, True), (5.0, 0.5, True)]).run(s).frames)
    assert all(abs(half[i] - 127.5).max() <= 1 for i in base)
    diff = planes(Chain().add(invert, output_name="inv").add(ch.difference(), inputs=("$input", "inv")).run(s).frames)
    assert all((diff[i] == abs(255 - 2 * base[i])).all() for i in base)


def test_dependencies(spark):
    s = stream(spark)
    base = planes(s.frames)
    mean = planes(Chain().add(ch.mean_of(1, 1)).run(s).frames)
    for i in base:
        around = [base[min(max(f, 0), 5)] for f in (i - 1, i, i + 1)]
        assert (mean[i] == (sum(around) + 1) // 3).all()
    slow = Chain().add(ch.nearest_rate(2.0)).run(s)
    assert slow.schema.count == 12 and slow.schema.rate == Fraction(60)
    assert all((v == base[k // 2]).all() for k, v in planes(slow.frames).items())
    mixed = planes(ch.interpolate(s.frames, 6, 2.0))
    assert len(mixed) == 12
    for i, v in mixed.items():
        at = int(np.floor((i + 0.5) / 2 * 256 + 0.5)) - 128
        a, b = (base[min(max(f, 0), 5)] for f in (at >> 8, (at >> 8) + 1))
        assert (v == a + ((b - a) * (at & 255) + 128 >> 8)).all()


def test_direct_mode_finds_keys_however_far_back(spark):
    frames = spark.range(2_000).select(F.col("id").alias("frame"), F.array(F.lit(0)).alias("r"), F.array(F.lit(0)).alias("g"), F.array(F.lit(0)).alias("b"), F.col("id").isin(0, 100, 1_700).alias("is_key"))
    p = Project(spark, mode=0)
    p.open(frames, 1, 1)
    p.timeline = EditList([(1_500, 10), (1_750, 2)])
    assert p.shown().spans == [(100, 1_410, False, 0), (1_700, 52, False, 0)]


def test_projects_of_one_frame(spark):
    one = spark.createDataFrame([(0, [1], [2], [3])], "frame long, r array<int>, g array<int>, b array<int>")
    p = Project(spark)
    p.open(one, 1, 1)
    p.append(one)
    assert len(p.timeline) == 2 and p.result().count() == 2


def _numbers(spark, n=40):
    return spark.range(n).select("id", *(F.array(*((F.col("id") * k + i).cast("int") % 256 for i in range(32))).alias(c) for k, c in ((1, "r"), (2, "g"), (3, "b")))).withColumnRenamed("id", "frame")


def test_every_filter_can_be_added_and_runs(spark):
    """Each by its default settings, on its own: the frame has the size that its schema says."""
    from framelake.script.filters import FILTERS

    frames = _numbers(spark, 10).cache()
    for name in FILTERS:
        p = Project(spark)
        p.open(frames, 8, 4)
        p.run_script(f'app.video.filters.Add("{name}");')
        s = Chain(p.chain).run(p.source).schema
        done = Chain(p.chain).run(p.source).frames
        sizes = {(len(r["r"]), len(r["b"])) for r in done.collect()}
        want = s.width * s.height
        assert sizes == {(want, want)}, name
        assert done.count() == s.count, name


def test_configured_filters(spark):
    p = Project(spark)
    p.open(_numbers(spark), 8, 4)
    p.run_script('app.video.filters.Add("threshold"); app.video.filters.instance[0].Config(100); app.video.filters.Add("levels"); app.video.filters.instance[1].Config(0, 65535, 16777216, 65535, 0);')
    for r in p.result().collect():
        for i in range(32):
            rgb = [(r["frame"] * k + i) % 256 for k in (1, 2, 3)]
            assert r["r"][i] == (0 if 54 * rgb[0] + 183 * rgb[1] + 19 * rgb[2] >= 25600 else 255)


def test_sound_through_a_script(spark, tmp_path):
    from framelake.script.sound import Sound

    samples = spark.range(1000).selectExpr("id AS pos", "CAST(id * 10 AS INT) AS l", "CAST(-id AS INT) AS r")
    p = Project(spark)
    p.open(_numbers(spark, 20), 8, 4, Fraction(10))
    p.audio.source = Sound(samples, 500)
    p.timeline = EditList([(10, 5), (0, 2)])
    script = """
        app.audio.SetMode(1); app.audio.SetVolume(512); app.audio.EnableFilterGraph(1);
        declare i;
        app.audio.filters.Add("input"); app.audio.filters.Add("stereo split"); app.audio.filters.Add("gain");
        app.audio.filters.Add("stereo merge"); app.audio.filters.Add("output");
        app.audio.filters.Connect(0, 0, 1, 0); app.audio.filters.Connect(1, 1, 2, 0); app.audio.filters.Connect(1, 0, 3, 0);
        app.audio.filters.Connect(2, 0, 3, 1); app.audio.filters.Connect(3, 0, 4, 0);
        app.audio.filters.instance[2].SetDouble(0, 3.0);
    """
    p.run_script("\n".join(x for x in script.splitlines() if "declare" not in x))
    got = sorted((r["pos"], r["l"], r["r"]) for r in p.sounds().samples.collect())
    source = [*range(500, 750), *range(0, 100)]
    assert got == [(i, 20 * s, -6 * s) for i, s in enumerate(source)]
    p.run_script(f'app.SaveWAV("{tmp_path}/w"); app.SaveRawAudio("{tmp_path}/r");')
    assert files.read_wav(spark, str(tmp_path / "w")).count() == files.read_raw_audio(spark, str(tmp_path / "r")).count() == 350
    with pytest.raises(ScriptError):
        p.run_script('app.audio.filters.Connect(4, 0, 1, 0);')
    with pytest.raises(ScriptError):
        p.run_script('app.audio.filters.Add("no such");')


def test_saving_and_opening_through_a_script(spark, tmp_path):
    p = Project(spark)
    p.open(_numbers(spark, 12), 8, 4)
    p.run_script(f'app.SaveSegmentedAVI("{tmp_path}/s", 1, 5); app.SaveStripedAVI("{tmp_path}/t", 2); app.SaveRawVideo("{tmp_path}/v"); app.SaveAVI("{tmp_path}/a");')
    assert files.read_segmented(spark, str(tmp_path / "s")).count() == files.read_striped(spark, str(tmp_path / "t"), 2).count() == files.read_raw_video(spark, str(tmp_path / "v"), 8, 4).count() == 12
    q = Project(spark)
    q.run_script(f'app.Open("{tmp_path}/a/out.avi"); app.Append("{tmp_path}/a/out.avi");')
    rows = {r["frame"]: r["g"] for r in q.result().collect()}
    assert len(rows) == 24 and rows[3] == rows[15] == [(6 + i) % 256 for i in range(32)]
    q.run_script("app.Close();")
    assert q.source is None
