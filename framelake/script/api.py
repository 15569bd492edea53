"""The script's objects over the DataFrame engine, and the same as Python methods.

`Project` is what a script edits: a source, a timeline, a filter chain, rates and
ranges. Its `application()` is the root object of a script; every member is also
a Python method under its snake_case name. Nothing is computed until something
is saved, previewed or run.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.functions.fraction import Fraction
from framelake.operators import spatial
from framelake.plans import timeline as tl
from framelake.plans.chain import Chain, Entry, Filter, FrameSchema, Stream
from framelake.plans.kernels import PLANES
from framelake.plans.timeline import EditList
from framelake.script import sound
from framelake.script.filters import FILTERS
from framelake.script.language import Function, Interpreter, ScriptError
from framelake.sources import files

def _length(frames: DataFrame) -> int:
    last = frames.agg(F.max("frame").alias("m")).first()["m"]
    return 0 if last is None else last + 1


@dataclass
class Project:
    spark: SparkSession
    source: Stream | None = None
    keys: DataFrame | None = None
    timeline: EditList = field(default_factory=EditList)
    chain: list[Entry] = field(default_factory=list)
    rate: Fraction | None = None
    range_ms: tuple[int, int] | None = None  # from the start and from the end, in source time
    range_frames: tuple[int, int] | None = None
    mode: int = 3  # 0 direct copy, 1 fast recompress, 2 normal recompress, 3 full processing
    log: list[str] = field(default_factory=list)
    info: dict[str, str] = field(default_factory=dict)
    audio: sound.Audio = field(default_factory=sound.Audio)
    params: list[str] = field(default_factory=list)

    def open(self, frames: DataFrame, width: int, height: int, rate: Fraction = Fraction(30)) -> None:
        """frames: (frame, r, g, b[, is_key]) without gaps from 0."""
        n = _length(frames)
        self.source = Stream(frames, FrameSchema(width, height, "rgb", rate, n))
        self.keys = frames.select("frame", "is_key") if "is_key" in frames.columns else None
        self.timeline, self.rate, self.range_ms, self.range_frames = EditList.whole(n), None, None, None

    def append(self, frames: DataFrame) -> None:
        names = ["frame", *PLANES]
        n = self.source.schema.count
        more = _length(frames)
        self.timeline = self.timeline.add(n, more)
        s = self.source.schema
        self.source = Stream(files.append(self.source.frames.select(*names), frames.select(*names)), FrameSchema(s.width, s.height, s.model, s.rate, n + more))

    def selection(self) -> tuple[int, int]:
        """Timeline frames [start, end) that are saved; the range counts in source time whatever the rate."""
        n = len(self.timeline)
        if self.range_frames:
            return max(0, self.range_frames[0]), min(n, self.range_frames[1])
        if not self.range_ms:
            return 0, n
        per_ms = self.source.schema.rate / 1000
        return max(0, per_ms.scale(self.range_ms[0])), max(0, n - per_ms.scale(self.range_ms[1]))

    def shown(self) -> EditList:
        """The part of the timeline that is saved, grown to key frames in direct mode."""
        start, end = self.selection()
        part = self.timeline.clip(start, max(0, end - start))
        if self.mode == 0 and self.keys is not None:
            starts = [s.start for s in part.spans]
            # One row per span comes back, with the key that its first frame needs, however far back that is.
            keyed = tl.previous_key(self.keys.withColumn("stream", F.lit(0))).where(F.col("frame").isin(starts))
            found = {r["prev_key"] for r in keyed.select("prev_key").distinct().collect()}
            part = part.direct(lambda f: f in found)
        return part

    def schema(self) -> FrameSchema:
        steps = Chain(self.chain).plan(self.source.schema)
        return steps[-1][2] if steps else self.source.schema

    def frame_map(self) -> DataFrame:
        """(place, frame): what each saved frame shows."""
        part = self.shown()
        rows = [(0, *row) for row in part.rows()]
        spans = self.spark.createDataFrame(rows, "stream int, ord int, start long, len long, masked boolean, source int")
        places = self.spark.range(len(part)).select(F.lit(0).alias("stream"), F.col("id").alias("place"))
        return tl.lookup(spans, places).select("place", "frame")

    def result(self) -> DataFrame:
        """(frame, r, g, b) as they are saved: each source frame is filtered once, however often it shows.

        Filters that look at other frames see the source's neighbours.
        """
        chosen = self.frame_map()
        source = self.source
        if all(e.filter.needs is None and e.filter.frames is None for e in self.chain):  # frames that don't show needn't be filtered
            source = Stream(source.frames.join(chosen.select("frame").distinct(), "frame", "left_semi"), source.schema)
        done = source if self.mode == 0 else Chain(self.chain).run(source)
        return chosen.join(done.frames.select("frame", *PLANES), "frame").select(F.col("place").alias("frame"), *PLANES)

    def save_avi(self, folder: str, name: str = "out") -> list[str]:
        s, rate = self.schema(), self.rate or self.source.schema.rate
        return files.write_video(self.result().withColumn("name", F.lit(name)), folder, "avi", size=(s.width, s.height), rate=(rate.hi, rate.lo))

    def save_images(self, folder: str, kind: str = "png") -> None:
        s = self.schema()
        files.write_images(self.result(), folder, kind, size=(s.width, s.height))

    def _named(self, name: str) -> tuple[DataFrame, dict]:
        s, rate = self.schema(), self.rate or self.source.schema.rate
        return self.result().withColumn("name", F.lit(name)), {"size": (s.width, s.height), "rate": (rate.hi, rate.lo)}

    def save_video(self, folder: str, kind: str, name: str = "out") -> list[str]:
        """rgb (raw), gif, apng or flm."""
        frames, how = self._named(name)
        return files.write_video(frames, folder, kind, **how)

    def save_segmented(self, folder: str, megabytes: int, most_frames: int, name: str = "out") -> list[str]:
        frames, how = self._named(name)
        return files.write_segmented(frames, folder, megabytes << 20, most_frames or 1 << 31, **how)

    def save_striped(self, folder: str, n: int, name: str = "out") -> list[str]:
        frames, how = self._named(name)
        return files.write_striped(frames, folder, n, **how)

    def sounds(self) -> sound.Sound:
        """The sound as it is saved; the timeline's selected part cuts it."""
        start, end = self.selection() if self.source else (0, 0)
        part = self.timeline.clip(start, max(0, end - start)) if self.source else EditList()
        return self.audio.result(part, self.source.schema.rate.as_float() if self.source else 1.0)

    def save_wav(self, folder: str, name: str = "out") -> list[str]:
        out = self.sounds()
        return files.write_wav(out.samples.withColumn("name", F.lit(name)), folder, out.rate)

    def save_raw_audio(self, folder: str, name: str = "out") -> list[str]:
        return files.write_raw_audio(self.sounds().samples.withColumn("name", F.lit(name)), folder)

    def open_file(self, path: str) -> None:
        """An AVI, filmstrip or folder of images; its frames become the source."""
        frames = self._read(path)
        size = frames.select("w", "h").first()
        if size is None:
            raise ScriptError(f"there are no frames in {path}")
        self.open(frames.select("frame", *PLANES, "is_key"), size["w"], size["h"])

    def append_file(self, path: str) -> None:
        self.append(self._read(path))

    def _read(self, path: str) -> DataFrame:
        kind = path.rsplit(".", 1)[-1].lower()
        if kind == "avi":
            return files.read_avi(self.spark, path)
        return files.read_filmstrip(self.spark, path) if kind == "flm" else files.read_images(self.spark, path)

    def close(self) -> None:
        self.source, self.keys, self.timeline = None, None, EditList()

    def run_null(self) -> None:
        files.run_null(self.result())

    def run_script(self, text: str, root: str = "app") -> Any:
        return Interpreter({root: application(self)}).run(text)


class Object:
    """A script object: properties by function, methods by overloads."""

    def __init__(self, methods: dict[str, list], properties: dict[str, Any] | None = None):
        self.methods, self.properties = methods, properties or {}

    def member(self, name: str) -> Any:
        if name in self.properties:
            return self.properties[name]()
        if name in self.methods:
            return Function(name, self.methods[name])
        raise ScriptError(f"no member {name}")


def _set(project: Project, **values) -> None:
    for k, v in values.items():
        setattr(project, k, v)


def _filter_object(project: Project, i: int) -> Object:
    def entry() -> Entry:
        if not 0 <= i < len(project.chain):
            raise ScriptError(f"no filter {i}")
        return project.chain[i]

    name = entry().filter.name
    types, build = FILTERS[name]

    def configure(*args) -> None:
        entry().filter = build(*args)

    def clip(left: int, top: int, right: int, bottom: int) -> None:
        f = entry().filter
        inner, crop = f.kernel, spatial.crop(left, top, right, bottom)
        output = f.output
        entry().filter = Filter(f.name, lambda p: inner(crop(p)), f.models, lambda s: output(FrameSchema(s.width - left - right, s.height - top - bottom, s.model, s.rate, s.count)))

    def add_curve() -> Object:
        entry().opacity = []
        return Object({"AddPoint": [("0ddi", lambda x, y, linear: entry().opacity.append((x, y, bool(linear))))]})

    return Object({
        "Config": [("0" + types[:k], configure) for k in range(len(types) + 1)],
        "SetEnabled": [("0i", lambda on: setattr(entry(), "enabled", bool(on)))],
        "SetRangeFrames": [("0ll", lambda a, b: setattr(entry(), "frames", (int(a), int(b))))],
        "SetClipping": [("0iiii", clip)],
        "SetOutputName": [("0s", lambda n: setattr(entry(), "output_name", n))],
        "AddInput": [("0s", lambda n: setattr(entry(), "inputs", (n,)))],
        "AddOpacityCurve": [("v", add_curve)],
        "Remove": [("0", lambda: project.chain.pop(i))],
    })


def application(project: Project) -> Object:
    """The root object of scripts."""
    def add(name: str) -> int:
        if name not in FILTERS:
            raise ScriptError(f"no filter is called {name}")
        project.chain.append(Entry(FILTERS[name][1]()))
        return len(project.chain) - 1

    def validate(*wanted: int) -> None:
        found = [r["frame"] for r in project.frame_map().orderBy("place").collect()]
        if found != [int(w) for w in wanted]:
            raise ScriptError(f"frames {found} are shown, not {list(wanted)}")

    def edit(change) -> None:
        project.timeline = change(project.timeline)

    filters = Object({"Add": [("is", add)], "Clear": [("0", project.chain.clear)], "BeginUpdate": [("0", lambda: None)], "EndUpdate": [("0", lambda: None)]}, {"instance": lambda: Object({"[]": [("vi", lambda i: _filter_object(project, i))]})})
    video = Object(
        {
            "SetMode": [("0i", lambda m: _set(project, mode=m))],
            "GetMode": [("i", lambda: project.mode)],
            "SetRange": [("0", lambda: _set(project, range_ms=None, range_frames=None)), ("0ii", lambda a, b: _set(project, range_ms=(a, b), range_frames=None))],
            "SetRangeFrames": [("0ii", lambda a, b: _set(project, range_frames=(a, b)))],
            "GetRange": [("ii", lambda i: project.selection()[i])],
            "GetFrameRate": [("d", lambda: (project.rate or project.source.schema.rate).as_float())],
            "SetFrameRate2": [("0iii", lambda hi, lo, _: _set(project, rate=Fraction(hi, lo) if hi else None))],
            "ValidateFrames": [("0.", validate)],
            "IsKeyFrame": [("il", lambda f: project.keys is None or bool(project.keys.where(F.col("frame") == int(f)).where("is_key").limit(1).count()))],
        },
        {"width": lambda: project.schema().width, "height": lambda: project.schema().height, "length": lambda: len(project.shown()), "framerate": lambda: (project.rate or project.source.schema.rate).as_float(), "filters": lambda: filters},
    )
    subset = Object(
        {
            "Clear": [("0", lambda: edit(lambda t: EditList()))],
            "AddRange": [("0ll", lambda a, n: edit(lambda t: t.add(int(a), int(n))))],
            "AddFrame": [("0ll", lambda a, n: edit(lambda t: t.add(int(a), int(n))))],
            "AddMaskedRange": [("0ll", lambda a, n: edit(lambda t: t.add(int(a), int(n), True)))],
            "Delete": [("0", lambda: edit(lambda t: EditList.whole(project.source.schema.count)))],
            "LookupFrame": [("il", lambda f: project.timeline.lookup(int(f))[0])],
        },
        {"length": lambda: len(project.timeline)},
    )
    return Object(
        {
            "SaveAVI": [("0s", lambda folder: project.save_avi(folder))],
            "SaveCompatibleAVI": [("0s", lambda folder: project.save_avi(folder))],
            "SaveSegmentedAVI": [("0sii", lambda folder, megabytes, n: project.save_segmented(folder, megabytes, n))],
            "SaveStripedAVI": [("0si", lambda folder, n: project.save_striped(folder, n))],
            "SaveImageSequence": [("0ss", project.save_images)],
            "SaveRawVideo": [("0s", lambda folder: project.save_video(folder, "rgb"))],
            "SaveAnimatedGIF": [("0s", lambda folder: project.save_video(folder, "gif"))],
            "SaveAnimatedPNG": [("0s", lambda folder: project.save_video(folder, "apng"))],
            "SaveWAV": [("0s", lambda folder: project.save_wav(folder))],
            "SaveAudio": [("0s", lambda folder: project.save_wav(folder))],
            "SaveRawAudio": [("0s", lambda folder: project.save_raw_audio(folder))],
            "Open": [("0s", project.open_file)],
            "Append": [("0s", project.append_file)],
            "Close": [("0", project.close)],
            "Preview": [("0", project.run_null)],
            "RunNullVideoPass": [("0", project.run_null)],
            "Log": [("0s", project.log.append)],
            "SetStatus": [("0s", project.log.append)],
            "Exit": [("0i", lambda code: None)],
        },
        {"version": lambda: "framelake", "video": lambda: video, "audio": lambda: sound.objects(project.audio, Object), "params": lambda: Object({"[]": [("si", lambda i: project.params[i])]}), "subset": lambda: subset, "project": lambda: Object({"AddTextInfo": [("0ss", project.info.__setitem__)], "ClearTextInfo": [("0", project.info.clear)]})},
    )
