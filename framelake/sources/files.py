"""Readers and writers of media files as DataFrames.

Files come in through Spark's binaryFile source, so from any file system it
knows, and are decoded in the tasks that read them. Writers make one file per
group in the task that holds it; they need a folder that all tasks see.

mode "fail" raises on a file that can't be decoded, "skip" leaves it out, "keep"
gives its row without content: the three ways of treating damaged input.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framelake.sources import codecs, jpeg, yuv

FRAMES = "name string, frame long, is_key boolean, w int, h int, r array<int>, g array<int>, b array<int>"


DECODERS = {**codecs.DECODERS, "jpg": jpeg.decode, "jpeg": jpeg.decode}
ENCODERS = {**codecs.ENCODERS, "jpg": lambda image: jpeg.encode(image, 0)}


def _files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "content")


def _decoded(df: DataFrame, decode: Callable[[str, bytes], Iterator[tuple]], schema: str, mode: str, empty: Callable[[str], tuple] | None = None) -> DataFrame:
    def run(batches):
        for b in batches:
            for path, content in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                name = path.rsplit("/", 1)[-1]
                try:
                    rows = list(decode(name, content.as_py()))
                except (codecs.FormatError, ValueError, IndexError, codecs.struct.error, codecs.zlib.error):
                    if mode == "fail":
                        raise
                    rows = [empty(name)] if mode == "keep" and empty else []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    fields = [f.split() for f in schema.split(", ")]
    names = [f[0] for f in fields]
    kinds = [{"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32())}[f[1]] for f in fields]
    return df.mapInArrow(run, schema)


def _row(name: str, frame: int, key: bool, image: np.ndarray) -> tuple:
    h, w, _ = image.shape
    return (name, frame, key, w, h, *(image[:, :, i].reshape(-1).astype(np.int32).tolist() for i in range(3)))


def _nothing(name: str) -> tuple:
    return (name, None, None, None, None, None, None, None)


def read_images(spark: SparkSession, path: str, pattern: str = "*", mode: str = "fail") -> DataFrame:
    """One frame per file (PNG, JPEG, BMP or TGA, known by content, then by name); frames are numbered by the number in the name."""
    def decode(name: str, data: bytes):
        kind = codecs.sniff(data)
        kind = kind if kind in DECODERS else name.rsplit(".", 1)[-1].lower()
        if kind not in DECODERS:
            raise codecs.FormatError(f"{name} is of no known kind")
        digits = "".join(c if c.isdigit() else " " for c in name.rsplit(".", 1)[0]).split()
        yield _row(name, int(digits[-1]) if digits else 0, True, DECODERS[kind](data))

    return _decoded(_files(spark, path, pattern), decode, FRAMES, mode, _nothing)


def read_raw_video(spark: SparkSession, path: str, width: int, height: int, pattern: str = "*.rgb", layout: str = "rgb") -> DataFrame:
    """Frames of width x height one after another, as r, g, b bytes or in a layout of `yuv.LAYOUTS`; a rest at the end is no frame."""
    def decode(name: str, data: bytes):
        size = width * height * 3 if layout == "rgb" else yuv.frame_bytes(layout, width, height)
        for i in range(len(data) // size):
            if layout == "rgb":
                image = np.frombuffer(data, np.uint8, size, i * size).reshape(height, width, 3)
            else:
                image = yuv.to_rgb(*yuv.unpack(data[i * size : (i + 1) * size], layout, width, height))
            yield _row(name, i, True, image)

    return _decoded(_files(spark, path, pattern), decode, FRAMES, "fail")


def read_filmstrip(spark: SparkSession, path: str, pattern: str = "*.flm", mode: str = "fail") -> DataFrame:
    return _decoded(_files(spark, path, pattern), lambda name, data: (_row(name, i, True, f) for i, f in enumerate(codecs.filmstrip_decode(data))), FRAMES, mode, _nothing)


def read_avi(spark: SparkSession, path: str, pattern: str = "*.avi", mode: str = "fail", rebuild: bool = False) -> DataFrame:
    def decode(name: str, data: bytes):
        avi = codecs.avi_parse(data, rebuild)
        for i, c in enumerate(c for c in avi.chunks if c.stream == 0):
            yield _row(name, i, c.is_key, codecs.avi_frame(data, avi, c))

    return _decoded(_files(spark, path, pattern), decode, FRAMES, mode, _nothing)


def detect(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(name, kind, bytes): what each file is, by its content."""
    def decode(name: str, data: bytes):
        yield name, codecs.sniff(data), len(data)

    return _decoded(_files(spark, path, pattern), decode, "name string, kind string, bytes long", "fail")


#: Readers of video by what `codecs.sniff` finds; a reader gets the session, the path, a file-name pattern and a mode.
READERS: dict[str, Callable[..., DataFrame]] = {}


def read_media(spark: SparkSession, path: str, mode: str = "fail") -> DataFrame:
    """Frames of all files under path, each read by its kind's reader; kinds without one raise, or are left out by mode "skip"."""
    found = detect(spark, path)
    kinds = [r["kind"] for r in found.select("kind").distinct().collect()]  # at most as many as there are kinds
    unknown = sorted(set(kinds) - set(READERS))
    if unknown and mode == "fail":
        raise codecs.FormatError(f"no reader for {', '.join(unknown)}")
    out = None
    for kind in sorted(set(kinds) & set(READERS)):
        names = found.where(F.col("kind") == kind).select("name")
        frames = READERS[kind](spark, path, "*", "skip").join(names, "name", "left_semi")
        out = frames if out is None else out.unionByName(frames)
    return spark.createDataFrame([], FRAMES) if out is None else out


def read_avi_index(spark: SparkSession, path: str, pattern: str = "*.avi", rebuild: bool = False) -> DataFrame:
    """(name, stream, chunk, offset, size, is_key) of every chunk, without decoding."""
    def decode(name: str, data: bytes):
        for i, c in enumerate(codecs.avi_parse(data, rebuild).chunks):
            yield name, c.stream, i, c.offset, c.size, c.is_key

    return _decoded(_files(spark, path, pattern), decode, "name string, stream int, chunk long, offset long, size long, is_key boolean", "fail")


SAMPLES = "name string, pos long, l int, r int"


def read_wav(spark: SparkSession, path: str, pattern: str = "*.wav", mode: str = "fail") -> DataFrame:
    """(name, pos, l, r); a mono file has the same value on both sides."""
    def decode(name: str, data: bytes):
        s = codecs.wav_decode(data).samples
        return zip([name] * len(s), range(len(s)), s[:, 0].tolist(), s[:, -1].tolist(), strict=True)

    return _decoded(_files(spark, path, pattern), decode, SAMPLES, mode, lambda name: (name, None, None, None))


def append(*segments: DataFrame) -> DataFrame:
    """Segments one after another, frames numbered on from the largest before; an empty one adds nothing."""
    numbered = [s.withColumn("segment_", F.lit(i)) for i, s in enumerate(segments)]
    every = numbered[0]
    for s in numbered[1:]:
        every = every.unionByName(s)
    counts = every.groupBy("segment_").agg((F.max("frame") + 1).alias("n_"))  # a row per segment
    before = F.coalesce(F.sum("n_").over(Window.orderBy("segment_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(counts.select("segment_", before.alias("before_")))
    return every.join(starts, "segment_").withColumn("frame", F.col("frame") + F.col("before_")).select(*segments[0].columns)


# --- generated -------------------------------------------------------------


def test_id(spark: SparkSession, n: int = 100) -> DataFrame:
    """Frames of 8 x 4 that say their own number: (frame, is_key, code); every fifth is a key frame."""
    hi, lo = F.shiftright("id", 4), F.col("id").bitwiseAND(15)
    code = F.lit(0x8800) + F.shiftleft(F.shiftright(hi * 17, 3), 5) + F.shiftright(lo * 17, 3)
    return spark.range(n).select(F.col("id").alias("frame"), (F.col("id") % 5 == 0).alias("is_key"), code.cast("int").alias("code"))


def test_id_number(code):
    """The number that a test frame's pixel says."""
    return F.shiftright(code.bitwiseAND(0x1E), 1) + F.shiftright(code.bitwiseAND(0x3C0), 2)


def test_pattern(spark: SparkSession, n: int = 10, width: int = 32, height: int = 8) -> DataFrame:
    """A walk through the colour cube: (frame, x, y, r, g, b)."""
    grid = spark.range(n).select(F.col("id").alias("frame"), F.explode(F.sequence(F.lit(0), F.lit(width * height - 1))).alias("i"))
    x, y = F.col("i") % width, F.floor(F.col("i") / width).cast("int")
    return grid.select("frame", x.alias("x"), y.alias("y"), F.floor(x * 255 / (width - 1)).cast("int").alias("r"), F.floor(y * 255 / (height - 1)).cast("int").alias("g"), F.floor(F.col("frame") * 255 / max(1, n - 1)).cast("int").alias("b"))


# --- writers ---------------------------------------------------------------


def _image(row: dict, size: tuple[int, int]) -> np.ndarray:
    return np.stack([np.array(row[c], np.uint8).reshape(size[1], size[0]) for c in "rgb"], axis=2)


def _write_groups(df: DataFrame, by: list[str], folder: str, name: Callable[[tuple], str], encode: Callable[[list[dict]], bytes]) -> list[str]:
    """A file per group, its rows in order of frame or pos, put in place only when whole; returns the names."""
    folder = folder.removeprefix("file://")
    os.makedirs(folder, exist_ok=True)

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by("frame" if "frame" in table.column_names else "pos")
        target = os.path.join(folder, name(tuple(k.as_py() for k in key)))
        part = f"{target}.{os.getpid()}.part"
        with open(part, "wb") as f:
            f.write(encode(table.to_pylist()))
        os.replace(part, target)
        return pa.table({"file": pa.array([target])})

    return sorted(r["file"] for r in df.groupBy(*by).applyInArrow(run, "file string").collect())


def write_images(frames: DataFrame, folder: str, kind: str = "png", prefix: str = "frame", size: tuple[int, int] = (8, 8)) -> None:
    """A numbered image per frame, written where the frame is; nothing is shuffled."""
    folder = folder.removeprefix("file://")
    os.makedirs(folder, exist_ok=True)

    def run(rows) -> None:
        for row in rows:
            target = os.path.join(folder, f"{prefix}{row['frame']:08d}.{kind}")
            with open(target + ".part", "wb") as f:
                f.write(ENCODERS[kind](_image(row, size)))
            os.replace(target + ".part", target)

    frames.select("frame", *"rgb").foreachPartition(run)


def write_video(frames: DataFrame, folder: str, kind: str = "avi", by: str = "name", size: tuple[int, int] = (8, 8), rate: tuple[int, int] = (30, 1), riff_frames: int | None = None, codec: bytes = b"DIB ") -> list[str]:
    """A file per value of `by`: avi (in RIFF parts of riff_frames frames, by a codec), flm, gif, apng, rgb (raw) or a layout of `yuv.LAYOUTS`."""
    encoders = {
        "avi": lambda rows: codecs.avi_encode([_image(r, size) for r in rows], rate, [r["is_key"] for r in rows] if "is_key" in rows[0] else None, riff_frames=riff_frames, codec=codec),
        "flm": lambda rows: codecs.filmstrip_encode([_image(r, size) for r in rows], rate[0] // rate[1]),
        "gif": lambda rows: codecs.gif_encode([_image(r, size) for r in rows], 100 * rate[1] // rate[0]),
        "apng": lambda rows: codecs.apng_encode([_image(r, size) for r in rows], 100 * rate[1] // rate[0]),
        "rgb": lambda rows: b"".join(_image(r, size).tobytes() for r in rows),
    }
    for layout in yuv.LAYOUTS:
        encoders[layout] = lambda rows, k=layout: b"".join(yuv.pack(*yuv.from_rgb(_image(r, size)), k) for r in rows)
    return _write_groups(frames, [by], folder, lambda key: f"{key[0]}.{kind}", encoders[kind])


def segments(frames: DataFrame, size_col: str, most_bytes: int, most_frames: int, by: str = "stream", order: str = "frame") -> DataFrame:
    """frames with the number of the segment each goes to: a new one begins when bytes (24 more a frame) or frames would exceed the limit.

    Each segment begins where the one before was full, so a stream is followed in order; streams run in parallel.
    """
    def run(rows):
        rows = rows.sort_values(order)
        out, segment, held, count = [], 0, 0, 0
        for size in rows[size_col]:
            if count and (held + size + 24 > most_bytes or count >= most_frames):
                segment, held, count = segment + 1, 0, 0
            held, count = held + size + 24, count + 1
            out.append(segment)
        return rows.assign(segment=out)

    return frames.groupBy(by).applyInPandas(run, f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in frames.schema)}, segment int")


def stripes(frames: DataFrame, n: int) -> DataFrame:
    """frames with the one of n files each goes to, in turn."""
    return frames.withColumn("stripe", F.pmod("frame", F.lit(n)))


def write_segmented(frames: DataFrame, folder: str, most_bytes: int, most_frames: int, size: tuple[int, int] = (8, 8), **how) -> list[str]:
    """An AVI per segment, name.00.avi and so on, none above most_bytes of frames (as `segments` counts them) or most_frames."""
    area = size[0] * size[1] * 3
    cut = segments(frames.withColumn("size_", F.lit(area)), "size_", most_bytes, most_frames, "name")
    named = cut.withColumn("name", F.concat("name", F.lit("."), F.lpad(F.col("segment").cast("string"), 2, "0")))
    return write_video(named.drop("segment", "size_"), folder, "avi", size=size, **how)


def write_striped(frames: DataFrame, folder: str, n: int, size: tuple[int, int] = (8, 8), **how) -> list[str]:
    """n AVIs, each with every n-th frame of a name, name.stripe0.avi and so on."""
    named = stripes(frames, n).withColumn("name", F.concat("name", F.lit(".stripe"), F.col("stripe").cast("string")))
    return write_video(named.drop("stripe"), folder, "avi", size=size, **how)


def read_segmented(spark: SparkSession, path: str, **how) -> DataFrame:
    """The frames of segments name.00.avi, name.01.avi ... of each name, numbered on."""
    parts = read_avi(spark, path, "*.*.avi", **how).withColumn("segment_", F.regexp_extract("name", r"\.(\d+)\.avi$", 1).cast("int")).withColumn("name", F.regexp_extract("name", r"^(.*)\.\d+\.avi$", 1))
    counts = parts.groupBy("name", "segment_").agg((F.max("frame") + 1).alias("n_"))  # a row per file
    before = F.coalesce(F.sum("n_").over(Window.partitionBy("name").orderBy("segment_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("name", "segment_", before.alias("before_"))
    return parts.join(starts, ["name", "segment_"]).withColumn("frame", F.col("frame") + F.col("before_")).drop("segment_", "before_")


def read_striped(spark: SparkSession, path: str, n: int, **how) -> DataFrame:
    """The frames of n stripes of each name, in turn again."""
    parts = read_avi(spark, path, "*.stripe*.avi", **how)
    stripe = F.regexp_extract("name", r"\.stripe(\d+)\.avi$", 1).cast("long")
    return parts.withColumn("frame", F.col("frame") * n + stripe).withColumn("name", F.regexp_extract("name", r"^(.*)\.stripe\d+\.avi$", 1))


def write_raw_audio(samples: DataFrame, folder: str, by: str = "name") -> list[str]:
    """16-bit little-endian pairs without a header, a file per value of `by`."""
    return _write_groups(samples, [by], folder, lambda key: f"{key[0]}.pcm", lambda rows: np.array([[r["l"], r["r"]] for r in rows]).astype("<i2").tobytes())


def read_raw_audio(spark: SparkSession, path: str, pattern: str = "*.pcm") -> DataFrame:
    """(name, pos, l, r) of 16-bit little-endian pairs; a rest at the end is no sample."""
    def decode(name: str, data: bytes):
        s = np.frombuffer(data[: len(data) // 4 * 4], "<i2").reshape(-1, 2)
        return zip([name] * len(s), range(len(s)), s[:, 0].tolist(), s[:, 1].tolist(), strict=True)

    return _decoded(_files(spark, path, pattern), decode, SAMPLES, "fail")


def write_wav(samples: DataFrame, folder: str, rate: int = 44_100, by: str = "name", kind: str = "wav") -> list[str]:
    """16-bit stereo, a file per value of `by`: wav, or w64 for sounds of more than 4 GB."""
    encode = codecs.w64_encode if kind == "w64" else codecs.wav_encode
    return _write_groups(samples, [by], folder, lambda key: f"{key[0]}.{kind}", lambda rows: encode(np.array([[r["l"], r["r"]] for r in rows]), rate))


def run_null(df: DataFrame) -> None:
    """Computes everything and keeps nothing."""
    df.write.format("noop").mode("overwrite").save()


READERS |= {
    "avi": lambda spark, path, pattern, mode: read_avi(spark, path, pattern, mode),
    "filmstrip": lambda spark, path, pattern, mode: read_filmstrip(spark, path, pattern, mode),
    **{kind: lambda spark, path, pattern, mode: read_images(spark, path, pattern, mode) for kind in ("png", "jpg", "bmp")},
}
