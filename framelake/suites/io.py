"""Queries that write media files, read them back and give what the tables say, and generated sources and scripts."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.catalog import register
from framelake.functions.fraction import Fraction
from framelake.operators import audio
from framelake.script.columns import compile_expression
from framelake.sources import files
from framelake.sources.tables import SQL_CHUNKS, SQL_PIXELS, SQL_SAMPLES, chunks, frames, pixels, samples


def _folder(spark: SparkSession) -> str:
    """A folder under the cluster's shared one; a local one only where none is set."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    return tempfile.mkdtemp(prefix="media-", dir=shared.removeprefix("file://") if shared else None)


def _clips(s: SparkSession, d: str) -> DataFrame:
    """Frames as clips of 100."""
    return frames(s, d).withColumns({"name": F.concat(F.lit("clip"), F.floor(F.col("frame") / 100).cast("string")), "frame": F.col("frame") % 100})


def _video(kind: str, read):
    def run(s: SparkSession, d: str) -> DataFrame:
        folder = _folder(s)
        files.write_video(_clips(s, d), folder, kind)
        back = read(s, folder)
        number = F.regexp_extract("name", r"(\d+)\.", 1).cast("long") * 100 + F.col("frame")
        return pixels(back.withColumn("frame", number))

    return run


def _parts(s: SparkSession, d: str) -> DataFrame:
    folder = _folder(s)
    files.write_video(_clips(s, d), folder, riff_frames=30)
    return _numbered(files.read_avi(s, folder))


def _numbered(back: DataFrame) -> DataFrame:
    return pixels(back.withColumn("frame", F.regexp_extract("name", r"clip(\d+)", 1).cast("long") * 100 + F.col("frame")))


def _segmented(s: SparkSession, d: str) -> DataFrame:
    folder = _folder(s)
    files.write_segmented(_clips(s, d), folder, 8_000, 30)
    return _numbered(files.read_segmented(s, folder))


def _striped(s: SparkSession, d: str) -> DataFrame:
    folder = _folder(s)
    files.write_striped(_clips(s, d), folder, 3)
    return _numbered(files.read_striped(s, folder, 3))


_ALL = f"WITH {SQL_PIXELS} SELECT frame, x, y, r, g, b FROM px"
register("io_avi", _video("avi", files.read_avi), _ALL)
register("io_avi_rebuilt_index", _video("avi", lambda s, p: files.read_avi(s, p, rebuild=True)), _ALL)
register("io_avi_parts", _parts, _ALL)
register("io_avi_segmented", _segmented, _ALL)
register("io_avi_striped", _striped, _ALL)
register("io_filmstrip", _video("flm", files.read_filmstrip), _ALL)
register("io_raw_video", _video("rgb", lambda s, p: files.read_raw_video(s, p, 8, 8)), _ALL)


def _images(kind: str):
    def run(s: SparkSession, d: str) -> DataFrame:
        folder = _folder(s)
        files.write_images(frames(s, d), folder, kind)
        return pixels(files.read_images(s, folder))

    return run


for _kind in ("png", "bmp", "tga"):
    register(f"io_images_{_kind}", _images(_kind), _ALL)


def _avi_index(s: SparkSession, d: str) -> DataFrame:
    folder = _folder(s)
    files.write_video(_clips(s, d).withColumn("is_key", F.col("frame") % 5 == 0), folder, "avi")
    return files.read_avi_index(s, folder).groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"), F.sum(F.col("is_key").cast("long")).alias("keys"))


register("io_avi_index", _avi_index, "SELECT 'clip' || (vec_id // 100) || '.avi' AS name, count(*) AS n, CAST(count(*) * 192 AS BIGINT) AS bytes, CAST(sum(CASE WHEN vec_id % 5 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS keys FROM embeddings GROUP BY 1")


def _wav(s: SparkSession, d: str) -> DataFrame:
    folder = _folder(s)
    files.write_wav(samples(s, d).withColumn("name", F.lit("all")), folder)
    return files.read_wav(s, folder).select("pos", "l", "r")


def _pcm(s: SparkSession, d: str) -> DataFrame:
    folder = _folder(s)
    files.write_raw_audio(samples(s, d).withColumn("name", F.lit("all")), folder)
    return files.read_raw_audio(s, folder).select("pos", "l", "r")


register("io_raw_audio", _pcm, f"WITH {SQL_SAMPLES} SELECT pos, l, r FROM smp")
register("io_wav", _wav, f"WITH {SQL_SAMPLES} SELECT pos, l, r FROM smp")
register(
    "io_segments",
    lambda s, d: files.segments(chunks(s, d).select(F.col("kind").alias("stream"), F.col("chunk").alias("frame"), "size"), "size", 100_000, 40),
    f"""WITH RECURSIVE {SQL_CHUNKS}, c AS (SELECT kind AS stream, chunk AS frame, size, row_number() OVER (PARTITION BY kind ORDER BY chunk) AS k FROM chk),
walk(stream, k, frame, size, segment, held, n) AS (
  SELECT stream, k, frame, size, CAST(0 AS BIGINT), CAST(size + 24 AS BIGINT), CAST(1 AS BIGINT) FROM c WHERE k = 1
  UNION ALL SELECT stream, k, frame, size, segment + CASE WHEN cut THEN 1 ELSE 0 END, CASE WHEN cut THEN 0 ELSE held END + size + 24, CASE WHEN cut THEN 0 ELSE n END + 1
  FROM (SELECT c.*, w.segment, w.held, w.n, w.held + c.size + 24 > 100000 OR w.n >= 40 AS cut FROM walk w JOIN c ON c.stream = w.stream AND c.k = w.k + 1))
SELECT stream, frame, size, CAST(segment AS INT) AS segment FROM walk""",
)
register("io_stripes", lambda s, d: files.stripes(frames(s, d).select("frame"), 3), "SELECT vec_id AS frame, vec_id % 3 AS stripe FROM embeddings")


def _close(back: DataFrame, s: SparkSession, d: str) -> DataFrame:
    """How many pixels there are, and how many came back within what quantisation by 1 can do."""
    px = pixels(frames(s, d)).select("frame", "x", "y", *(F.col(c).alias(f"{c}0") for c in "rgb"))
    near = F.greatest(*(F.abs(F.col(c) - F.col(f"{c}0")) for c in "rgb")) <= 4
    return px.join(back, ["frame", "x", "y"], "left").agg(F.count(F.lit(1)).alias("n"), F.sum(near.cast("long")).alias("near"))


def _jpegs(s: SparkSession, d: str) -> DataFrame:
    folder = _folder(s)
    files.write_images(frames(s, d), folder, "jpg")
    return _close(pixels(files.read_images(s, folder)), s, d)


def _motion_jpeg(s: SparkSession, d: str) -> DataFrame:
    folder = _folder(s)
    files.write_video(_clips(s, d), folder, codec=b"MJPG")
    return _close(_numbered(files.read_avi(s, folder)), s, d)


_COUNT = f"WITH {SQL_PIXELS} SELECT count(*) AS n, count(*) AS near FROM px"
register("io_images_jpg", _jpegs, _COUNT)
register("io_avi_motion_jpeg", _motion_jpeg, _COUNT)


def _raw(layout: str):
    def run(s: SparkSession, d: str) -> DataFrame:
        folder = _folder(s)
        files.write_video(_clips(s, d), folder, layout)
        return _numbered(files.read_raw_video(s, folder, 8, 8, "*", layout))

    return run


def _layout_sql(across: int, down: int) -> str:
    """To limited-range YCbCr, chroma averaged over so many pixels, and back."""
    fit = lambda v: f"greatest(0, least(255, ({v}) >> 16))"
    forward = ((16829, 33039, 6416, 0x108000), (-9714, -19071, 28784, 0x808000), (28784, -24103, -4681, 0x808000))
    ycc = ", ".join(f"{fit(f'({r}) * r + ({g}) * g + ({b}) * b + {o}')}::BIGINT AS {n}" for (r, g, b, o), n in zip(forward, ("yy", "uu", "vv"), strict=True))
    area = across * down
    mean = ", ".join(f"((sum({c}) + {area // 2}) // {area})::BIGINT AS {c}" for c in ("uu", "vv"))
    base = "76309 * (f.yy - 16) + 32768"
    back = (f"{base} + 104597 * (m.vv - 128)", f"{base} - 53279 * (m.vv - 128) - 25674 * (m.uu - 128)", f"{base} + 132201 * (m.uu - 128)")
    return f"""WITH {SQL_PIXELS}, f AS (SELECT frame, x, y, {ycc} FROM px), m AS (SELECT frame, x // {across} AS hx, y // {down} AS hy, {mean} FROM f GROUP BY 1, 2, 3)
SELECT f.frame, f.x, f.y, {', '.join(f'CAST({fit(v)} AS INT) AS {c}' for v, c in zip(back, 'rgb', strict=True))} FROM f JOIN m ON m.frame = f.frame AND m.hx = f.x // {across} AND m.hy = f.y // {down}"""


for _layout, _shared in (("yuy2", (2, 1)), ("uyvy", (2, 1)), ("yv12", (2, 2)), ("nv12", (2, 2)), ("yvu9", (4, 4)), ("yv24", (1, 1))):
    register(f"io_raw_{_layout}", _raw(_layout), _layout_sql(*_shared))


def _yuy2_avi(s: SparkSession, d: str) -> DataFrame:
    folder = _folder(s)
    files.write_video(_clips(s, d), folder, codec=b"YUY2")
    return _numbered(files.read_avi(s, folder))


register("io_avi_yuy2", _yuy2_avi, _layout_sql(2, 1))


def _w64(s: SparkSession, d: str) -> DataFrame:
    folder = _folder(s)
    files.write_wav(samples(s, d).withColumn("name", F.lit("all")), folder, kind="w64")
    return files.read_wav(s, folder, "*.w64").select("pos", "l", "r")


register("io_wave64", _w64, f"WITH {SQL_SAMPLES} SELECT pos, l, r FROM smp")


def _kinds(s: SparkSession, d: str) -> DataFrame:
    """Files of several kinds in one folder, known by content and each read by its reader."""
    folder = _folder(s)
    files.write_images(frames(s, d).where("frame % 2 = 0"), folder, "png")
    files.write_images(frames(s, d).where("frame % 2 = 1"), folder, "bmp")
    return pixels(files.read_media(s, folder))


register("io_read_by_content", _kinds, _ALL)
register("io_append_one_frame", lambda s, d: files.append(frames(s, d).where("frame = 0").select("frame"), frames(s, d).select("frame")), "SELECT vec_id + 1 AS frame FROM embeddings UNION ALL SELECT 0")
register("io_append", lambda s, d: files.append(frames(s, d).select("frame"), frames(s, d).select("frame")), "SELECT vec_id AS frame FROM embeddings UNION ALL SELECT vec_id + (SELECT max(vec_id) + 1 FROM embeddings) FROM embeddings")


def _null_pass(s: SparkSession, d: str) -> DataFrame:
    px = pixels(frames(s, d))
    files.run_null(px)
    return px.agg(F.count(F.lit(1)).alias("n"))


register("io_null_pass", _null_pass, f"WITH {SQL_PIXELS} SELECT count(*) AS n FROM px")
register("src_test_id", lambda s, d: files.test_id(s).withColumn("number", files.test_id_number(F.col("code"))), "SELECT i AS frame, i % 5 = 0 AS is_key, CAST(34816 + ((((i >> 4) * 17) >> 3) << 5) + (((i & 15) * 17) >> 3) AS INT) AS code, CAST(i AS INT) AS number FROM range(0, 100) t(i)")
register("src_test_pattern", lambda s, d: files.test_pattern(s), "SELECT f AS frame, CAST(x AS INT) AS x, CAST(y AS INT) AS y, CAST(x * 255 // 31 AS INT) AS r, CAST(y * 255 // 7 AS INT) AS g, CAST(f * 255 // 9 AS INT) AS b FROM range(0, 10) a(f), range(0, 32) b(x), range(0, 8) c(y)")
register("src_chunks", chunks, f"WITH {SQL_CHUNKS} SELECT * FROM chk")

# --- scripts and scalar functions ------------------------------------------

_LINES = lambda s, d: s.read.parquet(f"{d}/lineitem.parquet")
register(
    "script_columns",
    lambda s, d: _LINES(s, d).select("l_orderkey", "l_linenumber", *(compile_expression(e).alias(n) for n, e in (("a", "l_partkey * 7 % 1000 + (l_suppkey & 15)"), ("b", "(l_partkey ^ l_suppkey) / 3 - l_linenumber"), ("c", "l_partkey > l_suppkey && l_linenumber != 2 || !l_linenumber"), ("d", "~l_partkey | 5"), ("e", "(double)l_suppkey * 0.5")))),
    "SELECT l_orderkey, l_linenumber, l_partkey * 7 % 1000 + (l_suppkey & 15) AS a, xor(l_partkey, l_suppkey) // 3 - l_linenumber AS b, CAST((l_partkey > l_suppkey AND l_linenumber <> 2) OR l_linenumber = 0 AS BIGINT) AS c, ~l_partkey | 5 AS d, l_suppkey * 0.5::DOUBLE AS e FROM lineitem",
)
_RATE = Fraction(30000, 1001)
register(
    "fraction_scale",
    lambda s, d: s.read.parquet(f"{d}/orders.parquet").select("o_orderkey", *(_RATE.scale_column(F.col("o_orderkey") * 1_000_003 - 5_000_000_000, m).alias(m) for m in ("trunc", "round", "up"))),
    "WITH t AS (SELECT o_orderkey, o_orderkey * 1000003 - 5000000000 AS v FROM orders), u AS (SELECT *, abs(v)::HUGEINT * 30000 AS w, CASE WHEN v < 0 THEN -1 ELSE 1 END AS s FROM t) SELECT o_orderkey, CAST(s * (w // 1001) AS BIGINT) AS trunc, CAST(s * ((w + 500) // 1001) AS BIGINT) AS round, CAST(CASE WHEN v > 0 THEN (w + 1000) // 1001 ELSE s * (w // 1001) END AS BIGINT) AS up FROM u",
)
register("json_scalars", lambda s, d: s.read.parquet(f"{d}/events.parquet").select("event_id", F.coalesce(F.get_json_object("props", "$.missing"), F.lit("none")).alias("missing"), F.json_object_keys("props").alias("keys")).select("event_id", "missing", F.array_join("keys", ",").alias("keys")), "SELECT event_id, coalesce(json_extract_string(props, '$.missing'), 'none') AS missing, array_to_string(json_keys(props), ',') AS keys FROM events")
register("audio_x_law_codes", lambda s, d: s.range(256).select(F.col("id").cast("int").alias("code"), audio.decode_x_law(F.col("id").cast("int"), "mu").alias("mu")), "SELECT CAST(i AS INT) AS code, CAST(CASE WHEN (xor(i, 255) & 128) > 0 THEN -1 ELSE 1 END * ((((xor(i, 255) & 15) * 8 + 132) << ((xor(i, 255) >> 4) & 7)) - 132) AS INT) AS mu FROM range(0, 256) t(i)")
