"""Queries of timelines, frame maps and key look-ups; streams are customers, spans their orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.catalog import register
from framelake.operators import stats
from framelake.operators.point import invert, levels_table, lookup
from framelake.plans import timeline as tl
from framelake.script.api import Project
from framelake.sources.tables import frames, pixels
from framelake.suites.video import SQL_PIXELS


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.select(F.col("o_custkey").alias("stream"), F.col("o_orderkey").alias("ord"), (F.col("o_orderkey") * 7 % 1000).alias("start"), (F.col("o_orderkey") % 20 + 5).alias("len"), (F.col("o_orderkey") % 7 == 0).alias("masked"), (F.col("o_orderkey") % 2).cast("int").alias("source"))


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every place of every customer's timeline, and one beyond its end; place 0 of those without."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("stream"))
    n = F.coalesce("n_frames", F.lit(0)).cast("long")
    return c.join(tl.total_frames(spans(spark, sf_dir)), "stream", "left").select("stream", F.explode(F.sequence(F.lit(0).cast("long"), n)).alias("place"))


def wanted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frame that a customer's spans show, and the ones after their ends."""
    return spans(spark, sf_dir).select("stream", F.explode(F.sequence("start", F.col("start") + F.col("len"))).alias("frame")).distinct()


SQL_SPANS = "tl AS (SELECT o_custkey AS stream, o_orderkey AS ord, o_orderkey * 7 % 1000 AS start, o_orderkey % 20 + 5 AS len, o_orderkey % 7 = 0 AS masked, CAST(o_orderkey % 2 AS INT) AS source FROM orders)"
SQL_PLACED = f"{SQL_SPANS}, placed AS (SELECT *, CAST(sum(len) OVER (PARTITION BY stream ORDER BY ord) - len AS BIGINT) AS dst0 FROM tl)"
_RENUMBER = "SELECT stream, row_number() OVER (PARTITION BY stream ORDER BY {order}) - 1 AS ord, start, CAST(len AS BIGINT) AS len, masked, source FROM {table} WHERE len > 0"
_COALESCE = """, marked AS (SELECT *, CASE WHEN lag(start + len) OVER w = start AND lag(masked) OVER w = masked AND lag(source) OVER w = source THEN 0 ELSE 1 END AS fresh FROM n WINDOW w AS (PARTITION BY stream ORDER BY ord)),
runs AS (SELECT *, sum(fresh) OVER (PARTITION BY stream ORDER BY ord) AS run FROM marked)
SELECT stream, CAST(run - 1 AS BIGINT) AS ord, arg_min(start, ord) AS start, CAST(sum(len) AS BIGINT) AS len, any_value(masked) AS masked, any_value(source) AS source FROM runs GROUP BY stream, run"""


register("tl_placed", lambda s, d: tl.placed(spans(s, d)), f"WITH {SQL_PLACED} SELECT * FROM placed")
register("tl_total_frames", lambda s, d: tl.total_frames(spans(s, d)), f"WITH {SQL_SPANS} SELECT stream, CAST(sum(len) AS BIGINT) AS n_frames FROM tl GROUP BY stream")
register(
    "tl_lookup",
    lambda s, d: tl.lookup(spans(s, d), places(s, d)),
    f"""WITH {SQL_PLACED}, asked AS (SELECT stream, unnest(range(0, n + 1)) AS place FROM (SELECT c_custkey AS stream, coalesce(sum(len), 0)::BIGINT AS n FROM customer LEFT JOIN tl ON tl.stream = c_custkey GROUP BY 1)),
hit AS (SELECT a.stream, a.place, p.* EXCLUDE (stream) FROM asked a LEFT JOIN placed p ON p.stream = a.stream AND a.place >= p.dst0 AND a.place < p.dst0 + p.len),
held AS (SELECT h.stream, h.place, arg_max(q.start + q.len - 1, q.ord) FILTER (NOT q.masked) AS f, arg_max(q.source, q.ord) FILTER (NOT q.masked) AS s, arg_min(q.start, q.ord) AS f0, arg_min(q.source, q.ord) AS s0
  FROM hit h JOIN placed q ON q.stream = h.stream AND q.ord <= h.ord WHERE h.masked GROUP BY 1, 2)
SELECT h.stream, h.place, CAST(coalesce(CASE WHEN h.masked THEN coalesce(k.f, k.f0) ELSE h.start + h.place - h.dst0 END, -1) AS BIGINT) AS frame, coalesce(h.masked, false) AS masked,
  CAST(coalesce(CASE WHEN h.masked THEN coalesce(k.s, k.s0) ELSE h.source END, -1) AS INT) AS source FROM hit h LEFT JOIN held k USING (stream, place)""",
)
register(
    "tl_reverse_lookup",
    lambda s, d: tl.reverse_lookup(spans(s, d), wanted(s, d)),
    f"""WITH {SQL_PLACED}, asked AS (SELECT DISTINCT stream, unnest(range(start, start + len + 1)) AS frame FROM tl)
SELECT a.stream, a.frame, CAST(coalesce(arg_min(p.dst0 + a.frame - p.start, p.ord), -1) AS BIGINT) AS place FROM asked a LEFT JOIN placed p ON p.stream = a.stream AND a.frame >= p.start AND a.frame < p.start + p.len GROUP BY 1, 2""",
)
register(
    "tl_union",
    lambda s, d: tl.union_spans(spans(s, d)),
    f"""WITH {SQL_SPANS}, each AS (SELECT DISTINCT stream, masked, source, unnest(range(start, start + len)) AS f FROM tl),
runs AS (SELECT *, f - row_number() OVER (PARTITION BY stream, masked, source ORDER BY f) AS k FROM each)
SELECT stream, masked, source, min(f) AS start, count(*) AS len FROM runs GROUP BY stream, masked, source, k""",
)
_CUT = lambda lo, hi: f"greatest(start, least(start + len, start + {lo} - dst0)) AS lo, greatest(start, least(start + len, start + {hi} - dst0)) AS hi"
register("tl_delete_range", lambda s, d: tl.delete_range(spans(s, d), 30, 40), f"WITH {SQL_PLACED}, cut AS (SELECT *, {_CUT(30, 70)} FROM placed), p AS (SELECT stream, ord, 0 AS piece, start, lo - start AS len, masked, source FROM cut UNION ALL SELECT stream, ord, 1, hi, start + len - hi, masked, source FROM cut) {_RENUMBER.format(order='ord, piece', table='p')}")
register("tl_delete_input_range", lambda s, d: tl.delete_input_range(spans(s, d), 200, 300), f"WITH {SQL_SPANS}, p AS (SELECT stream, ord, 0 AS piece, start, least(start + len, 200) - start AS len, masked, source FROM tl UNION ALL SELECT stream, ord, 1, greatest(start, 500), start + len - greatest(start, 500), masked, source FROM tl) {_RENUMBER.format(order='ord, piece', table='p')}")
register("tl_set_range", lambda s, d: tl.set_range(spans(s, d), 20, 35), f"WITH {SQL_PLACED}, cut AS (SELECT *, {_CUT(20, 55)} FROM placed), p AS (SELECT stream, ord, 0 AS piece, start, lo - start AS len, masked, source FROM cut UNION ALL SELECT stream, ord, 1, lo, hi - lo, true, source FROM cut UNION ALL SELECT stream, ord, 2, hi, start + len - hi, masked, source FROM cut), n AS ({_RENUMBER.format(order='ord, piece', table='p')}){_COALESCE}")
register("tl_clip", lambda s, d: tl.clip(spans(s, d), 25, 60), f"WITH {SQL_PLACED}, cut AS (SELECT *, {_CUT(25, 85)} FROM placed), p AS (SELECT stream, ord, lo AS start, hi - lo AS len, masked, source FROM cut) {_RENUMBER.format(order='ord', table='p')}")
register("tl_offset", lambda s, d: tl.offset(spans(s, d), 17), f"WITH {SQL_SPANS} SELECT stream, ord, start + 17 AS start, len, masked, source FROM tl")
register("tl_trim_input", lambda s, d: tl.trim_input(spans(s, d), 600), f"WITH {SQL_SPANS} SELECT stream, ord, start, least(len, 600 - start) AS len, masked, source FROM tl WHERE start < 600")
register(
    "tl_insert",
    lambda s, d: tl.insert(spans(s, d), 33, tl.offset(spans(s, d).where("ord % 3 = 0"), 2000)),
    f"WITH {SQL_PLACED}, cut AS (SELECT *, greatest(start, least(start + len, start + 33 - dst0)) AS lo FROM placed), p AS (SELECT stream, ord, 0 AS side, start, lo - start AS len, masked, source FROM cut UNION ALL SELECT stream, ord, 1, start + 2000, len, masked, source FROM tl WHERE ord % 3 = 0 UNION ALL SELECT stream, ord, 2, lo, start + len - lo, masked, source FROM cut), n AS ({_RENUMBER.format(order='side, ord', table='p')}){_COALESCE}",
)
register("tl_rescale", lambda s, d: tl.rescale(spans(s, d), 0.8, 800), f"WITH {SQL_SPANS}, p AS (SELECT stream, ord, CAST(ceil(start * 0.8::DOUBLE - 0.5) AS BIGINT) AS start, CASE WHEN ord = max(ord) OVER (PARTITION BY stream) THEN 800 ELSE CAST(ceil((start + len) * 0.8::DOUBLE - 0.5) AS BIGINT) END AS e, masked, source FROM tl), q AS (SELECT *, e - start AS len FROM p) {_RENUMBER.format(order='ord', table='q')}")


# --- keys and maps ---------------------------------------------------------


def video(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A long stream with a key frame every five frames, and some missing."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.select(F.lit(0).alias("stream"), F.col("o_orderkey").alias("frame"), ((F.col("o_orderkey") % 5 == 0) & (F.col("o_orderkey") % 35 != 0)).alias("is_key"))


SQL_VIDEO = "vid AS (SELECT 0 AS stream, o_orderkey AS frame, o_orderkey % 5 = 0 AND o_orderkey % 35 <> 0 AS is_key FROM orders)"
register("key_lookup", lambda s, d: tl.previous_key(video(s, d), block=256), f"WITH {SQL_VIDEO} SELECT *, last_value(CASE WHEN is_key THEN frame END IGNORE NULLS) OVER (ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS prev_key, first_value(CASE WHEN is_key THEN frame END IGNORE NULLS) OVER (ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS next_key FROM vid")
register(
    "key_nearest",
    lambda s, d: tl.previous_key(video(s, d)).select("frame", F.when(F.col("prev_key").isNull() | (F.col("next_key") - F.col("frame") < F.col("frame") - F.col("prev_key")), F.col("next_key")).otherwise(F.col("prev_key")).alias("nearest_key")),
    f"WITH {SQL_VIDEO}, k AS (SELECT frame AS key FROM vid WHERE is_key), p AS (SELECT v.frame, k.key AS prev FROM vid v ASOF LEFT JOIN k ON v.frame >= k.key), n AS (SELECT v.frame, k.key AS next FROM vid v ASOF LEFT JOIN k ON v.frame <= k.key) SELECT frame, CASE WHEN prev IS NULL OR next - frame < frame - prev THEN next ELSE prev END AS nearest_key FROM p JOIN n USING (frame)",
)
register("map_rate", lambda s, d: tl.rate_map(15_000, (30, 1), (24, 1), s), "SELECT i AS frame, i * 30 // 24 AS timeline FROM range(0, 12000) t(i)")
register("map_decimate", lambda s, d: video(s, d).where("frame % 3 = 0").select(F.floor(F.col("frame") / 3).alias("frame"), F.col("frame").alias("src")), f"WITH {SQL_VIDEO} SELECT frame // 3 AS frame, frame AS src FROM vid WHERE frame % 3 = 0")
register("map_interpolate", lambda s, d: tl.interpolation_map(1_000, 2.5, s), "SELECT i AS frame, CAST(floor((i + 0.5) / 2.5 * 256 + 0.5) - 128 AS BIGINT) >> 8 AS src, CAST(floor((i + 0.5) / 2.5 * 256 + 0.5) - 128 AS BIGINT) & 255 AS alpha FROM range(0, 2500) t(i)")
register(
    "map_direct",
    lambda s, d: tl.direct_map(video(s, d).where("frame % 4 <> 1").select("stream", F.row_number().over(tl.Window.partitionBy("stream").orderBy("frame")).alias("frame"), F.col("frame").alias("src")), video(s, d)),
    f"WITH {SQL_VIDEO}, m AS (SELECT stream, CAST(row_number() OVER (ORDER BY frame) AS INT) AS frame, frame AS src FROM vid WHERE frame % 4 <> 1), k AS (SELECT frame, last_value(CASE WHEN is_key THEN frame END IGNORE NULLS) OVER (ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS key FROM vid), j AS (SELECT m.*, k.key, lag(m.src) OVER (ORDER BY m.frame) AS last FROM m JOIN k ON k.frame = m.src) SELECT stream, frame, src, greatest(CASE WHEN last < src AND last >= key THEN last + 1 ELSE key END, key) AS needs FROM j",
)


def _far_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A project in direct mode over a long video with a key every 2,000 frames: spans grow back to theirs."""
    nothing = [F.array().cast("array<int>").alias(c) for c in "rgb"]
    frames_ = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("frame"), (F.col("o_orderkey") % 2_000 == 0).alias("is_key"), *nothing)
    project = Project(spark, mode=0)
    project.open(frames_, 0, 0)
    project.timeline = tl.EditList([(1_490, 5), (1_200, 3)])
    return project.frame_map()


register("map_direct_far_key", _far_keys, "SELECT i AS place, i AS frame FROM range(0, 1495) t(i) UNION ALL SELECT i + 1495, i FROM range(0, 1203) t(i)")
register("map_interleave", lambda s, d: tl.interleave(500, 44100 / 29.97, 11025, 64, s), "WITH t AS (SELECT i, ceil((ceil((i + 1) * (44100 / 29.97::DOUBLE)) + 11025) / 64) * 64 AS upto FROM range(0, 500) r(i)) SELECT i AS frame, CAST(upto - coalesce(lag(upto) OVER (ORDER BY i), 0) AS BIGINT) AS samples FROM t")


def _duplicates(spark, sf_dir):
    """Output frames of a frame map that show the same source as the one before stand for it."""
    m = tl.rate_map(1_000, (10, 1), (25, 1), spark)
    return stats.first_of_run(m, "frame", "timeline", block=100)


register("map_nearest_unique", _duplicates, "SELECT i AS frame, i * 10 // 25 AS timeline, min(i) OVER (PARTITION BY i * 10 // 25) AS unique_frame FROM range(0, 2500) t(i)")


def edit_and_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: an edit list selects frames, the filter chain grades them, a histogram sums up each shown place.

    Only frames that the timeline shows are filtered, each once however often it shows.
    """
    edits = tl.EditList.whole(400).delete(50, 30).mask(100, 20).insert(10, tl.EditList([(300, 25), (40, 5)])).add(480, 15)
    edit_df = spark.createDataFrame([(0, *row) for row in edits.rows()], "stream int, ord int, start long, len long, masked boolean, source int")
    shown = tl.lookup(edit_df, spark.range(len(edits)).select(F.lit(0).alias("stream"), F.col("id").alias("place")))
    needed = frames(spark, sf_dir).join(shown.select("frame").distinct(), "frame", "left_semi")
    table = levels_table(8192, 57344, 1.4, 0, 65535)
    graded = pixels(needed).select("frame", *(lookup(table, c).alias(n) for c, n in zip(invert((F.col("r"), F.col("g"), F.col("b"))), "rgb", strict=True)))
    per_frame = graded.select("frame", F.shiftright(19 * F.col("b") + 183 * F.col("g") + 54 * F.col("r"), 12).alias("bin")).groupBy("frame", "bin").agg(F.count(F.lit(1)).alias("n"))
    return shown.select("place", "frame").join(per_frame, "frame").select("place", "frame", "bin", "n")


_LV = "(CASE WHEN {v} * 257 < 8192 THEN 0 WHEN {v} * 257 > 57344 THEN 255 ELSE CAST(floor(65535 * pow(({v} * 257 - 8192) / 49152.0, 1 / 1.4) + 0.5) AS BIGINT) >> 8 END)"
register(
    "edit_and_grade",
    edit_and_grade,
    f"""WITH {SQL_PIXELS}, v(ord, start, len, masked) AS (VALUES (0, 0, 10, false), (1, 300, 25, false), (2, 40, 5, false), (3, 10, 40, false), (4, 80, 50, false), (5, 130, 20, true), (6, 150, 250, false), (7, 480, 15, false)),
p AS (SELECT *, sum(len) OVER (ORDER BY ord) - len AS dst0 FROM v), shown AS (SELECT CAST(i AS BIGINT) AS place, CASE WHEN masked THEN 129 ELSE start + i - dst0 END AS frame FROM p, range(0, 415) t(i) WHERE i >= dst0 AND i < dst0 + len),
g AS (SELECT frame, {', '.join(f"{_LV.format(v=f'(255 - {c})')} AS {c}" for c in 'rgb')} FROM px), h AS (SELECT frame, (19 * b + 183 * g + 54 * r) >> 12 AS bin, count(*) AS n FROM g GROUP BY 1, 2)
SELECT s.place, CAST(s.frame AS BIGINT) AS frame, CAST(h.bin AS INT) AS bin, h.n FROM shown s JOIN h ON h.frame = s.frame""",
)
