"""Queries of aggregates, windows, joins with curves, and job queues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.catalog import register
from framelake.functions import curve
from framelake.operators import point, stats
from framelake.operators.point import luma
from framelake.sources.tables import SQL_CHUNKS, SQL_PACKETS, SQL_PIXELS, SQL_SAMPLES, chunks, frames, packets, pixels, samples

_PX = lambda s, d: pixels(frames(s, d))


def _luma():
    return F.shiftright(luma((F.col("r"), F.col("g"), F.col("b"))), 8)



register("agg_histogram_gray", lambda s, d: stats.histogram(_PX(s, d), _luma()), f"WITH {SQL_PIXELS} SELECT frame, (19 * b + 183 * g + 54 * r) >> 8 AS bin, count(*) AS n FROM px GROUP BY 1, 2")
register("agg_histogram_red", lambda s, d: stats.histogram(_PX(s, d), F.col("r")), f"WITH {SQL_PIXELS} SELECT frame, r AS bin, count(*) AS n FROM px GROUP BY 1, 2")
register("agg_histogram_shot", lambda s, d: stats.histogram(_PX(s, d).join(frames(s, d).select("frame", "shot"), "frame"), F.col("g"), ("shot",), 3), f"WITH {SQL_PIXELS} SELECT shot, g >> 3 AS bin, count(*) AS n FROM px GROUP BY 1, 2")
register("agg_channel_cube", lambda s, d: stats.channel_cube(_PX(s, d)), f"WITH {SQL_PIXELS}, t AS (SELECT r >> 6 AS r, g >> 6 AS g, b >> 6 AS b FROM px) SELECT coalesce(r, -1) AS r, coalesce(g, -1) AS g, coalesce(b, -1) AS b, count(*) AS n FROM t GROUP BY CUBE (r, g, b)")
register("agg_tile_means", lambda s, d: stats.tile_means(_PX(s, d), 4), f"WITH {SQL_PIXELS} SELECT frame, CAST(x // 4 AS BIGINT) AS tx, CAST(y // 4 AS BIGINT) AS ty, {', '.join(f'(sum({c}) + 8)::BIGINT >> 4 AS {c}' for c in 'rgb')} FROM px GROUP BY 1, 2, 3")
_SCENE = f"""WITH {SQL_PIXELS}, tiles AS (SELECT frame, x // 4 AS tx, y // 4 AS ty, {', '.join(f'(sum({c}) + 8)::BIGINT >> 4 AS {c}' for c in 'rgb')} FROM px GROUP BY 1, 2, 3),
l AS (SELECT *, (54 * r + 183 * g + 19 * b + 128) >> 8 AS y, (54 * abs(r - lag(r) OVER w) + 183 * abs(g - lag(g) OVER w) + 19 * abs(b - lag(b) OVER w)) >> 8 AS d FROM tiles WINDOW w AS (PARTITION BY tx, ty ORDER BY frame))
SELECT frame, metric, is_cut, is_fade, is_fade AND NOT coalesce(lag(is_fade) OVER (ORDER BY frame), false) AS fade_starts FROM (
SELECT frame, CAST(coalesce(sum(d), 0) AS BIGINT) AS metric, coalesce(sum(d), 0) > 60 AS is_cut, sqrt(CAST(count(*) * sum(y * y) - sum(y) * sum(y) AS DOUBLE)) < 30 AS is_fade FROM l GROUP BY frame)"""
register("agg_scene_changes", lambda s, d: stats.scene_changes(stats.tile_means(_PX(s, d), 4), 60, 30, 100), _SCENE)
register("agg_regression", lambda s, d: stats.regression(packets(s, d).withColumns({"x": (F.col("clock_us") % 1_000_000_007).cast("double"), "y": (F.col("ts_us") % 1_000_000_007).cast("double")}), "x", "y", ("user_id",)).select("user_id", "n", F.round("slope", 6).alias("slope")), f"WITH {SQL_PACKETS}, p AS (SELECT user_id, CAST(clock_us % 1000000007 AS DOUBLE) AS x, CAST(ts_us % 1000000007 AS DOUBLE) AS y FROM pkt) SELECT user_id, count(*) AS n, round(CASE WHEN count(*) >= 4 THEN regr_slope(y, x) END, 6) AS slope FROM p GROUP BY user_id")
register(
    "win_regression",
    lambda s, d: stats.windowed_regression(packets(s, d).select("user_id", "seq", F.col("seq").cast("double").alias("x"), F.col("bytes").cast("double").alias("y")), "x", "y", "seq", 5, ("user_id",)).select("user_id", "seq", F.round("slope", 5).alias("slope")),
    f"WITH {SQL_PACKETS} SELECT user_id, seq, round(CASE WHEN count(*) OVER w >= 5 THEN regr_slope(CAST(bytes AS DOUBLE), CAST(seq AS DOUBLE)) OVER w END, 5) AS slope FROM pkt WINDOW w AS (PARTITION BY user_id ORDER BY seq ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)",
)
register("win_moving_average", lambda s, d: stats.moving_average(packets(s, d), "bytes", "seq", 8, ("user_id",)).select("user_id", "seq", F.round("average", 6).alias("average")), f"WITH {SQL_PACKETS} SELECT user_id, seq, round((sum(bytes) OVER w + (8 - count(*) OVER w) * first_value(bytes) OVER (PARTITION BY user_id ORDER BY seq)) / 8.0::DOUBLE, 6) AS average FROM pkt WINDOW w AS (PARTITION BY user_id ORDER BY seq ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)")
register("agg_peaks", lambda s, d: stats.peaks(samples(s, d)), f"WITH {SQL_SAMPLES} SELECT pos // 100 AS block, max(abs(l)) AS left, max(abs(r)) AS right FROM smp GROUP BY 1")
register("agg_running_offsets", lambda s, d: stats.running_offsets(chunks(s, d), 4, 512), f"WITH {SQL_CHUNKS}, t AS (SELECT chunk, size, CAST(ceil(size / 4) AS BIGINT) AS samples FROM chk) SELECT *, CAST(coalesce(sum(size) OVER w, 0) AS BIGINT) AS byte0, CAST(coalesce(sum(samples) OVER w, 0) AS BIGINT) AS sample0 FROM t WINDOW w AS (ORDER BY chunk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
register("agg_bit_rates", lambda s, d: stats.bit_rates(chunks(s, d)).select("kind", *(F.round(c, 6).alias(c) for c in ("mean", "deviation", "most"))), f"WITH {SQL_CHUNKS} SELECT kind, round(avg(size), 6) AS mean, round(stddev_pop(size), 6) AS deviation, round(greatest(max(size) - avg(size), avg(size) - min(size)), 6) AS most FROM chk GROUP BY kind")
register("agg_stream_totals", lambda s, d: stats.stream_totals(chunks(s, d)), f"WITH {SQL_CHUNKS} SELECT kind, count(*) AS chunks, CAST(sum(size) AS BIGINT) AS bytes, min(size) AS least, max(size) AS most, CAST(sum(CAST(is_key AS INT)) AS BIGINT) AS keys FROM chk GROUP BY kind")
register("agg_byte_rate", lambda s, d: chunks(s, d).groupBy("kind").agg((F.sum("size") * 44100 / (F.count(F.lit(1)) * 1152)).alias("rate")).select("kind", F.round("rate", 6).alias("rate")), f"WITH {SQL_CHUNKS} SELECT kind, round(sum(size) * 44100 / (count(*) * 1152)::DOUBLE, 6) AS rate FROM chk GROUP BY kind")
register("agg_symbolic_frame", lambda s, d: stats.symbolic_frame(s.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_orderkey").alias("frame"), F.col("l_partkey").alias("src"))), "SELECT l_orderkey AS frame, CAST((sum(l_partkey) + (count(*) >> 1)) // count(*) AS BIGINT) AS symbolic FROM lineitem GROUP BY 1")
_CURVE = [(50.0, 0.1, False), (150.0, 0.9, True), (300.0, 0.3, False), (420.0, 1.2, False)]
register("curve_nearest_point", lambda s, d: stats.nearest_points(curve.as_table(s, _CURVE), frames(s, d)), "WITH c(x) AS (VALUES (50.0), (150.0), (300.0), (420.0)) SELECT vec_id AS frame, CAST(arg_min(x, abs(x - vec_id) * 1000 + x / 1000) AS DOUBLE) AS x FROM embeddings, c GROUP BY 1")


def _curve_sql() -> str:
    """The same curve by joining each frame with its bracketing points; slopes from the neighbours, ends doubled."""
    return """c(i, x, y, lin) AS (VALUES (1, 50.0::DOUBLE, 0.1::DOUBLE, false), (2, 150.0, 0.9, true), (3, 300.0, 0.3, false), (4, 420.0, 1.2, false)),
s AS (SELECT a.x x1, a.y y1, a.lin, b.x x2, b.y y2, coalesce(z.x, a.x) x0, coalesce(z.y, a.y) y0, coalesce(d.x, b.x) x3, coalesce(d.y, b.y) y3 FROM c a JOIN c b ON b.i = a.i + 1 LEFT JOIN c z ON z.i = a.i - 1 LEFT JOIN c d ON d.i = a.i + 2),
f AS (SELECT vec_id AS frame, CAST(vec_id AS DOUBLE) AS p FROM embeddings),
j AS (SELECT f.*, s.*, (p - x1) / (x2 - x1) AS t, (y2 - y0) / (x2 - x0) * (x2 - x1) AS m1, (y3 - y1) / (x3 - x1) * (x2 - x1) AS m2 FROM f LEFT JOIN s ON p >= x1 AND p < x2),
alpha AS (SELECT frame, greatest(0, least(1, CASE WHEN p < 50 THEN 0.1 WHEN p >= 420 THEN 1.2 WHEN lin THEN y1 + (y2 - y1) * t ELSE y1 + t * (m1 + t * ((-2 * m1 - m2 - 3 * (y1 - y2)) + t * (m1 + m2 + 2 * (y1 - y2)))) END)) AS a FROM j)"""


register("curve_evaluate", lambda s, d: frames(s, d).select("frame", F.round(curve.evaluate(_CURVE, F.col("frame").cast("double")), 6).alias("a")), f"WITH {_curve_sql()} SELECT frame, round(a, 6) AS a FROM alpha")


def _opacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = _PX(spark, sf_dir)
    filtered = px.select("frame", "x", "y", *(c.alias(n) for c, n in zip(point.invert((F.col("r"), F.col("g"), F.col("b"))), "rgb", strict=True)))
    return curve.with_opacity(px, filtered, _CURVE)


_MIX = ", ".join(f"CAST(CASE WHEN a < 0.5 / 255 THEN {c} WHEN a >= 254.5 / 255 THEN 255 - {c} ELSE {c} + (((255 - 2 * {c}) * CAST(floor(a * 256 + 0.5) AS INT) + 128) >> 8) END AS INT) AS {c}" for c in "rgb")
register("opacity_curve", _opacity, f"WITH {SQL_PIXELS}, {_curve_sql()} SELECT frame, x, y, {_MIX} FROM px JOIN alpha USING (frame)")
register("filter_range", lambda s, d: _PX(s, d).select("frame", "x", "y", *(F.when(F.col("frame").between(100, 199), 255 - F.col(c)).otherwise(F.col(c)).alias(c) for c in "rgb")), f"WITH {SQL_PIXELS} SELECT frame, x, y, {', '.join(f'CASE WHEN frame BETWEEN 100 AND 199 THEN 255 - {c} ELSE {c} END AS {c}' for c in 'rgb')} FROM px")


def _jobs(spark: SparkSession, sf_dir: str, turn: int) -> DataFrame:
    states = F.array(*map(F.lit, stats.JOB_PRIORITY))
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").where(F.col("o_orderkey") % 5 != turn)
    return o.select(F.col("o_orderkey").alias("job"), F.element_at(states, ((F.col("o_orderkey") * (turn + 3) + turn) % 8 + 1).cast("int")).alias("state"), ((F.col("o_orderkey") + turn) % 3).alias("revision"), (F.col("o_orderkey") % (turn + 2) == 0).alias("modified"))


_JOB = lambda t: f"(SELECT o_orderkey AS job, ['waiting', 'in_progress', 'completed', 'postponed', 'aborted', 'error', 'aborting', 'starting'][(o_orderkey * {t + 3} + {t}) % 8 + 1] AS state, (o_orderkey + {t}) % 3 AS revision, o_orderkey % {t + 2} = 0 AS modified FROM orders WHERE o_orderkey % 5 <> {t})"
_PRI = "list_position(['starting', 'aborting', 'aborted', 'error', 'waiting', 'postponed', 'completed', 'in_progress'], {}.state)"
register(
    "job_merge",
    lambda s, d: stats.merge_jobs(_jobs(s, d, 1), _jobs(s, d, 2)),
    f"WITH j AS (SELECT m, t, CASE WHEN m.job IS NULL THEN true WHEN t.job IS NULL THEN false WHEN m.revision <> t.revision THEN t.revision > m.revision WHEN m.modified <> t.modified THEN t.modified ELSE {_PRI.format('m')} <= {_PRI.format('t')} END AS theirs FROM {_JOB(1)} m FULL JOIN {_JOB(2)} t ON m.job = t.job) SELECT {', '.join(f'CASE WHEN theirs THEN t.{c} ELSE m.{c} END AS {c}' for c in ('job', 'state', 'revision', 'modified'))} FROM j",
)
register("job_transform", lambda s, d: stats.transform_jobs(_jobs(s, d, 1), "error", "waiting"), f"SELECT job, CASE WHEN state = 'error' THEN 'waiting' ELSE state END AS state, revision, modified FROM {_JOB(1)}")
