"""Queries of audio filters and capture corrections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.catalog import register
from framelake.operators import audio
from framelake.plans.timeline import EditList
from framelake.sources.tables import SQL_PACKETS, SQL_SAMPLES, packets, samples
from framelake.streaming import capture
from framelake.suites import twins


def _expr(name: str, make, sql: str) -> None:
    """A filter without memory; make(l, r): its output columns by name. Columns exist only once a session does."""
    register(name, lambda s, d: samples(s, d).select("pos", *(c.cast("int").alias(n) for n, c in make(F.col("l"), F.col("r")).items())), f"WITH {SQL_SAMPLES} SELECT pos, {sql} FROM smp")


CLIP = lambda v: f"CAST(greatest(-32768, least(32767, {v})) AS INT)"
_expr("a_16_to_8", lambda l, r: {"l": audio.to_8(l), "r": audio.to_8(r)}, "(l + 32768) >> 8 AS l, (r + 32768) >> 8 AS r")
_expr("a_8_to_16", lambda l, r: {"l": audio.to_16(audio.to_8(l)), "r": audio.to_16(audio.to_8(r))}, "(((l + 32768) >> 8) - 128) * 256 AS l, (((r + 32768) >> 8) - 128) * 256 AS r")
_expr("a_mono_16", lambda l, r: {"v": audio.mono_16(l, r)}, "CAST(floor((l + r) / 2) AS INT) AS v")
_expr("a_mono_8", lambda l, r: {"v": audio.mono_8(audio.to_8(l), audio.to_8(r))}, "(((l + 32768) >> 8) + ((r + 32768) >> 8)) // 2 AS v")
_expr("a_mono_16_to_8", lambda l, r: {"v": audio.mono_16_to_8(l, r)}, "CAST(floor((l + r + 65536) / 512) AS INT) AS v")
_expr("a_float_round_trip", lambda l, r: {"l": audio.float_to_16(l / 32768.0), "r": audio.float_to_16(r / 32768.0)}, "l, r")
_expr("a_gain", lambda l, r: {"l": audio.gain(l, 1.7), "r": audio.gain(r, 1.7)}, f"{CLIP('(l * 435 + 128) >> 8')} AS l, {CLIP('(r * 435 + 128) >> 8')} AS r")
_expr("a_amplify_16", lambda l, r: {"l": audio.amplify_16(l, 0.6), "r": audio.amplify_16(r, 2.5)}, f"{CLIP('(l * 154 + 128) >> 8')} AS l, {CLIP('(r * 640 + 128) >> 8')} AS r")
_expr("a_amplify_8", lambda l, r: {"l": audio.amplify_8(audio.to_8(l), 1.5)}, "CAST(greatest(0, least(255, (((l + 32768) >> 8) * 384 + 32896 - 49152) >> 8)) AS INT) AS l")
_expr("a_butterfly", lambda l, r: dict(zip("lr", audio.butterfly(l, r), strict=True)), "(l + r) >> 1 AS l, (l - r) >> 1 AS r")
_expr("a_mu_law", lambda l, r: {"v": audio.decode_x_law(audio.to_8(l), "mu")}, "CASE WHEN (xor((l + 32768) >> 8, 255) & 128) > 0 THEN -1 ELSE 1 END * ((((xor((l + 32768) >> 8, 255) & 15) * 8 + 132) << ((xor((l + 32768) >> 8, 255) >> 4) & 7)) - 132) AS v")
_expr("a_a_law", lambda l, r: {"v": audio.decode_x_law(audio.to_8(l), "a")}, "CASE WHEN (xor((l + 32768) >> 8, 85) & 128) > 0 THEN 1 ELSE -1 END * CASE (xor((l + 32768) >> 8, 85) >> 4) & 7 WHEN 0 THEN (xor((l + 32768) >> 8, 85) & 15) * 16 + 8 ELSE ((xor((l + 32768) >> 8, 85) & 15) * 16 + 264) << greatest(0, ((xor((l + 32768) >> 8, 85) >> 4) & 7) - 1) END AS v")


def _delayed(s: SparkSession, d: str) -> DataFrame:
    return samples(s, d).withColumn("pos", F.col("pos") + 500)


register("a_mix", lambda s, d: audio.mix(samples(s, d), _delayed(s, d)), f"WITH {SQL_SAMPLES} SELECT pos, {', '.join(f'{CLIP(f'coalesce(a.{c}, 0) + coalesce(b.{c}, 0)')} AS {c}' for c in 'lr')} FROM smp a FULL JOIN (SELECT pos + 500 AS pos, l, r FROM smp) b USING (pos)")
register("a_split_merge", lambda s, d: audio.stereo_merge(*reversed(audio.stereo_split(samples(s, d)))), f"WITH {SQL_SAMPLES} SELECT pos, r AS l, l AS r FROM smp")
register("a_center_mix", lambda s, d: audio.center_mix(samples(s, d), audio.stereo_split(_delayed(s, d))[0]), f"WITH {SQL_SAMPLES} SELECT a.pos, {CLIP('a.l + b.l')} AS l, {CLIP('a.r + b.l')} AS r FROM smp a JOIN smp b ON a.pos = b.pos + 500")


def _graph(s: SparkSession, d: str) -> DataFrame:
    g = audio.AudioGraph()
    source = g.add("input", lambda: samples(s, d))
    split = g.add("stereo split", audio.stereo_split)
    louder = g.add("gain", lambda m: m.select("pos", audio.gain(F.col("v"), 2.0).alias("v")))
    merge = g.add("stereo merge", audio.stereo_merge)
    g.connect(source, 0, split, 0)
    g.connect(split, 0, louder, 0)
    g.connect(louder, 0, merge, 0)
    g.connect(split, 1, merge, 1)
    return g.run()[merge][0]


register("a_graph", _graph, f"WITH {SQL_SAMPLES} SELECT pos, {CLIP('2 * l')} AS l, r FROM smp")
_TAPS = audio.fir_taps(4000, 44_100, 8, False)
_AT = lambda c, taps: " + ".join(f"({int(t)}) * coalesce({'lead' if i > 8 else 'lag'}({c}, {abs(i - 8)}) OVER w, 0)" for i, t in enumerate(taps))
_FIR = lambda taps: f"WITH {SQL_SAMPLES} SELECT pos, {', '.join(f'{CLIP(f'({_AT(c, taps)} + 8192) >> 14')} AS {c}' for c in 'lr')} FROM smp WINDOW w AS (ORDER BY pos)"
register("a_low_pass", lambda s, d: audio.low_pass(samples(s, d), 4000, half=8, block=1000), _FIR(_TAPS))
register("a_high_pass", lambda s, d: audio.high_pass(samples(s, d), 4000, half=8, block=1000), _FIR(audio.fir_taps(4000, 44_100, 8, True)))
register(
    "a_chorus",
    lambda s, d: audio.chorus(samples(s, d), block=2000),
    f"""WITH {SQL_SAMPLES}, t AS (SELECT pos, list(l) OVER all_ AS ll, list(r) OVER all_ AS rr, l, r,
  CAST(trunc(1102 * 256 + 44 * 256 * sin(((pos * {int(2**32 * 0.3 / 44_100)}) % 4294967296) * (pi() / 2147483648))) AS BIGINT) AS dl,
  CAST(trunc(1102 * 256 + 44 * 256 * sin(((pos * {int(2**32 * 0.3 / 44_100)} + 1073741824) % 4294967296) * (pi() / 2147483648))) AS BIGINT) AS dr FROM smp WINDOW all_ AS (ORDER BY pos ROWS BETWEEN 1200 PRECEDING AND CURRENT ROW)),
u AS (SELECT pos, l, r, dl & 255 AS fl, dr & 255 AS fr, coalesce(ll[len(ll) - (dl >> 8)], 0) * CASE WHEN len(ll) - (dl >> 8) >= 1 THEN 1 ELSE 0 END AS l1, coalesce(ll[len(ll) - (dl >> 8) + 1], 0) * CASE WHEN len(ll) - (dl >> 8) + 1 >= 1 THEN 1 ELSE 0 END AS l2,
  coalesce(rr[len(rr) - (dr >> 8)], 0) * CASE WHEN len(rr) - (dr >> 8) >= 1 THEN 1 ELSE 0 END AS r1, coalesce(rr[len(rr) - (dr >> 8) + 1], 0) * CASE WHEN len(rr) - (dr >> 8) + 1 >= 1 THEN 1 ELSE 0 END AS r2 FROM t)
SELECT pos, {', '.join(CLIP(f'{c} + (({c}1 + ((({c}2 - {c}1) * f{c} + 128) >> 8)) >> 1)') + f' AS {c}' for c in 'lr')} FROM u""",
)
register("a_resample", lambda s, d: audio.resample(samples(s, d), 1.5, block=3000), twins.resampled("1.5"))
register("a_stretch", lambda s, d: audio.resample(samples(s, d), 0.8), twins.resampled("0.8"))
register("a_resample_identity", lambda s, d: audio.resample(samples(s, d), 1.0, block=3000), f"WITH {SQL_SAMPLES} SELECT * FROM smp")
register("a_center_cut", lambda s, d: audio.center_cut(samples(s, d), block=4096), None)
register("a_time_stretch", lambda s, d: audio.time_stretch(samples(s, d), 1.25), None)
register("a_pitch_shift", lambda s, d: audio.pitch_shift(samples(s, d), 1.2), None)
_EDITS = EditList([(100, 10), (20, 5, True), (300, 7), (100, 3)])
register(
    "a_subset",
    lambda s, d: audio.subset(samples(s, d), s.createDataFrame([(0, *r) for r in _EDITS.rows()], "stream int, ord int, start long, len long, masked boolean, source int"), 16.5),
    f"WITH {SQL_SAMPLES}, v(ord, start, len, masked) AS (VALUES (0, 100, 10, false), (1, 20, 5, true), (2, 300, 7, false), (3, 100, 3, false)), p AS (SELECT *, sum(len) OVER (ORDER BY ord) - len AS d FROM v), e AS (SELECT CAST(floor(start * 16.5 + 0.5) AS BIGINT) AS s0, CAST(floor(d * 16.5 + 0.5) AS BIGINT) AS o0, CAST(floor((d + len) * 16.5 + 0.5) AS BIGINT) AS o1, masked FROM p) SELECT pos - s0 + o0 AS pos, CASE WHEN masked THEN 0 ELSE l END AS l, CASE WHEN masked THEN 0 ELSE r END AS r FROM smp JOIN e ON pos >= s0 AND pos < s0 + o1 - o0",
)


def _captured(s: SparkSession, d: str) -> DataFrame:
    p = packets(s, d)
    return p.select(F.col("user_id").alias("stream"), "seq", ((F.col("ts_us") - F.min("ts_us").over(capture.Window.partitionBy("user_id"))) % 4_294_967_296).alias("ts_us"))


register(
    "cap_repair_timestamps",
    lambda s, d: capture.repair_timestamps(_captured(s, d)),
    f"WITH {SQL_PACKETS}, c AS (SELECT user_id AS stream, seq, (ts_us - min(ts_us) OVER (PARTITION BY user_id)) % 4294967296 AS ts_us FROM pkt), l AS (SELECT *, lag(ts_us) OVER (PARTITION BY stream ORDER BY seq) AS last FROM c), j AS (SELECT *, CASE WHEN ts_us < last AND ts_us < 10000000 AND last >= 2138000000 AND abs(ts_us + CASE WHEN last >= 4285000000 THEN 4294967296 ELSE 2147483648 END - last) <= 5000000 THEN CASE WHEN last >= 4285000000 THEN 4294967296 ELSE 2147483648 END ELSE 0 END AS jump FROM l) SELECT stream, seq, CAST(ts_us + sum(jump) OVER (PARTITION BY stream ORDER BY seq) AS BIGINT) AS ts_us FROM j",
)
#: One frame in 10 s of clock: about the events' rate, so that all three actions occur.
register(
    "cap_resync",
    lambda s, d: capture.resync(_captured(s, d), 0.001, 10),
    f"""WITH RECURSIVE {SQL_PACKETS}, c AS (SELECT user_id AS stream, seq, (ts_us - min(ts_us) OVER (PARTITION BY user_id)) % 4294967296 AS ts_us, row_number() OVER (PARTITION BY user_id ORDER BY seq) AS k FROM pkt),
walk(stream, k, seq, ts_us, action, inserted, written) AS (
  SELECT stream, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST('' AS VARCHAR), CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM c WHERE k = 1
  UNION ALL SELECT stream, k, seq, ts_us, CASE WHEN e < -0.75 THEN 'drop' WHEN x > 0 THEN 'insert' ELSE 'keep' END, x, w + CASE WHEN e < -0.75 THEN 0 ELSE 1 + x END
  FROM (SELECT c.*, walk.written AS w, c.ts_us * 0.001::DOUBLE / 1000000 - walk.written AS e,
      CASE WHEN c.ts_us * 0.001::DOUBLE / 1000000 - walk.written > 0.75 AND walk.written > 0 THEN least(CAST(floor(c.ts_us * 0.001::DOUBLE / 1000000 - walk.written + 0.5) AS BIGINT), 10) ELSE 0 END AS x
    FROM walk JOIN c ON c.stream = walk.stream AND c.k = walk.k + 1))
SELECT stream, seq, ts_us, action, CAST(inserted AS INT) AS inserted, written FROM walk WHERE k > 0""",
)
register("cap_control", lambda s, d: capture.control(packets(s, d).select(F.col("user_id").alias("stream"), "seq", ((F.col("bytes") % 200 - 100) / 10.0).alias("error"))).withColumn("correction", F.round("correction", 9)), twins.controlled())
register(
    "cap_summaries",
    lambda s, d: capture.summaries(s.read.parquet(f"{d}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("kind"), F.floor(F.col("value") * 10).alias("bytes"))).select(F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("hour"), "kind", "n", "bytes"),
    "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS hour, event_type AS kind, count(*) AS n, CAST(sum(CAST(floor(value * 10) AS BIGINT)) AS BIGINT) AS bytes FROM events GROUP BY 1, 2",
)
