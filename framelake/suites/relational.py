"""Queries of sorts, limits, ranks, sets of rows, semi and anti joins, and windows of event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.catalog import register
from framelake.operators import audio, stats
from framelake.sources.tables import SQL_CHUNKS, SQL_PACKETS, SQL_SAMPLES, chunks, packets, samples
from framelake.streaming import capture


def _largest(s: SparkSession, d: str) -> DataFrame:
    return stats.top_of(chunks(s, d).select("kind", "chunk", "size"), ["kind"], [F.desc("size"), F.col("chunk")], 5)


register("rel_top_k", _largest, f"WITH {SQL_CHUNKS}, r AS (SELECT kind, chunk, size, CAST(row_number() OVER (PARTITION BY kind ORDER BY size DESC, chunk) AS INT) AS rank FROM chk) SELECT * FROM r WHERE rank <= 5")
register("rel_page", lambda s, d: stats.page_of(chunks(s, d).select("chunk", "size"), [F.desc("size"), F.col("chunk")], 40, 25), f"WITH {SQL_CHUNKS} SELECT chunk, size FROM chk ORDER BY size DESC, chunk LIMIT 25 OFFSET 40")
register(
    "rel_ranks",
    lambda s, d: stats.ranked(chunks(s, d).select("kind", "size").distinct().withColumn("tens", F.floor(F.col("size") / 10)), ["kind"], [F.col("tens"), F.col("size")]).select("kind", "size", "row_number", "rank", "dense_rank", "tile"),
    f"WITH {SQL_CHUNKS}, t AS (SELECT DISTINCT kind, size FROM chk) SELECT kind, size, CAST(row_number() OVER w AS INT) AS row_number, CAST(rank() OVER w AS INT) AS rank, CAST(dense_rank() OVER w AS INT) AS dense_rank, CAST(ntile(4) OVER w AS INT) AS tile FROM t WINDOW w AS (PARTITION BY kind ORDER BY size // 10, size)",
)
register(
    "rel_ties",
    lambda s, d: stats.ranked(chunks(s, d).select("kind", (F.col("size") % 20).alias("size")).groupBy("kind", "size").agg(F.count(F.lit(1)).alias("n")), ["kind"], [F.col("n")]).select("kind", "size", "rank", "dense_rank"),
    f"WITH {SQL_CHUNKS}, t AS (SELECT kind, size % 20 AS size, count(*) AS n FROM chk GROUP BY 1, 2) SELECT kind, size, CAST(rank() OVER w AS INT) AS rank, CAST(dense_rank() OVER w AS INT) AS dense_rank FROM t WINDOW w AS (PARTITION BY kind ORDER BY n)",
)


def _frames_shown(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Customers' frames as two edits of one table show them."""
    o = s.read.parquet(f"{d}/orders.parquet").select(F.col("o_custkey").alias("stream"), (F.col("o_orderkey") % 100).alias("frame"), "o_orderkey")
    return o.where("o_orderkey % 3 <> 0").select("stream", "frame"), o.where("o_orderkey % 2 = 0").select("stream", "frame")


_TWO = "WITH o AS (SELECT o_custkey AS stream, o_orderkey % 100 AS frame, o_orderkey FROM orders), a AS (SELECT stream, frame FROM o WHERE o_orderkey % 3 <> 0), b AS (SELECT stream, frame FROM o WHERE o_orderkey % 2 = 0)"


def _pair(join):
    return lambda s, d: join(*_frames_shown(s, d))


register("rel_except", _pair(lambda a, b: a.subtract(b)), f"{_TWO} SELECT * FROM a EXCEPT SELECT * FROM b")
register("rel_except_all", _pair(lambda a, b: a.exceptAll(b)), f"{_TWO} SELECT * FROM a EXCEPT ALL SELECT * FROM b")
register("rel_intersect", _pair(lambda a, b: a.intersect(b)), f"{_TWO} SELECT * FROM a INTERSECT SELECT * FROM b")
register("rel_union", _pair(lambda a, b: a.union(b).distinct()), f"{_TWO} SELECT * FROM a UNION SELECT * FROM b")
register("rel_semi_join", _pair(lambda a, b: a.join(b, ["stream", "frame"], "left_semi")), f"{_TWO} SELECT * FROM a SEMI JOIN b USING (stream, frame)")
register("rel_anti_join", _pair(lambda a, b: a.join(b, ["stream", "frame"], "left_anti")), f"{_TWO} SELECT * FROM a ANTI JOIN b USING (stream, frame)")
register(
    "rel_grouping_sets",
    lambda s, d: chunks(s, d).rollup("kind", "is_key").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"), F.grouping_id().cast("int").alias("level")),
    f"WITH {SQL_CHUNKS} SELECT kind, is_key, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes, CAST(grouping(kind, is_key) AS INT) AS level FROM chk GROUP BY ROLLUP (kind, is_key)",
)


def _events(s: SparkSession, d: str) -> DataFrame:
    e = s.read.parquet(f"{d}/events.parquet")
    return e.select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("kind"), F.floor(F.col("value") * 10).alias("bytes"))


def _stamp(c: str):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


register(
    "cap_sliding",
    lambda s, d: capture.summaries(_events(s, d), width="1 hour", slide="20 minutes").select(_stamp("window.start").alias("start"), "kind", "n", "bytes"),
    "WITH e AS (SELECT unnest(range(0, 3)) AS k, ts, event_type AS kind, CAST(floor(value * 10) AS BIGINT) AS bytes FROM events) SELECT strftime(to_timestamp((epoch_us(ts) // 1200000000 - k) * 1200), '%Y-%m-%d %H:%M:%S') AS start, kind, count(*) AS n, CAST(sum(bytes) AS BIGINT) AS bytes FROM e GROUP BY 1, 2",
)
register(
    "cap_sessions",
    lambda s, d: capture.summaries(_events(s, d), gap="10 minutes").select(_stamp("window.start").alias("start"), _stamp("window.end").alias("end"), "kind", "n", "bytes"),
    """WITH e AS (SELECT ts, event_type AS kind, CAST(floor(value * 10) AS BIGINT) AS bytes, lag(ts) OVER (PARTITION BY event_type ORDER BY ts) AS last FROM events),
f AS (SELECT *, sum(CASE WHEN last IS NULL OR ts >= last + INTERVAL 10 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY kind ORDER BY ts, last ROWS UNBOUNDED PRECEDING) AS session FROM e)
SELECT strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, strftime(max(ts) + INTERVAL 10 MINUTE, '%Y-%m-%d %H:%M:%S') AS end, kind, count(*) AS n, CAST(sum(bytes) AS BIGINT) AS bytes FROM f GROUP BY kind, session""",
)
register("a_limit", lambda s, d: audio.limit(samples(s, d), 4_000), f"WITH {SQL_SAMPLES} SELECT * FROM smp WHERE pos < 4000")
register("a_new_rate", lambda s, d: audio.new_rate(samples(s, d), 44_100, 48_000), f"WITH {SQL_SAMPLES} SELECT pos, pos / 44100.0::DOUBLE AS before, pos / 48000.0::DOUBLE AS seconds, l, r FROM smp")
register(
    "agg_distinct",
    lambda s, d: packets(s, d).groupBy((F.col("user_id") % 10).alias("shelf")).agg(F.countDistinct("user_id").alias("users"), F.count(F.lit(1)).alias("n"), F.max("bytes").alias("most")),
    f"WITH {SQL_PACKETS} SELECT user_id % 10 AS shelf, count(DISTINCT user_id) AS users, count(*) AS n, max(bytes) AS most FROM pkt GROUP BY 1",
)
