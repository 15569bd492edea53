"""Media relations derived from stored tables: frames, pixels, audio samples, capture packets.

A frame is one row with its planes as arrays, so that whatever looks at
neighbours within a frame needs no shuffle; pixels are its explosion.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

W = H = 8


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(frame, shot, r, g, b): an 8x8 frame per vector, planes as int arrays in row order."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    v = F.transform("embedding", lambda x: F.floor((x.cast("double") + 1) * 127.5).cast("int"))
    return e.select(F.col("vec_id").alias("frame"), F.col("label").alias("shot"), v.alias("r")).select(
        "frame", "shot", "r", F.transform("r", lambda x: x * 3 % 256).alias("g"), F.transform("r", lambda x: x * 7 % 256).alias("b")
    )


def pixels(frames_df: DataFrame, width: int = W) -> DataFrame:
    """(frame, x, y, r, g, b): a row per pixel of frames with planes as arrays."""
    zipped = frames_df.select("frame", F.posexplode(F.arrays_zip("r", "g", "b")).alias("i", "p"))
    return zipped.select("frame", (F.col("i") % width).alias("x"), F.floor(F.col("i") / width).cast("int").alias("y"), "p.r", "p.g", "p.b")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pos, l, r): 16-bit stereo samples from the event stream."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    left = (F.floor(F.col("value") * 100).cast("long") % 65536 - 32768).cast("int")
    return e.select(F.col("event_id").alias("pos"), left.alias("l"), (F.col("user_id") * 37 % 65536 - 32768).cast("int").alias("r"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chunk, size, is_key, kind): a container's chunk index."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(F.col("event_id").alias("chunk"), F.floor(F.col("value") * 10).cast("int").alias("size"), (F.col("event_type") == "signup").alias("is_key"), F.col("event_type").alias("kind"))


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, user_id, ts_us, clock_us, bytes): captured packets with their time stamps and the capture clock."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    # Without a zone on both sides, so that the session's doesn't matter.
    us = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))")
    return e.select(F.col("event_id").alias("seq"), "user_id", us.alias("ts_us"), (us + F.col("user_id") % 97).alias("clock_us"), F.floor(F.col("value") * 10).cast("int").alias("bytes"))


#: The same relations in the oracle's SQL.
SQL_PIXELS = """
px AS (
  SELECT frame, shot, CAST(i % 8 AS INT) AS x, CAST(i // 8 AS INT) AS y, v AS r, v * 3 % 256 AS g, v * 7 % 256 AS b FROM (
    SELECT vec_id AS frame, label AS shot, generate_subscripts(embedding, 1) - 1 AS i,
      CAST(floor((CAST(unnest(embedding) AS DOUBLE) + 1) * 127.5) AS INT) AS v FROM embeddings)
)"""
SQL_SAMPLES = """
smp AS (
  SELECT event_id AS pos, CAST(CAST(floor(value * 100) AS BIGINT) % 65536 - 32768 AS INT) AS l, CAST(user_id * 37 % 65536 - 32768 AS INT) AS r FROM events
)"""
SQL_CHUNKS = """
chk AS (
  SELECT event_id AS chunk, CAST(floor(value * 10) AS INT) AS size, event_type = 'signup' AS is_key, event_type AS kind FROM events
)"""
SQL_PACKETS = """
pkt AS (
  SELECT event_id AS seq, user_id, epoch_us(ts) AS ts_us, epoch_us(ts) + user_id % 97 AS clock_us, CAST(floor(value * 10) AS INT) AS bytes FROM events
)"""
