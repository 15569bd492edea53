"""Aggregates and sample windows over frames, samples, chunks and packets.

Running windows over a whole stream are computed in blocks of positions: sums
within a block, plus one row per block of what comes before it, so that a stream
of any length is shared by many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def histogram(pixels: DataFrame, channel: Column, by: tuple[str, ...] = ("frame",), shift: int = 0) -> DataFrame:
    return pixels.groupBy(*by, F.shiftright(channel, shift).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def channel_cube(pixels: DataFrame, shift: int = 6) -> DataFrame:
    """Counts of all combinations of channel bins, with subtotals; -1 stands for all values of a channel."""
    bins = pixels.select(*(F.shiftright(F.col(c), shift).alias(c) for c in "rgb"))
    return bins.cube("r", "g", "b").agg(F.count(F.lit(1)).alias("n")).select(*(F.coalesce(c, F.lit(-1)).alias(c) for c in "rgb"), "n")


def tile_means(pixels: DataFrame, tile: int = 8) -> DataFrame:
    """(frame, tx, ty, r, g, b): means of tiles of 8 x 8, rounded."""
    half, bits = tile * tile // 2, (tile * tile).bit_length() - 1
    grouped = pixels.groupBy("frame", F.floor(F.col("x") / tile).alias("tx"), F.floor(F.col("y") / tile).alias("ty"))
    return grouped.agg(*(F.shiftright(F.sum(c) + half, bits).alias(c) for c in "rgb"))


def scene_changes(tiles: DataFrame, cut: int, fade: float, block: int = 512) -> DataFrame:
    """(frame, metric, is_cut, is_fade, fade_starts) against the frame before.

    metric sums the tiles' weighted channel differences; a fade is a frame whose
    luma hardly varies, and starts where the frame before is none. Each tile is a stream of its own, so its lag needs no more
    than its own frames; block only bounds the final pass over frames.
    """
    before = Window.partitionBy("tx", "ty", F.floor(F.col("frame") / block)).orderBy("frame")
    # The last frame of each block is repeated at the head of the next.
    edge = tiles.where((F.col("frame") + 1) % block == 0).withColumn("frame_", F.col("frame") + 1)
    joined = tiles.alias("t").join(edge.select("tx", "ty", F.col("frame_").alias("frame"), *(F.col(c).alias(f"{c}_e") for c in "rgb")), ["tx", "ty", "frame"], "left")
    lagged = joined.select("frame", "tx", "ty", *"rgb", *(F.coalesce(F.lag(c).over(before), F.col(f"{c}_e")).alias(f"{c}_p") for c in "rgb"))
    change = F.shiftright(54 * F.abs(F.col("r") - F.col("r_p")) + 183 * F.abs(F.col("g") - F.col("g_p")) + 19 * F.abs(F.col("b") - F.col("b_p")), 8)
    luma = F.shiftright(54 * F.col("r") + 183 * F.col("g") + 19 * F.col("b") + 128, 8)
    per_frame = lagged.groupBy("frame").agg(F.coalesce(F.sum(change), F.lit(0)).alias("metric"), F.count(F.lit(1)).alias("n"), F.sum(luma).alias("s"), F.sum(luma * luma).alias("q"))
    marked = per_frame.select("frame", "metric", (F.col("metric") > cut).alias("is_cut"), (F.sqrt((F.col("n") * F.col("q") - F.col("s") * F.col("s")).cast("double")) < fade).alias("is_fade"))
    last = marked.select((F.col("frame") + 1).alias("frame"), F.col("is_fade").alias("faded"))
    return marked.join(last, "frame", "left").select("frame", "metric", "is_cut", "is_fade", (F.col("is_fade") & ~F.coalesce("faded", F.lit(False))).alias("fade_starts"))


def regression(points: DataFrame, x: str, y: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Slope and intercept of all samples, null under four."""
    n = F.count(F.lit(1))
    grouped = points.groupBy(*by) if by else points
    return grouped.agg(n.alias("n"), F.when(n >= 4, F.regr_slope(y, x)).alias("slope"), F.when(n >= 4, F.regr_intercept(y, x)).alias("intercept"))


def windowed_regression(points: DataFrame, x: str, y: str, order: str, size: int, by: tuple[str, ...]) -> DataFrame:
    """Slope over the last `size` samples of each stream, null until there are as many."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(1 - size, 0)
    return points.withColumn("slope", F.when(F.count(F.lit(1)).over(w) >= size, F.regr_slope(y, x).over(w)))


def moving_average(points: DataFrame, value: str, order: str, size: int, by: tuple[str, ...]) -> DataFrame:
    """Mean of the last `size` samples of each stream; before there are as many the first value stands in for the rest."""
    w = Window.partitionBy(*by).orderBy(order)
    last = w.rowsBetween(1 - size, 0)
    first = F.first(value).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return points.withColumn("average", (F.sum(value).over(last) + (size - F.count(F.lit(1)).over(last)) * first) / size)


def peaks(samples: DataFrame, block: int = 100) -> DataFrame:
    """(block, left, right): largest magnitudes of each block of samples."""
    return samples.groupBy(F.floor(F.col("pos") / block).alias("block")).agg(F.max(F.abs("l")).alias("left"), F.max(F.abs("r")).alias("right"))


def running_offsets(chunks: DataFrame, sample_size: int, block: int = 4096) -> DataFrame:
    """(chunk, size, samples, byte0, sample0): where each chunk starts in bytes and samples."""
    rows = chunks.select("chunk", "size", F.ceil(F.col("size") / sample_size).cast("long").alias("samples"), F.floor(F.col("chunk") / block).alias("block_"))
    within = Window.partitionBy("block_").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("block_").agg(F.sum("size").alias("b_"), F.sum("samples").alias("s_"))
    before = Window.orderBy("block_").rowsBetween(Window.unboundedPreceding, -1)  # one row per block of chunks
    starts = sums.select("block_", F.coalesce(F.sum("b_").over(before), F.lit(0)).alias("b_"), F.coalesce(F.sum("s_").over(before), F.lit(0)).alias("s_"))
    zero = F.lit(0)
    return rows.withColumn("byte0", F.coalesce(F.sum("size").over(within), zero)).withColumn("sample0", F.coalesce(F.sum("samples").over(within), zero)).join(starts, "block_").select("chunk", "size", "samples", (F.col("byte0") + F.col("b_")).alias("byte0"), (F.col("sample0") + F.col("s_")).alias("sample0"))


def bit_rates(chunks: DataFrame) -> DataFrame:
    """Mean, deviation and largest distance from the mean of chunk sizes, per kind."""
    mean = chunks.groupBy("kind").agg(F.avg("size").alias("mean"), F.stddev_pop("size").alias("deviation"), F.min("size").alias("lo"), F.max("size").alias("hi"))
    return mean.select("kind", "mean", "deviation", F.greatest(F.col("hi") - F.col("mean"), F.col("mean") - F.col("lo")).alias("most"))


def stream_totals(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("kind").agg(F.count(F.lit(1)).alias("chunks"), F.sum("size").alias("bytes"), F.min("size").alias("least"), F.max("size").alias("most"), F.sum(F.col("is_key").cast("int")).alias("keys"))


def symbolic_frame(prefetched: DataFrame) -> DataFrame:
    """(frame, symbolic): the rounded mean of the source frames each output frame looks at."""
    n = F.count(F.lit(1))
    return prefetched.groupBy("frame").agg(F.floor((F.sum("src") + F.shiftright(n, 1)) / n).alias("symbolic"))


def first_of_run(frame_map: DataFrame, order: str, value: str, block: int = 4096) -> DataFrame:
    """With unique_frame: the first row of the run of equal values that a row is in, runs being contiguous in order.

    Runs are followed within blocks; one row per block carries the run that is open at its start.
    """
    rows = frame_map.withColumn("block_", F.floor(F.col(order) / block))
    w = Window.partitionBy("block_").orderBy(order)
    begins = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)) & (F.row_number().over(w) > 1), None).otherwise(F.col(order))
    local = rows.withColumn("begin_", begins).withColumn("begin_", F.last("begin_", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    ends = local.groupBy("block_").agg(F.max_by(value, order).alias("last_value"), F.max("begin_").alias("last_begin"), F.min_by(value, order).alias("head"), F.min(order).alias("head_at"))
    across = Window.orderBy("block_")
    open_ = ends.withColumn("joined", F.lag("last_value").over(across).eqNullSafe(F.col("head")) & F.lag("block_").over(across).isNotNull())
    # A run that spans whole blocks begins where the first of them that isn't joined throughout says.
    carried = F.when(~F.col("joined") | (F.col("last_begin") != F.col("head_at")), F.col("last_begin"))
    open_ = open_.withColumn("carry", F.last(carried, ignorenulls=True).over(across.rowsBetween(Window.unboundedPreceding, -1)))
    out = local.join(open_.select("block_", "joined", "carry", "head_at"), "block_")
    return out.withColumn("unique_frame", F.when(F.col("joined") & (F.col("begin_") == F.col("head_at")), F.col("carry")).otherwise(F.col("begin_"))).drop("block_", "begin_", "joined", "carry", "head_at")


def nearest_points(curve: DataFrame, places: DataFrame, block: int = 4096) -> DataFrame:
    """(frame, x): the curve's point nearest to each frame, null without points. Ties go to the smaller x.

    Points and frames are walked together in blocks; the points before and after
    a block come through one row per block.
    """
    points = curve.select(F.col("x").cast("double").alias("at"), F.col("x").alias("x"), F.lit(None).cast("long").alias("frame"))
    rows = places.select(F.col("frame").cast("double").alias("at"), F.lit(None).cast("double").alias("x"), F.col("frame").cast("long").alias("frame")).unionByName(points)
    rows = rows.withColumn("block_", F.floor(F.col("at") / block))
    w = Window.partitionBy("block_").orderBy("at")
    before = F.max("x").over(w.rangeBetween(Window.unboundedPreceding, 0))
    after = F.min("x").over(w.rangeBetween(0, Window.unboundedFollowing))
    edges = rows.groupBy("block_").agg(F.min("x").alias("lo_"), F.max("x").alias("hi_"))
    across = Window.orderBy("block_")  # one row per block
    edges = edges.select("block_", F.max("hi_").over(across.rowsBetween(Window.unboundedPreceding, -1)).alias("left_"), F.min("lo_").over(across.rowsBetween(1, Window.unboundedFollowing)).alias("right_"))
    found = rows.withColumn("b_", before).withColumn("a_", after).where("frame is not null").join(edges, "block_")
    left, right = F.coalesce("b_", "left_"), F.coalesce("a_", "right_")
    nearest = F.when(left.isNull() | (right - F.col("at") < F.col("at") - left), right).otherwise(left)
    return found.select("frame", nearest.alias("x"))


def top_of(rows: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group, with their rank; Spark cuts each task's rows to k before they are shuffled."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def page_of(rows: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """limit rows from offset on, in order."""
    return rows.orderBy(*order).offset(offset).limit(limit)


def ranked(rows: DataFrame, by: list[str], order: list[Column], tiles: int = 4) -> DataFrame:
    """With row_number, rank, dense_rank and ntile within each group."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.select("*", F.row_number().over(w).alias("row_number"), F.rank().over(w).alias("rank"), F.dense_rank().over(w).alias("dense_rank"), F.ntile(tiles).over(w).alias("tile"))


#: Job states by what wins a merge; fixed values.
JOB_PRIORITY = {"waiting": 4, "in_progress": 7, "completed": 6, "postponed": 5, "aborted": 2, "error": 3, "aborting": 1, "starting": 0}


def merge_jobs(mine: DataFrame, theirs: DataFrame) -> DataFrame:
    """Queues merged by job id: what is only in one stays; else the one alone modified, the later revision, or the stronger state wins; ties go to theirs."""
    rank = lambda s: F.element_at(F.create_map(*(F.lit(x) for kv in JOB_PRIORITY.items() for x in kv)), s)
    m, t = mine.alias("m"), theirs.alias("t")
    both = m.join(t, F.col("m.job") == F.col("t.job"), "full_outer")
    accept = (
        F.when(F.col("m.job").isNull(), True)
        .when(F.col("t.job").isNull(), False)
        .when(F.col("m.revision") != F.col("t.revision"), F.col("t.revision") > F.col("m.revision"))
        .when(F.col("m.modified") != F.col("t.modified"), F.col("t.modified"))
        .otherwise(rank(F.col("m.state")) <= rank(F.col("t.state")))
    )
    return both.withColumn("accept", accept).select(*(F.when(F.col("accept"), F.col(f"t.{c}")).otherwise(F.col(f"m.{c}")).alias(c) for c in ("job", "state", "revision", "modified")))


def transform_jobs(jobs: DataFrame, before: str, after: str) -> DataFrame:
    return jobs.withColumn("state", F.when(F.col("state") == before, after).otherwise(F.col("state")))
