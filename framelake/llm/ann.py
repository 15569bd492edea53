"""Approximate nearest neighbours on shifted space-filling curves.

Equal vectors are one node, with the k + 1 smallest of their ids; nodes become
ids again after scoring, so that copies take one place however many they are.
Each of several curves projects the nodes by its own random rotation to a few
coordinates, shifts these by random amounts and orders all nodes by Hilbert
key. Spark range-partitions the orders; runs of equal length become blocks. A
query takes the blocks within its window on every curve as candidates; each
block scores its queries, and keeps the best, and the lists of all blocks and
curves merge. A query's own node is always among them. Scores are sums in the
order of the components, so they are a function of the pair alone.

Inner products become angles by one more coordinate, sqrt(M^2 - |x|^2) with the
largest norm M, which is 0 for queries; for equal norms it vanishes. Vectors of
different lengths never meet: each length has curves of its own.

How far to look along the curves depends on the vectors, so it is measured: a
bounded sample of queries is compared with all nodes, and the window is the
distance, on the nearest curve, within which `target` of their true neighbours
lie. For vectors in clusters that is a number of rows that doesn't grow with the
table. Isotropic vectors in 64 dimensions have no near neighbours worth the name
(the twentieth of fifty thousand is at cosine 0.4); no order helps there, and the
measured window becomes a share of the table, in all more than a scan looks at.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framelake.llm.hilbert import hilbert_keys
from framelake.llm.workspace import partitions, settle

#: Coordinates and bits of each of a curve's keys.
COORDINATES, BITS = 6, 10
#: Rows of a block at most; a wider window takes more blocks.
BLOCK_ROWS = 4_096
LEAST_WINDOW = 256
#: Queries by which the window is measured.
SAMPLE = 256


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) of vectors that are not null or zero, without null or non-finite components; floats stay floats."""
    v = F.col(vector_col)
    if vectors.schema[vector_col].dataType != T.ArrayType(T.FloatType()) and vectors.schema[vector_col].dataType != T.ArrayType(T.FloatType(), False):
        v = v.cast("array<double>")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    fine = vectors.select(F.col(id_col).alias("id"), v.alias("v")).where("v is not null and id is not null")
    return fine.where(~F.exists("v", bad) & F.exists("v", lambda x: x != 0))


def _square(v: str) -> Column:
    """A vector's inner product with itself, in the order of its components."""
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))


@functools.lru_cache(64)
def _curves(dim: int, curves: int, seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The rotation and the shift of each curve."""
    rng = np.random.default_rng([seed, dim])
    turns = [np.linalg.qr(rng.normal(size=(dim + 1, dim + 1)))[0][:, : min(COORDINATES, dim + 1)] for _ in range(curves)]
    return [(t, rng.random(t.shape[1])) for t in turns]


def _by_length(batch: pa.RecordBatch):
    """The parts of a batch that have vectors of one length."""
    sizes = batch.column("v").value_lengths().to_numpy(zero_copy_only=False)
    for dim in np.unique(sizes):
        yield int(dim), batch if (sizes == dim).all() else batch.filter(pa.array(sizes == dim))


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of rows, summed component after component."""
    out = np.zeros(len(q))
    for j in range(q.shape[1]):
        out += q[:, j] * x[:, j]
    return out


def _best(q: np.ndarray, members: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, member, score) of each query's k largest products, larger first, ties to earlier members.

    A matrix product finds them with room for its rounding; the scores that count
    are those of `_products`.
    """
    s = np.einsum("ij,kj->ik", q, members, optimize=True)
    k = min(k, s.shape[1])
    slack = 1e-12 * q.shape[1] * np.sqrt((q * q).sum(axis=1)) * np.sqrt((members * members).sum(axis=1).max())
    edge = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k] - slack
    rows, at = np.nonzero(s >= edge[:, None])
    score = _products(q[rows], members[at])
    order = np.lexsort((at, -score, rows))
    rows, at, score = rows[order], at[order], score[order]
    first = np.searchsorted(rows, np.arange(len(q)))
    kept = np.arange(len(rows)) - first[rows] < k
    return rows[kept], at[kept], score[kept]


def nearest(
    vectors: DataFrame,
    is_query: Column,
    k: int = 20,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    curves: int = 12,
    target: float = 0.96,
    seed: int = 17,
) -> DataFrame:
    """(query_id, rank, id, score): the k candidates of largest inner product found for each row where is_query holds.

    Candidates are all rows but the query's own id. Ties go to the smaller id,
    among any number of equal vectors too.
    Vectors that are null or zero or have null or non-finite components take no
    part, nor do rows without id; vectors of another length than the query's are
    no candidates of it. Rows that repeat an id with the same vector count once;
    with several vectors, each is a candidate and the id gets its best score.
    Fewer than k candidates found are all returned; with fewer rows than the
    least window that is every row. Columns other than the id aren't carried. An
    empty table gives none. target is the share of true neighbours that the
    window is measured for.
    """
    spark = vectors.sparkSession
    usable = settle(_usable(vectors, id_col, vector_col).distinct(), "vectors")
    asked = vectors.where(is_query).select(F.col(id_col).alias("id")).distinct()
    # Node numbers follow the nodes' smallest ids, so that ties go to smaller numbers.
    copy = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    ids = usable.withColumn("copy", copy).where(F.col("copy") <= k + 1).groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    nodes = ids.orderBy(F.element_at("ids", 1), F.xxhash64("v")).withColumn("node", F.monotonically_increasing_id())
    nodes = settle(nodes.withColumn("norm2", _square("v")), "nodes")
    asking = settle(usable.join(asked, "id", "left_semi").join(nodes.select("v", "node"), "v").select("id", "node"), "asking")
    queries = nodes.join(asking.select("node").distinct(), "node", "left_semi")
    largest = nodes.groupBy(F.size("v").alias("dim")).agg(F.max("norm2").alias("largest"))
    # Of so many nodes of an answer, ids that have several vectors and the query's own leave k ids.
    keep = (k + 1) * (usable.groupBy("id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 1)

    def keyed(asks: bool):
        def run(batches):
            for batch in batches:
                for dim, b in _by_length(batch):
                    x, norm2, most = _matrix(b.column("v")), b.column("norm2").to_numpy(), b.column("largest").to_numpy()
                    if asks:
                        x, extra = x / np.sqrt(norm2)[:, None], np.zeros(len(x))
                    else:
                        x, extra = x / np.sqrt(most)[:, None], np.sqrt(np.maximum(0, 1 - norm2 / most))
                    x = np.column_stack((x, extra))
                    for c, (turn, shift) in enumerate(_curves(dim, curves, seed)):
                        unit = 1 / (1 + np.exp(-1.7 * np.sqrt(dim) * (x @ turn)))
                        points = ((unit + shift) / 2 * (1 << BITS)).astype(np.int64)
                        columns = [pa.array(np.full(len(x), dim, np.int32)), pa.array(np.full(len(x), c, np.int32)), pa.array(hilbert_keys(points, BITS).astype(np.int64)), b.column("node"), pa.array(np.full(len(x), asks))]
                        yield pa.RecordBatch.from_arrays(columns, names=["dim", "curve", "key", "node", "asks"])

        return run

    order_schema = "dim int, curve int, key long, node long, asks boolean"
    with_largest = lambda df: df.join(F.broadcast(largest), F.size("v") == F.col("dim")).select("v", "norm2", "largest", "node")
    order = with_largest(nodes).mapInArrow(keyed(False), order_schema).unionByName(with_largest(queries).mapInArrow(keyed(True), order_schema))

    def number(batches):
        at = 0
        for b in batches:
            place = np.arange(at, at + b.num_rows)
            at += b.num_rows
            yield b.append_column("place", pa.array(place))

    ranged = order.repartitionByRange(partitions(spark), "dim", "curve", "key", "node").withColumn("slice", F.spark_partition_id()).sortWithinPartitions("dim", "curve", "key", "node")
    placed = settle(ranged.mapInArrow(number, T.StructType([*ranged.schema, T.StructField("place", T.LongType())])), "curves")
    # Places run on from slice to slice: one row per slice, as many as there are shuffle partitions.
    sizes = placed.groupBy("slice").agg(F.count(F.lit(1)).alias("n_"))
    before = F.coalesce(F.sum("n_").over(Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = placed.join(F.broadcast(sizes.select("slice", before.alias("before"))), "slice").select("dim", "curve", "node", "asks", (F.col("before") + F.col("place")).alias("place"))
    window = max(LEAST_WINDOW, _measured(nodes, queries, placed, k, target))
    block = min(window, BLOCK_ROWS)
    reach = -(-window // block)
    blocks = placed.withColumn("block", F.floor(F.col("place") / block).cast("long"))
    wanted = F.explode(F.sequence(F.col("block") - reach, F.col("block") + reach))
    group = ["dim", "curve", "block"]
    roles = blocks.where("not asks").select(*group, "node", "asks").unionByName(blocks.where("asks").select("dim", "curve", wanted.alias("block"), "node", "asks"))

    def score(table: pa.Table) -> pa.Table:
        asks = table.column("asks").to_numpy()
        numbers, v = table.column("node").to_numpy(), _matrix(table.column("v"))
        by_number = np.argsort(numbers[~asks])
        member_numbers, members = numbers[~asks][by_number], v[~asks][by_number]
        out = [[], [], []]
        for lo in range(0, int(asks.sum()) if len(members) else 0, 256):
            q_numbers, q = numbers[asks][lo : lo + 256], v[asks][lo : lo + 256]
            for column, x in zip(out, _best(q, members, keep), strict=True):
                column.append(x)
            out[0][-1], out[1][-1] = q_numbers[out[0][-1]], member_numbers[out[1][-1]]
        parts = [np.concatenate(x) if x else np.zeros(0) for x in out]
        return pa.table({"node": pa.array(parts[0], pa.int64()), "near": pa.array(parts[1], pa.int64()), "score": pa.array(parts[2], pa.float64())})

    found = roles.join(nodes.select("node", "v"), "node").groupBy(*group).applyInArrow(score, "node long, near long, score double")
    own = queries.select("node", F.col("node").alias("near"), F.col("norm2").alias("score"))
    merged = found.unionByName(own).groupBy("node", "near").agg(F.max("score").alias("score"))
    place = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("score"), "near"))
    best = merged.withColumn("place", place).where(F.col("place") <= keep)
    expanded = best.join(nodes.select(F.col("node").alias("near"), "ids"), "near").select("node", F.explode("ids").alias("id"), "score")
    place = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("score"), "id"))
    answers = expanded.groupBy("node", "id").agg(F.max("score").alias("score")).withColumn("place", place).where(F.col("place") <= k + 1)
    # One row for each node, so that the many queries of a group of copies aren't ranked in one task.
    lists = answers.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("place", "id", "score"))).alias("list"))
    others = F.slice(F.filter("list", lambda x: x["id"] != F.col("query_id")), 1, k)
    ranked = asking.withColumnRenamed("id", "query_id").join(lists, "node").select("query_id", "node", F.posexplode(others).alias("at", "x"))
    if keep == k + 1:  # no id has several vectors
        return ranked.select("query_id", (F.col("at") + 1).alias("rank"), F.col("x.id").alias(id_col), "x.score")
    merged = ranked.groupBy("query_id", F.col("x.id").alias("id")).agg(F.max("x.score").alias("score"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return merged.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")


def _measured(nodes: DataFrame, queries: DataFrame, placed: DataFrame, k: int, target: float) -> int:
    """Rows on each side of a query's place, on the curve where they are nearest, within which `target` of the k best nodes of sampled queries lie."""
    sample = queries.orderBy(F.xxhash64("node"), "node").limit(SAMPLE).select("node", "v").toArrow()
    if not len(sample):
        return 0
    asked = sample.column("node").to_numpy()
    of_length = {dim: (part.column("node").to_numpy(), _matrix(part.column("v"))) for dim, part in _by_length(sample.combine_chunks().to_batches()[0])}

    def scan(batches):
        best = {dim: [np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64)] for dim in of_length}  # scores, rows of the sample, nodes
        for batch in batches:
            for dim, b in _by_length(batch):
                if dim in of_length:
                    numbers, q = of_length[dim]
                    x, at = _matrix(b.column("v")), b.column("node").to_numpy()
                    rows, members, score = _best(q, x, k + 1)
                    parts = [np.concatenate(pair) for pair in zip(best[dim], (score, rows, at[members]), strict=True)]
                    order = np.lexsort((parts[2], -parts[0], parts[1]))
                    parts = [p[order] for p in parts]
                    kept = np.arange(len(order)) - np.searchsorted(parts[1], np.arange(len(numbers)))[parts[1]] <= k
                    best[dim] = [p[kept] for p in parts]
        for dim, (score, rows, near) in best.items():
            yield pa.RecordBatch.from_arrays([pa.array(of_length[dim][0][rows]), pa.array(near), pa.array(score)], names=["q", "near", "score"])

    # At most k + 1 rows for each sampled query and task.
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "near"))
    truth = nodes.select("node", "v").mapInArrow(scan, "q long, near long, score double").where("q <> near").withColumn("place", place).where(F.col("place") <= k)
    truth = F.broadcast(settle(truth.select("q", "near"), "truth"))  # k * SAMPLE rows
    of_query = placed.where("asks").where(F.col("node").isin(asked.tolist())).select(F.col("node").alias("q"), "curve", F.col("place").alias("at"))
    met = placed.where("not asks").select(F.col("node").alias("near"), "curve", "place").join(truth, "near")
    apart = met.join(F.broadcast(of_query), ["q", "curve"]).groupBy("q", "near").agg(F.min(F.abs(F.col("place") - F.col("at"))).alias("apart"))
    return int(apart.agg(F.percentile("apart", target)).first()[0] or 0) + 1
