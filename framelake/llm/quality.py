"""Quality classifier: Naive Bayes support vectors.

Indicators of token uni- and bigrams are scaled by the log ratio of their
smoothed frequencies in either class and brought to unit length; a linear model
with hinge loss is fitted on them by dual coordinate descent, and its margins
become probabilities by a logistic fit on rows that its first fit has not seen.

The fit takes a bounded sample of labelled rows (`most`), gathered as bucket
numbers; scoring takes every row in place.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from framelake.llm.features import Rows, labelled_sample, ngram_indicators
from framelake.llm.wordpiece import slices
from framelake.llm.workspace import fresh, settle

BITS = 18


class Model(NamedTuple):
    ratios: np.ndarray  # float32, by bucket: what an indicator is scaled by
    weights: np.ndarray  # float32, of scaled indicators
    bias: float
    slope: float  # of the probability's logit over the margin
    shift: float


def _scaled(rows: Rows, ratios: np.ndarray) -> np.ndarray:
    """Values of all rows' indicators: the ratios, each row at unit length."""
    v = ratios[rows.buckets].astype(np.float64)
    sums = np.concatenate(([0], np.cumsum(v * v)))
    norms = np.sqrt(np.maximum(sums[rows.offs[1:]] - sums[rows.offs[:-1]], 1e-12))
    return v / np.repeat(norms, np.diff(rows.offs))


def _margins(rows: Rows, ratios: np.ndarray, weights: np.ndarray, bias: float) -> np.ndarray:
    sums = np.concatenate(([0], np.cumsum(_scaled(rows, ratios) * weights[rows.buckets])))
    return sums[rows.offs[1:]] - sums[rows.offs[:-1]] + bias


def _log_ratios(rows: Rows, y: np.ndarray, size: int) -> np.ndarray:
    of = np.repeat(y, np.diff(rows.offs))
    p = np.bincount(rows.buckets[of == 1], minlength=size) + 1.0
    q = np.bincount(rows.buckets[of == 0], minlength=size) + 1.0
    return np.log(p / p.sum()) - np.log(q / q.sum())


def _descend(rows: Rows, y: np.ndarray, ratios: np.ndarray, cost: float, epochs: int, seed: int) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the hinge loss (L1 dual, box 0 to cost)."""
    values, sign = _scaled(rows, ratios), np.where(y == 1, 1.0, -1.0)
    w, bias, alpha = np.zeros(len(ratios)), 0.0, np.zeros(len(y))
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        most = 0.0
        for i in rng.permutation(len(y)):
            lo, hi = rows.offs[i], rows.offs[i + 1]
            at, x = rows.buckets[lo:hi], values[lo:hi]
            gradient = sign[i] * (w[at] @ x + bias) - 1
            new = min(cost, max(0.0, alpha[i] - gradient / (x @ x + 1)))
            step = (new - alpha[i]) * sign[i]
            if step:
                w[at] += step * x
                bias += step
                alpha[i] = new
                most = max(most, abs(step))
        if most < 1e-3:
            break
    return w, bias


def _calibrate(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope (positive) and shift of a logistic fit by Newton's method, with Platt's smoothed targets."""
    pos = y.sum()
    t = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (len(y) - pos + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        r, k = p - t, np.maximum(p * (1 - p), 1e-6)
        g = np.array([r @ margins + 1e-3 * (a - 1), r.sum()])
        h = np.array([[k @ (margins * margins) + 1e-3, k @ margins], [k @ margins, k.sum()]])
        step = np.linalg.solve(h + 1e-9 * np.eye(2), g)
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-8:
            break
    return max(a, 1e-3), b


def fit(rows: Rows, y: np.ndarray, cost: float = 1.0, epochs: int = 20, seed: int = 3) -> Model:
    """With one class only, or no rows, every score is the smoothed share of positives."""
    size = 1 << BITS
    if len(np.unique(y)) < 2:
        share = (y.sum() + 1) / (len(y) + 2)
        return Model(np.zeros(size, np.float32), np.zeros(size, np.float32), 0.0, 1.0, float(np.log(share / (1 - share))))
    ratios = _log_ratios(rows, y, size)
    held = np.arange(len(y)) % 5 == 4
    slope, shift = 1.0, 0.0
    if len(np.unique(y[~held])) == 2 and len(np.unique(y[held])) == 2:
        part = _take(rows, ~held)
        r = _log_ratios(part, y[~held], size)
        w, bias = _descend(part, y[~held], r, cost, epochs, seed)
        slope, shift = _calibrate(_margins(_take(rows, held), r, w, bias), y[held])
    w, bias = _descend(rows, y, ratios, cost, epochs, seed)
    return Model(ratios.astype(np.float32), w.astype(np.float32), bias, slope, shift)


def _take(rows: Rows, mask: np.ndarray) -> Rows:
    sizes = np.diff(rows.offs)
    return Rows(rows.buckets[np.repeat(mask, sizes)], np.concatenate(([0], np.cumsum(sizes[mask]))))


def train(docs: DataFrame, labels: DataFrame, wanted: Column, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", most: int = 12_000, entries: int = 40_000_000) -> Model:
    """A model of at most `most` labelled rows, those where wanted (of the id column) holds, chosen by a hash of the id.

    N-grams are counted in Spark, at most 2**BITS of them. Those whose shares in
    the two classes lie farthest apart are gathered, as many as have at most
    `entries` occurrences in the sample's rows together (four bytes each), so
    that the driver's memory has a bound whatever the texts' lengths.
    """
    sample = settle(labelled_sample(docs, labels, label, wanted, most, id_col, text_col), "labelled")

    def rows_of(batches):
        for b in batches:
            for lo, part in slices(b.column("text")):
                yield ngram_indicators(part, BITS), b.column("y").slice(lo, len(part))

    def count(batches):
        for rows, y in rows_of(batches):
            positive = np.repeat(y.to_numpy() > 0, np.diff(rows.offs))
            seen, inverse = np.unique(rows.buckets, return_inverse=True)
            p = np.bincount(inverse, weights=positive, minlength=len(seen)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int64)), pa.array(p), pa.array(np.bincount(inverse, minlength=len(seen)) - p)], names=["bucket", "pos", "neg"])

    sizes = sample.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum((F.col("y") > 0).cast("int")), F.lit(0)).alias("p")).first()
    n_pos, n_neg = sizes["p"], sizes["n"] - sizes["p"]
    counts = sample.mapInArrow(count, "bucket long, pos long, neg long").groupBy("bucket").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    table = counts.toArrow().sort_by("bucket")
    pos, neg = table.column("pos").to_numpy(), table.column("neg").to_numpy()
    far = np.abs(pos / max(n_pos, 1) - neg / max(n_neg, 1)) / np.sqrt(np.maximum(pos + neg, 1))
    order = np.argsort(-far, kind="stable")
    chosen = np.zeros(1 << BITS, bool)
    chosen[table.column("bucket").to_numpy()[order[np.cumsum((pos + neg)[order]) <= entries]]] = True

    def indicate(batches):
        for rows, y in rows_of(batches):
            kept = chosen[rows.buckets]
            offs = np.concatenate(([0], np.cumsum(kept)))[rows.offs]
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(rows.buckets[kept].astype(np.int32))), y], names=["buckets", "y"])

    table = sample.mapInArrow(indicate, "buckets array<int>, y int").toArrow()
    lists = table.column("buckets").combine_chunks()
    lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
    offs = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)))).astype(np.int64) if len(lists) else np.zeros(1, np.int64)
    return fit(Rows(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), offs), (table.column("y").to_numpy() > 0).astype(np.int64))


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with its score (0 to 1, higher: better) from the text alone; null and empty texts get the bias's."""
    column = fresh(docs, "score")

    def run(batches):
        for b in batches:
            scores = [np.zeros(0)]
            for _, part in slices(b.column(text_col)):
                m = _margins(ngram_indicators(part, BITS), model.ratios, model.weights, model.bias)
                scores.append(1 / (1 + np.exp(-np.clip(model.slope * m + model.shift, -500, 500))))
            yield b.append_column(column, pa.array(np.concatenate(scores)))

    return docs.mapInArrow(run, StructType([*docs.schema, StructField(column, DoubleType())]))


def held_out(id_column: Column) -> Column:
    """Rows that are never learned from: the CRC-32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.pmod(F.crc32(id_column.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))
