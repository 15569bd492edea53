"""Toxicity: cumulative-link ordinal regression on sparse text features.

Labels are grades from 0 to `GRADES`. Where they only say toxic or not, the grades
are 0 for what is not and 1 to `GRADES` for equal parts of what is, by the share
of words that the fit itself finds to mark the toxic class: an order by density,
not a judgement that the labels would hold. Features
are whole words and word beginnings (insults are inflected), hashed; those whose
shares in the two classes lie far enough apart are kept, and count per
square root of the text's length, so that neither length alone nor one chance
word decides. All thresholds P(grade > k) = 1 / (1 + exp(t_k - w x)) share the
weights w and stay in order, as t_k grows by exponentials. The output is the
expected grade and the probability of any toxicity.

The fit takes a bounded sample of labelled rows (`most`); features are counted
and chosen in Spark, and only chosen ones (at most `features`) are gathered.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, StructField, StructType

from framelake.llm.features import doc_of, labelled_sample, word_parts
from framelake.llm.wordpiece import slices
from framelake.llm.workspace import fresh, settle

BITS = 20
GRADES = 3


class Model(NamedTuple):
    buckets: np.ndarray  # chosen features, ascending
    weights: np.ndarray
    thresholds: np.ndarray  # ascending, one for each grade above 0


def _chosen(parts: list[np.ndarray], buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(token, index into buckets) of every chosen feature of every token."""
    tokens, found = [], []
    for part in parts:
        at = np.minimum(np.searchsorted(buckets, part), max(len(buckets) - 1, 0))
        hit = np.flatnonzero(buckets[at] == part) if len(buckets) else np.zeros(0, np.int64)
        tokens.append(hit)
        found.append(at[hit])
    return np.concatenate(tokens), np.concatenate(found)


def _severity(x: np.ndarray, thresholds: np.ndarray) -> np.ndarray:
    """P(grade > k) for each threshold."""
    return 1 / (1 + np.exp(np.clip(thresholds[None, :] - x[:, None], -500, 500)))


def _fit(rows: list[np.ndarray], values: list[np.ndarray], grade: np.ndarray, size: int, rounds: int = 400, ridge: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds by Adam on the mean log likelihood of the cumulative-link model."""
    at = np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64)
    v = np.concatenate([*values, np.zeros(0)])
    of = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    n = len(rows)
    # Each feature has a root mean square of 1 where it occurs.
    scale = np.sqrt(np.maximum(np.bincount(at, weights=v * v, minlength=size), 1e-12) / np.maximum(np.bincount(at, minlength=size), 1))
    v = v / scale[at]
    # Parameters: weights, then the first threshold and the logs of the gaps to the next ones.
    p = np.concatenate((np.zeros(size), [2.0], np.zeros(GRADES - 1)))
    m, s = np.zeros_like(p), np.zeros_like(p)
    for step in range(1, rounds + 1):
        t = p[size] + np.concatenate(([0], np.cumsum(np.exp(p[size + 1 :]))))
        x = np.bincount(of, weights=v * p[at], minlength=n)
        above = np.column_stack((np.ones(n), _severity(x, t), np.zeros(n)))  # P(grade > k - 1) for k = 0 ...
        hi, lo = above[np.arange(n), grade], above[np.arange(n), grade + 1]
        like = np.maximum(hi - lo, 1e-12)
        d_hi, d_lo = hi * (1 - hi) / like, lo * (1 - lo) / like  # of the log likelihood over x at both edges
        d_x = d_hi - d_lo
        d_t = np.zeros(GRADES)
        np.add.at(d_t, np.maximum(grade - 1, 0), np.where(grade > 0, -d_hi, 0))
        np.add.at(d_t, np.minimum(grade, GRADES - 1), np.where(grade < GRADES, d_lo, 0))
        tail = np.cumsum(d_t[::-1])[::-1]
        g = np.concatenate((np.bincount(at, weights=v * d_x[of], minlength=size), [tail[0]], tail[1:] * np.exp(p[size + 1 :]))) / n
        g[:size] -= ridge * p[:size]
        m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
        p += 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    return p[:size] / scale, p[size] + np.concatenate(([0], np.cumsum(np.exp(p[size + 1 :]))))


def train(docs: DataFrame, labels: DataFrame, wanted: Column, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", most: int = 12_000, features: int = 3_000, least_z: float = 3.0) -> Model:
    """A model of at most `most` labelled rows, those where wanted (of the id column) holds, chosen by a hash of the id.

    Labels above 1 are grades; if there are none, toxic rows are graded by density
    (see above). With one class only, or no rows, it calls nothing toxic.
    """
    sample = settle(labelled_sample(docs, labels, label, wanted, most, id_col, text_col), "labelled")

    def count(batches):
        for b in batches:
            for lo, part in slices(b.column("text")):
                y = b.column("y").slice(lo, len(part)).to_numpy() > 0
                parts, words = word_parts(part, BITS)
                doc = doc_of(np.arange(len(words.starts)), words.first)
                keys = np.unique(np.concatenate([doc[x >= 0] << BITS | x[x >= 0] for x in parts]))
                bucket, pos = keys & (1 << BITS) - 1, y[keys >> BITS]
                seen, inverse = np.unique(bucket, return_inverse=True)
                p = np.bincount(inverse, weights=pos, minlength=len(seen)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(p), pa.array(np.bincount(inverse, minlength=len(seen)) - p)], names=["bucket", "pos", "neg"])

    sizes = sample.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum((F.col("y") > 0).cast("int")), F.lit(0)).alias("p")).first()
    n_pos, n_neg = sizes["p"], sizes["n"] - sizes["p"]
    nothing = Model(np.zeros(0, np.int64), np.zeros(0), np.full(GRADES, 30.0) + np.arange(GRADES))
    if not n_pos or not n_neg:
        return nothing
    counts = sample.mapInArrow(count, "bucket long, pos long, neg long").groupBy("bucket").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    # Two-proportion z: how far apart the shares of either class that have the feature lie.
    p, q, both = F.col("pos") / n_pos, F.col("neg") / n_neg, (F.col("pos") + F.col("neg")) / (n_pos + n_neg)
    spread_ = F.sqrt(both * (1 - both) * (1 / n_pos + 1 / n_neg) + 1e-12)
    scored = counts.where("pos + neg >= 3").select("bucket", ((p - q) / spread_).alias("z")).where(F.abs("z") >= least_z)
    table = scored.orderBy(F.desc(F.abs("z")), "bucket").limit(features).toPandas().sort_values("bucket")
    buckets, marks = table["bucket"].to_numpy(np.int64), table["z"].to_numpy() > 0
    if not len(buckets):
        return nothing

    def gather(batches):
        for b in batches:
            for lo, part in slices(b.column("text")):
                at, x, share = _rows(part, buckets, marks)
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.list_(pa.int16())), pa.array([v.astype(np.float32) for v in x], pa.list_(pa.float32())), pa.array(share), b.column("y").slice(lo, len(part))], names=["at", "x", "share", "y"])

    # Six bytes for each chosen feature of a sampled row: at most 6 * most * features bytes, in practice a few MB.
    data = sample.mapInArrow(gather, "at array<smallint>, x array<float>, share double, y int").toPandas()
    y, share = data["y"].to_numpy(), data["share"].to_numpy()
    if y.max() > 1:
        grade = np.clip(y, 0, GRADES)
    else:
        edges = np.quantile(share[y > 0], np.arange(1, GRADES) / GRADES)
        grade = np.where(y > 0, 1 + np.searchsorted(edges, share, "right"), 0)
    weights, thresholds = _fit(list(data["at"]), list(data["x"]), grade, len(buckets))
    return Model(buckets, weights, thresholds)


def _rows(part: pa.Array, buckets: np.ndarray, marks: np.ndarray) -> tuple[list, list, np.ndarray]:
    """For each text its chosen features, their values, and the share of tokens with a marking one."""
    parts, words = word_parts(part, BITS)
    token, found = _chosen(parts, buckets)
    n, sizes = len(part), words.per_doc
    doc = doc_of(token, words.first)
    keys, counts = np.unique(doc * len(buckets) + found, return_counts=True)
    of, at = keys // len(buckets), keys % len(buckets)
    x = counts / np.sqrt(np.maximum(sizes[of], 1))
    edges = np.searchsorted(of, np.arange(1, n))
    marked = np.bincount(doc_of(np.unique(token[marks[found]]), words.first), minlength=n)[:n]
    return np.split(at, edges), np.split(x, edges), marked / np.maximum(sizes, 1)


def grade(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with severity (expected grade, 0 to GRADES), grade (the likeliest) and toxic (any grade above 0 is likelier than not).

    Columns of those names get a _ before. Only the text counts; null and empty
    texts have no feature and so the severity of the thresholds alone.
    """
    names = [fresh(docs, c) for c in ("severity", "grade", "toxic")]

    def run(batches):
        for b in batches:
            severity, likeliest, toxic = [np.zeros(0)], [np.zeros(0, np.int32)], [np.zeros(0, bool)]
            for _, part in slices(b.column(text_col)):
                parts, words = word_parts(part, BITS)
                token, found = _chosen(parts, model.buckets)
                x = np.bincount(doc_of(token, words.first), weights=model.weights[found], minlength=len(part))[: len(part)] if len(token) else np.zeros(len(part))
                above = _severity(x / np.sqrt(np.maximum(words.per_doc, 1)), model.thresholds)
                severity.append(above.sum(axis=1))
                edges = np.column_stack((np.ones(len(x)), above, np.zeros(len(x))))
                likeliest.append((edges[:, :-1] - edges[:, 1:]).argmax(axis=1).astype(np.int32))
                toxic.append(above[:, 0] >= 0.5)
            out = b
            for name, values in zip(names, (severity, likeliest, toxic), strict=True):
                out = out.append_column(name, pa.array(np.concatenate(values)))
            yield out

    fields = [StructField(n, t) for n, t in zip(names, (DoubleType(), IntegerType(), BooleanType()), strict=True)]
    return docs.mapInArrow(run, StructType([*docs.schema, *fields]))
