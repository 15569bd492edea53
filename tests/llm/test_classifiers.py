from __future__ import annotations

import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from framelake.llm import quality, textops, toxicity
from framelake.llm.features import PREFIXES, cut_tokens, ngram_indicators
from tests.llm.corpus import prose

GOOD, BAD = ["alpha", "beta", "gamma"], ["junk###", "spam|", "%%%"]
SLURS = ["fie", "knave", "villain", "wretch"]


def table(spark):
    r = random.Random(4)
    docs, labels = [], []
    for i in range(600):
        w = prose(i, r.choice((10, 60, 300))).split()
        poor, toxic = i % 3 == 0, i % 5 == 0
        for _ in range(max(2, len(w) // 15)):
            w[r.randrange(len(w))] = r.choice(BAD if poor else GOOD)
        for _ in range(max(2, len(w) // (10 + i % 40)) if toxic else 0):
            w[r.randrange(len(w))] = r.choice(SLURS) + r.choice(["", "ish", "."])
        docs.append((i, " ".join(w), "source", "s"))
        labels.append((i, int(not poor), int(toxic)))
    docs += [(1000, None, None, None), (1001, "", None, None), (1002, "x" * 100_000, None, None), (None, "fie fie", None, None), (5, docs[5][1], None, None)]
    labels += [(None, 1, 1), (3, None, None), (5000, 1, 0), (5, 1, 1)]
    return spark.createDataFrame(docs, "doc_id long, text string, score string, grade string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality_on_rows_held_out(spark):
    docs, labels = table(spark)
    held = quality.held_out(F.col("doc_id"))
    model = quality.train(docs, labels, ~held, most=500)
    out = quality.score(docs, model)
    assert out.columns == ["doc_id", "text", "score", "grade", "_score"]
    rows = out.join(labels.where("quality is not null").dropDuplicates(["doc_id"]), "doc_id").where(held).select("_score", "quality").collect()
    assert np.mean([(r["_score"] >= 0.5) == (r["quality"] == 1) for r in rows]) > 0.95
    every = out.collect()
    assert len(every) == docs.count() and all(0 <= r["_score"] <= 1 for r in every)


def mixed(h):
    mask = (1 << 64) - 1
    h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 & mask
    h = (h ^ h >> 27) * 0x94D049BB133111EB & mask
    return h ^ h >> 31


def named(word):
    """The fixed hash of a word of up to 256 bytes, in whole numbers."""
    value = len(word)
    for i in range(0, len(word), 7):
        value = (value * textops.FIXED.word + int.from_bytes(word[i : i + 7], "little")) % textops.PRIME
    return mixed(value)


def tokens(text):
    return re.findall(rb"[a-z0-9\x80-\xff]+|[^a-z0-9\x80-\xff\x20\x09-\x0d]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))


def test_scores_by_hand(spark):
    """Both models' scores of every row, worked out token by token."""
    docs, labels = table(spark)
    docs = docs.where("doc_id is null or doc_id <> 1002")
    model = quality.train(docs, labels, F.lit(True))
    for r in quality.score(docs, model).collect():
        h = [named(t) for t in tokens(r["text"])]
        found = {x >> 64 - quality.BITS for x in h} | {mixed((a * textops.FIXED.run + b) % 2**64) >> 64 - quality.BITS for a, b in zip(h, h[1:], strict=False)}
        v = {b: float(model.ratios[b]) for b in found}
        norm = math.sqrt(max(sum(x * x for x in v.values()), 1e-12))
        margin = sum(x / norm * float(model.weights[b]) for b, x in v.items()) + model.bias
        assert r["_score"] == pytest.approx(1 / (1 + math.exp(-(model.slope * margin + model.shift))), abs=1e-6)
    model = toxicity.train(docs, labels, F.lit(True))
    weight = dict(zip(model.buckets.tolist(), model.weights.tolist(), strict=True))
    for r in toxicity.grade(docs, model).collect():
        x, words = 0.0, tokens(r["text"])
        for t in words:
            x += weight.get(named(t) >> 64 - toxicity.BITS, 0.0)
            for n in PREFIXES:
                if len(t) > n:
                    code = 0
                    for c in t[:n]:
                        code = (code * textops.FIXED.word + c + 1) % 2**64
                    x += weight.get(mixed(code ^ n) >> 64 - toxicity.BITS, 0.0)
        above = [1 / (1 + math.exp(t - x / math.sqrt(max(len(words), 1)))) for t in model.thresholds]
        assert r["severity"] == pytest.approx(sum(above), abs=1e-6) and r["toxic"] == (above[0] >= 0.5)


def test_quality_gathers_a_bounded_number_of_entries(spark, monkeypatch):
    docs, labels = table(spark)
    seen = []
    fit = quality.fit
    monkeypatch.setattr(quality, "fit", lambda rows, y: seen.append(len(rows.buckets)) or fit(rows, y))
    model = quality.train(docs, labels, F.lit(True), entries=3_000)
    rows = quality.score(docs, model).join(labels.where("doc_id < 600 and quality is not null").dropDuplicates(["doc_id"]), "doc_id").collect()
    assert 2_000 < seen[0] <= 3_000 and np.mean([(r["_score"] >= 0.5) == (r["quality"] == 1) for r in rows]) > 0.95


def test_graded_labels_come_back_in_order(spark):
    """Labels of grades that no share of marks tells: each grade has words of its own."""
    r = random.Random(8)
    marks = {1: ["tut", "fiddle"], 2: ["rogue", "scamp"], 3: ["caitiff", "dastard"]}
    docs, labels = [], []
    for i in range(800):
        grade = i % 4
        w = prose(i, 60).split()
        for _ in range(4 if grade else 0):
            w[r.randrange(60)] = r.choice(marks[grade])
        docs.append((i, " ".join(w)))
        labels.append((i, grade))
    docs, labels = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    held = quality.held_out(F.col("doc_id"))
    out = toxicity.grade(docs, toxicity.train(docs, labels, ~held)).where(held).join(labels.withColumnRenamed("toxic", "want"), "doc_id")
    rows = out.collect()
    means = [np.mean([x["severity"] for x in rows if x["want"] == g]) for g in range(4)]
    assert means == sorted(means) and np.mean([x["grade"] == x["want"] for x in rows]) > 0.8


def test_quality_without_labels(spark):
    docs, labels = table(spark)
    for chosen in (labels.limit(0), labels.where("quality = 1")):
        model = quality.train(docs, chosen, F.lit(True))
        scores = {r["_score"] for r in quality.score(docs, model).collect()}
        assert len(scores) == 1 and 0 < scores.pop() < 1
    assert quality.score(docs.limit(0), model).count() == 0


def test_toxicity_on_rows_held_out(spark):
    docs, labels = table(spark)
    held = quality.held_out(F.col("doc_id"))
    model = toxicity.train(docs, labels, ~held)
    assert (np.diff(model.thresholds) > 0).all()
    out = toxicity.grade(docs, model)
    assert out.columns == ["doc_id", "text", "score", "grade", "severity", "_grade", "toxic"]
    rows = out.withColumnRenamed("toxic", "found").join(labels.where("doc_id <> 5 and toxic is not null"), "doc_id").where(held).collect()
    hit = [r["found"] for r in rows if r["toxic"] == 1]
    miss = [r["found"] for r in rows if r["toxic"] == 0]
    assert np.mean(hit) > 0.85 and np.mean(miss) < 0.03
    every = out.collect()
    assert len(every) == docs.count() and all(0 <= r["severity"] <= toxicity.GRADES for r in every)
    assert not any(r["toxic"] for r in every if not r["text"])


def test_severity_follows_the_share_of_marks(spark):
    docs, labels = table(spark)
    model = toxicity.train(docs, labels, F.lit(True))
    texts = [(i, " ".join(["knave"] * i + prose(7, 100).split())) for i in (0, 2, 8, 30)]
    found = [r["severity"] for r in toxicity.grade(spark.createDataFrame(texts, "doc_id long, text string"), model).orderBy("doc_id").collect()]
    assert found == sorted(found) and found[0] < 0.5 < found[-1]


def test_toxicity_without_labels(spark):
    docs, labels = table(spark)
    for chosen in (labels.limit(0), labels.where("toxic = 0")):
        model = toxicity.train(docs, chosen, F.lit(True))
        assert not any(r["toxic"] for r in toxicity.grade(docs, model).collect())


def test_tokens_and_indicators():
    texts = pa.array(["The  end.#### é9x", None, "", "the end. the end."])
    w = cut_tokens(texts)
    assert [w.data[s:e].tobytes().decode() for s, e in zip(w.starts, w.ends, strict=True)] == ["the", "end", ".####", "é9x", "the", "end", ".", "the", "end", "."]
    assert w.per_doc.tolist() == [4, 0, 0, 6]
    rows = ngram_indicators(texts, 18)
    assert np.diff(rows.offs).tolist() == [7, 0, 0, 6]


def test_dual_coordinate_descent_reaches_the_primal_optimum():
    """The duality gap closes: dual value = sum(alpha) - |w|^2 / 2, primal = |w|^2 / 2 + C * hinge losses."""
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 80)
    lists = [np.unique(rng.integers(0, 40, 6) + 20 * k) for k in y]
    rows = quality.Rows(np.concatenate(lists), np.concatenate(([0], np.cumsum([len(x) for x in lists]))))
    ratios = quality._log_ratios(rows, y, 64)
    w, b = quality._descend(rows, y, ratios, 1.0, 400, 0)
    sign = np.where(y == 1, 1, -1)
    primal = lambda w, b: (w @ w + b * b) / 2 + np.maximum(0, 1 - sign * quality._margins(rows, ratios, w, b)).sum()
    best = primal(w, b)
    for _ in range(200):
        assert primal(w + rng.normal(size=64) * 0.05, b + rng.normal() * 0.05) >= best - 1e-3


@pytest.mark.parametrize("seed", range(3))
def test_ordinal_gradient(seed):
    """The fit's likelihood beats nearby parameters."""
    rng = np.random.default_rng(seed)
    rows = [np.unique(rng.integers(0, 6, 3)) for _ in range(300)]
    values = [np.ones(len(r)) for r in rows]
    true = np.array([2.0, 1, 0, 0, -1, -2])
    x = np.array([true[r].sum() for r in rows])
    grade = (rng.logistic(size=300) + x > np.array([[0.0], [1.5], [3.0]])).sum(axis=0)
    w, t = toxicity._fit(rows, values, grade, 6, ridge=0.0)

    def loss(w, t):
        x = np.array([w[r].sum() for r in rows])
        above = np.column_stack((np.ones(300), toxicity._severity(x, t), np.zeros(300)))
        return -np.log(above[np.arange(300), grade] - above[np.arange(300), grade + 1]).mean()

    best = loss(w, t)
    for _ in range(100):
        assert loss(w + rng.normal(size=6) * 0.1, np.sort(t + rng.normal(size=3) * 0.1)) >= best - 1e-3
