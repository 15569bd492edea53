from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from framelake.llm import sketch, substring_dedup, textops
from framelake.llm.substring_dedup import remove_repeated_passages
from tests.llm.corpus import documents, prose, thue_morse, words


def brute(rows, size=35):
    seen = Counter(tuple(w[i : i + size]) for _, t in rows for w in [words(t)] for i in range(len(w) - size + 1))
    out = []
    for key, text in rows:
        w = words(text)
        gone = {j for i in range(len(w) - size + 1) if seen[tuple(w[i : i + size])] > 1 for j in range(i, i + size)}
        out.append((key, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return sorted(out)


@pytest.mark.parametrize("chunk_bytes", [2_000_000, 2_000])
def test_against_brute_force(spark, monkeypatch, chunk_bytes):
    monkeypatch.setattr(substring_dedup, "CHUNK_BYTES", chunk_bytes)
    monkeypatch.setattr(substring_dedup, "RANGE_KEYS", 5_000)
    rows = documents()
    found = remove_repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r["doc_id"], r["n_words"], r["n_removed"], r["text"]) for r in found.collect()) == brute(rows)


def test_sketch_that_collides_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr(sketch, "plan_sketch", lambda keys, depth=2, *_, **__: sketch.SketchPlan(depth, 4, 1_024))
    monkeypatch.setattr(substring_dedup, "CHUNK_BYTES", 5_000)
    rows = documents()
    found = remove_repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r["doc_id"], r["n_words"], r["n_removed"], r["text"]) for r in found.collect()) == brute(rows)


def test_words_that_collide_under_any_base_of_a_power_of_two(spark):
    """Two documents that share no window: a long Thue-Morse word or its complement, then 34 like words."""
    tail = prose(77, 34)
    rows = [(4 * k + i, f"{w} {tail}") for k in range(3) for i, w in enumerate(thue_morse(1_024 << k))]
    rows += [(100 + k, f"{thue_morse(2_048)[0]} {tail}") for k in range(2)]
    # As words: rows of two words in Thue-Morse order.
    rows += [(200 + i, " ".join(w)) for i, w in enumerate(thue_morse(64))]
    found = remove_repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"))
    got = sorted((r["doc_id"], r["n_words"], r["n_removed"], r["text"]) for r in found.collect())
    assert got == brute(rows) and {i for i, _, n, _ in got if n} == {100, 101, 4}


def test_hashes_are_the_polynomials_that_the_docstring_names():
    bases = textops.draw()
    texts = ["a bb ccc dddddddd", "x" * 256, "y" * 257, "", "é" * 20, None]
    w = textops.cut_words(*textops.text_bytes(pa.array(texts)))
    for s, e, h in zip(w.starts, w.ends, textops.word_hashes(w, bases.word), strict=True):
        raw = w.data[s:e].tobytes()
        value = len(raw)
        for i in range(0, len(raw), 7):
            value = (value * bases.word + int.from_bytes(raw[i : i + 7], "little")) % textops.PRIME
        assert int(h) == value or len(raw) > 256
    again = textops.cut_words(*textops.text_bytes(pa.array([None, *reversed(texts)])))
    assert sorted(textops.word_hashes(again, bases.word)) == sorted(textops.word_hashes(w, bases.word))


def test_messages_grow_with_the_input():
    """A hundred times the input, a hundred times the messages, within the bound of a worker's memory."""
    count = []
    for size in (10**9, 10**10, 10**11):
        scale = sketch.scale_of(size, 16 << 30)
        plan = sketch.plan_sketch(size // 6, scale=scale)
        count.append(sketch.messages(plan, size // (substring_dedup.CHUNK_BYTES * scale)))
    assert all(5 < b / a < 20 for a, b in zip(count, count[1:], strict=False))
    scale = sketch.scale_of(10**14, 16 << 30)
    plan = sketch.plan_sketch(10**14 // 6, scale=scale)
    assert sketch.messages(plan, 10**14 // (substring_dedup.CHUNK_BYTES * scale)) * 30 < 2 * 10**14 // 6


def test_many_equal_rows_are_dealt_over_chunks(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "CHUNK_BYTES", 2_000)
    rows = [(None, prose(5, 100))] * 60 + [(None, None)] * 200 + [(1, prose(6, 100))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    chunks = substring_dedup.chunked(docs, "doc_id", "text", "c")
    sizes = [r["count"] for r in chunks.dealt.where("text is not null").groupBy("c").count().collect()]
    assert len(sizes) > 5 and max(sizes) < 30
    found = remove_repeated_passages(docs)
    assert sorted((r["n_words"], r["n_removed"]) for r in found.collect()) == [(0, 0)] * 200 + [(100, 0)] + [(100, 100)] * 60


def test_empty_table_and_clashing_columns(spark):
    schema = "doc_id long, text string, chunk int, n_words string, n_removed double"
    assert remove_repeated_passages(spark.createDataFrame([], schema)).count() == 0
    out = remove_repeated_passages(spark.createDataFrame([(1, "a b", None, "kept", 0.5), (None, None, 3, None, None)], schema))
    assert out.columns == ["doc_id", "text", "chunk", "n_words", "n_removed", "_n_words", "_n_removed"]
    assert sorted((r["chunk"] or 0, r["n_words"], r["_n_words"], r["text"]) for r in out.collect()) == [(0, "kept", 2, "a b"), (3, None, 0, "")]


def test_sketch_never_underestimates():
    rng = np.random.default_rng(0)
    chunks = [rng.integers(0, 3_000, 2_000).astype(np.uint64) for _ in range(6)]
    plan = sketch.SketchPlan(2, 8, 1_024)
    sent = [sketch.send(i, *sketch.distinct(textops.mix(c)), plan) for i, c in enumerate(chunks)]
    table = pa.concat_tables(sent)
    answers = {}
    for slot in set(table.column("slot").to_pylist()):
        rows = sketch.merge(table.filter(pa.compute.equal(table.column("slot"), slot)), plan.width)
        for chunk, payload in zip(rows.column("chunk").to_pylist(), rows.column("payload").to_pylist(), strict=True):
            answers.setdefault(chunk, {})[slot] = payload
    total = Counter(int(x) for c in chunks for x in c)
    for i, c in enumerate(chunks):
        keys = np.unique(c)
        hashed = textops.mix(keys)
        order = np.argsort(hashed)
        found = sketch.levels(hashed[order], answers[i], plan)
        assert all(f >= total[int(k)].bit_length() for f, k in zip(found, keys[order], strict=True))


def test_words_like_the_pattern():
    texts = ["", " a  b\x0b\x0cc\r\n", "é\xa0x\x85y z", "tail ", None]
    w = textops.cut_words(*textops.text_bytes(pa.array(texts)))
    found = [w.data[s:e].tobytes().decode() for s, e in zip(w.starts, w.ends, strict=True)]
    assert found == [x for t in texts for x in words(t)]
    assert w.per_doc.tolist() == [len(words(t)) for t in texts]
    data, offs = textops.join_words(w, np.ones(len(found), bool))
    assert textops.to_strings(data, offs).to_pylist() == [" ".join(words(t)) for t in texts]
