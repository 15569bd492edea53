from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from framelake.llm import wordpiece
from framelake.llm.packing import _fractional, _rounded, cut_pieces, pack, plan_sequences
from framelake.llm.queries import tokenizer_path
from framelake.llm.wordpiece import encode
from tests.llm.corpus import documents, thue_morse

PATH = tokenizer_path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def test_pieces_and_sequences(spark, tokenizer):
    rows = documents()
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, piece string, length int")
    out = pack(cut_pieces(docs, PATH)).collect()
    want = Counter()
    for d, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 2048):
            part = np.array(ids[k : k + 2048], "<u4").tobytes()
            want[d, k // 2048, k, len(part) // 4, zlib.crc32(part)] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], zlib.crc32(r["ids"])) for r in out) == want
    places = {}
    for r in out:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    bins: list[int] = []
    for length in sorted((r["length"] for r in out), reverse=True):  # first fit, longest first
        fit = next((i for i, used in enumerate(bins) if used + length <= 2048), None)
        if fit is None:
            bins.append(length)
        else:
            bins[fit] += length
    assert len(places) <= len(bins) + 1


def test_empty_table(spark):
    assert pack(cut_pieces(spark.createDataFrame([], "doc_id long, text string"), PATH)).count() == 0


@settings(max_examples=25, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 300), max_size=20))
def test_plan_places_every_piece_once(histogram):
    plan = plan_sequences(histogram, 64, rounds=40)
    used = Counter()
    for length, n in histogram.items():
        rank = np.arange(n)
        at = np.searchsorted(plan.key, length * plan.span + rank, "right") - 1
        into = rank - (plan.key[at] - length * plan.span)
        for seq, off in zip(plan.sequence[at] + into // plan.per_copy[at], plan.offset[at] + into % plan.per_copy[at] * length, strict=True):
            for k in range(off, off + length):
                used[seq, k] += 1
    assert all(v == 1 for v in used.values())
    total = sum(k * v for k, v in histogram.items())
    assert len(used) == total and max((s for s, _ in used), default=-1) < plan.sequences
    assert all(0 <= k < 64 for _, k in used)


def test_a_wide_histogram_is_covered_and_no_worse_than_best_fit():
    r = np.random.default_rng(5)
    histogram = {int(x): int(n) for x, n in zip(r.permutation(np.arange(1, 513))[:420], np.minimum(500, 1 + 3 * r.pareto(1.0, 420)), strict=True)}
    histogram[175] = sum(n for x, n in histogram.items() if x != 175) // 2  # a third of all pieces, two to a sequence
    lengths = np.array(sorted(histogram))
    demand = np.array([histogram[int(x)] for x in lengths])
    assert 3 * histogram[175] >= demand.sum() - 3 and (demand == 1).any() and (lengths * demand).sum() > 1_000 * 512
    short = np.where(lengths < 512, demand, 0)
    covered = np.zeros(len(lengths))
    for found, x in _fractional(lengths, short, 512):
        for i, a in found.items():
            covered[i] += x * a
    assert np.allclose(covered, short)
    assert plan_sequences(histogram, 512).sequences <= sum(n for _, n in _rounded(lengths, demand, 512, []))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=40) | st.text(alphabet="abAB 'stéÉñß.,!<|>endoftx12²½Σσ́\x85\xa0\n", max_size=60), max_size=8))
def test_fast_encoding_is_the_tokenizer_s(texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(PATH)
    texts = [t for t in texts if not any(0xD800 <= ord(c) < 0xE000 for c in t)]
    ids, offs = encode(pa.array(texts, pa.string()), PATH)
    assert [ids[a:b].tolist() for a, b in zip(offs[:-1], offs[1:], strict=True)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_words_of_one_hash_keep_their_own_ids(tokenizer, monkeypatch):
    """Thue-Morse words, and all words under a hash that calls every two alike, within a batch and from one to the next."""
    texts = [w for n in (1_024, 2_048, 4_096) for w in thue_morse(n)] + ["some plain words", "other plain ones", None, "a\u00e9 some"]
    want = [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    monkeypatch.setattr(wordpiece, "_LOADED", {})
    for name in ("as it is", "constant"):
        if name == "constant":
            monkeypatch.setattr(wordpiece, "word_hashes", lambda words, base: np.ones(len(words.starts), np.uint64))
            monkeypatch.setattr(wordpiece, "_LOADED", {})
        for _ in range(2):
            ids, offs = wordpiece.encode(pa.array(texts), PATH)
            assert [ids[a:b].tolist() for a, b in zip(offs, offs[1:], strict=False)] == want
            texts, want = texts[::-1], want[::-1]
