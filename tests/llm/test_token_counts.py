from __future__ import annotations

import public_tokenizers
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from framelake.llm.queries import REDACTIONS, _redactions, tokenizer_path
from framelake.llm.token_counts import CountTree, Encoder, count_tokens, edits_of
from tests.llm.corpus import documents

PATH = tokenizer_path("byte_bpe_50k.tiktoken")
ENCODER = Encoder(PATH, public_tokenizers.PATTERN)
TEXT = st.text(alphabet="ab '\nrestvé1!  ", max_size=120)


def n_tokens(text: str) -> int:
    return len(ENCODER.encoding.encode_ordinary(text))


@settings(max_examples=300, deadline=None)
@given(TEXT, st.lists(st.tuples(st.integers(0, 150), st.integers(0, 40), TEXT), max_size=5))
def test_edits_like_encoding_anew(text, edits):
    tree = CountTree(text, ENCODER)
    for start, length, new in edits:
        start = min(start, len(text))
        end = min(start + length, len(text))
        tree.edit(start, end, new)
        text = text[:start] + new + text[end:]
        assert tree.text == text
        assert [p for b in tree.blocks for p, _ in b] == ENCODER.pattern.findall(text)
        assert tree.n_tokens == n_tokens(text)


def test_small_edit_of_a_long_text_encodes_little():
    text = "some words and 12 numbers, again " * 4_000
    tree = CountTree(text, ENCODER)
    before = tree.encoded
    tree.edit(60_000, 60_004, "other")
    assert tree.encoded - before < 20
    assert tree.n_tokens == n_tokens(text[:60_000] + "other" + text[60_004:])
    assert tree.tokens_before(0) == 0 and tree.tokens_before(10**9) == tree.n_tokens


def test_edit_beyond_the_text():
    with pytest.raises(IndexError):
        CountTree("abc", ENCODER).edit(1, 9, "")


def test_table(spark):
    rows = [*documents(), (900, "write to a.b@c.example.org or 0123 456-7890 now\n\n\nend")]
    found = count_tokens(spark.createDataFrame([(d, t, 5) for d, t in rows], "doc_id long, text string, n_tokens int"), PATH, public_tokenizers.PATTERN, _redactions)
    assert found.columns == ["doc_id", "text", "n_tokens", "_n_tokens", "n_edits", "n_tokens_edited", "n_reencoded"]
    for r in found.collect():
        text = r["text"] or ""
        assert r["_n_tokens"] == n_tokens(text)
        for rule in REDACTIONS:
            text = regex.sub(rule.pattern, rule.replacement, text)
        assert r["n_tokens_edited"] == n_tokens(text)
        assert r["n_edits"] == len(edits_of(r["text"] or "", REDACTIONS))
    assert count_tokens(spark.createDataFrame([], "text string"), PATH, public_tokenizers.PATTERN).count() == 0


@pytest.mark.parametrize("pattern", [r"\s*[\r\n]+|\s+", r"\w+(?=x)|.", r"(?<=a)b|.", r"\p{N}{1,3}|.", r"a+?b|."])
def test_patterns_that_look_far_are_refused(pattern):
    with pytest.raises(ValueError):
        Encoder(PATH, pattern)
