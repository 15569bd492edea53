"""Token ids of whole texts by a tokenizer whose pre-tokens never span white space.

`word_bpe_49k.json` drops white space before it merges, so a text's ids are
those of its ASCII-space-separated words one after another. Distinct words are
encoded once and kept in sorted arrays by hash, with their bytes, which are
compared wherever a word is found again; the rest is NumPy. New words of plain Latin characters are merged by tiktoken, given the
same merges as ranks with a byte that stands for a word's end; all others go
through the tokenizer itself.
"""

from __future__ import annotations

import json
from typing import NamedTuple

import numpy as np
import pyarrow as pa

from framelake.llm.textops import U64, cut_words, draw, give_back, same_words, text_bytes, word_hashes

#: Words that a worker remembers at most; beyond, it starts anew.
CACHE_WORDS = 500_000
#: Text bytes that are looked at together; a longer document is looked at alone.
SLICE_BYTES = 2_000_000
#: Marks a word's end in ranks and a text's end of word; no plain word has it.
WORD_END, NEXT = "\x01", "\n"
#: Characters that neither normalisation nor any version of Unicode's tables treats specially.
PLAIN = "[\\x21-\\x7e\\xa1-\\xac\\xae-\\u012f\\u0131-\\u017e]"
#: The tokenizer file's own pre-token pattern.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def slices(column: pa.Array, limit: int = SLICE_BYTES):
    """Parts of a text column of about `limit` bytes, in order, as (first row, part)."""
    _, offs = text_bytes(column)
    lo = 0
    while lo < len(column):
        give_back()
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        yield lo, column.slice(lo, hi - lo)
        lo = hi


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for sizes[0] numbers, then the same for the next."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - sizes), sizes)


class _Merger:
    """The tokenizer and its fast twin for plain words."""

    def __init__(self, path: str):
        import regex
        import tiktoken
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        # The byte-level alphabet: printable bytes stand for themselves, the others for characters from 256 on.
        shown = [b for b in range(256) if chr(b) in ByteLevel.alphabet() and b not in (0xAD,)]
        alphabet = {chr(b): b for b in shown}
        alphabet |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
        suffix = model["end_of_word_suffix"]

        def raw(token: str) -> bytes:
            body, end = (token[: -len(suffix)], WORD_END) if token.endswith(suffix) and token != suffix else (token, "")
            return bytes(alphabet[c] for c in body) + end.encode()

        char_of = {b: c for c, b in alphabet.items()}
        order = [bytes([b]) for b in range(256)] + [bytes([b]) + WORD_END.encode() for b in range(256)]
        vocab = model["vocab"]
        ids = [vocab[char_of[b]] for b in range(256)] + [vocab[char_of[b] + suffix] for b in range(256)]
        for pair in model["merges"]:
            token = "".join(pair.split(" ") if isinstance(pair, str) else pair)
            order.append(raw(token))
            ids.append(vocab[token])
        self.ids = np.array(ids, np.uint32)
        self.next_rank = order.index(NEXT.encode())
        self.encoding = tiktoken.Encoding("words", pat_str=f"[^{WORD_END}{NEXT}]+{WORD_END}|{NEXT}", mergeable_ranks={t: i for i, t in enumerate(order)}, special_tokens={})
        self.plain = regex.compile(f"(?:{PLAIN})*")
        self.pretoken = regex.compile(f"({PRETOKEN})")

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """ids of all words one after another and the number of ids of each."""
        fast = [i for i, w in enumerate(words) if self.plain.fullmatch(w) and "<|" not in w]
        slow = sorted(set(range(len(words))) - set(fast))
        text = "".join([words[i] + NEXT for i in fast]).lower()
        ranks = np.array(self.encoding.encode_ordinary(self.pretoken.sub(r"\1" + WORD_END, text)), np.int64)
        ends = np.flatnonzero(ranks == self.next_rank)
        sizes = np.zeros(len(words), np.int64)
        sizes[fast] = np.diff(ends, prepend=-1) - 1
        others = [e.ids for e in self.tokenizer.encode_batch([words[i] for i in slow], add_special_tokens=False)] if slow else []
        sizes[slow] = [len(x) for x in others]
        starts = np.cumsum(sizes) - sizes
        flat = np.zeros(int(sizes.sum()), np.uint32)
        flat[spread(starts[fast], sizes[fast])] = self.ids[np.delete(ranks, ends)]
        for i, x in zip(slow, others, strict=True):
            flat[starts[i] : starts[i] + len(x)] = x
        return flat, sizes


class _Memory(NamedTuple):
    """Words by ascending hash: where the bytes and the ids of each are."""

    keys: np.ndarray
    raw_at: np.ndarray
    raw_sizes: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray
    raw: np.ndarray
    flat: np.ndarray

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        return at, self.keys[at] == keys if len(self.keys) else np.zeros(len(keys), bool)

    def with_words(self, keys: np.ndarray, raw: np.ndarray, raw_sizes: np.ndarray, flat: np.ndarray, sizes: np.ndarray) -> _Memory:
        at = np.searchsorted(self.keys, keys)
        raw_at, starts = np.cumsum(raw_sizes) - raw_sizes + len(self.raw), np.cumsum(sizes) - sizes + len(self.flat)
        columns = zip(self[:5], (keys, raw_at, raw_sizes, starts, sizes), strict=True)
        return _Memory(*(np.insert(old, at, new) for old, new in columns), np.concatenate((self.raw, raw)), np.concatenate((self.flat, flat)))


_EMPTY = _Memory(np.zeros(0, U64), *(np.zeros(0, np.int64) for _ in range(4)), np.zeros(0, np.uint8), np.zeros(0, np.uint32))
_LOADED: dict[str, tuple[_Merger, list[_Memory]]] = {}
_BASE = draw().word


def encode(column: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """uint32 ids of all texts one after another, and the texts' offsets in them."""
    if path not in _LOADED:
        _LOADED[path] = _Merger(path), [_EMPTY]
    merger, kept = _LOADED[path]
    words = cut_words(*text_bytes(column))
    word_sizes = words.ends - words.starts

    def ids_of(which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw = words.data.tobytes()
        return merger.encode([raw[s:e].decode() for s, e in zip(words.starts[which].tolist(), words.ends[which].tolist(), strict=True)])

    keys, first, inverse = np.unique(word_hashes(words, _BASE), return_index=True, return_inverse=True)
    at, known = kept[0].find(keys)
    new = np.flatnonzero(~known)
    if len(new):
        if len(kept[0].keys) + len(new) > CACHE_WORDS:
            kept[0], new = _EMPTY, np.arange(len(keys))
        flat, sizes = ids_of(first[new])
        of = first[new]
        kept[0] = kept[0].with_words(keys[new], words.data[spread(words.starts[of], word_sizes[of])], word_sizes[of], flat, sizes)
        at, _ = kept[0].find(keys)
    at = at[inverse]
    memory = kept[0]
    same = memory.raw_sizes[at] == word_sizes
    check = np.flatnonzero(same)
    same[check] = same_words(words.data, words.starts[check], memory.raw, memory.raw_at[at[check]], word_sizes[check])
    starts, per_word, source = memory.starts[at], memory.sizes[at], memory.flat
    if not same.all():  # other words of one hash: encoded anew
        other = np.flatnonzero(~same)
        flat, sizes = ids_of(other)
        starts, per_word, source = starts.copy(), per_word.copy(), np.concatenate((source, flat))
        starts[other], per_word[other] = np.cumsum(sizes) - sizes + len(memory.flat), sizes
    return source[spread(starts, per_word)], np.concatenate(([0], np.cumsum(per_word)))[words.first]
