"""Edit-aware token counts: a tree of pre-token counts per document.

A byte-level BPE merges within pre-tokens only, so a text's token count is the
sum of its pre-tokens' counts. `CountTree` keeps the pre-tokens in small blocks
with segment trees of characters and tokens over the blocks. An edit re-encodes
only the pre-tokens it touches, the few before it that looked at its characters
(the pattern looks at most `LOOKAHEAD` characters past a match), and those after
it until the old boundaries meet the new ones; then the sums on the path to the
root are updated.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterable
from typing import NamedTuple

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StructField, StructType

from framelake.llm.wordpiece import slices
from framelake.llm.workspace import fresh

#: Pre-tokens of a block when built; a block of four times as many is split.
BLOCK = 64
#: How far past a match's end the pattern may look.
LOOKAHEAD = 2
CACHE_PRETOKENS = 400_000
#: What would let a pattern look farther: other look-arounds, and repetitions that may give back what they took.
FARTHER = regex.compile(r"\(\?[=!<]|\*|\{\d|\+\?|\?\?")


class Edit(NamedTuple):
    """Replaces the characters [start, end) of the text as it is before this edit."""

    start: int
    end: int
    text: str


class Encoder:
    """Pre-tokens of a text and the number of tokens of each, for a .tiktoken vocabulary."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        if FARTHER.search(pattern.replace(r"\s+(?!\S)", "")):
            raise ValueError(f"a pre-token's end must depend on at most {LOOKAHEAD} characters after it: {pattern}")
        self.pattern = regex.compile(pattern)
        self.known: dict[str, int] = {}

    def counts(self, pretokens: list[str]) -> list[int]:
        known = self.known
        try:
            return [known[p] for p in pretokens]
        except KeyError:
            if len(known) > CACHE_PRETOKENS:
                known.clear()
            encode = self.encoding.encode_ordinary
            out = []
            for p in pretokens:
                n = known.get(p)
                if n is None:
                    n = len(encode(p))
                    if len(p) < 40:
                        known[p] = n
                out.append(n)
            return out


class _Sums:
    """A segment tree of sums over a list of numbers."""

    def __init__(self, values: list[int]):
        self.size = 1 << max(0, (len(values) - 1).bit_length())
        self.tree = [0] * self.size + values + [0] * (self.size - len(values))
        for i in range(self.size - 1, 0, -1):
            self.tree[i] = self.tree[2 * i] + self.tree[2 * i + 1]

    def total(self) -> int:
        return self.tree[1]

    def put(self, i: int, value: int) -> None:
        i += self.size
        self.tree[i] = value
        while i > 1:
            i >>= 1
            self.tree[i] = self.tree[2 * i] + self.tree[2 * i + 1]

    def find(self, at: int) -> tuple[int, int]:
        """The entry that holds unit number `at`, and how many units come before that entry."""
        i, before = 1, 0
        while i < self.size:
            i *= 2
            if at - before >= self.tree[i]:
                before += self.tree[i]
                i += 1
        return i - self.size, before

    def before(self, i: int) -> int:
        """The sum of the entries before entry i."""
        i += self.size
        out = 0
        while i > 1:
            if i & 1:
                out += self.tree[i - 1]
            i >>= 1
        return out


class CountTree:
    def __init__(self, text: str, encoder: Encoder):
        self.encoder = encoder
        #: Pre-tokens encoded so far, those of the first count included.
        self.encoded = 0
        self._build(self._cut(text))

    def _cut(self, text: str) -> list[tuple[str, int]]:
        pretokens = self.encoder.pattern.findall(text)
        self.encoded += len(pretokens)
        return list(zip(pretokens, self.encoder.counts(pretokens), strict=True))

    def _build(self, leaves: list[tuple[str, int]]) -> None:
        self.blocks = [leaves[i : i + BLOCK] for i in range(0, len(leaves), BLOCK)] or [[]]
        self.chars = _Sums([sum(len(p) for p, _ in b) for b in self.blocks])
        self.tokens = _Sums([sum(n for _, n in b) for b in self.blocks])

    @property
    def n_tokens(self) -> int:
        return self.tokens.total()

    @property
    def text(self) -> str:
        return "".join(p for b in self.blocks for p, _ in b)

    def tokens_before(self, char: int) -> int:
        """Tokens of the pre-tokens that end at or before a character."""
        block, at = self._place(char)
        total = self.tokens.before(block)
        for p, n in self.blocks[block]:
            at += len(p)
            if at > char:
                break
            total += n
        return total

    def _place(self, char: int) -> tuple[int, int]:
        if char >= self.chars.total():
            last = len(self.blocks) - 1
            return last, self.chars.before(last)
        return self.chars.find(char)

    def _leaf(self, char: int) -> tuple[int, int, int]:
        """Block, index and first character of the pre-token that holds a character (past the end: of the place after the last)."""
        block, at = self._place(char)
        for i, (p, _) in enumerate(self.blocks[block]):
            if at + len(p) > char:
                return block, i, at
            at += len(p)
        return block, len(self.blocks[block]), at

    def edit(self, start: int, end: int, text: str) -> None:
        total = self.chars.total()
        if not 0 <= start <= end <= total:
            raise IndexError(f"[{start}, {end}) of {total} characters")
        # A match that ends LOOKAHEAD or more characters before the edit didn't see it.
        block, index, begin = self._leaf(max(0, start - LOOKAHEAD - 1))
        head = ""
        b, i, at = block, index, begin
        taken: list[str] = []  # old pre-tokens from begin on
        margin = 8

        def pull() -> bool:
            nonlocal b, i, at
            while b < len(self.blocks) and i >= len(self.blocks[b]):
                b, i = b + 1, 0
            if b == len(self.blocks):
                return False
            taken.append(self.blocks[b][i][0])
            at += len(taken[-1])
            i += 1
            return True

        while True:
            while at < min(total, end + margin) and pull():
                pass
            old = "".join(taken)
            head = old[: start - begin] + text
            window = head + old[end - begin :]
            whole = at >= total
            olds, place = set(), begin
            for p in taken:
                olds.add(place)
                place += len(p)
            olds.add(place)
            shift = len(head) - (end - begin)  # from old to new, both from begin
            new, stop = [], None
            for m in self.encoder.pattern.finditer(window):
                s = m.start()
                if s >= len(head) and s - shift + begin in olds:
                    stop = s - shift + begin
                    break
                if not whole and m.end() + LOOKAHEAD >= len(window):
                    break  # the match may depend on what is beyond the window
                new.append(m[0])
            else:
                stop = total if whole else None
            if stop is not None:
                break
            margin *= 4
        kept, place = 0, begin
        while place < stop:
            place += len(taken[kept])
            kept += 1
        counts = self.encoder.counts(new)
        self.encoded += len(new)
        self._replace(block, index, kept, list(zip(new, counts, strict=True)))

    def _replace(self, block: int, index: int, gone: int, leaves: list[tuple[str, int]]) -> None:
        """Puts leaves in place of `gone` ones from (block, index) on; only blocks touched are summed again."""
        here = self.blocks[block]
        take = min(gone, len(here) - index)
        here[index : index + take] = leaves
        touched = [block]
        gone -= take
        b = block + 1
        while gone:
            take = min(gone, len(self.blocks[b]))
            del self.blocks[b][:take]
            gone -= take
            touched.append(b)
            b += 1
        if len(here) > 4 * BLOCK:
            self._build([x for b in self.blocks for x in b])
            return
        for b in touched:
            self.chars.put(b, sum(len(p) for p, _ in self.blocks[b]))
            self.tokens.put(b, sum(n for _, n in self.blocks[b]))


class Rule(NamedTuple):
    pattern: str
    replacement: str


def edits_of(text: str, rules: Iterable[Rule]) -> list[Edit]:
    """The edits by which each rule's matches are replaced, one rule after another, each edit against the text before it."""
    out: list[Edit] = []
    for rule in rules:
        shift, parts, last = 0, [], 0
        for m in regex.finditer(rule.pattern, text):
            out.append(Edit(m.start() + shift, m.end() + shift, rule.replacement))
            shift += len(rule.replacement) - (m.end() - m.start())
            parts += [text[last : m.start()], rule.replacement]
            last = m.end()
        text = "".join([*parts, text[last:]])
    return out


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def count_tokens(docs: DataFrame, vocabulary_path: str, pattern: str, edits: Callable[[str], list[Edit]] | None = None, text_col: str = "text") -> DataFrame:
    """docs with n_tokens, n_edits, n_tokens_edited and n_reencoded.

    n_tokens counts the text as it is, n_tokens_edited after the edits that
    `edits` names for it, applied in order; n_reencoded is how many pre-tokens
    these made the tree encode anew. Null and empty texts have no tokens (edits
    are asked for an empty text in their place). Columns of those names get a _
    before. An empty table gives an empty result. Patterns whose matches depend on
    characters far behind them are refused: they raise ValueError.
    """
    names = [fresh(docs, c) for c in ("n_tokens", "n_edits", "n_tokens_edited", "n_reencoded")]

    def run(batches):
        key = (vocabulary_path, pattern)
        if key not in _ENCODERS:
            _ENCODERS[key] = Encoder(*key)
        for b in batches:
            rows: list[tuple[int, int, int, int]] = []
            for _, part in slices(b.column(text_col)):
                for text in part.to_pylist():
                    tree = CountTree(text or "", _ENCODERS[key])
                    before, first = tree.n_tokens, tree.encoded
                    found = edits(text or "") if edits else []
                    for e in found:
                        tree.edit(*e)
                    rows.append((before, len(found), tree.n_tokens, tree.encoded - first))
            for name, values in zip(names, zip(*rows, strict=True) if rows else ((),) * 4, strict=True):
                b = b.append_column(name, pa.array(values, pa.int64()))
            yield b

    return docs.mapInArrow(run, StructType([*docs.schema, *(StructField(n, LongType()) for n in names)]))
