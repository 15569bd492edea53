"""Hashed sparse text features for the classifiers, and the bounded labelled sample they are fitted on.

A token is a run of letters and digits (bytes from 0x80 count as letters) or a
run of other printable bytes; A-Z are lower-cased.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.llm.textops import FIXED, FOLD, SPACES, U64, Words, doc_of, mix, text_bytes, word_hashes
from framelake.llm.workspace import settle

_CLASS = np.full(256, 2, np.uint8)
_CLASS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_CLASS[SPACES] = 0


class Rows(NamedTuple):
    """Sparse rows: row i has buckets[offs[i]:offs[i + 1]], with values where they matter."""

    buckets: np.ndarray
    offs: np.ndarray

    def row(self, i: int) -> np.ndarray:
        return self.buckets[self.offs[i] : self.offs[i + 1]]


def cut_tokens(column: pa.Array) -> Words:
    data, offs = text_bytes(column)
    data = FOLD[data]
    kind = _CLASS[data]
    n = len(data)
    edge = np.ones(n + 1, bool)
    edge[1:n] = kind[1:] != kind[:-1]
    edge[offs] = True
    at = np.flatnonzero(edge)
    starts, ends = at[:-1], at[1:]
    solid = kind[starts] > 0 if n else np.zeros(0, bool)
    starts, ends = starts[solid], ends[solid]
    return Words(data, starts, ends, np.searchsorted(starts, offs))


def _bucket(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> U64(64 - bits)).astype(np.int64)


def ngram_indicators(column: pa.Array, bits: int) -> Rows:
    """Distinct buckets of each text's token unigrams and bigrams, ascending."""
    words = cut_tokens(column)
    h = mix(word_hashes(words, FIXED.word))
    doc = doc_of(np.arange(len(h)), words.first)
    pair = np.flatnonzero(doc[1:] == doc[:-1])
    keys = np.concatenate((doc << bits | _bucket(h, bits), doc[pair] << bits | _bucket(mix(h[pair] * U64(FIXED.run) + h[pair + 1]), bits)))
    keys = np.unique(keys)
    return Rows((keys & (1 << bits) - 1).astype(np.uint32), np.searchsorted(keys, np.arange(len(words.first)) << bits))


#: Bytes of the word beginnings that count as features beside whole words.
PREFIXES = (4, 5, 6, 7, 8)


def word_parts(column: pa.Array, bits: int) -> tuple[list[np.ndarray], Words]:
    """For whole words and for each prefix length, the bucket of every token, -1 where a token isn't longer than the prefix."""
    words = cut_tokens(column)
    out = [_bucket(mix(word_hashes(words, FIXED.word)), bits)]
    for size in PREFIXES:
        bucket = np.full(len(words.starts), -1, np.int64)
        long = np.flatnonzero(words.ends - words.starts > size)
        code = np.zeros(len(long), U64)
        for i in range(size):
            code = code * U64(FIXED.word) + words.data[words.starts[long] + i].astype(U64) + U64(1)
        bucket[long] = _bucket(mix(code ^ U64(size)), bits)
        out.append(bucket)
    return out, words


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, wanted: Column, most: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(text, y) of at most `most` labelled rows where wanted (of id) holds, chosen by a hash of the id.

    The chosen ids, at most `most`, are broadcast to the scan of docs; null ids,
    labels and texts are left out, and of an id's several labels the largest counts.
    """
    chosen = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull()).where(wanted).groupBy(F.col(id_col).alias("id_")).agg(F.max(label).cast("int").alias("y"))
    # Written first: the choice then meets in a task, where a broadcast would gather `most` rows of every partition on the driver.
    chosen = settle(chosen.orderBy(F.xxhash64("id_"), "id_").limit(most), "chosen")
    rows = docs.select(F.col(id_col).alias("id_"), F.col(text_col).alias("text")).where("text is not null").join(F.broadcast(chosen), "id_")
    # The order goes by hashes: a sort by texts would sample them, whole, on the driver.
    return rows.orderBy(F.xxhash64("id_"), "id_", F.xxhash64("text")).select("text", "y")
