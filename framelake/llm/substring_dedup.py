"""Substring deduplication: count-min prefilter, then exact grouping of what it leaves.

Every document belongs to a chunk of some megabytes, named by a hash of its id
and text. Chunks are shuffled once; Spark reuses that exchange in all passes:

1. Each chunk hashes its windows and sends their cells to the sketch
   (`framelake.llm.sketch`); the merged sketch answers with levels.
2. Windows whose level says "perhaps twice" go, once per chunk with their
   fingerprint, to tasks that own a range of fingerprints, which group them and
   answer with a bit for each. The sketch never underestimates, so no repeated
   window is lost.
3. Each chunk removes every word covered by a repeated window.

Windows are grouped by fingerprints of twice 61 bits, polynomials of words at
four bases drawn for the run (`framelake.llm.textops`): whatever the texts, two
given different windows agree with a probability of about 36**2 / 2**122, and any
two of the 1e13 windows of 100 TB with one of about 2**-25.

Fingerprints are packed per chunk and range, so a window that a third of all
rows hold is one entry a chunk. No key gathers rows.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import LongType, StringType, StructField, StructType

from framelake.llm import sketch
from framelake.llm.textops import U64, Words, cut_words, doc_of, draw, give_back, join_words, runs_of, text_bytes, to_strings, word_hashes
from framelake.llm.workspace import executor_bytes, fresh, partitions, settle

CHUNK_BYTES = 2_000_000
RANGE_KEYS = 500_000


class Chunks(NamedTuple):
    dealt: DataFrame  # docs with the name of each row's chunk, dealt out by it
    number: int
    bytes: int
    scale: int  # of chunks and ranges (sketch.scale_of)


def chunked(docs: DataFrame, id_col: str, text_col: str, chunk_col: str) -> Chunks:
    """docs in chunks of about CHUNK_BYTES times the scale, by a hash of id and text.

    Rows that repeat, id and all, would share a chunk however many they are;
    where such a group is larger than a chunk, its rows are numbered, and the
    numbered rows written, so that a repeated task finds the same numbers.
    """
    spark = docs.sparkSession
    whole = [F.col(id_col), F.col(text_col)]
    alike = docs.groupBy(F.xxhash64(*whole).alias("h")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(F.octet_length(text_col), F.lit(0)) + 32).alias("b"))
    size = alike.agg(F.sum("b").alias("b"), F.max(F.when(F.col("n") > 1, F.col("b"))).alias("most")).first()
    scale = sketch.scale_of(size["b"] or 0, executor_bytes(spark))
    number = max(1, (size["b"] or 0) // (CHUNK_BYTES * scale))
    if (size["most"] or 0) > CHUNK_BYTES * scale:
        docs = settle(docs.withColumn(chunk_col, F.monotonically_increasing_id()), "numbered")
        whole.append(F.col(chunk_col))
    key = F.pmod(F.xxhash64(*whole), F.lit(number).cast("long"))
    return Chunks(docs.withColumn(chunk_col, key).repartition(partitions(spark), chunk_col), number, size["b"] or 0, scale)


def remove_repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35, depth: int = 2) -> DataFrame:
    """Removes each word covered by a window of `window` words that also starts anywhere else.

    Returns all columns of docs, with the kept words joined by one space as the
    text, plus n_words and n_removed (prefixed with _ where docs has such
    columns already). Null and empty texts give an empty text and zeros; a text
    shorter than the window stays. Rows that repeat, ids included, are documents
    like any others. An empty table gives an empty result.
    """
    words_col, removed_col, chunk_col = fresh(docs, "n_words"), fresh(docs, "n_removed"), fresh(docs, "chunk")
    dealt, _, size, scale = chunked(docs, id_col, text_col, chunk_col)
    expected = max(1, size // 6)
    plan = sketch.plan_sketch(expected, depth, scale)
    exact = max(1, expected // (RANGE_KEYS * scale))
    exact_edges = np.array([(r << 64) // exact for r in range(1, exact)], U64)
    bases, others = draw(), draw()
    fields = list(docs.schema)
    out_schema = StructType([*(StructField(f.name, StringType() if f.name == text_col else f.dataType, True) for f in fields), StructField(words_col, LongType()), StructField(removed_col, LongType())])

    def look(table: pa.Table) -> tuple[Words, np.ndarray, np.ndarray]:
        give_back()
        words = cut_words(*text_bytes(table.column(text_col)))
        keys, at = runs_of(word_hashes(words, bases.word), words.first, window, bases.run)
        return words, keys, at

    def send(table: pa.Table) -> pa.Table:
        _, keys, _ = look(table)
        keys, counts = sketch.distinct(keys)
        return sketch.send(table.column(chunk_col)[0].as_py(), keys, counts, plan)

    def suspects(words: Words, keys: np.ndarray, at: np.ndarray, answers: dict[int, bytes]):
        """Windows that the sketch can't rule out: where they start, and their distinct fingerprints in order."""
        distinct, inverse = np.unique(keys, return_inverse=True)
        maybe = (sketch.levels(distinct, answers, plan) > 1)[inverse]
        at, keys = at[maybe], keys[maybe]
        second, all_at = runs_of(word_hashes(words, others.word), words.first, window, others.run)
        second = second[np.searchsorted(all_at, at)]
        order = np.lexsort((second, keys))
        a, b = keys[order], second[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        head = np.flatnonzero(new)
        entry = np.empty(len(at), np.int64)
        entry[order] = np.cumsum(new) - 1
        counts = np.diff(head, append=len(a))
        edges = np.concatenate(([0], np.searchsorted(a[head], exact_edges), [len(head)]))
        return at, entry, a[head], b[head], counts, edges

    def send_suspects(table: pa.Table, answered: pa.Table) -> pa.Table:
        slots, payloads, chunk = [], [], None
        if len(table) and len(answered):
            chunk = table.column(chunk_col)[0].as_py()
            _, _, a, b, counts, edges = suspects(*look(table), _answers(answered))
            for r in np.flatnonzero(np.diff(edges)):
                lo, hi = edges[r], edges[r + 1]
                slots.append(int(r))
                payloads.append(a[lo:hi].tobytes() + b[lo:hi].tobytes() + np.packbits(counts[lo:hi] > 1).tobytes())
        return pa.table({"slot": pa.array(slots, pa.int32()), "chunk": pa.array([chunk] * len(slots), pa.int64()), "payload": pa.array(payloads, pa.binary())})

    def group_exactly(table: pa.Table) -> pa.Table:
        give_back()
        first, second, twice = [], [], []
        for raw in table.column("payload").to_pylist():
            n = _entries(len(raw))
            first.append(np.frombuffer(raw, U64, n))
            second.append(np.frombuffer(raw, U64, n, 8 * n))
            twice.append(np.unpackbits(np.frombuffer(raw, np.uint8, -1, 16 * n), count=n).astype(bool))
        sizes = [len(x) for x in first]
        a, b, more = np.concatenate(first), np.concatenate(second), np.concatenate(twice)
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        same = np.zeros(len(a) + 1, bool)
        same[1:-1] = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
        repeated = np.empty(len(a), bool)
        repeated[order] = same[1:] | same[:-1]
        repeated |= more
        bits = [np.packbits(x).tobytes() for x in np.split(repeated, np.cumsum(sizes)[:-1])]
        slots = pa.array(-1 - table.column("slot").to_numpy().astype(np.int32))
        return pa.table({"chunk": table.column("chunk"), "slot": slots, "payload": pa.array(bits, pa.binary())})

    def clean(table: pa.Table, answered: pa.Table) -> pa.Table:
        words, keys, at = look(table)
        covered = np.zeros(len(words.starts) + 1, np.int64)
        answers = _answers(answered)
        if len(keys):
            at, entry, a, _, _, edges = suspects(words, keys, at, answers)
            bits = [np.unpackbits(np.frombuffer(answers[-1 - int(r)], np.uint8), count=int(edges[r + 1] - edges[r])) for r in np.flatnonzero(np.diff(edges))]
            repeated = np.concatenate([*bits, np.zeros(0, np.uint8)]).astype(bool)
            hit = at[repeated[entry]]
            np.add.at(covered, hit, 1)
            np.subtract.at(covered, hit + window, 1)
        gone = np.cumsum(covered[:-1]) > 0
        n_docs = len(words.first) - 1
        removed = np.bincount(doc_of(np.flatnonzero(gone), words.first), minlength=n_docs)[:n_docs]
        text = to_strings(*join_words(words, ~gone))
        columns = [text if f.name == text_col else table.column(f.name).cast(to_arrow_type(f.dataType)) for f in fields]
        return pa.table([*columns, pa.array(words.per_doc, pa.int64()), pa.array(removed, pa.int64())], names=out_schema.names)

    sent = dealt.groupBy(chunk_col).applyInArrow(send, sketch.SENT)
    answers = sent.groupBy("slot").applyInArrow(lambda table: sketch.merge(table, plan.width), sketch.ANSWERED)
    by_chunk = lambda df: df.groupBy("chunk")
    suspected = dealt.groupBy(chunk_col).cogroup(by_chunk(answers)).applyInArrow(send_suspects, sketch.SENT)
    repeated = suspected.groupBy("slot").applyInArrow(group_exactly, sketch.ANSWERED)
    return dealt.groupBy(chunk_col).cogroup(by_chunk(answers.unionByName(repeated))).applyInArrow(clean, out_schema)


def _entries(size: int) -> int:
    """n of a payload of 16 * n bytes and n bits in whole bytes."""
    n = size * 8 // 129
    while 16 * n + (n + 7) // 8 > size:
        n -= 1
    while 16 * (n + 1) + (n + 8) // 8 <= size:
        n += 1
    return n


def _answers(table: pa.Table) -> dict[int, bytes]:
    return dict(zip(table.column("slot").to_pylist(), table.column("payload").to_pylist(), strict=True))

