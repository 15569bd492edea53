"""Benchmark decontamination by containment search over size-partitioned MinHash sketches.

Everything is a DataFrame expression. A test item is short and a document may be
ten thousand times longer, so their Jaccard similarity says nothing, and fixed
size signatures of long documents would miss most items. Therefore:

* items are partitioned by size (powers of two of their shingle counts); an
  item's sketch is its bottom-k MinHash, k being one more than the shingles that
  it may lack (k = n - ceil(n * percent / 100) + 1). A document that contains
  enough of the item must, by the pigeonhole principle, contain one of any k of
  its shingles, so the sketch misses nothing. Shingles that many items share
  come last, so that one in every item doesn't bring every item to a document;
* a partition's threshold is the largest hash in its sketches. A document's
  sketch for it is all its shingle hashes up to that, cut before anything is
  exploded, and meets the partition's sketches in an equi-join. Where all
  sketches together are few (they are counted), the hashes themselves are the
  filter, a set literal, and only shingles that some sketch holds are exploded;
* a pair that meets is verified on the shingles themselves, over whole texts:
  the pair's item shingles are joined with the shingles of the documents that met
  any item, on document and shingle, and counted. No key of that join is frequent,
  and no row gathers sets.

Small tables are broadcast only when their counted rows are below a bound; else
the joins are shuffled ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.llm import native
from framelake.llm.workspace import settle

#: Rows (about 100 bytes each) up to which a table is broadcast.
BROADCAST_ROWS = 200_000
#: Hashes up to which a filter is a set literal.
SET_HASHES = 20_000
#: A shingle that more items share is taken into a sketch last.
COMMON = 16


def _broadcast(df: DataFrame) -> DataFrame:
    """A written table, to be broadcast if it is small."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _shingled(items: DataFrame, n: int) -> DataFrame:
    """(item, name, s, h): the distinct shingles of each item and their hashes."""
    w = items.select("item", "name", native.words(F.col("text")).alias("w"))
    pairs = F.arrays_zip(native.shingles("w", n).alias("s"), native.shingle_hashes("w", n).alias("h"))
    return w.select("item", "name", F.explode(F.array_distinct(pairs)).alias("x")).select("item", "name", "x.s", "x.h")


def _sketches(shingled: DataFrame, percent: int) -> DataFrame:
    """(item, size_class, h): each item's bottom-k hashes, shared ones last."""
    common = shingled.groupBy("h").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > COMMON).select("h", F.lit(True).alias("common"))
    order = F.struct(F.coalesce("common", F.lit(False)).alias("common"), "h")
    hashed = shingled.join(common, "h", "left").groupBy("item").agg(F.array_sort(F.collect_set(order)).alias("hs"))
    k = F.size("hs") - F.ceil(F.size("hs") * F.lit(percent) / 100).cast("int") + 1
    return hashed.select("item", F.floor(F.log2(F.size("hs"))).cast("int").alias("size_class"), F.explode(F.slice("hs", F.lit(1), k)).alias("x")).select("item", "size_class", "x.h")


def _few(hashes: DataFrame) -> list[int] | None:
    """The distinct hashes of a written table, if they are at most SET_HASHES."""
    found = hashes.select("h").distinct().limit(SET_HASHES + 1).collect()
    return [r["h"] for r in found] if len(found) <= SET_HASHES else None


def _in_set(array: str, field: str, hashes: list[int]) -> Column:
    """The elements of an array of which the hash is one of so many."""
    return F.expr(f"filter({array}, x -> x{field} IN ({', '.join(f'{h}L' if h > -(1 << 63) else 'bigint(-9223372036854775808)' for h in hashes)}))") if hashes else F.slice(array, 1, 0)


def _own(text: Column) -> Column:
    """What tells rows of one id, or without an id, apart: their text."""
    return F.sha2(text.cast("binary"), 256)


def _pairs(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str, n: int, percent: int) -> DataFrame:
    """(id, own, item, n_item, n_shared) for each different row of docs and each different text of an item that it holds."""
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("own", _own(F.col("text")))
    texts = settle(items.select(F.col(item_col).alias("name"), F.col(item_text_col).alias("text")).distinct().withColumn("item", F.monotonically_increasing_id()), "items")
    shingled = settle(_shingled(texts, n), "shingles")
    sketches = settle(_sketches(shingled, percent), "sketches")
    hashes = d.select("id", "own", native.words(F.col("text")).alias("w")).select("id", "own", native.shingle_hashes("w", n).alias("hs"))
    few = _few(sketches)
    if few is not None:
        low, on = hashes.select("id", "own", F.explode(_in_set("hs", "", few)).alias("h")), ["h"]
    else:
        limits = sketches.groupBy("size_class").agg(F.max("h").alias("limit")).collect()  # a row per power of two
        low = hashes.select("id", "own", F.explode(_per_class(limits)).alias("x")).select("id", "own", "x.size_class", "x.h")
        on = ["size_class", "h"]
    met = settle(low.join(_broadcast(sketches), on).select("id", "own", "item").distinct(), "met")
    # The shingles of documents that met anything, those that items have.
    some = _broadcast(settle(met.select(F.col("id").alias("m_id"), F.col("own").alias("m_own")).distinct(), "some"))
    same = F.col("id").eqNullSafe(F.col("m_id")) & (F.col("own") == F.col("m_own"))
    w = d.join(some, same, "left_semi").distinct().select("id", "own", native.words(F.col("text")).alias("w"))
    zipped = w.select("id", "own", F.arrays_zip(native.shingles("w", n).alias("s"), native.shingle_hashes("w", n).alias("h")).alias("x"))
    few = _few(shingled)
    found = _in_set("x", ".h", few) if few is not None else F.col("x")
    held = zipped.select("id", "own", F.explode(F.array_distinct(found)).alias("x")).select(F.col("id").alias("h_id"), F.col("own").alias("h_own"), F.col("x.s").alias("h_s"))
    sizes = shingled.groupBy("item").agg(F.count(F.lit(1)).alias("n_item"))
    wanted = met.join(_broadcast(shingled), "item")
    counted = wanted.join(held, F.col("id").eqNullSafe(F.col("h_id")) & (F.col("own") == F.col("h_own")) & (F.col("s") == F.col("h_s")))
    shared = counted.groupBy("id", "own", "item", "name").agg(F.count(F.lit(1)).alias("n_shared"))
    pairs = shared.join(sizes, "item").where(F.col("n_shared") * 100 >= F.col("n_item") * percent)
    return pairs.select("id", "own", F.col("name").alias("item"), "n_item", "n_shared")


def _per_class(limits: list) -> Column:
    """Of hashes hs, (size_class, h) for each size partition and each hash up to its threshold."""

    def cut(size_class: int, limit: int) -> Column:
        return F.transform(F.filter("hs", lambda h: h <= F.lit(limit)), lambda h: F.struct(F.lit(size_class).alias("size_class"), h.alias("h")))

    return F.flatten(F.array(*(cut(r["size_class"], r["limit"]) for r in limits)))


def find_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """Pairs (id, item id, n_item, n_shared): documents that hold at least percent % of an item's distinct n-word shingles.

    A-Z count as a-z; a text with fewer than n words is one shingle. Null and
    empty texts have no shingles and are in no pair. Rows that repeat give their
    pair once; rows of one id with different texts are one document that holds
    what any of its rows holds enough of (the largest n_shared counts). Each text
    of an item id is searched; a pair's figures are those of the text of which
    most is shared. Null ids, of documents or items, are searched and reported
    like others.
    """
    kept = _pairs(docs, items, id_col, text_col, item_col, item_text_col, n, percent)
    most = kept.groupBy("id", "item").agg(F.max(F.struct("n_shared", "n_item")).alias("most"))
    return most.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "most.n_item", "most.n_shared")


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """docs without the rows that hold an item; all else, rows with null texts too, stays as it is. Of rows that share an id, those go that hold one."""
    found = _pairs(docs, items, id_col, text_col, item_col, item_text_col, n, percent).select(F.col("id").alias("found_id_"), F.col("own").alias("found_own_")).distinct()
    return docs.join(found, F.col(id_col).eqNullSafe(F.col("found_id_")) & (_own(F.col(text_col)) == F.col("found_own_")), "left_anti")
