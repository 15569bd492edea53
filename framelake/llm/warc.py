"""WARC archives: writing with revisit records, and reading verified by boundary chains.

A record is one string, so Spark's text writer makes the archives, with the
blank lines that end a record as its line separator: any file system that Spark
knows, committed as a whole.

Spark's text reader cuts archives at the magic, and splits large files. Each piece
with a readable header is a candidate, which names its successor: where its
content and the blank lines after it end. Pages may quote archives, so the magic
proves nothing. Lengths add up to offsets, and only candidates that the chain from
the file's start reaches are records; it is followed by pointer jumping, which
doubles the distance with every step.

All work on bytes stays in the JVM and reads each byte once: a piece that is
exactly one record is hashed where it is read, true record or quoted one. Only
records whose payload holds the magic lie in several pieces; these, and no
others, are read again and put together.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.llm.workspace import settle

END = "\r\n\r\n"
MAGIC = b"WARC/1.0\r\n"
#: The fixed alphabets of base 32 as Spark's conv() and as RFC 4648 write it.
CONV_DIGITS, BASE32_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
IDENTICAL = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "


def base32_sha1(payload: Column) -> Column:
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*parts), CONV_DIGITS, BASE32_DIGITS)


def _line(name: str, value: Column) -> Column:
    """A header line, or nothing for null; line ends in the value are percent-encoded."""
    safe = F.replace(F.replace(value, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.coalesce(F.concat(F.lit(f"{name}: "), safe, F.lit("\r\n")), F.lit(""))


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", revisit_bytes: int = 0, archive_bytes: int = 64_000_000) -> None:
    """Writes a record per row under path, a null payload as an empty one.

    Of rows with equal payloads of revisit_bytes or more, those with the smallest
    id become responses and the others revisit records without payload that
    refer to it; rows with smaller payloads all become responses. Rows that
    repeat are written as often; a null id or url is left out of the header, and
    a null id counts as larger than any. An empty table gives a folder without archives.
    Archives hold as many records as make about archive_bytes at their mean
    size; a record has less than 2 GB, as every string in Spark.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    rows = rows.withColumns({"digest": base32_sha1(F.col("html").cast("binary")), "bytes": F.octet_length("html").cast("long")})
    # Only payloads that occur more than once need a look-up; the counts combine before the shuffle.
    again = rows.where(F.col("bytes") >= revisit_bytes).groupBy("digest", "bytes").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    # Written first, so that the planner knows its size: while small it is broadcast, and payloads aren't shuffled.
    rows = rows.join(settle(again, "again"), ["digest", "bytes"], "left")
    revisit = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    mean = rows.agg(F.avg("bytes")).first()[0] or 0
    records_per_file = max(1, int(archive_bytes / (mean + 500)))
    http = F.concat(F.lit(_HTTP), F.col("bytes").cast("string"), F.lit(END))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("html")))
    record = F.concat(
        F.lit(MAGIC.decode()),
        _line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.col("id").cast("string"), F.lit(">"))),
        _line("WARC-Target-URI", F.col("url")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        _line("WARC-Profile", F.when(revisit, IDENTICAL)),
        _line("WARC-Refers-To", F.when(revisit, F.concat(F.lit("<urn:page:"), F.col("first").cast("string"), F.lit(">")))),
        _line("Content-Type", F.lit("application/http; msgtype=response")),
        _line("Content-Length", F.octet_length("block").cast("string")),
        F.lit("\r\n"),
        F.col("block"),
    )
    rows.withColumn("block", block).select(record.alias("value")).write.option("lineSep", END).option("maxRecordsPerFile", records_per_file).text(path)


def reachable(offsets: np.ndarray, successors: np.ndarray) -> np.ndarray:
    """Which candidates (by ascending offset) the chain from 0 reaches, by pointer jumping."""
    n = len(offsets)
    at = np.searchsorted(offsets, successors)
    hit = (at < n) & (offsets[np.minimum(at, n - 1)] == successors)
    jump = np.append(np.where(hit, at, n), n)
    seen = np.zeros(n + 1, bool)
    seen[0] = n > 0 and offsets[0] == 0
    while True:
        before = seen.sum()
        seen[jump[seen]] = True
        if seen.sum() == before:
            return seen[:n]
        jump = jump[jump]


#: What is known of a piece of an archive without its bytes.
_PIECE = "file string, block long, row long, size long, head long, content long, page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long"
_RECORD = "file string, offset long, successor long, page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long"
_PART = "file string, row long, offset long, place long, skip long, take long"


def _field(name: str) -> Column:
    """A header line's value; null if there is none."""
    found = F.regexp_extract("h", rf"(?i)(?:\A|\r\n){name}[ \t]*:[ \t]*([^\r\n]*)", 1)
    return F.when(F.col("h").rlike(rf"(?i)(?:\A|\r\n){name}[ \t]*:"), F.rtrim(found))


def _number(text: Column, pattern: str) -> Column:
    """The digits that a pattern finds; null if there are none, or too many for a number."""
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")).try_cast("long")


def _raw(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """(file, block, row, raw): archives cut at the magic. Rows of a block ascend in file order, whenever they are read."""
    cut = spark.read.option("lineSep", MAGIC.decode()).option("pathGlobFilter", glob).text(path)
    return cut.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"), F.col("value").alias("raw"))


def _pieces(raw: DataFrame) -> DataFrame:
    """_PIECE of each row: head is the header's bytes, content those that it states; digest and size of a payload that lies in the row."""
    blank = F.instr("raw", END) > 0
    parts = raw.select("file", "block", "row", "raw", F.octet_length("raw").cast("long").alias("size"), F.when(blank, F.substring_index("raw", END, 1)).alias("h"))
    fields = parts.select("*", F.octet_length("h").cast("long").alias("head"), _number(_field("Content-Length"), r"\A(\d+)\z").alias("content"), F.coalesce(_field("WARC-Type"), F.lit("")).alias("record_type"))
    # The content as far as it is in the row; its own header ends at its first blank line.
    body = F.substring(F.col("raw").cast("binary"), (F.col("head") + 5).cast("int"), F.least("content", "size").cast("int"))
    bodied = fields.withColumn("body", F.when(F.col("content").isNotNull(), body.cast("string")))
    inner = F.instr("body", END) > 0
    bodied = bodied.withColumn("http", F.when(inner, F.substring_index("body", END, 1)))
    start = F.when(inner, F.octet_length("http") + 5).otherwise(1)
    payload = F.substring(F.col("body").cast("binary"), start, F.col("content").cast("int"))
    revisit, whole = F.col("record_type") == "revisit", F.col("size") == F.col("head") + F.col("content") + 8
    page = lambda name: _number(_field(name), r"\A<urn:page:(-?\d+)>\z")
    return bodied.select(
        "file",
        "block",
        "row",
        "size",
        "head",
        "content",
        page("WARC-Record-ID").alias("page_id"),
        _field("WARC-Target-URI").alias("url"),
        "record_type",
        page("WARC-Refers-To").alias("refers_to"),
        F.when(revisit, F.regexp_replace(F.coalesce(_field("WARC-Payload-Digest"), F.lit("")), r"\Asha1:", "")).when(whole, base32_sha1(payload)).alias("payload_digest"),
        F.when(revisit, _number(F.col("http"), r"(?i)content-length: *(\d+)")).when(whole, F.octet_length(payload).cast("long")).alias("payload_bytes"),
    )


def _chained(table: pa.Table) -> tuple[pa.Table, dict[str, np.ndarray]]:
    """A file's pieces in order, and for each where its magic begins, its record would end, and whether the chain reaches it."""
    table = table.sort_by([("block", "ascending"), ("row", "ascending")])
    size = table.column("size").to_numpy()
    # The first piece is what stands before the first magic.
    ends = np.cumsum(size) + len(MAGIC) * np.arange(len(size))
    offset = ends - size - len(MAGIC)
    stated = table.column("content").is_valid().to_numpy() & (np.arange(len(size)) > 0)
    head, content = (table.column(c).fill_null(0).to_numpy() for c in ("head", "content"))
    successor = offset + len(MAGIC) + head + content + 8
    candidate = np.flatnonzero(stated & (successor <= ends[-1]))
    reached = np.zeros(len(size), bool)
    reached[candidate] = reachable(offset[candidate], successor[candidate])
    return table, {"offset": offset, "successor": successor, "reached": reached, "ends": ends}


def _records(table: pa.Table) -> pa.Table:
    table, x = _chained(table)
    at = pa.array(np.flatnonzero(x["reached"]))
    kept = table.take(at).append_column("offset", pa.array(x["offset"][at])).append_column("successor", pa.array(x["successor"][at]))
    return kept.select([f.split()[0] for f in _RECORD.split(", ")])


def _parts(table: pa.Table) -> pa.Table:
    """The pieces of records that lie in several, in order, with the bytes to skip at the first and to take in all."""
    table, x = _chained(table)
    rows, file = table.column("row").to_numpy(), table.column("file")[0].as_py()
    revisit = np.array([t == "revisit" for t in table.column("record_type").to_pylist()])
    several = np.flatnonzero(x["reached"] & ~revisit & (x["successor"] != x["ends"]))
    head, content = (table.column(c).fill_null(0).to_numpy() for c in ("head", "content"))
    counts = np.searchsorted(x["offset"], x["successor"][several]) - several
    first = np.repeat(several, counts)
    place = np.arange(len(first)) - np.repeat(np.cumsum(counts) - counts, counts)
    out = (rows[first + place], x["offset"][first], place, head[first] + 4, content[first])
    return pa.table([pa.array([file] * len(out[0]), pa.string()), *(pa.array(c, pa.int64()) for c in out)], names=[f.split()[0] for f in _PART.split(", ")])


def _joined(table: pa.Table) -> pa.Table:
    """Digest and size of one record's payload, put together from its pieces."""
    table = table.sort_by("place")
    skip, take = table.column("skip")[0].as_py(), table.column("take")[0].as_py()
    content = MAGIC.join(x.as_py() for x in table.column("raw"))[skip : skip + take]
    payload = content[content.find(b"\r\n\r\n") + 4 :] if b"\r\n\r\n" in content else content
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    return pa.table({"file": table.column("file").slice(0, 1), "offset": table.column("offset").slice(0, 1), "whole_digest": [digest], "whole_bytes": pa.array([len(payload)], pa.int64())})


def read_archives(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """The records under path, of files whose name matches glob and doesn't begin with _ or ., that are reachable from their file's start.

    Columns: file, offset, successor, page_id, url, record_type, refers_to,
    payload_digest and payload_bytes; the last two are computed from a response's
    payload, and for a revisit are those it states. What isn't stated is null. A
    chain that breaks (a cut or damaged file, or a header that itself holds the
    magic) ends there. Files are split as Spark splits text; what meets in a task
    are a file's offsets and header fields, without payloads.
    """
    raw = _raw(spark, path, glob)
    pieces = settle(_pieces(raw), "pieces")
    records = pieces.groupBy("file").applyInArrow(_records, _RECORD)
    if not pieces.where("content IS NOT NULL AND record_type <> 'revisit' AND payload_digest IS NULL").limit(1).count():
        return records
    parts = settle(pieces.select("file", "block", "row", "size", "head", "content", "record_type").groupBy("file").applyInArrow(_parts, _PART), "parts")
    again = raw.select("file", "row", F.col("raw").cast("binary").alias("raw")).join(parts, ["file", "row"])
    whole = again.groupBy("file", "offset").applyInArrow(_joined, "file string, offset long, whole_digest string, whole_bytes long")
    out = records.join(whole, ["file", "offset"], "left")
    given = {"payload_digest": "whole_digest", "payload_bytes": "whole_bytes"}
    return out.select(*(F.coalesce(given[c], c).alias(c) if c in given else c for c in records.columns))
