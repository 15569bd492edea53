from __future__ import annotations

import base64
import hashlib
import time

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from framelake.llm.warc import base32_sha1, reachable, read_archives, write_archives

INNER = "WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"


def pages():
    same = "<p>same</p>"
    rows = [(i, f"http://a/{i}", same) for i in range(20, 0, -1)]  # a group of equal payloads
    rows += [(100, "http://b", None), (101, None, ""), (102, "http://c\r\nX: y", f"<pre>{INNER}</pre>{INNER}"), (103, "u", INNER), (104, "u", INNER)]
    rows += [(105, "u", "é中" * 5000), (106, "u", "x" * 200_000), (107, "u", "\r\n\r\nWARC/1.0\r\n"), (None, "u", "no id")]
    return rows + [(1, "http://a/1", same)]


@pytest.fixture(params=["whole", "split"])
def splits(request, spark):
    """Files read whole, or in splits far smaller than a record."""
    if request.param == "split":
        spark.conf.set("spark.sql.files.maxPartitionBytes", "701b")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_round_trip(spark, tmp_path, splits):
    rows = pages()
    write_archives(spark.createDataFrame([(*r, 7) for r in rows], "page_id long, url string, html string, digest int"), str(tmp_path / "w"), archive_bytes=9_000)
    found = read_archives(spark, str(tmp_path / "w")).collect()
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    want = []
    for i, u, h in rows:
        raw = (h or "").encode()
        again = h != "no id" and i != first[h or ""]
        url = u.replace("\r", "%0D").replace("\n", "%0A") if u is not None else None
        want.append((i, url, "revisit" if again else "response", first[h or ""] if again else None, base64.b32encode(hashlib.sha1(raw).digest()).decode(), len(raw)))
    got = [(r["page_id"], r["url"], r["record_type"], r["refers_to"], r["payload_digest"], r["payload_bytes"]) for r in found]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert len({r["file"] for r in found}) > 2


def test_limit_and_empty(spark, tmp_path):
    write_archives(spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "long enough"), (4, "u", "long enough")], "page_id long, url string, html string"), str(tmp_path / "a"), revisit_bytes=5)
    assert sorted((r["page_id"], r["record_type"]) for r in read_archives(spark, str(tmp_path / "a")).collect()) == [(1, "response"), (2, "response"), (3, "response"), (4, "revisit")]
    write_archives(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "b"))
    assert read_archives(spark, str(tmp_path / "b")).count() == 0


@pytest.mark.parametrize("size", range(11, 60, 7))
def test_splits_anywhere_in_the_magic(spark, tmp_path, size):
    write_archives(spark.createDataFrame([(i, "u", f"{INNER}{i}" + "WARC/1.0WARC/1.0\r\n" * (i % 3)) for i in range(4)], "page_id long, url string, html string").coalesce(1), str(tmp_path / "w"))
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", f"{size}b")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        found = read_archives(spark, str(tmp_path / "w")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    want = [f"{INNER}{i}" + "WARC/1.0WARC/1.0\r\n" * (i % 3) for i in range(4)]
    assert sorted((r["page_id"], r["payload_digest"]) for r in found) == [(i, base64.b32encode(hashlib.sha1(w.encode()).digest()).decode()) for i, w in enumerate(want)]


def test_any_name_but_hidden_ones(spark, tmp_path):
    write_archives(spark.createDataFrame([(1, "u", "a")], "page_id long, url string, html string").coalesce(1), str(tmp_path / "w"))
    raw = next((tmp_path / "w").glob("part-*")).read_bytes()
    folder = tmp_path / "other"
    folder.mkdir()
    for name in ("crawl-1.warc", "b", "_hidden.warc", ".hidden"):
        (folder / name).write_bytes(raw)
    (folder / "text.warc").write_bytes(b"no archive" + raw)
    (folder / "empty.warc").write_bytes(b"")
    assert sorted(r["file"].rsplit("/", 1)[-1] for r in read_archives(spark, str(folder)).collect()) == ["b", "crawl-1.warc"]
    assert read_archives(spark, str(folder), "*.warc").count() == 1


def test_a_page_of_magics_is_read_once(spark, tmp_path):
    """Two megabytes of quoted magics without a blank line, and as many of quoted records: time follows the bytes."""
    pages = ["WARC/1.0\r\n" * 200_000, INNER * 30_000, "x" * 2_000_000]
    docs = spark.createDataFrame([(i, "u", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    write_archives(docs, str(tmp_path / "w"))
    began = time.perf_counter()
    found = sorted((r["page_id"], r["payload_digest"], r["payload_bytes"]) for r in read_archives(spark, str(tmp_path / "w")).collect())
    assert time.perf_counter() - began < 20
    assert found == [(i, base64.b32encode(hashlib.sha1(p.encode()).digest()).decode(), len(p)) for i, p in enumerate(pages)]


def test_cut_archive_ends_where_its_chain_breaks(spark, tmp_path):
    folder = tmp_path / "w"
    write_archives(spark.createDataFrame([(i, "u", f"{INNER}{i}") for i in range(9)], "page_id long, url string, html string").coalesce(1), str(folder), revisit_bytes=10**6)
    file = next(folder.glob("part-*"))
    whole = file.read_bytes()
    starts = sorted(r["offset"] for r in read_archives(spark, str(folder)).collect())
    assert len(starts) == 9
    (folder / f".{file.name}.crc").unlink()
    file.write_bytes(whole[: starts[5] + 40])
    assert sorted(r["offset"] for r in read_archives(spark, str(folder)).collect()) == starts[:5]


@given(st.lists(st.tuples(st.integers(0, 40), st.integers(1, 12)), max_size=30, unique_by=lambda x: x[0]))
def test_reachable(candidates):
    candidates = sorted(candidates)
    succ = {o: o + s for o, s in candidates}
    want, at = set(), 0
    while at in succ:
        want.add(at)
        at = succ[at]
    found = reachable(np.array([o for o, _ in candidates], np.int64), np.array([o + s for o, s in candidates], np.int64))
    assert {o for (o, _), hit in zip(candidates, found, strict=True) if hit} == want


def test_base32(spark):
    texts = ["", "a", "é" * 100]
    found = [r["d"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(base32_sha1(__import__("pyspark").sql.functions.col("t").cast("binary")).alias("d")).collect()]
    assert found == [base64.b32encode(hashlib.sha1(t.encode()).digest()).decode() for t in texts]
