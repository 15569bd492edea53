from __future__ import annotations

import random

import pytest

from framelake.plans import timeline as tl
from framelake.plans.timeline import EditList, Span


def expand(e: EditList) -> list[tuple[int, bool, int]]:
    return [(s.start + k, s.masked, s.source) for s in e.spans for k in range(s.len)]


def random_list(r: random.Random) -> EditList:
    return EditList([(r.randrange(60), r.randrange(1, 12), r.random() < 0.3, r.randrange(2)) for _ in range(r.randrange(1, 8))])


def test_merge_golden_cases():
    e = EditList().merge(10, 10).merge(20, 10).merge(30, 10)
    assert e.spans == [Span(10, 30)]
    assert EditList().merge(10, 10).merge(8, 48).merge(50, 10).spans == [Span(8, 52)]
    assert EditList().add(110, 20).add(100, 20).trim_input(120).spans == [Span(110, 10), Span(100, 20)]
    assert EditList().add(100, 30).mask(10, 10).spans == [Span(100, 10), Span(110, 10, True), Span(120, 10)]
    assert EditList([(0, 10)]).merge(5, 10, masked=True).spans == [Span(0, 10), Span(10, 5, True)]  # what is there wins


def test_direct_mode_golden_cases():
    key = lambda f: f % 5 == 0
    shown = lambda e: [f for f, _, _ in expand(e.direct(key))]
    assert shown(EditList([(0, 10)])) == list(range(10))
    assert shown(EditList([(5, 5)])) == [5, 6, 7, 8, 9]
    assert shown(EditList([(4, 4)])) == list(range(8))
    assert shown(EditList([(15, 10)]).clip(2, 2)) == [15, 16, 17, 18]
    assert shown(EditList([(13, 10)]).clip(2, 2)) == [15, 16]


@pytest.mark.parametrize("seed", range(40))
def test_edits_act_on_the_frames_shown(seed):
    r = random.Random(seed)
    e, other = random_list(r), random_list(r)
    at, n = r.randrange(40), r.randrange(30)
    f = expand(e)
    assert expand(e.delete(at, n)) == f[:at] + f[at + n :]
    assert expand(e.clip(at, n)) == f[at : at + n]
    assert expand(e.insert(at, other)) == f[:at] + expand(other) + f[at:]
    assert expand(e.mask(at, n)) == [(x, m or at <= i < at + n, s) for i, (x, m, s) in enumerate(f)]
    assert expand(e.delete_input(at, n)) == [x for x in f if not at <= x[0] < at + n]
    assert expand(e.trim_input(at)) == [x for x in f if x[0] < at]
    assert expand(e.offset(7)) == [(x + 7, m, s) for x, m, s in f]
    for i in (0, len(f) // 2, len(f) - 1):
        frame, masked, source = e.lookup(i)
        assert (frame, masked, source) == f[i] if not f[i][1] else masked
    assert e.lookup(len(f))[0] == -1
    assert e.find(999) == -1
    for i, x in enumerate(f[:5]):
        assert e.find(x[0]) == min(j for j, y in enumerate(f) if y[0] == x[0])


def table(spark, lists):
    return spark.createDataFrame([(k, *row) for k, e in lists.items() for row in e.rows()], "stream int, ord int, start long, len long, masked boolean, source int").selectExpr("stream", "CAST(ord AS LONG) AS ord", "start", "len", "masked", "source")


def listed(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["stream"], r["ord"])):
        out.setdefault(r["stream"], []).append(Span(r["start"], r["len"], r["masked"], r["source"]))
    return out


def test_frames_like_the_driver_s(spark):
    lists = {k: random_list(random.Random(100 + k)) for k in range(25)}
    t = table(spark, lists)
    others = {k: random_list(random.Random(300 + k)) for k in range(25)}
    cases = [
        (tl.delete_range(t, 7, 9), lambda e, k: e.delete(7, 9)),
        (tl.delete_input_range(t, 20, 15), lambda e, k: e.delete_input(20, 15)),
        (tl.set_range(t, 5, 12), lambda e, k: e.mask(5, 12)),
        (tl.clip(t, 4, 20), lambda e, k: e.clip(4, 20)),
        (tl.insert(t, 6, table(spark, others)), lambda e, k: e.insert(6, others[k])),
        (tl.rescale(t, 1.3, 77), lambda e, k: e.rescale(1.3, 77)),
        (tl.trim_input(t, 30), lambda e, k: e.trim_input(30)),
    ]
    for df, on_driver in cases:
        found = listed(df)
        for k, e in lists.items():
            assert [tuple(s) for s in tl._coalesced(found.get(k, []))] == [tuple(s) for s in tl._coalesced(on_driver(e, k).spans)]
    places = spark.createDataFrame([(k, p) for k in lists for p in range(60)], "stream int, place long")
    for r in tl.lookup(t, places, cell=4).collect():
        want = lists[r["stream"]].lookup(r["place"])
        assert (r["frame"], r["masked"], r["source"]) == want


def test_key_lookup_over_blocks_without_keys(spark):
    keys = {3, 4, 40, 41, 90}
    rows = spark.range(100).selectExpr("0 AS stream", "id AS frame", f"id IN ({', '.join(map(str, keys))}) AS is_key")
    for r in tl.previous_key(rows, block=7).collect():
        f = r["frame"]
        assert r["prev_key"] == max((k for k in keys if k <= f), default=None)
        assert r["next_key"] == min((k for k in keys if k >= f), default=None)
