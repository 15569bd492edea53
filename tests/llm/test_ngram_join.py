from __future__ import annotations

import pytest

from framelake.llm import ngram_join
from framelake.llm.components import components
from framelake.llm.ngram_join import link_near_duplicates, similar_sets
from tests.llm.corpus import documents, prose, thue_morse, words


def sets(rows, n=5):
    out = []
    for key, text in rows:
        w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        out.append((key, {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set())))
    return out


def brute(rows, percent=80):
    s = sets(rows)
    parent = list(range(len(s)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (_, a) in enumerate(s):
        for j in range(i):
            b = s[j][1]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[find(i)] = find(j)
    least = {}
    for i, (key, _) in enumerate(s):
        least[find(i)] = min(least.get(find(i), key), key)
    return sorted((key, len(a), least[find(i)]) for i, (key, a) in enumerate(s))


def run(spark, rows, **options):
    found = link_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), **options)
    return sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found.collect())


def test_against_brute_force(spark):
    assert run(spark, documents()) == brute(documents())


def families():
    """Families of near copies, with edits around the threshold."""
    rows = []
    for family in range(4):
        base = prose(50 + family, 120, 60).split()
        for i in range(22):
            w = list(base)
            for k in range(i % 7):
                w[(i * 13 + k * 31) % 120] = f"y{i}{k}"
            rows.append((1000 * family + i, " ".join(w)))
    return rows


@pytest.mark.parametrize("leaders", [True, False])
@pytest.mark.parametrize("broadcast_rows", [200_000, 0])
def test_small_groups_and_borderline_copies(spark, monkeypatch, leaders, broadcast_rows):
    """Groups of four nodes, so that the reducer, splits and the matrix all take part; without the reducer and with salted keys the result is the same."""
    for name, value in (("GROUP", 4), ("LEADERS", 1), ("ASKERS", 3), ("BROADCAST_ROWS", broadcast_rows)):
        monkeypatch.setattr(ngram_join, name, value)
    rows = families()
    assert run(spark, rows, leaders=leaders) == brute(rows)


@pytest.mark.parametrize("group", [4, 256])
def test_every_link(spark, monkeypatch, group):
    monkeypatch.setattr(ngram_join, "GROUP", group)
    monkeypatch.setattr(ngram_join, "ASKERS", 2 * group)
    rows = [(i, text) for i, (_, text) in enumerate(families() + documents())]
    members, links = similar_sets(spark.createDataFrame(rows, "doc_id long, text string"))
    of = {key: frozenset(a) for key, a in sets(rows)}
    ids, distinct = {}, set(of.values())
    for r in members.collect():
        a = of[r["doc_id"]]
        assert r["n_shingles"] == len(a) and (r["set"] is None) == (not a)
        assert ids.setdefault(a, bytes(r["set"] or b"")) == bytes(r["set"] or b"")
    some = [a for a in distinct if a]
    want = {}
    for i, a in enumerate(some):
        for b in some[:i]:
            if 100 * len(a & b) >= 80 * len(a | b):
                want[frozenset((ids[a], ids[b]))] = len(a & b)
    got = [(frozenset((bytes(r["a"]), bytes(r["b"]))), r["n_shared"]) for r in links.collect()]
    assert len(got) == len(set(got)) > 100 and dict(got) == want


def test_words_that_collide_under_any_base_of_a_power_of_two(spark):
    rows = [(10 * k + i, w) for k in range(3) for i, w in enumerate(thue_morse(1_024 << k))] + [(99, thue_morse(2_048)[1])]
    rows += [(200 + i, " ".join(w)) for i, w in enumerate(thue_morse(4))]
    assert run(spark, rows) == brute(rows)


def test_empty_and_null(spark):
    schema = "doc_id long, text string, node string, n int"
    assert link_near_duplicates(spark.createDataFrame([], schema)).count() == 0
    members, links = similar_sets(spark.createDataFrame([], schema))
    assert members.count() == links.count() == 0
    rows = [(7, None, None, None), (8, "", "x", 1), (9, "only", None, 2), (3, "ONLY", None, 2), (None, "apart", None, None)]
    found = link_near_duplicates(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"]) for r in found) == [(-1, 1, None), (3, 1, 3), (7, 0, 7), (8, 0, 8), (9, 1, 3)]


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 60)] + [(100, 101), (101, 100)]])
def test_components(spark, edges):
    found = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    values = spark.range(200).selectExpr("id AS node", "CASE WHEN id % 7 > 0 THEN -id END AS value")
    valued = {r["node"]: r["value"] for r in components(spark.createDataFrame(edges, "a long, b long"), values=values).collect()}
    want = {}
    for a, b in edges:
        want.setdefault(a, {a}).add(b)
        want.setdefault(b, {b}).add(a)
    for n in want:
        reach, todo = {n}, [n]
        while todo:
            for m in want[todo.pop()] - reach:
                reach.add(m)
                todo.append(m)
        assert found[n] == min(reach) and valued[n] == min((-x for x in reach if x % 7), default=None)
    assert len(found) == len(want)
