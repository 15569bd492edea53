from __future__ import annotations

from framelake.llm import decontaminate
from framelake.llm.decontaminate import drop_contaminated, find_contaminated
from tests.llm.corpus import documents, prose
from tests.llm.test_ngram_join import sets


def tables(spark):
    items = [(i, prose(500 + i, 15 + i, 200)) for i in range(20)] + [(90, None), (91, ""), (92, "one two three"), (93, "a b c d e"), (0, prose(500, 15, 200))]
    docs = documents()
    for i in range(20):  # whole, with some words changed, in long surroundings
        w = prose(500 + i, 15 + i, 200).split()
        if i % 3:
            w[i % 15] = "changed"
        docs.append((5000 + i, f"{prose(600 + i, 2000)} {' '.join(w).upper()} {prose(700 + i, 900)}"))
    return docs, items


def test_against_brute_force(spark, monkeypatch):
    docs, items = tables(spark)
    want = set()
    for d, a in sets(docs):
        for i, b in sets(items):
            if b and len(a & b) * 100 >= 80 * len(b):
                want.add((d, i, len(b), len(a & b)))
    for bound, hashes in ((200_000, 20_000), (200_000, 0), (0, 0)):  # a set literal, broadcast, or shuffled
        monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", bound)
        monkeypatch.setattr(decontaminate, "SET_HASHES", hashes)
        found = find_contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
        rows = [tuple(r) for r in found.select("doc_id", "item_id", "n_item", "n_shared").collect()]
        assert len(rows) == len(set(rows)) and set(rows) == want
    monkeypatch.undo()
    assert len(want) > 8
    kept = drop_contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(d for d, _ in docs if d not in {w[0] for w in want})


def test_items_numbered_alike_and_rows_without_ids(spark):
    a, b, c, d = (prose(800 + i, 20 + i, 200) for i in range(4))
    items = spark.createDataFrame([(1, a), (1, b), (1, b), (None, c), (None, d)], "item_id long, text string")
    rows = [(10, f"x {a} y"), (11, f"x {b} y"), (12, c), (None, f"z {d}"), (None, "clean text of enough words here"), (13, "clean"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(r["doc_id"], r["item_id"]): (r["n_item"], r["n_shared"]) for r in find_contaminated(docs, items).collect()}
    assert found == {(10, 1): (16, 16), (11, 1): (17, 17), (12, None): (18, 18), (None, None): (19, 19)}
    kept = drop_contaminated(docs, items)
    assert kept.columns == ["doc_id", "text"] and {tuple(r) for r in kept.collect()} == set(rows[4:])


def test_rows_of_one_id_go_by_their_text(spark):
    item = prose(900, 25, 200)
    docs = spark.createDataFrame([(1, f"x {item}"), (1, "another text"), (1, "another text"), (2, None)], "doc_id long, text string")
    items = spark.createDataFrame([(5, item)], "item_id long, text string")
    assert sorted((r["doc_id"], r["text"]) for r in drop_contaminated(docs, items).where("text is not null").collect()) == [(1, "another text")] * 2
    assert drop_contaminated(docs, items).count() == 3
    assert [tuple(r) for r in find_contaminated(docs, items).collect()] == [(1, 5, 21, 21)]


def test_a_shingle_in_every_item(spark, monkeypatch):
    """Items that begin alike: what they share brings no document to all of them, and the result is the brute force's."""
    monkeypatch.setattr(decontaminate, "COMMON", 4)
    common = "answer the following question now please"
    items = [(i, f"{common} {prose(900 + i, 20, 300)}") for i in range(40)] + [(99, "answer the following question now")]
    docs = [(i, f"{prose(950 + i, 100)} {items[i][1] if i < 8 else common} {prose(980 + i, 60)}") for i in range(30)]
    want = {(d, i, len(b), len(a & b)) for d, a in sets(docs) for i, b in sets(items) if len(a & b) * 100 >= 80 * len(b)}
    item_df = spark.createDataFrame(items, "item_id long, text string")
    found = find_contaminated(spark.createDataFrame(docs, "doc_id long, text string"), item_df)
    assert {tuple(r) for r in found.collect()} == want and len(want) == 38
    texts = item_df.selectExpr("item_id AS item", "item_id AS name", "text")
    shingled = decontaminate._shingled(texts, 5)
    sketches = decontaminate._sketches(shingled, 80)
    shares = sketches.groupBy("h").count()
    assert shares.where("count > 2").count() == 0 and sketches.select("item").distinct().count() == 41


def test_no_python_in_the_plan(spark):
    docs, items = tables(spark)
    found = find_contaminated(spark.createDataFrame([(1, "a")], "doc_id long, text string").selectExpr("doc_id", "text"), spark.range(1).selectExpr("id AS item_id", "'x' AS text"))
    plan = found._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_empty_tables(spark):
    docs, items = tables(spark)
    none_d, none_i = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert find_contaminated(none_d, spark.createDataFrame(items, "item_id long, text string")).count() == 0
    some = spark.createDataFrame(docs, "doc_id long, text string")
    assert find_contaminated(some, none_i).count() == 0
    assert drop_contaminated(some, none_i).count() == len(docs)
