from __future__ import annotations

from tests.llm.corpus import documents, prose, words
from tests.llm.test_ngram_join import brute as components_of
from tests.llm.test_ngram_join import sets
from tests.llm.test_substring_dedup import brute as dedup_of


def test_stages_against_brute_force(spark, tmp_path):
    import corpus_pipeline

    rows = [(d, t, "en", "s", len(t or "")) for d, t in documents() + [(9000, "fie knave villain fie " + prose(77, 30)), (9001, prose(31, 60) + " " + prose(5000, 40))]]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    labelled = [(300 + i, 1, 0) for i in range(25)] + [(30 + i, 1, 0) for i in range(40)] + [(9000, 1, 1)]
    spark.createDataFrame(labelled, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, prose(5000, 40)), (1, prose(9, 30_000, 5_000).split(" ", 100)[50])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard_join", "substring_dedup", "benchmark_decontamination", "best_fit_packing"]
    for name, stage in corpus_pipeline.STAGES:
        before = [(r["doc_id"], r["text"]) for r in docs.collect()]
        out = stage(spark, docs, str(tmp_path))
        path = f"{tmp_path}/{name}"
        out.write.parquet(path)
        after = spark.read.parquet(path)
        if name != "best_fit_packing":
            assert after.columns == docs.columns
            found = sorted((r["doc_id"], r["text"] or "") for r in after.collect())
        if name == "ngram_jaccard_join":
            assert found == sorted({(d, t or "") for d, t in before if dict((k, c) for k, _, c in components_of(before))[d] == d})
        elif name == "substring_dedup":
            assert found == sorted((d, t) for d, _, _, t in dedup_of(before))
            assert all(r["n_chars"] == len(r["text"]) for r in after.collect())
        elif name == "benchmark_decontamination":
            items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{tmp_path}/benchmark.parquet").collect()]
            bad = {d for d, a in sets(before) for _, b in sets(items) if b and len(a & b) * 100 >= 80 * len(b)}
            assert bad and found == sorted((d, t) for d, t in before if d not in bad)
        elif name == "best_fit_packing":
            assert {r["doc_id"] for r in after.collect()} == {d for d, _ in before}
        docs = after
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == docs.count()
    assert words("a") == ["a"]


def test_groups_are_decided_by_rows(spark):
    """An id's copy goes, its other text stays; of rows that repeat one stays; null ids come last; rows without words all stay."""
    import corpus_pipeline

    a, b, c, d = (prose(40 + i, 60) for i in range(4))
    rows = [(1, a), (2, a), (2, b), (3, c), (3, c), (None, c), (None, d), (None, d + " more"), (5, None), (5, None), (6, ""), (6, ""), (None, None)]
    out = corpus_pipeline.keep_one_of_each_group(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    found = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str)
    one_of = [x for x in found if x[1] in (d, d + " more")]
    assert len(one_of) == 1
    want = [(1, a), (2, b), (3, c), (5, None), (5, None), (6, ""), (6, ""), (None, None), *one_of]
    assert out.columns == ["doc_id", "text"] and found == sorted(want, key=str)
