"""The pipeline over the small tables: each stage keeps what it must; nulls, repeats and empty tables pass through."""

import corpus_pipeline
from mnemospark.llm import components


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    every = {r.doc_id for r in docs.collect()}
    sizes = []
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:3]:
        kept = stage(spark, kept, sf_dir).cache()
        ids = [r.doc_id for r in kept.select("doc_id").collect()]
        assert kept.columns == docs.columns and len(set(ids)) == len(ids) and set(ids) <= every, name
        sizes.append(len(ids))
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > len(every) / 2
    mixed = corpus_pipeline.mixture(spark, kept, sf_dir)
    assert {r.doc_id for r in mixed.collect()} == {r.doc_id for r in kept.collect()} and mixed.columns == docs.columns
    out = corpus_pipeline.shards(spark, mixed, sf_dir).collect()
    counts = [sum(r.shard == s for r in out) for s in range(corpus_pipeline.SHARDS)]
    assert len(out) == mixed.count() and max(counts) - min(counts) <= 1


def test_stages_of_odd_rows(spark, sf_dir):
    """Null ids, texts and sources, empty texts and repeated rows; and no rows at all."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = spark.createDataFrame([(None, "a b c d e f", "en", None, 11), (1, None, None, "s", None), (2, "", "en", "s", 0), (3, "a b c d e f", "en", "s", 11), (3, "a b c d e f", "en", "s", 11), (4, "x " * 50_000, "en", "t", 100_000)], schema)
    model = corpus_pipeline.STAGES[0][1]
    kept = model(spark, rows, sf_dir)
    assert kept.count() == 6
    kept = corpus_pipeline.near_duplicates(spark, kept, sf_dir)
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "3", "4", "None"]
    kept = corpus_pipeline.benchmark(spark, kept, sf_dir)
    assert kept.count() == 5 and kept.columns == rows.columns
    mixed = corpus_pipeline.mixture(spark, kept, sf_dir)
    assert {r.source for r in mixed.collect()} == {None, "s", "t"}
    assert corpus_pipeline.shards(spark, mixed, sf_dir).count() == mixed.count()
    none = rows.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, sf_dir).count() == 0


def test_components_build_no_broadcast(spark, capsys):
    """Small edges are merged too: each broadcast, at worst four of a step, is built and held on the driver."""
    edges = spark.createDataFrame([(2, 1), (3, 2), (5, 4)], "u long, v long")
    for step, expected in ((components._large, {(2, 1), (3, 1), (5, 4)}), (components._small, {(2, 1), (3, 2), (5, 4)})):
        out = step(edges)
        assert {tuple(r) for r in out.collect()} == expected
        capsys.readouterr()
        out.explain()
        said = capsys.readouterr().out
        assert "SortMergeJoin" in said and "Broadcast" not in said
