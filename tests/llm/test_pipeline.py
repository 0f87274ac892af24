"""The pipeline against its stages done one after the other in plain Python."""

import pyarrow as pa
from test_decontamination import brute as hits
from test_near_duplicates import brute as classes
from test_packing import expected_pieces

import corpus_pipeline
from claimloom.llm import quality


def test_against_brute_force(spark, sf_dir, documents):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.train(documents, labels)
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    scores = model.score(quality.measures(pa.array([t for _, t in rows], pa.string())))
    rows = [r for r, s in zip(rows, scores, strict=True) if s >= 0.7]
    first = {d: c for d, c, _, _ in classes(rows)}
    rows = [(d, t) for d, t in rows if first[d] == d]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    dirty = {h[0] for h in hits(rows, items, 10) if h[5]}
    rows = [(d, t) for d, t in rows if d not in dirty]
    want = expected_pieces(spark.createDataFrame(rows, "doc_id long, text string"), 2048, 0)
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert sorted(tuple(r)[:5] for r in got) == sorted(want) and 0 < len(rows) < documents.count()


def test_stages_take_odd_and_empty_tables(spark, odd_docs, no_docs, sf_dir):
    for docs in (odd_docs, no_docs):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            got = stage(spark, docs, sf_dir)
            assert got.columns == docs.columns, name
            assert got.count() <= docs.count()
        assert stage is not None and corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() >= docs.count()
