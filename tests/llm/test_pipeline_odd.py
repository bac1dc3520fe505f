"""The corpus pipeline on odd and on empty tables."""

import pytest
from corpus_cases import ODD, no_labels, normal, odd  # noqa: F401

import corpus_pipeline


@pytest.fixture(scope="module")
def folder(odd, no_labels, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("odd"))
    odd.write.parquet(f"{path}/documents.parquet")
    no_labels.write.parquet(f"{path}/labels.parquet")
    return path


def test_stages_keep_columns_and_rows(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, counts = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stored(stage(spark, docs, folder), f"odd-{name}")
        assert docs.columns == columns
        counts.append(docs.count())
    texts = {normal(r[1]) for r in ODD}
    assert counts[0] == len(ODD) and counts[1] == len(texts) >= counts[2] > 0
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    assert len({(r.sequence_id, r.offset) for r in pieces}) == len(pieces)
    ends = {}
    for r in sorted(pieces, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert sum(r.length for r in pieces) == sum(r.doc_tokens for r in pieces if r.start == 0)


def test_whole_run_on_odd_and_empty_tables(spark, folder, odd, no_labels, tmp_path):
    rows = corpus_pipeline.run(spark, folder).collect()
    assert rows and {r.doc_id for r in rows} <= {r[0] for r in ODD}
    odd.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    no_labels.write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
