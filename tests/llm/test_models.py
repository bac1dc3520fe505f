"""Toxicity, quality and nearest neighbours: held-out accuracy and recall."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from forumlake.llm import ann, quality, toxicity
from corpus_cases import ODD, crc, no_labels, odd  # noqa: F401

MORE = "/root/testdata/sf0.01"


@pytest.mark.parametrize("query, label, least, held", [(toxicity.op6_toxicity, "toxic", 0.7, (3, 1)), (quality.op2_quality, "quality", 0.3, (5, 0))])
def test_held_out_accuracy(spark, query, label, least, held):
    truth = dict(duckdb.sql(f"SELECT doc_id, {label} FROM '{MORE}/labels.parquet'").fetchall())
    rows = query(spark, MORE).collect()
    assert len(rows) == duckdb.sql(f"SELECT count(*) FROM '{MORE}/documents.parquet'").fetchall()[0][0]
    assert all(r.held_out == (crc(r.doc_id) % held[0] == held[1]) and 0 <= r.score <= 1 and r.predicted == int(r.score >= least) for r in rows)
    test = [r for r in rows if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in test]) > 0.93


def test_pairs_count_beyond_single_terms():
    rng = np.random.default_rng(1)
    sets = [sorted(set(rng.choice(4, size=2).tolist())) for _ in range(600)]
    labels = np.array([int(s == [0, 1] or s == [2, 3]) for s in sets])  # no single term tells
    machine = toxicity.train(labels, sets, np.arange(4), epochs=60)
    assert np.mean([(machine.score(s) >= 0.5) == y for s, y in zip(sets, labels)]) > 0.97


@pytest.mark.parametrize("module, rest", [(toxicity, 0.0), (quality, 0.5)])
def test_odd_rows(spark, odd, no_labels, module, rest):
    label = "toxic" if module is toxicity else "quality"
    assert module.fit(odd, no_labels, label, F.lit(True)) is None
    assert {r[-1] for r in module.score(odd, None).collect()} == {rest}
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in (1, 2, 2, 3, 4, 6, 7)] + [(None, 1, 1), (9, None, None)], no_labels.schema)
    out = module.score(odd, module.fit(odd, labels, label, F.lit(True)))
    assert out.columns == [*odd.columns, "score_"]
    got = out.collect()
    assert len(got) == len(ODD) and all(0 <= r[-1] <= 1 for r in got)


def test_rejection_keeps_clean_rows(spark, odd, no_labels):
    assert toxicity.reject_toxic(odd, no_labels).count() == len(ODD)


def nearest(rows, q, k=20):
    ids = [i for i, _ in rows if i != q]
    at = dict(rows)
    score = {i: float(np.dot(at[i], at[q])) for i in ids}
    return sorted(ids, key=lambda i: (-score[i], i))[:k]


def test_recall_and_order(spark):
    rows = [(i, np.array(v, dtype=float)) for i, v in duckdb.sql(f"SELECT vec_id, embedding FROM '{MORE}/embeddings.parquet'").fetchall()]
    got = {}
    for r in ann.op9_ann(spark, MORE).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert sorted(got) == sorted(i for i, _ in rows if i % 20 == 0)
    hits = 0
    for q, found in got.items():
        assert len(found) == 20 and found == sorted(found, key=lambda p: (-p[1], p[0]))
        hits += len({i for i, _ in found} & set(nearest(rows, q)))
    assert hits / (20 * len(got)) >= 0.9


@pytest.mark.parametrize("block", [8, 4096])
def test_vectors_odd_rows_ties_repeated_ids_widths_and_a_hot_vector(spark, monkeypatch, block):
    monkeypatch.setattr(ann, "BLOCK", block)
    same = [(i, [1.0, 2.0]) for i in range(100, 140)]
    bad = [(20, None), (40, []), (60, [0.0, 0.0]), (80, [1.0, None]), (None, [1.0, 1.0]), (160, [float("nan"), 1.0]), (180, [float("inf"), 1.0])]
    more = [(0, [3.0, 0.5]), (0, [3.0, 0.5]), (1, [5.0, 0.0]), (1, [-9.0, 9.0]), (1, [6.0, -1.0]), (2, [0.5, 0.5]), (200, [1.0, 2.0, 3.0]), (220, [1.0, 1.0, 1.0]), (7, [0.0, 0.0, 9.0]), (240, [4.0])]
    clean = same + more
    frame = spark.createDataFrame([(i, v, "x", 1, 2) for i, v in clean + bad], "vec_id long, embedding array<float>, score string, rank int, r int")
    want = []
    for at, (q, v) in enumerate(clean):
        if q % 20 == 0:
            scores = sorted((-float(np.dot(v, w)), i) for other, (i, w) in enumerate(clean) if other != at and len(w) == len(v))
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scores[:20])]
    got = [tuple(r) for r in ann.search(frame, F.col("vec_id") % 20 == 0).collect()]
    assert sorted(got) == sorted(want)
    assert {r[0] for r in got} == {0, 100, 120, 200, 220}  # 240 has no other vector of its length
    assert ann.search(frame.limit(0), F.lit(True)).count() == 0


def test_recall_where_most_lists_are_not_read(spark):
    """Jittered copies of the given vectors: 20,000 rows in 100 lists and more."""
    base = np.array([v for (v,) in duckdb.sql("SELECT embedding FROM '/root/testdata/sf0.1/embeddings.parquet' ORDER BY vec_id").fetchall()], dtype=float)
    rng = np.random.default_rng(3)
    vectors = np.concatenate([base] * 10)
    vectors += rng.normal(scale=0.35 * np.abs(base).mean(), size=vectors.shape)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    asked = {}
    for r in ann.search(frame, F.col("vec_id") % 100 == 0).collect():
        asked.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for q, found in asked.items():
        scores = vectors @ vectors[q]
        scores[q] = -np.inf
        hits += len(found & set(np.argsort(-scores, kind="stable")[:20].tolist()))
    assert len(asked) == 200 and hits / (20 * len(asked)) >= 0.9
    longest = float(np.linalg.norm(vectors, axis=1).max())
    index = ann.Index(vectors, longest, len(vectors) // ann.LIST_SIZE)
    for lists in index.assign(vectors):
        index.first[lists[0]] += 1
    probed = np.mean([len(index.probes(vectors[q], ann.K)) for q in sorted(asked)[:50]])
    assert len(index.centres) >= 100 and probed < 0.8 * len(index.centres)
