"""Folded segments of stream state: bounded files, restarts, changing tables and times."""

import glob
from datetime import datetime

import pytest
from conftest import NOW, at
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from forumlake.operators.moderation import delete_reported_comments, hide_reported_posts
from forumlake.streaming import jobs
from forumlake.streaming.segments import Notes, Segments, cover, folds

REPORT = "id BIGINT, post_id STRING, user_id STRING, reason STRING, created_at TIMESTAMP_NTZ"
COMMENT_REPORT = "id BIGINT, comment_id BIGINT, user_id STRING, reason STRING, created_at TIMESTAMP_NTZ"


@pytest.mark.parametrize("fold", [2, 3, 8])
def test_segments_of_every_batch_number(fold):
    held = set()
    for n in range(1, 700):
        for _, parts in folds(n - 1, fold):
            held -= set(parts)
        held.add((n - 1, n - 1))
        for whole, parts in folds(n, fold):
            assert held.issuperset(parts)
            held.add(whole)
        now = cover(n, fold)
        assert held.issuperset(now)
        assert [b for first, last in now for b in range(first, last + 1)] == list(range(n))
        levels = len(str(n)) * 4
        assert len(now) <= (fold - 1) * levels


def _segments(path):
    return sorted(p.rpartition("=")[2] for p in glob.glob(f"{path}/segment=*"))


def test_fifty_batches(spark, frame, tmp_path):
    ddl, path = "key BIGINT, batch INT", str(tmp_path / "state")
    schema = StructType.fromDDL(ddl)
    state = Segments(spark, path, "key", fold=3, buckets=4)
    rows = lambda b: frame(ddl, [{"key": k, "batch": b} for k in (b % 5, 100 + b)])
    most = 0
    for b in range(50):
        state.start(b)
        state.write(rows(b), b)
        if b == 26:  # three folds end here; the try dies in the last one, and the batch runs again
            for file in glob.glob(f"{path}/segment=0-26/**/part-*", recursive=True):
                with open(file, "wb"):
                    pass
            state.start(b)
            assert sorted(r.batch for r in state.before(b, schema).collect()) == sorted(2 * list(range(b)))
            state.write(rows(b), b)
        most = max(most, len(_segments(path)))
    assert most <= 14  # 50 unfolded batches would be 50
    assert sorted((r.key, r.batch) for r in state.before(50, schema).collect()) == sorted((k, b) for b in range(50) for k in (b % 5, 100 + b))
    some = state.before(50, schema, frame("key BIGINT", [{"key": 3}, {"key": 120}]))
    assert sorted((r.key, r.batch) for r in some.collect()) == sorted([(3, b) for b in range(3, 50, 5)] + [(120, 20)])
    scanned = state.before(50, schema, frame("key BIGINT", [{"key": 3}]))
    assert scanned.count() == 10 and "PartitionFilters: [isnotnull(bucket" in scanned._jdf.queryExecution().toString()


def test_a_counter_batch_again_changes_nothing(spark, frame, tmp_path):
    ddl, out = "post_id STRING, kind STRING", str(tmp_path / "out")
    assert jobs.sink(spark, out, "counters") is None
    step = jobs.counters_step(spark, out, fold=2, buckets=2)
    batches = [[("p0", "like"), ("p0", "like"), ("p1", "like")], [], [("p0", "dislike")], [("p1", "like"), ("p2", "like")]]
    for b, rows in enumerate(batches):
        df = frame(ddl, [{"post_id": p, "kind": k} for p, k in rows])
        step(df, b)
        step(df, b)
    got = {(r.post_id, r.kind): r.n for r in jobs.latest_counters(spark, out).collect()}
    assert got == {("p0", "like"): 2, ("p1", "like"): 2, ("p0", "dislike"): 1, ("p2", "like"): 1}


def test_reports_in_many_folded_batches_end_as_one_batch(spark, frame, forum, tmp_path):
    tables = forum(
        users=[{"id": f"u{i}", "email": f"u{i}"} for i in range(9)], posts=[{"id": f"p{i}", "status": "active"} for i in range(3)],
        post_reports=[{"id": 900, "post_id": "p0", "user_id": "u8"}],
    )
    rows = [{"id": i, "post_id": f"p{i * 7 % 4}", "user_id": f"u{i % 9}", "reason": "x", "created_at": at(i)} for i in range(35)]
    want = hide_reported_posts(tables, frame(REPORT, rows), NOW, 4)
    out = str(tmp_path / "out")
    run = lambda here, batch, now: hide_reported_posts(here, batch, now, 4)
    step = jobs.moderation_step(spark, tables, NOW, out, "post_reports", "posts", run, fold=2, buckets=2)
    for b in range(5):
        step(frame(REPORT, rows[7 * b : 7 * b + 7]), b)
        if b == 3:  # folded into one segment, then run again
            step(frame(REPORT, rows[21:28]), b)
    for name, expected in (("accepted", want.inserts["post_reports"]), ("changed", want.updates["posts"]), ("rejected", want.rejected)):
        got = jobs.sink(spark, out, name)
        assert sorted(r.id for r in got.collect()) == sorted(r.id for r in expected.collect())
    logs = jobs.sink(spark, out, "logs").orderBy("id").collect()
    assert [r.id for r in logs] == list(range(1, len(logs) + 1)) and len(logs) == want.updates["posts"].count()
    assert set(_segments(f"{out}/accepted")) >= {"0-3", "4-4"} and len(_segments(f"{out}/accepted")) <= 3


def test_tables_and_time_of_each_batch(spark, frame, forum, tmp_path):
    users = [{"id": f"u{i}", "email": f"u{i}"} for i in range(4)]
    roots = {}
    for version, comments in (("a", [0]), ("b", [0, 1])):
        tables = forum(
            users=users, comments=[{"id": i, "post_id": "p0"} for i in comments],
            comment_reports=[{"id": 1, "comment_id": 0, "user_id": "u0"}] if version == "b" else [],
        )
        roots[version] = str(tmp_path / version)
        for name, df in tables.items():
            df.write.parquet(f"{roots[version]}/{name}")
    answers = {0: ("a", "2024-06-01 00:00:00"), 1: ("b", "2024-06-02 00:00:00")}
    run = lambda here, batch, now: delete_reported_comments(here, batch, now, 2, "gone ")
    out = str(tmp_path / "out")
    step = jobs.moderation_step(spark, lambda b: roots[answers[b][0]], lambda b: answers[b][1], out, "comment_reports", "comments", run, fold=2, buckets=2)
    make = lambda rows: frame(COMMENT_REPORT, [{"id": i, "comment_id": c, "user_id": u, "reason": "x", "created_at": at(i)} for i, c, u in rows])
    step(make([(1, 0, "u0"), (2, 1, "u0")]), 0)  # comment 1 is not there yet
    assert [r.id for r in jobs.sink(spark, out, "rejected").collect()] == [2]
    # the snapshot of the second batch holds report 1 already, which counts once
    second = make([(3, 1, "u1"), (4, 1, "u2"), (5, 0, "u0")])
    step(second, 1)
    answers[1] = ("a", "2025-01-01 00:00:00")  # a second try keeps the answers of the first
    step(second, 1)
    assert Notes(spark, f"{out}/asked").read(1) == {"root": roots["b"], "now": "2024-06-02 00:00:00"}
    changed = jobs.sink(spark, out, "changed").collect()
    assert [(r.id, r.deleted_at) for r in changed] == [(1, datetime(2024, 6, 2))]
    assert sorted(r.id for r in jobs.sink(spark, out, "rejected").collect()) == [2, 5]
    assert sorted(r.id for r in jobs.sink(spark, out, "accepted").select(F.col("id")).collect()) == [1, 3, 4]
