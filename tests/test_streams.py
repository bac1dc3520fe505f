"""Streaming jobs end in the state of the batch operators."""

import random

import pytest
from conftest import NOW, T0, at

from forumlake.operators.moderation import delete_reported_comments, hide_reported_posts
from forumlake.streaming import jobs

REPORT = "id BIGINT, post_id STRING, user_id STRING, reason STRING, created_at TIMESTAMP_NTZ"
COMMENT_REPORT = "id BIGINT, comment_id BIGINT, user_id STRING, reason STRING, created_at TIMESTAMP_NTZ"


@pytest.fixture(scope="module")
def tables(forum):
    return forum(
        users=[{"id": f"u{i}", "email": f"u{i}"} for i in range(10)],
        posts=[{"id": f"p{i}", "status": "hidden" if i == 3 else "active"} for i in range(4)],
        comments=[{"id": i, "post_id": "p0"} for i in range(4)],
        post_reports=[{"id": 900, "post_id": "p0", "user_id": "u9"}],
    )


def _land(frame, ddl, rows, path, files):
    """Write the reports in arrival order as a number of files."""
    size = -(-len(rows) // files)
    for i in range(files):
        part = rows[i * size:(i + 1) * size]
        if part:
            frame(ddl, part).coalesce(1).write.parquet(f"{path}/part{i:03d}", mode="overwrite")
    return f"{path}/*"


def _rows(key, values, n):
    rng = random.Random(4)
    return [{"id": i, key: rng.choice(values), "user_id": f"u{rng.randrange(9)}", "reason": "x", "created_at": at(i)}
            for i in range(n)]


def _keys(df):
    return sorted(r["id"] for r in df.select("id").collect())


@pytest.mark.parametrize("files", [1, 4])
def test_post_reports(spark, frame, tables, tmp_path, files):
    rows = _rows("post_id", ["p0", "p0", "p1", "p2", "p3", "p9"], 60)
    batch = hide_reported_posts(tables, frame(REPORT, rows), NOW, 4)
    source = _land(frame, REPORT, rows, str(tmp_path / "in"), files)
    like = frame(REPORT, rows[:1])
    out = str(tmp_path / "out")
    for _ in range(2):  # the second start finds nothing new
        stream = jobs.file_stream(spark, source, like, files_per_batch=1)
        jobs.stream_hide_reported_posts(stream, tables, out, NOW, 4).awaitTermination()
        assert _keys(jobs.sink(spark, out, "accepted")) == _keys(batch.inserts["post_reports"])
        assert _keys(jobs.sink(spark, out, "changed")) == _keys(batch.updates["posts"])
        assert _keys(jobs.sink(spark, out, "rejected")) == _keys(batch.rejected)


def test_comment_reports(spark, frame, tables, tmp_path):
    rows = _rows("comment_id", [0, 0, 1, 2, 8], 40)
    batch = delete_reported_comments(tables, frame(COMMENT_REPORT, rows), NOW, 4)
    source = _land(frame, COMMENT_REPORT, rows, str(tmp_path / "in"), 3)
    out = str(tmp_path / "out")
    stream = jobs.file_stream(spark, source, frame(COMMENT_REPORT, rows[:1]), files_per_batch=1)
    jobs.stream_delete_reported_comments(stream, tables, out, NOW, 4).awaitTermination()
    assert _keys(jobs.sink(spark, out, "accepted")) == _keys(batch.inserts["comment_reports"])
    assert _keys(jobs.sink(spark, out, "changed")) == _keys(batch.updates["comments"])


def test_counters(spark, frame, tmp_path):
    ddl = "post_id STRING, kind STRING"
    rows = [{"post_id": f"p{i % 3}", "kind": ["like", "dislike"][i % 2]} for i in range(24)]
    source = _land(frame, ddl, rows, str(tmp_path / "in"), 3)
    stream = jobs.file_stream(spark, source, frame(ddl, rows[:1]), files_per_batch=1)
    jobs.stream_counters(stream, str(tmp_path / "out")).awaitTermination()
    got = {(r["post_id"], r["kind"]): r["n"] for r in jobs.latest_counters(spark, str(tmp_path / "out")).collect()}
    assert got == {(f"p{p}", k): 4 for p in range(3) for k in ("like", "dislike")}


def test_signups_wait_for_the_watermark(spark, frame, tmp_path):
    ddl = "id BIGINT, created_at TIMESTAMP_NTZ"
    rows = [{"id": i, "created_at": at(i * 600)} for i in range(40)]  # almost 17 days
    source = _land(frame, ddl, rows, str(tmp_path / "in"), 2)
    stream = jobs.file_stream(spark, source, frame(ddl, rows[:1]), files_per_batch=1)
    jobs.stream_signups(stream, str(tmp_path / "out")).awaitTermination()
    days = spark.read.parquet(f"{tmp_path}/out/signups").orderBy("signup_date").collect()
    per_day = {}
    for row in rows:
        per_day[row["created_at"].date()] = per_day.get(row["created_at"].date(), 0) + 1
    closed = {d: n for d, n in per_day.items() if (d - T0.date()).days <= 14}
    assert {r["signup_date"]: r["new_user_count"] for r in days} == closed
