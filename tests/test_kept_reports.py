"""Reports kept by batches of changes against the full reports, and what a batch reads."""

import random
from datetime import datetime

import pytest
from conftest import NOW

from forumlake.operators import moderation
from forumlake.operators.outcome import apply_outcome
from forumlake.plans import views
from forumlake.streaming.reports import POST, Activity, row_changes

NOON = datetime(2024, 3, 1, 12)
TABLES = ("posts", "comments", "post_likes", "post_reports", "users")
MODERATE = "request_id STRING, requested_at TIMESTAMP_NTZ, requesting_user_id STRING, post_id STRING, reason_category STRING"


def _rows(df):
    return sorted(tuple(r[c] for c in sorted(df.columns)) for r in df.collect())


@pytest.fixture
def made(forum):
    rng = random.Random(2)
    posts = [{"id": f"p{k}", "user_id": "u0", "school_id": [1, 2, None][k % 3], "deleted_at": NOON if k % 7 == 0 else None} for k in range(30)]
    child = lambda n: [{"id": k, "post_id": f"p{rng.choice([0, 4, 4, 4, rng.randrange(32)])}", "user_id": "u0"} for k in range(n)]
    comments = [{**c, "deleted_at": NOON if c["id"] % 5 == 0 else None} for c in child(60)]
    return forum(
        schools=[{"id": k, "name": f"s{k}"} for k in (1, 2, 3)],
        users=[{"id": f"u{k}", "email": f"e{k}", "school_id": [1, 2, None][k % 3]} for k in range(10)],
        posts=posts, comments=comments, post_likes=child(50), post_reports=child(20),
    )


def _check(kept, tables):
    assert _rows(kept.school_activity(tables["schools"])) == _rows(views.school_activity(tables))
    full = views.post_activity(tables).selectExpr("id AS post_id", "school_id", "like_count", "report_count", "comment_count")
    assert _rows(kept.post_counts()) == _rows(full)


def test_batches_equal_the_full_reports(spark, made, frame, tmp_path):
    kept = Activity(spark, str(tmp_path), fold=2, buckets=3)
    assert kept.post_counts().count() == 0
    # children first, their posts later; then the users; an empty batch; repeats of a batch
    kept.apply(0, {n: made[n] for n in ("comments", "post_likes")})
    kept.apply(1, {n: made[n] for n in ("posts", "post_reports")})
    kept.apply(1, {n: made[n] for n in ("posts", "post_reports")})
    kept.apply(2, {"users": made["users"]})
    kept.apply(3, {}, {})
    _check(kept, made)
    requests = frame(MODERATE, [
        {"request_id": f"r{k}", "requested_at": NOON, "requesting_user_id": "system", "post_id": f"p{k}", "reason_category": "spam"}
        for k in (4, 4, 5, 7, 99)
    ])
    outcome = moderation.apply_post_deletes(made, requests, NOW)
    kept.apply(4, *row_changes(made, outcome))
    after = apply_outcome(made, outcome)
    _check(kept, after)
    # users change school, and a like is taken back
    moved = after["users"].selectExpr("* EXCEPT (school_id)", "3 AS school_id")
    kept.apply(5, {"users": moved.select(*after["users"].columns)}, {"users": after["users"], "post_likes": after["post_likes"].where("id = 1")})
    _check(kept, {**after, "users": moved, "post_likes": after["post_likes"].where("id <> 1")})


def test_a_batch_opens_only_its_buckets(spark, made, tmp_path):
    kept = Activity(spark, str(tmp_path), buckets=8)
    kept.apply(0, {n: made[n] for n in TABLES})
    touched = made["posts"].where("id = 'p4'").selectExpr("id AS post_id")
    files = kept.posts.before(1, POST, touched)
    assert [r["post_id"] for r in files.collect()] == ["p4"]
    assert "PartitionFilters: [isnotnull(bucket" in files._jdf.queryExecution().executedPlan().toString()


def _deletes(made, frame):
    rows = [
        {"request_id": f"r{k}", "requested_at": NOON, "requesting_user_id": "system", "post_id": post, "reason_category": "spam"}
        for k, post in enumerate(("p4", "p4", "p5", None))
    ]
    return moderation.apply_post_deletes(made, frame(MODERATE, rows), NOW)


def test_changes_are_kept_as_column_files(made, frame):
    came, went = row_changes(made, _deletes(made, frame))
    assert sorted(r["id"] for r in went["posts"].collect()) == ["p4", "p5"]
    for rows in (came["posts"], went["posts"]):  # a plan reads what it uses, verdicts and texts are not stored
        plan = rows.select("id", "school_id")._jdf.queryExecution().executedPlan().toString()
        schemas = [line.split("ReadSchema: ")[1] for line in plan.splitlines() if "FileScan parquet" in line]
        assert schemas and "ExistingRDD" not in plan
        assert all("content" not in s and "requested_at" not in s for s in schemas)


def test_both_sides_of_the_first_request_read_the_same_rows(made, frame):
    delta = _deletes(made, frame).updates["posts"]
    # a filter on one side only would keep the two from sharing their shuffles
    assert "isnotnull(post_id" not in delta._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r["id"] for r in delta.collect()) == ["p4", "p5"]


def test_shuffle_files_go_with_the_batch(spark, made, tmp_path):
    manager = spark._jsc.sc().env().blockManager().diskBlockManager()

    def files():
        blocks = manager.getAllBlocks().mkString(" ").split()
        return {name.split("_")[1] for name in blocks if name.startswith("shuffle_")}

    before = files()
    kept = Activity(spark, str(tmp_path))
    kept.apply(0, {n: made[n] for n in TABLES})
    kept.apply(1, {"comments": made["comments"]}, {"comments": made["comments"]})
    # only that of the small query for the touched buckets is left to the collector
    assert len(files() - before) <= 1
