"""How much one task gets: joins per count, rows without a key, work per row of a sequence, size of a task."""

import pytest
from pyspark.sql import functions as F

from forumlake import session
from forumlake.functions.ranking import STEP, number_rows, slice_rows
from forumlake.operators import comments
from forumlake.operators.counts import child_counts
from forumlake.sources.benchdata import bench_tables
from forumlake.streaming.segments import Segments


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def shuffled(spark):
    """Joins are shuffled and no partition is merged with another."""
    keys = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for key, value in keys.items():
        spark.conf.set(key, value)
    yield spark
    for key in keys:
        spark.conf.unset(key)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", session.DEFAULTS["spark.sql.adaptive.coalescePartitions.enabled"])


def test_asked_keys_meet_the_counts_once(shuffled):
    likes, views = (shuffled.range(40).selectExpr(f"id % {n} AS post_id") for n in (4, 10))
    asked = shuffled.range(3, 6).selectExpr("id AS post_id")
    counts = child_counts("post_id", only=asked, likes=(likes, "post_id"), views=(views, "post_id"))
    assert plan(counts).count("LeftSemi") == 1
    assert sorted(map(tuple, counts.collect())) == [(3, 10, 4), (4, 0, 4), (5, 0, 4)]


def test_requests_without_a_post_are_dealt_over_tasks(shuffled):
    posts = shuffled.range(5).selectExpr("id", "CAST(1 AS INT) AS school_id", "'active' AS status", "CAST(NULL AS TIMESTAMP_NTZ) AS deleted_at")
    permissions = shuffled.range(3).selectExpr("id AS post_id", "'none' AS comment_permission")
    asked = shuffled.range(400).selectExpr(
        "id AS request_id", "TIMESTAMP_NTZ'2024-01-01 00:00:00' AS requested_at", "CASE WHEN id < 5 THEN id END AS _parent_post"
    )
    found = comments._with_post({"posts": posts, "post_permissions": permissions}, asked, "_parent_post")
    assert found.columns == [*asked.columns, "_post", "_post_school", "_permission"]
    met = found.where("_parent_post IS NOT NULL").select("request_id", "_post", "_post_school", "_permission").collect()
    assert sorted(map(tuple, met)) == [(i, i, 1, "none" if i < 3 else None) for i in range(5)]
    places = found.where("_parent_post IS NULL").groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert sum(r["count"] for r in places) == 395
    assert len(places) > 1 and max(r["count"] for r in places) < 395


def test_slices_are_found_without_a_look_at_every_cut(spark):
    rows = spark.range(20_000).selectExpr("id", "CAST(id * 7919 % 20011 AS INT) AS at")
    spark.conf.set("spark.sql.shuffle.partitions", "40")  # more cuts than one run holds
    try:
        sliced = slice_rows(rows, [], ["at", "id"])
        text = plan(sliced).split("Subquery")[0]
        assert f"% {STEP})" not in text
        assert sliced.select("_slice").distinct().count() == 40
        assert sliced.groupBy("_slice").agg(F.min("at").alias("a"), F.max("at").alias("b")).selectExpr(
            "b < coalesce(lead(a) OVER (ORDER BY _slice), 1000000) AS apart").where("NOT apart").isEmpty()
        numbered = number_rows(rows, ["at", "id"]).select("row_index", F.expr("row_number() OVER (ORDER BY at, id) AS n"))
        assert numbered.where("row_index <> n").isEmpty()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_tables_come_with_a_task_size_unless_the_session_has_one(spark):
    before = spark.conf.get(session.TASK_KEY)
    try:
        spark.conf.unset(session.TASK_KEY)
        bench_tables(spark, "/nowhere/a")
        assert spark.conf.get(session.TASK_KEY) == "16m"
        spark.conf.set(session.TASK_KEY, "5m")
        bench_tables(spark, "/nowhere/b")
        assert spark.conf.get(session.TASK_KEY) == "5m"
    finally:
        spark.conf.set(session.TASK_KEY, before)


def test_a_first_batch_does_not_look_for_older_rows(spark, tmp_path):
    state = Segments(spark, str(tmp_path / "state"), "key", buckets=4)
    schema = spark.createDataFrame([], "key STRING, n BIGINT").schema
    unread = spark.range(1).selectExpr("CAST(raise_error('read') AS STRING) AS key")
    assert state.before(0, schema, unread).collect() == []
