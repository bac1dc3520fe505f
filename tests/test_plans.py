"""Shapes of physical plans that have to hold at scale."""

import re
import uuid

import pytest
from conftest import DATA

from forumlake.functions.ranking import carry_forward, row_index, slice_rows
from forumlake.operators import feed, hydrate
from forumlake.schema import TABLES
from forumlake.sources.benchdata import AS_OF, bench_tables
from forumlake.sources.tables import load_tables, write_bucketed

def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def tables(spark):
    return bench_tables(spark, DATA)


def test_feed_limits_groups_before_the_shuffle(tables):
    text = plan(feed.build_feeds(tables, AS_OF))
    assert len(re.findall(r"WindowGroupLimit .*Partial", text)) == 2
    assert len(re.findall(r"WindowGroupLimit .*Final", text)) == 2


def test_page_is_a_top_k(tables):
    assert "TakeOrderedAndProject" in plan(feed.feed_page(tables, 1, AS_OF, offset=5))
    assert "TakeOrderedAndProject" in plan(hydrate.comment_page(tables, 1))


def test_children_are_counted_in_one_shuffle(tables):
    text = plan(feed.interaction_counts({n: tables.spark.range(9).selectExpr("id", "id AS post_id")
                                         for n in ("post_likes", "post_dislikes", "comments")}))
    assert text.count("Exchange") == 1 and "partial_sum" in text


def test_filters_and_columns_reach_the_scan(spark, tables, tmp_path):
    root = str(tmp_path)
    names = ("posts", "post_likes", "post_dislikes", "comments", "post_permissions", "topics", "post_topics")
    for name in names:
        columns = [f"CAST({c.name} AS {c.type.simpleString()}) AS {c.name}" for c in TABLES[name]]
        tables[name].selectExpr(*columns).write.parquet(f"{root}/{name}")
    stored = load_tables(spark, root, names)
    text = plan(feed.feed_page(stored, 7, AS_OF))
    scan = next(line for line in text.splitlines() if "FileScan" in line and "school_id" in line)
    assert "EqualTo(status,active)" in scan and "EqualTo(school_id,7)" in scan
    assert "content" not in scan.split("ReadSchema")[1]
    likes = next(line for line in text.splitlines() if "post_likes" in line)
    assert likes.split("ReadSchema: ")[1].startswith("struct<post_id:string>")


def test_bucketed_posts_meet_permissions_without_shuffle(spark, tables):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    tag = uuid.uuid4().hex
    names = (f"posts_{tag}", f"permissions_{tag}")
    try:
        write_bucketed(tables["posts"], names[0], "id", 4)
        write_bucketed(tables["post_permissions"], names[1], "post_id", 4)
        posts, permissions = (spark.table(n) for n in names)
        joined = posts.join(permissions.selectExpr("post_id AS id", "view_permission"), "id")
        assert "Exchange" not in plan(joined)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for name in names:
            spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_images_are_reduced_to_the_cards_before_they_are_joined(tables):
    text = plan(hydrate.alias_cards(tables))
    assert re.search(r"Join.*LeftSemi|Join.*, LeftSemi", text)
    assert "LeftOuter" in text


def test_sequences_are_planned_without_jobs_and_shuffle_rows_once(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.sparkContext.setJobGroup("sequences", "planned only")
    try:
        sliced = slice_rows(spark.range(100).selectExpr("id", "id % 7 AS k", "nullif(id % 3, 0) AS v", "'p' AS payload"), ["k"], ["id"])
        for df in (carry_forward(sliced, "v", "last"), row_index(sliced)):
            lines = [line for line in plan(df).splitlines() if "Exchange hashpartitioning(_slice" in line]
            assert len(lines) == 3  # the rows once; facts, combined before, and again after their window
        assert not spark.sparkContext.statusTracker().getJobIdsForGroup("sequences")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
