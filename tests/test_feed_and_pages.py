from datetime import datetime, timedelta

import pytest
from conftest import DATA

from forumlake.operators import feed, hydrate
from forumlake.operators.outcome import stamp, update_rows
from forumlake.plans import views
from forumlake.sources.benchdata import AS_OF, bench_tables

NOON = datetime(2024, 3, 1, 12)


@pytest.fixture(scope="module")
def tables(spark):
    return bench_tables(spark, DATA)


@pytest.fixture(scope="module")
def small(forum):
    """Two schools; author a owns four posts; likes, dislikes and comments on p1."""
    ago = lambda hours: NOON - timedelta(hours=hours)
    posts = [
        {"id": "p1", "user_id": "a", "school_id": 1, "created_at": ago(48)},
        {"id": "p2", "user_id": "a", "school_id": 1, "created_at": ago(0.5)},
        {"id": "p3", "user_id": "a", "school_id": 1, "created_at": ago(0.5)},
        {"id": "p4", "user_id": "a", "school_id": 1, "created_at": ago(1)},
        {"id": "p5", "user_id": "b", "school_id": 1, "created_at": ago(10)},
        {"id": "p6", "user_id": "b", "school_id": 1, "created_at": ago(10)},
        {"id": "p7", "user_id": "b", "school_id": 1, "created_at": ago(10), "status": "hidden"},
        {"id": "p8", "user_id": "c", "school_id": 2, "created_at": ago(10)},
        {"id": "p9", "user_id": "c", "school_id": 1, "created_at": ago(10)},
    ]
    views_ = ["all", "all", "school_only", "all", "all", "none", "all", "all"]
    return forum(
        posts=posts,
        post_permissions=[{"id": i, "post_id": f"p{i + 1}", "view_permission": v} for i, v in enumerate(views_)],
        post_likes=[{"id": i, "post_id": "p1", "user_id": f"u{i}"} for i in range(5)],
        post_dislikes=[{"id": 1, "post_id": "p1", "user_id": "x"}, {"id": 2, "post_id": "p5", "user_id": "x"}],
        comments=[{"id": 1, "post_id": "p1"}, {"id": 2, "post_id": "p1", "deleted_at": NOON}],
        topics=[{"id": 1, "value": "hot", "is_hot": True, "is_hidden": True}, {"id": 2, "value": "cold"}],
        post_topics=[{"id": 1, "post_id": "p5", "topic_id": 1}, {"id": 2, "post_id": "p1", "topic_id": 2}],
        schools=[{"id": 1}, {"id": 2}],
    )


def test_scores(small):
    scores = {r["id"]: r["final_score"] for r in feed.scored_posts(small, NOON).collect()}
    assert scores["p1"] == pytest.approx((5 * 0.6 - 1.5 + 2 * 0.4) / 2)  # deleted comments count, one period old
    assert scores["p2"] == 5.0 and scores["p4"] == 0.0  # exactly one hour old is not new
    assert scores["p5"] == pytest.approx(-1.5 / (1 + 10 / 48) * 1.2)  # hot makes a negative score lower
    assert set(scores) == {"p1", "p2", "p3", "p4", "p5", "p8"}  # p6 none, p7 hidden, p9 without permission row


def test_author_cap_and_ties(small):
    page = [r["id"] for r in feed.feed_page(small, 1, NOON).collect()]
    assert page == ["p3", "p2", "p1", "p5"]  # equal scores by id, fourth post of author a capped
    assert [r["id"] for r in feed.feed_page(small, 1, NOON, feed.FeedParams(per_author=1)).collect()] == ["p3", "p5"]
    assert [r["id"] for r in feed.feed_page(small, 1, NOON, topic="cold").collect()] == ["p1"]


def test_cursor_pages_equal_one_long_page(tables):
    whole = [(r["id"], r["final_score"]) for r in feed.feed_page(tables, 7, AS_OF, limit=1000).collect()]
    pages, cursor = [], None
    while True:
        page = [(r["id"], r["final_score"]) for r in feed.feed_page(tables, 7, AS_OF, limit=12, cursor=cursor).collect()]
        pages += page
        if len(page) < 12:
            break
        cursor = (page[-1][1], page[-1][0])
    assert pages == whole
    offset = [r["id"] for r in feed.feed_page(tables, 7, AS_OF, limit=12, offset=12).collect()]
    assert offset == [i for i, _ in whole[12:24]]


def test_all_feeds_contain_each_page(tables):
    rows = feed.build_feeds(tables, AS_OF, n=15).where("school_id = 7").orderBy("feed_rank").collect()
    assert [r["id"] for r in rows] == [r["id"] for r in feed.feed_page(tables, 7, AS_OF).collect()]


def test_comment_pages(forum):
    rows = [{"id": i, "post_id": "p", "parent_comment_id": 1 if i % 3 == 0 else None} for i in range(1, 20)]
    t = forum(comments=rows)
    ids = lambda **k: [r["id"] for r in hydrate.comment_page(t, "p", **k).collect()]
    assert ids(limit=4) == [1, 2, 4, 5]
    assert ids(limit=4, cursor=5) == [7, 8, 10, 11]
    assert ids(parent=1, limit=3) == [3, 6, 9]


def test_counters_and_interactions(small, frame):
    ids = frame("id STRING", [{"id": "p1"}, {"id": "p1"}, {"id": "p5"}, {"id": "zz"}])
    got = {r["id"]: tuple(r)[1:] for r in hydrate.post_counters(small, ids).collect()}
    assert got == {"p1": (5, 1, 2), "p5": (0, 1, 0), "zz": (0, 0, 0)}  # a post's own dislikes only
    pairs = frame("user_id STRING, post_id STRING", [
        {"user_id": "u1", "post_id": "p1"}, {"user_id": "u1", "post_id": "p1"}, {"user_id": "x", "post_id": "p5"}])
    flags = sorted(tuple(r) for r in hydrate.user_interactions(small, pairs).collect())
    assert flags == [("u1", "p1", True, False), ("u1", "p1", True, False), ("x", "p5", False, True)]


def test_hydration_fallbacks(forum, frame):
    t = forum(
        posts=[{"id": "p1", "user_id": "a", "school_id": 1}, {"id": "p2", "user_id": "n", "school_id": 1}],
        users=[{"id": "a", "alias_id": "x", "school_id": 2, "email": "1"}, {"id": "n", "email": "2"}],
        aliases=[{"id": "x", "display_name": "fox", "icon_image_id": "i1"}],
        images=[{"id": "i1"}, {"id": "i2", "format": "jpg"}],
        schools=[{"id": 1, "short_name": "S1"}, {"id": 2, "short_name": "S2"}],
        post_images=[{"id": 1, "post_id": "p1", "image_id": "i2"}, {"id": 2, "post_id": "p1", "image_id": "i1"}],
        comments=[{"id": 1, "post_id": "p1", "user_id": "a"}],
    )
    rows = {r["id"]: r for r in hydrate.hydrate_posts(t, t["posts"].select("id")).collect()}
    assert (rows["p1"]["display_name"], rows["p1"]["avatar_url"]) == ("fox", "http://x/i1.png")
    assert rows["p1"]["images"] == ["http://x/i1.png", "http://x/i2.jpg"]
    assert (rows["p2"]["display_name"], rows["p2"]["avatar_url"], rows["p2"]["images"]) == ("anonymous", "", [])
    assert rows["p2"]["comment_permission"] == rows["p2"]["view_permission"] == "all"
    assert rows["p1"]["school_short_name"] == "S1"  # the post's school
    assert hydrate.hydrate_comments(t, frame("id BIGINT", [{"id": 1}])).first()["school_short_name"] == "S2"  # the author's


def test_reports_count_what_they_say(small):
    activity = {r["school_id"]: r for r in views.school_activity(small).collect()}
    assert activity[1]["post_count"] == 8 and activity[1]["comment_count"] == 1  # hidden posts in, deleted comments out
    assert activity[2]["post_like_count"] == 0


def test_stamp_touches_changed_rows_only(forum, frame):
    settings = forum(system_settings=[{"key": "a", "value": "1"}, {"key": "b", "value": "2"}])["system_settings"]
    delta = stamp(frame("key STRING, value STRING", [{"key": "b", "value": "3"}]), NOON)
    rows = {r["key"]: r for r in update_rows(settings, delta, "key").collect()}
    assert rows["b"]["value"] == "3" and rows["b"]["updated_at"] == NOON
    assert rows["a"]["value"] == "1" and rows["a"]["updated_at"] != NOON


def test_comment_pages_equal_single_pages(forum, frame):
    comments = [{"id": k, "post_id": f"p{k % 3}", "parent_comment_id": k % 7 if k % 2 and k > 6 else None} for k in range(1, 60)]
    made = forum(comments=comments)
    asked = [
        {"post_id": p, "parent_comment_id": parent, "cursor": cursor, "who": n}
        for n, (p, parent, cursor) in enumerate(
            [("p0", None, None), ("p0", None, 12), ("p0", None, 12), ("p1", None, 500), ("p1", 3, None), ("p1", 3, 17), ("p2", None, 1), ("none", None, None), (None, None, None)]
        )
    ]
    got = {}
    for r in hydrate.comment_pages(made, frame("post_id STRING, parent_comment_id BIGINT, cursor BIGINT, who INT", asked), 4).collect():
        got.setdefault(r["who"], {})[r["page_rank"]] = r["id"]
    for a in asked:
        page = hydrate.comment_page(made, a["post_id"], a["parent_comment_id"], 4, a["cursor"]).collect()
        assert got.get(a["who"], {}) == {n + 1: r["id"] for n, r in enumerate(page)}
    assert got[4] and got[5] and len(got[0]) == 4
