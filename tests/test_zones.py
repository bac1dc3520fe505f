"""Pages over bounded days against whole feeds, and what they count."""

import random

import pytest
from conftest import NOW, T0, at

from forumlake.operators import feed
from forumlake.operators.feed import FeedParams
from forumlake.streaming import zones as z

DAY = 24 * 60


def _rows(df):
    return [tuple(r) for r in df.collect()]


def _forum(forum, days, per_day, rng):
    posts, likes, dislikes, comments = [], [], [], []
    for k in range(days * per_day):
        posts.append({"id": f"p{k:05d}", "user_id": f"u{rng.randrange(per_day)}", "school_id": rng.choice([1, 1, 2]), "created_at": at(152 * DAY - k * DAY // per_day - 30)})
        for rows, most in ((likes, 6), (dislikes, 2), (comments, 4)):
            rows.extend({"id": len(rows), "post_id": f"p{k:05d}", "user_id": f"u{n}"} for n in range(rng.randrange(most)))
    likes.extend({"id": 10**6 + n, "post_id": f"p{days * per_day // 2:05d}", "user_id": f"u{n}"} for n in range(300))
    return forum(
        posts=posts, post_likes=likes, post_dislikes=dislikes, comments=comments,
        post_permissions=[{"id": k, "post_id": p["id"], "view_permission": "all"} for k, p in enumerate(posts)],
        topics=[{"id": 1, "is_hot": True, "value": "hot"}, {"id": 2, "value": "cold"}],
        post_topics=[{"id": k, "post_id": p["id"], "topic_id": 1 + k % 2} for k, p in enumerate(posts) if k % 3 == 0],
    )


@pytest.fixture(scope="module")
def made(forum):
    return _forum(forum, 40, 6, random.Random(4))


PAGES = [
    {}, {"limit": 3, "offset": 4}, {"cursor": (0.5, "p00100"), "limit": 5}, {"topic": "cold", "limit": 4},
    {"limit": 500}, {"params": FeedParams(hot_boost=0.5, per_author=1, new_post_boost=0.0)}, {"params": FeedParams(like_weight=-1.0)},
]


@pytest.mark.parametrize("page", range(len(PAGES)))
def test_page_equals_the_whole_feeds(made, page):
    asked = {"limit": 8, **PAGES[page]}
    zones = z.zones_of(made)
    assert _rows(z.bounded_page(made, zones, 1, NOW, first=8, **asked)) == _rows(feed.feed_page(made, 1, NOW, **asked))


def test_zones_by_batches_hold_and_pages_agree(spark, made, tmp_path):
    kept = z.Zones(spark, str(tmp_path / "zones"), fold=2, buckets=2)
    assert kept.of_school(1).count() == 0
    half = "post_id < 'p00120'"
    kept.apply(0, made, {"posts": made["posts"].where("id < 'p00120'"), "post_likes": made["post_likes"].where(half)})
    for _ in range(2):
        kept.apply(1, made, {"posts": made["posts"].where("id >= 'p00120'"), "post_likes": made["post_likes"].where(f"NOT ({half})")})
    kept.apply(2, made, {"comments": made["comments"]})
    whole = {r["day"]: r for r in z.zones_of(made).where("school_id = 1").collect()}
    rows = {r["day"]: r for r in kept.of_school(1).collect()}
    assert set(rows) == set(whole)
    for day, row in rows.items():
        assert row["posts"] == whole[day]["posts"] and row["youngest"] == whole[day]["youngest"]
        assert row["likes"] >= whole[day]["likes"] and row["comments"] >= whole[day]["comments"]
    assert _rows(z.bounded_page(made, kept.of_school(1), 1, NOW, limit=5, first=8)) == _rows(feed.feed_page(made, 1, NOW, limit=5))


def test_unknown_schools_and_times(made, forum):
    assert _rows(z.bounded_page(made, z.zones_of(made), 9, NOW)) == []
    ahead = forum(
        posts=[{"id": "a", "user_id": "u", "school_id": 1, "created_at": at(300 * DAY)}, {"id": "b", "user_id": "u", "school_id": 1, "created_at": T0}],
        post_permissions=[{"id": k, "post_id": p, "view_permission": "all"} for k, p in enumerate("ab")],
    )
    assert _rows(z.bounded_page(ahead, z.zones_of(ahead), 1, NOW, limit=1, first=1)) == _rows(feed.feed_page(ahead, 1, NOW, limit=1))
    with pytest.raises(ValueError):
        z.score_bound(NOW, FeedParams(dislike_weight=-1.0))


def test_posts_counted_do_not_grow_with_history(forum, monkeypatch):
    counted = {}
    scored = feed.scored_posts
    for days in (20, 60):
        tables = _forum(forum, days, 6, random.Random(1))
        seen = []
        monkeypatch.setattr(z, "scored_posts", lambda *a: seen.append(scored(*a).count()) or scored(*a))
        page = z.bounded_page(tables, z.zones_of(tables), 2, NOW, limit=3, first=8)
        assert _rows(page) == _rows(feed.feed_page(tables, 2, NOW, limit=3))
        counted[days] = sum(seen)
    assert counted[60] <= counted[20] * 1.2 and counted[60] < 60


def test_a_deep_cursor_takes_two_tries(forum, monkeypatch):
    scored = feed.scored_posts
    for days in (20, 120):
        tables = _forum(forum, days, 6, random.Random(2))
        zones = z.zones_of(tables).localCheckpoint()
        every = feed.feed_page(tables, 1, NOW, limit=10**6).collect()
        for at in (len(every) // 2, len(every) - 12):
            asked = {"limit": 5, "cursor": (every[at]["final_score"], every[at]["id"])}
            tries = []
            monkeypatch.setattr(z, "scored_posts", lambda *a: tries.append(1) or scored(*a))
            assert _rows(z.bounded_page(tables, zones, 1, NOW, first=2, **asked)) == _rows(feed.feed_page(tables, 1, NOW, **asked))
            assert len(tries) <= 2
