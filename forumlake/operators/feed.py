"""Scored feed: interaction score, hot topics, author cap, pages.

One builder serves the offset page, the cursor page and the feeds of all schools.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forumlake.functions.exprs import live, ntz, seconds_between
from forumlake.functions.ranking import top_per_group
from forumlake.operators.counts import child_counts, with_counts
from forumlake.sources.tables import Tables

SCORE_DIGITS = 9  # scores are rounded before they are compared, so ties are stable


@dataclass(frozen=True)
class FeedParams:
    like_weight: float = 0.6
    comment_weight: float = 0.4
    dislike_weight: float = 1.5
    new_post_boost: float = 5.0
    new_post_hours: int = 1
    hot_boost: float = 1.2
    decay_hours: int = 48
    per_author: int = 3


def interaction_counts(tables: Tables, only: DataFrame | None = None, **more: tuple[DataFrame, str]) -> DataFrame:
    """Likes, dislikes and comments per post (of those in `only`), and `more`; soft-deleted comments count too."""
    return child_counts(
        "post_id",
        only=only,
        likes=(tables["post_likes"], "post_id"),
        dislikes=(tables["post_dislikes"], "post_id"),
        comments=(tables["comments"], "post_id"),
        **more,
    )


def _base_score(as_of: datetime | str, params: FeedParams) -> Column:
    age = seconds_between(F.col("created_at"), ntz(as_of))
    weighted = (
        F.col("likes") * F.lit(params.like_weight)
        - F.col("dislikes") * F.lit(params.dislike_weight)
        + F.col("comments") * F.lit(params.comment_weight)
    )
    return weighted * (F.lit(1.0) / (F.lit(1.0) + age / F.lit(float(params.decay_hours * 3600))))


def interaction_scores(tables: Tables, as_of: datetime | str, params: FeedParams = FeedParams()) -> DataFrame:
    """(post_id, base_score) of every live post."""
    posts = tables["posts"].where(live()).select("id", "created_at")
    scored = with_counts(posts, interaction_counts(tables), "id", "post_id")
    return scored.select(
        F.col("id").alias("post_id"), F.round(_base_score(as_of, params), SCORE_DIGITS).alias("base_score")
    )


def _hot_tags(tables: Tables) -> DataFrame:
    hot = tables["topics"].where("is_hot").select(F.col("id").alias("topic_id"))
    return tables["post_topics"].join(hot, "topic_id", "left_semi").select("post_id")


def hot_posts(tables: Tables) -> DataFrame:
    """Distinct posts that carry any hot topic."""
    return _hot_tags(tables).distinct()


def scored_posts(
    tables: Tables,
    as_of: datetime | str,
    params: FeedParams = FeedParams(),
    school_id: int | None = None,
    topic: str | None = None,
    among: Column | None = None,
) -> DataFrame:
    """Feed candidates with final_score: (id, user_id, school_id, created_at, final_score).

    Live posts whose view permission is 'all' or 'school_only'; a post without a
    permission row is no candidate. School and topic filters, and any condition on posts
    given as `among`, apply before the counts are joined.
    """
    posts = tables["posts"].where(live()).select("id", "user_id", "school_id", "created_at")
    if school_id is not None:
        posts = posts.where(F.col("school_id") == school_id)
    if among is not None:
        posts = posts.where(among)
    visible = (
        tables["post_permissions"]
        .where(F.col("view_permission").isin("all", "school_only"))
        .select(F.col("post_id").alias("id"))
    )
    candidates = posts.join(visible, "id", "left_semi")
    if topic is not None:
        wanted = tables["topics"].where(F.col("value") == topic).select(F.col("id").alias("topic_id"))
        tagged = tables["post_topics"].join(wanted, "topic_id", "left_semi").select(F.col("post_id").alias("id"))
        candidates = candidates.join(tagged, "id", "left_semi")

    # with a filter, only the children of posts that pass it are counted; a hot tag is one more child
    asked = None if school_id is None and topic is None and among is None else candidates.select(F.col("id").alias("post_id"))
    counts = interaction_counts(tables, asked, hot_tags=(_hot_tags(tables), "post_id"))
    counted = with_counts(candidates, counts, "id", "post_id")

    boost_from = ntz(as_of) - F.make_interval(hours=F.lit(params.new_post_hours))
    boosted = _base_score(as_of, params) + F.when(
        F.col("created_at") > boost_from, F.lit(params.new_post_boost)
    ).otherwise(F.lit(0.0))
    final = boosted * F.when(F.col("hot_tags") > 0, F.lit(params.hot_boost)).otherwise(F.lit(1.0))
    return counted.select(
        "id", "user_id", "school_id", "created_at", F.round(final, SCORE_DIGITS).alias("final_score")
    )


def capped_posts(scored: DataFrame, params: FeedParams) -> DataFrame:
    """At most `per_author` best posts of an author within a school."""
    best = [F.col("final_score").desc(), F.col("id").desc()]
    return top_per_group(scored, ["school_id", "user_id"], best, params.per_author, "author_rank")


def cut_page(ranked: DataFrame, limit: int, offset: int = 0, cursor: tuple[float, object] | None = None) -> DataFrame:
    """(id, final_score) of one page of capped posts, best first."""
    if cursor is not None:
        score, last_id = cursor
        ranked = ranked.where(
            (F.col("final_score") < score) | ((F.col("final_score") == score) & (F.col("id") < last_id))
        )
    page = ranked.orderBy(F.col("final_score").desc(), F.col("id").desc())
    if offset:
        page = page.offset(offset)
    return page.limit(limit).select("id", "final_score")


def feed_page(
    tables: Tables,
    school_id: int,
    as_of: datetime | str,
    params: FeedParams = FeedParams(),
    limit: int = 15,
    offset: int = 0,
    topic: str | None = None,
    cursor: tuple[float, object] | None = None,
) -> DataFrame:
    """One page of a school's feed: (id, final_score), best first.

    Page either by offset or by `cursor`, the (final_score, id) of the last row seen.
    The author cap applies before the cursor. Pin `as_of` across the pages of one
    scroll: scores decay with it.
    """
    ranked = capped_posts(scored_posts(tables, as_of, params, school_id, topic), params)
    return cut_page(ranked, limit, offset, cursor)


def build_feeds(
    tables: Tables,
    as_of: datetime | str,
    params: FeedParams = FeedParams(),
    n: int = 15,
    topic: str | None = None,
) -> DataFrame:
    """First n posts of every school's feed: (school_id, feed_rank, id, final_score).

    Write it partitioned by school_id. Ranking is limited before each shuffle, so a
    school or author with a third of all posts stays cheap.
    """
    ranked = capped_posts(scored_posts(tables, as_of, params, topic=topic), params)
    best = [F.col("final_score").desc(), F.col("id").desc()]
    return top_per_group(ranked.where(F.col("school_id").isNotNull()), ["school_id"], best, n, "feed_rank").select(
        "school_id", "feed_rank", "id", "final_score"
    )
