"""The stored reports: rankings, activity, notifications, signups.

Each returns an unsorted DataFrame; `ORDERS` holds the presentation order of the
ones that have one, to be applied where the rows are shown.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forumlake.operators.counts import child_counts, with_counts
from forumlake.operators.hydrate import image_urls
from forumlake.sources.tables import Tables


def alias_ranking(tables: Tables) -> DataFrame:
    """Aliases by number of assignments ever made (the counter starts at 1)."""
    aliases = tables["aliases"].select(
        "id", "display_name", F.col("next_user_index").alias("user_count"), F.col("icon_image_id").alias("icon_id")
    )
    return aliases.join(image_urls(tables, "icon_id", "image_url", aliases), "icon_id", "left").select(
        "id", "display_name", "user_count", "image_url"
    )


def school_ranking(tables: Tables) -> DataFrame:
    """Active schools by number of users of any status."""
    schools = tables["schools"].where("is_active").select(
        "id", "name", "short_name", F.col("logo_image_id").alias("logo_id")
    )
    members = child_counts("school_id", user_count=(tables["users"], "school_id"))
    return (
        with_counts(schools, members, "id", "school_id")
        .join(image_urls(tables, "logo_id", "image_url", schools), "logo_id", "left")
        .select("id", "name", "short_name", "user_count", "image_url")
    )


def post_activity(tables: Tables) -> DataFrame:
    """Posts not soft-deleted (any status) with like, report and live-comment counts."""
    counts = child_counts(
        "post_id",
        like_count=(tables["post_likes"], "post_id"),
        report_count=(tables["post_reports"], "post_id"),
        comment_count=(tables["comments"], "post_id", F.col("deleted_at").isNull()),
    )
    posts = tables["posts"].where(F.col("deleted_at").isNull())
    return with_counts(
        posts.select("id", "content", "user_id", "school_id", "status", "created_at"), counts, "id", "post_id"
    )


def top_posts(tables: Tables, limit: int | None = None) -> DataFrame:
    posts = post_activity(tables)
    return in_order(posts, "top_posts").limit(limit) if limit else posts


def school_activity(tables: Tables) -> DataFrame:
    """Users, posts, live comments, likes and reports of every school; 0 when none."""
    posts = (
        post_activity(tables)
        .groupBy("school_id")
        .agg(
            F.count(F.lit(1)).alias("post_count"),
            F.sum("comment_count").alias("comment_count"),
            F.sum("like_count").alias("post_like_count"),
            F.sum("report_count").alias("post_report_count"),
        )
    )
    members = child_counts("school_id", user_count=(tables["users"], "school_id"))
    schools = tables["schools"].select(F.col("id").alias("of"), F.col("name").alias("school_name"))
    both = with_counts(with_counts(schools, members, "of", "school_id"), posts, "of", "school_id")
    return both.select(
        F.col("of").alias("school_id"), "school_name",
        "user_count", "post_count", "comment_count", "post_like_count", "post_report_count",
    )


def user_notifications(tables: Tables) -> DataFrame:
    """Total, read and unread per user, from the read rows: a notification without one counts nowhere."""
    reads = tables["notification_reads"].groupBy("user_id").agg(
        F.count(F.lit(1)).alias("total_notifications"),
        F.count_if("is_read").alias("read_notifications"),
    )
    users = tables["users"].select(F.col("id").alias("of"))
    return with_counts(users, reads, "of", "user_id").select(
        F.col("of").alias("user_id"),
        "total_notifications",
        "read_notifications",
        (F.col("total_notifications") - F.col("read_notifications")).alias("unread_notifications"),
    )


def alias_usage(tables: Tables) -> DataFrame:
    """Current members of every alias."""
    members = child_counts("alias_id", used_count=(tables["users"], "alias_id"))
    return with_counts(tables["aliases"].select("id", "display_name"), members, "id", "alias_id")


def signup_stats(tables: Tables) -> DataFrame:
    """New users per day."""
    return tables["users"].groupBy(F.to_date("created_at").alias("signup_date")).agg(
        F.count(F.lit(1)).alias("new_user_count")
    )


ORDERS = {
    "alias_ranking": ["user_count DESC NULLS LAST", "display_name ASC NULLS LAST"],
    "school_ranking": ["user_count DESC NULLS FIRST", "short_name ASC NULLS LAST"],
    "top_posts": ["like_count DESC", "comment_count DESC", "report_count DESC", "id ASC"],
    "signup_stats": ["signup_date DESC NULLS FIRST"],
}
VIEWS = {
    f.__name__: f
    for f in (alias_ranking, school_ranking, school_activity, top_posts, user_notifications, alias_usage, signup_stats)
}


def in_order(df: DataFrame, name: str) -> DataFrame:
    return df.orderBy(*[_sort_key(term) for term in ORDERS[name]])


def _sort_key(term: str) -> Column:
    column, direction, *nulls = term.split()
    method = "_".join([direction, *nulls]).lower()
    return getattr(F.col(column), method)()


def sorted_view(tables: Tables, name: str) -> DataFrame:
    df = VIEWS[name](tables)
    return in_order(df, name) if name in ORDERS else df
