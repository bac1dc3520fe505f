"""Hydration and counters for batches of ids.

Dimensions are joined without hints: Spark broadcasts them while their measured
size is below its threshold and shuffles them beyond it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forumlake.functions.exprs import image_url, live
from forumlake.functions.ranking import top_per_group
from forumlake.operators.counts import child_counts, with_counts
from forumlake.sources.tables import Tables


def image_urls(tables: Tables, key: str, url: str, only: DataFrame) -> DataFrame:
    """(key, url) of the images that `only` names in its column `key`.

    Images grow with attachments, icons and logos do not: reduced first, they stay small.
    """
    named = only.select(F.col(key).alias("id"))
    images = tables["images"].join(named, "id", "left_semi")
    return images.select(F.col("id").alias(key), image_url(F.col("base_url"), "id", F.col("format")).alias(url))


def alias_cards(tables: Tables) -> DataFrame:
    """(alias_id, display_name, avatar_url)."""
    aliases = tables["aliases"].select(
        F.col("id").alias("alias_id"), "display_name", F.col("icon_image_id").alias("icon_id")
    )
    return aliases.join(image_urls(tables, "icon_id", "avatar_url", aliases), "icon_id", "left").drop("icon_id")


def school_names(tables: Tables) -> DataFrame:
    """(school_id, school_name, school_short_name)."""
    return tables["schools"].select(
        F.col("id").alias("school_id"),
        F.col("name").alias("school_name"),
        F.col("short_name").alias("school_short_name"),
    )


def hydrate_posts(tables: Tables, ids: DataFrame) -> DataFrame:
    """Live posts for a frame of ids (column `id`) with author card, school and images.

    The school is the post's own. Missing permissions read as 'all', a missing
    alias as 'anonymous', a missing avatar as ''. `images` is a sorted array of
    distinct urls; use `to_json` at the edge where JSON is wanted.
    """
    posts = (
        tables["posts"]
        .where(live())
        .select("id", "user_id", "school_id", "content", "status", "created_at", "updated_at")
        .join(ids.select("id"), "id", "left_semi")
    )
    attached = tables["post_images"].select(F.col("post_id").alias("id"), "image_id")
    attached = attached.join(ids.select("id"), "id", "left_semi")
    pictures = (
        attached.join(image_urls(tables, "image_id", "url", attached), "image_id", "left")
        .groupBy("id")
        .agg(F.array_sort(F.collect_set("url")).alias("images"))
    )
    permissions = tables["post_permissions"].select(
        F.col("post_id").alias("id"), "comment_permission", "view_permission"
    )
    authors = tables["users"].select(F.col("id").alias("user_id"), "alias_id")
    return (
        posts.join(permissions, "id", "left")
        .join(pictures, "id", "left")
        .join(authors, "user_id", "left")
        .join(alias_cards(tables), "alias_id", "left")
        .join(school_names(tables), "school_id", "left")
        .select(
            "id",
            "user_id",
            "school_id",
            F.coalesce("avatar_url", F.lit("")).alias("avatar_url"),
            F.coalesce("display_name", F.lit("anonymous")).alias("display_name"),
            "school_name",
            "school_short_name",
            "content",
            F.coalesce("images", F.array().cast("array<string>")).alias("images"),
            "status",
            F.coalesce("comment_permission", F.lit("all")).alias("comment_permission"),
            F.coalesce("view_permission", F.lit("all")).alias("view_permission"),
            "created_at",
            "updated_at",
        )
    )


def post_counters(tables: Tables, ids: DataFrame) -> DataFrame:
    """(id, total_like, total_dislike, total_comment) per distinct id; 0 for unknown ids."""
    counts = child_counts(
        "post_id",
        only=ids.select(F.col("id").alias("post_id")),
        total_like=(tables["post_likes"], "post_id"),
        total_dislike=(tables["post_dislikes"], "post_id"),
        total_comment=(tables["comments"], "post_id"),
    )
    return with_counts(ids.select("id").distinct(), counts, "id", "post_id")


def user_interactions(tables: Tables, pairs: DataFrame) -> DataFrame:
    """(user_id, post_id, is_liked, is_disliked), one row per input pair, repeats kept.

    A call for one user is the same with that user's pairs.
    """
    key = ["user_id", "post_id"]
    reactions = (
        tables["post_likes"].select(*key, F.lit(1).alias("up"), F.lit(0).alias("down"))
        .unionByName(tables["post_dislikes"].select(*key, F.lit(0).alias("up"), F.lit(1).alias("down")))
        .join(pairs.select(*key), key, "left_semi")
        .groupBy(*key)
        .agg((F.max("up") > 0).alias("is_liked"), (F.max("down") > 0).alias("is_disliked"))
    )
    return pairs.select(*key).join(reactions, key, "left").select(
        *key,
        F.coalesce("is_liked", F.lit(False)).alias("is_liked"),
        F.coalesce("is_disliked", F.lit(False)).alias("is_disliked"),
    )


def comment_page(
    tables: Tables, post_id, parent=None, limit: int = 20, cursor: int | None = None
) -> DataFrame:
    """Ids of one page, ascending. Without `parent` the top level; deleted ones included."""
    page = tables["comments"].where(F.col("post_id") == post_id)
    page = page.where(F.col("parent_comment_id").eqNullSafe(F.lit(parent)))
    if cursor is not None:
        page = page.where(F.col("id") > cursor)
    return page.select("id").orderBy("id").limit(limit)


def comment_pages(tables: Tables, asked: DataFrame, n: int = 20) -> DataFrame:
    """Pages of many threads at once: (request columns, page_rank, id).

    `asked` has post_id, parent_comment_id (NULL: the top level), cursor (the last id seen; NULL:
    from the start) and may have more columns. The thread of a NULL parent matches null-safely.
    A thread that is asked for with several cursors gets a page for each; ranking is limited
    before the shuffle, so a viral thread sends at most a page per request and task.
    """
    asked = asked.withColumn("_ask", F.struct("post_id", "parent_comment_id", "cursor")).alias("a")
    each = asked.select("_ask").distinct()
    comments = tables["comments"].select("post_id", "parent_comment_id", "id").alias("c")
    inside = (
        (F.col("c.post_id") == F.col("_ask.post_id"))
        & F.col("c.parent_comment_id").eqNullSafe(F.col("_ask.parent_comment_id"))
        & (F.col("_ask.cursor").isNull() | (F.col("c.id") > F.col("_ask.cursor")))
    )
    found = comments.join(each, inside).select("_ask", F.col("c.id").alias("id"))
    pages = top_per_group(found, ["_ask"], [F.col("id").asc()], n, "page_rank")
    pages = pages.withColumnRenamed("_ask", "_of")
    same = F.col("_ask").eqNullSafe(F.col("_of"))
    return asked.join(pages, same).drop("_ask", "_of")


def first_comments(tables: Tables, n: int = 20) -> DataFrame:
    """First page of top-level comments of every post: (post_id, page_rank, id)."""
    top = tables["comments"].where(F.col("parent_comment_id").isNull()).select("post_id", "id")
    return top_per_group(top, ["post_id"], [F.col("id").asc()], n, "page_rank").select("post_id", "page_rank", "id")


def first_replies(tables: Tables, n: int = 20) -> DataFrame:
    """First page of replies of every comment: (post_id, parent_comment_id, page_rank, id)."""
    replies = tables["comments"].where(F.col("parent_comment_id").isNotNull())
    replies = replies.select("post_id", "parent_comment_id", "id")
    keys = ["post_id", "parent_comment_id"]
    return top_per_group(replies, keys, [F.col("id").asc()], n, "page_rank").select(*keys, "page_rank", "id")


def hydrate_comments(tables: Tables, ids: DataFrame) -> DataFrame:
    """Comments for a frame of ids with author card; the school is the author's."""
    authors = tables["users"].select(F.col("id").alias("user_id"), "alias_id", "school_id")
    return (
        tables["comments"]
        .join(ids.select("id"), "id", "left_semi")
        .join(authors, "user_id", "left")
        .join(alias_cards(tables), "alias_id", "left")
        .join(school_names(tables), "school_id", "left")
        .select(
            "id",
            "post_id",
            "parent_comment_id",
            "user_id",
            F.coalesce("display_name", F.lit("anonymous")).alias("display_name"),
            F.coalesce("avatar_url", F.lit("")).alias("avatar_url"),
            "school_short_name",
            "content",
            "created_at",
            "updated_at",
            "deleted_at",
        )
    )


def reply_counts(tables: Tables, ids: DataFrame) -> DataFrame:
    """(comment_id, total_replies) per distinct id; deleted replies count."""
    counts = child_counts(
        "parent_id", only=ids.select(F.col("id").alias("parent_id")),
        total_replies=(tables["comments"], "parent_comment_id"),
    )
    wanted = ids.select(F.col("id").alias("comment_id")).distinct()
    return with_counts(wanted, counts, "comment_id", "parent_id")


def user_profiles(tables: Tables, ids: DataFrame | None = None) -> DataFrame:
    """Profile of users (all, or those in `ids`): account, alias card, school. Any status.

    Credentials are never selected.
    """
    account = [
        "email", "login_method", "alias_id", "alias_index", "school_id", "status",
        "banned_reason", "deleted_reason", "updated_alias_at", "created_at", "updated_at", "deleted_at",
    ]
    users = tables["users"]
    if ids is not None:
        users = users.join(ids.select("id"), "id", "left_semi")
    logos = tables["schools"].select(F.col("id").alias("school_id"), F.col("logo_image_id").alias("logo_id"))
    logos = logos.join(image_urls(tables, "logo_id", "school_logo_url", logos), "logo_id", "left").drop("logo_id")
    schools = school_names(tables).join(logos, "school_id", "left")
    return (
        users.select(F.col("id").alias("user_id"), *account)
        .join(alias_cards(tables), "alias_id", "left")
        .join(schools, "school_id", "left")
        .select(
            "user_id", "email", "login_method", "alias_id", "alias_index", "display_name", "avatar_url",
            "school_id", "school_name", "school_short_name", "school_logo_url", "status", "banned_reason",
            "deleted_reason", "updated_alias_at", "created_at", "updated_at", "deleted_at",
        )
    )
