"""Bulk comment ingestion and edits.

Request frames carry `request_id` and `requested_at` (a total order) next to the
columns named in each function.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forumlake import messages as M
from forumlake.functions.exprs import blank, first_reason, is_distinct, live, ntz
from forumlake.operators.outcome import Outcome, decide, with_serial
from forumlake.sources.tables import Tables

ORDER = ("requested_at", "request_id")
NULL_PLACES = 1024


def _text_checks():
    return [
        (blank("content"), M.COMMENT_EMPTY),
        (F.length("content") > M.MAX_COMMENT_LENGTH, M.COMMENT_TOO_LONG),
    ]


def _with_author(tables: Tables, requests: DataFrame) -> DataFrame:
    """Adds `_user` and `_user_school` for authors that are live."""
    users = tables["users"].where(live()).select(
        F.col("id").alias("_user"), F.col("school_id").alias("_user_school")
    )
    return requests.join(users, requests["user_id"] == users["_user"], "left")


def _place(key: str) -> Column:
    """A second join column: 0, but for rows without a key, which meet nothing and are dealt over many tasks."""
    return F.when(F.col(key).isNull(), F.pmod(F.xxhash64(*ORDER), F.lit(NULL_PLACES)) + 1).otherwise(F.lit(0).cast("bigint"))


def _at_zero(key: str) -> Column:
    """Its counterpart: always 0, but no literal, which would drop out of the shuffle."""
    return F.pmod(F.xxhash64(key), F.lit(1)).cast("bigint")


def _with_post(tables: Tables, requests: DataFrame, key: str) -> DataFrame:
    """Adds `_post` and `_post_school` of live posts and the comment permission.

    Both joins go by `key`, so the requests move once, and requests without it are spread.
    """
    posts = tables["posts"].where(live()).select(
        F.col("id").alias("_post"), F.col("school_id").alias("_post_school"), _at_zero("id").alias("_post_place")
    )
    permissions = tables["post_permissions"].select(
        F.col("post_id").alias("_of"), F.col("comment_permission").alias("_permission"), _at_zero("post_id").alias("_of_place")
    )
    requests = requests.withColumn("_place", _place(key))
    joined = requests.join(posts, (requests[key] == posts["_post"]) & (requests["_place"] == posts["_post_place"]), "left")
    allowed = (F.col(key) == F.col("_of")) & (F.col("_place") == F.col("_of_place")) & F.col("_post").isNotNull()
    return joined.join(permissions, allowed, "left").drop("_of", "_place", "_post_place", "_of_place")


def _permission_checks(disabled: str):
    return [
        (F.col("_permission") == "none", disabled),
        ((F.col("_permission") == "school_only") & is_distinct("_user_school", "_post_school"), M.COMMENT_SCHOOL_ONLY),
    ]


def _insert_comments(tables: Tables, as_of: datetime | str, parent: bool):
    def build(outcome: Outcome):
        rows = outcome.applied.select(
            "post_id",
            "user_id",
            *(["parent_comment_id"] if parent else [F.lit(None).cast("bigint").alias("parent_comment_id")]),
            "content",
            ntz(as_of).alias("created_at"),
            ntz(as_of).alias("updated_at"),
            *ORDER,
        )
        return {"comments": with_serial(tables, "comments", rows, *ORDER)}, {}

    return build


def ingest_comments(tables: Tables, requests: DataFrame, as_of: datetime | str) -> Outcome:
    """Top-level comments. Requests: user_id, post_id, content.

    A post without a permission row takes comments. Ids follow arrival order, which
    is the paging order.
    """
    checked = _with_post(tables, _with_author(tables, requests), "post_id")
    reason = first_reason(
        *_text_checks(),
        (F.col("_user").isNull(), M.COMMENT_BAD_USER),
        (F.col("_post").isNull(), M.COMMENT_BAD_POST),
        *_permission_checks(M.COMMENT_DISABLED),
        (F.col("content").isNull(), M.NULL_VALUE.format("content")),
    )
    decided = decide(checked.select(*[requests[c] for c in requests.columns], reason.alias("reason")))
    return Outcome(decided, _insert_comments(tables, as_of, parent=False))


def ingest_replies(tables: Tables, requests: DataFrame, as_of: datetime | str) -> Outcome:
    """Replies to live top-level comments. Requests: user_id, parent_comment_id, content."""
    parents = tables["comments"].where(F.col("deleted_at").isNull()).select(
        F.col("id").alias("_parent"),
        F.col("post_id").alias("_parent_post"),
        F.col("parent_comment_id").alias("_grandparent"),
    )
    found = _with_author(tables, requests)
    found = found.join(parents, found["parent_comment_id"] == parents["_parent"], "left")
    checked = _with_post(tables, found, "_parent_post")
    reason = first_reason(
        *_text_checks(),
        (F.col("_user").isNull(), M.COMMENT_BAD_USER),
        (F.col("_parent").isNull(), M.REPLY_BAD_PARENT),
        (F.col("_grandparent").isNotNull(), M.REPLY_TOO_DEEP),
        (F.col("_post").isNull(), M.REPLY_BAD_POST),
        *_permission_checks(M.REPLY_DISABLED),
        (F.col("content").isNull(), M.NULL_VALUE.format("content")),
    )
    decided = decide(
        checked.select(
            *[requests[c] for c in requests.columns],
            F.col("_parent_post").alias("post_id"),
            reason.alias("reason"),
        )
    )
    return Outcome(decided, _insert_comments(tables, as_of, parent=True))


def apply_comment_edits(tables: Tables, requests: DataFrame, as_of: datetime | str) -> Outcome:
    """Owner edits. Requests: user_id, comment_id, content. The last accepted edit stays."""
    comments = tables["comments"].select(
        F.col("id").alias("_comment"), F.col("user_id").alias("_owner"), F.col("deleted_at").alias("_gone")
    )
    checked = requests.join(comments, requests["comment_id"] == comments["_comment"], "left")
    reason = first_reason(
        (blank("content"), M.COMMENT_EMPTY),
        (F.col("_comment").isNull(), M.EDIT_MISSING),
        (F.col("_gone").isNotNull(), M.EDIT_DELETED),
        (F.col("_owner") != F.col("user_id"), M.EDIT_DENIED),
        (F.col("user_id").isNull(), M.EDIT_DENIED),
        (F.col("content").isNull(), M.NULL_VALUE.format("content")),
    )
    decided = decide(checked.select(*[requests[c] for c in requests.columns], reason.alias("reason")))

    def build(outcome: Outcome):
        latest = outcome.applied.groupBy(F.col("comment_id").alias("id")).agg(
            F.max_by("content", F.struct(*ORDER)).alias("content")
        )
        return {}, {"comments": latest.withColumn("updated_at", ntz(as_of))}

    return Outcome(decided, build)
