"""Bulk post ingestion and edits."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forumlake import messages as M
from forumlake.functions.exprs import actor_key, blank, first_reason, in_domain, is_moderator, live, ntz, with_optional
from forumlake.operators.outcome import Outcome, decide, moderation_log, with_serial
from forumlake.schema import ENUMS, SCORE
from forumlake.session import freeze
from forumlake.sources.tables import Tables

ORDER = ("requested_at", "request_id")
NO_TEXT = "CAST(NULL AS STRING)"
ID_LENGTH = 12


def post_key(request_id: str, turn: int = 0) -> Column:
    """Post id derived from the request, so a retried task yields the same one: 72 bits of its hash.

    Each further turn takes the next characters of the hash, then those of the next hash.
    """
    per_hash = 43 // ID_LENGTH  # url-safe characters of 256 bits
    number, at = divmod(turn, per_hash)
    text = F.col(request_id).cast("string")
    digest = F.base64(F.unhex(F.sha2(F.concat(text, F.lit(f":{number}")) if number else text, 256)))
    return F.substring(F.translate(digest, "+/", "-_"), at * ID_LENGTH + 1, ID_LENGTH)


def assign_ids(requests: DataFrame, posts: DataFrame) -> DataFrame:
    """(request_id, post_id): an id of its own for every request (request_id and `ORDER`).

    All requests try their first id; of those that meet, the first in arrival order gets it,
    unless a stored post has it. The others go on with their next id, among themselves and
    against all ids given so far. Usually nobody goes on, and no further pass is planned.
    """
    stored = posts.select(F.col("id").cast("string").alias("post_id"))
    first = F.min(F.struct(*ORDER)).alias("_first")
    left, given, turn = requests.select(*dict.fromkeys(("request_id", *ORDER))), None, 0
    while True:
        tries = left.withColumn("post_id", post_key("request_id", turn))
        free = tries.join(stored, "post_id", "left_anti")
        if given is not None:
            free = free.join(given.select("post_id"), "post_id", "left_anti")
        won = free.groupBy("post_id").agg(first).select(F.col("_first.request_id").alias("request_id"), "post_id")
        won = freeze(won)
        given = won if given is None else freeze(given.unionByName(won))
        left = left.join(won.select("request_id"), "request_id", "left_anti")
        if not left.take(1):
            return given
        left, turn = freeze(left), turn + 1


def array_length(column: str) -> Column:
    """Number of elements; NULL for an empty or NULL array."""
    return F.when(F.size(column) > 0, F.size(column))


def _unknown(requests: DataFrame, array: str, parent: DataFrame, out: str) -> DataFrame:
    """Requests whose array names a row the parent table lacks."""
    named = requests.select("request_id", F.explode(array).alias("_ref")).where(F.col("_ref").isNotNull())
    parent_ids = parent.select(F.col("id").alias("_ref"))
    return named.join(parent_ids, "_ref", "left_anti").select("request_id").distinct().withColumn(out, F.lit(True))


def _has_null(array: str) -> Column:
    return F.exists(array, lambda x: x.isNull())


def _has_repeat(array: str) -> Column:
    return F.size(F.array_distinct(array)) < F.size(array)


def ingest_posts(tables: Tables, requests: DataFrame, as_of: datetime | str) -> Outcome:
    """Confession posts with topics, images and permissions.

    Requests: user_id, school_id, content, topic_ids, topic_scores, image_ids, status,
    hidden_reason, comment_permission, view_permission; columns from topic_ids on may be
    absent and then take the defaults below. A row is accepted or rejected as a whole. The author's own school is not compared with the target school.
    """
    requests = with_optional(
        requests, topic_ids="CAST(array() AS ARRAY<BIGINT>)", topic_scores=f"CAST(array() AS ARRAY<{SCORE.simpleString()}>)",
        image_ids="CAST(array() AS ARRAY<STRING>)", status="'active'", hidden_reason=NO_TEXT,
        comment_permission="'all'", view_permission="'all'",
    )
    users = tables["users"].where(live()).select(F.col("id").alias("_user"))
    schools = tables["schools"].where("is_active").select(F.col("id").alias("_school"))
    checked = (
        requests.join(users, requests["user_id"] == users["_user"], "left")
        .join(schools, requests["school_id"] == schools["_school"], "left")
        .join(_unknown(requests, "topic_ids", tables["topics"], "_bad_topic"), "request_id", "left")
        .join(_unknown(requests, "image_ids", tables["images"], "_bad_image"), "request_id", "left")
    )
    topics, scores, images = (array_length(c) for c in ("topic_ids", "topic_scores", "image_ids"))
    limit = 10 ** (SCORE.precision - SCORE.scale)
    enums = [
        ("status", "post_status"), ("hidden_reason", "hidden_reason"),
        ("comment_permission", "permission_type"), ("view_permission", "permission_type"),
    ]
    reason = first_reason(
        *[(~in_domain(c, ENUMS[domain]), M.BAD_ENUM.format(c)) for c, domain in enums],
        (blank("content"), M.POST_EMPTY),
        (F.length("content") > M.MAX_POST_LENGTH, M.POST_TOO_LONG),
        (images > M.MAX_POST_IMAGES, M.POST_TOO_MANY_IMAGES),
        (F.col("_user").isNull(), M.POST_BAD_USER),
        (F.col("_school").isNull(), M.POST_BAD_SCHOOL),
        (topics.isNull(), M.POST_NO_TOPIC),
        (~topics.eqNullSafe(scores), M.POST_TOPIC_MISMATCH),
        *[
            (F.col(c).isNull(), M.NULL_VALUE.format(c))
            for c in ("status", "content", "comment_permission", "view_permission")
        ],
        (_has_null("topic_ids"), M.NULL_VALUE.format("topic_id")),
        (_has_null("topic_scores"), M.NULL_VALUE.format("score")),
        (F.exists("topic_scores", lambda s: F.abs(F.round(s, SCORE.scale)) >= limit), M.BAD_RANGE.format("score")),
        (_has_repeat("topic_ids"), M.DUPLICATE_VALUE.format("topic_id")),
        (F.col("_bad_topic"), M.UNKNOWN_REFERENCE.format("topic_id")),
        (_has_null("image_ids"), M.NULL_VALUE.format("image_id")),
        (_has_repeat("image_ids"), M.DUPLICATE_VALUE.format("image_id")),
        (F.col("_bad_image"), M.UNKNOWN_REFERENCE.format("image_id")),
    )
    judged = checked.select(*[requests[c] for c in requests.columns], reason.alias("reason"))

    ids = assign_ids(freeze(judged.where(F.col("reason").isNull()).select(*dict.fromkeys(("request_id", *ORDER)))), tables["posts"])
    post_id = F.coalesce(ids["post_id"], post_key("request_id")).alias("post_id")  # rejected requests show their first id
    decided = decide(judged.join(ids, "request_id", "left").select(*[judged[c] for c in requests.columns], post_id, "reason"))

    def build(outcome: Outcome):
        rows = outcome.applied
        now = ntz(as_of)
        posts = rows.select(
            F.col("post_id").alias("id"), F.lit("confession").alias("post_type"), "user_id", "school_id",
            "status", "content", "hidden_reason", now.alias("created_at"), now.alias("updated_at"),
        )
        permissions = rows.select(
            "post_id", "comment_permission", "view_permission", now.alias("created_at"), *ORDER
        )
        return {
            "posts": posts,
            "post_permissions": lambda: with_serial(tables, "post_permissions", permissions, *ORDER).drop(*ORDER),
            "post_topics": lambda: _serials(tables, "post_topics", topic_rows(rows, as_of)),
            "post_images": lambda: _serials(tables, "post_images", image_rows(rows, as_of)),
        }, {}

    return Outcome(decided, build)


def _serials(tables: Tables, table: str, rows: DataFrame) -> DataFrame:
    by = (*ORDER, "position")
    return with_serial(tables, table, rows, *by).drop(*by)


def topic_rows(rows: DataFrame, as_of: datetime | str) -> DataFrame:
    """One row per (post, topic, score); the arrays are read in parallel."""
    pairs = F.arrays_zip(F.col("topic_ids").alias("topic_id"), F.col("topic_scores").alias("score"))
    return rows.select("post_id", *ORDER, F.posexplode(pairs).alias("position", "pair")).select(
        "post_id",
        F.col("pair").getField("topic_id").alias("topic_id"),
        F.col("pair").getField("score").cast(SCORE).alias("score"),
        ntz(as_of).alias("created_at"),
        *ORDER,
        "position",
    )


def image_rows(rows: DataFrame, as_of: datetime | str) -> DataFrame:
    """One row per (post, image)."""
    return rows.select(
        "post_id", F.posexplode("image_ids").alias("position", "image_id"), ntz(as_of).alias("created_at"), *ORDER
    )


def apply_post_edits(tables: Tables, requests: DataFrame, as_of: datetime | str) -> Outcome:
    """Edits by owners and moderators. Requests: requesting_user_id, post_id, content,
    comment_permission, view_permission, moderation_reason (each new value optional).

    Per column the last accepted value stays. Content edits move updated_at, permission
    edits do not; each moderator edit of another's post is logged.
    """
    requests = with_optional(requests, content=NO_TEXT, comment_permission=NO_TEXT, view_permission=NO_TEXT, moderation_reason=NO_TEXT)
    posts = tables["posts"].select(
        F.col("id").alias("_post"), F.col("user_id").alias("_owner"),
        F.col("status").alias("_status"), F.col("deleted_at").alias("_gone"),
    )
    moderators = tables["users"].where(is_moderator()).select(
        F.col("id").cast("string").alias("_mod")
    )
    found = requests.join(posts, requests["post_id"] == posts["_post"], "left")
    found = found.join(moderators, actor_key("requesting_user_id") == moderators["_mod"], "left")
    owner = F.coalesce(actor_key("requesting_user_id") == F.col("_owner").cast("string"), F.lit(False))
    given = [F.col(c).isNotNull() for c in ("content", "comment_permission", "view_permission")]
    reason = first_reason(
        *[
            (~in_domain(c, ENUMS["permission_type"]), M.BAD_ENUM.format(c))
            for c in ("comment_permission", "view_permission")
        ],
        (~(given[0] | given[1] | given[2]), M.POST_NO_UPDATE),
        (F.col("_post").isNull(), M.POST_NOT_FOUND),
        (F.col("_gone").isNotNull(), M.POST_UPDATE_DELETED),
        (F.col("_status") == "hidden", M.POST_UPDATE_HIDDEN),
        (~owner & F.col("_mod").isNull(), M.POST_UPDATE_DENIED),
    )
    decided = decide(
        found.select(*[requests[c] for c in requests.columns], owner.alias("by_owner"), reason.alias("reason"))
    )

    def build(outcome: Outcome):
        rows = outcome.applied
        edits = rows.groupBy("post_id").agg(*[_last_given(c) for c in (
            "content", "comment_permission", "view_permission")])
        contents = edits.where(F.col("content").isNotNull()).select(
            F.col("post_id").alias("id"), "content", ntz(as_of).alias("updated_at")
        )
        current = tables["post_permissions"].select(
            "id", "post_id", F.col("comment_permission").alias("_comment"), F.col("view_permission").alias("_view")
        )
        changed = edits.where(F.coalesce("comment_permission", "view_permission").isNotNull())
        permissions = changed.join(current, "post_id").select(
            "id",
            F.coalesce("comment_permission", "_comment").alias("comment_permission"),
            F.coalesce("view_permission", "_view").alias("view_permission"),
        )
        log = lambda: moderation_log(
            tables, rows.where(~F.col("by_owner")), as_of, M.ACTION_UPDATE_POST, "post",
            "requesting_user_id", "post_id", "moderation_reason",
        )
        return {"moderation_logs": log}, {"posts": contents, "post_permissions": permissions}

    return Outcome(decided, build)


def _last_given(column: str) -> Column:
    order = ", ".join(ORDER)
    return F.expr(f"max_by({column}, struct({order})) FILTER (WHERE {column} IS NOT NULL)").alias(column)


