"""Moderation in batches: deletes, hides and report thresholds.

Requests take effect in arrival order: the first permitted one per target is applied
and later ones see its result. Roles are looked up against moderators only, a frame
that is far smaller than the users.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forumlake import messages as M
from forumlake.functions.exprs import actor_key, first_reason, in_domain, is_moderator, is_system, ntz, with_optional
from forumlake.functions.ranking import top_per_group
from forumlake.operators.outcome import Outcome, decide, moderation_log
from forumlake.schema import ENUMS, SYSTEM_ACTOR
from forumlake.sources.tables import Tables

ORDER = ("requested_at", "request_id")
NO_TEXT = "CAST(NULL AS STRING)"
ACTOR = "requesting_user_id"


def _with_role(tables: Tables, requests: DataFrame) -> DataFrame:
    """Adds `_mod`, set for moderators and admins. Unknown actors have no role."""
    moderators = tables["users"].where(is_moderator()).select(F.col("id").cast("string").alias("_mod"))
    return requests.join(moderators, actor_key(ACTOR) == moderators["_mod"], "left")


def _is(owner: str) -> Column:
    return F.coalesce(actor_key(ACTOR) == F.col(owner).cast("string"), F.lit(False))


def _with_first(judged: DataFrame, key: str, effective: Column) -> DataFrame:
    """Adds `_first`, the order of the first effective request on the same target.

    Requests without effect and those without a target are passed over, not filtered: a filter,
    also the one that a join adds to its grouping key, would be pushed down on this side only,
    and the requests would be read, joined and shuffled once more.
    """
    first = F.min(F.when(effective, F.struct(*ORDER))).alias("_first")
    first = judged.groupBy(key).agg(F.max(key).alias("_target"), first).drop(key)
    return judged.join(first, judged[key] == first["_target"], "left").drop("_target")


def _after_first() -> Column:
    return F.coalesce(F.col("_first") < F.struct(*ORDER), F.lit(False))


def apply_post_deletes(tables: Tables, requests: DataFrame, as_of: datetime | str) -> Outcome:
    """Soft deletes by owner, system or moderators. Requests: requesting_user_id, post_id,
    reason_category, detailed_reason (optional). Missing or already deleted posts are no-ops.
    """
    requests = with_optional(requests, detailed_reason=NO_TEXT)
    posts = tables["posts"].select(
        F.col("id").alias("_post"), F.col("user_id").alias("_owner"), F.col("deleted_at").alias("_gone")
    )
    found = _with_role(tables, requests.join(posts, requests["post_id"] == posts["_post"], "left"))
    by_owner, by_system = _is("_owner"), is_system(ACTOR)
    code = F.when(by_owner, "user").when(by_system, "system").when(F.col("_mod").isNotNull(), "mod")
    judged = found.select(
        *[requests[c] for c in requests.columns],
        (F.col("_post").isNotNull() & F.col("_gone").isNull()).alias("_open"),
        code.alias("deleted_reason"),
        by_owner.alias("by_owner"),
    )
    allowed = F.col("deleted_reason").isNotNull()
    judged = _with_first(judged, "post_id", F.col("_open") & allowed)
    noop = ~F.col("_open") | _after_first()
    reason = F.when(~noop & ~allowed, F.lit(M.POST_DELETE_DENIED))
    decided = decide(
        judged.select(
            *requests.columns, "deleted_reason", "by_owner", noop.alias("_noop"), reason.alias("reason")
        ),
        noop=F.col("_noop"),
    ).drop("_noop")

    def build(outcome: Outcome):
        rows = outcome.applied
        delta = rows.select(
            F.col("post_id").alias("id"),
            ntz(as_of).alias("deleted_at"),
            F.lit("deleted").alias("status"),
            "deleted_reason",
        )
        log = lambda: moderation_log(
            tables, rows.where(~F.col("by_owner")), as_of, M.ACTION_DELETE_POST, "post",
            ACTOR, "post_id", "detailed_reason",
        )
        return {"moderation_logs": log}, {"posts": delta}

    return Outcome(decided, build)


def apply_post_hides(tables: Tables, requests: DataFrame, as_of: datetime | str) -> Outcome:
    """Hides by system or moderators; owning the post is not enough. Always logged."""
    requests = with_optional(requests, detailed_reason=NO_TEXT)
    posts = tables["posts"].select(F.col("id").alias("_post"), F.col("status").alias("_status"))
    found = _with_role(tables, requests.join(posts, requests["post_id"] == posts["_post"], "left"))
    reason = first_reason(
        (~in_domain("reason_category", ENUMS["hidden_reason"]), M.BAD_ENUM.format("reason_category")),
        (~is_system(ACTOR) & F.col("_mod").isNull(), M.POST_HIDE_DENIED),
        (F.col("_post").isNull(), M.POST_NOT_FOUND),
        (F.col("_status") != "active", M.POST_NOT_ACTIVE),
    )
    judged = found.select(*[requests[c] for c in requests.columns], reason.alias("reason"))
    judged = _with_first(judged, "post_id", F.col("reason").isNull())
    reason = F.coalesce("reason", F.when(_after_first(), F.lit(M.POST_NOT_ACTIVE)))
    decided = decide(judged.select(*requests.columns, reason.alias("reason")))

    def build(outcome: Outcome):
        rows = outcome.applied
        delta = rows.select(
            F.col("post_id").alias("id"),
            F.lit("hidden").alias("status"),
            F.col("reason_category").alias("hidden_reason"),
        )
        log = lambda: moderation_log(
            tables, rows, as_of, M.ACTION_HIDE_POST, "post", ACTOR, "post_id", "detailed_reason"
        )
        return {"moderation_logs": log}, {"posts": delta}

    return Outcome(decided, build)


def apply_comment_deletes(
    tables: Tables, requests: DataFrame, as_of: datetime | str, prefix: str = M.DELETED_COMMENT_PREFIX
) -> Outcome:
    """Soft deletes of comments by system, owner, moderators or the post's owner.

    Requests: requesting_user_id, comment_id, reason (optional). The content is replaced by
    `prefix` and a code that names who deleted it.
    """
    comments = tables["comments"].select(
        F.col("id").alias("_comment"), F.col("user_id").alias("_owner"),
        F.col("post_id").alias("_on"), F.col("deleted_at").alias("_gone"),
    )
    posts = tables["posts"].select(F.col("id").alias("_post"), F.col("user_id").alias("_post_owner"))
    found = with_optional(requests, reason=NO_TEXT).withColumnRenamed("reason", "log_reason")
    columns = found.columns
    found = found.join(comments, found["comment_id"] == comments["_comment"], "left")
    found = _with_role(tables, found.join(posts, found["_on"] == posts["_post"], "left"))
    by_owner = _is("_owner")
    code = (
        F.when(is_system(ACTOR), M.DELETED_BY_SYSTEM)
        .when(by_owner, M.DELETED_BY_OWNER)
        .when(F.col("_mod").isNotNull(), M.DELETED_BY_MODERATOR)
        .when(_is("_post_owner"), M.DELETED_BY_POST_OWNER)
    )
    judged = found.select(
        *columns,
        (F.col("_post").isNotNull() & F.col("_gone").isNull()).alias("_open"),
        code.alias("code"),
        by_owner.alias("by_owner"),
    )
    allowed = F.col("code").isNotNull()
    judged = _with_first(judged, "comment_id", F.col("_open") & allowed)
    noop = ~F.col("_open") | _after_first()
    reason = F.when(~noop & ~allowed, F.lit(M.COMMENT_DELETE_DENIED))
    decided = decide(
        judged.select(*columns, "code", "by_owner", noop.alias("_noop"), reason.alias("reason")),
        noop=F.col("_noop"),
    ).drop("_noop")

    def build(outcome: Outcome):
        rows = outcome.applied
        delta = rows.select(
            F.col("comment_id").alias("id"),
            ntz(as_of).alias("deleted_at"),
            F.concat(F.lit(prefix), F.col("code")).alias("content"),
        )
        log = lambda: moderation_log(
            tables, rows.where(~F.col("by_owner")), as_of, M.ACTION_DELETE_COMMENT, "comment",
            ACTOR, "comment_id", "log_reason",
        )
        return {"moderation_logs": log}, {"comments": delta}

    return Outcome(decided, build)


# ------------------------------------------------------------------ report thresholds


def report_threshold(settings: DataFrame, key: str, default: int = M.DEFAULT_REPORT_THRESHOLD) -> int:
    """Threshold stored under `key`; the default when absent or not a number."""
    row = settings.where(F.col("key") == key).select(F.expr("try_cast(value AS INT)")).first()
    return default if row is None or row[0] is None else row[0]


def _admissible(
    tables: Tables, reports: DataFrame, table: str, target: str, columns: list[str]
) -> tuple[DataFrame, DataFrame]:
    """Reports with the first constraint they violate (`reason`), and the stored
    reports per target (`_target`, `_existing`).

    Of several reports by one user on one target the earliest may stand, unless one is
    already stored; callers find it with a min per (target, user), which combines
    before the shuffle.
    """
    pair = [target, "user_id"]
    parent = "posts" if table == "post_reports" else "comments"
    # stored reports grow without end: only those on targets of the batch go on
    stored = tables[table].select(*pair).join(reports.select(target), target, "left_semi")
    known = stored.withColumn("_stored", F.lit(True))
    users = tables["users"].select(F.col("id").alias("_user"))
    targets = tables[parent].select(F.col("id").alias("_parent"), *[F.col(c).alias(f"_{c}") for c in columns])
    found = reports.join(targets, reports[target] == targets["_parent"], "left")
    found = found.join(users, found["user_id"] == users["_user"], "left")
    found = found.join(known, pair, "left")
    reason = first_reason(
        *[(F.col(c).isNull(), M.NULL_VALUE.format(c)) for c in (target, "user_id", "reason")],
        (F.col("_stored"), M.DUPLICATE_VALUE.format(f"{target}, user_id")),
        (F.col("_parent").isNull(), M.UNKNOWN_REFERENCE.format(target)),
        (F.col("_user").isNull(), M.UNKNOWN_REFERENCE.format("user_id")),
    )
    judged = found.select(
        *[reports[c] for c in reports.columns if c != "reason"],
        reports["reason"].alias("report_reason"),
        *[f"_{c}" for c in columns],
        reason.alias("reason"),
    )
    existing = stored.groupBy(F.col(target).alias("_target")).agg(F.count(F.lit(1)).alias("_existing"))
    return judged, existing


def hide_reported_posts(
    tables: Tables, reports: DataFrame, as_of: datetime | str, threshold: int | None = None
) -> Outcome:
    """New post reports (id, post_id, user_id, reason, created_at) against the threshold,
    which is looked up in the settings unless it is given.

    In (created_at, id) order a report is accepted while the running count stays
    below the threshold; on an active post the one that reaches it is accepted too
    and hides the post. Every further one is rejected, for the post is no longer
    active. Only the first `threshold` reports per post need a rank, so a post with
    most of the reports is cut down before the shuffle.
    """
    if threshold is None:
        threshold = report_threshold(tables["system_settings"], M.POST_THRESHOLD_KEY)
    judged, existing = _admissible(tables, reports, "post_reports", "post_id", ["status"])
    order = F.struct("created_at", "id")
    firsts = (
        judged.where(F.col("reason").isNull())
        .groupBy("post_id", "user_id")
        .agg(F.min(order).alias("_at"), F.first("_status").alias("_status"))
        .select("post_id", "user_id", "_status", "_at.created_at", "_at.id")
    )
    ranked = top_per_group(firsts, ["post_id"], [F.col("created_at"), F.col("id")], max(threshold, 1), "_n")
    ranked = ranked.join(existing, ranked["post_id"] == existing["_target"], "left")
    stored = F.coalesce("_existing", F.lit(0))
    active = F.col("_status") == "active"
    room = F.when(active, F.greatest(F.lit(threshold) - stored, F.lit(1))).otherwise(F.lit(threshold - 1) - stored)
    passed = ranked.where(F.col("_n") <= room).select(
        F.col("post_id").alias("_on"),
        F.col("user_id").alias("_by"),
        F.col("id").alias("_id"),
        (stored + F.col("_n")).alias("running"),
        (active & (stored + F.col("_n") >= threshold)).alias("hides"),
    )
    full = judged.join(passed, (judged["post_id"] == passed["_on"]) & (judged["user_id"] == passed["_by"]), "left")
    # A repeat of an accepted report breaks uniqueness; a repeat of a refused one is refused again.
    late = F.when(F.col("_id").isNull(), F.lit(M.POST_NOT_ACTIVE)).when(
        F.col("_id") != F.col("id"), F.lit(M.DUPLICATE_VALUE.format("post_id, user_id"))
    )
    first = F.col("_id") == F.col("id")
    decided = decide(
        full.select(
            "id", "post_id", "user_id", "report_reason", "created_at",
            F.when(first, F.col("running")).alias("running"),
            F.coalesce(first & F.col("hides"), F.lit(False)).alias("hides"),
            F.coalesce("reason", late).alias("reason"),
        )
    )

    def build(outcome: Outcome):
        rows = outcome.applied
        hidden = rows.where("hides")
        delta = hidden.select(
            F.col("post_id").alias("id"), F.lit("hidden").alias("status"), F.lit("report").alias("hidden_reason")
        )
        detail = F.concat(
            F.lit(M.AUTO_HIDE_PREFIX), F.col("running").cast("string"), F.lit(f"/{threshold}{M.AUTO_HIDE_SUFFIX}")
        )
        log = lambda: moderation_log(
            tables,
            hidden.select("post_id", "created_at", "id", detail.alias("detail"), F.lit(SYSTEM_ACTOR).alias("actor")),
            as_of, M.ACTION_HIDE_POST, "post", "actor", "post_id", "detail", order=("created_at", "id"),
        )
        return (
            {"post_reports": _report_rows(rows, "post_id"), "moderation_logs": log},
            {"posts": delta},
        )

    return Outcome(decided, build)


def delete_reported_comments(
    tables: Tables,
    reports: DataFrame,
    as_of: datetime | str,
    threshold: int | None = None,
    prefix: str = M.DELETED_COMMENT_PREFIX,
) -> Outcome:
    """New comment reports against the threshold, which is looked up in the settings
    unless it is given. All admissible ones are accepted; a comment whose count reaches
    the threshold is deleted by the system once.
    """
    if threshold is None:
        threshold = report_threshold(tables["system_settings"], M.COMMENT_THRESHOLD_KEY)
    judged, existing = _admissible(tables, reports, "comment_reports", "comment_id", [])
    firsts = (
        judged.where(F.col("reason").isNull())
        .groupBy("comment_id", "user_id")
        .agg(F.min(F.struct("created_at", "id")).alias("_at"))
        .select(F.col("_at.id").alias("_first_id"))
    )
    joined = judged.join(firsts, judged["id"] == firsts["_first_id"], "left")
    repeat = F.when(F.col("_first_id").isNull(), F.lit(M.DUPLICATE_VALUE.format("comment_id, user_id")))
    decided = decide(
        joined.select(
            "id", "comment_id", "user_id", "report_reason", "created_at",
            F.coalesce("reason", repeat).alias("reason"),
        )
    )

    def build(outcome: Outcome):
        rows = outcome.applied
        added = rows.groupBy("comment_id").agg(F.count(F.lit(1)).alias("_added"))
        live = tables["comments"].where(F.col("deleted_at").isNull()).select(F.col("id").alias("comment_id"))
        added = added.join(live, "comment_id", "left_semi")
        totals = added.join(existing, added["comment_id"] == existing["_target"], "left")
        over = totals.where(F.col("_added") + F.coalesce("_existing", F.lit(0)) >= threshold).select("comment_id")
        delta = over.select(
            F.col("comment_id").alias("id"),
            ntz(as_of).alias("deleted_at"),
            F.lit(prefix + M.DELETED_BY_SYSTEM).alias("content"),
        )
        log = lambda: moderation_log(
            tables,
            over.select("comment_id", F.lit(M.AUTO_DELETE_REASON).alias("detail"), F.lit(SYSTEM_ACTOR).alias("actor")),
            as_of, M.ACTION_DELETE_COMMENT, "comment", "actor", "comment_id", "detail", order=("comment_id",),
        )
        return (
            {"comment_reports": _report_rows(rows, "comment_id"), "moderation_logs": log},
            {"comments": delta},
        )

    return Outcome(decided, build)


def _report_rows(rows: DataFrame, target: str) -> DataFrame:
    return rows.select("id", target, "user_id", F.col("report_reason").alias("reason"), "created_at")


