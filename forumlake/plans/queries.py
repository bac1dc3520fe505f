"""Registered queries: every operator over the whole benchmark tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forumlake.operators import audit, comments, feed, hydrate, moderation, posts, purge, users
from forumlake.operators.outcome import apply_outcome, stamp, update_rows, update_stored
from forumlake.plans import views
from forumlake.schema import TABLES
from forumlake.session import work_dir
from forumlake.sources.benchdata import AS_OF, REQUESTS_AS_OF, BenchTables
from forumlake.sources.tables import append_events, typed_seed, with_defaults, with_ids, write_snapshot
from forumlake.streaming import jobs
from forumlake.streaming.audits import KeptAudit
from forumlake.streaming.reports import Activity, row_changes
from forumlake.streaming.zones import Zones, bounded_page

POST_THRESHOLD = 3
COMMENT_THRESHOLD = 3
PAGE_SCHOOL = 7
PAGE_TOPIC = "economy"
CURSOR = (0.001, 0)
PAGE = 2  # short pages, so that the cut shows

Query = Callable[[BenchTables], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


# ---------------------------------------------------------------- reports


@query
def q_alias_ranking(t):
    return views.sorted_view(t, "alias_ranking")


@query
def q_school_ranking(t):
    return views.sorted_view(t, "school_ranking")


@query
def q_school_activity(t):
    return views.school_activity(t)


@query
def q_top_posts(t):
    return views.top_posts(t)


@query
def q_top_posts_first(t):
    return views.top_posts(t, limit=100)


@query
def q_user_notifications(t):
    return views.user_notifications(t)


@query
def q_alias_usage(t):
    return views.alias_usage(t)


@query
def q_signup_stats(t):
    return views.sorted_view(t, "signup_stats")


ACTIVITY_CUT = "1998-01-01 00:00:00"


def _kept_activity(t) -> Activity:
    """Rows before and after a cut in time, then deleted posts, then deleted comments, each as a batch."""
    kept = Activity(t.spark, work_dir(t.spark, "activity"))
    names = ("posts", "comments", "post_likes", "post_reports", "users")
    for batch, side in enumerate(("<", ">=")):
        kept.apply(batch, {n: t[n].where(f"created_at {side} TIMESTAMP_NTZ'{ACTIVITY_CUT}'") for n in names})
    gone_posts = moderation.apply_post_deletes(t, t["post_moderation_requests"], REQUESTS_AS_OF)
    kept.apply(2, *row_changes(t, gone_posts))
    gone_comments = moderation.apply_comment_deletes(t, t["comment_moderation_requests"], REQUESTS_AS_OF)
    for _ in range(2):  # sent twice, counts once
        kept.apply(3, *row_changes(t, gone_comments))
    return kept


@query
def q_school_activity_kept(t):
    return _kept_activity(t).school_activity(t["schools"])


@query
def q_post_activity_kept(t):
    return _kept_activity(t).post_counts()


# ---------------------------------------------------------------- feed


@query
def q_interaction_score(t):
    return feed.interaction_scores(t, AS_OF)


@query
def q_hot_posts(t):
    return feed.hot_posts(t)


@query
def q_final_score(t):
    return feed.scored_posts(t, AS_OF).select("id", "user_id", "school_id", "final_score")


@query
def q_feed_page(t):
    return feed.feed_page(t, PAGE_SCHOOL, AS_OF)


@query
def q_feed_offset(t):
    return feed.feed_page(t, PAGE_SCHOOL, AS_OF, limit=40, offset=30)


@query
def q_feed_cursor(t):
    return feed.feed_page(t, PAGE_SCHOOL, AS_OF, limit=50, cursor=CURSOR)


def _school_zones(t):
    """Zones kept by batches: rows before and after a cut in time."""
    kept = Zones(t.spark, work_dir(t.spark, "zones"))
    for batch, side in enumerate(("<", ">=")):
        came = {n: t[n].where(f"created_at {side} TIMESTAMP_NTZ'{ACTIVITY_CUT}'") for n in ("posts", "post_likes", "comments")}
        kept.apply(batch, t, came)
    return kept.of_school(PAGE_SCHOOL)


@query
def q_feed_page_bounded(t):
    return bounded_page(t, _school_zones(t), PAGE_SCHOOL, AS_OF)


@query
def q_feed_cursor_bounded(t):
    return bounded_page(t, _school_zones(t), PAGE_SCHOOL, AS_OF, limit=50, cursor=CURSOR)


@query
def q_feed_topic(t):
    return feed.build_feeds(t, AS_OF, topic=PAGE_TOPIC)


@query
def q_feed_all(t):
    return feed.build_feeds(t, AS_OF)


# ---------------------------------------------------------------- hydration


def _asked_posts(t):
    return t["interaction_pairs"].select(F.col("post_id").alias("id"))


@query
def q_hydrate_posts(t):
    rows = hydrate.hydrate_posts(t, t["posts"].select("id"))
    return rows.withColumn("images", F.array_join("images", ","))


@query
def q_post_counters(t):
    return hydrate.post_counters(t, _asked_posts(t))


@query
def q_user_interactions(t):
    return hydrate.user_interactions(t, t["interaction_pairs"])


@query
def q_comment_page(t):
    return hydrate.first_comments(t, PAGE)


@query
def q_reply_page(t):
    return hydrate.first_replies(t, PAGE)


@query
def q_comment_page_cursor(t):
    """The page after the first comment of every thread, top levels and replies."""
    key = ["post_id", "parent_comment_id"]
    seen = t["comments"].groupBy(*key).agg(F.min("id").alias("cursor"))
    return hydrate.comment_pages(t, seen, PAGE).select(*key, "cursor", "page_rank", "id")


@query
def q_feed_hydrated(t):
    """The first feed pages of all schools with cards, counters and the reader's own flags, as one lazy plan."""
    pages = feed.build_feeds(t, AS_OF)
    cards = hydrate.hydrate_posts(t, pages.select("id")).select("id", "user_id", "display_name", "avatar_url", "content", "comment_permission")
    counters = hydrate.post_counters(t, pages.select("id"))
    readers = t["users"].where("role <> 'student'").select(F.col("id").alias("reader_id"), "school_id")
    shown = pages.join(readers, "school_id").join(cards, "id").join(counters, "id")
    flags = hydrate.user_interactions(t, shown.select(F.col("reader_id").alias("user_id"), F.col("id").alias("post_id")))
    flags = flags.select(F.col("user_id").alias("reader_id"), F.col("post_id").alias("id"), "is_liked", "is_disliked")
    return shown.join(flags, ["reader_id", "id"])


@query
def q_hydrate_comments(t):
    return hydrate.hydrate_comments(t, t["comments"].select("id"))


@query
def q_reply_counts(t):
    return hydrate.reply_counts(t, t["comments"].select("id"))


@query
def q_user_profiles(t):
    return hydrate.user_profiles(t)


# ---------------------------------------------------------------- ingestion


def _verdicts(outcome, *extra):
    return outcome.decided.select("request_id", "outcome", "reason", *extra)


@query
def q_ingest_posts(t):
    return _verdicts(posts.ingest_posts(t, t["post_requests"], AS_OF), "post_id")


@query
def q_ingest_post_rows(t):
    rows = posts.ingest_posts(t, t["post_requests"], AS_OF).inserts["posts"]
    return rows.select("id", "post_type", "user_id", "school_id", "status", "content", "hidden_reason", "created_at")


@query
def q_ingest_topics(t):
    return posts.ingest_posts(t, t["post_requests"], AS_OF).inserts["post_topics"].select(
        "id", "post_id", "topic_id", "score"
    )


@query
def q_ingest_images(t):
    return posts.ingest_posts(t, t["post_requests"], AS_OF).inserts["post_images"].select(
        "id", "post_id", "image_id"
    )


@query
def q_ingest_permissions(t):
    return posts.ingest_posts(t, t["post_requests"], AS_OF).inserts["post_permissions"].select(
        "id", "post_id", "comment_permission", "view_permission"
    )


@query
def q_ingest_comments(t):
    return _verdicts(comments.ingest_comments(t, t["comment_requests"], REQUESTS_AS_OF))


@query
def q_ingest_comment_rows(t):
    rows = comments.ingest_comments(t, t["comment_requests"], REQUESTS_AS_OF).inserts["comments"]
    return rows.select("id", "post_id", "user_id", "parent_comment_id", "content", "created_at")


@query
def q_ingest_replies(t):
    return _verdicts(comments.ingest_replies(t, t["reply_requests"], REQUESTS_AS_OF), "post_id")


@query
def q_ingest_reply_rows(t):
    rows = comments.ingest_replies(t, t["reply_requests"], REQUESTS_AS_OF).inserts["comments"]
    return rows.select("id", "post_id", "user_id", "parent_comment_id", "content", "created_at")


@query
def q_edit_comments(t):
    return _verdicts(comments.apply_comment_edits(t, t["comment_edit_requests"], REQUESTS_AS_OF))


@query
def q_edited_comments(t):
    outcome = comments.apply_comment_edits(t, t["comment_edit_requests"], REQUESTS_AS_OF)
    return apply_outcome(t, outcome)["comments"].select("id", "content", "updated_at")


@query
def q_edit_posts(t):
    return _verdicts(posts.apply_post_edits(t, t["post_edit_requests"], REQUESTS_AS_OF))


@query
def q_edited_posts(t):
    outcome = posts.apply_post_edits(t, t["post_edit_requests"], REQUESTS_AS_OF)
    edited = update_rows(t["posts"], outcome.updates["posts"], "id")
    permissions = update_rows(t["post_permissions"], outcome.updates["post_permissions"], "id")
    return edited.select("id", "content", "updated_at").join(
        permissions.select(F.col("post_id").alias("id"), "comment_permission", "view_permission"), "id", "left"
    )


@query
def q_edit_posts_log(t):
    log = posts.apply_post_edits(t, t["post_edit_requests"], REQUESTS_AS_OF).inserts["moderation_logs"]
    return log.select("id", "moderator_id", "action", "target_id", "target_type", "reason")


@query
def q_register_users(t):
    outcome = users.register_users(t, t["user_requests"], REQUESTS_AS_OF)
    return _verdicts(outcome, "user_id")


@query
def q_find_or_create_users(t):
    outcome = users.register_users(t, t["user_requests"], REQUESTS_AS_OF, on_existing="return")
    return _verdicts(outcome, "user_id")


@query
def q_assign_aliases(t):
    outcome = users.assign_aliases(t, t["alias_requests"], REQUESTS_AS_OF)
    return _verdicts(outcome, "user_id", "alias_id", "alias_index")


@query
def q_aliased_users(t):
    outcome = users.assign_aliases(t, t["alias_requests"], REQUESTS_AS_OF)
    return apply_outcome(t, outcome)["users"].select(
        "id", "alias_id", "alias_index", "status", "updated_alias_at", "updated_at"
    )


@query
def q_alias_counters(t):
    outcome = users.assign_aliases(t, t["alias_requests"], REQUESTS_AS_OF)
    return apply_outcome(t, outcome)["aliases"].select("id", "next_user_index")


@query
def q_assign_schools(t):
    outcome = users.assign_schools(t, t["school_requests"], REQUESTS_AS_OF)
    return apply_outcome(t, outcome)["users"].select("id", "school_id", "status", "updated_at")


@query
def q_promote_users(t):
    raw = t["users"].withColumn("status", F.when(F.col("status") == "active", F.lit("pending")).otherwise(F.col("status")))
    return users.promote_users(raw).select("id", "status")


@query
def q_upsert_devices(t):
    after = apply_outcome(t, users.upsert_devices(t, t["device_requests"], REQUESTS_AS_OF))["user_fcms"]
    return after.select("id", "user_id", "fcm_token", "device_id", "platform", "created_at", "last_used_at")


@query
def q_append_logins(t):
    rows = users.append_logins(t, t["login_requests"]).inserts["user_logins"]
    return rows.select("id", "user_id", "ip_address", "platform", "logged_in_at")


@query
def q_append_stored(t):
    """Logins appended to a stored table; the batch is sent twice and counts once."""
    root = work_dir(t.spark, "stored")
    rows = users.append_logins(t, t["login_requests"]).inserts["user_logins"]
    for _ in range(2):
        path = append_events(rows, root, "user_logins", "logged_in_at", batch=7)
    return t.spark.read.parquet(path).select("id", "user_id", "logged_in_at", "day")


@query
def q_dim_defaults(t):
    return with_defaults(t["alias_seed"], "aliases", AS_OF).select(
        "id", "icon_image_id", "display_name", "next_user_index", "created_at"
    )


@query
def q_seed_aliases(t):
    """Seed rows without ids: a text key is made from the row."""
    seed = with_ids(t["alias_seed"].select("display_name"), "aliases")
    return with_defaults(seed, "aliases", AS_OF).select("id", "display_name", "next_user_index")


@query
def q_seed_topics(t):
    """Seed rows without ids: serial keys go on from the highest one in use."""
    seed = with_ids(t["topics"].select("category", "value", "label"), "topics", start=100)
    return with_defaults(seed, "topics", AS_OF).select("id", "category", "value", "is_hidden", "display_order")


@query
def q_seed_rejects(t):
    """Values of a text seed that their columns cannot hold."""
    rejects = typed_seed(t["topic_seed"], "topics", AS_OF).rejects
    return rejects.select(F.get_json_object("row", "$.id").alias("id"), F.col("column").alias("column_name"), "raw", "reason")


@query
def q_seed_typed(t):
    """The other rows: explicit NULLs stay, absent columns take their defaults."""
    rows = typed_seed(t["topic_seed"], "topics", AS_OF).rows
    return rows.select("id", "value", "category", "is_hot", "is_hidden", "display_order", "created_at")


@query
def q_stamp(t):
    settings = t["setting_rows"]
    delta = settings.where(F.length("value") > 1).select("key", F.concat("value", F.lit("0")).alias("value"))
    return update_rows(settings, stamp(delta, AS_OF), "key").select("key", "value", "updated_at")


# ---------------------------------------------------------------- moderation


@query
def q_delete_posts(t):
    return _verdicts(moderation.apply_post_deletes(t, t["post_moderation_requests"], REQUESTS_AS_OF))


@query
def q_modlog(t):
    log = moderation.apply_post_deletes(t, t["post_moderation_requests"], REQUESTS_AS_OF).inserts["moderation_logs"]
    return log.select("id", "moderator_id", "action", "target_id", "target_type", "reason", "created_at")


@query
def q_apply_delta(t):
    delta = moderation.apply_post_deletes(t, t["post_moderation_requests"], REQUESTS_AS_OF).updates["posts"]
    return update_rows(t["posts"], delta, "id").select("id", "status", "deleted_reason", "deleted_at", "updated_at")


@query
def q_update_stored(t):
    """The same changes on a stored table: deleted posts move to another directory."""
    delta = moderation.apply_post_deletes(t, t["post_moderation_requests"], REQUESTS_AS_OF).updates["posts"]
    posts_now = t["posts"].select("id", "content", "status", "deleted_reason", "deleted_at", "updated_at")
    path = write_snapshot(posts_now, work_dir(t.spark, "stored"), "posts", ["status"])
    update_stored(path, delta, "id", "status", posts_now.schema)
    return t.spark.read.schema(posts_now.schema).parquet(path).select("id", "status", "deleted_reason", "deleted_at", "updated_at")


@query
def q_hide_posts(t):
    return _verdicts(moderation.apply_post_hides(t, t["post_moderation_requests"], REQUESTS_AS_OF))


@query
def q_hidden_posts(t):
    delta = moderation.apply_post_hides(t, t["post_moderation_requests"], REQUESTS_AS_OF).updates["posts"]
    return update_rows(t["posts"], delta, "id").select("id", "status", "hidden_reason", "deleted_at")


@query
def q_hide_posts_log(t):
    log = moderation.apply_post_hides(t, t["post_moderation_requests"], REQUESTS_AS_OF).inserts["moderation_logs"]
    return log.select("id", "moderator_id", "action", "target_id", "target_type", "reason")


@query
def q_delete_comments(t):
    outcome = moderation.apply_comment_deletes(t, t["comment_moderation_requests"], REQUESTS_AS_OF)
    return _verdicts(outcome)


@query
def q_deleted_comments(t):
    outcome = moderation.apply_comment_deletes(t, t["comment_moderation_requests"], REQUESTS_AS_OF)
    return update_rows(t["comments"], outcome.updates["comments"], "id").select("id", "content", "deleted_at")


@query
def q_delete_comments_log(t):
    log = moderation.apply_comment_deletes(t, t["comment_moderation_requests"], REQUESTS_AS_OF).inserts["moderation_logs"]
    return log.select("id", "moderator_id", "action", "target_id", "target_type", "reason")


def _fresh(t, reports):
    """The tables before any report was stored."""
    return {**{n: t[n] for n in ("users", "posts", "comments", "moderation_logs")}, reports: t[reports].where("false")}


@query
def q_report_hide(t):
    outcome = moderation.hide_reported_posts(_fresh(t, "post_reports"), t["post_reports"], AS_OF, POST_THRESHOLD)
    return outcome.decided.select("id", "post_id", "outcome", "reason", "running", "hides")


@query
def q_report_hide_setting(t):
    """The threshold comes from the settings."""
    tables = {**_fresh(t, "post_reports"), "system_settings": t["system_settings"]}
    outcome = moderation.hide_reported_posts(tables, t["post_reports"], AS_OF)
    return outcome.decided.select("id", "post_id", "outcome", "reason", "running", "hides")


@query
def q_report_hide_stored(t):
    """Further reports, with repeats and hot posts, over the stored ones."""
    outcome = moderation.hide_reported_posts(t, t["event_reports"], REQUESTS_AS_OF, POST_THRESHOLD)
    return outcome.decided.select("id", "post_id", "outcome", "reason", "running", "hides")


@query
def q_report_hide_log(t):
    outcome = moderation.hide_reported_posts(_fresh(t, "post_reports"), t["post_reports"], AS_OF, POST_THRESHOLD)
    return outcome.inserts["moderation_logs"].select("id", "moderator_id", "action", "target_id", "reason")


@query
def q_comment_autodelete(t):
    outcome = moderation.delete_reported_comments(t, t["event_comment_reports"], REQUESTS_AS_OF, COMMENT_THRESHOLD)
    return outcome.decided.select("id", "comment_id", "outcome", "reason")


@query
def q_autodeleted_comments(t):
    outcome = moderation.delete_reported_comments(
        _fresh(t, "comment_reports"), t["comment_reports"], REQUESTS_AS_OF, COMMENT_THRESHOLD
    )
    return update_rows(t["comments"], outcome.updates["comments"], "id").select("id", "content", "deleted_at")


@query
def q_comment_autodelete_log(t):
    outcome = moderation.delete_reported_comments(
        _fresh(t, "comment_reports"), t["comment_reports"], REQUESTS_AS_OF, COMMENT_THRESHOLD
    )
    return outcome.inserts["moderation_logs"].select("id", "moderator_id", "action", "target_id", "reason")


# ---------------------------------------------------------------- integrity


def _raw(t):
    """Tables before validation: request batches take the place of clean rows."""
    raw = {n: t[n] for n in TABLES}
    raw["users"] = t["user_requests"].select("id", "email", "login_method", "status")
    raw["posts"] = t["post_requests"].select(
        F.col("request_id").alias("id"), F.lit("confession").alias("post_type"), "user_id",
        F.when(F.col("school_id") < 25, F.col("school_id")).alias("school_id"), "status", "content", "hidden_reason",
    )
    raw["post_reports"] = t["event_reports"]
    raw["comment_reports"] = t["event_comment_reports"]
    return raw


@query
def q_audit_domain(t):
    return audit.audit_domains(_raw(t))


@query
def q_audit_unique(t):
    return audit.audit_unique(_raw(t))


@query
def q_audit_fk(t):
    return audit.audit_references({**_raw(t), "users": t["users"], "posts": t["posts"]})


@query
def q_audit_check(t):
    return audit.audit_checks(_raw(t))


@query
def q_audit_kept(t):
    """All audits after three batches: the tables but late reports, users sent twice; the late reports; the second users taken back."""
    raw = {**_raw(t), "users": t["users"], "posts": t["posts"]}
    late = {n: raw[n].where(f"created_at >= TIMESTAMP_NTZ'{ACTIVITY_CUT}'") for n in ("post_reports", "comment_reports")}
    early = {n: raw[n].where(f"NOT coalesce(created_at >= TIMESTAMP_NTZ'{ACTIVITY_CUT}', false)") for n in late}
    kept = KeptAudit(t.spark, work_dir(t.spark, "audit"))
    kept.apply(0, {**raw, **early, "users": t["users"].unionByName(t["users"])})
    for _ in range(2):  # sent twice, counts once
        kept.apply(1, late)
    kept.apply(2, {}, {"users": t["users"]})
    parts = {
        "domain": kept.domains().selectExpr("table_name", "rule", "violations AS found", "0L AS surplus"),
        "row": kept.checks().selectExpr("table_name", "rule", "violations AS found", "0L AS surplus"),
        "key": kept.unique().selectExpr("table_name", "key AS rule", "repeated_keys AS found", "surplus_rows AS surplus"),
        "reference": kept.references_found().selectExpr("table_name", "reference AS rule", "orphan_rows AS found", "0L AS surplus"),
    }
    return reduce(DataFrame.unionByName, [df.withColumn("audit", F.lit(name)) for name, df in parts.items()])


@query
def q_purge_users(t):
    return purge.purge_report(t, "users", t["users"].where("status = 'banned'").select("id"))


@query
def q_purged_aliases(t):
    """Purge of the icons of even size: aliases and schools keep their rows, lose the link."""
    after = purge.purge(t, "images", t["images"].where("width % 2 = 0").select("id"))
    return (
        after["aliases"].select(F.lit("aliases").alias("table_name"), F.col("id").cast("bigint").alias("id"),
                                F.col("icon_image_id").alias("image_id"))
        .unionByName(after["schools"].select(F.lit("schools").alias("table_name"), F.col("id").cast("bigint").alias("id"),
                                             F.col("logo_image_id").alias("image_id")))
        .unionByName(after["post_images"].select(F.lit("post_images").alias("table_name"), "id", "image_id"))
    )


# ---------------------------------------------------------------- streams


def _stream_post_reports(t) -> str:
    out = work_dir(t.spark, "stream")
    jobs.stream_hide_reported_posts(
        t.stream("event_reports"), _fresh(t, "post_reports"), out, REQUESTS_AS_OF, POST_THRESHOLD
    ).awaitTermination()
    return out


@query
def q_stream_report_hide(t):
    return jobs.sink(t.spark, _stream_post_reports(t), "accepted").select("id", "post_id", "user_id", "reason")


@query
def q_stream_hidden_posts(t):
    return jobs.sink(t.spark, _stream_post_reports(t), "changed").select("id", "status", "hidden_reason")


@query
def q_stream_report_hide_log(t):
    log = jobs.sink(t.spark, _stream_post_reports(t), "logs")
    return log.select("id", "moderator_id", "action", "target_id", "reason")


def _stream_comment_reports(t) -> str:
    out = work_dir(t.spark, "stream")
    reports = t.stream("event_reports").withColumnRenamed("post_id", "_post")
    firsts = t["first_comments"].select(F.col("post_id").alias("_post"), F.col("pid").alias("comment_id"))
    stream = reports.join(firsts, "_post", "left").withColumn("comment_id", F.coalesce("comment_id", F.lit(-1)))
    stream = stream.select("id", "comment_id", "user_id", "reason", "created_at")
    jobs.stream_delete_reported_comments(
        stream, _fresh(t, "comment_reports"), out, REQUESTS_AS_OF, COMMENT_THRESHOLD
    ).awaitTermination()
    return out


@query
def q_stream_comment_autodelete(t):
    return jobs.sink(t.spark, _stream_comment_reports(t), "changed").select("id", "content", "deleted_at")


@query
def q_stream_comment_rejected(t):
    """Reports of unknown comments and users, and repeats."""
    return jobs.sink(t.spark, _stream_comment_reports(t), "rejected").select("id", "comment_id", "user_id", "reason")


@query
def q_stream_counters(t):
    out = work_dir(t.spark, "stream")
    jobs.stream_counters(t.stream("reaction_events"), out).awaitTermination()
    return jobs.latest_counters(t.spark, out)


@query
def q_stream_signups(t):
    out = work_dir(t.spark, "stream")
    signups = t.stream("events").where("event_type = 'signup'").withColumnRenamed("ts", "created_at")
    jobs.stream_signups(signups, out).awaitTermination()
    return t.spark.read.parquet(f"{out}/signups").select("signup_date", "new_user_count")


