"""Check SQL for the registered queries, in the literal per-row form.

Each statement counts with correlated subqueries, ranks with plain windows and
spells out the guards, so that it shares no plan with the Spark operators.
"""

from __future__ import annotations

from forumlake import messages as M
from forumlake.plans.queries import COMMENT_THRESHOLD, CURSOR, PAGE, PAGE_SCHOOL, PAGE_TOPIC, POST_THRESHOLD
from forumlake.schema import ENUMS, TABLES, UNIQUE_KEYS
from forumlake.sources.benchdata import AS_OF, REQUESTS_AS_OF, with_clause

NOW = f"TIMESTAMP '{AS_OF}'"
LATER = f"TIMESTAMP '{REQUESTS_AS_OF}'"


def _sql(names: str, body: str, **ctes: str) -> str:
    extra = "".join(f",\n{name} AS ({text})" for name, text in ctes.items())
    return f"{with_clause(*names.split())}{extra}\n{body}"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _case(*checks: tuple[str, str]) -> str:
    return "CASE " + " ".join(f"WHEN {condition} THEN {_quoted(text)}" for condition, text in checks) + " END"


def _url(i: str) -> str:
    return f"CASE WHEN {i}.id IS NOT NULL THEN {i}.base_url || {i}.id || '.' || {i}.format END"


def _n(child: str, parent: str, key: str = "post_id", extra: str = "") -> str:
    return f"(SELECT count(*) FROM {child} x WHERE x.{key} = {parent} {extra})"


def _of_school(child: str, extra: str = "") -> str:
    return f"(SELECT count(*) FROM kept JOIN {child} x ON x.post_id = kept.id WHERE kept.school_id = s.id {extra})"


_VERDICT = "CASE WHEN reason IS NULL THEN 'applied' ELSE 'rejected' END AS outcome"
_LIVE = "status = 'active' AND deleted_at IS NULL"

# ---------------------------------------------------------------- feed

_BASE = f"""(({_n('post_likes', 'p.id')} * 0.6e0 - {_n('post_dislikes', 'p.id')} * 1.5e0 + {_n('comments', 'p.id')} * 0.4e0)
    * (1e0 / (1e0 + (epoch_us({NOW}) - epoch_us(p.created_at)) / 1e6 / 172800e0)))"""
_SCORED = f"""
    SELECT p.id, p.user_id, p.school_id, round(
        ({_BASE} + CASE WHEN p.created_at > {NOW} - INTERVAL 1 HOUR THEN 5e0 ELSE 0e0 END)
        * CASE WHEN p.id IN (SELECT a.post_id FROM post_topics a JOIN topics b ON a.topic_id = b.id WHERE b.is_hot)
          THEN 1.2e0 ELSE 1e0 END, 9) AS final_score
    FROM posts p
    WHERE {_LIVE} AND p.id IN (SELECT post_id FROM post_permissions WHERE view_permission IN ('all', 'school_only'))"""
_TAGGED = f"""
    SELECT * FROM scored WHERE id IN (
        SELECT a.post_id FROM post_topics a JOIN topics b ON a.topic_id = b.id WHERE b.value = '{PAGE_TOPIC}')"""
_CAP = """
    SELECT * FROM (
        SELECT *, row_number() OVER (PARTITION BY school_id, user_id ORDER BY final_score DESC, id DESC) AS rn FROM {}) r
    WHERE rn <= 3"""
_FEED = "posts post_permissions post_likes post_dislikes comments post_topics topics"
_BY_SCHOOL = """
    SELECT school_id, CAST(rn AS INTEGER) AS feed_rank, id, final_score FROM (
        SELECT school_id, id, final_score,
               row_number() OVER (PARTITION BY school_id ORDER BY final_score DESC, id DESC) AS rn FROM capped) r
    WHERE rn <= 15"""


def _feed_page(where: str, tail: str) -> str:
    return _sql(
        _FEED,
        f"SELECT id, final_score FROM capped WHERE school_id = {PAGE_SCHOOL} {where} ORDER BY final_score DESC, id DESC {tail}",
        scored=_SCORED,
        capped=_CAP.format("scored"),
    )


CHECKS: dict[str, str] = {
    # ------------------------------------------------------------ reports
    "q_alias_ranking": _sql("aliases images", f"""
        SELECT a.id, a.display_name, a.next_user_index AS user_count, {_url('i')} AS image_url
        FROM aliases a LEFT JOIN images i ON i.id = a.icon_image_id"""),
    "q_school_ranking": _sql("schools users images", f"""
        SELECT s.id, s.name, s.short_name, {_n('users', 's.id', 'school_id')} AS user_count, {_url('i')} AS image_url
        FROM schools s LEFT JOIN images i ON i.id = s.logo_image_id WHERE s.is_active"""),
    "q_school_activity": _sql("schools users posts comments post_likes post_reports", f"""
        SELECT s.id AS school_id, s.name AS school_name, {_n('users', 's.id', 'school_id')} AS user_count,
               (SELECT count(*) FROM kept WHERE kept.school_id = s.id) AS post_count,
               {_of_school('comments', 'AND x.deleted_at IS NULL')} AS comment_count,
               {_of_school('post_likes')} AS post_like_count, {_of_school('post_reports')} AS post_report_count
        FROM schools s""", kept="SELECT id, school_id FROM posts WHERE deleted_at IS NULL"),
    "q_user_notifications": _sql("users notification_reads", f"""
        SELECT u.id AS user_id, {_n('notification_reads', 'u.id', 'user_id')} AS total_notifications,
               {_n('notification_reads', 'u.id', 'user_id', 'AND x.is_read')} AS read_notifications,
               {_n('notification_reads', 'u.id', 'user_id', 'AND NOT x.is_read')} AS unread_notifications
        FROM users u"""),
    "q_alias_usage": _sql("aliases users", f"""
        SELECT id, display_name, {_n('users', 'aliases.id', 'alias_id')} AS used_count FROM aliases"""),
    "q_signup_stats": _sql("users", """
        SELECT CAST(created_at AS DATE) AS signup_date, count(*) AS new_user_count FROM users GROUP BY 1"""),
    # ------------------------------------------------------------ feed
    "q_interaction_score": _sql("posts post_likes post_dislikes comments", f"""
        SELECT p.id AS post_id, round({_BASE}, 9) AS base_score FROM posts p WHERE {_LIVE}"""),
    "q_hot_posts": _sql("post_topics topics", """
        SELECT DISTINCT post_id FROM post_topics WHERE topic_id IN (SELECT id FROM topics WHERE is_hot)"""),
    "q_final_score": _sql(_FEED, _SCORED),
    "q_feed_page": _feed_page("", "LIMIT 15"),
    "q_feed_offset": _feed_page("", "LIMIT 40 OFFSET 30"),
    "q_feed_cursor": _feed_page(
        f"AND (final_score < {CURSOR[0]!r}e0 OR (final_score = {CURSOR[0]!r}e0 AND id < {CURSOR[1]}))", "LIMIT 50"),
    "q_feed_page_bounded": _feed_page("", "LIMIT 15"),
    "q_feed_cursor_bounded": _feed_page(
        f"AND (final_score < {CURSOR[0]!r}e0 OR (final_score = {CURSOR[0]!r}e0 AND id < {CURSOR[1]}))", "LIMIT 50"),
    "q_feed_topic": _sql(_FEED, _BY_SCHOOL, scored=_SCORED, tagged=_TAGGED, capped=_CAP.format("tagged")),
    "q_feed_all": _sql(_FEED, _BY_SCHOOL, scored=_SCORED, capped=_CAP.format("scored")),
    # ------------------------------------------------------------ hydration
    "q_hydrate_posts": _sql("posts post_permissions post_images users aliases images schools", f"""
        SELECT p.id, p.user_id, p.school_id, coalesce({_url('i')}, '') AS avatar_url,
               coalesce(a.display_name, 'anonymous') AS display_name, s.name AS school_name,
               s.short_name AS school_short_name, p.content,
               coalesce((SELECT string_agg(DISTINCT {_url('j')}, ',' ORDER BY {_url('j')})
                         FROM post_images x JOIN images j ON j.id = x.image_id WHERE x.post_id = p.id), '') AS images,
               p.status, coalesce(m.comment_permission, 'all') AS comment_permission,
               coalesce(m.view_permission, 'all') AS view_permission, p.created_at, p.updated_at
        FROM posts p LEFT JOIN users u ON u.id = p.user_id LEFT JOIN aliases a ON a.id = u.alias_id
        LEFT JOIN images i ON i.id = a.icon_image_id LEFT JOIN schools s ON s.id = p.school_id
        LEFT JOIN post_permissions m ON m.post_id = p.id WHERE p.status = 'active' AND p.deleted_at IS NULL"""),
    "q_post_counters": _sql("interaction_pairs post_likes post_dislikes comments", f"""
        SELECT id, {_n('post_likes', 'd.id')} AS total_like, {_n('post_dislikes', 'd.id')} AS total_dislike,
               {_n('comments', 'd.id')} AS total_comment
        FROM (SELECT DISTINCT post_id AS id FROM interaction_pairs) d"""),
    "q_user_interactions": _sql("interaction_pairs post_likes post_dislikes", """
        SELECT d.user_id, d.post_id, l.id IS NOT NULL AS is_liked, k.id IS NOT NULL AS is_disliked
        FROM interaction_pairs d LEFT JOIN post_likes l ON l.post_id = d.post_id AND l.user_id = d.user_id
        LEFT JOIN post_dislikes k ON k.post_id = d.post_id AND k.user_id = d.user_id"""),
    "q_comment_page": _sql("comments", f"""
        SELECT post_id, CAST(rn AS INTEGER) AS page_rank, id FROM (
            SELECT post_id, id, row_number() OVER (PARTITION BY post_id ORDER BY id) AS rn
            FROM comments WHERE parent_comment_id IS NULL) r WHERE rn <= {PAGE}"""),
    "q_reply_page": _sql("comments", f"""
        SELECT post_id, parent_comment_id, CAST(rn AS INTEGER) AS page_rank, id FROM (
            SELECT post_id, parent_comment_id, id,
                   row_number() OVER (PARTITION BY post_id, parent_comment_id ORDER BY id) AS rn
            FROM comments WHERE parent_comment_id IS NOT NULL) r WHERE rn <= {PAGE}"""),
    "q_comment_page_cursor": _sql("comments", f"""
        SELECT post_id, parent_comment_id, low AS cursor, CAST(rn - 1 AS INTEGER) AS page_rank, id FROM (
            SELECT post_id, parent_comment_id, id, row_number() OVER w AS rn, min(id) OVER w AS low FROM comments
            WINDOW w AS (PARTITION BY post_id, parent_comment_id ORDER BY id)) r WHERE rn BETWEEN 2 AND {PAGE + 1}"""),
    "q_feed_hydrated": _sql(_FEED + " users aliases images schools", f"""
        SELECT f.school_id, f.feed_rank, f.id, f.final_score, r.id AS reader_id, p.user_id,
               coalesce(a.display_name, 'anonymous') AS display_name, coalesce({_url('i')}, '') AS avatar_url, p.content,
               m.comment_permission, {_n('post_likes', 'f.id')} AS total_like, {_n('post_dislikes', 'f.id')} AS total_dislike,
               {_n('comments', 'f.id')} AS total_comment,
               {_n('post_likes', 'f.id', extra='AND x.user_id = r.id')} > 0 AS is_liked,
               {_n('post_dislikes', 'f.id', extra='AND x.user_id = r.id')} > 0 AS is_disliked
        FROM feeds f JOIN users r ON r.school_id = f.school_id AND r.role <> 'student' JOIN posts p ON p.id = f.id
        JOIN post_permissions m ON m.post_id = p.id LEFT JOIN users u ON u.id = p.user_id
        LEFT JOIN aliases a ON a.id = u.alias_id LEFT JOIN images i ON i.id = a.icon_image_id""",
        scored=_SCORED, capped=_CAP.format("scored"), feeds=_BY_SCHOOL),
    "q_hydrate_comments": _sql("comments users aliases images schools", f"""
        SELECT c.id, c.post_id, c.parent_comment_id, c.user_id, coalesce(a.display_name, 'anonymous') AS display_name,
               coalesce({_url('i')}, '') AS avatar_url, s.short_name AS school_short_name, c.content,
               c.created_at, c.updated_at, c.deleted_at
        FROM comments c LEFT JOIN users u ON u.id = c.user_id LEFT JOIN aliases a ON a.id = u.alias_id
        LEFT JOIN images i ON i.id = a.icon_image_id LEFT JOIN schools s ON s.id = u.school_id"""),
    "q_reply_counts": _sql("comments", """
        SELECT c.id AS comment_id, (SELECT count(*) FROM comments x WHERE x.parent_comment_id = c.id) AS total_replies
        FROM comments c"""),
    "q_user_profiles": _sql("users aliases images schools", f"""
        SELECT u.id AS user_id, u.email, u.login_method, u.alias_id, u.alias_index, a.display_name,
               {_url('i')} AS avatar_url, u.school_id, s.name AS school_name, s.short_name AS school_short_name,
               {_url('j')} AS school_logo_url, u.status, CAST(NULL AS VARCHAR) AS banned_reason,
               CAST(NULL AS VARCHAR) AS deleted_reason, CAST(NULL AS TIMESTAMP) AS updated_alias_at,
               u.created_at, u.updated_at, CAST(NULL AS TIMESTAMP) AS deleted_at
        FROM users u LEFT JOIN aliases a ON a.id = u.alias_id LEFT JOIN images i ON i.id = a.icon_image_id
        LEFT JOIN schools s ON s.id = u.school_id LEFT JOIN images j ON j.id = s.logo_image_id"""),
}

_ACTIVITY = f"""
    SELECT p.id, p.content, p.user_id, p.school_id, p.status, p.created_at,
           {_n('post_likes', 'p.id')} AS like_count, {_n('post_reports', 'p.id')} AS report_count,
           {_n('comments', 'p.id', extra='AND x.deleted_at IS NULL')} AS comment_count
    FROM posts p WHERE p.deleted_at IS NULL"""
CHECKS["q_top_posts"] = _sql("posts post_likes post_reports comments", _ACTIVITY)
CHECKS["q_top_posts_first"] = _sql(
    "posts post_likes post_reports comments",
    _ACTIVITY + " ORDER BY like_count DESC, comment_count DESC, report_count DESC, id LIMIT 100")

# ---------------------------------------------------------------- post ingestion

_POST_JUDGED = f"""
    SELECT r.*, substr(translate(to_base64(unhex(sha256(CAST(r.request_id AS VARCHAR)))), '+/', '-_'), 1, 12) AS post_id, {_case(
        ("trim(content, ' ') = ''", M.POST_EMPTY),
        ("length(content) > 3000", M.POST_TOO_LONG),
        ("len(image_ids) > 10", M.POST_TOO_MANY_IMAGES),
        ("user_id NOT IN (SELECT id FROM users WHERE status = 'active')", M.POST_BAD_USER),
        ("school_id NOT IN (SELECT id FROM schools WHERE is_active)", M.POST_BAD_SCHOOL),
        ("len(topic_ids) = 0", M.POST_NO_TOPIC),
        ("len(topic_ids) <> len(topic_scores)", M.POST_TOPIC_MISMATCH),
        ("content IS NULL", M.NULL_VALUE.format("content")),
        ("topic_scores[1] IS NULL OR topic_scores[2] IS NULL", M.NULL_VALUE.format("score")),
        ("len(list_distinct(topic_ids)) < len(topic_ids)", M.DUPLICATE_VALUE.format("topic_id")),
        ("topic_ids[1] NOT IN (SELECT id FROM topics) OR topic_ids[2] NOT IN (SELECT id FROM topics)",
         M.UNKNOWN_REFERENCE.format("topic_id")),
        ("len(list_distinct(image_ids)) < len(image_ids)", M.DUPLICATE_VALUE.format("image_id")),
        ("image_ids[1] NOT IN (SELECT id FROM images) OR image_ids[2] NOT IN (SELECT id FROM images)",
         M.UNKNOWN_REFERENCE.format("image_id")),
    )} AS reason
    FROM post_requests r"""
_POST = "post_requests users schools topics images"
CHECKS["q_ingest_posts"] = _sql(
    _POST, f"SELECT request_id, {_VERDICT}, reason, post_id FROM judged", judged=_POST_JUDGED)
CHECKS["q_ingest_post_rows"] = _sql(_POST, f"""
    SELECT post_id AS id, 'confession' AS post_type, user_id, school_id, status, content, hidden_reason,
           {NOW} AS created_at FROM judged WHERE reason IS NULL""", judged=_POST_JUDGED)
_BY_ARRIVAL = "row_number() OVER (ORDER BY requested_at, request_id)"
CHECKS["q_ingest_topics"] = _sql(_POST + " post_topics", """
    SELECT (SELECT max(id) FROM post_topics) + row_number() OVER (ORDER BY requested_at, request_id, pos) AS id,
           post_id, topic_ids[pos] AS topic_id, topic_scores[pos] AS score
    FROM judged, (VALUES (1), (2)) v(pos) WHERE reason IS NULL""", judged=_POST_JUDGED)
CHECKS["q_ingest_images"] = _sql(_POST + " post_images", """
    SELECT (SELECT max(id) FROM post_images) + row_number() OVER (ORDER BY requested_at, request_id, pos) AS id,
           post_id, image_ids[pos] AS image_id
    FROM judged, (VALUES (1), (2)) v(pos) WHERE reason IS NULL""", judged=_POST_JUDGED)
CHECKS["q_ingest_permissions"] = _sql(_POST + " post_permissions", f"""
    SELECT (SELECT max(id) FROM post_permissions) + {_BY_ARRIVAL} AS id, post_id, comment_permission, view_permission
    FROM judged WHERE reason IS NULL""", judged=_POST_JUDGED)

# ---------------------------------------------------------------- comment ingestion

_COMMENT_JUDGED = f"""
    SELECT r.*, {_case(
        ("trim(r.content, ' ') = ''", M.COMMENT_EMPTY),
        ("length(r.content) > 1000", M.COMMENT_TOO_LONG),
        ("u.id IS NULL", M.COMMENT_BAD_USER),
        ("p.id IS NULL", M.COMMENT_BAD_POST),
        ("m.comment_permission = 'none'", M.COMMENT_DISABLED),
        ("m.comment_permission = 'school_only' AND u.school_id IS DISTINCT FROM p.school_id", M.COMMENT_SCHOOL_ONLY),
        ("r.content IS NULL", M.NULL_VALUE.format("content")),
    )} AS reason
    FROM comment_requests r LEFT JOIN users u ON u.id = r.user_id AND u.status = 'active'
    LEFT JOIN posts p ON p.id = r.post_id AND p.status = 'active' AND p.deleted_at IS NULL
    LEFT JOIN post_permissions m ON m.post_id = r.post_id"""
_COMMENT = "comment_requests comments users posts post_permissions"
CHECKS["q_ingest_comments"] = _sql(
    _COMMENT, f"SELECT request_id, {_VERDICT}, reason FROM judged", judged=_COMMENT_JUDGED)
CHECKS["q_ingest_comment_rows"] = _sql(_COMMENT, f"""
    SELECT (SELECT max(id) FROM comments) + {_BY_ARRIVAL} AS id, post_id, user_id,
           CAST(NULL AS BIGINT) AS parent_comment_id, content, {LATER} AS created_at
    FROM judged WHERE reason IS NULL""", judged=_COMMENT_JUDGED)
_REPLY_JUDGED = f"""
    SELECT r.*, k.post_id, {_case(
        ("trim(r.content, ' ') = ''", M.COMMENT_EMPTY),
        ("length(r.content) > 1000", M.COMMENT_TOO_LONG),
        ("u.id IS NULL", M.COMMENT_BAD_USER),
        ("k.id IS NULL", M.REPLY_BAD_PARENT),
        ("k.parent_comment_id IS NOT NULL", M.REPLY_TOO_DEEP),
        ("p.id IS NULL", M.REPLY_BAD_POST),
        ("m.comment_permission = 'none'", M.REPLY_DISABLED),
        ("m.comment_permission = 'school_only' AND u.school_id IS DISTINCT FROM p.school_id", M.COMMENT_SCHOOL_ONLY),
        ("r.content IS NULL", M.NULL_VALUE.format("content")),
    )} AS reason
    FROM reply_requests r LEFT JOIN users u ON u.id = r.user_id AND u.status = 'active'
    LEFT JOIN comments k ON k.id = r.parent_comment_id AND k.deleted_at IS NULL
    LEFT JOIN posts p ON p.id = k.post_id AND p.status = 'active' AND p.deleted_at IS NULL
    LEFT JOIN post_permissions m ON m.post_id = k.post_id"""
_REPLY = "reply_requests comments users posts post_permissions"
CHECKS["q_ingest_replies"] = _sql(
    _REPLY, f"SELECT request_id, {_VERDICT}, reason, post_id FROM judged", judged=_REPLY_JUDGED)
CHECKS["q_ingest_reply_rows"] = _sql(_REPLY, f"""
    SELECT (SELECT max(id) FROM comments) + {_BY_ARRIVAL} AS id, post_id, user_id, parent_comment_id, content,
           {LATER} AS created_at FROM judged WHERE reason IS NULL""", judged=_REPLY_JUDGED)
_EDIT_JUDGED = f"""
    SELECT r.*, {_case(
        ("trim(r.content, ' ') = ''", M.COMMENT_EMPTY),
        ("k.id IS NULL", M.EDIT_MISSING),
        ("k.deleted_at IS NOT NULL", M.EDIT_DELETED),
        ("k.user_id <> r.user_id", M.EDIT_DENIED),
    )} AS reason
    FROM comment_edit_requests r LEFT JOIN comments k ON k.id = r.comment_id"""
CHECKS["q_edit_comments"] = _sql(
    "comment_edit_requests comments", f"SELECT request_id, {_VERDICT}, reason FROM judged", judged=_EDIT_JUDGED)
CHECKS["q_edited_comments"] = _sql("comment_edit_requests comments", f"""
    SELECT c.id, coalesce(e.content, c.content) AS content,
           CASE WHEN e.comment_id IS NULL THEN c.updated_at ELSE {LATER} END AS updated_at
    FROM comments c LEFT JOIN (
        SELECT comment_id, content, row_number() OVER (PARTITION BY comment_id ORDER BY requested_at DESC, request_id DESC) AS rn
        FROM judged WHERE reason IS NULL) e ON e.comment_id = c.id AND e.rn = 1""", judged=_EDIT_JUDGED)

# ---------------------------------------------------------------- post edits

_MODS = "(SELECT CAST(id AS VARCHAR) FROM users WHERE role IN ('moderator', 'admin'))"
_POST_EDIT_JUDGED = f"""
    SELECT r.*, CAST(p.user_id AS VARCHAR) AS owner, {_case(
        ("r.content IS NULL AND comment_permission IS NULL AND view_permission IS NULL", M.POST_NO_UPDATE),
        ("p.id IS NULL", M.POST_NOT_FOUND),
        ("p.deleted_at IS NOT NULL", M.POST_UPDATE_DELETED),
        ("p.status = 'hidden'", M.POST_UPDATE_HIDDEN),
        (f"CAST(p.user_id AS VARCHAR) <> requesting_user_id AND requesting_user_id NOT IN {_MODS}", M.POST_UPDATE_DENIED),
    )} AS reason
    FROM post_edit_requests r LEFT JOIN posts p ON p.id = r.post_id"""
_POST_EDIT = "post_edit_requests posts users post_permissions"


def _last(column: str) -> str:
    return f"last({column} ORDER BY requested_at, request_id) FILTER (WHERE {column} IS NOT NULL) AS {column}"


CHECKS["q_edit_posts"] = _sql(
    _POST_EDIT, f"SELECT request_id, {_VERDICT}, reason FROM judged", judged=_POST_EDIT_JUDGED)
CHECKS["q_edited_posts"] = _sql(_POST_EDIT, f"""
    SELECT p.id, coalesce(e.content, p.content) AS content,
           CASE WHEN e.content IS NULL THEN p.updated_at ELSE {LATER} END AS updated_at,
           CASE WHEN m.id IS NOT NULL THEN coalesce(e.comment_permission, m.comment_permission) END AS comment_permission,
           CASE WHEN m.id IS NOT NULL THEN coalesce(e.view_permission, m.view_permission) END AS view_permission
    FROM posts p LEFT JOIN folded e ON e.post_id = p.id LEFT JOIN post_permissions m ON m.post_id = p.id""",
    judged=_POST_EDIT_JUDGED, folded=f"""
    SELECT post_id, {_last('content')}, {_last('comment_permission')}, {_last('view_permission')}
    FROM judged WHERE reason IS NULL GROUP BY post_id""")
CHECKS["q_edit_posts_log"] = _sql(_POST_EDIT, f"""
    SELECT {_BY_ARRIVAL} AS id, requesting_user_id AS moderator_id, 'UPDATE_POST' AS action,
           CAST(post_id AS VARCHAR) AS target_id, 'post' AS target_type, moderation_reason AS reason
    FROM judged WHERE reason IS NULL AND owner <> requesting_user_id""", judged=_POST_EDIT_JUDGED)

# ---------------------------------------------------------------- accounts

_REGISTER = f"""
    SELECT r.*, u.id AS holder,
           CASE WHEN r.email IS NULL THEN NULL ELSE row_number() OVER (
               PARTITION BY r.email, bad IS NULL AND u.id IS NULL ORDER BY requested_at, request_id) END AS rn,
           CASE WHEN bad IS NULL AND u.id IS NULL THEN first_value(r.id) OVER (
               PARTITION BY r.email, bad IS NULL AND u.id IS NULL ORDER BY requested_at, request_id) END AS winner
    FROM (SELECT *, {_case(
        ("login_method NOT IN ('email', 'google')", M.BAD_ENUM.format("login_method")),
        ("email IS NULL", M.NULL_VALUE.format("email")))} AS bad FROM user_requests) r
    LEFT JOIN users u ON u.email = r.email"""
CHECKS["q_register_users"] = _sql("user_requests users", f"""
    SELECT request_id, {_VERDICT}, reason, CASE WHEN reason IS NULL THEN id END AS user_id
    FROM (SELECT *, coalesce(bad, CASE WHEN holder IS NOT NULL OR rn > 1
          THEN {_quoted(M.DUPLICATE_VALUE.format('email'))} END) AS reason FROM reg) j""", reg=_REGISTER)
CHECKS["q_find_or_create_users"] = _sql("user_requests users", """
    SELECT request_id, CASE WHEN bad IS NOT NULL THEN 'rejected' WHEN holder IS NOT NULL OR rn > 1 THEN 'noop'
                            ELSE 'applied' END AS outcome, bad AS reason,
           CASE WHEN bad IS NULL THEN coalesce(holder, winner) END AS user_id
    FROM reg""", reg=_REGISTER)
_ALIAS = dict(
    valid="""
    SELECT r.*, u.alias_id AS held, u.alias_index AS held_index, a.next_user_index AS nxt
    FROM alias_requests r JOIN users u ON u.id = r.user_id AND u.status <> 'banned' JOIN aliases a ON a.id = r.alias_id""",
    marked="""
    SELECT *, alias_id IS DISTINCT FROM coalesce(
        lag(alias_id) OVER (PARTITION BY user_id ORDER BY requested_at, request_id), held) AS changed FROM valid""",
    taken="""
    SELECT *, CASE WHEN changed THEN nxt - 1 + row_number() OVER (
        PARTITION BY alias_id, changed ORDER BY requested_at, request_id) END AS own FROM marked""",
    answered="""
    SELECT *, coalesce(last_value(own IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY requested_at, request_id
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), held_index) AS alias_index FROM taken""",
)
CHECKS["q_assign_aliases"] = _sql("alias_requests users aliases", f"""
    SELECT r.request_id, CASE WHEN v.request_id IS NULL THEN 'rejected' WHEN v.changed THEN 'applied' ELSE 'noop' END AS outcome,
           CASE WHEN v.request_id IS NULL THEN {_quoted(M.INVALID_ALIAS)} END AS reason,
           r.user_id, r.alias_id, CAST(v.alias_index AS BIGINT) AS alias_index
    FROM alias_requests r LEFT JOIN answered v ON v.request_id = r.request_id""", **_ALIAS)
_PROMOTE = "CASE WHEN {s} = 'pending' AND {a} IS NOT NULL AND {c} IS NOT NULL THEN 'active' ELSE {s} END AS status"
CHECKS["q_aliased_users"] = _sql("alias_requests users aliases", f"""
    SELECT u.id, coalesce(f.alias_id, u.alias_id) AS alias_id, CAST(CASE WHEN f.user_id IS NULL THEN u.alias_index
           ELSE f.alias_index END AS INTEGER) AS alias_index,
           CASE WHEN f.user_id IS NULL THEN u.status
                ELSE {_PROMOTE.format(s='u.status', a='f.alias_id', c='u.school_id').removesuffix(' AS status')} END AS status,
           CASE WHEN f.any_change THEN {LATER} END AS updated_alias_at,
           CASE WHEN f.user_id IS NULL THEN u.updated_at ELSE {LATER} END AS updated_at
    FROM users u LEFT JOIN (
        SELECT user_id, last(alias_id ORDER BY requested_at, request_id) AS alias_id,
               last(alias_index ORDER BY requested_at, request_id) AS alias_index, bool_or(changed) AS any_change
        FROM answered GROUP BY user_id) f ON f.user_id = u.id""", **_ALIAS)
CHECKS["q_alias_counters"] = _sql("alias_requests users aliases", """
    SELECT id, CAST(next_user_index + (SELECT count(*) FROM marked m WHERE m.changed AND m.alias_id = aliases.id) AS BIGINT)
           AS next_user_index FROM aliases""", **_ALIAS)
CHECKS["q_assign_schools"] = _sql("school_requests users schools", f"""
    SELECT u.id, coalesce(f.school_id, u.school_id) AS school_id,
           CASE WHEN f.user_id IS NULL THEN u.status
                ELSE {_PROMOTE.format(s='u.status', a='u.alias_id', c='f.school_id').removesuffix(' AS status')} END AS status,
           CASE WHEN f.user_id IS NULL THEN u.updated_at ELSE {LATER} END AS updated_at
    FROM users u LEFT JOIN (
        SELECT r.user_id, last(r.school_id ORDER BY requested_at, request_id) AS school_id
        FROM school_requests r JOIN users v ON v.id = r.user_id AND v.status <> 'banned'
        WHERE r.school_id IN (SELECT id FROM schools) GROUP BY r.user_id) f ON f.user_id = u.id""")
CHECKS["q_promote_users"] = _sql("users", f"""
    SELECT id, {_PROMOTE.format(s='s', a='alias_id', c='school_id')}
    FROM (SELECT *, CASE WHEN status = 'active' THEN 'pending' ELSE status END AS s FROM users) x""")
CHECKS["q_upsert_devices"] = _sql("device_requests users user_fcms", f"""
    SELECT d.id, d.user_id, d.fcm_token, coalesce(f.device_id, d.device_id) AS device_id,
           coalesce(f.platform, d.platform) AS platform, d.created_at,
           CASE WHEN f.user_id IS NULL THEN d.last_used_at ELSE {LATER} END AS last_used_at
    FROM user_fcms d LEFT JOIN folded f ON f.user_id = d.user_id AND f.fcm_token = d.fcm_token
    UNION ALL
    SELECT (SELECT max(id) FROM user_fcms) + row_number() OVER (ORDER BY since, req), user_id, fcm_token, device_id, platform,
           {LATER}, {LATER}
    FROM folded f WHERE NOT EXISTS (SELECT 1 FROM user_fcms d WHERE d.user_id = f.user_id AND d.fcm_token = f.fcm_token)""",
    folded=f"""
    SELECT user_id, fcm_token, {_last('device_id')}, {_last('platform')}, min(requested_at) AS since,
           first(request_id ORDER BY requested_at, request_id) AS req
    FROM device_requests WHERE fcm_token IS NOT NULL AND user_id IN (SELECT id FROM users) GROUP BY user_id, fcm_token""")
CHECKS["q_append_logins"] = _sql("login_requests users user_logins", f"""
    SELECT (SELECT max(id) FROM user_logins) + {_BY_ARRIVAL} AS id, user_id, ip_address, platform,
           requested_at AS logged_in_at
    FROM login_requests WHERE user_id IN (SELECT id FROM users)""")
CHECKS["q_append_stored"] = _sql("login_requests users user_logins", f"""
    SELECT (SELECT max(id) FROM user_logins) + {_BY_ARRIVAL} AS id, user_id, requested_at AS logged_in_at,
           CAST(requested_at AS DATE) AS day FROM login_requests WHERE user_id IN (SELECT id FROM users)""")
CHECKS["q_dim_defaults"] = _sql("alias_seed", f"""
    SELECT id, CAST(NULL AS VARCHAR) AS icon_image_id, display_name, coalesce(next_user_index, 1) AS next_user_index,
           {NOW} AS created_at FROM alias_seed""")
_BAD_SEED = "(is_hot = 'maybe' OR display_order IN ('x7', '99999999999') OR created_at = 'yesterday')"
CHECKS["q_seed_rejects"] = _sql("topic_seed", """
    SELECT id, 'is_hot' AS column_name, is_hot AS raw, 'not a valid boolean' AS reason FROM topic_seed WHERE is_hot = 'maybe'
    UNION ALL SELECT id, 'display_order', display_order, 'not a valid int' FROM topic_seed WHERE display_order IN ('x7', '99999999999')
    UNION ALL SELECT id, 'created_at', created_at, 'not a valid timestamp_ntz' FROM topic_seed WHERE created_at = 'yesterday'""")
CHECKS["q_seed_typed"] = _sql("topic_seed", f"""
    SELECT CAST(id AS BIGINT) AS id, value, category, CAST(is_hot AS BOOLEAN) AS is_hot, false AS is_hidden,
           CAST(display_order AS INT) AS display_order, CAST(created_at AS TIMESTAMP) AS created_at
    FROM (SELECT * FROM topic_seed WHERE NOT coalesce({_BAD_SEED}, false)) s""")
CHECKS["q_stamp"] = _sql("setting_rows", f"""
    SELECT key, CASE WHEN length(value) > 1 THEN value || '0' ELSE value END AS value,
           CASE WHEN length(value) > 1 THEN {NOW} ELSE updated_at END AS updated_at FROM setting_rows""")
CHECKS["q_seed_aliases"] = _sql("alias_seed", """
    SELECT substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12)
           AS id, display_name, CAST(1 AS BIGINT) AS next_user_index
    FROM (SELECT *, sha256(display_name) AS h FROM alias_seed) x""")
CHECKS["q_seed_topics"] = _sql("topics", """
    SELECT 100 + row_number() OVER (ORDER BY category, value, label) AS id, category, value, false AS is_hidden,
           CAST(0 AS INT) AS display_order FROM topics""")

# ---------------------------------------------------------------- moderation


def _moderated(requests: str, join: str, code: str, key: str) -> dict[str, str]:
    """Requests with the code of the permission that applies and the rank of the first effective one."""
    return dict(
        coded=f"SELECT r.*, {code} AS code, {join}",
        ranked=f"""
    SELECT *, min(CASE WHEN open AND code IS NOT NULL THEN ord END) OVER (PARTITION BY {key}) AS first_ord
    FROM (SELECT *, row_number() OVER (ORDER BY requested_at, request_id) AS ord FROM coded) o""",
    )


_DELETE = _moderated(
    "post_moderation_requests",
    "p.id IS NOT NULL AND p.deleted_at IS NULL AS open FROM post_moderation_requests r LEFT JOIN posts p ON p.id = r.post_id",
    f"""CASE WHEN CAST(p.user_id AS VARCHAR) = requesting_user_id THEN 'user' WHEN requesting_user_id = 'system' THEN 'system'
         WHEN requesting_user_id IN {_MODS} THEN 'mod' END""",
    "post_id",
)
_RESULT = """CASE WHEN NOT open OR ord > first_ord THEN 'noop' WHEN code IS NULL THEN 'rejected' ELSE 'applied' END AS outcome"""
_DEL = "post_moderation_requests posts users"
CHECKS["q_delete_posts"] = _sql(_DEL, f"""
    SELECT request_id, outcome, CASE WHEN outcome = 'rejected' THEN {_quoted(M.POST_DELETE_DENIED)} END AS reason
    FROM (SELECT *, {_RESULT} FROM ranked) x""", **_DELETE)
CHECKS["q_modlog"] = _sql(_DEL, f"""
    SELECT {_BY_ARRIVAL} AS id, requesting_user_id AS moderator_id, 'DELETE_POST' AS action,
           CAST(post_id AS VARCHAR) AS target_id, 'post' AS target_type, detailed_reason AS reason, {LATER} AS created_at
    FROM ranked WHERE ord = first_ord AND code <> 'user'""", **_DELETE)
CHECKS["q_apply_delta"] = _sql(_DEL, f"""
    SELECT p.id, CASE WHEN x.code IS NULL THEN p.status ELSE 'deleted' END AS status, x.code AS deleted_reason,
           CASE WHEN x.code IS NULL THEN p.deleted_at ELSE {LATER} END AS deleted_at, p.updated_at
    FROM posts p LEFT JOIN (SELECT * FROM ranked WHERE ord = first_ord) x ON x.post_id = p.id""", **_DELETE)
CHECKS["q_update_stored"] = CHECKS["q_apply_delta"]
_HIDE = dict(
    checked=f"""
    SELECT r.*, {_case(
        (f"requesting_user_id <> 'system' AND requesting_user_id NOT IN {_MODS}", M.POST_HIDE_DENIED),
        ("p.id IS NULL", M.POST_NOT_FOUND),
        ("p.status <> 'active'", M.POST_NOT_ACTIVE),
    )} AS bad FROM post_moderation_requests r LEFT JOIN posts p ON p.id = r.post_id""",
    judged=f"""
    SELECT *, coalesce(bad, CASE WHEN row_number() OVER (PARTITION BY post_id, bad ORDER BY requested_at, request_id) > 1
                            THEN {_quoted(M.POST_NOT_ACTIVE)} END) AS reason FROM checked""",
)
CHECKS["q_hide_posts"] = _sql(_DEL, f"SELECT request_id, {_VERDICT}, reason FROM judged", **_HIDE)
CHECKS["q_hidden_posts"] = _sql(_DEL, """
    SELECT p.id, CASE WHEN x.post_id IS NULL THEN p.status ELSE 'hidden' END AS status,
           x.reason_category AS hidden_reason, p.deleted_at
    FROM posts p LEFT JOIN (SELECT * FROM judged WHERE reason IS NULL) x ON x.post_id = p.id""", **_HIDE)
CHECKS["q_hide_posts_log"] = _sql(_DEL, f"""
    SELECT {_BY_ARRIVAL} AS id, requesting_user_id AS moderator_id, 'HIDE_POST' AS action,
           CAST(post_id AS VARCHAR) AS target_id, 'post' AS target_type, detailed_reason AS reason
    FROM judged WHERE reason IS NULL""", **_HIDE)
_COMMENT_DELETE = _moderated(
    "comment_moderation_requests",
    """c.id IS NOT NULL AND p.id IS NOT NULL AND c.deleted_at IS NULL AS open FROM comment_moderation_requests r
       LEFT JOIN comments c ON c.id = r.comment_id LEFT JOIN posts p ON p.id = c.post_id""",
    f"""CASE WHEN requesting_user_id = 'system' THEN 'DELETED_BY_SYSTEM'
         WHEN CAST(c.user_id AS VARCHAR) = requesting_user_id THEN 'DELETED_BY_OWNER'
         WHEN requesting_user_id IN {_MODS} THEN 'DELETED_BY_MODERATOR'
         WHEN CAST(p.user_id AS VARCHAR) = requesting_user_id THEN 'DELETED_BY_POST_OWNER' END""",
    "comment_id",
)
_CDEL = "comment_moderation_requests comments posts users"
CHECKS["q_delete_comments"] = _sql(_CDEL, f"""
    SELECT request_id, outcome, CASE WHEN outcome = 'rejected' THEN {_quoted(M.COMMENT_DELETE_DENIED)} END AS reason
    FROM (SELECT * EXCLUDE (reason), {_RESULT} FROM ranked) x""", **_COMMENT_DELETE)
CHECKS["q_deleted_comments"] = _sql(_CDEL, f"""
    SELECT c.id, CASE WHEN x.code IS NULL THEN c.content ELSE {_quoted(M.DELETED_COMMENT_PREFIX)} || x.code END AS content,
           CASE WHEN x.code IS NULL THEN c.deleted_at ELSE {LATER} END AS deleted_at
    FROM comments c LEFT JOIN (SELECT * FROM ranked WHERE ord = first_ord) x ON x.comment_id = c.id""", **_COMMENT_DELETE)
CHECKS["q_delete_comments_log"] = _sql(_CDEL, f"""
    SELECT {_BY_ARRIVAL} AS id, requesting_user_id AS moderator_id, 'DELETE_COMMENT' AS action,
           CAST(comment_id AS VARCHAR) AS target_id, 'comment' AS target_type, reason
    FROM ranked WHERE ord = first_ord AND code <> 'DELETED_BY_OWNER'""", **_COMMENT_DELETE)

_BOTH_DELETED = {
    **_DELETE,
    **{f"comment_{name}": text.replace("FROM coded", "FROM comment_coded") for name, text in _COMMENT_DELETE.items()},
    "kept": "SELECT * FROM posts WHERE deleted_at IS NULL AND id NOT IN (SELECT post_id FROM ranked WHERE ord = first_ord)",
    "kept_comments": """SELECT * FROM comments
        WHERE deleted_at IS NULL AND id NOT IN (SELECT comment_id FROM comment_ranked WHERE ord = first_ord)""",
}
_ACTIVITY_TABLES = f"{_DEL} {_CDEL} schools post_likes post_reports"
CHECKS["q_school_activity_kept"] = _sql(_ACTIVITY_TABLES, f"""
    SELECT s.id AS school_id, s.name AS school_name, {_n('users', 's.id', 'school_id')} AS user_count,
           (SELECT count(*) FROM kept WHERE kept.school_id = s.id) AS post_count,
           {_of_school('kept_comments')} AS comment_count,
           {_of_school('post_likes')} AS post_like_count, {_of_school('post_reports')} AS post_report_count
    FROM schools s""", **_BOTH_DELETED)
CHECKS["q_post_activity_kept"] = _sql(_ACTIVITY_TABLES, f"""
    SELECT CAST(p.id AS VARCHAR) AS post_id, CAST(p.school_id AS INTEGER) AS school_id,
           {_n('post_likes', 'p.id')} AS like_count, {_n('post_reports', 'p.id')} AS report_count,
           {_n('kept_comments', 'p.id')} AS comment_count FROM kept p""", **_BOTH_DELETED)


def _reported(new: str, stored: str | None, target: str, parent: str, extra: str) -> dict[str, str]:
    """New reports with their first constraint violation; repeats marked by rank."""
    known = f"SELECT {target}, user_id FROM {stored}" if stored else "SELECT NULL, NULL WHERE false"
    return dict(
        checked=f"""
    SELECT r.*, {extra}, {_case(
        (f"(r.{target}, r.user_id) IN ({known})", M.DUPLICATE_VALUE.format(f"{target}, user_id")),
        ("p.id IS NULL", M.UNKNOWN_REFERENCE.format(target)),
        ("r.user_id NOT IN (SELECT id FROM users)", M.UNKNOWN_REFERENCE.format("user_id")),
    )} AS bad, {f"(SELECT count(*) FROM {stored} s WHERE s.{target} = r.{target})" if stored else "0"} AS existing
    FROM {new} r LEFT JOIN {parent} p ON p.id = r.{target}""",
        repeated=f"""
    SELECT *, CASE WHEN bad IS NULL THEN row_number() OVER (
        PARTITION BY {target}, user_id, bad IS NULL ORDER BY created_at, id) END AS nth FROM checked""",
    )


def _post_reports(new: str, stored: str | None, threshold: int | str = POST_THRESHOLD) -> dict[str, str]:
    duplicate, inactive = _quoted(M.DUPLICATE_VALUE.format("post_id, user_id")), _quoted(M.POST_NOT_ACTIVE)
    return dict(
        **_reported(new, stored, "post_id", "posts", "p.status AS post_status"),
        counted="""
    SELECT *, existing + CASE WHEN nth = 1 THEN row_number() OVER (PARTITION BY post_id, nth ORDER BY created_at, id) END
        AS n FROM repeated""",
        passed=f"""
    SELECT *, CASE WHEN nth <> 1 THEN NULL WHEN n < {threshold} THEN true
                   WHEN post_status <> 'active' THEN false
                   ELSE n = greatest({threshold}, existing + 1) END AS ok FROM counted""",
        judged=f"""
    SELECT a.*, coalesce(a.bad, CASE WHEN a.ok THEN NULL
               WHEN a.nth > 1 AND b.ok THEN {duplicate} ELSE {inactive} END) AS reason
    FROM passed a LEFT JOIN passed b ON b.post_id = a.post_id AND b.user_id = a.user_id AND b.nth = 1""",
    )


_RENAMED = "(SELECT id, post_id, user_id, reason AS rtext, created_at FROM event_reports)"
_RENAMED_STORED = "(SELECT id, post_id, user_id, created_at FROM post_reports)"
_RENAMED_COMMENT = "(SELECT id, comment_id, user_id, created_at FROM event_comment_reports)"
_REPORT_RESULT = f"""
    SELECT id, post_id, {_VERDICT}, reason, CASE WHEN reason IS NULL THEN CAST(n AS BIGINT) END AS running,
           reason IS NULL AND post_status = 'active' AND n >= {POST_THRESHOLD} AS hides FROM judged"""
CHECKS["q_report_hide"] = _sql("post_reports posts users", _REPORT_RESULT, **_post_reports(_RENAMED_STORED, None))
_SETTING = f"(SELECT CAST(value AS INT) FROM system_settings WHERE key = '{M.POST_THRESHOLD_KEY}')"
CHECKS["q_report_hide_setting"] = _sql(
    "post_reports posts users system_settings", _REPORT_RESULT.replace(f">= {POST_THRESHOLD}", f">= {_SETTING}"),
    **_post_reports(_RENAMED_STORED, None, _SETTING))
CHECKS["q_report_hide_stored"] = _sql(
    "event_reports post_reports posts users", _REPORT_RESULT, **_post_reports(_RENAMED, "post_reports"))
_HIDE_LOG = f"""
    SELECT row_number() OVER (ORDER BY created_at, id) AS id, 'system' AS moderator_id, 'HIDE_POST' AS action,
           CAST(post_id AS VARCHAR) AS target_id,
           '{M.AUTO_HIDE_PREFIX}' || CAST(n AS VARCHAR) || '/{POST_THRESHOLD}{M.AUTO_HIDE_SUFFIX}' AS reason
    FROM judged WHERE reason IS NULL AND post_status = 'active' AND n >= {POST_THRESHOLD}"""
CHECKS["q_report_hide_log"] = _sql("post_reports posts users", _HIDE_LOG, **_post_reports(_RENAMED_STORED, None))
_COMMENT_REPORTED = _reported(_RENAMED_COMMENT, "comment_reports", "comment_id", "comments", "p.deleted_at")
CHECKS["q_comment_autodelete"] = _sql("event_comment_reports comment_reports comments users", f"""
    SELECT id, comment_id, {_VERDICT}, reason FROM (SELECT id, comment_id, coalesce(bad, CASE WHEN nth > 1
        THEN {_quoted(M.DUPLICATE_VALUE.format('comment_id, user_id'))} END) AS reason FROM repeated) x""",
    **_COMMENT_REPORTED)
_AUTODELETED = f"{_quoted(M.DELETED_COMMENT_PREFIX + M.DELETED_BY_SYSTEM)}"
CHECKS["q_autodeleted_comments"] = _sql("comment_reports comments", f"""
    SELECT c.id, CASE WHEN hit THEN {_AUTODELETED} ELSE content END AS content,
           CASE WHEN hit THEN {LATER} ELSE deleted_at END AS deleted_at
    FROM (SELECT *, deleted_at IS NULL AND (SELECT count(*) FROM comment_reports r WHERE r.comment_id = comments.id)
          >= {COMMENT_THRESHOLD} AS hit FROM comments) c""")
CHECKS["q_comment_autodelete_log"] = _sql("comment_reports comments", f"""
    SELECT row_number() OVER (ORDER BY id) AS id, 'system' AS moderator_id, 'DELETE_COMMENT' AS action,
           CAST(id AS VARCHAR) AS target_id, {_quoted(M.AUTO_DELETE_REASON)} AS reason
    FROM comments WHERE deleted_at IS NULL
        AND (SELECT count(*) FROM comment_reports r WHERE r.comment_id = comments.id) >= {COMMENT_THRESHOLD}""")

# ---------------------------------------------------------------- integrity

_RAW = dict(
    raw_users="SELECT id, email, login_method, status FROM user_requests",
    raw_posts="""
    SELECT request_id AS id, 'confession' AS post_type, user_id, CASE WHEN school_id < 25 THEN school_id END AS school_id,
           status, content, hidden_reason FROM post_requests""",
    raw_post_reports="SELECT * FROM event_reports",
    raw_comment_reports="SELECT * FROM event_comment_reports",
)
_RAW_COLUMNS = {
    "users": ["id", "email", "login_method", "status"],
    "posts": ["id", "post_type", "user_id", "school_id", "status", "content", "hidden_reason"],
    "post_reports": ["id", "post_id", "user_id", "reason", "created_at"],
    "comment_reports": ["id", "comment_id", "user_id", "reason", "created_at"],
}
_RAW_SOURCES = "user_requests post_requests event_reports event_comment_reports"
# columns that the benchmark data has no source for: empty or filled with their default
_NO_SOURCE = {
    "system_settings": "deleted_at", "images": "created_at", "schools": "created_at updated_at", "aliases": "created_at updated_at",
    "users": "password_hash banned_reason deleted_reason updated_alias_at updated_user_name_at deleted_at",
    "user_logins": "ip_address user_agent device_id platform location", "topics": "is_hidden display_order created_at updated_at",
    "posts": "hidden_reason deleted_reason", "post_topics": "score created_at", "post_images": "created_at",
    "post_views": "device_id", "notifications": "data",
}
_NO_ROWS = ["user_blocks", "post_shares", "post_saves", "moderation_logs", "comment_likes", "comment_dislikes", "email_logs"]
_AUDITED = _RAW_SOURCES + " " + " ".join(n for n in TABLES if n not in _NO_ROWS)


def _raw_name(table: str, raw: tuple[str, ...] = tuple(_RAW_COLUMNS)) -> str:
    return f"raw_{table}" if table in raw else table


def _domain_checks(raw: tuple[str, ...] = tuple(_RAW_COLUMNS)) -> str:
    parts = []
    for table, columns in TABLES.items():
        for c in (c for c in columns if table not in raw or c.name in _RAW_COLUMNS[table]):
            conditions = []
            if c.required:
                conditions.append((f"{c.name} not null", f"{c.name} IS NULL"))
            if c.length:
                conditions.append((f"{c.name} length <= {c.length}", f"length(CAST({c.name} AS VARCHAR)) > {c.length}"))
            if c.enum:
                domain = ", ".join(map(_quoted, ENUMS[c.enum]))
                conditions.append((f"{c.name} in {c.enum}", f"{c.name} NOT IN ({domain})"))
            nothing = table in _NO_ROWS or table not in raw and c.name in _NO_SOURCE.get(table, "").split()
            for rule, condition in conditions:
                found = "CAST(0 AS BIGINT) AS violations" if nothing else f"count(*) AS violations FROM {_raw_name(table, raw)} WHERE {condition}"
                parts.append(f"SELECT '{table}' AS table_name, '{rule}' AS rule, {found}")
    return "\nUNION ALL ".join(parts)


def _unique_checks(raw: tuple[str, ...] = tuple(_RAW_COLUMNS)) -> str:
    parts = []
    for table, columns in TABLES.items():
        for key in [(columns[0].name,)] + ([UNIQUE_KEYS[table]] if table in UNIQUE_KEYS else []):
            names = ", ".join(key)
            present = " AND ".join(f"{k} IS NOT NULL" for k in key)
            groups = f"SELECT count(*) AS n FROM {_raw_name(table, raw)} WHERE {present} GROUP BY {names} HAVING count(*) > 1"
            if table in _NO_ROWS:
                groups = "SELECT 0 AS n WHERE false"
            parts.append(f"""SELECT '{table}' AS table_name, '{names}' AS key, count(*) AS repeated_keys,
                CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS surplus_rows FROM ({groups}) g""")
    return "\nUNION ALL ".join(parts)


def _reference_checks() -> str:
    parts = []
    for table, columns in TABLES.items():
        source = _raw_name(table) if table in ("post_reports", "comment_reports") else table
        for c in (c for c in columns if c.ref):
            orphans = (f"count(*) AS orphan_rows FROM {source} c WHERE c.{c.name} IS NOT NULL "
                       f"AND NOT EXISTS (SELECT 1 FROM {c.ref} p WHERE p.id = c.{c.name})")
            if table in _NO_ROWS:
                orphans = "CAST(0 AS BIGINT) AS orphan_rows"
            parts.append(f"SELECT '{table}' AS table_name, '{c.name} -> {c.ref}' AS reference, {orphans}")
    return "\nUNION ALL ".join(parts)


CHECKS["q_audit_domain"] = _sql(_AUDITED, _domain_checks(), **_RAW)
CHECKS["q_audit_unique"] = _sql(_AUDITED, _unique_checks(), **_RAW)
CHECKS["q_audit_fk"] = _sql(_AUDITED, _reference_checks(), **_RAW)
CHECKS["q_audit_check"] = _sql(_RAW_SOURCES, """
    SELECT 'posts' AS table_name, 'confession has school_id' AS rule, count(*) AS violations
    FROM raw_posts WHERE post_type = 'confession' AND school_id IS NULL""", **_RAW)

_REPORTS = ("post_reports", "comment_reports")
CHECKS["q_audit_kept"] = _sql(_AUDITED, f"""
    SELECT 'domain' AS audit, table_name, rule, violations AS found, CAST(0 AS BIGINT) AS surplus FROM ({_domain_checks(_REPORTS)}) d
    UNION ALL SELECT 'row', 'posts', 'confession has school_id', count(*), 0 FROM posts WHERE post_type = 'confession' AND school_id IS NULL
    UNION ALL SELECT 'key', table_name, key, repeated_keys, surplus_rows FROM ({_unique_checks(_REPORTS)}) k
    UNION ALL SELECT 'reference', table_name, reference, orphan_rows, 0 FROM ({_reference_checks()}) f""", **_RAW)

_DEAD = dict(
    dead="SELECT id FROM users WHERE status = 'banned'",
    dead_posts="SELECT id FROM posts WHERE user_id IN (SELECT id FROM dead)",
    dead_roots="""SELECT id FROM comments WHERE user_id IN (SELECT id FROM dead) OR post_id IN (SELECT id FROM dead_posts)""",
    dead_comments="""SELECT id FROM comments WHERE id IN (SELECT id FROM dead_roots)
                     OR parent_comment_id IN (SELECT id FROM dead_roots)""",
)
_BY_USER = "user_id IN (SELECT id FROM dead)"
_BY_POST = "post_id IN (SELECT id FROM dead_posts)"
_PURGED = {
    "users": "id IN (SELECT id FROM dead)", "posts": "id IN (SELECT id FROM dead_posts)",
    "comments": "id IN (SELECT id FROM dead_comments)",
    "user_logins": _BY_USER, "user_fcms": _BY_USER, "notification_reads": _BY_USER,
    "post_likes": f"{_BY_USER} OR {_BY_POST}", "post_dislikes": f"{_BY_USER} OR {_BY_POST}",
    "post_reports": f"{_BY_USER} OR {_BY_POST}", "post_views": f"{_BY_USER} OR {_BY_POST}",
    "post_topics": _BY_POST, "post_images": _BY_POST, "post_permissions": _BY_POST,
    "comment_reports": f"{_BY_USER} OR comment_id IN (SELECT id FROM dead_comments)",
}
CHECKS["q_purge_users"] = _sql(" ".join(_PURGED), "\nUNION ALL ".join(
    [f"SELECT '{n}' AS table_name, count(*) AS removed_rows FROM {n} WHERE {w}" for n, w in _PURGED.items()]
    + [f"SELECT '{n}' AS table_name, CAST(0 AS BIGINT) AS removed_rows" for n in _NO_ROWS if n != 'email_logs']), **_DEAD)
_KEPT_IMAGE = "{} NOT IN (SELECT id FROM images WHERE width % 2 = 0)"
CHECKS["q_purged_aliases"] = _sql("aliases schools images post_images", f"""
    SELECT 'aliases' AS table_name, CAST(id AS BIGINT) AS id,
           CASE WHEN {_KEPT_IMAGE.format('icon_image_id')} THEN icon_image_id END AS image_id FROM aliases
    UNION ALL SELECT 'schools', CAST(id AS BIGINT), CASE WHEN {_KEPT_IMAGE.format('logo_image_id')} THEN logo_image_id END FROM schools
    UNION ALL SELECT 'post_images', id, image_id FROM post_images WHERE {_KEPT_IMAGE.format('image_id')}""")

# ---------------------------------------------------------------- streams

CHECKS["q_stream_report_hide"] = _sql(
    "event_reports posts users", "SELECT id, post_id, user_id, rtext AS reason FROM judged WHERE reason IS NULL",
    **_post_reports(_RENAMED, None))
CHECKS["q_stream_hidden_posts"] = _sql("event_reports posts users", f"""
    SELECT post_id AS id, 'hidden' AS status, 'report' AS hidden_reason
    FROM judged WHERE reason IS NULL AND post_status = 'active' AND n >= {POST_THRESHOLD}""", **_post_reports(_RENAMED, None))
CHECKS["q_stream_report_hide_log"] = _sql("event_reports posts users", _HIDE_LOG, **_post_reports(_RENAMED, None))
CHECKS["q_stream_comment_rejected"] = _sql("event_comment_reports comments users", f"""
    SELECT id, comment_id, user_id, reason FROM (SELECT id, comment_id, user_id, coalesce(bad, CASE WHEN nth > 1
        THEN {_quoted(M.DUPLICATE_VALUE.format('comment_id, user_id'))} END) AS reason FROM repeated) x WHERE reason IS NOT NULL""",
    **_reported(_RENAMED_COMMENT, None, "comment_id", "comments", "p.deleted_at"))
CHECKS["q_stream_comment_autodelete"] = _sql("event_comment_reports comments users", f"""
    SELECT c.id, {_AUTODELETED} AS content, {LATER} AS deleted_at FROM comments c WHERE c.deleted_at IS NULL AND
        (SELECT count(DISTINCT r.user_id) FROM event_comment_reports r
         WHERE r.comment_id = c.id AND r.user_id IN (SELECT id FROM users)) >= {COMMENT_THRESHOLD}""")
CHECKS["q_stream_counters"] = _sql(
    "reaction_events", "SELECT post_id, kind, count(*) AS n FROM reaction_events GROUP BY post_id, kind")
CHECKS["q_stream_signups"] = """
    SELECT CAST(ts AS DATE) AS signup_date, count(*) AS new_user_count FROM events WHERE event_type = 'signup'
    GROUP BY 1 HAVING CAST(ts AS DATE) + INTERVAL 1 DAY <= (
        SELECT max(ts) - INTERVAL 1 DAY FROM events WHERE event_type = 'signup')"""
