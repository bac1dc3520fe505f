"""Forum tables and request batches derived from the benchmark parquet tables.

Each entry is one SELECT in the dialect Spark and DuckDB share. `{name}` refers to
a benchmark table or to another entry, so the same text builds the DataFrames here
and the WITH clauses of the check SQL (there `array(` becomes `list_value(`).
Every entry reads its source tables whole.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from forumlake.schema import TABLES
from forumlake.session import with_small_tasks
from forumlake.sources.tables import add_missing, empty

AS_OF = "2001-08-01 00:30:00"  # the newest posts are half an hour old
REQUESTS_AS_OF = "2024-02-01 00:00:00"  # after the last event

# declared, so that a scan needs no footer-reading job
SOURCES = {
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE,"
    " o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE,"
    " l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, l_linestatus STRING,"
    " l_shipdate TIMESTAMP_NTZ",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
}

_USER_OF_PART = "CAST(FLOOR(l_partkey * 0.75e0) AS BIGINT)"  # a double: exact here and far cheaper than a decimal


def _reactions(condition: str, extra: str = "") -> str:
    return f"""
        SELECT l_orderkey * 10000000 + {_USER_OF_PART} AS id, l_orderkey AS post_id,
               {_USER_OF_PART} AS user_id, {extra} min(l_shipdate) AS created_at
        FROM {{lineitem}} WHERE {condition} GROUP BY l_orderkey, {_USER_OF_PART}"""


ENTRIES: dict[str, str] = {
    "schools": """
        SELECT n_nationkey AS id, n_nationkey % 5 <> 0 AS is_active,
               CASE WHEN n_nationkey % 4 <> 0 THEN concat('img', CAST(n_nationkey AS VARCHAR(10))) END AS logo_image_id,
               n_name AS name, concat('N', CAST(n_nationkey AS VARCHAR(10))) AS short_name,
               CASE n_regionkey % 3 WHEN 0 THEN 'university' WHEN 1 THEN 'academy' ELSE 'college' END AS type
        FROM {nation}""",
    "images": """
        SELECT concat('img', CAST(p_partkey AS VARCHAR(20))) AS id, 'https://img.test/' AS base_url,
               CASE p_size % 3 WHEN 0 THEN 'svg' WHEN 1 THEN 'png' ELSE 'jpg' END AS format,
               p_size AS width, p_size AS height, p_partkey * 17 AS size
        FROM {part}""",
    "aliases": """
        SELECT s_suppkey AS id, s_name AS display_name,
               CASE WHEN s_suppkey % 6 <> 0 THEN concat('img', CAST(s_suppkey AS VARCHAR(20))) END AS icon_image_id,
               CAST(1 + coalesce(u.n, 0) AS BIGINT) AS next_user_index
        FROM {supplier} LEFT JOIN (
            SELECT c_custkey % 10 AS k, count(*) AS n FROM {customer} WHERE c_custkey % 7 <> 0 GROUP BY c_custkey % 10) u
          ON u.k = s_suppkey""",
    "users": """
        SELECT c_custkey AS id, CASE WHEN c_custkey % 11 <> 0 THEN c_nationkey END AS school_id,
               CASE WHEN c_custkey % 7 <> 0 THEN c_custkey % 10 END AS alias_id,
               concat('u', CAST(c_custkey AS VARCHAR(20)), '@mail.test') AS email,
               CASE WHEN c_custkey % 3 = 0 THEN 'google' ELSE 'email' END AS login_method,
               CASE WHEN c_custkey = 0 THEN 'admin' WHEN c_custkey % 100 = 1 THEN 'moderator' ELSE 'student' END AS role,
               CASE WHEN c_acctbal < 0 THEN 'banned' WHEN c_custkey % 11 = 0 OR c_custkey % 7 = 0 THEN 'pending'
                    ELSE 'active' END AS status,
               CASE WHEN c_custkey % 7 <> 0 THEN CAST(c_custkey % 97 AS INT) END AS alias_index,
               coalesce(o.first_order, CAST('1995-01-01 00:00:00' AS TIMESTAMP_NTZ)) AS created_at,
               coalesce(o.first_order, CAST('1995-01-01 00:00:00' AS TIMESTAMP_NTZ)) AS updated_at
        FROM {customer} LEFT JOIN (
            SELECT o_custkey, min(o_orderdate) AS first_order FROM {orders} GROUP BY o_custkey) o
          ON o.o_custkey = c_custkey""",
    "posts": """
        SELECT o_orderkey AS id, 'confession' AS post_type, o_custkey AS user_id, c_nationkey AS school_id,
               concat('post ', CAST(o_orderkey AS VARCHAR(20))) AS content,
               o_orderdate AS created_at, o_orderdate AS updated_at,
               CASE WHEN o_orderstatus = 'F' AND o_orderkey % 2 = 0 THEN 'hidden'
                    WHEN o_orderstatus = 'P' AND o_orderkey % 3 = 0 THEN 'deleted' ELSE 'active' END AS status,
               CASE WHEN o_orderstatus = 'P' AND o_orderkey % 3 = 0 THEN o_orderdate END AS deleted_at
        FROM {orders} JOIN {customer} ON o_custkey = c_custkey""",
    "post_permissions": """
        SELECT o_orderkey AS id, o_orderkey AS post_id,
               CASE o_orderpriority WHEN '2-HIGH' THEN 'school_only' WHEN '5-LOW' THEN 'none' ELSE 'all' END
                 AS comment_permission,
               CASE o_orderpriority WHEN '3-MEDIUM' THEN 'school_only' WHEN '5-LOW' THEN 'none' ELSE 'all' END
                 AS view_permission,
               o_orderdate AS created_at
        FROM {orders} WHERE o_orderpriority <> '4-NOT SPECIFIED'""",
    "post_likes": _reactions("l_returnflag = 'R'"),
    "post_dislikes": _reactions("l_returnflag = 'A' AND l_linestatus = 'O'"),
    "post_reports": _reactions("l_returnflag = 'A' AND l_linestatus = 'F'", "'spam' AS reason,"),
    "post_images": """
        SELECT DISTINCT l_orderkey * 10000000 + l_partkey AS id, l_orderkey AS post_id,
               concat('img', CAST(l_partkey AS VARCHAR(20))) AS image_id
        FROM {lineitem} WHERE l_linenumber <= 2 AND l_returnflag = 'N'""",
    "topics": """
        SELECT row_number() OVER (ORDER BY p_type) AS id, 'social' AS category, lower(p_type) AS value,
               p_type AS label, p_type IN ('ECONOMY', 'SMALL') AS is_hot
        FROM (SELECT DISTINCT p_type FROM {part}) x""",
    "post_topics": """
        SELECT DISTINCT l_orderkey * 1000 + t.id AS id, l_orderkey AS post_id, t.id AS topic_id
        FROM {lineitem} JOIN {part} ON l_partkey = p_partkey JOIN {topics} t ON t.value = lower(p_type)
        WHERE l_linenumber = 1""",
    "comments_flat": f"""
        SELECT l_orderkey * 10000000 + l_partkey AS id, l_orderkey AS post_id, {_USER_OF_PART} AS user_id,
               l_partkey % 3 = 0 AS wants_parent, min(l_shipdate) AS created_at,
               max(CASE WHEN l_suppkey % 10 = 0 THEN l_shipdate END) AS deleted_at
        FROM {{lineitem}} WHERE l_returnflag = 'N' GROUP BY l_orderkey, l_partkey""",
    "first_comments": """
        SELECT post_id, min(id) AS pid FROM {comments_flat} WHERE NOT wants_parent GROUP BY post_id""",
    "comments": """
        SELECT c.id, c.post_id, c.user_id, CASE WHEN c.wants_parent THEN p.pid END AS parent_comment_id,
               concat('comment ', CAST(c.id AS VARCHAR(20))) AS content,
               c.created_at, c.created_at AS updated_at, c.deleted_at
        FROM {comments_flat} c LEFT JOIN {first_comments} p ON c.post_id = p.post_id""",
    # every later commenter of a post reports its first top-level comment
    "comment_reports": """
        SELECT min(c.id) AS id, p.pid AS comment_id, c.user_id, 'abuse' AS reason, min(c.created_at) AS created_at
        FROM {comments_flat} c JOIN {first_comments} p ON c.post_id = p.post_id
        WHERE c.id <> p.pid GROUP BY p.pid, c.user_id""",
    "notifications": """
        SELECT event_id AS id, 'purchase' AS type, 'sale' AS title, props AS body, 'event' AS target_type,
               CAST(event_id AS VARCHAR(20)) AS target_id, ts AS created_at
        FROM {events} WHERE event_type = 'purchase'""",
    "notification_reads": """
        SELECT event_id AS id, event_id AS notification_id, user_id, value > 50 AS is_read, ts AS created_at
        FROM {events} WHERE event_type = 'purchase'""",
    "post_views": """
        SELECT event_id AS id, user_id, event_id AS post_id,
               CAST(round(value * 1000) AS INT) AS view_duration_ms, ts AS viewed_at
        FROM {events} WHERE event_type = 'view'""",
    "user_logins": """
        SELECT event_id AS id, user_id, props AS device_info, ts AS logged_in_at
        FROM {events} WHERE event_type = 'signup'""",
    # one device row per customer and market segment; customers with odd keys only own one
    "user_fcms": """
        SELECT c_custkey AS id, c_custkey AS user_id, concat('token-', CAST(c_custkey % 10 AS VARCHAR(5))) AS fcm_token,
               CASE WHEN c_custkey % 2 = 0 THEN concat('dev-', c_mktsegment) END AS device_id,
               CASE WHEN c_custkey % 3 = 0 THEN 'ios' END AS platform,
               CAST('2023-01-01 00:00:00' AS TIMESTAMP_NTZ) AS created_at,
               CAST('2023-01-01 00:00:00' AS TIMESTAMP_NTZ) AS last_used_at
        FROM {customer}""",
    # ------------------------------------------------------------ request batches
    "post_requests": """
        SELECT o_orderkey AS request_id, o_orderdate AS requested_at,
               CASE WHEN o_orderkey % 53 = 0 THEN -1 ELSE o_custkey END AS user_id,
               CAST(o_custkey % 27 AS INT) AS school_id,
               CASE WHEN o_orderkey % 41 = 0 THEN '   ' WHEN o_orderkey % 43 = 0 THEN repeat('x', 3001)
                    WHEN o_orderkey % 47 = 0 THEN NULL ELSE concat('new post ', o_orderpriority) END AS content,
               CASE WHEN o_orderkey % 17 = 0 THEN array(CAST(1 AS BIGINT), CAST(1 AS BIGINT))
                    WHEN o_orderkey % 19 = 0 THEN array(CAST(1 AS BIGINT), CAST(99 AS BIGINT))
                    ELSE array(CAST(1 + o_orderkey % 3 AS BIGINT), CAST(4 + o_orderkey % 3 AS BIGINT)) END AS topic_ids,
               CASE WHEN o_orderkey % 23 = 0 THEN array(CAST(0.5 AS DECIMAL(5,4)))
                    WHEN o_orderkey % 29 = 0 THEN array(CAST(0.5 AS DECIMAL(5,4)), CAST(NULL AS DECIMAL(5,4)))
                    ELSE array(CAST(0.75 AS DECIMAL(5,4)), CAST(0.25 AS DECIMAL(5,4))) END AS topic_scores,
               CASE WHEN o_orderkey % 31 = 0 THEN array('img1', 'missing')
                    WHEN o_orderkey % 37 = 0 THEN array('a','b','c','d','e','f','g','h','i','j','k')
                    ELSE array('img1', concat('img', CAST(10 + o_orderkey % 100 AS VARCHAR(20)))) END AS image_ids,
               CASE WHEN o_orderkey % 59 = 0 THEN 'hidden' ELSE 'active' END AS status,
               CASE WHEN o_orderkey % 59 = 0 THEN 'sensitive' END AS hidden_reason,
               CASE WHEN o_orderkey % 5 = 0 THEN 'school_only' ELSE 'all' END AS comment_permission,
               'all' AS view_permission
        FROM {orders}""",
    "comment_requests": """
        SELECT event_id AS request_id, ts AS requested_at,
               CASE WHEN event_id % 53 = 0 THEN -1 ELSE user_id END AS user_id,
               CASE WHEN event_id % 29 = 0 THEN -1 ELSE event_id END AS post_id,
               CASE WHEN event_id % 37 = 0 THEN '   ' WHEN event_id % 41 = 0 THEN repeat('x', 1001)
                    WHEN event_id % 43 = 0 THEN NULL ELSE props END AS content
        FROM {events}""",
    "reply_requests": """
        SELECT id AS request_id, created_at AS requested_at,
               CASE WHEN id % 53 = 0 THEN -1 ELSE user_id END AS user_id,
               CASE WHEN id % 29 = 0 THEN -1 ELSE id END AS parent_comment_id,
               CASE WHEN id % 37 = 0 THEN '' WHEN id % 41 = 0 THEN repeat('y', 1001)
                    WHEN id % 43 = 0 THEN NULL ELSE concat('re: ', content) END AS content
        FROM {comments}""",
    # several edits per comment: by its owner, by others, blank ones
    "comment_edit_requests": f"""
        SELECT l_orderkey * 100000000 + l_partkey * 10 + l_linenumber AS request_id, min(l_shipdate) AS requested_at,
               CASE WHEN l_linenumber = 5 THEN -1 ELSE {_USER_OF_PART} END AS user_id,
               CASE WHEN l_linenumber = 6 THEN -1 ELSE l_orderkey * 10000000 + l_partkey END AS comment_id,
               CASE WHEN l_linenumber = 7 THEN ' ' ELSE concat('edit ', CAST(l_linenumber AS VARCHAR(5))) END AS content
        FROM {{lineitem}} WHERE l_returnflag = 'N' GROUP BY l_orderkey, l_partkey, l_linenumber""",
    # edits per post by its owner, by the admin and by strangers
    "post_edit_requests": """
        SELECT l_orderkey * 1000000 + l_partkey * 10 + l_linenumber AS request_id, min(l_shipdate) AS requested_at,
               CASE WHEN l_linenumber % 3 = 0 THEN '0' WHEN l_linenumber = 5 THEN '-1'
                    ELSE CAST(o_custkey AS VARCHAR(20)) END AS requesting_user_id,
               CASE WHEN l_partkey % 31 = 0 THEN -1 ELSE l_orderkey END AS post_id,
               CASE WHEN l_linenumber IN (1, 3) THEN concat('edit ', CAST(l_partkey AS VARCHAR(20))) END AS content,
               CASE WHEN l_linenumber IN (2, 3) THEN 'none' END AS comment_permission,
               CASE WHEN l_linenumber IN (4, 5) THEN 'school_only' END AS view_permission,
               CASE WHEN l_linenumber = 3 THEN 'cleanup' END AS moderation_reason
        FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey
        GROUP BY l_orderkey, l_partkey, l_linenumber, o_custkey""",
    # moderation requests per post: owner, admin, system, stranger
    "post_moderation_requests": """
        SELECT l_orderkey * 1000000 + l_partkey * 10 + l_linenumber AS request_id, min(l_shipdate) AS requested_at,
               CASE l_linenumber % 4 WHEN 0 THEN 'system' WHEN 1 THEN CAST(o_custkey AS VARCHAR(20))
                    WHEN 2 THEN '1' ELSE '77' END AS requesting_user_id,
               CASE WHEN l_partkey % 31 = 0 THEN -1 ELSE l_orderkey END AS post_id,
               'spam' AS reason_category, concat('by rule ', CAST(l_linenumber AS VARCHAR(5))) AS detailed_reason
        FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey
        GROUP BY l_orderkey, l_partkey, l_linenumber, o_custkey""",
    "comment_moderation_requests": f"""
        SELECT l_orderkey * 100000000 + l_partkey * 10 + l_linenumber AS request_id, min(l_shipdate) AS requested_at,
               CASE l_linenumber WHEN 1 THEN CAST({_USER_OF_PART} AS VARCHAR(20)) WHEN 2 THEN '1'
                    WHEN 3 THEN CAST(o_custkey AS VARCHAR(20)) WHEN 4 THEN 'system' ELSE '77' END AS requesting_user_id,
               l_orderkey * 10000000 + l_partkey AS comment_id,
               concat('why ', CAST(l_linenumber AS VARCHAR(5))) AS reason
        FROM {{lineitem}} JOIN {{orders}} ON l_orderkey = o_orderkey
        WHERE l_returnflag = 'N' GROUP BY l_orderkey, l_partkey, l_linenumber, o_custkey""",
    # emails: some of existing users, the rest shared by several requests
    "user_requests": """
        SELECT event_id AS request_id, ts AS requested_at, event_id + 100000000 AS id,
               CASE WHEN event_id % 11 = 0 THEN NULL
                    WHEN event_id % 3 = 0 THEN concat('u', CAST(user_id AS VARCHAR(20)), '@mail.test')
                    ELSE concat('new', CAST(CAST(floor(value) AS BIGINT) AS VARCHAR(20)), '@mail.test') END AS email,
               CASE WHEN event_id % 13 = 0 THEN 'sms' ELSE 'email' END AS login_method,
               CASE WHEN event_id % 2 = 0 THEN 'active' ELSE 'pending' END AS status
        FROM {events}""",
    "alias_requests": """
        SELECT event_id AS request_id, ts AS requested_at,
               CASE WHEN event_id % 53 = 0 THEN -1 ELSE user_id END AS user_id,
               CASE WHEN event_id % 31 = 0 THEN -5 ELSE CAST(floor(value) AS BIGINT) % 10 END AS alias_id
        FROM {events}""",
    "school_requests": """
        SELECT event_id AS request_id, ts AS requested_at,
               CASE WHEN event_id % 53 = 0 THEN -1 ELSE user_id END AS user_id,
               CAST(event_id % 27 AS INT) AS school_id
        FROM {events}""",
    "login_requests": """
        SELECT event_id AS request_id, ts AS requested_at,
               CASE WHEN event_id % 53 = 0 THEN -1 ELSE user_id END AS user_id,
               concat('10.0.0.', CAST(event_id % 250 AS VARCHAR(5))) AS ip_address, 'agent' AS user_agent,
               props AS device_info, CASE WHEN event_id % 2 = 0 THEN 'ios' ELSE 'android' END AS platform
        FROM {events}""",
    "device_requests": """
        SELECT event_id AS request_id, ts AS requested_at,
               CASE WHEN event_id % 53 = 0 THEN -1 ELSE user_id END AS user_id,
               CASE WHEN event_id % 59 = 0 THEN NULL
                    ELSE concat('token-', CAST(CAST(floor(value) AS BIGINT) % 12 AS VARCHAR(5))) END AS fcm_token,
               CASE WHEN event_id % 3 = 0 THEN concat('d', CAST(event_id AS VARCHAR(20))) END AS device_id,
               CASE WHEN event_id % 5 = 0 THEN event_type END AS platform
        FROM {events}""",
    # reports in arrival order with repeats; low post ids are hot
    "event_reports": """
        SELECT event_id AS id, CAST(floor(value) AS BIGINT) AS post_id, user_id, event_type AS reason, ts AS created_at
        FROM {events}""",
    # the same for comments: the first comments of posts, picked by position in the post id range
    "event_comment_reports": """
        SELECT e.event_id AS id, coalesce(p.pid, -1) AS comment_id, e.user_id, e.event_type AS reason, e.ts AS created_at
        FROM {events} e LEFT JOIN {first_comments} p ON p.post_id = CAST(floor(e.value) AS BIGINT)""",
    # (user, post) pairs whose flags are asked for, with repeats and unknown posts
    "interaction_pairs": f"""
        SELECT {_USER_OF_PART} AS user_id,
               CASE WHEN l_suppkey % 20 = 0 THEN -l_orderkey ELSE l_orderkey END AS post_id
        FROM {{lineitem}}""",
    # raw reactions as they arrive, before any dedupe
    "reaction_events": """
        SELECT l_orderkey AS post_id,
               CASE l_returnflag WHEN 'R' THEN 'like' WHEN 'A' THEN 'dislike' ELSE 'comment' END AS kind
        FROM {lineitem}""",
    # the settings below with the two report thresholds among them
    "system_settings": """
        SELECT CASE key WHEN 'key1' THEN 'max_reports_to_hide_post' WHEN 'key2' THEN 'max_reports_to_delete_comment'
               ELSE key END AS key, CASE key WHEN 'key1' THEN '2' WHEN 'key2' THEN '4' ELSE value END AS value, description, updated_at
        FROM {setting_rows}""",
    "setting_rows": """
        SELECT concat('key', CAST(p_partkey AS VARCHAR(20))) AS key, CAST(p_size AS VARCHAR(10)) AS value,
               p_name AS description, CAST('2000-01-01 00:00:00' AS TIMESTAMP_NTZ) AS updated_at
        FROM {part}""",
    # a text seed with malformed numbers, flags and times, and with explicit NULLs
    "topic_seed": """
        SELECT CAST(p_partkey AS VARCHAR(20)) AS id, p_name AS value, p_brand AS label,
               CASE WHEN p_partkey % 3 = 0 THEN 'social' WHEN p_partkey % 3 = 1 THEN 'event' END AS category,
               CASE WHEN p_partkey % 7 = 0 THEN 'maybe' WHEN p_partkey % 2 = 0 THEN 'true' END AS is_hot,
               CASE WHEN p_partkey % 11 = 0 THEN 'x7' WHEN p_partkey % 13 = 0 THEN '99999999999'
                    WHEN p_partkey % 5 > 0 THEN CAST(p_size AS VARCHAR(10)) END AS display_order,
               CASE WHEN p_partkey % 17 = 0 THEN 'yesterday' ELSE '2024-02-03 04:05:06' END AS created_at
        FROM {part}""",
    # a seed file with holes, to be filled by column defaults
    "alias_seed": """
        SELECT s_suppkey AS id, s_name AS display_name,
               CASE WHEN s_suppkey % 4 = 0 THEN CAST(s_suppkey AS BIGINT) END AS next_user_index
        FROM {supplier}""",
}

_NAME = re.compile(r"\{(\w+)\}")


def needs(name: str) -> list[str]:
    """Names an entry refers to, in first-use order."""
    return list(dict.fromkeys(_NAME.findall(ENTRIES[name])))


class BenchTables(dict):
    """Forum tables over a directory of benchmark parquet files, built on first use."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        super().__init__()
        self.spark, self.sf_dir = spark, sf_dir

    def source(self, name: str) -> DataFrame:
        return self.spark.read.schema(SOURCES[name]).parquet(f"{self.sf_dir}/{name}.parquet")

    def stream(self, name: str) -> DataFrame:
        """A source table, or an entry over one, as a file stream."""
        if name in SOURCES:
            # a glob, since a stream source takes no plain file; it matches a directory as well
            return self.spark.readStream.schema(SOURCES[name]).parquet(f"{self.sf_dir}/{name}.parquet*")
        return self.spark.sql(ENTRIES[name], **{n: self.stream(n) for n in needs(name)})

    def __missing__(self, name: str) -> DataFrame:
        if name in SOURCES:
            df = self.source(name)
        elif name in ENTRIES:
            df = self.spark.sql(ENTRIES[name], **{n: self[n] for n in needs(name)})
        elif name in TABLES:
            df = empty(self.spark, name)
        else:
            raise KeyError(name)
        if name in TABLES and name in ENTRIES:
            df = add_missing(df, name, AS_OF)  # columns the benchmark data has no source for
        self[name] = df
        return df

    def get(self, name, default=None):
        try:
            return self[name]
        except KeyError:
            return default


_LOADED: dict[tuple[str, str], BenchTables] = {}


def bench_tables(spark: SparkSession, sf_dir: str) -> BenchTables:
    """The (lazy) frames of a directory, planned once per application."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _LOADED:
        _LOADED[key] = BenchTables(with_small_tasks(spark), sf_dir)
    return _LOADED[key]


def with_clause(*names: str) -> str:
    """WITH clause that defines the named entries and all they need, for the check SQL."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in ENTRIES and name not in ordered:
            for n in needs(name):
                visit(n)
            ordered.append(name)

    for name in names:
        visit(name)
    ctes = []
    for name in ordered:
        text = _NAME.sub(r"\1", ENTRIES[name])
        text = text.replace("array(", "list_value(").replace("TIMESTAMP_NTZ", "TIMESTAMP")
        ctes.append(f"{name} AS ({text})")
    return "WITH " + ",\n".join(ctes)
