"""Feed pages that stop early: how good the posts of a school's day can be at most.

A zone is a school's day. It holds an upper bound of the likes and of the comments of any of
its posts and the time of its youngest post, from which an upper bound of their scores
follows for every moment and every set of weights. A page visits the days of its school in
falling order of that bound and ends once the page is full of posts above the bound of all
days that are left: these are all of them, so are their authors' better ones, and the page is
exact. Only the posts of visited days are counted. Days that may hold posts from before the
cursor are visited at once, as no page ends above them; once the posts counted would fill a
page, its last score tells which days can still matter.

Bounds add up: those of a batch of new rows are added to the ones before. Rows that go
(deleted comments, hidden posts, taken-back likes) need not be told, they only loosen a bound.
"""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, IntegerType, LongType, StructField, StructType, TimestampNTZType

from forumlake.functions.exprs import ntz, seconds_between
from forumlake.operators.counts import child_counts
from forumlake.operators.feed import SCORE_DIGITS, FeedParams, capped_posts, cut_page, scored_posts
from forumlake.session import freeze
from forumlake.sources.tables import Tables
from forumlake.streaming.segments import BUCKETS, FOLD, Notes, Segments

ZONE = StructType([
    StructField("school_id", IntegerType()), StructField("day", DateType()), StructField("posts", LongType()),
    StructField("youngest", TimestampNTZType()), StructField("likes", LongType()), StructField("comments", LongType()),
])
FIRST = 256  # posts of the first days that are visited; every further try takes GROWTH times as many
GROWTH = 4
ROUNDING = 2 * 10.0**-SCORE_DIGITS


def zones_of(tables: Tables, came: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """Zones of the rows that came (posts, post_likes, comments); of all rows if not given.

    `tables` holds the posts of these rows, so a child may not come before its post. Posts
    of no school are in no feed.
    """
    came = tables if came is None else came
    names = ("id", "school_id", "created_at")
    parts = []
    children = {n: (came[t], "post_id") for n, t in (("likes", "post_likes"), ("comments", "comments")) if came.get(t) is not None}
    if children:
        counts = child_counts("post_id", **children)
        marked = tables["posts"].select(*names).join(counts, F.col("id") == F.col("post_id"))
        parts.append(marked.select(*names, F.lit(0).alias("posts"), *[
            (F.col(n) if n in children else F.lit(0)).cast("bigint").alias(n) for n in ("likes", "comments")
        ]))
    if came.get("posts") is not None:
        parts.append(came["posts"].selectExpr(*names, "1 AS posts", "0L AS likes", "0L AS comments"))
    if not parts:
        return tables["posts"].sparkSession.createDataFrame([], ZONE)
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    rows = rows.where("school_id IS NOT NULL").withColumn("day", F.to_date("created_at"))
    return rows.groupBy(F.col("school_id").cast("int").alias("school_id"), "day").agg(
        F.sum("posts").cast("bigint").alias("posts"), F.max("created_at").alias("youngest"),
        F.max("likes").alias("likes"), F.max("comments").alias("comments"),
    )


def _added(zones: DataFrame) -> DataFrame:
    return zones.groupBy("school_id", "day").agg(
        F.sum("posts").alias("posts"), F.max("youngest").alias("youngest"),
        F.sum("likes").alias("likes"), F.sum("comments").alias("comments"),
    )


class Zones:
    """Zones kept below `path` by batches, numbered from 0; one that is sent again changes nothing."""

    def __init__(self, spark: SparkSession, path: str, fold: int = FOLD, buckets: int = BUCKETS):
        self.spark = spark
        self.rows = Segments(spark, f"{path}/zones", "school_id", _added, fold, buckets)
        self.done = Notes(spark, f"{path}/done")

    def apply(self, batch: int, tables: Tables, came: Mapping[str, DataFrame] | None = None) -> None:
        self.rows.start(batch)
        self.rows.write(zones_of(tables, came), batch)
        self.done.write(batch, {})

    def of_school(self, school_id: int) -> DataFrame:
        """One row per day, read from the school's bucket."""
        last = self.done.latest()
        asked = self.spark.createDataFrame([(school_id,)], "school_id INT")
        return self.rows.before(0 if last is None else last + 1, ZONE, asked)


def score_bound(as_of: datetime | str, params: FeedParams) -> Column:
    """No post of a zone scores more; NULL without a time, as the scores then are."""
    if params.dislike_weight < 0 or params.hot_boost < 0 or params.decay_hours <= 0:
        raise ValueError("scores have no bound with a negative dislike weight or hot boost, or without decay")
    now = ntz(as_of)
    decay = F.lit(1.0) + seconds_between(F.col("youngest"), now) / F.lit(float(params.decay_hours * 3600))
    worth = F.col("likes") * F.lit(max(params.like_weight, 0.0)) + F.col("comments") * F.lit(max(params.comment_weight, 0.0))
    fresh = F.col("youngest") > now - F.make_interval(hours=F.lit(params.new_post_hours))
    boost = F.when(fresh, F.lit(max(params.new_post_boost, 0.0))).otherwise(F.lit(0.0))
    top = (worth / decay + boost) * F.lit(max(params.hot_boost, 1.0))
    # a post from so far ahead that its decay turns over can score anything
    return F.when(decay > 0, top + F.lit(ROUNDING)).when(decay <= 0, F.lit(float("inf")))


def _on_days(zones: list[Row]) -> Column:
    """Posts of these days; the outermost ones bound the scan."""
    days = sorted(z.day for z in zones if z.day is not None)
    unknown = F.col("created_at").isNull()
    if not days:
        return unknown
    after = datetime.combine(days[-1] + timedelta(days=1), datetime.min.time())
    inside = (F.col("created_at") >= ntz(datetime.combine(days[0], datetime.min.time()))) & (F.col("created_at") < ntz(after))
    inside = inside & F.to_date("created_at").isin(days)
    return inside | unknown if len(days) < len(zones) else inside


def bounded_page(
    tables: Tables,
    zones: DataFrame,
    school_id: int,
    as_of: datetime | str,
    params: FeedParams = FeedParams(),
    limit: int = 15,
    offset: int = 0,
    topic: str | None = None,
    cursor: tuple[float, object] | None = None,
    first: int = FIRST,
) -> DataFrame:
    """The rows of `feed_page`, counted over the days of the school that can matter.

    `zones` holds at least the school's zones and is not older than `tables`. The days of
    one school, a row each, come to the driver, and per try the size and last score of a page.
    The first try that finds a full page is followed by at most one more: with more days an
    author's best posts and so the page's last score only rise, and all days above that score
    are visited then. Until then tries grow, so their number is logarithmic in the posts of the
    days that hold a page. A page beyond the end visits all days.
    """
    days = zones.where(F.col("school_id") == school_id).select("day", "posts", score_bound(as_of, params).alias("bound"))
    days = days.orderBy(F.desc_nulls_last("bound"), F.desc_nulls_last("day")).collect()
    visited, wanted, reach = 0, max(first, 2 * (offset + limit)), None if cursor is None else cursor[0]
    while True:
        needed = sum(reach is not None and zone.bound is not None and zone.bound >= reach for zone in days)
        posts = 0
        for at, zone in enumerate(days):
            posts, visited = posts + zone.posts, at + 1
            if posts >= wanted and visited >= needed:
                break
        scored = scored_posts(tables, as_of, params, school_id, topic, _on_days(days[:visited]))
        page = cut_page(capped_posts(scored, params), limit, offset, cursor)
        if visited == len(days):
            return page
        left = days[visited].bound
        page = freeze(page)
        found, last = page.agg(F.count("final_score"), F.min("final_score")).first()
        if found < limit:
            wanted = GROWTH * posts
        elif left is None or last is None or last > left:
            return page.orderBy(F.col("final_score").desc(), F.col("id").desc())
        else:
            reach = last
