"""Activity of posts and schools, kept up to date by batches of changed rows.

Counts add up, so a batch only has to say which rows came and which went: a row that is
changed goes as it was and comes as it is. Per post the signed counts are added to those of
earlier batches; per school the difference is kept that the touched posts make. A batch
reads its own rows and the buckets of the posts they belong to, never the history.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from forumlake.operators.counts import with_counts
from forumlake.operators.outcome import Outcome, update_rows
from forumlake.schema import primary_key
from forumlake.session import keep
from forumlake.sources.tables import Tables, conform
from forumlake.streaming.segments import BUCKETS, FOLD, Notes, Segments

NOT_GONE = "deleted_at IS NULL"
# fact: table, column with the post, what counts
POST_FACTS = {
    "post_count": ("posts", "id", NOT_GONE),
    "comment_count": ("comments", "post_id", NOT_GONE),
    "like_count": ("post_likes", "post_id", "true"),
    "report_count": ("post_reports", "post_id", "true"),
}
FACTS = list(POST_FACTS)
COUNTED = {"users", *(table for table, _, _ in POST_FACTS.values())}
_COUNTS = [StructField(fact, LongType()) for fact in FACTS]
POST = StructType([StructField("post_id", StringType()), StructField("school_id", IntegerType()), *_COUNTS])
SCHOOL = StructType([StructField("school_id", IntegerType()), StructField("user_count", LongType()), *_COUNTS])


def _posts_added(rows: DataFrame) -> DataFrame:
    return rows.groupBy("post_id").agg(F.max("school_id").alias("school_id"), *[F.sum(f).alias(f) for f in FACTS])


def _schools_added(rows: DataFrame) -> DataFrame:
    return rows.groupBy("school_id").agg(*[F.sum(f).alias(f) for f in ("user_count", *FACTS)])


def row_changes(tables: Tables, outcome: Outcome) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """(came, went): the rows of counted tables that an outcome adds or changes as they are after it, and the changed ones as they were."""
    came, went = {}, {}
    # what is kept is the changes: the verdicts on all requests, with their texts, are many times as large
    for name in COUNTED.intersection(outcome.updates):
        delta, key = keep(outcome.updates[name], "changes"), primary_key(name)
        marked = delta.select(F.col(key).cast(tables[name].schema[key].dataType).alias(key))
        went[name] = keep(tables[name].join(marked, key, "left_semi").select(*tables[name].columns), "went")
        came[name] = update_rows(went[name], delta, key)
    for name in COUNTED.intersection(outcome.inserts):
        rows = keep(conform(outcome.inserts[name], tables[name]), "inserts")
        came[name] = came[name].unionByName(rows) if name in came else rows
    return came, went


class Activity:
    """The state below `path`. Batches are numbered from 0; one that is sent again changes nothing."""

    def __init__(self, spark: SparkSession, path: str, fold: int = FOLD, buckets: int = BUCKETS):
        self.spark = spark
        self.posts = Segments(spark, f"{path}/posts", "post_id", _posts_added, fold, buckets)
        self.schools = Segments(spark, f"{path}/schools", "school_id", _schools_added, fold, buckets)
        self.done = Notes(spark, f"{path}/done")

    def _signed(self, tables: Mapping[str, DataFrame], sign: int) -> list[DataFrame]:
        parts = []
        for fact, (table, post, counted) in POST_FACTS.items():
            if table in tables:
                school = "CAST(school_id AS INT)" if table == "posts" else "CAST(NULL AS INT)"
                facts = [f"{sign if f == fact else 0}L AS {f}" for f in FACTS]
                rows = tables[table].where(f"{post} IS NOT NULL AND {counted}")
                parts.append(rows.selectExpr(f"CAST({post} AS STRING) AS post_id", f"{school} AS school_id", *facts))
        return parts

    def _members(self, tables: Mapping[str, DataFrame], sign: int) -> list[DataFrame]:
        if "users" not in tables:
            return []
        facts = [f"0L AS {f}" for f in FACTS]
        users = tables["users"].where("school_id IS NOT NULL")
        return [users.selectExpr("CAST(school_id AS INT) AS school_id", f"{sign}L AS user_count", *facts)]

    def _before_and_after(self, batch: int, delta: DataFrame) -> DataFrame:
        """The posts of a delta, a row each: their school, their counts without the batch (`old_`) and with it."""
        if not batch:
            return delta.select("*", *[F.lit(0).cast("bigint").alias(f"old_{f}") for f in FACTS])
        before = self.posts.before(batch, POST, delta.select("post_id"))
        before = before.toDF("_post", "_school", *[f"old_{f}" for f in FACTS])
        old = {f: F.coalesce(f"old_{f}", F.lit(0)) for f in FACTS}
        return delta.join(before, F.col("post_id") == F.col("_post"), "left").select(
            "post_id", F.greatest("school_id", "_school").alias("school_id"),
            *[old[f].alias(f"old_{f}") for f in FACTS], *[(F.col(f) + old[f]).alias(f) for f in FACTS],
        )

    def apply(self, batch: int, came: Mapping[str, DataFrame], went: Mapping[str, DataFrame] = {}) -> None:
        """Adds rows that came, and takes off rows that went, by table (posts, comments, post_likes, post_reports, users).

        A post keeps its school. Rows of posts that come with a later batch wait for them.
        """
        self.posts.start(batch)
        self.schools.start(batch)
        empty = self.spark.createDataFrame([], POST)
        rows = reduce(DataFrame.unionByName, self._signed(came, 1) + self._signed(went, -1), empty)
        self.posts.write(_posts_added(rows), batch)
        both = self._before_and_after(batch, self.posts.of(batch, POST))
        # what a post is worth to its school: its counts while it is there, nothing else
        there, was = F.col("post_count") > 0, F.col("old_post_count") > 0
        worth = [(F.when(there, F.col(f)).otherwise(0) - F.when(was, F.col(f"old_{f}")).otherwise(0)).alias(f) for f in FACTS]
        moved = both.where("school_id IS NOT NULL").select("school_id", F.lit(0).cast("bigint").alias("user_count"), *worth)
        self.schools.write(_schools_added(reduce(DataFrame.unionByName, self._members(came, 1) + self._members(went, -1), moved)), batch)
        self.done.write(batch, {})

    def _batches(self) -> int:
        last = self.done.latest()
        return 0 if last is None else last + 1

    def school_activity(self, schools: DataFrame) -> DataFrame:
        """The columns of the full report, for every school."""
        counts = self.schools.before(self._batches(), SCHOOL)
        names = schools.select(F.col("id").alias("of"), F.col("name").alias("school_name"))
        return with_counts(names, counts, "of", "school_id").select(
            F.col("of").alias("school_id"), "school_name", "user_count", "post_count", "comment_count",
            F.col("like_count").alias("post_like_count"), F.col("report_count").alias("post_report_count"),
        )

    def post_counts(self) -> DataFrame:
        """(post_id, school_id, like_count, report_count, comment_count) of the posts that are there."""
        rows = self.posts.before(self._batches(), POST).where("post_count > 0")
        return rows.select("post_id", "school_id", "like_count", "report_count", "comment_count")
