"""Headline timings: one JSON line on stdout.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_RUNS (timed runs after one warm-up, median taken; default 3), BENCH_QUERIES
(comma-separated names; default the headline list), BENCH_LITERAL (comma-separated
literal_* names) to add row-product forms of counting queries, which the engine is
measured against; literal_school_activity only fits small data;
BENCH_DERIVED=1 to derive the forum tables from the source tables within every run
instead of reading them from parquet files written in the warm-up.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import functions as F

from forumlake.plans.queries import QUERIES
from forumlake.session import build_session, work_dir
from forumlake.sources.benchdata import bench_tables
from forumlake.sources.tables import write_snapshot

HEADLINE = [
    "q_feed_all", "q_feed_page", "q_school_activity", "q_top_posts", "q_user_notifications",
    "q_interaction_score", "q_hydrate_posts", "q_post_counters", "q_user_interactions",
    "q_hydrate_comments", "q_reply_counts", "q_ingest_posts", "q_ingest_comments", "q_edit_posts",
    "q_register_users", "q_assign_aliases", "q_report_hide", "q_delete_posts", "q_audit_fk", "q_purge_users",
]


def _fan_out(parents, key, children):
    """Join all children first, count distinct ids afterwards."""
    joined = parents
    for name, child in children.items():
        ids = child.select(F.col("post_id").alias(f"{name}_of"), F.col("id").alias(name))
        joined = joined.join(ids, F.col(key) == F.col(f"{name}_of"), "left")
    return joined.groupBy(*parents.columns).agg(*[F.count_distinct(n).alias(n) for n in children])


def literal_top_posts(t):
    posts = t["posts"].where("deleted_at IS NULL").select("id", "content", "user_id", "school_id", "status", "created_at")
    live = t["comments"].where("deleted_at IS NULL")
    return _fan_out(posts.withColumnRenamed("id", "post"), "post",
                    {"likes": t["post_likes"], "reports": t["post_reports"], "comments": live})


def literal_school_activity(t):
    users = t["users"].select(F.col("id").alias("user"), F.col("school_id").alias("of"))
    posts = t["posts"].where("deleted_at IS NULL").select(F.col("id").alias("post"), F.col("school_id").alias("at"))
    joined = t["schools"].select("id", "name").join(users, F.col("id") == F.col("of"), "left")
    joined = joined.join(posts, F.col("id") == F.col("at"), "left")
    for name, child in (("likes", t["post_likes"]), ("reports", t["post_reports"]),
                        ("comments", t["comments"].where("deleted_at IS NULL"))):
        ids = child.select(F.col("post_id").alias(f"{name}_of"), F.col("id").alias(name))
        joined = joined.join(ids, F.col("post") == F.col(f"{name}_of"), "left")
    return joined.groupBy("id", "name").agg(
        *[F.count_distinct(n).alias(f"n_{n}") for n in ("user", "post", "likes", "reports", "comments")])


def literal_interaction_counts(t):
    posts = t["posts"].where("status = 'active' AND deleted_at IS NULL").select(F.col("id").alias("post"), "created_at")
    return _fan_out(posts, "post", {"likes": t["post_likes"], "dislikes": t["post_dislikes"], "comments": t["comments"]})


LITERAL = {f.__name__: f for f in (literal_top_posts, literal_interaction_counts, literal_school_activity)}


class StoredTables(dict):
    """Forum tables written once as parquet, so that a query is timed and not the derivation of its input."""

    def __init__(self, derived):
        super().__init__()
        self.derived, self.root = derived, work_dir(derived.spark, "bench")
        self.spark = derived.spark

    def __missing__(self, name):
        df = self.derived[name]
        path = write_snapshot(df, self.root, name)
        self[name] = self.spark.read.schema(df.schema).parquet(path)
        return self[name]


def timed(fn, tables, runs):
    """Median seconds of building and running the query into the no-op sink."""
    samples = []
    for attempt in range(runs + 1):
        start = time.perf_counter()
        fn(tables).write.format("noop").mode("overwrite").save()
        if attempt:
            samples.append(time.perf_counter() - start)
    return statistics.median(samples)


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    chosen = os.environ.get("BENCH_QUERIES")
    names = chosen.split(",") if chosen else HEADLINE
    work = {name: QUERIES[name] for name in names}
    if os.environ.get("BENCH_LITERAL"):
        work.update({name: LITERAL[name] for name in os.environ["BENCH_LITERAL"].split(",")})
    spark = build_session(
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "7g"),
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    derived = bench_tables(spark, sf_dir)
    tables = derived if os.environ.get("BENCH_DERIVED") else StoredTables(derived)
    seconds = {}
    for name, fn in work.items():
        seconds[name] = round(timed(fn, tables, runs), 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    total = round(sum(v for k, v in seconds.items() if k not in LITERAL), 3)
    print(json.dumps({
        "metric": "forumlake_headline_total", "value": total, "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
