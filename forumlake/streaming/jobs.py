"""Streaming forms of the report thresholds, live counters and signups.

Sinks of the thresholds and the counters are bucketed segments (`segments.py`); `sink`
reads one. A micro-batch opens only the buckets of the targets it touches, and a batch that
is run again after a failure overwrites what its first try wrote and reads only what earlier
batches wrote, so results do not depend on restarts.

Tables and the current time may change from batch to batch: `tables` may be a function that
names the snapshot folder for a batch, `as_of` one that tells its time. Their answers are
noted per batch before it runs, so a second try gets the same ones.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from forumlake import messages as M
from forumlake.functions.exprs import ntz, seconds_between
from forumlake.operators.moderation import delete_reported_comments, hide_reported_posts
from forumlake.operators.outcome import Outcome, insert_rows, last_id, update_rows
from forumlake.sources.tables import Tables, load_tables
from forumlake.streaming.segments import BUCKETS, FOLD, Notes, Segments

TablesAt = Tables | Callable[[int], str]
Time = datetime | str
TimeAt = Time | Callable[[int], Time]
CHANGED_AT = "changed_at"


def _latest(rows: DataFrame) -> DataFrame:
    """Of several changes of one row the last one."""
    last = Window.partitionBy("id").orderBy(F.desc("_batch"))
    return rows.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy("post_id", "kind").agg(F.sum("n").alias("n"))


MERGES = {"changed": _latest, "counters": _summed}
INTERNAL = ("_batch", CHANGED_AT)


def sink(spark: SparkSession, out: str, name: str) -> DataFrame | None:
    """All rows of a sink (`accepted`, `changed`, `rejected`, `logs`, `counters`) up to the last complete batch; None before the first."""
    notes = Notes(spark, f"{out}/done")
    last = notes.latest()
    if last is None:
        return None
    facts = notes.read(last)
    segments = Segments(spark, f"{out}/{name}", facts["keys"][name], MERGES.get(name), facts["fold"], facts["buckets"])
    rows = segments.before(last + 1, StructType.fromJson(facts["schemas"][name]))
    return rows.drop(*INTERNAL)


def file_stream(spark: SparkSession, path: str, like: DataFrame, files_per_batch: int | None = None) -> DataFrame:
    """Stream of parquet files that land under `path`, with the schema of `like`."""
    reader = spark.readStream.schema(like.schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def _moderate(
    stream: DataFrame,
    tables: TablesAt,
    as_of: TimeAt,
    out: str,
    reports_table: str,
    target_table: str,
    run: Callable[[Tables, DataFrame, Time], Outcome],
    once: bool,
    fold: int,
    buckets: int,
) -> StreamingQuery:
    """Run a batch threshold operator on every micro-batch over the state so far."""
    step = moderation_step(stream.sparkSession, tables, as_of, out, reports_table, target_table, run, fold, buckets)
    writer = stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{out}/checkpoint")
    return (writer.trigger(availableNow=True) if once else writer).start()


def moderation_step(
    spark: SparkSession,
    tables: TablesAt,
    as_of: TimeAt,
    out: str,
    reports_table: str,
    target_table: str,
    run: Callable[[Tables, DataFrame, Time], Outcome],
    fold: int = FOLD,
    buckets: int = BUCKETS,
) -> Callable[[DataFrame, int], None]:
    """What is done with each micro-batch.

    The accepted reports are the dedupe truth (uniqueness has no time limit), kept as
    files instead of an unbounded state store. Only state that concerns the targets
    of the micro-batch is read into the plan. Reports that a later snapshot of the
    tables already holds count once, and a change of a target holds until the
    snapshot's row is younger.
    """
    target = "post_id" if target_table == "posts" else "comment_id"
    keys = {"accepted": target, "changed": "id", "rejected": target, "logs": "target_id"}
    sinks = {n: Segments(spark, f"{out}/{n}", key, MERGES.get(n), fold, buckets) for n, key in keys.items()}
    asked, done = Notes(spark, f"{out}/asked"), Notes(spark, f"{out}/done")

    def step(batch: DataFrame, batch_id: int) -> None:
        noted = asked.read(batch_id)
        if noted is None:
            noted = {"root": tables(batch_id) if callable(tables) else None, "now": str(as_of(batch_id) if callable(as_of) else as_of)}
            asked.write(batch_id, noted)
        here = load_tables(spark, noted["root"]) if noted["root"] else tables
        before = done.read(batch_id - 1)
        for segments in sinks.values():
            segments.start(batch_id)
        # a stateless micro-batch may be read several times by the plan below
        batch.persist()
        try:
            now = dict(here)
            touched = batch.select(target).distinct()
            stored = here[reports_table].join(touched, target, "left_semi").select(*here[reports_table].columns)
            ids = touched.select(F.col(target).alias("id"))
            rows = here[target_table].join(ids, "id", "left_semi").select(*here[target_table].columns)
            log_id = last_id(here, "moderation_logs")
            if before is not None:
                earlier = lambda name: sinks[name].before(batch_id, StructType.fromJson(before["schemas"][name]), touched)
                accepted, changed = earlier("accepted"), earlier("changed")
                if noted["root"]:
                    accepted = accepted.join(stored.select("id"), "id", "left_anti")
                    since = rows.select("id", F.col("updated_at").alias("_since"))
                    older = F.coalesce(F.col("_since") <= F.col(CHANGED_AT), F.lit(True))
                    changed = changed.join(since, "id", "left").where(older).drop("_since")
                stored, rows = insert_rows(stored, accepted), update_rows(rows, changed.drop(*INTERNAL), "id")
                log_id = max(log_id, before["log_id"])
            now[reports_table], now[target_table] = stored, rows
            # serial ids go on from the last batch: one row stands for all logged ones
            now["moderation_logs"] = insert_rows(here["moderation_logs"].limit(0), spark.createDataFrame([(log_id,)], "id long"))
            outcome = run(now, batch, noted["now"]).frozen()
            changes = outcome.updates[target_table].withColumns({"_batch": F.lit(batch_id), CHANGED_AT: ntz(noted["now"])})
            results = {
                "logs": outcome.inserts["moderation_logs"], "accepted": outcome.inserts[reports_table],
                "changed": changes, "rejected": outcome.rejected,
            }
            for name, made in results.items():
                sinks[name].write(made, batch_id)
            log_id = max(log_id, last_id(outcome.inserts, "moderation_logs"))
            done.write(batch_id, {"schemas": {n: r.schema.jsonValue() for n, r in results.items()}, "keys": keys, "fold": fold, "buckets": buckets, "log_id": log_id})
        finally:
            batch.unpersist()

    return step


def stream_hide_reported_posts(
    stream: DataFrame,
    tables: TablesAt,
    out: str,
    as_of: TimeAt,
    threshold: int | None = None,
    once: bool = True,
    fold: int = FOLD,
    buckets: int = BUCKETS,
) -> StreamingQuery:
    """Post reports as they arrive; sinks `accepted`, `changed` (hidden posts), `rejected` and `logs` under `out`, read by `sink`."""
    return _moderate(
        stream, tables, as_of, out, "post_reports", "posts",
        lambda here, batch, now: hide_reported_posts(here, batch, now, threshold), once, fold, buckets,
    )


def stream_delete_reported_comments(
    stream: DataFrame,
    tables: TablesAt,
    out: str,
    as_of: TimeAt,
    threshold: int | None = None,
    prefix: str = M.DELETED_COMMENT_PREFIX,
    once: bool = True,
    fold: int = FOLD,
    buckets: int = BUCKETS,
) -> StreamingQuery:
    """Comment reports as they arrive; sinks as for posts."""
    return _moderate(
        stream, tables, as_of, out, "comment_reports", "comments",
        lambda here, batch, now: delete_reported_comments(here, batch, now, threshold, prefix), once, fold, buckets,
    )


def counters_step(spark: SparkSession, out: str, fold: int = FOLD, buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """Adds a micro-batch's partial counts to the counters; the same batch again changes nothing."""
    segments, done = Segments(spark, f"{out}/counters", "post_id", _summed, fold, buckets), Notes(spark, f"{out}/done")

    def step(batch: DataFrame, batch_id: int) -> None:
        segments.start(batch_id)
        counts = batch.groupBy("post_id", "kind").agg(F.count(F.lit(1)).alias("n"))
        segments.write(counts, batch_id)
        facts = {"schemas": {"counters": counts.schema.jsonValue()}, "keys": {"counters": "post_id"}, "fold": fold, "buckets": buckets}
        done.write(batch_id, facts)

    return step


def stream_counters(stream: DataFrame, out: str, once: bool = True, fold: int = FOLD, buckets: int = BUCKETS) -> StreamingQuery:
    """Running (post_id, kind) counts, without a state store: partial sums of batches, folded."""
    writer = stream.writeStream.foreachBatch(counters_step(stream.sparkSession, out, fold, buckets))
    writer = writer.option("checkpointLocation", f"{out}/checkpoint")
    return (writer.trigger(availableNow=True) if once else writer).start()


def latest_counters(spark: SparkSession, out: str) -> DataFrame:
    """Current counters."""
    return sink(spark, out, "counters")


def stream_signups(stream: DataFrame, out: str, ts: str = "created_at", late: str = "1 day", once: bool = True) -> StreamingQuery:
    """Signups per day, each day written once the watermark has passed it.

    Rows later than the watermark are dropped; rerun the batch report to correct. A
    watermark needs an instant: zone-less times are read as UTC whatever the session
    zone, and so are the days.
    """
    micros = F.round(seconds_between(ntz("1970-01-01 00:00:00"), F.col(ts)) * 1e6).cast("bigint")
    day = F.floor(F.unix_seconds(F.col("window.start")) / F.lit(86400)).cast("int")
    daily = (
        stream.select(F.timestamp_micros(micros).alias("ts"))
        .withWatermark("ts", late)
        .groupBy(F.window("ts", "1 day"))
        .agg(F.count(F.lit(1)).alias("new_user_count"))
        .select(F.date_from_unix_date(day).alias("signup_date"), "new_user_count")
    )
    writer = (
        daily.writeStream.outputMode("append").format("parquet")
        .option("checkpointLocation", f"{out}/checkpoint").option("path", f"{out}/signups")
    )
    return (writer.trigger(availableNow=True) if once else writer).start()
