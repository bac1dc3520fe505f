"""Exact deduplication by a streaming query with disk-backed keyed state.

Digests of all rows are streamed through a stateful aggregation kept in RocksDB. State has
no expiry: per digest it retains the number of rows and, of the row that stays, the stable
identifier (doc_id) and the content locator (file and row number). Digests that were hit
more than once have their full bytes compared; texts that differ under one digest are
grouped anew by digest and text, so a collision never merges two texts.

Texts are equal if they are identical without the characters [\\x20\\x09-\\x0D]; a null text
counts as empty. Of equal texts the row with most code points stays, then the smallest
doc_id (null last), then the first by file and row number, so exactly one row of repeated
rows stays. An empty table gives an empty result. Other columns are never looked at.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forumlake.llm.common import keep_rows, locatable, locator, stored, table
from forumlake.session import work_dir

SPACES = r"[\x20\x09-\x0D]+"
FILES_PER_BATCH = 10_000
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # all stores of an executor share one memory budget
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # many small stores: no disk reserved ahead of their logs
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def normal(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, "")


def keyed_state(seen: DataFrame, path: str, files_per_batch: int = FILES_PER_BATCH) -> DataFrame:
    """The state after all files of `path` went through the stream: one row per digest.

    The checkpoint lies in the shared folder, so a restarted driver or a lost executor goes
    on from the last micro-batch.
    """
    spark = seen.sparkSession
    session = spark.newSession()
    for key, value in STATE.items():
        session.conf.set(key, value)
    for key in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        session.conf.set(key, spark.conf.get(key))
    checkpoint = work_dir(spark, "exact-state")
    first = F.struct(
        (-F.col("code_points")).alias("less"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "file", "row"
    )
    query = (
        session.readStream.schema(seen.schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
        .groupBy("digest").agg(F.count("*").alias("n"), F.min(first).alias("first"))
        .writeStream.format("noop").outputMode("update").option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    state = spark.read.format("statestore").load(checkpoint)
    count, keep = (f"value.{f.name}" for f in state.schema["value"].dataType.fields)
    keep = F.col(keep)
    return state.select(
        F.col("key.digest").alias("digest"), F.col(count).alias("group_size"),
        keep["doc_id"].alias("keep_id"), keep["file"].alias("keep_file"), keep["row"].alias("keep_row"),
    )


def exact_groups(docs: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """A row per row of `docs`: doc_id, file, row, text_sha256, keep_id, group_size, kept.

    `docs` must be `locatable`. `digest` is the key of the state; sha256 unless collisions
    are to be tried out.
    """
    path, number = locator(docs)
    rows = docs.select("doc_id", path.alias("file"), number.alias("row"), "text").withColumn("normal", normal(F.col("text")))
    narrow = rows.select(
        "doc_id", "file", "row", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("code_points"),
        digest(F.col("normal")).alias("digest"), sha256(F.col("normal")).alias("sha"),
    )
    seen = stored(narrow, "exact-seen")
    state = stored(keyed_state(seen, seen.inputFiles()[0].rpartition("/")[0]), "exact-groups") if seen.inputFiles() else None
    if state is None:
        return seen.select("doc_id", "file", "row", F.hex("sha").alias("text_sha256"), F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))

    texts = rows.select("doc_id", "file", "row", "normal", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("code_points"), digest(F.col("normal")).alias("digest"))
    # full bytes of every hit: smallest and greatest text of a digest are the same only if all
    # are; combined before the shuffle, so a group of copies is one row per task
    clashes = stored(
        texts.groupBy("digest").agg(F.min("normal").alias("a"), F.max("normal").alias("b")).where("a <> b").select("digest"),
        "exact-clashes",
    )
    kept = (F.col("file") == F.col("keep_file")) & (F.col("row") == F.col("keep_row"))
    shape = ["doc_id", "file", "row", F.lower(F.hex("sha")).alias("text_sha256"), "keep_id", "group_size", kept.alias("kept")]
    sure = seen.join(state, "digest")
    if not clashes.take(1):
        return sure.select(*shape)
    first = F.min(F.struct((-F.col("code_points")).alias("less"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "file", "row"))
    members = texts.join(clashes, "digest")
    exact = members.groupBy("digest", "normal").agg(F.count("*").alias("group_size"), first.alias("keep")).select(
        "digest", "normal", "group_size", F.col("keep.doc_id").alias("keep_id"), F.col("keep.file").alias("keep_file"), F.col("keep.row").alias("keep_row")
    )
    split = members.join(exact, ["digest", "normal"]).withColumn("sha", sha256(F.col("normal")))
    return sure.join(clashes, "digest", "left_anti").select(*shape).unionByName(split.select(*shape))


def drop_copies(docs: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """The rows of `docs` that stay, with all their columns."""
    docs = locatable(docs, "exact-docs")
    groups = exact_groups(docs, digest)
    return keep_rows(docs, groups.where("kept").select("file", "row"))


def op4_exact_dedup(spark, sf_dir: str) -> DataFrame:
    docs = locatable(table(spark, sf_dir, "documents"), "exact-docs")
    return exact_groups(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLE = r"""
WITH d AS (
    SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS normal, length(coalesce(text, '')) AS n
    FROM documents
)
SELECT doc_id, first_value(doc_id) OVER (PARTITION BY normal ORDER BY n DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY normal) AS group_size,
       row_number() OVER (PARTITION BY normal ORDER BY n DESC, doc_id) = 1 AS kept, sha256(normal) AS text_sha256
FROM d
"""
