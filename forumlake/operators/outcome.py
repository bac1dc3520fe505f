"""Result of a batch operator, and applying it to tables."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from datetime import datetime
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from forumlake.functions.exprs import ntz
from forumlake.functions.ranking import number_rows
from forumlake.schema import primary_key
from forumlake.session import freeze
from forumlake.sources.tables import Tables, conform

APPLIED, NOOP, REJECTED = "applied", "noop", "rejected"


class Deltas(Mapping):
    """Row changes per table. Values given as functions are built when first asked for."""

    def __init__(self, values: Mapping[str, DataFrame | Callable[[], DataFrame]]):
        self._values = dict(values)

    def __getitem__(self, table: str) -> DataFrame:
        if not isinstance(self._values[table], DataFrame):
            self._values[table] = self._values[table]()
        return self._values[table]

    def __iter__(self):
        return iter(self._values)

    def __len__(self):
        return len(self._values)


@dataclass
class Outcome:
    """Every request with its verdict, and the row changes of the applied ones.

    `decided` holds the request columns plus `outcome` (applied / noop / rejected)
    and `reason`. `inserts` and `updates` map table names to rows; an update frame
    holds the key and the changed columns only. Both are built on first use, so a
    caller interested in verdicts alone does not pay for id allocation. Use `frozen()`
    when verdicts and changes are both written: the checks then run once.
    """

    decided: DataFrame
    build: Callable[["Outcome"], tuple[dict, dict]] = field(default=lambda outcome: ({}, {}))

    def frozen(self) -> "Outcome":
        """The same outcome over materialised verdicts."""
        return Outcome(freeze(self.decided), self.build)

    @property
    def accepted(self) -> DataFrame:
        return self.decided.where(F.col("outcome") != REJECTED).drop("reason")

    @property
    def applied(self) -> DataFrame:
        return self.decided.where(F.col("outcome") == APPLIED).drop("outcome", "reason")

    @property
    def rejected(self) -> DataFrame:
        return self.decided.where(F.col("outcome") == REJECTED).drop("outcome")

    @cached_property
    def _deltas(self) -> tuple[Deltas, Deltas]:
        inserts, updates = self.build(self)
        return Deltas(inserts), Deltas(updates)

    @property
    def inserts(self) -> Deltas:
        return self._deltas[0]

    @property
    def updates(self) -> Deltas:
        return self._deltas[1]


def decide(df: DataFrame, noop=None) -> DataFrame:
    """Turn a `reason` column into `outcome`; `noop` marks accepted rows without effect."""
    accepted = F.lit(APPLIED) if noop is None else F.when(noop, F.lit(NOOP)).otherwise(F.lit(APPLIED))
    return df.withColumn("outcome", F.when(F.col("reason").isNotNull(), F.lit(REJECTED)).otherwise(accepted))


def update_rows(target: DataFrame, delta: DataFrame, key: str) -> DataFrame:
    """Replace the delta's columns in matching rows of the target."""
    changed = [c for c in delta.columns if c != key]
    marked = delta.select(F.col(key).cast(target.schema[key].dataType).alias("_key"), *changed)
    joined = target.join(marked, target[key] == marked["_key"], "left")
    return joined.select(
        *[
            F.when(marked["_key"].isNotNull(), marked[c].cast(target.schema[c].dataType))
            .otherwise(target[c])
            .alias(c)
            if c in changed
            else target[c]
            for c in target.columns
        ]
    )


def insert_rows(target: DataFrame, delta: DataFrame) -> DataFrame:
    return target.unionByName(conform(delta, target))


def apply_outcome(tables: Tables, outcome: Outcome) -> Tables:
    """New table frames with the outcome's changes; write them as the next snapshot."""
    outcome = outcome.frozen()
    after = dict(tables)
    for name, delta in outcome.updates.items():
        after[name] = update_rows(tables[name], delta, primary_key(name))
    for name, delta in outcome.inserts.items():
        after[name] = insert_rows(after[name] if name in after else tables[name], delta)
    return after


def update_stored(path: str, delta: DataFrame, key: str, partition_by: str, schema: StructType | None = None) -> list:
    """Apply an update delta to a stored, partitioned table; returns the partitions rewritten.

    Only directories that hold changed rows are read in full and written again, e.g.
    the months of the comments that were edited. The new rows are materialised before
    the overwrite starts, so a lost task or a second run finds its input intact. Rows may
    move to another partition, and partition values may be NULL. `schema` is the declared
    schema; without it the types of partition values are inferred from their directories.
    A delta with repeated keys is refused.
    """
    spark = delta.sparkSession
    if delta.groupBy(key).count().where("count > 1").take(1):
        raise ValueError(f"the delta has several rows for one {key}")
    target = (spark.read.schema(schema) if schema else spark.read).parquet(path)
    delta = freeze(delta)
    hit = target.select(key, partition_by).join(delta.select(key), key, "left_semi")
    places = hit.select(partition_by)
    if partition_by in delta.columns:  # a row may move to another directory
        moved = delta.join(hit.select(key), key, "left_semi").select(F.col(partition_by).cast(target.schema[partition_by].dataType))
        places = places.unionByName(moved)
    places = freeze(places.distinct())  # one value per directory
    touched = [row[0] for row in places.collect()]
    if touched:
        inside = F.col(partition_by).eqNullSafe(F.col("_place"))
        rows = target.join(places.select(F.col(partition_by).alias("_place")), inside, "left_semi")
        rows = freeze(update_rows(rows, delta, key))
        # a directory that all rows leave is not overwritten, so it goes
        left = places.join(rows.select(F.col(partition_by).alias("_place")), F.col(partition_by).eqNullSafe(F.col("_place")), "left_anti")
        old = target.withColumn("_file", target.metadataColumn("_metadata")["file_path"])
        old = old.join(left.select(F.col(partition_by).alias("_place")), F.col(partition_by).eqNullSafe(F.col("_place")), "left_semi")
        emptied = [r[0] for r in old.select(F.regexp_replace("_file", "/[^/]*$", "")).distinct().collect()]
        writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy(partition_by).parquet(path)
        for folder in emptied:
            place = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(folder))
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    return sorted(touched, key=lambda v: (v is not None, v))


def stamp(delta: DataFrame, as_of: datetime | str) -> DataFrame:
    """Changed rows carry the time of the change."""
    return delta.withColumn("updated_at", ntz(as_of))


def last_id(tables: Mapping[str, DataFrame], table: str) -> int:
    """Highest serial in use: one number, read from one column."""
    return tables[table].agg(F.max("id")).first()[0] or 0


def with_serial(tables: Mapping[str, DataFrame], table: str, rows: DataFrame, *order: str) -> DataFrame:
    """Allocate ids for new rows of `table` in the given total order."""
    start = last_id(tables, table)
    numbered = number_rows(rows, order)
    return numbered.withColumn("id", F.col("row_index") + F.lit(start)).drop("row_index")


def moderation_log(
    tables: Mapping[str, DataFrame],
    rows: DataFrame,
    as_of: datetime | str,
    action: str,
    target_type: str,
    actor: str,
    target: str,
    reason: str,
    order: tuple[str, ...] = ("requested_at", "request_id"),
) -> DataFrame:
    """Log rows for moderation actions, to be appended to `moderation_logs`."""
    logged = rows.select(
        F.col(actor).cast("string").alias("moderator_id"),
        F.lit(action).alias("action"),
        F.col(target).cast("string").alias("target_id"),
        F.lit(target_type).alias("target_type"),
        F.col(reason).alias("reason"),
        ntz(as_of).alias("created_at"),
        *[F.col(c).alias(f"_by_{c}") for c in order],
    )
    by = [f"_by_{c}" for c in order]
    return with_serial(tables, "moderation_logs", logged, *by).drop(*by)


