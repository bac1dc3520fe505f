"""Reading and writing forum tables with their declared schemas."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from forumlake import messages as M
from forumlake.functions.ranking import number_rows
from forumlake.schema import NOW, TABLES, Column, struct_type

Tables = dict[str, DataFrame]


def table_path(root: str, table: str) -> str:
    """Place of a table below a root folder or URI."""
    return f"{root.rstrip('/')}/{table}"


def load_tables(spark: SparkSession, root: str, names: Iterable[str] | None = None) -> Tables:
    """Lazy parquet scans of `<root>/<table>` with the declared schema, never inferred."""
    return {
        name: spark.read.schema(struct_type(name)).parquet(table_path(root, name))
        for name in (names or TABLES)
    }


def _default_sql(column: Column, as_of: datetime | str) -> str:
    if column.default is None:
        return "NULL"
    if column.default is NOW:
        return f"TIMESTAMP_NTZ'{as_of}'"
    return repr(column.default) if isinstance(column.default, str) else str(column.default)


def add_missing(df: DataFrame, table: str, as_of: datetime | str) -> DataFrame:
    """Append the table's columns that the frame lacks, filled with their default."""
    present = set(df.columns)
    absent = [c for c in TABLES[table] if c.name not in present]
    return df.selectExpr(
        "*", *[f"CAST({_default_sql(c, as_of)} AS {c.type.simpleString()}) AS {c.name}" for c in absent]
    )


def with_defaults(df: DataFrame, table: str, as_of: datetime | str) -> DataFrame:
    """All columns of the table, in order; absent or NULL values take the column default.

    Column types of the input are kept, so ids may be numbers or text.
    """
    full = add_missing(df, table, as_of)
    types = dict(full.dtypes)
    return full.selectExpr(
        *[
            c.name
            if c.default is None
            else f"coalesce({c.name}, CAST({_default_sql(c, as_of)} AS {types[c.name]})) AS {c.name}"
            for c in TABLES[table]
        ]
    )


def with_ids(df: DataFrame, table: str, start: int = 0) -> DataFrame:
    """The frame with its key: as it is if given, else made.

    Serial keys count on from `start` in the order of the given columns. Text keys are made
    from the row itself, in the shape of a UUID, so a seed that is loaded again keeps them.
    """
    key = TABLES[table][0]
    if key.name in df.columns:
        return df
    if isinstance(key.type, StringType):
        digest = F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]), 256)
        parts = [F.substring(digest, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
        return df.withColumn(key.name, F.concat_ws("-", *parts))
    numbered = number_rows(df, df.columns, out=key.name)
    return numbered.withColumn(key.name, (F.col(key.name) + F.lit(start)).cast(key.type))


class Seed(NamedTuple):
    """Rows of a seed and what was turned away: the row (JSON), the column, its text and the reason."""

    rows: DataFrame
    rejects: DataFrame


def typed_seed(raw: DataFrame, table: str, as_of: datetime | str, start: int = 0, holes: bool = False) -> Seed:
    """Seed rows with the table's types; a row with a value that its column cannot hold goes to the rejects.

    Columns that the seed lacks take their default, missing keys are made. An explicit NULL
    stays NULL and is left to the audits, unless `holes` says that it stands for an absent
    value. A row is rejected once for each of its malformed values. Columns that the table
    does not have are not looked at.
    """
    declared = {c.name: c.type for c in TABLES[table]}
    given = [c for c in raw.columns if c in declared]
    row = F.to_json(F.struct(*given), {"ignoreNullFields": "false"})
    cast = {c: F.col(c).try_cast(declared[c]) for c in given}
    bad = [
        F.when(F.col(c).isNotNull() & cast[c].isNull(), F.struct(
            F.lit(c).alias("column"), F.col(c).cast("string").alias("raw"), F.lit(M.NOT_OF_TYPE.format(declared[c].simpleString())).alias("reason"),
        ))
        for c in given
    ]
    marked = raw.select(*given).withColumns({"_row": row, "_bad": F.array_compact(F.array(*bad))})
    rejects = marked.select(F.col("_row").alias("row"), F.explode("_bad").alias("b")).select("row", "b.*")
    good = marked.where(F.size("_bad") == 0).select(*[cast[c].alias(c) for c in given])
    keyed = with_ids(good, table, start)
    full = with_defaults(keyed, table, as_of) if holes else add_missing(keyed, table, as_of)
    return Seed(full.select(*[F.col(c).cast(t).alias(c) for c, t in declared.items()]), rejects)


def load_seed(
    spark: SparkSession, path: str, table: str, as_of: datetime | str, header: bool = True, start: int = 0
) -> Seed:
    """Bulk load of a seed file (CSV or parquet): given columns read by name, rest by default.

    The file need not carry every column. An empty CSV field is a hole and takes the
    default. Run the audits on the rows before `write_snapshot`.
    """
    if path.rstrip("/").endswith(".csv"):
        raw = spark.read.option("header", header).option("multiLine", True).option("escape", '"').csv(path)
        return typed_seed(raw, table, as_of, start, holes=True)
    return typed_seed(spark.read.parquet(path), table, as_of, start)


def load_dimension(
    spark: SparkSession, path: str, table: str, as_of: datetime | str, header: bool = True, start: int = 0
) -> DataFrame:
    """The rows of a seed file without malformed values; an error names some of them if it has any."""
    rows, rejects = load_seed(spark, path, table, as_of, header, start)
    if some := rejects.take(3):
        raise ValueError(f"{path}: " + "; ".join(f"{r.column} = {r.raw!r} in {r.row}: {r.reason}" for r in some))
    return rows


def write_snapshot(df: DataFrame, root: str, table: str, partition_by: Iterable[str] = ()) -> str:
    """Write a table as a new snapshot; the caller switches readers to the new root."""
    path = table_path(root, table)
    df.write.mode("errorifexists").partitionBy(*partition_by).parquet(path)
    return path


def append_events(df: DataFrame, root: str, table: str, day_of: str, batch: int | str | None = None) -> str:
    """Append event rows, one directory per day of `day_of`; a day's rows are dealt together, large days split.

    With a `batch` id the rows go to a directory of that batch, and a batch that is sent
    again replaces its first try.
    """
    path = table_path(root, table)
    rows = df.withColumn("day", F.to_date(day_of)).hint("rebalance", "day")
    if batch is None:
        rows.write.mode("append").partitionBy("day").parquet(path)
    else:
        rows.write.mode("overwrite").partitionBy("day").parquet(f"{path}/batch={batch}")
    return path


def empty(spark: SparkSession, table: str) -> DataFrame:
    """A table without rows."""
    return spark.createDataFrame([], struct_type(table))


def conform(df: DataFrame, like: DataFrame) -> DataFrame:
    """Columns and types of `like`; columns it lacks become NULL."""
    columns = []
    for field in like.schema.fields:
        value = F.col(field.name) if field.name in df.columns else F.lit(None)
        columns.append(value.cast(field.dataType).alias(field.name))
    return df.select(*columns)


def register_views(tables: Tables, prefix: str = "") -> None:
    """Expose tables to `spark.sql`."""
    for name, df in tables.items():
        df.createOrReplaceTempView(prefix + name)


def write_bucketed(df: DataFrame, name: str, key: str, buckets: int) -> None:
    """Save as a table clustered by `key`, so that joins on it need no shuffle.

    Meant for tables with one row per key (posts by id, permissions by post_id), where
    buckets cannot be lopsided. Child rows of a viral post would all share one bucket:
    leave those unbucketed, their counts are combined before the shuffle.
    """
    df.write.mode("errorifexists").bucketBy(buckets, key).sortBy(key).saveAsTable(name)
