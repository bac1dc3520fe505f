"""What several operators share: tables in the shared folder, row locators, sampled labels."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forumlake.session import work_dir


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


_shipped: set[str] = set()


def ship(spark) -> None:
    """Lets Python workers import this package where it is not on their path already."""
    package = Path(__file__).resolve().parents[1]
    app = spark.sparkContext.applicationId
    if app in _shipped or str(package.parent) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    _shipped.add(app)
    archive = f"{tempfile.mkdtemp(prefix='ship-')}/{package.name}.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, str(file.relative_to(package.parent)))
    spark.sparkContext.addPyFile(archive)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Written below the shared folder and read again, so that a lost executor costs no lineage."""
    path = work_dir(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that `df` does not have, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def locatable(df: DataFrame, name: str) -> DataFrame:
    """`df` if it is a plain table scan, where file and row number name a row; else a stored copy."""
    plain = df._jdf.queryExecution().analyzed().nodeName() == "LogicalRelation"
    return df if plain and df.inputFiles() else stored(df, name)


def locator(df: DataFrame) -> tuple[Column, Column]:
    """File path and row number of each row of a `locatable` frame."""
    meta = df.metadataColumn("_metadata")
    return meta["file_path"], meta["row_index"]


def keep_rows(df: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows of a `locatable` frame whose locator is among `keys` (file, row), columns as they are."""
    file, row = fresh(df, "at_file"), fresh(df, "at_row")
    path, number = locator(df)
    tagged = df.withColumns({file: path, row: number})
    right = keys.select(F.col("file").alias(file), F.col("row").alias(row))
    return tagged.join(right.hint("shuffle_hash"), [file, row], "left_semi").select(*[F.col(f"`{c}`") for c in df.columns])


def join_facts(rows: DataFrame, facts: DataFrame, key: str, often: Column) -> DataFrame:
    """`rows` with the columns of `facts`, which has one row per key; both are read twice.

    `often` marks the facts of keys with a large share of all rows. As shares add up to one
    there are few of them whatever the size of the table, so they are broadcast and a hot
    key's rows stay where they are.
    """
    hot = F.broadcast(facts.where(often))
    rest = rows.join(hot.select(key), key, "left_anti").join(facts.where(~often), key)
    return rows.join(hot, key).unionByName(rest)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, keep: Column, per_class: dict[int, int]) -> DataFrame:
    """At most `per_class[v]` documents for each label value: (text, label), one per doc_id.

    Chosen by a hash of doc_id among the labelled ids for which `keep` holds. An id with
    several labels counts as the largest, one with several texts as the smallest.
    """
    ids = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & keep)
    ids = ids.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    chosen = None
    for value, most in per_class.items():
        part = ids.where(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        chosen = part if chosen is None else chosen.unionByName(part)
    # bounded by the sum of per_class, whatever the size of the labels
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    return rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label")).select("text", "label")
