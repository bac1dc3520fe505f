"""Child counts: one row per parent, whatever the number of child tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def child_counts(key: str, only: DataFrame | None = None, **children: tuple[DataFrame, str] | tuple[DataFrame, str, Column]) -> DataFrame:
    """Count several child tables per parent key in one aggregation.

    `child_counts("post_id", likes=(likes, "post_id"), live=(comments, "post_id", cond))`
    gives one row per key that has any child. The children are stacked, so there is
    a single shuffle, and map-side partial sums keep a hot key to one row per task.
    `only` (a frame with the column `key`) keeps the counts of its keys. It meets the counts, one row per
    key; while it is small enough to broadcast, Spark moves that join down to every child by itself.
    """
    names = list(children)
    stacked = []
    for name, (df, column, *condition) in children.items():
        rows = df.where(condition[0]) if condition else df
        flags = [f"{int(n == name)}L AS {n}" for n in names]
        stacked.append(rows.where(f"{column} IS NOT NULL").selectExpr(f"{column} AS {key}", *flags))
    union = reduce(DataFrame.unionByName, stacked)
    counts = union.groupBy(key).agg(*[F.sum(n).alias(n) for n in names])
    return counts if only is None else counts.join(only.select(key), key, "left_semi")


def with_counts(parents: DataFrame, counts: DataFrame, parent_key: str, key: str) -> DataFrame:
    """Left-join counts to parents; absent counts are 0."""
    names = [c for c in counts.columns if c != key]
    keyed = counts.withColumnRenamed(key, "_counted")
    return parents.join(keyed, F.expr(f"{parent_key} = _counted"), "left").selectExpr(
        *parents.columns, *[f"coalesce({n}, 0L) AS {n}" for n in names]
    )
