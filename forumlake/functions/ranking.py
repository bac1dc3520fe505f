"""Ranks and sequences that never put one whole group into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

SLICE, KEY, ROW = "_slice", "_key", "_row"
PER_PART = 64  # sampled rows per slice
STEP = 16
_SALTS = 64


def _group_limit(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000"))


def top_per_group(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank"
) -> DataFrame:
    """The first k rows of every group with their 1-based rank; exact.

    Small k: Spark limits each group before the shuffle, so a hot group sends at
    most k rows per map task. Beyond Spark's threshold for that rewrite the group
    is first cut to k rows in salted sub-groups, then ranked.
    """
    if k >= _group_limit(df):
        salt = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(_SALTS))
        salted = Window.partitionBy(*keys, "_salt").orderBy(*order)
        df = (
            df.withColumn("_salt", salt)
            .withColumn(rank, F.row_number().over(salted))
            .where(F.col(rank) <= k)
            .drop("_salt", rank)
        )
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= k)


def _cut_points(df: DataFrame, row: Column, parts: int) -> Column:
    """Sorted rows that cut `df` into about equal parts, in runs of `STEP`: those of a sample of bounded size, chosen by hash.

    A scalar subquery: it runs once with the plan that uses it, so retried tasks see the same cuts.
    The runs are laid out in it as well, not once more for every row.
    """
    sample = df.select(row.alias("_row")).orderBy(F.xxhash64("_row"), "_row").limit(parts * PER_PART)
    ordered = sample.agg(F.sort_array(F.collect_list("_row")).alias("_rows"))
    places = F.sequence(F.lit(PER_PART), F.greatest(F.size("_rows"), F.lit(PER_PART)), F.lit(PER_PART))
    cuts = ordered.select(F.array_compact(F.transform(places, lambda i: F.get("_rows", i))).alias("_cuts"))
    starts = F.expr(f"filter(sequence(1, greatest(size(_cuts), 1), {STEP}), i -> i <= size(_cuts))")
    return cuts.select(F.transform(starts, lambda i: F.slice("_cuts", i, STEP)).alias("_runs")).scalar()


def _below(runs: Column, row: Column) -> Column:
    """How many cuts lie at or below a row, found in two steps: whole runs, then inside the last one begun."""
    begun = F.size(F.filter(runs, lambda run: F.get(run, F.lit(0)) <= row)) - 1
    inside = F.size(F.filter(F.get(runs, begun), lambda c: c <= row))
    return F.coalesce(F.when(begun >= 0, begun * STEP + inside), F.lit(0))  # never NULL, so no filter looks it up once more


def slice_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows with their slice of the whole order and their key; a hot key spreads over slices.

    Lazy: a row's slice follows from cut points, whatever task computes it. What is done per
    slice and key shuffles the rows once; facts about them combine before the shuffle.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    row = F.struct(*order)
    cut = df.withColumns({ROW: row, "_cuts": _cut_points(df, row, parts)})
    return keyed_slices(cut.withColumn(SLICE, _below(F.col("_cuts"), F.col(ROW))).drop("_cuts"), keys)


def keyed_slices(sliced: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows that have slices, under other keys; without keys all rows have one."""
    return sliced.withColumn(KEY, F.struct(*keys) if keys else F.struct(F.lit(0)))


def _inside(frame_end: int | None = None) -> WindowSpec:
    window = Window.partitionBy(SLICE, KEY).orderBy(ROW)
    return window if frame_end is None else window.rowsBetween(Window.unboundedPreceding, frame_end)


def _before() -> WindowSpec:
    """The earlier slices of a key: at most one fact for each."""
    return Window.partitionBy(KEY).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)


def row_index(sliced: DataFrame, out: str = "row_index") -> DataFrame:
    """1-based position in the order, per key of the slices."""
    facts = sliced.groupBy(SLICE, KEY).agg(F.count(F.lit(1)).alias("_n"))
    facts = facts.select(SLICE, KEY, F.coalesce(F.sum("_n").over(_before()), F.lit(0)).alias("_offset"))
    rows = sliced.withColumn(out, F.row_number().over(_inside()))
    return rows.join(facts, [SLICE, KEY]).withColumn(out, F.col("_offset") + F.col(out)).drop("_offset")


def number_rows(
    df: DataFrame, order: Sequence[str], keys: Sequence[str] = (), out: str = "row_index"
) -> DataFrame:
    """Exact 1..n per key in the given order, without a per-key task."""
    return row_index(slice_rows(df, keys, order), out).drop(SLICE, KEY, ROW)


def carry_forward(sliced: DataFrame, value: str, out: str, inclusive: bool = True) -> DataFrame:
    """Last non-NULL `value` up to a row (or strictly before it), per key of the slices.

    Inside a slice a window finds it; across slices one value per slice and key is carried over.
    """
    facts = sliced.groupBy(SLICE, KEY).agg(F.expr(f"max_by({value}, {ROW}) FILTER (WHERE {value} IS NOT NULL)").alias("_last"))
    facts = facts.select(SLICE, KEY, F.last("_last", ignorenulls=True).over(_before()).alias("_carried"))
    rows = sliced.withColumn(out, F.last(value, ignorenulls=True).over(_inside(0 if inclusive else -1)))
    return rows.join(facts, [SLICE, KEY]).withColumn(out, F.coalesce(out, "_carried")).drop("_carried")
