"""Mixing sources to target weights by a time-varying curriculum.

The size of a document is its number of words, [^\\x20\\x09-\\x0D]+ (null text: 0). Sources in
order of their code points, null last, weigh 5, 2, 1, repeating, and share `SHARE` times the
words of all; a target stops at `MOST` times the source's words and the excess is shared
anew by weight until none is above (found in closed form from one row per source).

Each document is taken a whole number of times. All documents of a source are taken
floor(target / words) times; for the rest of the target, whole documents are taken once more
in hash order while they fit, and the gap left by the first that doesn't fit is filled from
all documents not yet taken once more: of every size, the largest first, as many as still
fit, in hash order. So no spare document fits what a source misses of its target.

Every source has a weight schedule over training time from 0 to 1, piecewise linear. Its
integral, scaled to the words that the source contributes, is the source's cumulative token
demand. A copy whose words lie around c in the source's stream is placed where demand
reaches c, which inverts the integral piece by piece. The documents are then range-sorted
by position. Positions depend on ids, texts and sources alone, so reruns agree.

Prefix sums never gather a source: a source is cut into slices by hash, slice totals are
summed in one short window, and the rest is summed inside slices. The gap is filled from
counts of sizes, one row per source; its array holds sizes up to the gap only. Rows that are repeated
whole are equal in every respect and any of them may take the other's place. Null doc_ids
and sources are values like others. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from forumlake.llm.common import fresh, locatable, locator, stored, table

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
# relative weight at these times, by place in WEIGHTS: heavy sources early, light ones late
TIMES = (0.0, 0.5, 1.0)
SCHEDULES = ((1.5, 1.0, 0.5), (1.0, 1.0, 1.0), (0.5, 1.0, 1.5))
SLICES_PER_PARTITION = 8


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(rows: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """source, source_size, target, place: one row per source of `rows` (source, size)."""
    totals = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    # windows over one row per source
    ranked = totals.withColumn("place", F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))).cast("int"))
    ranked = ranked.withColumn("weight", F.element_at(cycle, F.col("place") + 1)).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    # sources reach their caps in order of cap / weight; `level` is the words per weight if all before are capped
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    before, rest = by_cap.rowsBetween(Window.unboundedPreceding, -1), by_cap.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything) * F.lit(share) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    ranked = ranked.withColumn("level", level).withColumn("below", F.col("level") * F.col("weight") < F.col("cap"))
    final = F.min(F.when(F.col("below"), F.struct((F.col("cap") / F.col("weight")).alias("r"), F.col("level")))).over(everything)["level"]
    ranked = ranked.withColumn("final", final)
    return ranked.select(
        "source", "source_size", "place",
        F.when(F.col("final").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("final") * F.col("weight"))).alias("target"),
    )


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def _position(share: Column, place: Column, times=TIMES, schedules=SCHEDULES) -> Column:
    """Time at which the schedule's integral reaches `share` (0 to 1) of its whole."""
    out = None
    for k, weights in enumerate(schedules):
        pieces = list(zip(times, times[1:], weights, weights[1:]))
        areas = [(t1 - t0) * (w0 + w1) / 2 for t0, t1, w0, w1 in pieces]
        need, done, at = share * sum(areas), 0.0, F.lit(float(times[-1]))
        for (t0, t1, w0, w1), area in reversed(list(zip(pieces, areas))):
            done = sum(areas[: pieces.index((t0, t1, w0, w1))])
            rest, slope = need - done, (w1 - w0) / (t1 - t0)
            # root of w0 x + slope x^2 / 2 = rest, in a form that also holds for slope 0
            x = 2 * rest / (w0 + F.sqrt(F.greatest(F.lit(w0 * w0) + 2 * slope * rest, F.lit(0.0))))
            at = F.when(need <= done + area, t0 + x).otherwise(at)
        out = F.when(place == k, at) if out is None else out.when(place == k, at)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), out))


def curriculum(docs: DataFrame) -> DataFrame:
    """A row per row of a `locatable` frame: doc_id, source, file, row, size, source_size, target, positions.

    `positions` has one training position for each time the mix takes the document.
    """
    spark = docs.sparkSession
    path, number = locator(docs)
    rows = docs.select("doc_id", "source", path.alias("file"), number.alias("row"), words(F.col("text")).alias("size"), F.xxhash64("doc_id", "text").alias("hash"))
    rows = stored(rows, "mix-rows")
    slices = max(64, SLICES_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = rows.withColumn("slice", F.pmod(F.shiftrightunsigned("hash", 1), F.lit(slices)))
    per_slice = rows.groupBy("source", "slice").agg(F.sum("size").alias("size"))
    goal = targets(per_slice)
    run = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_slice.select("source", "slice", F.coalesce(F.sum("size").over(run), F.lit(0)).alias("start"))
    starts = starts.alias("s").join(goal.alias("g"), _same("s.source", "g.source")).select("s.*", "source_size", "target", "place")
    # one row per slice and source
    joined = rows.alias("r").join(starts.alias("s"), _same("r.source", "s.source") & (F.col("r.slice") == F.col("s.slice"))).select("r.*", "start", "source_size", "target", "place")
    inside = Window.partitionBy("source", "slice").orderBy("hash", F.col("doc_id"), "size", "file", "row").rowsBetween(Window.unboundedPreceding, 0)
    joined = joined.withColumn("end", F.col("start") + F.sum("size").over(inside))
    times = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    joined = joined.withColumn("times", times).withColumn("rest", F.col("target") - F.col("times") * F.col("source_size"))
    joined = joined.withColumn("again", (F.col("size") > 0) & (F.col("end") <= F.col("rest")))
    joined = stored(joined, "mix-prefix")

    gaps = joined.groupBy("source").agg(F.first("rest").alias("rest"), F.sum(F.when(F.col("again"), F.col("size")).otherwise(0)).alias("got"))
    gaps = gaps.withColumn("gap", F.floor(F.col("rest") - F.col("got")))
    spare = joined.where(~F.col("again") & (F.col("size") > 0))
    sizes = spare.groupBy("source", "size").agg(F.count("*").alias("n"))
    sizes = sizes.alias("z").join(gaps.alias("g"), _same("z.source", "g.source")).where(F.col("size") <= F.col("gap")).select("z.*", "got", "gap")
    sizes = sizes.groupBy("source").agg(F.first("got").alias("got"), F.first("gap").alias("gap"), F.sort_array(F.collect_list(F.struct("size", "n")), asc=False).alias("sizes"))
    zero = F.struct(F.lit(0).cast("long").alias("sum"), F.array().cast("array<struct<size:bigint,take:bigint,base:bigint>>").alias("fill"))

    def fitting(acc: Column, z: Column) -> Column:
        take = F.least(z["n"], F.floor((F.col("gap") - acc["sum"]) / z["size"]))
        fill = F.concat(acc["fill"], F.array(F.struct(z["size"].alias("size"), take.alias("take"), acc["sum"].alias("base"))))
        return F.when(take > 0, F.struct((acc["sum"] + take * z["size"]).alias("sum"), fill.alias("fill"))).otherwise(acc)

    fills = stored(sizes.select("source", "got", F.explode(F.aggregate("sizes", zero, fitting)["fill"]).alias("f")).select("source", "f.size", "f.take", (F.col("got") + F.col("f.base")).alias("base")), "mix-fills")
    # of each size the first `take` in the order of slices and hashes
    both = _same("r.source", "f.source") & (F.col("r.size") == F.col("f.size"))
    some = spare.alias("r").join(fills.alias("f"), both).select("r.source", "r.size", "slice", "hash", "doc_id", "file", "row", "take", "base")
    counts = some.groupBy("source", "size", "slice").agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("source", "size").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("source", "size", "slice", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    both = _same("r.source", "c.source") & (F.col("r.size") == F.col("c.size")) & (F.col("r.slice") == F.col("c.slice"))
    some = some.alias("r").join(counts.alias("c"), both).where(F.col("ahead") < F.col("take")).select("r.*", "ahead")
    among = Window.partitionBy("source", "size", "slice").orderBy("hash", "doc_id", "file", "row")
    some = some.withColumn("k", F.col("ahead") + F.row_number().over(among)).where(F.col("k") <= F.col("take"))
    filled = some.select("file", "row", (F.col("base") + F.col("k") * F.col("size")).alias("filled"))
    plan = joined.join(filled, ["file", "row"], "left")
    extra = F.col("again") | F.col("filled").isNotNull()
    middle, done = F.col("end") - F.col("size") / 2, F.col("times") * F.col("source_size")
    at = lambda c: _position(F.when(F.col("target") > 0, c / F.col("target")).otherwise(F.lit(0.0)), F.col("place"))
    late = done + F.coalesce(F.col("filled") - F.col("size") / 2, middle)
    copies = [F.when(F.col("times") > k, at(k * F.col("source_size") + middle)) for k in range(MOST)] + [F.when(extra, at(late))]
    return plan.select("doc_id", "source", "file", "row", "hash", "size", "source_size", "target", F.array_compact(F.array(*copies)).alias("positions"))


def mix(docs: DataFrame) -> DataFrame:
    """The training stream: rows of `docs` as often as they are taken, range-sorted by position."""
    docs = locatable(docs, "mix-docs")
    file, row, at = fresh(docs, "at_file"), fresh(docs, "at_row"), fresh(docs, "at_position")
    path, number = locator(docs)
    plan = curriculum(docs).select(F.col("file").alias(file), F.col("row").alias(row), F.explode("positions").alias(at))
    taken = docs.withColumns({file: path, row: number}).join(plan, [file, row])
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return taken.repartitionByRange(parts, at, file, row).sortWithinPartitions(at, file, row).select(*[F.col(f"`{c}`") for c in docs.columns])


def op7_mix(spark, sf_dir: str) -> DataFrame:
    plan = curriculum(locatable(table(spark, sf_dir, "documents"), "mix-docs"))
    taken = (F.col("size") * F.size("positions")).alias("taken")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    out = plan.select("doc_id", "size", "source_size", "target", taken, F.array_min("positions").alias("first_position"))
    return out.repartitionByRange(parts, "first_position", "doc_id").sortWithinPartitions("first_position", "doc_id")
