"""State of a stream as files: rows in hash buckets, folded as micro-batches come in.

Every batch writes a segment of its own. When `fold` segments of one size are complete they
are written once more as one segment, so after n batches the rows lie in the segments that
the digits of n in base `fold` name: a number that grows with the logarithm of n, and each
row is rewritten that often. Which segments hold the state before a batch follows from its
number alone; nothing is listed and no schema is guessed.

A batch that is run again overwrites its own segments and folds. What a fold has replaced is
deleted when the next batch starts, for only then the fold's batch is known to be complete.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructType

from forumlake.session import short_shuffles

BUCKET = "bucket"
SEGMENT = "segment"
FOLD = 8
BUCKETS = 16


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def delete(spark: SparkSession, path: str) -> None:
    place, system = _place(spark, path)
    system.delete(place, True)


def cover(batches: int, fold: int) -> list[tuple[int, int]]:
    """(first, last) of the segments that hold the first `batches` batches."""
    size = 1
    while size * fold <= batches:
        size *= fold
    out, at = [], 0
    while size:
        while batches - at >= size:
            out.append((at, at + size - 1))
            at += size
        size //= fold
    return out


def folds(batches: int, fold: int) -> list[tuple[tuple[int, int], list[tuple[int, int]]]]:
    """What is folded after the first `batches` batches: each new segment and its parts, small ones first."""
    out, size = [], fold
    while batches and batches % size == 0:
        first, part = batches - size, size // fold
        out.append(((first, batches - 1), [(at, at + part - 1) for at in range(first, batches, part)]))
        size *= fold
    return out


class Segments:
    """Rows by `key`. `merge` reduces rows of one key, as sums or the latest ones, and may be applied again and again."""

    def __init__(
        self, spark: SparkSession, path: str, key: str, merge: Callable[[DataFrame], DataFrame] | None = None,
        fold: int = FOLD, buckets: int = BUCKETS, order: Sequence[str] = (),
    ):
        """Files are sorted by `order`, so a reader that picks by these columns skips most pages."""
        self.order = order
        self.spark, self.path, self.key, self.fold, self.buckets = spark, path, key, fold, buckets
        self.merge = merge or (lambda rows: rows)

    def _at(self, segment: tuple[int, int]) -> str:
        return f"{self.path}/{SEGMENT}={segment[0]}-{segment[1]}"

    def _bucket(self, key: str):
        return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(self.buckets)).cast("int")

    def _put(self, rows: DataFrame, segment: tuple[int, int]) -> None:
        # a bucket's rows lie together, large buckets are split
        rows = rows.withColumn(BUCKET, self._bucket(self.key)).hint("rebalance", BUCKET)
        if self.order:
            rows = rows.sortWithinPartitions(BUCKET, *self.order)
        with short_shuffles(rows.sparkSession):
            rows.write.mode("overwrite").partitionBy(BUCKET).parquet(self._at(segment))

    def _read(self, segments: Iterable[tuple[int, int]], schema: StructType) -> DataFrame:
        paths = [self._at(s) for s in segments]
        declared = StructType([*schema.fields]).add(BUCKET, IntegerType()).add(SEGMENT, StringType())
        if not paths:
            return self.spark.createDataFrame([], declared).drop(SEGMENT)
        return self.spark.read.schema(declared).option("basePath", self.path).parquet(*paths).drop(SEGMENT)

    def start(self, batch: int) -> None:
        """Drops what the folds of the batch before have replaced."""
        for _, parts in folds(batch, self.fold):
            for part in parts:
                delete(self.spark, self._at(part))

    def write(self, rows: DataFrame, batch: int) -> None:
        self._put(rows, (batch, batch))
        for whole, parts in folds(batch + 1, self.fold):
            self._put(self.merge(self._read(parts, rows.schema).drop(BUCKET)), whole)

    def of(self, batch: int, schema: StructType) -> DataFrame:
        """The rows that a batch has written, until the next one starts."""
        return self._read([(batch, batch)], schema).drop(BUCKET)

    def before(self, batch: int, schema: StructType, touched: DataFrame | None = None) -> DataFrame:
        """Rows of all earlier batches; with `touched` (key) only those of its keys, from their buckets.

        Before the first batch there are none, and `touched` is not read.
        """
        return self.merge(self.parts(batch, schema, touched))

    def parts(self, batch: int, schema: StructType, touched: DataFrame | None = None, only: Column | None = None) -> DataFrame:
        """The same rows as they were written, not merged yet; `only` picks rows before they meet `touched`."""
        rows = self._read(cover(batch, self.fold), schema)
        if only is not None:
            rows = rows.where(only)
        if touched is not None and batch > 0:
            # at most `buckets` numbers
            hit = [r[0] for r in touched.select(self._bucket(touched.columns[0])).distinct().collect()]
            keys = touched.toDF("_key")
            rows = rows.where(F.col(BUCKET).isin(hit)).join(keys, F.col(self.key) == keys["_key"], "left_semi")
        return rows.drop(BUCKET)


class Notes:
    """Small facts of single batches, each a file; only those of the last batches are kept."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _at(self, batch: int) -> str:
        return f"{self.path}/batch={batch}"

    def read(self, batch: int) -> dict | None:
        place, system = _place(self.spark, f"{self._at(batch)}/_SUCCESS")
        if batch < 0 or not system.exists(place):
            return None
        return json.loads(self.spark.read.schema("value string").option("wholetext", True).text(self._at(batch)).first()[0])

    def write(self, batch: int, facts: dict) -> None:
        self.spark.createDataFrame([(json.dumps(facts),)], "value string").coalesce(1).write.mode("overwrite").text(self._at(batch))
        delete(self.spark, self._at(batch - 2))

    def latest(self) -> int | None:
        """The last batch noted."""
        place, system = _place(self.spark, self.path)
        if not system.exists(place):
            return None
        noted = [int(f.getPath().getName().removeprefix("batch=")) for f in system.listStatus(place)]
        return max((b for b in noted if self.read(b) is not None), default=None)
