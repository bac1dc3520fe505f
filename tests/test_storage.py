"""Paths with a host, and updates of stored tables."""

import pytest
from pyspark.sql import functions as F

from conftest import NOW
from forumlake.operators.outcome import update_stored
from forumlake.sources.tables import append_events, load_dimension, load_seed, table_path, typed_seed, with_ids

DDL = "id long, g string, v string"


@pytest.mark.parametrize("root", ["s3a://lake/x", "hdfs://nn:8020/forum", "file:///tmp/x", "/tmp/x"])
def test_paths_keep_their_host(root):
    assert table_path(root, "posts") == table_path(root + "/", "posts") == root + "/posts"


def test_rows_move_and_null_partitions_are_updated(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = [(1, "a", "x"), (2, "b", "x"), (3, "a", "y"), (4, None, "z"), (5, "c", "x")]
    spark.createDataFrame(rows, DDL).write.partitionBy("g").parquet(path)
    delta = spark.createDataFrame([(2, "a", "moved"), (4, None, "n"), (9, "c", "unknown")], DDL)
    assert update_stored(path, delta, "id", "g") == [None, "a", "b"]
    got = sorted(map(tuple, spark.read.parquet(path).select("id", "g", "v").collect()))
    assert got == [(1, "a", "x"), (2, "a", "moved"), (3, "a", "y"), (4, None, "n"), (5, "c", "x")]
    with pytest.raises(ValueError):
        update_stored(path, delta.union(delta), "id", "g")


def test_ids_of_seeds(spark):
    seed = spark.createDataFrame([("b", "x"), ("a", None)], "value string, label string")
    assert [(r.id, r.value) for r in with_ids(seed, "topics", 5).orderBy("id").collect()] == [(6, "a"), (7, "b")]
    made = [r.id for r in with_ids(seed, "aliases").collect()]
    assert len(set(made)) == 2 and all(len(i) == 36 for i in made)
    assert with_ids(seed.withColumn("id", F.lit(1)), "topics").columns == ["value", "label", "id"]


def test_a_batch_sent_again_counts_once(spark, tmp_path):
    rows = spark.createDataFrame([(1, "2024-01-01 10:00:00"), (2, "2024-01-02 10:00:00")], "id long, at string")
    rows = rows.withColumn("at", F.col("at").cast("timestamp_ntz"))
    for batch in ("first", "first", "second"):
        path = append_events(rows, str(tmp_path), "user_logins", "at", batch)
    assert sorted((r.id, str(r.day), r.batch) for r in spark.read.parquet(path).collect()) == [
        (1, "2024-01-01", "first"), (1, "2024-01-01", "second"), (2, "2024-01-02", "first"), (2, "2024-01-02", "second")]


def test_malformed_seed_values_are_reported(spark, tmp_path):
    rows = [
        ("1", "music", "l", "social", "maybe", "x7", None), ("2", "sport", "l", "event", "true", "3", "2024-02-30 00:00:00"),
        ("3", None, "l", "event", None, "99999999999", "2024-02-03 00:00:00"), ("4", "art", "l", None, None, None, "2024-02-03 00:00:00"),
    ]
    raw = spark.createDataFrame(rows, "id string, value string, label string, category string, is_hot string, display_order string, created_at string")
    seed = typed_seed(raw.withColumn("more", F.lit(1)), "topics", NOW)
    assert sorted((r.column, r.raw) for r in seed.rejects.collect()) == [
        ("created_at", "2024-02-30 00:00:00"), ("display_order", "99999999999"), ("display_order", "x7"), ("is_hot", "maybe"),
    ]
    kept = seed.rows.collect()
    # an explicit NULL stays for the audit, an absent column takes its default
    assert [(r.id, r.category, r.is_hot, r.display_order, r.is_hidden) for r in kept] == [(4, None, None, None, False)]
    assert [(r.is_hot, r.display_order) for r in typed_seed(raw, "topics", NOW, holes=True).rows.collect()] == [(False, 0)]
    path = str(tmp_path / "seed.parquet")
    raw.write.parquet(path)
    with pytest.raises(ValueError, match="maybe|x7|2024-02-30|99999999999"):
        load_dimension(spark, path, "topics", NOW)
    assert load_seed(spark, path, "topics", NOW).rejects.count() == 4
    empty = typed_seed(raw.limit(0), "topics", NOW)
    assert empty.rows.count() == 0 and empty.rejects.count() == 0
