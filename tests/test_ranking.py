"""Ranks and sequences against plain Python, with one key holding most rows."""

import random

import pytest
from pyspark.sql import functions as F

from forumlake.functions.ranking import carry_forward, number_rows, slice_rows, top_per_group


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    return [
        (i, rng.choice(["hot", "hot", "hot", "a", "b", None]), rng.randrange(40), rng.choice([None, "x", "y"]))
        for i in range(3000)
    ]


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, "id INT, k STRING, t INT, v STRING").repartition(5)


def _groups(rows):
    groups = {}
    for row in sorted(rows, key=lambda r: (r[2], r[0])):
        groups.setdefault(row[1], []).append(row)
    return groups


def test_number_rows_per_key(df, rows):
    want = {r[0]: i for g in _groups(rows).values() for i, r in enumerate(g, 1)}
    got = {r["id"]: r["n"] for r in number_rows(df, ["t", "id"], ["k"], "n").collect()}
    assert got == want


def test_number_rows_globally(df, rows):
    ordered = sorted(rows, key=lambda r: (r[2], r[0]))
    got = {r["id"]: r["n"] for r in number_rows(df, ["t", "id"], (), "n").collect()}
    assert got == {r[0]: i for i, r in enumerate(ordered, 1)}


@pytest.mark.parametrize("inclusive", [True, False])
def test_carry_forward(df, rows, inclusive):
    want = {}
    for group in _groups(rows).values():
        last = None
        for row in group:
            before = last
            last = row[3] if row[3] is not None else last
            want[row[0]] = last if inclusive else before
    sliced = slice_rows(df, ["k"], ["t", "id"])
    got = {r["id"]: r["c"] for r in carry_forward(sliced, "v", "c", inclusive).collect()}
    assert got == want


@pytest.mark.parametrize("k", [1, 3, 1200])
def test_top_per_group(df, rows, k):
    want = {(r[0], i) for g in _groups(rows).values() for i, r in enumerate(g, 1) if i <= k}
    top = top_per_group(df, ["k"], [F.col("t").asc(), F.col("id").asc()], k, "n")
    assert {(r["id"], r["n"]) for r in top.collect()} == want
