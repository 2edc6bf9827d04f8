"""Positions in groups: both ways of counting against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from tallyboard.config import SkewPolicy
from tallyboard.operators.ranking import find_hot_groups, range_count, with_position

TINY = SkewPolicy(hot_rows=100, chunk_rows=37)
NO_BROADCAST = SkewPolicy(hot_rows=100, chunk_rows=37, broadcast_rows=0)


def rows_with_hot_group(seed=7):
    """A third of the rows in one group, a third of that with one and the same value."""
    rng = random.Random(seed)
    rows = []
    for i in range(1500):
        group = "hot" if i % 3 == 0 else f"g{rng.randrange(60)}"
        value = 0.0 if rng.random() < 0.35 else rng.randrange(40) / 4
        rows.append((i, group, value, rng.randrange(5)))
    rng.shuffle(rows)
    return rows


def expected(rows, by):
    groups = {}
    for r in rows:
        groups.setdefault(r[1] if by else None, []).append(r)
    found = {}
    for members in groups.values():
        members.sort(key=lambda r: (-r[2], r[0]))
        total, some = len([r for r in members if r[3] != 0]), 0
        top = max(r[3] for r in members)
        for place, r in enumerate(members, 1):
            some += r[3] > 2
            found[r[0]] = (place, some, total, top)
    return found


@pytest.mark.parametrize("by", [["g"], []])
@pytest.mark.parametrize("policy", [SkewPolicy(), TINY, NO_BROADCAST])
def test_positions(spark, by, policy):
    rows = rows_with_hot_group()
    df = spark.createDataFrame(rows, "id long, g string, v double, k int").repartition(5)
    placed = with_position(
        df,
        by,
        [F.desc("v"), F.asc("id")],
        "place",
        running={"some": F.col("k") > 2},
        totals={"total": F.col("k") != 0},
        highest={"top": "k"},
        policy=policy,
    )
    assert set(placed.columns) == {"id", "g", "v", "k", "place", "some", "total", "top"}
    found = {r.id: (r.place, r.some, r.total, r.top) for r in placed.collect()}
    assert found == expected(rows, by)


def test_hot_groups_are_found(spark):
    df = spark.createDataFrame(rows_with_hot_group(), "id long, g string, v double, k int")
    hot = find_hot_groups(df, ["g"], TINY)
    assert (hot.groups, hot.rows) == (1, 500)
    assert [r.g for r in hot.keys.collect()] == ["hot"]
    assert find_hot_groups(df, ["g"]).keys is None
    assert find_hot_groups(df, [], TINY).rows == 1500


def test_no_task_gets_a_hot_group(spark):
    """The ranges written for a hot group are all smaller than the group."""
    rows = [(i, "hot", 0.0) for i in range(4000)]
    df = spark.createDataFrame(rows, "id long, g string, v double")
    policy = SkewPolicy(hot_rows=1000, chunk_rows=500)
    placed = with_position(df, ["g"], [F.desc("v"), F.asc("id")], "place", policy=policy)
    assert [r.place for r in placed.orderBy("id").collect()] == list(range(1, 4001))
    parts = (
        df.repartitionByRange(8, "g", F.desc("v"), F.asc("id"))
        .groupBy(F.spark_partition_id())
        .count()
        .collect()
    )
    assert max(r["count"] for r in parts) < 1000


def test_null_is_a_group(spark):
    rows = [(i, None if i % 2 else "a") for i in range(40)]
    df = spark.createDataFrame(rows, "id long, g string")
    policy = SkewPolicy(hot_rows=15, chunk_rows=6)
    # both groups are above the limit
    placed = with_position(df, ["g"], [F.asc("id")], "place", policy=policy)
    found = {r.id: r.place for r in placed.collect()}
    assert found == {i: i // 2 + 1 for i in range(40)}


def test_ranges_are_bounded_by_what_a_shuffle_needs(spark):
    """Small chunks do not make a range, with samples on the driver, of every few rows."""
    policy = SkewPolicy(hot_rows=200, chunk_rows=1000)
    assert range_count(spark, 5000, policy) == 5
    assert range_count(spark, 36_000_000, policy) < 200
    assert range_count(spark, 216_000_000, policy) < 1200
    # rows of a range stay few enough to sort in memory
    assert 216_000_000 / range_count(spark, 216_000_000, policy) < 250_000
    assert range_count(spark, 10, policy) == 2


def test_bounded_ranges_give_the_same_places(spark):
    rows = rows_with_hot_group()
    df = spark.createDataFrame(rows, "id long, g string, v double, k int")
    policy = SkewPolicy(hot_rows=100, chunk_rows=1)
    assert range_count(spark, 500, policy) == 8
    placed = with_position(df, ["g"], [F.desc("v"), F.asc("id")], "place", policy=policy)
    assert {r.id: r.place for r in placed.collect()} == {i: v[0] for i, v in expected(rows, ["g"]).items()}
