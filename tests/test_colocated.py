"""Tables stored by player and by board: same results, and no rows that move."""

import pytest
from pyspark.sql import functions as F

from tallyboard.config import SkewPolicy
from tallyboard.operators import boards
from tallyboard.plans import colocated, series
from tallyboard.session import materialise, new_path
from tallyboard.sources import buckets

SPLIT = SkewPolicy(hot_rows=300, chunk_rows=1000, broadcast_rows=0)
# as SPLIT, but the few hot keys may be broadcast
SPLIT_FEW = SkewPolicy(hot_rows=300, chunk_rows=1000)


@pytest.fixture(scope="module")
def stored(spark, refreshed):
    return {name: materialise(df, name) for name, df in refreshed[1].items()}


@pytest.fixture(scope="module")
def layout(spark, stored):
    return colocated.store(stored, new_path(spark, "layout"))


@pytest.fixture(scope="module")
def split(spark, stored):
    return colocated.store(stored, new_path(spark, "layout"), policy=SPLIT_FEW)


@pytest.fixture
def no_small_broadcasts(spark):
    """Tables of the test are small enough to be broadcast; large ones are not."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    yield
    spark.conf.set(name, before)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def moved(df):
    """Lines of the plan with an exchange of rows between tasks."""
    lines = [line for line in plan(df).splitlines() if "Exchange" in line]
    return [line for line in lines if "BroadcastExchange" not in line]


def rows(df):
    columns = sorted(df.columns)
    numbers = [F.round(c, 6).alias(c) if dict(df.dtypes)[c] == "double" else c for c in columns]
    return sorted(map(repr, df.select(*numbers).collect()))


def test_series_move_nothing(layout, no_small_broadcasts):
    text = plan(colocated.stored_series(layout))
    assert "SortMergeJoin" in text and "Bucketed: true" in text
    assert moved(colocated.stored_series(layout)) == []


def test_statistics_move_nothing(layout):
    assert moved(colocated.stored_board_stats(layout)) == []
    assert moved(colocated.stored_board_statistics(layout)) == []


def test_hot_players_stay_and_hot_boards_move_sums(split, no_small_broadcasts):
    assert split.scores.hot_keys.groups > 0 and split.held.hot_keys.groups > 0
    # one row per hot player is sent out, the scores are not
    assert moved(colocated.stored_series(split, SPLIT_FEW)) == []
    text = plan(colocated.stored_board_stats(split))
    assert len(moved(colocated.stored_board_stats(split))) == 1
    assert "partial_count" in text


@pytest.mark.parametrize("policy", [SPLIT, SPLIT_FEW])
def test_same_as_plain_tables(spark, stored, policy):
    layout = colocated.store(stored, new_path(spark, "layout"), policy=policy)
    scores, players = stored["scores"], stored["players"]
    assert rows(colocated.stored_series(layout, policy)) == rows(
        series.score_series(scores, players)
    )
    held = boards.held_scores(scores, players).withColumn(
        "top_player", F.coalesce("top_player", F.lit(False))
    )
    assert rows(colocated.stored_board_stats(layout)) == rows(boards.board_stats(scores, players))
    assert rows(colocated.stored_board_statistics(layout, policy=policy)) == rows(
        boards.board_statistics(held)
    )


def test_another_session_opens_the_folder(spark, stored):
    root = new_path(spark, "layout")
    colocated.store(stored, root)
    other = spark.newSession()
    name = buckets._name(f"{root}/scores")
    spark.sql(f"DROP TABLE {name}")  # what a new session with a catalogue of its own knows
    opened = colocated.open_layout(other, root)
    other.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    assert moved(colocated.stored_series(opened)) == []
    assert colocated.stored_series(opened).count() == stored["scores"].count()


def test_null_and_hot_null_keys(spark):
    rows_ = [(i, None if i % 3 else f"p{i % 7}") for i in range(500)]
    df = materialise(spark.createDataFrame(rows_, "id long, player_id string"), "nulls")
    policy = SkewPolicy(hot_rows=100)
    table = buckets.write_table(df, new_path(spark, "nulls"), "player_id", 4, policy)
    assert table.hot_keys.groups == 1
    assert table.hot.where("player_id is not null").count() == 0
    assert sorted(table.all_rows().collect(), key=lambda r: r["id"]) == sorted(df.collect())


def test_empty_table(spark):
    df = spark.createDataFrame([], "id long, player_id string")
    table = buckets.write_table(df, new_path(spark, "empty"), "player_id", 4)
    assert table.hot is None and table.all_rows().count() == 0


def test_bucket_counts_divide_each_other(spark):
    counts = [buckets.bucket_count(spark, rows) for rows in (0, 10**6, 10**9, 10**15)]
    assert all(n & (n - 1) == 0 for n in counts)
    assert counts == sorted(counts) and counts[-1] == buckets.MAX_BUCKETS
