"""Score series, axes, comparison, freshness and rating shares."""

import json

import pytest
from pyspark.sql import functions as F

from tallyboard.config import DEFAULT_SKEW, SkewPolicy
from tallyboard.plans import series

SCORES = (
    "id long, leaderboard_id string, player_id string, timepost long, weight double, rank long,"
    " modifiers string, accuracy double, pp double, fc boolean, fc_acc double"
)
PLAYERS = "id string, name string, avatar string, rank long"


@pytest.fixture(scope="module")
def rows(spark):
    scores = [
        (1, "b1", "p1", 86400, 1.0, 1, "FS,GN", 0.95, 200.0, True, 0.96),
        (2, "b1", "p2", 0, 0.5, 2, "", 1.0, 100.0, False, 1.0),
        (3, "b1", "p3", 86400, 0.5, 3, "SS", 0.9, 0.0, False, 0.9),
        (4, "b1", "p0", 86400, 0.5, 4, "", 0.9, 50.0, False, 0.9),
        (5, "b2", "p1", 172800, 0.965, 1, "", 0.8, 80.0, False, 0.85),
        (6, "b2", "nobody", 1, 1.0, 1, "", 0.8, 80.0, False, 0.85),
    ]
    players = [("p0", "None", "", 0), ("p1", "Ann", "x", 1), ("p2", "Bo", "", 2), ("p3", "Cy", "", 3)]
    return series.score_series(
        spark.createDataFrame(scores, SCORES), spark.createDataFrame(players, PLAYERS)
    )


def points(df):
    return {r.id: (r.x, r.y) for r in df.collect()}


def test_series(rows):
    assert rows.columns == ["id", "leaderboard_id", *series.SERIES_COLUMNS]
    first = rows.where("id = 1").first()
    assert (first.accuracy, first.player_rank, first.player_name) == (95.0, 1, "Ann")
    # a score without a player is not in the series
    assert rows.where("id = 6").count() == 0


def test_series_of_one_board(refreshed):
    scores, players = refreshed[1]["scores"], refreshed[1]["players"]
    assert series.score_series(scores, players, "0").count() == 816


def test_json(rows):
    row = series.series_json(rows).where("id = 1").first()
    parsed = json.loads(row.json)
    assert list(parsed) == [series.JSON_NAMES.get(c, c) for c in series.SERIES_COLUMNS]
    assert (parsed["playerId"], parsed["pp"], parsed["fc"]) == ("p1", 200.0, True)


def test_json_keeps_nulls(rows):
    row = series.series_json(rows.withColumn("fc_acc", F.lit(None).cast("double"))).first()
    assert json.loads(row.json)["fcAcc"] is None


@pytest.mark.parametrize("policy", [DEFAULT_SKEW, SkewPolicy(3, 4, 0)], ids=["usual", "split"])
def test_chunks_join_to_the_array_of_a_board(spark, rows, policy):
    one = rows.where("id = 1").drop("id", "rank", "leaderboard_id")
    # a large board whose ranks are not the order of the ids, one with equal and one with no ranks
    places = spark.range(47).selectExpr(
        "id", "if(id < 30, 'a', if(id < 42, 'b', 'c')) AS leaderboard_id",
        "if(id < 30, 100 - id, if(id < 42, 0, null)) AS rank",
    )
    many = places.crossJoin(one).select(*rows.columns)
    chunks = series.series_json_chunks(many, 7, policy=policy).collect()
    for board, total in {"a": 30, "b": 12, "c": 5}.items():
        own = sorted((r.chunk, r.entries, r.json) for r in chunks if r.leaderboard_id == board)
        full, rest = divmod(total, 7)
        assert [n for _, n, _ in own] == [7] * full + [rest] * (rest > 0)
        assert [k for k, _, _ in own] == list(range(len(own)))
        joined = [entry for _, _, text in own for entry in json.loads(text)]
        single = series.series_json(many.where(many.leaderboard_id == board)).collect()
        ranks = {r.id: (r.rank is not None, r.rank, r.id) for r in many.collect()}
        single.sort(key=lambda r: ranks[r.id])
        assert joined == [json.loads(r.json) for r in single]


def test_no_chunks_of_no_scores(rows):
    assert series.series_json_chunks(rows.limit(0)).count() == 0


def test_not_a_number_is_missing(rows):
    odd = rows.withColumn("pp", F.when(F.col("id") == 1, F.lit(float("nan"))).otherwise(F.col("pp")))
    assert set(points(series.series_axes(odd, "pp", "weight"))) == {2, 5}


def test_axes(rows):
    assert points(series.series_axes(rows)) == {
        1: (1, 100.0),
        2: (2, 50.0),
        3: (3, 50.0),
        5: (1, 96.5),
    }
    # zero points drop on pp and weightedPp, a perfect accuracy on acc, no date on date
    assert set(points(series.series_axes(rows, "pp", "weight"))) == {1, 2, 5}
    assert set(points(series.series_axes(rows, "weightedPp", "weight"))) == {1, 2, 5}
    assert set(points(series.series_axes(rows, "acc", "weight"))) == {1, 3, 5}
    assert set(points(series.series_axes(rows, "date", "weight"))) == {1, 3, 5}
    # a perfect full-combo accuracy stays
    assert set(points(series.series_axes(rows, "fcAcc", "weight"))) == {1, 2, 3, 5}


def test_rank_share_counts_all_scores_of_the_board(rows):
    found = points(series.series_axes(rows, "rank", "pp"))
    assert found[1] == (25.0, 200.0)
    assert found[2] == (50.0, 100.0)
    assert found[5] == (100.0, 80.0)


def test_full_combo_axis(rows):
    assert points(series.series_axes(rows, "fcAcc"))[1][0] == pytest.approx(4.0)
    assert points(series.series_axes(rows, "fcAcc", literal=True))[1][0] == pytest.approx(99.04)


def test_unknown_axis_is_null(rows):
    found = points(series.series_axes(rows, "pauses"))
    assert set(found) == {1, 2, 3, 5} and found[1][0] is None


def test_modifier_lists(rows):
    found = {r.id: r.mods for r in series.series_axes(rows).collect()}
    assert found[1] == ["FS", "GN"] and found[2] is None


def test_compare(rows):
    both = series.compare_series(rows, "b1", "b2", "rank", "weight").collect()
    found = {(r.id, r.is_compare): r.x for r in both}
    assert found == {(1, False): 25.0, (2, False): 50.0, (3, False): 75.0, (5, True): 100.0}


def test_freshness(spark):
    day, now = 86400, 1_000_000_000
    ages = {0: 255, -5: 255, 120: 128 + 127 // 8, 240: 128, 9999: 128}
    df = spark.createDataFrame([(now - a * day, a) for a in ages], "t long, age long")
    found = df.select("age", series.score_freshness(F.col("t"), now).alias("b")).collect()
    assert {r.age: r.b for r in found} == ages


def test_rating_shares(spark):
    boards = spark.createDataFrame(
        [("a", 10.0, 5.0, 7.5), ("b", 17.2, 1.0, 9.0)],
        "id string, tech_rating double, pass_rating double, acc_rating double",
    )
    own = {r.id: r for r in series.rating_shares(boards).collect()}
    assert own["a"].max_rating == 15 and own["a"].acc_share == 0.5
    assert own["b"].max_rating == 18 and own["b"].acc_share == 0.5
    pair = {r.id: r for r in series.rating_shares_compare(boards, "a", "b").collect()}
    assert pair["a"].max_rating == 18 and pair["a"].pass_share == pytest.approx(5 / 18)
