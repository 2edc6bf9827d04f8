"""The plans hold what the scaling relies on: few shuffles, pruned scans, top-k pages."""

import re

import pytest
from pyspark.sql import functions as F

from tallyboard.config import SkewPolicy
from tallyboard.operators import boards, players, scores
from tallyboard.operators.ranking import with_position
from tallyboard.plans import pages, refresh, series
from tallyboard.session import materialise


@pytest.fixture(scope="module")
def stored(spark, refreshed):
    return {name: materialise(df, name) for name, df in refreshed[1].items()}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(df):
    """Key columns of every shuffle in the plan."""
    return re.findall(r"(?<!Broadcast)Exchange (?:hash|range)partitioning\((\w+)#", plan(df))


def scanned(df):
    return re.findall(r"ReadSchema: struct<(.*?)>(?:\n|$)", plan(df))


def test_score_refresh_shuffles_once_per_key(stored):
    df = refresh.refresh_scores(stored["scores"], stored["leaderboards"])
    assert shuffles(df) == ["player_id", "leaderboard_id"]
    assert plan(df).count("Sort [") == 2


def test_points_are_not_shuffled_to_the_boards(stored):
    """They are computed where the scores of a board lie already."""
    text = plan(refresh.refresh_scores(stored["scores"], stored["leaderboards"]))
    moved = text[text.index("hashpartitioning(leaderboard_id") :]
    moved = moved[: moved.index("BroadcastExchange")] if "BroadcastExchange" in moved else moved
    assert text.index("BroadcastHashJoin") < text.index("hashpartitioning(leaderboard_id")
    assert "acc_rating" not in moved and "rank#" not in moved


def test_totals_share_the_window_of_the_places(stored):
    text = plan(refresh.refresh_scores(stored["scores"], stored["leaderboards"]))
    assert text.count("Window [") == 2
    carried = stored["scores"].withColumns({"top_pp": F.col("pp"), "ranked_play_count": F.col("rank")})
    held = boards.flag_top_players(carried, stored["players"])
    assert plan(boards.board_statistics(held)).count("Window [") == 1


def test_hot_groups_are_not_shuffled_again(stored):
    """After the range partitioning only one row per range moves."""
    policy = SkewPolicy(hot_rows=100, chunk_rows=5000)
    order = [F.desc("pp"), F.asc("id")]
    df = with_position(stored["scores"], ["leaderboard_id"], order, "place", policy=policy)
    # the usual groups, and for the hot ones the counts per range and their sums
    assert shuffles(df) == ["leaderboard_id"] * 3
    assert "rangepartitioning" not in plan(df)
    assert "partial_count" in plan(df)


def test_totals_reuse_the_grouping_of_the_weights(stored):
    scored = scores.score_pp(stored["scores"], stored["leaderboards"])
    assert shuffles(players.player_totals(scores.score_weights(scored))) == ["player_id"]


def test_board_statistics_shuffle_and_sort_once(stored):
    carried = stored["scores"].withColumns(
        {"top_pp": F.col("pp"), "ranked_play_count": F.col("rank")}
    )
    df = boards.board_statistics(boards.flag_top_players(carried, stored["players"]))
    assert shuffles(df) == ["leaderboard_id"]
    assert plan(df).count("Sort [") == 1
    assert "cover" not in plan(df) and "modifiers" not in "".join(scanned(df))


def test_group_sizes_come_from_the_stored_scores(stored, monkeypatch):
    """Without given sizes, the join with the players is not evaluated for them."""
    asked = []
    found = boards.find_hot_groups
    monkeypatch.setattr(boards, "find_hot_groups", lambda df, *a: asked.append(df) or found(df, *a))
    boards.board_megametrics(stored["scores"], stored["players"])
    assert asked == [stored["scores"]]


def test_simple_statistics_combine_before_the_shuffle(stored):
    df = boards.board_stats(stored["scores"], stored["players"])
    text = plan(df)
    assert shuffles(df) == ["leaderboard_id"]
    assert text.index("HashAggregate") < text.index("Exchange hash") < text.index("partial_avg")


def test_formula_stays_in_generated_code(stored):
    text = plan(scores.score_pp(stored["scores"], stored["leaderboards"]))
    assert "PythonUDF" not in text and "ArrowEvalPython" not in text


def test_generated_methods_can_be_compiled(spark, stored, capsys):
    """The JVM leaves methods above 8000 bytes to the interpreter."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        refresh.refresh_scores(stored["scores"], stored["leaderboards"]).explain("codegen")
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
    assert sizes and max(sizes) < 8000


@pytest.mark.parametrize("number", [1, 7])
def test_pages_are_top_k(stored, number):
    for df in (
        pages.ranking_page(stored["players"], number),
        pages.stats_page(stored["leaderboards"], "ring", "Average", True, number),
        pages.boards_by_stars(stored["leaderboards"], None, False, number),
        pages.ranking_slice(stored["players"], number),
        pages.player_page(stored["scores"], stored["leaderboards"], "18", number),
    ):
        assert "TakeOrderedAndProject" in plan(df)
        assert shuffles(df) == []


def test_filters_reach_the_scan(stored):
    slice_plan = plan(pages.ranking_slice(stored["players"], 3))
    assert "GreaterThanOrEqual(rank,101)" in slice_plan
    own = plan(pages.player_page(stored["scores"], stored["leaderboards"], "18"))
    assert "EqualTo(player_id,18)" in own


def test_series_shuffle_nothing(stored):
    rows = series.score_series(stored["scores"], stored["players"])
    assert shuffles(series.series_axes(rows)) == []
    # the totals of a known small number of boards: only partial counts are shuffled
    ranked = series.series_axes(rows, "rank", "pp", few_boards=True)
    assert shuffles(ranked) == ["leaderboard_id"]
    assert "partial_count" in plan(ranked)
    # stored totals: nothing is shuffled or scanned twice
    given = series.series_axes(
        rows, "rank", "pp", few_boards=True, boards=stored["leaderboards"]
    )
    assert shuffles(given) == [] and plan(given).count("FileScan parquet") == 3


def test_deep_leaderboard_pages_filter_on_the_rank(stored, capsys):
    # the plain plan shortens its list of filters
    pages.leaderboard_slice(stored["scores"], stored["players"], "7", 40).explain("formatted")
    text = capsys.readouterr().out
    assert "GreaterThanOrEqual(rank,391)" in text and "TakeOrderedAndProject" in text
