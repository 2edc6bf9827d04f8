"""Listings, searches and the statistics table."""

import pytest
from pyspark.sql import functions as F

from tallyboard.plans import pages


@pytest.fixture(scope="module")
def names(spark):
    found = ["Blue Ring", "50% off", "50 off", "a_b", "axb", "back\\slash", "ÉTÉ"]
    return spark.createDataFrame([(str(i), n) for i, n in enumerate(found)], "id string, name string")


def listed(df):
    return [r.name for r in df.orderBy("id").collect()]


def test_like_search(names):
    assert listed(pages.search_like(names, "RING")) == ["Blue Ring"]
    assert listed(pages.search_like(names, "50% OFF")) == ["50% off", "50 off"]
    assert listed(pages.search_like(names, "A_B")) == ["a_b", "axb"]
    assert listed(pages.search_like(names, "k\\s")) == ["back\\slash"]
    assert listed(pages.search_like(names, "été")) == ["ÉTÉ"]


def test_contains_search(names):
    assert listed(pages.search_contains(names, "50% OFF")) == ["50% off"]
    assert listed(pages.search_contains(names, "A_B")) == ["a_b"]
    assert listed(pages.search_contains(names, "K\\S")) == ["back\\slash"]


@pytest.mark.parametrize("search", [pages.search_like, pages.search_contains])
@pytest.mark.parametrize("text", [None, ""])
def test_no_search_text_means_all(names, search, text):
    assert search(names, text).count() == 7


def test_pages(spark):
    df = spark.range(25).withColumn("pp", F.lit(1.0))
    order = [F.desc("pp"), F.asc("id")]

    def ids(number):
        return [r.id for r in pages.page(df, order, number, 10).collect()]

    assert ids(1) == list(range(10))
    assert ids(3) == list(range(20, 25))
    assert ids(4) == []
    assert ids(0) == ids(-5) == ids(1)
    plan = pages.page(df, order, 2, 10)._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in plan
    assert tuple(pages.page_count(df, 10).first()) == (25, 3)
    assert tuple(pages.page_count(df.limit(0), 10).first()) == (0, 0)


def test_lookup(spark):
    df = spark.createDataFrame([("1", "a"), ("2", "b")], "id string, name string")
    assert pages.by_id(df, "2").first().name == "b"
    assert pages.by_id(df, "3").count() == 0


def test_deep_ranking_pages(refreshed):
    players = refreshed[1]["players"]
    for number in (1, 5, 12):
        by_offset = [r["id"] for r in pages.ranking_page(players, number).collect()]
        by_rank = [r["id"] for r in pages.ranking_slice(players, number).collect()]
        assert by_offset == by_rank
    # the page where ranked players end is filled up by offset only
    assert len(pages.ranking_slice(players, 13).collect()) == 10
    assert len(pages.ranking_page(players, 13).collect()) == 50


def test_board_listing(refreshed):
    boards = refreshed[1]["leaderboards"]
    stars = [r.stars for r in pages.boards_by_stars(boards).collect()]
    assert len(stars) == 10 and stars == sorted(stars)
    stars = [r.stars for r in pages.boards_by_stars(boards, "ring", descending=True).collect()]
    assert len(stars) == 10 and stars == sorted(stars, reverse=True)


@pytest.mark.parametrize("name", list(pages.STATS_KEYS))
def test_statistics_sort_keys(refreshed, name):
    boards = refreshed[1]["leaderboards"]
    column = pages.STATS_KEYS[name]
    values = [r[column] for r in pages.stats_page(boards, sort_by=name).collect()]
    assert len(values) == 50 and values == sorted(values, reverse=True)


def test_statistics_sort_names():
    assert pages.stats_sort_column("Nonsense", True) == "total_pp"
    assert pages.stats_sort_column("Percentile", True) == "percentile"
    assert pages.stats_sort_column("Percentile", True, literal=True) == "average"
    assert pages.stats_sort_column("Percentile", False, literal=True) == "percentile"
    assert pages.stats_sort_column("Count80Ratio", True, literal=True) == "total_pp"


def test_score_pages(refreshed):
    scores, players, boards = (refreshed[1][t] for t in ("scores", "players", "leaderboards"))
    own = pages.player_page(scores, boards, "18", 2).collect()
    pp = [r.pp for r in own]
    assert len(own) == 10 and pp == sorted(pp, reverse=True)
    assert {r.player_id for r in own} == {"18"}
    assert all(r.leaderboard_name for r in own)
    on_board = pages.leaderboard_page(scores, players, "7").collect()
    assert len(on_board) == 10 and on_board[0].rank == 1
    assert all(r.player_name for r in on_board)
    assert pages.player_page(scores, boards, "nobody").count() == 0


def test_report_rounding(refreshed):
    boards = refreshed[1]["leaderboards"]
    stats = pages.stats_table(boards).where("id = '1'")
    shown, exact = pages.stats_report(stats).first(), stats.first()
    assert shown.total_pp == round(exact.total_pp, 2)
    assert shown.average == round(exact.average * 100, 1)
    assert shown.count80_ratio == round(exact.count80_ratio * 100, 1)
    assert shown["count"] == exact["count"]
    header = pages.board_header(boards.where("id = '1'")).first()
    assert header.stars == pytest.approx(boards.where("id = '1'").first().stars, abs=0.05)
