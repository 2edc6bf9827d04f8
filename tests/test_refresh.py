"""The pipeline against known totals, and properties that must hold for any data."""

import pytest
from pyspark.sql import functions as F

from tallyboard.config import SkewPolicy
from tallyboard.operators.players import player_ranks, player_totals
from tallyboard.operators.updates import changed_values, changed_weights
from tallyboard.plans.refresh import refresh_all, refresh_scores, refresh_summary
from tallyboard.plans.rescore import what_if_rescore
from __spark_entry__ import TRIAL_RATING

# totals of the DuckDB queries, whose rows are rounded to four digits
BOARD_SUMS = {
    "count": 60000,
    "count80": 4265,
    "count95": 1220,
    "average": 451.2692,
    "top250": 9894,
    "percentile": 29.9029,
    "megametric": 4.5324,
    "megametric125": 3.7089,
    "megametric75": 3.8120,
    "megametric40": 9.2735,
    "pp_ratio_filtered": 316.2337,
    "pp_ratio_unfiltered": 378.1088,
    "total_pp": 5547215.1989,
}

# hot boards, and one of the many small ones
BOARDS = {
    "0": (816, 0, 0, 0.0900, 10, 282.5122, 0.2704, 0, 0.0, 0.0, 0.0005, 0.0025, 0.0029),
    "1": (785, 14, 6, 0.1609, 78, 34115.9133, 0.4542, 0.1468, 0.0203, 0.0208, 0.0784, 0.1134, 0.1357),
    "2": (762, 3, 2, 0.1211, 41, 12677.4573, 0.3552, 0, 0.0056, 0.0056, 0.0317, 0.0637, 0.0759),
    "3": (805, 45, 9, 0.2133, 108, 59108.1685, 0.5795, 0.2047, 0.0342, 0.0386, 0.1295, 0.1484, 0.1799),
    "500": (23, 2, 0, 0.3385, 9, 5894.6871, 0, 0, 0, 0, 0, 0.2482, 0.2738),
}
BOARD_ORDER = (
    "count",
    "count80",
    "count95",
    "average",
    "top250",
    "total_pp",
    "percentile",
    "megametric",
    "megametric125",
    "megametric75",
    "megametric40",
    "pp_ratio_filtered",
    "pp_ratio_unfiltered",
)


def test_score_totals(refreshed):
    scores = refreshed[1]["scores"]
    row = scores.agg(
        F.count("*").alias("n"),
        F.sum("pp").alias("pp"),
        F.sum("bonus_pp").alias("bonus"),
        F.max("pp").alias("top"),
        F.count_if(F.col("pp") == 0).alias("none"),
        F.count_if(F.col("bonus_pp") < -1e-6).alias("slower"),
        F.max(F.abs(F.col("pass_pp") + F.col("acc_pp") + F.col("tech_pp") - F.col("pp"))).alias("gap"),
    ).first()
    assert row.n == 60000
    assert row.pp == pytest.approx(15509176.3317, abs=0.02)
    assert row.bonus == pytest.approx(1579832.0262, abs=0.02)
    assert row.top == pytest.approx(7529.96, abs=1e-4)
    assert (row.none, row.slower) == (4454, 17076)
    assert row.gap < 1e-8


def test_points_by_modifiers(refreshed):
    sums = {
        r.modifiers: r.pp
        for r in refreshed[1]["scores"].groupBy("modifiers").agg(F.sum("pp").alias("pp")).collect()
    }
    assert sums == pytest.approx(
        {
            "": 2147610.61,
            "BFS": 1206758.26,
            "FS": 2946061.83,
            "NA,NB": 865736.43,
            "NF": 0,
            "SF,GN": 4161983.49,
            "SS": 1488629.13,
            "fs": 2692396.58,
        },
        abs=0.02,
    )


def test_players(refreshed):
    players = refreshed[1]["players"]
    known = {1: ("12", 38366.9390), 2: ("15", 36751.1740), 3: ("6", 34626.7127), 610: ("719", 728.5365)}
    found = {r["rank"]: (r["id"], r["pp"]) for r in players.where("rank > 0").collect()}
    assert sorted(found) == list(range(1, 611))
    for rank, (player, pp) in known.items():
        assert found[rank][0] == player
        assert found[rank][1] == pytest.approx(pp, abs=1e-4)
    first = players.where("rank = 1").first()
    assert first.top_pp == pytest.approx(3707.9475, abs=1e-4)
    assert first.ranked_play_count == 2086
    total = players.agg(F.sum("pp")).first()[0]
    assert total == pytest.approx(5547215.1991, abs=0.02)
    # players without scores keep their zeros
    assert players.where("rank = 0").agg(F.sum("pp"), F.max("ranked_play_count")).first() == (0.0, 0)


def test_boards(refreshed):
    boards = refreshed[1]["leaderboards"]
    sums = boards.agg(*[F.sum(c).alias(c) for c in BOARD_SUMS]).first().asDict()
    assert sums == pytest.approx(BOARD_SUMS, abs=0.02)
    scored = boards.where("count > 0")
    assert scored.count() == 2000
    assert scored.where("megametric = 0").count() == 1984
    for row in boards.where(F.col("id").isin(*BOARDS)).collect():
        assert [row[c] for c in BOARD_ORDER] == pytest.approx(BOARDS[row["id"]], abs=6e-5)


def test_ranks_are_complete(refreshed):
    scores, players = refreshed[1]["scores"], refreshed[1]["players"]

    def gaps(df, group, rank):
        ends = df.groupBy(group).agg(
            F.count("*").alias("n"), F.countDistinct(rank).alias("d"), F.max(rank).alias("m")
        )
        return ends.where("n <> d or n <> m").count()

    assert gaps(scores, "leaderboard_id", "rank") == 0
    located = players.where("rank > 0 and country is not null")
    assert gaps(located, "country", "country_rank") == 0
    assert players.where("country is null and country_rank <> 0").count() == 0


def test_weights_follow_the_decay(refreshed):
    places = refreshed[1]["scores"].select(
        "player_id", F.rint(F.log(F.col("weight")) / F.log(F.lit(0.965))).alias("place")
    )
    ends = places.groupBy("player_id").agg(
        F.count("*").alias("n"), F.countDistinct("place").alias("d"), F.max("place").alias("m")
    )
    assert ends.where("n <> d or n <> m + 1").count() == 0


def test_refreshing_again_changes_nothing(refreshed):
    imported, once = refreshed
    again = refresh_all({**once})
    assert changed_weights(once["scores"], again["scores"]).count() == 0
    assert changed_values(once["scores"], again["scores"], "rank").count() == 0
    assert changed_values(once["players"], again["players"], "rank").count() == 0
    assert changed_values(once["leaderboards"], again["leaderboards"], "percentile").count() == 0


def test_hot_groups_change_nothing(refreshed):
    """The whole refresh with nearly every group split gives the same tables."""
    imported, once = refreshed
    split = refresh_all(imported, policy=SkewPolicy(hot_rows=150, chunk_rows=4000))
    for table, columns in {
        "scores": ("pp", "rank", "weight"),
        "players": ("pp", "rank", "country_rank", "ranked_play_count"),
        "leaderboards": ("total_pp", "top250", "percentile", "megametric", "megametric40"),
    }.items():
        for column in columns:
            changed = changed_values(once[table], split[table], column, tolerance=1e-7)
            assert changed.count() == 0, (table, column)


def test_unknown_players_take_no_rank(spark, refreshed):
    totals = player_totals(refreshed[1]["scores"])
    fewer = refreshed[0]["players"].where("id <> '18'")
    ranks = player_ranks(totals, fewer)
    ends = ranks.agg(F.count("*"), F.min("rank"), F.max("rank"), F.countDistinct("rank")).first()
    assert tuple(ends) == (609, 1, 609, 609)


def test_orphans_stay(spark, refreshed):
    """Scores without a board keep their row and get no points."""
    imported, once = refreshed
    fewer = imported | {"leaderboards": imported["leaderboards"].where("id <> '7'")}
    scores = refresh_scores(fewer["scores"], fewer["leaderboards"])
    assert scores.count() == 60000
    lost = scores.where("leaderboard_id = '7'").agg(F.count("*"), F.max("pp"), F.max("weight"))
    found = lost.first()
    assert found[0] > 100 and found[1] == 0


def test_only_what_is_asked_for(spark, refreshed):
    """The players alone, with the input computed once, before the stages."""
    imported, once = refreshed
    times = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            times.add(batch.num_rows)
            yield batch

    lineage = imported["scores"].mapInArrow(counted, imported["scores"].schema)
    found = refresh_all(imported | {"scores": lineage}, only=["players"])
    assert list(found) == ["players"]
    assert changed_values(once["players"], found["players"], "rank").count() == 0
    assert times.value == 60000


def test_summary(refreshed):
    rows = {(r.table_name, r.column_name): r for r in refresh_summary(refreshed[1]).collect()}
    assert rows["scores", "pp"].rows == 60000
    assert rows["leaderboards", "count"].total == 60000


def test_what_if(refreshed):
    imported, once = refreshed
    trial = what_if_rescore(imported, once, TRIAL_RATING)
    players = trial["players"]
    assert players.count() == 1500
    assert players.where("rank_delta <> 0").count() > 0
    assert players.where("abs(new_pp - old_pp - pp_delta) > 1e-9").count() == 0
    assert trial["scores"].agg(F.sum("old_pp")).first()[0] == pytest.approx(15509176.3317, abs=0.02)


def test_publishing_leaves_no_scratch_and_refuses_a_stale_base(spark, refreshed):
    from pathlib import Path

    from tallyboard.plans.refresh import refresh_and_publish
    from tallyboard.session import new_path, scratch_folder
    from tallyboard.sources import snapshots

    imported, tables = refreshed
    root = new_path(spark, "published")
    folder = Path(scratch_folder(spark)) / "tallyboard"
    before = set(folder.iterdir())
    first = refresh_and_publish(imported, root)
    assert set(folder.iterdir()) - before == {Path(root)}
    assert snapshots.read_latest(spark, root)["scores"].count() == tables["scores"].count()
    small = {"leaderboards": tables["leaderboards"].limit(5)}
    second = snapshots.publish_snapshot(small, root, base=first)
    with pytest.raises(snapshots.Conflict):
        snapshots.publish_snapshot(small, root, base=first)
    assert snapshots.latest_version(spark, root) == second
    # a number that another writer holds is passed over, or refuses who built on a base
    assert snapshots.claim(spark, root, 3)
    with pytest.raises(snapshots.Conflict):
        snapshots.publish_snapshot(small, root, base=second)
    third = snapshots.publish_snapshot(small, root)
    assert snapshots.latest_version(spark, root) == third


def test_an_import_is_stored_once_for_a_query(spark, tmp_path):
    """Snapshots and trials of a folder start from the same stored scores."""
    import __spark_entry__ as registry
    from conftest import TESTDATA

    folder = str(tmp_path)
    for name in ("lineitem", "orders", "customer", "part"):
        spark.read.parquet(str(TESTDATA / "sf0.001" / f"{name}.parquet")).limit(300).write.parquet(
            f"{folder}/{name}.parquet"
        )
    first, again = (registry._imported_once(spark, folder)["scores"] for _ in range(2))
    assert first is again
    plan = first._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Join" not in plan
