"""Board statistics against plain Python on small made-up boards."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyboard.config import SkewPolicy
from tallyboard.operators.boards import (
    board_megametrics,
    board_ratios,
    board_statistics,
    board_stats,
    flag_top_players,
    held_scores,
    weight_levels,
)

SCORES = "id long, leaderboard_id string, player_id string, pp double, weight double"
PLAYERS = "id string, top_pp double, ranked_play_count long, rank long"


def fixture(seed=3):
    rng = random.Random(seed)
    players = []
    for i in range(400):
        top = 0.0 if i % 9 == 0 else 100 + rng.random() * 400
        players.append((f"p{i}", top, rng.choice([10, 41, 49, 50, 76, 126, 300]), i + 1))
    scores, n = [], 0
    for board, size in (("big", 2000), ("mid", 90), ("ten", 30), ("eleven", 34), ("one", 1)):
        for _ in range(size):
            who, top, _, _ = rng.choice(players)
            scores.append((n, board, who, rng.random() * (top or 50), 0.965 ** rng.randrange(60)))
            n += 1
    # a board where nobody has points
    scores += [(n + i, "zero", "p0", 0.0, 1.0) for i in range(40)]
    return scores, players


def brute(scores, players):
    about = {p[0]: p[1:] for p in players}
    boards = {}
    for s in scores:
        boards.setdefault(s[1], []).append((s[0], s[3], s[4], *about[s[2]]))

    def mean(values, least=0):
        values = list(values)
        return math.fsum(values) / len(values) if len(values) > least else 0.0

    found = {}
    for board, rows in boards.items():
        heavy = sorted((r for r in rows if r[3] != 0), key=lambda r: (-r[2], r[0]))
        k = int(len(heavy) * 0.33)
        score = lambda r: r[1] / r[3] * r[2]
        found[board] = {
            "count": len(rows),
            "count80": sum(r[2] > 0.8 for r in rows),
            "count95": sum(r[2] > 0.95 for r in rows),
            "average": mean(r[2] for r in rows),
            "top250": sum(r[5] < 250 and r[2] > 0.965**39.5 for r in rows),
            "total_pp": math.fsum(r[1] * r[2] for r in rows),
            "pp_ratio_filtered": mean(r[1] / r[3] for r in heavy if r[4] >= 50),
            "pp_ratio_unfiltered": mean(r[1] / r[3] for r in heavy),
            "percentile": mean((r[2] for r in heavy[:k]), 10),
            "megametric": mean((score(r) for r in heavy[:k] if r[4] > 75), 10),
            **{
                f"megametric{t}": mean((score(r) for r in [r for r in heavy if r[4] > t][:k]), 10)
                for t in (125, 75, 40)
            },
        }
    return found


@pytest.mark.parametrize("policy", [SkewPolicy(), SkewPolicy(hot_rows=60, chunk_rows=100)])
def test_all_statistics(spark, policy):
    scores, players = fixture()
    s, p = spark.createDataFrame(scores, SCORES), spark.createDataFrame(players, PLAYERS)
    expected = brute(scores, players)
    found = {
        r.leaderboard_id: r.asDict() for r in board_statistics(held_scores(s, p), policy=policy).collect()
    }
    assert found.keys() == expected.keys()
    for board, values in expected.items():
        del found[board]["leaderboard_id"]
        assert found[board] == pytest.approx(values, abs=1e-9), board
    assert found["ten"]["percentile"] == 0
    assert found["zero"]["pp_ratio_unfiltered"] == 0


def test_parts_equal_the_whole(spark):
    scores, players = fixture(5)
    s, p = spark.createDataFrame(scores, SCORES), spark.createDataFrame(players, PLAYERS)
    whole = {r.leaderboard_id: r.asDict() for r in board_statistics(held_scores(s, p)).collect()}
    for part in (board_stats(s, p), board_megametrics(s, p)):
        for r in part.collect():
            for column, value in r.asDict().items():
                assert value == pytest.approx(whole[r.leaderboard_id][column])


def test_both_ways_to_join_players(spark):
    """Scores that carry their player's values give the same statistics."""
    scores, players = fixture()
    s, p = spark.createDataFrame(scores, SCORES), spark.createDataFrame(players, PLAYERS)
    carried = s.join(
        p.select(F.col("id").alias("player_id"), "top_pp", "ranked_play_count"), "player_id"
    )
    joined = board_statistics(held_scores(s, p)).collect()
    flagged = board_statistics(flag_top_players(carried, p)).collect()
    assert {r.leaderboard_id: r.top250 for r in flagged} == {
        r.leaderboard_id: r.top250 for r in joined
    }


def test_literal_repeats_the_filtered_ratio(spark):
    scores, players = fixture()
    s, p = spark.createDataFrame(scores, SCORES), spark.createDataFrame(players, PLAYERS)
    rows = board_stats(s, p, literal=True).collect()
    assert all(r.pp_ratio_filtered == r.pp_ratio_unfiltered for r in rows)


def test_percentile_does_not_depend_on_ties(spark):
    scores, players = fixture()
    renumbered = [(100000 - s[0], *s[1:]) for s in scores]
    p = spark.createDataFrame(players, PLAYERS)

    def percentiles(rows):
        found = board_megametrics(spark.createDataFrame(rows, SCORES), p)
        return {r.leaderboard_id: r.percentile for r in found.collect()}

    assert percentiles(scores) == pytest.approx(percentiles(renumbered))


def test_ratios(spark):
    df = spark.createDataFrame([(10, 5, 2), (3, 0, 0), (0, 0, 0)], "count long, count80 long, count95 long")
    found = [tuple(r)[3:] for r in board_ratios(df).orderBy(F.desc("count")).collect()]
    assert found == [(0.5, 0.2, 0.4), (0.0, 0.0, 0.0), (0.0, 0.0, 0.0)]


def _tied(spark, seed):
    """Boards with few distinct weights, so that thirds end inside a weight."""
    rng = np.random.default_rng(seed)
    rows = [
        (int(k), f"b{k % 3}", float(pp), 0.965 ** int(rng.integers(0, 4)), float(top), int(plays), bool(k % 5 == 0))
        for k, (pp, top, plays) in enumerate(
            zip(rng.uniform(0, 90, 400).round(2), rng.choice([0.0, 100.0, 150.0], 400, p=[0.1, 0.6, 0.3]),
                rng.integers(30, 140, 400))
        )
    ]
    schema = "id long, leaderboard_id string, pp double, weight double, top_pp double, ranked_play_count long, top_player boolean"
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("policy", [SkewPolicy(hot_rows=1), SkewPolicy(hot_rows=5, chunk_rows=10, broadcast_rows=0)])
def test_ties_at_the_cut(spark, seed, policy):
    held = _tied(spark, seed)
    sorted_way = {r.leaderboard_id: r for r in board_statistics(held).collect()}
    counted_way = {r.leaderboard_id: r for r in board_statistics(held, policy=policy).collect()}
    assert set(sorted_way) == set(counted_way)
    for board, row in sorted_way.items():
        assert row[1:] == pytest.approx(counted_way[board][1:], rel=1e-12)
        assert row.megametric40 > 0 and row.megametric125 != row.megametric


def test_hot_scores_are_summed_before_they_move(spark, capsys):
    weight_levels(_tied(spark, 1)).explain()
    plan = capsys.readouterr().out.split("\n")
    moved = [k for k, line in enumerate(plan) if "Exchange hashpartitioning" in line]
    assert len(moved) == 1 and "partial_sum" in plan[moved[0] + 1]


def test_hot_boards_are_not_ranged(spark, monkeypatch):
    """Only rows at the weight of a cut are put in order, by id."""
    from tallyboard.operators import boards

    ordered = []
    place = boards.with_position

    def noted(df, by, order, position, **more):
        ordered.append((position, df.count()))
        return place(df, by, order, position, **more)

    monkeypatch.setattr(boards, "with_position", noted)
    held = _tied(spark, 1)
    board_statistics(held, policy=SkewPolicy(hot_rows=1)).collect()
    rows = dict(ordered)
    assert rows["_place"] == 0 and 0 < rows["place"] < 4 * held.count()
