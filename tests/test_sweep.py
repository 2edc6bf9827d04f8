"""Several configurations in one pass."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import SPLIT, SWEEP, TRIAL_RATING
from tallyboard.config import DEFAULT_RATING, SkewPolicy
from tallyboard.plans.rescore import COMPARED, what_if_rescore
from tallyboard.plans import sweep
from tallyboard.plans.sweep import sweep_scores, what_if_sweep
from tallyboard.session import SORTED


def _rows(df):
    """Rows with doubles to six decimals, as sums are added in another order."""
    cells = [F.round(c, 6) + 0.0 if kind == "double" else F.col(c) for c, kind in df.dtypes]
    return sorted(map(tuple, df.select(*cells).collect()))


@pytest.mark.parametrize("policy", [None, SPLIT], ids=["usual", "split"])
def test_a_sweep_is_its_trials_one_by_one(refreshed, policy):
    imported, once = refreshed
    setting = {} if policy is None else {"policy": policy}
    swept = what_if_sweep(imported, once, SWEEP, stored=True, **setting)
    alone = what_if_rescore(imported, once, TRIAL_RATING, stored=True)
    for table in COMPARED:
        trials = swept[table]
        assert _rows(trials.where("trial = 'trial'").select(alone[table].columns)) == _rows(alone[table])
        counts = {r.trial: r["count"] for r in trials.groupBy("trial").count().collect()}
        assert counts == dict.fromkeys(SWEEP, alone[table].count())
        unchanged = trials.where("trial = 'same'")
        for column in COMPARED[table]:
            assert unchanged.where(F.abs(f"{column}_delta") > 1e-6).count() == 0


def test_what_a_trial_does_not_reach_keeps_its_values(spark, refreshed):
    imported, once = refreshed
    none = imported | {"scores": imported["scores"].where("player_id = '18'")}
    tables = what_if_sweep(none, once, {"one": TRIAL_RATING}, only=["players", "leaderboards"])
    others = tables["players"].where("id <> '18'")
    assert others.count() == imported["players"].count() - 1
    assert others.where("new_pp <> 0 or new_rank <> 0").count() == 0
    assert tables["players"].where("id = '18' and new_rank = 1").count() == 1
    empty = imported | {"scores": imported["scores"].limit(0)}
    found = what_if_sweep(empty, once, {"one": TRIAL_RATING})
    assert found["scores"].count() == 0
    assert found["leaderboards"].where("new_total_pp <> 0").count() == 0
    assert found["players"].count() == imported["players"].count()
    with pytest.raises(ValueError):
        what_if_sweep(imported, once, {})


def test_configurations_share_their_shuffles(refreshed):
    imported, _ = refreshed
    configs = [replace(DEFAULT_RATING, decay=0.9 + k / 100) for k in range(5)]

    def exchanges(n):
        swept = sweep_scores(imported["scores"], imported["leaderboards"], configs[:n])
        plan = swept._jdf.queryExecution().executedPlan().toString()
        return plan.count("Exchange hashpartitioning"), plan.count("+- Window")

    assert exchanges(1)[0] == exchanges(5)[0] == 2
    assert exchanges(5)[1] > exchanges(1)[1]


def test_a_group_is_hot_at_fewer_rows_for_more_configurations(refreshed, monkeypatch):
    """A task sorts a group once per configuration."""
    imported, once = refreshed
    found, find = [], sweep.find_hot_groups
    monkeypatch.setattr(
        sweep,
        "find_hot_groups",
        lambda df, by, policy, rows: found.append((*by, policy.hot_rows)) or find(df, by, policy, rows),
    )
    asked, sized = [], sweep.sized_shuffles
    monkeypatch.setattr(
        sweep, "sized_shuffles", lambda spark, *sizes: asked.append(sizes) or sized(spark, *sizes)
    )
    tables = what_if_sweep(imported, once, SWEEP, SkewPolicy(hot_rows=4000), stored=True)
    assert asked == [(imported["scores"].count(), SORTED * len(SWEEP))]
    assert set(found) == {("leaderboard_id", 1000), ("player_id", 1000), (4000 // len(SWEEP) // SORTED,)}
    usual = what_if_sweep(imported, once, SWEEP, stored=True)
    for table in COMPARED:
        assert _rows(tables[table]) == _rows(usual[table])


def test_many_boards_are_not_broadcast(refreshed):
    """However small their files look."""
    imported, _ = refreshed
    configs = [DEFAULT_RATING, TRIAL_RATING]
    swept = sweep_scores(imported["scores"], imported["leaderboards"], configs, SkewPolicy(broadcast_rows=0))
    plan = swept._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and plan.count("ShuffledHashJoin") == 2


def test_points_are_computed_once_for_trials_that_differ_in_the_decay(refreshed):
    imported, once = refreshed
    assert sweep.alike(list(SWEEP.values())) == [0, 1, 0, 3]
    swept = sweep_scores(imported["scores"], imported["leaderboards"], list(SWEEP.values()))
    assert {c for c in swept.columns if c.startswith(("pp_", "rank_", "top_pp_"))} == {
        f"{c}_{k}" for c in ("pp", "rank", "top_pp") for k in (0, 1, 3)
    }
    assert {f"weight_{k}" for k in range(4)} < set(swept.columns)
    two = {"decay": SWEEP["decay"], "last": TRIAL_RATING, "first": DEFAULT_RATING}
    for policy in ({}, {"policy": SPLIT}):
        found = what_if_sweep(imported, once, two, stored=True, **policy)
        for name, config in two.items():
            alone = what_if_rescore(imported, once, config, stored=True)
            for table in COMPARED:
                rows = found[table].where(F.col("trial") == name).select(alone[table].columns)
                assert _rows(rows) == _rows(alone[table])


def test_boards_of_one_id_rate_each_configuration(refreshed):
    """Every configuration joins them, so none takes the points of another."""
    imported, once = refreshed
    boards = imported["leaderboards"]
    twice = boards.unionByName(boards.where("id = '7'").withColumn("acc_rating", F.lit(1.5)))
    scores = imported["scores"].where("leaderboard_id in ('7', '8')")
    swept = sweep_scores(scores, twice, list(SWEEP.values()))
    assert {f"pp_{k}" for k in range(4)} < set(swept.columns)
    usual = scores.where("leaderboard_id = '8'").count()
    assert swept.count() == usual + (scores.count() - usual) * 2 ** len(SWEEP)
    assert swept.where("leaderboard_id = '7' and pp_0 <> pp_2").count() > 0
    trials = what_if_sweep(imported | {"leaderboards": twice, "scores": scores}, once, SWEEP, stored=True)
    assert trials["scores"].count() == len(SWEEP) * swept.count()
    # boards without an id have no scores
    none = boards.unionByName(boards.limit(2).withColumn("id", F.lit(None).cast("string")))
    assert sweep.alike(list(SWEEP.values())) == sweep._shared(list(SWEEP.values()), none)
