"""A refresh of what changed gives what a full one gives."""

import pytest
from pyspark.sql import functions as F

from tallyboard.config import DEFAULT_SKEW, SkewPolicy
from tallyboard.plans import delta
from tallyboard.plans.delta import find_changes, merged, refresh_delta
from tallyboard.plans.refresh import refresh_all
from tallyboard.schema import SCORE_COMPUTED
from tallyboard.session import SORTED

ALL_SPLIT = SkewPolicy(hot_rows=100, chunk_rows=400, broadcast_rows=0)


def plain(df):
    """Rows as comparable tuples."""
    columns = [
        (F.round(c, 6) + 0.0).alias(c) if kind == "double" else F.col(c).cast("string")
        for c, kind in sorted(df.dtypes)
    ]
    return sorted(map(str, df.select(*columns).collect()))


@pytest.fixture(scope="module")
def imported(spark):
    from conftest import TESTDATA
    from tallyboard.session import materialise
    from tallyboard.sources import importer, retail

    tables = importer.import_dump(retail.dump(spark, str(TESTDATA / "sf0.001")))
    return {name: materialise(df, name) for name, df in tables.items()}


@pytest.fixture(scope="module")
def stored(imported):
    return refresh_all(imported, stored=True)


def check(stored, now, players=None, boards=None, policy=DEFAULT_SKEW):
    upserts, removed = find_changes(stored["scores"], now["scores"])
    delta = refresh_delta(stored, upserts, removed, players, boards, policy=policy)
    brought, full = merged(stored, delta), refresh_all(now, stored=True)
    for name in full:
        assert plain(brought[name]) == plain(full[name]), name
    return delta


def changed(scores):
    """Some scores gone, some new, some better, one moved to another player and board."""
    share = F.pmod(F.xxhash64("id"), F.lit(400))
    new = scores.where(share == 1).withColumn("id", F.col("id") + F.lit(2**45))
    better = F.when(share == 2, F.col("accuracy") + 0.001).otherwise(F.col("accuracy"))
    moved = F.when(share == 3, F.lit("7")).otherwise(F.col("player_id"))
    kept = scores.where(share != 0).withColumns({"accuracy": better, "player_id": moved})
    return kept.unionByName(new)


@pytest.mark.parametrize("policy", [DEFAULT_SKEW, ALL_SPLIT])
def test_scores_change(imported, stored, policy):
    delta = check(stored, imported | {"scores": changed(imported["scores"])}, policy=policy)
    assert 0 < delta.removed.count() < 100


def test_nothing_changes(imported, stored):
    delta = check(stored, imported)
    assert [df.count() for df in delta.changed.values()] == [0, 0, 0]
    assert delta.removed.count() == 0


def test_first_scores(spark, imported):
    none = imported | {"scores": imported["scores"].limit(0)}
    check(refresh_all(none, stored=True), imported)


def test_all_scores_go(imported, stored):
    check(stored, imported | {"scores": imported["scores"].limit(0)})


def test_boards_are_rated_anew_and_players_move(imported, stored):
    boards = imported["leaderboards"].withColumn(
        "pass_rating", F.when(F.col("id") == "3", F.lit(9.0)).otherwise(F.col("pass_rating"))
    )
    players = imported["players"].withColumn(
        "country", F.when(F.col("id").isin("5", "18"), F.lit("N99")).otherwise(F.col("country"))
    )
    now = imported | {"leaderboards": boards, "players": players}
    check(stored, now, players, boards)


def test_scores_without_player_or_board(spark, imported):
    scores = imported["scores"]
    stray = (
        scores.limit(40)
        .withColumn("id", F.col("id") + F.lit(2**46))
        .withColumn("player_id", F.concat(F.lit("nobody"), (F.col("id") % 3).cast("string")))
    )
    lost = scores.limit(5).withColumns({"id": F.col("id") + F.lit(2**47), "leaderboard_id": F.lit("none")})
    before = imported | {"scores": scores.unionByName(stray).unionByName(lost)}
    first = refresh_all(before)
    check(first, imported | {"scores": changed(before["scores"])})


def test_few_scores_reach_few_rows(imported, stored):
    one = stored["scores"].orderBy(F.desc("rank"), "id").limit(1)
    upsert = one.withColumn("accuracy", F.col("accuracy") - 0.0001).drop(*SCORE_COMPUTED)
    delta = refresh_delta(stored, upsert, one.select("id").limit(0))
    board, player = one.select("leaderboard_id", "player_id").first()
    rows = delta.changed["scores"].collect()
    assert rows and all(r.leaderboard_id == board or r.player_id == player for r in rows)


def test_untouched_scores_are_not_shuffled(stored, capsys):
    """The list of touched boards is broadcast to the scan of the scores."""
    from tallyboard.plans.delta import _Keys

    boards = _Keys(stored["leaderboards"].limit(3), "id", "few", DEFAULT_SKEW)
    boards.within(stored["scores"], "leaderboard_id").explain("formatted")
    plan = capsys.readouterr().out
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan


def test_changes_are_found_in_one_join(imported, stored, monkeypatch):
    """Stored and imported scores are read once for upserts and removed ones."""
    found, write = {}, delta.materialise
    monkeypatch.setattr(delta, "materialise", lambda df, label: found.setdefault(label, df) and write(df, label))
    now = changed(imported["scores"])
    upserts, removed = find_changes(stored["scores"], now)
    plan = found["found-changes"]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join FullOuter") == 1 and plan.count("Join") == 1
    for df in (upserts, removed):
        assert "Join" not in df._jdf.queryExecution().optimizedPlan().toString()
    none = now.limit(3).withColumn("id", F.lit(None).cast("bigint"))
    upserts, removed = find_changes(stored["scores"].unionByName(none, True), now.unionByName(none))
    assert upserts.where("id is null").count() == removed.where("id is null").count() == 3


def test_a_change_sorts_small_partitions(imported, stored, monkeypatch):
    """However few partitions the session's shuffles have, and group sizes need no rows."""
    asked, sized = [], delta.sized_shuffles
    monkeypatch.setattr(
        delta, "sized_shuffles", lambda spark, *sizes: asked.append(sizes) or sized(spark, *sizes)
    )
    seen, find = [], delta.find_hot_groups
    monkeypatch.setattr(delta, "find_hot_groups", lambda df, *a: seen.append(df.columns) or find(df, *a))
    rows = stored["scores"].count()
    upserts, removed = find_changes(stored["scores"], changed(imported["scores"]))
    number = upserts.count()
    refresh_delta(stored, upserts, removed)
    assert asked == [(rows, SORTED), (rows + number, SORTED)]
    assert seen == [["leaderboard_id", "player_id"]] * 2
