"""The full recomputation: scores, then players, then leaderboards."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyboard.config import DEFAULT_RATING, DEFAULT_SKEW, RatingConfig, SkewPolicy
from tallyboard.operators.boards import board_statistics, flag_top_players
from tallyboard.operators.integrity import violation_counts
from tallyboard.operators.players import player_ranks, player_totals
from tallyboard.operators.ranking import HotGroups, find_hot_groups
from tallyboard.operators.scores import (
    HOLDER_COLUMNS,
    POINT_COLUMNS,
    score_pp,
    score_ranks,
    score_weights_and_holders,
)
from tallyboard.operators.updates import apply_updates
from tallyboard.schema import BOARD_COMPUTED, PLAYER_COMPUTED, SCORE_COMPUTED
from tallyboard.session import SORTED, materialise, measure, own_stages, sized_shuffles
from tallyboard.sources.snapshots import publish_snapshot


def refresh_scores(
    scores: DataFrame,
    boards: DataFrame,
    config: RatingConfig = DEFAULT_RATING,
    policy: SkewPolicy = DEFAULT_SKEW,
    rows: int | None = None,
    hot_boards: HotGroups | None = None,
) -> DataFrame:
    """Scores with points, rank in their board and weight.

    One shuffle by board and one by player. Group sizes are taken from the stored
    table, before the join, where they cost a scan of one column. The player's
    best points and play count come along, for the board statistics. ``rows`` is
    the number of scores and ``hot_boards`` the large boards where they are known.
    """
    rows = scores.count() if rows is None else rows
    if hot_boards is None:
        hot_boards = find_hot_groups(scores, ["leaderboard_id"], policy, rows)
    hot_players = find_hot_groups(scores, ["player_id"], policy, rows)
    few_boards = boards.count() <= policy.broadcast_rows
    narrow = scores.drop(*POINT_COLUMNS, "rank", "weight")
    if not hot_boards.groups:
        # before there are points, which hardly compress, to move and to write
        narrow = narrow.repartition("leaderboard_id")
    scored = score_pp(narrow, boards, config, few_boards)
    ranked = score_ranks(scored, config, hot_boards, policy)
    if hot_players.groups:
        # usual and hot players are placed separately: do not rank twice for that
        ranked = materialise(ranked, "ranked-scores")
    weighted = score_weights_and_holders(ranked, config, hot_players, policy)
    imported = [c for c in scores.columns if c not in SCORE_COMPUTED]
    return weighted.select(*imported, *SCORE_COMPUTED, *HOLDER_COLUMNS)


def refresh_players(
    players: DataFrame,
    scores: DataFrame,
    config: RatingConfig = DEFAULT_RATING,
    policy: SkewPolicy = DEFAULT_SKEW,
) -> DataFrame:
    """Players with totals and ranks; those without scores keep what they have."""
    ranked = player_ranks(player_totals(scores), players, config, policy)
    return apply_updates(
        players, ranked.withColumnRenamed("player_id", "id"), list(PLAYER_COMPUTED)
    )


def refresh_boards(
    boards: DataFrame,
    scores: DataFrame,
    players: DataFrame,
    config: RatingConfig = DEFAULT_RATING,
    policy: SkewPolicy = DEFAULT_SKEW,
    rows: int | None = None,
    literal: bool = False,
    hot: HotGroups | None = None,
) -> DataFrame:
    """Leaderboards with statistics; those without scores keep what they have.

    ``scores`` are those of ``refresh_scores``, and ``hot`` the large boards where they are
    known. What is shuffled are seven narrow columns of them, once, by board. ``literal`` as
    in ``board_stats``.
    """
    if hot is None:
        rows = scores.count() if rows is None else rows
        hot = find_hot_groups(scores, ["leaderboard_id"], policy, rows)
    held = flag_top_players(scores, players, config, policy)
    stats = board_statistics(held, config, hot, policy, literal)
    return apply_updates(
        boards, stats.withColumnRenamed("leaderboard_id", "id"), list(BOARD_COMPUTED)
    )


def refresh_all(
    tables: Mapping[str, DataFrame],
    config: RatingConfig = DEFAULT_RATING,
    policy: SkewPolicy = DEFAULT_SKEW,
    only: Sequence[str] = ("scores", "players", "leaderboards"),
    literal: bool = False,
    stored: bool = False,
    violations: dict[str, dict[str, int]] | None = None,
) -> dict[str, DataFrame]:
    """Recompute all three tables, or those named by ``only``.

    Each stage is written to the scratch folder: later ones read several times what
    it computed, and none has to start over when an executor is lost. Imported scores
    are written first, so that whatever computes them runs once; ``stored`` says that
    they are a stored table, which is read as it is. The number of shuffle partitions
    follows the number of scores. ``violations`` is filled with the broken limits of the
    tables (``integrity.violation_report``), which are counted as they are written.
    """

    def stage(table: str, df: DataFrame) -> DataFrame:
        if violations is None:
            return materialise(df, table)
        written, violations[table] = measure(df, table, violation_counts(table, df.columns))
        return written

    boards, imported = tables["leaderboards"], tables["scores"]
    if stored:
        rows = imported.count()
    else:
        imported, seen = measure(imported, "imported-scores", {"rows": F.count("*")})
        rows = seen["rows"]
    with sized_shuffles(imported.sparkSession, rows, SORTED):
        hot_boards = find_hot_groups(imported, ["leaderboard_id"], policy, rows)
        refreshed = refresh_scores(imported, boards, config, policy, rows, hot_boards)
        scores = stage("scores", refreshed)
        found = {"scores": scores.drop(*HOLDER_COLUMNS)}
        if "players" in only or "leaderboards" in only:
            players = refresh_players(tables["players"], scores, config, policy)
            found["players"] = stage("players", players)
        if "leaderboards" in only:
            refreshed = refresh_boards(
                boards, scores, found["players"], config, policy, rows, literal, hot_boards
            )
            found["leaderboards"] = stage("leaderboards", refreshed)
    return {table: found[table] for table in only}


def refresh_and_publish(
    tables: Mapping[str, DataFrame],
    root: str,
    config: RatingConfig = DEFAULT_RATING,
    policy: SkewPolicy = DEFAULT_SKEW,
    base: str | None = None,
    stored: bool = False,
) -> str:
    """Refresh all tables, publish them and leave nothing in the scratch folder.

    ``base`` as in ``publish_snapshot``, ``stored`` as in ``refresh_all``.
    """
    with own_stages(tables["scores"].sparkSession):
        refreshed = refresh_all(tables, config, policy, stored=stored)
        return publish_snapshot(refreshed, root, base=base)


def refresh_summary(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Row counts and sums of the computed columns, one row per table and column."""
    computed = {
        "scores": SCORE_COMPUTED,
        "players": PLAYER_COMPUTED,
        "leaderboards": BOARD_COMPUTED,
    }
    report = None
    for table, columns in computed.items():
        df = tables[table]
        sums = df.agg(
            F.count("*").alias("rows"), *[F.sum(c).cast("double").alias(c) for c in columns]
        )
        cells = F.array(
            *[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("total")) for c in columns]
        )
        part = sums.select(F.lit(table).alias("table_name"), "rows", F.inline(cells))
        report = part if report is None else report.unionByName(part)
    return report
