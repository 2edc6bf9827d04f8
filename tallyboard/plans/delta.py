"""Refresh after a change: only what the changed scores reach is computed again.

A change travels in a fixed order. Changed scores touch their boards, whose ranks are
taken anew. They touch their players, whose weights and totals are taken anew. What
changed of a player's weights, best score or play counts touches the boards of those
scores, whose statistics are taken anew; so does entering or leaving the best players.
Everything else comes from the stored tables, of which a full refresh would make the
same. Players are ranked all at once: one score may move every rank, and the table is
small beside the scores.

Lists of touched keys are stored and counted; up to ``SkewPolicy.broadcast_rows`` they
are broadcast, so untouched scores are dropped while they are read and are not shuffled.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyboard.config import DEFAULT_RATING, DEFAULT_SKEW, RatingConfig, SkewPolicy
from tallyboard.operators.boards import board_statistics
from tallyboard.operators.players import player_ranks, player_totals
from tallyboard.operators.ranking import find_hot_groups
from tallyboard.operators.scores import (
    HOLDER_COLUMNS,
    score_pp,
    score_ranks,
    score_weights_and_holders,
)
from tallyboard.operators.updates import apply_updates
from tallyboard.schema import BOARD_COMPUTED, PLAYER_COMPUTED, SCORE_COMPUTED
from tallyboard.session import SORTED, materialise, sized_shuffles

_RATINGS = ("acc_rating", "pass_rating", "tech_rating", "modifiers_rating")


@dataclass(frozen=True)
class Delta:
    """Whole rows that are new or changed, by table, and the ids of removed scores."""

    changed: dict[str, DataFrame]
    removed: DataFrame


class _Keys:
    """A stored list of distinct keys, broadcast where it is short."""

    def __init__(self, rows: DataFrame, column: str, label: str, policy: SkewPolicy):
        stored = materialise(rows.select(column).distinct(), label)
        self.column, self.number = column, stored.count()
        self.short = self.number <= policy.broadcast_rows
        self.stored = stored

    def _join(self, df: DataFrame, column: str, how: str) -> DataFrame:
        keys = self.stored.select(F.col(self.column).alias("_key"))
        keys = F.broadcast(keys) if self.short else keys
        return df.join(keys, F.col(column).eqNullSafe(F.col("_key")), how)

    def within(self, df: DataFrame, column: str | None = None) -> DataFrame:
        return self._join(df, column or self.column, "left_semi")

    def outside(self, df: DataFrame, column: str | None = None) -> DataFrame:
        return self._join(df, column or self.column, "left_anti") if self.number else df


def _imported(df: DataFrame, computed: Mapping[str, str]) -> list[str]:
    return [c for c in df.columns if c not in computed]


def _differ(old: DataFrame, new: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows of ``new`` that ``old`` lacks or has with other values."""
    known = old.select(
        F.col("id").alias("_id"), *[F.col(c).alias(f"_old_{c}") for c in columns if c != "id"]
    )
    same = [F.col(c).eqNullSafe(F.col(f"_old_{c}")) for c in columns if c != "id"]
    changed = F.col("_id").isNull() | ~reduce(lambda a, b: a & b, same)
    joined = new.join(known, F.col("id") == F.col("_id"), "left")
    return joined.where(changed).select(*new.columns)


def find_changes(stored: DataFrame, imported: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(upserts, removed ids) that lead from stored scores to imported ones, by id.

    For imports that come whole. Both sides are read once and joined by id; what differs is
    stored.
    """
    columns = _imported(imported, SCORE_COMPUTED)
    now = imported.select(*columns, F.lit(True).alias("_now"))
    known = stored.select(
        F.col("id").alias("_id"),
        F.lit(True).alias("_known"),
        *[F.col(c).alias(f"_old_{c}") for c in columns if c != "id"],
    )
    same = [F.col(c).eqNullSafe(F.col(f"_old_{c}")) for c in columns if c != "id"]
    same = reduce(lambda a, b: a & b, [F.col("_now") & F.col("_known"), *same])
    both = now.join(known, F.col("id") == F.col("_id"), "full")
    rows = both.where(~F.coalesce(same, F.lit(False))).select(*columns, "_now", "_id")
    with sized_shuffles(stored.sparkSession, stored.count(), SORTED):
        changed = materialise(rows, "found-changes")
    return (
        changed.where("_now").select(*columns),
        changed.where("_now is null").select(F.col("_id").alias("id")),
    )


def refresh_delta(
    stored: Mapping[str, DataFrame],
    upserts: DataFrame,
    removed: DataFrame,
    players: DataFrame | None = None,
    boards: DataFrame | None = None,
    config: RatingConfig = DEFAULT_RATING,
    policy: SkewPolicy = DEFAULT_SKEW,
) -> Delta:
    """What a full refresh would change in ``stored``, itself a refresh under ``config``.

    ``upserts`` are new scores or new versions of stored ones (imported columns, one row
    per id), ``removed`` has ids. ``players`` and ``boards`` are these tables as newly
    imported; without them, those in ``stored`` hold. Ratings of boards may have changed.
    """
    scores = stored["scores"]
    upserts = materialise(upserts.select(*_imported(scores, SCORE_COMPUTED)), "upserts")
    boards = stored["leaderboards"] if boards is None else boards
    players = stored["players"] if players is None else players
    rows = scores.count() + upserts.count()
    with sized_shuffles(scores.sparkSession, rows, SORTED):
        return _refreshed(stored, upserts, removed, players, boards, config, policy, rows)


def _refreshed(stored, upserts, removed, players, boards, config, policy, rows) -> Delta:
    scores = stored["scores"]
    # sizes of the groups, whatever part of them is touched: two columns read instead of the rows
    keys = [df.select("leaderboard_id", "player_id") for df in (scores, upserts)]
    keys = keys[0].unionByName(keys[1])
    hot = {key: find_hot_groups(keys, [key], policy, rows) for key in keys.columns}
    scored = _Change(scores, upserts, removed, stored["leaderboards"], boards, config, policy, hot)
    weighted = scored.weighted(config, policy)
    refreshed = _refreshed_players(stored["players"], players, scored, weighted, config, policy)
    statistics = _refreshed_boards(stored, refreshed, boards, scored, weighted, config, policy)
    changed = {
        "scores": _changed_scores(scores, scored, weighted),
        "players": _differ(stored["players"], refreshed, stored["players"].columns),
        "leaderboards": _differ(stored["leaderboards"], statistics, stored["leaderboards"].columns),
    }
    changed = {name: materialise(df, f"changed-{name}") for name, df in changed.items()}
    gone = scored.replaced.within(scores.select("id"), "id").join(upserts.select("id"), "id", "left_anti")
    return Delta(changed, materialise(gone, "removed-scores"))


class _Change:
    """Changed scores, the boards and players they touch, and the new ranks there."""

    def __init__(self, scores, upserts, removed, old_boards, boards, config, policy, hot):
        self.scores, self.hot = scores, hot
        ids = upserts.select("id").unionByName(removed.select("id"))
        self.replaced = _Keys(ids, "id", "replaced-scores", policy)
        before = materialise(
            self.replaced.within(scores.select("id", "leaderboard_id", "player_id")), "scores-before"
        )
        ends = before.unionByName(upserts.select("id", "leaderboard_id", "player_id"))
        rerated = _Keys(
            _differ(old_boards, boards.select("id", *_RATINGS), _RATINGS), "id", "rerated-boards", policy
        )
        touched = ends.select("leaderboard_id").unionByName(
            rerated.stored.select(F.col("id").alias("leaderboard_id"))
        )
        self.boards = _Keys(touched, "leaderboard_id", "touched-boards", policy)

        few = boards.count() <= policy.broadcast_rows
        on_boards = self.replaced.outside(self.boards.within(scores))
        kept = rerated.outside(on_boards, "leaderboard_id")
        again = upserts
        if rerated.number:
            again = rerated.within(on_boards, "leaderboard_id").unionByName(upserts, True)
        # new versions have neither a stored weight nor a stored rank
        rows = kept.withColumn("_rescored", F.lit(False)).unionByName(
            score_pp(again.drop("rank", "weight"), boards, config, few).withColumn("_rescored", F.lit(True)),
            allowMissingColumns=True,
        )
        rows = rows.withColumn("_old_rank", F.col("rank"))
        #: all scores of touched boards, with points and ranks
        ranked = score_ranks(rows, config, hot["leaderboard_id"], policy)
        self.ranked = materialise(ranked, "touched-ranks")
        players = ends.select("player_id")
        if rerated.number:
            players = players.unionByName(self.ranked.where("_rescored").select("player_id"))
        self.players = _Keys(players, "player_id", "touched-players", policy)

    def elsewhere(self, columns: Sequence[str]) -> DataFrame:
        """Unchanged scores of boards that are not touched."""
        return self.boards.outside(self.replaced.outside(self.scores)).select(*columns)

    def weighted(self, config: RatingConfig, policy: SkewPolicy) -> DataFrame:
        """All scores of touched players, with new weights beside the stored ones."""
        elsewhere = self.elsewhere(self.scores.columns).withColumns(
            {"_rescored": F.lit(False), "_old_rank": F.col("rank")}
        )
        rows = self.players.within(elsewhere).unionByName(self.players.within(self.ranked))
        rows = rows.withColumn("_old_weight", F.col("weight"))
        weighted = score_weights_and_holders(rows, config, self.hot["player_id"], policy)
        return materialise(weighted, "touched-weights")


def _fresh(df: DataFrame, computed: Mapping[str, str], columns: Sequence[str]) -> DataFrame:
    """Rows as an import leaves them."""
    zeros = {c: F.lit(0).cast(kind) for c, kind in computed.items()}
    return df.select(*[zeros[c].alias(c) if c in zeros else F.col(c) for c in columns])


def _refreshed_players(stored, players, scored: _Change, weighted, config, policy) -> DataFrame:
    """All players with new totals and ranks."""
    totals = player_totals(weighted)
    others = scored.players.outside(stored.where("ranked_play_count > 0"), "id")
    others = others.select(F.col("id").alias("player_id"), *[c for c in totals.columns if c != "player_id"])
    everyone = materialise(others.unionByName(totals), "player-totals")
    ranked = player_ranks(everyone, players, config, policy).withColumnRenamed("player_id", "id")
    fresh = _fresh(players, PLAYER_COMPUTED, stored.columns)
    return materialise(apply_updates(fresh, ranked, list(PLAYER_COMPUTED)), "players")


def _counts_as(plays: Column, config: RatingConfig) -> list[Column]:
    """What the statistics ask of a play count."""
    limits = [*config.play_thresholds, config.top_min_plays]
    return [plays > limit for limit in limits] + [plays >= config.ratio_min_plays]


def _refreshed_boards(stored, players, boards, scored: _Change, weighted, config, policy) -> DataFrame:
    """Boards whose statistics are reached, and newly imported ones, refreshed; the
    others as they are stored."""
    top = F.col("rank").between(1, config.top_rank - 1)
    before = stored["players"].select(
        F.col("id").alias("_holder"), top.alias("_was_top"),
        F.col("top_pp").alias("_old_top_pp"), F.col("ranked_play_count").alias("_old_plays"),
    )
    moved = players.select("id", top.alias("_is_top")).join(before, F.col("id") == F.col("_holder"), "left")
    moved = moved.where(F.col("_is_top") != F.coalesce("_was_top", F.lit(False)))
    moved = _Keys(moved, "id", "moved-players", policy)

    now = [F.col("top_pp"), *_counts_as(F.col("ranked_play_count"), config)]
    was = [F.col("_old_top_pp"), *_counts_as(F.col("_old_plays"), config)]
    same = reduce(lambda a, b: a & b, [a.eqNullSafe(b) for a, b in zip(now, was)])
    own = weighted.join(before, F.col("player_id") == F.col("_holder"), "left")
    reached = own.where(~(same & F.col("weight").eqNullSafe(F.col("_old_weight"))))
    narrow = ["id", "leaderboard_id", "player_id", "pp", "weight"]
    reached = (
        reached.select("leaderboard_id")
        .unionByName(moved.within(scored.elsewhere(narrow), "player_id").select("leaderboard_id"))
        .unionByName(scored.boards.stored)
    )
    reached = _Keys(reached, "leaderboard_id", "reached-boards", policy)

    others = scored.players.outside(
        reached.within(scored.elsewhere(narrow)).unionByName(scored.ranked.select(*narrow))
    )
    held = _with_holders(others, stored, scored, policy).unionByName(
        reached.within(weighted.select(*narrow, *HOLDER_COLUMNS))
    )
    best = F.broadcast(players.where(top).select(F.col("id").alias("player_id"), F.lit(True).alias("top_player")))
    held = held.join(best, "player_id", "left").withColumn("top_player", F.coalesce("top_player", F.lit(False)))
    held = materialise(held.drop("player_id"), "reached-scores")
    stats = board_statistics(held, config, scored.hot["leaderboard_id"], policy).withColumnRenamed("leaderboard_id", "id")

    columns = stored["leaderboards"].columns
    fresh = apply_updates(
        _fresh(reached.within(boards, "id"), BOARD_COMPUTED, columns), stats, list(BOARD_COMPUTED)
    )
    # imported columns are the newest, statistics the stored ones
    rest = _fresh(reached.outside(boards, "id"), BOARD_COMPUTED, columns)
    rest = apply_updates(rest, stored["leaderboards"], list(BOARD_COMPUTED))
    return fresh.unionByName(rest)


def _with_holders(scores: DataFrame, stored, scored: _Change, policy: SkewPolicy) -> DataFrame:
    """Scores of untouched players with their best points and play count.

    These are stored with the player. A score without a known player counts as well, with
    what the scores themselves say of its holder.
    """
    holders = stored["players"].select(F.col("id").alias("player_id"), *HOLDER_COLUMNS)
    known = scores.join(holders, "player_id", "left")
    strays = _Keys(known.where("ranked_play_count is null"), "player_id", "unknown-players", policy)
    if not strays.number:
        return known
    own = strays.within(
        scored.elsewhere(["player_id", "pp"]).unionByName(scored.ranked.select("player_id", "pp"))
    )
    found = own.groupBy("player_id").agg(
        F.max("pp").alias("top_pp"), F.count("*").alias("ranked_play_count")
    )
    unknown = strays.within(scores).join(found, "player_id")
    return known.where("ranked_play_count is not null").unionByName(unknown)


def _changed_scores(scores: DataFrame, scored: _Change, weighted: DataFrame) -> DataFrame:
    """Rows of touched boards and players that are new or have another value."""
    rank = F.col("_rescored") | ~F.col("rank").eqNullSafe(F.col("_old_rank"))
    weight = ~F.col("weight").eqNullSafe(F.col("_old_weight"))
    return scored.players.outside(scored.ranked).where(rank).select(*scores.columns).unionByName(
        weighted.where(rank | weight).select(*scores.columns)
    )


def merged(stored: Mapping[str, DataFrame], delta: Delta) -> dict[str, DataFrame]:
    """The stored tables with the changes applied."""
    tables = {}
    for name, changed in delta.changed.items():
        gone = changed.select("id")
        if name == "scores":
            gone = gone.unionByName(delta.removed)
        tables[name] = stored[name].join(gone, "id", "left_anti").unionByName(changed)
    return tables
