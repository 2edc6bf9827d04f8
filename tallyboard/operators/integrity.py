"""Constraints a Parquet table does not enforce by itself, as reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyboard.schema import COMPUTED, LIMITS, RATING_FIELDS, STORED_FAMILIES


def _rules(table: str, present: Sequence[str]) -> list[tuple[str, str, Column]]:
    rules = []
    for column, limit in LIMITS[table].items():
        rules.append((column, "not null", F.col(column).isNull()))
        if limit is not None:
            rules.append((column, f"max length {limit}", F.length(column) > limit))
    rules += [(c, "not null", F.col(c).isNull()) for c in COMPUTED[table] if c in present]
    if "modifiers_rating" in present:
        # a board may lack all families, but not a value of one
        rated = F.col("modifiers_rating").isNotNull()
        for code in STORED_FAMILIES:
            for field in RATING_FIELDS:
                name = f"modifiers_rating.{code}.{field}"
                rules.append((name, "not null", rated & F.col(name).isNull()))
    return rules


def violation_counts(table: str, present: Sequence[str]) -> dict[str, Column]:
    """Every rule of a table as an aggregate, to be observed while the table is written."""
    rules = _rules(table, present)
    return {f"{c}: {rule}": F.count_if(broken) for c, rule, broken in rules}


def violation_report(
    spark: SparkSession, counted: Mapping[str, Mapping[str, int]]
) -> DataFrame:
    """``schema_violations`` of tables whose ``violation_counts`` are known."""
    found = [
        (table, *name.split(": ", 1), n)
        for table, counts in counted.items()
        for name, n in counts.items()
        if n
    ]
    return spark.createDataFrame(found, "table_name string, column_name string, rule string, n long")


def schema_violations(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(table_name, column_name, rule, n) for every broken rule.

    All rules of a table are counted in one pass over it. Columns that a refresh
    fills, and modifier ratings, are checked where the table has them.
    """
    reports = []
    for table, df in tables.items():
        rules = _rules(table, df.columns)
        counts = df.agg(*[F.count_if(broken).alias(f"r{i}") for i, (_, _, broken) in enumerate(rules)])
        rows = F.array(
            *[
                F.struct(
                    F.lit(table).alias("table_name"),
                    F.lit(column).alias("column_name"),
                    F.lit(rule).alias("rule"),
                    F.col(f"r{i}").alias("n"),
                )
                for i, (column, rule, _) in enumerate(rules)
            ]
        )
        reports.append(counts.select(F.inline(rows)).where("n > 0"))
    return reduce(DataFrame.unionByName, reports)


def orphan_scores(scores: DataFrame, players: DataFrame, boards: DataFrame) -> DataFrame:
    """(id, missing) for scores whose player or leaderboard does not exist.

    One pass: a score that lacks both gives two rows.
    """

    def known(parents: DataFrame, key: str, flag: str) -> DataFrame:
        return parents.select(F.col("id").alias(key)).distinct().withColumn(flag, F.lit(True))

    marked = (
        scores.select("id", "player_id", "leaderboard_id")
        .join(known(players, "player_id", "has_player"), "player_id", "left")
        .join(known(boards, "leaderboard_id", "has_board"), "leaderboard_id", "left")
    )
    missing = F.array_compact(
        F.array(
            F.when(F.col("has_player").isNull(), F.lit("player")),
            F.when(F.col("has_board").isNull(), F.lit("leaderboard")),
        )
    )
    return marked.select("id", F.explode(missing).alias("missing"))


def cascade_delete(
    scores: DataFrame,
    players: DataFrame | None = None,
    boards: DataFrame | None = None,
) -> DataFrame:
    """The scores left after deleting the given players and leaderboards."""
    if players is not None:
        gone = players.select(F.col("id").alias("player_id"))
        scores = scores.join(gone, "player_id", "left_anti")
    if boards is not None:
        gone = boards.select(F.col("id").alias("leaderboard_id"))
        scores = scores.join(gone, "leaderboard_id", "left_anti")
    return scores


def duplicate_keys(df: DataFrame, key: Sequence[str] = ("id",)) -> DataFrame:
    """Keys that occur more than once, with their number of rows."""
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")
