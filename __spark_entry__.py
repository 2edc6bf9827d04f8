"""Registry of queries over the test tables, and the SQL each must agree with.

``tallyboard`` holds the operators; this file only feeds them. Operator queries
start from the imported tables. Read queries, as in a deployed system, start from
a refreshed and published snapshot, which is made once per session and folder.
"""

from __future__ import annotations

import sys
from collections.abc import Callable
from dataclasses import replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

from oracle.sql import oracle_queries
from tallyboard.config import (
    CURVE_A,
    DEFAULT_MULTIPLIERS,
    DEFAULT_RATING,
    DEFAULT_SKEW,
    RANKED_MULTIPLIERS,
    SkewPolicy,
)
from tallyboard.functions import curves, modifiers, numbers, points, rating
from tallyboard.operators import boards as board_ops
from tallyboard.operators import integrity, podium, updates
from tallyboard.operators import players as player_ops
from tallyboard.operators import scores as score_ops
from tallyboard.operators.ranking import HotGroups, find_hot_groups
from tallyboard.plans import colocated, delta, fences, pages, refresh, rescore, search, series, sweep
from tallyboard.schema import DUMP_FAMILIES, RATING_FIELDS, STORED_FAMILIES
from tallyboard.session import materialise, measure, new_path
from tallyboard.sources import cut, dump, files, importer, retail, snapshots

Tables = dict[str, DataFrame]

# the other constants of the what-if queries
TRIAL_RATING = replace(
    DEFAULT_RATING,
    score_curve=CURVE_A,
    decay=0.95,
    multipliers=tuple(DEFAULT_MULTIPLIERS.items()),
)
# the configurations of the sweep
SWEEP = {
    "same": DEFAULT_RATING,
    "trial": TRIAL_RATING,
    "decay": replace(DEFAULT_RATING, decay=0.9),
    "curve": replace(DEFAULT_RATING, score_curve=CURVE_A),
}
# limits so low that most groups of the test tables are split, and nothing is broadcast
SPLIT = SkewPolicy(hot_rows=200, chunk_rows=1000, broadcast_rows=0)
AS_OF = 915_148_800  # 1999-01-01 UTC

_imports: dict[tuple[str, str], DataFrame] = {}
_published: dict[tuple[str, str, str], str] = {}
_deltas: dict[tuple[str, str], delta.Delta] = {}
_layouts: dict[tuple[str, str, SkewPolicy], str] = {}
_marks: dict[tuple[str, str, str], DataFrame] = {}


def _imported(spark: SparkSession, folder: str) -> Tables:
    return importer.import_dump(retail.dump(spark, folder))


def _imported_once(spark: SparkSession, folder: str) -> Tables:
    """The same with stored scores, for queries that start from them more than once."""
    tables, key = _imported(spark, folder), (spark.sparkContext.applicationId, folder)
    if key not in _imports:
        _imports[key] = materialise(tables["scores"], "imported-once")
    return tables | {"scores": _imports[key]}


def _snapshot(spark: SparkSession, folder: str, name: str, config, earlier=None) -> Tables:
    key = (spark.sparkContext.applicationId, folder, name)
    if key not in _published:
        root, imported = new_path(spark, f"database-{name}"), _imported_once(spark, folder)
        if earlier:
            imported = earlier(imported)
        refresh.refresh_and_publish(imported, root, config, stored=not earlier)
        _published[key] = root
    return snapshots.read_latest(spark, _published[key])


def _imported_earlier(tables: Tables) -> Tables:
    """The import before some scores came, some got better and some were taken back, and
    before some boards were rated anew."""
    scores, boards = tables["scores"], tables["leaderboards"]
    share = F.pmod(F.xxhash64("id"), F.lit(300))
    better = F.when(share == 1, F.col("accuracy") - 0.02).otherwise(F.col("accuracy"))
    taken_back = scores.where(share == 2).withColumn("id", F.col("id") + F.lit(2**50))
    earlier = scores.where(share != 0).withColumn("accuracy", better).unionByName(taken_back)
    rated = F.when(F.length("id") == 1, F.col("acc_rating") + 1).otherwise(F.col("acc_rating"))
    return tables | {"scores": earlier, "leaderboards": boards.withColumn("acc_rating", rated)}


def _current(spark: SparkSession, folder: str) -> Tables:
    return _snapshot(spark, folder, "current", DEFAULT_RATING)


def _trial(spark: SparkSession, folder: str) -> Tables:
    return _snapshot(spark, folder, "trial", TRIAL_RATING)


def _rounded(df: DataFrame, decimals: int = 4) -> DataFrame:
    """Doubles rounded for comparison; adding 0 turns -0 into 0."""
    return df.select(
        *[
            (numbers.half_up(F.col(c), decimals) + 0.0).alias(c) if kind == "double" else F.col(c)
            for c, kind in df.dtypes
        ]
    )


# ---- import and maintenance --------------------------------------------------


def _ingested(spark, folder, read_dump) -> DataFrame:
    path = new_path(spark, "dump")
    dump.write_dump(retail.dump(spark, folder), path)
    read = read_dump(spark, path)
    ratings = _rating_columns(DUMP_FAMILIES)
    read["maps"] = read["maps"].select("*", *ratings).drop("modifiers_rating")
    return _rounded(_stacked(read))


def ingest_dump(spark, folder):
    return _ingested(spark, folder, dump.read_dump)


def ingest_dump_cut(spark, folder):
    return _ingested(spark, folder, cut.read_dump_cut)


def _rating_columns(codes) -> list:
    return [
        F.col(f"modifiers_rating.{code}.{field}").alias(f"{code.lower()}_{field}")
        for code in codes
        for field in RATING_FIELDS
    ]


def _stacked(tables: Tables) -> DataFrame:
    """The rows of all tables under each other, with the columns of all."""
    stacked = None
    for name, df in tables.items():
        named = df.withColumn("id", F.col("id").cast("string"))
        named = named.withColumn("table_name", F.lit(name))
        stacked = (
            named if stacked is None else stacked.unionByName(named, allowMissingColumns=True)
        )
    return stacked


def import_leaderboards(spark, folder):
    boards = importer.import_leaderboards(retail.maps(spark, folder))
    return _rounded(boards.drop("modifiers_rating"))


def import_players(spark, folder):
    return importer.import_players(retail.players(spark, folder))


def import_scores(spark, folder):
    return _rounded(importer.import_scores(retail.scores(spark, folder)))


def import_modifier_ratings(spark, folder):
    boards = importer.import_leaderboards(retail.maps(spark, folder))
    columns = _rating_columns(STORED_FAMILIES)
    return _rounded(boards.select(F.col("id").alias("leaderboard_id"), *columns))


def modifier_ratings_long(spark, folder):
    boards = importer.import_leaderboards(retail.maps(spark, folder))
    return _rounded(importer.modifier_ratings_long(boards))


UPDATED = ["pp", "top_pp", "ranked_play_count"]


def _player_updates(tables: Tables) -> DataFrame:
    weighted = score_ops.score_weights(
        score_ops.score_pp(tables["scores"], tables["leaderboards"])
    )
    return player_ops.player_totals(weighted).withColumnRenamed("player_id", "id")


def apply_updates(spark, folder):
    tables = _imported(spark, folder)
    updated = updates.apply_updates(tables["players"], _player_updates(tables), UPDATED)
    return _rounded(updated)


def apply_updates_pruned(spark, folder):
    """The same in two steps on stored files; the second touches those of a range of ids."""
    tables = _imported(spark, folder)
    players, totals = tables["players"], materialise(_player_updates(tables), "totals")
    root = new_path(spark, "player-files")
    number = files.create(players, root, files=16)
    late = F.col("id").startswith("12")
    for part in (totals.where(~late), totals.where(late)):
        number = files.update(spark, root, number, players.schema, part, UPDATED)
    return _rounded(files.read(spark, root, number, players.schema))


def changed_weights(spark, folder):
    stored, fresh = _trial(spark, folder)["scores"], _current(spark, folder)["scores"]
    return _rounded(updates.changed_weights(stored, fresh))


def publish_snapshot(spark, folder):
    root = new_path(spark, "published")
    imported = _imported(spark, folder)
    snapshots.publish_snapshot(imported, root, "20240101000000-first")
    boards = imported["leaderboards"].where("acc_rating > 0")
    snapshots.publish_snapshot(imported | {"leaderboards": boards}, root, "20240102000000-second")
    latest = snapshots.read_latest(spark, root)
    columns = {
        "players": ["id", "name", "country"],
        "scores": ["id", "leaderboard_id", "player_id", "accuracy"],
        "leaderboards": ["id", "name", "stars"],
    }
    return _rounded(_stacked({name: latest[name].select(*columns[name]) for name in columns}))


def append_table(spark, folder):
    path = new_path(spark, "appended")
    scores = retail.scores(spark, folder)
    snapshots.append_table(scores.where("fc"), path)
    snapshots.append_table(scores.where("not fc"), path)
    return _rounded(spark.read.schema(scores.schema).parquet(path))


def schema_violations(spark, folder):
    return integrity.schema_violations(_imported(spark, folder))


def schema_violations_observed(spark, folder):
    """The same, counted while the tables are written."""
    counted = {}
    for table, df in _imported(spark, folder).items():
        rules = integrity.violation_counts(table, df.columns)
        counted[table] = measure(df, f"checked-{table}", rules)[1]
    return integrity.violation_report(spark, counted)


def _rated_and_located(tables: Tables) -> tuple[DataFrame, DataFrame]:
    return (
        tables["players"].where("country is not null"),
        tables["leaderboards"].where("acc_rating > 0"),
    )


def orphan_scores(spark, folder):
    tables = _imported(spark, folder)
    return integrity.orphan_scores(tables["scores"], *_rated_and_located(tables))


def cascade_delete(spark, folder):
    tables = _imported(spark, folder)
    kept = integrity.cascade_delete(
        tables["scores"],
        players=tables["players"].where("country is null"),
        boards=tables["leaderboards"].where("acc_rating = 0"),
    )
    return kept.select("id", "player_id", "leaderboard_id")


def duplicate_keys(spark, folder):
    return integrity.duplicate_keys(retail.lines(spark, folder))


def page_counts(spark, folder):
    tables = _current(spark, folder)
    found = pages.search_contains(tables["leaderboards"], "RING")
    scores, per_board, per_player = tables["scores"], ["leaderboard_id"], ["player_id"]
    listings = [
        ("ranking", pages.page_count(tables["players"], pages.RANKING_PAGE), None),
        ("boards", pages.page_count(tables["leaderboards"], pages.BOARDS_PAGE), None),
        ("stats", pages.page_count(found, pages.STATS_PAGE), None),
        ("leaderboard", pages.page_count(scores, pages.SCORES_PAGE, per_board), per_board[0]),
        ("player", pages.page_count(scores, pages.SCORES_PAGE, per_player), per_player[0]),
    ]
    report = None
    for listing, counted, key in listings:
        key = F.col(key) if key else F.lit(None).cast("string")
        part = counted.select(F.lit(listing).alias("listing"), key.alias("key"), "total", "pages")
        report = part if report is None else report.unionByName(part)
    return report


# ---- scores ------------------------------------------------------------------


def _scored(spark, folder) -> DataFrame:
    tables = _imported(spark, folder)
    return score_ops.score_pp(tables["scores"], tables["leaderboards"])


def _scored_once(spark, folder, key, policy) -> tuple[DataFrame, HotGroups]:
    """Scores with points, and the hot groups of a key.

    They are read for the sizes, before the join, and once for hot and once for other groups,
    so the import is stored.
    """
    tables = _imported(spark, folder)
    scores = materialise(tables["scores"], "imported-scores")
    hot = find_hot_groups(scores, [key], policy)
    return score_ops.score_pp(scores, tables["leaderboards"]), hot


def _ranked(spark, folder, policy=DEFAULT_SKEW) -> DataFrame:
    """Ids and boards of the scores with ranks; no other column moves to the ranges."""
    scored, hot = _scored_once(spark, folder, "leaderboard_id", policy)
    scored = scored.select("id", "leaderboard_id", "accuracy", "pp")
    return score_ops.score_ranks(scored, hot=hot, policy=policy)


def _weighted(spark, folder, policy=DEFAULT_SKEW, columns=("*",)) -> DataFrame:
    """Scores with weights, likewise; of the other columns those named."""
    scored, hot = _scored_once(spark, folder, "player_id", policy)
    return score_ops.score_weights(scored.select(*columns), hot=hot, policy=policy)


def score_pp(spark, folder):
    return _rounded(_scored(spark, folder).select("id", *score_ops.POINT_COLUMNS))


def score_ranks(spark, folder):
    return _ranked(spark, folder).select("id", "leaderboard_id", "rank")


def score_weights(spark, folder):
    return _rounded(_weighted(spark, folder).select("id", "player_id", "weight"), 6)


def modifier_usage(spark, folder):
    return _rounded(score_ops.modifier_usage(_scored(spark, folder)))


def modifier_table_diff(spark, folder):
    scores = retail.scores(spark, folder)
    return score_ops.modifier_table_diff(scores, DEFAULT_MULTIPLIERS, RANKED_MULTIPLIERS)


def modifier_multipliers(spark, folder):
    text = F.col("modifiers")
    return _rounded(
        retail.scores(spark, folder).select(
            "id",
            modifiers.total_multiplier(text, RANKED_MULTIPLIERS).alias("total"),
            modifiers.total_multiplier(text, RANKED_MULTIPLIERS, False).alias("total_no_speed"),
            modifiers.positive_multiplier(text, RANKED_MULTIPLIERS).alias("positive"),
            modifiers.negative_multiplier(text, RANKED_MULTIPLIERS).alias("negative"),
            modifiers.negative_multiplier(text, RANKED_MULTIPLIERS, True).alias("negative_no_nf"),
            modifiers.negative_codes(text, RANKED_MULTIPLIERS).alias("negative_codes"),
        )
    )


def curve_values(spark, folder):
    accuracy = F.col("accuracy")
    return _rounded(
        retail.scores(spark, folder).select(
            "id",
            curves.curve_a(accuracy).alias("curve_a"),
            curves.curve_b(accuracy).alias("curve_b"),
        ),
        8,
    )


def derived_acc_rating(spark, folder):
    columns = [F.col(c) for c in ("predicted_acc", "pass_rating", "tech_rating")]
    derived = rating.derived_acc_rating(*columns).alias("derived")
    return _rounded(retail.maps(spark, folder).select("id", derived))


def max_note_score(spark, folder):
    players = _current(spark, folder)["players"]
    best = points.max_score_for_note(F.col("ranked_play_count")).alias("max_score")
    return players.select("id", "ranked_play_count", best)


def short_names(spark, folder):
    def part(column, start, length):
        return numbers.safe_substring(F.col(column), start, length)

    return retail.maps(spark, folder).select(
        "id",
        part("name", 0, 8).alias("short_name"),
        part("name", 12, 40).alias("rest"),
        part("name", 200, 5).alias("past_end"),
    )


def score_ranks_split(spark, folder):
    return _ranked(spark, folder, SPLIT).select("id", "leaderboard_id", "rank")


def score_weights_split(spark, folder):
    weighted = _weighted(spark, folder, SPLIT, ["id", "player_id", "pp"])
    return _rounded(weighted.select("id", "player_id", "weight"), 6)


# ---- players and boards ------------------------------------------------------


def player_totals(spark, folder):
    return _rounded(player_ops.player_totals(_weighted(spark, folder)))


def player_ranks(spark, folder):
    totals = player_ops.player_totals(_weighted(spark, folder))
    ranked = player_ops.player_ranks(totals, retail.players(spark, folder))
    return ranked.select("player_id", "country", "rank", "country_rank")


def board_stats(spark, folder):
    tables = _current(spark, folder)
    return _rounded(board_ops.board_stats(tables["scores"], tables["players"]))


def board_megametrics(spark, folder):
    tables = _current(spark, folder)
    return _rounded(board_ops.board_megametrics(tables["scores"], tables["players"]), 6)


def _layout(spark, folder, policy=DEFAULT_SKEW) -> colocated.Layout:
    """The current tables stored by player and by board, once per session and folder."""
    key = (spark.sparkContext.applicationId, folder, policy)
    if key not in _layouts:
        _layouts[key] = new_path(spark, "layout")
        colocated.store(_current(spark, folder), _layouts[key], policy=policy)
    return colocated.open_layout(spark, _layouts[key])


def score_series_colocated(spark, folder):
    return _rounded(colocated.stored_series(_layout(spark, folder)))


def score_series_colocated_split(spark, folder):
    return _rounded(colocated.stored_series(_layout(spark, folder, SPLIT), SPLIT))


def board_stats_colocated(spark, folder):
    return _rounded(colocated.stored_board_stats(_layout(spark, folder)))


def board_megametrics_colocated(spark, folder):
    return _board_means(colocated.stored_board_statistics(_layout(spark, folder)))


def board_megametrics_colocated_split(spark, folder):
    layout = _layout(spark, folder, SPLIT)
    return _board_means(colocated.stored_board_statistics(layout, policy=SPLIT))


def _board_means(statistics: DataFrame) -> DataFrame:
    means = [f"megametric{limit}" for limit in DEFAULT_RATING.play_thresholds]
    return _rounded(statistics.select("leaderboard_id", "percentile", "megametric", *means), 6)


def player_ranks_split(spark, folder):
    tables = _current(spark, folder)
    players = retail.players(spark, folder)
    totals = player_ops.player_totals(tables["scores"])
    ranked = player_ops.player_ranks(totals, players, policy=SPLIT)
    return ranked.select("player_id", "country", "rank", "country_rank")


def board_megametrics_split(spark, folder):
    tables = _current(spark, folder)
    means = board_ops.board_megametrics(tables["scores"], tables["players"], policy=SPLIT)
    return _rounded(means, 6)


def board_ratios(spark, folder):
    ratios = board_ops.board_ratios(_current(spark, folder)["leaderboards"])
    return _rounded(ratios.select("id", "count80_ratio", "count95_ratio", "count95to80_ratio"))


def scores_full(spark, folder):
    return _rounded(_current(spark, folder)["scores"])


def players_full(spark, folder):
    return _rounded(_current(spark, folder)["players"])


def boards_full(spark, folder):
    return _rounded(_current(spark, folder)["leaderboards"].drop("modifiers_rating"))


def boards_full_literal(spark, folder):
    tables = refresh.refresh_all(_imported(spark, folder), only=["leaderboards"], literal=True)
    return _rounded(tables["leaderboards"].drop("modifiers_rating"))


def podium_points(spark, folder):
    return podium.podium_points(_current(spark, folder)["scores"])


def podium_delta(spark, folder):
    return podium.podium_delta(_current(spark, folder)["scores"], _trial(spark, folder)["scores"])


# ---- whole jobs --------------------------------------------------------------


def refresh_all(spark, folder):
    return _rounded(refresh.refresh_summary(refresh.refresh_all(_imported(spark, folder))), 3)


def refresh_all_split(spark, folder):
    tables = refresh.refresh_all(_imported(spark, folder), policy=SPLIT)
    return _rounded(refresh.refresh_summary(tables), 3)


def _refresh_delta(table: str):
    """The earlier database brought up to the present one by what changed."""

    def query(spark, folder):
        stored = _snapshot(spark, folder, "earlier", DEFAULT_RATING, _imported_earlier)
        key = (spark.sparkContext.applicationId, folder)
        if key not in _deltas:
            imported = _imported_once(spark, folder)
            upserts, removed = delta.find_changes(stored["scores"], imported["scores"])
            _deltas[key] = delta.refresh_delta(
                stored, upserts, removed, imported["players"], imported["leaderboards"]
            )
        brought = delta.merged(stored, _deltas[key])[table]
        return _rounded(brought.drop("modifiers_rating"))

    return query


def _what_if(table: str):
    def query(spark, folder):
        trial = rescore.what_if_rescore(
            _imported_once(spark, folder),
            _current(spark, folder),
            TRIAL_RATING,
            only=[table],
            stored=True,
        )
        return _rounded(trial[table])

    return query


def _what_if_sweep(table: str):
    """All configurations of ``SWEEP`` over one pass."""

    def query(spark, folder):
        imported, current = _imported_once(spark, folder), _current(spark, folder)
        trials = sweep.what_if_sweep(imported, current, SWEEP, only=[table], stored=True)
        return _rounded(trials[table])

    return query


# ---- read queries ------------------------------------------------------------


def player_by_id(spark, folder):
    return _rounded(pages.by_id(_current(spark, folder)["players"], "18"))


def leaderboard_by_id(spark, folder):
    return _rounded(
        pages.board_header(pages.by_id(_current(spark, folder)["leaderboards"], "7"))
    )


def search_like(spark, folder):
    return pages.search_like(_current(spark, folder)["leaderboards"], "Re_ %ST").select("id", "name")


def search_contains(spark, folder):
    found = pages.search_contains(_current(spark, folder)["leaderboards"], "ED RIN")
    return found.select("id", "name")


def _search_indexed(text: str, literal: bool):
    """The index is written once per snapshot, as when it is published."""

    def query(spark, folder):
        boards = _current(spark, folder)["leaderboards"]
        key = (spark.sparkContext.applicationId, folder, "names")
        if key not in _published:
            path = new_path(spark, "name-index")
            search.write_index(boards, path)
            _published[key] = path
        index = search.read_index(boards, _published[key])
        return search.search(boards, index, text, literal).select("id", "name")

    return query


def ranking_page(spark, folder):
    return _rounded(pages.ranking_page(_current(spark, folder)["players"], 2))


def ranking_slice(spark, folder):
    return _rounded(pages.ranking_slice(_current(spark, folder)["players"], 3))


def player_page(spark, folder):
    tables = _current(spark, folder)
    return _rounded(pages.player_page(tables["scores"], tables["leaderboards"], "18", 3))


def leaderboard_page(spark, folder):
    tables = _current(spark, folder)
    return _rounded(pages.leaderboard_page(tables["scores"], tables["players"], "7", 2))


def leaderboard_slice(spark, folder):
    tables = _current(spark, folder)
    return _rounded(pages.leaderboard_slice(tables["scores"], tables["players"], "7", 3))


def _boards_by_stars(descending: bool):
    def query(spark, folder):
        boards = _current(spark, folder)["leaderboards"]
        listed = pages.boards_by_stars(boards, "ring", descending, 2)
        return _rounded(listed.select("id", "name", "stars"))

    return query


def _stats_by(name: str, descending: bool):
    def query(spark, folder):
        boards = _current(spark, folder)["leaderboards"]
        return _rounded(pages.stats_page(boards, None, name, descending))

    return query


def _fences(spark, folder, label: str, df: DataFrame, *settings) -> DataFrame:
    """Made once per snapshot, as when it is published."""
    key = (spark.sparkContext.applicationId, folder, label)
    if key not in _marks:
        _marks[key] = materialise(fences.fences(df, *settings), f"fences-{label}")
    return _marks[key]


def _stats_last(column: str):
    """The last page of the statistics table in ascending order."""

    def query(spark, folder):
        table = pages.stats_table(_current(spark, folder)["leaderboards"])
        size = pages.STATS_PAGE
        marks = _fences(spark, folder, f"stats-{column}", table, column, False, size)
        last = fences.last_page(marks)
        return _rounded(fences.fenced_page(table, marks, column, False, last, size))

    return query


def boards_by_stars_fenced(spark, folder):
    boards, size = _current(spark, folder)["leaderboards"], pages.BOARDS_PAGE
    marks = _fences(spark, folder, "stars", boards, "stars", False, size)
    found = fences.fenced_page(boards, marks, "stars", False, 15, size)
    return _rounded(found.select("id", "name", "stars"))


def player_page_fenced(spark, folder):
    scores, size = _current(spark, folder)["scores"], pages.SCORES_PAGE
    marks = _fences(spark, folder, "player-scores", scores, "pp", True, size, ["player_id"])
    own = scores.where(F.col("player_id") == "18")
    found = fences.fenced_page(own, marks.where(F.col("player_id") == "18"), "pp", True, 4, size)
    return _rounded(found.select("id", "player_id", "leaderboard_id", "pp", "weight", "rank"))


def stats_by_percentile_literal(spark, folder):
    boards = _current(spark, folder)["leaderboards"]
    return _rounded(pages.stats_page(boards, None, "Percentile", True, literal=True))


def stats_by_count80_ratio_literal(spark, folder):
    boards = _current(spark, folder)["leaderboards"]
    return _rounded(pages.stats_page(boards, None, "Count80Ratio", False, literal=True))


def stats_search(spark, folder):
    boards = _current(spark, folder)["leaderboards"]
    return _rounded(pages.stats_page(boards, "WIDGET", "Name", False, 2))


def stats_report(spark, folder):
    boards = _current(spark, folder)["leaderboards"]
    return pages.stats_report(pages.stats_table(boards))


def _series(spark, folder) -> DataFrame:
    tables = _current(spark, folder)
    return series.score_series(tables["scores"], tables["players"])


def score_series(spark, folder):
    return _rounded(_series(spark, folder))


def series_json(spark, folder):
    rows = series.series_json(_series(spark, folder))
    names = {c: series.JSON_NAMES.get(c, c) for c in series.SERIES_COLUMNS}
    kinds = dict(_series(spark, folder).dtypes)
    read = F.from_json("json", ", ".join(f"{n} {kinds[c]}" for c, n in names.items()))
    parsed = rows.select("id", "leaderboard_id", read.alias("entry"))
    fields = [F.col(f"entry.{n}").alias(c) for c, n in names.items()]
    return _rounded(parsed.select("id", "leaderboard_id", *fields))


def series_json_chunks(spark, folder):
    """The objects of the arrays, with their places in the boards."""
    rows, size = _series(spark, folder), 20
    chunks = series.series_json_chunks(rows, size)
    names = {c: series.JSON_NAMES.get(c, c) for c in series.SERIES_COLUMNS}
    kinds = dict(rows.dtypes)
    kind = f"array<struct<{', '.join(f'{n}: {kinds[c]}' for c, n in names.items())}>>"
    parsed = chunks.select(
        "leaderboard_id", "chunk", "entries", F.posexplode(F.from_json("json", kind)).alias("at", "entry")
    )
    fields = [F.col(f"entry.{n}").alias(c) for c, n in names.items()]
    place = (F.col("chunk") * size + F.col("at") + 1).alias("place")
    return _rounded(parsed.select("leaderboard_id", "chunk", "entries", place, *fields))


def _plain_axes(df: DataFrame) -> DataFrame:
    """Axis columns as doubles (a date as unix seconds), the list as text."""
    kinds = dict(df.dtypes)
    for axis in ("x", "y"):
        value = F.unix_timestamp(axis) if kinds[axis] == "timestamp" else F.col(axis)
        df = df.withColumn(axis, value.cast("double"))
    df = df.withColumn("mods", F.concat_ws("|", "mods"))
    keep = ("id", "leaderboard_id", "x", "y", "mods", "is_compare")
    return _rounded(df.select(*[c for c in keep if c in df.columns]))


def _series_axes(x_axis: str, y_axis: str, literal: bool = False):
    def query(spark, folder):
        boards, few = None, False
        if "rank" in (x_axis, y_axis):
            boards = _current(spark, folder)["leaderboards"]
            few = boards.count() <= DEFAULT_SKEW.broadcast_rows
        points = series.series_axes(_series(spark, folder), x_axis, y_axis, literal, few, boards)
        return _plain_axes(points)

    return query


def compare_series(spark, folder):
    return _plain_axes(series.compare_series(_series(spark, folder), "1", "3", "rank", "pp"))


def score_freshness(spark, folder):
    scores = retail.scores(spark, folder)
    return scores.select(
        "id", series.score_freshness(F.col("timepost"), AS_OF).alias("brightness")
    )


def rating_shares(spark, folder):
    return _rounded(series.rating_shares(_imported(spark, folder)["leaderboards"]))


def rating_shares_compare(spark, folder):
    boards = _imported(spark, folder)["leaderboards"]
    return _rounded(series.rating_shares_compare(boards, "7", "15"))


# ---- contract ----------------------------------------------------------------


def entry(spark: SparkSession) -> DataFrame:
    """Import, full refresh, and the first page of the player ranking."""
    tables = refresh.refresh_all(_imported(spark, "/root/testdata/sf0.001"))
    return _rounded(pages.ranking_page(tables["players"]))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Every implemented operator over the tables of a folder."""
    plain = [
        ingest_dump,
        ingest_dump_cut,
        import_leaderboards,
        import_players,
        import_scores,
        import_modifier_ratings,
        modifier_ratings_long,
        apply_updates,
        apply_updates_pruned,
        changed_weights,
        publish_snapshot,
        append_table,
        schema_violations,
        schema_violations_observed,
        orphan_scores,
        cascade_delete,
        duplicate_keys,
        page_counts,
        score_pp,
        score_ranks,
        score_weights,
        modifier_usage,
        modifier_table_diff,
        modifier_multipliers,
        curve_values,
        derived_acc_rating,
        max_note_score,
        short_names,
        player_totals,
        player_ranks,
        board_stats,
        board_megametrics,
        board_ratios,
        scores_full,
        players_full,
        boards_full,
        podium_points,
        podium_delta,
        score_ranks_split,
        score_weights_split,
        player_ranks_split,
        board_megametrics_split,
        score_series_colocated,
        score_series_colocated_split,
        board_stats_colocated,
        board_megametrics_colocated,
        board_megametrics_colocated_split,
        boards_full_literal,
        refresh_all,
        refresh_all_split,
        leaderboard_slice,
        boards_by_stars_fenced,
        player_page_fenced,
        stats_by_percentile_literal,
        stats_by_count80_ratio_literal,
        player_by_id,
        leaderboard_by_id,
        search_like,
        search_contains,
        ranking_page,
        ranking_slice,
        player_page,
        leaderboard_page,
        stats_search,
        stats_report,
        score_series,
        series_json,
        series_json_chunks,
        compare_series,
        score_freshness,
        rating_shares,
        rating_shares_compare,
    ]
    registry = {query.__name__: query for query in plain}
    for table in ("scores", "players", "leaderboards"):
        registry[f"what_if_{table}"] = _what_if(table)
        registry[f"what_if_sweep_{table}"] = _what_if_sweep(table)
        registry[f"refresh_delta_{table}"] = _refresh_delta(table)
    registry["search_like_indexed"] = _search_indexed("LD W%g_T", False)
    registry["search_contains_indexed"] = _search_indexed("ED RIN", True)
    registry["boards_by_stars"] = _boards_by_stars(False)
    registry["boards_by_stars_desc"] = _boards_by_stars(True)
    for name, column in pages.STATS_KEYS.items():
        registry[f"stats_by_{column}"] = _stats_by(name, True)
        registry[f"stats_by_{column}_asc"] = _stats_by(name, False)
    for column in LAST_PAGES:
        registry[f"stats_last_{column}"] = _stats_last(column)
    for label, axes in SERIES_AXES.items():
        registry[f"series_axes_{label}"] = _series_axes(*axes)
    registry["series_axes_fc_acc_literal"] = _series_axes("fcAcc", "weight", True)
    return registry | _llm("queries")


# columns with so many zeros that their first ascending pages hold the same boards
LAST_PAGES = (
    "count80", "count95", "percentile", "megametric125", "megametric75", "megametric40",
    "count80_ratio", "count95_ratio", "count95to80_ratio",
)

# every axis at least once
SERIES_AXES = {
    "player_rank_weight": ("playerRank", "weight"),
    "date_weighted_pp": ("date", "weightedPp"),
    "acc_rank": ("acc", "rank"),
    "fc_acc_pp": ("fcAcc", "pp"),
}


def oracle_sql() -> dict[str, str]:
    """The DuckDB query each entry of ``queries()`` must agree with."""
    return oracle_queries() | _llm("oracle_sql")


def _llm(part: str) -> dict:
    """What the subpackage ``llm`` registers, if it and its pipeline are there."""
    try:
        from tallyboard.llm import registry
    except ImportError as missing:
        # an emptied folder still imports, but holds no registry
        if any(name in str(missing) for name in ("tallyboard.llm", "corpus_pipeline")):
            return {}
        raise
    return getattr(registry, part)()
