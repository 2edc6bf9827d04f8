"""DuckDB SQL for every registered query.

Written separately from the Spark operators and in another way where there is one:
curves are a range join with a table of knots, multipliers and rating tokens are
joins on unnested rows, ranks are plain windows.
"""

from __future__ import annotations

# The engine has its own copy of these, so a wrong constant in either one shows.

# Accuracy knots with the value of curve A and of curve B.
CURVE_KNOTS = (
    (1.0, 7.424, 7.424),
    (0.999, 6.241, 6.241),
    (0.9975, 5.158, 5.158),
    (0.995, 4.010, 4.010),
    (0.9925, 3.241, 3.241),
    (0.99, 2.700, 2.700),
    (0.9875, 2.303, 2.303),
    (0.985, 2.007, 2.007),
    (0.9825, 1.786, 1.786),
    (0.98, 1.618, 1.618),
    (0.9775, 1.490, 1.490),
    (0.975, 1.392, 1.392),
    (0.9725, 1.315, 1.315),
    (0.97, 1.256, 1.256),
    (0.965, 1.167, 1.167),
    (0.96, 1.101, 1.094),
    (0.955, 1.047, 1.039),
    (0.95, 1.000, 1.000),
    (0.94, 0.919, 0.931),
    (0.93, 0.847, 0.867),
    (0.92, 0.786, 0.813),
    (0.91, 0.734, 0.768),
    (0.9, 0.692, 0.729),
    (0.875, 0.606, 0.650),
    (0.85, 0.537, 0.581),
    (0.825, 0.480, 0.522),
    (0.8, 0.429, 0.473),
    (0.75, 0.345, 0.404),
    (0.7, 0.286, 0.345),
    (0.65, 0.246, 0.296),
    (0.6, 0.217, 0.256),
    (0.0, 0.000, 0.000),
)
CURVE_A = tuple((acc, a) for acc, a, _ in CURVE_KNOTS)
CURVE_B = tuple((acc, b) for acc, _, b in CURVE_KNOTS)

# What each modifier code adds to the score multiplier.
DEFAULT_MULTIPLIERS = {
    "DA": 0.0,
    "FS": 0.20,
    "SF": 0.36,
    "SS": -0.3,
    "GN": 0.04,
    "NA": -0.3,
    "NB": -0.2,
    "NF": -0.5,
    "NO": -0.2,
    "PM": 0.0,
    "SC": 0.0,
    "SA": 0.0,
    "OP": -0.5,
}
RANKED_MULTIPLIERS = DEFAULT_MULTIPLIERS | {"FS": 0.40, "SF": 0.72, "GN": 0.08, "NF": -1.0}

# ---- data mapping ------------------------------------------------------------

BASE = """
numbered AS (
  SELECT l_orderkey, l_linenumber, l_partkey AS partkey, l_quantity AS qty, l_discount AS discount,
         l_tax AS tax, l_returnflag AS flag, l_linestatus AS status, l_shipdate AS shipped,
         row_number() OVER (PARTITION BY l_orderkey, l_linenumber
           ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax,
                    l_returnflag, l_linestatus, l_shipdate) - 1 AS repeat
  FROM lineitem),
scores AS MATERIALIZED (
  SELECT l_orderkey * 8 + l_linenumber + repeat * 1099511627776 AS id,
         CAST(CASE WHEN l_orderkey % 4 = 0 THEN partkey % 20 ELSE partkey END AS VARCHAR)
           AS leaderboard_id,
         CAST(CASE o_custkey % 3 WHEN 0 THEN o_custkey % 30 WHEN 1 THEN o_custkey % 300
              ELSE o_custkey END AS VARCHAR) AS player_id,
         CASE WHEN l_orderkey % 89 = 7 THEN 0 ELSE CAST(epoch(shipped) AS BIGINT) END AS timepost,
         CAST(CASE WHEN qty = 50 AND tax = 0 THEN 0.0 WHEN qty = 1 AND tax = 0 THEN 1.01
              ELSE 1.0::DOUBLE - (discount * 2 + qty / 1000.0::DOUBLE + tax / 4) END AS DOUBLE)
           AS accuracy,
         CASE l_linenumber WHEN 1 THEN '' WHEN 2 THEN 'FS' WHEN 3 THEN 'SS' WHEN 4 THEN 'SF,GN'
              WHEN 5 THEN 'NA,NB' WHEN 6 THEN 'fs'
              ELSE CASE WHEN status = 'O' THEN 'NF' ELSE 'BFS' END END AS modifiers,
         flag = 'R' AS fc,
         least(1.0::DOUBLE, accuracy + 0.005::DOUBLE) AS fc_acc
  FROM numbered JOIN orders ON o_orderkey = l_orderkey),
players AS MATERIALIZED (
  SELECT CAST(c_custkey AS VARCHAR) AS id,
         repeat(c_name, CASE WHEN c_custkey % 61 = 17 THEN 4 ELSE 1 END) AS name,
         CASE WHEN c_custkey % 20 <> 7 THEN 'N' || c_nationkey END AS country,
         repeat('avatars/' || c_custkey || '.png', CASE WHEN c_custkey % 71 = 5 THEN 10 ELSE 1 END)
           AS avatar
  FROM customer),
maps AS MATERIALIZED (
  SELECT CAST(p_partkey AS VARCHAR) AS id, p_name || ' ' || p_type AS name,
         md5(p_name || p_partkey) AS hash, CAST(p_partkey // 5 AS VARCHAR) AS song_id,
         p_type AS mode_name, p_brand AS difficulty_name, p_brand AS mapper,
         repeat('covers/' || md5(p_name) || '.jpg', CASE WHEN p_partkey % 59 = 13 THEN 4 ELSE 1 END)
           AS cover,
         CASE WHEN p_size % 11 <> 0 THEN 4.0::DOUBLE + p_size / 5.0::DOUBLE END AS acc_rating,
         CASE WHEN p_size % 13 <> 0 THEN 1.0::DOUBLE + (p_partkey % 23) * 0.5::DOUBLE END
           AS pass_rating,
         (p_partkey % 17) * 0.6::DOUBLE AS tech_rating,
         CASE WHEN p_partkey % 3 = 0 THEN 0.95::DOUBLE + p_size / 1000.0::DOUBLE END
           AS predicted_acc,
         p_partkey % 4 <> 0 AS has_modifier_ratings
  FROM part),
rated AS MATERIALIZED (
  SELECT * REPLACE (coalesce(acc_rating, 0) AS acc_rating, coalesce(pass_rating, 0) AS pass_rating,
                    coalesce(predicted_acc, 0) AS predicted_acc)
  FROM maps),
families(code, place, acc_by, acc_plus, pass_by, tech_by) AS (VALUES
  ('SS', 1, 0.8::DOUBLE, 0.0::DOUBLE, 0.7::DOUBLE, 0.9::DOUBLE),
  ('FS', 2, 1.2::DOUBLE, 0.5::DOUBLE, 1.2::DOUBLE, 1.1::DOUBLE),
  ('SF', 3, 1.4::DOUBLE, 1.0::DOUBLE, 1.5::DOUBLE, 1.2::DOUBLE),
  ('BFS', 4, 1.1::DOUBLE, 0.25::DOUBLE, 1.1::DOUBLE, 1.05::DOUBLE),
  ('BSF', 5, 1.3::DOUBLE, 0.75::DOUBLE, 1.3::DOUBLE, 1.15::DOUBLE)),
dump_ratings AS (
  SELECT id AS leaderboard_id, code, acc_rating * acc_by + acc_plus AS acc_rating,
         pass_rating * pass_by AS pass_rating, tech_rating * tech_by AS tech_rating,
         0.9::DOUBLE + tech_rating / 200 + place / 100.0::DOUBLE AS predicted_acc,
         acc_rating + place / 4.0::DOUBLE AS stars
  FROM rated, families
  WHERE has_modifier_ratings),
modifier_ratings AS (SELECT * FROM dump_ratings WHERE code IN ('SS', 'FS', 'SF'))"""


def _knots(name: str, curve) -> str:
    rows = ", ".join(f"({x}::DOUBLE, {y}::DOUBLE)" for x, y in curve)
    return f"""
{name}_points(x, y) AS (VALUES {rows}),
{name} AS (
  SELECT x AS x0, y AS y0, lead(x) OVER (ORDER BY x) AS x1, lead(y) OVER (ORDER BY x) AS y1,
         row_number() OVER (ORDER BY x DESC) AS from_top
  FROM {name}_points
  QUALIFY lead(x) OVER (ORDER BY x) IS NOT NULL)"""


def _on_curve(knots: str, value: str) -> str:
    """Join condition: the segment of ``value``; the last one has no right end."""
    return f"({value} >= {knots}.x0 AND ({value} < {knots}.x1 OR {knots}.from_top = 2))"


def _interpolated(knots: str, value: str) -> str:
    k = knots
    return f"coalesce({k}.y0 + ({value} - {k}.x0) * (({k}.y1 - {k}.y0) / ({k}.x1 - {k}.x0)), 0)"


CURVES = _knots("curve_a", CURVE_A) + "," + _knots("curve_b", CURVE_B)


def _multiplier_rows(table) -> str:
    return ", ".join(f"('{c}', {v}::DOUBLE, {i})" for i, (c, v) in enumerate(table.items()))


def _finite(x: str) -> str:
    return f"(CASE WHEN isfinite({x}) THEN {x} ELSE 0 END)"


def _inflate(x: str) -> str:
    return f"(650.0::DOUBLE * pow({x}, 1.3::DOUBLE) / pow(650.0::DOUBLE, 1.3::DOUBLE))"


def _pass_points(x: str) -> str:
    raw = f"15.2::DOUBLE * exp(pow({x}, 1 / 2.62::DOUBLE)) - 30"
    return f"greatest({_finite(f'({raw})')}, 0)"


# ---- the refresh -------------------------------------------------------------


def _refresh(p: str, curve: str, decay: float, table) -> str:
    """All stages as CTEs whose names start with ``p``."""
    return f"""
{p}multipliers(code, value, place) AS (VALUES {_multiplier_rows(table)}),
{p}texts AS (
  SELECT modifiers, has_ratings,
         1 + coalesce(sum(value ORDER BY place) FILTER (
           contains(modifiers, code) AND (has_ratings IS FALSE OR code NOT IN ('FS', 'SS', 'SF'))),
           0) AS mp
  FROM (SELECT DISTINCT modifiers FROM scores), (VALUES (TRUE), (FALSE)) AS h(has_ratings),
       {p}multipliers
  GROUP BY modifiers, has_ratings),
{p}tokens AS (
  SELECT modifiers, arg_min(token, place) AS code
  FROM (SELECT modifiers, unnest(string_split(upper(modifiers), ',')) AS token,
               generate_subscripts(string_split(modifiers, ','), 1) AS place
        FROM (SELECT DISTINCT modifiers FROM scores))
  WHERE token IN ('FS', 'SS', 'SF') GROUP BY modifiers),
{p}inputs AS (
  SELECT s.id, s.accuracy, s.modifiers, {_interpolated('k', 's.accuracy')} AS on_curve, t.mp,
         b.acc_rating AS a0, b.pass_rating AS p0, b.tech_rating AS t0,
         coalesce(r.acc_rating, b.acc_rating) * t.mp AS a1,
         coalesce(r.pass_rating, b.pass_rating) * t.mp AS p1,
         coalesce(r.tech_rating, b.tech_rating) * t.mp AS t1
  FROM scores s
  JOIN rated b ON b.id = s.leaderboard_id
  JOIN {p}texts t ON t.modifiers = s.modifiers AND t.has_ratings = b.has_modifier_ratings
  LEFT JOIN {curve} k ON {_on_curve('k', 's.accuracy')}
  LEFT JOIN {p}tokens c ON c.modifiers = s.modifiers
  LEFT JOIN modifier_ratings r ON r.leaderboard_id = b.id AND r.code = c.code),
{p}parts AS (
  SELECT *, {_pass_points('p0')} + on_curve * a0 * 34 + exp(1.9::DOUBLE * accuracy) * 1.08::DOUBLE * t0
              AS sum0,
         {_pass_points('p1')} AS pass1, on_curve * a1 * 34 AS acc1,
         exp(1.9::DOUBLE * accuracy) * 1.08::DOUBLE * t1 AS tech1
  FROM {p}inputs),
{p}inflated AS (
  SELECT *, pass1 + acc1 + tech1 AS sum1, {_inflate('sum0')} AS raw, {_inflate('sum1')} AS filled,
         accuracy > 0 AND accuracy <= 1 AND NOT contains(modifiers, 'NF') AS counts
  FROM {p}parts),
{p}points AS MATERIALIZED (
  SELECT id, CASE WHEN counts THEN {_finite('filled')} ELSE 0 END AS pp,
         CASE WHEN counts THEN {_finite('filled')} - {_finite('raw')} ELSE 0 END AS bonus_pp,
         CASE WHEN counts AND sum1 > 0 THEN pass1 * filled / sum1 ELSE 0 END AS pass_pp,
         CASE WHEN counts AND sum1 > 0 THEN acc1 * filled / sum1 ELSE 0 END AS acc_pp,
         CASE WHEN counts AND sum1 > 0 THEN tech1 * filled / sum1 ELSE 0 END AS tech_pp
  FROM {p}inflated),
{p}scores_full AS MATERIALIZED (
  SELECT s.id, timepost, player_id, leaderboard_id, accuracy, modifiers, fc, fc_acc, pp, acc_pp,
         tech_pp, pass_pp, bonus_pp,
         pow({decay}::DOUBLE, row_number() OVER (
           PARTITION BY player_id ORDER BY round_even(pp * 1000000, 0) DESC, s.id) - 1) AS weight,
         row_number() OVER (
           PARTITION BY leaderboard_id ORDER BY round_even(pp * 100, 0) DESC,
           round_even(accuracy * 10000, 0) DESC, s.id) AS rank
  FROM scores s JOIN {p}points USING (id)),
{p}totals AS MATERIALIZED (
  SELECT player_id, sum(pp * weight) AS pp, sum(acc_pp * weight) AS acc_pp,
         sum(tech_pp * weight) AS tech_pp, sum(pass_pp * weight) AS pass_pp, max(pp) AS top_pp,
         count(*) AS ranked_play_count
  FROM {p}scores_full GROUP BY player_id),
{p}ranked AS (
  SELECT t.*, country,
         row_number() OVER (ORDER BY round_even(pp * 1000000, 0) DESC, player_id) AS rank,
         CASE WHEN country IS NULL THEN 0 ELSE row_number() OVER (
           PARTITION BY country ORDER BY round_even(pp * 1000000, 0) DESC, player_id)
         END AS country_rank
  FROM {p}totals t LEFT JOIN players ON id = player_id),
{p}players_full AS MATERIALIZED (
  SELECT id, name, p.country, avatar, coalesce(pp, 0) AS pp, coalesce(acc_pp, 0) AS acc_pp,
         coalesce(tech_pp, 0) AS tech_pp, coalesce(pass_pp, 0) AS pass_pp,
         coalesce(rank, 0) AS rank, coalesce(country_rank, 0) AS country_rank,
         coalesce(top_pp, 0) AS top_pp, coalesce(ranked_play_count, 0) AS ranked_play_count
  FROM players p LEFT JOIN {p}ranked r ON r.player_id = p.id),
{p}held AS MATERIALIZED (
  SELECT s.id, s.leaderboard_id, s.pp, s.weight, p.top_pp, p.ranked_play_count AS plays,
         p.rank AS player_rank, s.pp / nullif(p.top_pp, 0) AS share
  FROM {p}scores_full s JOIN {p}players_full p ON p.id = s.player_id),
{p}stats AS (
  SELECT leaderboard_id, count(*) AS "count", count(*) FILTER (weight > 0.8::DOUBLE) AS count80,
         count(*) FILTER (weight > 0.95::DOUBLE) AS count95, avg(weight) AS average,
         count(*) FILTER (player_rank < 250 AND weight > pow({decay}::DOUBLE, 40)) AS top250,
         sum(pp * weight) AS total_pp,
         coalesce(avg(share) FILTER (plays >= 50), 0) AS pp_ratio_filtered,
         coalesce(avg(share), 0) AS pp_ratio_unfiltered
  FROM {p}held GROUP BY leaderboard_id),
{p}eligible AS (
  SELECT *, CAST(floor(count(*) OVER (PARTITION BY leaderboard_id) * 0.33::DOUBLE) AS BIGINT) AS k
  FROM {p}held WHERE top_pp <> 0),
{p}top_all AS (
  SELECT * FROM {p}eligible
  QUALIFY row_number() OVER (PARTITION BY leaderboard_id ORDER BY weight DESC, id) <= k),
{','.join(f'''
{p}top_{t} AS (
  SELECT leaderboard_id, CASE WHEN count(*) > 10 THEN avg(share * weight) ELSE 0 END AS mean
  FROM (SELECT * FROM {p}eligible WHERE plays > {t}
        QUALIFY row_number() OVER (PARTITION BY leaderboard_id ORDER BY weight DESC, id) <= k)
  GROUP BY leaderboard_id)''' for t in (125, 75, 40))},
{p}tops AS (
  SELECT leaderboard_id, CASE WHEN count(*) > 10 THEN avg(weight) ELSE 0 END AS percentile,
         CASE WHEN count(*) FILTER (plays > 75) > 10
              THEN avg(share * weight) FILTER (plays > 75) ELSE 0 END AS megametric
  FROM {p}top_all GROUP BY leaderboard_id),
{p}means AS (
  SELECT s.leaderboard_id, coalesce(percentile, 0) AS percentile,
         coalesce(megametric, 0) AS megametric, coalesce(m1.mean, 0) AS megametric125,
         coalesce(m2.mean, 0) AS megametric75, coalesce(m3.mean, 0) AS megametric40
  FROM (SELECT DISTINCT leaderboard_id FROM {p}held) s
  LEFT JOIN {p}tops USING (leaderboard_id)
  LEFT JOIN {p}top_125 m1 USING (leaderboard_id)
  LEFT JOIN {p}top_75 m2 USING (leaderboard_id)
  LEFT JOIN {p}top_40 m3 USING (leaderboard_id)),
{p}boards_full AS MATERIALIZED (
  SELECT id, name, hash, song_id, mode_name, difficulty_name, cover, mapper,
         {_inflate(STAR_SUM)} / 52 AS stars, pass_rating, acc_rating, tech_rating, predicted_acc,
         {', '.join(f'coalesce("{c}", 0) AS "{c}"' for c in BOARD_COLUMNS)}
  FROM rated LEFT JOIN {p}stats s ON s.leaderboard_id = id
  LEFT JOIN {p}means m ON m.leaderboard_id = id),
{p}boards_ratios AS (
  SELECT *, CASE WHEN "count" > 0 THEN count80 / "count"::DOUBLE ELSE 0 END AS count80_ratio,
         CASE WHEN "count" > 0 THEN count95 / "count"::DOUBLE ELSE 0 END AS count95_ratio,
         CASE WHEN count80 > 0 THEN count95 / count80::DOUBLE ELSE 0 END AS count95to80_ratio
  FROM {p}boards_full)"""


BOARD_COLUMNS = (
    "count",
    "count80",
    "count95",
    "average",
    "top250",
    "total_pp",
    "pp_ratio_filtered",
    "pp_ratio_unfiltered",
    "percentile",
    "megametric",
    "megametric125",
    "megametric75",
    "megametric40",
)
BOARD_TEXT = "id, name, hash, song_id, mode_name, difficulty_name, cover, mapper"
RATINGS = ("stars", "pass_rating", "acc_rating", "tech_rating", "predicted_acc")
COUNTS = ("count", "count80", "count95", "top250")
PLAYER_DOUBLES = ("pp", "acc_pp", "tech_pp", "pass_pp", "top_pp")
SCORE_DOUBLES = ("accuracy", "fc_acc", "pp", "acc_pp", "tech_pp", "pass_pp", "bonus_pp", "weight")

# curve B at .96 is a knot
STAR_SUM = (
    f"({_pass_points('pass_rating')} + 1.094::DOUBLE * acc_rating * 34"
    " + exp(1.9::DOUBLE * 0.96::DOUBLE) * 1.08::DOUBLE * tech_rating)"
)


def _r(columns, decimals: int = 4, prefix: str = "") -> str:
    return ", ".join(f'round({prefix}"{c}", {decimals}) + 0.0 AS "{c}"' for c in columns)


def _stat_columns() -> str:
    cells = [f'"{c}"' if c in COUNTS else _r([c]) for c in BOARD_COLUMNS]
    return ", ".join(cells)


_PLAYER = f"id, name, country, avatar, {_r(PLAYER_DOUBLES)}, rank, country_rank, ranked_play_count"
_SCORE = f"""s.id, timepost, player_id, leaderboard_id, modifiers, fc,
  {_r(SCORE_DOUBLES, prefix="s.")}, s.rank"""
_STATS_TABLE = (
    f"id, name, {_stat_columns()}, {_r(('acc_rating', 'pass_rating', 'tech_rating'))},"
    f" {_r(('count80_ratio', 'count95_ratio', 'count95to80_ratio'))}"
)


# ---- query bodies ------------------------------------------------------------

CURRENT = _refresh("", "curve_b", 0.965, RANKED_MULTIPLIERS)
TRIAL = _refresh("trial_", "curve_a", 0.95, DEFAULT_MULTIPLIERS)
DECAYED = _refresh("decayed_", "curve_b", 0.9, RANKED_MULTIPLIERS)
CURVED = _refresh("curved_", "curve_a", 0.965, RANKED_MULTIPLIERS)


def _base(body: str) -> str:
    return f"WITH {BASE.strip()}, {CURVES.strip()}\n{body}"


def _current(body: str) -> str:
    return f"WITH {BASE.strip()}, {CURVES.strip()}, {CURRENT.strip()}\n{body}"


def _both(body: str) -> str:
    return f"WITH {BASE.strip()}, {CURVES.strip()}, {CURRENT.strip()}, {TRIAL.strip()}\n{body}"


def _series(x: str, y: str, where: str, extra: str = "", boards: str = "TRUE") -> str:
    return f"""
    SELECT s.id, s.leaderboard_id, round({x}, 4) + 0.0 AS x, round({y}, 4) + 0.0 AS y,
           replace(s.modifiers, ',', '|') AS mods {extra}
    FROM scores_full s JOIN players_full p ON p.id = s.player_id
    JOIN (SELECT leaderboard_id, count(*) AS total FROM scores_full GROUP BY 1) n
      ON n.leaderboard_id = s.leaderboard_id
    WHERE p.rank <> 0 AND {where} AND {boards}"""


AXIS = {
    "date": "CAST(nullif(s.timepost, 0) AS DOUBLE)",
    "pp": "s.pp",
    "acc": "(100 - s.accuracy * 100)",
    "fcAcc": "(100 - s.fc_acc * 100)",
    "rank": "(s.rank / n.total::DOUBLE * 100)",
    "weight": "(s.weight * 100)",
    "weightedPp": "(s.weight * s.pp)",
    "playerRank": "CAST(p.rank AS DOUBLE)",
}


def _axes(x: str, y: str, extra: str = "", boards: str = "TRUE") -> str:
    needed = [f"coalesce({AXIS[a]}, 0) <> 0" for a in (x, y) if a not in ("fcAcc", "playerRank")]
    return _series(AXIS[x], AXIS[y], " AND ".join(needed) or "TRUE", extra, boards)


def _wide(ratings: str, codes) -> str:
    cells = ", ".join(
        f"round(max(r.{f}) FILTER (code = '{c}'), 4) + 0.0 AS {c.lower()}_{f}"
        for c in codes
        for f in RATINGS
    )
    return f"""SELECT rated.id AS leaderboard_id, {cells}
      FROM rated LEFT JOIN {ratings} r ON r.leaderboard_id = rated.id GROUP BY rated.id"""


def _violations() -> str:
    limits = {
        "players": ({"id": 25, "name": 50, "country": 5, "avatar": 100}, "players"),
        "scores": (
            dict.fromkeys(("id", "timepost", "accuracy", "modifiers", "fc", "fc_acc"))
            | {"player_id": 25, "leaderboard_id": 25},
            "scores",
        ),
        "leaderboards": (
            {
                "id": 25,
                "name": 150,
                "hash": None,
                "song_id": 25,
                "mode_name": 25,
                "difficulty_name": 25,
                "cover": 150,
                "mapper": 200,
                "pass_rating": None,
                "acc_rating": None,
                "tech_rating": None,
                "predicted_acc": None,
            },
            "rated",
        ),
    }
    parts = []
    for table, (columns, source) in limits.items():
        for column, limit in columns.items():
            parts.append(
                f"SELECT '{table}' AS table_name, '{column}' AS column_name, 'not null' AS rule,"
                f" count(*) AS n FROM {source} WHERE {column} IS NULL"
            )
            if limit:
                parts.append(
                    f"SELECT '{table}', '{column}', 'max length {limit}', count(*)"
                    f" FROM {source} WHERE length({column}) > {limit}"
                )
    return "SELECT * FROM (" + " UNION ALL ".join(parts) + ") WHERE n > 0"


def _summary() -> str:
    cells = {
        "scores": (
            "scores_full",
            ("pp", "acc_pp", "tech_pp", "pass_pp", "bonus_pp", "weight", "rank"),
        ),
        "players": (
            "players_full",
            ("pp", "acc_pp", "tech_pp", "pass_pp", "rank", "country_rank", "top_pp")
            + ("ranked_play_count",),
        ),
        "leaderboards": ("boards_full", BOARD_COLUMNS),
    }
    parts = [
        f"SELECT '{table}' AS table_name, count(*) AS rows, '{c}' AS column_name,"
        f" round(CAST(sum(\"{c}\") AS DOUBLE), 3) + 0.0 AS total FROM {source}"
        for table, (source, columns) in cells.items()
        for c in columns
    ]
    return " UNION ALL ".join(parts)


def _compare(table: str, columns, trial: str = "trial_", label: str = "") -> str:
    cells = []
    for c, is_double in columns.items():
        old, new, delta = f"o.{c}", f"n.{c}", f"n.{c} - o.{c}"
        if is_double:
            old, new, delta = (f"round({e}, 4) + 0.0" for e in (old, new, delta))
        cells.append(f"{old} AS old_{c}, {new} AS new_{c}, {delta} AS {c}_delta")
    return f"SELECT o.id, {label}{', '.join(cells)} FROM {table} o JOIN {trial}{table} n USING (id)"


def _sweep(table: str, columns) -> str:
    """The comparison under each configuration; the first one has the constants in force."""
    ctes = [BASE, CURVES, CURRENT, TRIAL, DECAYED, CURVED]
    parts = [
        _compare(table, columns, prefix, f"'{name}' AS trial, ")
        for name, prefix in {
            "same": "", "trial": "trial_", "decay": "decayed_", "curve": "curved_"
        }.items()
    ]
    return f"WITH {', '.join(cte.strip() for cte in ctes)}\n{' UNION ALL '.join(parts)}"


def _points_of(rank: str) -> str:
    return f"CASE {rank} WHEN 1 THEN 5 WHEN 2 THEN 3 WHEN 3 THEN 1 ELSE 0 END"


def _zero(columns, kind: str) -> str:
    return ", ".join(f'0::{kind} AS "{c}"' for c in columns)


def oracle_queries() -> dict[str, str]:
    q: dict[str, str] = {}

    # import and maintenance
    q["ingest_dump"] = _base(f"""
      SELECT 'players' AS table_name, * FROM players
      UNION ALL BY NAME
      SELECT 'scores' AS table_name, * REPLACE (CAST(id AS VARCHAR) AS id,
             round(accuracy, 4) + 0.0 AS accuracy, round(fc_acc, 4) + 0.0 AS fc_acc) FROM scores
      UNION ALL BY NAME
      SELECT 'maps' AS table_name, * EXCLUDE (cover, has_modifier_ratings, leaderboard_id)
             REPLACE ({_r(RATINGS[1:])}), cover AS cover_image
      FROM maps JOIN ({_wide("dump_ratings", ("SS", "FS", "SF", "BFS", "BSF"))}) ON leaderboard_id = id""")
    stars = f"round({_inflate(STAR_SUM)} / 52, 4) + 0.0 AS stars"
    board_doubles = [c for c in BOARD_COLUMNS if c not in COUNTS]
    q["import_leaderboards"] = _base(f"""
      SELECT {BOARD_TEXT}, {stars}, {_r(RATINGS[1:])}, {_zero(COUNTS, 'BIGINT')},
             {_zero(board_doubles, 'DOUBLE')} FROM rated""")
    q["import_players"] = _base(f"""
      SELECT *, {_zero(PLAYER_DOUBLES, 'DOUBLE')},
             {_zero(('rank', 'country_rank', 'ranked_play_count'), 'BIGINT')} FROM players""")
    q["import_scores"] = _base(f"""
      SELECT id, timepost, player_id, leaderboard_id, {_r(('accuracy', 'fc_acc'))}, modifiers, fc,
             {_zero(SCORE_DOUBLES[2:], 'DOUBLE')}, {_zero(('rank',), 'BIGINT')} FROM scores""")
    q["import_modifier_ratings"] = _base(_wide("modifier_ratings", ("FS", "SS", "SF")))
    q["modifier_ratings_long"] = _base(f"""
      SELECT leaderboard_id, code, {_r(RATINGS)} FROM modifier_ratings""")
    q["apply_updates"] = _current(f"""
      SELECT id, name, country, avatar, {_r(('pp', 'top_pp'))}, ranked_play_count,
             {_zero(('acc_pp', 'tech_pp', 'pass_pp'), 'DOUBLE')},
             {_zero(('rank', 'country_rank'), 'BIGINT')} FROM players_full""")
    q["changed_weights"] = _both("""
      SELECT n.id, round(n.weight, 4) + 0.0 AS weight
      FROM scores_full n JOIN trial_scores_full o USING (id)
      WHERE abs(n.weight - o.weight) > 1e-9""")
    q["publish_snapshot"] = _base(f"""
      SELECT 'players' AS table_name, id, name, country FROM players
      UNION ALL BY NAME
      SELECT 'scores' AS table_name, CAST(id AS VARCHAR) AS id, leaderboard_id, player_id,
             {_r(('accuracy',))} FROM scores
      UNION ALL BY NAME
      SELECT 'leaderboards' AS table_name, id, name, {stars} FROM rated WHERE acc_rating > 0""")
    q["append_table"] = _base(f"""
      SELECT id, timepost, player_id, leaderboard_id, modifiers, fc, {_r(('accuracy', 'fc_acc'))}
      FROM scores""")
    q["schema_violations"] = _base(_violations())
    q["orphan_scores"] = _base("""
      SELECT id, 'player' AS missing FROM scores
      WHERE player_id NOT IN (SELECT id FROM players WHERE country IS NOT NULL)
      UNION ALL SELECT id, 'leaderboard' FROM scores
      WHERE leaderboard_id NOT IN (SELECT id FROM rated WHERE acc_rating > 0)""")
    q["cascade_delete"] = _base("""
      SELECT s.id, player_id, leaderboard_id FROM scores s
      WHERE NOT EXISTS (FROM players p WHERE p.id = s.player_id AND p.country IS NULL)
        AND NOT EXISTS (FROM rated b WHERE b.id = s.leaderboard_id AND b.acc_rating = 0)""")
    q["duplicate_keys"] = """
      SELECT l_orderkey * 8 + l_linenumber AS id, count(*) AS n FROM lineitem
      GROUP BY 1 HAVING count(*) > 1"""
    listing = (
        "SELECT '{}' AS listing, {} AS key, count(*) AS total,"
        " CAST(ceil(count(*) / {}.0) AS BIGINT) AS pages FROM {}"
    )
    q["page_counts"] = _base(
        " UNION ALL ".join(
            [
                listing.format("ranking", "NULL::VARCHAR", 50, "players"),
                listing.format("boards", "NULL::VARCHAR", 10, "rated"),
                listing.format("stats", "NULL::VARCHAR", 50, "rated WHERE lower(name) LIKE '%ring%'"),
                listing.format("leaderboard", "leaderboard_id", 10, "scores GROUP BY leaderboard_id"),
                listing.format("player", "player_id", 10, "scores GROUP BY player_id"),
            ]
        )
    )

    # scores
    q["score_pp"] = _current(f"SELECT id, {_r(SCORE_DOUBLES[2:7])} FROM scores_full")
    q["score_ranks"] = _current("SELECT id, leaderboard_id, rank FROM scores_full")
    q["score_weights"] = _current(
        f"SELECT id, player_id, {_r(('weight',), 6)} FROM scores_full"
    )
    q["modifier_usage"] = _current("""
      SELECT code, count(*) AS scores, round(avg(pp), 4) + 0.0 AS avg_pp
      FROM (SELECT unnest(string_split(modifiers, ',')) AS code, pp FROM scores_full)
      WHERE code <> '' GROUP BY code""")
    q["modifier_table_diff"] = _base(f"""
      , o(code, value, place) AS (VALUES {_multiplier_rows(DEFAULT_MULTIPLIERS)}),
      n(code, value, place) AS (VALUES {_multiplier_rows(RANKED_MULTIPLIERS)})
      SELECT o.code, o.value AS old_value, n.value AS new_value,
             count(*) FILTER (contains(modifiers, o.code)) AS scores, o.value = n.value AS same
      FROM scores, o JOIN n ON n.code = o.code GROUP BY ALL""")
    pick = "sum(value ORDER BY place) FILTER (contains(modifiers, code) {})"
    q["modifier_multipliers"] = _base(f"""
      , m(code, value, place) AS (VALUES {_multiplier_rows(RANKED_MULTIPLIERS)}),
      t AS (
        SELECT modifiers, 1 + coalesce({pick.format('')}, 0) AS total,
               1 + coalesce({pick.format("AND code NOT IN ('FS', 'SS', 'SF')")}, 0) AS total_no_speed,
               1 + coalesce({pick.format('AND value > 0')}, 0) AS positive,
               1 + coalesce({pick.format('AND value < 0')}, 0) AS negative,
               1 + coalesce({pick.format("AND value < 0 AND code <> 'NF'")}, 0) AS negative_no_nf,
               coalesce(string_agg(code, ',' ORDER BY place)
                 FILTER (contains(modifiers, code) AND value < 0), '') AS negative_codes
        FROM (SELECT DISTINCT modifiers FROM scores), m GROUP BY modifiers)
      SELECT id, {_r(('total', 'total_no_speed', 'positive', 'negative', 'negative_no_nf'))},
             negative_codes
      FROM scores JOIN t USING (modifiers)""")
    q["curve_values"] = _base(f"""
      SELECT id, round({_interpolated('a', 'accuracy')}, 8) + 0.0 AS curve_a,
             round({_interpolated('b', 'accuracy')}, 8) + 0.0 AS curve_b
      FROM scores LEFT JOIN curve_a a ON {_on_curve('a', 'accuracy')}
      LEFT JOIN curve_b b ON {_on_curve('b', 'accuracy')}""")
    estimate = """(1 - pow(0.0208::DOUBLE * t + 1.1284::DOUBLE, -p)) * 8 + 2 + 0.01::DOUBLE * t * p"""
    q["derived_acc_rating"] = _base(f"""
      SELECT id, round(CASE WHEN predicted_acc > 0
               THEN 15 / {_interpolated('a', 'shifted')} ELSE {_finite(f'({estimate})')} END, 4) + 0.0
               AS derived
      FROM (SELECT id, predicted_acc, pass_rating AS p, tech_rating AS t,
                   predicted_acc + 0.0022::DOUBLE AS shifted FROM rated)
      LEFT JOIN curve_a a ON {_on_curve('a', 'shifted')}""")
    q["max_note_score"] = _current("""
      SELECT id, ranked_play_count, 115 * CASE
        WHEN ranked_play_count <= 1 THEN ranked_play_count
        WHEN ranked_play_count <= 5 THEN 1 + (ranked_play_count - 1) * 2
        WHEN ranked_play_count <= 13 THEN 9 + (ranked_play_count - 5) * 4
        ELSE 41 + (ranked_play_count - 13) * 8 END AS max_score
      FROM players_full""")
    q["short_names"] = _base("""
      SELECT id, substr(name, 1, 8) AS short_name, substr(name, 13, 40) AS rest,
             substr(name, 201, 5) AS past_end FROM maps""")

    # players and boards
    q["player_totals"] = _current(
        f"SELECT player_id, {_r(PLAYER_DOUBLES)}, ranked_play_count FROM totals"
    )
    q["player_ranks"] = _current("SELECT player_id, country, rank, country_rank FROM ranked")
    basic = [c if c in COUNTS else _r([c]) for c in BOARD_COLUMNS[:8]]
    basic[0] = '"count"'
    q["board_stats"] = _current(f"SELECT leaderboard_id, {', '.join(basic)} FROM stats")
    q["board_megametrics"] = _current(f"SELECT leaderboard_id, {_r(BOARD_COLUMNS[8:], 6)} FROM means")
    q["board_ratios"] = _current(
        f"SELECT id, {_r(('count80_ratio', 'count95_ratio', 'count95to80_ratio'))} FROM boards_ratios"
    )
    q["scores_full"] = _current(f"SELECT {_SCORE} FROM scores_full s")
    q["players_full"] = _current(f"SELECT {_PLAYER} FROM players_full")
    q["boards_full"] = _current(
        f"SELECT {BOARD_TEXT}, {_r(RATINGS)}, {_stat_columns()} FROM boards_full"
    )
    literal = _stat_columns().replace(
        _r(["pp_ratio_unfiltered"]), 'round("pp_ratio_filtered", 4) + 0.0 AS pp_ratio_unfiltered'
    )
    q["boards_full_literal"] = _current(f"SELECT {BOARD_TEXT}, {_r(RATINGS)}, {literal} FROM boards_full")
    q["podium_points"] = _current(f"""
      SELECT player_id, CAST(sum({_points_of('rank')}) AS BIGINT) AS points,
             count(*) FILTER (rank <= 3) AS podiums
      FROM scores_full GROUP BY player_id""")
    q["podium_delta"] = _both(f"""
      SELECT o.player_id, CAST(sum({_points_of('n.rank')} - {_points_of('o.rank')}) AS BIGINT) AS delta
      FROM scores_full o JOIN trial_scores_full n USING (id) GROUP BY o.player_id""")

    # whole jobs
    q["refresh_all"] = _current(_summary())
    compared = {
        "scores": ("scores_full", {"pp": True, "rank": False, "weight": True}),
        "players": ("players_full", {"pp": True, "rank": False, "country_rank": False}),
        "leaderboards": ("boards_full", {"total_pp": True, "percentile": True}),
    }
    for table, (source, columns) in compared.items():
        q[f"what_if_{table}"] = _both(_compare(source, columns))
        q[f"what_if_sweep_{table}"] = _sweep(source, columns)

    # read queries
    q["player_by_id"] = _current(f"SELECT {_PLAYER} FROM players_full WHERE id = '18'")
    q["leaderboard_by_id"] = _current(f"""
      SELECT id, name, difficulty_name, mode_name,
             {_r(('tech_rating', 'acc_rating', 'pass_rating'), 2)}, {_r(('stars',), 1)}
      FROM boards_full WHERE id = '7'""")
    q["search_like"] = _base("SELECT id, name FROM rated WHERE lower(name) LIKE '%re_ %st%'")
    q["search_contains"] = _base("SELECT id, name FROM rated WHERE contains(lower(name), 'ed rin')")
    q["search_like_indexed"] = _base("SELECT id, name FROM rated WHERE lower(name) LIKE '%ld w%g_t%'")
    q["search_contains_indexed"] = q["search_contains"]
    q["ranking_page"] = _current(
        f"SELECT {_PLAYER} FROM players_full p ORDER BY p.pp DESC, id LIMIT 50 OFFSET 50"
    )
    q["ranking_slice"] = _current(
        f"SELECT {_PLAYER} FROM players_full WHERE rank BETWEEN 101 AND 150"
    )
    q["player_page"] = _current(f"""
      SELECT {_SCORE}, b.name AS leaderboard_name, b.difficulty_name, b.mode_name,
             round(b.stars, 4) + 0.0 AS stars, b.cover
      FROM scores_full s JOIN boards_full b ON b.id = s.leaderboard_id
      WHERE player_id = '18' ORDER BY s.pp DESC, s.id LIMIT 10 OFFSET 20""")
    q["leaderboard_page"] = _current(f"""
      SELECT {_SCORE}, p.name AS player_name, p.country AS player_country, p.rank AS player_rank,
             p.avatar AS player_avatar
      FROM scores_full s JOIN players_full p ON p.id = s.player_id
      WHERE leaderboard_id = '7' ORDER BY s.pp DESC, s.id LIMIT 10 OFFSET 10""")
    q["leaderboard_slice"] = _current(f"""
      SELECT {_SCORE}, p.name AS player_name, p.country AS player_country, p.rank AS player_rank,
             p.avatar AS player_avatar
      FROM scores_full s JOIN players_full p ON p.id = s.player_id
      WHERE leaderboard_id = '7' AND s.rank BETWEEN 21 AND 30""")
    for name, direction in (("boards_by_stars", "ASC"), ("boards_by_stars_desc", "DESC")):
        q[name] = _current(f"""
          SELECT id, name, {_r(('stars',))} FROM boards_full b
          WHERE lower(name) LIKE '%ring%' ORDER BY b.stars {direction}, id LIMIT 10 OFFSET 10""")
    sort_columns = ("name", *BOARD_COLUMNS, "acc_rating", "pass_rating", "tech_rating")
    for column in (*sort_columns, "count80_ratio", "count95_ratio", "count95to80_ratio"):
        for suffix, direction in (("", "DESC"), ("_asc", "ASC")):
            q[f"stats_by_{column}{suffix}"] = _current(f"""
              SELECT {_STATS_TABLE} FROM boards_ratios b
              ORDER BY b."{column}" {direction}, id LIMIT 50""")
    for name, order in (
        ("stats_by_percentile_literal", "b.average DESC"),
        ("stats_by_count80_ratio_literal", "b.total_pp"),
    ):
        q[name] = _current(
            f"SELECT {_STATS_TABLE} FROM boards_ratios b ORDER BY {order}, id LIMIT 50"
        )
    for column in (
        "count80", "count95", "percentile", "megametric125", "megametric75", "megametric40",
        "count80_ratio", "count95_ratio", "count95to80_ratio",
    ):
        # the rest of the listing after all whole pages but, if it ends with one, the last
        q[f"stats_last_{column}"] = _current(f"""
          SELECT * EXCLUDE (place, listed) FROM (
            SELECT {_STATS_TABLE}, row_number() OVER (ORDER BY b."{column}", id) AS place,
                   count(*) OVER () AS listed FROM boards_ratios b)
          WHERE place > (listed - 1) // 50 * 50""")
    q["boards_by_stars_fenced"] = _current(
        f"SELECT id, name, {_r(('stars',))} FROM boards_full b ORDER BY b.stars, id LIMIT 10 OFFSET 140"
    )
    q["player_page_fenced"] = _current(f"""
      SELECT s.id, player_id, leaderboard_id, {_r(('pp', 'weight'))}, rank FROM scores_full s
      WHERE player_id = '18' ORDER BY s.pp DESC, id LIMIT 10 OFFSET 30""")
    q["stats_search"] = _current(f"""
      SELECT {_STATS_TABLE} FROM boards_ratios WHERE contains(lower(name), 'widget')
      ORDER BY name, id LIMIT 50 OFFSET 50""")
    percent = ("average", "count80_ratio", "count95_ratio", "count95to80_ratio")
    q["stats_report"] = _current(f"""
      SELECT id, name, "count", count80, count95, top250,
             {_r(('total_pp', 'acc_rating', 'pass_rating', 'tech_rating'), 2)},
             {_r([c for c in BOARD_COLUMNS[6:]], 3)},
             {', '.join(f'round({c} * 100, 1) + 0.0 AS {c}' for c in percent)}
      FROM boards_ratios""")
    q["score_series"] = _current("""
      SELECT s.id, leaderboard_id, player_id, round(weight, 4) + 0.0 AS weight, s.rank, timepost,
             modifiers, p.rank AS player_rank, p.name AS player_name, p.avatar AS player_avatar,
             round(accuracy * 100, 4) + 0.0 AS accuracy, round(s.pp, 4) + 0.0 AS pp, fc,
             round(fc_acc, 4) + 0.0 AS fc_acc
      FROM scores_full s JOIN players_full p ON p.id = s.player_id""")
    q["series_json"] = q["score_series"]
    q["series_json_chunks"] = f"""
      SELECT * EXCLUDE (id), CAST((place - 1) // 20 AS BIGINT) AS chunk,
             count(*) OVER (PARTITION BY leaderboard_id, (place - 1) // 20) AS entries
      FROM (SELECT *, row_number() OVER (PARTITION BY leaderboard_id ORDER BY rank, id) AS place
            FROM ({q["score_series"]}))"""
    q["compare_series"] = _current(
        _axes("rank", "pp", ", s.leaderboard_id = '3' AS is_compare", "s.leaderboard_id IN ('1', '3')")
    )
    q["score_freshness"] = _base("""
      SELECT id, CAST(floor(128 + 127 * pow(1 - least(greatest(
               (915148800 - timepost) / 20736000.0::DOUBLE, 0), 1), 3)) AS INTEGER) AS brightness
      FROM scores""")
    scale = "greatest(15.0::DOUBLE, ceil(greatest(tech_rating, pass_rating, acc_rating)))"
    shares = ", ".join(
        f"round({c}_rating / max_rating, 4) + 0.0 AS {c}_share" for c in ("tech", "pass", "acc")
    )
    q["rating_shares"] = _base(f"""
      SELECT id, max_rating, {shares} FROM (SELECT *, {scale} AS max_rating FROM rated)""")
    q["rating_shares_compare"] = _base(f"""
      SELECT id, max_rating, {shares}
      FROM (SELECT *, max({scale}) OVER () AS max_rating FROM rated WHERE id IN ('7', '15'))""")
    axes = {
        "player_rank_weight": ("playerRank", "weight"),
        "date_weighted_pp": ("date", "weightedPp"),
        "acc_rank": ("acc", "rank"),
        "fc_acc_pp": ("fcAcc", "pp"),
    }
    for label, (x, y) in axes.items():
        q[f"series_axes_{label}"] = _current(_axes(x, y))
    raw = "(100 - s.fc_acc)"
    present = f"coalesce({AXIS['weight']}, 0) <> 0"
    q["series_axes_fc_acc_literal"] = _current(_series(raw, AXIS["weight"], present))
    q["apply_updates_pruned"] = q["apply_updates"]
    # the earlier state leads to the present one
    for name, full in (("scores", "scores"), ("players", "players"), ("leaderboards", "boards")):
        q[f"refresh_delta_{name}"] = q[f"{full}_full"]
    for name in ("score_ranks", "score_weights", "player_ranks", "board_megametrics", "refresh_all"):
        q[f"{name}_split"] = q[name]
    q["ingest_dump_cut"] = q["ingest_dump"]
    q["schema_violations_observed"] = q["schema_violations"]
    for name in ("score_series", "board_stats", "board_megametrics"):
        q[f"{name}_colocated"] = q[name]
    for name in ("score_series_colocated", "board_megametrics_colocated"):
        q[f"{name}_split"] = q[name]
    return q
