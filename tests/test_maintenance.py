"""Updates, change detection and constraint reports."""

from tallyboard.operators import integrity, podium, updates
from tallyboard.operators.scores import modifier_table_diff, modifier_usage

PLAYERS = "id string, name string, country string, avatar string"
BOARDS = (
    "id string, name string, hash string, song_id string, mode_name string,"
    " difficulty_name string, cover string, mapper string, stars double, pass_rating double,"
    " acc_rating double, tech_rating double, predicted_acc double"
)
SCORES = (
    "id long, timepost long, player_id string, leaderboard_id string, accuracy double,"
    " modifiers string, fc boolean, fc_acc double"
)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_apply_updates(spark):
    target = spark.createDataFrame([("a", 1, 10), ("b", 2, 20)], "id string, x int, y int")
    changes = spark.createDataFrame([("a", None, 99), ("z", 5, 5)], "id string, x int, y int")
    # only the listed column, matched rows only, nulls are values
    assert rows(updates.apply_updates(target, changes, ["x"])) == [("a", None, 10), ("b", 2, 20)]
    assert updates.apply_updates(target, changes, ["x"]).columns == target.columns


def test_changed_values(spark):
    old = spark.createDataFrame(
        [(1, 0.5), (2, 0.5), (3, None), (4, None), (6, 0.5)], "id int, weight double"
    )
    new = spark.createDataFrame(
        [(1, 0.5 + 1e-12), (2, 0.6), (3, 0.5), (4, None), (5, 1.0)], "id int, weight double"
    )
    assert rows(updates.changed_weights(old, new)) == [(2, 0.6), (3, 0.5), (5, 1.0)]


def test_schema_violations(spark):
    tables = {
        "players": spark.createDataFrame(
            [("1", "x" * 51, None, ""), ("2", "ok", "TOOLONG", ""), (None, "ok", "NO", "")], PLAYERS
        ),
        "scores": spark.createDataFrame(
            [(1, 0, "p" * 26, "b", 0.5, None, True, 0.5)], SCORES
        ),
        "leaderboards": spark.createDataFrame(
            [("b", "n", "h", "s", "m", "d", "c", "m" * 201, 0.0, 0.0, None, 0.0, 0.0)], BOARDS
        ),
    }
    assert rows(integrity.schema_violations(tables)) == [
        ("leaderboards", "acc_rating", "not null", 1),
        ("leaderboards", "mapper", "max length 200", 1),
        ("players", "country", "max length 5", 1),
        ("players", "country", "not null", 1),
        ("players", "id", "not null", 1),
        ("players", "name", "max length 50", 1),
        ("scores", "modifiers", "not null", 1),
        ("scores", "player_id", "max length 25", 1),
    ]


def test_null_computed_values_break_the_schema(spark):
    players = spark.createDataFrame(
        [("1", "a", "NO", "", None), ("2", "b", "NO", "", 1.0)], PLAYERS + ", pp double"
    )
    family = "struct<predicted_acc:double,pass_rating:double,acc_rating:double,tech_rating:double,stars:double>"
    whole, broken = (1.0,) * 5, (1.0, 1.0, None, 1.0, 1.0)
    values = ("n", "h", "s", "m", "d", "c", "m", 0.0, 0.0, 0.0, 0.0, 0.0)
    boards = spark.createDataFrame(
        [("a", *values, (whole, broken, whole)), ("b", *values, None)],
        f"{BOARDS}, modifiers_rating struct<FS:{family},SS:{family},SF:{family}>",
    )
    assert rows(integrity.schema_violations({"players": players, "leaderboards": boards})) == [
        ("leaderboards", "modifiers_rating.SS.acc_rating", "not null", 1),
        ("players", "pp", "not null", 1),
    ]


def _three_tables(spark):
    scores = spark.createDataFrame(
        [(1, "p1", "b1"), (2, "p1", "b9"), (3, "p9", "b1"), (4, "p9", "b9")],
        "id long, player_id string, leaderboard_id string",
    )
    players = spark.createDataFrame([("p1",), ("p2",)], "id string")
    boards = spark.createDataFrame([("b1",)], "id string")
    return scores, players, boards


def test_orphans(spark):
    assert rows(integrity.orphan_scores(*_three_tables(spark))) == [
        (2, "leaderboard"),
        (3, "player"),
        (4, "leaderboard"),
        (4, "player"),
    ]


def test_cascade(spark):
    scores, players, boards = _three_tables(spark)
    assert [r[0] for r in rows(integrity.cascade_delete(scores, players=players).select("id"))] == [3, 4]
    assert [r[0] for r in rows(integrity.cascade_delete(scores, boards=boards).select("id"))] == [2, 4]
    both = integrity.cascade_delete(scores, players, boards).select("id")
    assert [r[0] for r in rows(both)] == [4]
    assert integrity.cascade_delete(scores).count() == 4


def test_duplicates(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "id int, k string")
    assert rows(integrity.duplicate_keys(df)) == [(1, 2)]
    assert rows(integrity.duplicate_keys(df, ["k"])) == [("a", 2)]


def test_podium(spark):
    schema = "id int, player_id string, rank int"
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 2), (3, "c", 9)], schema)
    new = spark.createDataFrame([(1, "a", 3), (3, "c", 1), (4, "b", 2)], schema)
    assert rows(podium.podium_points(old)) == [("a", 5, 1), ("b", 3, 1), ("c", 0, 0)]
    # b lost score 2 and gained score 4
    assert rows(podium.podium_delta(old, new)) == [("a", -4), ("b", 0), ("c", 5)]


def test_modifier_usage(spark):
    df = spark.createDataFrame(
        [("", 1.0), ("FS", 10.0), ("FS,GN", 20.0), ("GN", 5.0)], "modifiers string, pp double"
    )
    assert rows(modifier_usage(df)) == [("FS", 2, 15.0), ("GN", 2, 12.5)]


def test_modifier_table_diff(spark):
    df = spark.createDataFrame([("FS",), ("BFS",), ("NF,GN",)], "modifiers string")
    found = modifier_table_diff(df, {"FS": 0.2, "GN": 0.1}, {"FS": 0.4, "GN": 0.1, "NF": -1.0})
    assert rows(found.select("code", "old_value", "new_value", "scores", "same")) == [
        ("FS", 0.2, 0.4, 2, False),
        ("GN", 0.1, 0.1, 1, True),
        ("NF", None, -1.0, 1, False),
    ]
