"""Golden vectors of the scalar formulas."""

import math
from dataclasses import replace

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyboard.config import (
    CURVE_A,
    DEFAULT_MULTIPLIERS,
    DEFAULT_RATING,
    RANKED_MULTIPLIERS,
)
from tallyboard.functions import curves, modifiers, numbers, points, rating
from tallyboard.schema import STORED_FAMILIES, modifier_ratings_type

NAN, INF = float("nan"), float("inf")


def evaluate(spark, rows, schema, *columns):
    """One result tuple per row, in row order."""
    df = spark.createDataFrame([(i, *row) for i, row in enumerate(rows)], f"i int, {schema}")
    found = df.select("i", *columns).collect()
    return [tuple(r)[1:] for r in sorted(found)]


def test_curves(spark):
    cases = {
        1.0: (7.424, 7.424),
        0.96: (1.101, 1.094),
        0.955: (1.047, 1.039),
        0.9: (0.692, 0.729),
        0.5: (0.180833, 0.213333),
        0.01: (0.003617, 0.004267),
        0.0: (0.0, 0.0),
        -0.1: (0.0, 0.0),
        NAN: (0.0, 0.0),
        None: (0.0, 0.0),
        0.9995: (6.8325, 6.8325),
        1.001: (8.607, 8.607),
    }
    acc = F.col("acc")
    found = evaluate(
        spark, [(a,) for a in cases], "acc double", curves.curve_a(acc), curves.curve_b(acc)
    )
    for got, expected in zip(found, cases.values()):
        assert got == pytest.approx(expected, abs=1e-6)


def test_to_stars(spark):
    cases = {
        (0.0, 0.0, 0.0): 0.0,
        (5.0, 2.0, 1.0): 3.031666,
        (10.0, 8.0, 6.0): 9.373149,
        (12.5, 10.0, 9.0): 12.853652,
    }
    stars = rating.to_stars(F.col("acc"), F.col("pass"), F.col("tech"))
    found = evaluate(spark, list(cases), "acc double, pass double, tech double", stars)
    assert [f[0] for f in found] == pytest.approx(list(cases.values()), abs=1e-6)


def test_derived_acc_rating(spark):
    cases = {
        (0.97, 0.0, 0.0): 11.468591,
        (0.0, 8.0, 6.0): 9.164997,
        (0.0, 0.0, 0.0): 2.0,
        (0.995, 3.0, 3.0): 2.987905,
        (None, None, None): 2.0,
        (0.0, INF, 0.0): 0.0,
    }
    derived = rating.derived_acc_rating(F.col("pred"), F.col("pass"), F.col("tech"))
    found = evaluate(spark, list(cases), "pred double, pass double, tech double", derived)
    assert [f[0] for f in found] == pytest.approx(list(cases.values()), abs=1e-6)


def test_decay_weight(spark):
    cases = {0: 1.0, 1: 0.965, 2: 0.931225, 6: 0.807540, 7: 0.779276, 40: 0.240488}
    weight = points.decay_weight(F.col("i2"), 0.965)
    found = evaluate(spark, [(i,) for i in cases], "i2 int", weight)
    assert [f[0] for f in found] == pytest.approx(list(cases.values()), abs=1e-6)


def test_max_score_for_note(spark):
    cases = {0: 0, 1: 115, 2: 345, 5: 1035, 6: 1495, 13: 4715, 14: 5635, 100: 84755}
    found = evaluate(
        spark, [(n,) for n in cases], "n int", points.max_score_for_note(F.col("n"))
    )
    assert [f[0] for f in found] == list(cases.values())


def test_podium_points(spark):
    ranks = [None, 1, 2, 3, 4]
    found = evaluate(spark, [(r,) for r in ranks], "r int", points.score_for_rank(F.col("r")))
    assert [f[0] for f in found] == [0, 5, 3, 1, 0]
    moves = {(10, None, 1): 15, (10, 1, 2): 8, (10, 3, None): 9, (0, 7, 9): 0}
    change = points.update_rank_score(F.col("s"), F.col("old"), F.col("new"))
    found = evaluate(spark, list(moves), "s int, old int, new int", change)
    assert [f[0] for f in found] == list(moves.values())


def test_safe_substring(spark):
    cases = {("abcdef", 0, 3): "abc", ("abcdef", 4, 9): "ef", ("abc", 3, 1): "", ("", 0, 2): ""}
    for (text, start, length), expected in cases.items():
        part = numbers.safe_substring(F.col("t"), start, length)
        assert evaluate(spark, [(text,)], "t string", part) == [(expected,)]


def test_numbers(spark):
    values = [0.125, 0.375, -0.125, 2.345]
    found = evaluate(spark, [(v,) for v in values], "x double", numbers.half_even(F.col("x"), 2))
    # 2.345 * 100 is just above 234.5 in binary, so it goes up
    assert [f[0] for f in found] == [0.12, 0.38, -0.12, 2.35]
    values = [1.5, NAN, INF, -INF, None]
    found = evaluate(spark, [(v,) for v in values], "x double", numbers.finite_or_zero(F.col("x")))
    assert [f[0] for f in found] == [1.5, 0.0, 0.0, 0.0, None]
    found = evaluate(
        spark, [(1, 2), (1, 0), (0, 0)], "a int, b int", numbers.ratio(F.col("a"), F.col("b"))
    )
    assert [f[0] for f in found] == [0.5, 0.0, 0.0]
    found = evaluate(spark, [(0,), (86400,)], "s long", numbers.unix_time(F.col("s")).cast("long"))
    assert [f[0] for f in found] == [None, 86400]


def test_multipliers(spark):
    text = F.col("m")
    cases = {
        "": (1.0, 1.0, 1.0, 1.0, 1.0, ""),
        "FS": (1.4, 1.0, 1.4, 1.0, 1.0, ""),
        "SF,GN": (1.8, 1.08, 1.8, 1.0, 1.0, ""),
        "fs": (1.0, 1.0, 1.0, 1.0, 1.0, ""),
        "BFS": (1.4, 1.0, 1.4, 1.0, 1.0, ""),
        "OP,NF,SS": (-0.8, -0.5, 1.0, -0.8, 0.2, "SS,NF,OP"),
        "DA,PM": (1.0, 1.0, 1.0, 1.0, 1.0, ""),
    }
    found = evaluate(
        spark,
        [(m,) for m in cases],
        "m string",
        modifiers.total_multiplier(text, RANKED_MULTIPLIERS),
        modifiers.total_multiplier(text, RANKED_MULTIPLIERS, False),
        modifiers.positive_multiplier(text, RANKED_MULTIPLIERS),
        modifiers.negative_multiplier(text, RANKED_MULTIPLIERS),
        modifiers.negative_multiplier(text, RANKED_MULTIPLIERS, ignore_no_fail=True),
        modifiers.negative_codes(text, RANKED_MULTIPLIERS),
    )
    for got, expected in zip(found, cases.values()):
        assert got[:5] == pytest.approx(expected[:5])
        assert got[5] == expected[5]
    default = modifiers.total_multiplier(text, DEFAULT_MULTIPLIERS)
    found = evaluate(spark, [("FS",), ("NF",)], "m string", default)
    assert [f[0] for f in found] == pytest.approx([1.2, 0.5])


def test_modifier_list(spark):
    found = evaluate(
        spark, [("",), ("FS",), ("SF,GN",)], "m string", modifiers.modifier_list(F.col("m"))
    )
    assert [f[0] for f in found] == [None, ["FS"], ["SF", "GN"]]


# ---- points of a score -------------------------------------------------------

RATINGS = {"FS": (11.0, 9.0, 7.0), "SS": (8.0, 5.0, 4.0), "SF": (12.0, 11.0, 8.0)}


def _ratings(codes):
    if codes is None:
        return None
    return {
        c: None
        if c not in codes
        else {
            "predicted_acc": 0.0,
            "pass_rating": RATINGS[c][1],
            "acc_rating": RATINGS[c][0],
            "tech_rating": RATINGS[c][2],
            "stars": 0.0,
        }
        for c in STORED_FAMILIES
    }


def score_points(spark, cases, config=DEFAULT_RATING):
    schema = T.StructType(
        [
            T.StructField("i", T.IntegerType()),
            T.StructField("accuracy", T.DoubleType()),
            T.StructField("modifiers", T.StringType()),
            T.StructField("modifiers_rating", modifier_ratings_type(STORED_FAMILIES)),
            *[T.StructField(c, T.DoubleType()) for c in ("acc_rating", "pass_rating", "tech_rating")],
        ]
    )
    rows = [(i, a, m, _ratings(r), 10.0, 8.0, 6.0) for i, (a, m, r) in enumerate(cases)]
    found = rating.with_points(spark.createDataFrame(rows, schema), config).orderBy("i").collect()
    return [(r.pp, r.bonus_pp, r.pass_pp, r.acc_pp, r.tech_pp) for r in found]


ALL = tuple(STORED_FAMILIES)
GOLDEN_POINTS = {
    (0.96, "", None): (487.4037, 0, 101.7785, 348.0522, 37.5730),
    (0.96, "FS", None): (762.4057, 275.0020, 163.8131, 540.2693, 58.3233),
    (0.96, "FS", ALL): (560.0384, 72.6346, 119.4457, 395.3295, 45.2632),
    (0.96, "SF,FS", ALL): (655.9512, 168.5475, 155.0082, 447.2918, 53.6513),
    (1.0, "GN,SF", ALL): (5805.5389, 1713.7656, 280.0393, 5422.0945, 103.4052),
    (0.95, "NF", ALL): (0, 0, 0, 0, 0),
    (0.9, "NA,NB,NO,OP", None): (0, -337.3309, 0, 0, 0),
    (0.9, "BFS", ALL): (337.3309, 0, 93.4913, 213.0444, 30.7951),
    (0.9, "BFS", None): (529.3751, 192.0442, 150.5877, 330.9493, 47.8381),
    (0.85, "ss", ALL): (184.0525, -94.6898, 49.7080, 118.1109, 16.2336),
    (0.0, "", None): (0, 0, 0, 0, 0),
    (1.0001, "", None): (0, 0, 0, 0, 0),
    (NAN, "", ALL): (0, 0, 0, 0, 0),
    (None, "", ALL): (0, 0, 0, 0, 0),
}


def test_points(spark):
    found = score_points(spark, list(GOLDEN_POINTS))
    for case, got, expected in zip(GOLDEN_POINTS, found, GOLDEN_POINTS.values()):
        assert got == pytest.approx(expected, abs=1e-4), case


def test_lower_case_no_fail_counts(spark):
    plain, lower = score_points(spark, [(0.95, "", None), (0.95, "nf", None)])
    assert lower == plain and plain[0] > 0


def test_first_token_with_ratings_wins(spark):
    """A board without ratings for the first code falls through to the next."""
    both = score_points(spark, [(0.96, "SF,FS", ("FS", "SS")), (0.96, "FS", ("FS", "SS"))])
    assert both[0] == pytest.approx(both[1])


def test_constants_are_parameters(spark):
    other = replace(DEFAULT_RATING, score_curve=CURVE_A, acc_scale=17.0)
    (a,), (b,) = score_points(spark, [(0.9, "", None)]), score_points(
        spark, [(0.9, "", None)], other
    )
    assert b[0] < a[0]
    assert b[2] + b[3] + b[4] == pytest.approx(b[0])


def test_infinite_rating_gives_no_points(spark):
    huge = replace(DEFAULT_RATING, acc_scale=1e308)
    (found,) = score_points(spark, [(1.0, "", None)], huge)
    assert found[0] == 0.0 and not math.isnan(found[1])


@pytest.mark.parametrize("decimals", [3, 4, 6, 8])
def test_half_up_is_the_engines_rounding(spark, decimals):
    odd = [None, NAN, INF, -INF, 0.0, -0.0, -1e-9, 5e-324, 1e300, 123456789012.34567, 4.35, 99999.99995]
    ties = [sign * (k + 0.5) / 10**decimals for k in (0, 1, 2, 99, 12345, 10**9) for sign in (1, -1)]
    near = [math.nextafter(x, way) for x in ties for way in (INF, -INF)]
    some = [(k * 7919 % 10007) / 271.0 - 18 for k in range(2000)]
    rows = [(x,) for x in odd + ties + near + some]
    pairs = evaluate(
        spark, rows, "x double", numbers.half_up(F.col("x"), decimals), F.round("x", decimals)
    )
    assert all(repr(a) == repr(b) or a == b for a, b in pairs)
    plan = spark.range(1).select(numbers.half_up(F.col("id").cast("double"), 4))
    assert "rint" in plan._jdf.queryExecution().optimizedPlan().toString().lower()
