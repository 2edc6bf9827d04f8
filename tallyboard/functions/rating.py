"""Point and difficulty formulas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyboard.config import DEFAULT_RATING, NO_FAIL_CODE, SPEED_CODES, RatingConfig
from tallyboard.functions.curves import piecewise_linear, segment_of, value_on
from tallyboard.functions.modifiers import delimited, token_spot, total_multiplier
from tallyboard.functions.numbers import finite_or_zero


def inflate(points: Column, config: RatingConfig = DEFAULT_RATING) -> Column:
    """Stretch summed points by a power, keeping ``inflate_base`` fixed."""
    scale = config.inflate_base / config.inflate_base**config.inflate_power
    return F.pow(points, F.lit(config.inflate_power)) * scale


def _pass_raw(pass_rating: Column, config: RatingConfig) -> Column:
    root = F.pow(pass_rating, F.lit(1.0 / config.pass_root))
    return F.exp(root) * config.pass_scale - config.pass_shift


def _not_below_zero(points: Column) -> Column:
    return F.greatest(finite_or_zero(points), F.lit(0.0))


def pass_points(pass_rating: Column, config: RatingConfig = DEFAULT_RATING) -> Column:
    """Points for finishing; 0 where the formula is negative or not finite."""
    return _not_below_zero(_pass_raw(pass_rating, config))


def acc_points(
    curve_value: Column, acc_rating: Column, config: RatingConfig = DEFAULT_RATING
) -> Column:
    """Points for accuracy, given the accuracy's value on the score curve."""
    return curve_value * acc_rating * config.acc_scale


def tech_points(
    accuracy: Column, tech_rating: Column, config: RatingConfig = DEFAULT_RATING
) -> Column:
    """Points for technique."""
    return F.exp(accuracy * config.tech_growth) * config.tech_scale * tech_rating


def pp_components(
    accuracy: Column,
    acc_rating: Column,
    pass_rating: Column,
    tech_rating: Column,
    config: RatingConfig = DEFAULT_RATING,
) -> tuple[Column, Column, Column]:
    """(pass, acc, tech) points of one accuracy under one set of ratings."""
    return (
        pass_points(pass_rating, config),
        acc_points(piecewise_linear(accuracy, config.score_curve), acc_rating, config),
        tech_points(accuracy, tech_rating, config),
    )


def to_stars(
    acc_rating: Column,
    pass_rating: Column,
    tech_rating: Column,
    config: RatingConfig = DEFAULT_RATING,
) -> Column:
    """Overall difficulty: inflated points at the reference accuracy."""
    passing, acc, tech = pp_components(
        F.lit(config.star_accuracy), acc_rating, pass_rating, tech_rating, config
    )
    return inflate(passing + acc + tech, config) / config.star_divisor


def derived_acc_rating(
    predicted_acc: Column,
    pass_rating: Column,
    tech_rating: Column,
    config: RatingConfig = DEFAULT_RATING,
) -> Column:
    """Accuracy difficulty from a predicted accuracy, else from pass and tech."""
    predicted, passing, tech = (
        F.coalesce(c, F.lit(0.0)) for c in (predicted_acc, pass_rating, tech_rating)
    )
    on_curve = piecewise_linear(predicted + config.predicted_shift, config.prediction_curve)
    base = tech * config.derived_tech_slope + config.derived_tech_base
    estimate = (
        (F.lit(1.0) - F.pow(base, -passing)) * config.derived_span
        + config.derived_floor
        + tech * passing * config.derived_cross
    )
    from_prediction = F.lit(config.predicted_numerator) / F.nullif(on_curve, F.lit(0.0))
    rating = F.when(predicted > 0, F.coalesce(from_prediction, F.lit(0.0))).otherwise(estimate)
    return finite_or_zero(rating)


_RATING_FIELDS = ("acc_rating", "pass_rating", "tech_rating")


def with_points(df: DataFrame, config: RatingConfig = DEFAULT_RATING) -> DataFrame:
    """Add pp, bonus_pp, pass_pp, acc_pp and tech_pp to score rows.

    ``df`` needs accuracy, modifiers, modifiers_rating (nullable struct with one
    family per speed code), acc_rating, pass_rating and tech_rating.

    The formula is laid out in steps, each a projection that names what the next
    one uses more than once. So nothing is computed twice in a row, and all steps
    fit one generated method small enough for the JVM to compile. The helper
    columns are dropped at the end and pruned in between.
    """
    ratings, keep = F.col("modifiers_rating"), df.columns
    zero = F.lit(0.0)

    # inputs without nulls: the generated arithmetic needs no checks after this
    staged = df.withColumns(
        {f"_{c}": F.coalesce(c, zero) for c in ("accuracy", *_RATING_FIELDS)}
        | {"_modifiers": F.coalesce("modifiers", F.lit(""))}
    )
    accuracy, modifiers = F.col("_accuracy"), F.col("_modifiers")
    acc_rating, tech_rating = F.col("_acc_rating"), F.col("_tech_rating")

    # which segment of the curve, and where the speed codes stand in the text
    counts = ~F.isnan(accuracy) & (accuracy > 0) & (accuracy <= 1)
    multipliers = {c: v for c, v in config.multipliers if c != NO_FAIL_CODE}
    staged = staged.withColumns(
        {
            "_counts": counts & ~modifiers.contains(NO_FAIL_CODE),
            "_segment": segment_of(accuracy, config.score_curve),
            "_text": delimited(modifiers),
            "_mp": total_multiplier(modifiers, multipliers, ratings.isNull()),
        }
    )
    text, mp = F.col("_text"), F.col("_mp")
    staged = staged.withColumns(
        {
            "_curve": value_on(F.col("_segment"), accuracy, config.score_curve),
            "_tech_unit": tech_points(accuracy, F.lit(1.0), config),
        }
        | {f"_{code}": token_spot(text, code) for code in SPEED_CODES}
    )
    curve, tech_unit = F.col("_curve"), F.col("_tech_unit")

    # the board's own ratings for the first speed code it has them for
    spots = {code: F.col(f"_{code}") for code in SPEED_CODES}
    rated = [F.when(ratings[code].isNotNull(), spot) for code, spot in spots.items()]
    staged = staged.withColumn("_first", F.least(*rated))
    first, family = F.col("_first"), F
    for code, spot in spots.items():
        family = family.when(spot == first, ratings[code])
    staged = staged.withColumn("_family", family)
    family = F.col("_family")

    def chosen(field: str) -> Column:
        return F.coalesce(family[field], F.col(f"_{field}")) * mp

    staged = staged.withColumns(
        {
            "_raw_pass": _pass_raw(F.col("_pass_rating"), config),
            "_own_pass": _pass_raw(chosen("pass_rating"), config),
            "_acc": acc_points(curve, chosen("acc_rating"), config),
            "_tech": tech_unit * chosen("tech_rating"),
        }
    )
    raw_sum = (
        _not_below_zero(F.col("_raw_pass"))
        + acc_points(curve, acc_rating, config)
        + tech_unit * tech_rating
    )
    staged = staged.withColumns(
        {"_raw_sum": raw_sum, "_pass": _not_below_zero(F.col("_own_pass"))}
    )
    parts = {name: F.col(f"_{name}") for name in ("pass", "acc", "tech")}
    staged = staged.withColumns(
        {
            "_raw": inflate(F.col("_raw_sum"), config),
            "_sum": parts["pass"] + parts["acc"] + parts["tech"],
        }
    )
    counts, total, full, raw = (F.col(c) for c in ("_counts", "_sum", "_full", "_raw"))
    staged = staged.withColumn("_full", inflate(total, config))
    staged = staged.withColumns(
        {
            "_increase": F.when(counts & (total > 0), full / total),
            "_full": F.when(counts, finite_or_zero(full)),
            "_raw": F.when(counts, finite_or_zero(raw)),
        }
    )
    increase = F.col("_increase")
    return staged.select(
        *keep,
        F.coalesce(full, zero).alias("pp"),
        F.coalesce(full - raw, zero).alias("bonus_pp"),
        *[F.coalesce(c * increase, zero).alias(f"{name}_pp") for name, c in parts.items()],
    )
