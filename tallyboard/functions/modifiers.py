"""Multipliers of a comma-joined modifier text.

A code counts when the text *contains* it, case-sensitively, so a longer code
such as ``BFS`` counts as ``FS`` here. Rating lookup, by contrast, compares whole
tokens and ignores case (``first_rated_code``).
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyboard.config import NO_FAIL_CODE, SPEED_CODES


def _one_plus(modifiers: Column, values: Iterable[tuple[str, float]]) -> Column:
    terms = [F.when(modifiers.contains(c), F.lit(v)).otherwise(0.0) for c, v in values if v != 0]
    return reduce(lambda total, term: total + term, terms, F.lit(1.0))


def total_multiplier(
    modifiers: Column, table: Mapping[str, float], include_speed: Column | bool = True
) -> Column:
    """1 + the values of all contained codes; speed codes only where asked for."""
    speed = include_speed if isinstance(include_speed, Column) else F.lit(include_speed)
    terms = []
    for code, value in table.items():
        if value != 0:
            counts = modifiers.contains(code)
            if code in SPEED_CODES:
                counts = counts & speed
            terms.append(F.when(counts, F.lit(value)).otherwise(0.0))
    return reduce(lambda total, term: total + term, terms, F.lit(1.0))


def positive_multiplier(modifiers: Column, table: Mapping[str, float]) -> Column:
    """1 + the positive values of the contained codes."""
    return _one_plus(modifiers, [(c, v) for c, v in table.items() if v > 0])


def negative_multiplier(
    modifiers: Column, table: Mapping[str, float], ignore_no_fail: bool = False
) -> Column:
    """1 + the negative values of the contained codes."""
    return _one_plus(
        modifiers,
        [
            (c, v)
            for c, v in table.items()
            if v < 0 and not (ignore_no_fail and c == NO_FAIL_CODE)
        ],
    )


def negative_codes(modifiers: Column, table: Mapping[str, float]) -> Column:
    """The contained codes with a negative value, comma-joined in table order."""
    return F.concat_ws(
        ",", *[F.when(modifiers.contains(c), F.lit(c)) for c, v in table.items() if v < 0]
    )


def modifier_list(modifiers: Column) -> Column:
    """The codes as an array; null for an empty text."""
    return F.when(F.length(modifiers) > 0, F.split(modifiers, ","))


def delimited(modifiers: Column) -> Column:
    """The text upper-cased, with a comma at both ends, to look for whole tokens."""
    return F.concat(F.lit(","), F.upper(modifiers), F.lit(","))


def token_spot(text: Column, code: str) -> Column:
    """Where ``code`` stands as a whole token in a delimited text; null if nowhere.

    A position instead of an array with lambdas, which would drop out of
    whole-stage code generation.
    """
    return F.nullif(F.instr(text, f",{code},"), F.lit(0))
