"""Input columns of any name beside an operator's own.

An operator that adds or needs columns of its own carries the input's in one struct, so no
name can meet another, and puts them back at the end.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def named(column: str) -> Column:
    """The column of just this name, dots and all."""
    return F.col("`" + column.replace("`", "``") + "`")


def packed(names: Sequence[str]) -> Column:
    """A struct of the columns; without any, of one that stays unused."""
    return F.struct(*[named(c) for c in names]) if names else F.struct(F.lit(0).alias("none"))


def unpacked(names: Sequence[str], struct: str) -> list[Column]:
    return [F.col(struct).getField(c).alias(c) for c in names]


def free(names: Iterable[str], taken: Iterable[str]) -> dict[str, str]:
    """For each name itself, or with underscores in front where a column has it."""
    held = {c.lower() for c in taken}
    found = {}
    for name in names:
        own = name
        while own.lower() in held:
            own = f"_{own}"
        held.add(own.lower())
        found[name] = own
    return found


def order_of(docs: DataFrame, but: Sequence[str]) -> Column:
    """What tells rows apart that agree in the columns ``but``: the others as JSON."""
    others = [c for c in docs.columns if c not in but]
    return F.to_json(packed(others)) if others else F.lit("")
