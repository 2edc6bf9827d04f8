"""Documents in ascending order of id, dealt out in ranges.

Bounds come from approximate quantiles of the id, one range per shuffle partition,
so a range holds about as many rows as any other. The rows of a range meet in one
partition, sorted by id, then by a hash of the text. A null id comes first.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_FIRST = -(1 << 63)


def order_key(doc_id: str = "doc_id") -> Column:
    """The id as a long that sorts a null first."""
    return F.coalesce(F.col(doc_id).cast("long"), F.lit(_FIRST))


def bounds(docs: DataFrame) -> list[int]:
    """Lowest ids of all ranges but the first."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if n < 2:
        return []
    cuts = docs.agg(
        F.percentile_approx(order_key(), [k / n for k in range(1, n)], max(10_000, 20 * n))
    ).first()[0]
    return sorted(set(cuts or []))


def range_of(key: Column, cuts: list[int]) -> Column:
    """The range of an order key; ids below the first bound are in range 0."""
    edges = np.array(cuts, np.int64)

    @F.pandas_udf("int")
    def place(keys: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, keys.to_numpy(np.int64), "right").astype(np.int32))

    return place(key) if cuts else F.lit(0)


def range_of_id(key: int, cuts: list[int]) -> int:
    return bisect_right(cuts, key)
