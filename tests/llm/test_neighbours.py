"""Vantage-point trees against every inner product."""

from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyboard.llm import neighbours as nb

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<double>, label int, hash string, key string, dims string"


def brute(rows, nearest=20, asked=lambda k: k % 20 == 0):
    held = defaultdict(list)
    for k, v, *_ in rows:
        if k is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            held[k].append(tuple(map(float, v)))
    one = {k: min(some) for k, some in held.items()}
    found = []
    for q in filter(asked, one):
        scored = []
        for k, v in one.items():
            if k != q and len(v) == len(one[q]):
                score = 0.0
                for a, b in zip(one[q], v):
                    score += a * b
                scored.append((-score, k))
        found += [(q, r + 1, k, -s) for r, (s, k) in enumerate(sorted(scored)[:nearest])]
    return sorted(found)


def found(spark, rows, nearest=20, **settings):
    df = spark.createDataFrame(rows, SCHEMA)
    got = nb.nearest_neighbours(df, df.filter("vec_id % 20 = 0"), nearest, **settings)
    return sorted(map(tuple, got.collect()))


def row(k, v):
    return (k, v, 1, "h", "k", "d")


def odd():
    inf, nan = float("inf"), float("nan")
    rng = np.random.default_rng(3)
    small = rng.integers(-2, 3, (130, 3)).astype(float).tolist()  # many ties and zero vectors
    rows = [row(k, v) for k, v in enumerate(small)]
    rows += [row(k, [0.5, 0.25, 0.0]) for k in range(200, 290)]  # a large group of copies
    rows += [row(k, [1.0, 2.0]) for k in (300, 301, 320)] + [row(400, [7.0])]  # other lengths
    bad = (None, [], [0.0, 0.0, -0.0], [1.0, None, 2.0], [nan, 1.0, 1.0], [inf, 1.0, 1.0])
    rows += [row(500 + 20 * k, v) for k, v in enumerate(bad)]
    rows += [row(None, [1.0, 1.0, 1.0]), row(700, [1e3, 1e3, -1e3])]
    rows += [row(720, [1.0, 1.0, 0.0])] * 3 + [row(720, [1.0, 0.0, 1.0]), row(-40, [0.0, 1.0, 1.0])]
    return rows


@pytest.mark.parametrize("settings", [{}, {"shard_rows": 20}])
def test_edges(spark, monkeypatch, settings):
    monkeypatch.setattr(nb, "BLOCK_QUERIES", 5)
    assert found(spark, odd(), **settings) == brute(odd())


def test_few_and_empty(spark):
    assert found(spark, []) == []
    assert found(spark, [row(20, [1.0, 2.0])]) == []
    two = [row(20, [1.0, 2.0]), row(21, [2.0, 2.0])]
    assert found(spark, two) == [(20, 1, 21, 6.0)]


def searched(x, q, nearest, factor, leaf):
    order, rings = nb.lay_out(x, leaf)
    search = nb.Search(x[order], order, rings, q, np.full(len(q), -np.inf), nearest, factor, leaf)
    search.run()
    return search, [[int(order[r]) for r in row if r >= 0] for row in search.row]


def plain(x, q, nearest):
    score = np.cumsum(q[:, None, :] * x[None], axis=2)[:, :, -1]
    return [np.lexsort((np.arange(len(x)), -s))[:nearest].tolist() for s in score]


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10_000), st.sampled_from([2, 3, 8]), st.sampled_from(["ball", "grid", "norms"]))
def test_factor_one_is_exact(seed, leaf, kind):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(rng.integers(1, 200), 4))
    if kind == "grid":
        x = np.round(x)
    if kind == "norms":
        x *= np.exp(2 * rng.normal(size=(len(x), 1)))
    q = np.concatenate([x[:5], np.round(rng.normal(size=(5, 4)))])
    assert searched(x, q, 7, 1.0, leaf)[1] == plain(x, q, 7)


def test_pruning_and_recall():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 16)) * 4
    x = (centres[:, None] + rng.normal(size=(40, 100, 16)) * 0.4).reshape(-1, 16)
    x /= np.linalg.norm(x, axis=1)[:, None]
    q = x[::40]
    wanted = plain(x, q, 20)
    shares, recalls = [], []
    for factor in (1.0, 2.0, 8.0):
        search, got = searched(x, q, 20, factor, 64)
        shares.append(search.scored / len(q) / len(x))
        recalls.append(np.mean([len(set(a) & set(b)) / 20 for a, b in zip(got, wanted)]))
    assert recalls[0] == 1 and recalls[1] >= 0.9
    assert shares[0] < 0.5 and shares[0] > shares[1] > shares[2]


def test_recall_of_relaxed_search(spark):
    """Against every inner product of the table, with shards of a hundred rows."""
    rows = spark.read.parquet(f"{SF}/embeddings.parquet")
    asked = rows.filter("vec_id % 20 = 0")
    exact = {(r.query_id, r.vec_id) for r in nb.nearest_neighbours(rows, asked).collect()}
    relaxed = nb.nearest_neighbours(rows, asked, factor=4.0, shard_rows=100).collect()
    hits = sum((r.query_id, r.vec_id) in exact for r in relaxed)
    assert len(relaxed) == len(exact) and hits / len(exact) >= 0.9


def test_copies_are_one_entry(spark):
    rows = nb.usable(spark.createDataFrame(odd(), SCHEMA))
    held = nb.distinct_vectors(rows, 20).filter(F.array_contains("ids", 200)).collect()
    assert [r.ids for r in held] == [list(range(200, 221))]
