"""The quality model against dense, plain computations."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyboard.llm import quality


def _plain_isotonic(outputs, labels):
    """At each distinct output the max over starts of the min over ends of the mean label."""
    at = np.unique(outputs)
    found = []
    for x in at:
        lows, highs = at[at <= x], at[at >= x]
        found.append(
            max(min(labels[(outputs >= a) & (outputs <= b)].mean() for b in highs) for a in lows)
        )
    return at, np.array(found)


@given(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 1)), min_size=1, max_size=30))
@settings(max_examples=200, deadline=None)
def test_isotonic_is_the_max_of_min_means(pairs):
    outputs = np.array([float(p[0]) for p in pairs])
    labels = np.array([p[1] for p in pairs])
    at, expected = _plain_isotonic(outputs, labels)
    assert np.interp(at, *quality.isotonic(outputs, labels)) == pytest.approx(expected)


def test_fit_is_one_dense_ridge_solution(spark):
    random = np.random.default_rng(3)
    rows = random.normal(0, 2, (600, quality.STATISTICS))
    rows[:, 4] = 7.0  # a statistic without deviation
    labels = (rows[:, 0] + random.normal(0, 1, 600) > 0).astype(int)
    fold = np.arange(600) % 4
    labelled = spark.createDataFrame(
        [(rows[i].tolist(), int(labels[i]), int(fold[i])) for i in range(600)],
        "stats array<double>, quality int, fold int",
    ).repartition(7)
    features = 40
    model = quality.fit(labelled, features)

    train, last = fold != 3, fold == 3
    drawn = np.random.default_rng(quality.SEED)
    frequency = drawn.normal(0, np.sqrt(1 / quality.STATISTICS), (quality.STATISTICS, features))
    phase = drawn.uniform(0, 2 * np.pi, features)
    mean, deviation = rows[train].mean(0), rows[train].std(0)
    plain = np.clip((rows - mean) / np.where(deviation > 1e-9, deviation, 1), -8, 8)
    waves = np.array([[np.sqrt(2 / features) * np.cos(r @ w + p) for w, p in zip(frequency.T, phase)]
                      for r in plain])
    z = np.hstack([waves, np.ones((600, 1))])
    # ridge as least squares with a row for each weight
    tall = np.vstack([z[train], np.sqrt(quality.RIDGE) * np.eye(features + 1)])
    goal = np.concatenate([labels[train], np.zeros(features + 1)])
    weights = np.linalg.lstsq(tall, goal, rcond=None)[0]
    assert model.weights == pytest.approx(weights, abs=1e-7)

    outputs = z @ weights
    at, value = _plain_isotonic(outputs[last], labels[last])
    calibrated = np.interp(at, at, value)
    scores = model.score(rows)
    share = quality.ORDER_SHARE
    for x, c in zip(at, calibrated):
        i = int(np.flatnonzero(last & (outputs == x))[0])
        assert scores[i] == pytest.approx((1 - share) * c + share * np.clip(x, 0, 1), abs=1e-6)


def test_the_kernel_is_approximated():
    """Products of features tend to the Gaussian kernel of the standardised statistics."""
    random = np.random.default_rng(5)
    size, features = quality.STATISTICS, 20000
    frequency = random.normal(0, np.sqrt(1 / size), (size, features))
    project = quality.Projection(
        np.zeros(size), np.ones(size), frequency, random.uniform(0, 2 * np.pi, features)
    )
    rows = random.normal(0, 1, (20, size))
    waves = project(rows)[:, :-1]
    apart = ((rows[:, None] - rows[None]) ** 2).sum(2)
    assert waves @ waves.T == pytest.approx(np.exp(-apart / (2 * size)), abs=0.05)
