"""Periodic runs against a plain search for every period."""

import hashlib
import zlib
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyboard.llm import runs

SF = "/root/testdata/sf0.001"


def brute(w, words=24, periods=3):
    """Every stretch of equal words q apart; the smallest q of each stretch."""
    n, found = len(w), {}
    for q in range(1, n // periods + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(words, periods * q):
                found.setdefault((i, j - i + q), q)
            i = j
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def expected(doc_id, text):
    w = (text or "").encode().split()
    n = len(w)
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = brute(w)
    gone = {k for s, n, q in found for k in range(s + q, s + n)}
    best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None,) * 3)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (
        doc_id,
        len(found),
        *best,
        1000 * best[1] // best[2] if found else None,
        sha("".join("%d,%d,%d\n" % r for r in found).encode()),
        sha(b" ".join(x for k, x in enumerate(w) if k not in gone)),
    )


words_of = st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=12)
texts_of = st.lists(st.tuples(words_of, st.integers(1, 9)), max_size=5).map(
    lambda parts: [w for block, times in parts for w in block * times]
)


@settings(max_examples=300, deadline=None)
@given(st.lists(texts_of, max_size=4), st.sampled_from([(24, 3), (6, 3), (3, 3), (9, 4)]))
def test_runs_are_all_found(texts, limits):
    assert runs.find_runs(texts, *limits) == [brute(t, *limits) for t in texts]


def test_long_texts():
    block = [b"%d" % k for k in range(700)]
    assert runs.find_runs([[b"a"] * 50_000, block * 60 + [b"x"]]) == [
        [(0, 50_000, 1)],
        [(0, 42_000, 700)],
    ]


def test_two_periods_are_too_few():
    with pytest.raises(ValueError):
        runs.find_runs([], 24, 2)


ODD = [
    (1, None, 1),
    (2, "", 1),
    (3, " \t\n ", 1),
    (4, "a b " * 12, 1),
    (4, "a b " * 12, 1),
    (5, "a b " * 11 + "a", 2),
    (6, "a b c\x0bd\x1fe " * 9, 2),
    (7, " ".join(["x"] * 30 + ["y z"] * 20 + ["x"] * 30), 3),  # two runs of one exponent
    (None, "q " * 40, 3),
    (9, " ".join(f"w{k % 50}" for k in range(60_000)), None),
    # the query rewrites some of these
    *[(k, " ".join(f"w{j}" for j in range(k + 30)), 4) for k in range(20, 60)],
]


def test_query_rows(spark):
    docs = spark.createDataFrame(ODD, "doc_id long, text string, found int")
    docs = docs.withColumns({"words": F.lit("w"), "a": F.lit(1), "n": F.lit(2), "share": F.lit(3)})
    found = runs.describe(
        runs.with_repeats(docs).select("doc_id", runs.repetition(F.col("text")).alias("found"))
    )
    key = lambda r: (r[0] is None, r[0] or 0, r[6])
    wanted = sorted((expected(k, t) for k, t, _ in ODD if k != 9), key=key)
    rows = sorted(map(tuple, found.collect()), key=key)
    assert [r for r in rows if r[0] != 9] == wanted
    assert [r[1:5] for r in rows if r[0] == 9] == [(1, 0, 60_000, 50)]
    assert sum(zlib.crc32(str(k).encode()) % 10 == 0 for k in range(20, 60)) > 2
    empty = runs.with_repeats(docs.limit(0))
    assert runs.describe(empty.select("doc_id", runs.repetition(F.col("text")).alias("found"))).count() == 0


def test_whole_table(spark):
    texts = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    rows = {r[0]: tuple(r) for r in runs.query(spark, SF).collect()}
    assert len(rows) == len(texts)
    short = [r for r in texts if len(r.text or "") < 12_000]
    assert [rows[r.doc_id] for r in short] == [expected(*r) for r in short]
    assert sum(rows[r.doc_id][1] > 0 for r in short) > 5
