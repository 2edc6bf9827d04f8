"""The prefix trie against rebuilt conversations held as lists of texts."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tallyboard.config import SkewPolicy
from tallyboard.llm import conversations as cv

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string, depth long, words long, member string"


def rebuild(rows):
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [r[2:] for r in sorted(turns, key=lambda r: r[:2])] for c, turns in own.items()}
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = own.get(c - int(math.fmod(c, 20)), [])[:h] + turns[h:]
    return rebuilt


def brute(rows):
    rebuilt = rebuild(rows)
    members = defaultdict(list)
    for c in sorted(rebuilt):
        for d in range(len(rebuilt[c]) + 1):
            members[tuple(rebuilt[c][:d])].append(c)
    children = Counter(k[:-1] for k in members if k)
    leaves, saved = Counter(), Counter()
    for k, some in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
        for d in range(len(k) + 1):
            leaves[k[:d]] += children[k] == 0
            saved[k[:d]] += (len(some) - 1) * words
    sha = lambda k, some: hashlib.sha256(
        ",".join(str(c) for c in some if len(rebuilt[c]) == len(k)).encode()
    ).hexdigest()
    return sorted(
        (some[0], len(k), members[k[:-1]][0] if k else -1, len(some), children[k], leaves[k], saved[k], sha(k, some))
        for k, some in members.items()
    )


def found(spark, rows, **settings):
    df = spark.createDataFrame(rows, SCHEMA)
    result = cv.describe(cv.trie(df, cv.block_base(), cv.hashed_head(), **settings))
    return sorted((r[0], r[1], -1 if r[2] is None else r[2], *r[3:]) for r in map(tuple, result.collect()))


def made():
    rows = []
    for c in [*range(0, 70), 205, 206, 207, 401]:  # some have no base
        for turn in range(c % 6 + (c == 5) * 40):
            text = f"text {turn} of" if (c % 20 + turn) % 3 else f"text {turn} {c % 2}"
            rows.append((c, turn, "user" if turn % 2 else None, text, 1, 2, "x"))
    rows += [(60 + k, t, "user", "the same", None, None, None) for k in range(21, 30) for t in range(3)]
    rows += [
        (500, None, "user", "null turn comes first", 1, 1, "m"),
        (500, 3, None, None, 1, 1, "m"),
        (500, 4, "", "", 1, 1, "m"),
        (501, 0, "user", "", 1, 1, "m"),
        (502, 0, "use", "r", 1, 1, "m"),
        (503, 0, "user", "long " * 20_000, 1, 1, "m"),
        (None, 1, "user", "no conversation", 1, 1, "m"),
        (540, 1, "user", "twice", 1, 1, "m"),
        (540, 1, "user", "twice", 1, 1, "m"),
        (-27, 1, "user", "below", 1, 1, "m"),
        (-20, 1, "user", "zero", 1, 1, "m"),
    ]
    return rows


def test_nodes(spark):
    rows = made()
    assert {c for c, turns in rebuild(rows).items() if not turns}
    assert found(spark, rows) == brute(rows)


def test_ties_have_one_order(spark):
    rows = [(c, 1, "user", t, 0, 0, "") for c in (0, 1, 2, 3, 4, 5) for t in ("b", "a", "c")]
    once = found(spark, rows)
    assert once == found(spark, rows[::-1])
    assert max(r[1] for r in once) == 3


def test_empty(spark):
    assert found(spark, []) == []


def test_other_ways_give_the_same(spark, monkeypatch):
    rows = made()
    wanted = brute(rows)
    monkeypatch.setattr(cv, "CHUNK_TURNS", 2)
    assert found(spark, rows, policy=SkewPolicy(hot_rows=4, chunk_rows=8, broadcast_rows=0)) == wanted


def test_equal_digests_of_different_turns(spark):
    def weak(role, text):
        return [F.length(text).cast("long") % 3, F.length(role).cast("long") % 2]

    # the order of ties follows the digest, so rows have none
    rows = [r for r in made() if r[0] != 540]
    assert found(spark, rows, digests=weak) == brute(rows)


def test_equal_fingerprints_of_different_prefixes(spark, monkeypatch):
    monkeypatch.setattr(cv, "PRIME", 13)
    rows = made()
    assert found(spark, rows, lanes=1) == brute(rows)


def test_products_combine():
    lane, parts = 0, [5, 11, 7]

    def product(values):
        shift = [pow(cv._base(lane), k, cv.PRIME) for k in range(len(values) + 1)]
        return sum(v * s for v, s in zip(values, shift)) % cv.PRIME, shift[-1]

    a, b = product(parts[:1]), product(parts[1:])
    joined = cv.Product(*a).then(cv.Product(*b))
    assert (joined.total, joined.shift) == product(parts)


@pytest.mark.parametrize("bits", [0, 1, 16])
def test_members_in_pieces(spark, bits):
    ends = [(1, 0, m) for m in (9, 10, 100, -3, 2)] + [(7, 2, 7)]
    got = cv.member_digests(spark.createDataFrame(ends, "conv_id long, depth long, member long"), bits)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert sorted(map(tuple, got.collect())) == [(1, 0, sha("-3,2,9,10,100")), (7, 2, sha("7"))]


def test_turns_are_referred_to(spark):
    nodes = cv.trie(spark.createDataFrame(made(), SCHEMA), cv.block_base(), cv.hashed_head()).nodes
    rebuilt, own = rebuild(made()), rebuild([])
    for r in made():
        if r[0] is not None:
            own.setdefault(r[0], []).append((r[1] or 0, r[2] or "", r[3] or ""))
    for r in nodes.filter("depth > 0").collect():
        turn = sorted(own[r.turn_conv], key=lambda x: x[0])[r.turn_place - 1]
        if r.turn_conv not in (500, 540):
            assert turn[1:] == rebuilt[r.conv_id][r.depth - 1]


def test_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()]
    result = sorted((r[0], r[1], -1 if r[2] is None else r[2], *r[3:]) for r in map(tuple, cv.query(spark, SF).collect()))
    assert result == brute(rows)
