"""Periodic runs of words, found as maximal pairs in a tree of LCP intervals.

A run is a stretch of words with smallest period q, at least ``periods`` times as long
as q and at least ``words`` long, which no neighbouring word extends. Two places q words
apart whose longest common extension has l words, and which follow different words, mark
exactly the stretch of l + q words from the first of them: left and right ends are known
from the pair alone. So every run is a maximal pair with q <= l / (periods - 1), and
every such pair is a run once multiples of a period are set aside.

The tree is built bottom-up over the suffixes in order. Each node keeps the places of its
suffixes in ascending order and the classes of words before them. Where two children meet,
places of the smaller one are put into the list of the larger one and held against their
neighbours there: with a smallest period q no third place lies between, so no further pairs
need be listed. Children whose places all follow the same one word hold no maximal pair.
Only suffixes that share their first words with another one of the text (16 words for runs
of 24 words and three periods) enter the tree; the others are below its lowest useful depth.

Each text is treated whole by one task, documents are never moved. Memory follows the
longest text of a lot, work n log n of its words.

Edge cases: a null or empty text, and one without words, has no runs and collapses to the
empty text. Words are runs of bytes other than ASCII white space. A null doc_id is rewritten
by no rule of the query. Repeated rows are treated alike; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS = 24
PERIODS = 3
#: Words that are treated at a time, if no single text has more.
LOT_WORDS = 500_000
_SPACES = r"[\x20\x09-\x0D]+"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_FOUND = pa.struct([("n_words", pa.int64()), ("runs", pa.list_(_RUN)), ("collapsed", pa.string())])
_DDL = "n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"

Run = tuple[int, int, int]


def _ordered(ids: np.ndarray, ends: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes that share ``least`` words with another of their text, in order, and
    whether each shares them with the one before it.

    ``ids`` are words as numbers that differ between texts; ``ends`` has for each place
    the end of its text. Ranks are places of a class in the order, so what is settled
    keeps its rank while the others are told apart by twice as many words.
    """
    n = len(ids)
    order = np.argsort(ids, kind="stable")
    sorted_ids = ids[order]
    first = np.append(True, sorted_ids[1:] != sorted_ids[:-1])
    starts = np.flatnonzero(first)
    rank = np.empty(n, np.int64)
    rank[order] = starts[np.cumsum(first) - 1]
    known, kept, shared = 1, None, None
    while True:
        sizes = np.bincount(rank, minlength=n)
        active = np.flatnonzero(sizes[rank] > 1)
        if kept is None and 2 * known > least:
            # classes by 'least' words: two overlapping windows of 'known' words
            if known < least:
                active, rank = _refined(rank, active, ends, least - known)
                known = least
                continue
            kept, shared = active, rank.copy()
        if not len(active):
            break
        active, rank = _refined(rank, active, ends, known)
        known *= 2
    kept = kept[np.argsort(rank[kept])]
    same = np.append(False, shared[kept[1:]] == shared[kept[:-1]])[: len(kept)]
    return kept, same


def _refined(rank, active, ends, by) -> tuple[np.ndarray, np.ndarray]:
    """Ranks by the rank of the suffix so many words on as well."""
    later = active + by
    second = np.where(later < ends[active], rank[np.minimum(later, len(rank) - 1)], -1)
    order = np.lexsort((second, rank[active]))
    active, second = active[order], second[order]
    old = rank[active]
    at = np.arange(len(active))
    opens = np.append(True, old[1:] != old[:-1])[: len(active)]
    differs = opens | np.append(True, second[1:] != second[:-1])[: len(active)]
    class_start = np.maximum.accumulate(np.where(opens, at, 0))
    part_start = np.maximum.accumulate(np.where(differs, at, 0))
    rank = rank.copy()
    rank[active] = old + part_start - class_start
    return active, rank


def _common(ids: list[int], ends: np.ndarray, kept: np.ndarray, same: np.ndarray) -> list[int]:
    """Words that each suffix shares with the one before it, 0 where too few."""
    before = dict(zip(kept[1:][same[1:]].tolist(), kept[:-1][same[1:]].tolist()))
    common: dict[int, int] = {}
    held, last = 0, -2
    for i in sorted(before):
        j = before[i]
        # the place after one that shares h words shares at least h - 1
        held = held - 1 if i == last + 1 and held else 0
        most = min(ends[i] - i, ends[j] - j)
        while held < most and ids[i + held] == ids[j + held]:
            held += 1
        common[i] = held
        last = i
    return [common.get(i, 0) for i in kept.tolist()]


class _Node:
    """Places of the suffixes below a node, ascending, and the words before them."""

    __slots__ = ("places", "classes")

    def __init__(self, place: int, left: int):
        self.places = [place]
        self.classes = {left}


def _meet(a: _Node, b: _Node, depth: int, left: Sequence[int], words: int, periods: int, found: dict) -> _Node:
    """Join two children of a node of so many words; puts maximal pairs into ``found``."""
    if len(a.places) < len(b.places):
        a, b = b, a
    many, few = a.places, b.places
    farthest = depth // (periods - 1)
    if len(a.classes) > 1 or len(b.classes) > 1 or a.classes != b.classes:
        for x in few:
            k = bisect_left(many, x)
            for y in many[max(k - 1, 0) : k + 1]:
                i, j = (x, y) if x < y else (y, x)
                q = j - i
                if q <= farthest and q + depth >= words and left[i] != left[j]:
                    run = (i, q + depth)
                    found[run] = min(q, found.get(run, q))
    if len(few) < 16:
        for x in few:
            insort(many, x)
    else:
        many += few
        many.sort()
    a.classes |= b.classes
    return a


def _pairs(kept, common, left, words: int, periods: int) -> dict[tuple[int, int], int]:
    """(start, length) -> smallest period of all maximal pairs that are runs."""
    found: dict[tuple[int, int], int] = {}
    stack: list[list] = []

    def close(node: _Node, above: int) -> _Node:
        while stack and stack[-1][0] > above:
            depth, children = stack.pop()
            node = _meet(children, node, depth, left, words, periods, found)
        return node

    node = None
    for place, shares in zip(kept, common):
        if node is not None:
            node = close(node, shares)
            if not shares:
                stack.clear()
            elif stack and stack[-1][0] == shares:
                stack[-1][1] = _meet(stack[-1][1], node, shares, left, words, periods, found)
            else:
                stack.append([shares, node])
        node = _Node(place, left[place])
    if node is not None:
        close(node, 0)
    return found


def _suspects(ids: np.ndarray, owner: np.ndarray, ends: np.ndarray, least: int) -> np.ndarray:
    """Texts in which some ``least`` words occur twice, by hash: may name others too."""
    n = len(ids)
    if n < least:
        return np.empty(0, np.int64)
    value = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    value ^= value >> np.uint64(29)
    value *= np.uint64(0xBF58476D1CE4E5B9)
    value ^= value >> np.uint64(32)
    width = 1
    while width < least:
        step = min(width, least - width)
        # overlapping windows will do: equal words give equal hashes
        m = len(value) - step
        value = value[:m] * np.uint64(0xD6E8FEB86659FD93) + (value[step : step + m] ^ np.uint64(width))
        value ^= value >> np.uint64(31)
        width += step
    places = np.flatnonzero(np.arange(len(value)) + least <= ends[: len(value)])
    value = value[places] ^ (owner[places].astype(np.uint64) * np.uint64(0x94D049BB133111EB))
    order = np.argsort(value)
    value = value[order]
    twice = np.flatnonzero(value[1:] == value[:-1])
    return np.unique(owner[places[order[twice]]])


def find_runs(texts: Sequence[Sequence[bytes]], words: int = WORDS, periods: int = PERIODS) -> list[list[Run]]:
    """For each list of words its runs (start, length, period), by start, then period."""
    if periods < 3 or words < periods:
        raise ValueError("runs of at least three periods are found")
    least = -(-words * (periods - 1) // periods)
    runs: list[list[Run]] = [[] for _ in texts]
    codes: dict[bytes, int] = {}
    lengths = np.array([len(t) for t in texts], np.int64)
    ids = np.fromiter(
        (codes.setdefault(w, len(codes)) for t in texts for w in t), np.int64, int(lengths.sum())
    )
    owner = np.repeat(np.arange(len(texts)), lengths)
    stops = np.cumsum(lengths)
    suspects = _suspects(ids, owner, stops[owner], least)
    if not len(suspects):
        return runs
    chosen = np.isin(owner, suspects)
    ids, owner = ids[chosen], owner[chosen]
    firsts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
    of = np.searchsorted(firsts, np.arange(len(ids)), "right") - 1
    ends = np.append(firsts[1:], len(ids))[of]
    # words of different texts never agree
    _, apart = np.unique(owner * len(codes) + ids, return_inverse=True)
    kept, same = _ordered(apart, ends, least)
    left = np.append(-1, ids[:-1])
    left[firsts] = -1
    common = _common(ids.tolist(), ends, kept, same)
    for (start, length), period in _pairs(kept.tolist(), common, left.tolist(), words, periods).items():
        runs[owner[start]].append((start - int(firsts[of[start]]), length, period))
    for some in runs:
        some.sort(key=lambda r: (r[0], r[2]))
    return runs


def collapsed(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """Words that no run contains after its first period."""
    if not runs:
        return words
    drop = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        drop[start + period] += 1
        drop[start + length] -= 1
    gone = np.cumsum(drop)[:-1] > 0
    return [w for w, out in zip(words, gone.tolist()) if not out]


def _lots(texts: Iterator[bytes | None]) -> Iterator[list[list[bytes]]]:
    lot: list[list[bytes]] = []
    held = 0
    for text in texts:
        lot.append(text.split() if text else [])
        held += len(lot[-1])
        if held >= LOT_WORDS:
            yield lot
            lot, held = [], 0
    if lot:
        yield lot


def repetition(text: Column, words: int = WORDS, periods: int = PERIODS) -> Column:
    """Struct of n_words, runs (start, length, period; by start, then period) and collapsed:
    the words no run contains after its first period, joined by one space."""

    @F.arrow_udf(_DDL)
    def run(texts: pa.Array) -> pa.Array:
        rows = []
        for lot in _lots(t.as_py() for t in texts):
            for held, runs in zip(lot, find_runs(lot, words, periods)):
                rows.append(
                    {
                        "n_words": len(held),
                        "runs": [dict(zip(("start", "length", "period"), r)) for r in runs],
                        "collapsed": b" ".join(collapsed(held, runs)).decode(),
                    }
                )
        return pa.array(rows, _FOUND)

    return run(text.cast("binary"))


def with_repeats(docs: DataFrame) -> DataFrame:
    """doc_id and text, where every tenth text (by a hash of its id) repeats a stretch of
    its words from some word on to the end."""
    share = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split(F.col("text"), _SPACES), lambda w: w != "")
    n, g = F.size("words").cast("long"), F.floor(F.col("share") / 10)
    split = docs.select("doc_id", "text", share.alias("share")).select(
        "*", F.when((F.col("share") % 10 == 0) & F.col("text").isNotNull(), words).alias("words")
    )
    split = split.select("*", F.when(n > 0, g % n).alias("a"), n.alias("n"), (3 + g % 8).alias("times"))
    rest = F.col("n") - F.col("a")
    period = (1 + F.floor(rest / F.col("times"))).cast("int")
    start = F.col("a").cast("int")
    block = F.slice("words", start + 1, period)
    blocks = F.flatten(F.array_repeat(block, F.ceil(rest / period).cast("int")))
    repeated = F.concat(
        F.slice("words", F.lit(1), start), F.slice(blocks, F.lit(1), rest.cast("int"))
    )
    text = F.when(F.col("a").isNull(), F.col("text")).otherwise(F.array_join(repeated, " "))
    return split.select("doc_id", text.alias("text"))


def describe(found: DataFrame) -> DataFrame:
    """The columns of the query from doc_id and ``found``, a struct of ``repetition``."""
    runs = F.col("found.runs")
    better = lambda x, y: (x["length"] * y["period"] > y["length"] * x["period"]) | (
        # of equal exponents the earlier start, then the smaller period
        (x["length"] * y["period"] == y["length"] * x["period"])
        & ((x["start"] < y["start"]) | ((x["start"] == y["start"]) & (x["period"] < y["period"])))
    )
    best = F.reduce(runs, F.get(runs, F.lit(0)), lambda y, x: F.when(better(x, y), x).otherwise(y))
    line = lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))
    listed = F.array_join(F.transform(runs, line), "")
    return found.select("doc_id", "found", best.alias("best"), listed.alias("listed")).select(
        "doc_id",
        F.size("found.runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.col("listed").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("found.collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    docs = with_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return describe(docs.select("doc_id", repetition(F.col("text")).alias("found")))
