"""Words of many texts at once, as arrays of hashes.

A word is a run of bytes other than ASCII white space. Hashes have 64 bits and are the
same on every worker. Long texts are cut at white space, so memory stays bounded by
the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

LOT_BYTES = 2_000_000
_BASE = 0x9E3779B97F4A7C55
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_CODE = np.random.default_rng(5).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _tables(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        _powers.clear()
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            run = np.full(max(n, LOT_BYTES + 1), base, np.uint64)
            run[0] = 1
            _powers.append(np.cumprod(run))
    return _powers


def _lots(texts: Sequence[bytes]) -> Iterator[tuple[list[int], list[bytes]]]:
    """Texts, or pieces of long ones, up to a number of bytes at a time."""
    owners: list[int] = []
    pieces: list[bytes] = []
    held = 0
    for k, text in enumerate(texts):
        at = 0
        while at < len(text):
            end = min(len(text), at + LOT_BYTES)
            while end < len(text) and not _IS_SPACE[text[end]]:
                end += 1
            owners.append(k)
            pieces.append(text[at:end])
            held += end - at + 1
            at = end
            if held >= LOT_BYTES:
                yield owners, pieces
                owners, pieces, held = [], [], 0
    if pieces:
        yield owners, pieces


def hashed(texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and length of every word, and the number of words of each text."""
    hashes, lengths = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    counts = np.zeros(len(texts), np.int64)
    for owners, pieces in _lots(texts):
        data = np.frombuffer(b" ".join(pieces) + b" ", np.uint8)
        space = _IS_SPACE[data]
        edges = np.flatnonzero(np.diff(space, prepend=True))
        starts, ends = edges[::2], edges[1::2]
        power, inverse = _tables(len(data))
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_CODE[data] * power[: len(data)], out=sums[1:])
        hashes.append(mix((sums[ends] - sums[starts]) * inverse[starts]))
        lengths.append(ends - starts)
        lasts = np.cumsum([len(p) + 1 for p in pieces])
        words = np.diff(np.searchsorted(starts, lasts), prepend=0)
        np.add.at(counts, owners, words)
    return np.concatenate(hashes), np.concatenate(lengths), counts
