"""Token ids of whole texts by a public tokenizer, with a memo of words.

The library encodes word by word: a normaliser, a pattern that cuts the text into
words, and a model that turns each word into ids. Words repeat, so texts are taken
many at a time: texts of Latin-1 characters are cut by the tokenizer's pattern over
arrays of character classes, each distinct word goes through the library's model
once, and workers remember the words they met first. All other texts go through the
library's normaliser and pre-tokeniser. Texts in which an added token's string stands,
before or after normalising, go through the library's whole encode, which finds them
(no other special tokens are added). Words are told apart by a 64-bit hash within a
worker.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Sequence
from functools import cache

import numpy as np
import pandas as pd

#: Words each worker remembers. What comes later is encoded once per lot of texts.
MEMO_WORDS = 500_000
#: Characters taken at a time.
LOT_CHARS = 2_000_000

_SPACE, _LETTER, _NUMBER, _OTHER, _END = range(5)
# Unicode classes within Latin-1.
_LETTERS = "ªµº" + "".join(map(chr, [*range(65, 91), *range(97, 123), *range(192, 256)]))
_NUMBERS = "0123456789²³¹¼½¾"
_SPACES = "\t\n\x0b\x0c\r \x85\xa0"
# Fixed value: the pattern of the tokenizer that drops white space.
_DROPS_SPACE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

_BASE, _MASK = 0x9E3779B97F4A7C55, (1 << 64) - 1


def _classes() -> np.ndarray:
    table = np.full(256, _OTHER, np.uint8)
    for kind, members in ((_LETTER, _LETTERS), (_NUMBER, _NUMBERS), (_SPACE, _SPACES)):
        table[[ord(c) for c in members if c not in "×÷"]] = kind
    return table


def _visible_bytes() -> dict[int, str]:
    """Byte-level vocabularies write bytes without a glyph as characters from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class Encoder:
    """Encodes lists of texts to flat arrays of unsigned 32-bit ids."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        normalizer = self.tokenizer.normalizer
        self._normal = normalizer.normalize_str if normalizer else None
        self._split = self.tokenizer.pre_tokenizer.pre_tokenize_str
        self._tokenize = self.tokenizer.model.tokenize
        self._bytes = _visible_bytes()
        added = list(self.tokenizer.get_added_tokens_decoder().values())
        self._added = [t.content for t in added]
        # normalised ones are looked for in the normalised text
        self._added_normal = [
            self._normal(t.content) if self._normal else t.content for t in added if t.normalized
        ]
        self._kind = self._pattern_kind()
        if any(re.search(r"\s", content) for content in self._added_normal):
            self._kind = None  # arrays don't join runs of white space
        self._memo: dict[int, bytes] = {}
        self._class = _classes()
        self._code = np.random.default_rng(11).integers(1, 1 << 63, 256, np.uint64) * 2 + 1
        self._power = self._inverse = np.ones(1, np.uint64)

    def _pattern_kind(self) -> str | None:
        """Which of the two known patterns this tokenizer has."""
        spec = json.loads(self.tokenizer.to_str())
        steps, normal = spec["pre_tokenizer"], spec["normalizer"]
        if not normal and steps["type"] == "ByteLevel" and steps["use_regex"]:
            return None if steps["add_prefix_space"] else "keeps space"
        if normal and [s["type"] for s in normal.get("normalizers", [])] == [
            "NFC",
            "Replace",
            "Lowercase",
        ]:
            cut = steps.get("pretokenizers", [{}])[0]
            if cut.get("pattern") == {"Regex": _DROPS_SPACE} and cut["invert"]:
                return "drops space"
        return None

    def _ids(self, word: str) -> bytes:
        return array("I", [token.id for token in self._tokenize(word)]).tobytes()

    def _encode(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _slowly(self, text: str) -> np.ndarray:
        whole = text
        if self._normal:
            text = self._normal(text)
        if any(content in text for content in self._added_normal):
            return self._encode(whole)
        return np.frombuffer(b"".join([self._ids(w) for w, _ in self._split(text)]), np.uint32)

    def _powers(self, n: int) -> None:
        if len(self._power) < n:
            for name, base in (("_power", _BASE), ("_inverse", pow(_BASE, -1, _MASK + 1))):
                run = np.full(max(n, LOT_CHARS + 1), base, np.uint64)
                run[0] = 1
                setattr(self, name, np.cumprod(run))

    def _cut(self, chars: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the pattern's words start and end."""
        begins = np.empty(len(kinds) + 1, bool)
        begins[0] = begins[-1] = True
        np.not_equal(kinds[1:], kinds[:-1], out=begins[1:-1])
        if self._kind == "drops space":
            begins[:-1] |= kinds == _NUMBER
        else:
            # the last space of a run is cut off if a word follows, and joins that
            # word if it is a blank
            last = np.flatnonzero((kinds[:-1] == _SPACE) & (kinds[1:] != _SPACE) & (kinds[1:] != _END))
            begins[last] = True
            begins[last[chars[last] == 32] + 1] = False
        quote = np.flatnonzero((chars[:-1] == 39) & begins[:-2] & (kinds[1:] == _LETTER))
        if len(quote):
            one, two = chars[quote + 1], chars[np.minimum(quote + 2, len(chars) - 1)]
            short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
            long = ((two == ord("e")) & np.isin(one, np.frombuffer(b"rv", np.uint8))) | (
                (one == ord("l")) & (two == ord("l"))
            )
            begins[quote[short | long] + 1] = False
            begins[quote[short] + 2] = True
            begins[quote[long & ~short] + 3] = True
        edges = np.flatnonzero(begins)
        starts, ends = edges[:-1], edges[1:]
        keep = kinds[starts] != _END
        if self._kind == "drops space":
            keep &= kinds[starts] != _SPACE
        return starts[keep], ends[keep]

    def _lot(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        joined = b"\0".join(texts) + b"\0"
        chars = np.frombuffer(joined, np.uint8)
        kinds = self._class[chars]
        lasts = np.cumsum([len(t) + 1 for t in texts]) - 1
        kinds[lasts] = _END
        starts, ends = self._cut(chars, kinds)
        if not len(starts):
            return np.empty(0, np.uint32), np.zeros(len(texts), np.int64)
        self._powers(len(chars))
        sums = np.zeros(len(chars) + 1, np.uint64)
        np.cumsum(self._code[chars] * self._power[: len(chars)], out=sums[1:])
        hashes = (sums[ends] - sums[starts]) * self._inverse[starts]
        del sums
        codes, words = pd.factorize(hashes)
        found = list(map(self._memo.get, words.tolist()))
        if None in found:
            first = np.empty(len(words), np.int64)
            first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
            where, until = starts[first].tolist(), ends[first].tolist()
            room = MEMO_WORDS - len(self._memo)
            for k, ids in enumerate(found):
                if ids is None:
                    word = joined[where[k] : until[k]].decode("latin-1").encode()
                    found[k] = self._ids(word.decode("latin-1").translate(self._bytes))
                    if room > 0:
                        self._memo[int(words[k])] = found[k]
                        room -= 1
        flat = np.frombuffer(b"".join(found), np.uint32)
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        places = np.concatenate(([0], np.cumsum(sizes)))[:-1]
        counts = sizes[codes]
        before = np.concatenate(([0], np.cumsum(counts)))
        take = np.repeat(places[codes] - before[:-1], counts) + np.arange(before[-1])
        until = before[np.searchsorted(starts, lasts)]
        return flat[take], np.diff(until, prepend=0)

    def many(self, texts: Sequence[str]) -> list[np.ndarray]:
        """The ids of each whole text."""
        out: list[np.ndarray] = [np.empty(0, np.uint32)] * len(texts)
        lot: list[bytes] = []
        of: list[int] = []
        chars = 0

        def close() -> None:
            ids, counts = self._lot(lot)
            for k, part in zip(of, np.split(ids, np.cumsum(counts)[:-1])):
                out[k] = part

        for k, text in enumerate(texts):
            if any(content in text for content in self._added):
                out[k] = self._encode(text)
                continue
            normal = text.lower() if self._normal else text
            try:
                raw = normal.encode("latin-1")
            except UnicodeEncodeError:
                raw = None
            if raw is not None and any(content in normal for content in self._added_normal):
                raw = None
            if raw is None or self._kind is None:
                out[k] = self._slowly(text)
                continue
            lot.append(raw)
            of.append(k)
            chars += len(raw) + 1
            if chars >= LOT_CHARS:
                close()
                lot, of, chars = [], [], 0
        if lot:
            close()
        return out


@cache
def encoder(path: str) -> Encoder:
    """The worker's encoder for this file."""
    return Encoder(path)
