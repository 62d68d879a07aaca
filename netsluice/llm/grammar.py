"""A run-length grammar made by recompression, and common extensions read off it, for whole arrays of queries.

Rounds of block compression (a maximal stretch of one letter becomes one letter) and pair compression (letters are
split in two sides, and each neighbouring left and right letter becomes one) shorten the text until nothing is
left to join. A round's cuts depend only on the two letters beside them, so equal stretches are cut alike but for
their ends: an extension climbs the rounds while both sides begin a letter of the next one, and descends to
the first difference. Every step is taken for all queries at once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd

BLOCK, PAIR = 0, 1

#: Rounds of each kind after which the remaining letters are compared one after the other. A round joins a quarter
#: of all neighbours on average, so texts of any size end long before.
MOST_ROUNDS = 200


@dataclass
class Round:
    """Letters of one round over the whole text, and how they stand on the letters of the round before."""

    letters: np.ndarray
    first: np.ndarray | None = None  #: place of each letter's first part in the round before, and the end
    rules: np.ndarray | None = None  #: for each letter: (part, how often) or (left, right; -1 for none)
    kind: int = BLOCK
    up: np.ndarray | None = None  #: place in the next round of the letter that holds each letter


def _mixed(letters: np.ndarray, salt: int) -> np.ndarray:
    """The side of each letter, from its number alone."""
    x = (letters.astype(np.uint64) + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(40)) & np.uint64(1) == 1


class Grammar:
    """The rounds over ``letters`` (numbers from 0); negative numbers are ends, each of them different from all others.

    Ends are never joined to anything, so a letter never stands for parts of two texts.
    """

    def __init__(self, letters: np.ndarray, most_rounds: int = MOST_ROUNDS) -> None:
        letters = np.asarray(letters, np.int64)
        self.rounds = [Round(letters)]
        for k in range(most_rounds):
            self._blocks()
            if not self._pairs(k):
                break
        self._mirrored: list[Round] | None = None

    def _add(self, starts: np.ndarray, left: np.ndarray, right: np.ndarray, kind: int) -> None:
        below = self.rounds[-1]
        size = len(below.letters)
        inner = left >= 0
        letters = left.copy()  # ends keep their number
        codes, keys = pd.factorize(left[inner] * (int(right.max(initial=0)) + 2) + right[inner] + 1)
        letters[inner] = codes
        span = int(right.max(initial=0)) + 2
        rules = np.stack([keys // span, keys % span - 1], axis=1)
        marks = np.zeros(size, np.int64)
        marks[starts] = 1
        below.up = np.cumsum(marks) - 1
        self.rounds.append(Round(letters, np.append(starts, size), rules, kind))

    def _blocks(self) -> None:
        letters = self.rounds[-1].letters
        if not (letters[1:] == letters[:-1]).any():
            return
        starts = np.flatnonzero(np.concatenate([[True], letters[1:] != letters[:-1]]))
        self._add(starts, letters[starts], np.diff(np.append(starts, len(letters))), BLOCK)

    def _pairs(self, k: int) -> bool:
        letters = self.rounds[-1].letters
        inner = letters >= 0
        if not (inner[1:] & inner[:-1]).any():
            return False
        side = _mixed(letters, k)
        joined = side[:-1] & ~side[1:] & inner[:-1] & inner[1:]
        starts = np.flatnonzero(np.concatenate([[True], ~joined]))
        right = np.full(len(letters), -1, np.int64)
        right[:-1][joined] = letters[1:][joined]
        self._add(starts, letters[starts], right[starts], PAIR)
        return True

    def expanded(self) -> np.ndarray:
        """The text, from the last round's letters and the rules alone."""
        letters = self.rounds[-1].letters
        for r in reversed(self.rounds[1:]):
            inner = letters >= 0
            if r.kind == BLOCK:
                times = np.ones(len(letters), np.int64)
                times[inner] = r.rules[letters[inner], 1]
                part = letters.copy()
                part[inner] = r.rules[letters[inner], 0]
                letters = np.repeat(part, times)
            else:
                both = np.stack([letters, np.full(len(letters), -1)], axis=1)
                both[inner] = r.rules[letters[inner]]
                keep = np.stack([np.ones(len(letters), bool), inner & (both[:, 1] >= 0)], axis=1)
                letters = both[keep]
        return letters

    def _backward(self) -> list[Round]:
        """The same rounds read from the end of the text."""
        if self._mirrored is None:
            out = []
            for k, r in enumerate(self.rounds):
                m = Round(r.letters[::-1], kind=r.kind)
                if r.first is not None:
                    m.first = (r.first[-1] - r.first)[::-1]
                if r.up is not None:
                    m.up = (len(self.rounds[k + 1].letters) - 1 - r.up)[::-1]
                out.append(m)
            self._mirrored = out
        return self._mirrored

    def forward(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """How many letters are equal from the places x and y on, x < y; the text has to end with an end."""
        return _extension(self.rounds, x, y)

    def backward(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """How many letters are equal from the places x and y back, x < y; place -1 gives 0."""
        size = len(self.rounds[0].letters)
        out = np.zeros(len(x), np.int64)
        some = x >= 0
        out[some] = _extension(self._backward(), size - 1 - y[some], size - 1 - x[some])
        return out


def _extension(rounds: list[Round], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Places climb until they differ; where a round ends in the middle of equal letters, the rest of it is compared."""
    x, y = np.asarray(x, np.int64), np.asarray(y, np.int64)
    px, py = x.copy(), y.copy()
    level = np.full(len(x), -1)  # the round in which a query differed
    open_ = np.arange(len(x))
    for k, r in enumerate(rounds):
        if not len(open_):
            break
        if k + 1 == len(rounds):
            # nothing above: letter by letter
            while len(open_):
                a, b = px[open_], py[open_]
                inside = np.maximum(a, b) < len(r.letters)
                same = np.zeros(len(open_), bool)
                same[inside] = r.letters[a[inside]] == r.letters[b[inside]]
                level[open_[~same]] = k
                open_ = open_[same]
                px[open_] += 1
                py[open_] += 1
            break
        above = rounds[k + 1]
        a, b = px[open_], py[open_]
        inside = np.maximum(a, b) < len(r.letters)
        level[open_[~inside]] = k
        open_, a, b = open_[inside], a[inside], b[inside]
        up_a, up_b = r.up[a], r.up[b]
        begins = (above.first[up_a] == a) & (above.first[up_b] == b)
        # within a letter of the next round: up to its end, where both end together
        rest_a, rest_b = above.first[up_a + 1] - a, above.first[up_b + 1] - b
        same = r.letters[a] == r.letters[b]
        step = np.minimum(rest_a, rest_b) if above.kind == BLOCK else np.ones(len(a), np.int64)
        step = np.where(begins, 0, np.where(same, step, 0))
        differs = ~begins & ~same
        if above.kind == BLOCK:
            differs |= ~begins & same & (rest_a != rest_b)
        a, b = a + step, b + step
        px[open_], py[open_] = a, b
        level[open_[differs]] = k
        open_, a, b = open_[~differs], a[~differs], b[~differs]
        ended = np.maximum(a, b) >= len(r.letters)
        level[open_[ended]] = k
        open_, a, b = open_[~ended], a[~ended], b[~ended]
        px[open_], py[open_] = r.up[a], r.up[b]
    # back down: first parts, and past the parts that are equal
    for k in range(len(rounds) - 1, 0, -1):
        rows = np.flatnonzero(level == k)
        if not len(rows):
            continue
        r, below = rounds[k], rounds[k - 1]
        a, b = r.first[px[rows]], r.first[py[rows]]
        count_a = r.first[np.minimum(px[rows] + 1, len(r.letters))] - a
        count_b = r.first[np.minimum(py[rows] + 1, len(r.letters))] - b
        inside = np.maximum(a, b) < len(below.letters)
        same = np.zeros(len(rows), bool)
        same[inside] = below.letters[a[inside]] == below.letters[b[inside]]
        step = np.minimum(count_a, count_b) if r.kind == BLOCK else np.ones(len(rows), np.int64)
        step = np.where(same, step, 0)
        px[rows], py[rows] = a + step, b + step
        level[rows] = k - 1
    return px - x
