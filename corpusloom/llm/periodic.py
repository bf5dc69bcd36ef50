"""Runs of words that repeat with a period, found while the words are appended.

A run with period q is a longest stretch in which words q apart are equal, q being its smallest period. Runs
of at least ``LEAST_WORDS`` words and ``LEAST_PERIODS`` periods are reported.

Squares are caught by catchers over completed blocks. Level L (8, 16, 32, ...) cuts the words into blocks of L
words; when a block is complete, its catcher begins to watch. Every appended word completes one suffix of L
words per level and advances the comparison of it with the block of each catcher still watching: a catcher of
level L watches for its block at distances from L to 2 L - 1 (the lowest level from 1), so at most two catchers
per level look at a suffix, and a word costs O(log n) comparisons. A suffix equal to the block at distance q is
part of a square of period q. Every run that counts is caught: words q apart are equal over at least
max(24 - q, 2 q) places, which hold a whole block of level L for L <= q < 2 L, and 16 such places hold one of
level 8 for smaller q.

Catches of neighbouring blocks with the same q merge; the merged stretch is extended at both ends by less than
one block, by binary search on common prefixes. Stretches with the same ends and a period that is a multiple
of a smaller one are that run once more and go. Comparisons use fingerprints (polynomials modulo 2 ** 31 - 1 with
a drawn base); the runs that remain are compared word by word, and if one differs everything is done again with
another base. So the result is exact.

Words of several texts are appended to one stream, with a mark between texts that equals no word.

Null and empty texts have no words, no runs and an empty collapsed text; repeated rows get the same result each. A text
of n words takes O(n log n) time and O(n) memory; texts of a batch are handled in portions of bounded size, a
single long text is a portion of its own. Columns named ``runs`` or ``collapsed`` are replaced; an empty table gives an
empty one.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST_WORDS = 24
LEAST_PERIODS = 3
#: Blocks of the lowest level: 2 * 8 - 1 places always hold one, and a run has 16 equal places or more.
LOWEST = 8
#: Bytes of text whose words are alive at once, unless one text is longer.
PORTION = 4 << 20
PRIME = np.uint64((1 << 31) - 1)

RUNS = "runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"


class Stream:
    """Words appended piece by piece, given as numbers, and the squares caught so far.

    ``longest`` bounds the length of a run (the longest text); levels beyond a third of it are not kept.
    """

    def __init__(self, longest: int, seed: int = 1):
        draw = np.random.default_rng(seed)
        self.base = int(draw.integers(1 << 20, int(PRIME) - 1))
        self.salt = np.uint64(draw.integers(1, 1 << 62))
        self.words = np.zeros(0, np.int64)
        self.sums = np.zeros(1, np.uint64)
        self.levels = [LOWEST]
        while 2 * self.levels[-1] <= longest // LEAST_PERIODS:
            self.levels.append(2 * self.levels[-1])
        self.powers = np.ones(1, np.uint64)
        self.caught: list[tuple[int, np.ndarray, np.ndarray]] = []

    def append(self, words: np.ndarray) -> None:
        """Append words (any integers); of all levels, compare the suffixes that they complete."""
        old, n = len(self.words), len(self.words) + len(words)
        self.words = np.concatenate([self.words, words.astype(np.int64)])
        while len(self.powers) <= n:
            step = np.uint64(pow(self.base, len(self.powers), int(PRIME)))
            self.powers = np.concatenate([self.powers, self.powers * step % PRIME])
        terms = self._scattered(words) * self.powers[old:n] % PRIME
        self.sums = np.concatenate([self.sums, (self.sums[-1] + np.cumsum(terms)) % PRIME])
        for level in self.levels:
            starts = np.arange(max(0, old - level + 1), n - level + 1)
            if len(starts):
                self._compare(level, starts)

    def _scattered(self, words: np.ndarray) -> np.ndarray:
        x = (words.astype(np.uint64) + self.salt) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        return (x >> np.uint64(33)) % PRIME

    def _same(self, i: np.ndarray, j: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        """Whether the fingerprints of the words from i and from j (i < j) are equal."""
        left = (self.sums[i + length] + PRIME - self.sums[i]) % PRIME
        right = (self.sums[j + length] + PRIME - self.sums[j]) % PRIME
        return left * self.powers[j - i] % PRIME == right

    def _compare(self, level: int, starts: np.ndarray) -> None:
        """Suffixes that begin at ``starts`` against the blocks of the catchers that watch there."""
        if level == LOWEST:
            nearest = (starts - 1) // level * level
            choices = [nearest, nearest - level]
        else:
            choices = [(starts - level) // level * level]
        for blocks in choices:
            ok = (blocks >= 0) & (starts - blocks < 2 * level)
            block, start = blocks[ok], starts[ok]
            hit = self._same(block, start, level)
            if hit.any():
                self.caught.append((level, block[hit], start[hit] - block[hit]))

    def runs(self, most: int | None = None) -> np.ndarray:
        """Rows (start, length, period) of all runs among the words so far, by start and period."""
        found = [self._merged(level) for level in self.levels]
        stretches = np.concatenate([np.zeros((0, 3), np.int64), *found])
        a, b, q = stretches.T
        stretches = stretches[b - a >= np.maximum(LEAST_WORDS, LEAST_PERIODS * q)]
        stretches = stretches[np.lexsort(stretches.T[::-1])]
        if len(stretches):
            a, b, q = stretches.T
            first = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
            smallest = q[first][np.cumsum(first) - 1]
            stretches = stretches[first | (q % smallest != 0)]
        for a, b, q in stretches:
            if not np.array_equal(self.words[a : b - q], self.words[a + q : b]):
                raise Collision
        return np.column_stack([stretches[:, 0], stretches[:, 1] - stretches[:, 0], stretches[:, 2]])

    def _merged(self, level: int) -> np.ndarray:
        """Stretches (start, end, period) from the catches of a level, each extended as far as it goes."""
        mine = [(b, q) for at, b, q in self.caught if at == level]
        if not mine:
            return np.zeros((0, 3), np.int64)
        block = np.concatenate([b for b, _ in mine])
        period = np.concatenate([q for _, q in mine])
        order = np.lexsort((block, period))
        block, period = block[order], period[order]
        new = np.r_[True, (period[1:] != period[:-1]) | (block[1:] - block[:-1] != level)]
        first, q = block[new], period[new]
        last = block[np.r_[np.flatnonzero(new)[1:] - 1, len(block) - 1]] + level
        left = self._longest(np.minimum(first, level - 1), lambda n: self._same(first - n, first + q - n, n))
        room = np.minimum(len(self.words) - last - q, level - 1)
        right = self._longest(room, lambda n: self._same(last, last + q, n))
        return np.column_stack([first - left, last + q + right, q])

    @staticmethod
    def _longest(most: np.ndarray, holds) -> np.ndarray:
        """The largest n up to ``most`` for which ``holds``, given that it holds for all smaller ones."""
        low, high = np.zeros_like(most), most.copy()
        while (low < high).any():
            middle = (low + high + 1) // 2
            ok = holds(middle)
            low, high = np.where(ok, middle, low), np.where(ok, high, middle - 1)
        return low


class Collision(Exception):
    """Different words had the same fingerprint."""


def runs_of(texts: Sequence[Sequence]) -> list[np.ndarray]:
    """For each list of words, the rows (start, length, period) of its runs."""
    sizes = np.array([len(t) for t in texts], np.int64)
    result = [np.zeros((0, 3), np.int64)] * len(texts)
    long = np.flatnonzero(sizes >= LEAST_WORDS)
    if not len(long):
        return result
    number: dict = {}
    count = itertools.count()
    pieces, starts, at = [], [], 0
    for k, i in enumerate(long):
        starts.append(at)
        pieces.append(np.fromiter(map(number.setdefault, texts[i], count), np.int64, sizes[i]))
        # The mark behind a text is a number of its own.
        pieces.append(np.array([-1 - k], np.int64))
        at += sizes[i] + 1
    words = np.concatenate(pieces)
    for seed in itertools.count(1):
        stream = Stream(int(sizes.max()), seed)
        stream.append(words)
        try:
            found = stream.runs()
            break
        except Collision:
            continue
    begins = np.array(starts)
    owner = np.searchsorted(begins, found[:, 0], "right") - 1
    cuts = np.searchsorted(owner, np.arange(len(long) + 1))
    for k, i in enumerate(long):
        mine = found[cuts[k] : cuts[k + 1]].copy()
        mine[:, 0] -= begins[k]
        result[i] = mine
    return result


def collapse(words: Sequence, runs: np.ndarray) -> list:
    """The words without those that a run holds behind its first period."""
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return list(itertools.compress(words, keep))


def portions(sizes: Sequence[int], most: int = PORTION) -> Iterator[list[int]]:
    """Numbers of texts in order of size, cut where a portion would exceed ``most`` bytes."""
    part, total = [], 0
    for i in sorted(range(len(sizes)), key=sizes.__getitem__):
        if part and total + sizes[i] > most:
            yield part
            part, total = [], 0
        part.append(i)
        total += sizes[i]
    if part:
        yield part


def find_runs(texts: Sequence[bytes | None]) -> tuple[list[list[dict]], list[str]]:
    """Runs and collapsed text of each text; words are split at ASCII white space."""
    runs: list[list[dict]] = [[] for _ in texts]
    collapsed = [""] * len(texts)
    for part in portions([len(t or b"") for t in texts]):
        split = [(texts[i] or b"").split() for i in part]
        for i, words, found in zip(part, split, runs_of(split), strict=True):
            if len(found):
                runs[i] = [dict(zip(("start", "length", "period"), row, strict=True)) for row in found.tolist()]
                words = collapse(words, found)
            collapsed[i] = b" ".join(words).decode("utf-8", "replace")
    return runs, collapsed


def with_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with runs (start, length, period; by start, then period) and collapsed, the text without repeats.

    One pass in Arrow batches, no shuffle.
    """

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            runs, collapsed = find_runs(texts.tolist())
            yield pd.DataFrame({"runs": runs, "collapsed": collapsed})

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    found = F.pandas_udf(run, RUNS)(F.col(text).cast("binary"))
    kept = [c for c in docs.columns if c.lower() not in ("runs", "collapsed")]
    both = docs.select(*kept, found.alias("__found"))
    return both.select(*kept, "__found.runs", "__found.collapsed")
