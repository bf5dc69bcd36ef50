"""Seeded draws that depend on row keys only.

``rand()`` depends on how rows are spread over tasks, so a retried task or another cluster size
would give other numbers. An md5 of (seed, salt, key) gives the same draw everywhere.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_TWO_POW_32 = 4294967296.0


def draw_bits(salt: str, *keys: Column, seed: int = 0) -> Column:
    """32 pseudo-random bits as BIGINT."""
    parts = [F.lit(f"{seed}:{salt}"), *[k.cast("string") for k in keys]]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8), 16, 10).cast("bigint")


def uniform(salt: str, *keys: Column, seed: int = 0) -> Column:
    """A draw in [0, 1)."""
    return draw_bits(salt, *keys, seed=seed) / F.lit(_TWO_POW_32)


def uniform_value(salt: str, *keys: object, seed: int = 0) -> float:
    """The same draw for constants on the driver, e.g. the planes of a hash family."""
    digest = hashlib.md5(":".join([f"{seed}:{salt}", *map(str, keys)]).encode()).hexdigest()
    return int(digest[:8], 16) / _TWO_POW_32


#: Rounds of the network that permutes ranks, and walks after which a rank must lie below the number of rows.
FEISTEL_ROUNDS = 4
MOST_WALKS = 64


def feistel_sides(n: int) -> tuple[int, int]:
    """(a, b) with a * b >= n and as few numbers from n on as possible, fewer than a."""
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    return a, max(1, -(-n // a))


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once."""
    return F.element_at(F.transform(F.array(value), lambda x: body(x)), 1)


def permuted_rank(rank: Column, n: int, salt: str, *keys: Column, seed: int = 0) -> Column:
    """The place of ``rank`` in a permutation of 0 … n - 1 that (seed, salt, keys) choose.

    A small Feistel network: the rank is a pair (left, right) of numbers below a and b; in turn each side moves on by
    a draw from the other, modulo its size, which can be undone and so is a permutation of all pairs. A pair
    that stands for n or more goes through again until it does not. Every row computes its own place; no row needs
    to see another.
    """
    a, b = feistel_sides(n)
    lit = lambda x: F.lit(x).cast("bigint")

    def turn(i: int, p: Column) -> Column:
        drawn = draw_bits(salt, *keys, F.lit(i), p["l" if i % 2 else "r"], seed=seed)
        if i % 2:
            return F.struct(p["l"].alias("l"), F.pmod(p["r"] + drawn, lit(b)).alias("r"))
        return F.struct(F.pmod(p["l"] + drawn, lit(a)).alias("l"), p["r"].alias("r"))

    def once(x: Column) -> Column:
        pair = F.struct(F.floor(x / lit(b)).alias("l"), F.pmod(x, lit(b)).alias("r"))
        for i in range(FEISTEL_ROUNDS):
            pair = _bound(pair, functools.partial(turn, i))
        return _bound(pair, lambda p: p["l"] * lit(b) + p["r"])

    if n <= 1:
        return rank.cast("bigint")
    first = once(rank.cast("bigint"))
    if a * b == n:
        return first
    walked = F.aggregate(
        F.sequence(F.lit(1), F.lit(MOST_WALKS)), first, lambda x, _: F.when(x < n, x).otherwise(once(x))
    )
    unsettled = F.raise_error(F.lit("a rank does not settle")).cast("bigint")
    return _bound(walked, lambda x: F.when(x < n, x).otherwise(unsettled))


def permuted_rank_value(rank: int, n: int, salt: str, *keys: object, seed: int = 0) -> int:
    """The same place for a number on the driver."""
    a, b = feistel_sides(n)
    x = rank
    while n > 1:
        left, right = divmod(x, b)
        for i in range(FEISTEL_ROUNDS):
            side = left if i % 2 else right
            digest = hashlib.md5(":".join([f"{seed}:{salt}", *map(str, keys), str(i), str(side)]).encode()).hexdigest()
            drawn = int(digest[:8], 16)
            left, right = (left, (right + drawn) % b) if i % 2 else ((left + drawn) % a, right)
        x = left * b + right
        if x < n:
            break
    return x
