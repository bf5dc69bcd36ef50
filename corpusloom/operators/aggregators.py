"""Aggregates that plug in, as states that merge.

An aggregator is four functions: an empty state, a state with a batch of values added, two states as one, and the
result of a state. A task keeps one state per group it meets and passes on that, not the values; the states
of a group merge in two rounds, so no task sees more than a small share of them and a group is never one array.
A state must have a bounded size.
"""

from __future__ import annotations

import heapq
import math
import pickle
import zlib
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: States that a task keeps before it passes them on.
MOST_STATES = 50_000
#: Parts whose states merge on their own before all states of a group meet.
SALTS = 64


@dataclass(frozen=True)
class Aggregator:
    """``update`` gets a state and an array of doubles without nulls and gives the new state."""

    zero: Callable[[], Any]
    update: Callable[[Any, np.ndarray], Any]
    merge: Callable[[Any, Any], Any]
    finish: Callable[[Any], float | None]


def aggregate(df: DataFrame, by: Sequence[str], value: str, aggregator: Aggregator, out: str) -> DataFrame:
    """(by…, out). Null values are left out, a group without values has the result of the empty state.

    Null keys are a group of their own.
    """
    by = list(by)
    keys = [df.schema[c] for c in by]
    partial = T.StructType([*keys, T.StructField("__salt", T.IntegerType()), T.StructField("__state", T.BinaryType())])
    agg = aggregator

    def states(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, Any] = {}

        def flushed() -> pa.RecordBatch:
            cells = [list(col) for col in zip(*held, strict=True)] or [[] for _ in by]
            stored = [pickle.dumps(s) for s in held.values()]
            salts = [zlib.crc32(s) % SALTS for s in stored]
            arrays = [pa.array(c, t) for c, t in zip(cells, types, strict=True)]
            arrays += [pa.array(salts, pa.int32()), pa.array(stored, pa.binary())]
            return pa.RecordBatch.from_arrays(arrays, names=[*by, "__salt", "__state"])

        types: list[pa.DataType] = []
        for batch in batches:
            types = [batch.schema.field(c).type for c in by]
            values = batch.column(value).to_numpy(zero_copy_only=False).astype(np.float64)
            missing = np.asarray(batch.column(value).is_null())
            # One number per combination of keys that the batch holds.
            number: dict[tuple, int] = {}
            rows = zip(*[batch.column(c).to_pylist() for c in by], strict=True) if by else [()] * len(values)
            group = np.fromiter((number.setdefault(k, len(number)) for k in rows), np.int64, len(values))
            order = np.argsort(group, kind="stable")
            ends = np.searchsorted(group[order], np.arange(len(number) + 1))
            for key, g in number.items():
                mine = order[ends[g] : ends[g + 1]]
                state = held.get(key)
                held[key] = agg.update(agg.zero() if state is None else state, values[mine[~missing[mine]]])
            if len(held) > MOST_STATES:
                yield flushed()
                held.clear()
        if held:
            yield flushed()

    def merged(states: Iterable[bytes]) -> Any:
        total = None
        for data in states:
            state = pickle.loads(data)
            total = state if total is None else agg.merge(total, state)
        return total

    def first_round(frame: pd.DataFrame) -> pd.DataFrame:
        one = frame.iloc[:1].copy()
        one["__state"] = [pickle.dumps(merged(frame["__state"]))]
        return one

    def last_round(frame: pd.DataFrame) -> pd.DataFrame:
        one = frame.iloc[:1][by].copy()
        result = agg.finish(merged(frame["__state"]))
        one[out] = [None if result is None else float(result)]
        return one

    parts = df.select(*by, F.col(value).cast("double").alias(value)).mapInArrow(states, partial)
    salted = parts.groupBy(*by, "__salt").applyInPandas(first_round, partial)
    done = T.StructType([*keys, T.StructField(out, T.DoubleType())])
    return salted.groupBy(*by).applyInPandas(last_round, done)


def mean_without_extremes(k: int) -> Aggregator:
    """The mean without the ``k`` smallest and the ``k`` largest values; null with 2 * k values or fewer.

    The state holds the number of values, their sum and the k extremes on both sides.
    """

    def update(state: tuple, values: np.ndarray) -> tuple:
        n, total, low, high = state
        if not len(values):
            return state
        edge = np.sort(values)
        return (
            n + len(values),
            math.fsum([total, *values.tolist()]),
            heapq.nsmallest(k, [*low, *edge[:k].tolist()]),
            heapq.nlargest(k, [*high, *edge[len(edge) - min(k, len(edge)) :].tolist()]),
        )

    def merge(a: tuple, b: tuple) -> tuple:
        return (
            a[0] + b[0], math.fsum([a[1], b[1]]), heapq.nsmallest(k, a[2] + b[2]), heapq.nlargest(k, a[3] + b[3]),
        )

    def finish(state: tuple) -> float | None:
        n, total, low, high = state
        if n <= 2 * k:
            return None
        return math.fsum([total, *[-x for x in low], *[-x for x in high]]) / (n - 2 * k)

    return Aggregator(lambda: (0, 0.0, [], []), update, merge, finish)
