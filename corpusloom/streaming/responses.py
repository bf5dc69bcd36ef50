"""Token streams: whole responses, and responses as HTML while they arrive."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# The same rules as the column form in functions.html.
# White space that may be more than itself: a line feed, before a fence, or at the end of what has come.
_SPACE = re.compile(r"\n|[ \t](?=`|\Z)")
_SPACE_IN_CODE = re.compile(r"[\n \t](?=`|\Z)")
_OPEN = re.compile(r"[\n \t]```\S*(?=\s)")
_CLOSE = re.compile(r"[\n \t]```")
_MAY_OPEN = re.compile(r"[\n \t](?:`{0,2}|```\S*)")
_MAY_CLOSE = re.compile(r"[\n \t]`{0,2}")

_TOKENS = "seq bigint, token string, is_end boolean"


def format_step(in_code: bool, buffer: str, final: bool) -> tuple[str, bool, str]:
    """(html, in_code, rest): mark up what is decided; the rest waits for more text."""
    html, at = [], 0
    while at < len(buffer):
        space = (_SPACE_IN_CODE if in_code else _SPACE).search(buffer, at)
        if space is None:
            html.append(buffer[at:])
            at = len(buffer)
            break
        html.append(buffer[at : space.start()])
        at = space.start()
        fence = (_CLOSE if in_code else _OPEN).match(buffer, at)
        if fence:
            html.append("\n</pre>" if in_code else "\n<pre>")
            in_code, at = not in_code, fence.end()
        elif (_MAY_CLOSE if in_code else _MAY_OPEN).fullmatch(buffer, at):
            if final:
                html.append(buffer[at:])
                at = len(buffer)
            break
        else:
            html.append("<br>\n" if buffer[at] == "\n" and not in_code else buffer[at])
            at += 1
    return "".join(html), in_code, buffer[at:]


class _InOrder(StatefulProcessor):
    """Hands over the tokens of a response in the order of ``seq``; gaps wait in state.

    A number that was delivered twice counts once, with the largest token if both arrive before it is
    handed over. With a time-out a response that gets no token for so long is closed as it is.
    """

    def __init__(self, timeout_ms: int):
        self.timeout_ms = timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.early = handle.getListState("early", _TOKENS)
        self.next_seq = handle.getValueState("next_seq", "seq bigint")
        self.deadline = handle.getValueState("deadline", "ms bigint")

    def close(self) -> None:
        pass

    def expected(self) -> int:
        # One call to the state: an empty value is None.
        known = self.next_seq.get()
        return known[0] if known else 0

    def ready(self, frames: list[pd.DataFrame]) -> list[tuple[int, str | None, bool]]:
        expected = self.expected()
        waiting: dict[int, tuple[str | None, bool]] = {}
        rows = [tuple(r) for r in self.early.get()]
        for frame in frames:
            rows += zip(frame["seq"], frame["token"], frame["is_end"], strict=True)
        for seq, token, end in rows:
            known = waiting.get(int(seq))
            best = max((t for t in (token, known and known[0]) if isinstance(t, str)), default=None)
            if seq >= expected:
                waiting[int(seq)] = (best, bool(end) or bool(known and known[1]))
        done = []
        while expected in waiting:
            done.append((expected, *waiting.pop(expected)))
            expected += 1
        self.next_seq.update((expected,))
        if not waiting:
            self.early.clear()
        else:
            self.early.put([(s, t, e) for s, (t, e) in sorted(waiting.items())])
        return done

    def rest(self) -> tuple[list[tuple[int, str | None, bool]], int]:
        """Tokens behind a gap, in order, and how many are missing before the last of them."""
        left = sorted((int(s), t, bool(e)) for s, t, e in self.early.get())
        missing = left[-1][0] + 1 - self.expected() - len(left) if left else 0
        return left, missing

    def wait(self, frames: list[pd.DataFrame]) -> None:
        """Set the time-out anew by the newest token."""
        if not self.timeout_ms:
            return
        last = max(int(f["ts"].max().timestamp() * 1000) for f in frames if len(f)) + self.timeout_ms
        known = self.deadline.get()
        if not known or last > known[0]:
            if known:
                self.handle.deleteTimer(known[0])
            self.deadline.update((last,))
            self.handle.registerTimer(last)

    def forget(self, *more: object) -> None:
        known = self.deadline.get()
        if known:
            self.handle.deleteTimer(known[0])
        for state in (self.early, self.next_seq, self.deadline, *more):
            state.clear()


class _Assemble(_InOrder):
    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.parts = handle.getListState("parts", "text string")
        self.count = handle.getValueState("count", "n bigint")

    def _add(self, tokens: list[tuple[int, str | None, bool]]) -> None:
        if tokens:
            self.parts.appendValue(("".join(t or "" for _, t, _ in tokens),))
            before = self.count.get()[0] if self.count.exists() else 0
            self.count.update((before + sum(t is not None for _, t, _ in tokens),))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        frames = list(rows)
        tokens = self.ready(frames)
        self._add(tokens)
        if any(end for _, _, end in tokens):
            yield self._close_response(key, complete=True, missing=0)
        else:
            self.wait(frames)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        tokens, missing = self.rest()
        self._add(tokens)
        yield self._close_response(key, complete=False, missing=missing)

    def _close_response(self, key: tuple, complete: bool, missing: int) -> pd.DataFrame:
        text = "".join(r[0] for r in self.parts.get())
        count = self.count.get()[0] if self.count.exists() else 0
        self.forget(self.parts, self.count)
        return pd.DataFrame(
            {
                "response_id": [key[0]], "response": [text], "tokens": [count], "complete": [complete],
                "missing": [missing],
            }
        )


@dataclass
class _Open:
    """The open responses of a group, and the tokens of theirs that wait behind a gap: ``at`` is a place in ``ids``."""

    ids: list[str | None]
    expected: list[int]
    deadline: list[int | None]
    in_code: list[bool]
    buffer: list[str]
    at: np.ndarray
    seq: np.ndarray
    token: np.ndarray
    end: np.ndarray

    @classmethod
    def unpacked(cls, responses: bytes, waiting: bytes) -> _Open:
        heads = pa.ipc.open_stream(responses).read_all()
        tokens = pa.ipc.open_stream(waiting).read_all().to_pandas()
        # strings of Arrow become Python objects here
        return cls(*(c.to_pylist() for c in heads.columns), *(tokens[f.name].to_numpy(object if f.name == "token" else None)
                   for f in _WAITING))

    def packed(self) -> tuple[bytes, bytes]:
        heads = [self.ids, self.expected, self.deadline, self.in_code, self.buffer]
        return _stream(heads, _HEADS), _stream([self.at, self.seq, self.token, self.end], _WAITING)

    def keep(self, kept: np.ndarray, tokens: np.ndarray) -> None:
        """Leave out other responses, and tokens that are not in ``tokens`` or belong to them."""
        place = np.cumsum(kept) - 1
        for name in ("ids", "expected", "deadline", "in_code", "buffer"):
            setattr(self, name, [x for x, k in zip(getattr(self, name), kept, strict=True) if k])
        tokens = tokens & kept[self.at]
        self.at = place[self.at[tokens]]
        self.seq, self.token, self.end = self.seq[tokens], self.token[tokens], self.end[tokens]

    def add(self, frame: pd.DataFrame) -> np.ndarray:
        """Add new tokens; gives the places of their responses. Numbers that were handed over are left out."""
        if frame["seq"].isna().any():
            raise ValueError("a token has no number")
        codes, found = pd.factorize(frame["response_id"], use_na_sentinel=False)
        known = {name: i for i, name in enumerate(self.ids)}
        places = []
        for name in (x if isinstance(x, str) else None for x in found):
            if name not in known:
                known[name] = len(self.ids)
                for values, first in ((self.ids, name), (self.expected, 0), (self.deadline, None), (self.in_code, False), (self.buffer, "")):
                    values.append(first)
            places.append(known[name])
        at = np.array(places, np.int64)[codes]
        seq = frame["seq"].to_numpy(np.int64)
        token = frame["token"].to_numpy(object)
        end = np.array([bool(e) for e in frame["is_end"]]) if frame["is_end"].dtype == object else frame["is_end"].to_numpy(bool)
        fresh = seq >= np.array(self.expected, np.int64)[at]
        self.at, self.seq = np.r_[self.at, at[fresh]], np.r_[self.seq, seq[fresh]]
        self.token, self.end = np.r_[self.token, token[fresh]], np.r_[self.end, end[fresh]]
        self._in_order()
        return at

    def _in_order(self) -> None:
        """Sort the tokens by response and number. A number counts once, with its largest token."""
        order = np.lexsort((self.seq, self.at))
        self.at, self.seq, self.token, self.end = (x[order] for x in (self.at, self.seq, self.token, self.end))
        again = np.zeros(len(order), bool)
        again[1:] = (np.diff(self.at) == 0) & (np.diff(self.seq) == 0)
        if not again.any():
            return
        first = np.flatnonzero(~again)
        stop = np.r_[first[1:], len(order)]
        token = self.token[first]
        for i in np.flatnonzero(stop - first > 1):
            token[i] = max((t for t in self.token[first[i] : stop[i]] if isinstance(t, str)), default=None)
        self.end = np.logical_or.reduceat(self.end, first)
        self.at, self.seq, self.token = self.at[first], self.seq[first], token

    def runs(self) -> tuple[np.ndarray, np.ndarray]:
        """(where a response begins among the tokens, where it stops)."""
        begins = np.flatnonzero(np.r_[True, np.diff(self.at) != 0][: len(self.at)])
        return begins, np.r_[begins[1:], len(self.at)][: len(begins)]


_HEADS = pa.schema(
    [("id", pa.string()), ("expected", pa.int64()), ("deadline", pa.int64()), ("in_code", pa.bool_()), ("buffer", pa.string())]
)
_WAITING = pa.schema([("at", pa.int64()), ("seq", pa.int64()), ("token", pa.string()), ("end", pa.bool_())])


def _stream(columns: list, schema: pa.Schema) -> bytes:
    arrays = [pa.array(c, f.type, from_pandas=True) for c, f in zip(columns, schema, strict=True)]
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, schema) as out:
        out.write_batch(pa.RecordBatch.from_arrays(arrays, schema=schema))
    return sink.getvalue().to_pybytes()


def _text(tokens: np.ndarray) -> str:
    return "".join(t for t in tokens if isinstance(t, str))


class _ToHtml(StatefulProcessor):
    """Hands over the tokens of responses in the order of ``seq``, as :class:`_InOrder` does, for a group of responses.

    What is open of a group is one value and has one timer, so calls to the state grow with groups and batches, not
    with responses. It is read and rewritten when a batch has tokens of the group.
    """

    def __init__(self, timeout_ms: int):
        self.timeout_ms = timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "responses binary, waiting binary")
        self.wake = handle.getValueState("wake", "ms bigint")

    def close(self) -> None:
        pass

    def _load(self) -> _Open:
        return _Open.unpacked(*(self.open.get() or (_stream([[]] * 5, _HEADS), _stream([[]] * 4, _WAITING))))

    def _store(self, state: _Open, rung: bool = False) -> None:
        if state.ids:
            self.open.update(state.packed())
        else:
            self.open.clear()
        if self.timeout_ms:
            self._wake_at(min(state.deadline, default=None), rung)

    def _wake_at(self, first: int | None, rung: bool) -> None:
        """One timer, for the first time-out; it may be early, but not late."""
        known = self.wake.get()
        if known and not rung:
            if first is not None and known[0] <= first:
                return
            self.handle.deleteTimer(known[0])
        if first is not None:
            self.handle.registerTimer(first)
            self.wake.update((first,))
        elif known:
            self.wake.clear()

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        packs = [pa.ipc.open_stream(p).read_all() for f in rows for p in f["tokens"]]
        frame = pa.concat_tables(packs).to_pandas()
        state = self._load()
        touched = state.add(frame)
        expected = np.array(state.expected, np.int64)
        begins, stops = state.runs()
        ready = state.seq - expected[state.at] == np.arange(len(state.seq)) - np.repeat(begins, stops - begins)
        kept, out = np.ones(len(state.ids), bool), []
        for i, n in zip(begins.tolist(), np.add.reduceat(ready, begins, dtype=np.int64).tolist() if len(begins) else [], strict=True):
            if not n:
                continue
            r, last = int(state.at[i]), i + n - 1
            final = bool(state.end[last])
            text = state.buffer[r] + _text(state.token[i : i + n])
            html, state.in_code[r], state.buffer[r] = format_step(state.in_code[r], text, final)
            state.expected[r] += n
            kept[r] = not final
            out.append((state.ids[r], int(state.seq[last]), html, final, 0 if final else None))
        if self.timeout_ms:
            self._wait(state, touched, frame["ms"], kept)
        state.keep(kept, ~ready)
        self._store(state)
        if out:
            yield _shown(out)

    def _wait(self, state: _Open, touched: np.ndarray, ms: pd.Series, kept: np.ndarray) -> None:
        """Set the time-outs of responses anew by their newest tokens."""
        newest = ms.groupby(touched).max()
        for r, last in newest.items():
            if not kept[r]:
                continue
            if pd.isna(last):
                raise ValueError("a token has no time")
            state.deadline[r] = max(int(last) + self.timeout_ms, state.deadline[r] or 0)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        state, passed = self._load(), timerValues.getCurrentWatermarkInMs()
        due = np.array([d <= passed for d in state.deadline], bool)
        behind = dict(zip(state.at[(runs := state.runs())[0]].tolist(), zip(*runs, strict=True), strict=True))
        out = []
        for r in np.flatnonzero(due).tolist():
            # tokens behind a gap follow in order
            i, stop = behind.get(r, (0, 0))
            last = int(state.seq[stop - 1]) if stop > i else state.expected[r] - 1
            missing = last + 1 - state.expected[r] - int(stop - i)
            html, _, _ = format_step(state.in_code[r], state.buffer[r] + _text(state.token[i:stop]), True)
            out.append((state.ids[r], last, html, False, missing))
        state.keep(~due, np.ones(len(state.at), bool))
        self._store(state, rung=True)
        if out:
            yield _shown(out)


def _shown(rows: list[tuple]) -> pd.DataFrame:
    ids, seq, html, is_end, missing = zip(*rows, strict=True)
    return pd.DataFrame(
        {
            "response_id": pd.Series(ids, dtype=object), "seq": seq, "html": html, "is_end": is_end,
            "missing": pd.Series(missing, dtype="Int64"),
        }
    )


TIMEOUT_MS = 600_000
#: Groups of responses that share state. All that waits of a group is in memory at once.
GROUPS = 1024
#: Bytes of tokens that a task packs by group together.
PACK_BYTES = 64 * 1024 * 1024
#: Tokens of one group and so many microseconds are a pack; of event time it has its newest token's.
PACK_US = 1_000_000


def _watched(tokens: DataFrame, timeout_ms: int, lateness: str) -> DataFrame:
    columns = ["response_id", "seq", "token", "is_end"]
    if timeout_ms:
        return tokens.select(*columns, tokens["ts"].cast("timestamp").alias("ts")).withWatermark("ts", lateness)
    return tokens.select(*columns)


def _packed(tokens: DataFrame, timeout_ms: int, groups: int) -> DataFrame:
    """(responses, ts, tokens): the tokens that a task has of a group, as one row.

    State is handed over row by row, which takes longer than all that is done with a token. A token that the
    watermark would leave out may ride along with one less than a second newer.
    """
    response = F.col("response_id").cast("string")
    stamp = F.col("ts").cast("timestamp") if timeout_ms else F.lit(None).cast("timestamp")
    rows = tokens.select(
        F.pmod(F.xxhash64(response), F.lit(groups)).cast("int").alias("responses"), F.unix_micros(stamp).alias("us"),
        response.alias("response_id"), F.col("seq").cast("bigint").alias("seq"), "token", "is_end",
        F.unix_millis(stamp).alias("ms"),
    )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= PACK_BYTES:
                yield _packs(held)
                held, size = [], 0
        if held:
            yield _packs(held)

    packs = rows.mapInArrow(pack, "responses int, us bigint, tokens binary")
    return packs.select("responses", "tokens", *([F.timestamp_micros("us").alias("ts")] if timeout_ms else []))


def _packs(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    table = pa.Table.from_batches(batches)
    # no time is before all times
    group, us = table["responses"].to_numpy(), table["us"].fill_null(np.iinfo(np.int64).min).to_numpy()
    order = np.lexsort((us, group))
    group, us = group[order], us[order]
    first = np.flatnonzero(np.r_[True, (np.diff(group) != 0) | (np.diff(us // PACK_US) != 0)][: len(group)])
    stop = np.r_[first[1:], len(group)][: len(first)]
    sorted_ = table.select(["response_id", "seq", "token", "is_end", "ms"]).take(pa.array(order)).combine_chunks()
    packed = []
    for at, end in zip(first.tolist(), stop.tolist(), strict=True):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, sorted_.schema) as out:
            out.write_table(sorted_.slice(at, end - at))
        packed.append(sink.getvalue().to_pybytes())
    newest = us[stop - 1]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(group[first], pa.int32()), pa.array(newest, pa.int64(), mask=newest == np.iinfo(np.int64).min),
            pa.array(packed, pa.binary()),
        ],
        names=["responses", "us", "tokens"],
    )


def assemble_responses_stream(
    tokens: DataFrame, timeout_ms: int = TIMEOUT_MS, lateness: str = "10 seconds"
) -> DataFrame:
    """(response_id, response, tokens, complete, missing) as soon as a response has its end marker.

    ``tokens`` has (response_id, seq, token, is_end, ts). A response that gets no token for ``timeout_ms`` of
    event time is closed as it is, with ``complete`` false: tokens behind a gap follow in order, and ``missing``
    says how many were never seen before the last of them. With ``timeout_ms`` 0 nothing is closed by
    time and no ``ts`` is needed; a response without end then stays in state.
    """
    schema = "response_id string, response string, tokens bigint, complete boolean, missing bigint"
    return _watched(tokens, timeout_ms, lateness).groupBy("response_id").transformWithStateInPandas(
        _Assemble(timeout_ms), schema, "append", "EventTime" if timeout_ms else "None"
    )


def stream_to_html(
    tokens: DataFrame, timeout_ms: int = TIMEOUT_MS, lateness: str = "10 seconds", groups: int = GROUPS
) -> DataFrame:
    """(response_id, seq, html, is_end, missing): the HTML that each micro-batch adds to a response.

    ``tokens`` and time-outs as in :func:`assemble_responses_stream`. ``missing`` is null while a response is
    open; the row that closes one by time has ``is_end`` false and the number of tokens never seen. Responses share
    state by ``groups``, whose number may not change while a checkpoint is in use.
    """
    schema = "response_id string, seq bigint, html string, is_end boolean, missing bigint"
    rows = _packed(tokens, timeout_ms, groups)
    if timeout_ms:
        rows = rows.withWatermark("ts", lateness)
    return rows.groupBy("responses").transformWithStateInPandas(
        _ToHtml(timeout_ms), schema, "append", "EventTime" if timeout_ms else "None"
    )
