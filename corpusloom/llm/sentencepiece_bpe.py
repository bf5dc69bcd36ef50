"""Encoding and decoding with a merge-type SentencePiece vocabulary.

A text becomes symbols, one per character. An agenda holds the adjacent pairs whose concatenation is a
piece, best score first and leftmost among equals; the best valid pair is merged and its two new
neighbours enter the agenda, until it is empty. Symbols outside the vocabulary become byte pieces.

Segments of ordinary length and characters are merged side by side, as arrays of piece numbers: the agenda is a
number per pair, made of the rank of its score and its place, and each round merges the smallest of every
segment and looks up its two new pairs. Long segments and those with other characters have a heap each.

No piece of such a vocabulary has the space mark behind another character, and none contains a line
feed (both are tested when the vocabulary is loaded; otherwise texts are not cut there). So a text can
be cut before runs of the space mark and at line feeds: no merge crosses a cut, and equal segments are
encoded once while a worker remembers them. With ``check`` every newly encoded segment is compared with the library, one
call per Arrow batch, and a difference fails the task.

Null texts are empty; an empty text has no ids. Repeated rows are encoded each; texts may have any
length, a segment of n characters takes O(n log n). Columns named ids or decoded are replaced.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterable, Iterator, Sequence
from heapq import heapify, heappop, heappush
from itertools import chain, pairwise
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

MARK = "▁"
ROWS_OUT = 500
#: Characters up to which segments are merged side by side; the rounds are as many as the longest has.
MOST_ABREAST = 48
MOST_CACHED = 300_000


#: No pair.
_NONE = np.iinfo(np.int64).max


class Pieces:
    """The vocabulary of a model: merge ranks, ids, byte ids."""

    def __init__(self, model: bytes):
        from sentencepiece import SentencePieceProcessor

        self.library = SentencePieceProcessor(model_proto=model)
        lib = self.library
        self.surface = [lib.id_to_piece(i) for i in range(lib.get_piece_size())]
        special = [
            lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i)
            for i in range(len(self.surface))
        ]
        self.id_of = {p: i for i, p in enumerate(self.surface) if not special[i]}
        self.cost_of = {p: -lib.get_score(i) for p, i in self.id_of.items()}
        self.byte_of = {i: int(p[3:5], 16) for i, p in enumerate(self.surface) if lib.is_byte(i)}
        self.id_of_byte = {b: i for i, b in self.byte_of.items()}
        self.unknown = lib.unk_id()
        self.plain_chars = frozenset(p for p in self.id_of if len(p) == 1)
        self._tables()
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        #: Segments whose ids decode to another text, of both generations.
        self.odd: dict[str, str] = {}
        self.odd_old: dict[str, str] = {}
        cuts_at_mark = not any(re.search(f"[^{MARK}]{MARK}", p) for p in self.id_of)
        cuts_at_line = not any("\n" in p for p in self.id_of)
        if cuts_at_mark and cuts_at_line:
            self.segments = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n").findall
        else:
            self.segments = lambda text: [text] if text else []

    def _tables(self) -> None:
        """Piece of every character, and of every pair of pieces whose concatenation is one, with its rank."""
        self.piece_of_char = np.full(0x110000, -1, np.int32)
        for piece, i in self.id_of.items():
            if len(piece) == 1:
                self.piece_of_char[ord(piece)] = i
        ranked = sorted(set(self.cost_of.values()))
        rank_of = {cost: rank for rank, cost in enumerate(ranked)}
        pairs = []
        for piece, i in self.id_of.items():
            for cut in range(1, len(piece)):
                left, right = self.id_of.get(piece[:cut]), self.id_of.get(piece[cut:])
                if left is not None and right is not None:
                    pairs.append(((left << 32) | right, rank_of[self.cost_of[piece]], i))
        pairs.sort()
        # A last pair that no two pieces have, so that every search ends at one.
        self.pair_keys = np.array([*[k for k, _, _ in pairs], (1 << 63) - 1], np.int64)
        self.pair_ranks = np.array([*[r for _, r, _ in pairs], 0], np.int64)
        self.pair_pieces = np.array([*[i for _, _, i in pairs], 0], np.int64)

    def merge_abreast(self, segments: Sequence[str]) -> list[bytes]:
        """Ids of segments that are not empty and whose characters all are pieces, as bytes of 32-bit numbers."""
        codes = np.frombuffer("".join(segments).encode("utf-32-le"), np.uint32)
        symbols = self.piece_of_char[codes].astype(np.int64)
        n = len(symbols)
        sizes = np.fromiter(map(len, segments), np.int64, len(segments))
        ends = np.cumsum(sizes)
        starts = ends - sizes
        after = np.arange(1, n + 1)
        after[ends - 1] = -1
        before = np.arange(-1, n - 1)
        before[starts] = -1
        alive = np.ones(n, bool)
        agenda = np.full(n, _NONE)
        made = np.zeros(n, np.int64)

        def look_up(at: np.ndarray) -> None:
            """Enter the pairs that begin at these places."""
            follower = after[at]
            key = np.where(follower >= 0, (symbols[at] << 32) | symbols[follower], -1)
            found = np.searchsorted(self.pair_keys, key)
            hit = self.pair_keys[found] == key
            agenda[at] = np.where(hit, (self.pair_ranks[found] << 32) | at, _NONE)
            made[at] = self.pair_pieces[found]

        look_up(np.arange(n))
        open_starts, open_ends = starts, ends
        while len(open_starts):
            # The smallest number between each start and its end; what lies between segments is left out.
            bounds = np.column_stack([open_starts, open_ends]).ravel()
            if bounds[-1] == n:
                bounds = bounds[:-1]
            best = np.minimum.reduceat(agenda, bounds)[::2]
            going = best != _NONE
            open_starts, open_ends, at = open_starts[going], open_ends[going], best[going] & 0xFFFFFFFF
            if not len(at):
                break
            gone = after[at]
            symbols[at] = made[at]
            alive[gone] = False
            agenda[gone] = _NONE
            following = after[gone]
            after[at] = following
            linked = following >= 0
            before[following[linked]] = at[linked]
            look_up(at)
            previous = before[at]
            look_up(previous[previous >= 0])
        data = symbols[alive].astype(np.int32).tobytes()
        cuts = (4 * np.concatenate([[0], np.cumsum(alive)[ends - 1]])).tolist()
        return [data[a:b] for a, b in pairwise(cuts)]

    def merge(self, text: str) -> list[int]:
        """Ids of one segment, by the agenda."""
        cost_of = self.cost_of.get
        symbols = list(text)
        n = len(symbols)
        agenda = []
        last = symbols[0] if n else ""
        for i in range(1, n):
            symbol = symbols[i]
            pair = last + symbol
            cost = cost_of(pair)
            if cost is not None:
                agenda.append((cost, i - 1, i, pair))
            last = symbol
        if agenda:
            heapify(agenda)
            after = list(range(1, n + 1))
            before = list(range(-1, n - 1))
            while agenda:
                _, left, right, pair = heappop(agenda)
                # One of them was merged with another since.
                if not symbols[left] or not symbols[right] or symbols[left] + symbols[right] != pair:
                    continue
                symbols[left], symbols[right] = pair, ""
                following = after[right]
                after[left] = following
                if following < n:
                    before[following] = left
                    longer = pair + symbols[following]
                    cost = cost_of(longer)
                    if cost is not None:
                        heappush(agenda, (cost, left, following, longer))
                previous = before[left]
                if previous >= 0:
                    longer = symbols[previous] + pair
                    cost = cost_of(longer)
                    if cost is not None:
                        heappush(agenda, (cost, previous, left, longer))
        id_of = self.id_of.get
        ids = [id_of(symbol) for symbol in symbols if symbol]
        return self._spelled(symbols) if None in ids else ids

    def _spelled(self, symbols: Sequence[str]) -> list[int]:
        """Ids of symbols, those outside the vocabulary as their bytes or as unknown."""
        ids: list[int] = []
        for symbol in symbols:
            if symbol:
                known = self.id_of.get(symbol)
                if known is not None:
                    ids.append(known)
                elif self.id_of_byte:
                    ids += [self.id_of_byte[x] for x in symbol.encode()]
                else:
                    ids.append(self.unknown)
        return ids

    def text_of(self, ids: Sequence[int]) -> str:
        """The characters of ids, with spaces for space marks; bytes that are not UTF-8 become U+FFFD."""
        out: list[str] = []
        raw = bytearray()
        for i in ids:
            byte = self.byte_of.get(i)
            if byte is not None:
                raw.append(byte)
                continue
            if raw:
                out.append(_utf8(bytes(raw)))
                raw.clear()
            out.append(self.surface[i].replace(MARK, " "))
        if raw:
            out.append(_utf8(bytes(raw)))
        return "".join(out)

    def learn(self, segments: set[str], check: bool) -> tuple[dict[str, bytes], Callable]:
        """Ids of all these segments, as bytes, and the function that gives the text of their ids.

        Segments are kept in two generations: when the young one is full it replaces the old one.
        """
        if len(self.young) > MOST_CACHED:
            self.old, self.young = self.young, {}
            self.odd_old, self.odd = self.odd, {}
        young, odd, old = self.young, self.odd, self.old
        new = []
        for s in segments:
            if s not in young:
                ids = old.get(s)
                if ids is None:
                    new.append(s)
                else:
                    young[s] = ids
                    if s in self.odd_old:
                        odd[s] = self.odd_old[s]
        plain_only = self.plain_chars.issuperset
        abreast = [s for s in new if len(s) <= MOST_ABREAST and plain_only(s)]
        if abreast:
            young.update(zip(abreast, self.merge_abreast(abreast), strict=True))
        # Only these can hold ids whose surfaces are not the segment itself.
        for s in set(new).difference(abreast):
            ids = self.merge(s)
            young[s] = array("i", ids).tobytes()
            plain = self.text_of(ids)
            if plain != s.replace(MARK, " "):
                odd[s] = plain
        if check and new:
            self.compare(new)

        def decoded(parts: list[str]) -> str:
            if self.odd.keys().isdisjoint(parts):
                return "".join(parts).replace(MARK, " ")
            return "".join([self.odd.get(p) or p.replace(MARK, " ") for p in parts])

        return self.young, decoded

    def encode(self, text: str) -> list[int]:
        return [i for s in self.segments(marked(text)) for i in self.merge(s)]

    def decode(self, ids: Sequence[int]) -> str:
        """The text of ids; the space that encoding puts in front is taken away again."""
        text = self.text_of(ids)
        return text[1:] if ids and self.surface[ids[0]].startswith(MARK) else text

    def compare(self, segments: Sequence[str]) -> None:
        """Compare the learned ids of segments with the library; all those that begin with a mark at once."""
        marked_ = [s for s in segments if s[0] == MARK and s != MARK]
        found = self.library.encode([s[1:] for s in marked_], num_threads=1)
        flat = np.fromiter(chain.from_iterable(found), np.int32)
        same = b"".join(map(self.young.__getitem__, marked_)) == flat.tobytes()
        # Equal numbers in a row could still be cut at other places.
        if same:
            sizes = [len(self.young[s]) for s in marked_]
            same = sizes == [4 * len(f) for f in found]
        rest = [s for s in segments if s[0] != MARK] if same else segments
        wrong = self.differing(rest, [memoryview(self.young[s]).cast("i") for s in rest]) if rest else None
        if wrong is not None:
            raise ValueError(f"the library encodes {wrong[:80]!r} otherwise")

    def differing(self, segments: Sequence[str], ids: Sequence[Sequence[int]]) -> str | None:
        """The first segment that the library encodes otherwise.

        The library puts a space mark in front of a text. A segment that begins with one goes in
        without it; any other goes in behind a line feed, whose two ids are cut off.
        """
        asked = [s[1:] if s[0] == MARK else "\n" + s for s in segments]
        for segment, own, other in zip(segments, ids, self.library.encode(asked, num_threads=1), strict=True):
            if list(own) != (other if segment[0] == MARK else other[2:]) and segment != MARK:
                return segment
        return None


def marked(text: str) -> str:
    return MARK + text.replace(" ", MARK) if text else ""


def _utf8(raw: bytes) -> str:
    """Valid sequences as characters, every other byte as U+FFFD."""
    try:
        return raw.decode()
    except UnicodeDecodeError:
        out, i = [], 0
        while i < len(raw):
            for n in (1, 2, 3, 4):
                try:
                    out.append(raw[i : i + n].decode())
                    i += n
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                i += 1
        return "".join(out)


def read_model(path: str | Path) -> bytes:
    return Path(path).read_bytes()


def encode_and_decode(docs: DataFrame, model: bytes, text: str = "text", check: bool = True) -> DataFrame:
    """``docs`` with ids (array<int>, no begin or end ids) and decoded, the text of these ids.

    One pass without a shuffle. ``model`` is the content of the model file; it is broadcast.
    """
    kept = [f for f in docs.schema.fields if f.name.lower() not in ("ids", "decoded")]
    schema = T.StructType(
        [*kept, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())]
    )
    shared = docs.sparkSession.sparkContext.broadcast({"model": model})
    names = [f.name for f in kept]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A worker keeps its copy of the broadcast value, and with it the segments of earlier tasks.
        state = shared.value
        pieces = state.setdefault("pieces", None) or Pieces(state["model"])
        state["pieces"] = pieces
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS_OUT):
                batch = whole.slice(start, ROWS_OUT)
                cut = [pieces.segments(marked(t or "")) for t in batch.column(text).to_pylist()]
                known, decoded_of = pieces.learn(set().union(*cut), check)
                rows = [b"".join(map(known.__getitem__, segments)) for segments in cut]
                offsets = np.zeros(len(rows) + 1, dtype=np.int32)
                np.cumsum([len(r) // 4 for r in rows], out=offsets[1:])
                values = np.frombuffer(b"".join(rows), dtype=np.int32)
                decoded = [decoded_of(segments)[1:] for segments in cut]
                yield pa.RecordBatch.from_arrays(
                    [
                        *[batch.column(n) for n in names],
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(values)),
                        pa.array(decoded, pa.string()),
                    ],
                    names=[*names, "ids", "decoded"],
                )

    return docs.mapInArrow(run, schema)
