"""SimHash near-duplicates by the generalised pigeonhole principle.

A text's fingerprint has a bit set when the bit is set in more than half of the hashes of its shingles.
Fingerprints within ``distance`` bits are linked; the classes are the connected components.

Search among the distinct fingerprints, none of which is ever collected:

1. Bits are counted in pairs over all fingerprints, and correlated bits grouped into ``ATOMS`` atoms.
2. Each atom's histogram (256 cells, over all fingerprints) gives the number of pairs by distance
   inside the atom; distances inside a part, a union of atoms, follow by convolution.
3. If the thresholds of m parts add up to distance - m + 1, every pair within the distance has a part
   within its threshold (-1: the part is never looked at). For each m a dynamic program finds the
   thresholds with the least cost of probes and candidates; the best m wins.
4. Every fingerprint stands in the index under its value of each part in use, and probes the values
   within the part's threshold that are not smaller than its own, so each pair meets from one side.
   Pairs are verified inside the join.
5. Buckets with more than ``hot_bucket`` members are not joined. Their members, and what would probe
   them, are linked through centres: two fingerprints are within three bits exactly if some centre is
   within one bit of the one and two bits of the other, and then all within one bit of this centre
   are linked to all within two. Of three differing bits two lie in one half, so only flips of two bits
   in one half are needed. The smallest fingerprint within one bit stands for the centre. This is
   linear in the members and loses no link.

Null and empty texts have fingerprint zero and are linked like any other. Repeated rows are kept each. A
component is named by its smallest doc_id; rows without doc_id get the name of their component, null
if no member has one. Long texts are hashed whole. An empty table gives an empty result.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.common import fresh_name
from corpusloom.llm.components import components
from corpusloom.session import checkpointed

BITS = 64
ATOMS = 8
DISTANCE = 3
SHINGLE_WORDS = 3
SEED = 42
#: Rows dropped whose numbers are broadcast.
MOST_DROPPED = 1_000_000
HOT_BUCKET = 2000
#: Cost of one exchanged row, counted in comparisons of two fingerprints inside the join.
ROW_COST = 10.0
#: Variants that one fingerprint may be given in one part.
MOST_PROBES = 2500

_UPPER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


# -- fingerprints ----------------------------------------------------------------------------------


def shingle_hashes(text: str | None, shingle_words: int = SHINGLE_WORDS) -> np.ndarray:
    """A hash for each run of words; a shorter text is one run, a text without words has none.

    Words are separated by ASCII white space, A-Z count as a-z.
    """
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").translate(_UPPER).split()
    if not words:
        return np.empty(0, np.uint64)
    n = max(1, len(words) - shingle_words + 1)
    line = b" ".join(words)
    view = memoryview(line)
    ends = list(itertools.accumulate(len(w) + 1 for w in words))
    last = ends[shingle_words - 1 :] or ends[-1:]
    first = [0, *ends[: n - 1]]
    return np.array([xxh64_intdigest(view[a : b - 1], SEED) for a, b in zip(first, last, strict=True)], np.uint64)


def fingerprint_of(text: str | None, shingle_words: int = SHINGLE_WORDS) -> int:
    """The fingerprint as an unsigned number.

    The bit counts are taken from blocks of hashes, so a very long text needs little memory beside its words.
    """
    hashes = shingle_hashes(text, shingle_words)
    n = len(hashes)
    if not n:
        return 0
    counts = np.zeros(BITS, np.int64)
    for at in range(0, n, 65536):
        bits = np.unpackbits(hashes[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += np.add.reduce(bits, axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def with_fingerprint(docs: DataFrame, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """``docs`` with the fingerprint as a signed BIGINT; one pass, no shuffle."""

    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint_of(t) for t in texts], np.uint64).view(np.int64))

    udf = F.pandas_udf(run, T.LongType())
    return docs.withColumn(name, udf(F.col(text)))


# -- the plan: parts and thresholds ----------------------------------------------------------------


@dataclass(frozen=True)
class Part:
    bits: tuple[int, ...]
    threshold: int

    @property
    def mask(self) -> int:
        return sum(1 << b for b in self.bits)


def pair_counts(prints: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints and, for each pair of bits, in how many both are set; over all rows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BITS, BITS), np.int64)
        n = 0
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for at in range(0, len(values), 65536):
                block = values[at : at + 65536].view(np.uint8).reshape(-1, 8)
                bits = np.unpackbits(block, axis=1, bitorder="little").astype(np.float32)
                total += np.rint(bits.T @ bits).astype(np.int64)
                n += len(bits)
        cells = np.append(total.ravel(), n)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cells))), pa.array(cells)], names=["i", "n"])

    rows = prints.mapInArrow(run, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).collect()
    cells = np.zeros(BITS * BITS + 1, np.int64)
    for i, n in rows:
        cells[i] = n
    return int(cells[-1]), cells[:-1].reshape(BITS, BITS)


def group_bits(n: int, both: np.ndarray) -> list[tuple[int, ...]]:
    """Atoms of correlated bits: each starts with the strongest free pair and takes the closest bits."""
    if n:
        p = np.diag(both) / n
        spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
        close = np.abs(both / n - np.outer(p, p)) / np.outer(spread, spread)
    else:
        close = np.zeros((BITS, BITS))
    np.fill_diagonal(close, 0)
    free = set(range(BITS))
    atoms = []
    while free:
        pool = sorted(free)
        i, j = max(itertools.combinations(pool, 2), key=lambda x: close[x])
        atom = [i, j]
        while len(atom) < BITS // ATOMS:
            rest = [b for b in pool if b not in atom]
            atom.append(max(rest, key=lambda b: close[b, atom].sum()))
        atoms.append(tuple(sorted(atom)))
        free -= set(atom)
    return atoms


def _value_in(column: Column, bits: Sequence[int]) -> Column:
    """The bits of a fingerprint as a small number."""
    total = F.lit(0).cast("long")
    for k, b in enumerate(bits):
        total = total.bitwiseOR(F.shiftleft(F.shiftrightunsigned(column, b).bitwiseAND(F.lit(1)), k))
    return total


def distance_shares(prints: DataFrame, atoms: Sequence[Sequence[int]]) -> list[np.ndarray]:
    """For each atom, the share of ordered pairs of fingerprints at each distance inside the atom."""
    cells = F.array(*[F.struct(F.lit(a).alias("a"), _value_in(F.col("fp"), bits).alias("v")) for a, bits in enumerate(atoms)])
    rows = (
        prints.select(F.explode(cells).alias("c")).groupBy("c.a", "c.v").agg(F.count("*").alias("n")).collect()
    )
    width = BITS // ATOMS
    histograms = np.zeros((len(atoms), 1 << width))
    for a, v, n in rows:
        histograms[a, v] = n
    return [pair_distances(h) for h in histograms]


def pair_distances(histogram: np.ndarray) -> np.ndarray:
    """Share of ordered pairs by distance: the xor-correlation of a histogram, by the Walsh transform."""
    h = histogram / max(histogram.sum(), 1)
    size = len(h)
    f = h.copy()
    step = 1
    while step < size:
        f = f.reshape(-1, 2, step)
        f = np.stack([f[:, 0] + f[:, 1], f[:, 0] - f[:, 1]], axis=1).reshape(-1)
        step *= 2
    f = f * f
    step = 1
    while step < size:
        f = f.reshape(-1, 2, step)
        f = np.stack([f[:, 0] + f[:, 1], f[:, 0] - f[:, 1]], axis=1).reshape(-1)
        step *= 2
    weight = np.array([i.bit_count() for i in range(size)])
    return np.bincount(weight, weights=np.maximum(f / size, 0), minlength=size.bit_length())


def allocate(costs: Sequence[Sequence[float]], total: int) -> tuple[float, tuple[int, ...]]:
    """Thresholds from -1 up with the given sum and the least cost; costs[i][t + 1] is part i at t."""
    best: dict[int, tuple[float, tuple[int, ...]]] = {0: (0.0, ())}
    for row in costs:
        following: dict[int, tuple[float, tuple[int, ...]]] = {}
        for spent, (cost, chosen) in best.items():
            for t in range(-1, len(row) - 1):
                key, value = spent + t, (cost + row[t + 1], (*chosen, t))
                if key not in following or value < following[key]:
                    following[key] = value
        best = following
    return best[total]


def plan_parts(n: int, atoms: Sequence[Sequence[int]], shares: Sequence[np.ndarray], distance: int) -> list[Part]:
    """The parts and thresholds with the least estimated cost for n fingerprints."""
    best: tuple[float, list[Part]] | None = None
    for m in range(1, ATOMS + 1):
        edges = [round(k * ATOMS / m) for k in range(m + 1)]
        groups = [list(range(a, b)) for a, b in itertools.pairwise(edges)]
        costs = []
        for group in groups:
            share = np.ones(1)
            for a in group:
                share = np.convolve(share, shares[a])
            width = sum(len(atoms[a]) for a in group)
            row = [0.0]
            for t in range(distance + 1):
                probes = sum(float(np.prod(range(width - k + 1, width + 1)) / np.prod(range(1, k + 1))) for k in range(t + 1))
                candidates = n / 2 * float(share[: t + 1].sum())
                rows = ROW_COST * (1 + (1 + probes) / 2) if probes <= MOST_PROBES else float("inf")
                row.append(rows + candidates)
            costs.append(row)
        cost, thresholds = allocate(costs, distance - m + 1)
        if best is None or cost < best[0]:
            parts = [
                Part(tuple(sorted(b for a in group for b in atoms[a])), t)
                for group, t in zip(groups, thresholds, strict=True)
                if t >= 0
            ]
            best = (cost, parts)
    return best[1]


# -- the search ------------------------------------------------------------------------------------


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def flips(bits: Sequence[int], most: int) -> list[int]:
    """Masks of up to ``most`` of the bits, as signed numbers."""
    return [
        _signed(sum(1 << b for b in chosen))
        for k in range(most + 1)
        for chosen in itertools.combinations(bits, k)
    ]


def _keys(prints: DataFrame, parts: Sequence[Part], probing: bool) -> DataFrame:
    """(part, value, fp): the index entries, or the probes whose value is not below the own one."""
    def values(part: Part) -> Column:
        own = F.col("fp").bitwiseAND(F.lit(_signed(part.mask)))
        if not probing or part.threshold == 0:
            return F.array(own)
        masks = F.array(*[F.lit(m).cast("long") for m in flips(part.bits, part.threshold)])
        return F.filter(F.transform(masks, lambda m: own.bitwiseXOR(m)), lambda v: v >= own)

    def named(i: int, part: Part) -> Column:
        return F.transform(values(part), lambda v: F.struct(F.lit(i).alias("part"), v.alias("value")))

    cells = [named(i, part) for i, part in enumerate(parts)]
    return prints.select("fp", F.explode(F.concat(*cells)).alias("k")).select("k.part", "k.value", "fp")


def _within(distance: int) -> Column:
    return F.bit_count(F.col("p.fp").bitwiseXOR(F.col("i.fp"))) <= distance


def centre_links(members: DataFrame, distance: int) -> DataFrame:
    """Links (a, b) that connect exactly what pairs within the distance connect; linear in the members."""
    if not 1 <= distance <= 3:
        raise ValueError("centres are defined for distances from 1 to 3")
    halves = (range(BITS // 2), range(BITS // 2, BITS))
    near = flips(range(BITS), 1) if distance > 1 else [0]
    if distance == 1:
        far = flips(range(BITS), 1)[1:]
    elif distance == 2:
        far = []
    else:
        far = [m for half in halves for m in flips(half, 2) if m not in set(flips(half, 1))]
    of = lambda masks: F.array(*[F.lit(m).cast("long") for m in masks])
    spread = F.concat(
        F.transform(of(near), lambda m: F.struct(F.col("fp").bitwiseXOR(m).alias("c"), F.lit(True).alias("near"))),
        F.transform(of(far), lambda m: F.struct(F.col("fp").bitwiseXOR(m).alias("c"), F.lit(False).alias("near")))
        if far
        else F.array().cast("array<struct<c:bigint,near:boolean>>"),
    )
    rows = members.select("fp", F.explode(spread).alias("x")).select("fp", "x.c", "x.near")
    rows = checkpointed(rows, "centres")
    heads = rows.groupBy("c").agg(
        F.min(F.when(F.col("near"), F.col("fp"))).alias("head"), F.min("fp").alias("lo"), F.max("fp").alias("hi")
    ).where("head is not null and lo <> hi").select("c", "head")
    return rows.join(heads, "c").where("fp <> head").select(F.col("head").alias("a"), F.col("fp").alias("b")).distinct()


def link_fingerprints(
    prints: DataFrame, distance: int = DISTANCE, hot_bucket: int = HOT_BUCKET, parts: Sequence[Part] | None = None
) -> DataFrame:
    """Links (a, b) between distinct fingerprints whose components are those of all pairs in reach.

    A link may be given several times.
    ``prints`` has one column fp, without repetition; it is read several times, so it should be stored.
    """
    if parts is None:
        n, both = pair_counts(prints)
        atoms = group_bits(n, both)
        parts = plan_parts(n, atoms, distance_shares(prints, atoms), distance)
    index = _keys(prints, parts, probing=False)
    probes = _keys(prints, parts, probing=True)
    hot = checkpointed(
        index.groupBy("part", "value").count().where(F.col("count") > hot_bucket).select("part", "value"), "hot"
    )
    pairs = None
    if hot.isEmpty():
        cold_index, cold_probes = index, probes
    else:
        keys = ["part", "value"]
        cold_index, cold_probes = index.join(hot, keys, "left_anti"), probes.join(hot, keys, "left_anti")
        touched = index.join(hot, keys, "left_semi").unionByName(probes.join(hot, keys, "left_semi"))
        pairs = centre_links(touched.select("fp").distinct(), distance)
    near = cold_probes.alias("p").join(
        cold_index.alias("i"),
        (F.col("p.part") == F.col("i.part")) & (F.col("p.value") == F.col("i.value"))
        & (F.col("p.fp") != F.col("i.fp")) & _within(distance),
    ).select(F.least("p.fp", "i.fp").alias("a"), F.greatest("p.fp", "i.fp").alias("b"))
    return near if pairs is None else near.unionByName(pairs)


def near_duplicates(
    prints: DataFrame, doc_id: str = "doc_id", fingerprint: str = "fingerprint", distance: int = DISTANCE,
    hot_bucket: int = HOT_BUCKET,
) -> DataFrame:
    """One row per distinct fingerprint: fp, root (its component) and component_id (the smallest doc_id).

    ``prints`` has a row per document; it is read several times, so it should be stored.
    """
    copies = checkpointed(
        prints.groupBy(F.col(fingerprint).alias("fp")).agg(F.min(doc_id).alias("least_id")), "fingerprints"
    )
    roots = components(link_fingerprints(copies.select("fp"), distance, hot_bucket))
    joined = copies.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    linked = joined.where("root is not null")
    names = linked.groupBy("root").agg(F.min("least_id").alias("component_id"))
    single = joined.where("root is null").select("fp", F.col("fp").alias("root"), F.col("least_id").alias("component_id"))
    return linked.join(names, "root").select("fp", "root", "component_id").unionByName(single)


def near_duplicate_classes(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id, one row per row of ``docs``."""
    prints = checkpointed(with_fingerprint(docs.select(doc_id, text), text, "fp").select(doc_id, "fp"), "simhash")
    classes = near_duplicates(prints, doc_id, "fp")
    return prints.join(classes, "fp").select(
        F.col(doc_id).alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def drop_near_duplicates(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", most_broadcast: int = MOST_DROPPED
) -> DataFrame:
    """One row of every component stays: the one with the smallest doc_id, null ids last.

    The fingerprints are computed once, stored beside the rows with a number for every row. What stays is decided on
    (number, id, fingerprint) alone; of repeated rows one stays. The numbers of the rows that go are broadcast when
    they are ``most_broadcast`` or fewer, so no text is moved; beyond that the rows are joined by number.
    """
    name, row = fresh_name(docs, "__fp"), fresh_name(docs, "__row")
    numbered = with_fingerprint(docs, text, name).withColumn(row, F.monotonically_increasing_id())
    stored = checkpointed(numbered, "fingerprinted")
    narrow = stored.select(F.col(doc_id).alias("doc_id"), F.col(name).alias("fp"), F.col(row).alias("row"))
    classes = near_duplicates(narrow, "doc_id", "fp")
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), "fp", "row")
    best = narrow.join(classes, "fp").groupBy("root").agg(F.min(order).alias("k")).select(F.col("k.row").alias("row"))
    gone = checkpointed(narrow.select("row").join(best, "row", "left_anti"), "gone").withColumnRenamed("row", row)
    if gone.count() <= most_broadcast:
        gone = F.broadcast(gone)
    return stored.join(gone, row, "left_anti").select(*docs.columns)
