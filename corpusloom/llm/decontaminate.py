"""Benchmark decontamination by winnowing, with DataFrame operations only.

Of the hashes of all 5-word grams, the least one of every 6 neighbours is kept, on both sides. Any
10 words shared by a document and an item contain 6 neighbouring grams, so they share a kept one at the
same place. Training and test fingerprints are joined by hash; a hit is compared word by word and
extended by up to 5 words to each side, which reaches every 10-word window around the gram. Spans of
10 words or more are hits; spans of all kept grams together cover every shared window.

An item of fewer than 10 words is one window. For each such length in the benchmark (9 at most) the
documents' grams of that length join the same way, without winnowing.

Documents stay in their scan tasks: positions are exploded and joined inside one stage, and only hits and one
row per document are exchanged. A word is hashed once, a gram is the hash of its words' hashes. The
fingerprints of the benchmark are broadcast when their counted number is at most ``MOST_BROADCAST``; then the
join looks up the bare hash of every gram, and only where the benchmark keeps the same hash it is tested
whether the document keeps the gram too. Beyond that number the documents' grams are thinned first, and the
kept ones are joined by a shuffle and carry the 15 words around them.

Null and empty texts have no words and no hits. Documents are told apart by doc_id and text; equal rows
are judged once and given back as often as they occur. Items without words are ignored, an item without
id marks words but isn't listed, rows of one item_id count as one item.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import ascii_lower, words_of
from corpusloom.session import checkpointed

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
GRAM = 5
#: Grams of which the least is kept: a window of words holds so many.
NEIGHBOURS = WINDOW - GRAM + 1
REACH = WINDOW - GRAM
MOST_BROADCAST = 100_000
#: Rows with a hit whose keys are broadcast.
MOST_DROPPED = 1_000_000


def benchmark_words(text: Column) -> Column:
    return words_of(ascii_lower(text), SEPARATORS)


def _marks(words: Column) -> Column:
    """A hash for every word."""
    return F.transform(words, lambda w: F.xxhash64(w))


def _gram(marks: Column, p: Column, size: int, short: bool = False) -> Column:
    """The hash of the ``size`` words from ``p`` on; null unless all are there. Grams and short items differ."""
    whole = F.xxhash64(F.lit(size if short else 0), *[F.get(marks, p + k) for k in range(size)])
    return F.when((p >= 0) & (p + size <= F.size(marks)), whole)


def _run(same: Callable[[int], Column], most: int) -> Column:
    """How many of same(1), same(2), ... hold before the first that does not; null counts as not."""
    result = F.when(~F.coalesce(same(1), F.lit(False)), 0)
    for k in range(2, most + 1):
        result = result.when(~F.coalesce(same(k), F.lit(False)), k - 1)
    return result.otherwise(most)


def _kept(marks: Column, p: Column) -> Column:
    """Is the gram at ``p`` the least of some ``NEIGHBOURS`` that stand side by side?"""
    own = _gram(marks, p, GRAM)
    left = _run(lambda k: _gram(marks, p - k, GRAM) >= own, NEIGHBOURS - 1)
    right = _run(lambda k: _gram(marks, p + k, GRAM) >= own, NEIGHBOURS - 1)
    return left + right >= NEIGHBOURS - 1


def _around(words: Column, p: Column) -> Column:
    """The words from ``REACH`` before to ``WINDOW`` - 1 behind ``p``; null outside the text."""
    return F.array(*[F.get(words, p + o) for o in range(-REACH, WINDOW)])


def benchmark_fingerprints(benchmark: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(size, hash, item, around): kept grams of long items with size 0, whole items with their size."""
    items = benchmark.select(F.col(item_id).alias("item"), benchmark_words(F.col(text)).alias("words"))
    items = items.withColumn("marks", _marks(F.col("words")))
    n, marks = F.size("words"), F.col("marks")
    at = items.where(n >= WINDOW).select("*", F.explode(F.sequence(F.lit(0), n - GRAM)).alias("p"))
    kept = at.where(_kept(marks, F.col("p"))).select(
        F.lit(0).alias("size"), _gram(marks, F.col("p"), GRAM).alias("hash"), "item",
        _around(F.col("words"), F.col("p")).alias("around"),
    )
    short = items.where((n > 0) & (n < WINDOW))
    whole = F.lit(None).cast("bigint")
    for size in range(1, WINDOW):
        whole = F.when(n == size, _gram(marks, F.lit(0), size, True)).otherwise(whole)
    return kept.unionByName(
        short.select(n.alias("size"), whole.alias("hash"), "item", _around(F.col("words"), F.lit(0)).alias("around"))
    )


def contamination(
    docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
    item_text: str = "text", most_broadcast: int = MOST_BROADCAST,
) -> DataFrame:
    """Per document: doc_id, text_hash, n_words, spans (array<struct<start, end>> of words), items (array).

    One row per row of ``docs``; spans are those of the hits, sorted, and may overlap.
    """
    prints = checkpointed(benchmark_fingerprints(benchmark, item_id, item_text), "benchmark")
    sizes = {r["size"]: r["n"] for r in prints.groupBy("size").agg(F.count("*").alias("n")).collect()}
    small = sum(sizes.values()) <= most_broadcast
    short = sorted(s for s in sizes if s)

    words = docs.select(
        F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("text_hash"),
        benchmark_words(F.col(text)).alias("words"),
    )
    marked = words.select("*", _marks(F.col("words")).alias("marks"))
    # Position -1 stands for the document itself: one row that is always kept.
    p, marks = F.col("p"), F.col("marks")
    at = marked.select("*", F.explode(F.sequence(F.lit(-1), F.size("words") - 1)).alias("p"))
    gram = _gram(marks, p, GRAM)
    if not small:
        gram = F.when(_kept(marks, p), gram)
    if short:
        hashes = F.array(gram, *[_gram(marks, p, size, True) for size in short])
        none = F.array(F.lit(None).cast("bigint"))
        at = at.select("*", F.explode(F.when(p >= 0, hashes).otherwise(none)).alias("hash"))
    else:
        at = at.withColumn("hash", gram)
    document = p == -1
    at = at.where(document | F.col("hash").isNotNull())
    if small:
        prints = F.broadcast(prints)
        here = lambda o: F.get("words", p + o)
    else:
        at = at.withColumn("near", F.when(p >= 0, _around(F.col("words"), p)))
        at = at.withColumn("words", F.size("words")).drop("marks")
        here = lambda o: F.get("near", F.lit(o + REACH))
    n_words = F.size("words") if small else F.col("words")

    right = prints.withColumnRenamed("hash", "hash2")
    found = at.join(right, F.col("hash") == F.col("hash2"), "left")
    found = found.where(document | F.col("size").isNotNull())
    there = lambda o: F.get("around", F.lit(o + REACH))
    same = lambda o: here(o) == there(o)
    core = same(0)
    for k in range(1, GRAM):
        core = core & same(k)
    left = _run(lambda k: same(-k), REACH)
    right_run = _run(lambda k: same(GRAM - 1 + k), REACH)
    whole = F.lit(True)
    for k in range(WINDOW - 1):
        whole = whole & ((F.lit(k) >= F.col("size")) | F.coalesce(same(k), F.lit(False)))
    reached = core & (left + right_run + GRAM >= WINDOW)
    if small:
        reached = reached & _kept(marks, p)
    is_hit = F.coalesce(F.when(F.col("size") == 0, reached).otherwise(whole), F.lit(False))
    span = F.when(
        F.col("size") == 0,
        F.struct((p - left).alias("start"), (p + GRAM + right_run).alias("end")),
    ).otherwise(F.struct(p.alias("start"), (p + F.col("size")).alias("end")))
    hit = F.col("size").isNotNull() & is_hit
    rows = found.select(
        "doc_id", "text_hash", n_words.alias("n_words"), document.alias("document"),
        F.when(hit, span).alias("span"), F.when(hit, F.col("item")).alias("item"),
    )
    judged = rows.groupBy("doc_id", "text_hash", "n_words").agg(
        F.count(F.when(F.col("document"), 1)).cast("int").alias("copies"),
        F.array_sort(F.collect_set("span")).alias("spans"),
        F.collect_set("item").alias("items"),
    )
    return judged.select(
        "doc_id", "text_hash", F.col("n_words").cast("bigint").alias("n_words"), "spans", "items",
        F.explode(F.array_repeat(F.lit(0), F.col("copies"))).alias("copy"),
    ).drop("copy")


def covered_words(spans: Column) -> Column:
    """The number of words inside sorted spans."""
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("end"))
    folded = F.aggregate(
        spans,
        start,
        lambda a, s: F.struct(
            (a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], a["end"]))).alias("n"),
            F.greatest(s["end"], a["end"]).alias("end"),
        ),
    )
    return folded["n"]


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text",
    most_dropped: int = MOST_DROPPED, **kwargs: str,
) -> DataFrame:
    """The rows of ``docs`` without any hit.

    The keys of the rows with one are broadcast when they are ``most_dropped`` or fewer, so no text is moved; beyond
    that the rows are joined by key.
    """
    judged = contamination(docs, benchmark, doc_id, text, **kwargs)
    bad = judged.where(F.size("spans") > 0).select(
        F.col("doc_id").alias("__bad_id"), F.col("text_hash").alias("__bad_hash")
    )
    bad = checkpointed(bad.distinct(), "contaminated")
    if bad.count() <= most_dropped:
        bad = F.broadcast(bad)
    same = docs[doc_id].eqNullSafe(bad["__bad_id"]) & (F.xxhash64(docs[text]) == bad["__bad_hash"])
    return docs.join(bad, same, "left_anti")
