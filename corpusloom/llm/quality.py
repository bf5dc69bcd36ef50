"""Quality rules: a threshold table compiled into one projection.

``quality_metrics`` measures a text with column expressions only; ``passes`` turns a table of
(rule, metric, least, most) into one Boolean expression. There is no shuffle and no user function.

Null texts count as empty. A text without words fails the base rules; metrics of such a text are 0.
Repeated rows are judged each on their own; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import SPACE, fresh_name, words_of

SYMBOLS = "#*$%&|<>"

#: Frequent function words of four languages.
STOP_WORDS = tuple(
    "the of and to in is a that it for on with as was be by are this from he an or at not "
    "de la le les et des un une du en que qui est dans pour par sur pas avec au "
    "die der und das den zu von ist im dem nicht ein eine mit auf für sich als auch "
    "el los las y se del es con para su lo como".split()
)


@dataclass(frozen=True)
class Rule:
    """A text passes when ``metric`` lies between ``least`` and ``most``, both included."""

    name: str
    metric: str
    least: float | None = None
    most: float | None = None


RULES = (
    Rule("mean word length", "mean_word_chars", least=2.0, most=10.0),
    Rule("symbols per word", "symbol_ratio", most=0.1),
    Rule("stop words per word", "stop_ratio", least=0.02),
    Rule("repeated lines per line", "dup_line_ratio", most=0.5),
)

LEAST_WORDS = 50
MOST_REPEATED_PERCENT = 50


def passes(rules: Sequence[Rule]) -> Column:
    """All rules as one expression over the metric columns."""
    tests = []
    for rule in rules:
        if rule.least is not None:
            tests.append(F.col(rule.metric) >= F.lit(float(rule.least)))
        if rule.most is not None:
            tests.append(F.col(rule.metric) <= F.lit(float(rule.most)))
    result = F.lit(True)
    for test in tests:
        result = result & test
    return result


def _repeated_words(words: Column, hashes: Column) -> Column:
    """Words inside 3-word windows that occur at least twice.

    Windows are compared by 64-bit hashes. Only texts with an equal pair sort theirs; equal hashes
    then stand next to each other with their positions.
    """
    placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    again = F.element_at(
        F.transform(
            F.array(placed),
            lambda s: F.transform(
                F.filter(
                    s,
                    lambda x, k: (F.get(s, k - 1)["h"] == x["h"]).eqNullSafe(True)
                    | (F.get(s, k + 1)["h"] == x["h"]).eqNullSafe(True),
                ),
                lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2),
            ),
        ),
        1,
    )
    unique = F.size(hashes) == F.size(F.array_distinct(hashes))
    return F.when(unique, 0).otherwise(F.size(F.array_distinct(F.flatten(again)))).cast("bigint")


def quality_metrics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the ratios of the rules.

    A column of ``docs`` with one of these names is replaced.
    """
    words, hashes, body, lines = (
        fresh_name(docs, f"__{n}") for n in ("words", "hashes", "body", "lines")
    )
    made = [
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "mean_word_chars", "symbol_ratio", "stop_ratio", "dup_line_ratio",
    ]
    kept = [c for c in docs.columns if c.lower() not in made]
    body_text = F.coalesce(F.col(text), F.lit(""))
    df = docs.select(*kept, body_text.alias(body))
    has_word = lambda line: line.rlike(r"[^\x20\x09-\x0D]")
    df = df.select(
        "*", words_of(F.col(body), SPACE).alias(words), F.filter(F.split(body, "\n"), has_word).alias(lines)
    )
    w = F.col(words)
    windows = F.when(
        F.size(w) >= 3,
        F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2])),
    ).otherwise(F.array().cast("array<bigint>"))
    df = df.select("*", windows.alias(hashes))
    n_chars = F.length(body)
    stop = F.size(F.filter(w, lambda x: x.isin(*STOP_WORDS)))
    df = df.select(
        *kept,
        F.size(w).cast("bigint").alias("n_words"),
        F.length(F.translate(body, " \t\n\x0b\x0c\r", "")).cast("bigint").alias("word_chars"),
        (n_chars - F.length(F.translate(body, SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint").alias("n_dup_lines"),
        _repeated_words(w, F.col(hashes)).alias("n_repeat_words"),
        F.size(lines).alias(lines),
        stop.alias(words),
    )
    per_word = lambda c: F.when(F.col("n_words") > 0, c / F.col("n_words")).otherwise(0.0)
    return df.select(
        *kept, *made[:5],
        per_word(F.col("word_chars")).alias("mean_word_chars"),
        per_word(F.col("n_symbols")).alias("symbol_ratio"),
        per_word(F.col(words)).alias("stop_ratio"),
        F.when(F.col(lines) > 0, F.col("n_dup_lines") / F.col(lines)).otherwise(0.0).alias("dup_line_ratio"),
    )


def judge_quality(docs: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """The metrics, ``base_failed`` (too short or mostly repeated) and ``kept``."""
    df = quality_metrics(docs, text)
    df = df.select(*[c for c in df.columns if c.lower() not in ("base_failed", "kept")])
    failed = (F.col("n_words") < LEAST_WORDS) | (
        100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words")
    )
    return df.select("*", failed.alias("base_failed"), (~failed & passes(rules)).alias("kept"))
