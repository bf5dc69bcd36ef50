r"""Chat formatting with column expressions.

The rows of a conversation become one training string and the places that count for the loss:

    ### user          a header opens a run of rows of one role
    text</turn>       each row of the run ends with a closing mark, so rows can be told apart again
    ### assistant     ...

Control strings inside texts and roles are escaped, so the output can be read back: a backslash
becomes ``\\``, ``</turn>`` becomes ``\t``, ``###`` becomes ``\h`` and, in roles, a line feed ``\n``.

The turns of a conversation are collected as structs and sorted; neighbours of one role are merged into a run,
an array of their texts, and the string is concatenated from the runs. Everything below a conversation is
array expressions. An array that a lambda looks into is bound by ``_let`` first, as the optimiser would else
put its expression into the lambda and evaluate it for every element; so formatting and reading take time
linear in the length of a conversation.

Rows are ordered by turn, then role, then text. A null text or role is empty, a null turn comes first,
rows with a null id form one conversation. Repeated rows are kept, an empty table gives no conversations. Other
columns are not carried. A conversation is one group, as its string is one cell.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEADER = "### "
CLOSE = "</turn>"
ASSISTANT = "assistant"
#: Sums before an element add up to so many elements one by one; whole blocks of them are summed once.
BLOCK = 64
LEVELS = 3


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once."""
    return F.get(F.transform(F.array(value), body), 0)


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("bigint"), lambda a, x: a + x)


def _sums_before(values: Column, levels: int = LEVELS) -> Column:
    """The sum of the elements before each one, by sums of blocks, of blocks of blocks and so on."""
    if not levels:
        return F.transform(values, lambda _, i: _total(F.slice(values, 1, i)))

    def by_blocks(bases: Column) -> Column:
        return F.transform(
            values,
            lambda _, i: F.get(bases, (i / BLOCK).cast("int")) + _total(F.slice(values, i - i % BLOCK + 1, i % BLOCK)),
        )

    # One number more than there are blocks, so that no values are not counted downwards.
    numbers = F.sequence(F.lit(0), F.ceil(F.size(values) / BLOCK).cast("int"))
    blocks = F.transform(numbers, lambda b: _total(F.slice(values, b * BLOCK + 1, BLOCK)))
    return _let(blocks, lambda b: _let(_sums_before(b, levels - 1), by_blocks))


def escape(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    text = F.replace(text, F.lit("###"), F.lit("\\h"))
    return F.replace(text, F.lit(CLOSE), F.lit("\\t"))


def unescape(text: Column) -> Column:
    """The text before ``escape``: pairs of backslashes are set apart first."""
    parts = F.split(text, r"\\\\")
    plain = F.transform(
        parts,
        lambda p: F.replace(
            F.replace(F.replace(p, F.lit("\\t"), F.lit(CLOSE)), F.lit("\\h"), F.lit("###")),
            F.lit("\\n"),
            F.lit("\n"),
        ),
    )
    return F.array_join(plain, "\\")


def format_chats(
    rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    trained_role: str = ASSISTANT,
) -> DataFrame:
    """One row per conversation: conv_id, messages, formatted, loss.

    ``messages`` holds the runs: array<struct<role, texts>>, adjacent rows of one role merged.
    ``loss`` holds array<struct<turn, start, len>>: the escaped texts of the trained role without marks, by their
    place in code points of ``formatted`` and by the number of the turn, whose closing mark ends the span.
    """
    turn_struct = F.struct(
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    )
    chats = rows.groupBy(F.col(conv_id).alias("conv_id")).agg(F.array_sort(F.collect_list(turn_struct)).alias("turns"))

    def from_runs(runs: Column) -> Column:
        messages = F.transform(runs, lambda r: F.struct(r["role"].alias("role"), r["texts"].alias("texts")))
        strings = F.transform(
            runs,
            lambda r: F.concat(
                r["header"], F.array_join(F.transform(r["escaped"], lambda e: F.concat(e, F.lit(CLOSE))), "")
            ),
        )
        sizes = F.flatten(
            F.transform(
                runs,
                lambda r: F.transform(
                    r["escaped"],
                    lambda e, j: (
                        F.length(e) + len(CLOSE) + F.when(j == 0, F.length(r["header"])).otherwise(0)
                    ).cast("bigint"),
                ),
            )
        )
        loss = _let(sizes, lambda s: _let(_sums_before(s), lambda before: _loss(runs, before, trained_role)))
        return F.struct(
            messages.alias("messages"), F.array_join(strings, "").alias("formatted"), loss.alias("loss")
        )

    whole = _let(F.col("turns"), lambda turns: _let(_runs(turns), from_runs))
    return chats.select("conv_id", whole.alias("whole")).select("conv_id", "whole.*")


def _runs(turns: Column) -> Column:
    """Neighbouring turns of one role as array<struct<first, role, header, texts, escaped>>."""
    other = lambda i: F.get(turns, i - 1)["role"] != F.get(turns, i)["role"]
    firsts = F.filter(F.sequence(F.lit(0), F.size(turns) - 1), lambda i: (i == 0) | other(i))

    def run(firsts: Column, first: Column, k: Column) -> Column:
        following = F.coalesce(F.get(firsts, k + 1), F.size(turns))
        role = F.get(turns, first)["role"]
        texts = F.transform(F.slice(turns, first + 1, following - first), lambda t: t["text"])
        header = F.concat(F.lit(HEADER), F.replace(escape(role), F.lit("\n"), F.lit("\\n")), F.lit("\n"))
        return _let(
            texts,
            lambda t: F.struct(
                first.alias("first"), role.alias("role"), header.alias("header"), t.alias("texts"),
                F.transform(t, escape).alias("escaped"),
            ),
        )

    return _let(firsts, lambda f: F.transform(f, lambda first, k: run(f, first, k)))


def _loss(runs: Column, before: Column, trained_role: str) -> Column:
    """Spans of the escaped texts of the trained role; ``before`` holds the characters before each turn."""

    def spans(r: Column) -> Column:
        return F.transform(
            r["escaped"],
            lambda e, j: F.struct(
                (r["first"] + j).alias("turn"),
                (F.get(before, r["first"] + j) + F.when(j == 0, F.length(r["header"])).otherwise(0)).alias("start"),
                F.length(e).alias("len"),
            ),
        )

    return F.flatten(F.transform(F.filter(runs, lambda r: r["role"] == trained_role), spans))


def _pieces(formatted: Column) -> Column:
    """What stands before each closing mark: the text of a turn, with its header if it opens a run."""
    pieces = F.split(formatted, CLOSE)
    return _let(pieces, lambda p: F.slice(p, 1, F.size(p) - 1))


def read_chat(formatted: Column) -> Column:
    """The rows of a formatted conversation: array<struct<role, text>>, in order.

    The text is split at closing marks. A piece that begins with a header opens a run; the pieces up
    to the next one belong to it.
    """

    def read(pieces: Column) -> Column:
        opens = lambda i: F.startswith(F.get(pieces, i), F.lit(HEADER))
        # No piece at all gives one number too many, which opens nothing.
        firsts = F.filter(F.sequence(F.lit(0), F.greatest(F.size(pieces) - 1, F.lit(0))), opens)

        def run(firsts: Column, first: Column, k: Column) -> Column:
            following = F.coalesce(F.get(firsts, k + 1), F.size(pieces))
            opening = F.get(pieces, first)
            line_end = F.instr(opening, "\n")
            role = unescape(F.substring(opening, F.lit(len(HEADER) + 1), line_end - len(HEADER) - 1))
            head = F.struct(role.alias("role"), line_end.alias("line_end"))
            return _let(
                head,
                lambda h: F.transform(
                    F.slice(pieces, first + 1, following - first),
                    lambda p, j: F.struct(
                        h["role"].alias("role"),
                        unescape(
                            F.when(j == 0, F.substring(p, h["line_end"] + 1, F.length(p))).otherwise(p)
                        ).alias("text"),
                    ),
                ),
            )

        return F.flatten(_let(firsts, lambda f: F.transform(f, lambda first, k: run(f, first, k))))

    return _let(_pieces(formatted), read)


def loss_text(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped, in order.

    The string is cut at its closing marks once; a span is the end of the piece of its turn.
    """

    def under(pieces: Column) -> Column:
        def part(span: Column) -> Column:
            return _let(
                F.get(pieces, span["turn"]),
                lambda p: unescape(F.substring(p, F.length(p) - span["len"] + 1, F.length(p))),
            )

        return F.array_join(F.transform(loss, part), "")

    return _let(_pieces(formatted), under)
