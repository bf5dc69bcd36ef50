"""Completion tasks, prompts and other text transforms as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.common import after_first, left_of, let, right_from

# The placeholder of a completion task and the fill-in-the-middle marker tokens.
PLACEHOLDER = "<todo>"
FIM_PREFIX = "<fim-prefix>"
FIM_SUFFIX = "<fim-suffix>"
FIM_MIDDLE = "<fim-middle>"
FIM_PAD = "<fim-pad>"

_STRIP = r"^[ \t\r\f\x0b]+|[ \t\r\f\x0b]+$"
_STRIP_RIGHT = r"[ \t\r\f\x0b]+$"


def has_placeholder(code: Column) -> Column:
    return F.contains(code, F.lit(PLACEHOLDER))


def split_placeholder(code: Column, strict: bool = False) -> Column:
    """struct(prefix, suffix) around the first placeholder; later ones stay in the suffix.

    Without a placeholder the struct is null, or the job fails when ``strict``.
    """
    at = F.instr(code, PLACEHOLDER)
    parts = F.struct(
        left_of(code, at - 1).alias("prefix"),
        right_from(code, at + len(PLACEHOLDER)).alias("suffix"),
    )
    if not strict:
        return F.when(at > 0, parts)
    missing = F.raise_error(F.lit("completion task without placeholder"))
    return F.when(at > 0, parts).otherwise(missing.cast("struct<prefix:string,suffix:string>"))


def join_placeholder(prefix: Column, suffix: Column) -> Column:
    return F.concat(prefix, F.lit(PLACEHOLDER), suffix)


def full_code(prefix: Column, completion: Column, suffix: Column) -> Column:
    return F.concat(prefix, completion, suffix)


def fim_prompt(prefix: Column, suffix: Column) -> Column:
    """Prompt in prefix-suffix-middle order."""
    return F.concat(F.lit(FIM_PREFIX), prefix, F.lit(FIM_SUFFIX), suffix, F.lit(FIM_MIDDLE))


def extract_completion(response: Column, suffix: Column, lang_id: Column) -> Column:
    """Completion text behind the first middle marker, '' without one.

    Ruby: when the line after the hole is an ``end`` line, the completion stops before its own
    first line of exactly that text, since models tend to close the block once more. A match on
    the very first line gives '' (nothing before it is left).
    """
    second_line = F.regexp_replace(
        F.coalesce(F.get(F.split(suffix, "\n"), F.lit(1)), F.lit("")), _STRIP_RIGHT, ""
    )
    closes_block = (lang_id == "ruby") & (F.regexp_replace(second_line, _STRIP, "") == "end")

    def cut(completion: Column) -> Column:
        line = F.concat(F.lit("\n"), second_line, F.lit("\n"))
        at = F.instr(F.concat(F.lit("\n"), completion), line)
        return F.when(
            closes_block & (at > 0), left_of(completion, F.greatest(at - 2, F.lit(0)))
        ).otherwise(completion)

    return let(after_first(response, FIM_MIDDLE), cut)


def model_id_to_fn(model_id: Column) -> Column:
    return F.replace(model_id, F.lit("/"), F.lit("--"))


def model_id_from_fn(file_name: Column) -> Column:
    """Inverse of :func:`model_id_to_fn` for ids without a double dash."""
    return F.replace(file_name, F.lit("--"), F.lit("/"))


def lang_from_filename(name: Column) -> Column:
    """Language id from a file name: known extensions by name, others without their dot."""
    base = F.regexp_replace(F.substring_index(name, "/", -1), r"^\.+", "")
    ext = F.regexp_extract(base, r"^.+\.([^.]*)$", 1)
    return F.when(ext == "py", "python").when(ext == "rb", "ruby").otherwise(ext)


def embedding_key(text: Column) -> Column:
    """Text as the embedder sees it, and the key of the embedding cache."""
    return F.replace(text, F.lit("\n"), F.lit(" "))


def cutoff_at_sentence(text: Column, max_words: int = 5000) -> Column:
    """Text cut behind the last sentence end within the first ``max_words`` words.

    Words are separated by single spaces, so empty words count. Shorter texts stay as they are;
    without any sentence end only the start of the text is left.
    """

    def cut(words: Column) -> Column:
        head = F.slice(words, 1, max_words + 1)
        ends = F.transform(F.reverse(head), lambda w: F.endswith(w, F.lit(".")))
        first_end = F.array_position(ends, F.lit(True))
        skipped = F.when(first_end > 0, first_end - 1).otherwise(F.size(head) - 1)
        return F.array_join(F.slice(words, F.lit(1), (max_words - skipped + 1).cast("int")), " ")

    return let(
        F.split(text, " "),
        lambda words: F.when(F.size(words) < max_words, text).otherwise(cut(words)),
    )
