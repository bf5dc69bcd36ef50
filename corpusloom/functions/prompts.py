"""Prompt templates and lookups."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Prompt of each code function. The template texts are part of the contract.
CODE_FUNCTION_TEMPLATES = {
    "add-docstrings": "Please add docstrings to this piece of code:\n\n{code}\n\nCommented code:",
    "explain": "Please describe what this piece of code does:\n\n{code}",
    "implement-tests": (
        "Please implement tests for this piece of code. For Python code, use pytest.\n\n"
        "{code}\n\nTest code:"
    ),
    "improve-code": (
        "Please identify flaws in this piece of code and respond with an improved version,"
        "explaining your improvements in code comments:\n\n{code}\n\nImproved code:"
    ),
    "input-checks": (
        "Please write code that checks the inputs for the function in the code that follows.\n"
        "{code}\n\nPlease respond with the input checking code only."
    ),
    "potential-problems": (
        "What are potential problems in this piece of code?\n"
        "The code may be taken out of context, so please ignore missing imports.\n\n"
        "{code}\n\nPotential problems:"
    ),
    "review": (
        "Please review this piece of code, highlighting strengths and weaknesses in the "
        "implementation:\n\n{code}"
    ),
}

# Functions whose answers are shown as HTML; the others stay plain text.
HTML_FUNCTIONS = ("explain", "potential-problems", "review")

# Chat markup of instruction-tuned models, and chunk size in characters by model type.
CHAT_OPEN = "<|system|><|end|><|user|>"
CHAT_CLOSE = "<|end|><|assistant|>"
CHUNK_SIZES = {
    "OPENAI_DAVINCI3": 1000,
    "OPENAI_CHAT_GPT4": 1000,
    "HUGGINGFACE_GPT2": 512,
    "HUGGINGFACE_DOLLY_7B": 512,
}

# Our own wording: the question is put below the retrieved passages.
QA_TEMPLATE = (
    "Answer the question from the passages. If they do not contain the answer, say so.\n\n"
    "{context}\n\nQuestion: {question}\nAnswer:"
)


def fill(template: Column | str, **values: Column) -> Column:
    """Replace each ``{name}``. Values are inserted one after the other, in the given order."""
    text = F.lit(template) if isinstance(template, str) else template
    for name, value in values.items():
        text = F.replace(text, F.lit("{" + name + "}"), value)
    return text


def code_functions(*names: str) -> Column:
    """array<struct<fn, template, as_html>> to explode next to the code, in place of a join."""
    return F.array(
        *[
            F.struct(
                F.lit(name).alias("fn"),
                F.lit(CODE_FUNCTION_TEMPLATES[name]).alias("template"),
                F.lit(name in HTML_FUNCTIONS).alias("as_html"),
            )
            for name in (names or CODE_FUNCTION_TEMPLATES)
        ]
    )


def code_fn_prompt(template: Column, code: Column) -> Column:
    return fill(template, code=code)


def chat_wrap(prompt: Column, style: Column) -> Column:
    """Prepared prompt: ``style`` 'chat' adds the chat markup, any other leaves the text as it is."""
    return F.when(
        style == "chat", F.concat(F.lit(CHAT_OPEN), prompt, F.lit(CHAT_CLOSE))
    ).otherwise(prompt)


def chunk_size_for(model_type: Column, strict: bool = True) -> Column:
    """Chunk size of a model type; an unknown type fails the job, or is null when not strict."""
    size = F.try_element_at(
        F.create_map(*[F.lit(v) for kv in CHUNK_SIZES.items() for v in kv]), model_type
    )
    if not strict:
        return size
    unknown = F.raise_error(F.concat(F.lit("no chunk size for model type "), model_type))
    return F.coalesce(size, unknown.cast("int"))


def qa_prompt(context: Column, question: Column) -> Column:
    """All retrieved passages in one prompt."""
    head, tail = QA_TEMPLATE.split("{context}")
    return F.concat(F.lit(head), context, fill(tail, question=question))
