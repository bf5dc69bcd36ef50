"""HTML rendering of code and of model responses, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.common import let
from corpusloom.functions.text import PLACEHOLDER

# A fenced block of a finished response; only this tag is recognised there.
_PYTHON_BLOCK = r"```python([\s\S]*?)```"

# A fenced block in a streamed response: white space, fence, any tag, white space (kept), then
# everything up to white space and the closing fence, or to the end of the response.
_OPEN_FENCE = r"[\n \t]```\S*(?=\s)"
_STREAM_BLOCK = _OPEN_FENCE + r"[\s\S]*?(?:[\n \t]```|\z)"
# Tail of a response that could still become an opening fence; it is passed on untouched.
_UNDECIDED_TAIL = r"[\n \t](?:`{0,2}|```\S*)\z"


def html_escape(text: Column) -> Column:
    for char, entity in (
        ("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"),
    ):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def highlight_placeholder(escaped: Column) -> Column:
    """Put the (escaped) placeholder of a task into a span that the report shows in red."""
    mark = PLACEHOLDER.replace("<", "&lt;").replace(">", "&gt;")
    return F.replace(escaped, F.lit(mark), F.lit(f'<span class="placeholder">{mark}</span>'))


def _interleave(texts: Column, blocks: Column) -> Column:
    """text, block, text, block, …, text joined to one string."""
    return F.array_join(
        F.transform(
            texts, lambda t, i: F.concat(t, F.coalesce(F.get(blocks, i), F.lit("")))
        ),
        "",
    )


def format_response_html(response: Column) -> Column:
    """A finished response as HTML: paragraphs, line breaks and preformatted Python blocks."""
    blocks = F.transform(
        F.regexp_extract_all(response, F.lit(_PYTHON_BLOCK), F.lit(1)),
        lambda code: F.concat(F.lit("<pre>"), code, F.lit("</pre>")),
    )
    texts = F.transform(
        F.split(response, _PYTHON_BLOCK),
        lambda t: F.replace(
            F.replace(t, F.lit("\n\n"), F.lit("</p><p>")), F.lit("\n"), F.lit("<br/>")
        ),
    )
    return F.concat(
        F.lit('<div style="font-family: monospace"><p>'),
        let(blocks, lambda b: _interleave(texts, b)),
        F.lit("</p></div>"),
    )


def stream_response_html(response: Column) -> Column:
    """The HTML that the streaming formatter has produced once a response is complete.

    The result does not depend on where token boundaries were, so the whole text is enough.
    """

    def render_block(block: Column) -> Column:
        opened = F.regexp_replace(block, r"\A[\n \t]```\S*", "\n<pre>")
        return F.regexp_replace(opened, r"[\n \t]```\z", "\n</pre>")

    def render_text(text: Column, last: Column) -> Column:
        tail = F.when(last, F.regexp_extract(text, _UNDECIDED_TAIL, 0)).otherwise(F.lit(""))
        head = F.substring(text, F.lit(1), F.length(text) - F.length(tail))
        return F.concat(F.replace(head, F.lit("\n"), F.lit("<br>\n")), tail)

    def render(texts: Column) -> Column:
        blocks = F.transform(
            F.regexp_extract_all(response, F.lit(_STREAM_BLOCK), F.lit(0)), render_block
        )
        shown = F.transform(texts, lambda t, i: render_text(t, i == F.size(texts) - 1))
        return let(blocks, lambda b: _interleave(shown, b))

    return let(F.split(response, _STREAM_BLOCK), render)


def render_response(response: Column, as_html: Column, streamed: Column | bool = False) -> Column:
    """What a code function shows: plain text, or the HTML of a finished or of a streamed response."""
    streamed = F.lit(streamed) if isinstance(streamed, bool) else streamed
    return (
        F.when(~as_html, response)
        .when(streamed, stream_response_html(response))
        .otherwise(format_response_html(response))
    )
