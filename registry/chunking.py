"""Splitters. All of them see whole documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import chunking as op
from registry.derived import table

SIZE = 400
FINE_SIZE = 60
NUM_LINES, MAX_LINES = 4, 6


def _docs(spark, sf):
    return table(spark, sf, "documents", "doc_id", "text", spread=True)


def _numbered(df, chunks):
    return op.number_parts(df.withColumn("chunks", chunks), F.col("chunks"), "doc_id").select(
        "doc_id", "part", "num_parts", F.md5("content").alias("content_md5")
    )


def chunk_parts(spark, sf):
    return _numbered(_docs(spark, sf), F.split("text", "\n"))


def char_chunks(spark, sf):
    return _numbered(_docs(spark, sf), op.char_chunks(F.col("text"), "\n", SIZE))


def _sentences(df):
    return df.withColumn("blocks", F.filter(op.split_literal(F.col("text"), ". "), lambda b: b != ""))


def line_budget_chunks(spark, sf):
    """A document with a block above the limit gives one row that says so."""
    chunks = op.line_budget_chunks(F.col("blocks"), NUM_LINES, MAX_LINES, strict=False)
    return _numbered(_sentences(_docs(spark, sf)), F.coalesce(chunks, F.array(F.lit("block too long"))))


def recursive_chunks(spark, sf):
    chunked = op.with_recursive_chunks(_docs(spark, sf), "text", "chunks", FINE_SIZE, 0)
    return _numbered(chunked, F.col("chunks"))


def markdown_chunks(spark, sf):
    headed = F.replace(F.col("text"), F.lit(".\n"), F.lit(".\n## "))
    chunked = op.with_markdown_chunks(_docs(spark, sf).withColumn("text", headed), "text", "chunks", SIZE, 0)
    return _numbered(chunked, F.col("chunks"))


def python_code_chunks(spark, sf):
    code = F.replace(F.col("text"), F.lit(".\n"), F.lit("\ndef "))
    chunked = op.with_python_code_chunks(_docs(spark, sf).withColumn("text", code), "text", "chunks", SIZE, 0)
    return _numbered(chunked, F.col("chunks"))


QUERIES = {
    fn.__name__: fn
    for fn in (
        chunk_parts, char_chunks, line_budget_chunks, recursive_chunks, markdown_chunks, python_code_chunks,
    )
}


def _sql_text(value: str) -> str:
    return " || ".join(
        "chr(10)" if c == "\n" else "chr(9)" if c == "\t" else "'" + c + "'" for c in value
    )


def sql_level(src: str, out: str, sep: str, size: int) -> str:
    """CTEs that split and re-join the open texts of ``src`` (doc_id, path, t); ``path`` is their order.

    Chunk by chunk: from each start as many pieces as fit, at least one.
    """
    gap, s = len(sep), _sql_text(sep)
    end = (
        f"greatest({{s}}, {{s}} - 1 + len(list_filter(range({{s}}, len(p) + 1), "
        f"lambda i: cum[i + 1] - cum[{{s}}] + (i - {{s}}) * {gap} <= {size})))"
    )
    return f"""
{out}_pieces AS (
  SELECT doc_id, path, list_filter(string_split(t, {s}), lambda x: x <> '') AS p
  FROM {src} WHERE length(t) > {size}),
{out}_cum AS (
  SELECT doc_id, path, p, list_concat([0], list_transform(range(1, len(p) + 1),
    lambda i: list_sum(list_transform(p[1:i], lambda x: length(x)))::BIGINT)) AS cum
  FROM {out}_pieces WHERE len(p) > 0),
{out}_walk AS (
  SELECT doc_id, path, p, cum, 1::BIGINT AS s, {end.format(s="1::BIGINT")} AS e FROM {out}_cum
  UNION ALL
  SELECT doc_id, path, p, cum, e + 1, {end.format(s="(e + 1)")} FROM {out}_walk WHERE e < len(p)),
{out} AS (
  SELECT doc_id, list_append(path, s) AS path, array_to_string(p[s:e], {s}) AS t FROM {out}_walk
  UNION ALL SELECT doc_id, path, t FROM {src} WHERE length(t) <= {size} AND t <> '')"""


def sql_fixed_width(src: str, out: str, size: int) -> str:
    return f"""
{out} AS (
  SELECT doc_id, list_append(path, k) AS path, substr(t, CAST(k * {size} + 1 AS BIGINT), {size}) AS t
  FROM (SELECT *, unnest(range(0, CAST(ceil(length(t) / {size}::DOUBLE) AS BIGINT))) AS k
        FROM {src} WHERE length(t) > {size})
  UNION ALL SELECT doc_id, path, t FROM {src} WHERE length(t) <= {size} AND t <> '')"""


SQL_PARTS = """
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY path) - 1 AS part,
    count(*) OVER (PARTITION BY doc_id) AS num_parts, md5(t) AS content_md5 FROM {src}"""


def sql_recursive(text: str, separators: list[str], size: int) -> str:
    steps = [f"l0 AS (SELECT doc_id, CAST([] AS BIGINT[]) AS path, {text} AS t FROM documents)"]
    for i, sep in enumerate(separators, start=1):
        step = sql_level(f"l{i - 1}", f"l{i}", sep, size) if sep else sql_fixed_width(f"l{i - 1}", f"l{i}", size)
        steps.append(step)
    return f"WITH RECURSIVE {','.join(steps)} {SQL_PARTS.format(src=f'l{len(separators)}')}"


ORACLE = {
    "chunk_parts": """
        SELECT doc_id, i - 1 AS part, CAST(len(l) AS BIGINT) AS num_parts, md5(l[i]) AS content_md5
        FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i
              FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))""",
    # one level; texts that already fit are split and joined to themselves again
    "char_chunks": f"""WITH RECURSIVE
        l0 AS (SELECT doc_id, CAST([] AS BIGINT[]) AS path, text AS t FROM documents),
        {sql_level("l0", "l1", chr(10), SIZE)} {SQL_PARTS.format(src="l1")}""",
    # cum[i]: lines of the first i blocks; "opened" says that the first block was taken untested
    "line_budget_chunks": f"""WITH RECURSIVE
        b AS (SELECT doc_id, list_filter(string_split(text, '. '), lambda x: x <> '') AS p FROM documents),
        n AS (SELECT doc_id, p, list_transform(p, lambda x: len(string_split(x, chr(10)))) AS lines FROM b
              WHERE len(p) > 0),
        bad AS (SELECT doc_id FROM n WHERE list_max(lines) > {MAX_LINES}),
        c AS (SELECT doc_id, p, lines, list_concat([0], list_transform(range(1, len(p) + 1),
                lambda i: list_sum(lines[1:i])::BIGINT)) AS cum FROM n
              WHERE doc_id NOT IN (SELECT doc_id FROM bad)),
        w AS (
          SELECT doc_id, p, lines, cum, 0::BIGINT AS s, 0::BIGINT AS e, false AS strip, 1::BIGINT AS next_s,
            false AS opened FROM c
          UNION ALL
          SELECT doc_id, p, lines, cum, s2, CASE WHEN stop IS NULL THEN len(p) WHEN over THEN stop - 1 ELSE stop END,
            NOT coalesce(over, false), CASE WHEN stop IS NULL THEN len(p) + 1 WHEN over THEN stop ELSE stop + 1 END,
            coalesce(over, false)
          FROM (SELECT *, stop > s2 AND (cum[stop] - cum[s2] + (stop - 1 - s2)) + lines[stop] > {MAX_LINES} AS over
            FROM (SELECT *, next_s AS s2, list_filter(
                range(next_s + CASE WHEN opened THEN 1 ELSE 0 END, len(p) + 1),
                lambda i: cum[i + 1] - cum[next_s] + (i - next_s) >= {NUM_LINES}
                  OR (i > next_s AND (cum[i] - cum[next_s] + (i - 1 - next_s)) + lines[i] > {MAX_LINES}))[1] AS stop
              FROM w WHERE next_s <= len(p)))),
        t AS (SELECT doc_id, s, CASE WHEN strip THEN rtrim(array_to_string(p[s:e], chr(10)), chr(10))
                ELSE array_to_string(p[s:e], chr(10)) END AS t FROM w WHERE s > 0)
        SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS part,
          count(*) OVER (PARTITION BY doc_id) AS num_parts, md5(t) AS content_md5 FROM t
        UNION ALL SELECT doc_id, 0, 1, md5('block too long') FROM bad""",
    "recursive_chunks": sql_recursive("text", op.SEPARATORS, FINE_SIZE),
    "markdown_chunks": sql_recursive(
        "replace(text, '.' || chr(10), '.' || chr(10) || '## ')", op.MARKDOWN_SEPARATORS, SIZE
    ),
    "python_code_chunks": sql_recursive(
        "replace(text, '.' || chr(10), chr(10) || 'def ')", op.PYTHON_SEPARATORS, SIZE
    ),
}
