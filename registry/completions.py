"""Grids of tasks, snippets, functions and models; stored results and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import html, text
from corpusloom.functions.models import echo
from corpusloom.operators import completions as op
from registry.derived import MODELS, SQL_TASKS, table
from registry.text import _MODELS, _TEMPLATES, _sql_escape, _tasks

FUNCTIONS = ["explain", "potential-problems"]


def _grid(spark, sf):
    return op.task_model_grid(_tasks(spark, sf), MODELS)


def task_model_grid(spark, sf):
    return _grid(spark, sf).select("doc_id", "model_id", F.md5("prompt").alias("prompt_md5"))


def _snippets(spark, sf):
    d = table(spark, sf, "conversations", "conv_id", "turn", "text")
    return d.select(F.concat_ws("-", "conv_id", "turn").alias("snippet_name"), F.col("text").alias("code"))


def snippet_fn_model_grid(spark, sf):
    grid = op.snippet_fn_model_grid(_snippets(spark, sf), FUNCTIONS, MODELS)
    return grid.select("snippet_name", "fn", "model_id", "as_html", F.md5("prompt").alias("prompt_md5"))


def _answers(spark, sf):
    grid = op.snippet_fn_model_grid(_snippets(spark, sf), FUNCTIONS, MODELS)
    return grid.withColumn("response", echo(F.concat("model_id", F.lit(": "), "prompt")))


def responses_pivot(spark, sf):
    nested = op.nest_responses(_answers(spark, sf), MODELS)
    return nested.select("fn", "snippet_name", *[
        F.md5(F.col(f"`{m}`")).alias("m" + str(i)) for i, m in enumerate(MODELS)
    ])


def responses_html(spark, sf):
    shown = op.responses_html(_answers(spark, sf))
    return shown.select("fn", "snippet_name", F.md5("html").alias("html_md5"))


def rendered_responses(spark, sf):
    """Answers as their function shows them: as HTML or plain, finished or streamed."""
    grid = op.snippet_fn_model_grid(_snippets(spark, sf), ["explain", "add-docstrings"], MODELS)
    shown = html.render_response(F.col("code"), F.col("as_html"), F.col("model_id") == MODELS[0])
    return grid.select("snippet_name", "fn", "model_id", F.md5(shown).alias("shown_md5"))


def _stored(spark, sf):
    """What a comparison run leaves behind: one file per task and one per task and model."""
    tasks = _tasks(spark, sf).withColumn("task_name", F.concat(F.lit("task_"), F.col("doc_id")))
    described = tasks.select(
        "task_name", F.lit("task").alias("base_name"),
        text.join_placeholder(F.col("prefix"), F.col("suffix")).alias("content"),
    )
    done = op.for_each(tasks, "model_id", MODELS).select(
        "task_name", text.model_id_to_fn(F.col("model_id")).alias("base_name"),
        text.full_code(F.col("prefix"), F.col("model_id"), F.col("suffix")).alias("content"),
    )
    return described.unionByName(done)


def stored_results_join(spark, sf):
    stored = op.stored_results(_stored(spark, sf))
    return stored.select("task_name", "task", F.explode("completions")).select(
        "task_name", F.md5("task").alias("task_md5"), F.col("key").alias("model_id"),
        F.md5("value").alias("completion_md5"),
    )


def report_grid(spark, sf):
    tasks = _tasks(spark, sf).withColumn("task_name", F.concat(F.lit("task_"), F.col("doc_id")))
    return op.report_grid(op.for_each(tasks.select("task_name", "lang_id"), "model_id", MODELS))


def completion_report_html(spark, sf):
    tasks = _tasks(spark, sf).withColumn("task_name", F.concat(F.lit("task_"), F.col("doc_id")))
    grid = op.for_each(tasks, "model_id", MODELS).select(
        "lang_id", "task_name", "model_id",
        text.join_placeholder(F.col("prefix"), F.col("suffix")).alias("task"),
        text.full_code(F.col("prefix"), F.col("model_id"), F.col("suffix")).alias("full_code"),
    )
    return op.report_fragments(grid).select("lang_id", "task_name", F.md5("html").alias("html_md5"))


QUERIES = {
    fn.__name__: fn
    for fn in (
        task_model_grid, snippet_fn_model_grid, responses_pivot, responses_html, rendered_responses, stored_results_join,
        report_grid, completion_report_html,
    )
}

_M = f"models(m) AS (VALUES {_MODELS})"
_T = f"templates(fn, template) AS (SELECT * FROM (VALUES {_TEMPLATES}) t(fn, template) WHERE fn IN ('explain', 'potential-problems'))"
_SNIPPETS = "snippets AS (SELECT conv_id || '-' || turn AS snippet_name, text AS code FROM conversations)"
_ANSWERS = f"""{_M}, {_T}, {_SNIPPETS},
  answers AS (SELECT snippet_name, fn, m, code, upper(translate(m || ': ' || replace(template, '{{code}}', code), 'ß', '?'))
    AS response FROM snippets CROSS JOIN templates CROSS JOIN models)"""
_CELL = (
    "'<td><h4>' || m || '</h4><pre>' || " + _sql_escape("prefix || m || suffix") + " || '</pre></td>'"
)

ORACLE = {
    "task_model_grid": f"""WITH {SQL_TASKS}, {_M}
        SELECT doc_id, m AS model_id,
          md5('<fim-prefix>' || prefix || '<fim-suffix>' || suffix || '<fim-middle>') AS prompt_md5
        FROM tasks CROSS JOIN models""",
    "snippet_fn_model_grid": f"""WITH {_M}, {_T}, {_SNIPPETS}
        SELECT snippet_name, fn, m AS model_id, true AS as_html, md5(replace(template, '{{code}}', code)) AS prompt_md5
        FROM snippets CROSS JOIN templates CROSS JOIN models""",
    "responses_pivot": f"""WITH {_ANSWERS}
        SELECT fn, snippet_name, {", ".join(f"md5(max(response) FILTER (m = '{m}')) AS m{i}" for i, m in enumerate(MODELS))}
        FROM answers GROUP BY fn, snippet_name""",
    "responses_html": f"""WITH {_ANSWERS}
        SELECT fn, snippet_name, md5('<h3>' || snippet_name || '</h3><pre>' || {_sql_escape("any_value(code)")} || '</pre>'
          || string_agg('<h4>' || m || '</h4><pre>' || {_sql_escape("response")} || '</pre>', '' ORDER BY m)) AS html_md5
        FROM answers GROUP BY fn, snippet_name""",
    "rendered_responses": f"""WITH {_M}, {_SNIPPETS}, fns(fn) AS (VALUES ('explain'), ('add-docstrings')),
        t AS (SELECT *, regexp_extract(code, '[\\n \\t]$') AS tail FROM snippets)
        SELECT snippet_name, fn, m AS model_id, md5(CASE WHEN fn = 'add-docstrings' THEN code
          WHEN m = '{MODELS[0]}'
            THEN replace(left(code, length(code) - length(tail)), chr(10), '<br>' || chr(10)) || tail
          ELSE '<div style="font-family: monospace"><p>' || replace(replace(code, chr(10) || chr(10), '</p><p>'),
            chr(10), '<br/>') || '</p></div>' END) AS shown_md5
        FROM t CROSS JOIN fns CROSS JOIN models""",
    "stored_results_join": f"""WITH {SQL_TASKS}, {_M}
        SELECT 'task_' || doc_id AS task_name, md5(prefix || '<todo>' || suffix) AS task_md5, m AS model_id,
          md5(prefix || m || suffix) AS completion_md5 FROM tasks CROSS JOIN models""",
    "report_grid": f"""WITH {SQL_TASKS}, {_M}
        SELECT 'task_' || doc_id AS task_name, lang_id, m AS model_id,
          (row_number() OVER (PARTITION BY doc_id ORDER BY m) - 1) // 2 AS row,
          (row_number() OVER (PARTITION BY doc_id ORDER BY m) - 1) % 2 AS col FROM tasks CROSS JOIN models""",
    "completion_report_html": f"""WITH {SQL_TASKS}, {_M}
        SELECT lang_id, 'task_' || doc_id AS task_name, md5('<h2>task_' || doc_id || '</h2><pre>'
          || {_sql_escape("prefix")} || '<span class="placeholder">&lt;todo&gt;</span>' || {_sql_escape("suffix")}
          || '</pre><table class="answers"><tr>'
          || string_agg(CASE WHEN m = 'runs/ckpt-6000' THEN '</tr><tr>' ELSE '' END || {_CELL}, '' ORDER BY m)
          || '</tr></table>') AS html_md5
        FROM tasks CROSS JOIN models GROUP BY lang_id, doc_id, prefix, suffix""",
}
