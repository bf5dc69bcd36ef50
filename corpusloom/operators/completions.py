"""Completion grids, results and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import html, prompts, text

REPORT_COLUMNS = 2
PAGE_STYLE = (
    "main { max-width: 100em; margin: auto; font: 15px/1.4 system-ui; }"
    " pre { margin: 0.5em 0; padding: 0.75em; overflow: auto; background: #f3f4f7; border-radius: 4px; }"
    " .placeholder { color: #c00; font-weight: bold; }"
    " .answers { width: 100%; table-layout: fixed; } .answers td { vertical-align: top; }"
)
PAGE_END = "</main></body></html>"


def page_start(title: Column) -> Column:
    return F.concat(
        F.lit(f"<html><head><style>{PAGE_STYLE}</style></head><body><main><h1>"), title, F.lit("</h1>")
    )


def for_each(df: DataFrame, name: str, values: list[str]) -> DataFrame:
    """Every row once per value. The list is part of the plan, so nothing is joined or shuffled."""
    return df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))


def task_model_grid(tasks: DataFrame, models: list[str]) -> DataFrame:
    """Every model answers every task: adds ``model_id`` and ``prompt``."""
    prompt = text.fim_prompt(F.col("prefix"), F.col("suffix"))
    return for_each(tasks, "model_id", models).withColumn("prompt", prompt)


def snippet_fn_model_grid(snippets: DataFrame, functions: list[str], models: list[str]) -> DataFrame:
    """Snippets × code functions × models: adds ``fn``, ``as_html``, ``prompt`` and ``model_id``."""
    return (
        for_each(snippets, "model_id", models)
        .withColumn("__f", F.explode(prompts.code_functions(*functions)))
        .withColumn("prompt", prompts.code_fn_prompt(F.col("__f.template"), F.col("code")))
        .select("*", "__f.fn", "__f.as_html")
        .drop("__f")
    )


def _task_keys(df: DataFrame) -> list[str]:
    """What names a task: its name, and its language where there is one."""
    return [c for c in ("lang_id", "task_name") if c in df.columns]


def stored_results(results: DataFrame) -> DataFrame:
    """(task_name, task, completions map<model, text>) from rows (task_name, base_name, content).

    With a column lang_id, equal names of two languages are two tasks.
    """
    is_task = F.col("base_name") == "task"
    model = text.model_id_from_fn(F.col("base_name"))
    entry = F.when(~is_task, F.struct(model.alias("model_id"), F.col("content").alias("completion")))
    return results.groupBy(*_task_keys(results)).agg(
        F.max(F.when(is_task, F.col("content"))).alias("task"),
        F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("completions"),
    )


def report_grid(completions: DataFrame, columns: int = REPORT_COLUMNS) -> DataFrame:
    """Add the 0-based cell ``row``, ``col`` of each completion: models by name, row by row."""
    by_name = Window.partitionBy(*_task_keys(completions)).orderBy("model_id")
    index = F.row_number().over(by_name) - 1
    return (
        completions.withColumn("__i", index)
        .withColumn("row", F.floor(F.col("__i") / columns).cast("bigint"))
        .withColumn("col", (F.col("__i") % columns).cast("bigint"))
        .drop("__i")
    )


def _cells_html(cells: Column, columns: int) -> Column:
    """Table rows from the sorted array<struct<model_id, full_code>> of a task."""

    def cell(c: Column, i: Column) -> Column:
        td = F.concat(
            F.lit("<td><h4>"), c["model_id"], F.lit("</h4><pre>"), html.html_escape(c["full_code"]), F.lit("</pre></td>"),
        )
        first = F.when((i > 0) & (i % columns == 0), F.lit("</tr><tr>")).otherwise(F.lit(""))
        return F.concat(first, td)

    return F.array_join(F.transform(cells, cell), "")


def report_fragments(completions: DataFrame, columns: int = REPORT_COLUMNS, by: tuple[str, ...] = ()) -> DataFrame:
    """One row per task with its part of the page: the task, then all completions side by side.

    ``completions`` has (lang_id, task_name, task, model_id, full_code); a task has one row per
    model. Everything is escaped. Columns ``by`` are kept and part a task.
    """
    cells = F.sort_array(F.collect_list(F.struct("model_id", "full_code")))
    grouped = completions.groupBy("lang_id", *by, "task_name").agg(
        F.max("task").alias("task"), cells.alias("cells")
    )
    task = html.highlight_placeholder(html.html_escape(F.col("task")))
    fragment = F.concat(
        F.lit("<h2>"), F.col("task_name"), F.lit("</h2>"),
        F.lit("<pre>"), task, F.lit('</pre><table class="answers"><tr>'),
        _cells_html(F.col("cells"), columns),
        F.lit("</tr></table>"),
    )
    return grouped.select("lang_id", *by, "task_name", fragment.alias("html"))


def nest_responses(responses: DataFrame, models: list[str]) -> DataFrame:
    """(fn, snippet_name, one column per model) from (fn, snippet_name, model_id, response)."""
    return responses.groupBy("fn", "snippet_name").pivot("model_id", models).agg(F.first("response"))


def responses_html(responses: DataFrame) -> DataFrame:
    """One fragment per function and snippet: the code, then each model's response."""
    cells = F.sort_array(F.collect_list(F.struct("model_id", "response")))
    shown = F.array_join(
        F.transform(
            F.col("cells"),
            lambda c: F.concat(
                F.lit("<h4>"), c["model_id"], F.lit("</h4><pre>"),
                html.html_escape(c["response"]), F.lit("</pre>"),
            ),
        ),
        "",
    )
    grouped = responses.groupBy("fn", "snippet_name").agg(F.max("code").alias("code"), cells.alias("cells"))
    return grouped.select(
        "fn",
        "snippet_name",
        F.concat(
            F.lit("<h3>"), F.col("snippet_name"), F.lit("</h3><pre>"),
            html.html_escape(F.col("code")), F.lit("</pre>"), shown,
        ).alias("html"),
    )


def valid_completions(results: DataFrame, suffix: str = "suffix") -> DataFrame:
    """Results that show something; empty responses give no rows, the result index stays."""
    return results.where(F.col(suffix).isNotNull() & (F.col(suffix) != ""))


def limit_completions(results: DataFrame, n: int, by: str = "request_id") -> DataFrame:
    """Of the first ``n`` results of a request those that continue the typed prefix."""
    return results.where((F.col("index") < n) & F.startswith(F.col("text"), F.col("typed_prefix")))
