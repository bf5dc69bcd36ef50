"""Scalar text operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import html, prompts, text
from registry.derived import (
    MODELS,
    SQL_FENCED,
    SQL_FILES,
    SQL_TASKS,
    SQL_TODO,
    fenced_table,
    files_table,
    fim_text,
    table,
    todo_table,
)


def _tasks(spark, sf):
    parts = text.split_placeholder(F.col("code"), strict=True)
    return todo_table(spark, sf).withColumn("p", parts).select(
        "doc_id", "lang_id", "p.prefix", "p.suffix"
    )


def _md5s(df, *cols):
    return df.select("doc_id", *[F.md5(c).alias(f"{c}_md5") for c in cols])


def completion_tasks(spark, sf):
    return _tasks(spark, sf).select(
        "doc_id", "lang_id", F.md5("prefix").alias("prefix_md5"), F.md5("suffix").alias("suffix_md5")
    )


def placeholder_roundtrip(spark, sf):
    joined = text.join_placeholder(F.col("prefix"), F.col("suffix"))
    return _md5s(_tasks(spark, sf).withColumn("code", joined), "code")


def full_code(spark, sf):
    code = text.full_code(F.col("prefix"), F.lit("-- filled in --"), F.col("suffix"))
    return _md5s(_tasks(spark, sf).withColumn("code", code), "code")


def fim_prompt(spark, sf):
    prompt = text.fim_prompt(F.col("prefix"), F.col("suffix"))
    return _md5s(_tasks(spark, sf).withColumn("prompt", prompt), "prompt")


def extract_completion(spark, sf):
    done = F.concat(F.lit("# "), F.col("prefix"))
    response = F.when(
        F.col("doc_id") % 9 == 4, F.concat(F.col("prefix"), F.col("suffix"))
    ).otherwise(fim_text(F.col("prefix"), F.col("suffix"), done))
    found = text.extract_completion(response, F.col("suffix"), F.col("lang_id"))
    return _tasks(spark, sf).select("doc_id", found.alias("completion"))


def extract_completion_ruby(spark, sf):
    suffix = F.concat(F.lit(" # rest\n  end  \n"), F.col("suffix"))
    answer = F.concat(
        F.when(F.col("doc_id") % 3 == 0, F.lit("")).otherwise(F.concat(F.col("prefix"), F.lit("\n"))),
        F.lit("  end\n"), F.col("prefix"),
    )
    found = text.extract_completion(
        fim_text(F.col("prefix"), suffix, answer), suffix, F.col("lang_id")
    )
    return _md5s(_tasks(spark, sf).withColumn("completion", found), "completion")


def model_id_fn(spark, sf):
    models = F.explode(F.array(*[F.lit(m) for m in MODELS]))
    d = table(spark, sf, "documents", "source").groupBy("source").agg(F.count(F.lit(1)).alias("docs"))
    named = d.withColumn("m", models).withColumn("model_id", F.concat_ws("/", "m", "source"))
    file_name = text.model_id_to_fn(F.col("model_id"))
    return named.select(
        "model_id", file_name.alias("file_name"), text.model_id_from_fn(file_name).alias("restored"), "docs"
    )


def lang_from_filename(spark, sf):
    return files_table(spark, sf).select(
        "doc_id", text.lang_from_filename(F.col("path")).alias("lang_id")
    )


def code_fn_prompts(spark, sf):
    d = table(spark, sf, "documents", "doc_id", "text")
    each = d.select("doc_id", "text", F.explode(prompts.code_functions()).alias("f"))
    prompt = prompts.code_fn_prompt(F.col("f.template"), F.col("text"))
    return each.select("doc_id", "f.fn", F.md5(prompt).alias("prompt_md5"))


def chat_wrap(spark, sf):
    c = table(spark, sf, "conversations", "conv_id", "turn", "role", "text")
    style = F.when(F.col("role") == "user", "chat").otherwise("plain")
    return c.select("conv_id", "turn", F.md5(prompts.chat_wrap(F.col("text"), style)).alias("prompt_md5"))


def chunk_size_lookup(spark, sf):
    known = F.array(*[F.lit(m) for m in prompts.CHUNK_SIZES])
    model_type = F.get(known, (F.col("doc_id") % len(prompts.CHUNK_SIZES)).cast("int"))
    d = table(spark, sf, "documents", "doc_id", "n_chars").withColumn("model_type", model_type)
    size = prompts.chunk_size_for(F.col("model_type"))
    return d.groupBy("model_type", size.cast("bigint").alias("chunk_size")).agg(
        F.sum(F.ceil(F.col("n_chars") / size)).alias("chunks_at_least")
    )


def embedding_key(spark, sf):
    d = table(spark, sf, "documents", "doc_id", "text")
    return d.select("doc_id", F.md5(text.embedding_key(F.col("text"))).alias("key_md5"))


def cutoff_sentence(spark, sf):
    d = table(spark, sf, "documents", "doc_id", "text")
    return d.select("doc_id", F.md5(text.cutoff_at_sentence(F.col("text"), 50)).alias("cut_md5"))


def html_escape(spark, sf):
    shown = html.highlight_placeholder(html.html_escape(F.col("code")))
    todo = todo_table(spark, sf).select("doc_id", F.md5(shown).alias("html_md5"))
    page = table(spark, sf, "pages", "page_id", "html").select(
        (-1 - F.col("page_id")).alias("doc_id"), F.md5(html.html_escape(F.col("html"))).alias("html_md5")
    )
    return todo.unionByName(page)


def format_response_html(spark, sf):
    shown = html.format_response_html(F.col("fenced"))
    return fenced_table(spark, sf).select("doc_id", F.md5(shown).alias("html_md5"))


QUERIES = {
    fn.__name__: fn
    for fn in (
        completion_tasks, placeholder_roundtrip, full_code, fim_prompt, extract_completion,
        extract_completion_ruby, model_id_fn, lang_from_filename, code_fn_prompts, chat_wrap,
        chunk_size_lookup, embedding_key, cutoff_sentence, html_escape, format_response_html,
    )
}


def _quote(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


_TEMPLATES = ", ".join(
    f"({_quote(name)}, {_quote(t)})" for name, t in prompts.CODE_FUNCTION_TEMPLATES.items()
)
_SIZES = ", ".join(
    f"({i}, {_quote(name)}, {size})" for i, (name, size) in enumerate(prompts.CHUNK_SIZES.items())
)
_MODELS = ", ".join(f"({_quote(m)})" for m in MODELS)
_FIM = "'<fim-prefix>' || prefix || '<fim-suffix>' || {suffix} || '<fim-middle>'"


def _sql_escape(col: str) -> str:
    return (
        f"replace(replace(replace(replace(replace({col}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), "
        "'\"', '&quot;'), '''', '&#x27;')"
    )


def _sql_breaks(text: str) -> str:
    return f"replace(replace({text}, chr(10) || chr(10), '</p><p>'), chr(10), '<br/>')"


ORACLE = {
    "completion_tasks": f"""WITH {SQL_TASKS}
        SELECT doc_id, lang_id, md5(prefix) AS prefix_md5, md5(suffix) AS suffix_md5 FROM tasks""",
    "placeholder_roundtrip": f"WITH {SQL_TODO} SELECT doc_id, md5(code) AS code_md5 FROM todo",
    "full_code": f"""WITH {SQL_TODO}
        SELECT doc_id, md5(replace(code, '<todo>', '-- filled in --')) AS code_md5 FROM todo""",
    "fim_prompt": f"""WITH {SQL_TASKS}
        SELECT doc_id, md5({_FIM.format(suffix="suffix")}) AS prompt_md5 FROM tasks""",
    "extract_completion": f"""WITH {SQL_TASKS}
        SELECT doc_id, CASE WHEN doc_id % 9 = 4 THEN '' ELSE '# ' || prefix END AS completion
        FROM tasks""",
    "extract_completion_ruby": f"""WITH {SQL_TASKS}
        SELECT doc_id, md5(CASE
            WHEN lang_id = 'ruby' AND doc_id % 3 = 0 THEN ''
            WHEN lang_id = 'ruby' THEN prefix
            WHEN doc_id % 3 = 0 THEN '  end' || chr(10) || prefix
            ELSE prefix || chr(10) || '  end' || chr(10) || prefix END) AS completion_md5
        FROM tasks""",
    "model_id_fn": f"""WITH models(m) AS (VALUES {_MODELS}),
        s AS (SELECT source, count(*) AS docs FROM documents GROUP BY 1)
        SELECT m || '/' || source AS model_id, replace(m || '/' || source, '/', '--') AS file_name,
          m || '/' || source AS restored, docs FROM models CROSS JOIN s""",
    "lang_from_filename": f"""WITH {SQL_FILES}
        SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'python' WHEN 1 THEN 'md' WHEN 2 THEN 'ruby'
          WHEN 3 THEN 'txt' ELSE '' END AS lang_id FROM files""",
    "code_fn_prompts": f"""WITH templates(fn, template) AS (VALUES {_TEMPLATES})
        SELECT doc_id, fn, md5(replace(template, '{{code}}', text)) AS prompt_md5
        FROM documents CROSS JOIN templates""",
    "chat_wrap": """SELECT conv_id, turn, md5(CASE WHEN role = 'user'
          THEN '<|system|><|end|><|user|>' || text || '<|end|><|assistant|>' ELSE text END) AS prompt_md5
        FROM conversations""",
    "chunk_size_lookup": f"""WITH sizes(i, model_type, size) AS (VALUES {_SIZES})
        SELECT model_type, CAST(size AS BIGINT) AS chunk_size,
          CAST(sum(ceil(n_chars / size::DOUBLE)) AS BIGINT) AS chunks_at_least
        FROM documents JOIN sizes ON doc_id % {len(prompts.CHUNK_SIZES)} = i GROUP BY 1, 2""",
    "embedding_key": "SELECT doc_id, md5(replace(text, chr(10), ' ')) AS key_md5 FROM documents",
    "cutoff_sentence": """WITH w AS (SELECT doc_id, text, string_split(text, ' ') AS words FROM documents),
        h AS (SELECT *, list_reverse(words[1:51]) AS back FROM w),
        i AS (SELECT *, coalesce(list_position(list_transform(back, lambda x: ends_with(x, '.')), true) - 1,
            len(back) - 1) AS idx FROM h)
        SELECT doc_id, md5(CASE WHEN len(words) < 50 THEN text
          ELSE array_to_string(words[1:50 - idx + 1], ' ') END) AS cut_md5 FROM i""",
    "html_escape": f"""WITH {SQL_TODO}
        SELECT doc_id, md5(replace({_sql_escape("code")}, '&lt;todo&gt;',
          '<span class="placeholder">&lt;todo&gt;</span>')) AS html_md5 FROM todo
        UNION ALL SELECT -1 - page_id AS doc_id, md5({_sql_escape("html")}) AS html_md5 FROM pages""",
    "format_response_html": f"""WITH {SQL_FENCED},
        h AS (SELECT doc_id, string_split(fenced, '```python') AS h FROM fenced),
        p AS (SELECT doc_id, h[1] AS before, string_split(h[2], '```') AS r FROM h)
        SELECT doc_id, md5('<div style="font-family: monospace"><p>' || {_sql_breaks("before")}
          || CASE WHEN r IS NULL THEN '' ELSE '<pre>' || r[1] || '</pre>' || {_sql_breaks("r[2]")} END
          || '</p></div>') AS html_md5 FROM p""",
}
