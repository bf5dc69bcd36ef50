"""Training data preparation."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions.rng import draw_bits
from corpusloom.functions.text import FIM_MIDDLE, FIM_PREFIX, FIM_SUFFIX
from corpusloom.functions.tokens import regex_tokens
from corpusloom.operators import training as op
from corpusloom.operators import vocabulary as voc
from corpusloom.functions.rng import FEISTEL_ROUNDS
from corpusloom.plans.training_data import TrainingConfig, prepare_epochs, prepare_training_data
from registry.derived import SQL_FILES, files_table, sql_bits, sql_uniform, table

SEQ = 512
BOUND = 50_000
WORD = r"\S+"
FRACTION = 0.05
CONFIG = TrainingConfig(
    seq_length=SEQ, fim_rate=0.5, fim_spm_rate=0.5, validation_fraction=FRACTION,
    chars_per_token=3.6, sequences_per_buffer=32, seed=0,
)


def _words(spark, sf):
    d = table(spark, sf, "documents", "doc_id", "text", spread=True)
    return d.select("doc_id", regex_tokens(F.col("text"), WORD).alias("tokens"))


def take_skip(spark, sf):
    d = table(spark, sf, "documents", "doc_id", "source")
    first, rest = op.take_skip(d, "doc_id", 100)
    return first.withColumn("part", F.lit("validation")).unionByName(rest.withColumn("part", F.lit("train")))


def train_val_split(spark, sf):
    d = table(spark, sf, "documents", "doc_id", "lang")
    return d.withColumn("is_validation", op.is_validation(F.col("doc_id"), FRACTION))


def train_val_split_exact(spark, sf):
    d = table(spark, sf, "documents", "doc_id", "lang")
    return op.train_val_split_exact(d, "doc_id", FRACTION)


def corpus_stats(spark, sf):
    d = table(spark, sf, "documents", "doc_id", "lang", "n_chars")
    split = d.withColumn("is_validation", op.is_validation(F.col("doc_id"), FRACTION))
    return op.corpus_stats(split, "n_chars", "lang", "is_validation")


def chars_token_ratio(spark, sf):
    d = table(spark, sf, "documents", "doc_id", "text")
    return op.chars_token_ratio(d, "doc_id").select(F.round("chars_per_token", 6).alias("chars_per_token"))


def shuffle_order(spark, sf):
    d = table(spark, sf, "documents", "doc_id")
    return op.shuffle_rank(d, "doc_id", "rank", seed=0)


def repeat_epochs(spark, sf):
    d = op.repeat_epochs(table(spark, sf, "documents", "doc_id", "source"), 3)
    bits = draw_bits("shuffle", F.col("epoch"), F.col("doc_id"))
    return d.select("doc_id", F.col("epoch").cast("bigint").alias("epoch"), bits.alias("draw"))


def _permuted(spark, sf, truncate):
    f = op.fim_permute(F.col("tokens"), F.col("doc_id"), truncate=truncate)
    return _words(spark, sf).select("doc_id", f.alias("f")).select("doc_id", "f.mode", "f.tokens")


def _token_md5(df):
    return df.select(
        "doc_id", "mode", F.size("tokens").cast("bigint").alias("n"),
        F.md5(F.array_join("tokens", " ")).alias("tokens_md5"),
    )


def fim_permute(spark, sf):
    return _token_md5(_permuted(spark, sf, truncate=False))


def fim_permute_truncated(spark, sf):
    return _token_md5(_permuted(spark, sf, truncate=True))


def fim_mode_counts(spark, sf):
    return _permuted(spark, sf, truncate=False).groupBy("mode").agg(F.count(F.lit(1)).alias("docs"))


def pack_shards(spark, sf):
    d = table(spark, sf, "documents", "doc_id", "n_chars")
    shards = op.assign_shards(d, "doc_id", "n_chars", BOUND)
    return shards.select("doc_id", "shard")


def pack_sequences(spark, sf):
    packed = op.pack_constant_length(_words(spark, sf), "doc_id", "tokens", SEQ)
    return packed.select(
        "piece", F.md5(F.array_join("input_ids", " ")).alias("ids_md5"),
        F.md5(F.array_join("labels", " ")).alias("labels_md5"),
    )


def _files_by_path(spark, sf):
    files = files_table(spark, sf, spread=True)
    return files.select("path", "content", F.length("content").cast("bigint").alias("n_chars"))


def pack_by_path(spark, sf):
    files = _files_by_path(spark, sf).select("path", regex_tokens(F.col("content"), WORD).alias("tokens"))
    packed = op.pack_in_order(files, ["path"], "tokens", SEQ)
    return packed.select(
        "piece", F.md5(F.array_join("input_ids", " ")).alias("ids_md5"),
        F.md5(F.array_join("labels", " ")).alias("labels_md5"),
    )


def shards_by_path(spark, sf):
    files = _files_by_path(spark, sf).drop("content")
    return op.shards_in_order(files, ["path"], "n_chars", BOUND).select("path", "shard")


def token_ids(spark, sf):
    words = _words(spark, sf)
    ids = voc.token_ids(words, voc.vocabulary(words), "doc_id")
    return ids.select(
        "doc_id", F.size("token_ids").cast("bigint").alias("n"),
        F.md5(F.array_join(F.col("token_ids").cast("array<string>"), " ")).alias("ids_md5"),
    )


def training_sequences(spark, sf):
    d = table(spark, sf, "documents", "doc_id", "text", "n_chars", spread=True)
    out = prepare_training_data(d, "doc_id", "text", CONFIG, token_pattern=WORD)
    return out.select(
        "is_validation", "shard", "piece", "rank", F.md5(F.array_join("input_ids", " ")).alias("ids_md5")
    )


EPOCHS = 3


def training_epochs(spark, sf):
    d = table(spark, sf, "documents", "doc_id", "text", "n_chars", spread=True)
    out = prepare_epochs(d, "doc_id", "text", EPOCHS, CONFIG, token_pattern=WORD)
    return out.select(
        F.col("epoch").cast("bigint").alias("epoch"), "is_validation", "shard", "piece", "position",
        F.md5(F.array_join("input_ids", " ")).alias("ids_md5"),
    )


QUERIES = {
    fn.__name__: fn
    for fn in (
        take_skip, train_val_split, train_val_split_exact, corpus_stats, chars_token_ratio, shuffle_order,
        repeat_epochs, fim_permute, fim_permute_truncated, fim_mode_counts, pack_shards, pack_sequences,
        token_ids, training_sequences, pack_by_path, shards_by_path, training_epochs,
    )
}


def sql_fim(src: str, out: str, truncate: bool = False) -> str:
    """CTE ``out`` (…, mode, t): ``src`` (doc_id, …, tokens) with permuted tokens ``t``."""
    kept = "n - hi - 3" if truncate else "n - hi"
    guard = "AND n - hi > 3" if truncate else ""
    a, b = (f"CAST(floor({sql_uniform(s, 'doc_id')} * (len(tokens) + 1)) AS BIGINT)" for s in "ab")
    return f"""
{out}_c AS (SELECT *, len(tokens) AS n, least({a}, {b}) AS lo, greatest({a}, {b}) AS hi FROM {src}),
{out}_m AS (SELECT *, CASE WHEN NOT ({sql_uniform("f", "doc_id")} < 0.5 {guard}) THEN 'none'
    WHEN {sql_uniform("s", "doc_id")} < 0.5 THEN 'spm' ELSE 'psm' END AS mode FROM {out}_c),
{out} AS (SELECT *, CASE mode WHEN 'none' THEN tokens
    WHEN 'spm' THEN ['{FIM_PREFIX}', '{FIM_SUFFIX}'] || tokens[hi + 1:hi + {kept}] || ['{FIM_MIDDLE}'] || tokens[1:hi]
    ELSE ['{FIM_PREFIX}'] || tokens[1:lo] || ['{FIM_SUFFIX}'] || tokens[hi + 1:hi + {kept}] || ['{FIM_MIDDLE}']
      || tokens[lo + 1:hi] END AS t FROM {out}_m)"""


_WORDS = "words AS (SELECT doc_id, n_chars, regexp_extract_all(text, '\\S+') AS tokens FROM documents)"
_SPLIT = f"{sql_uniform('v', 'doc_id')} < {FRACTION}"
_TRAIN_BOUND = op.buffer_size(SEQ, 3.6, 32)

def _sql_feistel(x: str) -> str:
    """One pass of the network over ``x``, with a and b as columns, for epoch ``epoch``."""
    left, right = f"(({x}) // b)", f"(({x}) % b)"
    for i in range(FEISTEL_ROUNDS):
        drawn = sql_bits("epoch", "epoch", str(i), left if i % 2 else right)
        if i % 2:
            right = f"(({right} + {drawn}) % b)"
        else:
            left = f"(({left} + {drawn}) % a)"
    return f"({left} * b + {right})"


# naive: the pieces of every epoch numbered by a window, and each number walked until it is below their count
_SQL_EPOCHS = f"""WITH RECURSIVE
  ratio AS (SELECT sum(length(text)) / sum(len(regexp_extract_all(text, '\\S+'))) AS r FROM (
    SELECT text FROM documents WHERE NOT {_SPLIT} ORDER BY doc_id LIMIT 400)),
  bound AS (SELECT ceil({SEQ} * r * {CONFIG.sequences_per_buffer}) AS c FROM ratio),
  words AS (SELECT doc_id AS id, {_SPLIT} AS is_validation, CAST(floor(coalesce(sum(n_chars) OVER (
        PARTITION BY {_SPLIT} ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / c) AS BIGINT) AS shard,
      regexp_extract_all(text, '\\S+') AS tokens FROM documents, bound),
  each AS (SELECT epoch, epoch || ':' || id AS doc_id, id, is_validation, shard, tokens
    FROM words, range({EPOCHS}) e(epoch) WHERE NOT is_validation OR epoch = 0),
  {sql_fim("each", "f")},
  rows AS (SELECT epoch, id, is_validation, shard, unnest(list_append(t, '<eos>')) AS w,
      unnest(range(1, len(t) + 2)) AS i FROM f),
  pos AS (SELECT *, row_number() OVER (PARTITION BY epoch, is_validation, shard ORDER BY id, i) - 1 AS p FROM rows),
  pieces AS (SELECT epoch, is_validation, shard, p // {SEQ} AS piece, md5(string_agg(w, ' ' ORDER BY p)) AS ids_md5
    FROM pos GROUP BY ALL HAVING count(*) = {SEQ}),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY epoch, is_validation ORDER BY shard, piece) - 1 AS x,
      count(*) OVER (PARTITION BY epoch, is_validation) AS n FROM pieces),
  sides AS (SELECT *, (CASE WHEN s * s >= n THEN s ELSE s + 1 END) AS a FROM (
    SELECT *, CAST(floor(sqrt(n)) AS BIGINT) AS s FROM ranked)),
  net AS (SELECT *, CAST(ceil(n / a) AS BIGINT) AS b FROM sides),
  walk(epoch, is_validation, shard, piece, n, a, b, y, k) AS (
    SELECT epoch, is_validation, shard, piece, n, a, b, {_sql_feistel("x")}, 1 FROM net
    UNION ALL SELECT epoch, is_validation, shard, piece, n, a, b, {_sql_feistel("y")}, k + 1 FROM walk WHERE y >= n)
SELECT epoch, is_validation, shard, piece, CASE WHEN n = 1 THEN 0 ELSE y END AS position, ids_md5
FROM walk JOIN pieces USING (epoch, is_validation, shard, piece) WHERE y < n"""

ORACLE = {
    "training_epochs": _SQL_EPOCHS,
    "take_skip": """SELECT doc_id, source,
        CASE WHEN row_number() OVER (ORDER BY doc_id) <= 100 THEN 'validation' ELSE 'train' END AS part
        FROM documents""",
    "train_val_split": f"SELECT doc_id, lang, {_SPLIT} AS is_validation FROM documents",
    "train_val_split_exact": f"""SELECT doc_id, lang,
        row_number() OVER (ORDER BY {sql_bits("v", "doc_id")}, doc_id) <= ceil({FRACTION} * count(*) OVER ())
          AS is_validation FROM documents""",
    "corpus_stats": f"""SELECT lang, {_SPLIT} AS is_validation, count(*) AS docs,
        CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY ALL""",
    "chars_token_ratio": """SELECT round(sum(length(text))
          / sum(len(regexp_extract_all(text, '[A-Za-z0-9_]+|[^A-Za-z0-9_\\s]'))), 6) AS chars_per_token
        FROM (SELECT text FROM documents ORDER BY doc_id LIMIT 400)""",
    "shuffle_order": f"""SELECT doc_id,
        row_number() OVER (ORDER BY {sql_bits("shuffle", "0", "doc_id")}, doc_id) - 1 AS rank FROM documents""",
    "repeat_epochs": f"""SELECT doc_id, epoch, {sql_bits("shuffle", "epoch", "doc_id")} AS draw
        FROM documents CROSS JOIN range(3) e(epoch)""",
    "fim_permute": f"""WITH {_WORDS}, {sql_fim("words", "f")}
        SELECT doc_id, mode, CAST(len(t) AS BIGINT) AS n, md5(array_to_string(t, ' ')) AS tokens_md5 FROM f""",
    "fim_permute_truncated": f"""WITH {_WORDS}, {sql_fim("words", "f", truncate=True)}
        SELECT doc_id, mode, CAST(len(t) AS BIGINT) AS n, md5(array_to_string(t, ' ')) AS tokens_md5 FROM f""",
    "fim_mode_counts": f"""WITH {_WORDS}, {sql_fim("words", "f")}
        SELECT mode, count(*) AS docs FROM f GROUP BY mode""",
    "pack_shards": f"""SELECT doc_id, CAST(floor(coalesce(sum(n_chars) OVER (ORDER BY doc_id
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / {BOUND}::DOUBLE) AS BIGINT) AS shard FROM documents""",
    "pack_sequences": f"""WITH {_WORDS},
        rows AS (SELECT doc_id, unnest(list_append(tokens, '<eos>')) AS w,
            unnest(range(1, len(tokens) + 2)) AS i FROM words),
        pos AS (SELECT w, row_number() OVER (ORDER BY doc_id, i) - 1 AS p FROM rows)
        SELECT p // {SEQ} AS piece, md5(string_agg(w, ' ' ORDER BY p)) AS ids_md5,
          md5(string_agg(w, ' ' ORDER BY p)) AS labels_md5
        FROM pos GROUP BY 1 HAVING count(*) = {SEQ}""",
    "pack_by_path": f"""WITH {SQL_FILES},
        words AS (SELECT path, regexp_extract_all(content, '\\S+') AS tokens FROM files),
        rows AS (SELECT path, unnest(list_append(tokens, '<eos>')) AS w,
            unnest(range(1, len(tokens) + 2)) AS i FROM words),
        pos AS (SELECT w, row_number() OVER (ORDER BY path, i) - 1 AS p FROM rows)
        SELECT p // {SEQ} AS piece, md5(string_agg(w, ' ' ORDER BY p)) AS ids_md5,
          md5(string_agg(w, ' ' ORDER BY p)) AS labels_md5
        FROM pos GROUP BY 1 HAVING count(*) = {SEQ}""",
    "shards_by_path": f"""WITH {SQL_FILES}
        SELECT path, CAST(floor(coalesce(sum(length(content)) OVER (ORDER BY path
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / {BOUND}::DOUBLE) AS BIGINT) AS shard FROM files""",
    "token_ids": f"""WITH {_WORDS},
        vocab AS (SELECT w, row_number() OVER (ORDER BY {sql_bits("vocab", "w")}, w) - 1 AS id
          FROM (SELECT DISTINCT unnest(tokens) AS w FROM words)),
        rows AS (SELECT doc_id, unnest(tokens) AS w, unnest(range(1, len(tokens) + 1)) AS i FROM words)
        SELECT doc_id, count(id) AS n, md5(coalesce(string_agg(CAST(id AS VARCHAR), ' ' ORDER BY i), '')) AS ids_md5
        FROM documents LEFT JOIN rows USING (doc_id) LEFT JOIN vocab USING (w) GROUP BY doc_id""",
    "training_sequences": f"""WITH
        words AS (SELECT doc_id, {_SPLIT} AS is_validation, CAST(floor(coalesce(sum(n_chars) OVER (
              PARTITION BY {_SPLIT} ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
              / {_TRAIN_BOUND}::DOUBLE) AS BIGINT) AS shard,
            regexp_extract_all(text, '\\S+') AS tokens FROM documents),
        {sql_fim("words", "f")},
        rows AS (SELECT doc_id, is_validation, shard, unnest(list_append(t, '<eos>')) AS w,
            unnest(range(1, len(t) + 2)) AS i FROM f),
        pos AS (SELECT *, row_number() OVER (PARTITION BY is_validation, shard ORDER BY doc_id, i) - 1 AS p FROM rows),
        pieces AS (SELECT is_validation, shard, p // {SEQ} AS piece, md5(string_agg(w, ' ' ORDER BY p)) AS ids_md5
          FROM pos GROUP BY ALL HAVING count(*) = {SEQ})
        SELECT is_validation, shard, piece, ids_md5, row_number() OVER (PARTITION BY is_validation
            ORDER BY {sql_bits("shuffle", "0", "shard", "piece")}, shard, piece) - 1 AS rank FROM pieces""",
}
