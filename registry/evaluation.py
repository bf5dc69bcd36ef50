"""Perplexity, benchmark and resource summaries."""

from __future__ import annotations

import functools
import math

import numpy as np
from pyspark.sql import functions as F

from corpusloom.functions.tokens import lower_words
from corpusloom.operators import benchmarks as bench
from corpusloom.operators import perplexity as op
from corpusloom.operators.aggregators import mean_without_extremes
from corpusloom.operators.halo import ScoredModel
from corpusloom.operators.quantiles import exact_quantiles
from corpusloom.plans.evaluation import bigram_perplexity, scorer_perplexity
from registry.derived import SQL_FILES, SQL_SAMPLES, files_table, runs_table, samples_table, sql_uniform, table

LENGTH, STRIDE = 256, 64
FRACTION = 0.05


def _docs(spark, sf):
    d = table(spark, sf, "documents", "doc_id", "text", "lang", spread=True)
    return d.withColumn("tokens", lower_words(F.col("text"))).drop("text")


def _evaluation(spark, sf):
    return bigram_perplexity(
        _docs(spark, sf), "doc_id", "tokens", "lang", "en", FRACTION, LENGTH, STRIDE
    )


def joined_positions(spark, sf):
    """All documents as one sequence, a two-token separator between neighbours."""
    seq = op.joined_sequence(_docs(spark, sf), "doc_id", "tokens", ["<nl>", "<nl>"])
    return seq.select("doc_id", "start", "n_tokens")


def ppl_window_ids(spark, sf):
    seq = op.joined_sequence(_docs(spark, sf), "doc_id", "tokens")
    total = seq.agg(F.sum("n_tokens")).scalar()
    each = seq.where(F.col("n_tokens") > 0).select(
        total.alias("n"),
        F.explode(F.sequence(F.col("start"), F.col("start") + F.col("n_tokens") - 1)).alias("t"),
    )
    window = op.ppl_window(F.col("t"), F.col("n"), LENGTH, STRIDE)
    return each.groupBy(window.alias("window")).agg(
        F.min("t").alias("first_t"), F.max("t").alias("last_t"), F.count(F.lit(1)).alias("tokens")
    )


def bigram_nll(spark, sf):
    nll = _evaluation(spark, sf).nll
    return nll.select("model", "a", "b", F.round("nll", 6).alias("nll"))


def perplexity_windows(spark, sf):
    windows = _evaluation(spark, sf).windows
    return windows.select("model", "window", F.round("mean_nll", 6).alias("mean_nll"), "scored")


def model_ppl_ranking(spark, sf):
    ranking = _evaluation(spark, sf).ranking
    return ranking.select("model", F.round(F.log("ppl"), 6).alias("log_ppl"), F.round("ppl", 2).alias("ppl"))


def joined_by_path(spark, sf):
    """All files as one sequence in the order of their paths."""
    files = files_table(spark, sf, spread=True).select("path", lower_words(F.col("content")).alias("tokens"))
    seq = op.joined_in_order(files, ["path"], "tokens", ["<nl>", "<nl>"])
    return seq.select("path", "start", "n_tokens")


#: Stand-ins for models: windows they look at, and how many unseen tokens they reckon with.
CACHE_MODELS = {"cache-256-100": (256, 100), "cache-256-2000": (256, 2000), "cache-128-500": (128, 500)}


class _CacheScorer:
    """A model that expects what it has read in its window: p = (times read + 1) / (tokens read + unseen)."""

    def __init__(self, unseen: int):
        self.unseen = unseen

    def __call__(self, batch: list[list]) -> list[list[float]]:
        out = []
        for tokens in batch:
            read: dict = {}
            row = []
            for i, token in enumerate(tokens):
                n = read.get(token, 0)
                row.append(math.log((i + self.unseen) / (n + 1)))
                read[token] = n + 1
            out.append(row)
        return out

    def score_block(self, codes: np.ndarray, words: np.ndarray) -> np.ndarray:
        """The same for windows of one length: in the order of codes, a token's place in its run is how often it was read."""
        order = np.argsort(codes, axis=1, kind="stable")
        run = np.take_along_axis(codes, order, 1)
        place = np.arange(codes.shape[1])
        begins = np.zeros(codes.shape, np.int64)
        begins[:, 1:] = np.where(run[:, 1:] != run[:, :-1], place[1:], 0)
        read = np.empty(codes.shape, np.int64)
        np.put_along_axis(read, order, place - np.maximum.accumulate(begins, axis=1), 1)
        return np.log((place + self.unseen) / (read + 1))


def cache_scorer(unseen: int) -> _CacheScorer:
    return _CacheScorer(unseen)


def _scored(spark, sf):
    models = {
        name: ScoredModel(functools.partial(cache_scorer, unseen), length)
        for name, (length, unseen) in CACHE_MODELS.items()
    }
    return scorer_perplexity(_docs(spark, sf), ["doc_id"], "tokens", models, ["<nl>"], STRIDE)


def scorer_ppl_windows(spark, sf):
    return _scored(spark, sf).select("model", "window", F.round("mean_nll", 6).alias("mean_nll"), "scored")


def scorer_ppl_ranking(spark, sf):
    ranking = op.perplexity(_scored(spark, sf))
    return ranking.select("model", F.round(F.log("ppl"), 6).alias("log_ppl"), F.round("ppl", 2).alias("ppl"))


def benchmark_summary(spark, sf):
    return bench.benchmark_summary(runs_table(spark, sf)).select(
        "model_name", F.round("time_taken", 4).alias("time_taken"), "num_chars",
        F.round("secs_per_task", 6).alias("secs_per_task"),
    )


def _resources(spark, sf):
    return bench.resource_summary(samples_table(spark, sf))


def resource_median(spark, sf):
    names = bench.SUMMARY_NAMES.values()
    return _resources(spark, sf).select("model_name", *[F.round(n, 6).alias(n) for n in names])


#: Samples left out on each side.
EXTREMES = 25
QUANTILES = (0.0, 0.01, 0.25, 0.5, 0.75, 0.9, 0.99, 1.0)


def resource_trimmed_mean(spark, sf):
    """The summary by an aggregator that Spark does not have, over its mergeable states."""
    summary = bench.resource_summary(samples_table(spark, sf), mean_without_extremes(EXTREMES))
    return summary.select("model_name", *[F.round(n, 6).alias(n) for n in bench.SUMMARY_NAMES.values()])


def value_quantiles(spark, sf):
    return exact_quantiles(samples_table(spark, sf), ["model_name", "metric"], "value", QUANTILES)


def melt_memory(spark, sf):
    return bench.melt_memory(_resources(spark, sf)).select(
        "model_name", "type", F.round("memory_gb", 6).alias("memory_gb")
    )


QUERIES = {
    fn.__name__: fn
    for fn in (
        joined_positions, ppl_window_ids, bigram_nll, perplexity_windows, model_ppl_ranking,
        benchmark_summary, resource_median, melt_memory, joined_by_path, scorer_ppl_windows, scorer_ppl_ranking,
        resource_trimmed_mean, value_quantiles,
    )
}

_WORDS = """
  docs AS (SELECT doc_id, lang, text, regexp_extract_all(lower(text), '[a-z]+') AS w FROM documents)"""

# naive: one numbered token stream; pairs by position; every model against every token
_SQL_EVAL = f"""{_WORDS},
  split AS (SELECT *, {sql_uniform("v", "doc_id")} < {FRACTION} AS is_val FROM docs),
  train AS (SELECT doc_id, lang, unnest(w) AS b, unnest(range(1, len(w) + 1)) AS i FROM split WHERE NOT is_val),
  tp AS (SELECT lang, b, lag(b) OVER (PARTITION BY doc_id ORDER BY i) AS a FROM train),
  c2 AS (SELECT lang, a, b, count(*) AS n FROM tp WHERE a IS NOT NULL GROUP BY ALL),
  c1 AS (SELECT lang, a, sum(n) AS n FROM c2 GROUP BY ALL),
  v AS (SELECT lang, count(DISTINCT b) AS v FROM train GROUP BY lang),
  val AS (SELECT doc_id, unnest(w) AS b, unnest(range(1, len(w) + 1)) AS i FROM split WHERE is_val AND lang = 'en'),
  seq AS (SELECT b, row_number() OVER (ORDER BY doc_id, i) - 1 AS t, count(*) OVER () AS n FROM val),
  pairs AS (SELECT t, n, b, lag(b) OVER (ORDER BY t) AS a FROM seq),
  need AS (SELECT DISTINCT a, b FROM pairs WHERE a IS NOT NULL),
  nll AS (SELECT v.lang AS model, need.a, need.b,
      -ln((coalesce(c2.n, 0) + 0.1) / (coalesce(c1.n, 0) + 0.1::DOUBLE * v.v)) AS nll
    FROM need CROSS JOIN v LEFT JOIN c2 ON c2.lang = v.lang AND c2.a = need.a AND c2.b = need.b
    LEFT JOIN c1 ON c1.lang = v.lang AND c1.a = need.a),
  win AS (SELECT t, a, b, CASE WHEN t < {LENGTH} THEN 0 ELSE 1 + (t - {LENGTH}) // {STRIDE} END AS win,
      CASE WHEN n > {LENGTH} THEN t >= {LENGTH - STRIDE} ELSE t >= n - least({STRIDE}, n) END AS scored FROM pairs),
  means AS (SELECT model, win, avg(nll) AS mean_nll, count(*) AS scored
    FROM win JOIN nll USING (a, b) WHERE scored AND t > win * {STRIDE} GROUP BY model, win)"""

_SQL_MEDIANS = f"""{SQL_SAMPLES},
  first AS (SELECT *, metric = 'cpu' AND row_number() OVER (PARTITION BY model_name, metric
      ORDER BY ts, sample_id) = 1 AS skip FROM samples),
  med AS (SELECT model_name,
      coalesce(median(value) FILTER (metric = 'cpu'), 'nan'::DOUBLE) AS cpu_usage,
      coalesce(median(value) FILTER (metric = 'gpu'), 'nan'::DOUBLE) AS gpu_usage,
      coalesce(median(value) FILTER (metric = 'ram_mb') / 1000, 'nan'::DOUBLE) AS ram_gb,
      coalesce(median(value) FILTER (metric = 'vram_mb') / 1000, 'nan'::DOUBLE) AS vram_gb
    FROM first WHERE NOT skip GROUP BY model_name)"""

# naive: every model's windows in full, every token counted against all before it in its window
_SQL_SCORED = f"""{_WORDS},
  rows AS (SELECT doc_id, unnest(w) AS b, unnest(range(1, len(w) + 1)) AS i FROM docs
    UNION ALL SELECT doc_id, '<nl>', 0 FROM docs WHERE doc_id > (SELECT min(doc_id) FROM docs)),
  seq AS (SELECT b, row_number() OVER (ORDER BY doc_id, i) - 1 AS t, count(*) OVER () AS n FROM rows),
  models(model, len, unseen) AS (VALUES {", ".join(f"('{m}', {a}, {b})" for m, (a, b) in CACHE_MODELS.items())}),
  wins AS (SELECT model, len, unseen, k, k * {STRIDE} AS s, least(k * {STRIDE} + len, n) AS e, n
    FROM (SELECT model, len, unseen, n, unnest(range(0, CAST(ceil(n / {STRIDE}) AS BIGINT))) AS k
      FROM models, (SELECT max(n) AS n FROM seq))),
  ends AS (SELECT *, coalesce(lag(e) OVER (PARTITION BY model ORDER BY k), 0) AS before FROM wins),
  used AS (SELECT *, e - least({STRIDE}, e - before) AS f FROM ends WHERE before < n),
  read AS (SELECT model, k, f, s, t, ln((t - s + unseen) / (row_number() OVER (
      PARTITION BY model, k, b ORDER BY t)::DOUBLE)) AS nll
    FROM (SELECT *, unnest(range(s, e)) AS t FROM used) JOIN seq USING (t)),
  scored AS (SELECT model, k AS win, avg(nll) AS mean_nll, count(*) AS scored FROM read
    WHERE t >= f AND t > s GROUP BY model, k)"""

_SQL_TRIMMED = f"""{SQL_SAMPLES},
  marked AS (SELECT *, metric = 'cpu' AND row_number() OVER (PARTITION BY model_name, metric
      ORDER BY ts, sample_id) = 1 AS skip FROM samples),
  placed AS (SELECT *, row_number() OVER (PARTITION BY model_name, metric ORDER BY value) AS place,
      count(*) OVER (PARTITION BY model_name, metric) AS n FROM marked WHERE NOT skip),
  means AS (SELECT model_name, metric, avg(value) AS m FROM placed
    WHERE place > {EXTREMES} AND place <= n - {EXTREMES} GROUP BY ALL)"""

ORACLE = {
    "resource_trimmed_mean": f"""WITH {_SQL_TRIMMED}
        SELECT model_name, {", ".join(f"round(coalesce(max(m) FILTER (metric = '{m}') / {s}, 'nan'::DOUBLE), 6) AS {bench.SUMMARY_NAMES[m]}"
          for m, s in bench.METRICS.items())}
        FROM samples LEFT JOIN means USING (model_name, metric) GROUP BY model_name""",
    "value_quantiles": f"""WITH {SQL_SAMPLES},
        q AS (SELECT unnest({list(QUANTILES)}::DOUBLE[]) AS quantile),
        placed AS (SELECT model_name, metric, value,
            row_number() OVER (PARTITION BY model_name, metric ORDER BY value) AS place,
            count(value) OVER (PARTITION BY model_name, metric) AS n FROM samples WHERE value IS NOT NULL)
        SELECT model_name, metric, quantile, value FROM placed, q
        WHERE place = greatest(1, ceil(round(quantile * n, 9)))""",
    "joined_by_path": f"""WITH {SQL_FILES},
        n AS (SELECT path, len(regexp_extract_all(lower(content), '[a-z]+')) + CASE WHEN row_number() OVER (ORDER BY path) = 1
          THEN 0 ELSE 2 END AS n_tokens FROM files)
        SELECT path, CAST(coalesce(sum(n_tokens) OVER (ORDER BY path
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start,
          CAST(n_tokens AS BIGINT) AS n_tokens FROM n""",
    "scorer_ppl_windows": f"""WITH {_SQL_SCORED}
        SELECT model, win AS window, round(mean_nll, 6) AS mean_nll, scored FROM scored""",
    "scorer_ppl_ranking": f"""WITH {_SQL_SCORED}
        SELECT model, round(avg(mean_nll), 6) AS log_ppl, round(exp(avg(mean_nll)), 2) AS ppl
        FROM scored GROUP BY model""",
    "joined_positions": f"""WITH {_WORDS},
        n AS (SELECT doc_id, len(w) + CASE WHEN row_number() OVER (ORDER BY doc_id) = 1 THEN 0 ELSE 2 END AS n_tokens
          FROM docs)
        SELECT doc_id, CAST(coalesce(sum(n_tokens) OVER (ORDER BY doc_id
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start,
          CAST(n_tokens AS BIGINT) AS n_tokens FROM n""",
    "ppl_window_ids": f"""WITH {_WORDS},
        t AS (SELECT sum(len(w)) AS n FROM docs),
        pos AS (SELECT CAST(n AS BIGINT) AS n, unnest(range(0, CAST(n AS BIGINT))) AS t FROM t),
        wins AS (SELECT k, k * {STRIDE} AS b, least(k * {STRIDE} + {LENGTH}, n) AS e, n
          FROM (SELECT CAST(n AS BIGINT) AS n, unnest(range(0, CAST(ceil(n / {STRIDE}) AS BIGINT))) AS k FROM t)),
        used AS (SELECT *, least({STRIDE}, e - coalesce(lag(e) OVER (ORDER BY k), 0)) AS trg FROM wins
          QUALIFY coalesce(lag(e) OVER (ORDER BY k), 0) < n),
        scored AS (SELECT k, unnest(range(greatest(e - trg, b + 1), e)) AS t FROM used)
        SELECT k AS window, min(pos.t) AS first_t, max(pos.t) AS last_t, count(*) AS tokens
        FROM pos LEFT JOIN scored USING (t) GROUP BY k""",
    "bigram_nll": f"WITH {_SQL_EVAL} SELECT model, a, b, round(nll, 6) AS nll FROM nll",
    "perplexity_windows": f"""WITH {_SQL_EVAL}
        SELECT model, CAST(win AS BIGINT) AS window, round(mean_nll, 6) AS mean_nll, scored FROM means""",
    "model_ppl_ranking": f"""WITH {_SQL_EVAL}
        SELECT model, round(avg(mean_nll), 6) AS log_ppl, round(exp(avg(mean_nll)), 2) AS ppl
        FROM means GROUP BY model""",
    "benchmark_summary": """SELECT event_type AS model_name, round(sum(value), 4) AS time_taken,
          CAST(sum(floor(value * 10)) AS BIGINT) AS num_chars,
          round(sum(value) / (5 * count(DISTINCT user_id)), 6) AS secs_per_task
        FROM events WHERE event_id % 6 >= 1 GROUP BY 1""",
    "resource_median": f"""WITH {_SQL_MEDIANS} SELECT model_name, round(cpu_usage, 6) AS cpu_usage,
          round(gpu_usage, 6) AS gpu_usage, round(ram_gb, 6) AS ram_gb, round(vram_gb, 6) AS vram_gb FROM med""",
    "melt_memory": f"""WITH {_SQL_MEDIANS}
        SELECT model_name, 'RAM' AS type, round(ram_gb, 6) AS memory_gb FROM med
        UNION ALL SELECT model_name, 'VRAM', round(vram_gb, 6) FROM med""",
}
