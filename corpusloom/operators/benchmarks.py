"""Runtime summaries of benchmarked models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.aggregators import Aggregator, aggregate
from corpusloom.operators.joins import null_safe_join
from corpusloom.operators.quantiles import radix_median

MAX_BROADCAST_GROUPS = 10_000
#: Rows of a group up to which its bracket (a fiftieth of a per cent and what the sketch errs) is ordered in one window.
MOST_BRACKETED = 100_000_000
_ACCURACY = 10_000
_MARGIN = 0.001


def benchmark_summary(runs: DataFrame, burn_in: int = 1) -> DataFrame:
    """One row per model from (model_name, rep, task_id, secs, num_chars), fastest first.

    The first ``burn_in`` repetitions do not count.
    """
    measured = runs.where(F.col("rep") >= burn_in)
    # one row per model and task first: this is where most rows disappear, before any shuffle
    per_task = measured.groupBy("model_name", "task_id").agg(
        F.sum("secs").alias("secs"),
        F.sum("num_chars").alias("num_chars"),
        F.min("rep").alias("first_rep"),
        F.max("rep").alias("last_rep"),
    )
    reps = F.max("last_rep") - F.min("first_rep") + 1
    return (
        per_task.groupBy("model_name")
        .agg(
            F.sum("secs").alias("time_taken"),
            F.sum("num_chars").cast("bigint").alias("num_chars"),
            (F.sum("secs") / (reps * F.count("task_id"))).alias("secs_per_task"),
        )
        .orderBy("secs_per_task", "model_name")
    )


def exact_median(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by…, median): exact, also when one group has most of the rows.

    A quantile sketch brackets the median of each group. Below the bracket rows are only counted;
    the few distinct values inside it are ordered. The built-in exact median keeps all distinct
    values of a group in the memory of one task. With groups above ``MOST_BRACKETED`` rows, whose brackets would be
    long too, all medians are found by radix selection.
    """
    bracket = df.groupBy(*by).agg(
        F.percentile_approx(value, [0.5 - _MARGIN, 0.5 + _MARGIN], _ACCURACY).alias("__q"),
        F.count(value).alias("__rows"),
    )
    groups, largest = bracket.agg(F.count(F.lit(1)), F.max("__rows")).first()
    if (largest or 0) > MOST_BRACKETED:
        return radix_median(df, by, value)
    if groups <= MAX_BROADCAST_GROUPS:
        bracket = F.broadcast(bracket)
    values = df.groupBy(*by, value).agg(F.count(value).alias("__n")).where(F.col(value).isNotNull())
    placed = null_safe_join(values, bracket, by)
    low, high = F.col("__q")[0], F.col("__q")[1]
    # everything below the bracket becomes one row per group; values above it are not needed
    near = placed.where(F.col(value) <= high).groupBy(
        *by, "__rows", F.when(F.col(value) >= low, F.col(value)).alias("__v")
    ).agg(F.sum("__n").alias("__n"))
    in_order = Window.partitionBy(*by).orderBy(F.asc_nulls_first("__v"))
    upto = near.withColumn("__upto", F.sum("__n").over(in_order))
    half_low, half_high = F.floor((F.col("__rows") + 1) / 2), F.floor(F.col("__rows") / 2) + 1
    return upto.groupBy(*by).agg(
        (
            (
                F.min(F.when(F.col("__upto") >= half_low, F.col("__v")))
                + F.min(F.when(F.col("__upto") >= half_high, F.col("__v")))
            )
            / 2
        ).alias("median")
    )


# Resource metrics, the scale of their summary, and whose first sample is ignored.
METRICS = {"cpu": 1.0, "gpu": 1.0, "ram_mb": 1000.0, "vram_mb": 1000.0}
SUMMARY_NAMES = {"cpu": "cpu_usage", "gpu": "gpu_usage", "ram_mb": "ram_gb", "vram_mb": "vram_gb"}
FIRST_SAMPLE_IGNORED = "cpu"


def resource_summary(samples: DataFrame, agg: str | Aggregator = "median") -> DataFrame:
    """One row per model from (model_name, ts, sample_id, metric, value); no samples give NaN.

    ``agg`` is 'median', the name of any aggregate function, or an aggregator of your own. The first CPU sample of a model is
    ignored: it covers the time before the measurement.
    """
    cpu = samples.where(F.col("metric") == FIRST_SAMPLE_IGNORED)
    first = cpu.groupBy("model_name").agg(F.min(F.struct("ts", "sample_id")).alias("__first"))
    kept = samples.join(
        first.select(
            "model_name", F.lit(FIRST_SAMPLE_IGNORED).alias("metric"), "__first.ts", "__first.sample_id"
        ),
        ["model_name", "metric", "ts", "sample_id"],
        "left_anti",
    )
    if isinstance(agg, Aggregator):
        summary = aggregate(kept, ["model_name", "metric"], "value", agg, "own")
        agg = "own"
    elif agg == "median":
        summary = exact_median(kept, ["model_name", "metric"], "value")
    else:
        summary = kept.groupBy("model_name", "metric").agg(
            F.call_function(agg, F.col("value")).alias(agg)
        )

    def column(metric: str, scale: float) -> Column:
        found = F.max(F.when(F.col("metric") == metric, F.col(agg)))
        return F.coalesce(found / scale, F.lit(float("nan"))).alias(SUMMARY_NAMES[metric])

    return summary.groupBy("model_name").agg(*[column(m, s) for m, s in METRICS.items()])


def melt_memory(summary: DataFrame) -> DataFrame:
    """(model_name, type, memory_gb): RAM and VRAM in one column."""
    return summary.select("model_name", F.col("ram_gb").alias("RAM"), F.col("vram_gb").alias("VRAM")).unpivot(
        "model_name", ["RAM", "VRAM"], "type", "memory_gb"
    )
