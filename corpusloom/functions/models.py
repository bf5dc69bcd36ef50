"""Where models plug in.

A model is any callable that maps a batch of prompts to a batch of answers. It is created once per
Python worker, from a factory, and called with whole Arrow batches.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions.text import extract_completion, fim_prompt

Model = Callable[[pd.Series], pd.Series]
ModelFactory = Callable[[], Model]


def echo(prompt: Column) -> Column:
    """Deterministic stand-in for a model: the whole prompt, in capitals."""
    return F.upper(F.translate(prompt, "ß", "?"))


def apply_model(df: DataFrame, prompt: str, factory: ModelFactory, out: str = "response") -> DataFrame:
    """Add the answer of one model to every prompt."""

    @F.pandas_udf(T.StringType())
    def answers(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = factory()
        for batch in batches:
            yield model(batch)

    return df.withColumn(out, answers(F.col(prompt)))


def apply_models(
    df: DataFrame, prompt: str, model_id: str, factories: dict[str, ModelFactory], out: str = "response"
) -> DataFrame:
    """Add the answer of the model that each row names.

    Rows are grouped by model within a batch; a worker creates a model when the first row asks for
    it and keeps it. Repartition by ``model_id`` before if a worker can hold only one.
    """

    @F.pandas_udf(T.StringType())
    def answers(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        loaded: dict[str, Model] = {}
        for ids, prompts in batches:
            result = pd.Series([None] * len(prompts), index=prompts.index, dtype=object)
            for name, rows in prompts.groupby(ids):
                if name not in loaded:
                    loaded[name] = factories[name]()
                result.loc[rows.index] = loaded[name](rows)
            yield result

    return df.withColumn(out, answers(F.col(model_id), F.col(prompt)))


def complete_tasks(
    grid: DataFrame, factories: dict[str, ModelFactory], full_response: bool = True
) -> DataFrame:
    """Add ``completion`` and ``full_code`` to a grid of tasks and models.

    ``full_response`` says that models return their prompt with the answer behind it.
    """
    prompt = fim_prompt(F.col("prefix"), F.col("suffix"))
    # A scan of its own for each model: a task needs one, and no text passes a shuffle. Rows of no model are in the first.
    rows = grid.drop("prompt").withColumn("prompt", prompt)
    names = list(factories)
    own = [F.col("model_id") == name for name in names]
    own[:1] = [F.coalesce(~F.col("model_id").isin(names[1:]), F.lit(True))]
    parts = [apply_models(rows.where(w), "prompt", "model_id", factories) for w in own]
    answered = functools.reduce(DataFrame.unionByName, parts)
    response = F.col("response") if full_response else F.concat("prompt", "response")
    completion = extract_completion(response, F.col("suffix"), F.col("lang_id"))
    return answered.withColumn("completion", completion).withColumn(
        "full_code", F.concat("prefix", "completion", "suffix")
    )


def score_tokens(
    df: DataFrame, tokens: str, factory: Callable[[], Callable[[list], list[float]]], out: str = "nll"
) -> DataFrame:
    """Add the negative log-likelihood of every token of an array, from any causal model."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = factory()
        for batch in batches:
            yield pd.Series([scorer(list(t)) for t in batch], index=batch.index)

    return df.withColumn(out, scores(F.col(tokens)))


def model_embedder(factory: Callable[[], Callable[[list[str]], list]]) -> Callable[[Column], Column]:
    """An embedder for the cache and the search from any callable that maps texts to vectors."""

    def embed(text: Column) -> Column:
        @F.pandas_udf(T.ArrayType(T.FloatType()))
        def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = factory()
            for batch in batches:
                found = [[float(x) for x in vector] for vector in model(batch.tolist())]
                yield pd.Series(found, index=batch.index)

        return vectors(text)

    return embed


def model_tokenizer(factory: Callable[[], Callable[[str], list]], ids: bool = False) -> Callable[[Column], Column]:
    """A tokenizer column from any callable that maps a text to tokens, or to token ids."""

    def tokens(text: Column) -> Column:
        @F.pandas_udf(T.ArrayType(T.LongType() if ids else T.StringType()))
        def split(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            tokenizer = factory()
            for batch in batches:
                yield pd.Series([list(tokenizer(t)) for t in batch], index=batch.index)

        return split(text)

    return tokens
