"""Text providers and classifiers over a column: any callable from texts to texts, run batch by batch on the executors."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

Provider = Callable[[Sequence[str]], Sequence[str]]


def fake(prefix: str = "fake") -> Provider:
    """A provider for tests and dry runs: an answer that depends on the prompt alone."""
    return lambda prompts: [f"{prefix}:{hashlib.sha256(p.encode()).hexdigest()[:16]}" for p in prompts]


def answers(df: DataFrame, prompt: str, out: str, provider: Provider) -> DataFrame:
    """The rows with the provider's answers, asked once a batch; a null prompt is not asked and stays null."""

    @F.pandas_udf(StringType())
    def ask(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for prompts in batches:
            given = prompts.notna()
            told = pd.Series([None] * len(prompts), dtype=object)
            if given.any():
                told[given.to_numpy()] = list(provider(prompts[given].tolist()))
            yield told

    return df.withColumn(out, ask(F.col(prompt)))


def routed(df: DataFrame, prompt: str, task: str, out: str, providers: Mapping[str, Provider], default: str) -> DataFrame:
    """``answers`` by the provider of each row's task; other tasks, and null ones, go to the default."""
    if default not in providers:
        raise ValueError(f"no provider is called {default!r}")

    @F.pandas_udf(StringType())
    def ask(prompts: pd.Series, tasks: pd.Series) -> pd.Series:
        told = pd.Series([None] * len(prompts), dtype=object)
        names = tasks.where(tasks.isin(list(providers)), default).reset_index(drop=True)
        prompts = prompts.reset_index(drop=True)
        for name, part in prompts[prompts.notna()].groupby(names):
            told.loc[part.index] = list(providers[name](part.tolist()))
        return told

    return df.withColumn(out, ask(F.col(prompt), F.col(task)))


def keyword_classifier(text: Column, words: Mapping[str, Sequence[str]], default: str | None = None) -> Column:
    """The first label with a word in the text, without regard to case: what stands for a trained classifier in tests."""
    lower = F.lower(text)
    hits = [F.when(F.contains(lower, F.lit(w.lower())), label) for label, found in words.items() for w in found]
    return F.coalesce(*hits, F.lit(default))
