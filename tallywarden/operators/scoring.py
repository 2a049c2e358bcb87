"""Model calls as partition functions, with failover and retries."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.ml.feature import IDF, HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywarden.session import cut_lineage


class RateLimited(Exception):
    """Raised by a scorer to hand the batch to the next scorer."""


Scorer = Callable[[str], str]


def with_retries(scorer: Scorer, usable: Callable[[str], bool], more: int = 2, empty: str = "{}") -> Scorer:
    """Ask again up to ``more`` times while the answer is unusable, then ``empty``."""

    def ask(prompt: str) -> str:
        for _ in range(more + 1):
            answer = scorer(prompt)
            if usable(answer):
                return answer
        return empty

    return ask


def _calls(name: str, scorer: Scorer, prompt: str):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            answers, outcomes = [], []
            for text in part[prompt]:
                try:
                    answers.append(scorer(text))
                    outcomes.append("completed")
                except RateLimited:
                    answers.append(None)
                    outcomes.append("rate_limited")
                except Exception:
                    answers.append(None)
                    outcomes.append("error")
            yield part.assign(answer=answers, outcome=outcomes, provider=name)

    return run


def score_batches(
    df: DataFrame, scorers: list[tuple[str, Scorer]], prompt: str = "prompt", parallel: int | None = None
) -> DataFrame:
    """Rows with answer, outcome and provider. What one scorer is too busy for
    goes to the next, in order; any other failure is an ``error``.

    Each round is checkpointed, so a call that was answered is not made again.
    ``parallel`` bounds the partitions, hence the calls in flight.
    """
    schema = T.StructType(
        [*df.schema.fields, *[T.StructField(c, T.StringType()) for c in ("answer", "outcome", "provider")]]
    )
    waiting, done = df, None
    for place, (name, scorer) in enumerate(scorers):
        if parallel:
            waiting = waiting.repartition(parallel)
        asked = cut_lineage(waiting.mapInPandas(_calls(name, scorer, prompt), schema))
        last = place == len(scorers) - 1
        settled = asked if last else asked.filter(F.col("outcome") != "rate_limited")
        done = settled if done is None else done.unionByName(settled)
        waiting = asked.filter(F.col("outcome") == "rate_limited").select(*df.columns)
    return done


def outcome_counts(scored: DataFrame) -> DataFrame:
    return scored.groupBy("provider", "outcome").agg(F.count("*").alias("batches"))


def embed(df: DataFrame, text: str, out: str = "embedding", model: Column | None = None, features: int = 1024) -> DataFrame:
    """Unit vectors of texts: from a pandas UDF column, or hashed term weights."""
    if model is not None:
        return df.withColumn(out, model)
    words = df.withColumn(
        "__words", F.filter(F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    )
    counted = HashingTF(inputCol="__words", outputCol="__tf", numFeatures=features).transform(words)
    weighted = IDF(inputCol="__tf", outputCol="__idf").fit(counted).transform(counted)
    unit = Normalizer(inputCol="__idf", outputCol="__unit").transform(weighted)
    return unit.withColumn(out, vector_to_array("__unit", "float32")).drop("__words", "__tf", "__idf", "__unit")
