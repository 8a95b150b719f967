"""Narrow interfaces for models: embedders, scorers and completers, each with a deterministic default."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions.text import tokenize
from lodestar.operators.lexical import top_k

# How many times more hits a scorer gets, and what some embedders want before a question.
OVERFETCH = 3
PREFIXED = "bge"
QUERY_PREFIX = "Represent this sentence for searching relevant passages: "


class Completer(Protocol):
    """Makes a text of a prompt; may raise."""

    name: str

    def complete(self, prompt: str) -> str: ...


def hashed_embedding(text: Column, dim: int = 64) -> Column:
    """A vector of token counts by hash bucket: the default embedder, without a model."""
    buckets = F.transform(tokenize(text), lambda t: F.pmod(F.conv(F.substring(F.md5(t.cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(dim)))
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda k: F.size(F.filter(buckets, lambda b: b == k)).cast("float"))


def as_query(text: Column, model: str) -> Column:
    """A question as the embedder wants it: models of one family want a sentence before it, others the question alone."""
    return F.concat(F.lit(QUERY_PREFIX), text) if PREFIXED in model.lower() else text


def embed(texts: DataFrame, make: Callable[[], Callable[[list[str]], list[list[float]]]], text_col: str = "text") -> DataFrame:
    """``texts`` with ``embedding`` by a model that ``make`` loads once in each task."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for batch in batches:
            yield batch.assign(embedding=list(model(batch[text_col].fillna("").tolist())))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema)
    return texts.mapInPandas(run, f"{kinds}, embedding array<float>")


def sigmoid(score: Column) -> Column:
    return 1 / (1 + F.exp(-score))


def shared_words(query: Column, text: Column) -> Column:
    """The default scorer: distinct words of the question that the text holds."""
    return F.size(F.array_intersect(F.array_distinct(tokenize(query)), tokenize(text))).cast("double")


def rerank(hits: DataFrame, k: int, scorer: Callable[[Column, Column], Column] = shared_words) -> DataFrame:
    """The k best of each query's hits (query_id, doc_id, query, text) by a scorer's logit, as a share between 0 and 1."""
    scored = hits.select("query_id", "doc_id", sigmoid(scorer(F.col("query"), F.col("text")) / 10).alias("score"))
    return top_k(scored, k)


def complete(prompts: DataFrame, make: Callable[[], Completer], prompt_col: str = "prompt") -> DataFrame:
    """``prompts`` with text, model and status; a failing prompt is a row with status error and doesn't stop the others."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for batch in batches:
            texts, states = [], []
            for prompt in batch[prompt_col]:
                try:
                    texts.append(model.complete(prompt))
                    states.append("complete")
                except Exception as error:
                    texts.append(str(error))
                    states.append("error")
            yield batch.assign(text=texts, model=model.name, status=states)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in prompts.schema)
    return prompts.mapInPandas(run, f"{kinds}, text string, model string, status string")


def validate(settings: dict) -> list[str]:
    """What is wrong with settings: a model name must be there, shares must lie in [0, 1]."""
    wrong = [] if settings.get("model") else ["model is empty"]
    return wrong + [f"{k} is not between 0 and 1" for k in ("ubiquitous", "min_score") if not 0 <= float(settings.get(k, 0)) <= 1]
