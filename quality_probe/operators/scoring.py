"""Scorers: native ones built on n-gram signals, and any model through Arrow batches."""

from collections.abc import Callable
from dataclasses import dataclass, fields, replace
from functools import reduce
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quality_probe.functions import heads
from quality_probe.operators.ngram import NgramModel, score_signals
from quality_probe.schemas import DOCUMENT_KEYS, SCORE_FIELDS


@dataclass(frozen=True)
class Scorer:
    """A native scorer: the signals it needs and the head that turns them into SQL of score columns."""

    name: str
    signals: tuple
    head: Callable[..., dict]

    def fields(self) -> str:
        """SQL of the score record."""
        made = self.head(*self.signals)
        values = [f"'{f.name}', cast({made.get(f.name, 'NULL')} AS {f.dataType.simpleString()})" for f in SCORE_FIELDS.fields]
        return f"named_struct('classifier', '{self.name}', {', '.join(values)})"


@dataclass(frozen=True)
class ExternalScorer:
    """Any model: `load` runs once per task, `predict(model, texts)` gives one score per text."""

    name: str
    load: Callable[[], Any]
    predict: Callable[[Any, list], list]
    batch_size: int = 100


SCORERS: dict = {}


def register_scorer(scorer) -> None:
    SCORERS[scorer.name] = scorer


register_scorer(Scorer("binary_ngram", ("full_quality",), heads.binary))
register_scorer(Scorer("top_label", ("full_quality",), heads.top_label))
register_scorer(Scorer("edu_regression", ("full_quality",), heads.edu_regression))
register_scorer(Scorer("three_class", ("full_good", "full_poor", "full_mixed"), heads.three_class))
register_scorer(Scorer("chunk_edu", ("chunk_word_quality",), heads.chunked))
register_scorer(Scorer("chunk_edu_v2", ("chunk_pair_quality",), heads.chunked))
register_scorer(Scorer("chunk_binary", ("chunk_word_toxic",), heads.chunked))
register_scorer(Scorer("edu_binary", ("full_clean",), heads.edu_binary))
register_scorer(Scorer("dual_head", ("full_contrast", "full_toxic"), heads.dual))

NATIVE = list(SCORERS)


def chosen(scorers=None) -> list:
    """Scorers themselves or by name, all registered native ones if none are given."""
    return [SCORERS[s] if isinstance(s, str) else s for s in (NATIVE if scorers is None else scorers)]


def enabled(config: list) -> list:
    """The enabled scorers of a job, with the options that the job gives them."""
    found = []
    for entry in config:
        if entry.get("enabled", True):
            options = {k: v for k, v in entry.items() if k not in ("name", "enabled")}
            scorer = SCORERS[entry["name"]]
            known = {f.name for f in fields(scorer)}
            if isinstance(scorer, ExternalScorer):
                scorer = replace(scorer, **{k: v for k, v in options.items() if k in known})
            found.append(scorer)
    return found


def score_native(docs: DataFrame, model: NgramModel, scorers: list, carry=tuple(DOCUMENT_KEYS)) -> DataFrame:
    """Long form: one row per document and scorer, from one pass over the texts."""
    signals = list(dict.fromkeys(s for scorer in scorers for s in scorer.signals))
    summed = score_signals(docs, model, signals, carry, exact=True)
    return summed.selectExpr(*carry, f"inline(array({', '.join(s.fields() for s in scorers)}))")


def isolated(predict: Callable, model, texts: list) -> list:
    """(score, error) of each text: a failing batch is halved until the failing texts stand alone."""
    try:
        scores = [float(s) for s in predict(model, texts)]
        if len(scores) != len(texts):
            raise ValueError(f"{len(scores)} scores for {len(texts)} texts")
        return [(score, None) for score in scores]
    except Exception as error:
        if len(texts) == 1:
            return [(None, f"{type(error).__name__}: {error}")]
        half = len(texts) // 2
        return isolated(predict, model, texts[:half]) + isolated(predict, model, texts[half:])


def score_external(docs: DataFrame, scorer: ExternalScorer, carry=tuple(DOCUMENT_KEYS)) -> DataFrame:
    """Score with a model inside the Python workers. Texts that fail get null and an `error`, all others their score.

    One failing text among n costs about 2 log n calls more.
    """
    carry = list(carry)
    kept = docs.select(*carry, "text")
    load, predict, size = scorer.load, scorer.predict, scorer.batch_size

    def scored(frames):
        model = load()
        for frame in frames:
            found = []
            for start in range(0, len(frame), size):
                found.extend(isolated(predict, model, frame["text"].iloc[start : start + size].tolist()))
            yield frame.drop(columns="text").assign(
                score=pd.array([score for score, _ in found], dtype="Float64"),
                error=pd.array([error for _, error in found], dtype="string"),
            )

    fields = [f for f in kept.schema.fields if f.name != "text"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", score double, error string"
    rows = kept.mapInPandas(scored, schema).withColumn("classifier", F.lit(scorer.name))
    return rows.select(
        *carry,
        "classifier",
        *[
            F.col("score") if f.name == "score" else F.lit(None).cast(f.dataType).alias(f.name)
            for f in SCORE_FIELDS.fields
        ],
        "error",
    )


def score_corpus(docs: DataFrame, model: NgramModel, scorers=None, carry=tuple(DOCUMENT_KEYS)) -> DataFrame:
    """Score every document with every chosen scorer."""
    listed = chosen(scorers)
    native = [s for s in listed if isinstance(s, Scorer)]
    parts = [score_native(docs, model, native, carry)] if native else []
    parts += [score_external(docs, s, carry).drop("error") for s in listed if isinstance(s, ExternalScorer)]
    return reduce(DataFrame.unionByName, parts)
