"""Scoring heads: from logits in micro-units (BIGINT) to scores, labels and flags.

A head takes column names and gives SQL text per output column; wide projections of many heads stay
cheap to build that way. Missing logits give missing results.

Shown scores are rounded. What ranks documents is the exact ratio behind the logit, total / grams micro-units:
its whole part `rank_high` and the next 62 bits `rank_low`. Two different ratios of less than 2^31 grams lie at least
2^-62 apart, so no two of them share a key, and equal ratios always do.
"""

import math
from fractions import Fraction

# Fixed values.
MICRO = 1_000_000
REGRESSION_BASE = 2.5
REGRESSION_MAX = 5
HIGH_QUALITY_AT = 2.5
LABELS = ["__label__high_quality", "__label__low_quality"]

DIGIT = 31  # bits of a digit of `rank_low`, which has two
SOFTMAX_STEPS = 10**12  # a softmax has no ratio behind it; its order is that of 12 digits


def logit(micro: str) -> str:
    return f"({micro} / {MICRO}D)"


def probability(micro: str) -> str:
    return f"round(1D / (1D + exp(-{logit(micro)})), 6)"


def nearest(value: str) -> str:
    """Half-even rounding to an int."""
    return f"cast(bround({value}, 0) AS int)"


def clamp(value: str, low: int, high: int) -> str:
    return f"CASE WHEN {value} < {low} THEN {low}D WHEN {value} > {high} THEN {high}D ELSE {value} END"


def regression(micro: str) -> str:
    return clamp(f"({REGRESSION_BASE}D + {logit(micro)})", 0, REGRESSION_MAX)


def either(score: str, at: float, high: str, low: str) -> str:
    return f"CASE WHEN {score} >= {at}D THEN {high} WHEN {score} < {at}D THEN {low} END"


def exact_ratio(total: str, grams: str) -> tuple:
    """SQL of the whole part and the next 62 bits of total / grams; null without grams."""
    n = f"nullif({grams}, 0)"
    rest = f"pmod({total}, {n})"
    first = f"shiftleft({rest}, {DIGIT})"
    second = f"shiftleft({first} % {n}, {DIGIT})"
    return f"(({total} - {rest}) div {n})", f"(shiftleft({first} div {n}, {DIGIT}) + {second} div {n})"


def rank_of(signal: str) -> dict:
    return {"rank_high": f"{signal}_high", "rank_low": f"{signal}_low"}


def clamped_rank(signal: str) -> dict:
    """The ratio, but one value beyond either end of the regression's range."""
    reach = int(REGRESSION_BASE * MICRO)
    over, under = f"{signal}_high >= {reach}", f"{signal}_high < -{reach}"
    return {
        "rank_high": f"CASE WHEN {over} THEN {reach}L WHEN {under} THEN -{reach}L ELSE {signal}_high END",
        "rank_low": f"CASE WHEN {over} OR {under} THEN 0L ELSE {signal}_low END",
    }


def reaches(signal: str, share: float) -> str:
    """SQL: whether the probability of the exact ratio is at least `share`."""
    if share <= 0:
        return f"{signal}_high IS NOT NULL"
    if share >= 1:
        return "false"
    logit = Fraction(math.log(share / (1 - share))) * MICRO
    high = math.floor(logit)
    low = math.ceil((logit - high) * (1 << 2 * DIGIT))
    return f"({signal}_high > {high}L OR ({signal}_high = {high}L AND {signal}_low >= {low}L))"


def binary(micro: str) -> dict:
    return {"score": probability(micro), **rank_of(micro)}


def top_label(micro: str) -> dict:
    """Confidence of the likelier label, and that label without its prefix's characters."""
    high = probability(micro)
    raw = either(high, 0.5, *[f"'{label}'" for label in LABELS])
    return {
        "score": either(high, 0.5, high, f"round(1D - {high}, 6)"),
        "label": f"trim(LEADING '__label__' FROM {raw})",
        **dict(zip(("rank_high", "rank_low"), exact_ratio(f"abs({micro}_total)", f"{micro}_grams"), strict=True)),
    }


def edu_regression(micro: str) -> dict:
    score = regression(micro)
    return {"score": score, "int_score": nearest(score), **clamped_rank(micro)}


def three_class(first: str, second: str, third: str) -> dict:
    """Softmax over three logits; the first class counts whole, the third half."""
    top = f"greatest({first}, {second}, {third})"
    e1, e2, e3 = (f"exp({logit(f'({micro} - {top})')})" for micro in (first, second, third))
    share = f"(({e1} + 0.5D * {e3}) / ({e1} + {e2} + {e3}))"
    score = f"round({share}, 6)"
    rank = f"cast(floor({share} * {SOFTMAX_STEPS}D) AS bigint)"
    whole = f"CASE WHEN {first} IS NOT NULL THEN 0L END"
    return {
        "score": score,
        "int_score": nearest(clamp(f"(1D + 2D * {score})", 0, 3)),
        "rank_high": rank,
        "rank_low": whole,
    }


def edu_binary(micro: str) -> dict:
    score = regression(micro)
    return {
        "score": score,
        "int_score": nearest(score),
        "label": either(f"({score})", HIGH_QUALITY_AT, "'high_quality'", "'low_quality'"),
        **clamped_rank(micro),
    }


def chunked(micro: str) -> dict:
    """Best chunk, not clamped; only the integer score is."""
    return {"score": logit(micro), "int_score": nearest(clamp(logit(micro), 0, REGRESSION_MAX)), **rank_of(micro)}


def dual(micro: str, binary_micro: str) -> dict:
    score, prob = regression(micro), probability(binary_micro)
    return {
        "score": score,
        "int_score": nearest(score),
        "binary_pred": either(prob, 0.5, "1", "0"),
        "prob": prob,
        **clamped_rank(micro),
    }
