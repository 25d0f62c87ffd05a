"""Confidence of an answer from its token log-probabilities, or from its wording, as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyforge.functions.numbers import let

#: Words that hedge, and the weights of the heuristic.
HEDGES = ("maybe", "perhaps", "possibly", "uncertain", "unsure", "might", "could")
BASE, HEDGE_WEIGHT, SHORT_PENALTY, SHORT = 0.85, 0.5, 0.3, 3
_TINY = 1e-12


def _mean(values: Column) -> Column:
    kept = F.filter(values, lambda x: x.isNotNull())
    return F.coalesce(F.try_divide(F.aggregate(kept, F.lit(0.0), lambda acc, x: acc + x), F.size(kept)), F.lit(0.0))


def peak(positions: Column) -> Column:
    """Mean, over the positions with tokens, of the likeliest token's probability; 0 without any."""
    return F.coalesce(_mean(F.transform(positions, lambda p: F.exp(F.array_max(F.map_values(p))))), F.lit(0.0))


def _certainty(p: Column) -> Column:
    def of(raw: Column) -> Column:
        return let(F.aggregate(raw, F.lit(0.0), lambda acc, x: acc + x), lambda total: one_less_entropy(raw, total))

    def one_less_entropy(raw: Column, total: Column) -> Column:
        entropy = -F.aggregate(raw, F.lit(0.0), lambda acc, x: acc + F.try_divide(x, total) * F.ln(F.try_divide(x, total) + _TINY))
        most = F.when(F.size(raw) > 1, F.ln(F.size(raw))).otherwise(1.0)
        return F.when(total > 0, 1 - entropy / (most + _TINY))

    return let(F.transform(F.map_values(p), lambda lp: F.exp(lp)), of)


def certainty(positions: Column) -> Column:
    """1 less the normalised entropy, averaged over the positions with tokens; 0 without any."""
    return F.coalesce(_mean(F.transform(positions, _certainty)), F.lit(0.0))


METHODS = {"max_logprob": peak, "entropy": certainty}


def from_logprobs(positions: Column, method: str = "max_logprob") -> Column:
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}; there are {', '.join(METHODS)}")
    return METHODS[method](positions)


def from_wording(text: Column) -> Column:
    """A base less penalties for hedging words and shortness, within 0 and 1; 0 for an empty or null text."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    hedging = F.size(F.filter(words, lambda w: F.lower(w).isin(*HEDGES)))
    n = F.size(words)
    score = F.lit(BASE) - HEDGE_WEIGHT * hedging / F.greatest(n, F.lit(1)) - F.when(n < SHORT, SHORT_PENALTY).otherwise(0.0)
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))
