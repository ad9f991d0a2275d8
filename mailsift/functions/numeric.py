"""Rounding, clamping, decay and log-odds fusion as column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from mailsift import vocabulary as V

LOGIT_EPSILON = 1e-12


def round6(value: Column) -> Column:
    """Half-up rounding to six decimals."""
    return F.floor(value * F.lit(1e6) + F.lit(0.5)) / F.lit(1e6)


def clamp_unit(value: Column) -> Column:
    return F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0))


def ratio(numerator: Column, denominator: Column) -> Column:
    """``numerator / denominator``, zero where the denominator is zero."""
    return F.when(denominator == 0, F.lit(0.0)).otherwise(
        numerator.cast("double") / F.nullif(denominator, F.lit(0)).cast("double")
    )


def age_seconds(moment: Column, read_at: Column) -> Column:
    return (F.unix_micros(read_at) - F.unix_micros(moment)) / F.lit(1e6)


def surviving_fraction(age: Column, half_life_seconds: float = V.HALF_LIFE_SECONDS) -> Column:
    """``0.5 ^ (age / half-life)``; a negative age never amplifies."""
    if half_life_seconds <= 0:
        raise ValueError("half-life must be positive")
    return F.pow(F.lit(0.5), F.greatest(age, F.lit(0.0)) / F.lit(float(half_life_seconds)))


def _inside_unit(p: Column) -> Column:
    return F.least(F.greatest(p, F.lit(LOGIT_EPSILON)), F.lit(1.0 - LOGIT_EPSILON))


def logit(p: Column) -> Column:
    inside = _inside_unit(p)
    return F.ln(inside / (F.lit(1.0) - inside))


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def fused_logit(reputation_prior: Column, model_confidence: Column, training_base_rate: Column) -> Column:
    return logit(reputation_prior) + logit(model_confidence) - logit(training_base_rate)


def uncertainty_band(reputation_prior: Column, posterior: Column, prior_variance: Column) -> Column:
    """How far the posterior moves for one standard deviation of the sender's trust."""
    prior = _inside_unit(reputation_prior)
    moved = posterior * (F.lit(1.0) - posterior) * F.sqrt(F.greatest(prior_variance, F.lit(0.0)))
    return F.when(prior_variance <= 0, F.lit(0.0)).otherwise(moved / (prior * (F.lit(1.0) - prior)))


def raw_malicious(spam_score: Column, phishing_score: Column) -> Column:
    return clamp_unit(spam_score + phishing_score)


def token_price(prompt_tokens: Column, completion_tokens: Column) -> Column:
    """Dollar price of one slow-path call, six decimals half-up."""
    dollars = prompt_tokens / F.lit(1000.0) * F.lit(V.INPUT_USD_PER_1K) + completion_tokens / F.lit(
        1000.0
    ) * F.lit(V.OUTPUT_USD_PER_1K)
    return F.round(dollars.cast("decimal(20,12)"), 6).cast("decimal(12,6)")


def day_key(moment: Column) -> Column:
    return F.date_format(moment, "yyyy-MM-dd")


def month_key(moment: Column) -> Column:
    return F.date_format(moment, "yyyy-MM")
