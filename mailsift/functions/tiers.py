"""Decision tiers as ordinals, and the small mappings between decisions, routes and signals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from mailsift import vocabulary as V


def lookup(key: Column, table: dict[str, object]) -> Column:
    """``CASE key WHEN … END`` over a small fixed table; null when absent."""
    branches = [(key == F.lit(k), F.lit(v)) for k, v in table.items()]
    first, *rest = branches
    return reduce(lambda acc, b: acc.when(*b), rest, F.when(*first))


def severity(tier: Column) -> Column:
    return lookup(tier, {name: rank for rank, name in enumerate(V.TIERS)})


def tier_name(rank: Column) -> Column:
    return F.when(rank.isNotNull(), F.element_at(F.array(*[F.lit(t) for t in V.TIERS]), (rank + 1).cast("int")))


def most_severe(*tiers: Column) -> Column:
    return tier_name(F.greatest(*[severity(t) for t in tiers]))


def delivered(tier: Column) -> Column:
    return tier.isin(*V.DELIVERED_TIERS)


def is_abuse(label: Column) -> Column:
    return label.isin(*V.ABUSE_LABELS)


def decision_signal(tier: Column) -> Column:
    """Delivered mail speaks for its sender, withheld mail against."""
    return F.when(delivered(tier), F.lit("GOOD")).otherwise(F.lit("BAD"))


def feedback_signal(action: Column) -> Column:
    """Null for actions that carry no signal."""
    return lookup(action, V.FEEDBACK_SIGNALS)


def feedback_trust(malicious: Column, malicious_trust: float = V.MALICIOUS_TRUST) -> Column:
    return F.when(malicious, F.lit(float(malicious_trust))).otherwise(F.lit(1.0))


def route_bucket(route: Column) -> Column:
    token = F.lower(route)
    return (
        F.when(token == "hard_rule", F.lit("rules"))
        .when(token == "llm", F.lit("llm"))
        .otherwise(F.lit("reputation"))
    )


def track(label: Column) -> Column:
    return F.when(label == "ham", F.lit("LEGIT")).otherwise(F.lit("SPAM"))


def attacker_won(track_name: Column, was_delivered: Column) -> Column:
    return F.when(track_name == "LEGIT", ~was_delivered).otherwise(was_delivered)


def explanation(tier: Column, reason_codes: Column) -> Column:
    """One sentence for a tier and its reason codes."""
    verdict = lookup(tier, V.TIER_VERDICTS)
    phrases = F.concat_ws("; ", F.transform(reason_codes, lambda code: lookup(code, V.REASON_PHRASES)))
    empty = F.when(tier == "ALLOW", F.lit(V.NO_RULE_SENTENCE)).otherwise(
        F.concat(verdict, F.lit(V.NO_REASON_SUFFIX))
    )
    return F.when(F.size(reason_codes) == 0, empty).otherwise(F.concat(verdict, F.lit(": "), phrases, F.lit(".")))
