"""Hard rules: a registry of column rules, the denylist and brand rules, and the severity floor."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from mailsift import vocabulary as V
from mailsift.functions import links
from mailsift.functions.tiers import most_severe, severity, tier_name

# A rule reads message columns and returns struct<severity:int, reason:string>, null when it does not fire.
Rule = Callable[[], Column]


def match(condition: Column, tier: str, reason: str) -> Column:
    hit = F.struct(F.lit(V.TIERS.index(tier)).alias("severity"), F.lit(reason).alias("reason"))
    return F.when(F.coalesce(condition, F.lit(False)), hit)


def denylisted_ids(messages: DataFrame, denylist: DataFrame, text: str = "body_raw", key: str = "email_id") -> DataFrame:
    """Ids of messages that link to a denylisted host or to a sub-domain of one.

    Bodies are read once. Each distinct host of a message is widened to its parent domains, and those
    are matched by an equi-join on which Catalyst broadcasts the list when it is small.
    """
    parents = F.array_distinct(F.flatten(F.transform(links.rule_hosts(F.col(text)), links.domain_suffixes)))
    mentioned = messages.select(key, F.explode(parents).alias("host"))
    bad = denylist.select(F.lower("host").alias("host"))
    return mentioned.join(bad, "host", "left_semi").select(key).distinct()


def with_denylist_flag(messages: DataFrame, denylist: DataFrame, text: str = "body_raw", key: str = "email_id") -> DataFrame:
    """Adds ``links_to_denylist``. Project to the columns needed first: what is passed in may be shuffled by id."""
    hits = denylisted_ids(messages, denylist, text, key).withColumn("links_to_denylist", F.lit(True))
    return messages.join(hits, key, "left").withColumn(
        "links_to_denylist", F.coalesce("links_to_denylist", F.lit(False))
    )


def spoofs_brand(domain: Column, auth_results: Column, brands: Sequence[tuple[str, str]] = V.DEFAULT_BRANDS) -> Column:
    """A sender domain that claims a brand without being it under a DMARC pass.

    The brand list is configuration and one folded literal, whatever its length.
    """
    listed = json.dumps([{"name": n.lower(), "domain": d.lower()} for n, d in brands])
    table = F.from_json(F.lit(listed), "array<struct<name: string, domain: string>>")
    sender = F.lower(domain)
    aligned = F.coalesce(F.contains(F.lower(auth_results), F.lit("dmarc=pass")), F.lit(False))

    def spoof(brand: Column) -> Column:
        own = (sender == brand["domain"]) | sender.endswith(F.concat(F.lit("."), brand["domain"]))
        return (F.contains(sender, brand["name"]) | own) & ~(own & aligned)

    return F.coalesce(F.exists(table, spoof), F.lit(False))


def default_rules(brands: Sequence[tuple[str, str]] = V.DEFAULT_BRANDS) -> list[Rule]:
    """Rules in evaluation order; callers may append their own."""
    return [
        lambda: match(F.col("links_to_denylist"), "BLOCK", "KNOWN_BAD_URL"),
        lambda: match(
            spoofs_brand(F.col("sender_domain"), F.col("auth_results"), brands),
            "QUARANTINE", "MALFORMED_AUTH_BRAND_SPOOF",
        ),
    ]


def apply_rules(messages: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Adds ``hard_rule_decision`` (null when nothing fired) and ``rule_reasons`` in rule order."""
    fired = F.filter(F.array(*[rule() for rule in rules]), lambda m: m.isNotNull())
    return (
        messages.withColumn("_fired", fired)
        .withColumn("hard_rule_decision", tier_name(F.array_max(F.transform("_fired", lambda m: m["severity"]))))
        .withColumn("rule_reasons", F.array_distinct(F.transform("_fired", lambda m: m["reason"])))
        .drop("_fired")
    )


def floor_at_rule(rule_tier: Column, candidate: Column) -> Column:
    """No later stage may end below what a hard rule decided."""
    return most_severe(F.coalesce(rule_tier, F.lit("ALLOW")), candidate)


def softer_than_rule(rule_tier: Column, candidate: Column) -> Column:
    return F.coalesce(severity(candidate) < severity(rule_tier), F.lit(False))
