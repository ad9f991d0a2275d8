"""Checks over model-response strings and the fixed-format context line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from mailsift import vocabulary as V
from mailsift.functions.text import is_present, strip

RESPONSE_SCHEMA = (
    "verdict string, spam_prob double, phishing_prob double, reason_codes array<string>, explanation_short string"
)
RESPONSE_FIELDS = ("verdict", "spam_prob", "phishing_prob", "reason_codes", "explanation_short")


def strip_code_fence(text: Column) -> Column:
    """Drop a surrounding Markdown fence, if any."""
    bare = strip(text)
    opened = F.when(F.instr(bare, "\n") > 0, F.regexp_replace(bare, r"\A[^\n]*\n", "")).otherwise(bare)
    return F.when(bare.startswith("```"), strip(F.regexp_replace(opened, r"```\z", ""))).otherwise(bare)


def with_verdict(df: DataFrame, response: str, out: str = "verdict") -> DataFrame:
    """Adds the response as a struct, null unless every field is present, known and in range.

    The text is cleaned, parsed and judged in projections of their own, so it is parsed once.
    """
    parsed = F.col("_parsed")
    unit_interval = lambda c: c.isNotNull() & c.between(0.0, 1.0)
    known_reasons = F.array(*[F.lit(r) for r in V.MODEL_RESPONSE_REASONS])
    valid = (
        (F.sort_array("_keys") == F.array(*[F.lit(f) for f in sorted(RESPONSE_FIELDS)]))
        & parsed["verdict"].isin(*V.VERDICT_TIERS)
        & unit_interval(parsed["spam_prob"])
        & unit_interval(parsed["phishing_prob"])
        & parsed["reason_codes"].isNotNull()
        & F.forall(parsed["reason_codes"], lambda r: F.array_contains(known_reasons, F.coalesce(r, F.lit(""))))
        & is_present(parsed["explanation_short"])
        & (F.length(parsed["explanation_short"]) <= V.MAX_EXPLANATION_CHARS)
    )
    return (
        df.withColumn("_body", strip_code_fence(F.col(response)))
        .withColumns({"_parsed": F.from_json("_body", RESPONSE_SCHEMA), "_keys": F.json_object_keys("_body")})
        .withColumn(out, F.when(F.coalesce(valid, F.lit(False)), parsed))
        .drop("_body", "_parsed", "_keys")
    )


def grounded_context(features: Column, reputation: Column, reasons: Column, version: int = V.FEATURE_VERSION) -> Column:
    """Trusted signals of one message as the fixed text block given to the slow path.

    ``reputation`` is a struct of trust_mean, evidence_count, uncertainty and dmarc_aligned.
    """
    h, l, t, a = (features[name] for name in ("header", "link", "text", "auth"))
    flag = lambda c: c.cast("string")
    why = F.when(F.size(reasons) == 0, F.lit("(unspecified)")).otherwise(F.array_join(reasons, ", "))
    # The wording and layout of the block.
    layout = "\n".join(
        [
            "=== GROUNDED CONTEXT (trusted, machine-extracted — not the email's own words) ===",
            "Why escalated to you: %s",
            "Feature version: %d",
            "",
            "Header signals:",
            "  has_subject=%s subject_len=%d subject_uppercase_ratio=%.2f subject_exclamations=%d"
            " has_sender=%s recipients=%d reply_to_differs_from_from=%s",
            "Link signals:",
            "  url_count=%d unique_domains=%d has_ip_url=%s has_punycode_domain=%s max_url_len=%d",
            "Text signals:",
            "  char_count=%d word_count=%d uppercase_ratio=%.2f exclamations=%d avg_word_len=%.2f",
            "Authentication: spf=%s dkim=%s dmarc=%s",
            "Sender reputation: trust_mean=%.3f evidence_count=%.1f uncertainty=%.3f dmarc_aligned=%s",
            "=== END GROUNDED CONTEXT ===",
        ]
    )
    return F.format_string(
        layout, why, F.lit(version),
        flag(h["hasSubject"]), h["subjectLength"], h["subjectUppercaseRatio"], h["subjectExclamationCount"],
        flag(h["hasSender"]), h["recipientCount"], flag(h["replyToDiffersFromFrom"]),
        l["urlCount"], l["uniqueDomainCount"], flag(l["hasIpUrl"]), flag(l["hasPunycodeDomain"]), l["maxUrlLength"],
        t["charCount"], t["wordCount"], t["uppercaseRatio"], t["exclamationCount"], t["avgWordLength"],
        a["spf"], a["dkim"], a["dmarc"],
        reputation["trust_mean"], reputation["evidence_count"], reputation["uncertainty"],
        flag(reputation["dmarc_aligned"]),
    )
