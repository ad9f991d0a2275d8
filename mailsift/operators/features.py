"""Message features: five groups as nested structs, and the ordered vector made of them."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, functions as F

from mailsift import vocabulary as V
from mailsift.functions import links
from mailsift.functions.numeric import round6
from mailsift.functions.text import count_char, is_present, letters_only, strip, uppercase_share

ADDRESS = r"[^\s<>@]+@[^\s<>@]+"

# The order of the model vector.
VECTOR_FIELDS = (
    "header.hasSubject", "header.subjectLength", "header.subjectUppercaseRatio", "header.subjectExclamationCount",
    "header.hasSender", "header.recipientCount", "header.replyToDiffersFromFrom",
    "link.urlCount", "link.uniqueDomainCount", "link.hasIpUrl", "link.hasPunycodeDomain", "link.maxUrlLength",
    "text.charCount", "text.wordCount", "text.uppercaseRatio", "text.exclamationCount", "text.avgWordLength",
    "timing.hasDate", "timing.hourOfDayUtc", "timing.dayOfWeek", "timing.weekend",
    "auth.spf", "auth.dkim", "auth.dmarc",
)
# What an authentication token is worth in the vector.
AUTH_SCORES = {"pass": 1.0, "softfail": -0.5, "fail": -1.0}


def with_header_features(
    df: DataFrame, subject: str = "subject", sender: str = "sender", recipients: str = "recipients",
    reply_to: str = "reply_to", out: str = "header",
) -> DataFrame:
    def first_address(name: str) -> Column:
        return F.lower(F.regexp_extract(name, ADDRESS, 0))

    title = F.col(subject)
    listed = F.filter(F.split(recipients, ","), is_present)
    own, reply = F.col("_own_address"), F.col("_reply_address")
    staged = df.withColumns({
        "_letters": letters_only(title), "_own_address": first_address(sender), "_reply_address": first_address(reply_to),
    })
    header = F.struct(
        is_present(title).alias("hasSubject"),
        F.coalesce(F.length(title), F.lit(0)).alias("subjectLength"),
        uppercase_share(F.col("_letters")).alias("subjectUppercaseRatio"),
        count_char(title, "!").alias("subjectExclamationCount"),
        is_present(F.col(sender)).alias("hasSender"),
        F.coalesce(F.size(listed), F.lit(0)).alias("recipientCount"),
        F.coalesce((own != "") & (reply != "") & (own != reply), F.lit(False)).alias("replyToDiffersFromFrom"),
    )
    return staged.withColumn(out, header).drop("_letters", "_own_address", "_reply_address")


def with_link_features(df: DataFrame, body: str, out: str = "link") -> DataFrame:
    staged = df.withColumn("_urls", F.coalesce(links.urls(F.col(body)), F.array().cast("array<string>"))).withColumn(
        "_hosts", F.filter(F.transform("_urls", links.url_host), lambda h: h.isNotNull())
    )
    link = F.struct(
        F.size("_urls").alias("urlCount"),
        F.size(F.array_distinct("_hosts")).alias("uniqueDomainCount"),
        F.exists("_hosts", lambda h: h.rlike(links.IPV4_HOST)).alias("hasIpUrl"),
        F.exists("_hosts", lambda h: F.instr(h, "xn--") > 0).alias("hasPunycodeDomain"),
        F.coalesce(F.array_max(F.transform("_urls", F.length)), F.lit(0)).alias("maxUrlLength"),
    )
    return staged.withColumn(out, link).drop("_urls", "_hosts")


def with_text_features(df: DataFrame, body: str, out: str = "text") -> DataFrame:
    """Words are counted by their gaps, so long bodies never become arrays of words.

    Each pass over the body is its own projection, which keeps the optimizer from repeating it.
    """
    text = F.coalesce(F.col(body), F.lit(""))
    staged = df.withColumns(
        {"_spaced": F.regexp_replace(strip(text), r"\s+", " "), "_letters": letters_only(text)}
    ).withColumn("_word_chars", F.length("_spaced") - count_char(F.col("_spaced"), " "))
    words = F.when(F.length("_spaced") == 0, F.lit(0)).otherwise(F.length("_spaced") - F.col("_word_chars") + 1)
    staged = staged.withColumn("_words", words)
    mean = F.when(F.col("_words") > 0, round6(F.col("_word_chars") / F.col("_words"))).otherwise(F.lit(0.0))
    features = F.struct(
        F.length(text).alias("charCount"),
        F.col("_words").alias("wordCount"),
        uppercase_share(F.col("_letters")).alias("uppercaseRatio"),
        count_char(text, "!").alias("exclamationCount"),
        mean.alias("avgWordLength"),
    )
    return staged.withColumn(out, features).drop("_spaced", "_letters", "_word_chars", "_words")


def timing_features(moment: Column) -> Column:
    """UTC hour and ISO weekday; the session time zone must be UTC."""
    day = F.weekday(moment) + 1
    return F.struct(
        moment.isNotNull().alias("hasDate"),
        F.hour(moment).alias("hourOfDayUtc"),
        day.alias("dayOfWeek"),
        F.coalesce(day >= 6, F.lit(False)).alias("weekend"),
    )


def auth_features(auth_results: Column) -> Column:
    def token(method: str) -> Column:
        found = F.lower(F.regexp_extract(auth_results, rf"(?i)\b{method}\s*=\s*([a-z]+)", 1))
        return F.coalesce(F.nullif(found, F.lit("")), F.lit("unknown"))

    return F.struct(*[token(m).alias(m) for m in ("spf", "dkim", "dmarc")])


def reputation_bucket(auth: Column) -> Column:
    aligned = F.coalesce(F.lower(auth["dmarc"]) == "pass", F.lit(False))
    return F.when(aligned, F.lit("AUTHENTICATED")).otherwise(F.lit("UNAUTHENTICATED"))


def extract_features(messages: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """One row of nested features per message.

    Reads subject, sender, recipients, reply_to, body_raw, body_display, received_at and auth_results.
    """
    grouped = with_header_features(messages, out="_header")
    grouped = with_link_features(grouped, "body_raw", out="_link")
    grouped = with_text_features(grouped, "body_display", out="_text")
    features = F.struct(
        F.col("_header").alias("header"),
        F.col("_link").alias("link"),
        F.col("_text").alias("text"),
        timing_features(F.col("received_at")).alias("timing"),
        auth_features(F.col("auth_results")).alias("auth"),
        F.lit(None).cast("array<float>").alias("embedding"),
    )
    return grouped.select(
        "email_id", *(keep or []), F.lit(V.FEATURE_VERSION).alias("feature_version"), features.alias("features")
    )


def feature_array(features: Column) -> Column:
    """The 24 features in model order, as floats."""

    def number(path: str) -> Column:
        group, name = path.split(".")
        value = features[group][name]
        if group == "auth":
            scored = F.lit(0.0)
            for token, score in AUTH_SCORES.items():
                scored = F.when(value == token, F.lit(score)).otherwise(scored)
            value = scored
        elif name in ("hourOfDayUtc", "dayOfWeek"):
            value = F.coalesce(value, F.lit(-1))
        return value.cast("float")

    return F.array(*[number(path) for path in VECTOR_FIELDS])


def with_vector(features: DataFrame, out: str = "feature_vector") -> DataFrame:
    return features.withColumn(out, array_to_vector(feature_array(F.col("features")).cast("array<double>")))
