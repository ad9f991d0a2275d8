"""URL filter: rules first, then a character language-model ratio.

Two smoothed variable-order Markov models over characters are learned, one from URLs that rules accept and one from
URLs that rules reject. A character is predicted from up to ``ORDER`` characters before it; a context gives way to
the next shorter one by Witten-Bell interpolation, and a context that a model never saw gives way wholly. The score
of a URL is the mean over its characters of log P(accepted) - log P(rejected). URLs of the rules in the first of
``PARTS`` parts by their MD5 are kept out of the models; on their scores a threshold is calibrated: two normal distributions with
one variance and the observed class shares, equal odds at the threshold.

Everything is DataFrame functions. Distinct URLs are modelled once, so a URL that fills a third of the table is one
row until the last join. All counts have partial aggregates.

Nulls, empties, repeats: a null URL, or one without ``://``, has an empty host and path, so no rule fits; an empty
or null URL has no characters, scores 0 and passes when the threshold is not above 0. Without rejected or accepted
training URLs the threshold is 0. Repeated rows are all judged, equal URLs alike. A very long URL
is scored whole. An empty table gives no rows. Extra columns, of any name, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from mailsift.llm.natives import fold_ascii
from mailsift.llm.storage import stored

ORDER = 4
PARTS = 5
#: (pattern, verdict); a pattern is a host and the beginning of a path.
RULES = (
    ("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"),
)
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_PAD = "\x02"


def host_and_path(url: Column) -> tuple[Column, Column]:
    text = F.coalesce(url, F.lit(""))
    return fold_ascii(F.regexp_extract(text, _PARTS, 1)), F.regexp_extract(text, _PARTS, 2)


def matching_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule (by its pattern) that fits, and its verdict; nulls where none fits."""
    pattern = verdict = None
    for rule, judged in sorted(rules, key=lambda r: (-len(r[0]), -r[0].find("/"))):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        pattern = F.when(fits, F.lit(rule)) if pattern is None else pattern.when(fits, F.lit(rule))
        verdict = F.when(fits, F.lit(judged)) if verdict is None else verdict.when(fits, F.lit(judged))
    none = F.lit(None).cast("string")
    return (none, none) if pattern is None else (pattern, verdict)


def _grams(urls: DataFrame, order: int) -> DataFrame:
    """One row per character: the character after its ``order`` predecessors."""
    chars = urls.select("*", F.split("url", "").alias("chars"))
    at = chars.select("*", F.posexplode("chars").alias("place", "char")).filter("char <> ''")
    before = [F.coalesce(F.get("chars", F.col("place") - back), F.lit(_PAD)) for back in range(order, 0, -1)]
    return at.select(*urls.columns, F.concat(*before, "char").alias("gram"))


def _ratio_table(grams: DataFrame, order: int) -> DataFrame:
    """(gram, ratio): log10 P(accepted) - log10 P(rejected) of its last character after the others."""
    top = stored(grams.groupBy("gram").agg(
        F.sum(F.when(F.col("verdict") == "allow", 1).otherwise(0)).alias("a"),
        F.sum(F.when(F.col("verdict") == "block", 1).otherwise(0)).alias("r"),
    ))
    lower = None
    for k in range(order + 1):
        gram = F.substring("gram", order + 1 - k, k + 1)
        level = top.groupBy(gram.alias("g")).agg(F.sum("a").alias("a"), F.sum("r").alias("r"))
        context = F.substring("g", 1, k)
        seen = level.groupBy(context.alias("c")).agg(
            F.sum("a").alias("ca"), F.sum("r").alias("cr"), F.count("*").alias("kinds"),
            F.sum((F.col("a") > 0).cast("long")).alias("ta"), F.sum((F.col("r") > 0).cast("long")).alias("tr"),
        )
        joined = level.withColumn("c", context).join(seen, "c")
        if k == 0:
            p = lambda n, total: (F.col(n) + 1.0) / (F.col(total) + F.col("kinds") + 1.0)
            lower = joined.select("g", p("a", "ca").alias("pa"), p("r", "cr").alias("pr"))
            continue
        joined = joined.withColumn("shorter", F.substring("g", 2, k)).join(
            lower.select(F.col("g").alias("shorter"), F.col("pa").alias("la"), F.col("pr").alias("lr")), "shorter"
        )
        blend = lambda n, kinds, back, total: F.when(
            F.col(total) > 0, (F.col(n) + F.col(kinds) * F.col(back)) / (F.col(total) + F.col(kinds))
        ).otherwise(F.col(back))
        lower = joined.select("g", blend("a", "ta", "la", "ca").alias("pa"), blend("r", "tr", "lr", "cr").alias("pr"))
    return lower.select(F.col("g").alias("gram"), (F.log10("pa") - F.log10("pr")).alias("ratio"))


def url_part(url: Column) -> Column:
    return F.conv(F.substring(F.md5(url), 1, 8), 16, 10).cast("long") % PARTS


def threshold(scored: DataFrame) -> Column:
    """Score at which accepted and rejected are equally likely among held-back URLs of the rules."""
    allow, block = F.col("verdict") == "allow", F.col("verdict") == "block"
    stats = scored.agg(
        F.avg(F.when(allow, F.col("score"))).alias("ma"), F.avg(F.when(block, F.col("score"))).alias("mr"),
        F.sum(allow.cast("double")).alias("na"), F.sum(block.cast("double")).alias("nr"),
        F.coalesce(F.var_pop(F.when(allow, F.col("score"))), F.lit(0.0)).alias("va"),
        F.coalesce(F.var_pop(F.when(block, F.col("score"))), F.lit(0.0)).alias("vr"),
    )
    pooled = (F.col("va") * F.col("na") + F.col("vr") * F.col("nr")) / (F.col("na") + F.col("nr"))
    cut = (F.col("ma") + F.col("mr")) / 2 - pooled * F.log(F.col("na") / F.col("nr")) / (F.col("ma") - F.col("mr"))
    return stats.select(F.when(F.col("ma") > F.col("mr"), cut).otherwise(F.lit(0.0)).alias("cut")).scalar()


def judge_urls(pages: DataFrame, rules=RULES, order: int = ORDER) -> DataFrame:
    """page_id, host, path, rule, verdict and the method's score of every page (the score is null where a rule judged)."""
    urls = pages.filter("url IS NOT NULL").select("url").distinct()
    host, path = host_and_path(F.col("url"))
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    judged = urls.select("url", host.alias("host"), path.alias("path")).select("url", rule.alias("rule"), verdict.alias("verdict"))
    back = url_part(F.col("url")) == 0
    judged = stored(judged.withColumn("held_back", F.col("verdict").isNotNull() & back))
    grams = _grams(judged.select("url", F.when(~F.col("held_back"), F.col("verdict")).alias("verdict")), order)
    ratios = stored(_ratio_table(grams.select("gram", "verdict"), order))
    asked = judged.filter(F.col("verdict").isNull() | F.col("held_back"))
    scored = _grams(asked.select("url"), order).join(ratios, "gram").groupBy("url").agg(F.avg("ratio").alias("score"))
    scored = stored(asked.join(scored, "url", "left").select("url", "verdict", F.coalesce("score", F.lit(0.0)).alias("score")))
    cut = threshold(scored.filter("verdict IS NOT NULL"))
    method = scored.filter("verdict IS NULL").select("url", "score")
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", "url", host.alias("host"), path.alias("path")).withColumns(
        dict(zip(("rule", "verdict"), matching_rule(F.col("host"), F.col("path"), rules)))
    ).join(method, "url", "left")
    score = F.coalesce("score", F.lit(0.0))
    return rows.select(
        "page_id", "host", "path", "rule",
        F.coalesce("verdict", F.when(score < cut, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"), "score",
    )
