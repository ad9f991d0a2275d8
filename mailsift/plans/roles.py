"""The driver tables in the roles this engine works on.

Every role exists twice: as a DataFrame and as the SQL that derives the same rows, so that both
sides of a comparison start from the same data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from mailsift.functions.text import sender_key
from mailsift.operators.features import auth_features, reputation_bucket
from mailsift.operators.scoring import Policy

READ_AT = "2024-02-01 00:00:00"
FOLDED_AT = "2024-01-16 00:00:00"

LIVE = Policy("live")
STRICT = Policy("strict", warn=0.30, quarantine=0.55, block=0.85, slow_path=0.20, band=0.02, burst=2)
PSEUDONYM_KEY = b"documented-demo-key-for-pseudonyms"


#: Tables with whole texts and their key: rows are dealt by key before per-row work on texts, whatever the file layout.
TEXT_TABLES = {"documents": "doc_id", "pages": "page_id"}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    stored = spark.read.parquet(f"{folder}/{name}.parquet")
    return stored.repartition(TEXT_TABLES[name]) if name in TEXT_TABLES else stored


def prop_k() -> Column:
    return F.get_json_object("props", "$.k").cast("int")


def events(spark: SparkSession, folder: str) -> DataFrame:
    return as_events(table(spark, folder, "events"))


def event_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The event table as a stream of its files."""
    schema = table(spark, folder, "events").schema
    return as_events(spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder))


def as_events(raw: DataFrame) -> DataFrame:
    return raw.select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value", prop_k().alias("k")
    )


def messages(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as messages; the event of the same number gives arrival, sender and authentication."""
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang", "source")
    domain = F.concat("source", F.lit(".example"))
    sender = F.concat(F.lit("U"), F.col("user_id").cast("string"), F.lit("@"), domain)
    auth = F.concat(
        F.lit("mx.test; spf="), F.when(F.col("k") >= 50, F.lit("pass")).otherwise(F.lit("SoftFail")),
        F.lit("; dmarc="), F.when(F.col("k") % 2 == 0, F.lit("pass")).otherwise(F.lit("fail")),
    )
    joined = docs.join(events(spark, folder), F.col("doc_id") == F.col("event_id"), "left")
    return joined.select(
        F.col("doc_id").alias("email_id"),
        F.when(F.col("event_type") != "view", sender).alias("sender"),
        domain.alias("sender_domain"),
        F.concat(F.lit("team@corp.example, , user"), F.col("k").cast("string"), F.lit("@corp.example")).alias("recipients"),
        F.substring_index("text", "\n", 1).alias("subject"),
        F.when(F.col("event_type") != "signup", F.col("ts")).alias("received_at"),
        (F.col("ts") + F.expr("interval 1 minute")).alias("ingested_at"),
        F.when(F.col("event_type") != "click", auth).alias("auth_results"),
        F.concat_ws("-", "event_type", "lang").alias("ingest_source"),
        F.when(F.col("event_type") == "error", F.lit("other@reply.example")).alias("reply_to"),
        F.col("text").alias("body_raw"),
        F.col("text").alias("body_display"),
    )


def keyed_messages(spark: SparkSession, folder: str) -> DataFrame:
    return messages(spark, folder).select(
        "email_id", sender_key(F.col("sender"), F.col("sender_domain")).alias("sender_key"),
        reputation_bucket(auth_features(F.col("auth_results"))).alias("bucket"),
    )


def truth(spark: SparkSession, folder: str) -> DataFrame:
    label = (
        F.when(F.col("toxic") == 1, F.lit("phish")).when(F.col("quality") == 1, F.lit("ham")).otherwise(F.lit("spam"))
    )
    return table(spark, folder, "labels").select(
        F.col("doc_id").alias("email_id"), label.alias("label"), F.lit("labels").alias("dataset_source")
    )


def reputation_events(spark: SparkSession, folder: str) -> DataFrame:
    return as_reputation_events(events(spark, folder))


def as_reputation_events(rows: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Views say nothing about a sender; errors speak against it, all else for it."""
    return rows.filter("event_type <> 'view'").select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("sender_key"),
        F.when(F.col("event_type") == "error", F.lit("BAD")).otherwise(F.lit("GOOD")).alias("signal"),
        F.least(F.col("value") / 500.0, F.lit(1.0)).alias("weight"),
        F.when(F.col("event_type") == "click", F.lit("feedback")).otherwise(F.lit("accrual")).alias("source"),
        F.when(F.col("k") % 2 == 0, F.lit("AUTHENTICATED")).otherwise(F.lit("UNAUTHENTICATED")).alias("bucket"),
        F.col("ts").alias("occurred_at"), *keep,
    )


def scored(spark: SparkSession, folder: str) -> DataFrame:
    return as_scored(events(spark, folder))


def as_scored(rows: DataFrame) -> DataFrame:
    """Events as scored messages: rule hits, model confidence and fused posterior come from type, k and value."""
    k, value = F.col("k"), F.col("value")
    error = F.col("event_type") == "error"
    rule = F.when(error & (k >= 90), F.lit("BLOCK")).when(error & (k >= 75), F.lit("QUARANTINE"))
    reasons = (
        F.when(error & (k >= 90), F.array(F.lit("KNOWN_BAD_URL"), F.lit("MALFORMED_AUTH_BRAND_SPOOF")))
        .when(error & (k >= 75), F.array(F.lit("MALFORMED_AUTH_BRAND_SPOOF")))
        .otherwise(F.array().cast("array<string>"))
    )
    fused = ~(error & (k >= 75)) & (F.col("event_type") != "view")
    return rows.select(
        F.col("event_id").alias("email_id"), F.col("user_id"), F.col("ts"),
        rule.alias("hard_rule_decision"), reasons.alias("reason_codes"),
        F.when(fused, k / 99.0).alias("calibrated_confidence"),
        F.when(fused, F.least(value / 100.0, F.lit(1.0))).alias("posterior"),
        F.when(fused, k / 2000.0).alias("uncertainty_band"),
        F.when(fused, (F.col("user_id") % 10) / 125.0).alias("sender_uncertainty"),
        F.floor(value * 3).cast("bigint").alias("latency_ms"),
        F.round(value.cast("decimal(20,6)") / 10000, 6).cast("decimal(12,6)").alias("cost_usd"),
    )


def feedback(spark: SparkSession, folder: str) -> DataFrame:
    """Events as feedback: the user number names the message judged, ``k`` the reporter, the day the run."""
    action = (
        F.when(F.col("event_type") == "error", F.lit("REPORT"))
        .when(F.col("event_type") == "purchase", F.lit("RESCUE"))
        .when(F.col("event_type") == "view", F.lit("IGNORE"))
        .otherwise(F.lit("CLICK"))
    )
    return events(spark, folder).select(
        F.col("event_id").alias("feedback_id"), F.col("user_id").alias("email_id"), F.col("k").alias("persona_id"),
        F.date_format("ts", "yyyy-MM-dd").alias("run_id"), action.alias("action"),
        F.least(F.col("value") / 100.0, F.lit(1.0)).alias("action_confidence"),
        F.when(F.col("k") < 40, F.lit("ham")).when(F.col("k") < 70, F.lit("spam")).otherwise(F.lit("phish")).alias("ground_truth"),
    )


def personas(spark: SparkSession, folder: str) -> DataFrame:
    return events(spark, folder).select(F.col("k").alias("persona_id")).distinct().select(
        "persona_id", (F.col("persona_id") >= 85).alias("malicious")
    )


def variants(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as adversarial variants: one run per month, status gives the label, price what the defender did."""
    orders = table(spark, folder, "orders")
    label = (
        F.when(F.col("o_orderstatus") == "F", F.lit("ham"))
        .when(F.col("o_orderstatus") == "O", F.lit("spam")).otherwise(F.lit("phish"))
    )
    return orders.select(
        F.date_format("o_orderdate", "yyyy-MM").alias("run_id"), F.col("o_orderkey").alias("variant_id"),
        F.col("o_orderkey").alias("variant_email_id"), F.col("o_custkey").alias("seed_email_id"),
        label.alias("label"), (F.col("o_totalprice") > 250000).alias("defender_delivered"),
        F.lower(F.split("o_orderpriority", "-")[1]).alias("strategy"), F.lit("attacker-1").alias("attacker_model"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("generation"),
        F.least(F.col("o_totalprice") / 500000.0, F.lit(1.0)).alias("posterior"), F.col("o_orderdate").alias("created_at"),
    )


# Each role: the roles it is made of, and its SQL.
ROLE_SQL: dict[str, tuple[tuple[str, ...], str]] = {
    "ev": ((), """
        SELECT event_id, ts, user_id, event_type, value, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k
        FROM events"""),
    "messages": (("ev",), r"""
        SELECT doc_id AS email_id,
               CASE WHEN event_type <> 'view' THEN 'U' || user_id || '@' || source || '.example' END AS sender,
               source || '.example' AS sender_domain,
               'team@corp.example, , user' || k || '@corp.example' AS recipients,
               split_part(text, chr(10), 1) AS subject,
               CASE WHEN event_type <> 'signup' THEN ts END AS received_at,
               ts + INTERVAL 1 MINUTE AS ingested_at,
               CASE WHEN event_type <> 'click' THEN
                    'mx.test; spf=' || CASE WHEN k >= 50 THEN 'pass' ELSE 'SoftFail' END
                    || '; dmarc=' || CASE WHEN k % 2 = 0 THEN 'pass' ELSE 'fail' END END AS auth_results,
               event_type || '-' || lang AS ingest_source,
               CASE WHEN event_type = 'error' THEN 'other@reply.example' END AS reply_to,
               text AS body
        FROM documents LEFT JOIN ev ON doc_id = event_id"""),
    "keyed": (("messages",), """
        SELECT email_id, lower(coalesce(sender, sender_domain)) AS sender_key,
               CASE WHEN auth_results LIKE '%dmarc=pass%' THEN 'AUTHENTICATED' ELSE 'UNAUTHENTICATED' END AS bucket
        FROM messages"""),
    "truth": ((), """
        SELECT doc_id AS email_id,
               CASE WHEN toxic = 1 THEN 'phish' WHEN quality = 1 THEN 'ham' ELSE 'spam' END AS label,
               'labels' AS dataset_source
        FROM labels"""),
    "rep": (("ev",), """
        SELECT 'u' || user_id AS sender_key, CASE WHEN event_type = 'error' THEN 'BAD' ELSE 'GOOD' END AS signal,
               least(value / 500.0, 1.0) AS weight,
               CASE WHEN event_type = 'click' THEN 'feedback' ELSE 'accrual' END AS source,
               CASE WHEN k % 2 = 0 THEN 'AUTHENTICATED' ELSE 'UNAUTHENTICATED' END AS bucket, ts AS occurred_at
        FROM ev WHERE event_type <> 'view'"""),
    "scored": (("ev",), """
        SELECT event_id AS email_id, user_id, ts, event_type,
               CASE WHEN event_type = 'error' AND k >= 90 THEN 'BLOCK'
                    WHEN event_type = 'error' AND k >= 75 THEN 'QUARANTINE' END AS rule,
               CASE WHEN event_type = 'error' AND k >= 90 THEN ['KNOWN_BAD_URL', 'MALFORMED_AUTH_BRAND_SPOOF']
                    WHEN event_type = 'error' AND k >= 75 THEN ['MALFORMED_AUTH_BRAND_SPOOF']
                    ELSE CAST([] AS VARCHAR[]) END AS reason_codes,
               CASE WHEN event_type <> 'view' AND NOT (event_type = 'error' AND k >= 75)
                    THEN k / 99.0 END AS confidence,
               CASE WHEN event_type <> 'view' AND NOT (event_type = 'error' AND k >= 75)
                    THEN least(value / 100.0, 1.0) END AS posterior,
               CASE WHEN event_type <> 'view' AND NOT (event_type = 'error' AND k >= 75)
                    THEN CAST(k AS DOUBLE) / 2000.0 END AS band,
               CASE WHEN event_type <> 'view' AND NOT (event_type = 'error' AND k >= 75)
                    THEN CAST(user_id % 10 AS DOUBLE) / 125.0 END AS uncertainty,
               CAST(floor(value * 3) AS BIGINT) AS latency_ms,
               CAST(round(CAST(value AS DECIMAL(20,6)) / 10000, 6) AS DECIMAL(12,6)) AS cost_usd
        FROM ev"""),
    "policies": ((), """
        SELECT * FROM (VALUES ('live', 0.50e0, 0.80e0, 0.95e0, 0.40e0, 0.05e0, 20),
                              ('strict', 0.30e0, 0.55e0, 0.85e0, 0.20e0, 0.02e0, 2))
               AS p(version, warn, quarantine, block, slow_path, policy_band, burst)"""),
    "routed": (("scored", "policies"), """
        SELECT s.*, p.version AS policy_version, p.burst,
               coalesce(rule, CASE WHEN posterior IS NULL THEN 'ALLOW' WHEN posterior >= block THEN 'BLOCK'
                                   WHEN posterior >= quarantine THEN 'QUARANTINE'
                                   WHEN posterior >= warn THEN 'WARN' ELSE 'ALLOW' END) AS decision,
               posterior IS NOT NULL AND 2.0e0 * abs(confidence - 0.5e0) < slow_path AS low_confidence,
               posterior IS NOT NULL AND uncertainty >= policy_band AS new_sender,
               posterior IS NOT NULL AND least(abs(posterior - warn), abs(posterior - quarantine),
                                               abs(posterior - block)) <= policy_band + band AS near_boundary
        FROM scored s CROSS JOIN policies p"""),
    "decided": (("routed",), """
        SELECT *, CASE WHEN rule IS NOT NULL THEN 'HARD_RULE' WHEN low_confidence OR new_sender OR near_boundary
                       THEN 'LLM' ELSE 'MODEL' END AS route_used,
               concat_ws(',', CASE WHEN low_confidence THEN 'LOW_MODEL_CONFIDENCE' END,
                         CASE WHEN new_sender THEN 'NEW_SENDER_UNCERTAINTY' END,
                         CASE WHEN near_boundary THEN 'NEAR_TIER_BOUNDARY' END) AS routing_reasons,
               CASE decision WHEN 'ALLOW' THEN 0 WHEN 'WARN' THEN 1 WHEN 'QUARANTINE' THEN 2 ELSE 3 END AS severity
        FROM routed"""),
    "fb": (("ev",), """
        SELECT event_id AS feedback_id, user_id AS email_id, k AS persona_id, strftime(ts, '%Y-%m-%d') AS run_id,
               CASE event_type WHEN 'error' THEN 'REPORT' WHEN 'purchase' THEN 'RESCUE' WHEN 'view' THEN 'IGNORE'
                               ELSE 'CLICK' END AS action,
               least(value / 100.0, 1.0) AS action_confidence,
               CASE WHEN k < 40 THEN 'ham' WHEN k < 70 THEN 'spam' ELSE 'phish' END AS ground_truth
        FROM ev"""),
    "weighted": (("fb", "keyed"), """
        SELECT f.*, sender_key, bucket, CASE WHEN action = 'REPORT' THEN 'BAD' ELSE 'GOOD' END AS signal,
               CASE WHEN persona_id >= 85 THEN 0.1e0 ELSE 1.0e0 END AS trust,
               CASE WHEN persona_id >= 85 THEN 0.1e0 ELSE 1.0e0 END * action_confidence AS weight
        FROM fb f JOIN keyed USING (email_id) WHERE action <> 'IGNORE'"""),
    "groups": (("weighted",), """
        SELECT run_id, sender_key, signal, bucket, count(DISTINCT persona_id) AS corroborators,
               sum(weight) AS aggregate_weight, count(*) AS signals,
               count(DISTINCT persona_id) >= 3 AND round(sum(weight), 9) >= 1.5 AS trusted
        FROM weighted GROUP BY ALL"""),
    "variants": ((), """
        SELECT strftime(o_orderdate, '%Y-%m') AS run_id, o_orderkey AS variant_id, o_custkey AS seed_email_id,
               CASE o_orderstatus WHEN 'F' THEN 'ham' WHEN 'O' THEN 'spam' ELSE 'phish' END AS label,
               o_totalprice > 250000 AS defender_delivered, lower(split_part(o_orderpriority, '-', 2)) AS strategy,
               CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS generation,
               least(o_totalprice / 500000.0, 1.0) AS posterior, o_orderdate AS created_at
        FROM orders"""),
}
