"""Whole pipelines, and streaming jobs run to completion over the event table."""

from __future__ import annotations

import uuid

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from mailsift.functions.hashing import content_hash
from mailsift.functions.numeric import raw_malicious
from mailsift.operators import calibration, decision, features, reputation, similarity, training, windows
from mailsift.plans import roles as R
from mailsift.plans.common import R6, r6
from mailsift.operators.scoring import Policy
from mailsift.plans.policy_queries import (
    BRANDS, _AUTHORITY_HOST, _BAD, _CLAMP, _METRICS, _RATES, _SPOOF, _denylist, _golden, _linked_messages, _logit_sql,
)
from mailsift.plans.registry import query
from mailsift.plans.sender_queries import _GATED
from mailsift.plans.similarity_queries import _PRINTS
from mailsift.plans.text_queries import _VECTORS
from mailsift.plans.training_queries import _examples
from mailsift.session import cut_lineage, ensure_checkpoint_dir
from mailsift.sources import events as event_source
from mailsift.streaming import jobs, velocity

c = F.col
#: Parts of the key ledgers here; the tables are small, and every part is a file per batch.
PARTS = 8


def _bursts(messages):
    """What each message's sender sent, and what was close to it, in the day before."""
    sent = messages.select("email_id", F.coalesce("sender", "sender_domain").alias("sender"), "ingested_at")
    velocity = windows.trailing_sender_counts(sent, "sender", "email_id", "ingested_at", 86_400_000)
    prints = similarity.fingerprints(messages, "body_display", keep=("ingested_at",))
    copies = similarity.recent_near_duplicates(prints, "ingested_at", 86_400_000)
    return velocity.join(copies, "email_id").select("email_id", "sender_count", c("cluster_size").alias("duplicate_count"))


@query("decisions")
def decisions(spark, folder):
    """Every message decided: rules, trained model, calibration, sender standing, fusion, bursts, floor. No SQL twin: a model is trained."""
    messages = _linked_messages(spark, folder)
    vectors = cut_lineage(features.with_vector(features.extract_features(messages)).select("email_id", "feature_vector", "feature_version"))
    examples, _ = training.join_features(_examples(spark, folder), vectors)
    split = cut_lineage(windows.stratified_split(examples, "label", "email_id"))
    train = split.filter("split_side = 'train'").drop("split_side")
    model = training.fit_classifier(train)
    rate = training.base_rate(train).first()[0]
    held_out = split.filter("split_side = 'eval'").drop("split_side")
    scored = training.score_classes(model, held_out).withColumn("positive", c("label") != "ham")
    fitted = calibration.fit_isotonic(scored, "raw_malicious", "positive")
    keys = R.keyed_messages(spark, folder).select(c("email_id").alias("event_id"), "sender_key")
    log = R.as_reputation_events(R.events(spark, folder), keep=("event_id",)).drop("sender_key").join(keys, "event_id")
    standing = reputation.gated_reputation(log, R.READ_AT)
    rated = decision.score_messages(
        messages, _denylist(spark), decision.classifier(model),
        lambda df: calibration.apply_isotonic(fitted, df, "raw_malicious"), standing, rate, BRANDS,
    )
    decided = decision.decide(rated, R.LIVE, _bursts(messages))
    return decided.select(
        "email_id", "decision", "route_used", F.concat_ws(",", "reason_codes").alias("reasons"),
        F.concat_ws(",", "routing_reasons").alias("routing"), F.round("posterior", 3).alias("posterior"), "explanation",
    )


# A given model: per class its bias and the weights of some features, and given calibration points.
_BASE_RATE = 0.4
_WEIGHTS = {"spam": (-1.5, {14: 3.0, 15: 0.05, 21: -1.0}), "phish": (-2.0, {6: 2.0, 23: -1.2})}
_POINTS = ((0.0, 0.02), (0.3, 0.2), (0.7, 0.75), (1.0, 0.98))


def _given_classifier(df):
    f = vector_to_array("feature_vector")
    lines = {name: sum((f[i] * F.lit(w) for i, w in weights.items()), F.lit(bias)) for name, (bias, weights) in _WEIGHTS.items()}
    total = F.lit(1.0) + F.exp(lines["spam"]) + F.exp(lines["phish"])
    scored = df.withColumns({"spam_score": F.exp(lines["spam"]) / total, "phishing_score": F.exp(lines["phish"]) / total})
    return scored.withColumn("raw_malicious", raw_malicious(c("spam_score"), c("phishing_score")))


def _line_sql(name: str) -> str:
    bias, weights = _WEIGHTS[name]
    return " + ".join([f"({bias}e0)", *(f"({w}e0) * CAST(CAST(f[{i + 1}] AS FLOAT) AS DOUBLE)" for i, w in weights.items())])


def _points_sql(raw: str) -> str:
    cases = " ".join(
        f"WHEN {raw} <= {x1}e0 THEN {y0}e0 + ({raw} - {x0}e0) * {(y1 - y0) / (x1 - x0)!r}::DOUBLE"
        for (x0, y0), (x1, y1) in zip(_POINTS, _POINTS[1:])
    )
    return f"CASE WHEN {raw} <= {_POINTS[0][0]}e0 THEN {_POINTS[0][1]}e0 {cases} ELSE {_POINTS[-1][1]}e0 END"


@query("decision_chain", f"""
    WITH rep AS (SELECT keyed.sender_key, CASE WHEN event_type = 'error' THEN 'BAD' ELSE 'GOOD' END AS signal, least(value / 500.0, 1.0) AS weight,
                        CASE WHEN k % 2 = 0 THEN 'AUTHENTICATED' ELSE 'UNAUTHENTICATED' END AS bucket, ts AS occurred_at
                 FROM ev JOIN keyed ON email_id = event_id WHERE event_type <> 'view'),
    {_GATED}, {_VECTORS}, {_PRINTS},
    linked AS (SELECT email_id, sender, sender_domain, epoch_us(ingested_at) // 1000 AS ms,
                      coalesce(auth_results LIKE '%dmarc=pass%', FALSE) AS aligned, coalesce({_AUTHORITY_HOST.format('url')}, '') AS host
               FROM messages LEFT JOIN pages ON email_id = page_id),
    hit AS (SELECT *, ({_BAD}) AS bad, {_SPOOF} AS spoof FROM linked),
    ruled AS (SELECT email_id, sender, sender_domain, ms, CASE WHEN bad THEN 'BLOCK' WHEN spoof THEN 'QUARANTINE' END AS rule,
                     concat_ws(',', CASE WHEN bad THEN 'KNOWN_BAD_URL' END, CASE WHEN spoof THEN 'MALFORMED_AUTH_BRAND_SPOOF' END) AS reasons FROM hit),
    lines AS (SELECT email_id, exp({_line_sql('spam')}) AS es, exp({_line_sql('phish')}) AS ep FROM v),
    confident AS (SELECT email_id, {_points_sql('least(1e0, (es + ep) / (1e0 + es + ep))')} AS confidence FROM lines),
    standing AS (SELECT email_id, coalesce(CASE WHEN bucket = 'AUTHENTICATED' THEN auth_mean ELSE unauth_mean END, 0.5e0) AS mean,
                        coalesce(CASE WHEN bucket = 'AUTHENTICATED' THEN auth_variance ELSE unauth_variance END, 1 / 12.0e0) AS variance
                 FROM keyed LEFT JOIN gated USING (sender_key)),
    logits AS (SELECT *, {_logit_sql('(1.0e0 - mean)')} + {_logit_sql('confidence')} - {_logit_sql(f'{_BASE_RATE}e0')} AS z,
                      {_CLAMP.format('(1.0e0 - mean)')} AS prior FROM standing JOIN confident USING (email_id)),
    fused AS (SELECT email_id, confidence, sqrt(variance) AS uncertainty, 1e0 / (1e0 + exp(-z)) AS posterior,
                     posterior * (1e0 - posterior) * sqrt(variance) / (prior * (1e0 - prior)) AS band FROM logits),
    routed AS (SELECT r.*, CASE WHEN rule IS NULL THEN posterior END AS posterior,
                      rule IS NULL AND 2e0 * abs(confidence - 0.5e0) < 0.4e0 AS low, rule IS NULL AND uncertainty >= 0.05e0 AS fresh,
                      rule IS NULL AND least(abs(f.posterior - 0.5e0), abs(f.posterior - 0.8e0), abs(f.posterior - 0.95e0)) <= 0.05e0 + band AS near,
                      CASE coalesce(rule, CASE WHEN f.posterior >= 0.95e0 THEN 'BLOCK' WHEN f.posterior >= 0.8e0 THEN 'QUARANTINE'
                           WHEN f.posterior >= 0.5e0 THEN 'WARN' ELSE 'ALLOW' END) WHEN 'ALLOW' THEN 0 WHEN 'WARN' THEN 1 WHEN 'QUARANTINE' THEN 2 ELSE 3 END AS sev
               FROM ruled r JOIN fused f USING (email_id)),
    sent AS (SELECT a.email_id, count(*) AS sender_count FROM ruled a JOIN ruled b ON coalesce(a.sender, a.sender_domain) = coalesce(b.sender, b.sender_domain)
                    AND b.ms <= a.ms AND a.ms - b.ms < 86400000 GROUP BY a.email_id),
    heard AS (SELECT email_id, fp, ms FROM ruled JOIN prints ON doc_id = email_id WHERE fp <> 0),
    alike AS (SELECT a.email_id, count(*) AS duplicate_count FROM heard a JOIN heard b ON b.ms <= a.ms AND a.ms - b.ms < 86400000
                     AND bit_count(CAST(xor(a.fp, b.fp) AS BIT)) <= 6 GROUP BY a.email_id),
    burst AS (SELECT *, (coalesce(sender_count, 0) > 5 OR coalesce(duplicate_count, 0) > 5) AND sev < 2 AS raised
              FROM routed LEFT JOIN sent USING (email_id) LEFT JOIN alike USING (email_id))
    SELECT email_id, CASE CASE WHEN raised THEN 2 ELSE sev END WHEN 0 THEN 'ALLOW' WHEN 1 THEN 'WARN' WHEN 2 THEN 'QUARANTINE' ELSE 'BLOCK' END AS decision,
           CASE WHEN rule IS NOT NULL THEN 'HARD_RULE' WHEN low OR fresh OR near THEN 'LLM' ELSE 'MODEL' END AS route_used,
           concat_ws(',', nullif(reasons, ''), CASE WHEN raised THEN 'BURST_OVERRIDE' END) AS reasons,
           concat_ws(',', CASE WHEN low THEN 'LOW_MODEL_CONFIDENCE' END, CASE WHEN fresh THEN 'NEW_SENDER_UNCERTAINTY' END,
                     CASE WHEN near THEN 'NEAR_TIER_BOUNDARY' END) AS routing, {r6('posterior')} AS posterior FROM burst""",
       ("messages", "keyed", "ev"))
def decision_chain(spark, folder):
    """Every message decided under a given model and given calibration points: rules, softmax, interpolation, standing, fusion, bursts, floor."""
    messages = _linked_messages(spark, folder)
    keys = R.keyed_messages(spark, folder).select(c("email_id").alias("event_id"), "sender_key")
    log = R.as_reputation_events(R.events(spark, folder), keep=("event_id",)).drop("sender_key").join(keys, "event_id")
    rated = decision.score_messages(
        messages, _denylist(spark), _given_classifier,
        lambda df: df.withColumn("calibrated_confidence", calibration.interpolated(c("raw_malicious"), _POINTS)),
        reputation.gated_reputation(log, R.READ_AT), _BASE_RATE, BRANDS,
    )
    decided = decision.decide(rated, Policy("given", burst=5), _bursts(messages))
    return decided.select(
        "email_id", "decision", "route_used", F.concat_ws(",", "reason_codes").alias("reasons"),
        F.concat_ws(",", "routing_reasons").alias("routing"), R6(c("posterior")).alias("posterior"),
    )


@query("quality_report", "WITH " + _METRICS.format(where="WHERE ts < TIMESTAMP '2024-01-16 00:00:00'") + """
    SELECT m.policy_version, m.total, coalesce(m.total >= 50 AND m."precision" >= 0.95, FALSE) AS passed, """
       + ", ".join(f'{r6(f"m.{chr(34)}{n}{chr(34)} - b.{chr(34)}{n}{chr(34)}")} AS {n}_delta' for n in _RATES)
       + " FROM metrics m JOIN metrics b ON b.policy_version = 'live'", ("decided", "truth"))
def quality_report(spark, folder):
    report = decision.quality_report(
        R.scored(spark, folder), R.truth(spark, folder), [R.LIVE, R.STRICT], "live", _golden(spark, folder), "golden-1"
    )
    return report.select("policy_version", "total", "passed", *[R6(c(f"{n}_delta")).alias(f"{n}_delta") for n in _RATES])


def _workspace(spark) -> str:
    return f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"


def _appended(spark, stream, sink=None):
    """Runs a stream to its end and reads what it stored."""
    folder = _workspace(spark)
    jobs.run_available(stream, f"{folder}/progress", (sink or jobs.append_batches)(f"{folder}/out"))
    return spark.read.parquet(f"{folder}/out")


def _updated(spark, stream, keys, version):
    """Runs a windowed stream in update mode and reads the newest row of every key, open windows included."""
    folder = _workspace(spark)
    jobs.run_available(stream, f"{folder}/progress", jobs.upsert_batches(f"{folder}/out", keys, version), mode="update")
    return spark.read.parquet(f"{folder}/out")


@query("stream_once_per_message", "SELECT DISTINCT user_id, event_type FROM events")
def stream_once_per_message(spark, folder):
    """Deliveries of (user, type) messages; only the first of each passes."""
    stream = jobs.once_per_message(R.event_stream(spark, folder), "ts", ["user_id", "event_type"], "60 days")
    return _appended(spark, stream).select("user_id", "event_type")


@query("stream_ledger", "SELECT user_id, min(event_id) AS event_id FROM events GROUP BY user_id")
def stream_ledger(spark, folder):
    """Unbounded duplicate horizon: a key ledger, of which a batch reads the parts it can meet."""
    stream = R.event_stream(spark, folder).select("user_id", "event_id")
    return _appended(spark, stream, lambda path: jobs.insert_absent_batches(path, ["user_id"], ["event_id"], PARTS)).drop("part")


@query("stream_features", """
    SELECT doc_id AS email_id, length(text) AS char_count, len(regexp_extract_all(text, '!')) AS exclamations FROM documents""")
def stream_features(spark, folder):
    """Events announce messages; their features are extracted and the newest row per message kept."""
    announced = R.event_stream(spark, folder).select(c("event_id").alias("email_id"), c("ts").alias("arrived_at"))
    stream = jobs.feature_stream(announced, R.messages(spark, folder))
    stored = _appended(spark, stream, lambda path: jobs.upsert_batches(path, ["email_id", "feature_version"], ["arrived_at"]))
    return stored.select(
        "email_id", c("features.text.charCount").cast("bigint").alias("char_count"),
        c("features.text.exclamationCount").cast("bigint").alias("exclamations"),
    )


@query("stream_embeddings", """
    SELECT doc_id AS email_id, CAST(least(128, (SELECT count(DISTINCT text) FROM documents WHERE trim(text) <> '')) AS INTEGER) AS dimension, 1e0 AS length FROM documents JOIN events ON doc_id = event_id""")
def stream_embeddings(spark, folder):
    """Unit vectors of announced messages under an encoder fitted beforehand."""
    texts = R.messages(spark, folder).select("email_id", c("body_display").alias("text"))
    encoder = training.fit_encoder(training.hashed_vectors(texts, "text"), rows=R.table(spark, folder, "documents").count())
    announced = R.event_stream(spark, folder).select(c("event_id").alias("email_id"))
    stream = jobs.embedding_stream(
        announced, R.messages(spark, folder), lambda df: training.encode(training.hashed_vectors(df, "text"), encoder)
    )
    length = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda total, x: total + x * x))
    with training.batches_of(spark):
        stored = _appended(spark, stream)
    return stored.select("email_id", F.size("embedding").alias("dimension"), R6(length).alias("length"))


_OWN = """own AS (SELECT *, max(epoch_us(occurred_at)) OVER (PARTITION BY sender_key) AS last FROM rep)"""


@query("stream_reputation", f"""
    WITH {_OWN} SELECT sender_key, {', '.join(
        f"{r6(f'''coalesce(sum(weight * power(0.5e0, (last - epoch_us(occurred_at)) / 1e6 / 604800.0e0)) FILTER (bucket = '{b}' AND signal = '{s}'), 0)''')} AS {n}"
        for b, s, n in (("AUTHENTICATED", "GOOD", "auth_good"), ("AUTHENTICATED", "BAD", "auth_bad"),
                        ("UNAUTHENTICATED", "GOOD", "unauth_good"), ("UNAUTHENTICATED", "BAD", "unauth_bad")))}
    FROM own GROUP BY sender_key""", ("rep",))
def stream_reputation(spark, folder):
    """Keyed accrual, every signal claimed once: each sender's counts decayed to its own last event."""
    arrivals = R.event_stream(spark, folder)
    ids = arrivals.withColumn("claim", c("event_id"))
    signals = R.as_reputation_events(ids, keep=("claim",))
    out = _workspace(spark)
    jobs.run_available(signals, f"{out}/progress", jobs.accrual_batches(f"{out}/sums", f"{out}/claims", ["claim"], parts=PARTS))
    return jobs.accrued(spark.read.parquet(f"{out}/sums")).select("sender_key", *[R6(c(n)).alias(n) for n in reputation.COUNTS])


@query("stream_sender_velocity", """
    WITH w AS (SELECT user_id, epoch_us(ts) AS us, unnest(range(6)) AS i FROM events)
    SELECT user_id, (us // 3600000000 - i) * 3600000 + 21600000 AS window_end_ms, count(*) AS sender_count FROM w GROUP BY 1, 2""")
def stream_sender_velocity(spark, folder):
    """Six-hour windows sliding by an hour."""
    stream = jobs.sender_velocity(R.event_stream(spark, folder), "ts", "user_id", "6 hours", "1 hour", "1 hour")
    stored = _updated(spark, stream, ["window_end", "user_id"], ["sender_count"])
    return stored.select("user_id", F.unix_millis("window_end").alias("window_end_ms"), "sender_count")


@query("stream_message_velocity", """
    SELECT CAST(event_id AS VARCHAR) AS message, CAST(user_id AS VARCHAR) AS sender,
           count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000 RANGE BETWEEN 21599999 PRECEDING AND CURRENT ROW) AS sender_count FROM events""")
def stream_message_velocity(spark, folder):
    """Messages of the same sender in the six hours up to each message, from keyed state inside the stream."""
    name, provider = velocity.PROVIDER
    before = spark.conf.get(name)
    spark.conf.set(name, provider)
    try:
        counted = velocity.trailing_counts(R.event_stream(spark, folder), "ts", "user_id", "event_id", 21_600_000, "1 hour")
        out = _workspace(spark)
        jobs.run_available(counted, f"{out}/progress", velocity.largest_counts(f"{out}/out"), mode="update")
    finally:
        spark.conf.set(name, before)
    return spark.read.parquet(f"{out}/out").select("message", "sender", "sender_count")


@query("stream_near_duplicates", f"""
    WITH {_PRINTS}, p AS (SELECT doc_id, fp, epoch_us(ts) // 1000 AS ms FROM prints JOIN events ON doc_id = event_id),
    seen AS (SELECT * FROM p WHERE fp <> 0)
    SELECT p.doc_id AS email_id, CASE WHEN p.fp = 0 THEN 0 ELSE 1 + coalesce(n, 0) END AS cluster_size FROM p LEFT JOIN (
        SELECT a.doc_id, count(*) AS n FROM seen a JOIN seen b ON b.doc_id <> a.doc_id AND b.ms <= a.ms AND a.ms - b.ms < 86400000
               AND bit_count(CAST(xor(a.fp, b.fp) AS BIT)) <= 6 GROUP BY a.doc_id) USING (doc_id)""")
def stream_near_duplicates(spark, folder):
    arrivals = R.event_stream(spark, folder).select(c("event_id").alias("email_id"), "ts")
    texts = R.table(spark, folder, "documents").select(c("doc_id").alias("email_id"), "text")
    return _appended(
        spark, arrivals.join(texts, "email_id"),
        lambda path: jobs.near_duplicate_batches(path, f"{path}-state", "ts", "text", 86_400_000),
    ).select("email_id", "cluster_size")


@query("stream_replay", "SELECT email_id, policy_version, decision, route_used FROM decided", ("decided",))
def stream_replay(spark, folder):
    """Replay requests scored under both policies; the first result of a message and policy is kept."""
    asked = R.event_stream(spark, folder).select(F.lit("run-1").alias("run_id"), c("event_id").alias("email_id"))
    stream = jobs.replay_scoring(asked, R.scored(spark, folder), [R.LIVE, R.STRICT])
    kept = stream.select("run_id", "email_id", "policy_version", "decision", "route_used", "posterior")
    keys = ["run_id", "email_id", "policy_version"]
    stored = _appended(spark, kept, lambda path: jobs.insert_absent_batches(path, keys, ["posterior"], PARTS))
    return stored.select("email_id", "policy_version", "decision", "route_used")


@query("stream_shadow", """
    SELECT l.email_id, l.decision AS live_decision, CASE WHEN s.severity = l.severity THEN 'SAME' WHEN s.severity > l.severity
           THEN 'SHADOW_MORE_SEVERE' ELSE 'SHADOW_LESS_SEVERE' END AS direction
    FROM decided l JOIN decided s ON l.email_id = s.email_id AND l.policy_version = 'live' AND s.policy_version = 'strict'""", ("decided",))
def stream_shadow(spark, folder):
    """Live decisions with the shadow comparison stored beside them."""
    out = _workspace(spark)
    stream = R.as_scored(R.event_stream(spark, folder)).drop("ts", "user_id", "latency_ms", "cost_usd")
    sink = jobs.score_with_shadow(f"{out}/live", f"{out}/shadow", R.LIVE, R.STRICT)
    jobs.run_available(stream, f"{out}/progress", sink)
    live = spark.read.parquet(f"{out}/live").select("email_id", c("decision").alias("live_decision"))
    return live.join(spark.read.parquet(f"{out}/shadow").select("email_id", "direction"), "email_id")


@query("stream_counters", f"SELECT event_type, count(*) AS n, {r6('CAST(sum(cost_usd) AS DOUBLE)')} AS cost_usd FROM scored GROUP BY event_type", ("scored",))
def stream_counters(spark, folder):
    """Running totals in complete mode."""
    cost = F.round(c("value").cast("decimal(20,6)") / 10000, 6).cast("decimal(12,6)")
    counted = jobs.live_counters(R.event_stream(spark, folder).withColumn("cost_usd", cost), "event_type")
    out = _workspace(spark)
    jobs.run_available(counted, f"{out}/progress", jobs.overwrite_batches(f"{out}/out"), mode="complete")
    return spark.read.parquet(f"{out}/out").withColumn("cost_usd", R6(c("cost_usd").cast("double")))


@query("stream_rates", """
    SELECT event_type, epoch_us(ts) // 3600000000 * 3600000 AS interval_ms, count(*) AS n FROM events GROUP BY 1, 2""")
def stream_rates(spark, folder):
    stream = jobs.rate_series(R.event_stream(spark, folder), "ts", "event_type", "1 hour", "1 minute")
    stored = _updated(spark, stream, ["interval_start", "event_type"], ["n"])
    return stored.select("event_type", F.unix_millis("interval_start").alias("interval_ms"), "n")


@query("stream_spend", f"""
    WITH days AS (SELECT strftime(ts, '%Y-%m-%d') AS day, strftime(ts, '%Y-%m') AS month, sum(cost_usd) AS cost FROM scored GROUP BY 1, 2)
    SELECT day, month, {r6('CAST(cost AS DOUBLE)')} AS cost_usd, {r6('CAST(sum(cost) OVER (PARTITION BY month) AS DOUBLE)')} AS month_cost_usd
    FROM days""", ("scored",))
def stream_spend(spark, folder):
    cost = F.round(c("value").cast("decimal(20,6)") / 10000, 6).cast("decimal(12,6)")
    stream = jobs.spend_series(R.event_stream(spark, folder).withColumn("cost_usd", cost), "ts", "1 hour")
    days = jobs.with_month_total(_updated(spark, stream, ["day"], ["calls"]))
    return days.select(
        F.date_format("day", "yyyy-MM-dd").alias("day"), "month",
        *[R6(c(n).cast("double")).alias(n) for n in ("cost_usd", "month_cost_usd")],
    )


@query("stream_resolution", """
    SELECT event_id AS email_id, CASE WHEN k <= 30 THEN CASE k % 3 WHEN 0 THEN 'ALLOW' WHEN 1 THEN 'QUARANTINE' ELSE 'BLOCK' END ELSE 'QUARANTINE' END AS resolved_tier,
           CASE WHEN k > 30 THEN 'DEGRADED' WHEN k % 3 = 0 THEN 'PROMOTED' ELSE 'CONFIRMED' END AS resolution_state
    FROM ev""", ("ev",))
def stream_resolution(spark, folder):
    """Every event is pending; those with k below 60 get a verdict k seconds later, in time only up to 30."""
    asked = [
        c("event_id").alias("email_id"), c("ts").alias("pending_at"), F.lit("QUARANTINE").alias("fast_tier"),
        F.lit(None).cast("string").alias("hard_rule_decision"),
    ]
    pending = R.event_stream(spark, folder).select(*asked)
    names = F.array(F.lit("LEGITIMATE"), F.lit("SPAM"), F.lit("PHISHING"))
    answered = R.event_stream(spark, folder).filter("k < 60").select(
        c("event_id").alias("email_id"), F.get(names, c("k") % 3).alias("verdict"),
        (c("ts") + F.make_dt_interval(secs=c("k").cast("decimal(18,6)"))).alias("verdict_at"),
    )
    resolved = _appended(spark, jobs.resolutions(pending, answered)).select("email_id", "resolved_tier", "resolution_state")
    stored = R.events(spark, folder).select(*asked)
    end = stored.agg(F.max("pending_at")).scalar() + F.expr("interval 1 hour")
    return resolved.unionByName(jobs.overdue(stored, resolved, end).select(*resolved.columns))


@query("stream_poison", """
    SELECT k % 10 = 0 AS poison, count(*) AS n, CAST(coalesce(sum(k) FILTER (k % 10 <> 0), 0) AS BIGINT) AS k_sum FROM ev GROUP BY 1""", ("ev",))
def stream_poison(spark, folder):
    """Event properties as lines, every tenth of them cut off."""
    out = _workspace(spark)
    schema = R.table(spark, folder, "events").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder)
    cut = R.prop_k() % 10 == 0
    lines = raw.select(F.when(cut, F.substring("props", 1, 4)).otherwise(c("props")).alias("value"))
    decoded = event_source.decode(lines, StructType.fromDDL("k int"))
    jobs.run_available(decoded, f"{out}/progress", jobs.divert_poison(f"{out}/good", f"{out}/poison"))
    good = spark.read.parquet(f"{out}/good").agg(F.lit(False).alias("poison"), F.count("*").alias("n"), F.sum("k").alias("k_sum"))
    bad = spark.read.parquet(f"{out}/poison").agg(F.lit(True).alias("poison"), F.count("*").alias("n"), F.lit(0).cast("bigint").alias("k_sum"))
    return good.unionByName(bad)


@query("stream_cards", """
    SELECT user_id AS email_id, max_by(event_type, {'t': ts, 'e': event_id}) AS tier, count(*) > 1 AS resolved FROM events GROUP BY user_id""")
def stream_cards(spark, folder):
    """The live feed stored once per classification and folded to cards."""
    feed = R.event_stream(spark, folder).select(
        c("user_id").alias("email_id"), c("event_id").alias("classification_id"), c("ts").alias("at"),
        c("event_type").alias("tier"), F.lit("model").alias("route_used"),
    )
    log = _appended(spark, feed, lambda path: jobs.decision_log(path, PARTS)).drop("part")
    return windows.decision_cards(log, "email_id", "classification_id", "at", cap=None).select("email_id", "tier", "resolved")


@query("stream_raw_events", "SELECT doc_id AS email_id, sha256(text) AS content_hash FROM documents")
def stream_raw_events(spark, folder):
    """Published events of stored messages, encoded as keyed JSON lines and decoded again."""
    from mailsift import schemas
    from mailsift.operators.lookups import raw_events

    arrivals = R.event_stream(spark, folder).select(c("event_id").alias("email_id"))
    stored = R.messages(spark, folder).withColumn("content_hash", content_hash(c("body_raw")))
    lines = event_source.encode(raw_events(arrivals.join(stored, "email_id")))
    back = event_source.good_records(event_source.decode(lines, schemas.schema("raw_email_event")))
    return _appended(spark, back).select(c("emailId").cast("bigint").alias("email_id"), c("contentHashHex").alias("content_hash"))
