"""Queries over rules, scores, policies, shadow runs and live reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from mailsift import vocabulary as V
from mailsift.functions import numeric, tiers, verdicts
from mailsift.operators import lookups, metrics, quality, rules, scoring
from mailsift.plans import roles as R
from mailsift.plans.common import R6, millis, r6
from mailsift.plans.registry import query

c = F.col
DENYLIST = ("adult-x.example.net", "ads-track.example.org", "th.example.com")
BRANDS = (("src1", "src1.example"), ("src5", "src5.example"))

_AUTHORITY_HOST = "lower(regexp_extract(regexp_replace(regexp_extract({0}, '(?i)^https?://([^/\\s\"''>)\\]]+)', 1), '^.*@', ''), '^[^:]*'))"
_BAD = " OR ".join(f"host = '{d}' OR ends_with(host, '.{d}')" for d in DENYLIST)


def _denylist(spark):
    return spark.range(1).select(F.explode(F.array(*[F.lit(h) for h in DENYLIST])).alias("host"))


@query("denylist_hits", f"""
    WITH found AS (SELECT page_id, unnest(regexp_extract_all(concat_ws(' ', url, html), '(?i)https?://([^/\\s"''>)\\]]+)', 1)) AS authority FROM pages),
    hosts AS (SELECT page_id, lower(regexp_extract(regexp_replace(authority, '^.*@', ''), '^[^:]*')) AS host FROM found)
    SELECT page_id AS email_id, coalesce(bool_or({_BAD}), FALSE) AS links_to_denylist FROM pages LEFT JOIN hosts USING (page_id) GROUP BY page_id""")
def denylist_hits(spark, folder):
    pages = R.table(spark, folder, "pages").select(c("page_id").alias("email_id"), F.concat_ws(" ", "url", "html").alias("body_raw"))
    return rules.with_denylist_flag(pages, _denylist(spark)).select("email_id", "links_to_denylist")


_SPOOF = """(sender_domain LIKE '%src1%' AND NOT (sender_domain = 'src1.example' AND aligned)
             OR sender_domain LIKE '%src5%' AND NOT (sender_domain = 'src5.example' AND aligned))"""


@query("brand_spoofs", f"""
    SELECT email_id, {_SPOOF} AS spoofs FROM (SELECT *, coalesce(auth_results LIKE '%dmarc=pass%', FALSE) AS aligned FROM messages)""",
       ("messages",))
def brand_spoofs(spark, folder):
    return R.messages(spark, folder).select(
        "email_id", rules.spoofs_brand(c("sender_domain"), c("auth_results"), BRANDS).alias("spoofs")
    )


def _linked_messages(spark, folder):
    pages = R.table(spark, folder, "pages").select(c("page_id").alias("email_id"), "url")
    return R.messages(spark, folder).join(pages, "email_id", "left").withColumn(
        "body_raw", F.concat_ws(" ", "body_raw", "url")
    ).drop("url")


def _short_message_rule():
    return rules.match(F.length("body_display") < 100, "WARN", "UNSOLICITED_BULK")


@query("hard_rules", f"""
    WITH m AS (SELECT email_id, sender_domain, body, coalesce(auth_results LIKE '%dmarc=pass%', FALSE) AS aligned,
                      coalesce({_AUTHORITY_HOST.format('url')}, '') AS host FROM messages LEFT JOIN pages ON email_id = page_id),
    hit AS (SELECT email_id, ({_BAD}) AS bad, {_SPOOF} AS spoof, length(body) < 100 AS short FROM m)
    SELECT email_id, CASE WHEN bad THEN 'BLOCK' WHEN spoof THEN 'QUARANTINE' WHEN short THEN 'WARN' END AS hard_rule_decision,
           concat_ws(',', CASE WHEN bad THEN 'KNOWN_BAD_URL' END, CASE WHEN spoof THEN 'MALFORMED_AUTH_BRAND_SPOOF' END,
                     CASE WHEN short THEN 'UNSOLICITED_BULK' END) AS reasons FROM hit""", ("messages",))
def hard_rules(spark, folder):
    """The two default rules and one registered by the caller."""
    flagged = rules.with_denylist_flag(_linked_messages(spark, folder), _denylist(spark))
    ruled = rules.apply_rules(flagged, [*rules.default_rules(BRANDS), _short_message_rule])
    return ruled.select("email_id", "hard_rule_decision", F.concat_ws(",", "rule_reasons").alias("reasons"))


def _decided(spark, folder):
    return scoring.score_policies(R.scored(spark, folder), [R.LIVE, R.STRICT])


@query("policy_tiers", """
    SELECT email_id, policy_version, decision, route_used FROM decided""", ("decided",))
def policy_tiers(spark, folder):
    return _decided(spark, folder).select("email_id", "policy_version", "decision", "route_used")


@query("slow_path_routing", """
    SELECT email_id, policy_version, CASE WHEN rule IS NOT NULL THEN '' ELSE routing_reasons END AS reasons FROM decided
    WHERE route_used = 'LLM'""", ("decided",))
def slow_path_routing(spark, folder):
    routed = _decided(spark, folder).filter("route_used = 'LLM'")
    return routed.select("email_id", "policy_version", F.concat_ws(",", "routing_reasons").alias("reasons"))


_PAIRED = """paired AS (SELECT l.email_id, l.decision AS active_decision, s.decision AS shadow_decision, l.severity AS ls, s.severity AS ss
    FROM decided l JOIN decided s ON l.email_id = s.email_id AND l.policy_version = 'live' AND s.policy_version = 'strict')"""


@query("shadow_decisions", f"""
    WITH {_PAIRED} SELECT email_id, active_decision, shadow_decision, CASE WHEN ls = ss THEN 'AGREE' ELSE 'DISAGREE' END AS agreement,
           CASE WHEN ss > ls THEN 'SHADOW_MORE_SEVERE' WHEN ss < ls THEN 'SHADOW_LESS_SEVERE' ELSE 'SAME' END AS direction FROM paired""",
       ("decided",))
def shadow_decisions(spark, folder):
    return scoring.shadow_decisions(R.scored(spark, folder), R.LIVE, R.STRICT).select(
        "email_id", "active_decision", "shadow_decision", "agreement", "direction"
    )


@query("shadow_agreement", f"""
    WITH {_PAIRED} SELECT 'live' AS active_version, 'strict' AS shadow_version, count(*) AS total, count_if(ls = ss)::BIGINT AS agree,
           count_if(ls <> ss)::BIGINT AS disagree, count_if(ss > ls)::BIGINT AS more_severe, count_if(ss < ls)::BIGINT AS less_severe,
           {r6('count_if(ls = ss) / count(*)')} AS agreement_rate FROM paired""", ("decided",))
def shadow_agreement(spark, folder):
    stats = metrics.agreement_stats(scoring.shadow_decisions(R.scored(spark, folder), R.LIVE, R.STRICT))
    return stats.withColumn("agreement_rate", R6(c("agreement_rate")))


def _labelled(spark, folder):
    judged = metrics.labelled_decisions(R.scored(spark, folder), R.truth(spark, folder))
    return scoring.score_policies(judged, [R.LIVE, R.STRICT])


_METRICS = """metrics AS (
    SELECT policy_version, count(*) AS total, count_if(label <> 'ham')::BIGINT AS abuse_total, count_if(label = 'ham')::BIGINT AS ham_total,
           count_if(label <> 'ham' AND severity >= 2)::BIGINT AS true_positives,
           count_if(label = 'ham' AND severity >= 2)::BIGINT AS false_positives,
           count_if(label <> 'ham' AND severity < 2)::BIGINT AS false_negatives, count_if(route_used = 'LLM')::BIGINT AS escalations,
           coalesce(count_if(label <> 'ham' AND severity >= 2) / nullif(count_if(severity >= 2), 0), 0) AS "precision",
           coalesce(count_if(label <> 'ham' AND severity >= 2) / nullif(count_if(label <> 'ham'), 0), 0) AS recall,
           coalesce(count_if(label <> 'ham' AND severity < 2) / nullif(count_if(label <> 'ham'), 0), 0) AS bypass_rate,
           count_if(route_used = 'LLM') / count(*) AS escalation_rate,
           sum(CASE route_used WHEN 'HARD_RULE' THEN 1 WHEN 'MODEL' THEN 20 ELSE 900 END) / count(*) AS mean_latency_ms
    FROM decided JOIN truth USING (email_id) {where} GROUP BY policy_version)"""
_RATES = ("precision", "recall", "bypass_rate", "escalation_rate", "mean_latency_ms")


@query("policy_metrics", "WITH " + _METRICS.format(where="") + """
    SELECT policy_version, total, abuse_total, ham_total, true_positives, false_positives, false_negatives, escalations, """
       + ", ".join(f'{r6(chr(34) + n + chr(34))} AS "{n}"' for n in _RATES) + " FROM metrics", ("decided", "truth"))
def policy_metrics(spark, folder):
    found = metrics.policy_metrics(_labelled(spark, folder))
    return found.withColumns({n: R6(c(n)) for n in _RATES})


@query("policy_ab", "WITH " + _METRICS.format(where="") + " SELECT 'live' AS run_a, 'strict' AS run_b, "
       + ", ".join(f'{r6(f"b.{chr(34)}{n}{chr(34)} - a.{chr(34)}{n}{chr(34)}")} AS {n}_delta' for n in _RATES)
       + " FROM metrics a JOIN metrics b ON a.policy_version = 'live' AND b.policy_version = 'strict'", ("decided", "truth"))
def policy_ab(spark, folder):
    compared = metrics.compare_runs(metrics.policy_metrics(_labelled(spark, folder)), "live", "strict")
    return compared.select("run_a", "run_b", *[R6(c(f"{n}_delta")).alias(f"{n}_delta") for n in _RATES])


def _golden(spark, folder):
    """Frozen judging sets: labelled messages of the first and of the later half of the month."""
    arrived = R.events(spark, folder).select(c("event_id").alias("email_id"), "ts")
    version = F.when(c("ts") < F.lit(R.FOLDED_AT).cast("timestamp"), F.lit("golden-1")).otherwise(F.lit("golden-2"))
    return R.truth(spark, folder).join(arrived, "email_id").select(version.alias("version"), "email_id", "label")


@query("precision_gate", "WITH " + _METRICS.format(where="WHERE ts < TIMESTAMP '2024-01-16 00:00:00'") + """
    SELECT policy_version, total, coalesce(total >= 50 AND "precision" >= 0.95, FALSE) AS passed,
           CASE WHEN total < 50 THEN printf('golden set too small to judge precision: %d < 50 minimum samples', total)
                WHEN "precision" >= 0.95 THEN printf('precision %.4f >= floor 0.9500 on %d golden emails', "precision", total)
                ELSE printf('precision %.4f < floor 0.9500 on %d golden emails', "precision", total) END AS reason FROM metrics""",
       ("decided", "truth"))
def precision_gate(spark, folder):
    judged = metrics.labelled_decisions(
        _decided(spark, folder), R.truth(spark, folder), _golden(spark, folder), "golden-1"
    )
    return metrics.precision_gate(metrics.policy_metrics(judged)).select("policy_version", "total", "passed", "reason")


_CLAMP = "greatest(least({0}, 1.0e0 - 1e-12), 1e-12)"


def _logit_sql(p: str) -> str:
    x = _CLAMP.format(p)
    return f"ln({x} / (1.0e0 - {x}))"


@query("fusion", f"""
    WITH r AS (SELECT event_id AS email_id, CAST(user_id % 97 AS DOUBLE) / 96.0 AS mean, least(value / 5000.0, 0.08e0) AS variance,
                      k / 99.0 AS confidence FROM ev),
    f AS (SELECT *, {_logit_sql('(1.0e0 - mean)')} + {_logit_sql('confidence')} - {_logit_sql('0.6667e0')} AS z FROM r),
    p AS (SELECT *, 1.0e0 / (1.0e0 + exp(-z)) AS posterior, {_CLAMP.format('(1.0e0 - mean)')} AS prior FROM f)
    SELECT email_id, {r6('z')} AS posterior_logit, {r6('posterior')} AS posterior,
           {r6('CASE WHEN variance <= 0 THEN 0.0e0 ELSE least(1e6, posterior * (1.0e0 - posterior) * sqrt(variance) / (prior * (1.0e0 - prior))) END')}
           AS uncertainty_band, {r6('sqrt(variance)')} AS sender_uncertainty FROM p""", ("ev",))
def fusion(spark, folder):
    rated = R.events(spark, folder).select(
        c("event_id").alias("email_id"), ((c("user_id") % 97) / 96.0).alias("reputation_mean"),
        F.least(c("value") / 5000.0, F.lit(0.08)).alias("reputation_variance"), (c("k") / 99.0).alias("calibrated_confidence"),
    )
    fused = scoring.fuse(rated, 0.6667)
    return fused.select(
        "email_id", R6(c("posterior_logit")).alias("posterior_logit"), R6(c("posterior")).alias("posterior"),
        R6(F.least(F.lit(1e6), c("uncertainty_band"))).alias("uncertainty_band"),
        R6(c("sender_uncertainty")).alias("sender_uncertainty"),
    )


@query("hard_rule_floor", """
    SELECT email_id, CASE WHEN rule = 'BLOCK' THEN 'BLOCK' WHEN rule = 'QUARANTINE' AND candidate <> 'BLOCK' THEN 'QUARANTINE' ELSE candidate END AS final_tier,
           coalesce(rule = 'BLOCK' AND candidate <> 'BLOCK' OR rule = 'QUARANTINE' AND candidate IN ('ALLOW', 'WARN'), FALSE) AS was_softer
    FROM (SELECT email_id, rule, CASE CAST(user_id % 4 AS INTEGER) WHEN 0 THEN 'ALLOW' WHEN 1 THEN 'WARN' WHEN 2 THEN 'QUARANTINE' ELSE 'BLOCK' END AS candidate
          FROM scored)""", ("scored",))
def hard_rule_floor(spark, folder):
    candidate = tiers.tier_name((c("user_id") % 4).cast("int"))
    return R.scored(spark, folder).select(
        "email_id", rules.floor_at_rule(c("hard_rule_decision"), candidate).alias("final_tier"),
        rules.softer_than_rule(c("hard_rule_decision"), candidate).alias("was_softer"),
    )


@query("burst_escalation", """
    WITH b AS (SELECT email_id, decision, severity, len(reason_codes) AS reasons, latency_ms % 40 AS sender_count, user_id % 30 AS duplicate_count
               FROM decided WHERE policy_version = 'live'),
    t AS (SELECT *, CASE WHEN sender_count > 20 THEN 'SENDER_VELOCITY' WHEN duplicate_count > 20 THEN 'CONTENT_NEAR_DUP' END AS burst_trigger FROM b)
    SELECT email_id, burst_trigger, CASE WHEN burst_trigger IS NOT NULL AND severity < 2 THEN 'QUARANTINE' ELSE decision END AS decision,
           burst_trigger IS NOT NULL AND severity < 2 AS reason_added FROM t""", ("decided",))
def burst_escalation(spark, folder):
    decided = scoring.score_policies(R.scored(spark, folder), [R.LIVE])
    counted = decided.withColumn("sender_count", c("latency_ms") % 40).withColumn("duplicate_count", c("user_id") % 30)
    raised = scoring.escalate_bursts(counted, F.lit(R.LIVE.burst))
    return raised.select(
        "email_id", "burst_trigger", "decision", F.array_contains("reason_codes", "BURST_OVERRIDE").alias("reason_added")
    )


@query("pending_resolution", """
    WITH p AS (SELECT email_id, decision AS fast, rule, CASE CAST(user_id % 4 AS INTEGER) WHEN 0 THEN 'LEGITIMATE' WHEN 1 THEN 'SPAM' WHEN 2 THEN 'PHISHING' END AS verdict
               FROM decided WHERE policy_version = 'strict'),
    t AS (SELECT *, CASE verdict WHEN 'LEGITIMATE' THEN 0 WHEN 'SPAM' THEN 2 WHEN 'PHISHING' THEN 3 ELSE CASE WHEN fast = 'BLOCK' THEN 3 ELSE 2 END END AS sev,
                 CASE rule WHEN 'BLOCK' THEN 3 WHEN 'QUARANTINE' THEN 2 ELSE 0 END AS floor_sev FROM p)
    SELECT email_id, CASE greatest(sev, floor_sev) WHEN 0 THEN 'ALLOW' WHEN 1 THEN 'WARN' WHEN 2 THEN 'QUARANTINE' ELSE 'BLOCK' END AS resolved_tier,
           CASE WHEN verdict IS NULL THEN 'DEGRADED' WHEN greatest(sev, floor_sev) < 2 THEN 'PROMOTED' ELSE 'CONFIRMED' END AS resolution_state FROM t""",
       ("decided",))
def pending_resolution(spark, folder):
    decided = scoring.score_policies(R.scored(spark, folder), [R.STRICT])
    names = F.array(*[F.lit(v) for v in V.VERDICT_TIERS])
    verdict = F.when(c("user_id") % 4 < 3, F.get(names, (c("user_id") % 4).cast("int")))
    pending = decided.select("email_id", "hard_rule_decision", c("decision").alias("fast_tier"), verdict.alias("verdict"))
    return scoring.resolve_pending(pending).select("email_id", "resolved_tier", "resolution_state")


@query("route_mix", f"""
    SELECT bucket, coalesce(n, 0) AS n, {r6('coalesce(n, 0) / (SELECT count(*) FROM decided)')} AS share
    FROM (VALUES ('rules'), ('reputation'), ('llm')) b(bucket)
    LEFT JOIN (SELECT CASE route_used WHEN 'HARD_RULE' THEN 'rules' WHEN 'LLM' THEN 'llm' ELSE 'reputation' END AS bucket, count(*) AS n
               FROM decided GROUP BY 1) USING (bucket)""", ("decided",))
def route_mix(spark, folder):
    return metrics.route_mix(_decided(spark, folder)).withColumn("share", R6(c("share")))


@query("tier_mix", """
    SELECT decision, count(*) AS n, count_if(route_used = 'LLM')::BIGINT AS escalated FROM decided GROUP BY decision""", ("decided",))
def tier_mix(spark, folder):
    return metrics.tier_mix(_decided(spark, folder))


@query("reason_counts", """
    SELECT reason, count(*) AS n FROM (SELECT unnest(string_split(routing_reasons, ',')) AS reason FROM decided WHERE route_used = 'LLM')
    GROUP BY reason""", ("decided",))
def reason_counts(spark, folder):
    return metrics.reason_counts(_decided(spark, folder))


@query("latency_percentiles", f"""
    SELECT route_used, count(*) AS n, {r6('quantile_cont(latency_ms, 0.5)')} AS p50, {r6('quantile_cont(latency_ms, 0.95)')} AS p95,
           {r6('quantile_cont(latency_ms, 0.99)')} AS p99, quantile_cont(latency_ms, 0.95) <= 100 AS within_budget
    FROM decided WHERE route_used <> 'LLM' GROUP BY route_used""", ("decided",))
def latency_percentiles(spark, folder):
    found = metrics.latency_percentiles(_decided(spark, folder))
    return found.withColumns({p: R6(c(p)) for p in ("p50", "p95", "p99")})


@query("spend_meter", f"""
    WITH s AS (SELECT strftime(ts, '%Y-%m-%d') AS period, CAST(sum(cost_usd) AS DOUBLE) AS cost FROM scored GROUP BY 1)
    SELECT period, {r6('cost')} AS cost_usd, {r6('least(1.0e0, cost / 1.4e0)')} AS cost_ratio, cost >= 1.4e0 - 1e-9 AS at_cap FROM s""", ("scored",))
def spend_meter(spark, folder):
    meter = metrics.spend_meter(R.scored(spark, folder), 1.4, numeric.day_key(c("ts")))
    return meter.withColumns({n: R6(c(n)) for n in ("cost_usd", "cost_ratio")})


@query("interval_rates", f"""
    SELECT epoch_ms(time_bucket(INTERVAL 1 HOUR, ts)) AS interval_ms, route_used, count(*) AS n, {r6('count(*) / 3600.0e0')} AS per_second
    FROM decided WHERE policy_version = 'live' GROUP BY 1, 2""", ("decided",))
def interval_rates(spark, folder):
    decided = scoring.score_policies(R.scored(spark, folder), [R.LIVE])
    rates = metrics.interval_rates(decided, "ts", "route_used", "1 hour")
    return rates.select(millis("interval_start").alias("interval_ms"), "route_used", "n", R6(c("per_second")).alias("per_second"))


@query("event_validity", """
    SELECT broken, count(*) AS n FROM (SELECT concat_ws(',', CASE WHEN user_id % 50 = 0 THEN 'sender_key present' END,
        CASE WHEN event_type = 'view' THEN 'signal known' END, CASE WHEN k = 7 THEN 'bucket known' END,
        CASE WHEN value <= 5 THEN 'weight positive' END, CASE WHEN k = 0 OR k > 80 THEN 'decay_factor in (0,1]' END) AS broken FROM ev)
    GROUP BY broken""", ("ev",))
def event_validity(spark, folder):
    """Events as a raw reputation log with every kind of bad row, split by what each row breaks."""
    raw = R.events(spark, folder).select(
        F.when(c("user_id") % 50 == 0, F.lit("  ")).otherwise(c("user_id").cast("string")).alias("sender_key"),
        F.when(c("event_type") != "view", F.lit("GOOD")).alias("signal"),
        F.when(c("k") == 7, F.lit("OTHER")).otherwise(F.lit("AUTHENTICATED")).alias("bucket"),
        (c("value") - 5).alias("weight"), (c("k") / 80.0).alias("decay_factor"),
    )
    good, bad = quality.split_valid(raw, quality.reputation_event_rules())
    both = good.select(F.lit("").alias("broken")).unionAll(bad.select(F.array_join("violations", ",").alias("broken")))
    return both.groupBy("broken").agg(F.count("*").alias("n"))


@query("policy_validity", """
    SELECT broken, count(*) AS n, count_if(active) > 1 AS many_active FROM (
        SELECT o_orderpriority = '1-URGENT' AS active, concat_ws(',', CASE WHEN o_totalprice / 400000.0 > 1 THEN 'block_threshold in [0,1]' END,
            CASE WHEN o_totalprice / 400000.0 < 0.8 THEN 'ladder' END) AS broken FROM orders) GROUP BY broken""")
def policy_validity(spark, folder):
    """Orders read as policy rows whose block threshold follows the price."""
    rows = R.table(spark, folder, "orders").select(
        (c("o_orderpriority") == "1-URGENT").alias("active"), F.lit(False).alias("shadow"),
        F.lit(0.5).alias("warn_threshold"), F.lit(0.8).alias("quarantine_threshold"),
        (c("o_totalprice") / 400000.0).alias("block_threshold"), F.lit(0.4).alias("llm_threshold"),
        F.lit(0.05).alias("routing_band_width"), F.lit(20).alias("burst_threshold"),
    )
    marked = quality.with_violations(rows, quality.policy_rules())
    return marked.groupBy(F.array_join("violations", ",").alias("broken")).agg(
        F.count("*").alias("n"), (F.count_if("active") > 1).alias("many_active")
    )


@query("policy_flag_conflicts", """
    SELECT count_if(o_orderstatus = 'F')::BIGINT AS active, count_if(o_orderstatus = 'O')::BIGINT AS shadow,
           greatest(count_if(o_orderstatus = 'F'), count_if(o_orderstatus = 'O')) > 1 AS conflict FROM orders""")
def policy_flag_conflicts(spark, folder):
    flags = R.table(spark, folder, "orders").select((c("o_orderstatus") == "F").alias("active"), (c("o_orderstatus") == "O").alias("shadow"))
    return quality.flag_conflicts(flags)


@query("token_prices", """
    SELECT event_id, CAST(round(CAST(CAST(length(event_type) * 100 + k AS DOUBLE) / 1000.0e0 * 0.00015e0
           + CAST(user_id AS DOUBLE) / 1000.0e0 * 0.0006e0 AS DECIMAL(20,12)), 6) AS DOUBLE) AS price_usd FROM ev""", ("ev",))
def token_prices(spark, folder):
    price = numeric.token_price(F.length("event_type") * 100 + c("k"), c("user_id"))
    return R.events(spark, folder).select("event_id", price.cast("double").alias("price_usd"))


@query("verdict_checks", f"""
    SELECT event_id, CASE WHEN user_id % 11 NOT IN (1, 2, 3, 5) AND k < 95 AND NOT (user_id % 11 = 4 AND value / 400.0 > 1)
                          THEN 'SPAM' END AS verdict,
           CASE WHEN user_id % 11 NOT IN (1, 2, 3, 5) AND k < 95 AND NOT (user_id % 11 = 4 AND value / 400.0 > 1)
                THEN {r6('CASE WHEN user_id % 11 = 4 THEN value / 400.0 ELSE 0.25e0 END')} END AS spam_prob FROM ev""", ("ev",))
def verdict_checks(spark, folder):
    """Model responses built from events, most of them broken in one way, then validated."""
    kind = c("user_id") % 11
    fields = F.struct(
        F.lit("SPAM").alias("verdict"), F.when(kind == 4, c("value") / 400.0).otherwise(F.lit(0.25)).alias("spam_prob"),
        F.lit(0.1).alias("phishing_prob"),
        F.when(kind == 1, F.array(F.lit("MADE_UP"))).otherwise(F.array(F.lit("UNSOLICITED_BULK"))).alias("reason_codes"),
        F.when(c("k") >= 95, F.lit(" ")).otherwise(F.lit("bulk mail")).alias("explanation_short"),
    )
    body = F.to_json(fields)
    response = (
        F.when(kind == 2, F.replace(body, F.lit('{"verdict"'), F.lit('{"extra":1,"verdict"')))
        .when(kind == 3, F.replace(body, F.lit('"SPAM"'), F.lit('"MAYBE"')))
        .when(kind == 5, F.lit("I think this is spam"))
        .when(kind == 6, F.concat(F.lit("```json\n"), body, F.lit("\n```\n")))
        .otherwise(body)
    )
    answered = R.events(spark, folder).select("event_id", response.alias("response"))
    checked = verdicts.with_verdict(answered, "response", out="v")
    return checked.select("event_id", "v.verdict", R6(c("v.spam_prob")).alias("spam_prob"))


@query("decision_signals", """
    SELECT email_id, policy_version, CASE WHEN decision IN ('ALLOW', 'WARN') THEN 'GOOD' ELSE 'BAD' END AS signal FROM decided""", ("decided",))
def decision_signals(spark, folder):
    return _decided(spark, folder).select("email_id", "policy_version", tiers.decision_signal(c("decision")).alias("signal"))


@query("replay_events", """
    SELECT 'run-1' AS run_id, version AS policy_version, email_id, epoch_us(ingested_at) // 1000 AS ingested_ms
    FROM messages CROSS JOIN policies""", ("messages", "policies"))
def replay_events(spark, folder):
    fanned = lookups.replay_events(R.messages(spark, folder), [R.LIVE, R.STRICT], "run-1")
    return fanned.select("run_id", "policy_version", "email_id", millis("ingested_at").alias("ingested_ms"))
