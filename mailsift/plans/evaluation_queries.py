"""Queries over evaluation sets, families, windows, heads, budgets and storage folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from mailsift.operators import evalsplit, graph, lookups, ordered, windows
from mailsift.plans import roles as R
from mailsift.plans.common import R6, r6
from mailsift.plans.registry import query
from mailsift.sources import corpus as corpus_source, sinks

c = F.col

_CORPUS = """corpus AS (SELECT t.email_id, sender_domain, coalesce(received_at, ingested_at) AS event_time, label
                         FROM truth t JOIN messages m ON t.email_id = m.email_id)"""


def _corpus(spark, folder):
    return evalsplit.corpus(R.truth(spark, folder), R.messages(spark, folder))


@query("labelled_corpus", f"WITH {_CORPUS} SELECT email_id, sender_domain, epoch_us(event_time) // 1000 AS event_ms, label FROM corpus",
       ("truth", "messages"))
def labelled_corpus(spark, folder):
    return _corpus(spark, folder).select("email_id", "sender_domain", F.unix_millis("event_time").alias("event_ms"), "label")


_RELATIONS = """members AS (
        SELECT 'sender:' || user_id AS r, doc_id AS n FROM documents JOIN ev ON doc_id = event_id WHERE event_type = 'error'
        UNION SELECT 'copy:' || md5(text), doc_id FROM documents
        UNION SELECT 'lineage:' || doc_id || ':' || user_id, unnest([doc_id, user_id]) FROM documents JOIN ev ON doc_id = event_id
              WHERE k = 0)"""
_FAMILIES = f"""{_RELATIONS},
    edges AS (SELECT DISTINCT a.n AS x, b.n AS y FROM members a JOIN members b USING (r) WHERE a.n <> b.n),
    reach AS (SELECT n AS root, n AS node FROM (SELECT DISTINCT n FROM members) UNION SELECT root, y FROM reach JOIN edges ON node = x),
    families AS (SELECT node, min(root) AS component FROM reach GROUP BY node)"""


def _members(spark, folder):
    """Three relations: same noisy sender, exact copies, and variants of a seed message."""
    docs = R.table(spark, folder, "documents")
    sent = docs.join(R.events(spark, folder), c("doc_id") == c("event_id"))
    noisy = graph.relations_of(sent.filter("event_type = 'error'"), "user_id", "doc_id", "sender")
    copies = graph.relations_of(docs.select("doc_id", F.md5("text").alias("digest")), "digest", "doc_id", "copy")
    lineage = graph.lineage_relations(sent.filter("k = 0"), "doc_id", "user_id")
    return noisy.unionByName(copies).unionByName(lineage)


def _families(spark, folder):
    return graph.resolve_families(R.truth(spark, folder), _members(spark, folder))


@query("families", f"WITH RECURSIVE {_FAMILIES} SELECT t.email_id, 'fam:' || component AS family_key FROM truth t LEFT JOIN families ON t.email_id = node",
       ("truth", "ev"))
def families(spark, folder):
    return _families(spark, folder)


def _split(spark, folder):
    """Families here are senders' domains with the hour they wrote in, so both sides get some; ties by digest."""
    grouped = _corpus(spark, folder).withColumn(
        "group_id", F.concat_ws("/", "sender_domain", F.date_format("event_time", "yyyy-MM-dd"))
    )
    held = grouped.withColumn("group_id", F.when(c("email_id") % 9 == 0, F.lit(" ")).otherwise(c("group_id")))
    return evalsplit.time_forward_split(held, tie_hash=F.md5(F.concat(c("group_key"), F.lit("42"))))


_SPLIT = f"""{_CORPUS},
    keyed_corpus AS (SELECT *, CASE WHEN email_id % 9 = 0 THEN 'own:' || email_id
                             ELSE sender_domain || '/' || strftime(event_time, '%Y-%m-%d') END AS group_key FROM corpus),
    fams AS (SELECT group_key, max(event_time) AS newest, count(*) AS members, md5(group_key || '42') AS tie FROM keyed_corpus GROUP BY group_key),
    ranked AS (SELECT *, coalesce(sum(members) OVER (ORDER BY newest DESC, tie, group_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
                      row_number() OVER (ORDER BY newest DESC, tie, group_key) AS place FROM fams),
    sides AS (SELECT group_key, CASE WHEN before < (SELECT floor(count(*) * 0.2e0 + 0.5e0) FROM corpus)
                                      AND place < (SELECT count(*) FROM fams) THEN 'eval' ELSE 'train' END AS split_side FROM ranked),
    split AS (SELECT email_id, group_key, event_time, label, split_side FROM keyed_corpus JOIN sides USING (group_key))"""


@query("family_split", f"""
    WITH RECURSIVE {_FAMILIES}, {_CORPUS},
    keyed_corpus AS (SELECT corpus.*, coalesce('fam:' || component, 'own:' || email_id) AS group_key FROM corpus LEFT JOIN families ON email_id = node),
    {_SPLIT[_SPLIT.index("fams AS"):]} SELECT email_id, group_key, split_side FROM split""", ("truth", "messages", "ev"))
def family_split(spark, folder):
    """Families resolved over all relations, then kept whole by the split: no variant of a training message is judged on."""
    keyed = _corpus(spark, folder).join(_families(spark, folder), "email_id", "left").withColumnRenamed("family_key", "group_id")
    split = evalsplit.time_forward_split(keyed, tie_hash=F.md5(F.concat(c("group_key"), F.lit("42"))))
    return split.select("email_id", "group_key", "split_side")


@query("eval_split", f"WITH {_SPLIT} SELECT email_id, group_key, label, split_side FROM split", ("truth", "messages"))
def eval_split(spark, folder):
    return _split(spark, folder).select("email_id", "group_key", "label", "split_side")


@query("split_counts", f"WITH {_SPLIT} SELECT split_side, label, count(*) AS n FROM split GROUP BY ALL", ("truth", "messages"))
def split_counts(spark, folder):
    return evalsplit.counts_by_side_and_label(_split(spark, folder))


def _random_sides(spark, folder):
    """Sides drawn per message instead of per family, so that the audit has something to find."""
    return _split(spark, folder).withColumn(
        "split_side", F.when(F.substring(F.md5(c("email_id").cast("string")), 1, 1) < "4", F.lit("eval")).otherwise(F.lit("train"))
    )


def _audit_sql(source: str) -> str:
    return f"""
    SELECT *, cross_boundary_groups = 0 AND temporal_inversions = 0 AS leakage_free FROM (
    SELECT count(*) AS total, count_if(split_side = 'train')::BIGINT AS train_count, count_if(split_side = 'eval')::BIGINT AS eval_count,
           epoch_us(max(event_time) FILTER (split_side = 'train')) // 1000 AS latest_train_ms,
           epoch_us(min(event_time) FILTER (split_side = 'eval')) // 1000 AS earliest_eval_ms, count(DISTINCT group_key) AS group_count,
           (SELECT count(*) FROM (SELECT group_key FROM {source} GROUP BY 1 HAVING count(DISTINCT split_side) > 1)) AS cross_boundary_groups,
           count_if(split_side = 'eval' AND event_time < (SELECT max(event_time) FROM {source} WHERE split_side = 'train'))::BIGINT AS temporal_inversions FROM {source})"""


_AUDIT = ("total", "train_count", "eval_count", "group_count", "cross_boundary_groups", "temporal_inversions", "leakage_free")


def _audited(split):
    return evalsplit.split_audit(split).select(
        *_AUDIT, F.unix_millis("latest_train_time").alias("latest_train_ms"), F.unix_millis("earliest_eval_time").alias("earliest_eval_ms")
    )


@query("split_audit", f"WITH {_SPLIT} {_audit_sql('split')}", ("truth", "messages"))
def split_audit(spark, folder):
    return _audited(_split(spark, folder))


@query("random_split_audit", f"""
    WITH {_SPLIT}, drawn AS (SELECT email_id, group_key, event_time, label,
        CASE WHEN substr(md5(CAST(email_id AS VARCHAR)), 1, 1) < '4' THEN 'eval' ELSE 'train' END AS split_side FROM split) {_audit_sql('drawn')}""",
       ("truth", "messages"))
def random_split_audit(spark, folder):
    return _audited(_random_sides(spark, folder))


def _retrain(spark, folder):
    """Feedback on documents, as retrain labels."""
    return R.events(spark, folder).select(
        c("user_id").alias("email_id"), F.when(c("k") < 50, F.lit("ham")).otherwise(F.lit("spam")).alias("label"),
        F.least(c("value") / 100.0, F.lit(1.0)).alias("weight"),
        F.when(c("event_type") == "click", F.lit("arena")).otherwise(F.lit("feedback")).alias("source"),
        F.to_json(F.struct(c("event_id").alias("eventId"))).alias("provenance"),
    )


@query("judging_audit", f"""
    WITH {_SPLIT}, fresh AS (SELECT DISTINCT user_id AS email_id FROM ev WHERE event_type = 'signup' AND k < 5),
    judging AS (SELECT email_id FROM split WHERE split_side = 'eval' UNION SELECT email_id FROM truth WHERE label = 'phish' UNION SELECT email_id FROM fresh),
    feedback AS (SELECT DISTINCT user_id AS email_id FROM ev WHERE event_type <> 'click')
    SELECT count(*) AS judging_total, count_if(t.email_id IS NULL)::BIGINT AS without_ground_truth,
           count_if(f.email_id IS NOT NULL AND t.email_id IS NULL)::BIGINT AS feedback_only_in_judging,
           (SELECT count(*) FROM feedback) AS feedback_labeled_total, without_ground_truth = 0 AND feedback_only_in_judging = 0 AS clean
    FROM judging j LEFT JOIN truth t ON j.email_id = t.email_id LEFT JOIN feedback f ON j.email_id = f.email_id""", ("truth", "messages"))
def judging_audit(spark, folder):
    truth = R.truth(spark, folder)
    fresh = R.events(spark, folder).filter("event_type = 'signup' and k < 5").select(c("user_id").alias("email_id")).distinct()
    judged = evalsplit.judging_sources(_split(spark, folder), truth.filter("label = 'phish'"), fresh)
    return evalsplit.judging_audit(judged, truth, _retrain(spark, folder))


@query("labelled_split", f"WITH {_SPLIT} SELECT email_id, split_side, label <> 'ham' AS positive FROM split", ("truth", "messages"))
def labelled_split(spark, folder):
    return evalsplit.labelled_split(_split(spark, folder), R.truth(spark, folder))


@query("golden_counts", f"WITH {_SPLIT} SELECT 'g1' AS version, label, count(*) AS n FROM split WHERE split_side = 'eval' GROUP BY ALL", ("truth", "messages"))
def golden_counts(spark, folder):
    return evalsplit.golden_counts(evalsplit.frozen_golden(_split(spark, folder), R.truth(spark, folder), "g1"))


@query("stratified_head", """
    SELECT email_id, label, place FROM (SELECT email_id, label, CAST(row_number() OVER (PARTITION BY label ORDER BY ingested_at, email_id) AS INTEGER) AS place
    FROM truth JOIN messages USING (email_id)) WHERE place <= 4""", ("truth", "messages"))
def stratified_head(spark, folder):
    dated = R.truth(spark, folder).join(R.messages(spark, folder).select("email_id", "ingested_at"), "email_id")
    return windows.stratified_head(dated, "label", ["ingested_at", "email_id"], 4).select("email_id", "label", "place")


@query("latest_decision", """
    SELECT conv_id, max(turn) AS turn, max_by(role, turn) AS role, md5(max_by(text, turn)) AS text_md5 FROM conversations GROUP BY conv_id""")
def latest_decision(spark, folder):
    latest = windows.latest_per_key(R.table(spark, folder, "conversations"), ["conv_id"], ["turn"])
    return latest.select("conv_id", "turn", "role", F.md5("text").alias("text_md5"))


@query("latest_order_per_customer", """
    SELECT c_custkey, c_mktsegment, o_orderkey, o_totalprice FROM customer c JOIN LATERAL (
        SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = c.c_custkey ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1) ON TRUE""")
def latest_order_per_customer(spark, folder):
    history = R.table(spark, folder, "orders").select(c("o_custkey").alias("c_custkey"), "o_orderdate", "o_orderkey", "o_totalprice")
    wanted = R.table(spark, folder, "customer").select("c_custkey", "c_mktsegment")
    return windows.latest_for(wanted, history, "c_custkey", ["o_orderdate", "o_orderkey"]).select(
        "c_custkey", "c_mktsegment", "o_orderkey", "o_totalprice"
    )


@query("orders_of_segment", """
    SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""")
def orders_of_segment(spark, folder):
    """Rows for an id list held in a table."""
    ids = R.table(spark, folder, "customer").filter("c_mktsegment = 'BUILDING'").select(c("c_custkey").alias("o_custkey"))
    return lookups.by_ids(R.table(spark, folder, "orders"), ids, "o_custkey").select("o_orderkey", "o_custkey", "o_totalprice")


@query("newest_orders", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50")
def newest_orders(spark, folder):
    return windows.newest(R.table(spark, folder, "orders"), [F.desc("o_orderdate"), F.desc("o_orderkey")], 50).select("o_orderkey", "o_custkey")


@query("recent_orders_ascending", """
    SELECT o_orderkey, o_custkey FROM (SELECT * FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20) ORDER BY o_orderdate, o_orderkey""")
def recent_orders_ascending(spark, folder):
    return windows.recent_then_oldest_first(R.table(spark, folder, "orders"), "o_orderdate", "o_orderkey", 20).select("o_orderkey", "o_custkey")


@query("sender_burst", """
    SELECT a.event_id, (SELECT count(*) FROM ev b WHERE b.user_id = a.user_id AND epoch_us(b.ts) // 1000 > epoch_us(a.ts) // 1000 - 21600000
                        AND epoch_us(b.ts) // 1000 <= epoch_us(a.ts) // 1000) AS sender_count FROM ev a""", ("ev",))
def sender_burst(spark, folder):
    """Six-hour window instead of a minute, for the pace of the event table."""
    counts = windows.trailing_sender_counts(R.events(spark, folder), "user_id", "event_id", "ts", 6 * 3600 * 1000)
    return counts.select("event_id", "sender_count")


@query("running_spend", """
    SELECT email_id, CAST(sum(cost_usd) OVER (PARTITION BY strftime(ts, '%Y-%m-%d') ORDER BY ts, email_id ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS day_spend,
           CAST(sum(cost_usd) OVER (PARTITION BY strftime(ts, '%Y-%m') ORDER BY ts, email_id ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS month_spend,
           CASE WHEN day_spend > 1.0e0 THEN 'daily' WHEN month_spend > 20.0e0 THEN 'monthly' ELSE 'none' END AS denied_by FROM scored""", ("scored",))
def running_spend(spark, folder):
    calls = R.scored(spark, folder).select("email_id", "ts", "cost_usd")
    spent = windows.spend_so_far(calls, "ts", "cost_usd", "email_id")
    scope = windows.denial_scope(c("day_spend").cast("double"), c("month_spend").cast("double"), 1.0, 20.0)
    return spent.select(
        "email_id", c("day_spend").cast("double").alias("day_spend"), c("month_spend").cast("double").alias("month_spend"),
        F.coalesce(scope, F.lit("none")).alias("denied_by"),
    )


@query("admitted_calls", """
    WITH d AS (SELECT email_id, ts, cost_usd, strftime(ts, '%Y-%m-%d') AS day, strftime(ts, '%Y-%m') AS month,
                      coalesce(sum(cost_usd) OVER (PARTITION BY strftime(ts, '%Y-%m-%d') ORDER BY ts, email_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
                      + 0.01 <= 0.50 AS in_day FROM scored),
    m AS (SELECT *, in_day AND coalesce(sum(CASE WHEN in_day THEN cost_usd ELSE 0 END) OVER (PARTITION BY month ORDER BY ts, email_id
                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 0.01 <= 5.00 AS granted FROM d)
    SELECT email_id, CASE WHEN granted THEN 'granted'
        WHEN coalesce(sum(cost_usd) FILTER (granted) OVER (PARTITION BY day), 0) + 0.01 > 0.50 THEN 'daily' ELSE 'monthly' END AS outcome FROM m""", ("scored",))
def admitted_calls(spark, folder):
    calls = R.scored(spark, folder).select("email_id", "ts", "cost_usd")
    return windows.admit_calls(calls, "ts", "cost_usd", "email_id").select("email_id", "outcome")


@query("trust_series", f"""
    WITH s AS (SELECT email_id, posterior, row_number() OVER (ORDER BY ts, email_id) AS seq, row_number() OVER (ORDER BY ts DESC, email_id DESC) AS back
               FROM scored WHERE posterior IS NOT NULL)
    SELECT seq, email_id, {r6('greatest(0, least(1, 1.0e0 - posterior))')} AS trust FROM s WHERE back <= 60""", ("scored",))
def trust_series(spark, folder):
    return windows.trust_series(R.scored(spark, folder), "ts", "email_id").withColumn("trust", R6(c("trust")))


_CARD_SQL = """
    WITH o AS (SELECT DISTINCT conv_id, turn, CASE role WHEN 'user' THEN 'quarantine' ELSE 'allow' END AS tier,
                      CASE role WHEN 'system' THEN 'hard_rule' ELSE 'llm' END AS route_used FROM conversations)
    SELECT conv_id, max_by(tier, turn) AS tier, max_by(route_used, turn) AS route_used, count(*) > 1 AS resolved, min(turn) AS first_seen,
           count(*) = 1 AND max_by(route_used, turn) = 'llm' AND max_by(tier, turn) = 'quarantine' AS pending FROM o GROUP BY conv_id"""


def _card_decisions(spark, folder):
    """Turns as decisions of a conversation, every one of them delivered twice."""
    turns = R.table(spark, folder, "conversations").select(
        "conv_id", c("turn").alias("classification_id"), c("turn").alias("at_turn"),
        F.when(c("role") == "user", F.lit("quarantine")).otherwise(F.lit("allow")).alias("tier"),
        F.when(c("role") == "system", F.lit("hard_rule")).otherwise(F.lit("llm")).alias("route_used"),
    )
    return turns.unionAll(turns)


@query("decision_cards", _CARD_SQL)
def decision_cards(spark, folder):
    return windows.decision_cards(_card_decisions(spark, folder), "conv_id", "classification_id", "at_turn", cap=None)


@query("newest_cards", f"SELECT * FROM ({_CARD_SQL}) ORDER BY first_seen DESC, conv_id DESC LIMIT 100")
def newest_cards(spark, folder):
    return windows.decision_cards(_card_decisions(spark, folder), "conv_id", "classification_id", "at_turn", cap=100)


@query("stratified_split", """
    WITH r AS (SELECT email_id, label, row_number() OVER (PARTITION BY label ORDER BY md5(email_id || '-42'), email_id) AS place,
                      count(*) OVER (PARTITION BY label) AS n FROM truth)
    SELECT email_id, label, CASE WHEN place <= floor(n * 0.25e0 + 0.5e0) THEN 'eval' ELSE 'train' END AS split_side FROM r""", ("truth",))
def stratified_split(spark, folder):
    drawn = F.md5(F.concat(c("email_id").cast("string"), F.lit("-42")))
    return windows.stratified_split(R.truth(spark, folder), "label", "email_id", order_hash=drawn).select("email_id", "label", "split_side")


@query("first_seen_ids", """
    SELECT doc_id, min(doc_id) OVER (PARTITION BY sha2) AS canonical_id, doc_id <> min(doc_id) OVER (PARTITION BY sha2) AS duplicate
    FROM (SELECT doc_id, sha256(text) AS sha2 FROM documents)""")
def first_seen_ids(spark, folder):
    """Ingest of every document, half of them already stored: canonical id and duplicate flag per content hash."""
    hashed = R.table(spark, folder, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"))
    half = hashed.agg(F.max("doc_id")).scalar() / 2
    earlier = sinks.first_per_key(hashed.filter(c("doc_id") < half), ["content_hash"], ["doc_id"])
    later = sinks.with_canonical_id(hashed.filter(c("doc_id") >= half), earlier, "content_hash", "doc_id", ["doc_id"])
    first = sinks.with_canonical_id(hashed.filter(c("doc_id") < half), earlier.limit(0), "content_hash", "doc_id", ["doc_id"])
    return later.unionByName(first).select("doc_id", "canonical_id", "duplicate")


@query("absent_rows", "SELECT min(doc_id) AS doc_id, sha256(text) AS content_hash FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE lang = 'en') GROUP BY 2")
def absent_rows(spark, folder):
    """Rows an insert-if-absent would add when the English documents are already stored."""
    hashed = R.table(spark, folder, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"), "lang")
    stored = hashed.filter("lang = 'en'").select("content_hash").distinct()
    return sinks.absent_rows(hashed, stored, ["content_hash"], ["doc_id"]).select("doc_id", "content_hash")


@query("upserted_orders", """
    SELECT o_custkey, arg_max(o_orderkey, {'d': o_orderdate, 'k': o_orderkey}) AS o_orderkey FROM orders GROUP BY o_custkey""")
def upserted_orders(spark, folder):
    """Latest order per customer: a stored half-finished table, then the finished and failed orders as updates."""
    orders = R.table(spark, folder, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus")
    stored = sinks.first_per_key(orders.filter("o_orderstatus = 'O'").withColumn("late", F.struct(-F.unix_seconds(c("o_orderdate").cast("timestamp")), -c("o_orderkey"))),
                                 ["o_custkey"], ["late"]).drop("late")
    merged = sinks.upserted(stored, orders.filter("o_orderstatus <> 'O'"), ["o_custkey"], ["o_orderdate", "o_orderkey"])
    return merged.select("o_custkey", "o_orderkey")


@query("load_report", """
    WITH h AS (SELECT label, source, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) > 1 AS duplicate
               FROM documents JOIN truth ON doc_id = email_id)
    SELECT label, count_if(NOT duplicate)::BIGINT AS loaded, count_if(duplicate)::BIGINT AS duplicates_skipped,
           coalesce(string_agg(DISTINCT source, ',' ORDER BY source) FILTER (NOT duplicate), '') AS datasets FROM h GROUP BY label""", ("truth",))
def load_report(spark, folder):
    labelled = R.table(spark, folder, "documents").join(R.truth(spark, folder), c("doc_id") == c("email_id"))
    hashed = labelled.select("doc_id", "label", c("source").alias("dataset"), F.sha2("text", 256).alias("content_hash"))
    empty = hashed.limit(0)
    loaded = sinks.with_canonical_id(hashed, empty, "content_hash", "doc_id", ["doc_id"])
    return corpus_source.load_report(loaded).withColumn("datasets", F.array_join("datasets", ","))


@query("ordered_positions", "SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS position FROM ev", ("ev",))
def ordered_positions(spark, folder):
    """Place of every event in replay order."""
    return ordered.positions(R.events(spark, folder).select("event_id", "ts"), ["ts", "event_id"]).select("event_id", "position")
