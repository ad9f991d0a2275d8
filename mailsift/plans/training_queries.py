"""Queries over calibration, training sets, models and protected content."""

from __future__ import annotations

from pyspark.sql import functions as F

from mailsift.functions import crypto
from mailsift.operators import calibration, features, privacy, training
from mailsift.plans import roles as R
from mailsift.plans.common import R6, r6
from mailsift.plans.evaluation_queries import _SPLIT, _retrain, _split
from mailsift.plans.registry import query
from mailsift.sources import sinks
from mailsift.session import cut_lineage, ensure_checkpoint_dir

c = F.col


def _confident(spark, folder):
    return R.scored(spark, folder).select("email_id", c("calibrated_confidence").alias("raw")).join(R.truth(spark, folder), "email_id").filter(
        c("raw").isNotNull()
    ).withColumn("positive", c("label") != "ham")


_CURVE = """scores AS (SELECT confidence AS raw, label <> 'ham' AS positive FROM scored JOIN truth USING (email_id) WHERE confidence IS NOT NULL),
    binned AS (SELECT CAST(least(floor(raw * 10), 9) AS INTEGER) AS bin, count(*) AS n, avg(raw) AS p, avg(CAST(positive AS DOUBLE)) AS o FROM scores GROUP BY 1),
    curve AS (SELECT b.bin, coalesce(n, 0) AS n, coalesce(p, 0) AS p, coalesce(o, 0) AS o
              FROM (SELECT CAST(unnest(range(10)) AS INTEGER) AS bin) b LEFT JOIN binned USING (bin))"""


@query("reliability_curve", f"WITH {_CURVE} SELECT bin, n, {r6('p')} AS mean_predicted, {r6('o')} AS observed FROM curve", ("scored", "truth"))
def reliability_curve(spark, folder):
    curve = calibration.reliability_curve(_confident(spark, folder), "raw", "positive")
    return curve.select("bin", "n", R6(c("mean_predicted")).alias("mean_predicted"), R6(c("observed")).alias("observed"))


@query("calibration_error", f"WITH {_CURVE} SELECT CAST(sum(n) AS BIGINT) AS samples, {r6('sum(n * abs(p - o)) / sum(n)')} AS ece FROM curve", ("scored", "truth"))
def calibration_error(spark, folder):
    curve = calibration.reliability_curve(_confident(spark, folder), "raw", "positive")
    return calibration.calibration_error(curve).withColumn("ece", R6(c("ece")))


@query("calibration_gate", f"""
    WITH {_CURVE}, halves AS (SELECT raw / 2 AS raw, positive FROM scores),
    hb AS (SELECT CAST(least(floor(raw * 10), 9) AS INTEGER) AS bin, count(*) AS n, avg(raw) AS p, avg(CAST(positive AS DOUBLE)) AS o FROM halves GROUP BY 1),
    e AS (SELECT (SELECT sum(n * abs(p - o)) / sum(n) FROM curve) AS er, (SELECT sum(n * abs(p - o)) / sum(n) FROM hb) AS ec)
    SELECT {r6('er')} AS ece_raw, {r6('ec')} AS ece_calibrated, ec <= 0.1 AS passed,
           printf('calibrated ECE %.4f %s ceiling 0.1000 for model m1 (raw ECE was %.4f)', ec, CASE WHEN ec <= 0.1 THEN 'within' ELSE 'exceeds' END, er) AS reason
    FROM e""", ("scored", "truth"))
def calibration_gate(spark, folder):
    scored = _confident(spark, folder).withColumn("halved", c("raw") / 2)
    report = calibration.reliability_report(scored, "raw", "halved", "positive")
    judged = calibration.calibration_gate(report, "m1")
    return judged.select(R6(c("ece_raw")).alias("ece_raw"), R6(c("ece_calibrated")).alias("ece_calibrated"), "passed", "reason")


# The isotonic fit at a point is the largest, over starts before it, of the smallest mean of the ranges that hold it.
@query("isotonic_calibration", f"""
    WITH {_SPLIT},
    fitted AS (SELECT c.email_id, c.confidence AS raw, CAST(t.label <> 'ham' AS DOUBLE) AS positive, s.split_side
               FROM scored c JOIN truth t ON c.email_id = t.email_id JOIN split s ON s.email_id = c.email_id WHERE confidence IS NOT NULL),
    points AS (SELECT raw AS x, avg(positive) AS y, count(*) AS w, row_number() OVER (ORDER BY raw) AS i
               FROM fitted WHERE split_side = 'train' GROUP BY raw),
    ranges AS (SELECT a.i AS a, b.i AS b, sum(p.y * p.w) / sum(p.w) AS m
               FROM points a JOIN points b ON a.i <= b.i JOIN points p ON p.i BETWEEN a.i AND b.i GROUP BY 1, 2),
    lowest AS (SELECT p.i, r.a, min(m) AS m FROM points p JOIN ranges r ON p.i BETWEEN r.a AND r.b GROUP BY 1, 2),
    curve AS (SELECT x, v FROM points JOIN (SELECT i, max(m) AS v FROM lowest GROUP BY i) USING (i)),
    placed AS (SELECT f.email_id, f.split_side, f.raw, max(x) FILTER (x <= raw) AS x0, min(x) FILTER (x >= raw) AS x1
               FROM fitted f CROSS JOIN curve GROUP BY ALL)
    SELECT email_id, split_side, {r6("""greatest(0e0, least(1e0, CASE WHEN x0 IS NULL OR x0 = x1 THEN b.v WHEN x1 IS NULL THEN a.v
           ELSE a.v + (b.v - a.v) * (raw - x0) / (x1 - x0) END))""")} AS calibrated_confidence
    FROM placed LEFT JOIN curve a ON a.x = x0 LEFT JOIN curve b ON b.x = x1""", ("scored", "truth", "messages"))
def isotonic_calibration(spark, folder):
    """Fit on the train side, applied to every scored message."""
    sides = _split(spark, folder).select("email_id", "split_side")
    fitted = _confident(spark, folder).join(sides, "email_id")
    model = calibration.fit_isotonic(fitted.filter("split_side = 'train'"), "raw", "positive")
    return calibration.apply_isotonic(model, fitted, "raw").select("email_id", "split_side", R6(c("calibrated_confidence")).alias("calibrated_confidence"))


@query("isotonic_blocks", f"""
    WITH {_SPLIT},
    fitted AS (SELECT c.email_id, c.confidence AS raw, CAST(t.label <> 'ham' AS DOUBLE) AS positive, s.split_side
               FROM scored c JOIN truth t ON c.email_id = t.email_id JOIN split s ON s.email_id = c.email_id WHERE confidence IS NOT NULL),
    points AS (SELECT raw AS x, avg(positive) AS y, count(*) AS w, row_number() OVER (ORDER BY raw) AS i
               FROM fitted WHERE split_side = 'train' GROUP BY raw),
    ranges AS (SELECT a.i AS a, b.i AS b, sum(p.y * p.w) / sum(p.w) AS m
               FROM points a JOIN points b ON a.i <= b.i JOIN points p ON p.i BETWEEN a.i AND b.i GROUP BY 1, 2),
    lowest AS (SELECT p.i, r.a, min(m) AS m FROM points p JOIN ranges r ON p.i BETWEEN r.a AND r.b GROUP BY 1, 2),
    curve AS (SELECT x, v FROM points JOIN (SELECT i, max(m) AS v FROM lowest GROUP BY i) USING (i))
    SELECT {r6('min(x)')} AS low, {r6('max(x)')} AS high, CAST(sum(w) AS BIGINT) AS n, {r6('v')} AS value FROM curve JOIN points USING (x) GROUP BY v""",
       ("scored", "truth", "messages"))
def isotonic_blocks(spark, folder):
    """The blocks of the fit on the train side, pooled chunk by chunk."""
    sides = _split(spark, folder).filter("split_side = 'train'").select("email_id")
    blocks = calibration.isotonic_blocks(_confident(spark, folder).join(sides, "email_id"), "raw", "positive")
    return blocks.select(R6(c("low")).alias("low"), R6(c("high")).alias("high"), "n", R6(c("value")).alias("value"))


def _examples(spark, folder):
    """Ground truth weighted by arrival value, with features; two sources."""
    arrived = R.events(spark, folder).select(
        c("event_id").alias("email_id"), F.greatest(c("value") / 100.0, F.lit(0.1)).alias("weight"),
        F.when(c("event_type") == "view", F.lit("arena")).otherwise(F.lit("seed")).alias("source"),
    )
    return R.truth(spark, folder).join(arrived, "email_id").select("email_id", "label", "weight", "source")


_EXAMPLES = """examples AS (SELECT t.email_id, label, greatest(value / 100.0, 0.1e0) AS weight,
        CASE WHEN event_type = 'view' THEN 'arena' ELSE 'seed' END AS source FROM truth t JOIN ev ON email_id = event_id)"""


@query("training_accounting", f"""
    WITH {_EXAMPLES} SELECT source, label, count(*) AS examples, {r6('sum(weight)')} AS weight FROM examples GROUP BY ALL""", ("truth", "ev"))
def training_accounting(spark, folder):
    return training.training_accounting(_examples(spark, folder)).withColumn("weight", R6(c("weight")))


@query("training_base_rate", f"""
    WITH {_EXAMPLES} SELECT {r6("sum(weight) FILTER (label <> 'ham') / sum(weight)")} AS training_base_rate FROM examples""", ("truth", "ev"))
def training_base_rate(spark, folder):
    return training.base_rate(_examples(spark, folder)).select(R6(c("training_base_rate")).alias("training_base_rate"))


@query("training_validation", f"""
    WITH {_EXAMPLES} SELECT count(*) AS examples, 0::BIGINT AS bad_vectors, count_if(email_id % 10 = 0)::BIGINT AS unknown_labels,
           count_if(email_id % 7 = 0)::BIGINT AS bad_weights, count_if(label = 'ham' AND email_id % 10 <> 0)::BIGINT AS ham,
           count_if(label <> 'ham' AND email_id % 10 <> 0)::BIGINT AS abuse, FALSE AS trainable FROM examples""", ("truth", "ev"))
def training_validation(spark, folder):
    """A set with spoiled labels and weights."""
    spoiled = _examples(spark, folder).withColumns({
        "label": F.when(c("email_id") % 10 == 0, F.lit("other")).otherwise(c("label")),
        "weight": F.when(c("email_id") % 7 == 0, F.lit(0.0)).otherwise(c("weight")),
    })
    vectors = features.extract_features(R.messages(spark, folder))
    joined, _ = training.join_features(spoiled, vectors)
    listed = joined.withColumn("features", features.feature_array(c("features")))
    return training.training_problems(listed)


@query("feature_join", f"""
    WITH {_EXAMPLES}, f AS (SELECT email_id FROM messages WHERE received_at IS NOT NULL)
    SELECT (SELECT count(*) FROM examples JOIN f USING (email_id)) AS kept,
           (SELECT count(*) FROM examples WHERE email_id NOT IN (SELECT email_id FROM f)) AS dropped""", ("truth", "messages"))
def feature_join(spark, folder):
    """Labels joined to features that exist only for dated messages."""
    extracted = features.extract_features(R.messages(spark, folder).filter("received_at is not null"))
    kept, dropped = training.join_features(_examples(spark, folder), extracted)
    return kept.agg(F.count("*").alias("kept")).withColumn("dropped", dropped.scalar())


@query("dataset_version", f"""
    WITH {_EXAMPLES}, d AS (SELECT sha256('{{"email_id":' || email_id || ',"label":"' || label || '","source":"' || source || '"}}') AS h FROM examples),
    p AS (SELECT count(*) || '-' || {" || '-' || ".join(f"sum(CAST('0x' || substr(h, {8 * i + 1}, 8) AS BIGINT))" for i in range(8))} AS joined FROM d)
    SELECT 'candidate-fv1-' || substr(sha256(joined), 1, 8) AS dataset_version FROM p""", ("truth", "ev"))
def dataset_version(spark, folder):
    return training.dataset_version(_examples(spark, folder), columns=("email_id", "label", "source"))


@query("classifier_scores")
def classifier_scores(spark, folder):
    """Class probabilities of every message under a model trained on the labelled ones; the optimiser has no SQL twin."""
    extracted = features.with_vector(features.extract_features(R.messages(spark, folder)))
    vectors = cut_lineage(extracted.select("email_id", "feature_vector", "feature_version"))  # texts are read once: for the fit and the scores
    examples, _ = training.join_features(_examples(spark, folder), vectors)
    model = training.fit_classifier(examples)
    scored = training.score_classes(model, vectors)
    names = ("ham_score", "spam_score", "phishing_score", "raw_malicious")
    return scored.select("email_id", *[F.round(n, 4).alias(n) for n in names])


@query("text_embeddings", "SELECT doc_id AS email_id, CAST(least(128, (SELECT count(DISTINCT text) FROM documents WHERE trim(text) <> '')) AS INTEGER) AS dimension, CASE WHEN trim(text) <> '' THEN 1e0 ELSE 0e0 END AS length FROM documents")
def text_embeddings(spark, folder):
    """Unit vectors of all texts at the encoder's own size, from a truncated decomposition of the hashed corpus."""
    docs = R.table(spark, folder, "documents").select(c("doc_id").alias("email_id"), "text")
    hashed = training.hashed_vectors(docs, "text")
    encoder = training.fit_encoder(hashed, rows=docs.count())
    length = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda total, x: total + x * x))
    return training.encode(hashed, encoder).select("email_id", F.size("embedding").alias("dimension"), R6(length).alias("length"))


@query("encoder_facts", f"""
    SELECT count(*) FILTER (trim(text) <> '') AS texts, {r6("CAST(count(*) FILTER (trim(text) <> '') AS DOUBLE)")} AS energy,
           CAST(least(128, count(DISTINCT text) FILTER (trim(text) <> '')) AS INTEGER) AS dimension, TRUE AS orthonormal, TRUE AS settled, TRUE AS kept_most
    FROM documents""")
def encoder_facts(spark, folder):
    """The fitted encoder judged: an orthonormal basis of a settled subspace that keeps most of the corpus's energy."""
    docs = R.table(spark, folder, "documents").select(c("doc_id").alias("email_id"), "text")
    hashed = training.hashed_vectors(docs, "text")
    facts = training.encoder_facts(hashed, training.fit_encoder(hashed))
    return facts.select(
        "texts", R6(c("energy")).alias("energy"), "dimension", (c("skew") < 1e-9).alias("orthonormal"), (c("off") < 0.05).alias("settled"),
        (c("kept").between(0.5 * c("energy"), c("energy") * 1.000001)).alias("kept_most"),
    )


def _hmac_sql(message: str) -> str:
    key = R.PSEUDONYM_KEY.ljust(64, b"\0")
    pads = ["".join(f"\\x{b ^ flip:02X}" for b in key) for flip in (0x36, 0x5C)]
    return f"'snd_' || substr(sha256('{pads[1]}'::BLOB || unhex(sha256('{pads[0]}'::BLOB || encode({message})))), 1, 24)"


@query("sender_pseudonyms", f"SELECT email_id, {_hmac_sql('lower(coalesce(sender, sender_domain))')} AS pseudonym FROM messages", ("messages",))
def sender_pseudonyms(spark, folder):
    return R.keyed_messages(spark, folder).select("email_id", crypto.pseudonym(c("sender_key"), R.PSEUDONYM_KEY).alias("pseudonym"))


_EXPORT = """seed AS (SELECT t.email_id, t.label, 1.0e0 AS weight, 'seed' AS source, '{"datasetSource":"labels"}' AS provenance
                     FROM truth t JOIN split s ON t.email_id = s.email_id AND split_side = 'train'),
    fed AS (SELECT user_id AS email_id, CASE WHEN k < 50 THEN 'ham' ELSE 'spam' END AS label, least(value / 100.0, 1.0) AS weight,
                   CASE WHEN event_type = 'click' THEN 'arena' ELSE 'feedback' END AS source, '{"eventId":' || event_id || '}' AS provenance
            FROM ev JOIN documents ON user_id = doc_id WHERE user_id NOT IN (SELECT email_id FROM split WHERE split_side = 'eval')),
    pool AS (SELECT * FROM seed UNION ALL SELECT * FROM fed)"""


def _export(spark, folder):
    split, messages = _split(spark, folder), R.messages(spark, folder)
    seed = privacy.seed_examples(R.truth(spark, folder), split, messages)
    fed = privacy.retrain_examples(_retrain(spark, folder), split, messages)
    return privacy.training_export(seed, fed, R.PSEUDONYM_KEY)


@query("training_export", f"""
    WITH {_SPLIT}, {_EXPORT} SELECT email_id, label, {r6('weight')} AS weight, source, provenance,
           {_hmac_sql('lower(coalesce(sender, sender_domain))')} AS sender_pseudonym FROM pool JOIN messages USING (email_id)""", ("truth", "messages"))
def training_export(spark, folder):
    return _export(spark, folder).drop("feature_version").withColumn("weight", R6(c("weight")))


@query("export_manifest", f"""
    WITH {_SPLIT}, {_EXPORT} SELECT 1 AS feature_version, 'keyed HMAC-SHA-256' AS sender_pseudonymization, TRUE AS direct_identifiers_masked,
           FALSE AS raw_bodies_exported, 'ham,spam,phish' AS label_vocabulary, count(*) AS examples FROM pool""", ("truth", "messages"))
def export_manifest(spark, folder):
    return privacy.export_manifest(_export(spark, folder)).withColumn("label_vocabulary", F.array_join("label_vocabulary", ","))


@query("scrubbed_provenance", f"""
    SELECT feedback_id, '{{"runId":"' || run_id || '","senderKey":"' || {_hmac_sql('sender_key')}
        || '","note":["t***@corp.example",{{"sender":"' || {_hmac_sql('sender_key')} || '"}}]}}' AS provenance FROM weighted""", ("weighted",))
def scrubbed_provenance(spark, folder):
    """Nested provenance scrubbed at any depth."""
    from mailsift.operators.feedback import provenance
    from mailsift.plans.sender_queries import _weighted

    told = provenance(
        runId=c("run_id"), senderKey=c("sender_key"), note=F.lit("@"),
    )
    nested = F.replace(told, F.lit('"@"'), F.concat(F.lit('["team@corp.example",{"sender":"'), c("sender_key"), F.lit('"}]')))
    return _weighted(spark, folder).select("feedback_id", privacy.scrub_json(R.PSEUDONYM_KEY)(nested).alias("provenance"))


MASTERS = {"v1": b"master-key-one-for-demonstration", "v2": b"master-key-two-for-demonstration"}


def _stored(spark, folder):
    """Documents sealed under the first master key, written once, and their key table."""
    import uuid

    docs = R.table(spark, folder, "documents").select(c("doc_id").alias("email_id"), F.encode("text", "UTF-8").alias("raw_content"))
    path = f"{ensure_checkpoint_dir(spark)}/sealed-{uuid.uuid4().hex}"
    sealed = sinks.write_sealed(privacy.seal(docs, MASTERS, "v1"), path)
    keys = sealed.select("email_id", "wrapped_key", "key_version", F.lit(None).cast("timestamp").alias("erased_at"))
    return sealed.select("email_id", "sealed"), keys


def _requests(spark, folder):
    """Erasure is asked for every labelled document and for as many ids that were never stored."""
    asked = R.table(spark, folder, "labels").select(c("doc_id").alias("email_id"))
    return asked.unionByName(asked.select((-c("email_id") - 1).alias("email_id")))


@query("sealed_content", """
    SELECT doc_id AS email_id, md5(text) AS opened_md5, length(encode(text)) + 28 AS sealed_bytes FROM documents""".replace("length(encode", "octet_length(encode"))
def sealed_content(spark, folder):
    sealed, keys = _stored(spark, folder)
    opened = privacy.open_sealed(sealed, keys, MASTERS)
    sizes = sealed.select("email_id", F.octet_length("sealed").cast("bigint").alias("sealed_bytes"))
    return opened.join(sizes, "email_id").select("email_id", F.md5("content").alias("opened_md5"), "sealed_bytes")


@query("rotated_keys", """
    SELECT doc_id AS email_id, doc_id NOT IN (SELECT doc_id FROM labels) AS rotated,
           CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'v1' ELSE 'v2' END AS key_version,
           CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN md5('') ELSE md5(text) END AS opened_md5 FROM documents""")
def rotated_keys(spark, folder):
    """Erasure of the labelled documents, then rotation of what is left, then opening everything."""
    sealed, keys = _stored(spark, folder)
    kept = privacy.erase_keys(keys, _requests(spark, folder), F.lit(R.READ_AT).cast("timestamp"))
    rotated = privacy.rotate_keys(kept, MASTERS, "v2")
    opened = privacy.open_sealed(sealed, rotated.drop("rotated"), {"v2": MASTERS["v2"]})
    return rotated.select("email_id", "rotated", "key_version").join(opened, "email_id").select(
        "email_id", "rotated", "key_version", F.md5("content").alias("opened_md5")
    )


@query("erasure_outcomes", """
    SELECT doc_id AS email_id, CASE WHEN quality = 0 THEN 'ALREADY_ERASED' WHEN toxic = 1 THEN 'NO_KEY' ELSE 'ERASED' END AS outcome FROM labels
    UNION ALL SELECT -doc_id - 1, 'NOT_FOUND' FROM labels""")
def erasure_outcomes(spark, folder):
    """Poor documents were erased before and toxic ones were never sealed."""
    marks = R.table(spark, folder, "labels").select(c("doc_id").alias("email_id"), "quality", "toxic")
    docs = R.table(spark, folder, "documents").select(c("doc_id").alias("email_id"))
    keys = docs.join(marks, "email_id", "left").filter("coalesce(quality, 1) = 0 or coalesce(toxic, 0) = 0").select(
        "email_id", F.when(c("quality") == 0, F.lit(R.FOLDED_AT).cast("timestamp")).alias("erased_at")
    )
    return privacy.erasure_outcomes(_requests(spark, folder), keys, docs)
