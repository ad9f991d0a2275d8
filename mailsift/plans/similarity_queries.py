"""Queries over fingerprints, vectors and campaigns."""

from __future__ import annotations

from pyspark.sql import functions as F

from mailsift.functions import vectors
from mailsift.operators import campaigns, similarity, vectorjoin
from mailsift.plans import roles as R
from mailsift.plans.common import R6, r6
from mailsift.plans.registry import query

c = F.col
TAU = 0.35

_PRINTS = f"""words AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM documents),
    hashed AS (SELECT token, list_reduce(list_prepend(14695981039346656037::UHUGEINT,
                   list_transform(string_split(token, ''), lambda ch: CAST(ascii(ch) AS UHUGEINT))),
                   lambda h, ch: (xor(h, ch) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT) AS h
               FROM (SELECT DISTINCT token FROM words)),
    votes AS (SELECT doc_id, {', '.join(f'sum(CASE WHEN (h >> {b}) & 1 = 1 THEN 1 ELSE -1 END) > 0 AS b{b}' for b in range(64))}
              FROM words JOIN hashed USING (token) GROUP BY doc_id),
    prints AS (SELECT d.doc_id, coalesce({' + '.join(f"CAST(b{b} AS UBIGINT) * {1 << b}::UBIGINT" for b in range(64))}, 0::UBIGINT) AS fp
               FROM documents d LEFT JOIN votes v ON d.doc_id = v.doc_id)"""


def _prints(spark, folder):
    docs = R.table(spark, folder, "documents").select(c("doc_id").alias("email_id"), "text")
    return similarity.fingerprints(docs, "text")


@query("near_duplicate_neighbours", f"""
    WITH {_PRINTS}, f AS (SELECT fp, count(*) AS copies, min(doc_id) AS first_id FROM prints WHERE fp <> 0 GROUP BY fp)
    SELECT a.first_id, any_value(a.copies) AS copies, count(*) AS neighbours, CAST(sum(b.copies) AS BIGINT) AS near_messages,
           CAST(min(bit_count(CAST(xor(a.fp, b.fp) AS BIT))) AS INTEGER) AS closest, min(b.first_id) AS first_neighbour
    FROM f a JOIN f b ON a.fp <> b.fp AND bit_count(CAST(xor(a.fp, b.fp) AS BIT)) <= 6 GROUP BY a.first_id""")
def near_duplicate_neighbours(spark, folder):
    """For each group of copies, the groups within six bits of it; a group is named by its first document."""
    return similarity.near_duplicate_neighbours(_prints(spark, folder)).drop("fingerprint")


@query("near_duplicate_clusters", f"""
    WITH {_PRINTS}, p AS (SELECT doc_id, fp, epoch_us(ts) // 1000 AS ms FROM prints JOIN events ON doc_id = event_id),
    seen AS (SELECT * FROM p WHERE fp <> 0)
    SELECT p.doc_id AS email_id, CASE WHEN p.fp = 0 THEN 0 ELSE 1 + coalesce(n, 0) END AS cluster_size FROM p LEFT JOIN (
        SELECT a.doc_id, count(*) AS n FROM seen a JOIN seen b ON b.doc_id <> a.doc_id AND b.ms <= a.ms AND a.ms - b.ms < 864000000
               AND bit_count(CAST(xor(a.fp, b.fp) AS BIT)) <= 6 GROUP BY a.doc_id) USING (doc_id)""")
def near_duplicate_clusters(spark, folder):
    """Cluster size on arrival with a ten-day window, for the pace of the event table."""
    prints = _prints(spark, folder).join(R.events(spark, folder).select(c("event_id").alias("email_id"), "ts"), "email_id")
    return similarity.recent_near_duplicates(prints, "ts", 10 * 86_400_000)


_UNIT = """unit AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE) / sqrt(list_sum(list_transform(embedding, lambda y: CAST(y AS DOUBLE) * y)))) AS u FROM embeddings),
    mean AS (SELECT label, i, avg(u[i]) AS m, count(*) AS size FROM unit, (SELECT unnest(range(1, 65)) AS i) GROUP BY ALL),
    centroids AS (SELECT label, max(size) AS size, list(m ORDER BY i) AS v FROM mean GROUP BY label)"""


def _vectors(spark, folder):
    return R.table(spark, folder, "embeddings")


@query("label_centroids", f"""
    WITH {_UNIT}, n AS (SELECT *, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS len FROM centroids)
    SELECT label, size, {r6('v[1] / len')} AS first_value, {r6('v[64] / len')} AS last_value,
           {r6('list_sum(v) / len')} AS total FROM n""")
def label_centroids(spark, folder):
    found = campaigns.centroids(_vectors(spark, folder), "label")
    v = c("centroid")
    return found.select(
        "label", "size", R6(v[0]).alias("first_value"), R6(v[63]).alias("last_value"),
        R6(F.aggregate(v, F.lit(0.0), lambda a, x: a + x)).alias("total"),
    )


@query("centroid_similarity", f"""
    WITH {_UNIT} SELECT vec_id, label, {r6('list_cosine_similarity(u, v)')} AS similarity FROM unit JOIN centroids USING (label)""")
def centroid_similarity(spark, folder):
    centres = campaigns.centroids(_vectors(spark, folder), "label").select("label", "centroid")
    return _vectors(spark, folder).join(centres, "label").select(
        "vec_id", "label", R6(vectors.cosine(c("embedding"), c("centroid"))).alias("similarity")
    )


@query("nearest_vectors", f"""
    WITH {_UNIT}, s AS (SELECT c.label AS query_id, vec_id, round(list_cosine_similarity(u, v), 9) AS similarity FROM unit, centroids c),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS INTEGER) AS rank FROM s)
    SELECT query_id, vec_id, rank, {r6('similarity')} AS similarity FROM r WHERE rank <= 10""")
def nearest_vectors(spark, folder):
    """The ten rows nearest to the centroid of each label, over the whole table."""
    centres = campaigns.centroids(_vectors(spark, folder), "label").select(c("label").alias("query_id"), c("centroid").alias("embedding"))
    found = similarity.nearest_vectors(_vectors(spark, folder), centres, 10)
    return found.withColumn("similarity", R6(c("similarity")))


def _assigned(spark, folder):
    return campaigns.campaign_leaders(_vectors(spark, folder), TAU, key="vec_id")


_LEADERS = f"""unit AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) / sqrt(list_sum(list_transform(embedding, lambda y: CAST(y AS DOUBLE) * y)))) AS u FROM embeddings),
    ranked AS (SELECT *, row_number() OVER (ORDER BY vec_id) AS i FROM unit),
    walk AS (SELECT 1::BIGINT AS i, [{{'id': vec_id, 'u': u}}] AS leaders FROM ranked WHERE i = 1
        UNION ALL SELECT r.i, CASE WHEN list_max(list_transform(leaders, lambda l: round(list_dot_product(l.u, r.u), 9))) >= {TAU}e0
                                   THEN leaders ELSE list_append(leaders, {{'id': r.vec_id, 'u': r.u}}) END
        FROM walk w JOIN ranked r ON r.i = w.i + 1),
    final AS (SELECT unnest(leaders) AS l FROM walk WHERE i = (SELECT count(*) FROM ranked)),
    scored_leaders AS (SELECT vec_id, l.id AS leader, round(list_dot_product(l.u, u), 9) AS s FROM unit, final WHERE l.id <= vec_id),
    best AS (SELECT vec_id, arg_max(leader, {{'s': s, 'k': -leader}}) AS cluster_id, max(s) AS similarity FROM scored_leaders WHERE s >= {TAU}e0 GROUP BY vec_id)"""


@query("campaign_leaders", f"WITH RECURSIVE {_LEADERS} SELECT vec_id, cluster_id, {r6('similarity')} AS similarity FROM best")
def campaign_leaders(spark, folder):
    return _assigned(spark, folder).select("vec_id", "cluster_id", R6(c("similarity")).alias("similarity"))


_CLUSTERED = f"""{_LEADERS},
    means AS (SELECT cluster_id, i, avg(u[i]) AS m, count(*) AS size FROM unit JOIN best USING (vec_id), (SELECT unnest(range(1, 65)) AS i) GROUP BY ALL),
    clusters AS (SELECT cluster_id, max(size) AS size, list(m ORDER BY i) AS v FROM means GROUP BY cluster_id)"""


@query("campaign_clusters", f"WITH RECURSIVE {_CLUSTERED} SELECT cluster_id, size, {r6('v[1] / sqrt(list_sum(list_transform(v, lambda x: x * x)))')} AS first_value FROM clusters")
def campaign_clusters(spark, folder):
    clusters, _ = campaigns.campaign_clusters(_assigned(spark, folder), key="vec_id")
    return clusters.select("cluster_id", "size", R6(c("centroid")[0]).alias("first_value"))


@query("campaign_ids", f"""
    WITH RECURSIVE {_LEADERS}, d AS (SELECT cluster_id, sha256(CAST(vec_id AS VARCHAR)) AS h FROM best),
    p AS (SELECT cluster_id, count(*) || '-' || {" || '-' || ".join(f"sum(CAST('0x' || substr(h, {8 * i + 1}, 8) AS BIGINT))" for i in range(8))} AS joined
          FROM d GROUP BY cluster_id), h AS (SELECT cluster_id, md5(joined) AS m FROM p)
    SELECT cluster_id, substr(m, 1, 8) || '-' || substr(m, 9, 4) || '-3' || substr(m, 14, 3) || '-'
           || substr('89ab', 1 + (CAST('0x' || substr(m, 17, 1) AS INTEGER) & 3), 1) || substr(m, 18, 3) || '-' || substr(m, 21, 12) AS campaign_id
    FROM h""")
def campaign_ids(spark, folder):
    """Each campaign named by its members."""
    return campaigns.campaign_ids(_assigned(spark, folder), key="vec_id")


@query("campaign_membership", f"""
    WITH RECURSIVE {_CLUSTERED} SELECT vec_id, cluster_id, size, {r6('list_cosine_similarity(u, v)')} AS similarity
    FROM unit JOIN best USING (vec_id) JOIN clusters USING (cluster_id) WHERE vec_id IN (SELECT doc_id FROM labels)""")
def campaign_membership(spark, folder):
    """Cluster of every labelled message."""
    clusters, members = campaigns.campaign_clusters(_assigned(spark, folder), key="vec_id")
    version = F.lit("v1").alias("model_version")
    asked = R.table(spark, folder, "labels").select(c("doc_id").alias("vec_id"))
    found = campaigns.membership(members.select("*", version), clusters.select("*", version), asked, "v1", "vec_id")
    return found.withColumn("similarity", R6(c("similarity")))


_CLASSES = """first AS (SELECT min(vec_id) AS id, embedding FROM embeddings GROUP BY embedding),
    u AS (SELECT id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) / sqrt(list_sum(list_transform(embedding, lambda y: CAST(y AS DOUBLE) * y)))) AS u
          FROM first)"""


@query("similar_vectors", f"""
    WITH {_CLASSES} SELECT a.id AS id_a, b.id AS id_b, {r6('round(list_dot_product(a.u, b.u), 9)')} AS similarity
    FROM u a JOIN u b ON a.id < b.id AND round(list_dot_product(a.u, b.u), 9) >= {TAU}e0""")
def similar_vectors(spark, folder):
    """All pairs of different vectors whose cosine reaches the threshold; copies are one class."""
    pairs = vectorjoin.cosine_join(vectorjoin.vector_classes(_vectors(spark, folder)), TAU)
    return pairs.withColumn("similarity", R6(c("similarity")))


@query("vector_links", f"""
    WITH {_CLASSES}, p AS (SELECT a.id AS a, b.id AS b FROM u a JOIN u b ON a.id < b.id AND round(list_dot_product(a.u, b.u), 9) >= {TAU}e0),
    n AS (SELECT id, count(*) AS links FROM (SELECT a AS id FROM p UNION ALL SELECT b FROM p) GROUP BY id)
    SELECT vec_id, first.id AS class_id, coalesce(links, 0) AS links FROM embeddings JOIN first USING (embedding) LEFT JOIN n ON n.id = first.id""")
def vector_links(spark, folder):
    """Every row with its class and how many other classes are close to it."""
    classes = vectorjoin.vector_classes(_vectors(spark, folder))
    counts = vectorjoin.close_counts(classes, TAU).withColumnRenamed("id", "class_id")
    return classes.join(counts, "class_id", "left").select("vec_id", "class_id", F.coalesce("links", F.lit(0)).alias("links"))


@query("running_campaigns", f"""
    WITH RECURSIVE unit AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)
                                / sqrt(list_sum(list_transform(embedding, lambda y: CAST(y AS DOUBLE) * y)))) AS u FROM embeddings),
    ranked AS (SELECT *, row_number() OVER (ORDER BY vec_id) AS i FROM unit),
    walk AS (SELECT 1::BIGINT AS i, [{{'id': vec_id, 's': u, 'c': u}}] AS held, vec_id AS cluster_id, 1e0 AS similarity FROM ranked WHERE i = 1
        UNION ALL SELECT i, CASE WHEN top >= {TAU}e0 THEN list_concat(list_concat(held[1:spot - 1], [{{'id': held[spot].id, 's': grown,
                  'c': list_transform(grown, lambda x: x / sqrt(list_dot_product(grown, grown)))}}]), held[spot + 1:len(held)])
                  ELSE list_append(held, {{'id': vec_id, 's': u, 'c': u}}) END,
             CASE WHEN top >= {TAU}e0 THEN held[spot].id ELSE vec_id END, CASE WHEN top >= {TAU}e0 THEN top ELSE 1e0 END
        FROM (SELECT *, list_transform(held[spot].s, lambda x, k: x + u[k]) AS grown FROM (
              SELECT *, list_max(scores) AS top, list_position(scores, list_max(scores)) AS spot FROM (
              SELECT r.i, r.vec_id, r.u, held, list_transform(held, lambda h: round(list_dot_product(h.c, r.u), 9)) AS scores
              FROM walk w JOIN ranked r ON r.i = w.i + 1))))
    SELECT vec_id, walk.cluster_id, {r6('similarity')} AS similarity FROM walk JOIN ranked USING (i)""")
def running_campaigns(spark, folder):
    """Greedy clustering around running centroids, in id order."""
    found = campaigns.running_campaigns(_vectors(spark, folder), TAU, key="vec_id")
    return found.select("vec_id", "cluster_id", R6(c("similarity")).alias("similarity"))
