"""The registered queries of this subpackage; each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from mailsift.llm import bagminhash, factormachine, hardnegatives, kernelquality, pieces_tokenizer, positional, secrets, substrings, suffixtree, tokenfiles, topk, turnrepair, urlmodel

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(build: Query) -> Query:
        QUERIES[name] = build
        if sql is not None:
            SQL[name] = sql
        return build

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op8_near_duplicates")
def op8_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return bagminhash.near_duplicates(table(spark, folder, "documents"))


@query("op7_substring_dedup")
def op7_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    kept = substrings.remove_repeats(table(spark, folder, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query("op2_suffix_tree_scores")
def op2_suffix_tree_scores(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    scored = suffixtree.score_corpus(docs, suffixtree.held_out(F.col("doc_id")))
    return scored.withColumn("held_out", suffixtree.held_out(F.col("doc_id")))


@query("op3_benchmark_decontamination", r"""
    WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
    b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
    bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
           FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
    sizes AS (SELECT DISTINCT n FROM bw),
    dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
           FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
    hits AS (SELECT dw.doc_id, item_id, i, dw.n FROM dw JOIN bw ON dw.g = bw.g AND dw.n = bw.n),
    covered AS (SELECT doc_id, count(*) AS n_hit FROM
                (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
    items AS (SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS ids
              FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS k FROM hits) GROUP BY doc_id)
    SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
           sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
    """)
def op3_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = positional.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


# The same models level by level; ^B stands for what is before the start.
_URL_LEVELS = """
    l{k} AS (SELECT right(gram, {k} + 1) AS g, left(right(gram, {k} + 1), {k}) AS c, sum(a) AS a, sum(r) AS r FROM top GROUP BY 1, 2),
    s{k} AS (SELECT c, sum(a) AS ca, sum(r) AS cr, count(*) AS kinds, count(*) FILTER (a > 0) AS ta, count(*) FILTER (r > 0) AS tr
             FROM l{k} GROUP BY c),"""
_URL_BLEND = """
    p{k} AS (SELECT l{k}.g, CASE WHEN ca > 0 THEN (a + ta * pa) / (ca + ta) ELSE pa END AS pa,
                    CASE WHEN cr > 0 THEN (r + tr * pr) / (cr + tr) ELSE pr END AS pr
             FROM l{k} JOIN s{k} USING (c) JOIN p{b} ON substr(l{k}.g, 2) = p{b}.g),"""


def _url_sql(order: int = urlmodel.ORDER) -> str:
    levels = "".join(_URL_LEVELS.format(k=k) + (_URL_BLEND.format(k=k, b=k - 1) if k else """
    p0 AS (SELECT g, (a + 1e0) / (ca + kinds + 1e0) AS pa, (r + 1e0) / (cr + kinds + 1e0) AS pr FROM l0 JOIN s0 USING (c)),""")
        for k in range(order + 1))
    fits = "\n".join(
        f"""WHEN (host = '{r.partition("/")[0]}' OR ends_with(host, '.{r.partition("/")[0]}'))
                AND starts_with(path, '/{r.partition("/")[2]}') THEN '{r}'"""
        for r, _ in sorted(urlmodel.RULES, key=lambda x: -len(x[0]))
    )
    judged = " ".join(f"WHEN '{r}' THEN '{v}'" for r, v in urlmodel.RULES)
    return rf"""
    WITH parts AS (SELECT page_id, url,
                          translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1),
                                    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                          regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
    ruled AS (SELECT *, CASE {fits} END AS rule FROM parts),
    judged AS (SELECT *, CASE rule {judged} END AS verdict FROM ruled),
    keyed AS (SELECT url, verdict, verdict IS NOT NULL AND CAST('0x' || substr(md5(url), 1, 8) AS BIGINT) % {urlmodel.PARTS} = 0 AS held
              FROM (SELECT DISTINCT url, verdict FROM judged WHERE url IS NOT NULL)),
    grams AS (SELECT url, verdict, held, substr(repeat(chr(2), {order}) || url, i, {order} + 1) AS gram
              FROM (SELECT *, unnest(range(1, length(url) + 1)) AS i FROM keyed)),
    top AS (SELECT gram, count(*) FILTER (NOT held AND verdict = 'allow') AS a, count(*) FILTER (NOT held AND verdict = 'block') AS r
            FROM grams GROUP BY gram),
    {levels}
    scored AS (SELECT url, verdict, avg(log10(pa) - log10(pr)) AS score FROM grams JOIN p{order} ON gram = g
               WHERE held OR verdict IS NULL GROUP BY ALL),
    stats AS (SELECT avg(score) FILTER (verdict = 'allow') AS ma, avg(score) FILTER (verdict = 'block') AS mr,
                     count(*) FILTER (verdict = 'allow') AS na, count(*) FILTER (verdict = 'block') AS nr,
                     coalesce(var_pop(score) FILTER (verdict = 'allow'), 0) AS va,
                     coalesce(var_pop(score) FILTER (verdict = 'block'), 0) AS vr FROM scored),
    cut AS (SELECT CASE WHEN ma > mr THEN (ma + mr) / 2
                        - ((va * na + vr * nr) / (na + nr)) * ln(CAST(na AS DOUBLE) / nr) / (ma - mr) ELSE 0 END AS t FROM stats)
    SELECT page_id, host, path, rule,
           coalesce(judged.verdict, CASE WHEN coalesce(score, 0) < t THEN 'block' ELSE 'allow' END) AS verdict
    FROM judged LEFT JOIN (SELECT url, score FROM scored WHERE verdict IS NULL) USING (url), cut
    """


@query("op1_url_filter", _url_sql())
def op1_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return urlmodel.judge_urls(table(spark, folder, "pages")).select("page_id", "host", "path", "rule", "verdict")


def _secret_sql() -> str:
    patterns = {
        "assign": (r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|"""
                   r"""[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, "length(v) >= 12"),
        "access": (r"AKIA[A-Z0-9]+", 0, "length(v) >= 18"),
        "hex": (r"[0-9a-f]{16,}", 0, "true"),
        "live": (r"[A-Za-z0-9_-]{20,}", 0,
                 "regexp_matches(v, '[0-9].*[0-9].*[0-9]') AND regexp_matches(v, '[A-Za-z].*[A-Za-z].*[A-Za-z]')"),
    }
    each = " UNION ALL ".join(
        f"""SELECT doc_id, source, {n} AS rank, '{kind}' AS kind, m, v, list_sum([length(x) for x in g[1:i]]) AS gap,
                   coalesce(list_sum([length(x) for x in ms[1:i - 1]]), 0) AS done
            FROM (SELECT doc_id, source, g, ms, i, ms[i] AS m, vs[i] AS v FROM (
                  SELECT doc_id, source, string_split_regex(t, '{p}') AS g, regexp_extract_all(t, '{p}') AS ms,
                         regexp_extract_all(t, '{p}', {group}) AS vs, unnest(range(1, len(regexp_extract_all(t, '{p}')) + 1)) AS i
                  FROM d)) WHERE {test}"""
        for n, (kind, (p, group, test)) in enumerate(patterns.items(), 1)
    )
    return f"""
    WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
    spans AS (SELECT doc_id, source, rank, kind, v, CAST(gap + done AS BIGINT) AS s, CAST(gap + done + length(m) AS BIGINT) AS e FROM ({each})),
    own AS (SELECT v, count(DISTINCT source) >= {secrets.COPIED_OWNERS} AS copied
            FROM spans GROUP BY v),
    kept AS (SELECT * FROM spans JOIN own USING (v) WHERE kind <> 'live' OR NOT copied),
    listed AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
                      count(*) FILTER (kind = 'hex') AS n_hex,
                      string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) FILTER (kind <> 'live') AS base,
                      string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) AS spans FROM kept GROUP BY doc_id)
    SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
           sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
    FROM documents LEFT JOIN listed USING (doc_id)
    """


@query("op4_secret_scan", _secret_sql())
def op4_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, folder, "documents"))
    number = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] != "live")
    return found.select(
        "doc_id", number("assign").alias("n_assign"), number("access").alias("n_access"), number("hex").alias("n_hex"),
        F.sha2(secrets.listed(base), 256).alias("base_sha256"), secrets.listed(F.col("spans")).alias("spans"),
    )


@query("op6_exact_top_k", """
    WITH v AS (SELECT vec_id, [CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT) FOR x IN embedding] AS w FROM embeddings
               WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
                 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
    terms AS (SELECT vec_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS t FROM v),
    pairs AS (SELECT q.vec_id AS query_id, c.vec_id, sum(q.x * c.x) AS score FROM terms q JOIN terms c ON q.t = c.t
              WHERE q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id GROUP BY 1, 2),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs)
    SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= 5
    """)
def op6_exact_top_k(spark: SparkSession, folder: str) -> DataFrame:
    return topk.top_k(table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0)


@query("op5_quality_classifier")
def op5_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    return kernelquality.quality_scores(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op10_toxicity")
def op10_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return factormachine.toxicity_scores(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op9_sentencepiece")
def op9_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    return pieces_tokenizer.encode_texts(table(spark, folder, "documents"))


@query("op11_token_files")
def op11_token_files(spark: SparkSession, folder: str) -> DataFrame:
    path = tokenfiles.new_folder(spark)
    tokenfiles.write_tokens(table(spark, folder, "documents"), path)
    read = tokenfiles.read_tokens(spark, path)
    return read.select("doc_id", "start", "n_tokens", F.crc32("packed").alias("ids_crc32"))


def _crc32_sql(text: str) -> str:
    """CRC-32 of ASCII text, byte by byte over the table of the polynomial 0xEDB88320."""
    entries = []
    for value in range(256):
        for _ in range(8):
            value = value >> 1 ^ (0xEDB88320 if value & 1 else 0)
        entries.append(value)
    listed = ", ".join(map(str, entries))
    step = f"lambda c, b: xor(c >> 8, ([{listed}])[(xor(c, b) & 255) + 1])"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, [ascii(x)::BIGINT FOR x IN string_split({text}, '')]), {step}), 4294967295)"


def _repair_sql() -> str:
    def plus(cost: str, letter: str, value: str) -> str:
        return f"printf('%08d', CAST({value}[:8] AS INTEGER) + {cost}) || '{letter}' || {value}[9:]"

    reached = {"b": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    given = {"b": "u", "s": "u", "u": "a", "a": "u"}
    stays = "CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END"
    base = []
    for state in "bsua":
        ways = [plus("2", "D", f"v.{state}")]
        ways += [f"CASE WHEN may AND role[:1] = '{i}' THEN {plus(stays, 'K', f'v.{to}')} END" for i, to in reached[state].items()]
        ways += [f"CASE WHEN may THEN {plus(f'1 + {stays}', 'R', f'v.{given[state]}')} END"]
        base.append(f"least({', '.join(ways)}) AS {state}")
    more = lambda state, after: f"least({state}, {plus('5', 'I', after)}) AS {state}"
    follows = " ".join(f"WHEN '{s}' THEN '{t}'" for s, t in given.items())
    return rf"""
    WITH RECURSIVE src AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                {_crc32_sql("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS fate FROM conversations),
    d AS (SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
                 CASE fate WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
                 unnest(range(CASE WHEN fate = 3 THEN 2 ELSE 1 END)) AS copy FROM src WHERE fate <> 0),
    n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(role || chr(0) || text), copy) AS pos FROM d),
    f AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
                         WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'duplicate'
                         WHEN regexp_extract(text, '(?s)([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault,
                 lag(role) OVER (PARTITION BY conv_id ORDER BY pos) AS before FROM n),
    g AS (SELECT *, coalesce(fault NOT IN ('blank', 'duplicate'), true) AS may FROM f),
    counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
                      count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
                      count(*) FILTER (pos > 1 AND before[:1] || role[:1] NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS rows
               FROM f GROUP BY conv_id),
    v AS (SELECT conv_id, rows + 1 AS pos, '00000000' AS b, '00000010II' AS s, '00000005I' AS u, '00000000' AS a FROM counts
          UNION ALL
          SELECT conv_id, pos, {more('b', 'u')}, {more('s', 'u')}, u, a FROM (
            SELECT conv_id, pos, b, s, {more('u', 'a')}, {more('a', 'u')} FROM (
              SELECT g.conv_id, g.pos, {", ".join(base)} FROM v JOIN g ON g.conv_id IS NOT DISTINCT FROM v.conv_id AND g.pos = v.pos - 1))),
    best AS (SELECT conv_id, CAST(b[:8] AS BIGINT) AS cost, b[9:] AS audit FROM v WHERE pos = 1),
    walk AS (SELECT conv_id, 0 AS i, 0::BIGINT AS pos, 'b' AS state, NULL::VARCHAR AS line FROM best
             UNION ALL
             SELECT x.conv_id, x.i, x.pos,
                    CASE x.letter WHEN 'D' THEN x.state WHEN 'K' THEN g.role[:1] ELSE x.goes END,
                    CASE x.letter WHEN 'K' THEN g.role || ':' || g.text
                         WHEN 'R' THEN CASE x.goes WHEN 'u' THEN 'user:' ELSE 'assistant:' END || g.text
                         WHEN 'I' THEN CASE x.goes WHEN 'u' THEN 'user:' ELSE 'assistant:' END END
             FROM (SELECT walk.conv_id, i + 1 AS i, pos + CASE WHEN audit[i + 1] = 'I' THEN 0 ELSE 1 END AS pos, state, audit[i + 1] AS letter,
                          CASE state {follows} END AS goes
                   FROM walk JOIN best ON walk.conv_id IS NOT DISTINCT FROM best.conv_id WHERE i < length(audit)) x
             LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM x.conv_id AND g.pos = x.pos),
    lines AS (SELECT conv_id, string_agg(line, chr(10) ORDER BY i) AS whole FROM walk WHERE line IS NOT NULL GROUP BY conv_id)
    SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
           coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit,
           sha256(coalesce(whole, '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) o
    LEFT JOIN counts ON o.conv_id IS NOT DISTINCT FROM counts.conv_id
    LEFT JOIN best ON o.conv_id IS NOT DISTINCT FROM best.conv_id
    LEFT JOIN lines ON o.conv_id IS NOT DISTINCT FROM lines.conv_id
    """


@query("op12_conversation_repair", _repair_sql())
def op12_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations")
    return turnrepair.report(turnrepair.damaged(turns), turns)


@query("op13_hard_negatives", """
    WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                      [CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT) FOR x IN embedding] AS w FROM embeddings
               WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
                 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
    terms AS (SELECT vec_id, label, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS t FROM v),
    pairs AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, sum(a.x * c.x) AS score FROM terms a JOIN terms c ON a.t = c.t
              WHERE a.vec_id % 50 = 0 AND c.vec_id <> a.vec_id GROUP BY 1, 2, 3),
    near AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM pairs WHERE same
             QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
    hard AS (SELECT near.*, vec_id AS negative_id, score AS negative_score,
                    row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS rank
             FROM near JOIN pairs USING (anchor_id)
             WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
    SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, CAST(positive_score AS BIGINT) AS positive_score,
           CAST(negative_score AS BIGINT) AS negative_score FROM hard WHERE rank <= 3
    """)
def op13_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    noisy = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hardnegatives.mine(vectors.withColumn("label", noisy), F.col("vec_id") % 50 == 0)
