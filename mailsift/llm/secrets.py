"""Secret scan with corpus-wide ownership frequency.

Base spans of a text, leftmost and non-overlapping per kind: ``assign`` (a credential word, an equals sign or colon, a
value of 12 or more), ``access`` (AKIA keys) and ``hex`` (16 or more). The method adds ``live`` spans. Its candidates
are long unbroken tokens that mix letters and digits and are no plain words; every candidate's hash is counted over
the distinct repositories and the distinct owners it appears with. One that at least ``COPIED_OWNERS`` owners hold is
a widely copied example and adds nothing; one that fewer hold looks like a live credential of its owner, in however
many repositories it stands. Base spans stay either way and carry the same judgement.

DataFrame functions only. A text is scanned once; a narrow table of match pieces is kept, and positions are running
sums over the pieces of one document. Distinct counts are made by two aggregates with partial sums; a candidate that
a third of the corpus holds meets its counts in a join that can be split.

Nulls, empties, repeats: a null text is empty. A null owner or repository is no owner or repository. Rows with equal
id and text are repeated in the result and count once. Very long texts are scanned whole. Spans that start alike are ordered
by kind. An empty table gives no rows. Extra columns, of any name, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from mailsift.llm.natives import likely_in
from mailsift.llm.storage import stored

# The kinds in their listed order and their patterns.
KINDS = ("assign", "access", "hex", "live")
WORDS = r"((?i:password|passwd|secret|token|api_?key))"
ASSIGN = WORDS + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"
TOKEN = r"[A-Za-z0-9_-]{20,}"

COPIED_OWNERS = 3
_DOC = ["doc_id", "row_key"]


def _pieces(text: Column, kind: str, pattern: str, group: int) -> Column:
    """Lengths of the stretches between matches, the matches, and their values; null where nothing matches."""
    lengths = F.transform(F.split(text, pattern, -1), lambda gap: F.char_length(gap))
    found = F.struct(
        F.lit(kind).alias("kind"), lengths.alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("matches"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("values"),
    )
    return F.when(text.rlike(pattern), found)


def scan(docs: DataFrame, repository: str, owner: str) -> DataFrame:
    """One narrow row per document: its keys, repository, owner and the match pieces of every kind."""
    text = F.coalesce(F.col("text"), F.lit(""))
    kinds = zip(KINDS, (ASSIGN, ACCESS, HEX, TOKEN), (2, 0, 0, 0))
    found = F.array_compact(F.array(*(_pieces(F.col("body"), *kind) for kind in kinds)))
    keyed = docs.select(
        "doc_id", F.xxhash64("text").alias("row_key"), text.alias("body"),
        F.col(repository).cast("string").alias("repository"), F.col(owner).cast("string").alias("owner"),
    )
    return keyed.select(*_DOC, "repository", "owner", found.alias("found"))


def locate(scanned: DataFrame) -> DataFrame:
    """(doc_id, row_key, kind, start, end, value): spans that pass their kind's test, in code points, end exclusive."""
    each = scanned.filter(F.size("found") > 0).select(*_DOC, "found").dropDuplicates(_DOC).select(*_DOC, F.explode("found").alias("f"))
    rows = each.select(
        *_DOC, "f.kind", F.posexplode(F.arrays_zip("f.gaps", "f.matches", "f.values")).alias("place", "piece")
    ).select("*", "piece.*").filter("matches IS NOT NULL")
    before = Window.partitionBy(*_DOC, "kind").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    size = F.char_length("matches")
    end = F.sum(F.col("gaps") + size).over(before)
    spans = rows.select(*_DOC, "kind", (end - size).alias("start"), end.alias("end"), F.col("values").alias("value"))
    length = F.char_length("value")
    mixed = F.col("value").rlike("[0-9].*[0-9].*[0-9]") & F.col("value").rlike("[A-Za-z].*[A-Za-z].*[A-Za-z]")
    return spans.filter(
        F.when(F.col("kind") == "assign", length >= 12).when(F.col("kind") == "access", length >= 18)
        .when(F.col("kind") == "live", mixed).otherwise(F.lit(True))
    )


def ownership(spans: DataFrame, scanned: DataFrame) -> DataFrame:
    """(digest, owners, repositories) of every candidate value over the whole corpus."""
    holders = scanned.filter(F.size("found") > 0).select(F.struct(*_DOC).alias("doc_key"), "repository", "owner").distinct()
    held = spans.select(F.struct(*_DOC).alias("doc_key"), F.sha2("value", 256).alias("digest")).distinct()
    return held.join(holders, "doc_key").groupBy("digest").agg(
        F.count_distinct("owner").alias("owners"), F.count_distinct("repository").alias("repositories")
    )


def find_secrets(
    docs: DataFrame, repository: str = "doc_id", owner: str = "source", copied_owners: int = COPIED_OWNERS,
) -> DataFrame:
    """doc_id, row_key and spans (start, rank of the kind, kind, end, digest, copied) of every row, in order."""
    scanned = stored(scan(docs, repository, owner))
    spans = stored(locate(scanned).withColumn("digest", F.sha2("value", 256)))
    copied = F.col("owners") >= copied_owners
    judged = spans.join(ownership(spans, scanned).select("digest", copied.alias("copied")), "digest")
    kept = judged.filter((F.col("kind") != "live") | ~F.col("copied"))
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int")
    per_text = kept.groupBy(F.struct(*_DOC).alias("doc_key")).agg(
        F.sort_array(F.collect_list(F.struct("start", rank.alias("rank"), "kind", "end", "digest", "copied"))).alias("spans")
    )
    empty = F.filter(F.array(F.struct(
        F.lit(0).cast("long").alias("start"), F.lit(0).alias("rank"), F.lit("").alias("kind"), F.lit(0).cast("long").alias("end"),
        F.lit("").alias("digest"), F.lit(False).alias("copied"))), lambda _: F.lit(False))
    rows = scanned.select(*_DOC, F.struct(*_DOC).alias("doc_key"))
    return rows.join(per_text, "doc_key", "left").select(*_DOC, F.coalesce("spans", empty).alias("spans"))


def listed(spans: Column) -> Column:
    """``kind:start:end`` of the spans, comma-joined."""
    name = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, name), ",")


def masked(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` with every found span replaced: ``[SECRET]``, or ``[EXAMPLE]`` where all of it is widely copied.

    A column ``n_chars`` is kept true. Only rows that may hold a span are shuffled.
    """
    apart = found.filter(F.size("spans") > 0).dropDuplicates(_DOC).select(*_DOC, F.explode("spans").alias("s")).select(*_DOC, "s.*")
    so_far = Window.partitionBy(*_DOC).orderBy("start", "rank").rowsBetween(Window.unboundedPreceding, -1)
    fresh = (F.col("start") >= F.coalesce(F.max("end").over(so_far), F.lit(-1))).cast("int")
    island = F.sum("fresh").over(Window.partitionBy(*_DOC).orderBy("start", "rank"))
    merged = apart.withColumn("fresh", fresh).withColumn("island", island).groupBy(*_DOC, "island").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.min("copied").alias("copied")
    )
    cuts = merged.groupBy(F.struct(*_DOC).alias("__doc_key")).agg(F.sort_array(F.collect_list(F.struct("start", "end", "copied"))).alias("__cuts"))
    code = F.xxhash64("doc_id", F.xxhash64("text"))
    hit = likely_in(code, cuts, F.xxhash64("__doc_key.doc_id", "__doc_key.row_key"))
    rows = docs.filter(hit).withColumn("__doc_key", F.struct("doc_id", F.xxhash64("text").alias("row_key")))
    mark = lambda c: F.when(c["copied"], F.lit("[EXAMPLE]")).otherwise(F.lit("[SECRET]"))
    previous = lambda i: F.coalesce(F.get("__cuts", i - 1)["end"], F.lit(0))
    head = F.transform("__cuts", lambda c, i: F.concat(
        F.substring(F.col("text"), (previous(i) + 1).cast("int"), (c["start"] - previous(i)).cast("int")), mark(c)))
    last = F.element_at("__cuts", -1)["end"]
    tail = F.substring(F.col("text"), (last + 1).cast("int"), F.char_length("text"))
    text = F.when(F.col("__cuts").isNull(), F.col("text")).otherwise(F.concat(F.array_join(head, ""), tail))
    changed = rows.join(cuts, "__doc_key", "left").withColumn("text", text)
    if "n_chars" in docs.columns:
        size = F.when(F.col("__cuts").isNull(), F.col("n_chars")).otherwise(F.char_length("text"))
        changed = changed.withColumn("n_chars", size.cast(docs.schema["n_chars"].dataType))
    return changed.select(*docs.columns).unionByName(docs.filter(~hit))
