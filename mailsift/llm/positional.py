"""Benchmark decontamination with a positional inverted index over the training documents.

``build_index`` stores the postings (term, document, position) that a test set can ask for and one closing row per
document with its length. For phrases a posting is stored where it and a neighbour form a word pair of the test set;
for proximity wherever the word is one of the test set's. Both filters are bit tables of a fixed size made from the
test set: they never lose a posting, and when the test set outgrows them they only keep more.

``phrase_hits`` answers all windows of ``WINDOW`` words of all items: the two rarest terms of each window, by their
stored postings, are looked up first; their positions less their offsets in the item must agree on a diagonal.
Diagonals on which they do are intersected with the postings of all other terms, and runs of agreeing neighbours at
least a window long are exact matches. ``proximity_hits`` looks for all words of an item near its rarest word.

Join keys: the first lookup is by term and takes the rarest ones, later ones by document and position. Hot terms are
left to skew-join splitting; no aggregate needs the rows of a term together.

Nulls, empties, repeats: a null or empty text has no words and no hits. An item without id or words is ignored;
items with one id count once. Rows with equal id and text are repeated in the result. Rows without an id are
documents like others. Very long texts are indexed whole. Terms of equal rarity are taken in order of place. An empty table of
documents gives no rows, an empty benchmark no hits. Extra columns, of any name, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from mailsift.llm.natives import bit_table, fold_ascii, in_table
from mailsift.llm.storage import stored

WINDOW = 10
BITS = 1 << 20
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_DOC = ["doc_id", "row_key"]


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(fold_ascii(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def items_of(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """item_id, words, n and the number of words a match takes, one row per item text."""
    cut = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words_of(F.col("text")).alias("words"))
    sized = cut.filter("item_id IS NOT NULL").withColumn("n", F.size("words")).filter("n > 0").distinct()
    return sized.withColumn("need", F.least("n", F.lit(window))).withColumn("item", F.xxhash64("item_id", "words"))


def build_index(docs: DataFrame, items: DataFrame, adjacent: bool = True, bits: int = BITS) -> DataFrame:
    """Postings (doc_id, row_key, position, term) and closing rows with a null term and the length as position."""
    spark = docs.sparkSession
    split = docs.select("doc_id", F.xxhash64("text").alias("row_key"), words_of(F.col("text")).alias("words"))
    closed = F.concat("words", F.array(F.lit(None).cast("string")))
    rows = split.select(*_DOC, "words", F.posexplode(closed).alias("position", "term"))
    terms = items.select("words", "n", F.posexplode("words").alias("offset", "term"))
    if adjacent:
        # a window of one word has no pair, it is known by itself
        asked = terms.filter("offset + 1 < n").select(F.xxhash64("term", F.get("words", F.col("offset") + 1)).alias("code"))
        asked = asked.union(terms.filter("n = 1").select(F.xxhash64("term")))
        table = bit_table(spark, asked, "code", bits)
        follows, before = F.get("words", F.col("position") + 1), F.get("words", F.col("position") - 1)
        wanted = (
            in_table(table, F.xxhash64("term", follows), bits) | in_table(table, F.xxhash64(before, "term"), bits)
            | in_table(table, F.xxhash64("term"), bits)
        )
    else:
        table = bit_table(spark, terms.select(F.xxhash64("term").alias("code")), "code", bits)
        wanted = in_table(table, F.xxhash64("term"), bits)
    return rows.filter(F.col("term").isNull() | wanted).select(*_DOC, "position", "term")


def _rare_terms(index: DataFrame, items: DataFrame, each: int) -> DataFrame:
    """(item, offset, term): for every window of every item its ``each`` rarest terms."""
    terms = items.select("item", "n", "need", F.posexplode("words").alias("offset", "term"))
    stored = index.filter("term IS NOT NULL").groupBy("term").agg(F.count("*").alias("stored"))
    counted = terms.join(stored, "term", "left").withColumn("stored", F.coalesce("stored", F.lit(0).cast("long")))
    starts = F.sequence(F.greatest(F.col("offset") - F.col("need") + 1, F.lit(0)), F.least("offset", F.col("n") - F.col("need")))
    per_window = counted.select("item", "offset", "term", "stored", F.explode(starts).alias("start")).groupBy("item", "start").agg(
        F.slice(F.sort_array(F.collect_list(F.struct("stored", "offset", "term"))), 1, each).alias("rarest")
    )
    return per_window.select("item", F.explode("rarest").alias("r")).select("item", "r.offset", "r.term").distinct()


def phrase_hits(index: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, row_key, item_id, first, words): maximal runs of a document that are words of an item, a window long at least."""
    postings = index.filter("term IS NOT NULL")
    rare = _rare_terms(index, items, 2)
    diagonal = (F.col("position") - F.col("offset")).alias("diagonal")
    met = postings.join(rare, "term").select(*_DOC, "item", diagonal, "offset").distinct()
    agreeing = met.groupBy(*_DOC, "item", "diagonal").agg(F.count("*").alias("terms"))
    asked = items.select("item", "item_id", "need", F.posexplode("words").alias("offset", "term"))
    likely = agreeing.join(items.select("item", "need"), "item").filter(F.col("terms") >= F.least("need", F.lit(2)))
    expected = likely.select(*_DOC, "item", "diagonal").join(asked, "item").withColumn(
        "position", F.col("diagonal") + F.col("offset")
    )
    key = F.struct(*_DOC).alias("doc_key")  # as a struct, null ids meet too
    left = expected.select("*", key)
    right = postings.select(key, "position", "term")
    matched = left.join(right, ["doc_key", "position", "term"], "left_semi")
    along = Window.partitionBy(*_DOC, "item", "diagonal").orderBy("offset")
    runs = matched.withColumn("run", F.col("offset") - F.row_number().over(along))
    return (
        runs.groupBy(*_DOC, "item", "diagonal", "run")
        .agg(F.min("position").alias("first"), F.count("*").alias("words"), F.max("need").alias("need"), F.max("item_id").alias("item_id"))
        .filter("words >= need").select(*_DOC, "item_id", "first", "words")
    )


def proximity_hits(index: DataFrame, items: DataFrame, slack: int = WINDOW) -> DataFrame:
    """(doc_id, row_key, item_id, position): places of an item's rarest word with all its words at most ``slack`` words away.

    ``index`` must be built with ``adjacent=False``.
    """
    postings = index.filter("term IS NOT NULL")
    whole = items.withColumn("need", F.col("n"))
    rarest = _rare_terms(index, whole, 1).select("item", "term").distinct()
    places = postings.join(rarest, "term").select(F.struct(*_DOC).alias("doc_key"), *_DOC, "item", F.col("position").alias("place"))
    asked = items.select("item", "item_id", F.size(F.array_distinct("words")).alias("distinct"), F.explode(F.array_distinct("words")).alias("term"))
    near = postings.select(F.struct(*_DOC).alias("doc_key"), "term", "position")
    met = places.join(asked, "item").join(near, ["doc_key", "term"]).filter(F.abs(F.col("position") - F.col("place")) <= slack)
    found = met.select(*_DOC, "item", "item_id", "place", "distinct", "term").distinct()
    return (
        found.groupBy(*_DOC, "item", "item_id", "place", "distinct").agg(F.count("*").alias("terms")).filter("terms = distinct")
        .select(*_DOC, "item_id", F.col("place").alias("position"))
    )


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, keyed: bool = False) -> DataFrame:
    """doc_id, n_words, n_hit, items (sorted ids) of every row; ``keyed`` adds row_key, the hash of its text, after doc_id."""
    items = stored(items_of(benchmark, window))
    index = stored(build_index(docs, items))
    hits = stored(phrase_hits(index, items))
    end = F.col("first") + F.col("words").cast("int") - 1
    places = hits.select(*_DOC, F.explode(F.sequence("first", end)).alias("position")).distinct()
    named = hits.select(*_DOC, "item_id").distinct()
    both = places.select(*_DOC, F.lit(1).alias("hit"), F.lit(None).cast("string").alias("item_id")).unionByName(
        named.select(*_DOC, F.lit(0).alias("hit"), "item_id")
    )
    found = both.groupBy(F.struct(*_DOC).alias("doc_key")).agg(
        F.sum("hit").alias("n_hit"), F.sort_array(F.collect_list("item_id")).alias("items")
    )
    heads = index.filter("term IS NULL").select(*_DOC, F.struct(*_DOC).alias("doc_key"), F.col("position").cast("long").alias("n_words"))
    return heads.join(found, "doc_key", "left").select(
        *(_DOC if keyed else _DOC[:1]), "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )
