"""A training-corpus pipeline over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns the rows it keeps; every stage's output is written as Parquet and
reread as the next stage's input. All but the last return the columns of ``documents``. A stage handles nulls,
empties, repeats and extra columns as its operator's module states.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from mailsift.llm import bagminhash, kernelquality, pieces_tokenizer, positional, secrets
from mailsift.llm.natives import likely_in
from mailsift.llm.storage import stored
from mailsift.operators.ordered import positions


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _key() -> Column:
    """Id and text of a row."""
    return F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row_key"))


def _split(docs: DataFrame, keys: DataFrame, key: Column, held: Column) -> tuple[DataFrame, DataFrame]:
    """Rows whose ``key`` may be one of the ``held`` keys, and rows whose certainly is none; only the former need a shuffle."""
    hit = likely_in(F.xxhash64(key), keys, F.xxhash64(held))
    return docs.filter(hit), docs.filter(~hit)


def _without(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """``docs`` but for the rows whose id and text are one of ``keys`` (__key); an id may be null."""
    some, rest = _split(docs, keys, _key(), F.col("__key"))
    return some.withColumn("__key", _key()).join(keys, "__key", "left_anti").select(*docs.columns).unionByName(rest)


def _numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with ``__sid``: its id, or behind all ids a number of its own for each text under a null or repeated id.

    Rows equal in id and text are folded to one.
    """
    number = F.col("doc_id").cast("long")
    ids = docs.select(number.alias("doc_id"))
    repeated = stored(ids.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 OR doc_id IS NULL").select(F.struct("doc_id").alias("__id")))
    if repeated.isEmpty():
        return docs.withColumn("__sid", number)
    own = F.struct(number.alias("doc_id"))
    some, rest = _split(docs, repeated, own, F.col("__id"))
    marked = stored(some.withColumn("__id", own).join(repeated.withColumn("__again", F.lit(True)), "__id", "left").drop("__id"))
    odd = marked.filter("__again").drop("__again").withColumn("__key", _key())
    last = F.coalesce(ids.agg(F.max("doc_id")).scalar(), F.lit(0))
    distinct = odd.select("__key").distinct().select("__key", F.col("__key.doc_id").alias("a"), F.col("__key.row_key").alias("b"))
    places = positions(distinct, ["a", "b"]).select("__key", (last + F.col("position")).alias("__sid"))
    plain = marked.filter("__again IS NULL").drop("__again").unionByName(rest).withColumn("__sid", number)
    return plain.unionByName(odd.join(places, "__key").drop("__key").dropDuplicates(["__sid"]))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return kernelquality.accepted(docs, _table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each near-duplicate class, in order of ids; texts under a null or repeated id come last and are
    judged one by one, and rows equal in id and text are one."""
    numbered = _numbered(docs)
    own = F.col("__sid").alias("doc_id")
    classes = bagminhash.near_duplicates(numbered.select(own, "text")).filter("doc_id <> class_id")
    dropped = stored(classes.select(F.col("doc_id").alias("__sid")).distinct())
    some, rest = _split(numbered, dropped, F.col("__sid"), F.col("__sid"))
    return some.join(dropped, "__sid", "left_anti").unionByName(rest, allowMissingColumns=True).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window of words with the benchmark, whether they have an id or not."""
    found = positional.contamination(docs, _table(spark, sf_dir, "benchmark"), keyed=True).filter("n_hit > 0")
    key = F.struct(F.col("doc_id").cast("long").alias("doc_id"), "row_key").alias("__key")
    return _without(docs, stored(found.select(key).distinct()))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets found in them masked."""
    return secrets.masked(docs, stored(secrets.find_secrets(docs)))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their token ids; a column named like one of the encoder's gives way to it."""
    return pieces_tokenizer.encode_texts(docs, keep=tuple(docs.columns))


STAGES = [
    ("quality classifier", quality),
    ("minhash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("secret scans", secret_scan),
    ("sentencepiece encoding", encoding),
]

#: A fitted classifier and a tokenizer model take part, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
