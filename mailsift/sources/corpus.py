"""Labelled corpus trees and mailbox files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from mailsift import vocabulary as V
from mailsift.functions.text import strip
from mailsift.functions.tiers import lookup


def mailbox_messages(text: Column) -> Column:
    """Messages of a mailbox: cut at ``From `` lines, text before the first dropped, blanks dropped."""
    parts = F.split(text, r"(?md)^From [^\n]*\n?")
    return F.filter(F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), strip), lambda m: F.length(m) > 0)


def corpus_files(spark: SparkSession, root: str) -> DataFrame:
    """Files of ``<root>/<dataset>/<class>/<file>`` with dataset, label and content.

    An unknown class directory is an error, not a skipped file.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    parts = F.split("path", "/")
    folder = F.element_at(parts, -2)
    label = lookup(F.lower(folder), V.CLASS_DIRECTORIES)
    unknown = F.raise_error(F.concat(F.lit("unknown corpus class directory: "), folder))
    return files.select(
        F.element_at(parts, -3).alias("dataset"),
        F.coalesce(label, unknown.cast("string")).alias("label"),
        F.element_at(parts, -1).alias("file"),
        "content",
    )


def corpus_messages(files: DataFrame) -> DataFrame:
    """One row per message: a mailbox is split, any other file is one message as it is."""
    is_mailbox = F.lower("file").endswith(".mbox")
    boxes = files.filter(is_mailbox).select(
        "dataset", "label", F.explode(mailbox_messages(F.decode("content", "UTF-8"))).alias("_text")
    )
    split = boxes.select("dataset", "label", F.encode("_text", "UTF-8").alias("raw_content"))
    whole = files.filter(~is_mailbox).select("dataset", "label", F.col("content").alias("raw_content"))
    return whole.filter(F.length("raw_content") > 0).unionByName(split)


def load_report(loaded: DataFrame) -> DataFrame:
    """New rows by label, duplicates skipped and datasets seen. Reads label, dataset and duplicate."""
    fresh = ~F.col("duplicate")
    return loaded.groupBy("label").agg(
        F.count_if(fresh).alias("loaded"), F.count_if(F.col("duplicate")).alias("duplicates_skipped"),
        F.array_sort(F.collect_set(F.when(fresh, F.col("dataset")))).alias("datasets"),
    )
