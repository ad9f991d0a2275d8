"""Table writers: insert-if-absent, upsert-latest, replace-a-version, checked append, frozen snapshot, export."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from mailsift.operators.quality import split_valid
from mailsift.session import cut_lineage


def read_or_empty(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """The table at ``path``, or an empty frame of the same shape before the first write."""
    try:
        return spark.read.schema(like.schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], like.schema)


def first_per_key(batch: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First row per key, as a mergeable aggregate."""
    rest = [c for c in batch.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(*order))
    return batch.groupBy(*keys).agg(first.alias("_row")).select(*keys, "_row.*")


def absent_rows(batch: DataFrame, target: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows of ``batch`` whose key is new, repeats inside the batch collapsed."""
    return first_per_key(batch, keys, order).join(target.select(*keys), keys, "left_anti")


def with_canonical_id(batch: DataFrame, target: DataFrame, key: str, identity: str, order: list[str]) -> DataFrame:
    """Each incoming row with the id its content is stored under and whether it was a duplicate."""
    winners = first_per_key(batch, [key], order).select(key, F.col(identity).alias("_batch_id"))
    stored = target.select(key, F.col(identity).alias("_stored_id"))
    joined = batch.join(winners, key).join(stored, key, "left")
    canonical = F.coalesce("_stored_id", "_batch_id")
    return joined.withColumn("canonical_id", canonical).withColumn(
        "duplicate", F.col("_stored_id").isNotNull() | (F.col(identity) != F.col("_batch_id"))
    ).drop("_batch_id", "_stored_id")


def insert_if_absent(batch: DataFrame, path: str, keys: list[str], order: list[str]) -> None:
    target = read_or_empty(batch.sparkSession, path, batch)
    absent_rows(batch, target, keys, order).write.mode("append").parquet(path)


def upserted(target: DataFrame, updates: DataFrame, keys: list[str], version: list[str]) -> DataFrame:
    """Target and updates folded to the newest row per key."""
    both = target.unionByName(updates)
    rest = [c for c in both.columns if c not in keys]
    return both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*version)).alias("_row")).select(*keys, "_row.*")


def upsert(updates: DataFrame, path: str, keys: list[str], version: list[str], buckets: int = 64) -> None:
    """Rewrites only the hash buckets the updates touch."""
    spark = updates.sparkSession
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
    marked = updates.withColumn("bucket", bucket)
    current = read_or_empty(spark, path, marked)
    touched = current.join(marked.select("bucket").distinct(), "bucket", "left_semi")
    merged = upserted(touched, marked, [*keys, "bucket"], version)
    # The merge reads the folder it replaces, so it is written out first; one task then writes each bucket.
    settled = cut_lineage(merged.repartition("bucket"))
    settled.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def replace_version(rows: DataFrame, path: str, version: str = "model_version") -> None:
    """Replaces the partitions present in ``rows`` and leaves other versions alone."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(version).parquet(path)


def append_valid(rows: DataFrame, path: str, quarantine_path: str, rules: list[tuple[str, Column]]) -> None:
    """Appends rows that keep every rule; the others go to the quarantine folder with what they break."""
    good, bad = split_valid(rows, rules)
    good.write.mode("append").parquet(path)
    bad.write.mode("append").parquet(quarantine_path)


def freeze(rows: DataFrame, folder: str, version: str) -> None:
    """Writes an immutable version; an existing one is an error."""
    rows.write.mode("error").parquet(f"{folder}/version={version}")


def write_export(examples: DataFrame, manifest: DataFrame, folder: str) -> None:
    """Export rows ordered for readers, and the manifest beside them."""
    examples.orderBy("source", "email_id").write.mode("error").json(f"{folder}/examples")
    manifest.write.mode("error").json(f"{folder}/manifest")


def write_sealed(sealed: DataFrame, path: str) -> DataFrame:
    """Writes freshly sealed content once, so that its random keys are fixed, and reads it back."""
    sealed.write.mode("error").parquet(path)
    return sealed.sparkSession.read.parquet(path)


def to_json_column(df: DataFrame, source: str, out: str) -> DataFrame:
    return df.withColumn(out, F.to_json(source))


def from_json_column(df: DataFrame, source: str, out: str, schema: str) -> DataFrame:
    """Parses a JSON column; text that does not fit leaves ``<out>_corrupt`` filled."""
    wide = F.from_json(source, f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    parsed = df.withColumn("_parsed", wide)
    names = [c for c in parsed.select("_parsed.*").columns if c != "_corrupt"]
    value = F.when(F.col("_parsed._corrupt").isNull(), F.struct(*[F.col(f"_parsed.{n}").alias(n) for n in names]))
    return parsed.withColumn(out, value).withColumn(f"{out}_corrupt", F.col("_parsed._corrupt")).drop("_parsed")
