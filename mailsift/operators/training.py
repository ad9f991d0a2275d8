"""Training sets, classifiers and the text encoder."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructType

from mailsift import vocabulary as V
from mailsift.functions.hashing import ngram_vectors
from mailsift.functions.numeric import raw_malicious
from mailsift.functions.tiers import is_abuse, lookup
from mailsift.functions.vectors import unit

#: Training rows of a partition that an optimiser step reads as one task.
FIT_ROWS = 1 << 17

#: Rows that are written out in full at once to be multiplied with themselves, and rows of the product that are computed at once.
GRAM_ROWS, GRAM_TILE = 1 << 10, 1 << 9

#: Rows that are worth a task of their own: the sum that a task sends has one size, however few rows it read.
GRAM_TASK_ROWS = 1 << 14


def join_features(export: DataFrame, features: DataFrame, version: int = V.FEATURE_VERSION) -> tuple[DataFrame, DataFrame]:
    """(examples with features, one-row count of labels dropped for want of them)."""
    current = features.filter(F.col("feature_version") == version)
    kept = export.join(current, "email_id")
    dropped = export.join(current, "email_id", "left_anti").agg(F.count(F.lit(1)).alias("dropped"))
    return kept, dropped


def training_problems(examples: DataFrame, min_samples: int = 40) -> DataFrame:
    """One row of counts that decide whether a set can be trained on, and the verdict.

    Reads features (array), label and weight.
    """
    weight, label = F.col("weight"), F.col("label")
    bad_weight = weight.isNull() | (weight <= 0) | F.isnan(weight) | (weight == float("inf"))
    c = F.col
    return examples.agg(
        F.count(F.lit(1)).alias("examples"),
        F.count_if(F.coalesce(F.size("features") != V.FEATURE_COUNT, F.lit(True))).alias("bad_vectors"),
        F.count_if(F.coalesce(~label.isin(*V.LABELS), F.lit(True))).alias("unknown_labels"),
        F.count_if(bad_weight).alias("bad_weights"),
        F.count_if(label == "ham").alias("ham"),
        F.count_if(is_abuse(label)).alias("abuse"),
    ).withColumn(
        "trainable",
        (c("examples") >= min_samples) & (c("bad_vectors") == 0) & (c("unknown_labels") == 0)
        & (c("bad_weights") == 0) & (c("ham") > 0) & (c("abuse") > 0),
    )


def training_accounting(examples: DataFrame) -> DataFrame:
    """Examples and weight by source and label."""
    return examples.groupBy("source", "label").agg(
        F.count(F.lit(1)).alias("examples"), F.sum("weight").alias("weight")
    )


def base_rate(examples: DataFrame) -> DataFrame:
    """Weighted share of abuse, as one row."""
    return examples.agg(
        (F.sum(F.when(is_abuse(F.col("label")), F.col("weight")).otherwise(F.lit(0.0))) / F.sum("weight")).alias(
            "training_base_rate"
        )
    )


def dataset_version(examples: DataFrame, feature_version: int = V.FEATURE_VERSION, columns: tuple[str, ...] = ("email_id", "label", "weight")) -> DataFrame:
    """A version name that depends only on content.

    Row digests are added up in 32-bit halves, so the name needs no order and no task sees the whole set.
    """
    digest = F.sha2(F.to_json(F.struct(*columns)), 256)
    part = lambda i: F.sum(F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("decimal(38,0)"))
    total = examples.agg(F.concat_ws("-", F.count(F.lit(1)), *[part(i) for i in range(8)]).alias("_all"))
    return total.select(
        F.concat(F.lit(f"candidate-fv{feature_version}-"), F.substring(F.sha2("_all", 256), 1, 8)).alias("dataset_version")
    )


def label_index(label: Column) -> Column:
    return lookup(label, {name: float(i) for i, name in enumerate(V.LABELS)})


def fit_classifier(examples: DataFrame, vector: str = "feature_vector", strength: float = 1.0, iterations: int = 200) -> PipelineModel:
    """Weighted multinomial logistic regression on standardised features.

    ``strength`` is the inverse penalty on the summed loss; Spark penalises the mean loss. Every optimiser step is a job over all
    rows, so these are held in as many partitions as run at once, or ``FIT_ROWS`` rows each where that is more.
    """
    needed = examples.select(vector, "weight", label_index(F.col("label")).alias("_label"))
    labelled = needed.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        weight, rows = labelled.agg(F.sum("weight"), F.count(F.lit(1))).first()
        parts = max(examples.sparkSession.sparkContext.defaultParallelism, -(-rows // FIT_ROWS))
        scaler = StandardScaler(inputCol=vector, outputCol="_scaled", withMean=True, withStd=True)
        model = LogisticRegression(
            featuresCol="_scaled", labelCol="_label", weightCol="weight", family="multinomial",
            regParam=1.0 / (strength * weight), standardization=False, maxIter=iterations,
            probabilityCol="_probability", predictionCol="_prediction", rawPredictionCol="_raw",
        )
        return Pipeline(stages=[scaler, model]).fit(labelled.coalesce(parts))
    finally:
        labelled.unpersist()


def score_classes(model: PipelineModel, messages: DataFrame) -> DataFrame:
    """Adds ham_score, spam_score, phishing_score and raw_malicious."""
    scores = vector_to_array("_probability")
    return (
        model.transform(messages)
        .withColumn("ham_score", scores[0]).withColumn("spam_score", scores[1]).withColumn("phishing_score", scores[2])
        .withColumn("raw_malicious", raw_malicious(F.col("spam_score"), F.col("phishing_score")))
        .drop("_scaled", "_raw", "_probability", "_prediction")
    )


def hashed_vectors(messages: DataFrame, text: str, key: str = "email_id") -> DataFrame:
    """Unit-length n-gram counts per message, as parallel sparse arrays ``buckets`` and ``values``."""
    taken = messages.select(key, text)
    return taken.mapInArrow(ngram_vectors, StructType([taken.schema[0]]).add("buckets", ArrayType(IntegerType())).add("values", ArrayType(DoubleType())))


def fit_encoder(
    hashed: DataFrame, dimension: int = V.ENCODER_DIMENSION, settled: float = 1e-3, oversample: int = 8, seed: int = V.EVAL_SEED,
    rows: int | None = None,
) -> np.ndarray:
    """Leading right singular vectors of the hashed corpus: ``HASH_DIMENSION`` by at most ``dimension``.

    Randomised subspace iteration on the Gram matrix of the buckets, which has a fixed size and is summed in one pass over the corpus,
    so neither rows nor pairs of rows reach the driver. Iterations end when the energy that the leading directions keep
    grows by less than a ``settled`` part. ``rows``, about how many the corpus has, only spares tasks where these are few.
    """
    width = min(dimension + oversample, V.HASH_DIMENSION)
    basis, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((V.HASH_DIMENSION, width)))
    gram, kept = _gram(hashed.select("buckets", "values"), rows), 0.0
    while True:
        product = gram @ basis
        # Energies of the corpus within the basis, and the directions that have them.
        energy, turned = np.linalg.eigh(basis.T @ product)
        energy, turned = energy[::-1], turned[:, ::-1]
        found = int((energy > max(energy[0], 0.0) * 1e-9).sum())
        before, kept = kept, float(energy[:dimension].clip(0).sum())
        if kept - before <= settled * kept:
            return (basis @ turned)[:, : min(dimension, found)]
        basis, _ = np.linalg.qr(product)


def encoder_facts(hashed: DataFrame, encoder: np.ndarray) -> DataFrame:
    """One row: documents with text, their energy, the part the encoder keeps, and how far it is from the leading subspace.

    ``skew`` is the largest entry of B'B - I; ``off`` is the length of what the corpus adds to the basis outside it,
    over the length of what it adds: 0 for an exact subspace.
    """
    product = _gram_times(hashed.select("buckets", "values"), encoder)
    inside = encoder @ (encoder.T @ product)
    skew = float(np.abs(encoder.T @ encoder - np.eye(encoder.shape[1])).max(initial=0))
    kept = float((encoder * product).sum())
    off = float(np.linalg.norm(product - inside) / max(np.linalg.norm(product), 1e-300))
    energy = F.aggregate("values", F.lit(0.0), lambda total, x: total + F.coalesce(x * x, F.lit(0.0)))
    return hashed.agg(F.count_if(F.size("buckets") > 0).alias("texts"), F.coalesce(F.sum(energy), F.lit(0.0)).alias("energy")).select(
        "texts", "energy", F.lit(encoder.shape[1]).alias("dimension"), F.lit(kept).alias("kept"), F.lit(skew).alias("skew"), F.lit(off).alias("off")
    )


def _dense_rows(buckets: pd.Series, values: pd.Series, chunk: int = 256) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, block of at most ``chunk`` dense rows)."""
    for begin in range(0, len(buckets), chunk):
        some, own = buckets.iloc[begin : begin + chunk], values.iloc[begin : begin + chunk]
        block = np.zeros((len(some), V.HASH_DIMENSION))
        for row, (at, x) in enumerate(zip(some, own)):
            block[row, np.asarray(at, np.int64)] = np.asarray(x, float)
        yield begin, block


@contextmanager
def batches_of(spark: SparkSession, rows: int = GRAM_ROWS) -> Iterator[None]:
    """Jobs run inside hand Python at most ``rows`` rows at a time: a hashed row may take tens of kilobytes."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, min(rows, int(before)) if int(before) > 0 else rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _full_blocks(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    """Sparse rows (``buckets``, ``values``) written out in full, at most ``GRAM_ROWS`` at a time; a block is overwritten by the next."""
    room = np.zeros((min(batch.num_rows, GRAM_ROWS), V.HASH_DIMENSION))
    for begin in range(0, batch.num_rows, GRAM_ROWS):
        some = batch.slice(begin, GRAM_ROWS)
        sizes = pc.fill_null(pc.list_value_length(some.column("buckets")), 0).to_numpy(zero_copy_only=False)
        slots = np.repeat(np.arange(some.num_rows) * V.HASH_DIMENSION, sizes) + some.column("buckets").flatten().to_numpy()
        room.ravel()[slots] = some.column("values").flatten().to_numpy(zero_copy_only=False)
        yield room[: some.num_rows]
        room.ravel()[slots] = 0.0


def _gram(corpus: DataFrame, rows: int | None = None) -> np.ndarray:
    """``A' A`` for the sparse corpus ``A``: ``HASH_DIMENSION`` squared, whatever the corpus.

    Only tiles on and below the diagonal are computed. A task sends what is below once, and there are at most as many tasks as run at once.
    """
    edges = [(a, min(a + GRAM_TILE, V.HASH_DIMENSION)) for a in range(0, V.HASH_DIMENSION, GRAM_TILE)]

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiles: list[np.ndarray] = []
        room = np.empty(GRAM_TILE * V.HASH_DIMENSION)
        for batch in batches:
            tiles = tiles or [np.zeros((b - a, b)) for a, b in edges]
            for block in _full_blocks(batch):
                for (a, b), tile in zip(edges, tiles):
                    tile += np.matmul(block[:, a:b].T, block[:, :b], out=room[: tile.size].reshape(tile.shape))
        for (a, b), tile in zip(edges, tiles):
            used = np.flatnonzero(tile.any(axis=1))
            ends = pa.array(np.cumsum([0, *(used + a + 1)]), pa.int32())
            below = tile[used][used[:, None] + a >= np.arange(b)]
            yield pa.RecordBatch.from_arrays([pa.array(used + a), pa.ListArray.from_arrays(ends, below)], ["bucket", "partial"])

    tasks = max(1, corpus.sparkSession.sparkContext.defaultParallelism)
    if rows is not None:
        tasks = max(1, min(tasks, -(-rows // GRAM_TASK_ROWS)))
    partials = corpus.coalesce(tasks).mapInArrow(multiply, "bucket bigint, partial array<double>")
    summed = partials.groupBy("bucket").agg(vector_to_array(Summarizer.sum(array_to_vector("partial"))).alias("row"))
    gram = np.zeros((V.HASH_DIMENSION, V.HASH_DIMENSION))
    with batches_of(corpus.sparkSession):
        collected = summed.toArrow()
    for batch in collected.to_batches():
        for bucket, row in zip(batch.column("bucket").to_pylist(), batch.column("row")):
            gram[bucket, : len(row)] = row.values.to_numpy()
    for a, b in edges:
        gram[a:b, a:b] += np.tril(gram[a:b, a:b], -1).T
        gram[a:b, b:] = gram[b:, a:b].T
    return gram


def _gram_times(corpus: DataFrame, basis: np.ndarray) -> np.ndarray:
    """``A' A basis`` for the sparse corpus ``A``."""
    shared = corpus.sparkSession.sparkContext.broadcast(basis)

    def multiply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matrix, total = shared.value, None
        for pdf in batches:
            total = np.zeros_like(matrix) if total is None else total
            for _, block in _dense_rows(pdf["buckets"], pdf["values"]):
                total += block.T @ (block @ matrix)
        if total is not None:
            touched = np.flatnonzero(total.any(axis=1))
            yield pd.DataFrame({"bucket": touched, "partial": list(total[touched])})

    partials = corpus.mapInPandas(multiply, "bucket bigint, partial array<double>")
    # Bounded: at most HASH_DIMENSION rows of fixed width come back.
    summed = partials.groupBy("bucket").agg(vector_to_array(Summarizer.sum(array_to_vector("partial"))).alias("row"))
    product = np.zeros_like(basis)
    for bucket, row in summed.toPandas().itertuples(index=False):
        product[bucket] = row
    shared.unpersist()
    return product


def encode(hashed: DataFrame, encoder: np.ndarray, key: str = "email_id", out: str = "embedding") -> DataFrame:
    """Unit vectors of each message under a fitted encoder, which is broadcast (fixed size)."""
    shared = hashed.sparkSession.sparkContext.broadcast(encoder)

    @F.pandas_udf(ArrayType(DoubleType()))
    def project(buckets: pd.Series, values: pd.Series) -> pd.Series:
        parts = [block @ shared.value for _, block in _dense_rows(buckets, values)]
        return pd.Series(list(np.concatenate(parts)) if parts else [])

    encoded = project(F.col("buckets"), F.col("values"))
    return hashed.select(key, encoded.alias("_encoded")).select(key, unit(F.col("_encoded")).alias(out))
