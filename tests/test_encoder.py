"""The encoder: hashing straight from Arrow, the Gram matrix of the corpus, and unit vectors."""

from datetime import datetime
import random

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from mailsift import vocabulary as V
from mailsift.functions import hashing, vectors
from mailsift.operators import training

WORDS = [f"w{i}" for i in range(300)] + ["Ab9", "naïve", "x" * 40, "ſ", "0"]


def some_texts(n):
    rng = random.Random(n)
    return [" ".join(rng.choices(WORDS, k=rng.choice([1, 2, 9, 60]))) for _ in range(n)]


def dense(hashed):
    collected = hashed.collect()
    full = np.zeros((len(collected), V.HASH_DIMENSION))
    for row, found in zip(full, collected):
        row[found.buckets] = found.values
    return full


@pytest.mark.parametrize("limit", [40, 1 << 19])
def test_vectors_are_counts_over_their_length(limit, monkeypatch):
    monkeypatch.setattr(hashing, "PIECE_CHARS", limit)
    texts = [None, "", "?!", "a b a", "end", "start again", *some_texts(50), None, "é"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts) + 2)), pa.array(["cut", "off", *texts])], ["id", "text"]).slice(2)
    found = [r for part in hashing.ngram_vectors(iter([batch.slice(0, 0), batch])) for r in part.to_pylist()]
    assert [r["id"] for r in found] == list(range(2, len(texts) + 2))
    for r, (buckets, counts) in zip(found, hashing.ngram_counts(pd.Series(texts))):
        assert r["buckets"] == buckets.tolist()
        assert r["values"] == (counts / np.sqrt(float((counts.astype(float) ** 2).sum()) or 1.0)).tolist()


def test_tokens_of_neighbouring_texts_stay_apart():
    (buckets, counts), (none, _), (other, _) = hashing.ngram_counts(pd.Series(["ab", None, "cd"]))
    assert len(buckets) == len(other) == 1 and buckets[0] == (31 * ord("a") + ord("b")) % V.HASH_DIMENSION
    assert other[0] == (31 * ord("c") + ord("d")) % V.HASH_DIMENSION and len(none) == 0 and counts.tolist() == [1]


def test_gram_of_many_blocks_and_tasks(spark, monkeypatch):
    monkeypatch.setattr(training, "GRAM_ROWS", 64)
    frame = spark.createDataFrame(list(enumerate(some_texts(700))), "email_id long, text string").repartition(20)
    hashed = training.hashed_vectors(frame, "text")
    full = dense(hashed)
    for rows in (None, 0, 700):
        assert np.allclose(training._gram(hashed, rows), full.T @ full, rtol=0, atol=1e-11)


def test_fit_with_a_task_without_tokens(spark):
    texts = [(1, "a b c"), (2, "c d"), (3, "e f g")]
    plain = spark.createDataFrame(texts, "email_id long, text string")
    empty = spark.createDataFrame([(4, ""), (5, None), (6, "?")], "email_id long, text string")
    hashed = training.hashed_vectors(plain.coalesce(1).unionByName(empty.coalesce(1)), "text")
    encoder = training.fit_encoder(hashed)
    assert encoder.shape == (V.HASH_DIMENSION, 3)
    found = {r.email_id: r.embedding for r in training.encode(hashed, encoder).collect()}
    assert all(sum(x * x for x in found[i]) == pytest.approx(1.0) for i in (1, 2, 3)) and found[4] == found[5] == found[6] == [0.0] * 3


def test_the_corpus_is_read_once_however_long_the_iteration(spark):
    frame = spark.createDataFrame(list(enumerate(some_texts(400))), "email_id long, text string").coalesce(2)
    context, jobs = spark.sparkContext, []
    for settled in (0.5, 1e-6):
        context.setJobGroup(f"fit-{settled}", "fit")
        encoder = training.fit_encoder(training.hashed_vectors(frame, "text"), dimension=20, settled=settled)
        jobs.append(len(context.statusTracker().getJobIdsForGroup(f"fit-{settled}")))
    context.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[0] == jobs[1] > 0
    full = dense(training.hashed_vectors(frame, "text"))
    leading = np.linalg.svd(full, full_matrices=False)[2][:20]
    assert (np.linalg.norm(full @ encoder) / np.linalg.norm(full @ leading.T)) ** 2 > 0.999


def test_a_norm_is_computed_once_per_vector():
    assert str(vectors.unit(F.col("a"))).count("aggregate") == 1


def test_unit_keeps_nulls_and_zeros(one):
    assert one(vectors.unit(F.lit(None).cast("array<double>"))) is None
    assert one(vectors.unit(F.array(F.lit(1.0), F.lit(None).cast("double")))) == [None, None]
    assert one(vectors.unit(F.array().cast("array<double>"))) == []
    assert one(vectors.unit(F.array(F.lit(3), F.lit(-4)))) == [0.6, -0.8]


@pytest.mark.parametrize("texts, dimension", [(["", None, "?!"], 0), (["a b", None, "c d e", ""], 2)])
def test_streamed_vectors_of_texts_with_and_without_tokens(spark, tmp_path, texts, dimension):
    n = len(texts)
    docs = {"doc_id": range(n), "text": pa.array(texts, pa.string()), "lang": ["en"] * n, "source": ["web"] * n, "n_chars": range(n)}
    events = {
        "event_id": range(n), "ts": pa.array([datetime(2024, 1, 1)] * n, pa.timestamp("us")), "user_id": range(n),
        "event_type": ["view"] * n, "value": [1.0] * n, "props": ['{"k": 1}'] * n,
    }
    for name, columns in (("documents", docs), ("events", events)):
        pq.write_table(pa.table({k: pa.array(v) for k, v in columns.items()}), tmp_path / f"{name}.parquet")
    for name in ("text_embeddings", "stream_embeddings"):
        found = {r.email_id: (r.dimension, r.length) for r in entry.queries()[name](spark, str(tmp_path)).collect()}
        assert found == {i: (dimension, float(any(map(str.isalnum, t or "")))) for i, t in enumerate(texts)}, name


def test_few_rows_reach_python_at_once(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    with training.batches_of(spark, 100):
        sizes = [r.n for r in spark.range(1050).coalesce(1).mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches), "n long").collect()]
    assert sum(sizes) == 1050 and max(sizes) <= 100 and spark.conf.get(name) == before
