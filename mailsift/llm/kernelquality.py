"""Document quality by random Fourier features, ridge regression and isotonic calibration.

Statistics of a text (shape of words and lines, character classes, repetition) are standardised and mapped to
``FEATURES`` random cosines that approximate a Gaussian kernel. Every fitting task adds up its rows' normal
equations; the ``TASKS`` sums have a fixed size and are solved once. Ridge scores of held-back training rows are
counted in ``BINS`` fixed bins, pooled to a rising curve, and each score is read off that curve.

Texts are read once; a narrow table of statistics serves fitting and scoring. Labels meet statistics in a join.

Nulls, empties, repeats: a null text is empty, an empty text has statistics 0 and a score like any other. Rows are
scored one by one. Labels that are null, or without an id, teach nothing; repeated labels of an id count once, the
larger one. Without labels of both kinds every score is the mean label, or 0.5 without any. Very long texts are
read whole. Equal statistics score alike. An empty table gives no rows. Extra columns, of any name, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from mailsift.llm.natives import likely_in
from mailsift.llm.storage import stored
from mailsift.llm.words import Words, grams, in_small_batches, pieces, split_words, tidy

FEATURES = 256
RIDGE = 1.0
TASKS = 16
BINS = 512
THRESHOLD = 0.7
_SYMBOLS = b"#$%&*|@=+<>{}[]_~^\\/"
_CLASSES = {
    "upper": bytes(range(65, 91)), "digit": b"0123456789", "symbol": _SYMBOLS, "bang": b"!?", "stop": b".,;:", "line": b"\n",
    "quote": b"\"'()", "far": bytes(range(128, 256)), "bar": b"|",
}


def _mask(chars: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table


_MASKS = {name: _mask(chars) for name, chars in _CLASSES.items()}


def _share_repeated(codes: np.ndarray, owner: np.ndarray, texts: int) -> np.ndarray:
    """Share of a text's entries that repeat an earlier one of it."""
    total = np.bincount(owner, minlength=texts)
    order = np.lexsort((codes, owner))
    same = (codes[order][1:] == codes[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    return np.bincount(owner[order][1:][same], minlength=texts) / np.maximum(total, 1)


def statistics(words: Words) -> np.ndarray:
    """One row of numbers per text."""
    texts = len(words.bounds) - 1
    n_bytes, n_words, owner = np.diff(words.offsets), words.counts, words.owner()
    per_byte, per_word = np.maximum(n_bytes, 1), np.maximum(n_words, 1)
    at = {name: np.flatnonzero(mask[words.data]) for name, mask in _MASKS.items()}
    share = {name: np.diff(np.searchsorted(places, words.offsets)) / per_byte for name, places in at.items()}
    length = (words.ends - words.starts).astype(float)
    mean = np.bincount(owner, weights=length, minlength=texts) / per_word
    square = np.bincount(owner, weights=length**2, minlength=texts) / per_word
    longest = np.zeros(texts)
    np.maximum.at(longest, owner, length)
    upper_before = np.concatenate([[0], np.cumsum(_MASKS["upper"][words.data])])
    shouted = (upper_before[words.ends] - upper_before[words.starts]) * 2 > length
    last = words.data[words.ends - 1] if len(words.ends) else words.data[:0]
    pairs = words.room() >= 2
    columns = [
        np.log1p(n_bytes), np.log1p(n_words), mean, np.sqrt(np.maximum(square - mean**2, 0)), np.log1p(longest),
        *(share[name] for name in _CLASSES),
        np.bincount(owner[shouted], minlength=texts) / per_word,
        np.bincount(owner[_MASKS["symbol"][last]], minlength=texts) / per_word,
        np.bincount(owner[_MASKS["bang"][last]], minlength=texts) / per_word,
        np.bincount(owner[_MASKS["stop"][last]], minlength=texts) / per_word,
        np.bincount(owner[length <= 3], minlength=texts) / per_word,
        _share_repeated(words.codes, owner, texts),
        _share_repeated(grams(words.codes, 2)[pairs], owner[pairs], texts),
        np.log1p(n_words / (share["line"] * n_bytes + 1)),
    ]
    return np.stack(columns, axis=1)


@tidy
def _statistic_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in pieces(batches):
        values = statistics(split_words(piece.column("text"), lower=False))
        bounds = np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
        yield pa.RecordBatch.from_arrays(
            [piece.column("doc_id"), pa.ListArray.from_arrays(pa.array(bounds), pa.array(values.ravel()))], names=["doc_id", "stats"]
        )


def text_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of every row."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_statistic_rows, "doc_id long, stats array<double>")


def _matrix(column: pa.Array) -> np.ndarray:
    flat = np.asarray(pa.compute.list_flatten(column))
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray | None = None
    low: float = 0.0
    step: float = 1.0
    curve: np.ndarray | None = None
    constant: float = 0.5

    def cosines(self, stats: np.ndarray) -> np.ndarray:
        inner = np.clip((stats - self.mean) / self.scale, -8, 8) @ self.directions + self.phases
        return np.hstack([np.cos(inner) * np.sqrt(2.0 / len(self.phases)), np.ones((len(stats), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.cosines(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        if self.curve is None:
            return np.full(len(stats), self.constant)
        place = (self.raw(stats) - self.low) / self.step - 0.5
        return np.interp(place, np.arange(len(self.curve)), self.curve)


def _sums(rows: DataFrame, part) -> list[np.ndarray]:
    """``part`` of every fitting task: a fixed number of arrays of a fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for first in range(0, batch.num_rows, 2048):
                some = batch.slice(first, 2048)
                value = part(_matrix(some.column("stats")), np.asarray(some.column("label")).astype(float))
                total = value if total is None else total + value
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(total).tobytes()])], names=["part"])

    return [np.frombuffer(row.part) for row in rows.mapInArrow(tidy(run), "part binary").collect()]


def pooled(positive: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Rising curve over the bins nearest to the observed shares (pool adjacent violators); empty bins are filled in."""
    blocks: list[list[float]] = []
    for hits, weight in zip(positive, total):
        if weight == 0:
            if blocks:
                blocks[-1][2] += 1
            else:
                blocks.append([0.0, 0.0, 1])
            continue
        blocks.append([hits, weight, 1])
        while len(blocks) > 1 and (blocks[-2][1] == 0 or blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]):
            top = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], top)]
    return np.concatenate([np.full(int(n), hits / weight if weight else 0.5) for hits, weight, n in blocks])


def fit(labelled: DataFrame, features: int = FEATURES, ridge: float = RIDGE, seed: int = 7) -> Model:
    """``labelled``: stats, label (0/1) and calibrate (rows kept for the isotonic curve)."""
    rows = labelled.select("doc_id", "stats", F.col("label").cast("double").alias("label"), "calibrate").repartition(TASKS, "doc_id").coalesce(TASKS)
    for_ridge, for_curve = rows.filter("NOT calibrate"), rows.filter("calibrate")
    moments = _sums(for_ridge, lambda x, y: np.concatenate([[len(y), y.sum()], x.sum(0), (x**2).sum(0)]))
    if not moments:
        return Model(*[np.zeros(0)] * 4)
    total = np.sum(moments, axis=0)
    n, width = total[0], (len(total) - 2) // 2
    mean = total[2 : 2 + width] / n
    spread = np.sqrt(np.maximum(total[2 + width :] / n - mean**2, 0))
    rng = np.random.default_rng(seed)
    directions = rng.normal(size=(width, features)) * np.sqrt(2.0 / width)
    model = Model(mean, np.where(spread > 1e-9, spread, 1.0), directions, rng.uniform(0, 2 * np.pi, features), constant=total[1] / n)
    if total[1] in (0, n):
        return model

    def normal(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        z = model.cosines(x)
        return np.hstack([z.T @ z, (z.T @ y)[:, None]])

    equations = np.sum(_sums(for_ridge, normal), axis=0).reshape(features + 1, features + 2)
    penalty = np.full(features + 1, ridge)
    penalty[-1] = 0.0
    model.weights = np.linalg.solve(equations[:, :-1] + np.diag(penalty) + 1e-9 * np.eye(features + 1), equations[:, -1])
    model.low, model.step = -0.5, 2.0 / BINS

    def binned(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        place = np.clip(((model.raw(x) - model.low) / model.step).astype(int), 0, BINS - 1)
        return np.stack([np.bincount(place, weights=y, minlength=BINS), np.bincount(place, minlength=BINS).astype(float)])

    parts = _sums(for_curve, binned) or _sums(for_ridge, binned)
    counts = np.sum(parts, axis=0).reshape(2, BINS)
    model.curve = pooled(counts[0], counts[1])
    return model


def score(stats: DataFrame, model: Model) -> DataFrame:
    sent = stats.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                for first in range(0, batch.num_rows, 2048):
                    some = batch.slice(first, 2048)
                    values = np.clip(sent.value.score(_matrix(some.column("stats"))), 0.0, 1.0)
                    yield pa.RecordBatch.from_arrays([some.column("doc_id"), pa.array(values)], names=["doc_id", "score"])

    return stats.mapInArrow(tidy(run), "doc_id long, score double")


def part_of(doc_id: Column, parts: int = 4) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % parts, F.lit(-1))


def once_per_id(labels: DataFrame, label: str) -> DataFrame:
    return labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(label).alias("label")
    )


def train(stats: DataFrame, labels: DataFrame) -> Model:
    """Fits on the labels outside part 2 and calibrates on part 3; ``stats`` may hold more rows than the labelled ones."""
    part = part_of(F.col("doc_id"))
    labelled = stats.filter(part != 2).join(once_per_id(labels, "quality"), "doc_id").withColumn("calibrate", part == 3)
    return fit(stored(labelled))


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    stats = stored(text_statistics(in_small_batches(docs)))
    return score(stats, train(stats, labels)).select(
        "doc_id", (part_of(F.col("doc_id")) == 2).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, whose score reaches ``threshold``; texts take part in no shuffle but the labelled ones'."""
    docs, known = in_small_batches(docs), once_per_id(labels, "quality")
    asked = docs.filter(likely_in(F.xxhash64(F.col("doc_id").cast("long")), known, F.xxhash64("doc_id")))
    sent = docs.sparkSession.sparkContext.broadcast(train(text_statistics(asked), labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            values = sent.value.score(statistics(split_words(piece.column("text"), lower=False)))
            yield piece.filter(pa.array(np.clip(values, 0.0, 1.0) >= threshold))

    return docs.mapInArrow(tidy(run), docs.schema)
