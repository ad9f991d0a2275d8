"""Toxicity by a factorization machine over hashed terms.

Terms of a text are its distinct words (A-Z lower-cased) and their beginnings of 4 to 7 bytes, hashed into ``SLOTS``
slots. Over all labelled training rows the rows of each slot are counted, and the toxic ones of them; every slot with
at least ``SUPPORT`` rows is kept. A term enters the linear part with its own evidence, the log ratio of its shares of toxic and
other rows over that ratio's standard error, so a rare coincidence weighs little without being cut off; a text's entries are
scaled to unit length, so long texts neither saturate nor drown. For every two terms the machine adds the inner
product of their ``FACTORS`` factors over the text's number of terms, so a pair such as an insult and a group can weigh
more or less than both alone, also where each alone tells nothing. Terms of fewer than ``PAIRED`` rows have no factors.

Weights and factors are fitted by full gradients with Adam on ``ROWS`` labelled training rows at most (chosen by a hash of
doc_id; a documented bound, so the fit is one task of bounded size on an executor): weights first, then factors for what these
leave over, in as many steps as serve a held-back part best. The model, of a fixed size, is broadcast, and all rows are scored in one pass.

Nulls, empties, repeats: a null text is empty; an empty text, or one without a known term, gets the bias as its score.
Very long texts are handled whole. Rows are scored one by one, so repeated rows and ids score alike. Labels that are null,
or without an id, teach nothing; repeated labels of an id count once, the larger one. Without labels of both kinds every score
is the mean label, or 0.5 without any. An empty table gives no rows. Extra columns, of any name, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from mailsift.llm.kernelquality import once_per_id, part_of
from mailsift.llm.natives import likely_in
from mailsift.llm.storage import stored
from mailsift.llm.words import Words, beginnings, in_small_batches, pieces, split_words, tidy

SLOTS = 1 << 18
SUPPORT = 2
#: A term of fewer rows has a weight but no factors: too few rows tell of its pairs.
PAIRED = 8
FACTORS = 4
#: Labelled rows that weights and factors are fitted on, at most (about: rows are chosen by hash).
ROWS = 1 << 13
#: One of so many of these rows is held back to choose the number of factor steps, which end ``PATIENCE`` after the best.
HELD_BACK = 6
STEPS, RATE, PENALTY = 40, 0.1, 1e-4
PAIR_STEPS, PAIR_RATE, PAIR_PENALTY, PATIENCE = 80, 0.1, 1e-4, 12
#: Standard errors by which factors must lower the held-back rows' losses to be kept.
SURE = 2.0
#: Entries gathered at a time.
CHUNK = 1 << 19
PARTS = 5
THRESHOLD = 0.5
_BEGINNINGS = (4, 5, 6, 7)


def hashed_terms(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(text, slot) of every word and beginning, repeats included."""
    owner = words.owner()
    codes, owners = [words.codes], [owner]
    for length in _BEGINNINGS:
        longer, found = beginnings(words, length)
        codes.append(found)
        owners.append(owner[longer])
    return np.concatenate(owners), (np.concatenate(codes) >> np.uint64(46)).astype(np.int64)


@tidy
def _term_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in pieces(batches):
        owner, slot = hashed_terms(split_words(piece.column("text"), lower=True))
        both = np.unique(owner * SLOTS + slot)
        bounds = np.searchsorted(both, np.arange(piece.num_rows + 1) * SLOTS).astype(np.int32)
        terms = pa.ListArray.from_arrays(pa.array(bounds), pa.array((both % SLOTS).astype(np.int32)))
        yield pa.RecordBatch.from_arrays([piece.column("doc_id"), terms], names=["doc_id", "terms"])


@dataclass
class Machine:
    """``place`` maps a slot to its kept term or -1; a term has its evidence, a weight and ``FACTORS`` factors."""

    place: np.ndarray
    evidence: np.ndarray
    bias: float
    weights: np.ndarray
    factors: np.ndarray
    constant: float | None = None

    def inputs(self, owner: np.ndarray, term: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
        """The linear input of every (text, term) entry, and for each text what a factor is multiplied with."""
        value = self.evidence[term]
        length = np.sqrt(np.maximum(np.bincount(owner, weights=value**2, minlength=texts), 1e-12))
        return value / length[owner], 1 / np.sqrt(np.maximum(np.bincount(owner, minlength=texts), 1))

    def logits(self, owner: np.ndarray, term: np.ndarray, texts: int) -> np.ndarray:
        """Scores of distinct (text, term) entries in order of text."""
        linear, unit = self.inputs(owner, term, texts)
        bounds = np.searchsorted(owner, np.arange(texts + 1))
        scored = self.bias + np.bincount(owner, weights=self.weights[term] * linear, minlength=texts)
        return scored + _pairs(term, bounds, unit, self.factors)[0]

    def score(self, words: Words) -> np.ndarray:
        texts = len(words.bounds) - 1
        if self.constant is not None:
            return np.full(texts, self.constant)
        owner, slot = hashed_terms(words)
        term = self.place[slot]
        both = np.unique(owner[term >= 0] * len(self.weights) + term[term >= 0])
        return _logistic(self.logits(both // len(self.weights), both % len(self.weights), texts))


def _folded(values: np.ndarray, index: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Row i is the sum of ``values[index[bounds[i]:bounds[i + 1]]]``; about ``CHUNK`` entries are gathered at a time."""
    out = np.zeros((len(bounds) - 1, values.shape[1]))
    first = 0
    while first < len(out):
        last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + CHUNK, "right")) - 1)
        held = np.flatnonzero(np.diff(bounds[first : last + 1])) + first
        if len(held):
            out[held] = np.add.reduceat(values[index[bounds[first] : bounds[last]]], bounds[held] - bounds[first], axis=0)
        first = last
    return out


def _pairs(term: np.ndarray, bounds: np.ndarray, unit: np.ndarray, factors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's sum over pairs of its terms, and its factor sums."""
    both = _folded(np.column_stack([factors, (factors**2).sum(1)]), term, bounds)
    sums = both[:, :-1] * unit[:, None]
    return 0.5 * ((sums**2).sum(1) - both[:, -1] * unit**2), sums


def _logistic(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * x))


def _losses(logits: np.ndarray, label: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, logits) - label * logits


class Rows:
    """Labelled texts as entries in order of text, and in order of term."""

    def __init__(self, machine: Machine, owner: np.ndarray, term: np.ndarray, label: np.ndarray) -> None:
        self.owner, self.term, self.label = owner, term, label
        self.linear, self.unit = machine.inputs(owner, term, len(label))
        self.by_text = np.searchsorted(owner, np.arange(len(label) + 1))
        order = np.argsort(term, kind="stable")
        self.owner_by_term, self.by_term = owner[order], np.searchsorted(term[order], np.arange(len(machine.weights) + 1))

    def only(self, machine: Machine, chosen: np.ndarray) -> Rows:
        number, inside = np.cumsum(chosen) - 1, chosen[self.owner]
        return Rows(machine, number[self.owner[inside]], self.term[inside], self.label[chosen])

    def linear_part(self, machine: Machine) -> np.ndarray:
        return machine.bias + np.bincount(self.owner, weights=machine.weights[self.term] * self.linear, minlength=len(self.label))


def linear_slope(machine: Machine, rows: Rows) -> list[np.ndarray]:
    """The gradient of the mean log loss and the penalty by bias and weights, without pairs."""
    error = (_logistic(rows.linear_part(machine)) - rows.label) / len(rows.label)
    pulled = np.bincount(rows.term, weights=error[rows.owner] * rows.linear, minlength=len(machine.weights))
    return [error.sum(keepdims=True), pulled + PENALTY * machine.weights]


def factor_slope(machine: Machine, rows: Rows, linear: np.ndarray) -> list[np.ndarray]:
    """The gradient of the mean log loss and the penalty by bias and factors; ``linear`` is the linear part."""
    pair, sums = _pairs(rows.term, rows.by_text, rows.unit, machine.factors)
    error = (_logistic(linear + pair) - rows.label) / len(rows.label)
    pulled = _folded(np.column_stack([(error * rows.unit)[:, None] * sums, error * rows.unit**2]), rows.owner_by_term, rows.by_term)
    return [error.sum(keepdims=True), pulled[:, :-1] - pulled[:, -1:] * machine.factors + PAIR_PENALTY * machine.factors]


class Adam:
    def __init__(self, rate: float) -> None:
        self.rate, self.step, self.first, self.second = rate, 0, None, None

    def moves(self, slopes: list[np.ndarray]) -> list[np.ndarray]:
        self.step += 1
        self.first = [0.1 * g if self.first is None else 0.9 * self.first[k] + 0.1 * g for k, g in enumerate(slopes)]
        self.second = [0.01 * g * g if self.second is None else 0.99 * self.second[k] + 0.01 * g * g for k, g in enumerate(slopes)]
        up, down = 1 - 0.9**self.step, 1 - 0.99**self.step
        return [self.rate * (m / up) / (np.sqrt(v / down) + 1e-8) for m, v in zip(self.first, self.second)]


def _with_weights(machine: Machine, rows: Rows, steps: int = STEPS) -> Machine:
    now, adam = replace(machine, weights=machine.weights.copy()), Adam(RATE)
    for _ in range(steps):
        bias, weights = adam.moves(linear_slope(now, rows))
        now.bias -= float(bias[0])
        now.weights -= weights
    return now


def _with_factors(machine: Machine, rows: Rows, paired: np.ndarray, steps: int, judged: Rows | None = None) -> tuple[Machine, int]:
    """``machine`` with factors for what its weights leave over, and the number of steps that served ``judged`` best.

    That number is 0 unless the judged rows' losses fell by more than ``SURE`` standard errors.
    """
    now, adam = replace(machine, factors=machine.factors * paired[:, None]), Adam(PAIR_RATE)
    linear = rows.linear_part(machine) - machine.bias
    if judged is not None:
        aside = judged.linear_part(machine) - machine.bias
        before = _losses(machine.bias + aside, judged.label)
        best, least = 0, before
    for step in range(1, steps + 1):
        bias, factors = adam.moves(factor_slope(now, rows, now.bias + linear))
        now.bias -= float(bias[0])
        now.factors = now.factors - factors * paired[:, None]
        if judged is not None and step % 4 == 0:
            losses = _losses(now.bias + aside + _pairs(judged.term, judged.by_text, judged.unit, now.factors)[0], judged.label)
            if losses.sum() < least.sum():
                best, least = step, losses
            elif step >= best + PATIENCE:
                break
    if judged is None:
        return now, steps
    gain = before - least
    return now, best if gain.mean() > SURE * gain.std() / np.sqrt(len(gain)) else 0


def train(machine: Machine, owner: np.ndarray, term: np.ndarray, label: np.ndarray, paired: np.ndarray, seed: int) -> Machine:
    """Weights first, then factors for what these leave over, in as many steps as serve held-back rows best."""
    rows = Rows(machine, owner, term, label)
    full = _with_weights(machine, rows)
    held = np.random.default_rng(seed).permutation(len(label)) % HELD_BACK == 0
    steps = 0
    if 0 < label[held].sum() < held.sum() and paired.any():
        others = rows.only(machine, ~held)
        steps = _with_factors(_with_weights(machine, others), others, paired, PAIR_STEPS, rows.only(machine, held))[1]
    if not steps:
        return replace(full, factors=np.zeros_like(full.factors))
    return _with_factors(full, rows, paired, steps)[0]


@tidy
def _slot_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows and toxic rows of every slot that a task has seen, and of slot -1, which stands for all rows."""
    counts = np.zeros((2, SLOTS), np.int64)
    rows = np.zeros(2, np.int64)
    for batch in batches:
        label = np.asarray(batch.column("label")).astype(np.int64)
        terms = np.asarray(pa.compute.list_flatten(batch.column("terms")))
        toxic = np.repeat(label, np.asarray(pa.compute.list_value_length(batch.column("terms")))) == 1
        counts += [np.bincount(terms, minlength=SLOTS), np.bincount(terms[toxic], minlength=SLOTS)]
        rows += [len(label), label.sum()]
    if rows[0]:
        seen = np.flatnonzero(counts[0])
        columns = np.append(seen, -1), np.append(counts[0, seen], rows[0]), np.append(counts[1, seen], rows[1])
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["slot", "n", "toxic"])


def evidence(n: np.ndarray, toxic: np.ndarray, size: float, hits: float) -> np.ndarray:
    """Log ratio of a term's shares of toxic and other rows, over its standard error."""
    other = n - toxic
    ratio = np.log((toxic + 0.5) / (hits + 1)) - np.log((other + 0.5) / (size - hits + 1))
    return ratio / np.sqrt(1 / (toxic + 0.5) + 1 / (other + 0.5))


def fit(training: DataFrame, support: int = SUPPORT, factors: int = FACTORS, rows: int = ROWS, seed: int = 5) -> Machine:
    """``training``: doc_id, terms (distinct slots), label (0/1)."""
    counted = training.select("terms", "label").mapInArrow(_slot_counts, "slot long, n long, toxic long")
    sums = counted.groupBy("slot").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic")).toPandas().set_index("slot")
    none = Machine(np.full(SLOTS, -1), np.zeros(1), 0.0, np.zeros(1), np.zeros((1, factors)), 0.5)
    if sums.empty:
        return none
    size, hits = map(float, sums.loc[-1, ["n", "toxic"]])
    if hits in (0.0, size):
        none.constant = hits / size
        return none
    sums = sums.drop(index=-1)
    sums = sums[sums["n"] >= support].sort_index()
    kept, n = sums.index.to_numpy(), sums["n"].to_numpy()
    place = np.full(SLOTS, -1)
    place[kept] = np.arange(len(kept))
    terms = max(len(kept), 1)
    start = np.random.default_rng(seed).normal(size=(terms, factors)) * 0.1
    weighed = evidence(n, sums["toxic"].to_numpy(), size, hits) if len(kept) else np.zeros(1)
    machine = Machine(place, weighed, float(np.log(hits / (size - hits))), np.zeros(terms), start)
    paired = n >= PAIRED if len(kept) else np.zeros(1, bool)
    sent = training.sparkSession.sparkContext.broadcast((machine, paired))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun, some = sent.value
        owners, terms, labels, count = [], [], [], 0
        for batch in batches:
            sizes = np.asarray(pa.compute.list_value_length(batch.column("terms")))
            term = begun.place[np.asarray(pa.compute.list_flatten(batch.column("terms")))]
            owner = np.repeat(np.arange(count, count + batch.num_rows), sizes)
            owners.append(owner[term >= 0])
            terms.append(term[term >= 0])
            labels.append(np.asarray(batch.column("label")).astype(float))
            count += batch.num_rows
        if count:
            done = train(begun, np.concatenate(owners), np.concatenate(terms), np.concatenate(labels), some, seed)
            model = np.column_stack([done.weights, done.factors]).astype(np.float32)
            yield pa.RecordBatch.from_arrays([pa.array([done.bias]), pa.array([model.tobytes()])], names=["bias", "model"])

    part = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(7)), F.lit(1 << 20))
    chosen = training.filter(part < int(min(1.0, rows / size) * (1 << 20))).select("terms", F.col("label").cast("int").alias("label"))
    fitted = chosen.repartition(1).mapInArrow(tidy(run), "bias double, model binary").collect()
    sent.unpersist()
    if fitted:
        table = np.frombuffer(fitted[0].model, np.float32).reshape(terms, 1 + factors)
        machine = Machine(place, weighed.astype(np.float32), fitted[0].bias, table[:, 0], table[:, 1:])
    return machine


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every row; learns from labels outside part 0."""
    keyed = in_small_batches(docs).select(F.col("doc_id").cast("long"), "text")
    part = part_of(F.col("doc_id"), PARTS)
    known = once_per_id(labels, "toxic").filter(part != 0)
    asked = keyed.filter(part != 0).filter(likely_in(F.xxhash64("doc_id"), known, F.xxhash64("doc_id")))
    training = stored(asked.mapInArrow(_term_rows, "doc_id long, terms array<int>").join(known.hint("merge"), "doc_id"))
    sent = docs.sparkSession.sparkContext.broadcast(fit(training))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            values = sent.value.score(split_words(piece.column("text"), lower=True))
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(values)], names=["doc_id", "score"])

    return keyed.mapInArrow(tidy(run), "doc_id long, score double").select(
        "doc_id", (part == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
