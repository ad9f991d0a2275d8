"""Removal of word passages that an earlier document already holds.

A window is ``WINDOW`` consecutive words. A word goes when some window over it also starts in a document with a
smaller id. Windows are judged on the input.

Every window names an anchor: the smallest code among its ``WINDOW // 2``-word grams, so equal windows name equal
anchors. A maximal run of windows of one document with one anchor is a segment. Segments whose anchor occurs in one
document only can hold no repeated window and stop there; this leaves one short row per about twelve words. Of the
rest, equal segments are folded: all windows of a segment that an earlier document has go at once. Only where an
anchor has different segments are the windows of each segment's first document compared one by one. Decisions rest
on codes of 96 bits and more. No step gathers the rows of an anchor, a segment or a window in one task: minima have partial
aggregates, and joins on hot keys can be split.

``ReferenceAutomaton`` holds the same question against one bounded reference text as a suffix automaton: matching
statistics of a streamed text, maximal spans of at least ``WINDOW`` words.

Nulls, empties, repeats: a null or empty text has no words. Rows without an id neither remove nor lose words. Rows
with equal ids do not remove from each other. Very long texts are handled whole. An empty table gives no rows. Extra columns,
of any name, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from mailsift.llm.natives import likely_in
from mailsift.llm.storage import stored
from mailsift.llm.words import Words, in_small_batches, mix, pieces, signed, split_words, tidy, windows

WINDOW = 50
_ROW = ["doc_id", "row_key"]


class ReferenceAutomaton:
    """Suffix automaton over word codes of reference texts, each state with the smallest id it occurs in."""

    def __init__(self) -> None:
        self.moves: list[dict] = [{}]
        self.link = [-1]
        self.length = [0]
        self.first = [None]

    def add(self, words: Iterable, doc_id: int) -> None:
        last = 0
        for word in words:
            last = self._extend(last, word)
            state = last
            while state > 0 and (self.first[state] is None or self.first[state] > doc_id):
                self.first[state] = doc_id
                state = self.link[state]

    def _new(self, moves: dict, link: int, length: int, first) -> int:
        self.moves.append(moves)
        self.link.append(link)
        self.length.append(length)
        self.first.append(first)
        return len(self.moves) - 1

    def _extend(self, last: int, word) -> int:
        target = self.moves[last].get(word)
        if target is not None and self.length[target] == self.length[last] + 1:
            return target
        fresh = None if target is not None else self._new({}, 0, self.length[last] + 1, None)
        state = last
        while state >= 0 and word not in self.moves[state]:
            self.moves[state][word] = fresh
            state = self.link[state]
        if state < 0:
            return fresh
        onward = self.moves[state][word]
        if self.length[onward] == self.length[state] + 1:
            if fresh is not None:
                self.link[fresh] = onward
            return fresh if fresh is not None else onward
        copy = self._new(dict(self.moves[onward]), self.link[onward], self.length[state] + 1, self.first[onward])
        while state >= 0 and self.moves[state].get(word) == onward:
            self.moves[state][word] = copy
            state = self.link[state]
        self.link[onward] = copy
        if fresh is None:
            return copy
        self.link[fresh] = copy
        return fresh

    def covered(self, words: list, doc_id: int | None, window: int = WINDOW) -> np.ndarray:
        """Which words lie in a window that a reference with a smaller id (any, for None) holds."""
        hit = np.zeros(len(words) + 1, np.int64)
        state = length = 0
        for at, word in enumerate(words):
            while state and word not in self.moves[state]:
                state = self.link[state]
                length = self.length[state]
            state = self.moves[state].get(word, 0)
            length = length + 1 if state else 0
            while state and self.length[self.link[state]] >= window:
                state = self.link[state]
                length = self.length[state]
            if length >= window and (doc_id is None or self.first[state] < doc_id):
                hit[at - window + 1] += 1
                hit[at + 1] -= 1
        return np.cumsum(hit[:-1]) > 0


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours, in about log2(width) passes."""
    reach, out = 1, values
    while reach * 2 <= width:
        out = np.minimum(out[:-reach], out[reach:])
        reach *= 2
    rest = width - reach
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def segments(words: Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: (text, first word, windows, anchor, code of the run's words)."""
    codes, half = words.codes, window // 2
    valid = np.flatnonzero(words.room() >= window)
    if not len(valid):
        none = np.zeros(0, np.int64)
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    anchors = sliding_minimum(windows(codes, half, 21), window - half + 1)[valid]
    owner = words.owner()[valid]
    begins = np.ones(len(valid), bool)
    begins[1:] = (anchors[1:] != anchors[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(begins)
    count = np.diff(np.append(at, len(valid)))
    # the run's words are known by its windows taken together
    place = _odd(valid - np.repeat(valid[at], count))
    with np.errstate(over="ignore"):
        content = mix(np.add.reduceat(mix(windows(codes, window, 22)[valid]) * place, at))
    return owner[at], valid[at] - words.bounds[owner[at]], count, anchors[at], content


def _odd(steps: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(steps.astype(np.uint64) + np.uint64(77)) | np.uint64(1)


def _segment_rows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            owner, start, count, anchor, content = segments(split_words(piece.column("text"), lower=False), window)
            owner = pa.array(owner)
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc_id").take(owner), piece.column("row_key").take(owner), pa.array(start.astype(np.int32)),
                 pa.array(count.astype(np.int32)), pa.array(signed(anchor)), pa.array(signed(content))],
                names=["doc_id", "row_key", "start", "count", "anchor", "content"],
            )

    return tidy(run)


def _places(piece: pa.RecordBatch, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Absolute word positions of the (start, count) runs each row lists: owner, position, count."""
    runs = piece.column("runs")
    cuts = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(runs), 0))
    flat = pa.compute.list_flatten(runs)
    owner = np.repeat(np.arange(piece.num_rows), cuts)
    start = np.asarray(flat.field("start")).astype(np.int64) + bounds[owner]
    return owner, start, np.asarray(flat.field("count")).astype(np.int64)


def _window_rows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            words = split_words(piece.column("text"), lower=False)
            owner, start, count = _places(piece, words.bounds)
            total = np.cumsum(count)
            at = np.arange(int(count.sum())) - np.repeat(total - count - start, count)
            row = np.repeat(owner, count)
            one, two = windows(words.codes, window, 24)[at], windows(words.codes, window, 25)[at]
            row_ids = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc_id").take(row_ids), piece.column("row_key").take(row_ids),
                 pa.array((at - words.bounds[row]).astype(np.int32)), pa.array(signed(one)), pa.array(signed(two) >> 32, pa.int32(), safe=False)],
                names=["doc_id", "row_key", "start", "w1", "w2"],
            )

    return tidy(run)


def _kept_rows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            words = split_words(piece.column("text"), lower=False)
            owner, start, count = _places(piece, words.bounds)
            change = np.zeros(len(words.codes) + 1, np.int64)
            np.add.at(change, start, 1)
            np.add.at(change, start + count + window - 1, -1)
            gone = np.cumsum(change[:-1]) > 0
            kept = np.flatnonzero(~gone)
            # bytes of the kept words, each followed by a space
            size = words.ends[kept] - words.starts[kept] + 1
            ends = np.cumsum(size)
            source = np.arange(int(size.sum())) + np.repeat(words.starts[kept] - ends + size, size)
            source[ends - 1] = 0
            out = words.data[source] if len(source) else np.zeros(0, np.uint8)
            out[ends - 1] = 32
            per_text = np.searchsorted(kept, words.bounds, "left")
            text_ends = np.concatenate([[0], ends])[per_text]
            last = text_ends[1:][np.diff(text_ends) > 0] - 1
            out = np.delete(out, last)
            text_ends = text_ends - np.concatenate([[0], np.cumsum(np.diff(text_ends) > 0)])
            text = pa.LargeStringArray.from_buffers(
                piece.num_rows, pa.py_buffer(text_ends.astype(np.int64).tobytes()), pa.py_buffer(out.tobytes())
            ).cast(pa.string())
            removed = words.counts - np.diff(per_text)
            edge = np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))
            # spans never run from one text into the next
            opens, closes = edge == 1, edge == -1
            inner = words.bounds[1:-1]
            inner = inner[(inner > 0) & (inner < len(gone))]
            both = inner[gone[inner] & gone[inner - 1]] if len(inner) else inner
            opens[both] = closes[both] = True
            opens, closes = np.flatnonzero(opens), np.flatnonzero(closes)
            span_bounds = np.searchsorted(opens, words.bounds, "left")
            span_owner = np.repeat(np.arange(piece.num_rows), np.diff(span_bounds))
            spans = pa.StructArray.from_arrays(
                [pa.array(opens - words.bounds[span_owner]), pa.array(closes - words.bounds[span_owner])], names=["start", "end"]
            )
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc_id"), text, pa.array(words.counts.astype(np.int64)), pa.array(removed.astype(np.int64)),
                 pa.ListArray.from_arrays(pa.array(span_bounds.astype(np.int32)), spans)],
                names=["doc_id", "kept_text", "n_words", "n_removed", "spans"],
            )

    return tidy(run)


def _runs(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*_ROW).agg(F.collect_list(F.struct("start", "count")).alias("runs"))


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, kept_text, n_words, n_removed and removed word spans [start, end) of every row."""
    texts = in_small_batches(docs).select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("row_key"))
    row_code = F.xxhash64(*_ROW)
    found = texts.filter("doc_id IS NOT NULL").mapInArrow(
        _segment_rows(window), "doc_id long, row_key long, start int, count int, anchor long, content long"
    )
    shared = found.groupBy("anchor").agg(
        F.min("doc_id").alias("anchor_first"), F.max("doc_id").alias("last"), F.min("content").alias("low"), F.max("content").alias("high")
    ).filter("anchor_first < last").select("anchor", "anchor_first", (F.col("low") < F.col("high")).alias("varied"))
    shared = stored(shared)
    near = found.filter(likely_in(F.col("anchor"), shared, F.col("anchor")))  # made again rather than kept: it is the largest table
    repeated = stored(near.join(shared, "anchor"))
    uniform = repeated.filter("NOT varied AND anchor_first < doc_id").select(*_ROW, "start", "count")
    varied = repeated.filter("varied")
    firsts = varied.groupBy("anchor", "content").agg(F.min("doc_id").alias("first"))
    judged = stored(varied.join(firsts, ["anchor", "content"]).select(*_ROW, "start", "count", "first"))
    later = judged.filter("first < doc_id").select(*_ROW, "start", "count")
    unsure = judged.filter("first = doc_id")
    singles = stored(
        texts.filter(likely_in(row_code, unsure, row_code)).join(_runs(unsure), _ROW)
        .mapInArrow(_window_rows(window), "doc_id long, row_key long, start int, w1 long, w2 int")
    )
    window_firsts = stored(
        singles.groupBy("w1", "w2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
        .filter("first < last").select("w1", "w2", "first")
    )
    alone = singles.filter(likely_in(F.col("w1"), window_firsts, F.col("w1"))).join(window_firsts, ["w1", "w2"])
    alone = alone.filter("first < doc_id").select(*_ROW, "start", F.lit(1).alias("count"))
    runs = stored(_runs(uniform.unionByName(later).unionByName(alone)))
    touched = likely_in(row_code, runs, row_code)
    untouched = texts.filter(~touched).withColumn("runs", F.lit(None).cast(runs.schema["runs"].dataType))
    with_runs = texts.filter(touched).join(runs, _ROW, "left").select(*untouched.columns)
    schema = "doc_id long, kept_text string, n_words long, n_removed long, spans array<struct<start: long, end: long>>"
    return with_runs.unionByName(untouched).mapInArrow(_kept_rows(window), schema)
