"""Hard negatives by exact inner products, scored with Four-Russians tables.

Components are whole numbers, ``floor(SCALE * x)``. A candidate is stored as bit planes: for every plane of its
two's complement components and every group of eight dimensions one byte, whose bits are the group's components at
that plane. An anchor has for every group a table of the 256 subset sums of its components; the byte of a plane
looks up what that plane adds to the score, and lookups are shifted by the plane and added (the sign plane is
subtracted). That gives the full, exact inner product without a multiplication.

Two passes over the same tiles of anchor and candidate blocks: the first keeps each anchor's best rows of its own
label (positives), tile by tile and then over all tiles; the second looks, for each positive, for the best rows of
other labels in the band between ``LEAST`` and ``MOST`` per cent of the positive's score.

Scale: a task holds ``BLOCK`` candidates' bytes, ``ANCHOR_BLOCK`` anchors and the scores of ``STEP`` anchors; candidates
are shuffled as packed bytes once per block of anchors, and a tile hands on at most its best few of every anchor. Blocks are
dealt by hash of the whole row and a row's number, so a vector that very many rows share is spread over all blocks. The number
of planes is that of the largest component of the table, found by an aggregate.

Nulls, empties, repeats: a row whose id, label or vector is null, or that holds a null or non-finite component, takes no
part. Missing components of the shorter of two vectors count as 0, an empty vector scores 0. An anchor's own id is left
out of its positives and negatives; other repeated rows are rows of their own (ties of score and id are alike); a
repeated anchor id asks once, with its smallest label and vector. Very large components are exact as long as a sum of
products fits 63 bits, which is checked; beyond that the job fails rather than wrap. An empty table gives no rows. Extra columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from mailsift.llm.storage import stored
from mailsift.llm.words import tidy

SCALE = 256
BLOCK = 8192
ANCHOR_BLOCK = 512
#: Anchors scored at a time.
STEP = 16
GROUP = 8
POSITIVES, NEGATIVES = 5, 3
#: A negative's score lies between these per cent of the positive's.
LEAST, MOST = 50, 95


def integer_rows(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, weights) of the rows that take part."""
    value = F.col("embedding")
    finite = F.forall(value, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)) & ~F.isnan(x.cast("double")))
    whole = F.transform(value, lambda x: F.floor(x.cast("double") * SCALE).cast("long"))
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & value.isNotNull() & finite
    return vectors.filter(usable).select(F.col("vec_id").cast("long"), F.col("label").cast("long"), whole.alias("weights"))


def packed(weights: np.ndarray, planes: int) -> np.ndarray:
    """Bit-plane bytes (row, plane, group) of whole numbers (row, dimension) in two's complement."""
    rows, dims = weights.shape
    wide = np.zeros((rows, -(-dims // GROUP) * GROUP), np.int64)
    wide[:, :dims] = weights
    out = np.empty((rows, planes, wide.shape[1] // GROUP), np.uint8)
    for plane in range(planes):
        out[:, plane] = np.packbits(((wide >> plane) & 1).astype(np.uint8), axis=1, bitorder="little")
    return out


def subset_sums(anchors: np.ndarray) -> np.ndarray:
    """Tables (group, byte, anchor): the sum of the group's components whose bits the byte holds."""
    count, dims = anchors.shape
    wide = np.zeros((count, -(-dims // GROUP) * GROUP), np.int64)
    wide[:, :dims] = anchors
    parts = wide.reshape(count, -1, GROUP).transpose(1, 2, 0)
    table = np.zeros((parts.shape[0], 1, count), np.int64)
    for bit in range(GROUP):
        table = np.concatenate([table, table + parts[:, bit, None]], axis=1)
    return table


def scores(codes: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """Inner products (candidate, anchor) by shifted lookups; ``codes`` is (plane, group, candidate)."""
    planes, groups, count = codes.shape
    # Sums of one plane stay below the sum of the largest subsets; narrow numbers halve the memory that lookups touch.
    narrow = int(np.abs(tables).max(axis=1, initial=0).sum(axis=0).max(initial=0)) < 1 << 31
    tables = np.ascontiguousarray(tables, np.int32 if narrow else np.int64)
    total = np.zeros((count, tables.shape[2]), np.int64)
    layer, found = np.empty(total.shape, tables.dtype), np.empty(total.shape, tables.dtype)
    for plane in range(planes):
        layer[:] = 0
        for group in range(groups):
            np.take(tables[group], codes[plane, group], axis=0, out=found, mode="clip")
            layer += found
        shifted = layer.astype(np.int64) << plane
        total += -shifted if plane == planes - 1 else shifted
    return total


def _dense(rows: list, dims: int) -> np.ndarray:
    out = np.zeros((len(rows), dims), np.int64)
    for at, row in enumerate(rows):
        out[at, : len(row)] = row
    return out


def _packer(planes: int, dims: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = packed(_dense(batch.column("weights").to_pylist(), dims), planes)
            size = codes.shape[1] * codes.shape[2]
            data = pa.array([row.tobytes() for row in codes] if size else [b""] * len(codes), pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(name) for name in ("row", "vec_id", "label")), data], names=["row", "vec_id", "label", "codes"])

    return run


def _tile(planes: int, dims: int, largest: int, choose: Callable, names: tuple[str, ...]):
    """Runs ``choose(anchor row, ids, labels, scores)`` for every anchor of a tile and gathers what it returns."""
    groups = -(-dims // GROUP)

    def run(table: pa.Table) -> pa.Table:
        asks = np.asarray(table.column("asks").combine_chunks())
        anchors, others = table.filter(pa.array(asks)), table.filter(pa.array(~asks))
        found: list[list[tuple]] = []
        if len(anchors) and len(others):
            ids, labels = np.asarray(others.column("vec_id")), np.asarray(others.column("label"))
            flat = np.frombuffer(b"".join(others.column("codes").to_pylist()), np.uint8)
            codes = np.ascontiguousarray(flat.reshape(len(ids), planes, groups).transpose(1, 2, 0)).astype(np.intp)
            listed = anchors.select(["vec_id", "label", "weights", "positives"]).to_pylist()
            for first in range(0, len(listed), STEP):
                some = listed[first : first + STEP]
                weights = _dense([a["weights"] for a in some], dims)
                if max(sum(map(abs, a["weights"])) for a in some) * largest >= 1 << 62:
                    raise OverflowError("inner products of components this large do not fit 63 bits")
                reached = np.ascontiguousarray(scores(codes, subset_sums(weights)).T)
                for anchor, row in zip(some, reached):
                    found.extend(choose(anchor, ids, labels, row))
        columns = list(zip(*found)) if found else [[] for _ in names]
        return pa.table({name: pa.array(np.concatenate(c) if len(c) else [], pa.int64()) for name, c in zip(names, columns)})

    return run


def _best(ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best, higher scores first, ties by smaller id."""
    place = np.arange(len(ids))
    if len(ids) > k:
        place = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
    return place[np.lexsort((ids[place], -score[place]))[:k]]


def _positives(k: int) -> Callable:
    def choose(anchor: dict, ids: np.ndarray, labels: np.ndarray, score: np.ndarray) -> list[tuple]:
        own = np.flatnonzero((labels == anchor["label"]) & (ids != anchor["vec_id"]))
        own = own[_best(ids[own], score[own], k)]
        return [(np.full(len(own), anchor["vec_id"]), ids[own], score[own])]

    return choose


def _negatives(k: int, least: int, most: int) -> Callable:
    def choose(anchor: dict, ids: np.ndarray, labels: np.ndarray, score: np.ndarray) -> list[tuple]:
        out = []
        other = np.flatnonzero((labels != anchor["label"]) & (ids != anchor["vec_id"]))
        rows, values = ids[other], score[other]
        for number, positive in enumerate(anchor["positives"]):
            # In whole numbers: least * positive <= 100 * value <= most * positive.
            low, high = -(-least * positive["score"] // 100), most * positive["score"] // 100
            fit = np.flatnonzero((values >= low) & (values <= high))
            fit = fit[_best(rows[fit], values[fit], k)]
            full = lambda x: np.full(len(fit), x)  # noqa: E731, B023
            out.append((full(anchor["vec_id"]), full(number), full(positive["vec_id"]), full(positive["score"]), rows[fit], values[fit]))
        return out

    return choose


def mine(
    vectors: DataFrame, asked: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST, most: int = MOST,
    block: int = BLOCK, anchor_block: int = ANCHOR_BLOCK,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    ``asked`` says over vec_id which rows are anchors. Positives are numbered by score; a repeated positive row keeps its negatives.
    """
    rows = stored(integer_rows(vectors).withColumn("row", F.monotonically_increasing_id()))
    size = F.coalesce(F.max(F.array_max(F.transform("weights", lambda x: F.abs(x)))), F.lit(0))
    facts = rows.agg(F.count("*").alias("n"), F.count(F.when(asked, 1)).alias("asked"), size.alias("largest"), F.max(F.size("weights")).alias("dims")).first()
    planes, dims, largest = int(facts.largest).bit_length() + 1, facts.dims or 0, int(facts.largest)
    blocks, anchor_blocks = -(-facts.n // block) or 1, -(-facts.asked // anchor_block) or 1
    codes = stored(rows.mapInArrow(tidy(_packer(planes, dims)), "row long, vec_id long, label long, codes binary"))
    anchors = rows.filter(asked).groupBy("vec_id").agg(F.min(F.struct("label", "weights")).alias("own"))
    anchors = stored(anchors.select("vec_id", "own.*", F.expr("CAST(NULL AS array<struct<vec_id: long, score: long>>)").alias("positives")))

    def tiles(asking: DataFrame, choose: Callable, *names: str) -> DataFrame:
        within = lambda n, key: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        asks = asking.select(
            every(blocks).alias("block"), within(anchor_blocks, "vec_id").alias("anchor_block"), F.lit(True).alias("asks"), "vec_id", "label",
            "weights", "positives", F.lit(None).cast("binary").alias("codes"),
        )
        held = codes.select(
            within(blocks, "row").alias("block"), every(anchor_blocks).alias("anchor_block"), F.lit(False).alias("asks"), "vec_id", "label", "codes"
        )
        run = _tile(planes, dims, largest, choose, names)
        both = asks.unionByName(held, allowMissingColumns=True)
        return both.groupBy("block", "anchor_block").applyInArrow(run, ", ".join(f"{name} long" for name in names))

    near = tiles(anchors, _positives(positives), "anchor_id", "positive_id", "score")
    place = F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.desc("score"), "positive_id"))
    first = near.withColumn("place", place).filter(F.col("place") <= positives)
    listed = first.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("place", F.col("positive_id").alias("vec_id"), "score"))).alias("all"))
    known = listed.select(F.col("anchor_id").alias("vec_id"), F.transform("all", lambda x: F.struct(x["vec_id"], x["score"])).alias("positives"))
    asking = stored(anchors.drop("positives").join(known, "vec_id"))
    names = ("anchor_id", "number", "positive_id", "positive_score", "negative_id", "negative_score")
    hard = tiles(asking, _negatives(negatives, least, most), *names)
    rank = F.row_number().over(Window.partitionBy("anchor_id", "number").orderBy(F.desc("negative_score"), "negative_id"))
    return hard.withColumn("rank", rank).filter(F.col("rank") <= negatives).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )
