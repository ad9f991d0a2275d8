"""Text scoring with a probabilistic suffix tree over words.

Tokens are the words of a text (A-Z lower-cased) and one end. The root predicts a token with (c + 1) / (N + V + 1).
A context of up to ``DEPTH`` tokens is a candidate state when some continuation of it is seen at least ``LEAST``
times, at any corpus size; only such continuations are recorded. A candidate stays a state when the divergence of its
next-token distribution from that of its longest suffix state passes ``DIVERGENCE`` (log10 units per occurrence).
Next-token distributions are smoothed: the mass of unrecorded continuations plus ``PRIOR`` counts is spread like the
distribution of the suffix state, so each sums to one. A token is scored in the longest suffix state of what stands
before it in its text.

The tree grows with the corpus and is a table of nodes, one row per code of a word, gram or state; nothing of it
passes the driver. The code of a gram is that of its context times a fixed odd number plus that of its last word, so a
counted gram needs only its last word beside it. Grams of one order are counted in at most ``COUNT_PASSES`` passes over the
texts, each for one range of codes; a level of the tree is joins of one order's counted grams with the order below.

The logarithm of a token's probability is that at the root plus one term per order: what a state spreads, or what a recorded
continuation gains over the order below. A text's score is therefore a sum of one number per occurrence of a code. Texts are
cut into blocks of about ``BLOCK_BYTES``; in ``SCORE_PASSES`` passes, each for one range of codes, the sorted codes of a block
meet the nodes of their bucket, and the sums go back to the rows. Shuffle files of a pass go with it, and tables that later
levels do not read are emptied, so the disk holds one pass, not the whole.

Nulls, empties, repeats: a null text is empty and scored for its end alone. Every row is scored; repeated training
rows count repeatedly. A row without an id belongs to the training rows. Very long texts are scored whole.
An empty table gives no rows.
Extra columns, of any name, are ignored.
"""

from __future__ import annotations

import os
import posixpath
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from mailsift.llm.words import in_small_batches, pieces, signed, split_words, stream, tidy
from mailsift.llm.storage import stored

DEPTH = 3
LEAST = 2
DIVERGENCE = 0.02
PRIOR = 2.0
END = np.uint64(0x5DEECE66D1CE4E5B)
#: Tokens whose counts a task gathers before it hands them on.
GATHER = 4_000_000
#: Bytes of text scored together.
BLOCK_BYTES = 1 << 22
#: Rows of a block at most: their numbers take two bytes. A piece has no more rows than a batch.
BLOCK_ROWS = 1 << 16
#: Passes over the texts, and the leading bits of a code that tell its bucket; grams of two tokens are counted in one pass.
COUNT_PASSES, COUNT_BITS = 2, 12
SCORE_PASSES, SCORE_BITS = 6, 10
#: Rows whose sums a task gathers before it hands them on.
SUMMED = 1 << 20
_STEP = stream(31, 1)[0] | np.uint64(1)
_BACK = np.uint64(pow(int(_STEP), -1, 1 << 64))
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@dataclass
class Tokens:
    """Token codes of a piece, each text closed by the end; ``place`` is the number of the token in its text."""

    codes: np.ndarray
    bounds: np.ndarray
    place: np.ndarray


def tokens(texts: pa.Array) -> Tokens:
    words = split_words(texts, lower=True)
    bounds = words.bounds + np.arange(len(words.bounds))
    codes = np.empty(bounds[-1], np.uint64)
    inner = np.ones(len(codes), bool)
    inner[bounds[1:] - 1] = False
    codes[inner] = words.codes
    codes[~inner] = END
    return Tokens(codes, bounds, np.arange(len(codes)) - np.repeat(bounds[:-1], np.diff(bounds)))


def gram_codes(codes: np.ndarray, order: int) -> np.ndarray:
    """Codes of the ``order`` tokens that end at each token."""
    total = codes.copy()
    with np.errstate(over="ignore"):
        for _ in range(1, min(order, len(codes))):
            total[1:] = total[:-1] * _STEP + codes[1:]
    return total


def _passed(df: DataFrame) -> DataFrame:
    """``df`` stored; the shuffle files behind it are removed."""
    conf = df.sparkSession.conf
    before = conf.get(_CLEANUP, None)
    conf.set(_CLEANUP, "true")
    try:
        return stored(df)
    finally:
        conf.unset(_CLEANUP) if before is None else conf.set(_CLEANUP, before)


def _emptied(df: DataFrame) -> None:
    """Frees the disk of a stored table that nothing reads any more."""
    for path in {posixpath.dirname(name) for name in df.inputFiles()}:
        df.sparkSession.range(0).write.mode("overwrite").parquet(path)


def _in_part(codes: np.ndarray, part: int, parts: int) -> np.ndarray:
    """Whether codes lie in one of ``parts`` equal ranges."""
    return ((codes >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32) == part


def _steps(codes: np.ndarray) -> bytes:
    """Sorted codes as differences; bytes of equal weight stand together, so that small numbers compress."""
    steps = codes.copy()
    steps[1:] -= codes[:-1]
    return steps.view(np.uint8).reshape(-1, 8).T.tobytes()


def _codes(data: pa.Scalar) -> np.ndarray:
    steps = np.ascontiguousarray(np.frombuffer(data.as_buffer(), np.uint8).reshape(8, -1).T).view(np.uint64).reshape(-1)
    return np.cumsum(steps, dtype=np.uint64)


def _bucket_cuts(codes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of sorted codes, and where they begin and end."""
    buckets = (codes >> np.uint64(64 - bits)).astype(np.int32)
    cuts = np.flatnonzero(np.diff(buckets, prepend=-1, append=-1))
    return buckets[cuts[:-1]], cuts


@tidy
def _word_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    gathered: list[np.ndarray] = []

    def counted() -> pa.RecordBatch:
        codes, counts = np.unique(np.concatenate(gathered), return_counts=True)
        gathered.clear()
        return pa.RecordBatch.from_arrays([pa.array(signed(codes)), pa.array(counts.astype(np.int64))], names=["code", "n"])

    size = 0
    for piece in pieces(batches):
        gathered.append(tokens(piece.column("text")).codes)
        size += len(gathered[-1])
        if size >= GATHER:
            yield counted()
            size = 0
    if gathered:
        yield counted()


def _gram_rows(k: int, part: int, parts: int):
    """(bucket, codes, words, counts): ``k``-grams of one range of codes with their last words, a gather at a time."""

    def counted(gathered: list) -> pa.RecordBatch:
        codes, words = (np.concatenate(side) for side in zip(*gathered))
        order = np.argsort(codes)
        codes = codes[order]
        first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
        counts = np.diff(np.append(first, len(codes))).astype(np.uint32)
        codes, words = codes[first], words[order[first]]
        buckets, cuts = _bucket_cuts(codes, COUNT_BITS)
        spans = list(zip(cuts[:-1], cuts[1:]))
        packed = [[_steps(codes[a:b]) for a, b in spans], [words[a:b].tobytes() for a, b in spans], [counts[a:b].tobytes() for a, b in spans]]
        return pa.RecordBatch.from_arrays([pa.array(buckets), *(pa.array(p, pa.binary()) for p in packed)], names=["bucket", "codes", "words", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered, size = [], 0
        for piece in pieces(batches):
            found = tokens(piece.column("text"))
            codes = gram_codes(found.codes, k)
            at = np.flatnonzero((found.place >= k - 1) & _in_part(codes, part, parts))
            if len(at):
                gathered.append((codes[at], found.codes[at]))
                size += len(at)
            if size >= GATHER:
                yield counted(gathered)
                gathered, size = [], 0
        if gathered:
            yield counted(gathered)

    return tidy(run)


def _repeated(least: int):
    """Of rows sorted by bucket, the (gram, context, n) seen at least ``least`` times."""

    def counted(held: list) -> pa.RecordBatch:
        codes, words, counts = (np.concatenate(side) for side in zip(*held))
        order = np.argsort(codes)
        codes = codes[order]
        first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
        n = np.add.reduceat(counts[order].astype(np.int64), first)
        often = n >= least
        first = first[often]
        codes, words = codes[first], words[order[first]]
        with np.errstate(over="ignore"):
            contexts = (codes - words) * _BACK
        return pa.RecordBatch.from_arrays([pa.array(signed(codes)), pa.array(signed(contexts)), pa.array(n[often])], names=["gram", "context", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        current = None
        for batch in batches:
            for bucket, codes, words, counts in zip(*(batch.column(c) for c in ("bucket", "codes", "words", "counts"))):
                if held and bucket != current:
                    yield counted(held)
                    held = []
                current = bucket
                held.append((_codes(codes), np.frombuffer(words.as_buffer(), np.uint64), np.frombuffer(counts.as_buffer(), np.uint32)))
        if held:
            yield counted(held)

    return tidy(run)


@dataclass
class Tree:
    """Sorted codes with what is looked up for them; a level holds grams (context + token) and states (contexts)."""

    total: int
    distinct: int
    words: np.ndarray
    word_counts: np.ndarray
    gram_codes: list[np.ndarray]
    gram_scores: list[np.ndarray]
    state_codes: list[np.ndarray]
    state_rest: list[np.ndarray]

    @property
    def root_norm(self) -> float:
        return float(np.log10(self.total + self.distinct + 1.0))


def _find(table: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Index of each code in the sorted table, -1 where it is not."""
    if not len(table):
        return np.full(len(codes), -1)
    at = np.minimum(np.searchsorted(table, codes), len(table) - 1)
    return np.where(table[at] == codes, at, -1)


def token_counts(training: DataFrame) -> DataFrame:
    """(code, n): how often each distinct token occurs."""
    return training.select("text").mapInArrow(_word_rows, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def gram_counts(training: DataFrame, k: int, least: int = LEAST) -> DataFrame:
    """(gram, context, n) of the grams of ``k`` tokens seen at least ``least`` times."""
    texts, found = training.select("text"), []
    parts = 1 if k == 2 else COUNT_PASSES
    for part in range(parts):
        rows = texts.mapInArrow(_gram_rows(k, part, parts), "bucket int, codes binary, words binary, counts binary")
        dealt = rows.repartition("bucket").sortWithinPartitions("bucket")
        found.append(_passed(dealt.mapInArrow(_repeated(least), "gram long, context long, n long")))
    return reduce(DataFrame.unionByName, found)


@tidy
def _lower_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """With ``lower``, the gram without its first word, in place of that of the context."""
    for batch in batches:
        gram, context, lower = (np.asarray(batch.column(c)).astype(np.int64).view(np.uint64) for c in ("gram", "context", "lower"))
        with np.errstate(over="ignore"):
            shorter = gram - (context - lower) * _STEP
        yield batch.set_column(batch.schema.get_field_index("lower"), "lower", pa.array(signed(shorter)))


def fit_nodes(
    training: DataFrame, counts: DataFrame, depth: int = DEPTH, least: int = LEAST, divergence: float = DIVERGENCE, prior: float = PRIOR,
    scores: bool = False,
) -> tuple[int, int, DataFrame]:
    """(tokens, distinct tokens, nodes) of the training texts.

    Nodes have a row per word with its ``n``, per state with its ``rest``, and per recorded gram in a state with its ``gain``: its score less
    that of the order below and the state's rest. With ``scores`` the last have their ``score`` too.
    """
    sums = counts.agg(F.sum("n"), F.count("*")).first()
    total, distinct = int(sums[0] or 0), int(sums[1])
    n, size, recorded, rest, back, own = map(F.col, ("n", "size", "recorded", "rest", "back", "own"))
    nothing = F.lit(None).cast("double")
    root = F.log10(n + 1.0) - F.lit(float(np.log10(total + distinct + 1.0)))
    nodes = [counts.select("code", n.cast("double").alias("n"), nothing.alias("score"), nothing.alias("gain"), nothing.alias("rest"))]
    known = counts.select("code", F.lit(0).cast("long").alias("lower"), "n", root.alias("score"))
    inside = Window.partitionBy("context")
    for k in range(2, depth + 2):
        grams = gram_counts(training, k, least)
        sizes = known.select(F.col("code").alias("context"), n.alias("size"), "lower")
        placed = _passed(grams.join(sizes, "context").withColumn("recorded", F.sum("n").over(inside)))
        _emptied(grams)
        backs = known.select(F.col("code").alias("lower"), F.col("score").alias("back"))
        table = _passed(placed.mapInArrow(_lower_rows, placed.schema).join(backs, "lower"))
        _emptied(placed)
        if k > 2:
            _emptied(known)
        sized = table.withColumn("rest", (size - recorded + prior) / (size + prior)).withColumn(
            "own", F.log10(n / (size + prior) + rest * F.pow(F.lit(10.0), back))
        )
        unseen = F.greatest(size - recorded, F.lit(0)) * F.log10(rest)
        judged = sized.withColumn("mine", F.sum(n * (own - back)).over(inside) + unseen >= F.lit(divergence) * size).withColumn(
            "first", F.row_number().over(inside.orderBy("gram")) == 1
        )
        known = _passed(judged.select(
            F.col("gram").alias("code"), "lower", "n", F.when(F.col("mine"), own).otherwise(back).alias("score"), F.when(F.col("mine"), own - back).alias("gain"),
            F.when(F.col("mine"), F.log10(rest)).alias("rest"), F.when(F.col("mine") & F.col("first"), F.col("context")).alias("state"),
        ))
        _emptied(table)
        recordings = known.filter("gain IS NOT NULL").select(
            "code", nothing.alias("n"), (F.col("score") if scores else nothing).alias("score"), (F.col("gain") - rest).alias("gain"), nothing.alias("rest")
        )
        states = known.filter("state IS NOT NULL").select(F.col("state").alias("code"), nothing.alias("n"), nothing.alias("score"), nothing.alias("gain"), "rest")
        nodes.append(_passed(recordings.unionByName(states)))
    _emptied(known)
    return total, distinct, reduce(DataFrame.unionByName, nodes)


def planted(total: int, distinct: int, nodes: pa.Table, depth: int) -> Tree:
    """The tree of some nodes. A code tells its order, so levels share their arrays."""
    codes = nodes.column("code").to_numpy().astype(np.int64).view(np.uint64)

    def held(name: str) -> tuple[np.ndarray, np.ndarray]:
        values = nodes.column(name).to_numpy().astype(float)
        there = np.flatnonzero(~np.isnan(values))
        there = there[np.argsort(codes[there])]
        return codes[there], values[there]

    (words, number), (grams, score), (states, rest) = map(held, ("n", "score", "rest"))
    return Tree(total, distinct, words, number, [grams] * depth, [score] * depth, [states] * depth, [rest] * depth)


def fit_tree(training: DataFrame, counts: DataFrame, depth: int = DEPTH, least: int = LEAST, **options) -> Tree:
    """The whole tree on the driver: for small training sets only."""
    total, distinct, nodes = fit_nodes(training, counts, depth, least, scores=True, **options)
    return planted(total, distinct, nodes.toArrow(), depth)


def adjustments(tree: Tree, found: Tokens, rank: np.ndarray) -> np.ndarray:
    """For each token its log10 probability in its suffix state less that at the root; ``rank`` is its word."""
    root = np.log10(tree.word_counts + 1.0) - tree.root_norm
    out = np.zeros(len(found.codes))
    open_at = np.arange(len(found.codes))
    for k in range(len(tree.gram_codes) + 1, 1, -1):
        context = gram_codes(found.codes, k - 1)
        at = open_at[found.place[open_at] >= k - 1]
        state = _find(tree.state_codes[k - 2], context[at - 1])
        at, state = at[state >= 0], state[state >= 0]
        held = _find(tree.gram_codes[k - 2], gram_codes(found.codes, k)[at])
        done = at[held >= 0]
        out[done] += tree.gram_scores[k - 2][held[held >= 0]] - root[rank[done]]
        out[at[held < 0]] += tree.state_rest[k - 2][state[held < 0]]
        still = np.ones(len(found.codes), bool)
        still[done] = False
        open_at = open_at[still[open_at]]
    return out


@tidy
def _block_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows with the number of their block, drawn at random, and theirs within it; to be stored before use."""
    size, block, row = BLOCK_BYTES, 0, 0
    for piece in pieces(batches):
        if size >= BLOCK_BYTES or row + piece.num_rows > BLOCK_ROWS:
            size, block, row = 0, int.from_bytes(os.urandom(8), "little") >> 1, 0
        size += piece.column("text").nbytes
        sizes = np.diff(tokens(piece.column("text")).bounds)
        blocks, rows = np.full(piece.num_rows, block, np.int64), np.arange(row, row + piece.num_rows, dtype=np.int32)
        row += piece.num_rows
        yield pa.RecordBatch.from_arrays(
            [pa.array(blocks), pa.array(rows), piece.column("doc_id"), pa.array(sizes.astype(np.int64)), piece.column("text")],
            names=["block", "row", "doc_id", "n_tokens", "text"],
        )


def _asked_rows(depth: int, part: int):
    """(bucket, block, codes, rows): codes of one range that the texts of a block have, each with its row, as far as one task reads it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered: list[tuple[np.ndarray, np.ndarray]] = []
        current = None

        def asked() -> pa.RecordBatch:
            codes, rows = (np.concatenate(side) for side in zip(*gathered))
            gathered.clear()
            order = np.argsort(codes)
            codes, rows = codes[order], rows[order]
            buckets, cuts = _bucket_cuts(codes, SCORE_BITS)
            spans = list(zip(cuts[:-1], cuts[1:]))
            return pa.RecordBatch.from_arrays(
                [pa.array(buckets), pa.array(np.full(len(buckets), current, np.int64)), pa.array([_steps(codes[a:b]) for a, b in spans], pa.binary()),
                 pa.array([rows[a:b].tobytes() for a, b in spans], pa.binary())],
                names=["bucket", "block", "codes", "rows"],
            )

        for batch in batches:
            blocks = np.asarray(batch.column("block"))
            cuts = np.flatnonzero(np.diff(blocks, prepend=blocks[:1] - 1, append=blocks[-1:] + 1))
            for first, last in zip(cuts[:-1], cuts[1:]):
                if gathered and blocks[first] != current:
                    yield asked()
                current = blocks[first]
                for piece in pieces(iter([batch.slice(first, last - first)])):
                    found = tokens(piece.column("text"))
                    owner = np.repeat(np.asarray(piece.column("row")).astype(np.uint16), np.diff(found.bounds))
                    for k in range(1, depth + 2):
                        codes = gram_codes(found.codes, k)
                        at = np.flatnonzero((found.place >= k - 1) & _in_part(codes, part, SCORE_PASSES))
                        if len(at):
                            gathered.append((codes[at], owner[at]))
        if gathered:
            yield asked()

    return tidy(run)


@tidy
def _summed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, row, base, known, gain) sums; in a bucket its nodes stand before what asks for them."""
    current, held, table = None, [], None
    sums: dict[int, np.ndarray] = {}

    def handed() -> pa.RecordBatch:
        block = np.repeat(np.array(list(sums), np.int64), [total.shape[1] for total in sums.values()])
        row = np.concatenate([np.arange(total.shape[1], dtype=np.int32) for total in sums.values()])
        values = np.concatenate(list(sums.values()), axis=1)
        there = np.flatnonzero(values.any(axis=0))
        sums.clear()
        return pa.RecordBatch.from_arrays([pa.array(x[there]) for x in (block, row, *values)], names=["block", "row", "base", "known", "gain"])

    for batch in batches:
        buckets, asks = np.asarray(batch.column("bucket")), np.asarray(batch.column("block").is_valid())
        cuts = np.flatnonzero(np.diff(buckets.astype(np.int64) * 2 + asks, prepend=-1, append=-1))
        for first, last in zip(cuts[:-1], cuts[1:]):
            if buckets[first] != current:
                current, held, table = buckets[first], [], None
            if not asks[first]:
                held.append([np.asarray(batch.column(c).slice(first, last - first)) for c in ("code", "n", "gain")])
                continue
            if not held:
                continue
            if table is None:
                code, n, gain = (np.concatenate(side) for side in zip(*held))
                code, which = np.unique(code.astype(np.int64).view(np.uint64), return_inverse=True)
                n, gain = np.bincount(which, weights=n), np.bincount(which, weights=gain)
                table = code, np.log10(n + 1.0), (n > 0).astype(float), gain
            for at in range(first, last):
                found = _find(table[0], _codes(batch.column("codes")[at]))
                there = np.flatnonzero(found >= 0)
                if not len(there):
                    continue
                rows, found = np.frombuffer(batch.column("rows")[at].as_buffer(), np.uint16)[there], found[there]
                block = batch.column("block")[at].as_py()
                total = sums.get(block, np.zeros((3, 0)))
                more = np.stack([np.bincount(rows, weights=values[found], minlength=total.shape[1]) for values in table[1:]])
                more[:, : total.shape[1]] += total
                sums[block] = more
            if sum(total.shape[1] for total in sums.values()) >= SUMMED:
                yield handed()
    if sums:
        yield handed()


def score_texts(docs: DataFrame, total: int, distinct: int, nodes: DataFrame, depth: int = DEPTH) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of every row."""
    keyed = docs.select(F.col("doc_id").cast("long"), "text")
    blocks = _passed(keyed.mapInArrow(_block_rows, "block long, row int, doc_id long, n_tokens long, text string"))
    held = lambda name: F.coalesce(name, F.lit(0.0))
    bucket = F.shiftrightunsigned("code", 64 - SCORE_BITS).cast("int").alias("bucket")
    values = nodes.select(bucket, "code", held("n").alias("n"), (held("gain") + held("rest")).alias("gain"))
    added = [F.sum(name).alias(name) for name in ("base", "known", "gain")]
    found = []
    for part in range(SCORE_PASSES):
        asked = blocks.select("block", "row", "text").mapInArrow(_asked_rows(depth, part), "bucket int, block long, codes binary, rows binary")
        mine = values.filter(F.shiftright(F.shiftrightunsigned("code", 32) * SCORE_PASSES, 32) == part)
        both = asked.unionByName(mine, allowMissingColumns=True)
        dealt = both.repartition("bucket").sortWithinPartitions("bucket", F.col("block").asc_nulls_first())
        sums = dealt.mapInArrow(_summed_rows, "block long, row int, base double, known double, gain double")
        found.append(_passed(sums.groupBy("block", "row").agg(*added)))
    sums = reduce(DataFrame.unionByName, found).groupBy("block", "row").agg(*added)
    n_tokens = F.col("n_tokens")
    base = held("base") - n_tokens * F.lit(float(np.log10(total + distinct + 1.0)))
    return blocks.drop("text").join(sums, ["block", "row"], "left").select(
        "doc_id", "n_tokens", held("known").cast("long").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        base.alias("base_score"), (base + held("gain")).alias("score"),
    )


def held_out(doc_id: Column, parts: int = 7, part: int = 2) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % parts == part, F.lit(False))


def score_corpus(docs: DataFrame, out: Column, **options) -> DataFrame:
    """Learns from the rows where ``out`` is false and scores all rows."""
    training = in_small_batches(docs).filter(~out)
    counts = _passed(token_counts(training))
    return score_texts(docs, *fit_nodes(training, counts, **options), options.get("depth", DEPTH))
