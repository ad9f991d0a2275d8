"""Near duplicates under weighted Jaccard of word shingles, by BagMinHash.

A text is the multiset of its five-word shingles (a text of one to four words is a single shingle). Weights are
discretised to whole counts. Count axis [0, oo) of a shingle is cut into dyadic intervals [0,1), [1,2), [2,4), ...;
each interval owns a Poisson process whose rate is its length, and a point belongs to a text when its place on the
axis lies below the shingle's count there (thinning). Every point falls into one of ``REGISTERS`` registers; the
signature keeps the earliest point of each register, so two texts agree in a register with probability equal to
their weighted Jaccard. Points are drawn in time order up to a horizon at which all registers are expected to be
filled, and further for the texts where one is not: few points per shingle for long texts, whatever the weights.

Registers are cut into bands. Texts that share a band meet, and every pair that is reported was verified on the
exact multiset overlap. Result: one row per document with the smallest id of its class; classes are the connected
components of verified links.

Large groups: texts with the same shingle multiset are folded first. Then every member of a shared bucket is compared
with the first member, so a group of copies costs comparisons linear in its size. Buckets in which different classes
are left are compared in full between the classes: small ones pair by pair, crowded ones in tiles of bounded size.

Nulls, empties, repeats: a null text has no words. Documents without words, and rows without an id, are in no
class with others (class = own id). Rows with equal ids are one document. Very long texts are signed and
compared whole. Of equal candidates the smaller id leads. An empty table gives no rows. Extra columns, of any name, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from mailsift.llm.natives import likely_in
from mailsift.llm.storage import stored
from mailsift.llm.words import grams, in_small_batches, lists, mix, pieces, signed, split_words, stream, tidy
from mailsift.operators.graph import component_labels

SHINGLE = 5
SIMILARITY = 0.8
#: A power of two, at most 2048: the low bits of a point are its register, the high bits its time.
REGISTERS = 128
BAND = 5
#: Up to so many members a bucket is compared pair by pair, above it tile by tile; the links are the same.
CROWDED = 8
#: Shingles of a tile; each text counts as ``TEXT_COST`` more, which bounds the texts of a tile too.
TILE = 250_000
TEXT_COST = 100
_AXIS = stream(11, 64)
_POINT = stream(12, 4)


def shingle_bags(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text: (text number, code, count), sorted by text and code, and shingles per text."""
    words = split_words(texts, lower=True)
    counts = words.counts
    owner = words.owner()
    keep = words.room() >= SHINGLE
    codes, owner = grams(words.codes, SHINGLE)[keep] if len(owner) else words.codes, owner[keep]
    for n in range(1, SHINGLE):
        short = np.flatnonzero(counts == n)
        if len(short):
            codes = np.concatenate([codes, grams(words.codes, n)[words.bounds[short]]])
            owner = np.concatenate([owner, short])
    order = np.argsort(codes)
    order = order[np.argsort(owner[order].astype(np.uint16 if len(counts) < 65536 else np.int64), kind="stable")]
    codes, owner = codes[order], owner[order]
    fresh = np.ones(len(codes), bool)
    fresh[1:] = (codes[1:] != codes[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(fresh)
    weight = np.diff(np.append(first, len(codes)))
    return owner[first], codes[first], weight, np.bincount(owner, minlength=len(counts))


def _uniform(bits: np.ndarray) -> np.ndarray:
    """Of (0, 1]."""
    return ((bits >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0**-53


def bag_signatures(owner: np.ndarray, codes: np.ndarray, weight: np.ndarray, texts: int, registers: int) -> np.ndarray:
    """Earliest point of each register, one row per text; infinite only for texts without shingles."""
    seeds, owners, rates, lows, weights = [mix(codes ^ _AXIS[0])], [owner], [np.ones(len(codes))], [np.zeros(len(codes))], [weight]
    level = 1
    while True:
        low = 1 << (level - 1)
        some = np.flatnonzero(weight > low)
        if not len(some):
            break
        seeds.append(mix(codes[some] ^ _AXIS[level]))
        owners.append(owner[some])
        rates.append(np.full(len(some), float(low)))
        lows.append(np.full(len(some), float(low)))
        weights.append(weight[some])
        level += 1
    seed, of, rate, low, bound = map(np.concatenate, (seeds, owners, rates, lows, weights))
    partial = low + rate > bound
    total = np.bincount(owner, weights=weight, minlength=texts)
    signature = np.full(texts * registers, np.inf)
    pending = total > 0
    horizon = np.where(pending, registers * (np.log(registers) + 3.0) / np.maximum(total, 1), 0.0)
    while pending.any():
        live = np.flatnonzero(pending[of])
        at = np.zeros(len(live))
        arrival = 0
        while len(live):
            block = int(np.clip(16384 // len(live), 1, 64))
            with np.errstate(over="ignore"):
                bits = mix(seed[live][:, None] + np.arange(arrival, arrival + block, dtype=np.uint64)[None, :] * _POINT[0])
            times = np.empty((len(live), block + 1))
            times[:, 0] = at
            np.divide(-np.log(_uniform(bits)), rate[live][:, None], out=times[:, 1:])
            times = np.cumsum(times, axis=1)[:, 1:]  # one arrival after the other, however they are blocked
            hit = times <= horizon[of[live]][:, None]
            row, col = np.nonzero(hit)
            source, point, when = live[row], bits[row, col], times[row, col]
            thin = np.flatnonzero(partial[source])
            if len(thin):
                some = source[thin]
                outside = low[some] + _uniform(mix(point[thin] ^ _POINT[2])) * rate[some] > bound[some]
                inside = np.ones(len(source), bool)
                inside[thin[outside]] = False
                source, point, when = source[inside], point[inside], when[inside]
            place = (point & np.uint64(registers - 1)).astype(np.int64) + of[source] * registers
            np.minimum.at(signature, place, when)
            going = hit[:, -1]
            live, at = live[going], times[going, -1]
            arrival += block
        pending &= np.isinf(signature.reshape(texts, registers)).any(axis=1)
        horizon *= 2.0
    return signature.reshape(texts, registers)


def band_keys(signature: np.ndarray, band: int) -> np.ndarray:
    bits = signature.view(np.uint64)
    bands = bits.shape[1] // band
    factors = stream(13, band) | np.uint64(1)
    with np.errstate(over="ignore"):
        folded = (bits[:, : bands * band].reshape(len(bits), bands, band) * factors).sum(axis=2, dtype=np.uint64)
        return mix(folded + stream(14, bands)[None, :])


def occurrence_codes(codes: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Multiset as a set: the k-th occurrence of a shingle has a code of its own."""
    first = np.cumsum(weight) - weight
    with np.errstate(over="ignore"):
        nth = (np.arange(int(weight.sum())) - np.repeat(first, weight)).astype(np.uint64)
        return mix(np.repeat(codes, weight) + nth * _POINT[3])


def _signature_rows(registers: int, band: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            owner, codes, weight, sizes = shingle_bags(piece.column("text"))
            texts = piece.num_rows
            keys = band_keys(bag_signatures(owner, codes, weight, texts, registers), band)
            single = occurrence_codes(codes, weight)
            belongs = np.repeat(owner, weight)
            digests = []
            for salt in stream(15, 2):
                folded = np.zeros(texts, np.uint64)
                np.add.at(folded, belongs, mix(single ^ salt))
                digests.append(pa.array(signed(folded)))
            has = np.flatnonzero(sizes > 0)
            counts = np.zeros(texts, np.int64)
            counts[has] = keys.shape[1]
            bounds = np.concatenate([[0], np.cumsum(counts)])
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc_id"), *digests, pa.array(sizes.astype(np.int64)),
                 lists(signed(keys[has].ravel()), bounds, pa.int64())],
                names=["doc_id", "d1", "d2", "size", "keys"],
            )

    return tidy(run)


@tidy
def _bag_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in pieces(batches):
        owner, codes, weight, sizes = shingle_bags(piece.column("text"))
        single, belongs = occurrence_codes(codes, weight), np.repeat(owner, weight)
        order = np.lexsort((single, belongs))
        ends = np.cumsum(sizes)
        raw = single[order].tobytes()
        blobs = [raw[8 * (e - s) : 8 * e] for s, e in zip(sizes.tolist(), ends.tolist())]
        yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(blobs, pa.binary())], names=["doc_id", "bag"])


def overlaps(left: pa.Array, right: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Shared elements and union sizes of paired bags."""
    both = []
    for side in (left, right):
        side = side.cast(pa.large_binary())
        _, offsets, data = side.buffers()
        cuts = np.frombuffer(offsets, np.int64)[side.offset : side.offset + len(side) + 1]
        both.append((np.frombuffer(data, np.uint64, count=(cuts[-1] - cuts[0]) // 8, offset=cuts[0]), np.diff(cuts) // 8))
    pair = np.concatenate([np.repeat(np.arange(len(left)), sizes) for _, sizes in both])
    codes = np.concatenate([values for values, _ in both])
    order = np.lexsort((codes, pair))
    codes, pair = codes[order], pair[order]
    twice = (codes[1:] == codes[:-1]) & (pair[1:] == pair[:-1])
    shared = np.bincount(pair[1:][twice], minlength=len(left))
    return shared, both[0][1] + both[1][1] - shared


def _verified(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(iter([batch]), "left_bag"):
                shared, union = overlaps(piece.column("left_bag"), piece.column("right_bag"))
                good = pa.array(shared >= similarity * union - 1e-9)
                yield pa.RecordBatch.from_arrays(
                    [piece.column("left").filter(good), piece.column("right").filter(good)], names=["left", "right"]
                )

    return tidy(run)


def signatures(docs: DataFrame, registers: int = REGISTERS, band: int = BAND) -> DataFrame:
    """doc_id, multiset digest (d1, d2), number of shingles and band keys of every document."""
    schema = "doc_id long, d1 long, d2 long, size long, keys array<long>"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_signature_rows(registers, band), schema)


def verify(pairs: DataFrame, bags: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Pairs (left, right) whose exact weighted Jaccard reaches ``similarity``."""
    left = bags.select(F.col("doc_id").alias("left"), F.col("bag").alias("left_bag"))
    right = bags.select(F.col("doc_id").alias("right"), F.col("bag").alias("right_bag"))
    return pairs.join(left, "left").join(right, "right").mapInArrow(_verified(similarity), "left long, right long")


def near_duplicates(
    docs: DataFrame, similarity: float = SIMILARITY, registers: int = REGISTERS, band: int = BAND
) -> DataFrame:
    """doc_id, class_id (smallest doc_id of the class) and class_size of every row of ``docs``."""
    docs = in_small_batches(docs)
    signed_rows = stored(signatures(docs, registers, band))
    known = signed_rows.filter("size > 0 AND doc_id IS NOT NULL")
    folded = known.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"))
    spread = known.select("d1", "d2", "doc_id", "size", F.explode("keys").alias("key"))
    entries = stored(spread.groupBy("key", "d1", "d2").agg(F.min("doc_id").alias("rep"), F.min("size").alias("size")).drop("d1", "d2"))
    shared = entries.groupBy("key").agg(F.min("rep").alias("leader"), F.max("rep").alias("last")).filter("leader < last").select("key", "leader")
    shared = stored(shared)
    members = stored(entries.filter(likely_in(F.col("key"), shared, F.col("key"))).join(shared, "key"))
    candidates = stored(members.select(F.col("rep").alias("doc_id")).distinct())
    code = F.xxhash64("doc_id")
    texts = docs.select(F.col("doc_id").cast("long"), "text").filter(likely_in(code, candidates, code)).join(candidates, "doc_id", "left_semi")
    bags = stored(texts.mapInArrow(_bag_rows, "doc_id long, bag binary"))
    links = _linked_pairs(members, bags, similarity)
    labels = component_labels(_as_relations(links, folded, known), "relation_id", "doc_id")
    named = signed_rows.join(labels, "doc_id", "left").select("doc_id", F.coalesce("component", "doc_id").alias("class_id"))
    sizes = labels.groupBy(F.col("component").alias("class_id")).agg(F.count("*").alias("class_size"))
    return named.join(sizes, "class_id", "left").select(
        "doc_id", "class_id", F.coalesce("class_size", F.lit(1).cast("long")).alias("class_size")
    )


def _as_relations(links: DataFrame, folded: DataFrame, known: DataFrame) -> DataFrame:
    """Every link by its leader, and every copy by the first document with the same multiset."""
    copies = known.join(folded, ["d1", "d2"]).filter("doc_id <> rep").select(F.col("doc_id").alias("left"), F.col("rep").alias("right"))
    both = links.select("left", "right").unionByName(copies)
    return both.select(F.col("right").alias("relation_id"), F.explode(F.array("left", "right")).alias("doc_id"))


def _linked_pairs(members: DataFrame, bags: DataFrame, similarity: float) -> DataFrame:
    """Verified links whose components are those of all links between members of one bucket."""
    first = members.filter("rep <> leader").select(F.col("rep").alias("left"), F.col("leader").alias("right")).distinct()
    links = stored(verify(first, bags, similarity))
    unsettled = _open(members, links)
    few = F.col("entries") <= CROWDED
    found = _small_buckets(unsettled.filter(few), first, bags, similarity).unionByName(
        _tiles(unsettled.filter(~few), bags, similarity)
    )
    return links.unionByName(stored(found))


def _small_buckets(entries: DataFrame, tried: DataFrame, bags: DataFrame, similarity: float) -> DataFrame:
    """Links of buckets of at most ``CROWDED`` members, pair by pair."""
    other = entries.select("key", F.col("rep").alias("right"), F.col("comp").alias("right_comp"), F.col("size").alias("right_size"))
    met = entries.join(other, "key").filter((F.col("rep") > F.col("right")) & (F.col("comp") != F.col("right_comp")))
    fits = F.least("size", "right_size") >= F.lit(similarity) * F.greatest("size", "right_size")
    pairs = met.filter(fits).select(F.col("rep").alias("left"), "right").distinct()
    return verify(pairs.join(tried, ["left", "right"], "left_anti"), bags, similarity)


def _tiles(entries: DataFrame, bags: DataFrame, similarity: float) -> DataFrame:
    """Links of crowded buckets: members are dealt into tiles of bounded size and every two tiles meet in one task.

    Classes that fill tiles of their own are not compared with themselves.
    """
    per_class = entries.groupBy("key", "comp").agg(F.sum(F.col("size") + TEXT_COST).alias("bulk"))
    cell = F.when(F.col("bulk") >= TILE, F.col("comp"))
    pools = per_class.select("key", "comp", "bulk", cell.alias("cell"))
    totals = pools.groupBy("key", "cell").agg(F.sum("bulk").alias("total"))
    placed = (
        entries.join(pools, ["key", "comp"])
        .join(totals.select("key", F.col("cell").alias("pool"), "total"), ["key"])
        .filter(F.col("cell").eqNullSafe(F.col("pool")))
    )
    number = F.pmod(F.xxhash64("rep"), F.ceil(F.col("total") / TILE))
    tile = F.struct(F.col("cell").isNull().alias("mixed"), F.coalesce("cell", F.lit(0)).alias("cell"), number.alias("number"))
    placed = stored(placed.select("key", "rep", "comp", tile.alias("tile")))
    tiles = placed.select("key", "tile").distinct()
    both = tiles.select("key", F.col("tile").alias("a")).join(tiles.select("key", F.col("tile").alias("b")), "key").filter(
        (F.col("a") <= F.col("b")) & (F.col("a.mixed") | F.col("b.mixed") | (F.col("a.cell") != F.col("b.cell")))
    )
    sides = both.select("key", "a", "b", F.explode(F.array_distinct(F.array("a", "b"))).alias("tile"))
    rows = sides.join(placed, ["key", "tile"]).join(bags.select(F.col("doc_id").alias("rep"), "bag"), "rep")
    return rows.groupBy("key", "a", "b").applyInArrow(_tile_links(similarity), "left long, right long").distinct()


def _tile_links(similarity: float):
    def run(table: pa.Table) -> pa.Table:
        """Links that join classes of the tile; a link inside what earlier ones have joined adds nothing and is left out."""
        table = table.combine_chunks()
        reps = np.asarray(table.column("rep"))
        _, label = np.unique(np.asarray(table.column("comp")), return_inverse=True)
        bags = [np.frombuffer(x, np.uint64) for x in table.column("bag").to_pylist()]
        sizes = np.array([len(x) for x in bags])
        row = np.repeat(np.arange(len(bags)), sizes)
        _, column, times = np.unique(np.concatenate(bags), return_inverse=True, return_counts=True)
        kept = times[column] > 1
        named = np.cumsum(times > 1) - 1
        row, column = row[kept], named[column[kept]]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        width = int(np.count_nonzero(times > 1))
        left, right = [], []
        for top in range(0, len(bags), 512):
            some = slice(top, top + 512)
            shared = np.zeros((len(reps[some]), len(bags)), np.float32)
            for low in range(0, width, 2048):
                cut = slice(*np.searchsorted(column, [low, low + 2048]))
                block = np.zeros((len(bags), min(2048, width - low)), np.float32)
                block[row[cut], column[cut] - low] = 1.0
                shared += block[some] @ block.T
            union = sizes[some, None] + sizes[None, :] - shared
            good = (shared >= similarity * union - 1e-6) & (label[some, None] != label[None, :])
            for at in np.flatnonzero(good.any(axis=1)):
                near = np.flatnonzero(good[at])
                roots, first = np.unique(label[near], return_index=True)
                apart = roots != label[top + at]
                left += [reps[top + at]] * int(apart.sum())
                right += reps[near[first[apart]]].tolist()
                label[np.isin(label, roots[apart])] = label[top + at]
        ends = np.array([left, right], np.int64).reshape(2, -1)
        return pa.table({"left": ends.max(axis=0), "right": ends.min(axis=0)})

    return run


def _open(members: DataFrame, links: DataFrame) -> DataFrame:
    """Members of buckets in which the verified links leave more than one class; a class is named by its leader."""
    labels = links.groupBy(F.col("left").alias("rep")).agg(F.min("right").alias("component"))
    held = members.select("key", "rep", "size").join(labels, "rep", "left").select("key", "rep", "size", F.coalesce("component", "rep").alias("comp"))
    mixed = held.groupBy("key").agg(
        F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("entries")
    ).filter("low < high").select("key", "entries")
    return stored(held.join(mixed, "key"))
