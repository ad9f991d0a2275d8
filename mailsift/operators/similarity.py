"""Near-duplicate fingerprints and nearest vectors."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb, log2

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from mailsift import vocabulary as V
from mailsift.functions.hashing import hamming, simhash64
from mailsift.operators.ordered import positions
from mailsift.session import cut_lineage

QUERY_BLOCK = 1024
CORPUS_BLOCK = 8192
#: Fingerprints of one side of a task.
PRINT_BLOCK = 131_072
#: Blocks that a table of less than that many full ones is cut into.
SPREAD = 32
#: Fingerprints whose distances tell which others cannot be close.
OUTLOOKS = 4


def fingerprints(messages: DataFrame, text: str, key: str = "email_id", keep: tuple[str, ...] = ()) -> DataFrame:
    return messages.select(key, *keep, simhash64(F.col(text)).alias("fingerprint"))


def band_plan(distinct: int, radius: int, bits: int = 64) -> tuple[int, int]:
    """(blocks, agreeing blocks) such that a key has about log2(distinct) bits.

    Two fingerprints within ``radius`` agree on at least ``blocks - radius`` of any ``blocks`` blocks,
    so keys made of that many blocks find every pair, and wider keys keep buckets small.
    """
    wanted = max(log2(max(distinct, 2)), 1.0)
    for blocks in range(radius + 1, radius + 7):
        agreeing = blocks - radius
        if agreeing * (bits // blocks) >= wanted or comb(blocks + 1, agreeing + 1) > 1000:
            break
    return blocks, agreeing


def _block_masks(blocks: int, bits: int = 64) -> list[int]:
    edges = [round(i * bits / blocks) for i in range(blocks + 1)]
    masks = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(blocks)]
    return [m - (1 << bits) if m >= 1 << (bits - 1) else m for m in masks]


def band_keys(fingerprint: Column, blocks: int, agreeing: int) -> Column:
    """Array of (combo, value) keys; ``combo`` has one bit set per block the key is made of."""
    masks = _block_masks(blocks)

    def key(chosen: tuple[int, ...]) -> Column:
        mask = 0
        for i in chosen:
            mask |= masks[i]
        combo = sum(1 << i for i in chosen)
        return F.struct(F.lit(combo).alias("combo"), fingerprint.bitwiseAND(F.lit(mask).cast("bigint")).alias("value"))

    return F.array(*[key(chosen) for chosen in combinations(range(blocks), agreeing)])


def _first_shared_key(a: Column, b: Column, combo: Column, blocks: int) -> Column:
    """True for the first key two fingerprints share, so that a pair is met once without a distinct.

    The first key is made of the lowest blocks that agree: below its highest block no other block agrees.
    """
    xor = a.bitwiseXOR(b)
    agree = F.lit(0)
    for i, mask in enumerate(_block_masks(blocks)):
        agree = agree.bitwiseOR(F.when(xor.bitwiseAND(F.lit(mask).cast("bigint")) == 0, F.lit(1 << i)).otherwise(F.lit(0)))
    below = F.pow(F.lit(2), F.length(F.bin(combo))).cast("int") - 1
    return agree.bitwiseAND(below) == combo


def close_fingerprints(
    prints: DataFrame, radius: int = V.NEAR_DUPLICATE_RADIUS, hot_bucket: int = 1024
) -> DataFrame:
    """Ordered pairs of different fingerprints within ``radius`` bits, each side with its copies.

    Copies of one fingerprint are folded first, so a group of copies of any size is one row and no
    pairs inside it are formed. Buckets that stay crowded are not joined; their members are keyed
    again on twice as many agreeing blocks, which finds the same pairs in smaller buckets.
    """
    folded = cut_lineage(
        prints.filter("fingerprint <> 0").groupBy("fingerprint").agg(
            F.count(F.lit(1)).alias("copies"), F.min("email_id").alias("first_id")
        )
    )
    plan = band_plan(folded.count(), radius)
    columns = ("fingerprint", "copies", "first_id", "crowded")

    def keyed(rows: DataFrame, blocks: int, agreeing: int) -> DataFrame:
        return rows.withColumn("k", F.explode(band_keys(F.col("fingerprint"), blocks, agreeing))).select(
            *[c for c in columns if c in rows.columns], "k.combo", "k.value"
        )

    def pairs(buckets: DataFrame, blocks: int, skip_crowded: bool) -> DataFrame:
        left = buckets.select("combo", "value", *[F.col(n).alias(f"{n}_a") for n in columns])
        right = buckets.select("combo", "value", *[F.col(n).alias(f"{n}_b") for n in columns])
        a, b = F.col("fingerprint_a"), F.col("fingerprint_b")
        near = (a != b) & (hamming(a, b) <= radius) & _first_shared_key(a, b, F.col("combo"), blocks)
        if skip_crowded:
            near = near & ~(F.col("crowded_a") & F.col("crowded_b"))
        return left.join(right, ["combo", "value"]).filter(near).select(
            "fingerprint_a", "fingerprint_b", "copies_a", "copies_b", "first_id_a", "first_id_b",
            hamming(a, b).alias("distance"),
        )

    first = keyed(folded.withColumn("crowded", F.lit(False)), *plan)
    crowded = first.groupBy("combo", "value").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > hot_bucket)
    crowded = cut_lineage(crowded.select("combo", "value"))
    if crowded.isEmpty():
        return pairs(first, plan[0], False)
    members = first.join(crowded, ["combo", "value"], "left_semi").select("fingerprint").distinct()
    members = cut_lineage(members.withColumn("crowded", F.lit(True)))
    marked = folded.join(members, "fingerprint", "left").withColumn("crowded", F.coalesce("crowded", F.lit(False)))
    calm = keyed(marked, *plan).join(crowded, ["combo", "value"], "left_anti")
    wider = (radius + 2 * plan[1], 2 * plan[1])
    again = keyed(marked.filter("crowded"), *wider)
    return pairs(calm, plan[0], True).unionByName(pairs(again, wider[0], False))


def _outlook(prints: np.ndarray) -> np.ndarray:
    """Distance of every fingerprint to a few that lie far apart; which ones changes the cost only."""
    some = prints[:: max(1, len(prints) // 1024)]
    nearest = np.full(len(some), 65)
    far, columns = 0, []
    for _ in range(OUTLOOKS):
        nearest = np.minimum(nearest, np.bitwise_count(some ^ some[far]))
        columns.append(np.bitwise_count(prints ^ some[far]).astype(np.int16))
        far = int(nearest.argmax())
    return np.stack(columns, axis=1)


def _by_place(outlook: np.ndarray, prints: np.ndarray) -> np.ndarray:
    """An order in which near fingerprints stand together and copies side by side."""
    home = outlook.argmin(axis=1)
    return np.lexsort((prints, outlook[np.arange(len(prints)), home], home))


def _meetings(
    left: np.ndarray, right: np.ndarray, outlook: tuple[np.ndarray, np.ndarray], radius: int, strip: int = 64, block: int = 512, width: int = 4096,
) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """(rows of ``left``, rows of ``right``, distances) of every pair that may be within ``radius``.

    A strip and a block whose distances to one outlook differ by more than ``radius`` hold no close pair. Both sides
    should stand ``_by_place``. The distances lie in a buffer that the next step overwrites.
    """
    if not len(left) or not len(right):
        return
    edges = np.arange(0, len(right), block)
    low, high = np.minimum.reduceat(outlook[1], edges), np.maximum.reduceat(outlook[1], edges)
    xors, distances = np.empty(strip * width, np.uint64), np.empty(strip * width, np.uint8)
    for begin in range(0, len(left), strip):
        some = slice(begin, min(begin + strip, len(left)))
        seen = outlook[0][some]
        near = ((low - seen.max(axis=0) <= radius) & (seen.min(axis=0) - high <= radius)).all(axis=1)
        columns = np.flatnonzero(np.repeat(near, block)[: len(right)])
        for first in range(0, len(columns), width):
            chosen = columns[first : first + width]
            shape = (some.stop - begin, len(chosen))
            xor, distance = xors[: shape[0] * shape[1]].reshape(shape), distances[: shape[0] * shape[1]].reshape(shape)
            np.bitwise_xor(left[some, None], right[chosen], out=xor)
            yield some, chosen, np.bitwise_count(xor, out=distance)


def _neighbour_sums(
    prints: tuple[np.ndarray, np.ndarray], copies: tuple[np.ndarray, np.ndarray], names: tuple[np.ndarray, np.ndarray], radius: int, same: bool,
) -> list[dict[str, np.ndarray]]:
    """For both sides of a tile: neighbours, near_messages, closest and the smallest neighbour's name of each fingerprint."""
    outlooks = _outlook(np.concatenate(prints))
    outlooks = (outlooks[: len(prints[0])], outlooks[len(prints[0]) :])
    order = [_by_place(o, p) for o, p in zip(outlooks, prints)]
    prints, outlooks = tuple(p[i] for p, i in zip(prints, order)), tuple(o[i] for o, i in zip(outlooks, order))
    copies, names = [n[i] for n, i in zip(copies, order)], [n[i] for n, i in zip(names, order)]
    count, near = [np.zeros(len(p), np.int64) for p in prints], [np.zeros(len(p), np.int64) for p in prints]
    closest, first = [np.full(len(p), 65, np.int64) for p in prints], [np.full(len(p), np.iinfo(np.int64).max) for p in prints]
    for some, chosen, distance in _meetings(*prints, outlooks, radius):
        hits = np.flatnonzero(distance <= radius)
        if not len(hits):
            continue
        row, column = np.divmod(hits, len(chosen))
        apart = distance.ravel()[hits].astype(np.int64)
        met = (row + some.start, chosen[column])
        for me, other in ((0, 1),) if same else ((0, 1), (1, 0)):
            mine, theirs = (met[me], met[other])
            use = apart > 0
            mine, theirs, steps = (mine[use], theirs[use], apart[use])
            np.add.at(count[me], mine, 1)
            np.add.at(near[me], mine, copies[other][theirs])
            np.minimum.at(closest[me], mine, steps)
            np.minimum.at(first[me], mine, names[other][theirs])
    out = []
    for side in (0,) if same else (0, 1):
        found = count[side] > 0
        out.append({
            "fingerprint": prints[side][found].view(np.int64), "neighbours": count[side][found], "near_messages": near[side][found],
            "closest": closest[side][found], "name": first[side][found],
        })
    return out


def near_duplicate_neighbours(
    prints: DataFrame, radius: int = V.NEAR_DUPLICATE_RADIUS, block: int = PRINT_BLOCK, least: int = 4096,
) -> DataFrame:
    """Per fingerprint: how many other fingerprints and messages are close, how close, and the first of them.

    Copies are folded; blocks of fingerprints meet pair by pair in tasks of one size, which hand on one partial row per
    fingerprint and never a pair. Texts of one language differ in few bits, so keys on agreeing bits would meet most pairs anyway, several times.
    """
    folded = cut_lineage(
        prints.filter("fingerprint <> 0").groupBy("fingerprint").agg(
            F.count(F.lit(1)).alias("copies"), F.min("email_id").alias("first_id")
        )
    )
    distinct = folded.count()
    blocks = max(1, -(-distinct // block), min(SPREAD, -(-distinct // least)))
    own = F.pmod(F.xxhash64("fingerprint"), F.lit(blocks)).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    tiles = folded.withColumn("own", own).withColumn("other", other).select(
        F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), (F.col("own") > F.col("other")).alias("later"),
        "fingerprint", "copies", "first_id",
    )

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        same = bool(pdf["a"].iat[0] == pdf["b"].iat[0])
        ids = pdf["first_id"].to_numpy()
        ordered = np.argsort(ids, kind="stable")
        names = np.empty(len(ids), np.int64)
        names[ordered] = np.arange(len(ids))
        later = pdf["later"].to_numpy(bool)
        sides = (np.ones(len(pdf), bool),) * 2 if same else (~later, later)
        value = pdf["fingerprint"].to_numpy(np.int64).view(np.uint64)
        found = _neighbour_sums(
            *(tuple(column[side] for side in sides) for column in (value, pdf["copies"].to_numpy(np.int64), names)), radius, same
        )
        out = pd.concat([pd.DataFrame(part) for part in found], ignore_index=True)
        out["first_neighbour"] = ids[ordered[out.pop("name").to_numpy(np.int64)]]
        return out

    id_type = folded.schema["first_id"].dataType.simpleString()
    partial = tiles.groupBy("a", "b").applyInPandas(
        meet, f"fingerprint bigint, neighbours bigint, near_messages bigint, closest int, first_neighbour {id_type}"
    )
    summed = partial.groupBy("fingerprint").agg(
        F.sum("neighbours").alias("neighbours"), F.sum("near_messages").alias("near_messages"),
        F.min("closest").alias("closest"), F.min("first_neighbour").alias("first_neighbour"),
    )
    return folded.join(summed, "fingerprint").select(
        "fingerprint", "first_id", "copies", "neighbours", "near_messages", "closest", "first_neighbour"
    )


def _count_back(times: np.ndarray, prints: np.ndarray, window_ms: int, radius: int, recent: int) -> np.ndarray:
    """For each row, how many of the ``recent`` rows before it are in the window and close to it."""
    counts = np.zeros(len(times), np.int64)
    for back in range(1, min(recent, len(times) - 1) + 1):
        inside = times[back:] - times[:-back] < window_ms
        if not inside.any():
            break
        counts[back:] += inside & (np.bitwise_count(prints[back:] ^ prints[:-back]) <= radius)
    return counts


def recent_near_duplicates(
    prints: DataFrame, moment: str, window_ms: int = V.BURST_WINDOW_MS, radius: int = V.NEAR_DUPLICATE_RADIUS,
    recent: int | None = None, block: int = 100_000,
) -> DataFrame:
    """Size of the near-duplicate cluster each message joins on arrival.

    A message is compared with all messages of the window before it, over all senders; the message itself counts
    once, messages in the same millisecond count each other, and a token-free message counts 0. ``recent`` limits
    the comparison to that many messages before it, in the order of time and id, as a bounded index would.
    """
    # Fingerprints are read several times below; writing these three numbers out saves hashing the texts again.
    rows = cut_lineage(prints.select("email_id", F.unix_millis(moment).alias("ms"), "fingerprint"))
    counted = _window_counts(rows, window_ms, radius) if recent is None else _last_counts(rows, window_ms, radius, recent, block)
    silent = rows.filter("fingerprint = 0").select("email_id", F.lit(0).cast("bigint").alias("cluster_size"))
    return counted.unionByName(silent)


def _weights_near(
    asked: np.ndarray, said: np.ndarray, weights: np.ndarray, outlook: tuple[np.ndarray, np.ndarray], radius: int
) -> np.ndarray:
    """For each of ``asked`` the weights of all ``said`` within ``radius``; both stand ``_by_place``."""
    total = np.zeros(len(asked), np.int64)
    heavy = weights > 1
    for some, _, distance in _meetings(asked, said, outlook, radius):
        total[some] += np.count_nonzero(distance <= radius, axis=1)
    for some, chosen, distance in _meetings(asked, said[heavy], (outlook[0], outlook[1][heavy]), radius):
        row, column = np.divmod(np.flatnonzero(distance <= radius), len(chosen))
        np.add.at(total, row + some.start, weights[heavy][chosen[column]] - 1)
    return total


def _folded(prints: np.ndarray, weights: np.ndarray, outlook: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Copies that stand side by side as one row."""
    if not len(prints):
        return prints, weights, outlook
    starts = np.flatnonzero(np.concatenate([[True], prints[1:] != prints[:-1]]))
    return prints[starts], np.add.reduceat(weights, starts), outlook[starts]


def _heard_in_window(
    asked: tuple[np.ndarray, np.ndarray], said: tuple[np.ndarray, np.ndarray, np.ndarray], window_ms: int, radius: int, together: int = 2048,
) -> np.ndarray:
    """For each (moment, fingerprint) asked the weight of what was said close to it in ``(moment - window, moment]``.

    ``asked`` is ordered by moment and answered some rows at a time: what lies in the window of all of them is folded to
    fingerprints, and only what lies in the window of some is compared by moment as well.
    """
    ms, prints = asked
    outlooks = _outlook(np.concatenate([prints, said[1]]))
    mine, theirs = outlooks[: len(prints)], outlooks[len(prints) :]
    order = _by_place(theirs, said[1])
    when, what, weight, place = said[0][order], said[1][order], said[2][order], theirs[order]
    total = np.zeros(len(ms), np.int64)
    for begin in range(0, len(ms), together):
        some = np.arange(begin, min(begin + together, len(ms)))
        some = some[_by_place(mine[some], prints[some])]
        low, high = ms[some].min(), ms[some].max()
        whole = (when > high - window_ms) & (when <= low)
        ask, _, ask_place = _folded(prints[some], np.ones(len(some), np.int64), mine[some])
        number = np.cumsum(np.concatenate([[0], prints[some][1:] != prints[some][:-1]]))
        total[some] += _weights_near(ask, *_fold_as_asked(what[whole], weight[whole], place[whole], ask_place), radius)[number]
        part = np.flatnonzero(~whole & (when > low - window_ms) & (when <= high))
        for rows, chosen, distance in _meetings(prints[some], what[part], (mine[some], place[part]), radius):
            row, column = np.divmod(np.flatnonzero(distance <= radius), len(chosen))
            hit, said_at = some[rows][row], part[chosen[column]]
            back = ms[hit] - when[said_at]
            use = (back >= 0) & (back < window_ms)
            np.add.at(total, hit[use], weight[said_at[use]])
    return total


def _fold_as_asked(prints: np.ndarray, weights: np.ndarray, outlook: np.ndarray, asked: np.ndarray):
    prints, weights, outlook = _folded(prints, weights, outlook)
    return prints, weights, (asked, outlook)


def _window_counts(rows: DataFrame, window_ms: int, radius: int, block: int = PRINT_BLOCK, least: int = 4096) -> DataFrame:
    """Arrivals fold per fingerprint and millisecond and are cut into blocks of one size in order of time.

    A block meets the blocks that reach into its windows, each pair in a task of its own that hands on one count per row and
    never a pair of messages.
    """
    heard = rows.filter("fingerprint <> 0")
    folded = cut_lineage(heard.groupBy("fingerprint", "ms").agg(F.count(F.lit(1)).alias("n")))
    size = min(block, max(least, -(-folded.count() // SPREAD)))
    placed = cut_lineage(
        positions(folded, ["ms", "fingerprint"]).withColumn("block", F.floor((F.col("position") - 1) / size).cast("int")).drop("position")
    )
    # Bounded: one row per block.
    spans = placed.groupBy("block").agg(F.min("ms").alias("low"), F.max("ms").alias("high"))
    later = spans.select(F.col("block").alias("asker"), F.col("low").alias("from"), F.col("high").alias("to"))
    reached = spans.join(later, (F.col("low") <= F.col("to")) & (F.col("high") > F.col("from") - window_ms))
    tiles = cut_lineage(reached.select("block", "asker"))
    asks = placed.join(F.broadcast(tiles.select(F.col("asker").alias("block"), F.col("block").alias("speaker"))), "block")
    says = placed.join(F.broadcast(tiles), "block")
    sides = asks.select(F.col("block").alias("a"), F.col("speaker").alias("b"), F.lit(True).alias("asks"), "ms", "fingerprint", "n").unionByName(
        says.select(F.col("asker").alias("a"), F.col("block").alias("b"), F.lit(False).alias("asks"), "ms", "fingerprint", "n")
    )

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        asks = pdf["asks"].to_numpy(bool)
        ask, say = pdf[asks].sort_values("ms"), pdf[~asks]
        value = lambda frame: frame["fingerprint"].to_numpy(np.int64).view(np.uint64)
        found = _heard_in_window(
            (ask["ms"].to_numpy(), value(ask)), (say["ms"].to_numpy(), value(say), say["n"].to_numpy()), window_ms, radius
        )
        out = pd.DataFrame({"fingerprint": ask["fingerprint"], "ms": ask["ms"], "found": found})
        return out[found > 0]

    partial = sides.groupBy("a", "b").applyInPandas(meet, "fingerprint bigint, ms bigint, found bigint")
    counts = partial.groupBy("fingerprint", "ms").agg(F.sum("found").alias("cluster_size"))
    return heard.join(counts, ["fingerprint", "ms"]).select("email_id", "cluster_size")


def _last_counts(rows: DataFrame, window_ms: int, radius: int, recent: int, block: int) -> DataFrame:
    """Positions in arrival order cut the stream into equal blocks that carry the last ``recent`` rows of the block before."""
    block = max(block, recent)
    placed = positions(rows.filter("fingerprint <> 0"), ["ms", "email_id"])
    home = F.floor((F.col("position") - 1) / block)
    tail = F.pmod(F.col("position") - 1, F.lit(block)) >= block - recent
    spread = placed.withColumn("home", home).withColumn(
        "block", F.explode(F.when(tail, F.array("home", F.col("home") + 1)).otherwise(F.array("home")))
    )

    def count_block(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("position")
        found = _count_back(
            pdf["ms"].to_numpy(), pdf["fingerprint"].to_numpy().view(np.uint64), window_ms, radius, recent
        )
        out = pd.DataFrame({"email_id": pdf["email_id"], "cluster_size": found + 1})
        return out[(pdf["home"] == pdf["block"]).to_numpy()]

    id_type = rows.schema["email_id"].dataType.simpleString()
    return spread.groupBy("block").applyInPandas(count_block, f"email_id {id_type}, cluster_size bigint")


def _best_per_query(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, column) of the best ``k`` columns per row; ties go to the lower column."""
    if scores.shape[1] <= k:
        q, c = np.nonzero(np.ones(scores.shape, bool))
        return q, c
    kth = -np.partition(-scores, k - 1, axis=1)[:, k - 1 : k]
    q, c = np.nonzero(scores >= kth)
    order = np.lexsort((c, -scores[q, c], q))
    q, c = q[order], c[order]
    first = np.searchsorted(q, np.arange(len(scores)))
    keep = np.arange(len(q)) - first[q] < k
    return q[keep], c[keep]


def nearest_vectors(
    corpus: DataFrame, queries: DataFrame, k: int, query_key: str = "query_id", key: str = "vec_id",
    vector: str = "embedding", query_block: int = QUERY_BLOCK, block: int = CORPUS_BLOCK,
) -> DataFrame:
    """Exact ``k`` nearest rows by cosine for each query vector, similarity rounded to 1e-9 for ties.

    Every block of queries meets every block of the corpus in a task of its own, which keeps its best ``k`` per
    query; the bests are then merged. Blocks have a fixed size, so any number of queries is answered, and no vector
    passes through the driver.
    """
    asked = cut_lineage(queries.select(F.col(query_key).alias("query"), F.col(vector).cast("array<double>").alias("v")))
    stored = corpus.select(F.col(key).alias("row"), F.col(vector).cast("array<double>").alias("v"))
    query_blocks, blocks = max(1, -(-asked.count() // query_block)), max(1, -(-stored.count() // block))

    def dealt(name: str, n: int) -> Column:
        return F.pmod(F.xxhash64(name, "v"), F.lit(n)).cast("int")

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    query_type, key_type = asked.schema["query"].dataType, stored.schema["row"].dataType
    sides = asked.select(dealt("query", query_blocks).alias("a"), every(blocks).alias("b"), "query", F.lit(None).cast(key_type).alias("row"), "v").unionByName(
        stored.select(every(query_blocks).alias("a"), dealt("row", blocks).alias("b"), F.lit(None).cast(query_type).alias("query"), "row", "v")
    )

    def best(pdf: pd.DataFrame) -> pd.DataFrame:
        ask, have = pdf[pdf["row"].isna()], pdf[pdf["row"].notna()].sort_values("row")
        if ask.empty or have.empty:
            return pd.DataFrame({query_key: [], key: [], "similarity": []})
        scores = np.round(_unit_rows(np.stack(ask["v"].to_numpy())) @ _unit_rows(np.stack(have["v"].to_numpy())).T, 9)
        q, c = _best_per_query(scores, k)
        return pd.DataFrame({query_key: ask["query"].to_numpy()[q], key: have["row"].to_numpy()[c], "similarity": scores[q, c]})

    found = sides.groupBy("a", "b").applyInPandas(
        best, f"{query_key} {query_type.simpleString()}, {key} {key_type.simpleString()}, similarity double"
    )
    rank = F.row_number().over(Window.partitionBy(query_key).orderBy(F.desc("similarity"), key))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def _unit_rows(matrix: np.ndarray) -> np.ndarray:
    rows = matrix.astype(np.float64)
    length = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, length, out=np.zeros_like(rows), where=length > 0)
