"""Exact top-k inner products by exhaustive term-at-a-time accumulation.

A vector is a sparse row of (term, weight); terms are component numbers, weights ``floor(SCALE * x)``. Candidates are
packed into blocks that hold, per term, a postings list of (row, weight). Queries are packed into blocks of sparse
rows. Every block of queries meets every block of candidates in a task of its own: for each term the query weights
are scattered with the term's postings into a dense score array, the partition's best ``k`` of every query are
selected, and the selections of all blocks are merged. Scores are 64-bit integers, so the result is exact.

Block sizes are fixed, so a task's memory is bounded: ``QUERY_BLOCK`` x ``BLOCK`` scores. The work is queries times
candidates, as an exhaustive search must be; the shuffle carries packed blocks once per query block.

Nulls, empties, repeats: a vector that is null or holds a null or non-finite component takes no part, nor does a
row without an id. An empty vector scores 0 with all. Components missing in the shorter of two vectors count as 0.
Candidates with the query's id are left out; repeated candidates are ranked as rows of their own; repeated query ids
are asked once, with their smallest vector. Ties go to the smaller id. An empty
table gives no rows. Sums of products must fit 63 bits (64 components of up to 2**28, say). Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

SCALE = 256
BLOCK = 4096
QUERY_BLOCK = 1024


def integer_rows(vectors: DataFrame) -> DataFrame:
    """(vec_id, weights): the vectors that take part, as whole numbers."""
    value = F.col("embedding")
    usable = value.isNotNull() & F.forall(value, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)) & ~F.isnan(x.cast("double")))
    whole = F.transform(value, lambda x: F.floor(x.cast("double") * SCALE).cast("long"))
    return vectors.filter(F.col("vec_id").isNotNull() & usable).select(F.col("vec_id").cast("long"), whole.alias("weights"))


def _pack(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """ids and the non-zero entries (row, term, weight) of a block."""
    ids = np.asarray(rows.column("vec_id"))
    weights = rows.column("weights").combine_chunks()
    sizes = np.asarray(pa.compute.list_value_length(weights)).astype(np.int64)
    flat = np.asarray(pa.compute.list_flatten(weights)).astype(np.int64)
    row = np.repeat(np.arange(len(ids)), sizes)
    term = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    held = flat != 0
    return ids, row[held], term[held], flat[held]


def accumulate(queries: tuple, candidates: tuple) -> np.ndarray:
    """Dense scores, filled term by term from the postings of the candidates."""
    q_ids, q_row, q_term, q_weight = queries
    c_ids, c_row, c_term, c_weight = candidates
    scores = np.zeros((len(q_ids), len(c_ids)), np.int64)
    by_q, by_c = np.argsort(q_term, kind="stable"), np.argsort(c_term, kind="stable")
    q_row, q_term, q_weight = q_row[by_q], q_term[by_q], q_weight[by_q]
    c_row, c_term, c_weight = c_row[by_c], c_term[by_c], c_weight[by_c]
    for term in np.intersect1d(q_term, c_term):
        asks = slice(*np.searchsorted(q_term, [term, term + 1]))
        posts = slice(*np.searchsorted(c_term, [term, term + 1]))
        rows, weights = c_row[posts], c_weight[posts]
        everywhere = len(rows) == len(c_ids)
        for query, weight in zip(q_row[asks], q_weight[asks]):
            if everywhere:
                scores[query] += weight * weights
            else:
                scores[query, rows] += weight * weights
    return scores


def select(scores: np.ndarray, q_ids: np.ndarray, c_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every query its k best candidates of the block; all that tie with the k-th are looked at."""
    out: list[tuple] = []
    for query in range(len(q_ids)):
        row, open_ = scores[query], c_ids != q_ids[query]
        row, ids = row[open_], c_ids[open_]
        if len(row) > k:
            least = np.partition(row, len(row) - k)[len(row) - k]
            keep = row >= least
            row, ids = row[keep], ids[keep]
        best = np.lexsort((ids, -row))[:k]
        out.append((np.full(len(best), q_ids[query]), ids[best], row[best]))
    return tuple(np.concatenate(x) for x in zip(*out))


def _tile(k: int):
    def run(table: pa.Table) -> pa.Table:
        side = np.asarray(table.column("asks"))
        queries, candidates = _pack(table.filter(pa.array(side))), _pack(table.filter(pa.array(~side)))
        if not len(queries[0]) or not len(candidates[0]):
            return pa.table({n: pa.array([], pa.int64()) for n in ("query_id", "vec_id", "score")})
        query, found, score = select(accumulate(queries, candidates), queries[0], candidates[0], k)
        return pa.table({"query_id": query, "vec_id": found, "score": score})

    return run


def top_k(vectors: DataFrame, asked: Column, k: int = 5, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id and score of the k best other vectors of every asked one."""
    rows = integer_rows(vectors)
    queries = rows.filter(asked).groupBy("vec_id").agg(F.min("weights").alias("weights"))
    sizes = rows.agg(F.count("*").alias("n"), F.count(F.when(asked, 1)).alias("q")).first()
    blocks, query_blocks = -(-sizes.n // block) or 1, -(-sizes.q // query_block) or 1
    dealt = lambda n, salt: F.pmod(F.xxhash64("vec_id", "weights", F.lit(salt)), F.lit(n)).cast("int")
    tiles = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    candidate_side = rows.select(dealt(blocks, 1).alias("block"), tiles(query_blocks).alias("query_block"), F.lit(False).alias("asks"), "vec_id", "weights")
    query_side = queries.select(tiles(blocks).alias("block"), dealt(query_blocks, 2).alias("query_block"), F.lit(True).alias("asks"), "vec_id", "weights")
    both = query_side.select(*candidate_side.columns).unionByName(candidate_side)
    found = both.groupBy("block", "query_block").applyInArrow(_tile(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
