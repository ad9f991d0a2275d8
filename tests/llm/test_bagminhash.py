"""Classes against brute-force multiset Jaccard, and the signature's agreement rate."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from mailsift.llm import bagminhash

WORD = re.compile("[^\x20\x09-\x0D]+")


def bag(text):
    w = WORD.findall((text or "").lower())
    if 0 < len(w) < 5:
        return Counter([tuple(w)])
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))


def brute(rows):
    bags = [(i, bag(t)) for i, t in rows if i is not None]
    parent = {i: i for i, _ in rows}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, (i, a) in enumerate(bags):
        for j, b in bags[:n]:
            union = sum((a | b).values())
            if union and sum((a & b).values()) >= 0.8 * union:
                x, y = sorted((top(i), top(j)))
                parent[y] = x
    return {i: top(i) for i, _ in rows}


def cases():
    rng = random.Random(4)
    draw = lambda n: [f"w{rng.randrange(300)}" for _ in range(n)]

    def edit(words, times):
        words = list(words)
        for _ in range(times):
            words[rng.randrange(len(words))] = "edit%d" % rng.randrange(10**6)
        return words

    rows, at = [], 0
    for _ in range(12):
        base = draw(rng.randrange(60, 300))
        for times in (0, 0, 1, 2, 3, 5, 8, 12):
            rows.append((at, " ".join(edit(base, times))))
            at += 1
    crowd = draw(120)
    for _ in range(80):
        rows.append((at, " ".join(edit(crowd, 3))))
        at += 1
    rows += [(1000, "a b c"), (1001, "A b C"), (1002, "a b"), (1003, None), (1004, ""), (1005, " \n "), (1006, None)]
    rows += [(1007, "rep eat it now and " * 200), (1008, "rep eat it now and " * 190), (1009, "rep eat it now and " * 90)]
    return rows + [(None, rows[0][1]), (1010, "z" * 20000)]


def run(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit("k")).withColumn("size", F.lit(0))
    return bagminhash.near_duplicates(docs).collect()


def test_equals_brute_force(spark):
    rows = cases()
    found = run(spark, rows)
    assert len(found) == len(rows)
    expected = brute(rows)
    assert {r.doc_id: r.class_id for r in found} == expected
    size = Counter(v for k, v in expected.items() if k is not None)
    assert all(r.class_size == size[r.class_id] for r in found if r.doc_id is not None)


def test_tiles_and_pairs_agree(spark, monkeypatch):
    rows = cases()[:180]
    monkeypatch.setattr(bagminhash, "CROWDED", 2)
    monkeypatch.setattr(bagminhash, "TILE", 2000)
    assert {r.doc_id: r.class_id for r in run(spark, rows)} == brute(rows)


def test_repeated_rows_and_empty_table(spark):
    assert run(spark, []) == []
    found = run(spark, [(3, "a b c d e f"), (3, "a b c d e f"), (5, "a b c d e f")])
    assert sorted((r.doc_id, r.class_id) for r in found) == [(3, 3), (3, 3), (5, 3)]


def test_signature_agreement_estimates_weighted_jaccard():
    rng = np.random.default_rng(1)
    a, b = rng.integers(1, 9, 400), rng.integers(1, 9, 400)
    codes = np.arange(400, dtype=np.uint64)
    both = bagminhash.bag_signatures(np.repeat([0, 1], 400), np.concatenate([codes, codes]), np.concatenate([a, b]), 2, 2048)
    true = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((both[0] == both[1]).mean() - true) < 0.05


def test_signature_does_not_depend_on_the_batch():
    texts = pa.array(["one two three four five six", "x " * 50, "a b"])
    owner, codes, weight, _ = bagminhash.shingle_bags(texts)
    whole = bagminhash.bag_signatures(owner, codes, weight, 3, 128)
    for i in range(3):
        o, c, w, _ = bagminhash.shingle_bags(texts.slice(i, 1))
        assert (bagminhash.bag_signatures(o, c, w, 1, 128)[0] == whole[i]).all()
