"""Phrase hits against brute force over all windows, and proximity matches by hand."""

import random
import re

from pyspark.sql import functions as F

from mailsift.llm import positional

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(FOLD))


def brute(docs, items, window=10):
    grams = {}
    for item_id, text in items:
        w = words(text)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            grams.setdefault(tuple(w[i : i + n]), set()).add(str(item_id))
    sizes = {len(g) for g in grams}
    out = []
    for doc_id, text in docs:
        w = words(text)
        hit, found = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                ids = grams.get(tuple(w[i : i + n]))
                if ids:
                    hit |= set(range(i, i + n))
                    found |= ids
        out.append((doc_id, len(w), len(hit), sorted(found)))
    return sorted(out, key=repr)


def cases():
    rng = random.Random(3)
    draw = lambda n: [rng.choice(["the", "of", "ab", "É", "1a", "zz"]) + rng.choice(["", "", "x", "q7"]) for _ in range(n)]
    items = [(i, " ".join(draw(rng.randrange(10, 40)))) for i in range(8)]
    items += [(20, "unique"), (21, "two words"), (22, None), (23, " .,"), (24, " ".join(["same"] * 25)), (25, " ".join(["same"] * 25)), (26, "Ab-cd EF")]
    docs = [(i, ". ".join(draw(rng.randrange(0, 60)) + items[i % 8][1].split()[i % 4 : 12 + i % 7] + draw(20))) for i in range(40)]
    docs += [(50, "A UNIQUE thing"), (51, "two, words! ab cd ef"), (52, " ".join(["same"] * 31)), (53, None), (54, ""), (55, "x" * 5000)]
    docs += [(56, items[3][1]), (56, items[3][1]), (None, items[4][1].upper()), (57, " ".join(draw(3000)) + " " + items[5][1])]
    return docs, items


def run(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit(3)).withColumn("position", F.lit("p"))
    b = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    return sorted((tuple(r) for r in positional.contamination(d, b).collect()), key=repr)


def test_equals_brute_force(spark):
    docs, items = cases()
    assert run(spark, docs, items) == brute(docs, items)


def test_empty_tables(spark):
    docs, items = cases()
    assert run(spark, [], items) == []
    assert run(spark, docs[:3], []) == brute(docs[:3], [])


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "red old fox saw blue dog"), (2, "red " + "x " * 9 + "dog blue"), (3, "blue dog")], "doc_id long, text string")
    items = positional.items_of(spark.createDataFrame([(7, "blue red dog")], "item_id long, text string"))
    index = positional.build_index(docs, items, adjacent=False)
    found = positional.proximity_hits(index, items, slack=5)
    assert [(r.doc_id, r.item_id) for r in found.collect()] == [(1, "7")]
