"""Repeated passages against a brute-force pass over all windows, and the suffix automaton against the same."""

import hashlib
import random
import re

import pytest

from mailsift.llm import substrings

WORD = re.compile("[^\x20\x09-\x0D]+")


def brute(rows, window=50):
    first = {}
    for doc_id, text in rows:
        words = WORD.findall(text or "")
        for i in range(len(words) - window + 1):
            key = tuple(words[i : i + window])
            if doc_id is not None:
                first[key] = min(first.get(key, doc_id), doc_id)
    out = []
    for doc_id, text in rows:
        words = WORD.findall(text or "")
        gone = [False] * len(words)
        for i in range(len(words) - window + 1):
            if doc_id is not None and first[tuple(words[i : i + window])] < doc_id:
                gone[i : i + window] = [True] * window
        kept = " ".join(w for w, g in zip(words, gone) if not g)
        out.append((doc_id, len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def cases():
    rng = random.Random(5)
    word = lambda: rng.choice(["a", "bé", "cc", "the", "of"]) + str(rng.randrange(40))
    text = lambda n: [word() for _ in range(n)]
    common, other = text(80), text(55)
    rows = [(i, " ".join(text(rng.randrange(0, 30)) + common + text(rng.randrange(0, 40)))) for i in range(12)]
    rows += [(20 + i, "\n".join(text(10) + common[i : i + 50 + i] + other)) for i in range(12)]
    rows += [(40, " ".join(common)), (41, " ".join(common[:49])), (42, "  ".join(common[:50])), (43, None), (44, ""), (45, " \n")]
    rows += [(46, " ".join(["x"] * 300)), (47, " ".join(["x"] * 120)), (48, "x" * 5000), (39, " ".join(["x"] * 60))]
    rows += [(50, " ".join(other)), (50, " ".join(other)), (None, " ".join(common)), (51, " ".join(text(4000) + other)), (52, " ".join(other + other))]
    return rows


def run(spark, rows, extra=False):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    if extra:
        docs = docs.selectExpr("doc_id", "text", "1 AS start", "'x' AS runs", "2 AS anchor", "3 AS count")
    from pyspark.sql import functions as F

    kept = substrings.remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256))
    return sorted((tuple(r) for r in kept.collect()), key=repr)


def test_equals_brute_force(spark):
    assert run(spark, cases()) == brute(cases())


def test_clashing_columns_and_empty_table(spark):
    rows = cases()[10:30]
    assert run(spark, rows, extra=True) == brute(rows)
    assert run(spark, []) == []


@pytest.mark.parametrize("seed", range(3))
def test_automaton_equals_windows(seed):
    rng = random.Random(seed)
    texts = [[rng.randrange(3) for _ in range(rng.randrange(0, 60))] for _ in range(6)]
    automaton = substrings.ReferenceAutomaton()
    for i, words in enumerate(texts):
        automaton.add(words, i)
    for doc_id, words in enumerate(texts):
        expected = [False] * len(words)
        for i in range(len(words) - 6 + 1):
            piece = words[i : i + 6]
            if any(t[j : j + 6] == piece for k, t in enumerate(texts) if k < doc_id for j in range(len(t) - 5)):
                expected[i : i + 6] = [True] * 6
        assert automaton.covered(words, doc_id, 6).tolist() == expected


def test_spans_and_kept_text(spark):
    common = " ".join(f"w{i}" for i in range(50))
    docs = spark.createDataFrame([(1, common), (2, f"head {common} tail")], "doc_id long, text string")
    found = {r.doc_id: r for r in substrings.remove_repeats(docs).collect()}
    assert found[2].kept_text == "head tail" and [tuple(s) for s in found[2].spans] == [(1, 51)]
    assert found[1].n_removed == 0 and found[1].spans == []
