"""Base scores against a brute-force count, and the tree's distributions."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from mailsift.llm import suffixtree
from mailsift.llm.words import split_words
import pyarrow as pa

WORD = re.compile("[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def toks(text):
    return WORD.findall((text or "").translate(FOLD)) + ["</end>"]


def brute(rows):
    training = [t for i, t in rows if i is None or zlib.crc32(str(i).encode()) % 7 != 2]
    count = Counter(w for t in training for w in toks(t))
    n, v = sum(count.values()), len(count)
    return {
        i: (len(toks(t)), sum(w in count for w in toks(t)), n, sum(math.log10((count[w] + 1) / (n + v + 1)) for w in toks(t)))
        for i, t in rows
    }


def rows():
    out = [(i, " ".join(f"w{(i * j) % (7 + i % 5)}" for j in range(i % 30)) + (" The end of it all" if i % 2 else "")) for i in range(60)]
    return out + [(100, None), (101, ""), (102, " \n\t"), (103, "É é A a " * 400), (104, "x" * 9000), (None, "null row the end")]


def run(spark, data, **options):
    docs = spark.createDataFrame(data, "doc_id long, text string").withColumn("n", F.lit(1)).withColumn("code", F.lit("a"))
    return suffixtree.score_corpus(docs, suffixtree.held_out(F.col("doc_id")), **options).collect()


def test_base_equals_brute_force(spark):
    expected = brute(rows())
    found = run(spark, rows())
    assert len(found) == len(expected)
    for r in found:
        n, known, total, base = expected[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total)
        assert r.base_score == pytest.approx(base, rel=1e-9)


def test_repeated_rows_and_empty_table(spark):
    data = rows()[:20] + rows()[3:5]
    found = run(spark, data)
    assert sorted(r.doc_id for r in found) == sorted(i for i, _ in data)
    assert run(spark, []) == []


def test_contexts_help_on_held_out_copies(spark):
    data = [(i, f"alpha{i % 3} beta gamma delta epsilon zeta eta theta x{i}") for i in range(300)]
    found = run(spark, data)
    out = [r for r in found if zlib.crc32(str(r.doc_id).encode()) % 7 == 2]
    assert sum(r.score for r in out) > sum(r.base_score for r in out) + len(out)


def test_rare_passages_are_contexts_in_a_large_corpus(spark):
    """A passage seen three times is learnt, however many other tokens there are (here a million)."""
    out = [i for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2][:1]
    seen = [i for i in range(200) if zlib.crc32(str(i).encode()) % 7 != 2][:3]
    data = [(i, "pa pb pc pd pe pf") for i in seen + out] + [(i, "u v " * 2500) for i in range(1000, 1240)]
    score = {r.doc_id: r for r in run(spark, data)}[out[0]]
    assert score.train_tokens > 1_000_000
    assert score.score - score.base_score > 5 * 5


def test_distributions_sum_to_one(spark):
    """After every context, over all known words and one unknown, probabilities sum to one."""
    data = [(i, f"a b c d{i % 4} a b c e a b f{i % 9}") for i in range(80)]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    counts = suffixtree.token_counts(docs)
    tree = suffixtree.fit_tree(docs, counts)
    assert sum(map(len, tree.state_codes)) > 3
    vocabulary = sorted({w for _, t in data for w in t.split()})
    known = dict(counts.collect())
    for context in (["a"], ["b"], ["a", "b"], ["b", "c"], ["a", "b", "c"], ["e", "a", "b"], ["zz"], ["d1", "a"]):
        total = 0.0
        for word in [*vocabulary, None, "neverseen"]:
            text = " ".join(context + ([word] if word else []))
            found = suffixtree.tokens(pa.array([text]))
            rank = suffixtree._find(tree.words, found.codes)
            at = len(context)
            code = int(found.codes[at].view(np.int64))
            base = math.log10((known.get(code, 0) + 1) / 10**tree.root_norm)
            total += 10 ** (base + suffixtree.adjustments(tree, found, rank)[at])
        assert total == pytest.approx(1.0, abs=1e-6)


def test_word_codes_do_not_depend_on_the_batch():
    texts = pa.array(["one two", None, "", "two\tone", "a" * 3000])
    whole = split_words(texts, lower=True)
    parts = np.concatenate([split_words(texts.slice(i, 1), lower=True).codes for i in range(5)])
    assert whole.codes.tolist() == parts.tolist() and whole.counts.tolist() == [2, 0, 0, 2, 1]


def test_scores_equal_a_whole_tree(spark):
    """Sums of one number per code, met in passes, are the scores of a tree held whole."""
    data = rows()
    docs = spark.createDataFrame(data, "doc_id long, text string")
    training = docs.filter(~suffixtree.held_out(F.col("doc_id")))
    tree = suffixtree.fit_tree(training, suffixtree.token_counts(training))
    assert sum(map(len, tree.state_codes)) > 30
    found = {r.doc_id: r for r in run(spark, data)}
    for i, text in data:
        whole = suffixtree.tokens(pa.array([text], pa.string()))
        rank = suffixtree._find(tree.words, whole.codes)
        gain = suffixtree.adjustments(tree, whole, rank).sum()
        assert found[i].score - found[i].base_score == pytest.approx(gain, rel=1e-9, abs=1e-9)


def test_grams_equal_brute_force_and_no_shuffle_is_wider_than_two_codes(spark):
    """Of each order the grams seen twice, their context and count; one order in a shuffle, packed."""
    data = rows()
    docs = spark.createDataFrame(data, "doc_id long, text string")
    for k in (2, 3, 4):
        expected = Counter()
        for _, text in data:
            words = toks(text)
            expected.update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
        found = suffixtree.gram_counts(docs, k).collect()
        assert sorted(r.n for r in found) == sorted(n for n in expected.values() if n >= 2)
        assert len({r.gram for r in found}) == len(found)
        assert len({r.context for r in found}) == len({g[:-1] for g, n in expected.items() if n >= 2})
    packed = list(suffixtree._gram_rows(4, 0, 1)(iter([pa.record_batch({"text": [" ".join(f"w{i * i % 977}" for i in range(50000))]})])))
    distinct = sum(len(suffixtree._codes(c)) for batch in packed for c in batch.column("codes"))
    assert distinct and sum(b.nbytes for b in packed) < 24 * distinct + (1 << 17)


def test_tables_of_a_fit_are_emptied(spark, tmp_path):
    """After scoring, no counted grams and no level of the tree are left on disk, only nodes and texts."""
    from mailsift.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    made = []
    keep = suffixtree.stored

    def noted(df):
        made.append(keep(df))
        return made[-1]

    suffixtree.stored = noted
    try:
        run(spark, rows())
    finally:
        suffixtree.stored = keep
    columns = [tuple(df.columns) for df in made]
    left = [c for df, c in zip(made, columns) if spark.read.schema(df.schema).parquet(df.inputFiles()[0].rsplit("/", 1)[0]).count()]
    assert ("gram", "context", "n") in columns and ("gram", "context", "n") not in left
    assert not any("lower" in c for c in left)
