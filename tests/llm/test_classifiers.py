"""Both classifiers on held-out rows, odd rows and missing labels."""

import random

import numpy as np
import pytest

from mailsift.llm import factormachine, kernelquality


def table(spark, rows, names):
    return spark.createDataFrame(rows, names)


def corpus(kind):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice(["ka", "lo", "mi", "ten", "ra"]) for _ in range(rng.randrange(1, 4)))
    docs, labels = [], []
    for i in range(400):
        words, label = [word() for _ in range(rng.randrange(20, 120))], int(rng.random() < 0.4)
        if kind == "quality" and not label:
            words = [w + "###" for w in words] if i % 2 else [w.upper() + "!!" for w in words]
        if kind == "toxic" and label:
            words.insert(rng.randrange(len(words)), rng.choice(["zzidiot", "qqscum", "zzidiotic"]))
        docs.append((i, " ".join(words)))
        labels.append((i, label))
    return docs, labels


ODD = [(900, None), (901, ""), (902, " \n "), (903, "y" * 40000), (None, "a null id"), (904, "same"), (904, "same")]


@pytest.mark.parametrize("kind,run", [("quality", kernelquality.quality_scores), ("toxic", factormachine.toxicity_scores)])
def test_held_out_rows(spark, kind, run):
    docs, labels = corpus(kind)
    extra = [(0, 1 - labels[0][1] if labels[0][1] == 0 else 1), (5000, 1), (3, None), (None, 1)]
    d = table(spark, docs + ODD, "doc_id long, text string").selectExpr("doc_id", "text", "1 AS stats", "2 AS terms", "3 AS label")
    found = run(d, table(spark, labels + extra, f"doc_id long, {kind} int")).collect()
    assert len(found) == len(docs) + len(ODD)
    assert all(0.0 <= r.score <= 1.0 for r in found)
    truth = dict(labels)
    held = [r for r in found if r.held_out and r.doc_id in truth]
    right = sum(r.predicted == truth[r.doc_id] for r in held)
    assert len(held) > 40 and right / len(held) > 0.93


@pytest.mark.parametrize("kind,run", [("quality", kernelquality.quality_scores), ("toxic", factormachine.toxicity_scores)])
def test_without_labels_or_rows(spark, kind, run):
    docs, labels = corpus(kind)
    names = f"doc_id long, {kind} int"
    few = table(spark, docs[:10], "doc_id long, text string")
    assert {r.score for r in run(few, table(spark, [], names)).collect()} == {0.5}
    assert {r.score for r in run(few, table(spark, [(i, 1) for i in range(10)], names)).collect()} == {1.0}
    assert run(few.filter("false"), table(spark, labels, names)).collect() == []


def test_pooled_curve_rises_and_keeps_the_mean():
    rng = np.random.default_rng(0)
    total = rng.integers(0, 9, 60).astype(float)
    hits = np.minimum(total, rng.integers(0, 9, 60)).astype(float)
    curve = kernelquality.pooled(hits, total)
    assert len(curve) == 60 and (np.diff(curve) >= -1e-12).all()
    assert abs((curve * total).sum() - hits.sum()) < 1e-9


def machine(terms, factors, seed=0):
    rng = np.random.default_rng(seed)
    return factormachine.Machine(np.arange(terms), rng.normal(size=terms), -0.3, rng.normal(size=terms), rng.normal(size=(terms, factors)))


def test_pairs_are_the_sum_over_all_pairs():
    m = machine(6, 3)
    texts = [[0, 1, 2], [3], [], [1, 2, 4, 5]]
    owner, term = np.repeat(np.arange(4), [3, 1, 0, 4]), np.concatenate(texts).astype(int)
    for k, (text, logit) in enumerate(zip(texts, m.logits(owner, term, 4))):
        x = m.evidence[text]
        linear = (m.weights[text] * x).sum() / max(np.sqrt((x**2).sum()), 1e-6)
        pairs = sum(m.factors[a] @ m.factors[b] for i, a in enumerate(text) for b in text[i + 1 :]) / max(len(text), 1)
        assert abs(logit - (m.bias + linear + pairs)) < 1e-9, k


def test_slopes_are_finite_differences():
    m = machine(5, 2, 3)
    owner, term = np.array([0, 0, 1, 1, 1, 2]), np.array([0, 3, 1, 2, 3, 4])
    label = np.array([1.0, 0.0, 1.0])
    rows = factormachine.Rows(m, owner, term, label)

    def loss(change, key, at):
        moved = {"bias": m.bias, "weights": m.weights.copy(), "factors": m.factors.copy()}
        if key == "bias":
            moved["bias"] += change
        else:
            moved[key][at] += change
        n = factormachine.Machine(m.place, m.evidence, **moved)
        pairs = key != "weights"
        logits = n.logits(owner, term, 3) if pairs else rows.linear_part(n)
        penalty = factormachine.PAIR_PENALTY * (n.factors**2).sum() if pairs else factormachine.PENALTY * (n.weights**2).sum()
        return factormachine._losses(logits, label).mean() + penalty / 2

    near = lambda key, at: (loss(1e-5, key, at) - loss(-1e-5, key, at)) / 2e-5
    by_weight = factormachine.linear_slope(m, rows)[1]
    by_bias, by_factor = factormachine.factor_slope(m, rows, rows.linear_part(m))
    assert abs(by_bias[0] - near("bias", None)) < 1e-7
    assert all(abs(by_weight[k] - near("weights", k)) < 1e-7 for k in range(5))
    assert all(abs(by_factor[k, f] - near("factors", (k, f))) < 1e-7 for k in range(5) for f in range(2))


def test_machine_learns_a_pair():
    """Two terms that are harmless alone and toxic together: the factors carry what weights cannot."""
    m = factormachine.Machine(np.arange(2), np.ones(2), -2.0, np.zeros(2), np.full((2, 1), 3.0))
    logits = m.logits(np.array([0, 1, 2, 2]), np.array([0, 1, 0, 1]), 3)
    assert logits[0] < 0 and logits[1] < 0 and logits[2] > 0


def ranked(scores, labels):
    """The chance that a toxic row scores above another."""
    toxic, other = scores[labels == 1], scores[labels == 0]
    return np.mean([(t > other).mean() + 0.5 * (t == other).mean() for t in toxic])


def test_long_mixed_texts(spark):
    """Few toxic rows, long texts of many rare words: held-out scores must rank, not only training ones."""
    rng = random.Random(11)
    bad = [f"{a}{b}" for a in ("zzid", "qqsc", "vvtr") for b in ("iot", "um", "ash", "ot")]
    docs, labels = [], []
    for i in range(1200):
        words = [f"w{int(rng.paretovariate(0.7)) % 30000}" for _ in range(rng.randrange(5, 600))]
        toxic = int(rng.random() < 0.12)
        for _ in range(rng.randrange(1, 4) * toxic):
            words.insert(rng.randrange(len(words)), rng.choice(bad))
        docs.append((i, " ".join(words)))
        labels.append((i, toxic))
    found = factormachine.toxicity_scores(table(spark, docs, "doc_id long, text string"), table(spark, labels, "doc_id long, toxic int")).collect()
    held = [r for r in found if r.held_out]
    score, label = np.array([r.score for r in held]), np.array([dict(labels)[r.doc_id] for r in held])
    assert ranked(score, label) > 0.97 and (score[label == 1] >= 0.5).mean() > 0.75 and (score[label == 0] >= 0.5).mean() < 0.02
    assert len(set(score)) > 0.9 * len(held)


def test_given_tables_are_ranked(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{name}.parquet") for name in ("documents", "labels"))
    found = factormachine.toxicity_scores(docs, labels).filter("held_out").join(labels.select("doc_id", "toxic"), "doc_id").collect()
    score, label = np.array([r.score for r in found]), np.array([r.toxic for r in found])
    assert ranked(score, label) > 0.93 and len(set(score)) > 0.9 * len(found)


def test_terms_that_are_toxic_only_together(spark):
    """Each of the two words has the base rate as its own share of toxic rows; rows with both or neither are toxic."""
    rng = random.Random(3)
    docs, labels = [], []
    for i in range(800):
        first, second = i % 2, i // 2 % 2
        words = [f"w{rng.randrange(12)}" for _ in range(6)] + ["gr"] * first + ["ins"] * second
        rng.shuffle(words)
        docs.append((i, " ".join(words)))
        labels.append((i, int(first == second)))
    found = factormachine.toxicity_scores(table(spark, docs, "doc_id long, text string"), table(spark, labels, "doc_id long, toxic int"))
    held = [r for r in found.collect() if r.held_out]
    assert np.mean([r.predicted == dict(labels)[r.doc_id] for r in held]) > 0.9


def test_no_fixed_number_of_terms(spark):
    """Of three thousand words that are toxic alike, each is known."""
    docs = [(i, f"bad{i % 3000}x" if i % 2 else f"fine{i % 40}") for i in range(24000)]
    labels = [(i, i % 2) for i in range(24000)]
    rows = table(spark, [(i, t, l) for (i, t), (_, l) in zip(docs, labels)], "doc_id long, text string, label int")
    terms = rows.mapInArrow(factormachine._term_rows, "doc_id long, terms array<int>").join(rows.select("doc_id", "label"), "doc_id")
    machine = factormachine.fit(terms, rows=500)
    slots = {int(x) for r in terms.select("terms").collect() for x in r.terms}
    assert len(slots) > 2048 and all(machine.place[x] >= 0 for x in slots)


def test_accepted_keeps_columns(spark):
    docs, labels = corpus("quality")
    d = table(spark, docs, "doc_id long, text string").selectExpr("doc_id", "text", "'en' AS lang", "'s' AS stats")
    kept = kernelquality.accepted(d, table(spark, labels, "doc_id long, quality int"))
    assert kept.columns == d.columns
    share = np.mean([dict(labels)[r.doc_id] for r in kept.collect()])
    assert share > 0.95
