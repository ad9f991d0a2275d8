"""Components of close vectors without a join in cells where a few rows already link them."""

import numpy as np
import pandas as pd
import pytest

from mailsift.operators import campaigns, vectorjoin


def parts(n, links):
    label = list(range(n))
    for a, b in links:
        low, high = sorted((label[a], label[b]))
        label = [low if x == high else x for x in label]
    return label


def vectors(spread, strays):
    rng = np.random.default_rng(5)
    crowd = rng.standard_normal((300, 8)) * spread + np.eye(8)[0] * 3
    far = rng.standard_normal((strays, 8)) * 0.05 - np.eye(8)[1] * 4
    return np.concatenate([crowd, far])


@pytest.mark.parametrize("strays, rest, cells", [(0, 50, False), (20, 50, False), (20, 3, True)])
def test_components_equal_all_pairs(spark, monkeypatch, strays, rest, cells):
    rows = vectors(0.8, strays)
    classes = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "class_id long, v array<double>")
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    close = np.argwhere(np.round(unit @ unit.T, 9) >= 0.6)
    called = []
    joined = vectorjoin._joined
    monkeypatch.setattr(vectorjoin, "_joined", lambda *given: called.append(1) or joined(*given))
    links = [(r.id_a, r.id_b) for r in vectorjoin.joining_links(classes, 0.6, pivots=6, block=50, rest=rest).collect()]
    assert parts(len(rows), links) == parts(len(rows), [(int(a), int(b)) for a, b in close])
    assert bool(called) == cells


def test_no_rows(spark):
    assert vectorjoin.joining_links(spark.createDataFrame([], "class_id long, v array<double>"), 0.6).collect() == []


def test_a_crowded_tile_hands_on_its_pairs_in_parts(spark, monkeypatch):
    rows = np.eye(8)[0] + np.random.default_rng(6).standard_normal((700, 8)) * 0.01
    frame = pd.DataFrame({"cell": 0, "first": 0, "second": 0, "side": 0, "angle": np.linspace(0, 0.01, 700), "id": range(700), "v": list(rows)})
    strips = list(vectorjoin._close(frame, 0.9))
    assert len(strips) > 3 and max(len(a) for a, *_ in strips) <= vectorjoin.STRIP**2
    pairs = [pair for a, b, *_ in strips for pair in zip(a.tolist(), b.tolist())]
    assert len(pairs) == len(set(pairs)) == 700 * 699 // 2 and all(a < b for a, b in pairs)
    handed = []
    monkeypatch.setattr(vectorjoin, "HANDED", 1000)
    monkeypatch.setattr(vectorjoin, "_joined", lambda classes, threshold, pivots, block, judge, layout: handed.extend(judge(frame)))
    vectorjoin.cosine_join(spark.createDataFrame([], "class_id long, v array<double>"), 0.9)
    assert len(handed) > 3 and sorted(zip(*(pd.concat(handed)[c] for c in ("id_a", "id_b")))) == sorted(pairs)


def test_links_are_counted_in_tiles(spark):
    rows = vectors(0.8, 20)
    classes = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "class_id long, v array<double>")
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    close = (np.round(unit @ unit.T, 9) >= 0.6).sum(axis=1) - 1
    found = {r.id: r.links for r in vectorjoin.close_counts(classes, 0.6, pivots=5, block=40).collect()}
    assert found == {i: int(n) for i, n in enumerate(close) if n}


def test_leaders_are_scored_in_strips(spark, monkeypatch):
    monkeypatch.setattr(campaigns, "SCORES", 100)
    frame = pd.DataFrame({"vec_id": range(50), "_v": [v for v in vectors(0.8, 0)[:50]]})
    parts = list(campaigns._strips(frame, frame[:8]))
    assert all(scores.size <= 100 for _, scores in parts) and pd.concat([some for some, _ in parts]).equals(frame)
    assert np.array_equal(np.concatenate([scores for _, scores in parts]), campaigns._scores(frame, frame[:8]))
    assert [scores.shape for _, scores in campaigns._strips(frame, frame[:0])] == [(50, 0)]
