"""The pivot similarity join and campaigns around running centroids, against plain loops."""

import numpy as np
import pytest

from mailsift.operators import campaigns, vectorjoin

NAMES = "vec_id long, embedding array<double>"


def families(seed, groups=30, each=20, dims=12, spread=0.12):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(groups, dims))
    centre /= np.linalg.norm(centre, axis=1, keepdims=True)
    rows = np.repeat(centre, each, axis=0) + rng.normal(size=(groups * each, dims)) * spread
    return rows[rng.permutation(len(rows))]


def unit(rows):
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def table(spark, rows, first=0):
    return spark.createDataFrame([(first + i, [float(x) for x in row]) for i, row in enumerate(rows)], NAMES)


@pytest.mark.parametrize("sizes", [{}, {"pivots": 7, "block": 40}, {"pivots": 1, "block": 64}])
@pytest.mark.parametrize("threshold", [0.9, 0.3])
def test_join_finds_every_pair_once(spark, sizes, threshold):
    rows = families(1)
    score = np.round(unit(rows) @ unit(rows).T, 9)
    want = {(i, j): score[i, j] for i, j in zip(*np.nonzero(score >= threshold)) if i < j}
    found = vectorjoin.cosine_join(vectorjoin.vector_classes(table(spark, rows)), threshold, **sizes).collect()
    assert len(found) == len(want)
    assert all(abs(want[r.id_a, r.id_b] - r.similarity) < 1e-8 for r in found)


def test_few_pairs_are_scored(spark):
    """Tight families and a high threshold: the bounds keep most pairs from being scored at all."""
    rows = families(2, groups=60, each=50, dims=8, spread=0.01)
    cost = vectorjoin.join_cost(vectorjoin.vector_classes(table(spark, rows)), 0.99).selectExpr("sum(scored) AS s", "sum(found) AS f").first()
    assert cost.f > 60 * 50 * 20 and cost.s < len(rows) ** 2 / 8


def test_crowded_cells_are_cut(spark):
    rows = families(3, groups=1, each=600, dims=6, spread=0.02)
    cost = vectorjoin.join_cost(vectorjoin.vector_classes(table(spark, rows)), 0.9, block=50).collect()
    assert len(cost) > 50 and max(r.rows for r in cost) < 300


def test_copies_zero_and_broken_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.9, 0.1]), (4, [0.0, 0.0]), (5, None), (6, []), (7, [float("inf"), 1.0]), (8, [0.0, 1.0])]
    classes = vectorjoin.vector_classes(spark.createDataFrame(rows, NAMES))
    assert sorted((r.vec_id, r.class_id) for r in classes.collect()) == [(1, 1), (2, 1), (3, 3), (8, 8)]
    assert [(r.id_a, r.id_b) for r in vectorjoin.cosine_join(classes, 0.9).collect()] == [(1, 3)]
    assert vectorjoin.cosine_join(classes.filter("false"), 0.9).collect() == []


def test_joining_links_keep_components(spark):
    classes = vectorjoin.vector_classes(table(spark, families(4, groups=10)))
    whole = vectorjoin.cosine_join(classes, 0.85).select("id_a", "id_b").collect()
    few = vectorjoin.joining_links(classes, 0.85, pivots=5, block=30).collect()

    def components(links):
        root = list(range(200))
        for a, b in sorted(links):
            ra, rb = root[a], root[b]
            root = [min(ra, rb) if r in (ra, rb) else r for r in root]
        return root

    assert components(map(tuple, few)) == components(map(tuple, whole)) and len(few) < len(whole)


def sequential(ids, rows, threshold):
    """The rule as stated, one row after another over plain lists."""
    clusters, out = [], {}
    for i, row in sorted(zip(ids, rows), key=lambda x: x[0]):
        scores = [round(float(np.mean(m, axis=0) / np.linalg.norm(np.mean(m, axis=0)) @ row), 9) for _, m in clusters]
        best = int(np.argmax(scores)) if scores else -1
        if best >= 0 and scores[best] >= threshold:
            clusters[best][1].append(row)
        else:
            clusters.append((i, [row]))
            best = len(clusters) - 1
        out[i] = clusters[best][0]
    return out


@pytest.mark.parametrize("threshold,block", [(0.9, 256), (0.8, 7), (0.5, 1)])
def test_running_campaigns_equal_the_sequential_rule(spark, threshold, block):
    rows = families(5, groups=12, each=15, dims=6, spread=0.2)
    found = campaigns.running_campaigns(table(spark, rows), threshold, key="vec_id", block=block).collect()
    assert {r.vec_id: r.cluster_id for r in found} == sequential(range(len(rows)), unit(rows), threshold) and len(found) == len(rows)


def test_a_campaign_follows_its_centroid(spark):
    """A chain of reworded messages: each is near the mean so far, the last ones are far from the first."""
    at = np.radians([0, 20, 25, 30, 35, 90])
    rows = np.stack([np.cos(at), np.sin(at)], axis=1)
    found = {r.vec_id: r.cluster_id for r in campaigns.running_campaigns(table(spark, rows), 0.93, key="vec_id").collect()}
    fixed = {r.vec_id: r.cluster_id for r in campaigns.campaign_leaders(table(spark, rows), 0.93, key="vec_id").collect()}
    assert found == {0: 0, 1: 0, 2: 0, 3: 0, 4: 0, 5: 5} and fixed[4] != 0


def test_parts_are_independent(spark):
    rows = families(6, groups=9, each=10, dims=10, spread=0.1)
    part = {r.vec_id: r.part for r in campaigns.independent_parts(table(spark, rows), 0.9, "vec_id").collect()}
    joined = {r.vec_id: r.cluster_id for r in campaigns.running_campaigns(table(spark, rows), 0.9, key="vec_id").collect()}
    assert len(set(part.values())) > 1 and all(part[i] == part[c] for i, c in joined.items())


def test_rows_without_direction(spark):
    rows = [(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [1.0, 0.0]), (4, [0.0, 0.0])]
    found = {r.vec_id: r.cluster_id for r in campaigns.running_campaigns(spark.createDataFrame(rows, NAMES), 0.8, key="vec_id").collect()}
    assert found == {1: 1, 2: 2, 3: 2, 4: 4}
