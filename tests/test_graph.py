"""Components by hub-free relations: against union-find, and with crowded relations, nodes and labels."""

import random
import statistics

import pytest

from mailsift.operators import graph

NAMES = "relation_id string, email_id long"


def union_find(rows):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    first = {}
    for relation, node in rows:
        if relation is None or node is None:
            continue
        other = first.setdefault(relation, node)
        a, b = find(other), find(node)
        root[max(a, b)] = min(a, b)
    return {node: find(node) for relation, node in rows if relation is not None and node is not None}


def labels(spark, rows, **kwargs):
    return {r.email_id: r.component for r in graph.component_labels(spark.createDataFrame(rows, NAMES), **kwargs).collect()}


@pytest.mark.parametrize("hub", [8, graph.HUB])
def test_random_relations(spark, hub):
    rng = random.Random(hub)
    rows = [(f"r{rng.randrange(60)}", rng.randrange(150)) for _ in range(170)] + [("big", i) for i in range(40, 60)]
    rows += [(f"s{i}", 7) for i in range(30)] + [(None, 3), ("x", None)]
    assert labels(spark, rows, hub=hub) == union_find(rows)


def test_long_chain(spark):
    rows = [(f"c{i}", n) for i in range(60) for n in (i, i + 1)]
    assert set(labels(spark, rows).values()) == {0}


def test_no_rows(spark):
    assert labels(spark, []) == {}


def test_names_that_look_like_parts(spark):
    rows = [("a", 1), ("a", 2), ("a#1#0", 3), ("node", 4), ("node", 5)]
    assert labels(spark, rows, hub=2) == union_find(rows)
    with pytest.raises(ValueError):
        labels(spark, rows, hub=1)


def crowded(spark, rows, relation, node):
    return spark.range(rows).selectExpr(f"{relation} AS relation_id", f"{node} AS email_id")


@pytest.mark.parametrize("relation,node", [("'all'", "id"), ("CAST(id AS STRING)", "0L")])
def test_hubs_are_cut(spark, relation, node):
    """A hundred thousand rows of one relation, or of one node: no key of the cut table has many rows."""
    rows = crowded(spark, 100_000, relation, node).selectExpr("relation_id AS r", "email_id AS n")
    cut = graph._without_hubs(rows, graph.HUB)
    assert cut.groupBy("r").count().selectExpr("max(count)").first()[0] < 2 * graph.HUB
    assert cut.groupBy("n", "alias").count().selectExpr("max(count)").first()[0] < 2 * graph.HUB
    dealt = [r["count"] for r in cut.repartition(8, "r").groupBy(graph.F.spark_partition_id()).count().collect()]
    assert max(dealt) < 2 * statistics.median(dealt)


def test_a_label_of_all_rows_is_dealt_out(spark):
    rows = spark.range(50_000).selectExpr("id AS n", "0L AS label")
    few = spark.createDataFrame([(0, -1)], "label long, further long")
    joined = graph.salted_left_join(rows, few, "label", "n")
    assert joined.filter("further = -1").count() == 50_000
    dealt = rows.withColumn("salt", graph.F.pmod(graph.F.xxhash64("n"), graph.F.lit(graph.SALTS))).repartition(8, "label", "salt")
    sizes = [r["count"] for r in dealt.groupBy(graph.F.spark_partition_id()).count().collect()]
    assert max(sizes) < 2 * statistics.median(sizes)


def test_a_whole_crowded_component(spark):
    found = graph.component_labels(crowded(spark, 30_000, "'all'", "id + 5")).groupBy("component").count().collect()
    assert [(r.component, r["count"]) for r in found] == [(5, 30_000)]
