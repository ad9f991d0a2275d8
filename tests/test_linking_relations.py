"""Relations of one member stay out of the rounds; their nodes keep their components."""

from mailsift.operators import graph

ROWS = [("a", 1), ("a", 2), ("b", 2), ("b", 3), ("c", 3), ("d", 9), ("e", 9), ("f", 7), ("a", 1), (None, 4), ("g", None)]


def test_single_members(spark):
    members = spark.createDataFrame(ROWS, "relation_id string, email_id long")
    named = members.selectExpr("relation_id AS r", "email_id AS n").dropna().distinct()
    assert sorted(tuple(r) for r in graph.linking(named).collect()) == [("a", 1), ("a", 2), ("b", 2), ("b", 3)]
    found = graph.component_labels(members)
    assert found.columns == ["email_id", "component"]
    assert sorted(tuple(r) for r in found.collect()) == [(1, 1), (2, 1), (3, 1), (7, 7), (9, 9)]
    assert sorted(tuple(r) for r in graph.component_labels(members.filter("email_id > 5")).collect()) == [(7, 7), (9, 9)]
    assert graph.component_labels(members.filter("false")).collect() == []
