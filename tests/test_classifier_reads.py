"""The classifier's query reads whole texts once."""

import __spark_entry__ as entry


def test_features_are_extracted_once(spark):
    scored = entry.queries()["classifier_scores"](spark, "/root/testdata/sf0.001")
    assert not [name for name in scored.inputFiles() if "documents" in name]
    rows = scored.collect()
    assert len(rows) == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
    assert all(abs(r.ham_score + r.spam_score + r.phishing_score - 1) < 0.001 for r in rows)
