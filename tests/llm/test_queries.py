"""The registered queries against their SQL, and the pipeline as a whole."""

import random

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from mailsift.llm import kernelquality, queries
from tests.compare import difference, duck

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    mine = entry.queries()[name](spark, FOLDER).toPandas()
    assert difference(mine, duck(FOLDER).execute(queries.SQL[name]).df()) is None


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_query_without_sql_gives_one_row_a_document(spark, name):
    assert entry.queries()[name](spark, FOLDER).count() == spark.read.parquet(f"{FOLDER}/documents.parquet").count()


def test_pipeline(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, FOLDER)
        assert kept.columns == docs.columns and 0 < kept.count() <= docs.count()
    assert "pipeline" in entry.queries()


def test_whole_pipeline_on_planted_rows(spark, tmp_path):
    """run() over a small folder: what each stage must take out or change, by id and text."""
    rng = random.Random(21)
    word = lambda: "".join(rng.choice(["ka", "lo", "mi", "ten", "ra", "su"]) for _ in range(rng.randrange(1, 4)))
    prose = lambda n: " ".join(word() for _ in range(n)) + "."
    poor = lambda n: " ".join(word().upper() + "!!###" for _ in range(n))
    rows = {i: prose(rng.randrange(60, 140)) if i % 3 else poor(rng.randrange(40, 90)) for i in range(300)}
    labels = [(i, int(i % 3 > 0), 0) for i in range(300)]
    passage, secret = prose(30), "AKIA" + "Q7" * 10
    rows |= {
        400: rows[1], 401: rows[2].replace(".", " moreover."), 402: prose(40) + " " + passage + " " + prose(40),
        403: prose(50) + f" password: {secret[4:]}z9 " + prose(20),
    }
    odd = [(None, passage), (500, prose(80)), (500, prose(70)), (500, rows[4]), (None, rows[5]), (501, None), (None, prose(66))]
    docs = [(i, t, "en", "s", len(t or ""), 1) for i, t in [*rows.items(), *odd, (500, odd[1][1])]]
    names = "doc_id long, text string, lang string, source string, n_chars long, n_tokens int"
    spark.createDataFrame(docs, names).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([("b1", passage)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    kept = {(str(r.doc_id), r.text or "") for r in out}
    assert len(kept) == len(out)
    table = lambda name: spark.read.parquet(f"{tmp_path}/{name}.parquet")
    accepted = {(str(r.doc_id), r.text) for r in kernelquality.accepted(table("documents"), table("labels")).collect()}
    good = [(str(i), t) for i, t in rows.items() if i % 3 and i < 300]
    assert len(accepted & set(good)) > 0.95 * len(good) and not any((str(i), rows[i]) in accepted for i in range(0, 300, 30))
    good += [("403", rows[403]), ("500", odd[1][1]), ("500", odd[2][1]), ("None", odd[6][1])]
    want = {(i, t.replace(f"password: {secret[4:]}z9", "[SECRET]")) for i, t in good if (i, t) in accepted}
    found = {x for x in kept if x[0] != "501"}
    assert (found - want, want - found) == (set(), set())
    assert all(r.n_tokens == len(r.token_ids) and r.parity for r in out)


def test_pipeline_on_odd_rows(spark):
    rows = [(1, None, "en", "s", 0), (2, "", None, None, 0), (2, "", None, None, 0), (None, "x y z", "en", "s", 5), (3, "one two three", "en", "s", 13)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[1:-1]:
        docs = stage(spark, docs, FOLDER)
    out = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).collect()
    assert sorted(str(r.doc_id) for r in out) == ["1", "2", "3", "None"]
    assert corpus_pipeline.STAGES[0][1](spark, docs.filter("false"), FOLDER).count() == 0
