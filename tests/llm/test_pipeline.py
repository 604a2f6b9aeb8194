"""The pipeline against brute-force versions of its stages, each on its own input; the SQL of the queries that have one."""

import pytest

import corpus_pipeline
from helpers import plain
from test_text_operators import brute_contamination, brute_join, brute_lines, pairs
from tickframe.llm import toxicity
from tickframe.llm.queries import ORACLES, QUERIES


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    steps = [docs]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name.replace(" ", "-"))
        stage(spark, steps[-1], sf).write.parquet(path)
        steps.append(spark.read.parquet(path))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "SentencePiece encoding"]
    assert all(s.columns == docs.columns for s in steps[:-1])
    clean, lines, single, apart, ids = steps[1:]
    score = toxicity.train(docs, spark.read.parquet(f"{sf}/labels.parquet")).scorer()
    assert sorted(pairs(clean, "doc_id")) == sorted((d,) for d, t in pairs(docs, "doc_id", "text") if score(t) < toxicity.THRESHOLD)
    assert sorted(pairs(lines, "doc_id", "text")) == sorted(brute_lines(sorted(pairs(clean, "doc_id", "text")), runs=True))
    assert {d for (d,) in pairs(single, "doc_id")} == {c for c, *_ in brute_join(pairs(lines, "doc_id", "text")).values()}
    found = brute_contamination(pairs(single, "doc_id", "text"), pairs(spark.read.parquet(f"{sf}/benchmark.parquet"), "item_id", "text"))
    assert {d for (d,) in pairs(apart, "doc_id")} == {r[0] for r in found if not r[-1]}
    assert {d for (d,) in pairs(ids, "doc_id")} == {d for (d,) in pairs(apart, "doc_id")}
    assert sorted(pairs(corpus_pipeline.run(spark, sf), "doc_id", "ids_crc32")) == sorted(pairs(ids, "doc_id", "ids_crc32"))


def test_the_pipeline_takes_messy_rows(spark, sf, messy):
    docs = messy
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == messy.columns
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() > 3
    assert corpus_pipeline.STAGES[0][1](spark, messy.limit(0), sf).count() == 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf, name):
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "conversations", "pages"):
        db.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got, wanted = QUERIES[name](spark, sf).toPandas(), db.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(wanted.columns) and plain(got) == plain(wanted)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_other_queries_give_a_row_for_each_of_their_table(spark, sf, name):
    table = "pages" if name.startswith("op10") else "documents"
    assert QUERIES[name](spark, sf).count() == spark.read.parquet(f"{sf}/{table}.parquet").count()
