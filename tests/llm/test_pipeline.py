import importlib

import pytest

SF = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_and_pack_what_is_left(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF).checkpoint()
        assert out.columns == docs.columns, name
        assert out.count() <= docs.count() and out.select("doc_id").distinct().count() == out.count()
        docs = out
    pieces = pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in pieces} == {r.doc_id for r in docs.select("doc_id").collect()}
    assert [n for n, _ in pipeline.STAGES] == ["quality", "near_dedup", "decontamination", "secrets", "packing"]


def test_entry_registers_every_operator():
    entry = importlib.import_module("__spark_entry__")
    names = entry.queries()
    assert {n.split("_")[0] for n in names if n.startswith("op")} >= {f"op{k}" for k in range(1, 11)} and "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names)
