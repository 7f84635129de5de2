"""The pipeline over a small corpus, and the registered queries that have SQL."""

import os
import tempfile
from pathlib import Path

import duckdb

import corpus_pipeline
from ledgerloom.llm import oracles, queries
from ledgerloom.llm.common import CLEAN_SHUFFLES, stage
from tests.conftest import SF_DIR


def test_every_stage_takes_effect(spark, tmp_path):
    source = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    before = {r.doc_id: r for r in source.collect()}
    docs = source.withColumn("extra", source.doc_id)
    for name, step in corpus_pipeline.STAGES[:-1]:
        docs = stage(step(spark, docs, SF_DIR), name)
        assert docs.columns == corpus_pipeline.COLUMNS
        rows = docs.collect()
        now = {r.doc_id for r in rows}
        assert now and now <= set(before)
        if name == "near_dedup":
            assert len({r.text for r in rows}) == len(rows)
        before = {r.doc_id: r for r in rows}
    encoded = corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR)
    assert encoded.count() == docs.count() and encoded.filter("n_tokens = 0").isEmpty()


def test_stages_take_an_empty_and_an_odd_table(spark, odd_docs):
    told = odd_docs.collect()
    out = {}
    for name, step in corpus_pipeline.STAGES:
        assert step(spark, odd_docs.limit(0), SF_DIR).collect() == []
        frame = step(spark, odd_docs, SF_DIR)
        assert name == "bpe" or frame.columns == corpus_pipeline.COLUMNS
        out[name] = frame.collect()
    rows = {tuple(r[c] for c in corpus_pipeline.COLUMNS) for r in told}
    for name in ("quality_rules", "near_dedup"):
        assert {tuple(r) for r in out[name]} <= rows
    assert all(r.text and len(r.text.split()) >= 50 for r in out["quality_rules"])
    texts = [r.text for r in out["near_dedup"] if r.text is not None]
    assert len(texts) == len(set(texts)) and sum(r.text is None for r in out["near_dedup"]) == sum(r.text is None for r in told)
    assert all(r.text for r in out["substring_dedup"]) and [r.doc_id for r in out["substring_dedup"] if r.doc_id in (1, 3)] == [1]
    assert all(r.text and r.text.split() for r in out["mixing"]) and {r.doc_id for r in out["mixing"]} <= {r.doc_id for r in told}
    assert len(out["bpe"]) == len(told) and sum(r.n_tokens == 0 for r in out["bpe"]) == sum(not (r.text or "").strip() for r in told)


def test_tool_calls_equal_their_sql(spark):
    duck = duckdb.connect()
    duck.execute(f"create view conversations as select * from '{SF_DIR}/conversations.parquet'")
    for name, text in oracles.sql().items():
        told = duck.execute(text)
        columns = [d[0] for d in told.description]
        got = queries.REGISTERED[name](spark, SF_DIR).select(*columns).collect()
        assert sorted(map(tuple, got), key=str) == sorted(told.fetchall(), key=str)


def test_staged_writes_leave_no_shuffle_files(spark, tmp_path):
    local = [p for p in Path(spark.conf.get("spark.local.dir", tempfile.gettempdir())).glob("blockmgr-*") if os.access(p, os.W_OK)]
    files = lambda: {f for p in local for f in p.rglob("shuffle_*.data")}
    before, setting = files(), spark.conf.get(CLEAN_SHUFFLES)
    rows = stage(spark.range(1000).repartition(3).groupBy("id").count(), "t")
    assert len(rows.collect()) == 1000 and spark.conf.get(CLEAN_SHUFFLES) == setting
    plain = spark.range(1000).repartition(3, "id")
    plain.write.parquet(str(tmp_path / "plain"))
    own = files() - before
    # The plain write's files show that the folder is the right one.
    assert len(own) > 0 and len({f.name.split("_")[1] for f in own}) == 1
