"""The registered operator queries against their oracle SQL, and the pipeline's stages against plain versions."""

from __future__ import annotations

import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from tests.oracle import connect, differences
from weftgraph.llm import queries as llm

from . import brute

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_oracle(spark, name):
    assert differences(llm.queries()[name](spark, SF), connect(SF), llm.oracle_sql()[name]) == ""


def test_language_on_held_out_rows(spark):
    docs = {d["doc_id"]: d for d in pq.read_table(f"{SF}/documents.parquet").to_pylist()}
    rows = [r for r in llm.op9_language(spark, SF).collect() if r["held_out"] and docs[r["doc_id"]]["lang"]]
    assert all(brute.held_out(r["doc_id"]) for r in rows)
    assert sum(r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in rows) >= 0.95 * len(rows)


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    bench = pq.read_table(f"{SF}/benchmark.parquet").to_pylist()
    for name, stage in corpus_pipeline.STAGES:
        before = [r.asDict() for r in docs.collect()]
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        after = {r["doc_id"]: r.asDict() for r in docs.collect()}
        if name != "mixing":
            assert docs.columns == columns
        if name == "language_id":
            gone = [d for d in before if d["doc_id"] not in after]
            assert all(not any(c.isalpha() for c in d["text"] or "") for d in gone)
        elif name == "line_dedup":
            want = brute.lines(before)
            assert {i: brute.sha(d["text"] or "") for i, d in after.items()} == {i: w[2] for i, w in want.items()}
            assert all(d["n_chars"] == len(d["text"] or "") for d in after.values())
        elif name == "near_dedup":
            want = brute.near(before, corpus_pipeline.PERCENT, corpus_pipeline.SHINGLE)
            assert set(after) == {i for i, (_, c) in want.items() if i == c}
        elif name == "decontamination":
            want = brute.hits(before, bench)
            assert set(after) == {i for i, w in want.items() if not w[4]}
        else:
            want = brute.targets(before)
            for s, (size, target) in want.items():
                rows = [r for r in after.values() if r["source"] == s]
                assert sum(r["size"] for r in rows) == size and abs(sum(r["taken"] for r in rows) - target) <= 1
