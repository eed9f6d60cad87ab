from __future__ import annotations

from pathlib import Path

import corpus_pipeline
import duckdb
import pytest
from pyspark.sql import functions as F

from tessella.llm import decontam, lines, simhash
from tessella.llm._shared import table
from tessella.llm.queries import ORACLES, QUERIES


def test_stages_follow_each_other(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir).cache()
        before, after = {r.doc_id: r for r in docs.collect()}, {r.doc_id: r for r in out.collect()}
        assert after.keys() <= before.keys() and len(after) == out.count()
        if name != "sentencepiece":
            assert out.columns == list(corpus_pipeline.COLUMNS)
        if name == "line_dedup":
            assert after.keys() == before.keys()
            gone = {(r.doc, r.line) for r in lines.repeated_lines(docs).collect()}
            assert all(after[d].text == "\n".join(x for i, x in enumerate(r.text.split("\n")) if (d, i) not in gone) for d, r in before.items())
            assert all(r.n_chars == len(r.text) for r in after.values())
        elif name == "simhash_near_dedup":
            groups = simhash.near_duplicates(docs, width=corpus_pipeline.SHINGLE, k=corpus_pipeline.BITS)
            assert after.keys() == {r.component_id for r in groups.collect()}
        elif name == "benchmark_decontamination":
            found = decontam.contamination(docs, table(spark, sf_dir, "benchmark"))
            assert before.keys() - after.keys() == {r.doc_id for r in found.where("contaminated or longest_hit >= 13").collect()}
        elif name == "sentencepiece":
            assert all(r.lossless for r in after.values())
        if name not in ("line_dedup", "sentencepiece"):
            assert all(after[d] == before[d] for d in after)
        docs = out


def test_run_is_the_stages(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).where(~F.col("lossless")).count() == 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_duckdb(spark, sf_dir, name):
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    got, want = QUERIES[name](spark, sf_dir).toPandas(), con.execute(ORACLES[name]).df()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    assert sorted(map(tuple, got[cols].to_numpy().tolist())) == sorted(map(tuple, want[cols].to_numpy().tolist()))
