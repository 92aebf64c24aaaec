"""Registered training-data queries against their SQL, and the pipeline's stages against plain Python."""

import os
import re

import duckdb
import pytest

import __spark_entry__ as entry_module
import corpus_pipeline
from newsweft.llm.queries import CHECKS, QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf_dir}/{f}'")
    return con


def test_all_are_registered():
    assert {f"op{n}" for n in range(1, 14)} == {name.split("_")[0] for name in QUERIES}
    assert set(QUERIES) | {"pipeline"} <= set(entry_module.queries()) and set(CHECKS) <= set(entry_module.oracle_sql())


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_query_against_sql(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted(repr([r[c] for c in columns]) for r in df.collect())
    result = duck.execute(CHECKS[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    assert got == sorted(repr([r[names.index(c)] for c in columns]) for r in result.fetchall())


def test_pipeline_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, now, sf_dir)
        assert kept.columns == docs.columns
        before = {r.doc_id: r.text for r in now.collect()}
        after = {r.doc_id: r for r in kept.collect()}
        assert set(after) <= set(before) and after
        if name == "quality rules":
            assert all(len(WORD.findall(r.text)) >= 10 and r.text == before[i] for i, r in after.items())
        if name == "MinHash near-dedup":
            texts = [r.text for r in after.values()]
            assert len(set(texts)) == len(texts)
            first = {}
            for i in sorted(before):
                first.setdefault(before[i], i)
            assert set(after) <= set(first.values())
        if name == "substring dedup":
            seen = set()
            for i in sorted(after):
                assert after[i].n_chars == len(after[i].text)
                assert set(WORD.findall(after[i].text)) <= set(WORD.findall(before[i]))
                seen.add(i)
                if len(WORD.findall(after[i].text)) == len(WORD.findall(before[i])):
                    assert after[i].text == before[i]
            unchanged = [i for i in before if i in after and before[i] == after[i].text]
            assert len(unchanged) > len(before) // 2
        if name == "benchmark decontamination":
            plain = lambda t: " ".join(WORD.findall(t))
            leaks = {i for i, t in before.items() if any(plain(x) in plain(t) for x in items)}
            assert not leaks & set(after)
            assert len(before) - len(after) <= 2 * len(leaks) + 2
        now = spark.createDataFrame(kept.collect(), kept.schema)
    packed = corpus_pipeline.STAGES[-1][1](spark, now, sf_dir).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in now.collect()}
    assert max(r.offset + r.length for r in packed) <= 2048


def test_pipeline_of_nothing(spark, sf_dir):
    empty = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0


def test_pipeline_runs(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
