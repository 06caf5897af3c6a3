"""Every registered query of the subpackage and every stage of the pipeline, run as they are."""

import random
import shutil
from collections import Counter

import duckdb
import pytest

import corpus_pipeline as P
from sparkgauge.llm import queries as Q
from test_text_operators import brute_components, odd, prose

SF = "/root/testdata/sf0.001"
SHAPES = {
    "op1_line_dedup": "doc_id text removed_lines removed_chunks", "op2_sharding": "doc_id slot shard", "op3_packing": "doc_id start length ids_crc32 doc_tokens sequence_id offset", "op4_quality_crf": "doc_id held_out score predicted",
    "op5_quality_rules": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words llr base_failed kept", "op6_pii": "doc_id text n_entities", "op7_secret_scan": "doc_id n_assign n_access n_hex n_crf base_sha256 spans",
    "op8_decontamination": "doc_id item_id score question_overlap answer_overlap", "op9_license_scan": "doc_id n_blocks licenses best_saved", "op10_near_duplicates": "doc_id n_shingles component_id kept",
}


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_query(spark, name):
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    out = Q.queries()[name](spark, SF)
    assert out.columns == SHAPES[name].split()
    rows = out.collect()
    if name not in ("op3_packing", "op8_decontamination"):
        assert len(rows) == n
    if name in Q.oracle_sql():
        con = duckdb.connect()
        con.sql(f"create view documents as select * from '{SF}/documents.parquet'")
        found = con.sql(Q.oracle_sql()[name])
        at = [found.columns.index(c) for c in out.columns]
        assert Counter(tuple(r) for r in rows) == Counter(tuple(x[i] for i in at) for x in found.fetchall())


def test_pipeline_keeps_every_token_of_what_stays(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in P.STAGES[:-1]:
        out = P.cut(stage(spark, docs, SF))
        assert out.columns == docs.columns, name
        assert out.count() <= docs.count()
        docs = out
    ids = {r.doc_id for r in docs.collect()}
    pieces = P.run(spark, SF).collect()
    assert {p.doc_id for p in pieces} == ids and P.ORACLE_SQL is None
    for doc in ids:
        own = sorted((p.start, p.length, p.doc_tokens) for p in pieces if p.doc_id == doc)
        assert [a for a, *_ in own] == [sum(n for _, n, _ in own[:k]) for k in range(len(own))] and sum(n for _, n, _ in own) == own[0][2]


def test_duplicates_equal_brute_force(spark):
    r = random.Random(21)
    rows = []
    for _ in range(20):
        base = prose(r, r.randint(20, 120)).split()
        for _ in range(r.randint(1, 6)):
            copy = list(base)
            for _ in range(r.choice([0, 0, 1, 2])):
                copy[r.randrange(len(copy))] = prose(r, 1)
            rows.append((len(rows), " ".join(copy)))
    want = {i for i, _, c in brute_components(rows, 80) if i == c}
    docs = spark.createDataFrame(rows + rows[:7], "doc_id long, text string")
    assert sorted(x.doc_id for x in P.duplicates(spark, docs, SF).collect()) == sorted(want)


@pytest.mark.parametrize("k", range(5))
def test_stage_odd(spark, tmp_path, k):
    name, stage = P.STAGES[k]
    docs = odd(spark).withColumnRenamed("label", "predicted").withColumnRenamed("h1", "n_chars")
    out = stage(spark, docs, SF)
    rows = out.collect()
    if name == "packing":
        assert len({r.sequence_id for r in rows}) >= 1 and sum(r.length for r in rows) == sum(r.doc_tokens for r in rows if r.start == 0)
    else:
        assert out.columns == docs.columns
    if name == "near_duplicates":
        assert Counter(r.doc_id for r in rows) == {None: 2, 1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 1, 7: 1, 8: 1}
    if name in ("line_dedup", "decontamination"):
        assert len(rows) == docs.count() and sum(r.text is None for r in rows) == 2
    assert stage(spark, docs.limit(0), SF).count() == 0


def test_stages_without_labels_or_items(spark, tmp_path):
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert P.quality(spark, docs, str(tmp_path)).count() == docs.count()
    assert P.benchmark(spark, docs, str(tmp_path)).count() == docs.count()
    shutil.rmtree(tmp_path)
