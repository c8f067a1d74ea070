"""Every registered query over a small scale, and the pipeline stage by stage."""

import pytest
from tests.llm.fixtures import plain_groups

import corpus_pipeline
from checks.compare import compare, connect
from tablewright.llm import queries

SF = "/root/testdata/sf0.001"
#: Columns that the queries promise.
COLUMNS = {
    "op1": "doc_id size text_crc32 law shard slot grown_shard",
    "op2": "page_id url text n_chars",
    "op3": "doc_id n_shingles component_id kept",
    "op4": "doc_id n_bytes n_tokens over_limit",
    "op5": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op6": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
    "op7": "doc_id size source_size target taken",
    "op8": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op9": "doc_id n_assign n_access n_hex base_sha256 spans",
    "op10": "doc_id held_out score predicted",
    "op11": "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256",
    "op12": "doc_id leaf subroot root proof_sha256 folded_root verified",
    "op13": "doc_id start n_tokens ids_crc32",
}


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, name):
    df = queries.QUERIES[name](spark, SF)
    assert df.columns == COLUMNS[name.split("_")[0]].split()
    if name in queries.ORACLES:
        assert compare(df, connect(SF), queries.ORACLES[name]).startswith("ok")
    else:
        source = "pages" if name.startswith("op2") else "documents"
        assert df.count() == spark.read.parquet(f"{SF}/{source}.parquet").count()


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = corpus_pipeline.written(stage(spark, docs, SF), name)
        after = docs.collect()
        if name != "encode":
            assert docs.columns == columns
        if name == "near_dedup":
            groups = plain_groups(list(before.items()), 5, 80)
            assert sorted(r.doc_id for r in after) == sorted({g for _, g in groups.values()})
        if name == "mask_secrets":
            assert len(after) == len(before)
        assert 0 < len(after)
    assert all(len(r.ids) == r.n_tokens for r in after)
