"""The registered queries at the smallest size: beside their SQL, or for rows and columns."""

import pytest

from locusloom.llm import queries
from locusloom.plans.check import compare, connect

COLUMNS = {
    "op1_forest_search": ["query_id", "rank", "vec_id", "score"], "op2_virtual_slots": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
    "op4_byte_pairs": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op5_personal_data": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"], "op6_pivotal_mix": ["doc_id", "size", "source_size", "target", "taken"],
    "op8_page_text": ["page_id", "url", "text", "n_chars"],
    "op9_prefix_fingerprints": ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    "op10_toxic_lexicon": ["doc_id", "held_out", "score", "predicted"],
    "op13_periodic_runs": ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]}


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql(spark, sf_dir, name):
    assert compare(spark, connect(sf_dir), queries.QUERIES[name], queries.ORACLE[name], sf_dir) is None


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_query_has_all_rows(spark, sf_dir, name):
    df = queries.QUERIES[name](spark, sf_dir)
    assert df.columns[:len(COLUMNS[name])] == COLUMNS[name]
    table = {"op1_forest_search": None, "op8_page_text": "pages"}.get(name, "documents")
    rows = df.count()
    assert rows == (50 if table is None else spark.read.parquet(f"{sf_dir}/{table}.parquet").count())


def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    kept = {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = f"{spark.conf.get('spark.checkpoint.dir')}/test-{name}"
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
        now = {r.doc_id for r in docs.select("doc_id").collect()}
        assert docs.columns == columns and now <= kept
        kept = now
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert last.count() == docs.count() and last.filter("NOT round_trip").count() == 0
