"""Every registered query on the smallest tables: names and types of its contract, whole results."""

import pytest
from pyspark.sql import functions as F

from freshet.llm import registry

SMALL = "/root/testdata/sf0.001"
LONG, INT, REAL, TEXT, TRUTH = "bigint", "int", "double", "string", "boolean"
CONTRACTS = {
    "op1_toxicity": dict(doc_id=LONG, held_out=TRUTH, score=REAL, predicted=INT),
    "op2_sharding": dict(doc_id=LONG, size=LONG, text_crc32=LONG, law=TEXT, shard=INT, slot=LONG, grown_shard=INT),
    "op3_language_model": dict(doc_id=LONG, held_out=TRUTH, n_tokens=LONG, n_known=LONG, train_tokens=LONG,
                               base_score=REAL, score=REAL),
    "op4_jaccard": dict(doc_id=LONG, n_shingles=LONG, component_id=LONG),
    "op6_token_store": dict(doc_id=LONG, start=LONG, n_tokens=LONG, ids_crc32=LONG),
    "op8_packing": dict(doc_id=LONG, start=LONG, length=LONG, ids_crc32=LONG, doc_tokens=LONG, sequence_id=LONG, offset=LONG),
    "op9_pii": dict(doc_id=LONG, n_email=LONG, n_ip=LONG, n_card=LONG, n_phone=LONG, base_sha256=TEXT, spans=TEXT),
    "op10_fingerprints": dict(doc_id=LONG, n_chars=LONG, edited_sha256=TEXT, fingerprint=TEXT, edited_fingerprint=TEXT,
                              near_edited=REAL, near_next=REAL),
    "op11_lexical_search": dict(item_id=LONG, rank=INT, doc_id=LONG, score=LONG),
    "op12_substring_dedup": dict(doc_id=LONG, n_words=LONG, n_removed=LONG, kept_sha256=TEXT),
    "op13_conversation_repair": dict(conv_id=LONG, gaps=LONG, blank=LONG, duplicate=LONG, truncated=LONG, illegal=LONG,
                                     cost=LONG, audit=TEXT, repaired_sha256=TEXT),
}
#: columns that may be NULL
MISSING = {"grown_shard"}


def test_all_are_registered():
    assert [n.split("_")[0] for n in registry.QUERIES] == [f"op{i}" for i in range(1, 14)]
    assert set(registry.SQL) <= set(registry.QUERIES)


@pytest.mark.parametrize("name", list(CONTRACTS))
def test_contract(spark, name):
    found = registry.QUERIES[name](spark, SMALL)
    types = dict(found.dtypes)
    assert {c: types.get(c) for c in CONTRACTS[name]} == CONTRACTS[name]
    nulls = found.agg(*[F.sum(F.col(c).isNull().cast("int")).alias(c) for c in CONTRACTS[name]]).first().asDict()
    assert {c for c, n in nulls.items() if n} <= MISSING
    table, key = ("conversations", "conv_id") if name.startswith("op13") else ("documents", "doc_id")
    if not name.startswith("op11"):  # a row or more for every document
        whole = spark.read.parquet(f"{SMALL}/{table}.parquet").select(key).distinct()
        assert found.select(key).distinct().count() == whole.count() == whole.join(found, key, "left_semi").count()


@pytest.mark.parametrize("name", ["op5_decontamination", "op7_token_counts"])
def test_others_run(spark, name):
    found = registry.QUERIES[name](spark, SMALL)
    assert "doc_id" in found.columns and found.count() > 0
