"""The registered queries next to their SQL, and their contracts, on the smallest tables."""

import pytest
from compare import connect, difference

from driftlens.llm.queries import ORACLE_SQL, QUERIES

FOLDER = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_neardup": ("documents", ["doc_id", "n_shingles", "component_id", "kept"]),
    "op3_pii": ("documents", ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]),
    "op4_secrets": ("documents", ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]),
    "op5_archives": ("pages", ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]),
    "op7_vectors": ("embeddings", ["vec_id", "n_links", "component_id", "kept"]),
    "op8_mixing": ("documents", ["doc_id", "size", "source_size", "target", "taken"]),
    "op9_extraction": ("pages", ["page_id", "url", "text", "n_chars"]),
    "op10_quality": ("documents", ["doc_id", "held_out", "score", "predicted"]),
    "op11_alignment": ("documents", ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]),
    "op13_exact": ("documents", ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]),
}


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, name):
    assert difference(spark, connect(FOLDER), FOLDER, name, QUERIES[name], ORACLE_SQL[name]) is None


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_one_row_per_row_of_the_table(spark, name):
    table, columns = COLUMNS[name]
    found = QUERIES[name](spark, FOLDER)
    assert found.columns == columns
    assert found.count() == spark.read.parquet(f"{FOLDER}/{table}.parquet").count()


def test_whitening_has_eight_rows_a_vector(spark):
    found = QUERIES["op12_whitening"](spark, FOLDER)
    assert found.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert found.schema["deviation"].dataType.typeName() == "long"
    assert found.count() == 8 * spark.read.parquet(f"{FOLDER}/embeddings.parquet").count()


def test_names():
    assert sorted(QUERIES, key=lambda n: int(n[2:].split("_")[0])) == [
        "op1_neardup", "op2_packing", "op3_pii", "op4_secrets", "op5_archives", "op6_decontaminate", "op7_vectors", "op8_mixing", "op9_extraction", "op10_quality", "op11_alignment", "op12_whitening", "op13_exact",
    ]
