"""Every registered query against its SQL restatement on the smallest tables."""

import pytest
from compare import connect, difference

from driftlens.plans.oracle import ORACLE
from driftlens.plans.registry import REGISTRY

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, duck, name):
    assert difference(spark, duck, FOLDER, name, REGISTRY[name], ORACLE[name]) is None


def test_sql_exists_for_registered_queries_only():
    assert set(ORACLE) <= set(REGISTRY)
    assert set(REGISTRY) - set(ORACLE) == {"rate_limit", "findings_digest"}


def test_entry_point(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0


def test_encoded_urls_of_any_length(spark, tmp_path):
    """Base64 of more than 76 characters is one literal too."""
    urls = [f"https://a.example/{'x' * n}" for n in (10, 38, 39, 40, 41, 200)]
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    found = {(r.page_id, r.found, r.encoding) for r in REGISTRY["encoded_urls"](spark, str(tmp_path)).collect()}
    assert found == {(i, u, e) for i, u in enumerate(urls) for e in ("base64", "hex")}
