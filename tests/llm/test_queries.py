import pytest
from oracle import agrees

from atomloom.llm.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_sql(spark, name):
    agrees(spark, SF, QUERIES[name], ORACLES[name])


def test_links_by_brute_force(spark):
    from test_cases import components_by_brute_force

    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in QUERIES["op9_jaccard_join"](spark, SF).collect()}
    assert got == components_by_brute_force(rows, 4, 85)
