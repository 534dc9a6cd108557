import pytest

from ledgerloom import catalog
from tests.sqlcheck import assert_same

SOME = ["flow_agg", "money_flow", "temporal_features", "identity_sharing", "party_matches", "wcc", "triangles_capped", "khop_gated", "epoch_batches", "split_accounts", "edge_bin_features", "gains_table", "ranking_metrics"]


@pytest.mark.parametrize("name", SOME)
def test_query_equals_its_sql(spark, sf_dir, name):
    assert_same(spark, sf_dir, catalog.QUERIES[name], catalog.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(SOME)))
def test_other_queries_equal_their_sql(spark, name):
    """On the smallest tables."""
    assert_same(spark, "/root/testdata/sf0.001", catalog.QUERIES[name], catalog.ORACLES[name])
