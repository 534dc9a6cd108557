"""Operators called from SQL, with parameters other than the defaults, against their Python form."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import tables
from ledgerloom.operators import export, flow, identity, masking
from ledgerloom.sources import fixtures as fx


def same(got, want):
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() > 0


@pytest.fixture(scope="module")
def frames(spark):
    sf = "/root/testdata/sf0.01"
    accounts = fx.accounts(spark, sf)
    found = {"flows": flow.has_paid(fx.peer_ledger(spark, sf)), "accounts": accounts, "pii": fx.party_pii(spark, sf),
             "splits": accounts.select("id", (F.col("id") % 3).cast("int").alias("split"))}
    assert set(tables.register(spark, **found)) == set(tables.FUNCTIONS)
    return found


def test_calls_equal_the_python_form(spark, frames):
    edges = flow.account_edges(frames["flows"])
    same(spark.sql("SELECT a, b, weight FROM account_edges(min_weight => 2)"), edges.where("weight >= 2").select("a", "b", "weight"))
    same(spark.sql("SELECT * FROM account_edges()"), edges.select("a", "b", "weight"))
    same(spark.sql("SELECT id FROM vertices_between(40, last => 65)"), export.in_page(frames["accounts"], 40, 65).select("id"))
    same(spark.sql("SELECT id FROM vertices_between(last => 7)"), export.in_page(frames["accounts"], None, 7).select("id"))
    same(spark.sql("SELECT * FROM party_candidates(candidate_degree => 20)"), identity.party_candidates(frames["pii"], 20))
    flagged = masking.flags(frames["splits"])
    same(spark.sql("SELECT * FROM split_members('val')"), masking.accounts_of(flagged, "val"))
    same(spark.sql("SELECT * FROM split_members()"), masking.accounts_of(flagged, "train"))
    both = edges.where("weight >= 2").select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    same(spark.sql("SELECT * FROM account_degrees(2)"), both)
    assert {r.kind: str(r.weight) for r in spark.sql("SELECT k AS kind, weight FROM VALUES ('email'), ('city'), ('x') AS t(k), LATERAL pair_weight(k)").collect()} == {
        "email": "0.50", "city": "0.10", "x": "0.00"}


def test_what_is_not_there_or_wrong_is_an_error(spark, frames):
    assert tables.register(spark) == ["pair_weight"]
    for bad in ("SELECT * FROM split_members('dev')", "SELECT * FROM account_edges(min_weight => 'many')", "SELECT * FROM account_edges(1, 2)"):
        with pytest.raises(Exception):
            spark.sql(bad).collect()


def test_filters_reach_through_a_call(spark, frames, capsys):
    spark.sql("SELECT id FROM vertices_between(3) WHERE id < 9").explain()
    plan = capsys.readouterr().out
    assert "PushedFilters" in plan and "GreaterThan(user_id,3)" in plan and "LessThan(user_id,9)" in plan
