"""Operators that SQL calls by name, as table functions with typed parameters and defaults.

``register`` puts the frames of a graph under ``ledgerloom_*`` views and the functions beside them, for the session:

    SELECT * FROM account_edges(min_weight => 3);
    SELECT * FROM split_members('val')

A call becomes part of the caller's plan, so filters and column pruning reach through it. Functions whose frames are
not given are not there.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.operators.identity import WEIGHTS

# A parameter is known in the outermost query of a function only, so inner ones carry what it is compared with.
_EDGES = """SELECT least(src, dst) AS a, greatest(src, dst) AS b, sum(txn_count) AS weight FROM ledgerloom_flows WHERE src <> dst
  GROUP BY least(src, dst), greatest(src, dst)"""
_PII = "SELECT DISTINCT party, kind, value FROM ledgerloom_pii"
_BANDED = f"SELECT party, kind, value, deg FROM ({_PII}) JOIN (SELECT kind, value, count(1) AS deg FROM ({_PII}) GROUP BY kind, value) USING (kind, value)"

#: name -> (frames it reads, parameters, result, query)
FUNCTIONS: dict[str, tuple[tuple[str, ...], str, str, str]] = {
    "account_edges": (
        ("flows",), "min_weight BIGINT DEFAULT 1", "a BIGINT, b BIGINT, weight BIGINT", f"SELECT a, b, weight FROM ({_EDGES}) WHERE weight >= min_weight"),
    "account_degrees": (
        ("flows",), "min_weight BIGINT DEFAULT 1", "id BIGINT, degree BIGINT",
        f"SELECT id, count(1) AS degree FROM (SELECT explode(array(a, b)) AS id, weight FROM ({_EDGES})) WHERE weight >= min_weight GROUP BY id"),
    "vertices_between": (
        ("accounts",), "cursor BIGINT DEFAULT NULL, last BIGINT DEFAULT NULL", "id BIGINT",
        "SELECT id FROM ledgerloom_accounts WHERE (cursor IS NULL OR id > cursor) AND (last IS NULL OR id <= last)"),
    "split_members": (
        ("splits",), "name STRING DEFAULT 'train'", "id BIGINT",
        """SELECT id FROM ledgerloom_splits WHERE split = CASE name WHEN 'train' THEN 0 WHEN 'val' THEN 1 WHEN 'test' THEN 2
        ELSE CAST(raise_error('a split is train, val or test') AS INT) END"""),
    "party_candidates": (
        ("pii",), "candidate_degree BIGINT DEFAULT 100", "a BIGINT, b BIGINT",
        f"""SELECT DISTINCT x.party AS a, y.party AS b FROM ({_BANDED}) x JOIN ({_BANDED}) y ON x.kind = y.kind AND x.value = y.value AND x.party < y.party
        WHERE x.deg > 1 AND x.deg < candidate_degree"""),
    "pair_weight": (
        (), "kind STRING", "weight DECIMAL(4,2)",
        f"SELECT CAST(CASE kind {' '.join(f'WHEN {k!r} THEN {Decimal(v)}' for k, v in WEIGHTS.items())} ELSE 0 END AS DECIMAL(4,2)) AS weight"),
}


def register(spark: SparkSession, **frames: DataFrame) -> list[str]:
    """Names of the functions that SQL of this session can call now; frames by the names that FUNCTIONS reads."""
    for name, d in frames.items():
        d.createOrReplaceTempView(f"ledgerloom_{name}")
    done = []
    for name, (reads, parameters, result, query) in FUNCTIONS.items():
        if set(reads) <= set(frames):
            spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS TABLE({result}) RETURN {query}")
            done.append(name)
    return done
