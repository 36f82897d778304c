"""Registered queries against DuckDB at the smallest scale.

One query per family by default; LOANWATCH_ALL=1 runs every query.
"""
import os

import pytest
from oracle_check import compare, duck

from loanwatch.plans import load_queries

SF = "/root/testdata/sf0.001"
CORE = ("A9_snapshot_store", "B1_contract_conformance", "C_all_rules", "D1_loan_grain", "E7_walk_forward_folds",
        "F7_preprocess_pipeline", "G4_ordinal_combination", "I2_cost_decision", "J3_full_scoring", "K2_ranking_at_k",
        "L6_metrics_by_category", "M10_matured_metrics", "M18_drift", "N8_cramers_v", "O2_woe", "P4_skim",
        "R2_trends", "S1_profile")
QUERIES = load_queries()
NAMES = [n for n, q in QUERIES.items() if q.sql] if os.environ.get("LOANWATCH_ALL") else CORE


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    assert compare(QUERIES[name].run(spark, SF), con, QUERIES[name].sql) == []


def test_entry_and_registry():
    import __spark_entry__ as e
    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 150
    for q in QUERIES.values():
        names = [c for c, _ in q.columns]
        assert len(names) == len(set(names))
