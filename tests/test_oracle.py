"""Registered queries against plain SQL in DuckDB.

By default a cross-section runs; HOLDFAST_ALL=1 runs every query.
"""

import os

import pytest
from compare import compare, duck

from holdfast.plans.queries import ORACLES, QUERIES

SF = os.environ.get("HOLDFAST_SF_DIR", "/root/testdata/sf0.01")
SOME = [
    "load_cohort", "holdout", "holdout_entity", "inner_holdout", "take_k", "prefix_sum", "scale_robust", "apply_params",
    "balance_replace", "balance_synthetic", "audit_jaccard", "audit_near_text", "audit_near", "audit_test", "check_claims", "summary", "roc_auc_orders", "figure_roc", "seed_reuse", "wilcoxon", "corrected_t", "spd",
    "evaluate_logistic", "tune_penalty", "audit_copies", "audit_all", "evaluate_run", "trace_run", "tune_features", "apply_select", "audit_complete", "audit_order", "broken_links", "fingerprint", "rerun_diff",
]


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(SF):
        pytest.skip("no test data")
    return duck(SF)


@pytest.mark.parametrize("name", sorted(ORACLES) if os.environ.get("HOLDFAST_ALL") else SOME)
def test_query_equals_sql(spark, con, name):
    assert compare(QUERIES[name](spark, SF), con, ORACLES[name]) == ""


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
