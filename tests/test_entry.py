"""Driver contract: entry() runs; a sample of queries equals its DuckDB oracle."""

import pytest

from riskfold.plans import catalog
from tests.oracle_harness import compare, duck

SMOKE = "/root/testdata/sf0.001"


def test_entry_runs(spark):
    import __spark_entry__ as e
    df = e.entry(spark)
    assert df.count() > 0
    assert {"card1_txn_count", "uid_fraud_rate", "split", "amt_bucket"} <= set(df.columns)


def test_every_query_has_an_oracle_or_is_rows_only():
    q, o = catalog.spark_queries(), catalog.oracle_queries()
    assert set(o) <= set(q)
    rows_only = set(q) - set(o)
    assert rows_only <= {"score_v1", "score_v2", "importance_table", "feature_ranking",
                         "hyper_search", "stream_scores", "training_curve"}


@pytest.mark.parametrize("key", ["enriched_features", "unseen_keys", "eval_report",
                                 "validate_output", "eda_key_profile", "v1_matrix"])
def test_oracle_sample(spark, key):
    import __spark_entry__ as e
    r = compare(spark, duck(SMOKE), SMOKE, key, e.queries()[key], e.oracle_sql()[key])
    assert r["ok"], r
