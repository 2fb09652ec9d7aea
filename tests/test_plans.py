"""Scale properties of the physical plans, locked in as tests."""

import contextlib
import io
from dataclasses import replace

from pyspark.sql import functions as F

from riskfold.plans import features_job as fj
from riskfold.plans.fixture import Fixture

SMOKE = "/root/testdata/sf0.001"
FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython",
             "ArrowEvalPython")


def _plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="formatted")
    return buf.getvalue()


def test_fit_scan_is_pruned(spark):
    fx = Fixture(spark, SMOKE)
    plan = _plan(fj.fit_card(fx.base.where(F.col("split") == "train"), fx.params.cfg))
    assert "PartitionFilters: [isnotnull(split" in plan and "(split" in plan
    read = [ln for ln in plan.splitlines() if ln.startswith("ReadSchema")][0]
    assert read == "ReadSchema: struct<TransactionAmt:double,card1:bigint,DeviceInfo:string>"


def test_apply_plans(spark):
    fx = Fixture(spark, SMOKE)
    direct = _plan(fx.enriched)
    assert not any(f in direct for f in FORBIDDEN)
    assert "SortMergeJoin" not in direct            # every lookup broadcast at this size
    combo = _plan(fj.apply(fx.base, replace(fx.params, broadcast_limit=0)))
    assert not any(f in combo for f in FORBIDDEN)
    # the fact table is joined once: the only full-width scan feeds one join
    wide = [ln for ln in combo.splitlines() if ln.startswith("ReadSchema")
            and "TransactionDT" in ln and "id_01" in ln]
    assert len(wide) == 1


def test_metric_plans_have_no_single_task_window(spark):
    from riskfold.operators import metrics as M
    fx = Fixture(spark, SMOKE)
    plan = _plan(M.score_groups(fx.scores))
    assert plan.count("Window") >= 1
    # the running-sum window is partitioned by the range column
    assert "hashpartitioning(_rng" in plan
