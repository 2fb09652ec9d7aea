"""O1 build_base: merge -> high-null drop -> dedupe -> dtype repair -> split."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame

from ..config import BaseConfig
from ..operators import base as ops
from ..session import materialize
from ..sources.bucketed import save_bucketed

log = logging.getLogger(__name__)


def build_base(txn: DataFrame, identity: DataFrame,
               cfg: BaseConfig = BaseConfig(), with_plan: bool = False):
    """One DataFrame with a ``split`` column (train/val/test).

    The merge runs once and is written bucketed by id; inputs that are bucketed
    by id already (``sources.bucketed``) are merged without an exchange. Two schema
    decisions need data (null shares, parse shares) and the split needs its cut
    keys: the null shares are one pass over the merged table, and equal rows share
    an id, so duplicates go inside their bucket, without a shuffle. The other
    passes read the columns they need of the deduplicated table. Every table is
    written to the shared checkpoint folder, so a lost executor costs only its
    running tasks, and the intermediate ones are deleted at the end. The result is
    partitioned by ``split``: split filters become partition pruning.
    """
    merged = save_bucketed(ops.merge_identity(txn, identity, cfg.id_col), cfg.id_col, "merged")
    try:
        protect = (cfg.id_col, cfg.time_col, cfg.target)
        dropped = ops.high_null_columns(merged.read(), cfg.null_threshold, protect)
        if dropped:
            log.info("dropping high-null columns: %s", dropped)
        distinct = save_bucketed(ops.drop_duplicates(merged.read().drop(*dropped)), cfg.id_col, "distinct")
    finally:
        merged.drop()
    try:
        deduped = distinct.read()
        numeric = ops.numeric_like_columns(deduped, cfg.numeric_threshold)
        fixed = ops.fix_dtypes(deduped, cfg.numeric_threshold, numeric)
        cuts = ops.split_cuts(fixed, cfg.time_col, cfg.id_col, cfg.ratios)
        # partitioned by split: split filters prune partitions and later scans
        # read only the columns they use
        base = materialize(ops.assign_split(fixed, cuts, cfg.time_col, cfg.id_col), "base",
                           partition_by="split")
    finally:
        distinct.drop()
    if with_plan:
        # the data-dependent decisions, replayable on new rows (streams)
        return base, BasePlan(dropped, numeric, cuts, cfg)
    return base


class BasePlan:
    """Decisions the base build took from data: dropped columns, columns
    coerced to numbers, split cut keys."""

    def __init__(self, dropped, numeric, cuts, cfg):
        self.dropped, self.numeric, self.cuts, self.cfg = dropped, numeric, cuts, cfg

    def replay(self, txn: DataFrame, identity: DataFrame) -> DataFrame:
        """Apply the same decisions to new rows (no action)."""
        return self.finish(ops.drop_duplicates(ops.merge_identity(txn, identity, self.cfg.id_col)))

    def finish(self, merged: DataFrame) -> DataFrame:
        """The decisions after merge and deduplication, row by row (stream-safe)."""
        merged = merged.drop(*self.dropped)
        if self.numeric:
            merged = merged.withColumns({c: ops.as_number(c) for c in self.numeric})
        return ops.assign_split(merged, self.cuts, self.cfg.time_col, self.cfg.id_col)
