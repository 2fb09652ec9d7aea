"""All registered queries: key -> (spark_fn, oracle_sql | None, round_cols)."""

from __future__ import annotations



def registry() -> dict:
    from . import catalog_core, catalog_eda, catalog_metrics, catalog_ml, catalog_prep
    out = dict(catalog_core.Q)
    for m in (catalog_prep, catalog_metrics, catalog_eda, catalog_ml):
        out.update(m.Q)
    return out


def _rounded_spark(fn, cols):
    from pyspark.sql import functions as F

    def run(spark, sf_dir):
        df = fn(spark, sf_dir)
        if cols:
            # floor(x * 1e6 + 0.5) / 1e6: the same IEEE steps in both engines
            df = df.withColumns({c: (F.floor(F.col(c) * F.lit(1e6) + F.lit(0.5))
                                     .cast("double") / F.lit(1e6)) for c in cols})
        return df
    return run


def _rounded_sql(sql: str, cols) -> str:
    if not cols:
        return sql
    from ..sources.fixtures import BODY_MARK
    # the statement starts with a WITH prefix; wrap only its final query
    head, sep, tail = sql.rpartition(BODY_MARK)
    if not sep:
        raise ValueError("oracle SQL must be built on duckdb_prefix()")
    rep = ", ".join(f"CAST(floor({c} * 1e6 + 0.5) AS DOUBLE) / 1e6 AS {c}" for c in cols)
    return f"{head}{sep}SELECT * REPLACE ({rep}) FROM ({tail}) _q"


def spark_queries() -> dict:
    return {k: _rounded_spark(fn, cols) for k, (fn, _, cols) in registry().items()}


def oracle_queries() -> dict:
    return {k: _rounded_sql(sql, cols) for k, (_, sql, cols) in registry().items()
            if sql is not None}
