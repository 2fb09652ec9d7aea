"""Run registered queries against their DuckDB oracles (like the driver).

    python tests/oracle_harness.py [sf_dir] [key ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations"]


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6)
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def _same(a, b, tol=1.5e-6):
    """Rows equal, floats within one unit of the 6th decimal (a double
    computed in a different summation order can straddle a rounding tie)."""
    for x, y in zip(a, b):
        if isinstance(x, float) and isinstance(y, float):
            if abs(x - y) > tol:
                return False
        elif x != y:
            return False
    return True


def _key(row):
    return tuple((0, "") if v is None else (1, str(v)) for v in row)


def compare(spark, con, sf_dir, key, fn, sql):
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    s_cols = sdf.columns
    s_rows = [tuple(r) for r in sdf.collect()]
    t_spark = time.time() - t0
    if sql is None:
        return dict(key=key, ok=None, rows=len(s_rows), spark_s=round(t_spark, 2))
    rel = con.sql(sql)
    d_cols = rel.columns
    d_rows = rel.fetchall()
    msgs = []
    if sorted(s_cols) != sorted(d_cols):
        msgs.append(f"columns differ: spark={sorted(s_cols)} duck={sorted(d_cols)}")
        return dict(key=key, ok=False, msg="; ".join(msgs), spark_s=round(t_spark, 2))
    order = sorted(s_cols)
    si = [s_cols.index(c) for c in order]
    di = [d_cols.index(c) for c in order]
    sa = sorted((tuple(_norm(r[i]) for i in si) for r in s_rows), key=_key)
    da = sorted((tuple(_norm(r[i]) for i in di) for r in d_rows), key=_key)
    if len(sa) != len(da):
        msgs.append(f"rows differ: spark={len(sa)} duck={len(da)}")
    else:
        bad = [(a, b) for a, b in zip(sa, da) if not _same(a, b)]
        if bad:
            msgs.append(f"{len(bad)} value mismatches, first: spark={bad[0][0]} duck={bad[0][1]} cols={order}")
    dtypes = dict(zip(d_cols, [str(t) for t in rel.dtypes]))
    stypes = {f.name: f.dataType.simpleString() for f in sdf.schema.fields}
    tmap = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
            "boolean": "BOOLEAN", "float": "FLOAT", "smallint": "SMALLINT", "date": "DATE",
            "timestamp_ntz": "TIMESTAMP", "tinyint": "TINYINT"}
    tdiff = [(c, stypes[c], dtypes[c]) for c in order if tmap.get(stypes[c], stypes[c]) != dtypes[c]]
    if tdiff:
        msgs.append(f"types differ: {tdiff}")
    return dict(key=key, ok=not msgs, msg="; ".join(msgs), rows=len(sa), spark_s=round(t_spark, 2))


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 and argv[1].startswith("/") else "/root/testdata/sf0.01"
    keys = [a for a in argv[1:] if not a.startswith("/")]
    from riskfold.session import local_session
    import __spark_entry__ as entry
    spark = local_session()
    con = duck(sf_dir)
    qs, os_ = entry.queries(), entry.oracle_sql()
    keys = keys or list(qs)
    bad = 0
    for k in keys:
        try:
            r = compare(spark, con, sf_dir, k, qs[k], os_.get(k))
        except Exception as e:  # report and continue
            r = dict(key=k, ok=False, msg=f"{type(e).__name__}: {str(e)[:400]}")
        if r.get("ok") is False:
            bad += 1
        print(r, flush=True)
    print(f"FAILED {bad} of {len(keys)}")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
