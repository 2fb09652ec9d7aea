"""Transactions / identity views derived from the driver's ``events`` table.

The reference works on two tables (transactions, identity) that the test data
does not contain; the views below derive them from ``events`` so that every
query reads the given tables and grows with them. The view text is one
template rendered for Spark SQL (engine side) and for DuckDB (oracle side),
so that the two cannot drift; only the seconds expression differs.

The ``% n`` rules below *derive* column values (NULL patterns, a label)
inside CASE expressions; no rule subsets rows to make checks cheaper. The
identity table holds a record for the transactions whose event property
``k`` is at least 75 (about a quarter), as the reference's identity table
covers a minority of transactions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# The derivation rules of the fixture (see FIXTURES.md §3).
_EV = """SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k
FROM {events}"""

_TXN = """SELECT event_id AS TransactionID,
  {seconds} AS TransactionDT,
  CASE WHEN event_id % 97 = 0 THEN NULL ELSE value END AS TransactionAmt,
  CASE WHEN event_id % 50 = 0 THEN 100000 + event_id ELSE user_id END AS card1,
  CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_type END AS P_emaildomain,
  CASE WHEN event_id % 9 = 0 THEN NULL
       ELSE CAST((user_id * 37 + k * 11) % 2500 AS DOUBLE) END AS addr1,
  CASE WHEN (event_id * 31 + user_id * 17) % 100
            < (CASE WHEN k >= 80 THEN 10 ELSE 2 END) THEN 1 ELSE 0 END AS isFraud,
  k{extra}
FROM ({ev}) ev"""

_IDT = """SELECT event_id AS TransactionID, CAST(k AS DOUBLE) AS id_01,
  CASE WHEN event_id % 12 = 0 THEN NULL ELSE CAST(k % 10 AS DOUBLE) END AS id_13,
  CASE WHEN event_id % 16 = 0 THEN NULL ELSE 'Found' END AS id_16,
  CASE WHEN event_id % 8 = 0 THEN CAST(1.0 AS DOUBLE) ELSE NULL END AS id_25,
  concat('dev-', CAST(k AS STRING)) AS DeviceInfo{extra}
FROM ({ev}) ev
WHERE k >= 75"""

SPARK_SECONDS = ("86400 + timestampdiff(SECOND, "
                 "TIMESTAMP_NTZ '2024-01-01 00:00:00', ts)")
DUCKDB_SECONDS = "86400 + CAST(floor(epoch(ts)) AS BIGINT) - 1704067200"

# columns of the merged table, and of the base table after the high-null drop
MERGED_COLUMNS = ["TransactionID", "TransactionDT", "TransactionAmt", "card1",
                  "P_emaildomain", "addr1", "isFraud", "k", "id_01", "id_13",
                  "id_16", "id_25", "DeviceInfo"]
BASE_COLUMNS = [c for c in MERGED_COLUMNS if c != "id_25"]

# score table for the metric queries: ties guaranteed, val split only
_SCORES = """SELECT TransactionID AS id, isFraud AS y,
  CAST(floor(((TransactionID * 13 + k * 7) % 100) * 0.7 + isFraud * 25) AS BIGINT)
    / CAST(100 AS DOUBLE) AS p
FROM {splits} WHERE split = 'val'"""


def _render(template: str, events: str, seconds: str, extra: str = "") -> str:
    ev = _EV.format(events=events)
    return template.format(ev=ev, seconds=seconds, extra=extra)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read_table(spark, sf_dir, "events")
    return spark.sql(_render(_TXN, "{events}", SPARK_SECONDS), events=events)


def identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read_table(spark, sf_dir, "events")
    return spark.sql(_render(_IDT, "{events}", SPARK_SECONDS), events=events)


def scores_from_splits(spark: SparkSession, splits: DataFrame) -> DataFrame:
    return spark.sql(_SCORES.format(splits="{splits}"), splits=splits)


def duckdb_prefix(extra: str = "") -> str:
    """``WITH`` prefix defining ev/txn/idt/merged/base/train/scores in DuckDB.

    ``base`` is the oracle form of the time split: a global row_number over
    (TransactionDT, TransactionID), cut at floor(n*0.70) and floor(n*0.85).
    """
    txn = _render(_TXN, "events", DUCKDB_SECONDS)
    idt = _render(_IDT, "events", DUCKDB_SECONDS)
    cols = ", ".join(BASE_COLUMNS)
    ctes = [
        f"txn AS ({txn})",
        f"idt AS ({idt})",
        "merged AS (SELECT * FROM txn LEFT JOIN idt USING (TransactionID))",
        "ranked AS (SELECT *, row_number() OVER (ORDER BY TransactionDT, "
        "TransactionID) AS _rn, count(*) OVER () AS _n FROM merged)",
        f"base AS (SELECT {cols}, CASE WHEN _rn <= floor(_n * 0.70) THEN 'train' "
        "WHEN _rn <= floor(_n * 0.85) THEN 'val' ELSE 'test' END AS split "
        "FROM ranked)",
        "train AS (SELECT * FROM base WHERE split = 'train')",
        f"scores AS ({_SCORES.format(splits='base')})",
    ]
    if extra:
        ctes.append(extra)
    return "WITH " + ",\n".join(ctes) + "\n" + BODY_MARK


# the final statement of an oracle follows this line
BODY_MARK = "-- result\n"
