"""Operator 1: mixing sources to target weights by weighted fair queueing.

Every source is a flow with a weight. Its documents queue in a shuffled order
(by a digest of id and text, so reruns agree), first once each, then in a
second pass once more: a source offers at most ``REPEATS`` times its size. A
copy's virtual finish time is the cumulative size of its source up to its end,
divided by the source's weight. All copies are range-sorted by finish time (of
equal times the source earlier in order goes first) and served until the total
budget is spent. A source whose queue ends leaves its share to the others, so
the order itself reshares what stands above a source's limit.

The sort is over light rows (finish time, source's place, size). Ranges are
written with their number; one sum per range tells in which the budget ends,
and only that range needs a running sum. The last copy served is a cut in the
order, so each document's copies compare with it where they are and nothing is
joined back. A range of very many copies is sorted into ranges again first. Cumulative sizes are sums over (source, digest range) tables plus
a window inside each range: a source with a third of all rows is spread over
``16 ** RANGE_DIGITS`` ranges.

Rounding: the copy at which the budget ends is taken if at least half of it
fits. A source is then off its target by at most one of its own documents and
its weight's share of the documents that the other sources have begun.

Defined results: a null text has size 0; null source is one source, last in
order; documents without words are never taken; with no words at all every
target is 0. Repeated rows queue one after the other. Other columns are not
read; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, words_re

BUDGET, REPEATS = 1.5, 2
WEIGHTS = (5.0, 2.0, 1.0)
#: Hex digits of the digest that name a range: 16^3 ranges of each source.
RANGE_DIGITS = 3
#: Copies of one range of the global order, and ranges of one sort: where more copies
#: would stand in a range, that in which the budget ends is sorted into ranges again.
RANGE_COPIES, RANGES = 20_000, 4_096


def source_targets(sizes: DataFrame, budget: float = BUDGET, repeats: int = REPEATS,
                   weights: tuple = WEIGHTS) -> DataFrame:
    """Targets of a table (source, source_size), one row per source: weights
    repeat along the sources' code-point order (``flow``), null last."""
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    every = Window.partitionBy(F.lit(0))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]),
                     ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    t = (sizes.withColumn("weight", w).withColumn("flow", F.row_number().over(by_name))
         .withColumn("cap", F.lit(float(repeats)) * F.col("source_size"))
         .withColumn("budget", F.lit(budget) * F.sum("source_size").over(every)))
    # sources in the order in which their queues end: at virtual time cap / weight
    ends = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source").cast("binary"))
    before = ends.rowsBetween(Window.unboundedPreceding, -1)
    after = ends.rowsBetween(0, Window.unboundedFollowing)
    t = (t.withColumn("spent", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
         .withColumn("open", F.sum("weight").over(after))
         .withColumn("v", (F.col("budget") - F.col("spent")) / F.col("open")))
    # the cut time: the first v at which the source in turn is not yet empty
    t = t.withColumn("place", F.row_number().over(ends))
    fits = F.when(F.col("v") <= F.col("cap") / F.col("weight"), F.struct("place", "v"))
    return (t.withColumn("cut", F.min(fits).over(every).getField("v"))
            .select("source", "flow", "weight", "source_size",
                    F.when(F.col("cut").isNull(), F.col("cap"))
                    .otherwise(F.least(F.col("cap"), F.col("weight") * F.col("cut"))).alias("target")))


def budget_cut(copies: DataFrame, budget: float) -> tuple[float, int] | None:
    """The last copy served, as its place (finish, flow) in the global order of
    ``copies`` (finish, flow, size); None if none is. The places are unique."""
    part = materialize(copies, "op1-copies")
    n, spent, last = part.count(), 0, None
    place = F.struct("finish", "flow")
    served = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    while True:
        ranges = min(RANGES, n // RANGE_COPIES + 1)
        ordered = materialize(part.repartitionByRange(ranges, "finish", "flow")
                              .withColumn("range", F.spark_partition_id()), "op1-order")
        # one row per range, at most RANGES
        totals = ordered.groupBy("range").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("range_size"),
                                              F.max(place).alias("end"))
        totals = (totals.withColumn("before", F.coalesce(F.sum("range_size").over(served), F.lit(0).cast("long")) + spent)
                  .withColumn("previous", F.lag("end").over(Window.orderBy("range"))))
        at = totals.filter(F.col("before") < budget).orderBy(F.col("range").desc()).first()
        if at is None:
            return None
        last = at["previous"] or last
        part = ordered.filter(F.col("range") == at["range"]).drop("range")
        n, spent = at["n"], at["before"]
        if ranges == 1 or n <= 2 * RANGE_COPIES:
            break
    upto = F.sum("size").over(Window.orderBy("finish", "flow").rowsBetween(Window.unboundedPreceding, 0)) + spent
    fits = part.withColumn("upto", upto).filter(F.col("upto") - F.col("size") / 2 <= budget)
    last = fits.agg(F.max(place).alias("last")).first()["last"] or last
    return None if last is None else (last["finish"], last["flow"])


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                source_col: str = "source", carry: bool = False) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies, finish (the virtual
    finish time of the first copy). With ``carry`` a struct ``row`` of all
    columns of ``docs`` follows."""
    text = F.col(f"`{text_col}`").cast("string")
    rows = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source_col}`").alias("source"),
        F.coalesce(F.regexp_count(text, F.lit(words_re)).cast("long"), F.lit(0).cast("long")).alias("size"),
        F.md5(F.concat(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")), F.lit("|"),
                       F.md5(F.coalesce(text, F.lit("")).cast("binary"))).cast("binary")).alias("turn"),
        *([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else []))
    light = materialize(rows.drop("row"), "op1-sizes")
    in_range = F.substring("turn", 1, RANGE_DIGITS)
    sums = light.groupBy("source", in_range.alias("range")).agg(F.sum("size").alias("range_size"))
    sums = materialize(sums, "op1-ranges")
    targets = materialize(source_targets(sums.groupBy("source").agg(F.sum("range_size").alias("source_size"))),
                          "op1-targets")
    # offsets of the ranges inside their source: at most 16^RANGE_DIGITS rows a source
    along = (Window.partitionBy("source").orderBy("range")
             .rowsBetween(Window.unboundedPreceding, -1))
    offsets = (sums.withColumn("offset", F.coalesce(F.sum("range_size").over(along), F.lit(0).cast("long")))
               .select(F.col("source").alias("s"), F.col("range").alias("r"), "offset"))
    flows = targets.select(F.col("source").alias("s"), "flow", "weight", "source_size", "target")
    inside = (Window.partitionBy("source", "range").orderBy("turn", "doc_id")
              .rowsBetween(Window.unboundedPreceding, 0))

    def queue(rows: DataFrame) -> DataFrame:
        """The rows with ``finishes``, the virtual finish time of each copy."""
        rows = rows.withColumn("range", in_range).withColumn("upto", F.sum("size").over(inside))
        rows = rows.join(offsets, F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("r"))).drop("s", "r")
        rows = rows.join(flows, F.col("source").eqNullSafe(F.col("s"))).drop("s")
        end = F.col("offset") + F.col("upto")
        return rows.withColumn("finishes", F.array(*[(end + F.lit(k) * F.col("source_size")) / F.col("weight")
                                                     for k in range(REPEATS)]))

    copies = queue(light).filter("size > 0").select(F.explode("finishes").alias("finish"), "flow", "size")
    total = targets.agg(F.sum("source_size")).first()[0]
    cut = budget_cut(copies, BUDGET * total) if total else None
    if cut is None:
        taken = F.lit(0).cast("long")
    else:
        finish, flow = cut
        taken = F.size(F.filter("finishes", lambda f: (f < finish) | ((f == finish) & (F.col("flow") <= flow))))
        taken = F.when(F.col("size") > 0, taken.cast("long")).otherwise(F.lit(0).cast("long"))
    return queue(rows if carry else light).withColumn("copies", taken).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies",
        F.get("finishes", F.lit(0)).alias("finish"), *(["row"] if carry else []))


def mixed_documents(docs: DataFrame, **cols) -> DataFrame:
    """The mix itself: every document as often as it is taken."""
    m = mix_sources(docs, carry=True, **cols)
    return (m.filter("copies > 0")
            .select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
            .select("row.*"))


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, ''))) AS turn
  FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, list_extract([5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE], CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS BIGINT)) AS weight,
         row_number() OVER (ORDER BY source NULLS LAST) AS flow, 2.0::DOUBLE * source_size AS cap, 1.5::DOUBLE * sum(source_size) OVER () AS budget FROM s0),
s2 AS (SELECT *, CAST(budget - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
         / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS v,
         row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS place FROM s1),
s3 AS (SELECT source, flow, weight, source_size, cap,
         arg_min(v, CASE WHEN v <= cap / weight THEN place END) OVER () AS cut FROM s2),
t AS (SELECT source, flow, weight, source_size,
        CASE WHEN cut IS NULL THEN cap ELSE least(cap, weight * cut) END AS target FROM s3),
q AS (SELECT d.*, flow, weight, source_size, target,
        sum(size) OVER (PARTITION BY d.source ORDER BY turn, doc_id, r ROWS UNBOUNDED PRECEDING) AS upto
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT r, size, flow, (upto + k * source_size) / weight AS f FROM q, (VALUES (0), (1)) AS n(k) WHERE size > 0),
o AS (SELECT r, size, sum(size) OVER (ORDER BY f, flow ROWS UNBOUNDED PRECEDING) AS served FROM c),
x AS (SELECT r, count(*) AS copies FROM o WHERE served - size / 2 <= 1.5::DOUBLE * (SELECT sum(size) FROM d) GROUP BY r)
SELECT doc_id, size, source_size, target, size * coalesce(copies, 0) AS taken,
       CAST(coalesce(copies, 0) AS BIGINT) AS copies, upto / weight AS finish
FROM q LEFT JOIN x ON q.r = x.r
"""
