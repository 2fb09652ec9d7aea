"""Operator 6: exact dedup with counting quotient filters.

Every text has a 64-bit fingerprint. Each input partition builds counting
quotient filters over its fingerprints: the top bits name a block, the next
``QUOTIENT_BITS`` a home slot, and the rest is the remainder, kept in sorted
runs with a counter. Filters of one block hold the same fingerprint ranges, so
they merge without loss: their (quotient, remainder) entries are merged in
sorted order and the counters add up. Only fingerprints whose merged count is
above one can have copies; their rows go to byte verification, which groups on
the text itself (map-side combined, so a group with a third of all rows
shuffles one row per task).

Defined results: a null text counts as empty; empty texts are one group; of
rows with equal text the largest doc_id stays (null ids are smallest). Rows
that repeat both doc_id and text carry the same values, each counts in
group_size, and ``exact_survivors`` leaves one of them. An empty table gives no
rows. Other columns are ignored by ``exact_groups`` and carried by
``exact_survivors``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, ship_code, text_of

QUOTIENT_BITS = 12
#: Expected fingerprints in one merged block.
BLOCK_ROWS = 1 << 16
#: Fingerprints that a task holds before it writes out a filter.
FLUSH_ROWS = 1 << 21


def encode_block(quotients: np.ndarray, remainders: np.ndarray, counts: np.ndarray) -> bytes:
    """One filter block: occupied bits by quotient, run-end bits by slot, and
    the slots' remainders and counters, in sorted order."""
    occupied = np.zeros(1 << QUOTIENT_BITS, bool)
    occupied[quotients] = True
    runend = np.ones(len(quotients), bool)
    runend[:-1] = quotients[1:] != quotients[:-1]
    return b"".join([np.int64(len(quotients)).tobytes(), np.packbits(occupied).tobytes(),
                     np.packbits(runend).tobytes(), remainders.astype("<u8").tobytes(),
                     counts.astype("<i8").tobytes()])


def decode_block(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(quotients, remainders, counts) of a block, in sorted order."""
    n = int(np.frombuffer(data, "<i8", 1)[0])
    at, nq = 8, 1 << QUOTIENT_BITS
    occupied = np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8, nq // 8, at)))
    at += nq // 8
    runend = np.unpackbits(np.frombuffer(data, np.uint8, (n + 7) // 8, at))[:n]
    at += (n + 7) // 8
    run = np.concatenate([[0], np.cumsum(runend[:-1], dtype=np.int64)]) if n else np.zeros(0, np.int64)
    return (occupied[run] if n else run, np.frombuffer(data, "<u8", n, at),
            np.frombuffer(data, "<i8", n, at + 8 * n))


def build_blocks(fingerprints: np.ndarray, block_bits: int) -> Iterator[tuple[int, bytes]]:
    """Counting quotient filter blocks over 64-bit fingerprints."""
    values, counts = np.unique(fingerprints.view(np.uint64), return_counts=True)
    rest = 64 - block_bits
    blocks = (values >> np.uint64(rest)).astype(np.int64) if block_bits else np.zeros(len(values), np.int64)
    cuts = np.flatnonzero(np.diff(blocks)) + 1
    for a, b in zip([0, *cuts], [*cuts, len(values)]):
        if b > a:
            v = values[a:b]
            q = (v >> np.uint64(rest - QUOTIENT_BITS)) & np.uint64((1 << QUOTIENT_BITS) - 1)
            r = v & np.uint64((1 << (rest - QUOTIENT_BITS)) - 1)
            yield int(blocks[a]), encode_block(q.astype(np.int64), r, counts[a:b])


def merge_blocks(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The lossless merge: entries in sorted order, counters of equal ones added."""
    dec = [decode_block(p) for p in parts]
    q = np.concatenate([d[0] for d in dec]).astype(np.uint64)
    r = np.concatenate([d[1] for d in dec])
    c = np.concatenate([d[2] for d in dec])
    order = np.lexsort((r, q))
    q, r, c = q[order], r[order], c[order]
    first = np.ones(len(q), bool)
    first[1:] = (q[1:] != q[:-1]) | (r[1:] != r[:-1])
    at = np.flatnonzero(first)
    return q[at], r[at], np.add.reduceat(c, at) if len(at) else c


def repeated_fingerprints(fps: DataFrame, n_rows: int) -> DataFrame:
    """Fingerprints (column ``fp``) that occur more than once, with counts."""
    bits = min(40, max(3, math.ceil(math.log2(max(1, n_rows / BLOCK_ROWS)))))

    def build(batches):
        held, size = [], 0

        def flush():
            ids, data = zip(*build_blocks(np.concatenate(held), bits))
            return pa.record_batch([pa.array(ids, pa.int64()), pa.array(data, pa.binary())],
                                   names=["block", "filter"])

        for b in batches:
            held.append(b.column(0).to_numpy(zero_copy_only=False))
            size += len(held[-1])
            if size >= FLUSH_ROWS:
                yield flush()
                held, size = [], 0
        if size:
            yield flush()

    def merge(block: pa.Table) -> pa.Table:
        b = block.column("block")[0].as_py()
        q, r, c = merge_blocks(block.column("filter").to_pylist())
        rest = 64 - bits
        v = (np.uint64(b) << np.uint64(rest)) if bits else np.uint64(0)
        v = v | (q << np.uint64(rest - QUOTIENT_BITS)) | r
        more = c > 1
        return pa.table({"fp": pa.array(v[more].view(np.int64)), "copies": pa.array(c[more])})

    return (fps.mapInArrow(build, "block long, filter binary")
            .groupBy("block").applyInArrow(merge, "fp long, copies long"))


def _candidates(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The repeated fingerprints, written once."""
    ship_code(docs.sparkSession)
    fps = docs.select(F.xxhash64(text_of(text_col)).alias("fp"))
    return materialize(repeated_fingerprints(fps, docs.count()), "op6-repeated")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    dup = _candidates(docs, id_col, text_col).select("fp")
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    fp = F.xxhash64("text")
    verified = (rows.withColumn("fp", fp)
                .join(dup.hint("shuffle_hash"), "fp", "left_semi")
                .groupBy("text").agg(F.max("doc_id").alias("keep_id"),
                                     F.count(F.lit(1)).alias("group_size"))
                .filter("group_size > 1")
                .select(F.sha2("text", 256).alias("text_sha256"), "keep_id", "group_size"))
    verified = materialize(verified, "op6-groups")
    light = rows.select("doc_id", F.sha2("text", 256).alias("text_sha256"))
    return (light.join(verified, "text_sha256", "left")
            .select("doc_id",
                    F.when(F.col("group_size").isNull(), F.col("doc_id"))
                    .otherwise(F.col("keep_id")).alias("keep_id"),
                    F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
                    "text_sha256")
            .select("doc_id", "keep_id", "group_size",
                    F.expr("doc_id <=> keep_id").alias("kept"), "text_sha256"))


def exact_survivors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all columns of ``docs``; null texts stay null
    unless a group of equal (null or empty) texts keeps another row."""
    dup = _candidates(docs, id_col, text_col).select(F.col("fp").alias("_op6_dup"))
    cols = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("_op6_row"),
                       F.xxhash64(text_of(text_col)).alias("_op6_fp"))
    joined = rows.join(dup.hint("shuffle_hash"), F.col("_op6_fp") == F.col("_op6_dup"), "left")
    single = joined.filter("_op6_dup is null").select("_op6_row.*")
    # of a group the row with the largest doc_id; the other columns break ties
    rest = [c for c in cols if c != id_col and c != text_col]
    groups = (joined.filter("_op6_dup is not null")
              .groupBy(F.coalesce(F.col(f"_op6_row.`{text_col}`"), F.lit("")).alias("_op6_text"))
              .agg(F.max(F.struct(F.col(f"_op6_row.`{id_col}`").alias("i"),
                                  F.col(f"_op6_row.`{text_col}`").isNotNull().alias("t"),
                                  *[F.col(f"_op6_row.`{c}`").alias(f"c{k}") for k, c in enumerate(rest)]))
                   .alias("_op6_best")))
    back = {id_col: F.col("_op6_best.i"),
            text_col: F.when(F.col("_op6_best.t"), F.col("_op6_text"))}
    back |= {c: F.col(f"_op6_best.c{k}") for k, c in enumerate(rest)}
    return single.unionByName(groups.select(*[back[c].alias(c) for c in cols]))
