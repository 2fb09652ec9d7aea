"""Operator 4: sharding by a consistent-hash ring with virtual nodes and
bounded loads.

The ring has ``CELLS`` cells. Every shard owns ``VNODES`` of them by a digest of
(shard, number), so the nodes of the first shards stay where they are when one
is added; a key's cell is a hash of its id, and its home is the next node
clockwise. Loads are bounded to the exact balance: of n rows a shard takes
floor(n / shards), the first n mod shards one more. Where a home is full, the
keys that come after continue clockwise to the next node whose shard has room,
so every shard ends at its bound (law ``rows``) and only overflow moves.

All keys of a cell see the same nodes in the same order, so the walk needs the
rows' counts per cell alone: a table of at most ``CELLS`` rows, whatever the
input, from which the pieces (cell, ranks from-to, shard, first slot) follow.
Rows get their rank in the cell by windows over (cell, part), parts splitting a
cell by the row's other columns, and meet the pieces by a broadcast of at most
``CELLS`` + CELLS x shards rows in theory, about CELLS + shards in practice.

Defined results: a null text has size 16 and crc32 0; null ids are one key;
repeated rows take consecutive ranks. An empty table gives no rows. Other
columns are not read. ``grown_shard`` is null, as the law is not ``key``.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

SHARDS, VNODES, CELLS, PARTS = 40, 64, 1 << 13, 64


def ring(shards: int, vnodes: int = VNODES, cells: int = CELLS) -> list[int]:
    """The shard of each cell that holds a node, -1 elsewhere. Nodes are placed
    shard by shard; one that meets a taken cell goes to the next free one."""
    if shards * vnodes > cells:
        raise ValueError("more virtual nodes than cells")
    owner = [-1] * cells
    for s in range(shards):
        for v in range(vnodes):
            c = int.from_bytes(hashlib.md5(f"{s}:{v}".encode()).digest()[:8], "big") % cells
            while owner[c] >= 0:
                c = (c + 1) % cells
            owner[c] = s
    return owner


def pieces(counts: dict[int, int], shards: int, vnodes: int = VNODES, cells: int = CELLS) -> list[tuple]:
    """(cell, from, to, shard, slot): ranks from <= r < to of a cell go to
    ``shard``, from ``slot`` on. Cells are served clockwise from cell 0."""
    owner = ring(shards, vnodes, cells)
    total = sum(counts.values())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    used = [0] * shards
    # next cell clockwise whose node may have room; full ones are skipped for good
    nxt = [c if owner[c] >= 0 else (c + 1) % cells for c in range(cells)]

    def find(c: int) -> int:
        path = []
        while owner[c] < 0 or used[owner[c]] >= room[owner[c]]:
            path.append(c)
            c = nxt[c] if nxt[c] != c else (c + 1) % cells
        for p in path:
            nxt[p] = c
        return c

    out = []
    for cell in sorted(counts):
        at, n = 0, counts[cell]
        while at < n:
            s = owner[find(cell)]
            take = min(n - at, room[s] - used[s])
            out.append((cell, at, at + take, s, used[s]))
            used[s] += take
            at += take
    return out


def shard_rows(docs: DataFrame, shards: int = SHARDS, vnodes: int = VNODES, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard; one row per row."""
    spark = docs.sparkSession
    raw = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), (F.octet_length(raw) + 16).cast("long").alias("size"),
                       F.crc32(raw).alias("text_crc32"))
    rows = rows.withColumns({"turn": F.xxhash64("doc_id"),
                             "part": F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), F.lit(PARTS)).cast("int")})
    rows = materialize(rows.withColumn("cell", F.pmod("turn", F.lit(CELLS)).cast("int")), "op4-rows")
    parts = materialize(rows.groupBy("cell", "part").agg(F.count(F.lit(1)).alias("n")), "op4-parts")
    counts = {r.cell: r.n for r in parts.groupBy("cell").agg(F.sum("n").alias("n")).collect()}
    # the pieces as one JSON literal: a table of bounded size that needs no Python rows
    table = json.dumps([dict(zip(("c", "lo", "hi", "shard", "first"), p)) for p in pieces(counts, shards, vnodes)])
    plan = spark.range(1, numPartitions=1).select(F.inline(F.from_json(
        F.lit(table), "array<struct<c:int,lo:long,hi:long,shard:int,first:long>>")))
    before = Window.partitionBy("cell").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(F.col("cell").alias("oc"), F.col("part").alias("op"),
                           F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("cell", "part").orderBy("turn", "doc_id", "text_crc32", "size")
    ranked = (rows.withColumn("r", F.row_number().over(inside).cast("long") - 1)
              .join(offsets, (F.col("cell") == F.col("oc")) & (F.col("part") == F.col("op")))
              .withColumn("r", F.col("r") + F.col("offset")))
    placed = ranked.join(F.broadcast(plan), (F.col("cell") == F.col("c")) & (F.col("r") >= F.col("lo"))
                         & (F.col("r") < F.col("hi")))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard",
                         (F.col("first") + F.col("r") - F.col("lo")).alias("slot"),
                         F.lit(None).cast("int").alias("grown_shard"))
