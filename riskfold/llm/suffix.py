"""Operator 3: repeated 50-byte strings across documents, by blockwise suffix
sorting with a difference cover.

A byte goes if it lies in a 50-byte string that also starts in a document with
a smaller id. Suffixes tie only up to depth 50 here, and the corpus is sorted in
blocks so that no task holds more than a chunk of text or a bucket of keys:

* Documents are put in order of their ids into *chunks* of about
  ``CHUNK_BYTES``, one compressed row each; every later step joins its lists to
  these rows. A later copy of a whole text needs no sorting: it goes as a whole.
* Cover samples: the positions p of a document with p mod 31 in the difference
  cover ``COVER``. For any two positions i, j there is a shift below 31 that
  takes both into the sample, so two suffixes that tie for 50 bytes have
  sampled places with equal 20-byte strings at the same shift. The samples'
  strings are ranked first, bucket by bucket: each chunk sends its distinct keys
  as sorted runs, a bucket merges them, and only keys with company (a rank that
  is shared) come back. A suffix without a shared rank in reach ties with
  nothing and is never sorted.
* Suffix buckets: the remaining suffixes are sorted to depth 50, one bucket
  after the other, again as sorted runs. A bucket tells each chunk which of its
  keys an earlier chunk has; order inside a chunk is settled there.

Keys stand for strings in a fixed total order (that of a 64-bit hash of the
string; sample keys keep ``SAMPLE_BITS`` more bits than the corpus needs, since
they only pick candidates). Runs are delta-coded.

Defined results: a null text is empty; texts below 50 bytes lose nothing; null
ids come first and are not smaller than one another; rows with equal ids do not
affect each other, rows that repeat id and text get the same values. An empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, materialize, mix64, ship_code, text_chunks, text_of, tidy

LENGTH = 50
#: A difference cover of 31: every residue is a difference of two of its values.
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)
SAMPLE_LENGTH = LENGTH - PERIOD + 1
SAMPLE_BITS = 10
CHUNK_BYTES = 8 << 20
BUCKET_KEYS = 1 << 20

_BASE = 0x9E3779B97F4A7C15
_TABLE = mix64(np.arange(256, dtype=np.uint64) + np.uint64(0x51ED270B))


def string_keys(data: np.ndarray, where: np.ndarray, length: int, block: int = 1 << 19) -> np.ndarray:
    """Hashes of the ``length`` bytes at the sorted positions ``where``: blocks
    of the bytes are hashed at power-of-two lengths by doubling."""
    out = np.zeros(len(where), np.uint64)
    for a in range(0, max(len(data) - length + 1, 0), block):
        lo, hi = np.searchsorted(where, (a, a + block))
        if lo == hi:
            continue
        at = where[lo:hi] - a
        have, size, done, key = _TABLE[data[a:a + block + length - 1]], 1, 0, None
        rest = length
        while rest:
            if rest & 1:
                tail = have[at + done]
                key = tail if key is None else key * np.uint64(pow(_BASE, size, 1 << 64)) + tail
                done += size
            rest >>= 1
            if rest:
                low = have[:-size] * np.uint64(pow(_BASE, size, 1 << 64))
                low += have[size:]
                have = low
                size *= 2
        out[lo:hi] = mix64(key)
    return out


def pack_run(keys: np.ndarray) -> bytes:
    """A sorted run of distinct unsigned keys as delta byte planes, compressed."""
    if not len(keys):
        return b""
    deltas = np.diff(keys, prepend=np.uint64(0))
    deltas[0] = 0
    planes = deltas.view(np.uint8).reshape(-1, 8).T
    used = max(1, (int(deltas.max()).bit_length() + 7) // 8)
    raw = np.ascontiguousarray(planes[:used]).tobytes()
    head = np.array([len(keys), used, int(keys[0])], np.uint64).tobytes()
    return head + pa.compress(raw, "zstd", asbytes=True)


def unpack_run(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, np.uint64)
    n, used, first = (int(x) for x in np.frombuffer(data, np.uint64, 3))
    raw = pa.decompress(data[24:], n * used, "zstd", asbytes=True)
    planes = np.zeros((n, 8), np.uint8)
    planes[:, :used] = np.frombuffer(raw, np.uint8).reshape(used, n).T
    keys = planes.reshape(-1).view(np.uint64).copy()
    keys[0] = first
    return np.cumsum(keys, dtype=np.uint64)


def sample_positions(off: np.ndarray) -> np.ndarray:
    """Cover positions whose sampled string fits into the text."""
    out = []
    cover = np.array(COVER)
    for a, b in zip(off[:-1], off[1:]):
        n = b - a - SAMPLE_LENGTH + 1
        if n > 0 and b - a >= LENGTH:
            p = (np.arange(0, n + PERIOD, PERIOD)[:, None] + cover).ravel()
            out.append(a + p[p < n])
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def sample_keys(data: np.ndarray, off: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and ``bits``-bit keys of the cover samples of texts."""
    pos = sample_positions(off)
    return pos, string_keys(data, pos, SAMPLE_LENGTH) >> np.uint64(64 - bits)


def distinct(keys: np.ndarray) -> np.ndarray:
    keys = np.sort(keys)
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    return keys[new]


def marked(ordered: np.ndarray, run: np.ndarray) -> np.ndarray:
    """Which of the ordered keys are in the sorted distinct run."""
    step = np.zeros(len(ordered) + 1, np.int32)
    np.add.at(step, np.searchsorted(ordered, run, "left"), 1)
    np.add.at(step, np.searchsorted(ordered, run, "right"), -1)
    return np.cumsum(step)[:-1] > 0


class Chunk:
    """One chunk: its texts in order of their ids, without later copies."""

    def __init__(self, row: dict) -> None:
        lens, ranks = np.array(row["lens"], np.int64), np.array(row["ranks"], np.int64)
        raw = pa.decompress(row["blob"], int(lens.sum()), "zstd", asbytes=True) if lens.sum() else b""
        data = np.frombuffer(raw, np.uint8)
        off = np.concatenate([[0], np.cumsum(lens)])
        self.place = np.sort(np.array(row["firsts"], np.int64))
        self.data = np.concatenate([data[off[i]:off[i + 1]] for i in self.place]) if len(self.place) else data[:0]
        self.off = np.concatenate([[0], np.cumsum(lens[self.place])])
        self.rank = ranks[self.place]

    def text_at(self, pos: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.off, pos, "right") - 1

    def regions(self, shared: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """First and last+1 starts of the runs of suffixes with a shared sample
        in reach, by position."""
        pos, keys = sample_keys(self.data, self.off, bits)
        order = np.argsort(keys)
        k, o = keys[order], self.rank[self.text_at(pos)][order]
        two = (k[1:] == k[:-1]) & (o[1:] != o[:-1])      # two ids in the chunk itself have it
        hit = pos[order[marked(k, np.union1d(shared, k[1:][two]))]]
        n = len(self.data)
        if n < LENGTH or not len(hit):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        seen = np.zeros(n + 1, np.int32)
        seen[hit + 1] = 1
        seen = np.cumsum(seen, dtype=np.int32)
        is_open = seen[PERIOD:PERIOD + n - LENGTH + 1] > seen[:n - LENGTH + 1]
        for e in self.off[1:-1]:                         # a suffix of 50 bytes stays inside its text
            is_open[max(0, e - LENGTH + 1):e] = False
        edge = np.diff(is_open.astype(np.int8), prepend=0, append=0)
        first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        # a run that touches the next text's first suffix can't exist: the gap is 49 positions
        return first, last


class Regions:
    """The parts of a chunk whose suffixes are sorted."""

    def __init__(self, row: dict) -> None:
        self.place, self.start, self.size, self.rank = (np.array(row[k], np.int64) for k in
                                                        ("places", "starts", "sizes", "owners"))
        n = int((self.size + LENGTH - 1).sum())
        self.data = np.frombuffer(pa.decompress(row["blob"], n, "zstd", asbytes=True) if n else b"", np.uint8)
        ends = np.cumsum(self.size)
        self.region = np.repeat(np.arange(len(self.size)), self.size)
        self.inner = np.arange(len(self.region)) - np.repeat(ends - self.size, self.size)
        at = np.concatenate([[0], np.cumsum(self.size + LENGTH - 1)])[:-1]
        self.keys = string_keys(self.data, at[self.region] + self.inner, LENGTH)


def _rows(batch: pa.RecordBatch):
    for i in range(batch.num_rows):
        yield batch.slice(i, 1).to_pylist()[0]


def _split(keys: np.ndarray, bits: int, bucket_bits: int):
    """A sorted run cut into buckets by its keys' top bits."""
    top = (keys >> np.uint64(bits - bucket_bits)).astype(np.int64) if bucket_bits else np.zeros(len(keys), np.int64)
    cuts = np.searchsorted(top, np.arange((1 << bucket_bits) + 1))
    for b in np.flatnonzero(np.diff(cuts)):
        yield int(b), pack_run(keys[cuts[b]:cuts[b + 1]])


def _pieces(rows: DataFrame, keys_of, bits: int, bucket_bits: int) -> DataFrame:
    """(bucket, chunk, run): each chunk's distinct keys as sorted runs."""
    def run(batches):
        for b in batches:
            for row in _rows(b):
                runs = list(_split(distinct(keys_of(row)), bits, bucket_bits))
                yield pa.record_batch([pa.array([x[0] for x in runs], pa.int64()),
                                       pa.array([row["chunk"]] * len(runs), pa.int64()),
                                       pa.array([x[1] for x in runs], pa.binary())], names=["bucket", "chunk", "run"])

    return rows.mapInArrow(run, "bucket long, chunk long, run binary")


def _merged(pieces: DataFrame, earlier: bool) -> DataFrame:
    """(chunk, run): of each chunk's keys those that another chunk has, or an
    earlier one. One bucket at a time is in memory."""
    def merge(t: pa.Table) -> pa.Table:
        chunk = t.column("chunk").to_numpy()
        runs = [unpack_run(x.as_py()) for x in t.column("run")]
        keys = np.concatenate(runs)
        who = np.repeat(chunk, [len(r) for r in runs])
        order = np.lexsort((who, keys))
        keys, who = keys[order], who[order]
        same = keys[1:] == keys[:-1]
        hit = np.zeros(len(keys), bool)
        hit[1:] = same                      # a chunk has a key once, so its neighbour is another chunk
        if not earlier:
            hit[:-1] |= same
        keys, who = keys[hit], who[hit]
        order = np.lexsort((keys, who))
        keys, who = keys[order], who[order]
        names, at = np.unique(who, return_index=True)
        parts = np.split(keys, at[1:])
        return pa.table({"chunk": pa.array(names, pa.int64()),
                         "run": pa.array([pack_run(p) for p in parts] if len(names) else [], pa.binary())})

    return pieces.groupBy("bucket").applyInArrow(merge, "chunk long, run binary")


def _runs(parts: list | None) -> np.ndarray:
    """A chunk's runs of all buckets, as one sorted array."""
    return np.sort(np.concatenate([unpack_run(p) for p in parts])) if parts else np.zeros(0, np.uint64)


def _collected(lists: DataFrame, name: str) -> DataFrame:
    """One row per chunk: its runs, at most one a bucket and no longer than the chunk."""
    return lists.groupBy("chunk").agg(F.collect_list("run").alias(name))


def pack_chunks(rows: DataFrame, n_chunks: int) -> DataFrame:
    """(chunk, ids, ranks, lens, digests, blob) from (doc_id, text); chunks
    follow the order of ids, rows with one id share a chunk."""
    def run(batches):
        ids, lens, digests, data = [], [], [], []
        for b in batches:
            for a, buf, off in text_chunks(b.column(1)):
                ids += b.column(0).slice(a, len(off) - 1).to_pylist()
                lens.append(np.diff(off))
                raw = buf.tobytes()
                data.append(raw)
                digests += [hashlib.sha256(raw[x:y]).digest() for x, y in zip(off[:-1], off[1:])]
        if not ids:
            return
        lens, raw = np.concatenate(lens), b"".join(data)
        off = np.concatenate([[0], np.cumsum(lens)])
        key = [(i is not None, i if i is not None else 0, d) for i, d in zip(ids, digests)]
        order = sorted(range(len(ids)), key=key.__getitem__)
        rank = np.cumsum([k > 0 and key[order[k]][:2] != key[order[k - 1]][:2] for k in range(len(order))])
        blob = pa.compress(b"".join(raw[off[i]:off[i + 1]] for i in order), "zstd", asbytes=True)
        yield pa.record_batch([
            pa.array([TaskContext.get().partitionId()], pa.int64()),
            pa.array([[ids[i] for i in order]], pa.list_(pa.int64())),
            pa.array([rank], pa.list_(pa.int64())), pa.array([lens[order]], pa.list_(pa.int64())),
            pa.array([[digests[i].hex() for i in order]], pa.list_(pa.string())),
            pa.array([blob], pa.binary())], names=["chunk", "ids", "ranks", "lens", "digests", "blob"])

    return rows.repartitionByRange(n_chunks, "doc_id").mapInArrow(
        run, "chunk long, ids array<long>, ranks array<long>, lens array<long>, digests array<string>, blob binary")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   texts: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and with ``texts`` the
    remaining bytes, ``kept``); one row per document."""
    spark = docs.sparkSession
    ship_code(spark)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text_of(f"`{text_col}`").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_chunks = max(1, math.ceil(total / CHUNK_BYTES))
    n_samples = max(1.0, total * len(COVER) / PERIOD)
    bits = min(64, math.ceil(math.log2(n_samples)) + SAMPLE_BITS)
    bucket_bits = max(4, math.ceil(math.log2(max(1, n_samples / BUCKET_KEYS))))
    scratch = Scratch()
    table = materialize(pack_chunks(rows, n_chunks), "op3-chunks")
    tidy(spark)

    # the first of equal texts, by id: the others go as a whole
    each = table.select("chunk", F.posexplode(F.arrays_zip("ids", "digests", "lens")).alias("place", "d"))
    each = each.select("chunk", "place", F.col("d.ids").alias("doc_id"), F.col("d.digests").alias("digest"),
                       F.col("d.lens").alias("n_bytes"))
    firsts = scratch.keep(each.groupBy("digest").agg(F.min(F.struct("chunk", "place")).alias("f"))
                          .groupBy("f.chunk").agg(F.collect_list("f.place").alias("firsts")), "op3-firsts")
    base = table.select("chunk", "ranks", "lens", "blob").join(firsts, "chunk")

    def cover(row: dict) -> np.ndarray:
        c = Chunk(row)
        return sample_keys(c.data, c.off, bits)[1]

    before_regions = Scratch()
    ranks = before_regions.keep(_merged(_pieces(base, cover, bits, bucket_bits), earlier=False), "op3-ranks")
    tidy(spark)

    def mark(batches):
        for b in batches:
            for row in _rows(b):
                c = Chunk(row)
                first, last = c.regions(_runs(row["shared"]), bits)
                t = c.text_at(first)
                text = b"".join(c.data[x:y + LENGTH - 1].tobytes() for x, y in zip(first, last))
                yield pa.record_batch(
                    [pa.array([row["chunk"]], pa.int64()),
                     *[pa.array([v], pa.list_(pa.int64())) for v in (c.place[t], first - c.off[t], last - first, c.rank[t])],
                     pa.array([pa.compress(text, "zstd", asbytes=True)], pa.binary())],
                    names=["chunk", "places", "starts", "sizes", "owners", "blob"])

    regions = scratch.keep(base.join(_collected(ranks, "shared"), "chunk", "left").mapInArrow(
        mark, "chunk long, places array<long>, starts array<long>, sizes array<long>, owners array<long>, blob binary"),
        "op3-regions")
    before_regions.free(spark)
    tidy(spark)
    earlier = scratch.keep(_merged(_pieces(regions, lambda row: Regions(row).keys, 64, bucket_bits), earlier=True),
                           "op3-earlier")
    tidy(spark)

    def settle(batches):
        for b in batches:
            for row in _rows(b):
                g = Regions(row)
                order = np.argsort(g.keys)
                k, o = g.keys[order], g.rank[g.region][order]
                gone = marked(k, _runs(row["before"]))
                new = np.ones(len(k), bool)
                new[1:] = k[1:] != k[:-1]
                if len(k):                               # inside the chunk: a smaller id has it
                    low = np.minimum.reduceat(o, np.flatnonzero(new))
                    gone |= o > low[np.cumsum(new) - 1]
                hit = np.sort(order[gone])               # regions follow places and starts
                place, at = g.place[g.region[hit]], (g.start[g.region] + g.inner)[hit]
                cut = np.ones(len(hit), bool)
                cut[1:] = (place[1:] != place[:-1]) | (at[1:] > at[:-1] + LENGTH)
                first = np.flatnonzero(cut)
                last = np.append(first[1:], len(hit)) - 1 if len(first) else first
                yield pa.record_batch([pa.array([row["chunk"]], pa.int64()),
                                       *[pa.array([v], pa.list_(pa.int64())) for v in
                                         (place[first], at[first], at[last] + LENGTH)]],
                                      names=["chunk", "places", "froms", "tos"])

    cuts = scratch.keep(regions.join(_collected(earlier, "before"), "chunk", "left").mapInArrow(
        settle, "chunk long, places array<long>, froms array<long>, tos array<long>"), "op3-cuts")

    def keep(batches):
        for b in batches:
            for row in _rows(b):
                lens = np.array(row["lens"], np.int64)
                off = np.concatenate([[0], np.cumsum(lens)])
                raw = pa.decompress(row["blob"], int(off[-1]), "zstd", asbytes=True) if off[-1] else b""
                place, x, y = (np.array(row[c], np.int64) for c in ("places", "froms", "tos"))
                out = []
                for i in np.unique(place) if not texts else np.arange(len(lens)):
                    lo, hi = np.searchsorted(place, (i, i + 1))
                    at = np.concatenate([[0], y[lo:hi]])
                    to = np.append(x[lo:hi], lens[i])
                    kept = b"".join(raw[off[i] + p:off[i] + q] for p, q in zip(at, to))
                    out.append((row["chunk"], int(i), int((y[lo:hi] - x[lo:hi]).sum()), int(hi - lo),
                                hashlib.sha256(kept).hexdigest(), kept if texts else None))
                yield pa.record_batch([pa.array([r[j] for r in out], t) for j, t in enumerate(
                    (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.binary()))],
                    names=["chunk", "place", "n_removed", "n_spans", "kept_sha256", "kept"])

    settled = table.select("chunk", "lens", "blob").join(cuts, "chunk").mapInArrow(
        keep, "chunk long, place int, n_removed long, n_spans long, kept_sha256 string, kept binary")
    first = (each.join(firsts.select("chunk", F.explode("firsts").alias("place")), ["chunk", "place"])
             .join(settled, ["chunk", "place"], "left")
             .select(F.col("digest").alias("f_digest"), F.col("doc_id").alias("f_id"),
                     F.coalesce("n_removed", F.lit(0).cast("long")).alias("r"),
                     F.coalesce("n_spans", F.lit(0).cast("long")).alias("s"),
                     F.coalesce("kept_sha256", "digest").alias("k"), F.col("kept").alias("kept_bytes")))
    first = materialize(first, "op3-results")
    scratch.free(spark)
    tidy(spark)
    # a later copy of a whole text goes as a whole, if it holds 50 bytes
    copy = ~F.col("doc_id").eqNullSafe(F.col("f_id")) & (F.col("n_bytes") >= LENGTH)
    out = each.join(first, F.col("digest") == F.col("f_digest"))
    return out.select("doc_id", "n_bytes", F.when(copy, F.col("n_bytes")).otherwise(F.col("r")).alias("n_removed"),
                      F.when(copy, F.lit(1).cast("long")).otherwise(F.col("s")).alias("n_spans"),
                      F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.col("k")).alias("kept_sha256"),
                      *([F.when(copy, F.lit("").cast("binary")).otherwise(F.col("kept_bytes")).alias("kept")]
                        if texts else []))
