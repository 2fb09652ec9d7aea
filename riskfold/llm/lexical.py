"""Operator 11: ranked lexical search by the Best Position Algorithm.

The benchmark's items are the stated query set and come in blocks of bounded
size. Per block one map over the documents writes an index in *shards* of about
``SHARD_BYTES`` of text: per document its number of terms, and for the block's
terms the postings (document, term, occurrences). The corpus statistics (N, L and
each term's df) are sums over all shards.

A search task turns a shard's postings into impact lists, one per term, in
descending order, and answers each item by the Best Position Algorithm: the lists
of the item's terms are read in parallel; every document met is looked up
directly in all of these lists, which also tells its position there; a list's
best position is the last one before which all have been seen, no matter how. No
unseen document can score more than the impacts at the best positions together,
so reading ends as soon as this threshold is strictly below the k-th score (equal
scores go by doc_id and must all be seen). ``FLOOR_SHARDS`` shards are searched
first; an item's k-th score there is a floor that no document of its final list
falls below, so the other shards stop at it too and send back nothing less.

Defined results: null texts have no terms; rows that repeat an id are documents
of their own; of equal scores the smaller doc_id goes first, null last. Items
that repeat id and text are searched once; items without terms give no rows. An
empty table gives none; other columns are ignored. A block holds one item at
least, however long.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, ship_code, text_chunks, text_of
from .terms import Block, item_blocks, places, terms_of

TOP = 20
SHARD_BYTES = 16 << 20
BLOCK_BYTES = 8 << 20
FLOOR_SHARDS = 4


def _plane(a: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(a, np.int32).tobytes(), "zstd", asbytes=True)


def _flat(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, 4 * n, "zstd", asbytes=True), np.int32) if n else np.zeros(0, np.int32)


def index_shards(docs: DataFrame, vocabulary: pa.Array, id_col: str, text_col: str) -> DataFrame:
    """(shard, ids, sizes, n, doc, term, tf, terms, dfs): postings in order of
    (document, term) as compressed planes, a shard per row; a map without a shuffle."""
    src = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text_of(f"`{text_col}`").alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary.to_pylist())

    def build(batches):
        known = pa.array(shared.value, pa.binary())
        number = TaskContext.get().partitionId() << 32
        for b in batches:
            for a, data, off in text_chunks(b.column(1), SHARD_BYTES):
                found, owner = terms_of(data, off)
                n = len(off) - 1
                place = places(found, known)
                inside = place >= 0
                pairs, tf = np.unique(owner[inside] * len(known) + place[inside], return_counts=True)
                doc, term = pairs // len(known), pairs % len(known)
                terms, dfs = np.unique(term, return_counts=True)
                yield pa.record_batch(
                    [pa.array([number], pa.int64()),
                     pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), b.column(0).slice(a, n)),
                     pa.array([np.bincount(owner, minlength=n)], pa.list_(pa.int64())), pa.array([len(pairs)], pa.int64()),
                     *[pa.array([_plane(x)], pa.binary()) for x in (doc, term, tf)],
                     pa.array([terms], pa.list_(pa.int32())), pa.array([dfs], pa.list_(pa.int64()))],
                    names=["shard", "ids", "sizes", "n", "doc", "term", "tf", "terms", "dfs"])
                number += 1

    return src.mapInArrow(build, f"shard long, ids array<{kind}>, sizes array<long>, n long, doc binary, term binary, "
                                 "tf binary, terms array<int>, dfs array<long>")


@dataclass
class Queries:
    """A block's items: distinct terms with their number, weights, corpus sums, floors."""

    terms: list
    counts: list
    weights: np.ndarray
    n_docs: int
    n_terms: int
    floors: np.ndarray


class ImpactLists:
    """A shard's postings as impact lists with direct access."""

    def __init__(self, sizes: np.ndarray, doc: np.ndarray, term: np.ndarray, tf: np.ndarray, q: Queries) -> None:
        self.width = len(q.weights)
        m = 100 - 25 + (25 * sizes * q.n_docs) // max(q.n_terms, 1)
        tf = tf.astype(np.int64)
        self.impact = q.weights[term] * ((1000000000 * tf) // (1000 * tf + 12 * m[doc]))
        self.key = doc.astype(np.int64) * self.width + term
        order = np.lexsort((doc, -self.impact, term))
        self.begin = np.searchsorted(term[order], np.arange(self.width + 1))
        self.listed_doc, self.listed_impact = doc[order], self.impact[order]
        self.position = np.empty(len(order), np.int64)
        self.position[order] = np.arange(len(order)) - self.begin[term[order]]
        self.seen = np.zeros(len(sizes), bool)

    def direct(self, docs: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Impact and position of each document in each term's list (0, -1 outside)."""
        want = docs[:, None] * self.width + terms
        at = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
        hit = self.key[at] == want
        return np.where(hit, self.impact[at], 0), np.where(hit, self.position[at], -1)

    def best(self, terms: np.ndarray, counts: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Documents that may be among the k best and their scores, above 0 and at
        least ``floor``, and the number of positions read."""
        size = self.begin[terms + 1] - self.begin[terms]
        held = size > 0
        terms, counts, size, begin = terms[held], counts[held], size[held], self.begin[terms][held]
        got = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if not len(terms):
            return got[0][0], got[1][0], 0
        marks = [np.zeros(n + 1, bool) for n in size]                # one False at the end
        best = np.zeros(len(terms), np.int64)
        depth, step, kth = 0, 2 * k, 0
        while True:
            read = np.concatenate([self.listed_doc[b + depth:b + min(depth + step, n)] for b, n in zip(begin, size)])
            depth, step = depth + step, 2 * step
            new = np.unique(read[~self.seen[read]])
            if len(new):
                self.seen[new] = True
                impact, position = self.direct(new, terms)
                got[0].append(new)
                got[1].append(impact @ counts)
                for i, mark in enumerate(marks):
                    p = position[:, i]
                    mark[p[p >= 0]] = True
                scores = np.concatenate(got[1])
                if len(scores) >= k:
                    kth = int(np.partition(scores, len(scores) - k)[len(scores) - k])
            threshold = 0
            for i, mark in enumerate(marks):
                best[i] += int(np.argmin(mark[best[i]:]))            # the first position not seen
                if best[i] < size[i]:
                    threshold += int(counts[i]) * int(self.listed_impact[begin[i] + max(best[i] - 1, 0)])
            if threshold < max(kth, floor) or threshold == 0:
                break
        docs, scores = np.concatenate(got[0]), np.concatenate(got[1])
        self.seen[docs] = False
        keep = scores >= max(kth, floor, 1)
        return docs[keep], scores[keep], int(np.minimum(size, depth).sum())


def _searched(index: DataFrame, q: Queries, k: int) -> DataFrame:
    """(item, doc_id, score, read): what each shard has to offer for each item."""
    shared = index.sparkSession.sparkContext.broadcast(q)
    kind = index.schema["ids"].dataType.elementType.simpleString()

    def run(batches):
        q = shared.value
        for b in batches:
            for i in range(b.num_rows):
                n = b.column("n")[i].as_py()
                doc, term, tf = (_flat(b.column(c)[i].as_py(), n) for c in ("doc", "term", "tf"))
                if not n:
                    continue
                lists = ImpactLists(np.array(b.column("sizes")[i].as_py(), np.int64), doc, term, tf, q)
                ids = b.column("ids").slice(i, 1).flatten()
                items, found, scores, reads = [], [], [], []
                for item, (terms, counts, floor) in enumerate(zip(q.terms, q.counts, q.floors)):
                    d, s, read = lists.best(terms, counts, k, int(floor))
                    items.append(np.full(len(d), item))
                    found.append(d)
                    scores.append(s)
                    reads.append(np.full(len(d), read))
                yield pa.record_batch([pa.array(np.concatenate(items), pa.int32()), ids.take(pa.array(np.concatenate(found))),
                                       pa.array(np.concatenate(scores), pa.int64()), pa.array(np.concatenate(reads), pa.int64())],
                                      names=["item", "doc_id", "score", "read"])

    return index.select("ids", "sizes", "n", "doc", "term", "tf").mapInArrow(
        run, f"item int, doc_id {kind}, score long, read long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _block_search(docs: DataFrame, block: Block, k: int, id_col: str, text_col: str) -> DataFrame:
    index = materialize(index_shards(docs, block.vocabulary, id_col, text_col), "op11-index")
    total = index.select("sizes").agg(
        F.sum(F.size(F.filter("sizes", lambda x: x > 0))), F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)))
    n_docs, n_terms = (int(x or 0) for x in total.first())
    df = np.zeros(len(block.vocabulary), np.int64)      # as many as the block has terms
    for t, n in (index.select(F.explode(F.arrays_zip("terms", "dfs")).alias("x")).groupBy("x.terms")
                 .agg(F.sum("x.dfs")).collect()):
        df[t] = n
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(n) + 1))) for n in df], np.int64)
    terms, counts = [], []
    for a, b in zip(block.off[:-1], block.off[1:]):
        t, c = np.unique(block.words[a:b], return_counts=True)
        keep = weights[t] > 0
        terms.append(t[keep].astype(np.int64))
        counts.append(c[keep].astype(np.int64))
    q = Queries(terms, counts, weights, n_docs, n_terms, np.zeros(len(terms), np.int64))
    first = [r[0] for r in index.where("n > 0").select("shard").orderBy(F.xxhash64("shard")).limit(FLOOR_SHARDS).collect()]
    least = (_ranked(_searched(index.where(F.col("shard").isin(first)), q, k), k).groupBy("item")
             .agg(F.min("score").alias("s"), F.count("*").alias("n")).where(F.col("n") == k))
    for item, score, _ in least.collect():               # one number an item of the block
        q.floors[item] = score
    names = docs.sparkSession.createDataFrame(
        pa.table({"item": pa.array(np.arange(len(terms)), pa.int32()), "item_id": block.ids}))
    out = _ranked(_searched(index, q, k), k)
    return out.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = TOP, id_col: str = "doc_id", text_col: str = "text",
           item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: each item's k best documents."""
    if k < 1:
        raise ValueError("k is 1 at least")
    ship_code(docs.sparkSession)
    out = None
    for block in item_blocks(items, item_id, item_text, BLOCK_BYTES, "op11"):
        found = _block_search(docs, block, k, id_col, text_col)
        out = found if out is None else out.unionByName(found)
    if out is None:
        kind = {"i": items.schema[item_id].dataType.simpleString(), "d": docs.schema[id_col].dataType.simpleString()}
        return docs.sparkSession.createDataFrame([], f"item_id {kind['i']}, rank int, doc_id {kind['d']}, score long")
    return out
