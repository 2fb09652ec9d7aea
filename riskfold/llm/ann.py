"""Operator 8: approximate nearest neighbours by balanced posting lists.

Nearness is the inner product. One more coordinate, sqrt(M^2 - |x|^2) with M the
largest norm, puts all vectors on a sphere, where the nearest by distance are
the largest by inner product; queries are scaled to norm M.

* Fit: ``SAMPLE`` vectors (by a hash of the id; a documented bound) are split by
  2-means until each part stands for at most ``LIST_ROWS`` rows of the table or
  ``MAX_LISTS`` lists are reached. The centroids and a graph that links each to
  its ``DEGREE`` nearest go to the tasks by broadcast: at most ``MAX_LISTS`` rows.
* Index: every vector goes to its nearest list, found in the graph, and, if it
  lies near a boundary, also to the next ones, up to ``REPLICAS`` lists within the
  distance ratio ``1 + BOUNDARY``. The graph search takes rows with the same
  nearest entry point together: one product gives their distances to the nodes
  that none of them has seen, and only nodes in some row's beam are expanded.
* Reach: how far a query looks is a distance ratio, fitted for each table: the
  true nearest of ``CALIBRATION`` queries (by a hash; a documented bound) are
  found by brute force over all rows, and the ratio is the smallest that reads
  the lists of ``RECALL`` of them. Nothing bounds the number of lists read.
* Search in rounds: a query's nearest lists first; the k-th score so far is a floor,
  and a next round reads further lists within the ratio, ``STEP`` times the rows of
  all rounds before, and gives only what reaches the floor, told by one product and
  one comparison a list. So a query gives rows by the number of rounds, which grows
  with the logarithm of the table. Where the ratio may go beyond the beam, the
  distances to all centroids are taken. Lists are put together in groups of about
  ``GROUP_ROWS`` rows; a longer list is split, and queries likewise come in blocks
  of ``BLOCK``, as many for a group as its queries fill (told by a hash sample of
  ``BLOCK`` queries), so equal vectors by the million make more blocks, not larger
  ones; nothing is dropped. Distances and scores are taken ``CELLS`` at a time.
  Scores are exact, in double precision on the vectors.

A query whose lists hold too few rows takes further ones, and one that found
fewer ids than there are searches all lists.

Defined results: vectors that are null, zero, of another dimension than most, or
hold null, NaN or infinite components take no part, nor do null ids. Rows that
repeat an id count once, with their best score. Ties go to the smaller vec_id.
Fewer candidates than k give all of them; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, ship_code

TOP, SAMPLE, LIST_ROWS, MAX_LISTS, DEGREE, BEAM = 20, 20_000, 256, 4096, 16, 32
BOUNDARY, REPLICAS, RECALL, CALIBRATION = 0.15, 2, 0.95, 256
BLOCK, GROUP_ROWS, SLICE, STEP = 4096, 8192, 1024, 8
#: Most elements of a matrix of distances or scores that a task holds at a time.
CELLS = 1 << 20
#: Nodes where a search enters the graph.
ENTRIES = 16
#: Least squared distance to a nearest centroid, as ratios to it are taken.
NEAR = 1e-12


def split_clusters(x: np.ndarray, most: int, limit: int, seed: int = 7) -> np.ndarray:
    """Centroids of a balanced hierarchical clustering: the largest part is
    halved by 2-means until none has over ``most`` rows or there are ``limit``."""
    rng = np.random.default_rng(seed)
    done, todo = [], [np.arange(len(x))]
    while todo:
        todo.sort(key=len)
        part = todo.pop()
        if len(part) <= most or len(done) + len(todo) + 1 >= limit:
            done.append(part)
            continue
        y = x[part]
        c = y[rng.choice(len(y), 2, replace=False)]
        side = np.zeros(len(y), bool)
        for _ in range(8):
            gap = ((y - c[0]) ** 2).sum(1) - ((y - c[1]) ** 2).sum(1)
            # the balance: the cut moves so that no side has under a quarter
            cut = np.clip(0.0, *np.quantile(gap, (0.25, 0.75)))
            side = gap > cut
            if side.all() or not side.any():
                break
            c = np.stack([y[~side].mean(0), y[side].mean(0)])
        if side.all() or not side.any():       # equal vectors can't be parted
            done.append(part)
            continue
        todo += [part[~side], part[side]]
    return np.stack([x[p].mean(0) for p in done]).astype(np.float32)


class Centroids:
    """The lists' centroids and the graph over them."""

    def __init__(self, points: np.ndarray) -> None:
        self.points = points
        n = len(points)
        k = min(DEGREE, n - 1)
        self.links = np.zeros((n, max(k, 1)), np.int64)
        for a in range(0, n, 512):
            if k:
                d = self._distance(points[a:a + 512], points)
                d[np.arange(len(d)), np.arange(a, a + len(d))] = np.inf
                self.links[a:a + 512] = np.argpartition(d, k - 1, 1)[:, :k]
        self.starts = np.unique(np.linspace(0, n - 1, min(n, ENTRIES)).astype(np.int64))

    @staticmethod
    def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0)

    def search(self, x: np.ndarray, width: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """(ids, squared distances) of near centroids, nearest first: a beam search
        in the graph. Rows with one nearest entry point share their visited nodes."""
        n = len(self.points)
        width = min(width, n)
        ids, dist = np.empty((len(x), width), np.int64), np.empty((len(x), width), np.float32)
        entry = self._distance(x, self.points[self.starts]).argmin(1) if len(x) else np.zeros(0, np.int64)
        for e in np.unique(entry):
            every = np.flatnonzero(entry == e)
            step = max(1, CELLS // n)
            for a in range(0, len(every), step):
                rows = every[a:a + step]
                ids[rows], dist[rows] = self._beam(x[rows], width)
        return ids, dist

    def _beam(self, y: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The search of rows that visit the same nodes."""
        n = len(self.points)
        unseen, unexpanded = np.ones(n, bool), np.ones(n, bool)
        nodes, new, d = np.zeros(0, np.int64), self.starts, np.zeros((len(y), 0), np.float32)
        while len(new):
            unseen[new] = False
            nodes, d = np.concatenate([nodes, new]), np.concatenate([d, self._distance(y, self.points[new])], 1)
            if len(nodes) <= width:
                beam = nodes
            else:
                beam = nodes[np.unique(np.argpartition(d, width - 1, 1)[:, :width])]
            beam = beam[unexpanded[beam]]
            unexpanded[beam] = False
            new = np.unique(self.links[beam])
            new = new[unseen[new]]
        if len(nodes) < width:          # a graph in parts: the rest is looked at too
            rest = np.flatnonzero(unseen)
            nodes, d = np.concatenate([nodes, rest]), np.concatenate([d, self._distance(y, self.points[rest])], 1)
        order = np.argsort(d, 1, kind="stable")[:, :width]
        return nodes[order], np.take_along_axis(d, order, 1)

    def lists_read(self, x: np.ndarray, size: np.ndarray, ratio: float, need: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, list, rows in nearer lists) of the lists that the queries read: those
        within ``ratio`` of the nearest, and further ones while they hold under ``need`` rows."""
        step = max(1, CELLS // len(self.points))
        parts = [self._read(x[a:a + step], size, ratio, need, a) for a in range(0, len(x), step)]
        return tuple(np.concatenate(z) for z in zip(*parts)) if parts else (np.zeros(0, np.int64),) * 3

    def _read(self, x: np.ndarray, size: np.ndarray, ratio: float, need: int, first: int):
        ids, d = self.search(x)
        far = ((d[:, -1] <= ratio ** 2 * np.maximum(d[:, 0], NEAR)) | (size[ids].sum(1) < need)) & (ids.shape[1] < len(self.points))
        every = self._distance(x[far], self.points)
        order = np.argsort(every, 1, kind="stable")
        rows, lists, before = [], [], []
        for at, i, e in ((~far, ids[~far], d[~far]), (far, order, np.take_along_axis(every, order, 1))):
            held = np.cumsum(size[i], 1) - size[i]
            take = (e <= ratio ** 2 * np.maximum(e[:, :1], NEAR)) | (held < need)
            row, col = np.nonzero(take & (size[i] > 0))
            rows.append(first + np.flatnonzero(at)[row])
            lists.append(i[row, col])
            before.append(held[row, col])
        return np.concatenate(rows), np.concatenate(lists), np.concatenate(before)


def _hits(qid: np.ndarray, q: np.ndarray, floor: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int):
    """``_part_hits`` of all queries, as many at a time as ``CELLS`` scores allow."""
    step = max(1, CELLS // max(1, len(ids)))
    parts = [_part_hits(qid[a:a + step], q[a:a + step], floor[a:a + step], ids, x, k) for a in range(0, len(qid), step)]
    return tuple(np.concatenate(z) for z in zip(*parts))


def _part_hits(qid: np.ndarray, q: np.ndarray, floor: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int):
    """(query id, vec id, score) of one list's rows (by id) that reach the queries'
    floors, and of these the k best ids of each query with all that tie; an id
    counts once, with its best row."""
    s = q @ x.T
    s[qid[:, None] == ids[None]] = -np.inf
    first = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
    top = s if len(first) == len(ids) else np.maximum.reduceat(s, first, axis=1)
    least = floor.copy()
    many = np.flatnonzero((top >= floor[:, None]).sum(1) > k)
    if len(many):
        least[many] = np.maximum(floor[many], -np.partition(-top[many], k - 1, 1)[:, k - 1])
    slack = np.where(np.isfinite(least), 1e-9 * (1 + np.abs(least)), 0)
    r, c = np.nonzero((s >= (least - slack)[:, None]) & (s > -np.inf))
    score = (x[c] * q[r]).sum(1)                 # row by row: equal vectors get equal scores
    order = np.lexsort((-score, c if len(first) == len(ids) else ids[c], r))
    r, c, score = r[order], c[order], score[order]
    one = np.ones(len(r), bool)
    one[1:] = (r[1:] != r[:-1]) | (ids[c[1:]] != ids[c[:-1]])
    return qid[r[one]], ids[c[one]], score[one]


def _best_ids(qid: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int):
    """Of each query the k best distinct ids, ties to the smaller id."""
    order = np.lexsort((-score, ids, qid))
    qid, ids, score = qid[order], ids[order], score[order]
    one = np.ones(len(qid), bool)
    one[1:] = (qid[1:] != qid[:-1]) | (ids[1:] != ids[:-1])
    qid, ids, score = qid[one], ids[one], score[one]
    order = np.lexsort((ids, -score, qid))
    qid, ids, score = qid[order], ids[order], score[order]
    rank = np.arange(len(qid)) - np.searchsorted(qid, qid)
    return qid[rank < k], ids[rank < k], score[rank < k]


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def true_nearest(base: DataFrame, q: np.ndarray, qid: np.ndarray, k: int) -> DataFrame:
    """query (row of ``q``), key: the k nearest ids of each query by brute force
    over all rows; the key names the id's best row."""
    dim = q.shape[1]
    q = q.astype(np.float64)

    def scan(batches):
        best = [(np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in q]
        floor = np.full(len(q), -np.inf)
        for b in batches:
            for a in range(0, b.num_rows, 4096):
                part = b.slice(a, 4096)
                ids, keys = part.column(0).to_numpy(), part.column(2).to_numpy()
                s = q @ _matrix(part.column(1), dim).astype(np.float64).T
                s[qid[:, None] == ids[None]] = -np.inf
                for j in range(len(q)):
                    c = np.flatnonzero((s[j] >= floor[j]) & (s[j] > -np.inf))
                    if not len(c):
                        continue
                    score, i, key = (np.concatenate(z) for z in zip(best[j], (s[j, c], ids[c], keys[c])))
                    order = np.lexsort((i, -score))
                    _, one = np.unique(i[order], return_index=True)
                    one = order[np.sort(one)[:k]]
                    best[j] = score[one], i[one], key[one]
                    floor[j] = score[one[-1]] if len(one) == k else -np.inf
        yield pa.record_batch([pa.array(np.repeat(np.arange(len(q)), [len(z[0]) for z in best])),
                               *(pa.array(np.concatenate([z[c] for z in best])) for c in (1, 2, 0))],
                              names=["query", "vec_id", "key", "score"])

    found = base.select("vec_id", "v", F.xxhash64("vec_id", "v").alias("key")).mapInArrow(
        scan, "query long, vec_id long, key long, score double")
    found = found.groupBy("query", "vec_id").agg(F.max(F.struct("score", "key")).alias("best"))
    by = Window.partitionBy("query").orderBy(F.desc("best.score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k).select("query", "best.key")


def fitted_ratio(centroids: Centroids, x: np.ndarray, size: np.ndarray, need: int, query: np.ndarray,
                 key: np.ndarray, lists: np.ndarray) -> float:
    """The smallest distance ratio at which the queries ``x`` read lists that hold
    ``RECALL`` of their true nearest, given as (query, key, a list that holds it)."""
    if not len(query):
        return 1.0
    d = centroids._distance(x, centroids.points)
    ratio = np.sqrt(d[query, lists] / np.maximum(d.min(1), NEAR)[query])
    _, one = np.unique(np.stack([query, key], 1), axis=0, return_inverse=True)
    one = one.reshape(-1)
    least = np.full(one.max() + 1, np.inf)
    np.minimum.at(least, one, ratio)
    least = np.sort(least)
    at = int(np.ceil(RECALL * len(least))) - 1
    while True:
        reach = max(1.0, float(least[at])) * (1 + 1e-5)
        read = np.zeros(d.shape, bool)
        read[centroids.lists_read(x, size, reach, need)[:2]] = True
        # the beam may miss a list: then the ratio grows
        if at == len(least) - 1 or len(np.unique(one[read[query, lists]])) >= RECALL * len(least):
            return reach
        at = min(len(least) - 1, at + max(1, len(least) // 100))


def nearest(vectors: DataFrame, queries: DataFrame | None = None, k: int = TOP, id_col: str = "vec_id",
            vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score. Queries are rows of (vec_id, embedding);
    by default those whose id is divisible by 20."""
    spark = vectors.sparkSession
    ship_code(spark)

    def clean(df: DataFrame) -> DataFrame:
        v = F.col(f"`{vector_col}`").cast("array<float>")
        ok = (F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
              & F.exists("v", lambda x: x != 0))
        return df.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), v.alias("v")).filter("vec_id is not null").filter(ok)

    base = clean(vectors)
    dims = base.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    dim = dims.dim if dims else 1
    base = materialize(base.filter(F.size("v") == dim).distinct(), "op8-vectors")   # repeated rows once
    asked = base.filter("vec_id % 20 = 0") if queries is None else clean(queries).filter(F.size("v") == dim)
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    stats = base.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("vec_id").alias("ids"), F.max(norm).alias("m")).first()
    n, top = stats.n, float(stats.m or 1.0)

    sample = base.orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(SAMPLE).select("v").toArrow()
    sample = _matrix(sample.column("v").combine_chunks(), dim) if n else np.ones((1, dim), np.float32)

    def lifted(x: np.ndarray) -> np.ndarray:
        x = x.astype(np.float32)
        rest = np.maximum(top - (x.astype(np.float64) ** 2).sum(1), 0)
        return np.concatenate([x, np.sqrt(rest)[:, None].astype(np.float32)], 1)

    def scaled(q: np.ndarray) -> np.ndarray:
        q64 = q.astype(np.float64)
        q64 *= np.sqrt(top) / np.sqrt((q64 ** 2).sum(1))[:, None]
        return np.concatenate([q64, np.zeros((len(q), 1))], 1).astype(np.float32)

    share = max(2, int(LIST_ROWS * len(sample) / max(n, 1)))
    centroids = Centroids(split_clusters(lifted(sample), share, MAX_LISTS))
    graph = spark.sparkContext.broadcast(centroids)

    def index(batches):
        g = graph.value
        for b in batches:
            for a in range(0, b.num_rows, 4 * SLICE):
                part = b.slice(a, 4 * SLICE)
                ids, d = g.search(lifted(_matrix(part.column(1), dim)))
                chosen = d <= (1 + BOUNDARY) ** 2 * d[:, :1] + NEAR
                chosen[:, REPLICAS:] = False
                row, col = np.nonzero(chosen)
                yield pa.record_batch([pa.array(ids[row, col]), part.column(0).take(pa.array(row)),
                                       part.column(1).take(pa.array(row))], names=["list", "vec_id", "v"])

    postings = materialize(base.mapInArrow(index, "list long, vec_id long, v array<float>"), "op8-postings")
    size = np.zeros(len(centroids.points), np.int64)
    for r in postings.groupBy("list").count().collect():   # at most MAX_LISTS
        size[r["list"]] = r["count"]
    need = 4 * (k + 1) * REPLICAS

    tried = asked.orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(max(CALIBRATION, BLOCK)).toArrow()
    reach = 1.0
    some = np.zeros((0, dim), np.float32)
    if tried.num_rows:
        some = _matrix(tried.column("v").combine_chunks(), dim)
        tried_id, tried = tried.column("vec_id").to_numpy()[:CALIBRATION], some[:CALIBRATION]
        held = postings.select("list", F.xxhash64("vec_id", "v").alias("key")).join(
            F.broadcast(true_nearest(base, tried, tried_id, k)), "key").toArrow()   # at most CALIBRATION * k * REPLICAS
        reach = fitted_ratio(centroids, scaled(tried), size, need, *(held.column(c).to_numpy() for c in ("query", "key", "list")))

    # lists in groups of about GROUP_ROWS rows; a longer list is a group of its own, in blocks of rows
    group = np.zeros(len(size), np.int64)
    held = 0
    for li in range(1, len(size)):
        held += size[li - 1]
        new = held + size[li] > GROUP_ROWS
        group[li] = group[li - 1] + new
        held = 0 if new else held
    row_blocks = np.maximum(1, -(-np.bincount(group, size) // (2 * GROUP_ROWS))).astype(np.int64)

    def search(asked: DataFrame, lists_of, count: int) -> DataFrame:
        """(query_id, vec_id, score) from the lists that ``lists_of`` names for
        (vec_id, v, floor) rows; scores below a query's floor stay out."""
        # of each group the queries that read it, from the sample of queries
        readers = np.zeros(len(size), np.int64)
        for a in range(0, len(some), 256):
            row, li = lists_of(scaled(some[a:a + 256]))
            readers += np.bincount(np.unique(row * len(size) + group[li]) % len(size), minlength=len(size))
        query_blocks = np.maximum(1, np.ceil(readers / max(1, len(some)) * count / BLOCK)).astype(np.int64)
        blocks = F.broadcast(spark.createDataFrame(pa.table({         # one row per list: at most MAX_LISTS
            "list": np.arange(len(size)), "g": group, "row_blocks": row_blocks[group], "query_blocks": query_blocks[group]})))

        def probe(batches):
            for b in batches:
                for a in range(0, b.num_rows, SLICE):
                    part = b.slice(a, SLICE)
                    q = _matrix(part.column(1), dim)
                    row, li = lists_of(scaled(q))
                    order = np.argsort(group[li], kind="stable")
                    row, li = row[order], li[order]
                    cuts = np.flatnonzero(np.diff(group[li], prepend=-1))
                    for r, ls in zip(np.split(row, cuts[1:]), np.split(li, cuts[1:])):
                        if not len(r):
                            continue
                        mine, at = np.unique(r, return_inverse=True)
                        take = part.take(pa.array(mine))
                        yield pa.record_batch(
                            [pa.array([group[ls[0]]], pa.int64()), pa.array([row_blocks[group[ls[0]]]], pa.int64()),
                             pa.array([abs(hash((int(mine[0]), take.column(0)[0].as_py(), a))) % int(query_blocks[group[ls[0]]])], pa.int64()),
                             *[pa.array([v], pa.list_(t)) for v, t in (
                                 (take.column(0).to_numpy(), pa.int64()), (q[mine].ravel(), pa.float32()),
                                 (take.column(2).to_numpy(), pa.float64()), (at, pa.int32()), (ls, pa.int32()))]],
                            names=["g", "rbs", "qb", "ids", "q", "floors", "at", "lists"])

        packed = asked.select("vec_id", "v", "floor").mapInArrow(
            probe, "g long, rbs long, qb long, ids array<long>, q array<float>, floors array<double>, at array<int>, lists array<int>")
        left = packed.withColumn("rb", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rbs") - 1))).drop("rbs")
        right = (postings.join(blocks, "list")
                 .withColumn("rb", F.pmod(F.xxhash64("vec_id", "v"), F.col("row_blocks")))
                 .withColumn("qb", F.explode(F.sequence(F.lit(0).cast("long"), F.col("query_blocks") - 1)))
                 .select("g", "rb", "qb", "list", "vec_id", "v"))
        keys = ["g", "rb", "qb"]
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(best, "query_id long, vec_id long, score double")

    def best(qt: pa.Table, vt: pa.Table) -> pa.Table:
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if qt.num_rows and vt.num_rows:
            ids, lists = vt.column("vec_id").to_numpy(), vt.column("list").to_numpy()
            order = np.lexsort((ids, lists))
            ids, lists = ids[order], lists[order]
            x = _matrix(vt.column("v").combine_chunks(), dim).astype(np.float64)[order]
            for p in range(qt.num_rows):
                qid, floor, at, wanted, q = (qt.column(c)[p].values.to_numpy() for c in ("ids", "floors", "at", "lists", "q"))
                q = q.astype(np.float64).reshape(-1, dim)
                by_list = np.argsort(wanted, kind="stable")
                at, wanted = at[by_list], wanted[by_list]
                cuts = np.flatnonzero(np.diff(wanted, prepend=-1))
                of_lists = []
                for rows, li in zip(np.split(at, cuts[1:]), wanted[cuts]):
                    lo, hi = np.searchsorted(lists, (li, li + 1))
                    if lo < hi:
                        of_lists.append(_hits(qid[rows], q[rows], floor[rows], ids[lo:hi], x[lo:hi], k))
                if of_lists:
                    found.append(_best_ids(*(np.concatenate(z) for z in zip(*of_lists)), k))
        return pa.table(dict(zip(("query_id", "vec_id", "score"), (np.concatenate(z) for z in zip(*found)))))

    def ranked(found: DataFrame) -> DataFrame:
        found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return (found.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)
                .select("query_id", "rank", "vec_id", "score"))

    def lists_between(least: float, most: float):
        """The lists that a query reads with ``least`` to ``most`` rows in nearer ones."""
        def lists_of(q: np.ndarray):
            row, li, before = graph.value.lists_read(q, size, reach, need)
            now = (before >= least) & (before < most)
            return row[now], li[now]
        return lists_of

    n_asked = asked.count()
    found, least, most = None, 0, need
    while least < size.sum():
        now = asked.withColumn("floor", F.lit(float("-inf")))
        if found is not None:
            floors = found.filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("floor"))
            now = asked.join(floors, "vec_id", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
        more = search(now, lists_between(least, most), n_asked)
        if found is not None:
            more = found.select("query_id", "vec_id", "score").unionByName(more)
        found = materialize(ranked(more), "op8-found")
        least, most = most, most * STEP
    if found is None:
        return ranked(spark.createDataFrame([], "query_id long, vec_id long, score double"))
    # an id with many vectors can fill a query's lists: such queries search all
    own = asked.select("vec_id").distinct().join(base.select("vec_id").distinct().withColumn("own", F.lit(1)), "vec_id", "left")
    whole = (own.join(found.groupBy(F.col("query_id").alias("vec_id")).count(), "vec_id", "left")
             .withColumn("want", F.least(F.lit(k), F.lit(stats.ids) - F.coalesce("own", F.lit(0))))
             .filter(F.coalesce("count", F.lit(0)) < F.col("want")).select("vec_id"))
    whole = materialize(whole, "op8-short")
    if whole.isEmpty():
        return found
    again = asked.join(whole, "vec_id", "left_semi").withColumn("floor", F.lit(float("-inf")))

    def all_lists(q: np.ndarray):
        row, li = np.nonzero(np.tile(size > 0, (len(q), 1)))
        return row, li
    again = ranked(search(again, all_lists, whole.count()))
    return found.join(whole.withColumnRenamed("vec_id", "query_id"), "query_id", "left_anti").unionByName(again)
