"""Operator 13: benchmark decontamination with suffix arrays of the training text.

The documents are packed into *shards* of about ``SHARD_BYTES``, one compressed
row each, written once and without a shuffle. The benchmark is the stated query
set: it comes in blocks of bounded size, each broadcast in turn. A task builds
the suffix array of one shard's words (prefix doubling; suffixes that hold a word
outside the block's vocabulary before the shortest window's end can't match and
are never sorted) and finds every test suffix by binary search, all suffixes at
once: the interval of the suffixes that start with its window gives all
locations, the neighbours of the place where the whole suffix would stand give
its longest verbatim match. A shard sends back its hit documents only: hit
spans, and the item lists, each distinct list once.

A window is ``window`` consecutive words of an item; an item of fewer words, but
not none, is one window. Words are compared as bytes.

Defined results: null texts have no words and are not contaminated; rows that
repeat an id are documents of their own, with the same values if their texts
agree; null ids are kept. Items that repeat an id count once in ``n_items``;
an item with a null id counts, its name is empty. Without items nothing is hit.
An empty table gives no rows; other columns are ignored. A document longer than
a shard is a shard of its own. Items over ``PIECE_WORDS`` are cut into pieces
that share ``window`` - 1 words, so no window is lost; their longest match ends
with the piece. ``longest_matches`` gives, of equally long matches, one.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, ship_code, text_chunks, text_of
from .terms import Block, item_blocks, places, terms_of

WINDOW = 10
SHARD_BYTES = 8 << 20
BLOCK_BYTES = 8 << 20
PIECE_WORDS = 1 << 20

_SPAN = "place int, first int, last int"
_BEST = "item string, words int, item_word int, place int, word int"


class Windows:
    """The distinct windows of a block and the items that hold them."""

    def __init__(self, block: Block, window: int) -> None:
        self.vocabulary = block.vocabulary
        self.words = block.words.astype(np.int64) + 1
        size = np.diff(block.off)
        n_windows = np.maximum(size - window + 1, 1)
        self.item = np.repeat(np.arange(len(size)), n_windows)
        inner = np.arange(len(self.item)) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows)
        self.item_word = inner
        self.start = block.off[self.item] + inner
        self.size = np.minimum(size, window)[self.item]
        self.left = size[self.item] - inner                       # words to the item's end
        # windows padded with zeros to one width: equal rows are equal windows
        at = self.start[:, None] + np.arange(window)
        grid = np.where(np.arange(window) < self.size[:, None], self.words[np.minimum(at, len(self.words) - 1)], 0)
        _, self.one, self.kind = np.unique(grid, axis=0, return_index=True, return_inverse=True)
        self.kind = self.kind.ravel()
        names = pa.array(block.ids).cast(pa.string()).to_pylist()
        self.names = [n or "" for n in names]
        order = np.argsort(self.kind, kind="stable")
        self.members = order                                      # windows by kind
        self.member_off = np.searchsorted(self.kind[order], np.arange(len(self.one) + 1))
        self.shortest = int(self.size.min())
        self.deepest = int(self.left.max())

    def items_of(self, kinds: np.ndarray) -> list[str]:
        """Names of the items that hold any of the windows, sorted as strings."""
        found = np.concatenate([self.item[self.members[self.member_off[k]:self.member_off[k + 1]]] for k in kinds])
        return sorted({self.names[i] for i in np.unique(found)})


class SuffixArray:
    """The suffixes of a shard's words that can start a window, sorted."""

    def __init__(self, words: np.ndarray, owner: np.ndarray, shortest: int, deepest: int) -> None:
        inside = words > 0
        edge = inside.copy()
        edge[1:] &= ~inside[:-1] | (owner[1:] != owner[:-1])
        first = np.flatnonzero(edge)
        run = np.cumsum(edge) - 1
        size = np.bincount(run[inside], minlength=len(first)) if len(first) else np.zeros(0, np.int64)
        long = size >= shortest
        first, size = first[long], size[long]
        # the long runs one after the other, a zero behind each
        total = int((size + 1).sum())
        begin = np.cumsum(size + 1) - (size + 1)
        self.text = np.zeros(total + 1, np.int64)
        self.origin = np.repeat(first - begin, size + 1) + np.arange(total)
        inner = np.ones(total, bool)
        inner[begin + size] = False
        self.text[:total][inner] = words[self.origin[inner]]
        left = np.repeat(begin + size, size + 1) - np.arange(total)
        rank, depth, n_ranks = self.text[:total].copy(), 1, -1
        while depth < deepest and total:
            then = np.zeros(total, np.int64)
            then[:-depth or None] = rank[depth:] if depth < total else 0
            values, rank = np.unique(rank * (int(rank.max()) + 2) + then, return_inverse=True)
            rank = rank.astype(np.int64) + 1
            if len(values) in (total, n_ranks):
                break
            n_ranks, depth = len(values), depth * 2
        start = np.flatnonzero(left >= shortest)
        self.order = start[np.argsort(rank[start], kind="stable")]

    def _against(self, at: np.ndarray, test: np.ndarray, start: np.ndarray, size: np.ndarray):
        """How each suffix compares with the first ``size`` words of a test suffix
        (-1, 0, 1), and how many words they share."""
        sign, same = np.zeros(len(at), np.int8), np.zeros(len(at), np.int64)
        live, d = np.arange(len(at)), 0
        while True:
            live = live[size[live] > d]
            if not len(live):
                return sign, same
            a, b = self.text[at[live] + d], test[start[live] + d]
            unlike = a != b
            sign[live[unlike]] = np.where(a[unlike] < b[unlike], -1, 1)
            live, d = live[~unlike], d + 1
            same[live] = d

    def bound(self, test: np.ndarray, start: np.ndarray, size: np.ndarray, upper: bool = False) -> np.ndarray:
        """Binary search: how many suffixes stand before each test prefix (with
        ``upper``, before or at it)."""
        lo, hi = np.zeros(len(start), np.int64), np.full(len(start), len(self.order), np.int64)
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                return lo
            mid = (lo[open_] + hi[open_]) >> 1
            sign, _ = self._against(self.order[mid], test, start[open_], size[open_])
            right = sign <= 0 if upper else sign < 0
            lo[open_[right]], hi[open_[~right]] = mid[right] + 1, mid[~right]

    def longest(self, test: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words and location of each test suffix's longest match."""
        place = self.bound(test, start, size)
        best, where = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
        for shift in (0, -1):
            near = np.clip(place + shift, 0, len(self.order) - 1)
            _, same = self._against(self.order[near], test, start, size)
            better = same > best
            best[better], where[better] = same[better], self.order[near][better]
        return best, where


def search_shard(w: Windows, data: np.ndarray, off: np.ndarray):
    """Hits of one shard: spans (place, first, last+1 word), the documents'
    places, which item list each has, the distinct lists, and per item its longest match."""
    found, owner = terms_of(data, off)
    words = places(found, w.vocabulary).astype(np.int64) + 1
    array = SuffixArray(words, owner, w.shortest, w.deepest)
    if not len(array.order):
        return None
    start, size = w.start[w.one], w.size[w.one]
    lo = array.bound(w.words, start, size)
    hi = array.bound(w.words, start, size, upper=True)
    count = hi - lo
    hit = np.flatnonzero(count)
    if not len(hit):
        return None
    kind = np.repeat(hit, count[hit])
    at = array.origin[array.order[np.arange(len(kind)) + np.repeat(lo[hit] - np.cumsum(count[hit]) + count[hit], count[hit])]]
    step = np.zeros(len(words) + 1, np.int64)
    np.add.at(step, at, 1)
    np.add.at(step, at + size[kind], -1)
    covered = np.cumsum(step[:-1]) > 0
    edge = covered.copy()
    edge[1:] &= ~covered[:-1] | (owner[1:] != owner[:-1])
    first = np.flatnonzero(edge)
    n = np.bincount((np.cumsum(edge) - 1)[covered], minlength=len(first))
    base = np.searchsorted(owner, np.arange(len(off) - 1))
    place = owner[first]
    spans = (place, first - base[place], first - base[place] + n)
    pairs = np.unique(owner[at] * len(w.one) + kind)              # each (document, window) once
    docs, kinds = pairs // len(w.one), pairs % len(w.one)
    cuts = np.flatnonzero(np.diff(docs, prepend=-1))
    codes, lists, known = [], [], {}
    for part in np.split(kinds, cuts[1:]):
        key = part.tobytes()
        if key not in known:
            known[key] = len(lists)
            lists.append(w.items_of(part))
        codes.append(known[key])
    tests = np.flatnonzero(count[w.kind] > 0)                     # test suffixes whose window occurs
    length, where = array.longest(w.words, w.start[tests], w.left[tests])
    order = np.lexsort((w.item_word[tests], -length, w.item[tests]))
    top = order[np.flatnonzero(np.diff(w.item[tests][order], prepend=-1))]
    spot = array.origin[where[top]]
    best = (([w.names[i] for i in w.item[tests][top]]), length[top], w.item_word[tests][top], owner[spot],
            spot - base[owner[spot]])
    return spans, docs[cuts], codes, lists, best


def pack_shards(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(shard, ids, lens, n_words, blob), a shard per row; a map without a shuffle."""
    src = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text_of(f"`{text_col}`").alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()

    def pack(batches):
        number = TaskContext.get().partitionId() << 32
        for b in batches:
            for a, data, off in text_chunks(b.column(1), SHARD_BYTES):
                _, owner = terms_of(data, off)
                n = len(off) - 1
                yield pa.record_batch(
                    [pa.array([number], pa.int64()),
                     pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), b.column(0).slice(a, n)),
                     pa.array([np.diff(off)], pa.list_(pa.int64())),
                     pa.array([np.bincount(owner, minlength=n)], pa.list_(pa.int64())),
                     pa.array([pa.compress(data.tobytes(), "zstd", asbytes=True)], pa.binary())],
                    names=["shard", "ids", "lens", "n_words", "blob"])
                number += 1

    return src.mapInArrow(pack, f"shard long, ids array<{kind}>, lens array<long>, n_words array<long>, blob binary")


def _struct_list(columns, names: str) -> pa.Array:
    """One list holding a struct per entry of the parallel columns."""
    fields = [f.split() for f in names.split(", ")]
    kinds = {"int": pa.int32(), "string": pa.string()}
    arrays = [pa.array(c, kinds[t]) for c, (_, t) in zip(columns, fields)]
    rows = pa.StructArray.from_arrays(arrays, names=[n for n, _ in fields])
    return pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows)


def _hits(shards: DataFrame, block: Block, window: int) -> DataFrame:
    shared = shards.sparkSession.sparkContext.broadcast(block)

    def run(batches):
        w = Windows(shared.value, window)
        for b in batches:
            for i in range(b.num_rows):
                lens = np.array(b.column(1)[i].as_py(), np.int64)
                off = np.concatenate([[0], np.cumsum(lens)])
                raw = pa.decompress(b.column(2)[i].as_py(), int(off[-1]), "zstd", asbytes=True) if off[-1] else b""
                got = search_shard(w, np.frombuffer(raw, np.uint8), off)
                if got is None:
                    continue
                spans, docs, codes, lists, best = got
                yield pa.record_batch(
                    [b.column(0).slice(i, 1), _struct_list(spans, _SPAN), pa.array([docs], pa.list_(pa.int32())),
                     pa.array([codes], pa.list_(pa.int32())), pa.array([lists], pa.list_(pa.list_(pa.string()))),
                     _struct_list(best, _BEST)], names=["shard", "spans", "docs", "codes", "lists", "best"])

    def typed(fields: str) -> str:
        return "array<struct<" + fields.replace(" ", ":").replace(",:", ",") + ">>"

    return shards.select("shard", "lens", "blob").mapInArrow(
        run, f"shard long, spans {typed(_SPAN)}, docs array<int>, codes array<int>, lists array<array<string>>, "
             f"best {typed(_BEST)}")


def _searched(docs: DataFrame, items: DataFrame, window: int, id_col: str, text_col: str,
              item_id: str, item_text: str) -> tuple[DataFrame, DataFrame]:
    """The shards, and their hits of every block of the benchmark, both written."""
    if window < 1:
        raise ValueError("a window has one word at least")
    ship_code(docs.sparkSession)
    shards = materialize(pack_shards(docs, id_col, text_col), "op13-shards")
    hits = None
    for block in item_blocks(items, item_id, item_text, BLOCK_BYTES, "op13", PIECE_WORDS, window - 1):
        found = materialize(_hits(shards, block, window), "op13-hits")
        hits = found if hits is None else hits.unionByName(found)
    return shards, hits


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, id_col: str = "doc_id",
                  text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated and
    hit_spans (first and last+1 word of each maximal run); one row per document."""
    shards, hits = _searched(docs, items, window, id_col, text_col, item_id, item_text)
    rows = shards.select("shard", "ids", "n_words")
    if hits is None:
        rows = rows.withColumn("hits", F.lit(None).cast("array<struct<spans:array<struct<place:int,first:int,last:int>>,"
                                                        "docs:array<int>,codes:array<int>,lists:array<array<string>>>>"))
    else:
        grouped = hits.groupBy("shard").agg(F.collect_list(F.struct("spans", "docs", "codes", "lists")).alias("hits"))
        rows = rows.join(grouped, "shard", "left")
    kind = docs.schema[id_col].dataType.simpleString()
    none = hashlib.sha256(b"").hexdigest()

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                ids, n_words = b.column("ids").slice(i, 1).flatten(), b.column("n_words")[i].as_py()
                spans, lists = {}, {}
                for h in b.column("hits")[i].as_py() or ():
                    for s in h["spans"]:
                        spans.setdefault(s["place"], []).append((s["first"], s["last"]))
                    for d, c in zip(h["docs"], h["codes"]):
                        lists.setdefault(d, []).append(h["lists"][c])
                digests, out = {}, []
                for d, n in enumerate(n_words):
                    if d not in lists:
                        out.append((n, 0, 0, none, False, []))
                        continue
                    key = tuple(map(id, lists[d]))
                    if key not in digests:
                        names = lists[d][0] if len(lists[d]) == 1 else sorted(set().union(*lists[d]))
                        digests[key] = len(names), hashlib.sha256(",".join(names).encode()).hexdigest()
                    runs = []
                    for x, y in sorted(spans[d]):
                        if runs and x <= runs[-1][1]:
                            runs[-1][1] = max(runs[-1][1], y)
                        else:
                            runs.append([x, y])
                    out.append((n, sum(y - x for x, y in runs), *digests[key], True, runs))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.list_(pa.list_(pa.int32())))
                yield pa.record_batch([ids, *[pa.array([r[j] for r in out], t) for j, t in enumerate(kinds)]],
                                      names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated",
                                             "hit_spans"])

    return rows.mapInArrow(run, f"doc_id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, "
                                "contaminated boolean, hit_spans array<array<int>>")


def longest_matches(docs: DataFrame, items: DataFrame, window: int = WINDOW, id_col: str = "doc_id",
                    text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """item, words, item_word, doc_id, word: each occurring item's longest
    verbatim match, where it starts in the item and where in which document."""
    shards, hits = _searched(docs, items, window, id_col, text_col, item_id, item_text)
    if hits is None:
        kind = docs.schema[id_col].dataType.simpleString()
        return docs.sparkSession.createDataFrame([], f"item string, words int, item_word int, doc_id {kind}, word int")
    best = (hits.select("shard", F.inline("best"))
            .groupBy("item").agg(F.max_by(F.struct("shard", "words", "item_word", "place", "word"),
                                          F.struct("words", -F.col("shard"))).alias("b")).select("item", "b.*"))
    names = shards.select("shard", F.posexplode("ids").alias("place", "doc_id"))
    return best.join(names, ["shard", "place"]).select("item", "words", "item_word", "doc_id", "word")


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, id_col: str = "doc_id",
                  text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents without the affected ones, all columns kept; rows that share
    an affected row's id go with it."""
    gone = contamination(docs, items, window, id_col, text_col, item_id, item_text).where("contaminated")
    gone = gone.select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, F.col(f"`{id_col}`").eqNullSafe(F.col("__gone")), "left_anti")
