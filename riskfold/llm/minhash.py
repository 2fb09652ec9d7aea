"""Operator 5: near-duplicate detection with bottom-k sketches of one hash.

1. Every text becomes the set of its distinct word shingles, as 64-bit hashes;
   a sketch is the set's ``K`` smallest values. Texts with equal sets are one
   *class* from here on, so copies cost nothing further.
   Sets of up to ``SHORT`` values meet partners that differ in at most two values
   by what is left of them without one or two of their own: exact, at most 92
   rows a class and one link a row, however many short texts look alike. Smaller
   sets than ``DELETED`` have no other partners and enter nothing further.
2. Inverted lists of retained values: two sets with similarity >= 0.8 share at
   least ``overlap_floor`` of their retained values (all of 0.8 n for sets that
   are retained whole; for larger ones but for a chance of ``MISS`` a link,
   from the sketch of their union). So each class enters only the lists of its
   rarest values, as many as it takes to meet every such partner. Values that a
   large part of the corpus shares are entered only where a class has hardly
   any others.
3. Candidates of a list: first every member against two pivots, one of them the most central, of the
   list (linear in the list's length); the links found are closed to components.
   Then the members of a list that are still in different components meet, so
   no link is lost, and a group of thousands of near copies, which a pivot has
   joined, gives no further pairs. Members of lists longer than ``LONG_LIST``
   that are apart are first listed anew by their full sets, where the bounds on
   what two sets can share are exact and leave few to compare; sets of up to
   ``PAIRED`` values are then listed by pairs of rare values, of which linked ones
   share one.
4. Bitmaps of 32 bytes drop candidates that have too little in common (exact bound:
   bits that differ stand for values that differ), so that sketches are fetched for
   likely pairs only. The sketch of the union filters these, bitmaps of the full sets
   what is left, and the full sets confirm.
5. Connected components by minimum labels.

Defined results: null or wordless texts have an empty set, are their own
component and are kept; texts shorter than a shingle have their whole word
sequence as the only one. Null ids count as largest in a component (a
component of null ids only has a null id and all of them are kept). Repeated rows get the same values.
An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, long_of, materialize, mix64, releasing, settings, ship_code, text_chunks, tidy, word_table
from .components import components

K = 64
#: Chance that the union sketch of a linked pair holds fewer shared values than the floor.
MISS = 1e-8
SIMILARITY = 80      # percent
#: Spark's runtime Bloom filter of wanted keys, at every input and list size.
BLOOM = {"spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
         "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0",
         "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "1t"}
#: Its size: bits a wanted key, and 1 MB at most.
KEY_BITS, MOST_BITS = 16, 1 << 23
#: Lists up to this length compare what is apart by sketches; the members of
#: longer ones are listed anew by their full sets.
LONG_LIST = 64
#: Similar sets differ in at most a quarter of what they share, so sets that share
#: fewer than 12 values differ in at most two: smaller sets than this have no other
#: partners, and those have at most ``SHORT`` values.
DELETED, SHORT = 12, 13
#: Long lists: sets up to this size are listed by pairs of values; those too small
#: for a larger partner (80% of 65 values) are listed by pairs only.
PAIRED = 64
#: A sketch length that retains sets whole.
WHOLE = 1 << 30
#: 64-bit words of a full set's bitmap, and of a sketch's.
BIT_WORDS, SIGN_WORDS = 16, 4


@functools.lru_cache(16)
def overlap_floor(k: int, percent: int = SIMILARITY, miss: float = MISS) -> int:
    """The largest c with P(Binomial(k, percent/100) < c) <= miss."""
    p, total = percent / 100, 0.0
    for c in range(k + 1):
        total += math.comb(k, c) * p ** c * (1 - p) ** (k - c)
        if total > miss:
            return c
    return k


def shingle_sets(data: np.ndarray, off: np.ndarray, width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    _, _, rows, h = word_table(data, off)
    n = len(off) - 1
    m = len(h) - width + 1
    if m > 0:
        x = mix64(h[:m] + np.uint64(0x632BE59BD9B4E019))
        for j in range(1, width):
            x = mix64(x * np.uint64(0x9FB21C651E98DF25) + h[j:m + j])
        whole = rows[:m] == rows[width - 1:]
        x, at = x[whole], rows[:m][whole]
    else:
        x, at = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    cuts = np.searchsorted(at, np.arange(n + 1))
    words = np.searchsorted(rows, np.arange(n + 1))
    out = []
    for i in range(n):
        if cuts[i + 1] > cuts[i]:
            out.append(np.unique(x[cuts[i]:cuts[i + 1]]))
        elif words[i + 1] > words[i]:
            y = np.uint64(words[i + 1] - words[i])
            for z in h[words[i]:words[i + 1]]:
                y = mix64(np.array([y * np.uint64(0xE7037ED1A0B428DB) + z], np.uint64))[0]
            out.append(np.array([y], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _signature(s: np.ndarray) -> int:
    """64 bits that name a set: the mixed sum of its mixed values and its size."""
    if not len(s):
        return 0
    return int(mix64(np.array([np.add.reduce(mix64(s)) + np.uint64(len(s))], np.uint64)).view(np.int64)[0])


def _lists(sets: list[np.ndarray]) -> pa.Array:
    off = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
    return pa.ListArray.from_arrays(off, long_of(np.concatenate(sets)) if sets else np.zeros(0, np.int64))


def _bitmaps(sets: list[np.ndarray], words: int) -> list[pa.Array]:
    """Bitmaps of the sets, by 64-bit word: every value sets one bit."""
    bits = np.zeros((len(sets), words), np.uint64)
    if sets:
        flat = np.concatenate(sets)
        rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        np.bitwise_or.at(bits, (rows, (flat >> np.uint64(6)) % np.uint64(words)),
                         np.uint64(1) << (flat & np.uint64(63)))
    return [pa.array(long_of(np.ascontiguousarray(bits[:, w]))) for w in range(words)]


def _words(prefix: str, words: int) -> list[str]:
    return [f"{prefix}{w}" for w in range(words)]


def _differ(a: str, b: str, names: list[str]):
    """How many bits of two bitmaps differ: at most as many as values, of which one set has none."""
    return sum((F.bit_count(F.col(f"{a}.{c}").bitwiseXOR(F.col(f"{b}.{c}"))) for c in names), F.lit(0))


def sketches(docs: DataFrame, width: int, k: int) -> DataFrame:
    """doc_id, text_key, node (the set's name), n (its size), sketch and its bitmap (sign0, ...)."""
    signs = _words("sign", SIGN_WORDS)

    def run(batches):
        with np.errstate(over="ignore"):
            for b in batches:
                for a, data, off in text_chunks(b.column(2)):
                    sets = shingle_sets(data, off, width)
                    least = [s[:k] for s in sets]
                    yield pa.record_batch([b.column(0).slice(a, len(sets)), b.column(1).slice(a, len(sets)),
                                           pa.array([_signature(s) for s in sets], pa.int64()),
                                           pa.array([len(s) for s in sets], pa.int64()),
                                           _lists(least), *_bitmaps(least, SIGN_WORDS)],
                                          names=["doc_id", "text_key", "node", "n", "sketch", *signs])

    kind = docs.schema["doc_id"].dataType.simpleString()
    docs = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    return docs.mapInArrow(releasing(run), f"doc_id {kind}, text_key long, node long, n long, sketch array<long>, "
                           + ", ".join(f"{c} long" for c in signs))


def full_sets(docs: DataFrame, width: int) -> DataFrame:
    """node, n, members (the whole sorted set) and its bitmap (bits0, ...)."""
    bits = _words("bits", BIT_WORDS)

    def run(batches):
        with np.errstate(over="ignore"):
            for b in batches:
                for _, data, off in text_chunks(b.column(0)):
                    sets = shingle_sets(data, off, width)
                    yield pa.record_batch([pa.array([_signature(s) for s in sets], pa.int64()),
                                           pa.array([len(s) for s in sets], pa.int64()), _lists(sets),
                                           *_bitmaps(sets, BIT_WORDS)], names=["node", "n", "members", *bits])

    return docs.select("text").mapInArrow(releasing(run), "node long, n long, members array<long>, "
                                          + ", ".join(f"{c} long" for c in bits))


def short_links(classes: DataFrame) -> DataFrame:
    """Links (a, b) that join every two similar sets of up to ``SHORT`` values, which
    sketches hold whole, to one component. ``core`` is what is left of a set without
    none, one or two (``gone``) of its values. Similar are: a core of four or more
    values and the sets of one more; from eight on also the sets of two more, and
    the sets of one more among themselves. All of a core's sets are linked with the
    core itself if it is a set, and otherwise with the first of one more."""
    s = F.col("sketch")
    without = lambda x: F.array_remove(s, x)
    none = F.array(F.struct(F.lit(0).alias("gone"), s.alias("core")))
    one = F.transform(s, lambda x: F.struct(F.lit(1).alias("gone"), without(x).alias("core")))
    two = F.flatten(F.transform(s, lambda x: F.transform(
        F.filter(s, lambda y: y > x), lambda y: F.struct(F.lit(2).alias("gone"), F.array_remove(without(x), y).alias("core")))))
    cores = (classes.filter((F.col("n") >= 4) & (F.col("n") <= SHORT))
             .select("node", F.explode(F.when(F.col("n") >= 10, F.concat(none, one, two))
                                       .when(F.col("n") >= 5, F.concat(none, one)).otherwise(none)).alias("c"))
             .select("node", "c.gone", "c.core"))
    centre = (cores.groupBy("core").agg(
        F.max(F.when(F.col("gone") == 0, F.col("node"))).alias("itself"),
        F.min(F.when((F.col("gone") == 1) & (F.size("core") >= 8), F.col("node"))).alias("first"),
        F.count(F.lit(1)).alias("members"))
        .filter((F.col("members") > 1) & F.coalesce("itself", "first").isNotNull()))
    return (cores.join(centre, "core").filter(F.col("itself").isNotNull() | (F.col("gone") == 1))
            .select(F.coalesce("itself", "first").alias("a"), F.col("node").alias("b"))
            .filter("a <> b").distinct())


def posting_lists(classes: DataFrame, k: int, scratch: Scratch | None = None) -> DataFrame:
    """(value, node, n, free, central): the lists that each class enters.
    With ``scratch`` the counts of values are written first and their shuffle files dropped.
    ``free`` counts the retained values that another class retains too;
    ``central`` says how often the corpus has them, so that of a group of near
    copies the one with the fewest changes of its own has most."""
    values = classes.select("node", F.explode("sketch").alias("value"))
    shared = values.groupBy("value").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    if scratch is not None:
        shared = scratch.keep(shared, "op5-shared")
        tidy(classes.sparkSession)
    least = F.ceil(F.col("n") * SIMILARITY / 100)
    if k < WHOLE:
        least = F.when(F.col("n") * SIMILARITY <= k * SIMILARITY * SIMILARITY / 100, least).otherwise(F.lit(overlap_floor(k)))
    sizes = classes.select("node", "n", *[c for c in classes.columns if c.startswith("bits")])
    # values that no other class retains come first in rarity and need no list; a class has few values in a
    # task that goes by value, so they are shuffled as they are and gathered afterwards
    ranked = (values.join(shared, "value").repartition("node").groupBy("node")
              .agg(F.sort_array(F.collect_list(F.struct("c", "value"))).alias("by_rarity"))
              .join(sizes, "node").withColumn("free", F.size("by_rarity"))
              .withColumn("places", (F.col("free") - least + 1).cast("int"))
              .filter("places > 0")
              .withColumn("central", F.aggregate("by_rarity", F.lit(0).cast("long"), lambda a, x: a + x.c)))
    bits = [c for c in classes.columns if c.startswith("bits")]
    placed = lambda rows: (
        rows.select("*", F.posexplode(F.slice("by_rarity", F.lit(1), F.col("places"))).alias("at", "e"))
        .select(F.col("e.value").alias("value"), "node", "n", "free", "central",
                *([F.transform(F.slice("by_rarity", F.lit(1), F.col("at")), lambda x: x.value).alias("before"), *bits]
                  if k >= WHOLE else [])))
    if k < WHOLE:
        return placed(ranked)
    # similar sets share two values of their places and one more (they share at least two, so all places but
    # the last hold one): a list for each two of them
    first = F.transform(F.slice("by_rarity", F.lit(1), F.col("places") + 1), lambda x: x.value)
    twos = F.flatten(F.transform(first, lambda x, i: F.transform(
        F.slice(first, i + 2, F.size(first)), lambda y: F.xxhash64(x, y))))
    paired = (ranked.filter(F.col("n") <= PAIRED)
              .select(F.explode(twos).alias("value"), "node", "n", "free", "central",
                      F.array().cast("array<long>").alias("before"), *bits))
    return placed(ranked.filter(F.col("n") * 100 > PAIRED * SIMILARITY)).unionByName(paired)


def _alike(a: str, b: str, k: int):
    """Sizes of sets that can be linked; of sets retained whole also by what
    they share with any other and by their bitmaps."""
    size = lambda x, c: F.col(f"{x}.{c}")
    ok = F.least(size(a, "n"), size(b, "n")) * 100 >= F.greatest(size(a, "n"), size(b, "n")) * SIMILARITY
    if k >= WHOLE:
        total = size(a, "n") + size(b, "n")
        ok &= F.least(size(a, "free"), size(b, "free")) * (100 + SIMILARITY) >= total * SIMILARITY
        # bits that differ stand for values of which one set has none
        ok &= _differ(a, b, _words("bits", BIT_WORDS)) * (100 + SIMILARITY) <= total * (100 - SIMILARITY)
        # a pair meets in the first list that both enter
        ok &= ~F.arrays_overlap(size(a, "before"), size(b, "before"))
    return ok


def _member(k: int):
    """What a list's row tells of a class."""
    return ["node", "n", "free", *(["before", *_words("bits", BIT_WORDS)] if k >= WHOLE else [])]


def pivot_pairs(lists: DataFrame, k: int) -> DataFrame:
    """Every member against its list's pivots: the most central one and any other."""
    me = F.struct(*_member(k))
    # the member follows what it is chosen by in one struct, which is half the state of max_by
    pivot = lists.groupBy("value").agg(F.max(F.struct("central", *_member(k))).alias("p0"),
                                       F.min(F.struct(F.xxhash64("node").alias("h"), *_member(k))).alias("p1"))
    pivot = pivot.select("value", F.explode(F.array_distinct(F.array(
        F.col("p0").dropFields("central"), F.col("p1").dropFields("h")))).alias("p"))
    return (lists.select("value", me.alias("x")).join(pivot, "value")
            .filter((F.col("x.node") != F.col("p.node")) & _alike("x", "p", k))
            .select(F.col("p.node").alias("a"), F.col("x.node").alias("b")).distinct())


def apart(lists: DataFrame, label: DataFrame) -> DataFrame:
    """The lists whose members are in several components, with their length."""
    member = lists.drop("central").join(label, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    mixed = (member.groupBy("value").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("length"))
             .filter("lo <> hi").select("value", "length"))
    return member.join(mixed, "value")


def cross_pairs(member: DataFrame, k: int) -> DataFrame:
    """Members of a list that are in different components."""
    me = F.struct(*_member(k), "comp")
    return (member.select("value", me.alias("x")).join(member.select("value", me.alias("y")), "value")
            .filter((F.col("x.node") < F.col("y.node")) & (F.col("x.comp") != F.col("y.comp")) & _alike("x", "y", k))
            .select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct())


def _close(pairs: DataFrame, maps: DataFrame, most) -> DataFrame:
    """Pairs (a, b) whose bitmaps in ``maps`` (node, m, words) differ in ``most(m of both)`` bits at most."""
    names = [c for c in maps.columns if c not in ("node", "m")]
    side = lambda x: maps.select(F.col("node").alias(x), F.struct("m", *names).alias(f"x{x}"))
    return (pairs.join(side("b"), "b").join(side("a"), "a")
            .filter(_differ("xa", "xb", names) <= most(F.col("xa.m") + F.col("xb.m"))).select("a", "b"))


def _signed(pairs: DataFrame, classes: DataFrame, k: int) -> DataFrame:
    """Pairs (a, b) that ``_filtered`` may keep, by the bitmaps of their sketches. It asks
    for 80% of the union in both, or ``overlap_floor`` values if the union has ``k``."""
    maps = classes.select("node", F.least("n", F.lit(k)).alias("m"), *_words("sign", SIGN_WORDS))
    return _close(pairs, maps, lambda total: F.greatest(total * ((100 - SIMILARITY) / (100 + SIMILARITY)) + 1e-6,
                                                        (total - 2 * overlap_floor(k)).cast("double")))


def _alike_in_full(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) that ``_confirmed`` may keep, by the bitmaps of their full sets."""
    maps = sets.select("node", F.col("n").alias("m"), *_words("bits", BIT_WORDS))
    return _close(pairs, maps, lambda total: total * ((100 - SIMILARITY) / (100 + SIMILARITY)) + 1e-6)


def _filtered(pairs: DataFrame, classes: DataFrame, k: int) -> DataFrame:
    """Pairs (a, b) whose union sketch holds enough shared values. ``a`` may be
    a pivot of many pairs; skewed joins are split."""
    s = classes.select("node", "sketch")
    # the filter, which holds for all, tells the optimizer that the pairs select (``_bloom``)
    both = (pairs.filter("a <> b").join(s.select(F.col("node").alias("b"), F.col("sketch").alias("sb")), "b")
            .join(s.select(F.col("node").alias("a"), F.col("sketch").alias("sa")), "a"))
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, k)
    size = F.size("u")
    both = both.withColumn("u", union).withColumn(
        "shared", F.size(F.array_intersect(F.col("u"), F.array_intersect("sa", "sb"))))
    return both.filter(F.when(size < k, F.col("shared") * 100 >= size * SIMILARITY)
                       .otherwise(F.col("shared") >= overlap_floor(k))).select("a", "b")


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) whose full sets are linked."""
    both = (pairs.filter("a <> b").join(sets.select(F.col("node").alias("b"), F.col("members").alias("mb")), "b")
            .join(sets.select(F.col("node").alias("a"), F.col("members").alias("ma")), "a"))
    inter = F.size(F.array_intersect("ma", "mb"))
    return (both.withColumn("i", inter)
            .filter(F.col("i") * 100 >= (F.size("ma") + F.size("mb") - F.col("i")) * SIMILARITY)
            .select("a", "b"))


def _bloom(wanted: DataFrame) -> dict[str, str]:
    """``BLOOM`` sized by the rows of ``wanted``, a written table of keys or pairs: the driver
    holds every filter whole, as a result, in the plan and in the tasks of its stages."""
    rows = max(1, wanted.count())
    bits = min(MOST_BITS, 1 << (KEY_BITS * rows - 1).bit_length())
    return BLOOM | {"spark.sql.optimizer.runtime.bloomFilter.expectedNumItems": str(rows),
                    "spark.sql.optimizer.runtime.bloomFilter.numBits": str(bits)}


def _sets_of(rows: DataFrame, reps: DataFrame, width: int, scratch: Scratch) -> DataFrame:
    """node, members of the classes that ``reps`` (id and text key, set size n)
    stand for. The texts are joined with the list of wanted ones; a Bloom filter
    of the list (``_bloom``) keeps most others out of the shuffle."""
    key = lambda i, t: F.concat_ws("|", i.cast("string"), t.cast("string"))
    wanted = scratch.keep(reps.select(key(F.col("rep.doc_id"), F.col("rep.text_key")).alias("key"), "n"), "op5-wanted")
    texts = rows.select(key(F.col("doc_id"), F.xxhash64("text")).alias("key"), "text")
    # the filter on n tells the optimizer that the list selects
    texts = texts.join(wanted.filter("n > 0"), "key", "left_semi").dropDuplicates(["key"])
    with settings(rows.sparkSession, _bloom(wanted)):
        return scratch.keep(full_sets(texts, width), "op5-sets")


def near_duplicates(docs: DataFrame, width: int = 2, id_col: str = "doc_id", text_col: str = "text",
                    k: int = K) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, text_key (a hash of the text);
    one row per document."""
    spark = docs.sparkSession
    ship_code(spark)
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    scratch = Scratch()
    sketched = Scratch()
    t1 = sketched.keep(sketches(rows, width, k), "op5-sketches")
    classes = scratch.keep(t1.filter("n > 0").groupBy("node")
                           .agg(F.min(F.struct("doc_id", "text_key")).alias("rep"), F.first("n").alias("n"),
                                F.first("sketch").alias("sketch"), F.min("doc_id").alias("least"),
                                *[F.first(c).alias(c) for c in _words("sign", SIGN_WORDS)]), "op5-classes")
    # documents need their class's name from here on, and only classes their sketches
    t1 = materialize(t1.select("doc_id", "text_key", "node", "n"), "op5-documents")
    sketched.free(spark)
    tidy(spark)
    short = k >= SHORT
    links = scratch.keep(short_links(classes), "op5-links") if short else None
    lists = scratch.keep(posting_lists(classes.filter(F.col("n") >= DELETED) if short else classes, k, scratch), "op5-lists")
    tidy(spark)
    sets = None

    def sets_for(nodes: DataFrame) -> DataFrame:
        """The full sets made so far, with those of new nodes."""
        nonlocal sets
        if sets is not None:
            nodes = nodes.join(sets.select("node"), "node", "left_anti")
        more = _sets_of(rows, nodes.join(classes, "node").select("rep", "n"), width, scratch)
        sets = more if sets is None else sets.unionByName(more)
        tidy(spark)
        return sets

    def confirm(pairs: DataFrame) -> DataFrame:
        """Links among candidate pairs: by the sketch of the union, then in full, each after its bitmaps."""
        near = scratch.keep(_signed(pairs, classes, k), "op5-near")
        tidy(spark)
        with settings(spark, _bloom(near)):
            likely = scratch.keep(_filtered(near, classes, k), "op5-pairs")
        tidy(spark)
        first = sets is None
        full = sets_for(likely.select(F.explode(F.array("a", "b")).alias("node")).distinct())
        return confirm_in_full(scratch.keep(_alike_in_full(likely, full), "op5-near"), full, first)

    def confirm_in_full(pairs: DataFrame, full: DataFrame, most: bool = False) -> DataFrame:
        """``most``: the pairs need most of the sets, so one shuffle of them all serves both sides."""
        with settings(spark, {} if most else _bloom(pairs)):
            found = scratch.keep(_confirmed(pairs, full), "op5-links")
        tidy(spark)
        return found

    def label_of(found: DataFrame) -> DataFrame:
        out = scratch.keep(components(found).select("node", F.col("component").alias("comp")), "op5-labels")
        tidy(spark)
        return out

    found = confirm(pivot_pairs(lists, k))
    links = links.unionByName(found) if short else found
    label = label_of(links)
    member = scratch.keep(apart(lists, label), "op5-apart")
    tidy(spark)
    links = links.unionByName(confirm(cross_pairs(member.filter(F.col("length") <= LONG_LIST), k)))
    # long lists: their members again, listed by their full sets, where every bound is exact
    crowd = scratch.keep(member.filter(F.col("length") > LONG_LIST).groupBy("node").agg(F.max("length").alias("length")),
                         "op5-crowd-nodes")
    full = sets_for(crowd.select("node"))
    with settings(spark, _bloom(crowd)):
        crowd = scratch.keep(full.join(crowd.filter("length > 0"), "node", "left_semi")
                             .withColumnRenamed("members", "sketch"), "op5-crowd")
    tidy(spark)
    lists = scratch.keep(posting_lists(crowd, WHOLE), "op5-crowd-lists")
    links = links.unionByName(confirm_in_full(scratch.keep(pivot_pairs(lists, WHOLE), "op5-pairs"), full))
    label = label_of(links)
    member = scratch.keep(apart(lists, label), "op5-apart")
    last = confirm_in_full(scratch.keep(cross_pairs(member, WHOLE), "op5-pairs"), full)
    if not last.isEmpty():
        label = label_of(links.unionByName(last))

    # smallest id of each component
    least = (label.join(classes.select("node", "least"), "node")
             .groupBy("comp").agg(F.min("least").alias("lowest")))
    named = label.join(least, "comp").select("node", "lowest")
    named = classes.select("node", "least").join(named, "node", "left") \
        .select("node", F.coalesce("lowest", "least").alias("component_id"))
    named = materialize(named, "op5-components")
    out = t1.select("doc_id", "text_key", "node", F.col("n").alias("n_shingles")).join(
        named.select(F.col("node").alias("c"), "component_id"),
        (F.col("node") == F.col("c")) & (F.col("n_shingles") > 0), "left")
    out = out.withColumn("component_id", F.when(F.col("n_shingles") == 0, F.col("doc_id"))
                         .otherwise(F.col("component_id")))
    scratch.free(spark)
    return out.select("doc_id", "n_shingles", "component_id", F.expr("doc_id <=> component_id").alias("kept"),
                      "text_key")


def near_survivors(docs: DataFrame, width: int = 5, id_col: str = "doc_id", text_col: str = "text",
                   k: int = K) -> DataFrame:
    """The rows of ``docs`` that stay, all columns as they are: of a component
    the row with the smallest id. Rows are told apart by id and text, so rows
    that repeat both stay or go together."""
    gone = (near_duplicates(docs, width, id_col, text_col, k).filter(~F.col("kept"))
            .select(F.col("doc_id").alias("_op5_gone"), F.col("text_key").alias("_op5_key")).distinct())
    return docs.join(gone, F.col(f"`{id_col}`").eqNullSafe(F.col("_op5_gone"))
                     & (F.xxhash64(F.col(f"`{text_col}`").cast("string")) == F.col("_op5_key")), "left_anti")
