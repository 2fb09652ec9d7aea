"""Near duplicates among short texts, which share most of their words: links
against brute force, and rows that grow with the texts and not with their pairs."""

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskfold.llm import minhash
from riskfold.llm.common import ship_code

from .test_operators import brute_components


def lines(n, words, vocabulary, seed, changed=0.6):
    """Random texts, and texts that drop, add or change a few words of an earlier one."""
    rng = np.random.default_rng(seed)
    names = [f"w{i}" for i in range(vocabulary)]
    out = []
    for i in range(n):
        if out and rng.random() < changed:
            t = out[int(rng.integers(len(out)))].split()
            for _ in range(int(rng.integers(1, 3))):
                at = int(rng.integers(len(t) + 1))
                t[at:at + int(rng.integers(2))] = [str(rng.choice(names))] * int(rng.integers(2))
            t = t or ["w0"]
        else:
            t = rng.choice(names, int(rng.integers(words[0], words[1] + 1))).tolist()
        out.append(" ".join(map(str, t)))
    return out


@pytest.mark.parametrize("words,vocabulary,long_list", [((1, 17), 4, 64), ((10, 18), 40, 64), ((12, 70), 30, 1)])
def test_random_lines(spark, monkeypatch, words, vocabulary, long_list):
    monkeypatch.setattr(minhash, "LONG_LIST", long_list)
    rows = list(enumerate(lines(260, words, vocabulary, vocabulary)))
    rows += [(7, rows[3][1]), (None, rows[5][1]), (900, None), (901, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = minhash.near_duplicates(docs, 2).collect()
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(rows, 2)


def test_short_links_are_complete_and_few(spark):
    rng = np.random.default_rng(1)
    sets = {tuple(sorted(rng.choice(16, int(rng.integers(1, 14)), replace=False).tolist())) for _ in range(700)}
    sets = sorted(sets)
    classes = spark.createDataFrame([(i, len(s), list(s)) for i, s in enumerate(sets)], "node long, n long, sketch array<long>")
    links = [(r.a, r.b) for r in minhash.short_links(classes).collect()]

    def roots(pairs):
        group = list(range(len(sets)))

        def top(x):
            while group[x] != x:
                x = group[x]
            return x
        for a, b in pairs:
            group[max(top(a), top(b))] = min(top(a), top(b))
        return [top(x) for x in range(len(sets))]

    similar = [(a, b) for a in range(len(sets)) for b in range(a)
               if 100 * len(set(sets[a]) & set(sets[b])) >= 80 * len(set(sets[a]) | set(sets[b]))]
    assert roots(links) == roots(similar)
    assert {(max(p), min(p)) for p in links} <= set(similar)


def test_rows_grow_with_the_texts(spark):
    """Four times the texts of six out of ten words give at most six times the links and no list."""
    ship_code(spark)
    made = {}
    for n in (2_000, 8_000):
        rng = np.random.default_rng(n)
        rows = [(i, " ".join(f"w{x}" for x in rng.integers(0, 10, 6))) for i in range(n)]
        t = minhash.sketches(spark.createDataFrame(rows, "doc_id long, text string"), 2, minhash.K)
        classes = t.groupBy("node").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"))
        assert classes.filter(F.col("n") >= minhash.DELETED).count() == 0
        made[n] = minhash.short_links(classes).count()
    assert 0 < made[8_000] <= 6 * max(made[2_000], 200)


def test_pair_lists_hold_every_similar_pair(spark):
    rng = np.random.default_rng(5)
    sets = []
    for _ in range(150):
        base = set(rng.choice(120, int(rng.integers(14, 75)), replace=False).tolist())
        sets += [base, (base - set(list(base)[:int(rng.integers(0, 4))])) | {200 + int(x) for x in rng.integers(0, 40, 3)}]
    sets = [sorted(s) for s in {frozenset(s) for s in sets}]
    zero = [0] * minhash.BIT_WORDS
    kinds = ", ".join(f"bits{w} long" for w in range(minhash.BIT_WORDS))
    classes = spark.createDataFrame([(i, len(s), s, *zero) for i, s in enumerate(sets)],
                                    f"node long, n long, sketch array<long>, {kinds}")
    lists = minhash.posting_lists(classes, minhash.WHOLE).withColumn("comp", F.col("node"))
    met = {(r.a, r.b) for r in minhash.cross_pairs(lists, minhash.WHOLE).collect()}
    similar = {(a, b) for b in range(len(sets)) for a in range(b)
               if 100 * len(set(sets[a]) & set(sets[b])) >= 80 * len(set(sets[a]) | set(sets[b]))}
    assert similar and similar <= met
