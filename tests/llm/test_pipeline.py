"""corpus_pipeline.run: each stage's rows against a brute-force version."""

import collections
import hashlib
import os
import tempfile

import numpy as np
import pytest

import corpus_pipeline
from riskfold.llm import bpe, mixing

from .test_operators import brute_components, prose


def brute_mix(rows):
    """Weighted fair queueing replayed: always serve the flow whose next copy ends first."""
    size = lambda r: len((r[1] or "").split())
    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    order = sorted({r[3] for r in rows}, key=lambda s: (s is None, s or ""))
    queues = {s: [] for s in order}
    for r in sorted(rows, key=lambda r: (md5(f"{'' if r[0] is None else r[0]}|{md5(r[1] or '')}"), r[0] or 0)):
        if size(r):
            queues[r[3]].append(r)
    queues = {s: q * mixing.REPEATS for s, q in queues.items()}
    served, spent, out = collections.Counter(), 0, collections.Counter()
    budget = mixing.BUDGET * sum(size(r) for r in rows)
    while any(queues.values()):
        ends = {s: (served[s] + size(queues[s][0])) / mixing.WEIGHTS[k % 3] for k, s in enumerate(order) if queues[s]}
        s = min(ends, key=lambda s: (ends[s], order.index(s)))
        r = queues[s].pop(0)
        if spent + size(r) / 2 > budget:
            break
        served[s], spent = served[s] + size(r), spent + size(r)
        out[r] += 1
    return out


@pytest.mark.parametrize("copies_a_range, ranges", [(20_000, 4_096), (9, 4_096), (2, 3)])
def test_mix_replays_the_queues(spark, monkeypatch, copies_a_range, ranges):
    monkeypatch.setattr(mixing, "RANGE_COPIES", copies_a_range)     # the budget ends in one of many ranges,
    monkeypatch.setattr(mixing, "RANGES", ranges)                   # or in a range of ranges
    rows = [(i, prose(1 + i * 7 % 40, i) if i % 11 else None, "x", f"s{i % 4}" if i % 4 else None) for i in range(120)]
    rows += [(200, "w " * 700, "x", "s1"), (201, "", "x", "s2"), (202, "one", "x", "lone"), (203, " \t", "x", "blank")]
    rows += [rows[5]] * 3 + [(None, "no id here", "x", "s3")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, size string, source string")     # a clashing name
    want = brute_mix(rows)
    assert collections.Counter(tuple(r) for r in mixing.mixed_documents(docs).collect()) == want
    got = mixing.mix_sources(docs).collect()
    assert len(got) == len(rows) and all(r.taken == r.size * r.copies for r in got)
    copies = collections.Counter()
    for r in got:
        copies[r.doc_id] += r.copies
    assert +copies == collections.Counter({i: sum(n for r, n in want.items() if r[0] == i) for i in {r[0] for r in want}})
    longest = max(r.size for r in got)
    for (target,), mine in {(r.target,): [x for x in got if x.target == r.target and x.source_size == r.source_size] for r in got}.items():
        assert abs(sum(x.taken for x in mine) - target) <= 2 * longest


def test_mix_without_words(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert [(r.size, r.target, r.taken) for r in mixing.mix_sources(docs).collect()] == [(0, 0.0, 0)] * 2
    assert mixing.mixed_documents(docs).count() == 0


def test_pipeline(spark, monkeypatch):
    from tokenizers import Tokenizer

    good = [(i, prose(80 + i, i).capitalize() + ".", "en", f"s{i % 3}") for i in range(60)]
    junk = [(i, " ".join(f"{w.upper()}$$$" for w in prose(80, i).split()), "en", "s1") for i in range(100, 160)]
    near = [(200 + i, t.replace(" ", " changed ", 1), "en", "s0") for i, t, *_ in good[:8]]      # one word more
    copies = [(300 + i, t, "de", "s2") for i, t, *_ in good[20:30]] + [(400, good[3][1], "en", "s2")]
    rows = good + junk + near + copies
    d = tempfile.mkdtemp(prefix="run-")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(os.path.join(d, "documents.parquet"))
    spark.createDataFrame([(r[0], int(r in good), 0) for r in good + junk],
                          "doc_id long, quality int, toxic int").write.parquet(os.path.join(d, "labels.parquet"))
    stages, write = [], corpus_pipeline.materialize
    monkeypatch.setattr(corpus_pipeline, "materialize", lambda df, name: stages.append(write(df, name)) or stages[-1])
    corpus_pipeline.run(spark, d)
    got = [collections.Counter(tuple(r) for r in s.collect()) for s in stages]
    assert len(got) == len(corpus_pipeline.STAGES)
    want = good + near + copies
    assert got[0] == collections.Counter(want)
    last = {t: max(r[0] for r in want if r[1] == t) for _, t, *_ in want}
    want = [r for r in want if r[0] == last[r[1]]]
    assert got[1] == collections.Counter(want)
    first = {i: c for i, _, c in brute_components(want, corpus_pipeline.SHINGLE_WORDS)}
    want = [r for r in want if r[0] == first[r[0]]]
    assert got[2] == collections.Counter(want) and 0 < len(want) < len(got[1])
    want = brute_mix(want)
    assert got[3] == want and max(want.values()) == 2
    tok, out = Tokenizer.from_file(bpe.default_path()), collections.Counter()
    for r, n in want.items():
        ids = tok.encode(r[1], add_special_tokens=False).ids
        out[r[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
            hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += n
    assert got[4] == out
