"""Operators 4, 7 and 10 against plain replays of what they define."""

import collections
import hashlib
import json
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskfold.llm import chat, quality, sharding
from riskfold.llm.common import text_chunks


# ------------------------------------------------------------------ 4: sharding

def walk(cells, shards):
    """Each key walks clockwise from its cell to the next node whose shard has room."""
    owner = sharding.ring(shards)
    n = len(cells)
    room = [n // shards + (s < n % shards) for s in range(shards)]
    taken = collections.Counter()
    for c in sorted(cells):
        while owner[c] < 0 or room[owner[c]] == 0:
            c = (c + 1) % len(owner)
        room[owner[c]] -= 1
        taken[owner[c]] += 1
        yield owner[c]


@pytest.mark.parametrize("n,hot", [(700, 0), (700, 260), (23, 0)])
def test_ring_replayed_key_by_key(spark, n, hot):
    rows = [(i, f"text {i}" * (i % 5)) for i in range(n)]
    rows += [(3, "one key")] * hot + [(None, None), (None, "x"), (5, rows[5][1]), (5, rows[5][1])]
    df = spark.createDataFrame([(*r, 9) for r in rows], "doc_id long, text string, cell int").repartition(4)
    got = sharding.shard_rows(df).collect()
    cell = {r.doc_id: r.cell for r in df.select("doc_id").distinct().select(
        "doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(sharding.CELLS)).alias("cell")).collect()}
    want = collections.Counter(zip(sorted(cell[r[0]] for r in rows), walk([cell[r[0]] for r in rows], sharding.SHARDS)))
    assert collections.Counter((cell[r.doc_id], r.shard) for r in got) == want
    for s in range(sharding.SHARDS):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in got) == collections.Counter(
        (i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)


# -------------------------------------------------------------- 7: chat format

def test_chat_table_against_the_rows(spark):
    rng = np.random.default_rng(4)
    bits = ["### ", "User: ", "</turn>", "\\", "\n", "é", "### Assistant: ", " ", "ok", "😀", " </turn>\n", "*"]
    rows = []
    for c in range(60):
        for t in range(int(rng.integers(1, 6))):
            text = None if rng.random() < 0.1 else "".join(rng.choice(bits, rng.integers(0, 9)))
            role = rng.choice(["user", "assistant", "system", "Tool 2", ""])
            rows.append((c, None if rng.random() < 0.1 else t, str(role), text))
    rows += [(None, 0, "user", "a"), (None, 1, None, "b"), (70, 0, "assistant", "long </turn> " * 20_000),
             (71, 0, "user", "same"), (71, 0, "user", "same")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    got = {r.conv_id: r for r in chat.format_conversations(df).collect()}
    for c in {r[0] for r in rows}:
        mine = sorted(((t is None, t or 0, role or "", text or "") for i, t, role, text in rows if i == c))
        turns = [(role, text) for _, _, role, text in mine]
        said = "".join(t for r, t in turns if r == "assistant")
        r = got[c]
        assert (r.n_turns, r.loss_chars, r.formatted_chars) == (len(turns), len(said), len(r.formatted))
        assert r.loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert [(a, b) for a, b, _, _ in chat.parse(r.formatted)] == turns
        spans = [r.formatted[a:b] for a, b in zip(r.loss_starts, r.loss_ends)]
        assert "".join(chat.unescape(s) if s != t else s for s, t in zip(spans, [t for a, t in turns if a == "assistant"])) == said
    assert chat.format_conversations(df.limit(0)).count() == 0


# ------------------------------------------------------ 10: quadratic discriminant

def discriminant(x, y, every):
    """Plain Gaussian classes with shrunken covariances; the odds' logistic."""
    d = x.shape[1]
    pooled = sum((y == c).sum() * np.cov(x[y == c].T, bias=True) for c in (0, 1)) / len(y)
    log = []
    for c in (0, 1):
        z = x[y == c]
        cov = (1 - quality.SHRINK) * np.cov(z.T, bias=True) + quality.SHRINK * np.diag(np.diag(pooled)) + quality.RIDGE * np.eye(d)
        off = every - z.mean(0)
        log.append(-0.5 * np.einsum("ij,jk,ik->i", off, np.linalg.inv(cov), off) - 0.5 * np.linalg.slogdet(cov)[1]
                   + np.log(len(z)))
    return 1 / (1 + np.exp(-np.clip(log[1] - log[0], -60, 60)))


def test_scores_of_a_plain_discriminant(spark):
    import pyarrow as pa

    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([(9_000_000, None), (9_000_001, ""), (9_000_002, "word " * 60_000), (0, "repeated id")],
                                  "doc_id long, text string")
    docs = docs.unionByName(extra).withColumn("score", F.lit("clash"))
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = docs.collect()
    got = collections.defaultdict(list)
    for r in quality.quality_scores(docs, labels).collect():
        got[r.doc_id].append((r.score, r.held_out, r.predicted))
    x = np.concatenate([quality.statistics(data, off) for _, data, off in text_chunks(pa.array([r.text for r in rows]))])
    held = np.array([zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in rows])
    mark = {r.doc_id: r.quality for r in labels.collect() if r.quality in (0, 1)}
    learn = np.array([not h and r.doc_id in mark for r, h in zip(rows, held)])
    y = np.array([mark.get(r.doc_id, 0) for r in rows])
    want = collections.defaultdict(list)
    for r, s, h in zip(rows, discriminant(x[learn], y[learn], x), held):
        want[r.doc_id].append((s, bool(h), int(s >= quality.THRESHOLD)))
    assert set(got) == set(want)
    for i, w in want.items():
        for (s, h, p), (t, k, q) in zip(sorted(got[i]), sorted(w)):
            assert s == pytest.approx(t, abs=1e-6) and (h, p) == (k, q)
    assert quality.quality_scores(docs.limit(0), labels).count() == 0


def test_filter_keeps_what_the_scores_accept(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    accepted = {r.doc_id for r in quality.quality_scores(docs, labels).collect() if r.predicted}
    kept = quality.quality_filter(docs, labels)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == accepted and json.dumps(len(accepted)) != "0"
