"""Operators 11 to 13 against brute-force versions on small fixtures."""

import functools
import hashlib
import itertools
import math
import re
import sys
import zlib

import numpy as np
import pytest

from riskfold.llm import decontaminate, lexical, repair
from riskfold.llm.common import settings

TERM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


# ------------------------------------------------------------- 12: repair

sys.setrecursionlimit(100_000)          # the brute-force version recurses once an edit

WANTED = re.compile(r"(s?(ua)+)?")


def faults(rows):
    """(must go, truncated) of each row and the fault counts."""
    seen, marks, counts = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
    for role, text in rows:
        body = text.strip(" \t\n\v\f\r")
        kind = ("blank" if not body else "duplicate" if (role, text) in seen
                else "truncated" if body[-1] not in ".!?" else None)
        seen.add((role, text))
        if kind:
            counts[kind] += 1
        marks.append((kind in ("blank", "duplicate"), kind == "truncated"))
    return marks, counts


def brute_repair(rows):
    """Cheapest and then least audit over all edit strings, by dynamic programming
    over (rows read, roles written so far as an automaton of the pattern)."""
    marks, counts = faults(rows)

    def step(state, initial):             # 0 nothing, 1 after s, 2 after u, 3 after a
        return {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}.get((state, initial))

    @functools.cache
    def best(i, state, inserts):
        ways = []
        if i == len(rows) and state in (0, 3):
            ways.append((0, "", ()))
        if inserts < 3:
            for role in ("user", "assistant"):
                s = step(state, role[0])
                if s is not None:
                    c, a, out = best(i, s, inserts + 1)
                    ways.append((c + 2, "I" + a, ((role, ""), *out)))
        if i < len(rows):
            (role, text), (must, cut) = rows[i], marks[i]
            c, a, out = best(i + 1, state, 0)
            ways.append((c + 3, "D" + a, out))
            if not must:
                for edit, new, cost in (("K", role, 0), ("R", "user", 2), ("R", "assistant", 2)):
                    s = step(state, new[:1])
                    if s is not None:
                        c, a, out = best(i + 1, s, 0)
                        ways.append((c + cost + cut, edit + a, ((new, text), *out)))
        return min(ways, key=lambda w: w[:2]) if ways else (10 ** 9, "~", ())

    cost, audit, out = best(0, 0, 0)
    assert WANTED.fullmatch("".join(r[0] for r, _ in out))
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
    return (counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, digest), out


def gap_count(turns):
    known = {t for t in turns if t is not None}
    return max(known) - min(known) + 1 - len(known) if known else 0


ROLES, TEXTS = ["system", "user", "assistant", "tool", "", "umbra", None], ["Yes.", "no", " ", "", "Fine!\n", "x? ", None, "."]


def key(t):
    return (t[0] is not None, t[0] or 0, *(x if x is not None else " " for x in t[1:]))


def random_conversations(n, longest, seed):
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(n):
        for turn in range(rng.integers(1, longest + 1)):
            t = None if rng.random() < 0.05 else int(turn + (turn > 3))
            roles = ["system", "user", "assistant"][turn % 3:] if rng.random() < .5 else ROLES
            text = TEXTS[rng.integers(len(TEXTS))] if rng.random() < 0.5 else f"turn {rng.integers(9)}."
            rows.append((c, t, roles[rng.integers(len(roles))], text))
            if rng.random() < 0.1:
                rows.append(rows[-1])
    return rows


def expected(rows):
    out = {}
    for c in {r[0] for r in rows}:
        mine = sorted((r[1:] for r in rows if r[0] == c), key=key)
        known = [(r if r is not None else " ", t if t is not None else " ") for _, r, t in mine]
        out[c] = (gap_count([t for t, _, _ in mine]), *brute_repair(known)[0])
    return out


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("spread", [False, True])
def test_repair_report(spark, spread):
    rows = random_conversations(150, 7, 5)
    if spread:          # long conversations over many partitions, one with copies by the hundred
        rows = random_conversations(3, 150, 6) + [(9, 4, "user", "again.")] * 300 + [(None, 0, "user", "x."), (None, 1, "tool", "y")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    with settings(spark, {"spark.sql.adaptive.coalescePartitions.enabled": str(not spread).lower()}):
        got = {r.conv_id: tuple(r)[1:] for r in repair.repair_report(df).collect()}
        if spread:
            placed = repair.placed_rows(df)
            assert placed.select("part").distinct().count() > 4
    assert got == expected(rows)


def test_repaired_rows(spark):
    rows = random_conversations(4, 90, 8)
    with settings(spark, {"spark.sql.adaptive.coalescePartitions.enabled": "false"}):
        got = repair.repair_conversations(spark.createDataFrame(rows, SCHEMA)).collect()
    for c in {r[0] for r in rows}:
        mine = [(r if r is not None else " ", t if t is not None else " ")
                for _, r, t in sorted((r[1:] for r in rows if r[0] == c), key=key)]
        assert [(r.role, r.text) for r in sorted(got, key=lambda r: (r.part, r.no)) if r.conv_id == c] == list(brute_repair(mine)[1])


def test_repair_tables_exhaustive():
    """Every sequence of up to four classes: the least cheapest letters of all edit strings."""
    def every(classes):
        best = None
        names = ["suax"[c % 4] for c in classes]
        for letters in itertools.product(*[[("I" * k) + e for k in range(3) for e in "DKR"] for _ in classes], [""] + ["I", "II"]):
            state, cost, ok = 0, 0, True
            for k, piece in enumerate(letters):
                for x in piece:
                    if x == "D":
                        cost += 3
                        continue
                    initial = names[k] if x == "K" else "a" if state == 2 else "u"
                    cost += {"I": 2, "K": 0, "R": 2}[x] + (x != "I" and classes[k] >= 4)
                    state = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}.get((state, initial))
                    if state is None:
                        ok = False
                        break
                if not ok:
                    break
            if ok and state in (0, 3):
                way = (cost, "".join(letters))
                best = min(best or way, way)
        return best
    for n in (0, 1, 2, 3):
        for classes in itertools.product(range(8), repeat=n):
            tables = [repair.TABLES[c] for c in classes]
            end, cost = repair.last_state(*repair.forward(tables, [0, repair.FAR, repair.FAR, repair.FAR], [0] * 4))
            assert (cost, "".join(repair.edits(bytes(classes), 0, end)) + repair._END_TEXT[end]) == every(classes)


def test_repair_query_on_damaged_rows(spark, tmp_path):
    from riskfold.llm.queries import op12_hirschberg_repair
    rows = [r for r in random_conversations(80, 5, 7)] + [(500 + k, 0, "user", "gone?") for k in range(60)]
    spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], SCHEMA + ", part int").write.parquet(f"{tmp_path}/conversations.parquet")
    damaged = []
    for c, turn, role, text in rows:
        code = zlib.crc32(f"{c}:{' ' if turn is None else turn}".encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        if code == 0:
            continue
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        damaged += [(c, turn, "user" if code == 4 else role, text)] * (2 if code == 3 else 1)
    want = expected(damaged)
    empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    got = {r.conv_id: tuple(r)[1:] for r in op12_hirschberg_repair(spark, str(tmp_path)).collect()}
    assert got == {c: want.get(c, empty) for c in {r[0] for r in rows}}
    assert any(v == empty for v in got.values())


def test_repair_empty_table(spark):
    assert repair.repair_report(spark.createDataFrame([], SCHEMA)).count() == 0
    assert repair.repair_conversations(spark.createDataFrame([], SCHEMA)).count() == 0


# --------------------------------------------------- 11: ranked lexical search

def brute_search(docs, items, k):
    bags = [(i, words(t)) for i, t in docs]
    n_docs, total = sum(bool(w) for _, w in bags), sum(len(w) for _, w in bags)
    df = {}
    for _, w in bags:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    out = []
    for item, text in dict.fromkeys(items):
        found = []
        for i, w in bags:
            score = 0
            if w:
                m = 100 - 25 + (25 * len(w) * n_docs) // total
                for t in words(text):
                    if tf := w.count(t):
                        score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (
                            (1000000000 * tf) // (1000 * tf + 12 * m))
            if score > 0:
                found.append((-score, i is None, i))
        found.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(found[:k])]
    return sorted(out, key=str)


def random_texts(n, rng, alphabet=40, longest=60):
    vocabulary = [f"W{k}x" if k % 3 else f"é{k}É" for k in range(alphabet)]
    p = 1 / np.arange(1, alphabet + 1)
    return [rng.choice([" ", "-", "\n"]).join(rng.choice(vocabulary, rng.integers(0, longest), p=p / p.sum())) for _ in range(n)]


@pytest.mark.parametrize("shard,block", [(16 << 20, 8 << 20), (2000, 300)])
def test_search(spark, monkeypatch, shard, block):
    monkeypatch.setattr(lexical, "SHARD_BYTES", shard)
    monkeypatch.setattr(lexical, "BLOCK_BYTES", block)
    rng = np.random.default_rng(3)
    docs = list(enumerate(random_texts(300, rng)))
    docs += [(k + 1000, docs[k][1]) for k in range(60)] + [(2000, None), (2001, ""), (None, docs[5][1]), (7, docs[8][1])]
    docs += [(3000, " ".join(random_texts(1, rng, longest=50)) * 2000)]                   # very long
    items = [(k, t) for k, t in enumerate(random_texts(12, rng, longest=25))] + [(50, None), (51, "!?"), (3, "w1x"), (3, "w1x")]
    d = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, term int").repartition(3)
    i = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, doc_id int")
    got = lexical.search(d, i, k=20).collect()
    want = brute_search(docs, items, 20)
    assert sorted((tuple(r) for r in got), key=str) == want


def test_search_reads_a_part_of_the_lists():
    """The best positions stop the reading before the lists end."""
    rng = np.random.default_rng(4)
    n = 5000
    doc = np.repeat(np.arange(n), 3)
    term = np.tile(np.arange(3), n)
    tf = np.minimum(rng.geometric(0.5, 3 * n), 40)
    q = lexical.Queries([], [], np.array([900, 700, 500]), n, 100 * n, np.zeros(1))
    lists = lexical.ImpactLists(np.full(n, 100), doc, term, tf, q)
    docs, scores, read = lists.best(np.arange(3), np.ones(3, np.int64), 20, 0)
    whole = lists.direct(np.arange(n), np.arange(3))[0].sum(1)
    kth = np.sort(whole)[-20]
    assert sorted(docs[scores >= kth]) == sorted(np.flatnonzero(whole >= kth))
    assert read < 3 * n / 4
    docs, scores, less = lists.best(np.arange(3), np.ones(3, np.int64), 20, int(whole.max()))
    assert set(docs) == set(np.flatnonzero(whole == whole.max())) and less <= read


def test_search_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert lexical.search(docs, items).count() == 0
    assert lexical.search(items.withColumnRenamed("item_id", "doc_id"), items.limit(0)).count() == 0


# ------------------------------------------------------- 13: decontamination

def brute_contamination(docs, items, width):
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(len(w), width)
        for p in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[p:p + n]), set()).add(item)
    out = []
    for i, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(x) for x in windows}:
            for p in range(len(w) - n + 1):
                if tuple(w[p:p + n]) in windows:
                    hit |= set(range(p, p + n))
                    found |= windows[tuple(w[p:p + n])]
        names = sorted("" if x is None else str(x) for x in found)
        out.append((i, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("shard,block,piece", [(8 << 20, 8 << 20, 1 << 20), (3000, 400, 15)])
def test_contamination(spark, monkeypatch, shard, block, piece):
    for name, value in (("SHARD_BYTES", shard), ("BLOCK_BYTES", block), ("PIECE_WORDS", piece)):
        monkeypatch.setattr(decontaminate, name, value)
    rng = np.random.default_rng(9)
    items = [(k, t) for k, t in enumerate(random_texts(25, rng, 200, 40))]
    docs = list(enumerate(random_texts(150, rng, 200, 120)))
    for k in range(60):                      # verbatim passages inside other text, some under ten words
        w = words(items[k % 25][1])
        a = int(rng.integers(0, max(1, len(w) - 5)))
        docs.append((1000 + k, f"{docs[k][1]} {' '.join(w[a:a + int(rng.integers(5, 30))]).upper()} {docs[k + 1][1]}"))
    docs += [(k + 5000, docs[170][1]) for k in range(30)] + [(2000, None), (2001, ""), (None, docs[160][1]), (3, docs[161][1])]
    docs += [(3000, (docs[165][1] + " ") * 800)]
    items += [(100, "w1x, W2x"), (101, None), (102, " . "), (None, docs[150][1]), (4, items[4][1]), (4, items[5][1]), (200, items[6][1])]
    d = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, shard int").repartition(3)
    i = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, doc_id int")
    got = sorted((tuple(r) for r in decontaminate.contamination(d, i).drop("hit_spans").collect()), key=str)
    want = brute_contamination(docs, items, 10)
    assert got == want
    if piece > 15:
        left = {r.doc_id for r in decontaminate.decontaminate(d, i).collect()}
        assert left == {r[0] for r in want} - {r[0] for r in want if r[5]}


def test_longest_matches(spark):
    rng = np.random.default_rng(2)
    w = [f"t{k}" for k in range(60)]
    docs = [(1, "x " + " ".join(w[5:18])), (2, "y z " + " ".join(w[20:47]) + " q"), (3, " ".join(rng.permutation(w)))]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame([(7, " ".join(w))], "item_id long, text string")
    (r,) = decontaminate.longest_matches(d, i).collect()
    assert tuple(r) == ("7", 27, 20, 2, 2)


def test_contamination_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b"), (None, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    none = hashlib.sha256(b"").hexdigest()
    assert decontaminate.contamination(docs.limit(0), items).count() == 0
    assert sorted(map(tuple, decontaminate.contamination(docs, items.limit(0)).drop("hit_spans").collect()), key=str) == [
        (1, 2, 0, 0, none, False), (None, 0, 0, 0, none, False)]
    assert decontaminate.longest_matches(docs, items.limit(0)).count() == 0
