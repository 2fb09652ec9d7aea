"""Operator 12: conversation structure repair by Hirschberg's divide and conquer.

A conversation should have role initials ``(s?(ua)+)?``. Each row is kept (K, 0),
given the other role (R, 2) or deleted (D, 3, a must for blank rows and for
copies of an earlier row); empty user and assistant rows can be inserted anywhere
(I, 2); a truncated row that stays adds 1. Of the cheapest edits the one whose
initials are least in ASCII order wins.

A prefix of the wanted form is in one of four states (nothing yet, after s, after
u, after a), and an edit leads from a state to one other state only. So every
row, and every run of rows, is a 4 x 4 table of (cost, order): the cheapest way
from one state to another and how the least audits of these ways compare. No two
audits up to the same row are prefixes of one another, so tables compose exactly.
Hirschberg: forward vectors of the first half and backward vectors of the second
meet at the middle row, the crossing of least cost, and there of least audit, is
chosen, and both halves are done alike; space is linear in the rows.

Spark does this in pieces, since one conversation may hold any share of the rows:
equal rows are counted first, the rest is range-partitioned by conversation and
turn, and a *segment* is what one partition holds of a conversation. Each segment
becomes its table, the tables of a conversation (at most one a partition) yield
the states at the segments' borders, and each segment is then solved by itself.

Defined results: rows go by turn (nulls first), then role, then text; null roles
and texts are one space; equal rows are kept in number, all but the first are
duplicates. Rows with a null conv_id are one conversation. ``turn`` is cast to
long. An empty table gives no rows; other columns are ignored. The audit and the
digest of a conversation are values of one row, so the task that writes this row
reads the conversation once, as a stream.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, ship_code

START, SYSTEM, USER, ASSISTANT = range(4)
FAR = 1 << 60
DELETE, INSERT, REROLE, CUT = 3, 2, 2, 1
#: Inserted initials that lead from one state to another.
_INSERTS = {(START, USER): "u", (START, ASSISTANT): "ua", (SYSTEM, USER): "u", (SYSTEM, ASSISTANT): "ua",
            (USER, ASSISTANT): "a", (ASSISTANT, USER): "u"}
_NEXT = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
#: What the end of a conversation still needs.
_END = (0, 2 * INSERT, INSERT, 0)
_END_TEXT = ("", "II", "I", "")


def _row_table(initial: str, cut: bool) -> dict:
    """{(from, to): (cost, letters)} of a row that may stay: inserts, then one edit."""
    best = {}
    for s in range(4):
        for m in range(4):
            if s != m and (s, m) not in _INSERTS:
                continue
            lead = "I" * len(_INSERTS.get((s, m), ""))
            ways = [(m, DELETE, "D")]
            if m in _NEXT.get(initial, {}):
                ways.append((_NEXT[initial][m], CUT * cut, "K"))
            ways.append((USER if m != USER else ASSISTANT, REROLE + CUT * cut, "R"))
            for t, cost, letter in ways:
                way = (cost + INSERT * len(lead), lead + letter)
                best[s, t] = min(best.get((s, t), way), way)
    return best


#: Classes of rows that may stay: initial s, u, a or any other; whole or cut.
CLASSES = [_row_table(i, c) for c in (False, True) for i in "suax"]


def _ordered(ways: dict) -> tuple:
    """Per start state a list of (to, cost, order of the letters)."""
    out = []
    for s in range(4):
        mine = sorted((w[1], t, w[0]) for (a, t), w in ways.items() if a == s)
        out.append(tuple((t, cost, k) for k, (_, t, cost) in enumerate(mine)))
    return tuple(out)


TABLES = [_ordered(c) for c in CLASSES]


def forward(tables, cost: list, order: list) -> tuple[list, list]:
    """Cost and order of the least audits to each state after the rows."""
    for table in tables:
        best = [None] * 4
        for m in range(4):
            if cost[m] < FAR:
                for t, c, k in table[m]:
                    way = (cost[m] + c, order[m], k)
                    if best[t] is None or way < best[t]:
                        best[t] = way
        by = sorted((b[1:], t) for t, b in enumerate(best) if b)
        cost, order = [b[0] if b else FAR for b in best], [4] * 4
        for k, (_, t) in enumerate(by):
            order[t] = k
    return cost, order


def backward(tables, cost: list) -> list:
    """Cheapest cost from each state before the rows to the given end costs."""
    for table in reversed(tables):
        cost = [min((c + cost[t] for t, c, _ in table[m]), default=FAR) for m in range(4)]
        cost = [min(c, FAR) for c in cost]
    return cost


def _at(state: int) -> list:
    return [0 if s == state else FAR for s in range(4)]


def crossings(tables, start: int, end: int) -> list[int]:
    """The states between the rows on the least cheapest way from start to end."""
    if len(tables) < 2:
        return []
    half = len(tables) // 2
    cost, order = forward(tables[:half], _at(start), [0] * 4)
    rest = backward(tables[half:], _at(end))
    meet = min(range(4), key=lambda s: (cost[s] + rest[s], order[s]))
    return [*crossings(tables[:half], start, meet), meet, *crossings(tables[half:], meet, end)]


def last_state(cost: list, order: list) -> tuple[int, int]:
    """The state after the last row, and the whole cost."""
    s = min(range(4), key=lambda s: (cost[s] + _END[s], order[s]))
    return s, cost[s] + _END[s]


def summary(tables) -> tuple:
    """The table of a run of rows."""
    out = []
    for s in range(4):
        cost, order = forward(tables, _at(s), [0] * 4)
        out.append(tuple((t, cost[t], order[t]) for t in range(4) if cost[t] < FAR))
    return tuple(out)


@functools.lru_cache(1 << 14)
def _short_summary(live: bytes) -> tuple:
    return summary([TABLES[c] for c in live])


def edits(live: bytes, start: int, end: int) -> list[str]:
    """The letters of each row that may stay, inserts before it included."""
    states = [start, *crossings([TABLES[c] for c in live], start, end), end]
    return [CLASSES[c][a, b][1] for c, a, b in zip(live, states, states[1:])]


@functools.lru_cache(1 << 14)
def _short_edits(live: bytes, start: int, end: int) -> tuple:
    return tuple(edits(live, start, end))


_SHORT = 64


def damage(conversations: DataFrame) -> DataFrame:
    """The rows after the damage that crc32(conv_id:turn) mod 20 decides: 0 drops a
    row, 1 empties its text, 2 removes its end marks, 3 repeats it, 4 makes it a
    user's. Nulls stand for one space."""
    def known(c):
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.concat(known("conv_id"), F.lit(":"), known("turn"))) % 20
    text = (F.when(code == 1, "").when(code == 2, F.regexp_replace(known("text"), "[.!?]", ""))
            .otherwise(known("text")))
    rows = conversations.where(code != 0).select(
        "conv_id", "turn", F.when(code == 4, "user").otherwise(known("role")).alias("role"), text.alias("text"),
        F.array_repeat(F.lit(0), F.when(code == 3, 2).otherwise(1)).alias("__n"))
    return rows.select("conv_id", "turn", "role", "text", F.explode("__n").alias("__n")).drop("__n")


def placed_rows(rows: DataFrame) -> DataFrame:
    """Distinct rows with their number, by conversation and turn, in partitions of
    a global range: (part, at) is a row's place."""
    r = rows.select("conv_id", F.col("turn").cast("long").alias("turn"),
                    F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
                    F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"))
    keys = ["conv_id", "turn", "role", "text"]
    r = r.groupBy(*keys).agg(F.count("*").alias("copies"))
    initial = F.instr(F.lit("sua"), F.substring("role", 1, 1))
    initial = F.when(F.length("role") == 0, 3).when(initial > 0, initial - 1).otherwise(3)
    cut = ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    r = r.withColumn("kind", (initial + F.when(cut, 4).otherwise(0)).cast("int"))
    # equal roles and texts have equal keys; blank rows need none
    key = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    r = r.withColumn("key", F.when(~blank, key))
    r = r.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return r.select(*keys, "copies", "kind", "key", F.spark_partition_id().alias("part"),
                    F.monotonically_increasing_id().alias("at"))


_COUNTS = ("blank", "duplicate", "truncated", "illegal")


def _segments(placed: DataFrame) -> DataFrame:
    """Per segment: the rows that may stay, how many deleted rows stand before
    each, the fault counts, and the segment's table."""
    kind = placed.schema["conv_id"].dataType.simpleString()
    # keys that an earlier segment of the conversation has; none where it has one segment
    spans = (placed.groupBy("conv_id").agg(F.min("part").alias("p"), F.max("part").alias("q")).where("p < q")
             .select(F.col("conv_id").alias("c")))
    keys = (placed.where("key is not null").join(spans, F.col("conv_id").eqNullSafe(F.col("c")), "left_semi")
            .groupBy("conv_id", "key").agg(F.collect_set("part").alias("parts")).where(F.size("parts") > 1))
    before = (keys.select("conv_id", "key", F.explode(F.array_except("parts", F.array(F.array_min("parts")))).alias("part"))
              .groupBy("conv_id", "part").agg(F.collect_list("key").alias("before")))
    rows = placed.groupBy("conv_id", "part").agg(
        F.array_sort(F.collect_list(F.struct("at", "kind", "copies", "key"))).alias("r"))
    before = before.select(F.col("conv_id").alias("c"), F.col("part").alias("p"), "before")
    rows = rows.join(before, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")), "left")
    rows = rows.select("conv_id", "part", F.transform("r", lambda x: x.kind).alias("kinds"),
                       F.transform("r", lambda x: x.copies).alias("copies"),
                       F.transform("r", lambda x: x.key).alias("keys"), "before")

    def run(batches):
        for b in batches:
            out = []
            for i in range(b.num_rows):
                kinds, copies, keys, before = (b.column(c)[i].as_py() for c in ("kinds", "copies", "keys", "before"))
                seen, live, gone = set(before or ()), bytearray(), [0]
                blank = duplicate = truncated = illegal = 0
                last, first = None, kinds[0] % 4
                for kind_, n, key in zip(kinds, copies, keys):
                    initial = "suax"[kind_ % 4]
                    illegal += n - 1 + (last is not None and last + initial not in ("su", "ua", "au"))
                    last = initial
                    if key is None:
                        blank += n
                        gone[-1] += n
                        continue
                    stays = key not in seen
                    seen.add(key)
                    duplicate += n - stays
                    if stays:
                        truncated += kind_ >= 4
                        live.append(kind_)
                        gone.append(0)
                    gone[-1] += n - stays
                live = bytes(live)
                table = _short_summary(live) if len(live) <= _SHORT else summary([TABLES[c] for c in live])
                table = [[s, t, c, k] for s in range(4) for t, c, k in table[s]]
                out.append((live, gone, blank, duplicate, truncated, illegal, first, "suax".index(last), sum(table, [])))
            kinds_ = (pa.binary(), pa.list_(pa.int64()), *[pa.int64()] * 4, pa.int32(), pa.int32(), pa.list_(pa.int64()))
            yield pa.record_batch([b.column("conv_id"), b.column("part"),
                                   *[pa.array([o[j] for o in out], t) for j, t in enumerate(kinds_)]],
                                  names=["conv_id", "part", "live", "gone", *_COUNTS, "first", "last", "table"])

    return rows.mapInArrow(run, f"conv_id {kind}, part int, live binary, gone array<long>, blank long, duplicate long, "
                                "truncated long, illegal long, first int, last int, table array<long>")


def _borders(segments: DataFrame) -> DataFrame:
    """Per conversation the counts and the cost, and per segment the states it
    starts and ends in. A conversation has at most one segment a partition."""
    kind = segments.schema["conv_id"].dataType.simpleString()
    rows = segments.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("part", "first", "last", "table"))).alias("s"),
        *[F.sum(c).alias(c) for c in _COUNTS], F.sum(F.aggregate("gone", F.lit(0).cast("long"), lambda a, x: a + x)).alias("deleted"))

    def run(batches):
        for b in batches:
            out = []
            for i in range(b.num_rows):
                parts = b.column("s")[i].as_py()
                tables, between = [], 0
                for k, p in enumerate(parts):
                    table = [[], [], [], []]
                    for s, t, c, o in np.array(p["table"], np.int64).reshape(-1, 4).tolist():
                        table[s].append((t, c, o))
                    tables.append(table)
                    between += k > 0 and "suax"[parts[k - 1]["last"]] + "suax"[p["first"]] not in ("su", "ua", "au")
                end, cost = last_state(*forward(tables, _at(START), [0] * 4))
                states = [START, *crossings(tables, START, end), end]
                out.append((b.column("illegal")[i].as_py() + between, cost + DELETE * b.column("deleted")[i].as_py(),
                            [p["part"] for p in parts], states))
            yield pa.record_batch([b.column("conv_id"), *[b.column(c) for c in _COUNTS[:3]],
                                   *[pa.array([o[j] for o in out], t) for j, t in enumerate(
                                       (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32())))]],
                                  names=["conv_id", *_COUNTS, "cost", "parts", "states"])

    return rows.mapInArrow(run, f"conv_id {kind}, blank long, duplicate long, truncated long, illegal long, cost long, "
                                "parts array<int>, states array<int>")


def _solved(segments: DataFrame, borders: DataFrame) -> DataFrame:
    """(conv_id, part, audit, opens): each segment's edits and the state it starts in."""
    kind = segments.schema["conv_id"].dataType.simpleString()
    ends = borders.select(
        F.col("conv_id").alias("c"), F.posexplode("parts").alias("k", "p"), "states").select(
        "c", "p", F.element_at("states", F.col("k") + 1).alias("opens"), F.element_at("states", F.col("k") + 2).alias("ends"),
        (F.col("k") + 2 == F.size("states")).alias("closes"))
    rows = segments.join(ends, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p"))).select(
        "conv_id", "part", "live", "gone", "opens", "ends", "closes")

    def run(batches):
        for b in batches:
            audits = []
            for live, gone, opens, ends, closes in zip(*(b.column(c).to_pylist() for c in ("live", "gone", "opens", "ends", "closes"))):
                done = (_short_edits if len(live) <= _SHORT else edits)(live, opens, ends)
                audits.append("D" * gone[0] + "".join(e + "D" * g for e, g in zip(done, gone[1:]))
                              + (_END_TEXT[ends] if closes else ""))
            yield pa.record_batch([b.column("conv_id"), b.column("part"), pa.array(audits, pa.string()), b.column("opens")],
                                  names=["conv_id", "part", "audit", "opens"])

    return rows.mapInArrow(run, f"conv_id {kind}, part int, audit string, opens int")


def _digest_batch(done: list, kind: pa.DataType) -> pa.RecordBatch:
    return pa.record_batch([pa.array([d[j] for d in done], t) for j, t in enumerate((kind, pa.string(), pa.string()))],
                           names=["conv_id", "audit", "repaired_sha256"])


class Repair:
    """The steps' tables: ``placed`` rows, ``totals`` per conversation, ``audits`` per segment."""

    def __init__(self, rows: DataFrame) -> None:
        ship_code(rows.sparkSession)
        self.placed = materialize(placed_rows(rows), "op12-placed")
        segments = materialize(_segments(self.placed), "op12-segments")
        self.totals = materialize(_borders(segments), "op12-borders")
        self.audits = materialize(_solved(segments, self.totals), "op12-audits")
        self.kind = rows.schema["conv_id"].dataType.simpleString()

    def _stream(self) -> DataFrame:
        """Segments' audits and rows; a segment's audit sorts before its rows."""
        none = F.lit(None).cast("string")
        return (self.audits.select("conv_id", "part", F.lit(-1).cast("long").alias("at"), none.alias("role"),
                                   none.alias("text"), F.lit(0).cast("long").alias("copies"), "audit", "opens")
                .unionByName(self.placed.select("conv_id", "part", "at", "role", "text", "copies",
                                                none.alias("audit"), F.lit(0).alias("opens"))))

    def rows(self) -> DataFrame:
        """conv_id, part, no, edit, role, text: the repaired rows; (part, no) is
        their order in the conversation."""
        def run(batches):
            walk = _Walk()
            for b in batches:
                out = [(i, walk.number(), *row) for i, row in walk.feed(b)]
                yield pa.record_batch(
                    [b.column("conv_id").take(pa.array([o[0] for o in out], pa.int64())),
                     b.column("part").take(pa.array([o[0] for o in out], pa.int64())),
                     *[pa.array([o[j] for o in out], t) for j, t in ((1, pa.int64()), (2, pa.string()), (3, pa.string()),
                                                                    (4, pa.string()))]],
                    names=["conv_id", "part", "no", "edit", "role", "text"])

        keyed = self._stream().repartition("conv_id", "part").sortWithinPartitions("conv_id", "part", "at")
        return keyed.mapInArrow(run, f"conv_id {self.kind}, part int, no long, edit string, role string, text string")

    def digests(self) -> DataFrame:
        """conv_id, audit, repaired_sha256; a conversation's rows pass as a stream."""
        def run(batches):
            walk, conv, digest, audit, begun = _Walk(), None, None, [], False
            for b in batches:
                ids, done = b.column("conv_id"), []
                own, pieces, at = ids.to_pylist(), b.column("audit").to_pylist(), b.column("at").to_pylist()
                fed = walk.feed(b)
                nxt = next(fed, None)
                for i in range(b.num_rows):
                    if at[i] < 0:
                        if digest is None or own[i] != conv:
                            if digest is not None:
                                done.append((conv, "".join(audit), digest.hexdigest()))
                            conv, digest, audit, begun = own[i], hashlib.sha256(), [], False
                        audit.append(pieces[i])
                    while nxt is not None and nxt[0] == i:
                        _, (_, role, text) = nxt
                        digest.update((("\n" if begun else "") + f"{role}:{text}").encode())
                        begun = True
                        nxt = next(fed, None)
                yield _digest_batch(done, ids.type)
                kind = ids.type
            if digest is not None:
                yield _digest_batch([(conv, "".join(audit), digest.hexdigest())], kind)

        keyed = self._stream().repartition("conv_id").sortWithinPartitions("conv_id", "part", "at")
        return keyed.mapInArrow(run, f"conv_id {self.kind}, audit string, repaired_sha256 string")


class _Walk:
    """Reads a stream of audits and rows, gives (row of the batch, (edit, role, text))."""

    def __init__(self) -> None:
        self.audit, self.at, self.state, self.count = "", 0, START, 0

    def number(self) -> int:
        self.count += 1
        return self.count - 1

    def _inserts(self):
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            self.state = ASSISTANT if self.state == USER else USER
            yield "I", "assistant" if self.state == ASSISTANT else "user", ""

    def feed(self, batch: pa.RecordBatch):
        cols = [batch.column(c).to_pylist() for c in ("role", "text", "copies", "audit", "opens")]
        for i, (role, text, copies, audit, opens) in enumerate(zip(*cols)):
            if audit is not None:
                self.audit, self.at, self.state, self.count = audit, 0, opens, 0
            for _ in range(copies):
                for row in self._inserts():
                    yield i, row
                edit = self.audit[self.at]
                self.at += 1
                if edit == "K":
                    self.state = _NEXT[role[0]][self.state]
                    yield i, (edit, role, text)
                elif edit == "R":
                    self.state = ASSISTANT if self.state == USER else USER
                    yield i, (edit, "assistant" if self.state == ASSISTANT else "user", text)
            if self.at < len(self.audit) and not self.audit[self.at:].strip("I"):
                for row in self._inserts():                     # what the end needs
                    yield i, row


def repair_conversations(rows: DataFrame) -> DataFrame:
    """The repaired rows of all conversations: conv_id, part, no, edit, role, text."""
    return Repair(rows).rows()


def repair_report(rows: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """Per conversation: gaps, blank, duplicate, truncated, illegal, cost, audit
    and repaired_sha256; ``conversations`` names ids that may have no rows."""
    fix = Repair(rows)
    gaps = fix.placed.groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps"))
    ids = (conversations if conversations is not None else rows).select("conv_id").distinct()
    out = ids
    for part in (gaps, fix.totals.select("conv_id", *_COUNTS, "cost"), fix.digests()):
        part = part.withColumnRenamed("conv_id", "__c")
        out = out.join(part, F.col("conv_id").eqNullSafe(F.col("__c")), "left").drop("__c")
    return out.select("conv_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", *_COUNTS, "cost")],
                      F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
