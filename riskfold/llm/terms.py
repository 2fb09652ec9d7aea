"""Terms of whole texts, and blocks of a benchmark's items, for operators 11 and 13.

A term is a maximal run of ASCII digits, ASCII letters and non-ASCII characters,
with A-Z lower-cased. Terms are compared as bytes, never by hash.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, text_chunks, text_of

_TERM = np.zeros(256, bool)
_TERM[0x30:0x3A] = _TERM[0x41:0x5B] = _TERM[0x61:0x7B] = _TERM[0x80:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def terms_of(data: np.ndarray, off: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The terms of the texts, in order, as an Arrow binary array, and the text
    each belongs to."""
    n = len(data)
    if n == 0:
        return pa.array([], pa.binary()), np.zeros(0, np.int64)
    word = _TERM[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    cut = off[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    first[cut] = word[cut]              # a term never runs from one text into the next
    starts = np.flatnonzero(first)
    before = np.cumsum(word, dtype=np.int32)
    edges = np.append(before[starts] - 1, before[-1]).astype(np.int32)
    letters = _LOWER[data[word]]
    found = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(edges), pa.py_buffer(letters)])
    return found, np.searchsorted(off, starts, "right") - 1


def places(found: pa.Array, vocabulary: pa.Array) -> np.ndarray:
    """Each term's place in the vocabulary, -1 outside it."""
    return pc.fill_null(pc.index_in(found, value_set=vocabulary), -1).to_numpy(zero_copy_only=False)


@dataclass
class Block:
    """Some items of the benchmark: their ids, their terms as places in a vocabulary."""

    ids: pa.Array
    vocabulary: pa.Array
    words: np.ndarray          # int32, item after item
    off: np.ndarray            # int64, first word of each item

    def __getstate__(self):
        return {"ids": self.ids.to_pylist(), "kind": self.ids.type, "vocabulary": self.vocabulary.to_pylist(),
                "words": self.words, "off": self.off}

    def __setstate__(self, s):
        self.ids, self.vocabulary = pa.array(s["ids"], s["kind"]), pa.array(s["vocabulary"], pa.binary())
        self.words, self.off = s["words"], s["off"]


def item_blocks(items: DataFrame, id_col: str, text_col: str, block_bytes: int, name: str,
                piece_words: int | None = None, overlap: int = 0):
    """Blocks of at most ``block_bytes`` of item text (one item at least), one
    after the other. With ``piece_words`` longer items are cut into pieces
    that share ``overlap`` words, which bounds a block without exception. Rows
    that repeat id and text count once; items without terms are left out."""
    rows = (items.select(F.col(f"`{id_col}`").alias("item_id"), text_of(f"`{text_col}`").alias("text"))
            .dropDuplicates(["item_id", "text"]))
    rows = materialize(rows, f"{name}-items")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    kind = rows.schema["item_id"].dataType.simpleString()

    def pack(batches):
        for b in batches:
            for a, data, off in text_chunks(b.column(1), block_bytes):
                found, owner = terms_of(data, off)
                coded = pc.dictionary_encode(found)
                cuts = np.searchsorted(owner, np.arange(len(off)))
                parts, whose = [], []
                for k in range(len(off) - 1):
                    x, y = int(cuts[k]), int(cuts[k + 1])
                    step = max(1, (piece_words or y - x) - overlap)
                    for p in range(x, max(x + 1, y - overlap), step) if y > x else ():
                        parts.append((p, min(y, p + step + overlap)))
                        whose.append(a + k)
                if not parts:
                    continue
                ids = b.column(0).take(pa.array(whose))
                code = coded.indices.to_numpy(zero_copy_only=False)
                yield pa.record_batch(
                    [pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
                     pa.array([coded.dictionary.to_pylist()], pa.list_(pa.binary())),
                     pa.array([np.concatenate([code[p:q] for p, q in parts])], pa.list_(pa.int32())),
                     pa.array([np.cumsum([0] + [q - p for p, q in parts])], pa.list_(pa.int64()))],
                    names=["ids", "vocabulary", "words", "off"])

    packed = rows.coalesce(max(1, math.ceil(total / block_bytes))).mapInArrow(
        pack, f"ids array<{kind}>, vocabulary array<binary>, words array<int>, off array<long>")
    packed = materialize(packed.withColumn("block", F.monotonically_increasing_id()), f"{name}-blocks")
    for (number,) in sorted(packed.select("block").collect()):
        t = packed.where(F.col("block") == number).toArrow()
        yield Block(t.column("ids").chunk(0).flatten(), pa.array(t.column("vocabulary")[0].as_py(), pa.binary()),
                    np.array(t.column("words")[0].as_py(), np.int32), np.array(t.column("off")[0].as_py(), np.int64))
