"""Operator 9: BPE encoding by backtracking, decoding by an offset table.

The vocabulary file's merges define the tokens: 256 byte symbols, 256 byte
symbols that end a word, and one token per merge, whose id order is the merge
order. A word is a string over those 512 symbols. Its encoding is the one
sequence of tokens whose neighbours are all *compatible*: the merges of the two
tokens' concatenation give back exactly these two. The encoder walks from left
to right with the longest token that starts at the place (found by one pass of
an Aho-Corasick automaton over the reversed word), and falls back to the next
shorter one, or to the token before, while the pair-compatibility table rejects
the pair; a place that failed is never tried again, so the work is linear in
the word's length. Words repeat, so each task keeps encodings of short words
(at most ``CACHE_WORDS``); the result does not depend on it.

Text rules of the vocabulary file: the added tokens are cut out of the raw text
first; the rest is NFC, blanks become one space, lower case, then words are cut
by the file's pattern. Texts of plain Latin letters take the same rules by a
table; all others go through the tokenizer library's own normalizer and
word pattern, so both agree on every code point.

Decoding: a blob with all tokens' decoded bytes and an offset table; ids are
gathered at once, joined by a space as the file has no decoder.

Defined results: a null text is empty: no tokens, empty decoded text. Repeated
rows give repeated rows; other columns are ignored or carried. Texts are
encoded whole, whatever their length.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, releasing, ship_code

CACHE_WORDS, CACHE_CHARS, PAIRS = 1 << 16, 48, 1 << 17


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte value, as byte-level vocabularies have it."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 0
    for b in range(256):
        if b in set(keep):
            out[b] = chr(b)
        else:
            out[b] = chr(256 + extra)
            extra += 1
    return out


class Vocabulary:
    """Tokens, merges and the tables that encoder and decoder use."""

    def __init__(self, path: str) -> None:
        import ahocorasick
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        n = max([*vocab.values(), *(a["id"] for a in spec["added_tokens"])]) + 1
        self.names = [""] * n
        for k, v in vocab.items():
            self.names[v] = k
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        for k, v in self.special.items():
            self.names[v] = k
        # merge result, rank and the two parts of each token
        self.left, self.right = list(range(n)), list(range(n))
        self.rank = [-1] * n
        self.pair: dict[tuple[int, int], int] = {}
        for r, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            self.pair[x, y] = z
            if self.rank[z] < 0:
                self.left[z], self.right[z], self.rank[z] = x, y, r
        symbols = byte_symbols()
        base = {vocab[s]: chr(i) for i, s in enumerate(symbols)}
        base |= {vocab[s + self.suffix]: chr(256 + i) for i, s in enumerate(symbols)}
        self.string: list[str] = [base.get(i, "") for i in range(n)]
        for i in sorted((i for i in range(n) if self.rank[i] >= 0), key=self.rank.__getitem__):
            self.string[i] = self.string[self.left[i]] + self.string[self.right[i]]
        self.size = [len(s) for s in self.string]
        self.compatible: dict[int, bool] = {}
        self.by_string = self._whole_tokens()
        # reversed tokens: a match that ends at a place of the reversed word is a
        # token that starts at the mirrored place of the word
        self.automaton = ahocorasick.Automaton()
        for s, i in self.by_string.items():
            self.automaton.add_word(s[::-1], i)
        self.automaton.make_automaton()
        # next shorter token that is a prefix of a token
        self.shorter = [-1] * n
        for s, i in self.by_string.items():
            for k in range(len(s) - 1, 0, -1):
                j = self.by_string.get(s[:k])
                if j is not None:
                    self.shorter[i] = j
                    break
        # decoding: blob of names and offsets
        blobs = [x.encode() for x in self.names]
        self.offsets = np.concatenate([[0], np.cumsum([len(b) for b in blobs])]).astype(np.int64)
        self.blob = np.frombuffer(b"".join(blobs), np.uint8)
        tok = Tokenizer.from_file(path)
        self.normalizer, self.cutter = tok.normalizer, tok.pre_tokenizer
        # plain texts: ASCII and Latin letters whose composition and case need no rules;
        # the file's word pattern over their lower case, with its classes spelt out
        self.plain = re.compile("[\t-\r\x20-\x7eÀ-ÖØ-öø-įĲ-ž]*")
        self.pattern = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ž]+|[0-9]|[^\t-\r\x20a-zß-öø-ž0-9]+")
        self.cut_special = (re.compile("|".join(re.escape(k) for k in sorted(self.special, key=len, reverse=True)))
                            if self.special else None)
        self.cache: dict[str, bytes] = {}
        self.back = {ord(s): i for i, s in enumerate(symbols)}

    # ------------------------------------------------ pair compatibility

    def fits(self, a: int, b: int, top: bool = True) -> bool:
        """Whether the tokens' concatenation is merged into just these two."""
        # Follow the border back in time: whichever side was merged last is
        # undone first. A merge across the border happens if it comes before the
        # merge that takes the border part into more; on equal rank the leftmost
        # merge comes first, so the left side's own goes before it, the right
        # side's own after it. ``top`` False leaves out the outermost pair.
        rank, pair = self.rank, self.pair
        a_taken = b_taken = 1 << 60
        while True:
            joined = pair.get((a, b)) if top else None
            if joined is not None and rank[joined] < a_taken and rank[joined] <= b_taken:
                return False
            top = True
            if rank[a] < 0 and rank[b] < 0:
                return True
            if rank[a] > rank[b]:
                a, a_taken = self.right[a], rank[a]
            else:
                b, b_taken = self.left[b], rank[b]

    def _whole_tokens(self) -> dict[str, int]:
        """Tokens that the merges of their own symbols give, by string; no other
        one can stand in an encoding."""
        whole = [r < 0 for r in self.rank]
        for i in sorted((i for i, r in enumerate(self.rank) if r >= 0), key=self.rank.__getitem__):
            a, b = self.left[i], self.right[i]
            whole[i] = whole[a] and whole[b] and self.fits(a, b, top=False)
        return {s: i for i, s in enumerate(self.string) if s and whole[i]}

    # ------------------------------------------------ encoder

    def encode_symbols(self, word: str) -> list[int]:
        """Token ids of a word given as a string of symbols."""
        token = self.by_string.get(word)
        if token is not None:
            return [token]
        n = len(word)
        longest = [-1] * n
        last = n
        for end, token in self.automaton.iter(word[::-1]):
            at = n - 1 - end
            if at != last:                     # the longest match of an end comes first
                longest[at] = token
                last = at
        size, shorter, compatible = self.size, self.shorter, self.compatible
        out: list[int] = []
        dead = bytearray(n + 1)
        at, token = 0, longest[0]
        while at < n:
            end = at + size[token]
            if not dead[end]:
                if out:
                    key = out[-1] << 32 | token
                    ok = compatible.get(key)
                    if ok is None:
                        ok = compatible[key] = self.fits(out[-1], token)
                        if len(compatible) > PAIRS:
                            compatible.clear()
                else:
                    ok = True
                if ok:
                    out.append(token)
                    at = end
                    token = longest[at] if at < n else -1
                    continue
            token = shorter[token]
            while token < 0:                   # no token goes on from here: take back the last one
                dead[at] = 1
                last = out.pop()
                at -= size[last]
                token = shorter[last]
        return out

    # ------------------------------------------------ texts

    def _bytes_ids(self, raw: bytes) -> bytes:
        s = raw[:-1].decode("latin-1") + chr(256 + raw[-1])
        return array("I", self.encode_symbols(s)).tobytes()

    def _plain_piece(self, piece: str) -> bytes:
        cache, out = self.cache, []
        for w in self.pattern.findall(piece.lower()):
            ids = cache.get(w)
            if ids is None:
                ids = self._bytes_ids(w.encode())
                if len(w) <= CACHE_CHARS and len(cache) < CACHE_WORDS:
                    cache[w] = ids           # the words met first are mostly the frequent ones
            out.append(ids)
        return b"".join(out)

    def _other_piece(self, piece: str) -> bytes:
        words = self.cutter.pre_tokenize_str(self.normalizer.normalize_str(piece))
        back = self.back
        return b"".join(self._bytes_ids(bytes(back[ord(c)] for c in w)) for w, _ in words if w)

    def encode(self, text: str) -> bytes:
        """Ids of a whole text, little-endian unsigned 32 bit."""
        if self.cut_special is None or self.cut_special.search(text) is None:
            return self._piece(text)
        out, at = [], 0
        for m in self.cut_special.finditer(text):
            out += [self._piece(text[at:m.start()]), np.uint32(self.special[m[0]]).astype("<u4").tobytes()]
            at = m.end()
        return b"".join([*out, self._piece(text[at:])])

    def _piece(self, piece: str) -> bytes:
        return self._plain_piece(piece) if self.plain.fullmatch(piece) else self._other_piece(piece)

    def decode(self, ids: np.ndarray, most: int = 1 << 17) -> bytes:
        """The decoded text's UTF-8, at most ``most`` ids gathered at a time."""
        out = []
        for k in range(0, len(ids), most):
            part = ids[k:k + most].astype(np.int64)
            start, size = self.offsets[part], self.offsets[part + 1] - self.offsets[part]
            ends = np.cumsum(size + 1)
            n = int(ends[-1])
            text = np.full(n, 32, np.uint8)
            shift = np.repeat(start - (ends - size - 1), size)
            where = np.arange(n)
            where = np.delete(where, ends - 1)
            text[where] = self.blob[where + shift]
            out.append(text[:-1].tobytes())
        return b" ".join(out)


@functools.lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    v = Vocabulary(path)
    release()                 # what only its building needed
    return v


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def bpe_digests(docs: DataFrame, path: str | None = None, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each whole text."""
    ship_code(docs.sparkSession)
    src = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def run(batches):
        v = vocabulary(path or default_path())
        for b in batches:
            n, ids_hex, text_hex = [], [], []
            for t in b.column(1):
                ids = v.encode(t.as_py() or "")
                n.append(len(ids) // 4)
                ids_hex.append(hashlib.sha256(ids).hexdigest())
                text_hex.append(hashlib.sha256(v.decode(np.frombuffer(ids, "<u4"))).hexdigest())
            yield pa.record_batch([b.column(0), pa.array(n, pa.int64()), pa.array(ids_hex, pa.string()),
                                   pa.array(text_hex, pa.string())],
                                  names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = src.schema["doc_id"].dataType.simpleString()
    return src.mapInArrow(releasing(run), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def bpe_encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """doc_id, ids (array of token ids) and the decoded text."""
    ship_code(docs.sparkSession)
    src = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def run(batches):
        v = vocabulary(path or default_path())
        for b in batches:
            for k in range(b.num_rows):
                ids = np.frombuffer(v.encode(b.column(1)[k].as_py() or ""), "<u4")
                yield pa.record_batch([b.column(0).slice(k, 1), pa.array([ids.astype(np.int32)], pa.list_(pa.int32())),
                                       pa.array([v.decode(ids).decode()])], names=["doc_id", "ids", "decoded"])

    kind = src.schema["doc_id"].dataType.simpleString()
    return src.mapInArrow(releasing(run), f"doc_id {kind}, ids array<int>, decoded string")
