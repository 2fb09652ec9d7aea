"""Operator 7: chat formatting with a grammar round trip.

A conversation is rendered as ``### Role: text </turn>`` lines and read back by
a deterministic parser. The two marks are control strings: ``### `` followed by
a name and a colon opens a turn, `` </turn>`` closes one. Every text is first
rendered as it is; if the parser does not give back the very turns, the texts
that conflict are escaped (their mark gets a star), until it does. Escaping puts
one backslash more before each control string and the backslashes before it, and
the reader takes exactly one off. A role that is no plain word stands in
hexadecimal.

Defined results: rows are ordered by turn (null last), then role, then text; null
texts and roles are empty. Rows with a null conv_id form one conversation with a
null id. Roles may hold any text. The loss mask covers the texts of the turns
whose role is ``assistant``. An empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship_code

OPEN, CLOSE, COLON = "### ", "</turn>", ": "
_CONTROL = re.compile(r"\\*(?:### |</turn>)")
_ESCAPED = re.compile(r"\\(\\*(?:### |</turn>))")
_END = re.compile(r"(?<!\\)</turn>\n")


class FormatError(ValueError):
    """The text is no conversation of the grammar."""


def escape(text: str) -> str:
    """One backslash more before every control string and its backslashes."""
    return _CONTROL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    """Takes off what ``escape`` put on."""
    return _ESCAPED.sub(lambda m: m[1], text)


def _name(role: str) -> str:
    """How a role stands in the mark: capitalised words as they are, anything
    else in hexadecimal, so that no role can hold a mark."""
    if role and role.isascii() and role.isalpha() and role.islower():
        return role.capitalize()
    return "0" + role.encode("utf-8", "surrogatepass").hex()


def _role(name: str) -> str:
    if name[:1] == "0":
        return bytes.fromhex(name[1:]).decode("utf-8", "surrogatepass")
    return name.lower()


def render(turns: list[tuple[str, str]], escaped: set[int]) -> str:
    """The conversation's text; turns whose place is in ``escaped`` are escaped."""
    return "".join(f"{OPEN}{_name(r)}{'*' if k in escaped else ''}{COLON}"
                   f"{escape(t) if k in escaped else t} {CLOSE}\n" for k, (r, t) in enumerate(turns))


def parse(text: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start, end) of each turn; start and end span the turn's
    (escaped) text. The grammar: turns one after the other, nothing between."""
    out, at = [], 0
    while at < len(text):
        if not text.startswith(OPEN, at):
            raise FormatError(f"no turn at {at}")
        colon = text.find(COLON, at + len(OPEN))
        if colon < 0:
            raise FormatError("no role")
        name = text[at + len(OPEN):colon]
        marked = name.endswith("*")
        name = name.removesuffix("*")
        if not re.fullmatch(r"[A-Z][a-z]*|0(?:[0-9a-f]{2})*", name):
            raise FormatError("no role")
        start = colon + len(COLON)
        m = _END.search(text, start)
        if m is None or text[m.start() - 1] != " " or m.start() - 1 < start:
            raise FormatError("open turn")
        end = m.start() - 1
        body = text[start:end]
        if not marked and (OPEN in body or CLOSE in body):
            raise FormatError("control string in a plain turn")
        out.append((_role(name), unescape(body) if marked else body, start, end))
        at = m.end()
    return out


def format_conversation(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[str, str, int, int]]]:
    """The rendered text and what the parser reads from it, equal to ``turns``.
    Conflicting turns are escaped until the round trip is exact."""
    escaped: set[int] = set()
    while True:
        text = render(turns, escaped)
        try:
            back = parse(text)
        except FormatError:
            back = None
        if back is not None and [(r, t) for r, t, _, _ in back] == turns:
            return text, back
        conflicts = {k for k, turn in enumerate(turns) if k not in escaped and not _alone(turn)}
        if not conflicts:
            raise FormatError("the conversation can't be rendered")
        escaped |= conflicts


def _alone(turn: tuple[str, str]) -> bool:
    """Whether the turn by itself survives the round trip unescaped."""
    try:
        back = parse(render([turn], set()))
    except FormatError:
        return False
    return len(back) == 1 and back[0][:2] == turn


def conversation_turns(conversations: DataFrame) -> DataFrame:
    """conv_id and its ordered turns, one row per conversation."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    item = F.struct(F.col("turn").isNull().alias("last"), F.col("turn").alias("turn"), role.alias("role"),
                    text.alias("text"))
    return (conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(item)).alias("t"))
            .select("conv_id", F.transform("t", lambda x: x.role).alias("roles"),
                    F.transform("t", lambda x: x.text).alias("texts")))


def format_conversations(conversations: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_spans (code-point start and end of each
    assistant text in formatted) and the digests of what is read back."""
    ship_code(conversations.sparkSession)
    turns = conversation_turns(conversations)

    def run(batches):
        for b in batches:
            cols = {k: [] for k in ("formatted", "loss_starts", "loss_ends", "n_turns", "turns_sha256", "loss_chars",
                                    "loss_sha256", "formatted_chars")}
            for roles, texts in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                text, _ = format_conversation(list(zip(roles, texts)))
                back = parse(text)
                loss = [x for x in back if x[0] == "assistant"]
                said = "".join(x[1] for x in loss)
                cols["formatted"].append(text)
                cols["loss_starts"].append([x[2] for x in loss])
                cols["loss_ends"].append([x[3] for x in loss])
                cols["n_turns"].append(len(back))
                cols["turns_sha256"].append(hashlib.sha256("".join(f"{r}\n{t}\n" for r, t, _, _ in back).encode()).hexdigest())
                cols["loss_chars"].append(len(said))
                cols["loss_sha256"].append(hashlib.sha256(said.encode()).hexdigest())
                cols["formatted_chars"].append(len(text))
            yield pa.record_batch(
                [b.column(0), pa.array(cols["formatted"], pa.string()),
                 *[pa.array(cols[k], pa.list_(pa.int64())) for k in ("loss_starts", "loss_ends")],
                 pa.array(cols["n_turns"], pa.int64()), pa.array(cols["turns_sha256"], pa.string()),
                 pa.array(cols["loss_chars"], pa.int64()), pa.array(cols["loss_sha256"], pa.string()),
                 pa.array(cols["formatted_chars"], pa.int64())], names=["conv_id", *cols])

    kind = turns.schema["conv_id"].dataType.simpleString()
    return turns.mapInArrow(run, f"conv_id {kind}, formatted string, loss_starts array<long>, loss_ends array<long>, "
                                 "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
                                 "formatted_chars long")
