"""Conversations as training text with loss flags (operator 12), by a finite-state machine over roles.

A declarative ``Template`` says which role may follow which state, what stands around a turn and whether its text is trained
on.  Each role leads to one state of its own and unknown roles leave the state alone, so a run of turns either sets the state
or keeps it.  That lets a conversation of any length be cut into pieces over tasks:

1. turns are dealt out by ranges of (conversation, turn), so a hot conversation spans as many tasks as its size asks for, and
   each task cuts what it reads into pieces of about ``PIECE_CHARS``;
2. the state before a piece is the last one that an earlier piece of its conversation sets: a window over a few numbers a
   piece, and only for conversations that reach a task's edge or have several pieces;
3. every piece is formatted by itself.

Control strings inside texts are broken by an escape, so markers are only where the template puts them and texts are read
back exactly.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import cut, slices, without_gc

PIECE_CHARS = 262_144
#: Begins every escape inside a text: itself doubled, or put after a control string's first character as ``\\.``.
ESCAPE = "\\"


@dataclass(frozen=True)
class Turn:
    """What a role's turn looks like: the states that it may follow, what stands around its text, and the state after it."""

    follows: tuple[str, ...]
    before: str
    close: str
    loss: bool
    to: str


@dataclass(frozen=True)
class Template:
    """``controls`` are the strings that no text may contain; ``before`` ends and ``close`` begins with white space and each holds
    a control string, ``other`` are the same three strings around an unknown role and its text."""

    turns: Mapping[str, Turn]
    controls: tuple[str, ...]
    opening: str = ""
    start: str = "start"
    other: tuple[str, str, str] = ("[ROLE] ", " [/ROLE] ", " [/TURN]")
    escaped: re.Pattern = field(init=False, repr=False, compare=False)

    def __post_init__(self) -> None:
        for c in self.controls:
            if len(c) < 2 or ESCAPE in c or re.search(r"\s", c):
                raise ValueError(f"{c!r} can't be a control string: two characters at least, no white space, no {ESCAPE}")
        around = [(t.before, t.close) for t in self.turns.values()] + [(self.other[0], self.other[1]), (self.other[0], self.other[2])]
        for before, close in around:
            if not (before[-1:].isspace() and close[:1].isspace() and all(any(c in s for c in self.controls) for s in (before, close))):
                raise ValueError(f"{before!r} must end and {close!r} begin with white space, and each hold a control string")
        begins = [self.other[0], *(t.before for t in self.turns.values())]
        if len(set(begins)) < len(begins) or any(a != b and a.startswith(b) for a in begins for b in begins):
            raise ValueError("each role needs a beginning of its own")
        object.__setattr__(self, "escaped", re.compile("|".join([re.escape(ESCAPE), *(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in self.controls)])))

    # -- texts -----------------------------------------------------------

    def escape(self, text: str) -> str:
        return self.escaped.sub(lambda m: ESCAPE + ESCAPE if m[0] == ESCAPE else f"{m[0]}{ESCAPE}.", text)

    @staticmethod
    def unescape(text: str) -> str:
        return re.sub(r"\\(.)", lambda m: ESCAPE if m[1] == ESCAPE else "", text, flags=re.DOTALL)

    # -- the machine -----------------------------------------------------

    def format(self, state: str, turns: Iterable[tuple[str | None, str | None]]) -> tuple[list[tuple[str, bool]], int, str]:
        """Segments (text, loss) of (role, text) turns from a state, how many turns are out of order, and the state after them."""
        segments, wrong = [], 0
        for role, text in turns:
            opening = self.opening if state == self.start else ""
            body, turn = self.escape(text or ""), self.turns.get(role or "")
            if turn:
                wrong += state not in turn.follows
                segments += [(opening + turn.before, False), (body, turn.loss), (turn.close, False)]
                state = turn.to
            else:
                wrong += 1
                a, b, c = self.other
                segments += [(opening + a + self.escape(role or "") + b, False), (body, False), (c, False)]
                state = "other" if state == self.start else state
        return segments, wrong, state

    def state_after(self, roles: Iterable[str | None]) -> str | None:
        """The state that the roles lead to whatever was before, or None if they keep it."""
        state = None
        for role in roles:
            if role in self.turns:
                state = self.turns[role].to
        return state

    def read(self, text: str) -> list[tuple[str, str]]:
        """(role, text) of formatted turns; an unknown null role is read as an empty one."""
        found, at = [], 0
        while at < len(text):
            if self.opening and text.startswith(self.opening, at):
                at += len(self.opening)
            role = next((r for r, t in self.turns.items() if text.startswith(t.before, at)), None)
            if role is not None:
                before, close = self.turns[role].before, self.turns[role].close
            else:
                before, middle, close = self.other
                if not text.startswith(before, at):
                    raise ValueError(f"no turn begins at character {at}")
                end = text.index(middle, at + len(before))
                role, at, before = self.unescape(text[at + len(before) : end]), end, middle
            at += len(before)
            end = text.index(close, at)
            found.append((role, self.unescape(text[at:end])))
            at = end + len(close)
        return found


#: One instruction format; another is another value.
TEMPLATE = Template(
    turns={
        "system": Turn(("start",), "<<SYS>>\n", "\n<</SYS>>\n", False, "briefed"),
        "user": Turn(("start", "briefed", "answered"), "[INST] ", " [/INST]", False, "asked"),
        "assistant": Turn(("asked",), "[OUT] ", " </s>", True, "answered"),
    },
    controls=("<s>", "</s>", "[INST]", "[/INST]", "[OUT]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]", "[/TURN]"),
    opening="<s>",
)

TURN = pa.struct([("role", pa.string()), ("text", pa.string())])
SEGMENT = pa.struct([("text", pa.string()), ("loss", pa.bool_())])


def _cut_up(template: Template, size: int, schema: pa.Schema) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sorted turns -> pieces; ``alone``: the piece is a whole conversation, which neither edge of the task's rows touches."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, rows = TaskContext.get().partitionId() << 32, 0
        key, turns, chars, first, pieces = object(), [], 0, True, 0

        def piece(closed: bool) -> tuple:
            roles = [t["role"] for t in turns]
            known = template.state_after(roles)
            # a state that only unknown roles reach is kept by the next piece, unless it is the start
            return key, number + rows, closed and not first and not pieces, known, len(turns), turns

        out: list[tuple] = []
        for batch in batches:
            for part in slices(batch):
                for k, role, text in zip(*(part.column(i).to_pylist() for i in range(3))):
                    if k != key:
                        if turns:
                            out.append(piece(True))
                            rows, first, turns, chars, pieces = rows + 1, False, [], 0, 0
                        elif pieces:
                            first, pieces = False, 0
                        key = k
                    elif chars >= size:
                        out.append(piece(False))
                        rows, turns, chars, pieces = rows + 1, [], 0, pieces + 1
                    turns.append({"role": role, "text": text})
                    chars += len(text or "") + 1
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)
                    out = []
        if turns:
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(piece(False), schema.types)], schema=schema)

    return run


def format_conversations(conversations: DataFrame, template: Template = TEMPLATE, piece_chars: int = PIECE_CHARS, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Pieces of every conversation: ``conv_id``, ``part`` (orders a conversation's pieces), ``alone`` (it is the only one),
    ``segments`` (array of text and loss; their texts make the training text) and ``n_wrong`` (turns that the order forbids).

    Turns go by ``turn``, nulls first, ties by role and text; repeated turns are kept.  Turns out of order are formatted all the
    same and counted.  A null text is an empty one, a null role an unknown one, and turns with a null conversation make one
    conversation.  Other columns are not read.
    """
    key_type = conversations.schema[conv_col].dataType
    raw = conversations.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))
    order: list[Column | str] = ["conv_id", "turn", "role", F.xxhash64("text")]
    dealt = raw.repartitionByRange(*order).sortWithinPartitions(*order, "text").select("conv_id", "role", "text")
    schema = pa.schema([("conv_id", to_arrow_type(key_type)), ("part", pa.int64()), ("alone", pa.bool_()), ("sets", pa.string()), ("n_turns", pa.int64()), ("turns", pa.list_(TURN))])
    pieces = cut(dealt.mapInArrow(_cut_up(template, piece_chars, schema), f"conv_id {key_type.simpleString()}, part bigint, alone boolean, sets string, n_turns bigint, turns array<struct<role:string,text:string>>"), "chat-pieces")

    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # turns before it but no state set: only unknown roles so far
    unset = F.when(F.coalesce(F.sum("n_turns").over(earlier), F.lit(0)) > 0, "other").otherwise(template.start)
    states = pieces.where("not alone").select("part", F.coalesce(F.last("sets", ignorenulls=True).over(earlier), unset).alias("state"))
    known = pieces.where("alone").select("conv_id", "part", "alone", F.lit(template.start).alias("state"), "turns")
    found = pieces.where("not alone").join(states, "part").select("conv_id", "part", "alone", "state", "turns")

    out = pa.schema([("conv_id", to_arrow_type(key_type)), ("part", pa.int64()), ("alone", pa.bool_()), ("segments", pa.list_(SEGMENT)), ("n_wrong", pa.int64())])

    def formatted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with without_gc():
            for batch in batches:
                for part in slices(batch):
                    done = [template.format(s, ((t["role"], t["text"]) for t in turns)) for s, turns in zip(part.column(3).to_pylist(), part.column(4).to_pylist())]
                    segments = [[{"text": t, "loss": loss} for t, loss in d[0]] for d in done]
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(segments, pa.list_(SEGMENT)), pa.array([d[1] for d in done], pa.int64())], schema=out)

    return known.unionAll(found).mapInArrow(formatted, f"conv_id {key_type.simpleString()}, part bigint, alone boolean, segments array<struct<text:string,loss:boolean>>, n_wrong bigint")


DIGEST = "n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, n_wrong bigint"


def read_digests(formatted: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """What is read back from formatted pieces, a row a conversation: digests of its turns and of the text under the loss mask.

    A digest runs over a conversation's bytes in order, so pieces of one that has several stream through one task, one piece in
    memory at a time; conversations of one piece, nearly all, stay where they are.
    """
    key_type = formatted.schema["conv_id"].dataType
    schema = pa.schema([("conv_id", to_arrow_type(key_type)), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_wrong", pa.int64())])

    def stream(single: bool) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key, open_, n, chars, lost, wrong = None, False, 0, 0, 0, 0
            turns, loss = hashlib.sha256(), hashlib.sha256()
            for batch in batches:
                for part in slices(batch):
                    out = []
                    for k, segments, bad in zip(*(part.column(i).to_pylist() for i in range(3))):
                        if open_ and (single or k != key):
                            out.append((key, n, turns.hexdigest(), lost, loss.hexdigest(), chars, wrong))
                            n = chars = lost = wrong = 0
                            turns, loss = hashlib.sha256(), hashlib.sha256()
                        key, open_ = k, True
                        text = "".join([s["text"] for s in segments])
                        said = template.read(text)
                        turns.update("".join([f"{role}\n{body}\n" for role, body in said]).encode())
                        under = "".join([template.unescape(s["text"]) for s in segments if s["loss"]])
                        loss.update(under.encode())
                        n, chars, lost, wrong = n + len(said), chars + len(text), lost + len(under), wrong + bad
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)
            if open_:
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((key, n, turns.hexdigest(), lost, loss.hexdigest(), chars, wrong), schema.types)], schema=schema)

        return run

    ddl = f"conv_id {key_type.simpleString()}, {DIGEST}"
    columns = ("conv_id", "segments", "n_wrong")
    whole = formatted.where("alone").select(*columns).mapInArrow(stream(True), ddl)
    several = formatted.where("not alone").repartition("conv_id").sortWithinPartitions("conv_id", "part").select(*columns).mapInArrow(stream(False), ddl)
    return whole.unionAll(several)
