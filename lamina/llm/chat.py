"""Chat formatting with a finite-state machine over roles and a declarative template.

A template names, for each role, the mark that opens a turn, the mark that closes it and whether
its text is learnt. Conversations stream through a task in (conv_id, turn) order: the machine checks
the order of roles and emits segments (mark, text, mark) with a loss flag each; only text of roles
with ``loss`` is under the loss mask. Control strings inside texts are escaped by a backslash after
their first character (one more if there are some already), which unescape() undoes exactly.

A task holds one row and one segment at a time, never a conversation, so a conversation of any
length only takes time. Digests read the formatted output back with a parser that knows nothing
but the template.

Null texts are empty, null or unknown roles get a mark that carries their (escaped) name, rows
that tie on (conv_id, turn) go in order of role and text, repeated rows are turns like any others.
A conversation whose order of roles is wrong is formatted all the same; ``problem`` says what the
machine met first. A null conv_id is a conversation of its own.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Role:
    opens: str
    closes: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    roles: dict[str, Role]
    #: For each state, the roles that may follow and the state that they lead to. "" is the start.
    follows: dict[str, dict[str, str]]
    #: States in which a conversation may end.
    ends: frozenset[str]
    #: Opens and closes turns of roles that the template doesn't name.
    other_opens: str = "<<ROLE>>"
    other_name_ends: str = "<</ROLE>>"
    other_closes: str = "<<END>>"
    #: Further strings that must not occur in texts.
    reserved: tuple[str, ...] = ("<s>",)
    controls: tuple[str, ...] = field(init=False)

    def __post_init__(self):
        marks = [m.strip() for r in self.roles.values() for m in (r.opens, r.closes)]
        found = {*marks, self.other_opens, self.other_name_ends, self.other_closes, *self.reserved} - {""}
        object.__setattr__(self, "controls", tuple(sorted(found, key=lambda c: (-len(c), c))))
        opens = [r.opens for r in self.roles.values()] + [self.other_opens]
        if any(a != b and a.startswith(b) for a in opens for b in opens) or any(not r.closes.strip() for r in self.roles.values()):
            raise ValueError("opening marks must not begin each other, and closing marks must not be blank")


INSTRUCT = Template(
    roles={
        "system": Role("<<SYS>>\n", "\n<</SYS>>\n"),
        "user": Role("[INST] ", " [/INST]"),
        "assistant": Role("<s>", "</s>", loss=True),
    },
    follows={
        "": {"system": "system", "user": "user"},
        "system": {"user": "user"},
        "user": {"assistant": "assistant"},
        "assistant": {"user": "user"},
    },
    ends=frozenset({"assistant"}),
)


def _patterns(template: Template) -> tuple[re.Pattern, re.Pattern]:
    bare = "|".join(rf"{re.escape(c[0])}\\*{re.escape(c[1:])}" for c in template.controls)
    escaped = "|".join(rf"{re.escape(c[0])}\\+{re.escape(c[1:])}" for c in template.controls)
    return re.compile(bare), re.compile(escaped)


def escape(template: Template, text: str) -> str:
    return _patterns(template)[0].sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text)


def unescape(template: Template, text: str) -> str:
    return _patterns(template)[1].sub(lambda m: m[0][0] + m[0][2:], text)


SEGMENTS = "conv_id long, segment long, turn_no long, role string, kind string, text string, loss boolean, problem string"
_ARROW = pa.schema([("conv_id", pa.int64()), ("segment", pa.int64()), ("turn_no", pa.int64()), ("role", pa.string()), ("kind", pa.string()), ("text", pa.string()), ("loss", pa.bool_()), ("problem", pa.string())])


def segments_of(template: Template, rows: Iterable[tuple]) -> Iterator[tuple]:
    """rows: (conv_id, role, text), a conversation's rows together and in order. The last segment of a conversation has kind 'end', no text, and the problem found, if any."""
    state, current, n, turn, problem, begun = "", None, 0, 0, None, False
    for conv, role, text in rows:
        if not begun or conv != current:
            if begun:
                yield _end(template, current, n, turn, state, problem)
            state, current, n, turn, problem, begun = "", conv, 0, 0, None, True
        if state is not None:
            state = template.follows.get(state, {}).get(role)
            if state is None:
                problem = f"turn {turn}: {role} may not stand here"
        known = template.roles.get(role)
        if known:
            opens, closes, loss = known.opens, known.closes, known.loss
        else:
            opens, closes, loss = f"{template.other_opens}{escape(template, role or '')}{template.other_name_ends}", template.other_closes, False
        for kind, part in (("opens", opens), ("text", escape(template, text or "")), ("closes", closes)):
            yield conv, n, turn, role, kind, part, loss and kind == "text", None
            n += 1
        turn += 1
    if begun:
        yield _end(template, current, n, turn, state, problem)


def _end(template, conv, n, turn, state, problem):
    if problem is None and state not in template.ends:
        problem = f"it ends after {state}"
    return conv, n, turn, None, "end", "", False, problem


def format_chats(conversations: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """Segments (conv_id, segment, turn_no, role, kind, text, loss, problem), a conversation's together and in order in one partition."""

    def emit(batches):
        def rows():
            for b in batches:
                yield from zip(*(b.column(i).to_pylist() for i in range(3)), strict=True)

        held, chars = [], 0
        for s in segments_of(template, rows()):
            held.append(s)
            chars += len(s[5])
            if len(held) >= 4096 or chars > 1 << 20:
                yield _batch(held, _ARROW)
                held, chars = [], 0
        if held:
            yield _batch(held, _ARROW)

    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("_turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "_turn", "role", "text")
    return ordered.select("conv_id", "role", "text").mapInArrow(emit, SEGMENTS)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


class Reader:
    """Reads turns back from formatted text that comes in pieces.

    Marks cannot occur in escaped texts, so the next closing mark ends a turn. One turn is held at most.
    """

    def __init__(self, template: Template, on_role, on_text):
        self.t, self.on_role, self.on_text = template, on_role, on_text
        self.buffer, self.closes = "", None
        self.opens = {r.opens: (name, r.closes) for name, r in template.roles.items()}

    def feed(self, piece: str) -> None:
        self.buffer += piece
        while self._step():
            pass

    def _step(self) -> bool:
        b = self.buffer
        if self.closes is None:
            for opens, (name, closes) in self.opens.items():
                if b.startswith(opens):
                    self.buffer, self.closes = b[len(opens) :], closes
                    self.on_role(name)
                    return True
            if b.startswith(self.t.other_opens) and (at := b.find(self.t.other_name_ends)) >= 0:
                self.on_role(unescape(self.t, b[len(self.t.other_opens) : at]))
                self.buffer, self.closes = b[at + len(self.t.other_name_ends) :], self.t.other_closes
                return True
            return False
        at = b.find(self.closes)
        if at >= 0:
            self.on_text(unescape(self.t, b[:at]))
            self.buffer, self.closes = b[at + len(self.closes) :], None
            return True
        return False


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, problem string"
_DIGESTS = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("problem", pa.string())])


def digests(segments: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """One row per conversation, read back from format_chats()'s output as it comes (same partitions, same order).

    turns_sha256 covers role, line feed, text, line feed of every turn; loss_sha256 the text under the loss mask.
    """

    def read(batches):
        out = []
        one = None
        for b in batches:
            for conv, kind, text, loss, problem in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                one = one or _Digest(template)
                if kind != "end":
                    one.add(text, loss)
                    continue
                out.append((conv, *one.result(), problem))
                one = None
                if len(out) >= 4096:
                    yield _batch(out, _DIGESTS)
                    out = []
        if out:
            yield _batch(out, _DIGESTS)

    return segments.select("conv_id", "kind", "text", "loss", "problem").mapInArrow(read, DIGESTS)


class _Digest:
    def __init__(self, template: Template):
        self.template = template
        self.turns, self.n, self.chars = hashlib.sha256(), 0, 0
        self.loss, self.loss_chars = hashlib.sha256(), 0
        self.reader = Reader(template, self._role, self._text)

    def add(self, text: str, loss: bool) -> None:
        self.chars += len(text)
        self.reader.feed(text)
        if loss:
            plain = unescape(self.template, text)
            self.loss_chars += len(plain)
            self.loss.update(plain.encode())

    def _role(self, name: str) -> None:
        self.n += 1
        self.turns.update(f"{name}\n".encode())

    def _text(self, text: str) -> None:
        self.turns.update(f"{text}\n".encode())

    def result(self) -> tuple:
        if self.reader.buffer or self.reader.closes:
            raise ValueError("formatted text that cannot be read back")
        return self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars
