"""Chat formatting by compiled templates.

The template language has text, ``{{ expression }}``, ``{% for m in messages %}``, ``{% if %}/{% elif %}/{% else %}``
and ``{% generation %}`` (what it encloses is under the loss mask). Expressions have strings, integers, ``True``,
``False``, ``None``, names, ``m.field`` of messages and loops, ``+``, comparisons, ``in``, ``and``, ``or``, ``not``,
brackets and a few filters; there are no calls and no Python attributes, so a template reaches nothing else. A template
is parsed into a syntax tree, constant parts are folded, and the tree becomes Python closures that give text segments
one by one, so that a long conversation is never held whole.
"""

from __future__ import annotations

import hashlib
import operator
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<role>", "</role>")
TEMPLATE = (
    "<s>{% for m in messages %}"
    "{% if m.role == 'user' %}[INST] {{ m.text | escape }} [/INST]"
    "{% elif m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}</s>"
    "{% else %}<role>{{ m.role | escape }}</role><<SYS>>{{ m.text | escape }}<</SYS>>{% endif %}"
    "{% endfor %}"
)
CHUNK = 1 << 16


def escape(text: str, controls: tuple[str, ...] = CONTROLS) -> str:
    """A backslash before each backslash, and after the first character of each control string."""
    text = text.replace("\\", "\\\\")
    return re.sub("|".join(f"(?<={re.escape(c[0])})(?={re.escape(c[1:])})" for c in controls), r"\\", text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


FILTERS: dict[str, Callable[[Any], Any]] = {"escape": lambda x: escape(str(x)), "trim": lambda x: str(x).strip(), "upper": lambda x: str(x).upper(), "lower": lambda x: str(x).lower(), "length": len}
OPERATORS = {"==": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge, "+": operator.add, "in": lambda a, b: a in b}


class TemplateError(ValueError):
    """A template that isn't in the language."""


@dataclass
class Node:
    """A node of the syntax tree: text, value, name, field, op, not, and, or, filter, print, if, for, generation, block."""

    kind: str
    value: Any = None
    parts: list[Any] = field(default_factory=list)


_TAG = re.compile(r"\{\{(.*?)\}\}|\{%-?\s*(.*?)\s*-?%\}|\{#.*?#\}", re.DOTALL)
_TOKEN = re.compile(r"\s*(?:('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(\d+)|([A-Za-z]\w*)|(==|!=|<=|>=|[-<>+()|.]))")


class _Expression:
    """Recursive descent over one expression."""

    def __init__(self, source: str):
        self.tokens, at = [], 0
        source = source.rstrip()
        while at < len(source):
            if not (m := _TOKEN.match(source, at)):
                raise TemplateError(f"bad expression: {source!r}")
            self.tokens.append((m.lastindex, m[m.lastindex]))
            at = m.end()
        self.at = 0

    def peek(self) -> str | None:
        return self.tokens[self.at][1] if self.at < len(self.tokens) and self.tokens[self.at][0] > 2 else None

    def take(self, *what: str) -> str | None:
        if (got := self.peek()) in what:
            self.at += 1
            return got
        return None

    def whole(self) -> Node:
        node = self.either()
        if self.at != len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return node

    def either(self) -> Node:
        node = self.both()
        while self.take("or"):
            node = Node("or", None, [node, self.both()])
        return node

    def both(self) -> Node:
        node = self.negated()
        while self.take("and"):
            node = Node("and", None, [node, self.negated()])
        return node

    def negated(self) -> Node:
        return Node("not", None, [self.negated()]) if self.take("not") else self.compared()

    def compared(self) -> Node:
        node = self.added()
        while op := self.take("==", "!=", "<", "<=", ">", ">=", "in"):
            node = Node("op", op, [node, self.added()])
        return node

    def added(self) -> Node:
        node = self.filtered()
        while self.take("+"):
            node = Node("op", "+", [node, self.filtered()])
        return node

    def filtered(self) -> Node:
        node = self.atom()
        while True:
            if self.take("|"):
                name = self.name()
                if name not in FILTERS:
                    raise TemplateError(f"no filter {name!r}")
                node = Node("filter", name, [node])
            elif self.take("."):
                node = Node("field", self.name(), [node])
            else:
                return node

    def name(self) -> str:
        if self.at < len(self.tokens) and self.tokens[self.at][0] == 3:
            self.at += 1
            return self.tokens[self.at - 1][1]
        raise TemplateError("a name is missing")

    def atom(self) -> Node:
        if self.at >= len(self.tokens):
            raise TemplateError("an expression ends early")
        kind, text = self.tokens[self.at]
        self.at += 1
        if kind == 1:
            return Node("value", re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), text[1:-1]))
        if kind == 2:
            return Node("value", int(text))
        if kind == 3:
            return Node("value", {"True": True, "False": False, "None": None}[text]) if text in ("True", "False", "None") else Node("name", text)
        if text == "(":
            node = self.either()
            if not self.take(")"):
                raise TemplateError("a bracket stays open")
            return node
        raise TemplateError(f"unexpected {text!r}")


def parse(source: str) -> Node:
    """The syntax tree of a template."""
    top, at = Node("block"), 0
    open_: list[tuple[str, Node]] = [("", top)]  # kind and the block that grows
    for m in _TAG.finditer(source):
        grow = open_[-1][1].parts
        if m.start() > at:
            grow.append(Node("text", source[at : m.start()]))
        at = m.end()
        if m[1] is not None:
            grow.append(Node("print", None, [_Expression(m[1]).whole()]))
        elif m[2] is not None:
            word, _, rest = m[2].partition(" ")
            if word == "for":
                if not (f := re.fullmatch(r"([A-Za-z]\w*)\s+in\s+(.+)", rest.strip())):
                    raise TemplateError(f"bad for: {rest!r}")
                grow.append(node := Node("for", f[1], [_Expression(f[2]).whole(), Node("block")]))
                open_.append(("for", node.parts[1]))
            elif word == "if":
                grow.append(node := Node("if", None, [(_Expression(rest).whole(), Node("block"))]))
                open_ += [("if", node), ("branch", node.parts[0][1])]
            elif word in ("elif", "else"):
                if open_[-1][0] != "branch":
                    raise TemplateError(f"{word} without if")
                open_.pop()
                open_[-1][1].parts.append((_Expression(rest).whole() if word == "elif" else Node("value", True), Node("block")))
                open_.append(("branch", open_[-1][1].parts[-1][1]))
            elif word == "generation":
                grow.append(node := Node("generation", None, [Node("block")]))
                open_.append(("generation", node.parts[0]))
            elif word in ("endfor", "endif", "endgeneration"):
                if open_.pop()[0] != {"endfor": "for", "endif": "branch", "endgeneration": "generation"}[word]:
                    raise TemplateError(f"{word} closes nothing")
                if word == "endif":
                    open_.pop()
            else:
                raise TemplateError(f"no statement {word!r}")
    if len(open_) > 1:
        raise TemplateError(f"{open_[-1][0]} stays open")
    if at < len(source):
        top.parts.append(Node("text", source[at:]))
    return top


def fold(node: Node) -> Node:
    """The tree with constant expressions evaluated, branches that can't be taken removed and adjacent texts joined."""
    if node.kind in ("value", "name", "text"):
        return node
    if node.kind == "if":
        kept: list[tuple[Node, Node]] = []
        for test, block in node.parts:
            test, block = fold(test), fold(block)
            if test.kind == "value" and not test.value:
                continue
            kept.append((test, block))
            if test.kind == "value":
                break
        return kept[0][1] if kept and kept[0][0].kind == "value" else Node("if", None, kept) if kept else Node("block")
    parts = [fold(p) for p in node.parts]
    if node.kind in ("op", "not", "and", "or", "filter") and all(p.kind == "value" for p in parts):
        return Node("value", _closure(Node(node.kind, node.value, parts))({}))
    if node.kind == "print" and parts[0].kind == "value":
        return Node("text", str(parts[0].value))
    if node.kind == "block":
        flat: list[Node] = []
        for p in parts:
            for q in p.parts if p.kind == "block" else [p]:
                if q.kind == "text" and flat and flat[-1].kind == "text":
                    flat[-1] = Node("text", flat[-1].value + q.value)
                elif q.kind != "text" or q.value:
                    flat.append(q)
        parts = flat
    return Node(node.kind, node.value, parts)


def _closure(node: Node) -> Callable[[dict], Any]:
    """A function of the variables that gives an expression's value."""
    v, parts = node.value, [_closure(p) for p in node.parts]
    match node.kind:
        case "value":
            return lambda env: v
        case "name":
            return lambda env: env.get(v)
        case "field":
            return lambda env: (x.get(v) if isinstance(x := parts[0](env), dict) else None)
        case "op":
            f = OPERATORS[v]
            return lambda env: f(parts[0](env), parts[1](env))
        case "not":
            return lambda env: not parts[0](env)
        case "and":
            return lambda env: parts[0](env) and parts[1](env)
        case "or":
            return lambda env: parts[0](env) or parts[1](env)
        case "filter":
            g = FILTERS[v]
            return lambda env: g(parts[0](env))
    raise TemplateError(f"{node.kind} isn't an expression")


Segment = tuple[str, bool]


def _writer(node: Node) -> Callable[[dict, bool], Iterator[Segment]]:
    """A function of the variables that gives a statement's segments; the flag says whether a generation encloses it."""
    v = node.value
    if node.kind == "text":

        def text(env: dict, marked: bool) -> Iterator[Segment]:
            yield v, marked

        return text
    if node.kind == "print":
        value = _closure(node.parts[0])

        def show(env: dict, marked: bool) -> Iterator[Segment]:
            yield str(value(env)), marked

        return show
    if node.kind == "if":
        branches = [(_closure(t), _writer(b)) for t, b in node.parts]

        def choose(env: dict, marked: bool) -> Iterator[Segment]:
            for test, write in branches:
                if test(env):
                    yield from write(env, marked)
                    return

        return choose
    if node.kind == "for":
        items, body = _closure(node.parts[0]), _writer(node.parts[1])

        def loop(env: dict, marked: bool) -> Iterator[Segment]:
            for k, item in enumerate(items(env) or ()):
                yield from body({**env, v: item, "loop": {"index": k + 1, "index0": k, "first": k == 0}}, marked)

        return loop
    inner = [_writer(p) for p in node.parts]

    def run(env: dict, marked: bool) -> Iterator[Segment]:
        for write in inner:
            yield from write(env, marked or node.kind == "generation")

    return run


def compile_template(source: str) -> Callable[[Iterable[dict]], Iterator[Segment]]:
    """A function that renders messages, read one at a time, as segments (text, whether it is under the loss mask)."""
    write = _writer(fold(parse(source)))
    return lambda messages: write({"messages": messages}, False)


FORMATTED = "conv_id {id}, chunk long, text string, masks array<struct<first:int,end:int>>, last boolean"


def format_conversations(turns: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """Render ``turns`` (conv_id, turn, role, text) by conversation, rows by turn; ties go by role and text, nulls first.

    Returns chunks of at most about 64 KB of a conversation's text in order (conv_id, chunk, text, masks, last), masks
    being the code points of the chunk under the loss mask. Conversations are streamed through sorted partitions, never
    gathered; a conversation is one sequence, so all of it passes through one task, however long it is. Null role and text count as empty, rows without conv_id form one conversation, repeated rows stay, an
    empty table gives no chunks, other columns are not read. A null or empty text under the mask has no code points.
    """
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render, kind = compile_template(template), None

        def messages() -> Iterator[tuple[Any, dict]]:
            nonlocal kind
            for batch in batches:
                kind = batch.schema.field(0).type
                for part in range(0, batch.num_rows, 500):
                    piece = batch.slice(part, 500)
                    for conv, role, text in zip(piece.column(0).to_pylist(), piece.column(2).to_pylist(), piece.column(3).to_pylist(), strict=True):
                        yield conv, {"role": role, "text": text}

        out: list[tuple] = []
        for conv, own in _runs(messages()):
            chunk, texts, masks, size = 0, [], [], 0
            for text, marked in render(own):
                for k in range(0, len(text), CHUNK):
                    part = text[k : k + CHUNK]
                    if size and size + len(part) > CHUNK:
                        out.append((conv, chunk, "".join(texts), masks, False))
                        chunk, texts, masks, size = chunk + 1, [], [], 0
                    if marked:
                        masks.append({"first": size, "end": size + len(part)})
                    texts.append(part)
                    size += len(part)
                if len(out) >= 64:
                    yield _batch(out, kind)
                    out = []
            out.append((conv, chunk, "".join(texts), masks, True))
            if len(out) >= 64:
                yield _batch(out, kind)
                out = []
        if out:
            yield _batch(out, kind)

    return rows.mapInArrow(run, FORMATTED.format(id=turns.schema["conv_id"].dataType.simpleString()))


def _batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    mask = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))
    types = (("conv_id", kind), ("chunk", pa.int64()), ("text", pa.string()), ("masks", mask), ("last", pa.bool_()))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), types, strict=True)], [n for n, _ in types])


def _runs(rows: Iterator[tuple[Any, dict]]) -> Iterator[tuple[Any, Iterator[dict]]]:
    """Adjacent rows of equal keys, each run as an iterator that is read to its end."""
    held = next(rows, None)
    while held is not None:
        key = held[0]

        def own() -> Iterator[dict]:
            nonlocal held
            while held is not None and held[0] == key:
                now, held = held, None
                yield now[1]
                held = next(rows, None)

        yield key, (it := own())
        for _ in it:
            pass


#: How a turn begins, and what ends it; a turn that begins otherwise is an assistant's.
_OPENS = {"user": "[INST] ", "role": "<role>"}
_ENDS = {"user": " [/INST]", "role": "</role><<SYS>>", "other": "<</SYS>>", "assistant": "</s>"}


class Unescaper:
    """Unescapes a text piece by piece: a backslash at a piece's end waits for what it escapes."""

    def __init__(self) -> None:
        self.held = ""

    def push(self, piece: str) -> str:
        text = self.held + piece
        self.held = "\\" * ((len(text) - len(text.rstrip("\\"))) % 2)
        return unescape(text[: len(text) - len(self.held)])


class Reader:
    """Reads one conversation's formatted text, chunk by chunk, back into turns and the text under its mask.

    Each character is looked at a fixed number of times, however long a turn is; only a role and the few characters that
    may begin a control string are held. With ``texts`` the turns are given whole as they end.
    """

    def __init__(self, texts: bool = False) -> None:
        self.rest, self.begun, self.turns, self.chars, self.loss_chars = "", False, 0, 0, 0
        self.turn_digest, self.loss_digest = hashlib.sha256(), hashlib.sha256()
        self.masked, self.said, self.state, self.role = Unescaper(), Unescaper(), "", ""
        self.texts, self.pieces = texts, []

    def push(self, text: str, masks: list[dict]) -> list[tuple[str, str]]:
        self.chars += len(text)
        for m in masks:
            said = self.masked.push(text[m["first"] : m["end"]])
            self.loss_chars += len(said)
            self.loss_digest.update(said.encode())
        self.rest += text
        if not self.begun and len(self.rest) >= 3:
            if not self.rest.startswith("<s>"):
                raise ValueError("a conversation begins with <s>")
            self.rest, self.begun = self.rest[3:], True
        return self._turns() if self.begun else []

    def _turns(self) -> list[tuple[str, str]]:
        found, text, at = [], self.rest, 0
        while at < len(text):
            if not self.state:
                opened = next((k for k, x in _OPENS.items() if text.startswith(x, at)), None)
                if opened is None and any(x.startswith(text[at:]) for x in _OPENS.values()):
                    break  # may still become an opening
                self.state = opened or "assistant"
                at += len(_OPENS.get(opened, ""))
                self._open("" if self.state == "role" else self.state)
            end = _ENDS[self.state]
            k = text.find(end, at)
            if k < 0:
                k = max(at, len(text) - len(end) + 1)
                self._say(text[at:k])
                at = k
                break
            self._say(text[at:k])
            at = k + len(end)
            if self.state == "role":
                self.state, role = "other", self.role
                self._open(role)
            else:
                self.turn_digest.update(b"\n")
                self.turns += 1
                if self.texts:
                    found.append((self.role, "".join(self.pieces)))
                self.state = ""
        self.rest = text[at:]
        return found

    def _open(self, role: str) -> None:
        self.role, self.said, self.pieces = role, Unescaper(), []
        if self.state != "role":
            self.turn_digest.update(f"{role}\n".encode())

    def _say(self, piece: str) -> None:
        said = self.said.push(piece)
        if self.state == "role":
            self.role += said
            return
        self.turn_digest.update(said.encode())
        if self.texts:
            self.pieces.append(said)

    def finish(self) -> tuple[int, str, int, str, int]:
        if self.rest or self.state or not self.begun:
            raise ValueError("a turn stays open")
        return self.turns, self.turn_digest.hexdigest(), self.loss_chars, self.loss_digest.hexdigest(), self.chars


def _read(formatted: DataFrame, give: Callable[[Reader, Any, list[tuple[str, str]], bool], list[tuple]], texts: bool, types: tuple, schema: str) -> DataFrame:
    """Rows that ``give`` makes of a reader after each chunk; chunks that don't follow one another are an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, conv, due = Reader(texts), None, 0
        for batch in batches:
            rows, kind = [], batch.schema.field("conv_id").type
            columns = [batch.column(batch.schema.get_field_index(c)) for c in ("conv_id", "chunk", "text", "masks", "last")]
            for k in range(batch.num_rows):
                own, chunk, text, masks, last = (c[k].as_py() for c in columns)
                if chunk != due or (due and own != conv):
                    raise ValueError(f"chunk {chunk} of conversation {own} follows chunk {due - 1} of conversation {conv}")
                conv, due = own, due + 1
                turns = reader.push(text, masks)
                rows += give(reader, own, turns, last)
                if last:
                    reader, due = Reader(texts), 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (kind, *types), strict=True)], [c.split()[0] for c in schema.split(", ")])
        if due:
            raise ValueError(f"conversation {conv} has no last chunk")

    names = ("conv_id", "chunk", "text", "masks", "last")
    return formatted.select(*names).mapInArrow(run, schema.format(id=formatted.schema["conv_id"].dataType.simpleString()))


def read_conversations(formatted: DataFrame) -> DataFrame:
    """Digests of conversations read back from chunks: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    Chunks have to stand in order within a partition, as ``format_conversations`` gives them; a missing, repeated or
    swapped chunk, a turn that stays open and a text that doesn't begin as the template does are errors. A null conv_id
    is a conversation like others; an empty table gives no rows; other columns are not read.
    """
    give = lambda reader, conv, turns, last: [(conv, *reader.finish())] if last else []
    types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    return _read(formatted, give, False, types, "conv_id {id}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def read_turns(formatted: DataFrame) -> DataFrame:
    """conv_id, turn (from 0), role and text of every turn, under the conditions of ``read_conversations``."""

    def give(reader: Reader, conv: Any, turns: list[tuple[str, str]], last: bool) -> list[tuple]:
        if last:
            reader.finish()
        first = reader.turns - len(turns)
        return [(conv, first + i, role, text) for i, (role, text) in enumerate(turns)]

    return _read(formatted, give, True, (pa.int64(), pa.string(), pa.string()), "conv_id {id}, turn long, role string, text string")
