"""Chat formatting with a small sandboxed template language.

A template is parsed into a syntax tree, constants are folded, and the tree is turned into Python
closures (generators) that render a conversation piece by piece, each piece with its loss flag.

Language: ``{{ expression }}``, ``{% for x in xs %}..{% else %}..{% endfor %}``,
``{% if %}..{% elif %}..{% else %}..{% endif %}``, ``{% set x = e %}``,
``{% generation %}..{% endgeneration %}`` (text under the loss mask) and ``{# comment #}``; a ``-`` inside
a delimiter trims white space on that side. Expressions: strings, integers, true/false/none, lists, names, ``a.b``,
``a['b']``, ``+ - * // % ~``, comparisons, ``in``, ``not/and/or``, ``a if c else b`` and filters after ``|``.

Sandbox: names are those given to the renderer or set in the template; a dot or bracket reads a
mapping's key or a list's index, never a Python attribute; there are no calls besides the listed filters;
products that repeat text are limited. ``messages`` is read as a stream, once, so that a conversation of any length
is rendered in bounded memory; a second loop over it is an error.

Defined results: null role or text is empty; a null conversation id is a conversation of its own; rows with equal turns
are ordered by role, then text; null turns come first; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import bound_batches, rows_of

Piece = tuple[str, bool]  # text, under the loss mask
Env = dict[str, Any]

#: A formatted conversation is handed on in parts of about so many characters.
PART_CHARS = 1 << 20
#: Longest text that a template's own ``*`` may make.
MAX_REPEAT = 10_000
#: Longest text or list that a template may make, and longest one that may be put to another of that length or more.
MAX_MADE, MAX_JOINED = 1 << 27, 1 << 20


class TemplateError(ValueError):
    """The template can't be parsed, or does what the sandbox forbids."""


# --------------------------------------------------------------------------- escaping
@dataclass(frozen=True)
class Escaper:
    """Makes control strings harmless inside texts, reversibly.

    Backslashes are doubled, then a single backslash is put behind the first character of each control
    string. Control strings have two characters at least, no backslash, and begin with a character that occurs in none of
    them later on; so a mark can't arise where a text meets a mark.
    """

    controls: tuple[str, ...]

    def __post_init__(self) -> None:
        firsts = {c[:1] for c in self.controls}
        for c in self.controls:
            if len(c) < 2 or "\\" in c or any(x in firsts for x in c[1:]):
                raise TemplateError(f"control string {c!r} can't be escaped safely")

    def escape(self, text: str) -> str:
        text = text.replace("\\", "\\\\")
        for c in self.controls:
            if c in text:
                text = text.replace(c, c[0] + "\\" + c[1:])
        return text

    def unescape(self, text: str) -> str:
        return re.sub(r"\\(\\?)", r"\1", text) if "\\" in text else text


# --------------------------------------------------------------------------- syntax tree
@dataclass
class Const:
    value: Any


@dataclass
class Name:
    name: str


@dataclass
class Item:
    base: Any
    key: Any


@dataclass
class Unary:
    op: str
    arg: Any


@dataclass
class Binary:
    op: str
    left: Any
    right: Any


@dataclass
class Choice:
    test: Any
    then: Any
    other: Any


@dataclass
class ListOf:
    items: list[Any]


@dataclass
class Filter:
    name: str
    arg: Any


@dataclass
class Text:
    text: str


@dataclass
class Output:
    expr: Any


@dataclass
class Assign:
    name: str
    expr: Any


@dataclass
class If:
    branches: list[tuple[Any, list[Any]]]
    other: list[Any] = field(default_factory=list)


@dataclass
class For:
    name: str
    source: Any
    body: list[Any]
    other: list[Any] = field(default_factory=list)


@dataclass
class Generation:
    body: list[Any]


_TAG = re.compile(r"\{\{-?.*?-?\}\}|\{%-?.*?-?%\}|\{#.*?#\}", re.S)
_TOKEN = re.compile(
    r"\s*(?:(?P<str>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<int>\d+)|(?P<name>[A-Za-z]\w*)|(?P<op>==|!=|<=|>=|//|[-+*%~<>|.,()\[\]=]))"
)
_WORDS = {"true": True, "false": False, "none": None, "True": True, "False": False, "None": None}
_KEYWORDS = {"and", "or", "not", "in", "if", "else"}
_BACKSLASH = {"n": "\n", "t": "\t", "r": "\r"}


class _Expression:
    """Recursive-descent parser of one expression."""

    def __init__(self, source: str):
        self.tokens: list[tuple[str, str]] = []
        at, source = 0, source.rstrip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"unexpected {source[at : at + 20]!r}")
            at = m.end()
            self.tokens.append((m.lastgroup or "", m[m.lastgroup or 0]))
        self.at = 0

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def take(self, *values: str) -> str | None:
        kind, value = self.peek()
        if kind in ("op", "name") and value in values:
            self.at += 1
            return value
        return None

    def need(self, value: str) -> None:
        if not self.take(value):
            raise TemplateError(f"expected {value!r}, found {self.peek()[1]!r}")

    def name(self) -> str:
        kind, value = self.peek()
        if kind != "name" or value in _KEYWORDS or value in _WORDS:
            raise TemplateError(f"expected a name, found {value!r}")
        self.at += 1
        return value

    def whole(self) -> Any:
        out = self.choice()
        if self.peek()[0] != "end":
            raise TemplateError(f"unexpected {self.peek()[1]!r}")
        return out

    def choice(self) -> Any:
        then = self.either()
        if self.take("if"):
            test = self.either()
            other = self.choice() if self.take("else") else Const("")
            return Choice(test, then, other)
        return then

    def _chain(self, below: Callable[[], Any], *ops: str) -> Any:
        left = below()
        while op := self.take(*ops):
            left = Binary(op, left, below())
        return left

    def either(self) -> Any:
        return self._chain(lambda: self._chain(self.negated, "and"), "or")

    def negated(self) -> Any:
        return Unary("not", self.negated()) if self.take("not") else self.compared()

    def compared(self) -> Any:
        left = self.added()
        while True:
            if op := self.take("==", "!=", "<", "<=", ">", ">=", "in"):
                left = Binary(op, left, self.added())
            elif self.take("not"):
                self.need("in")
                left = Unary("not", Binary("in", left, self.added()))
            else:
                return left

    def added(self) -> Any:
        return self._chain(lambda: self._chain(self.filtered, "*", "//", "%"), "+", "-", "~")

    def filtered(self) -> Any:
        out = self.unary()
        while self.take("|"):
            out = Filter(self.name(), out)
        return out

    def unary(self) -> Any:
        if self.take("-"):
            return Unary("-", self.unary())
        kind, value = self.peek()
        self.at += 1
        if kind == "str":
            out: Any = Const(re.sub(r"\\(.)", lambda m: _BACKSLASH.get(m[1], m[1]), value[1:-1], flags=re.S))
        elif kind == "int":
            out = Const(int(value))
        elif value == "(":
            out = self.choice()
            self.need(")")
        elif value == "[":
            items = []
            while not self.take("]"):
                items.append(self.choice())
                if not self.take(","):
                    self.need("]")
                    break
            out = ListOf(items)
        elif kind == "name" and value in _WORDS:
            out = Const(_WORDS[value])
        else:
            self.at -= 1
            out = Name(self.name())
        while True:
            if self.take("."):
                out = Item(out, Const(self.name()))
            elif self.take("["):
                out = Item(out, self.choice())
                self.need("]")
            else:
                return out


def parse(source: str) -> list[Any]:
    """The template's syntax tree."""
    parts: list[tuple[str, str]] = []  # kind: text, out or tag
    at, trim = 0, False
    for m in itertools.chain(_TAG.finditer(source), [None]):
        text = source[at : m.start()] if m else source[at:]
        text = text.lstrip() if trim else text
        trim = False
        if m:
            tag, at = m[0], m.end()
            text = text.rstrip() if tag[2] == "-" and tag[1] != "#" else text
        if text:
            parts.append(("text", text))
        if m and m[0][1] != "#":
            trim = m[0][-3] == "-"
            parts.append(("out" if m[0][1] == "{" else "tag", m[0][2:-2].strip("-").strip()))
    stream = iter(parts)

    def block(*ends: str) -> tuple[list[Any], str]:
        body: list[Any] = []
        for kind, value in stream:
            if kind == "text":
                body.append(Text(value))
                continue
            if kind == "out":
                body.append(Output(_Expression(value).whole()))
                continue
            word, _, rest = value.partition(" ")
            if word in ends:
                return body, value
            if word == "set":
                e = _Expression(rest)
                name = e.name()
                e.need("=")
                body.append(Assign(name, e.whole()))
            elif word == "if":
                branches, other, test = [], [], rest
                while True:
                    inner, end = block("elif", "else", "endif")
                    branches.append((_Expression(test).whole(), inner))
                    if not end.startswith("elif"):
                        break
                    test = end[4:]
                if end == "else":
                    other, _ = block("endif")
                body.append(If(branches, other))
            elif word == "for":
                e = _Expression(rest)
                name = e.name()
                e.need("in")
                source_expr = e.whole()
                inner, end = block("else", "endfor")
                body.append(For(name, source_expr, inner, block("endfor")[0] if end == "else" else []))
            elif word == "generation":
                body.append(Generation(block("endgeneration")[0]))
            else:
                raise TemplateError(f"unknown statement {value!r}")
        if ends:
            raise TemplateError(f"missing {ends[-1]}")
        return body, ""

    return block()[0]


# --------------------------------------------------------------------------- folding
def _times(a: Any, b: Any) -> Any:
    out_len = len(a) * b if isinstance(a, str) else len(b) * a if isinstance(b, str) else 0
    if out_len > MAX_REPEAT:
        raise TemplateError("a product repeats text too often")
    return a * b


def _made(x: Any) -> Any:
    """A value that the template made, if it isn't too large."""
    if isinstance(x, (str, list)) and len(x) > MAX_MADE:
        raise TemplateError("a value grows too large")
    return x


def _joined(a: Any, b: Any) -> Any:
    """Two texts or lists put together: the shorter one is bounded, so that doubling ends soon while a long text may get a frame."""
    if isinstance(b, (str, list)) and min(len(a), len(b)) > MAX_JOINED:
        raise TemplateError("a value grows too large")
    return _made(a + b)


_OPS: dict[str, Callable[[Any, Any], Any]] = {
    "+": lambda a, b: _joined(a, b) if isinstance(a, (str, list)) else a + b,
    "-": lambda a, b: a - b,
    "*": _times,
    "//": lambda a, b: a // b,
    "%": lambda a, b: a % b if isinstance(a, int) else _refuse("%"),
    "~": lambda a, b: _joined(_shown(a), _shown(b)),
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
    "in": lambda a, b: a in b,
}


def _refuse(what: str) -> Any:
    raise TemplateError(f"{what} isn't allowed here")


def _shown(x: Any) -> str:
    return x if isinstance(x, str) else "" if x is None else str(x)


def _item(base: Any, key: Any) -> Any:
    if isinstance(base, dict):
        return base.get(key)
    if isinstance(base, (list, str)) and isinstance(key, int):
        return base[key] if -len(base) <= key < len(base) else None
    raise TemplateError(f"can't read {key!r} of this value")


def _filters(escaper: Escaper) -> dict[str, Callable[[Any], Any]]:
    return {
        "trim": lambda x: _shown(x).strip(),
        "upper": lambda x: _made(_shown(x).upper()),
        "lower": lambda x: _made(_shown(x).lower()),
        "length": lambda x: len(x),
        "string": lambda x: _made(_shown(x)),
        "escape": lambda x: _made(escaper.escape(_shown(x))),
    }


def fold(node: Any, filters: dict[str, Callable[[Any], Any]]) -> Any:
    """An expression with its constant parts computed."""

    def const(*xs: Any) -> bool:
        return all(isinstance(x, Const) for x in xs)

    match node:
        case Unary(op, arg):
            arg = fold(arg, filters)
            return Const((not arg.value) if op == "not" else -arg.value) if const(arg) else Unary(op, arg)
        case Binary(op, left, right):
            left, right = fold(left, filters), fold(right, filters)
            if op in ("and", "or"):
                if const(left):
                    return right if bool(left.value) == (op == "and") else left
                return Binary(op, left, right)
            return Const(_OPS[op](left.value, right.value)) if const(left, right) else Binary(op, left, right)
        case Choice(test, then, other):
            test = fold(test, filters)
            if const(test):
                return fold(then if test.value else other, filters)
            return Choice(test, fold(then, filters), fold(other, filters))
        case ListOf(items):
            items = [fold(x, filters) for x in items]
            return Const([x.value for x in items]) if const(*items) else ListOf(items)
        case Filter(name, arg):
            if name not in filters:
                raise TemplateError(f"unknown filter {name!r}")
            arg = fold(arg, filters)
            return Const(filters[name](arg.value)) if const(arg) else Filter(name, arg)
        case Item(base, key):
            base, key = fold(base, filters), fold(key, filters)
            return Const(_item(base.value, key.value)) if const(base, key) else Item(base, key)
    return node


def fold_block(body: list[Any], filters: dict[str, Callable[[Any], Any]]) -> list[Any]:
    """A block with constants folded, dead branches dropped and neighbouring texts joined."""
    out: list[Any] = []
    for node in body:
        made: list[Any]
        match node:
            case Output(expr):
                expr = fold(expr, filters)
                made = [Text(_shown(expr.value))] if isinstance(expr, Const) else [Output(expr)]
            case Assign(name, expr):
                made = [Assign(name, fold(expr, filters))]
            case If(branches, other):
                kept, last = [], fold_block(other, filters)
                for test, inner in branches:
                    test = fold(test, filters)
                    if isinstance(test, Const):
                        if test.value:
                            last = fold_block(inner, filters)
                            break
                        continue
                    kept.append((test, fold_block(inner, filters)))
                made = [If(kept, last)] if kept else last
            case For(name, source, inner, other):
                made = [For(name, fold(source, filters), fold_block(inner, filters), fold_block(other, filters))]
            case Generation(inner):
                made = [Generation(fold_block(inner, filters))]
            case _:
                made = [node]
        for x in made:
            if isinstance(x, Text) and out and isinstance(out[-1], Text):
                out[-1] = Text(out[-1].text + x.text)
            elif not (isinstance(x, Text) and not x.text):
                out.append(x)
    return out


# --------------------------------------------------------------------------- closures
def _value(node: Any, filters: dict[str, Callable[[Any], Any]]) -> Callable[[Env], Any]:
    """A closure that computes an expression."""
    match node:
        case Const(value):
            return lambda env: value
        case Name(name):

            def read(env: Env) -> Any:
                if name not in env:
                    raise TemplateError(f"unknown name {name!r}")
                return env[name]

            return read
        case Item(base, key):
            b, k = _value(base, filters), _value(key, filters)
            return lambda env: _item(b(env), k(env))
        case Unary(op, arg):
            a = _value(arg, filters)
            return (lambda env: not a(env)) if op == "not" else (lambda env: -a(env))
        case Binary("and", left, right):
            l1, r1 = _value(left, filters), _value(right, filters)
            return lambda env: l1(env) and r1(env)
        case Binary("or", left, right):
            l2, r2 = _value(left, filters), _value(right, filters)
            return lambda env: l2(env) or r2(env)
        case Binary(op, left, right):
            l3, r3, f = _value(left, filters), _value(right, filters), _OPS[op]
            return lambda env: f(l3(env), r3(env))
        case Choice(test, then, other):
            t, y, n = (_value(x, filters) for x in (test, then, other))
            return lambda env: y(env) if t(env) else n(env)
        case ListOf(items):
            fs = [_value(x, filters) for x in items]
            return lambda env: [f(env) for f in fs]
        case Filter(name, arg):
            g, a2 = filters[name], _value(arg, filters)
            return lambda env: g(a2(env))
    raise TemplateError(f"can't compile {node!r}")


def _run(body: list[Any], filters: dict[str, Callable[[Any], Any]], masked: bool) -> Callable[[Env], Iterator[Piece]]:
    """A generator closure that renders a block."""
    steps: list[Callable[[Env], Iterable[Piece]]] = []
    for node in body:
        match node:
            case Text(text):
                steps.append(lambda env, piece=((text, masked),): piece)
            case Output(expr):
                f = _value(expr, filters)
                steps.append(lambda env, f=f: ((_shown(f(env)), masked),))
            case Assign(name, expr):

                def assign(env: Env, name: str = name, f: Callable[[Env], Any] = _value(expr, filters)) -> tuple[()]:
                    env[name] = f(env)
                    return ()

                steps.append(assign)
            case If(branches, other):

                def choose(
                    env: Env,
                    tests: list[Any] = [(_value(t, filters), _run(b, filters, masked)) for t, b in branches],  # noqa: B006
                    last: Any = _run(other, filters, masked),
                ) -> Iterator[Piece]:
                    return next((run for test, run in tests if test(env)), last)(env)

                steps.append(choose)
            case For(name, source, inner, other):

                def loop(
                    env: Env,
                    name: str = name,
                    src: Any = _value(source, filters),
                    run: Any = _run(inner, filters, masked),
                    last: Any = _run(other, filters, masked),
                ) -> Iterator[Piece]:
                    items, i, hidden = iter(src(env)), 0, {k: env[k] for k in (name, "loop") if k in env}
                    ahead = next(items, _END)
                    if ahead is _END:
                        yield from last(env)
                        return
                    while ahead is not _END:
                        now, ahead = ahead, next(items, _END)
                        env[name] = now
                        env["loop"] = {"index0": i, "index": i + 1, "first": i == 0, "last": ahead is _END}
                        yield from run(env)
                        i += 1
                    for k in (name, "loop"):
                        env.pop(k, None)
                    env.update(hidden)

                steps.append(loop)
            case Generation(inner):
                steps.append(_run(inner, filters, True))

    def run_all(env: Env) -> Iterator[Piece]:
        for step in steps:
            yield from step(env)

    return run_all


_END = object()


class _Once:
    """Messages as a stream that can be read once."""

    def __init__(self, items: Iterable[dict[str, Any]]):
        self.items: Iterable[dict[str, Any]] | None = items

    def __iter__(self) -> Iterator[dict[str, Any]]:
        if self.items is None:
            raise TemplateError("messages can be looped over once")
        items, self.items = self.items, None
        return iter(items)


class Template:
    """A compiled template: ``pieces(messages)`` yields texts, each with its loss flag."""

    def __init__(self, source: str, controls: tuple[str, ...] = (), variables: dict[str, Any] | None = None):
        self.source, self.controls, self.variables = source, controls, dict(variables or {})
        self.escaper = Escaper(controls)
        filters = _filters(self.escaper)
        self.tree = fold_block(parse(source), filters)
        self._render = _run(self.tree, filters, False)

    def __reduce__(self) -> tuple[Any, ...]:  # closures are made anew where the template arrives
        return Template, (self.source, self.controls, self.variables)

    def pieces(self, messages: Iterable[dict[str, Any]]) -> Iterator[Piece]:
        return self._render(self.variables | {"messages": _Once(messages)})

    def render(self, messages: Iterable[dict[str, Any]]) -> tuple[str, list[tuple[int, int]]]:
        """The whole text and the loss spans, in characters."""
        return next(_parts(self.pieces(messages), None))


#: Marks of the production format; fixed values of this format.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<|sys|>", "<|/sys|>", "<|role|>", "<|text|>", "<|end|>")
PRODUCTION = (
    "{% for m in messages %}"
    "{% if m.role == 'user' %}<s>[INST]{{ m.text | escape }}[/INST]"
    "{% elif m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}</s>"
    "{% elif m.role == 'system' %}<|sys|>{{ m.text | escape }}<|/sys|>"
    "{% else %}<|role|>{{ m.role | escape }}<|text|>{{ m.text | escape }}<|end|>{% endif %}"
    "{% endfor %}"
)


def production() -> Template:
    """The template of the registered query."""
    return Template(PRODUCTION, CONTROLS)


def _parts(pieces: Iterable[Piece], limit: int | None) -> Iterator[tuple[str, list[tuple[int, int]]]]:
    """Pieces gathered into parts of about ``limit`` characters, with loss spans inside the part. Pieces stay whole."""
    texts: list[str] = []
    spans: list[tuple[int, int]] = []
    at = 0
    for text, masked in pieces:
        if masked and text:
            if spans and spans[-1][1] == at:
                spans[-1] = (spans[-1][0], at + len(text))
            else:
                spans.append((at, at + len(text)))
        texts.append(text)
        at += len(text)
        if limit and at >= limit:
            yield "".join(texts), spans
            texts, spans, at = [], [], 0
    if texts or not limit:
        yield "".join(texts), spans


FORMATTED = "conv_id bigint, part int, formatted string, loss_spans array<struct<start:int,end:int>>"


def format_conversations(
    rows: DataFrame,
    template: Template,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """Conversations as formatted text with loss spans, in parts, each conversation's in order and in one partition.

    One shuffle by conversation and a sort that can spill; a conversation is then streamed, whatever its length.
    """
    source = rows.select(
        F.col(conv_col).cast("long").alias("conv_id"),
        F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    ordered = source.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    kind = pa.schema(
        [
            ("conv_id", pa.int64()),
            ("part", pa.int32()),
            ("formatted", pa.string()),
            ("loss_spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, Any]] = []
        chars = 0
        stream = rows_of(batches, ["conv_id", "role", "text"])
        for conv, turns in itertools.groupby(stream, key=lambda r: r[0]):
            messages = ({"role": role, "text": text} for _, role, text in turns)
            for part, (text, spans) in enumerate(_parts(template.pieces(messages), PART_CHARS)):
                held.append({"conv_id": conv, "part": part, "formatted": text, "loss_spans": [{"start": a, "end": b} for a, b in spans]})
                chars += len(text)
                if chars >= PART_CHARS or len(held) >= 1000:
                    yield pa.RecordBatch.from_pylist(held, schema=kind)
                    held, chars = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=kind)

    bound_batches(rows.sparkSession)
    return ordered.mapInArrow(run, FORMATTED)


_OPENERS = {"[INST]": "user", "<|sys|>": "system", "<|role|>": ""}
_MARK = re.compile("|".join(re.escape(c) for c in sorted(CONTROLS, key=len, reverse=True)))


class ProductionReader:
    """Reads the production format back, part by part: feed() returns the turns that are complete."""

    def __init__(self) -> None:
        self.escaper = Escaper(CONTROLS)
        self.rest = ""
        self.role: str | None = None
        self.open = ""

    def feed(self, text: str) -> Iterator[tuple[str, str]]:
        text = self.rest + text
        at = 0
        for m in _MARK.finditer(text):
            inner, mark = text[at : m.start()], m[0]
            if mark in ("[/INST]", "<|/sys|>", "<|end|>"):
                if self.role is None:
                    raise ValueError(f"{mark} without its start")
                yield self.role, self.escaper.unescape(inner)
                self.open = ""
            elif mark == "</s>":
                if self.open:
                    raise ValueError("</s> inside a turn")
                yield "assistant", self.escaper.unescape(inner)
            elif mark == "<|text|>":
                self.role = self.escaper.unescape(inner)
            else:
                if inner:
                    raise ValueError("text outside of turns")
                self.open, self.role = mark, _OPENERS.get(mark)
                if mark == "<s>":
                    self.open = ""
            at = m.end()
        self.rest = text[at:]

    def close(self) -> None:
        if self.rest or self.open:
            raise ValueError("the text ends inside a turn")


READ = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


def read_formatted(formatted: DataFrame) -> DataFrame:
    """What the formatted text holds: digests over turns and over the text under the loss mask.

    Expects each conversation's parts in order and in one partition, as format_conversations leaves them.
    """
    kind = pa.schema(
        [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict[str, Any]] = []
        stream = rows_of(batches, ["conv_id", "part", "formatted", "loss_spans"])
        for conv, parts in itertools.groupby(stream, key=lambda r: r[0]):
            reader, turns, loss = ProductionReader(), hashlib.sha256(), hashlib.sha256()
            n = loss_chars = chars = 0
            for _, _, text, spans in parts:
                chars += len(text)
                for role, said in reader.feed(text):
                    n += 1
                    turns.update(f"{role}\n{said}\n".encode())
                for s in spans:
                    said = reader.escaper.unescape(text[s["start"] : s["end"]])
                    loss_chars += len(said)
                    loss.update(said.encode())
            reader.close()
            out.append({"conv_id": conv, "n_turns": n, "turns_sha256": turns.hexdigest(), "loss_chars": loss_chars, "loss_sha256": loss.hexdigest(), "formatted_chars": chars})
            if len(out) >= 5000:
                yield pa.RecordBatch.from_pylist(out, schema=kind)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=kind)

    return formatted.mapInArrow(run, READ)
