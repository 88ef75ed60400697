"""A compiler from calculator programs (the stack language of PDF type 4 functions) to Spark columns.

The stack is evaluated while compiling: its items are columns, so a program becomes one expression that the optimiser folds
and generates code for. Stack operators (dup, exch, roll, ...) cost nothing at run time; their counts must be literals. Types are tracked as
'int', 'real' and 'bool'. Division by zero, the square root of a negative number and the like give null.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Reals closer than this are equal.
TOLERANCE = 1e-6

_TOKEN = re.compile(r"[{}]|[^\s{}]+")


class ProgramError(ValueError):
    """The program is malformed, or misuses the stack or types."""


@dataclass(frozen=True)
class Item:
    """A stack item: a column, its type and, for number literals, the value."""

    column: Column
    kind: str
    literal: int | float | None = None


def _integer(column: Column) -> Item:
    return Item(column.cast("bigint"), "int")


def _real(column: Column) -> Item:
    return Item(column.cast("double"), "real")


def _logical(column: Column) -> Item:
    return Item(column, "bool")


Block = list  # of tokens (str) and nested blocks


def parse(program: str) -> Block:
    """Tokens nested by braces; the outermost braces are optional."""
    tokens = _TOKEN.findall(re.sub(r"%[^\n]*", "", program))
    stack: list[Block] = [[]]
    for t in tokens:
        if t == "{":
            stack.append([])
        elif t == "}":
            if len(stack) == 1:
                raise ProgramError("unbalanced }")
            done = stack.pop()
            stack[-1].append(done)
        else:
            stack[-1].append(t)
    if len(stack) != 1:
        raise ProgramError("unbalanced {")
    body = stack[0]
    return body[0] if len(body) == 1 and isinstance(body[0], list) else body


class _Machine:
    def __init__(self, stack: list[Item]):
        self.stack = stack

    def pop(self, *kinds: str) -> Item:
        if not self.stack:
            raise ProgramError("stack underflow")
        item = self.stack.pop()
        if kinds and item.kind not in kinds:
            raise ProgramError(f"expected {' or '.join(kinds)}, found {item.kind}")
        return item

    def count(self) -> int:
        item = self.pop("int")
        if not isinstance(item.literal, int):
            raise ProgramError("a stack operator's count must be a literal")
        return item.literal

    def run(self, body: Block) -> None:
        i = 0
        while i < len(body):
            token = body[i]
            if isinstance(token, list):
                self.branch(body, i)
                i += 2 if body[i + 1] == "if" else 3
                continue
            self.step(token)
            i += 1

    def branch(self, body: Block, i: int) -> None:
        rest = body[i + 1 : i + 3]
        if rest[:1] == ["if"]:
            blocks = [body[i], []]
        elif len(rest) == 2 and isinstance(rest[0], list) and rest[1] == "ifelse":
            blocks = [body[i], rest[0]]
        else:
            raise ProgramError("a block must be followed by if or ifelse")
        test = self.pop("bool")
        ends = []
        for block in blocks:
            own = _Machine(list(self.stack))
            own.run(block)
            ends.append(own.stack)
        if len(ends[0]) != len(ends[1]):
            raise ProgramError("both branches must leave stacks of one height")
        out = []
        for yes, no in zip(*ends, strict=True):
            if yes is no:
                out.append(yes)
                continue
            if (yes.kind == "bool") != (no.kind == "bool"):
                raise ProgramError("both branches must leave compatible stacks")
            kind = yes.kind if yes.kind == no.kind else "real"
            cast = {"int": "bigint", "real": "double", "bool": "boolean"}[kind]
            out.append(Item(F.when(test.column, yes.column.cast(cast)).otherwise(no.column.cast(cast)), kind))
        self.stack[:] = out

    def step(self, token: str) -> None:
        if re.fullmatch(r"[-+]?\d+", token):
            self.stack.append(Item(F.lit(int(token)).cast("bigint"), "int", int(token)))
        elif re.fullmatch(r"[-+]?(\d+\.\d*|\.\d+|\d+)([eE][-+]?\d+)?", token):
            self.stack.append(Item(F.lit(float(token)), "real", float(token)))
        elif token in ("true", "false"):
            self.stack.append(_logical(F.lit(token == "true")))
        elif token in _STACK:
            _STACK[token](self)
        elif token in _UNARY:
            self.stack.append(_UNARY[token](self.pop()))
        elif token in _BINARY:
            b, a = self.pop(), self.pop()
            self.stack.append(_BINARY[token](a, b))
        else:
            raise ProgramError(f"unknown operator {token!r}")


# ------------------------------------------------------------------ stack operators, at compile time
def _copy(m: _Machine) -> None:
    n = m.count()
    if n < 0 or n > len(m.stack):
        raise ProgramError("copy out of range")
    m.stack += m.stack[len(m.stack) - n :]


def _index(m: _Machine) -> None:
    n = m.count()
    if n < 0 or n >= len(m.stack):
        raise ProgramError("index out of range")
    m.stack.append(m.stack[-1 - n])


def _roll(m: _Machine) -> None:
    by, n = m.count(), m.count()
    if n < 0 or n > len(m.stack):
        raise ProgramError("roll out of range")
    if n:
        top = m.stack[len(m.stack) - n :]
        by %= n
        m.stack[len(m.stack) - n :] = top[n - by :] + top[: n - by]


def _exch(m: _Machine) -> None:
    b, a = m.pop(), m.pop()
    m.stack += [b, a]


def _dup(m: _Machine) -> None:
    item = m.pop()
    m.stack += [item, item]


_STACK: dict[str, Callable[[_Machine], object]] = {"copy": _copy, "index": _index, "roll": _roll, "exch": _exch, "dup": _dup, "pop": lambda m: m.pop()}


# ------------------------------------------------------------------ operators on columns
def _number(x: Item) -> Item:
    if x.kind == "bool":
        raise ProgramError("expected a number, found a boolean")
    return x


def _same(f: Callable[[Column], Column]) -> Callable[[Item], Item]:
    """A function that keeps its argument's type."""
    return lambda x: (_integer if _number(x).kind == "int" else _real)(f(x.column))


def _to_real(f: Callable[[Column], Column]) -> Callable[[Item], Item]:
    return lambda x: _real(f(_number(x).column.cast("double")))


def _whole(f: Callable[[Column], Column]) -> Callable[[Item], Item]:
    """Rounding: integers stay, reals stay reals."""
    return lambda x: x if _number(x).kind == "int" else _real(f(x.column))


def _arith(f: Callable[[Column, Column], Column]) -> Callable[[Item, Item], Item]:
    def op(a: Item, b: Item) -> Item:
        both = _number(a).kind == _number(b).kind == "int"
        return _integer(f(a.column, b.column)) if both else _real(f(a.column.cast("double"), b.column.cast("double")))

    return op


def _ints(f: Callable[[Column, Column], Column]) -> Callable[[Item, Item], Item]:
    def op(a: Item, b: Item) -> Item:
        if a.kind != "int" or b.kind != "int":
            raise ProgramError("expected integers")
        return _integer(f(a.column, b.column))

    return op


def _bits(of_bool: Callable[[Column, Column], Column], of_int: Callable[[Column, Column], Column]) -> Callable[[Item, Item], Item]:
    def op(a: Item, b: Item) -> Item:
        if a.kind == b.kind == "bool":
            return _logical(of_bool(a.column, b.column))
        return _ints(of_int)(a, b)

    return op


def _equal(a: Item, b: Item) -> Column:
    if a.kind == b.kind and a.kind != "real":
        return a.column == b.column
    return F.abs(_number(a).column - _number(b).column) < TOLERANCE


def _order(f: Callable[[Column, Column], Column]) -> Callable[[Item, Item], Item]:
    return lambda a, b: _logical(f(_number(a).column, _number(b).column))


def _or_equal(f: Callable[[Column, Column], Column]) -> Callable[[Item, Item], Item]:
    return lambda a, b: _logical(f(_number(a).column, _number(b).column) | _equal(a, b))


def _guard(ok: Column, value: Column) -> Column:
    return F.when(ok, value)


def _divide(a: Column, b: Column) -> Column:
    return _guard(b != 0, a / F.when(b != 0, b))


def _idiv(a: Column, b: Column) -> Column:
    safe = F.when(b != 0, b)
    return F.call_function("div", a, safe)


def _atan(a: Item, b: Item) -> Item:
    num, den = _number(a).column.cast("double"), _number(b).column.cast("double")
    return _real(F.when(den == 0, F.when(num < 0, F.lit(270.0)).otherwise(F.lit(90.0))).otherwise(F.degrees(F.atan(num / F.when(den != 0, den)))))


def _power(a: Item, b: Item) -> Item:
    base, exponent = _number(a).column.cast("double"), _number(b).column.cast("double")
    return _real(F.when(~((base < 0) & (F.abs(exponent) < 1)), F.pow(base, exponent)))


def _shift(a: Item, b: Item) -> Item:
    if a.kind != "int" or not isinstance(b.literal, int):
        raise ProgramError("bitshift needs an integer and a literal")
    return _integer(F.shiftleft(a.column, b.literal) if b.literal >= 0 else F.shiftright(a.column, -b.literal))


def _not(x: Item) -> Item:
    if x.kind == "bool":
        return _logical(~x.column)
    if x.kind != "int":
        raise ProgramError("expected a boolean or an integer")
    return _integer(F.bitwise_not(x.column))


def _cvi(x: Item) -> Item:
    return _integer(_number(x).column)


_UNARY: dict[str, Callable[[Item], Item]] = {
    "abs": _same(F.abs),
    "neg": _same(lambda c: -c),
    "ceiling": _whole(lambda c: F.ceil(c).cast("double")),
    "floor": _whole(lambda c: F.floor(c).cast("double")),
    "round": _whole(lambda c: F.floor(c + 0.5).cast("double")),
    "truncate": _whole(lambda c: c.cast("bigint").cast("double")),
    "sqrt": _to_real(lambda c: _guard(c >= 0, F.sqrt(F.when(c >= 0, c)))),
    "sin": _to_real(lambda c: F.sin(F.radians(c))),
    "cos": _to_real(lambda c: F.cos(F.radians(c))),
    "ln": _to_real(lambda c: F.log(F.when(c > 0, c))),
    "log": _to_real(lambda c: F.log10(F.when(c > 0, c))),
    "cvi": _cvi,
    "cvr": _to_real(lambda c: c),
    "not": _not,
}
_BINARY: dict[str, Callable[[Item, Item], Item]] = {
    "add": _arith(lambda a, b: a + b),
    "sub": _arith(lambda a, b: a - b),
    "mul": _arith(lambda a, b: a * b),
    "div": lambda a, b: _real(_divide(_number(a).column.cast("double"), _number(b).column.cast("double"))),
    "idiv": _ints(_idiv),
    "mod": _ints(lambda a, b: a % F.when(b != 0, b)),
    "atan": _atan,
    "exp": _power,
    "bitshift": _shift,
    "and": _bits(lambda a, b: a & b, lambda a, b: a.bitwiseAND(b)),
    "or": _bits(lambda a, b: a | b, lambda a, b: a.bitwiseOR(b)),
    "xor": _bits(lambda a, b: a != b, lambda a, b: a.bitwiseXOR(b)),
    "eq": lambda a, b: _logical(_equal(a, b)),
    "ne": lambda a, b: _logical(~_equal(a, b)),
    "lt": _order(lambda a, b: a < b),
    "gt": _order(lambda a, b: a > b),
    "le": _or_equal(lambda a, b: a < b),
    "ge": _or_equal(lambda a, b: a > b),
}

_KINDS = {"bigint": "int", "int": "int", "double": "real", "boolean": "bool"}


def compile_program(program: str, inputs: Sequence[tuple[Column, str]]) -> list[Column]:
    """The columns that the program leaves on the stack, bottom first; inputs are (column, Spark type), pushed in order."""
    start = [Item(column.cast("bigint" if kind == "int" else kind), _KINDS[kind]) for column, kind in inputs]
    machine = _Machine(start)
    machine.run(parse(program))
    return [item.column for item in machine.stack]
