"""Chat formatting by a template compiler.

A small sandboxed template language is parsed into a syntax tree, constants are
folded, and the tree becomes Python closures. A compiled template is a generator:
it takes an iterator of turns and yields ``(piece, in_loss)`` one by one, so a
conversation of any length is rendered in bounded memory.

Language: ``{{ expr }}``, ``{% for m in turns %}``, ``{% if %} / {% elif %} /
{% else %}``, ``{% generation %}`` (the loss mask), ``{# comment #}``. Expressions:
string and integer literals, ``true``/``false``/``none``, names, ``m.role``,
``m.text``, ``loop.index``/``first``/``last``, ``== != and or not + ( )`` and the
filters ``escape trim upper lower``. Nothing else exists: no calls, no Python
attributes, no subscripts, no imports.

Control strings inside texts are escaped reversibly: backslashes are doubled and
a backslash is put after the first character of each control string.

Defined results: a null role or text is the empty string; turns are ordered by
(turn, role, text) with null turns first, so ties and repeated rows have a fixed
order; a null conversation id is one conversation; extra columns, whatever their
names, are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from typing import Any, NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, partitions, shared_dir

START, SEP, END = "<|turn|>", "<|says|>", "<|over|>"
#: Strings with a meaning for some chat model; none survives inside a text.
CONTROL = (START, SEP, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>", "<|im_start|>", "<|im_end|>")
TEMPLATE = (
    "{% for m in turns %}<|turn|>{{ m.role | escape }}<|says|>"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}"
    "{% else %}{{ m.text | escape }}{% endif %}<|over|>{% endfor %}"
)
#: Code points of a written chunk of formatted text.
CHUNK = 1 << 16
_SPANS = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
_CONTROL = re.compile("|".join(map(re.escape, sorted(CONTROL, key=len, reverse=True))))
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str) -> str:
    """Break every control string; undone by :func:`unescape`."""
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


class TemplateError(ValueError):
    """The template is not in the language."""


class Turn(NamedTuple):
    role: str
    text: str


# ---- syntax tree -----------------------------------------------------------


class Const(NamedTuple):
    value: Any


class Name(NamedTuple):
    name: str


class Field(NamedTuple):
    of: str
    field: str


class Apply(NamedTuple):
    op: str
    args: tuple


class Text(NamedTuple):
    value: str


class Emit(NamedTuple):
    expr: Any


class For(NamedTuple):
    var: str
    body: tuple


class If(NamedTuple):
    arms: tuple  # ((condition, body), ...)


class Generation(NamedTuple):
    body: tuple


FIELDS = {"loop": ("index", "first", "last")}
TURN_FIELDS = ("role", "text")
FILTERS: dict[str, Callable[[str], str]] = {"escape": escape, "trim": str.strip, "upper": str.upper, "lower": str.lower}
_TAG = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}|\{#.*?#\}", re.DOTALL)
_TOKEN = re.compile(r"\s*(?:(?P<str>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<int>\d+)|(?P<op>==|!=|[+()|.])|(?P<name>[A-Za-z_]\w*))")
_UNQUOTE = {"n": "\n", "t": "\t"}


def _tokens(source: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while source[at:].strip():
        m = _TOKEN.match(source, at)
        if not m:
            raise TemplateError(f"unexpected input: {source[at:].strip()[:20]!r}")
        out.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    return out


class _Expression:
    """Recursive descent over one expression: or < and < not < comparison < + < filter."""

    def __init__(self, source: str, scope: tuple[str, ...]):
        self.tokens, self.at, self.scope = _tokens(source), 0, scope

    def parse(self):
        tree = self.either()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return tree

    def take(self, *values: str) -> str | None:
        if self.at < len(self.tokens) and self.tokens[self.at][0] in ("op", "name") and self.tokens[self.at][1] in values:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def either(self):
        left = self.both()
        while self.take("or"):
            left = Apply("or", (left, self.both()))
        return left

    def both(self):
        left = self.negated()
        while self.take("and"):
            left = Apply("and", (left, self.negated()))
        return left

    def negated(self):
        return Apply("not", (self.negated(),)) if self.take("not") else self.compared()

    def compared(self):
        left = self.added()
        op = self.take("==", "!=")
        return Apply(op, (left, self.added())) if op else left

    def added(self):
        left = self.filtered()
        while self.take("+"):
            left = Apply("+", (left, self.filtered()))
        return left

    def filtered(self):
        value = self.atom()
        while self.take("|"):
            kind, name = self.tokens[self.at] if self.at < len(self.tokens) else ("", "")
            if kind != "name" or name not in FILTERS:
                raise TemplateError(f"unknown filter {name!r}")
            self.at += 1
            value = Apply("|" + name, (value,))
        return value

    def atom(self):
        if self.take("("):
            inner = self.either()
            if not self.take(")"):
                raise TemplateError("missing )")
            return inner
        if self.at >= len(self.tokens):
            raise TemplateError("expression ends early")
        kind, value = self.tokens[self.at]
        self.at += 1
        if kind == "str":
            return Const(re.sub(r"\\(.)", lambda m: _UNQUOTE.get(m[1], m[1]), value[1:-1], flags=re.DOTALL))
        if kind == "int":
            return Const(int(value))
        if kind != "name":
            raise TemplateError(f"unexpected {value!r}")
        if value in ("true", "false", "none"):
            return Const({"true": True, "false": False, "none": None}[value])
        if value not in self.scope:
            raise TemplateError(f"unknown name {value!r}")
        if self.take("."):
            field = self.tokens[self.at][1] if self.at < len(self.tokens) else ""
            self.at += 1
            if field not in FIELDS.get(value, TURN_FIELDS):
                raise TemplateError(f"unknown field {value}.{field}")
            return Field(value, field)
        raise TemplateError(f"{value!r} needs a field")


def parse(source: str) -> tuple:
    """Template text to a tuple of nodes."""
    parts, at = [], 0
    for m in _TAG.finditer(source):
        if m.start() > at:
            parts.append(("text", source[at : m.start()]))
        if m[1] is not None:
            parts.append(("emit", m[1]))
        elif m[2] is not None:
            parts.append(("tag", m[2].strip()))
        at = m.end()
    if at < len(source):
        parts.append(("text", source[at:]))
    for kind, value in parts:
        if kind == "text" and re.search(r"\{\{|\{%|\{#", value):
            raise TemplateError("a tag is not closed")
    body, rest = _block(parts, 0, (), ())
    if rest != len(parts):
        raise TemplateError(f"unexpected tag {parts[rest][1]!r}")
    return body


def _block(parts: list, at: int, scope: tuple, ends: tuple) -> tuple[tuple, int]:
    out = []
    while at < len(parts):
        kind, value = parts[at]
        word = value.split(None, 1)[0] if kind == "tag" and value else ""
        if kind == "tag" and word in ends:
            return tuple(out), at
        at += 1
        if kind == "text":
            out.append(Text(value))
        elif kind == "emit":
            out.append(Emit(_Expression(value, scope).parse()))
        elif m := re.fullmatch(r"for\s+([A-Za-z_]\w*)\s+in\s+turns", value):
            if scope or m[1] in ("loop", "turns"):
                raise TemplateError("loops do not nest")
            body, at = _block(parts, at, (m[1], "loop"), ("endfor",))
            out.append(For(m[1], body))
            at = _closed(parts, at)
        elif word == "if":
            arms, condition = [], _Expression(value[2:], scope).parse()
            while True:
                body, at = _block(parts, at, scope, ("elif", "else", "endif"))
                arms.append((condition, body))
                tag = parts[at][1] if at < len(parts) else ""
                at = _closed(parts, at)
                if tag.startswith("elif"):
                    condition = _Expression(tag[4:], scope).parse()
                elif tag == "else":
                    body, at = _block(parts, at, scope, ("endif",))
                    arms.append((Const(True), body))
                    at = _closed(parts, at)
                    break
                else:
                    break
            out.append(If(tuple(arms)))
        elif value == "generation":
            body, at = _block(parts, at, scope, ("endgeneration",))
            out.append(Generation(body))
            at = _closed(parts, at)
        else:
            raise TemplateError(f"unknown tag {value!r}")
    if ends:
        raise TemplateError(f"missing {' or '.join(ends)}")
    return tuple(out), at


def _closed(parts: list, at: int) -> int:
    if at >= len(parts):
        raise TemplateError("a block is not closed")
    return at + 1


# ---- constant folding ------------------------------------------------------

_OPS: dict[str, Callable] = {
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "+": lambda a, b: a + b if isinstance(a, int) and isinstance(b, int) else _text(a) + _text(b),
    "not": lambda a: not a,
    "and": lambda a, b: a and b,
    "or": lambda a, b: a or b,
    **{"|" + name: (lambda f: lambda a: f(_text(a)))(f) for name, f in FILTERS.items()},
}


def _text(value: Any) -> str:
    return value if isinstance(value, str) else "" if value is None else str(value).lower() if isinstance(value, bool) else str(value)


def fold(node: Any) -> Any:
    """Evaluate what does not depend on the turns; join neighbouring texts; drop dead branches."""
    if isinstance(node, tuple) and type(node) is tuple:
        out: list = []
        for x in (y for n in node for y in _spread(fold(n))):
            if isinstance(x, Text) and out and isinstance(out[-1], Text):
                out[-1] = Text(out[-1].value + x.value)
            elif not (isinstance(x, Text) and not x.value):
                out.append(x)
        return tuple(out)
    if isinstance(node, Apply):
        args = tuple(map(fold, node.args))
        if all(isinstance(a, Const) for a in args):
            return Const(_OPS[node.op](*(a.value for a in args)))
        if node.op in ("and", "or") and isinstance(args[0], Const):
            return args[1] if bool(args[0].value) == (node.op == "and") else args[0]
        return Apply(node.op, args)
    if isinstance(node, Emit):
        expr = fold(node.expr)
        return Text(_text(expr.value)) if isinstance(expr, Const) else Emit(expr)
    if isinstance(node, For):
        return For(node.var, fold(node.body))
    if isinstance(node, Generation):
        return Generation(fold(node.body))
    if isinstance(node, If):
        arms = []
        for condition, body in node.arms:
            condition = fold(condition)
            if isinstance(condition, Const) and not condition.value:
                continue
            arms.append((condition, fold(body)))
            if isinstance(condition, Const):
                break
        if not arms:
            return Text("")
        return arms[0][1] if isinstance(arms[0][0], Const) else If(tuple(arms))
    return node


def _spread(node: Any) -> tuple:
    return node if type(node) is tuple else (node,)


# ---- closures --------------------------------------------------------------


def _value(node: Any) -> Callable[[dict], Any]:
    if isinstance(node, Const):
        return lambda env, v=node.value: v
    if isinstance(node, Field):
        if node.of == "loop":
            return lambda env, f=node.field: env["loop"][f]
        return lambda env, n=node.of, k=TURN_FIELDS.index(node.field): env[n][k]
    args, op = tuple(map(_value, node.args)), node.op
    if op == "and":
        return lambda env: args[0](env) and args[1](env)
    if op == "or":
        return lambda env: args[0](env) or args[1](env)
    f = _OPS[op]
    if len(args) == 1:
        return lambda env, a=args[0]: f(a(env))
    return lambda env, a=args[0], b=args[1]: f(a(env), b(env))


Piece = tuple[str, bool]


def _body(nodes: tuple, loss: bool) -> Callable[[dict], Iterator[Piece]]:
    steps = tuple(_step(n, loss) for n in nodes)

    def run(env: dict) -> Iterator[Piece]:
        for step in steps:
            yield from step(env)

    return run


def _step(node: Any, loss: bool) -> Callable[[dict], Iterator[Piece]]:
    if isinstance(node, Text):
        return lambda env, piece=(node.value, loss): iter((piece,))
    if isinstance(node, Emit):
        value = _value(node.expr)
        return lambda env: iter(((_text(value(env)), loss),))
    if isinstance(node, Generation):
        return _body(node.body, True)
    if isinstance(node, If):
        arms = tuple((_value(c), _body(b, loss)) for c, b in node.arms)

        def choose(env: dict) -> Iterator[Piece]:
            for condition, body in arms:
                if condition(env):
                    return body(env)
            return iter(())

        return choose
    inner = _body(node.body, loss)

    def loop(env: dict) -> Iterator[Piece]:
        turns = iter(env["turns"])
        index, current = 0, next(turns, None)
        while current is not None:
            index, following = index + 1, next(turns, None)
            yield from inner({node.var: current, "loop": {"index": index, "first": index == 1, "last": following is None}})
            current = following

    return loop


def compile_template(source: str = TEMPLATE) -> Callable[[Iterable[Turn]], Iterator[Piece]]:
    """Compile to a function from turns to ``(piece, in_loss)`` pairs."""
    body = _body(fold(parse(source)), False)
    return lambda turns: body({"turns": turns})


def render(turns: Iterable[Turn], source: str = TEMPLATE) -> tuple[str, list[tuple[int, int]]]:
    """The whole formatted text and the half-open code-point spans under the loss mask."""
    text, spans, at = [], [], 0
    for piece, loss in compile_template(source)(turns):
        if loss and piece:
            if spans and spans[-1][1] == at:
                spans[-1] = (spans[-1][0], at + len(piece))
            else:
                spans.append((at, at + len(piece)))
        text.append(piece)
        at += len(piece)
    return "".join(text), spans


class Reader:
    """Reads formatted text of the default template back, piece by piece, holding one turn at a time."""

    def __init__(self) -> None:
        self.pending, self.pending_loss = [], []
        self.n_turns = self.loss_chars = self.formatted_chars = 0
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()

    def feed(self, piece: str, in_loss: bool) -> None:
        self.formatted_chars += len(piece)
        self.pending.append(piece)
        if in_loss:
            self.pending_loss.append(piece)
        if END in piece:
            self._drain()

    def _drain(self) -> None:
        text = "".join(self.pending)
        while (end := text.find(END)) >= 0:
            turn, text = text[:end], text[end + len(END) :]
            if not turn.startswith(START) or SEP not in turn:
                raise ValueError("not in the default format")
            role, said = turn[len(START) :].split(SEP, 1)
            self.turns.update(f"{unescape(role)}\n{unescape(said)}\n".encode("utf-8", "surrogatepass"))
            self.n_turns += 1
        self.pending = [text] if text else []
        said = unescape("".join(self.pending_loss))
        self.pending_loss = []
        self.loss_chars += len(said)
        self.loss.update(said.encode("utf-8", "surrogatepass"))

    def digest(self) -> tuple:
        if self.pending:
            raise ValueError("the last turn is not closed")
        return self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.formatted_chars


def _grouped(conversations: DataFrame) -> DataFrame:
    n = partitions(conversations.sparkSession)
    order = ("conv_id", "turn", "role", "text")
    rows = conversations.select(*order[:2], F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.repartition(n, "conv_id").sortWithinPartitions(*order)


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Any, Iterator[Turn]]]:
    """(conv_id, lazy turns) of a stream sorted by conv_id."""
    from itertools import groupby
    from operator import itemgetter

    rows = (r for b in batches for r in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True))
    for conv_id, group in groupby(rows, key=itemgetter(0)):
        yield conv_id, (Turn(r[1], r[2]) for r in group)


def format_turns(conversations: DataFrame, source: str = TEMPLATE) -> DataFrame:
    """The formatted text as rows (conv_id, piece_no, piece, in_loss); joined in order they are the output."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = compile_template(source)
        out: list = []
        size = 0
        for conv_id, turns in _conversations(batches):
            for k, (piece, loss) in enumerate(compiled(turns)):
                out.append((conv_id, k, piece, loss))
                size += len(piece) + 16
                if size > 4 << 20:
                    yield _batch(out, ("conv_id", "piece_no", "piece", "in_loss"), (pa.int64(), pa.int64(), pa.string(), pa.bool_()))
                    out, size = [], 0
        if out:
            yield _batch(out, ("conv_id", "piece_no", "piece", "in_loss"), (pa.int64(), pa.int64(), pa.string(), pa.bool_()))

    return _grouped(conversations).mapInArrow(run, "conv_id long, piece_no long, piece string, in_loss boolean")


def format_chunks(conversations: DataFrame, source: str = TEMPLATE, size: int = CHUNK) -> DataFrame:
    """The formatted text as rows (conv_id, begin, text, loss): at least ``size`` code points but for the last of a conversation,
    where the text begins in its conversation, and the half-open spans (a, b) of it under the loss mask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = compile_template(source)
        rows: list = []
        held = 0

        def batch() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), _SPANS), strict=True)], names=["conv_id", "begin", "text", "loss"])

        for conv_id, turns in _conversations(batches):
            begin, at, parts, spans = 0, 0, [], []
            for piece, loss in compiled(turns):
                parts.append(piece)
                if loss and piece:
                    if spans and spans[-1]["b"] == at:
                        spans[-1]["b"] = at + len(piece)
                    else:
                        spans.append({"a": at, "b": at + len(piece)})
                at += len(piece)
                if at >= size:
                    rows.append((conv_id, begin, "".join(parts), spans))
                    held += at
                    begin, at, parts, spans = begin + at, 0, [], []
                    if held > 4 << 20:
                        yield batch()
                        rows, held = [], 0
            if parts or not begin:
                rows.append((conv_id, begin, "".join(parts), spans))
                held += at + 64
        if rows:
            yield batch()

    return _grouped(conversations).mapInArrow(run, "conv_id long, begin long, text string, loss array<struct<a:int,b:int>>")


def read_formatted(chunks: DataFrame) -> DataFrame:
    """Counts and digests of what formatted conversations hold, from their text and loss spans alone."""
    names = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
    types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from itertools import groupby
        from operator import itemgetter

        rows = (r for b in batches for r in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True))
        out = []
        for conv_id, group in groupby(rows, key=itemgetter(0)):
            reader = Reader()
            for _, begin, text, spans in group:
                if begin != reader.formatted_chars:
                    raise ValueError(f"a chunk of conversation {conv_id} is missing")
                at = 0
                for span in spans:
                    reader.feed(text[at : span["a"]], False)
                    reader.feed(text[span["a"] : span["b"]], True)
                    at = span["b"]
                reader.feed(text[at:], False)
            out.append((conv_id, *reader.digest()))
            if len(out) >= 10_000:
                yield _batch(out, names, types)
                out = []
        if out:
            yield _batch(out, names, types)

    n = partitions(chunks.sparkSession)
    ordered = chunks.repartition(n, "conv_id").sortWithinPartitions("conv_id", "begin")
    return ordered.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def digests(conversations: DataFrame, source: str = TEMPLATE) -> DataFrame:
    """Format every conversation, write the text with its loss spans to the shared folder, read that back, and digest it."""
    return read_formatted(materialise(format_chunks(conversations, source), f"{shared_dir(conversations.sparkSession)}/formatted"))


def _batch(rows: list, names: tuple, types: tuple) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=list(names))
