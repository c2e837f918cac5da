"""Chat formatting with a small, sandboxed template language.

A template is text with ``{{ expression }}``, ``{% for x in list %}``, ``{% if %} / {% elif %} /
{% else %}``, ``{% set x = expression %}`` and ``{% generation %} ... {% endgeneration %}``.
Expressions know names, fields, string, integer and list literals, ``+ ~ == != < > in and or not``,
and the filters of ``FILTERS``; there are no calls, attributes or loops without a list, so a
template can reach nothing but the values given to it and always ends. It is parsed to a syntax
tree, constant parts are folded, and the rest becomes nested Python closures that write text
and, for generation blocks, character spans: the loss mask.

Texts may hold the template's own control strings. The filter ``escape`` puts a backslash before
every control string and every backslash, ``unescape`` takes it away again, so the formatted text
can be read back without loss.

Results for odd input: a null text or role counts as empty; turns are ordered by turn, nulls first,
then by role and text, and repeated rows are turns of their own; rows without conv_id form one
conversation; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

CONTROLS = ("###", "</turn>")
TEMPLATE = (
    "{% for m in messages %}### {{ m.role | escape_name }}:\n"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}"
    "{% else %}{{ m.text | escape }}{% endif %}</turn>\n{% endfor %}"
)

_CONTROL = re.compile("\\\\|" + "|".join(map(re.escape, CONTROLS)))
_NAME_CONTROL = re.compile("[\\\\:\n]|" + "|".join(map(re.escape, CONTROLS)))
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\" + m[0], text)


def escape_name(text: str) -> str:
    return _NAME_CONTROL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[1], text)


FILTERS: dict[str, Callable] = {
    "escape": escape, "escape_name": escape_name, "trim": str.strip, "upper": str.upper, "lower": str.lower,
    "capitalize": str.capitalize, "length": len, "string": str,
}


class TemplateError(ValueError):
    pass


# ------------------------------------------------------------------ parsing

_PIECES = re.compile(r"(\{\{.*?\}\}|\{%.*?%\})", re.DOTALL)
_TOKEN = re.compile(r"""\s*(?:(?P<text>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<number>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<mark>==|!=|[+~<>|.,()\[\]]))""")
_WORDS = {"and", "or", "not", "in"}
_ESCAPES = {"n": "\n", "t": "\t"}


class _Expression:
    """Recursive descent over the tokens of one expression; nodes are tuples headed by their kind."""

    def __init__(self, source: str):
        self.source, self.tokens, at = source, [], 0
        source = source.rstrip()
        while at < len(source):
            match = _TOKEN.match(source, at)
            if not match:
                raise TemplateError(f"cannot read {source[at:]!r}")
            kind = match.lastgroup
            value = match[kind]
            self.tokens.append(("mark" if value in _WORDS else kind, value))
            at = match.end()
        self.at = 0

    def take(self, *marks: str) -> str | None:
        if self.at < len(self.tokens) and self.tokens[self.at][0] == "mark" and self.tokens[self.at][1] in marks:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def whole(self):
        node = self.either()
        if self.at != len(self.tokens):
            raise TemplateError(f"unexpected rest in {self.source!r}")
        return node

    def _chain(self, lower, *marks):
        node = lower()
        while mark := self.take(*marks):
            node = ("binary", mark, node, lower())
        return node

    def either(self):
        return self._chain(self.both, "or")

    def both(self):
        return self._chain(self.negated, "and")

    def negated(self):
        return ("not", self.negated()) if self.take("not") else self.compared()

    def compared(self):
        return self._chain(self.joined, "==", "!=", "<", ">", "in")

    def joined(self):
        return self._chain(self.filtered, "+", "~")

    def filtered(self):
        node = self.value()
        while True:
            if self.take("|"):
                node = ("filter", self.name(FILTERS), node)
            elif self.take("."):
                node = ("field", self.name(), node)
            else:
                return node

    def name(self, known=None) -> str:
        kind, value = self.tokens[self.at] if self.at < len(self.tokens) else ("", "the end")
        if kind != "name" or value.startswith("_") or known is not None and value not in known:
            raise TemplateError(f"{value!r} is not a name here")
        self.at += 1
        return value

    def value(self):
        if self.take("("):
            node = self.either()
            if not self.take(")"):
                raise TemplateError(f"missing ) in {self.source!r}")
            return node
        if self.take("["):
            items = []
            while not self.take("]"):
                items.append(self.either())
                if not self.take(",") and (self.at >= len(self.tokens) or self.tokens[self.at] != ("mark", "]")):
                    raise TemplateError(f"missing ] in {self.source!r}")
            return ("list", items)
        kind, value = self.tokens[self.at] if self.at < len(self.tokens) else ("", "")
        if kind == "text":
            self.at += 1
            return ("constant", re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), value[1:-1], flags=re.DOTALL))
        if kind == "number":
            self.at += 1
            return ("constant", int(value))
        if kind == "name" and value in ("true", "false", "none"):
            self.at += 1
            return ("constant", {"true": True, "false": False, "none": None}[value])
        return ("name", self.name())


def parse(template: str) -> list:
    """The syntax tree: a list of statements."""
    root: list = []
    body, open_ = root, []  # open_: (kind, node, body around it)
    for piece in _PIECES.split(template):
        if piece.startswith("{{"):
            body.append(("write", _Expression(piece[2:-2]).whole()))
        elif not piece.startswith("{%"):
            if piece:
                body.append(("write", ("constant", piece)))
        else:
            word, _, rest = piece[2:-2].strip().partition(" ")
            if word == "for":
                match = re.fullmatch(r"([A-Za-z]\w*)\s+in\s+(.+)", rest.strip(), re.DOTALL)
                if not match:
                    raise TemplateError(f"cannot read {piece!r}")
                inside: list = []
                body.append(("for", match[1], _Expression(match[2]).whole(), inside))
            elif word == "if":
                inside = []
                body.append(("if", [(_Expression(rest).whole(), inside)]))
            elif word == "generation":
                inside = []
                body.append(("generation", inside))
            elif word == "set":
                name, equal, value = rest.partition("=")
                if not equal or not re.fullmatch(r"[A-Za-z]\w*", name.strip()):
                    raise TemplateError(f"cannot read {piece!r}")
                body.append(("set", name.strip(), _Expression(value).whole()))
                continue
            elif word in ("elif", "else") and open_ and open_[-1][0] == "if":
                body = []
                open_[-1][1][1].append((_Expression(rest).whole() if word == "elif" else ("constant", True), body))
                continue
            elif open_ and word == "end" + open_[-1][0]:
                body = open_.pop()[2]
                continue
            else:
                raise TemplateError(f"unexpected {piece!r}")
            if word == "generation" and any(kind == "generation" for kind, _, _ in open_):
                raise TemplateError("generation blocks cannot be nested")
            open_.append((word, body[-1], body))
            body = inside
    if open_:
        raise TemplateError(f"{open_[-1][0]} is not ended")
    return root


# ------------------------------------------------------------------ folding

_BINARY: dict[str, Callable] = {
    "+": lambda a, b: a + b, "~": lambda a, b: _text(a) + _text(b), "==": lambda a, b: a == b, "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b, ">": lambda a, b: a > b, "in": lambda a, b: a in b,
}


def _text(value) -> str:
    return "" if value is None else value if isinstance(value, str) else str(value)


def fold(node):
    """The expression with constant parts computed."""
    kind = node[0]
    if kind == "list":
        items = [fold(item) for item in node[1]]
        return ("constant", [i[1] for i in items]) if all(i[0] == "constant" for i in items) else ("list", items)
    if kind in ("filter", "field", "not"):
        inner = fold(node[-1])
        if kind == "not":
            return ("constant", not inner[1]) if inner[0] == "constant" else ("not", inner)
        if kind == "filter" and inner[0] == "constant":
            return ("constant", FILTERS[node[1]](inner[1] if node[1] == "length" else _text(inner[1])))
        return (kind, node[1], inner)
    if kind == "binary":
        _, mark, left, right = node
        left, right = fold(left), fold(right)
        if left[0] == "constant" and mark in ("and", "or"):
            return right if bool(left[1]) == (mark == "and") else left
        if left[0] == right[0] == "constant":
            return ("constant", _BINARY[mark](left[1], right[1]))
        return ("binary", mark, left, right)
    return node


def fold_body(body: list) -> list:
    """Statements with constant texts joined and branches that can't be taken left out."""
    made: list = []
    for statement in body:
        kind = statement[0]
        if kind == "write":
            value = fold(statement[1])
            if value[0] == "constant":
                value = ("constant", _text(value[1]))
                if made and made[-1][0] == "write" and made[-1][1][0] == "constant":
                    made[-1] = ("write", ("constant", made[-1][1][1] + value[1]))
                    continue
            made.append(("write", value))
        elif kind == "for":
            made.append(("for", statement[1], fold(statement[2]), fold_body(statement[3])))
        elif kind == "set":
            made.append(("set", statement[1], fold(statement[2])))
        elif kind == "generation":
            made.append(("generation", fold_body(statement[1])))
        else:
            branches = []
            for test, inside in statement[1]:
                test = fold(test)
                if test[0] == "constant" and not test[1]:
                    continue
                branches.append((test, fold_body(inside)))
                if test[0] == "constant":
                    break
            if branches and branches[0][0][0] == "constant":
                made += branches[0][1]
            elif branches:
                made.append(("if", branches))
    return made


# ------------------------------------------------------------------ closures


class _Output:
    def __init__(self):
        self.parts: list[str] = []
        self.size = 0
        self.spans: list[tuple[int, int]] = []

    def write(self, text: str) -> None:
        self.parts.append(text)
        self.size += len(text)


def _evaluator(node) -> Callable[[dict], object]:
    kind = node[0]
    if kind == "constant":
        value = node[1]
        return lambda scope: value
    if kind == "name":
        name = node[1]
        return lambda scope: scope.get(name)
    if kind == "field":
        name, inner = node[1], _evaluator(node[2])

        def field(scope):
            value = inner(scope)
            return value.get(name) if isinstance(value, dict) else None

        return field
    if kind == "filter":
        apply, inner, raw = FILTERS[node[1]], _evaluator(node[2]), node[1] == "length"
        return (lambda scope: apply(inner(scope) or "")) if raw else (lambda scope: apply(_text(inner(scope))))
    if kind == "not":
        inner = _evaluator(node[1])
        return lambda scope: not inner(scope)
    if kind == "list":
        items = [_evaluator(item) for item in node[1]]
        return lambda scope: [item(scope) for item in items]
    _, mark, left, right = node
    left, right = _evaluator(left), _evaluator(right)
    if mark == "and":
        return lambda scope: left(scope) and right(scope)
    if mark == "or":
        return lambda scope: left(scope) or right(scope)
    apply = _BINARY[mark]
    return lambda scope: apply(left(scope), right(scope))


def _runner(body: list) -> Callable[[dict, _Output], None]:
    return _sequence([_statement(s) for s in body])


def _sequence(steps: list) -> Callable[[dict, _Output], None]:
    if len(steps) == 1:
        return steps[0]

    def run(scope, out):
        for step in steps:
            step(scope, out)

    return run


def _statement(statement) -> Callable[[dict, _Output], None]:
    kind = statement[0]
    if kind == "write":
        value = _evaluator(statement[1])
        return lambda scope, out: out.write(_text(value(scope)))
    if kind == "set":
        name, value = statement[1], _evaluator(statement[2])
        return lambda scope, out: scope.__setitem__(name, value(scope))
    if kind == "generation":
        inside = _runner(statement[1])

        def generation(scope, out):
            begin = out.size
            inside(scope, out)
            out.spans.append((begin, out.size))

        return generation
    if kind == "for":
        name, items, inside = statement[1], _evaluator(statement[2]), _runner(statement[3])

        def loop(scope, out):
            inner = dict(scope)
            for item in items(scope) or ():
                inner[name] = item
                inside(inner, out)

        return loop
    branches = [(_evaluator(test), _runner(inside)) for test, inside in statement[1]]

    def choose(scope, out):
        for test, inside in branches:
            if test(scope):
                inside(scope, out)
                return

    return choose


class Template:
    """A compiled template; ``render`` gives the text and the spans of its generation blocks."""

    def __init__(self, source: str = TEMPLATE):
        self.tree = fold_body(parse(source))
        self._run = _runner(self.tree)

    def render(self, **values) -> tuple[str, list[tuple[int, int]]]:
        out = _Output()
        self._run(dict(values), out)
        return "".join(out.parts), out.spans


_HEAD = re.compile(r"### ((?:[^\\:]++|\\.)*+):\n", re.DOTALL)
_BODY = re.compile(r"((?:[^\\<]++|\\.|<(?!/turn>))*+)</turn>\n", re.DOTALL)


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The turns (role, text) of a text made by ``TEMPLATE``."""
    turns, at = [], 0
    while at < len(formatted):
        head = _HEAD.match(formatted, at)
        body = head and _BODY.match(formatted, head.end())
        if not body:
            raise ValueError(f"no turn at {at}")
        turns.append((unescape(head[1]), unescape(body[1])))
        at = body.end()
    return turns


def format_conversations(rows: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """(conv_id, turn, role, text) to one row per conversation: conv_id, formatted, spans.

    ``spans`` lists begin and end, in code points of ``formatted``, of each generation block. A
    conversation is one text, so its turns come together in one row.
    """
    clean = rows.select(F.col("conv_id").cast("bigint").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"),
                        F.coalesce("text", F.lit("")).alias("text"))
    listed = clean.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))

    def run(batches):
        made = Template(template)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                done = [made.render(messages=turns) for turns in part.column(1).to_pylist()]
                spans = [[{"begin": b, "end": e} for b, e in d[1]] for d in done]
                yield pa.record_batch(
                    [part.column(0), pa.array([d[0] for d in done], pa.string()),
                     pa.array(spans, pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])))],
                    names=["conv_id", "formatted", "spans"])

    return listed.mapInArrow(run, "conv_id bigint, formatted string, spans array<struct<begin: bigint, end: bigint>>")


def digests(formatted: DataFrame) -> DataFrame:
    """What the formatted texts and their spans say, read back: per conversation the digests of turns and loss text."""

    def hexed(text: str) -> str:
        return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()

    def run(batches):
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for i in range(batch.num_rows):
                text = batch.column(1)[i].as_py()
                turns = read_back(text)
                loss = "".join(unescape(text[s["begin"]:s["end"]]) for s in batch.column(2)[i].as_py())
                row = (batch.column(0)[i].as_py(), len(turns), hexed("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss),
                       hexed(loss), len(text))
                for values, value in zip(out, row):
                    values.append(value)
            types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            yield pa.record_batch([pa.array(v, t) for v, t in zip(out, types)], names=names)

    return formatted.select("conv_id", "formatted", "spans").mapInArrow(
        run, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
