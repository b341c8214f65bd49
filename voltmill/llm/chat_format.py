"""Chat formatting (8): a template compiler with generation markers.

A sandboxed template language is parsed into a syntax tree, constants are folded, and the tree becomes
Python closures.  The language: text, {{ expression }}, {% set name = expression %}, {% for x in list %} ...
{% endfor %}, {% if %} ... {% elif %} ... {% else %} ... {% endif %}, {% generation %} ... {% endgeneration %};
expressions have strings, integers, true, false, none, names, .field and [index] of dicts and lists, ==, !=,
in, and, or, not, +, a if c else b, and the filters escape, trim, upper, lower, length.  A dash at a tag's
bracket strips the white space on that side.  There are no calls, attributes or imports.

escape() puts a backslash before each backslash and after the first character of each control string.  It only
adds backslashes, which no control string has, and control strings don't overlap, so none is left as a part of
the escaped text, and a tokenizer that looks for them finds the template's own only.  unescape() gives the text back.

Defined results: a null role or text is empty; rows of equal turn are taken by role and text, and repeated rows are
turns of their own; a null conversation id is a conversation; an empty table gives no rows; extra columns aren't
read, whatever their names; a conversation is formatted in one piece, so it must fit in a task.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import parts

CONTROL = ("<s>", "</s>", "[INST]", "[/INST]")
#: One turn: <s>role[INST]text[/INST]</s>; an assistant's text is what a model is trained on.
TEMPLATE = (
    "{% for m in messages %}"
    "<s>{{ m.role | escape }}[INST]"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}{% else %}{{ m.text | escape }}{% endif %}"
    "[/INST]</s>"
    "{% endfor %}"
)
_UNSAFE = re.compile(r"\\|" + "|".join(re.escape(c) for c in CONTROL))


def escape(text: str) -> str:
    return _UNSAFE.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


FILTERS: dict[str, Callable] = {"escape": lambda x: escape(_str(x)), "trim": lambda x: _str(x).strip(), "upper": lambda x: _str(x).upper(), "lower": lambda x: _str(x).lower(), "length": len}


class TemplateError(ValueError):
    """The template isn't in the language."""


def _str(x: object) -> str:
    return "" if x is None else x if isinstance(x, str) else str(x)


_TAG = re.compile(r"\{\{-?(.*?)-?\}\}|\{%-?(.*?)-?%\}", re.S)
_TOKEN = re.compile(r"\s*(?:(?P<str>'(?:\\.|[^'\\])*'|\"(?:\\.|[^\"\\])*\")|(?P<int>\d+)|(?P<name>[A-Za-z][A-Za-z0-9_]*)|(?P<op>==|!=|[|.\[\]()+]))")
_WORDS = {"and", "or", "not", "in", "if", "else"}
_FIXED = {"true": True, "false": False, "none": None}


class _Expression:
    """Recursive descent over the tokens of one expression; nodes are tuples."""

    def __init__(self, source: str):
        self.tokens, at = [], 0
        source = source.rstrip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"can't read {source[at:]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self, *values: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] != "str" and self.tokens[self.at][1] in values

    def take(self, *values: str) -> str:
        if not self.peek(*values):
            raise TemplateError(f"expected {values} at token {self.at}")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def parse(self) -> tuple:
        node = self.choice()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return node

    def choice(self) -> tuple:
        node = self.either()
        if self.peek("if"):
            self.take("if")
            test = self.either()
            self.take("else")
            node = ("choose", test, node, self.choice())
        return node

    def either(self) -> tuple:
        node = self.both()
        while self.peek("or"):
            self.take("or")
            node = ("or", node, self.both())
        return node

    def both(self) -> tuple:
        node = self.negation()
        while self.peek("and"):
            self.take("and")
            node = ("and", node, self.negation())
        return node

    def negation(self) -> tuple:
        if self.peek("not"):
            self.take("not")
            return ("not", self.negation())
        node = self.sum()
        while self.peek("==", "!=", "in"):
            node = (self.take("==", "!=", "in"), node, self.sum())
        return node

    def sum(self) -> tuple:
        node = self.value()
        while self.peek("+"):
            self.take("+")
            node = ("+", node, self.value())
        return node

    def value(self) -> tuple:
        if self.at >= len(self.tokens):
            raise TemplateError("expression ends early")
        kind, text = self.tokens[self.at]
        self.at += 1
        if kind == "str":
            node = ("const", re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), text[1:-1]))
        elif kind == "int":
            node = ("const", int(text))
        elif kind == "name" and text not in _WORDS:
            node = ("const", _FIXED[text]) if text in _FIXED else ("name", text)
        elif text == "(":
            node = self.choice()
            self.take(")")
        else:
            raise TemplateError(f"unexpected {text!r}")
        while self.peek(".", "[", "|"):
            op = self.take(".", "[", "|")
            if op == "[":
                node = ("item", node, self.choice())
                self.take("]")
                continue
            if self.at >= len(self.tokens) or self.tokens[self.at][0] != "name":
                raise TemplateError(f"a name must follow {op!r}")
            name = self.tokens[self.at][1]
            self.at += 1
            if op == "|" and name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            node = ("filter", node, name) if op == "|" else ("item", node, ("const", name))
        return node


def fold(node: tuple) -> tuple:
    """The same expression with constant parts computed."""
    if node[0] in ("const", "name"):
        return node
    node = (node[0], *(fold(x) if isinstance(x, tuple) else x for x in node[1:]))
    kids = [x for x in node[1:] if isinstance(x, tuple)]
    if all(k[0] == "const" for k in kids):
        return ("const", expression(node)({}))
    if node[0] == "choose" and node[1][0] == "const":
        return node[2] if node[1][1] else node[3]
    return node


def expression(node: tuple) -> Callable[[dict], object]:
    """A closure that computes a node in an environment."""
    kind = node[0]
    if kind == "const":
        return lambda env, v=node[1]: v
    if kind == "name":
        return lambda env, n=node[1]: env.get(n)
    a = expression(node[1])
    if kind == "not":
        return lambda env: not a(env)
    if kind == "filter":
        return lambda env, f=FILTERS[node[2]]: f(a(env))
    b = expression(node[2])
    if kind == "choose":
        c = expression(node[3])
        return lambda env: b(env) if a(env) else c(env)
    if kind == "item":

        def item(env: dict) -> object:
            x, k = a(env), b(env)
            if isinstance(x, dict):
                return x.get(k)
            return x[k] if isinstance(x, (list, str)) and isinstance(k, int) and -len(x) <= k < len(x) else None

        return item
    return {
        "and": lambda env: a(env) and b(env),
        "or": lambda env: a(env) or b(env),
        "==": lambda env: a(env) == b(env),
        "!=": lambda env: a(env) != b(env),
        "in": lambda env: a(env) in (b(env) or ()),
        "+": lambda env: _add(a(env), b(env)),
    }[kind]


def _add(a: object, b: object) -> object:
    return a + b if isinstance(a, int) and isinstance(b, int) else _str(a) + _str(b)


class _Blocks:
    """Statements of a template as a tree: ("text", s), ("show", e), ("set", n, e), ("for", n, e, body), ("if", [(e, body)]), ("generation", body)."""

    def __init__(self, source: str):
        self.items, at = [], 0
        for m in _TAG.finditer(source):
            text = source[at : m.start()]
            if m[0][2] == "-":
                text = text.rstrip()
            if at and source[at - 3] == "-":
                text = text.lstrip()
            self.items += [("text", text)] if text else []
            self.items.append(("show", m[1]) if m[1] is not None else ("tag", m[2].strip()))
            at = m.end()
        rest = source[at:].lstrip() if at and source[at - 3] == "-" else source[at:]
        self.items += [("text", rest)] if rest else []
        self.at = 0

    def body(self, *ends: str) -> tuple[list[tuple], str]:
        out: list[tuple] = []
        while self.at < len(self.items):
            kind, text = self.items[self.at]
            self.at += 1
            if kind == "text":
                out.append(("text", text))
                continue
            if kind == "show":
                out.append(("show", fold(_Expression(text).parse())))
                continue
            word, _, rest = text.partition(" ")
            if word in ends:
                return self.joined(out), text
            if word == "set" and (m := re.fullmatch(r"\s*([A-Za-z]\w*)\s*=(.*)", rest, re.S)):
                out.append(("set", m[1], fold(_Expression(m[2]).parse())))
            elif word == "for" and (m := re.fullmatch(r"\s*([A-Za-z]\w*)\s+in\s+(.*)", rest, re.S)):
                out.append(("for", m[1], fold(_Expression(m[2]).parse()), self.body("endfor")[0]))
            elif word == "generation":
                out.append(("generation", self.body("endgeneration")[0]))
            elif word == "if":
                arms, test = [], rest
                while True:
                    body, end = self.body("elif", "else", "endif")
                    arms.append((fold(_Expression(test).parse()), body))
                    word, _, test = end.partition(" ")
                    if word == "else":
                        arms.append((("const", True), self.body("endif")[0]))
                    if word != "elif":
                        break
                live = [x for x in arms if x[0][0] != "const" or x[0][1]]
                out += live[0][1] if live and live[0][0][0] == "const" else [("if", live)] if live else []
            else:
                raise TemplateError(f"unknown tag {text!r}")
        if ends:
            raise TemplateError(f"missing {ends}")
        return self.joined(out), ""

    @staticmethod
    def joined(nodes: list[tuple]) -> list[tuple]:
        """Constant shows become text, and neighbouring texts one."""
        out: list[tuple] = []
        for n in nodes:
            if n[0] == "show" and n[1][0] == "const":
                n = ("text", _str(n[1][1]))
            if n[0] == "text" and out and out[-1][0] == "text":
                out[-1] = ("text", out[-1][1] + n[1])
            elif n != ("text", ""):
                out.append(n)
        return out


class _Sink:
    """Rendered parts, their length so far, and generation spans."""

    def __init__(self):
        self.parts: list[str] = []
        self.length, self.spans = 0, []

    def add(self, text: str) -> None:
        self.parts.append(text)
        self.length += len(text)


def _statement(node: tuple) -> Callable[[dict, _Sink], None]:
    kind = node[0]
    if kind == "text":
        return lambda env, out, t=node[1]: out.add(t)
    if kind == "show":
        return lambda env, out, e=expression(node[1]): out.add(_str(e(env)))
    if kind == "set":
        return lambda env, out, n=node[1], e=expression(node[2]): env.__setitem__(n, e(env))
    if kind == "generation":
        body = _sequence(node[1])

        def generation(env: dict, out: _Sink) -> None:
            begin = out.length
            body(env, out)
            out.spans.append((begin, out.length))

        return generation
    if kind == "for":
        items, body = expression(node[2]), _sequence(node[3])

        def loop(env: dict, out: _Sink) -> None:
            values = items(env) or []
            for i, x in enumerate(values):
                body({**env, node[1]: x, "loop": {"index": i + 1, "index0": i, "first": i == 0, "last": i + 1 == len(values)}}, out)

        return loop
    arms = [(expression(e), _sequence(body)) for e, body in node[1]]

    def branch(env: dict, out: _Sink) -> None:
        for test, body in arms:
            if test(env):
                return body(env, out)

    return branch


def _sequence(nodes: list[tuple]) -> Callable[[dict, _Sink], None]:
    steps = [_statement(n) for n in nodes]

    def run(env: dict, out: _Sink) -> None:
        for s in steps:
            s(env, out)

    return run


def compile_template(source: str) -> Callable[..., tuple[str, list[tuple[int, int]]]]:
    """A function of messages and other names that gives the text and its generation spans."""
    run = _sequence(_Blocks(source).body()[0])

    def render(messages: list[dict], **names: object) -> tuple[str, list[tuple[int, int]]]:
        out = _Sink()
        run({**names, "messages": messages}, out)
        return "".join(out.parts), out.spans

    return render


def read_back(text: str) -> list[tuple[str, str]]:
    """Role and text of each turn of a conversation that TEMPLATE formatted."""
    turns, at = [], 0
    while at < len(text):
        if not text.startswith("<s>", at):
            raise ValueError(f"no turn at {at}")
        role_end = text.index("[INST]", at + 3)
        end = text.index("[/INST]</s>", role_end + 6)
        turns.append((unescape(text[at + 3 : role_end]), unescape(text[role_end + 6 : end])))
        at = end + 11
    return turns


def format_conversations(rows: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans (code point ranges of what a model is trained on)."""
    source = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    order = source.repartition(parts(rows), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compile_template(template)
        held: list[dict] = []
        out: list[tuple] = []

        def flush() -> None:
            text, spans = render([{"role": r["role"], "text": r["text"]} for r in held])
            out.append((held[0]["conv_id"], text, [{"a": a, "b": b} for a, b in spans]))

        def made() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.string(), pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])))
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], ["conv_id", "formatted", "loss_spans"])

        for batch in batches:
            for row in batch.to_pylist():
                if held and held[0]["conv_id"] != row["conv_id"]:
                    flush()
                    held = []
                    if len(out) >= 500:
                        yield made()
                        out = []
                held.append(row)
        if held:
            flush()
        if out:
            yield made()

    return order.mapInArrow(run, "conv_id long, formatted string, loss_spans array<struct<a: long, b: long>>")


def digests(formatted: DataFrame) -> DataFrame:
    """What the formatted conversations say when they are read back, as counts and hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                text = r["formatted"]
                turns = read_back(text)
                all_turns = hashlib.sha256()
                for role, said in turns:
                    all_turns.update(f"{role}\n{said}\n".encode())
                loss = "".join(unescape(text[s["a"] : s["b"]]) for s in r["loss_spans"])
                rows.append((r["conv_id"], len(turns), all_turns.hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
