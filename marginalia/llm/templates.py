"""A small sandboxed template language, compiled to closures.

Text with ``{{ value }}``, ``{% if %} {% elif %} {% else %} {% endif %}``, ``{% for x in list %} {% endfor %}``,
``{% set x = value %}``, ``{% generation %} {% endgeneration %}`` and ``{# remark #}``; a minus sign inside a tag strips
the white space on its side.  Values: strings, integers, true, false, none, names, ``a.b``, ``a[b]``, ``a | filter(b)``,
``+ - * ~``, comparisons, ``in``, ``and``, ``or``, ``not`` and ``a if b else c``.

Sandbox: there are no calls but the named filters, names come from the given mapping, a member is a key of a mapping or
an index of a list (never a Python attribute), and loops run over given lists, so a template always ends.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace

TAG = re.compile(r"\{\{-?(?P<value>.*?)-?\}\}|\{%-?(?P<block>.*?)-?%\}|\{#.*?#\}", re.S)
WORD = re.compile(r"\s*(?:(?P<string>'(?:\\.|[^'\\])*'|\"(?:\\.|[^\"\\])*\")|(?P<number>\d+)|(?P<name>[A-Za-z_]\w*)"
                  r"|(?P<sign>==|!=|<=|>=|[-+*~<>()\[\].,|=]))", re.S)
ESCAPES = {"n": "\n", "t": "\t"}
MOST_NESTED = 50


class TemplateError(ValueError):
    pass


# Values: syntax tree.

@dataclass(frozen=True)
class Constant:
    value: object


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Member:
    of: object
    key: object


@dataclass(frozen=True)
class Applied:
    """A filter or an operator on values."""
    what: str
    args: tuple
    is_filter: bool = False


@dataclass(frozen=True)
class Choice:
    test: object
    then: object
    other: object


# Parts of a template.

@dataclass(frozen=True)
class Text:
    text: str


@dataclass(frozen=True)
class Value:
    value: object


@dataclass(frozen=True)
class If:
    test: object
    then: tuple
    other: tuple


@dataclass(frozen=True)
class For:
    name: str
    over: object
    body: tuple


@dataclass(frozen=True)
class Set:
    name: str
    value: object


@dataclass(frozen=True)
class Generation:
    body: tuple


def shown(value) -> str:
    if value is None:
        return ""
    if value is True or value is False:
        return "true" if value else "false"
    return str(value)


OPERATORS: dict[str, Callable] = {
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: _times(a, b),
    "~": lambda a, b: shown(a) + shown(b), "in": lambda a, b: a in b, "not": lambda a: not a,
}

FILTERS: dict[str, Callable] = {
    "trim": lambda x: shown(x).strip(), "upper": lambda x: shown(x).upper(), "lower": lambda x: shown(x).lower(),
    "capitalize": lambda x: shown(x).capitalize(), "length": len, "default": lambda x, other="": other if x is None else x,
    "string": shown, "replace": lambda x, old, new: shown(x).replace(old, new), "first": lambda x: x[0] if x else None,
    "last": lambda x: x[-1] if x else None, "join": lambda x, by="": by.join(map(shown, x)),
}


def _times(a, b):
    if isinstance(a, bool) or isinstance(b, bool) or not (isinstance(a, int) and isinstance(b, int)):
        raise TemplateError("only whole numbers can be multiplied")
    return a * b


# Reading.

class _Values:
    """Recursive descent over the words of one tag."""

    BINARY = (("or",), ("and",), ("==", "!=", "<=", ">=", "<", ">", "in"), ("~",), ("+", "-"), ("*",))

    def __init__(self, source: str):
        self.words, at = [], 0
        while source[at:].strip():
            m = WORD.match(source, at)
            if not m:
                raise TemplateError(f"cannot read {source[at:].strip()[:20]!r}")
            self.words.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self) -> str | None:
        return self.words[self.at][1] if self.at < len(self.words) and self.words[self.at][0] != "string" else None

    def take(self, *wanted: str) -> str:
        if self.peek() not in wanted:
            raise TemplateError(f"{' or '.join(wanted)} expected")
        self.at += 1
        return self.words[self.at - 1][1]

    def name(self) -> str:
        if self.at >= len(self.words) or self.words[self.at][0] != "name":
            raise TemplateError("a name is expected")
        self.at += 1
        return self.words[self.at - 1][1]

    def all(self):
        made = self.choice()
        self.end()
        return made

    def end(self) -> None:
        if self.at < len(self.words):
            raise TemplateError(f"{self.words[self.at][1]!r} is left over")

    def choice(self):
        then = self.binary(0)
        if self.peek() != "if":
            return then
        self.take("if")
        test = self.binary(0)
        self.take("else")
        return Choice(test, then, self.choice())

    def binary(self, level: int):
        if level == len(self.BINARY):
            return self.unary()
        if level == 2 and self.peek() == "not":
            self.take("not")
            return Applied("not", (self.binary(level),))
        left = self.binary(level + 1)
        while self.peek() in self.BINARY[level]:
            left = Applied(self.take(*self.BINARY[level]), (left, self.binary(level + 1)))
        return left

    def unary(self):
        made = self.atom()
        while (sign := self.peek()) in (".", "[", "|"):
            self.take(sign)
            if sign == ".":
                made = Member(made, Constant(self.name()))
            elif sign == "[":
                made = Member(made, self.choice())
                self.take("]")
            else:
                name, args = self.name(), []
                if self.peek() == "(":
                    self.take("(")
                    while self.peek() != ")":
                        args.append(self.choice())
                        if self.peek() != ")":
                            self.take(",")
                    self.take(")")
                made = Applied(name, (made, *args), True)
        return made

    def atom(self):
        if self.at >= len(self.words):
            raise TemplateError("a value is missing")
        kind, word = self.words[self.at]
        if word == "(" and kind == "sign":
            self.take("(")
            made = self.choice()
            self.take(")")
            return made
        if word == "-" and kind == "sign":
            self.take("-")
            return Applied("-", (Constant(0), self.atom()))
        self.at += 1
        if kind == "string":
            return Constant(re.sub(r"\\(.)", lambda m: ESCAPES.get(m[1], m[1]), word[1:-1], flags=re.S))
        if kind == "number":
            return Constant(int(word))
        if kind == "name":
            fixed = {"true": True, "false": False, "none": None}
            return Constant(fixed[word]) if word in fixed else Name(word)
        raise TemplateError(f"{word!r} is no value")


def parse(source: str) -> tuple:
    """The syntax tree of a template."""
    pieces, at, strip = [], 0, False
    for m in TAG.finditer(source):
        text = source[at:m.start()]
        text = text.lstrip() if strip else text
        pieces.append(("text", text.rstrip() if m[0][2] == "-" else text))
        if m["value"] is not None:
            pieces.append(("value", m["value"]))
        elif m["block"] is not None:
            pieces.append(("block", m["block"]))
        at, strip = m.end(), m[0][-3] == "-"
    pieces.append(("text", source[at:].lstrip() if strip else source[at:]))
    where = 0

    def body(closing: tuple, depth: int) -> tuple[tuple, str, str]:
        nonlocal where
        if depth > MOST_NESTED:
            raise TemplateError("nested too deeply")
        made = []
        while where < len(pieces):
            kind, what = pieces[where]
            where += 1
            if kind == "text":
                if what:
                    made.append(Text(what))
                continue
            if kind == "value":
                made.append(Value(_Values(what).all()))
                continue
            word, _, rest = what.strip().partition(" ")
            if word in closing:
                return tuple(made), word, rest
            if word == "if":
                made.append(branch(rest, depth))
            elif word == "for":
                values = _Values(rest)
                name = values.name()
                values.take("in")
                over = values.all()
                made.append(For(name, over, body(("endfor",), depth + 1)[0]))
            elif word == "set":
                values = _Values(rest)
                name = values.name()
                values.take("=")
                made.append(Set(name, values.all()))
            elif word == "generation":
                made.append(Generation(body(("endgeneration",), depth + 1)[0]))
            else:
                raise TemplateError(f"unknown tag {word!r}")
        if closing:
            raise TemplateError(f"{closing[-1]} is missing")
        return tuple(made), "", ""

    def branch(test: str, depth: int) -> If:
        then, word, rest = body(("elif", "else", "endif"), depth + 1)
        if word == "elif":
            other: tuple = (branch(rest, depth + 1),)
        elif word == "else":
            other = body(("endif",), depth + 1)[0]
        else:
            other = ()
        return If(_Values(test).all(), then, other)

    return body((), 0)[0]


# Folding.

def fold_value(x, filters: dict):
    if isinstance(x, Applied):
        args = tuple(fold_value(a, filters) for a in x.args)
        x = replace(x, args=args)
        if x.what in ("and", "or") and not x.is_filter:
            if isinstance(args[0], Constant):
                return args[1] if bool(args[0].value) == (x.what == "and") else args[0]
            return x
        if all(isinstance(a, Constant) for a in args):
            try:
                return Constant((filters if x.is_filter else OPERATORS)[x.what](*(a.value for a in args)))
            except Exception:  # reported when, and only if, it is rendered
                return x
    elif isinstance(x, Member):
        return Member(fold_value(x.of, filters), fold_value(x.key, filters))
    elif isinstance(x, Choice):
        test = fold_value(x.test, filters)
        if isinstance(test, Constant):
            return fold_value(x.then if test.value else x.other, filters)
        return Choice(test, fold_value(x.then, filters), fold_value(x.other, filters))
    return x


def fold(body: tuple, filters: dict) -> tuple:
    """The same template with constant values computed, dead branches gone and neighbouring texts joined."""
    made: list = []

    def add(part) -> None:
        if isinstance(part, Text) and made and isinstance(made[-1], Text):
            made[-1] = Text(made[-1].text + part.text)
        elif not (isinstance(part, Text) and not part.text):
            made.append(part)

    for part in body:
        if isinstance(part, Value):
            value = fold_value(part.value, filters)
            add(Text(shown(value.value)) if isinstance(value, Constant) else Value(value))
        elif isinstance(part, If):
            test = fold_value(part.test, filters)
            if isinstance(test, Constant):
                for x in fold(part.then if test.value else part.other, filters):
                    add(x)
            else:
                add(If(test, fold(part.then, filters), fold(part.other, filters)))
        elif isinstance(part, For):
            add(replace(part, over=fold_value(part.over, filters), body=fold(part.body, filters)))
        elif isinstance(part, Set):
            add(replace(part, value=fold_value(part.value, filters)))
        elif isinstance(part, Generation):
            add(Generation(fold(part.body, filters)))
        else:
            add(part)
    return tuple(made)


# Closures.

@dataclass
class Written:
    """Output so far: pieces, their length in code points, and the spans under generation markers."""
    pieces: list = field(default_factory=list)
    length: int = 0
    spans: list = field(default_factory=list)

    def add(self, text: str) -> None:
        self.pieces.append(text)
        self.length += len(text)


def value_closure(x, filters: dict) -> Callable[[dict], object]:
    if isinstance(x, Constant):
        return lambda env, v=x.value: v
    if isinstance(x, Name):
        return lambda env, name=x.name: env.get(name)
    if isinstance(x, Member):
        of, key = value_closure(x.of, filters), value_closure(x.key, filters)

        def member(env):
            holder, k = of(env), key(env)
            if isinstance(holder, dict):
                return holder.get(k)
            if isinstance(holder, (list, str)) and isinstance(k, int) and -len(holder) <= k < len(holder):
                return holder[k]
            return None
        return member
    if isinstance(x, Choice):
        test, then, other = (value_closure(v, filters) for v in (x.test, x.then, x.other))
        return lambda env: then(env) if test(env) else other(env)
    args = [value_closure(a, filters) for a in x.args]
    if x.what == "and" and not x.is_filter:
        return lambda env: args[0](env) and args[1](env)
    if x.what == "or" and not x.is_filter:
        return lambda env: args[0](env) or args[1](env)
    table = filters if x.is_filter else OPERATORS
    if x.what not in table:
        raise TemplateError(f"unknown filter {x.what!r}")
    apply = table[x.what]
    if len(args) == 1:
        return lambda env, a=args[0]: apply(a(env))
    return lambda env: apply(*(a(env) for a in args))


def body_closure(body: tuple, filters: dict) -> Callable[[dict, Written], None]:
    steps = [_step(part, filters) for part in body]
    if len(steps) == 1:
        return steps[0]

    def run(env, out):
        for step in steps:
            step(env, out)
    return run


def _step(part, filters: dict) -> Callable[[dict, Written], None]:
    if isinstance(part, Text):
        return lambda env, out, text=part.text: out.add(text)
    if isinstance(part, Value):
        value = value_closure(part.value, filters)
        return lambda env, out: out.add(shown(value(env)))
    if isinstance(part, If):
        test, then, other = value_closure(part.test, filters), body_closure(part.then, filters), body_closure(part.other, filters)
        return lambda env, out: then(env, out) if test(env) else other(env, out)
    if isinstance(part, Set):
        value = value_closure(part.value, filters)

        def assign(env, out, name=part.name):
            env[name] = value(env)
        return assign
    if isinstance(part, Generation):
        body = body_closure(part.body, filters)

        def marked(env, out):
            start = out.length
            body(env, out)
            out.spans.append((start, out.length))
        return marked
    over, body = value_closure(part.over, filters), body_closure(part.body, filters)

    def loop(env, out, name=part.name):
        items = over(env) or []
        if not isinstance(items, list):
            raise TemplateError("a loop needs a list")
        inner = dict(env)  # what a loop sets ends with it
        for i, item in enumerate(items):
            inner[name] = item
            inner["loop"] = {"index": i + 1, "index0": i, "first": i == 0, "last": i == len(items) - 1, "length": len(items)}
            body(inner, out)
    return loop


def compile_template(source: str, filters: dict[str, Callable] | None = None) -> Callable[[dict], tuple[str, list[tuple[int, int]]]]:
    """A function from a mapping of names to (text, spans in code points under generation markers).  ``filters`` are
    further pure functions that a template may apply by name."""
    known = {**FILTERS, **(filters or {})}
    run = body_closure(fold(parse(source), known), known)

    def render(names: dict) -> tuple[str, list[tuple[int, int]]]:
        out = Written()
        run(dict(names), out)
        return "".join(out.pieces), out.spans
    return render
