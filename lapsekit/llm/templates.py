"""A small sandboxed template language, compiled to Python closures.

    text {{ expression }} {% for x in expression %}..{% endfor %} {% if e %}..{% elif e %}..{% else %}..{% endif %}
    {% set x = expression %} {% generation %}..{% endgeneration %} {# comment #}      (-%} and {%- trim white space)

Expressions: names, strings, integers, true/false/none, ``a.b`` and ``a['b']`` (keys of records only),
``== != < <= > >= in not and or + ~``, parentheses and the filters ``escape trim upper lower length default``.
There are no calls and no attributes of Python objects, so a template can reach nothing but its inputs.

``compile_template`` parses to a syntax tree, folds constant parts and returns a function that yields
(text, is_generated) pieces. Loops read their input once, with one element of lookahead for ``loop.last``, so a
conversation can be a stream and need not fit in memory.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import Any

TAG = re.compile(r"\{\{(-?)(.*?)(-?)\}\}|\{%(-?)(.*?)(-?)%\}|\{#.*?#\}", re.S)
LEXEME = re.compile(r"""\s*(?:(\d+)|('(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|([A-Za-z_]\w*)|(==|!=|<=|>=|[-+~<>()\[\].|,]))""", re.S)
WORDS = {"true": True, "false": False, "none": None, "True": True, "False": False, "None": None}
ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


class TemplateError(ValueError):
    pass


# --- syntax tree: ("text", s) ("out", e) ("for", name, e, body) ("if", [(e, body)], body) ("set", name, e) ("gen", body)
# --- expressions: ("const", v) ("name", n) ("get", e, k) ("bin", op, a, b) ("not", a) ("and"/"or", a, b) ("filter", name, e, args)

def parse(source: str) -> list:
    pieces, at, trim = [], 0, False
    for m in TAG.finditer(source):
        text = source[at:m.start()]
        if trim:
            text = text.lstrip()
        if m[1] or m[4]:
            text = text.rstrip()
        if text:
            pieces.append(("text", text))
        if m[2] is not None:
            pieces.append(("out", _expression(m[2])))
        elif m[5] is not None:
            pieces.append(("tag", m[5].strip()))
        trim, at = bool(m[3] or m[6]), m.end()
    tail = source[at:].lstrip() if trim else source[at:]
    if tail:
        pieces.append(("text", tail))
    body, rest, stop = _block(pieces, 0, ())
    if stop:
        raise TemplateError(f"unexpected {stop}")
    return body


def _block(pieces: list, i: int, ends: tuple[str, ...]) -> tuple[list, int, str]:
    body = []
    while i < len(pieces):
        kind, value = pieces[i]
        i += 1
        if kind != "tag":
            body.append((kind, value))
            continue
        word, _, rest = value.partition(" ")
        if word in ends:
            return body, i, value
        if word == "for":
            m = re.fullmatch(r"([A-Za-z_]\w*)\s+in\s+(.+)", rest.strip(), re.S)
            if not m:
                raise TemplateError(f"bad loop: {value}")
            inner, i, _ = _block(pieces, i, ("endfor",))
            body.append(("for", m[1], _expression(m[2]), inner))
        elif word == "if":
            cases, otherwise, test = [], [], _expression(rest)
            while True:
                inner, i, stop = _block(pieces, i, ("elif", "else", "endif"))
                if test is None:
                    otherwise = inner
                else:
                    cases.append((test, inner))
                if stop.startswith("elif"):
                    test = _expression(stop[4:])
                elif stop == "else":
                    test = None
                else:
                    break
            body.append(("if", cases, otherwise))
        elif word == "set":
            name, eq, e = rest.partition("=")
            if not eq or not name.strip().isidentifier():
                raise TemplateError(f"bad set: {value}")
            body.append(("set", name.strip(), _expression(e)))
        elif word == "generation":
            inner, i, _ = _block(pieces, i, ("endgeneration",))
            body.append(("gen", inner))
        else:
            raise TemplateError(f"unknown tag: {value}")
    if ends:
        raise TemplateError(f"missing {ends[-1]}")
    return body, i, ""


def _expression(source: str):
    lexemes, at, end = [], 0, len(source.rstrip())
    while at < end:
        m = LEXEME.match(source, at)
        if not m:
            raise TemplateError(f"bad expression: {source.strip()}")
        at = m.end()
        if m[1]:
            lexemes.append(("const", int(m[1])))
        elif m[2]:
            lexemes.append(("const", re.sub(r"\\(.)", lambda x: ESCAPES.get(x[1], x[1]), m[2][1:-1], flags=re.S)))
        else:
            lexemes.append(("name", m[3]) if m[3] else ("op", m[4]))
    e, i = _binary(lexemes, 0, 0)
    if i != len(lexemes):
        raise TemplateError(f"bad expression: {source.strip()}")
    return e


LEVELS = [{"or"}, {"and"}, {"not"}, {"==", "!=", "<", "<=", ">", ">=", "in"}, {"+", "~"}]


def _binary(x: list, i: int, level: int):
    if level == len(LEVELS):
        return _postfix(x, i)
    if level == 2:
        if i < len(x) and x[i] == ("name", "not"):
            e, i = _binary(x, i + 1, level)
            return ("not", e), i
        return _binary(x, i, level + 1)
    left, i = _binary(x, i, level + 1)
    while i < len(x) and x[i][0] != "const" and x[i][1] in LEVELS[level]:
        op = x[i][1]
        right, i = _binary(x, i + 1, level + 1)
        left = (op, left, right) if op in ("and", "or") else ("bin", op, left, right)
    return left, i


def _postfix(x: list, i: int):
    if i >= len(x):
        raise TemplateError("expression ends early")
    kind, value = x[i]
    i += 1
    if kind == "const":
        e = ("const", value)
    elif kind == "name":
        e = ("const", WORDS[value]) if value in WORDS else ("name", value)
    elif value == "(":
        e, i = _binary(x, i, 0)
        if x[i:i + 1] != [("op", ")")]:
            raise TemplateError("missing )")
        i += 1
    else:
        raise TemplateError(f"unexpected {value}")
    while i < len(x) and x[i][0] == "op" and x[i][1] in ".[|":
        op = x[i][1]
        if op == "[":
            key, i = _binary(x, i + 1, 0)
            if x[i:i + 1] != [("op", "]")]:
                raise TemplateError("missing ]")
            e, i = ("get", e, key), i + 1
            continue
        if i + 1 >= len(x) or x[i + 1][0] != "name":
            raise TemplateError(f"a name must follow {op}")
        name, i = x[i + 1][1], i + 2
        if op == ".":
            e = ("get", e, ("const", name))
            continue
        args = []
        if x[i:i + 1] == [("op", "(")]:
            arg, i = _binary(x, i + 1, 0)
            if x[i:i + 1] != [("op", ")")]:
                raise TemplateError("missing )")
            args, i = [arg], i + 1
        if name not in FILTERS:
            raise TemplateError(f"unknown filter: {name}")
        e = ("filter", name, e, args)
    return e, i


def _text(v: Any) -> str:
    return "" if v is None else v if isinstance(v, str) else str(v)


FILTERS: dict[str, Callable] = {
    "trim": lambda env, v: _text(v).strip(), "upper": lambda env, v: _text(v).upper(), "lower": lambda env, v: _text(v).lower(),
    "length": lambda env, v: len(v) if v is not None else 0, "default": lambda env, v, d: d if v is None else v,
    "escape": lambda env, v: env["__escape__"](_text(v))}
BINARY: dict[str, Callable] = {
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "in": lambda a, b: a in b,
    "+": lambda a, b: _text(a) + _text(b) if isinstance(a, str) or isinstance(b, str) else a + b, "~": lambda a, b: _text(a) + _text(b)}


def fold(e):
    """Constant parts of an expression become constants."""
    kind = e[0]
    if kind in ("const", "name"):
        return e
    if kind == "get":
        return ("get", fold(e[1]), fold(e[2]))
    if kind == "not":
        a = fold(e[1])
        return ("const", not a[1]) if a[0] == "const" else ("not", a)
    if kind in ("and", "or"):
        a, b = fold(e[1]), fold(e[2])
        if a[0] == "const":
            return (b if a[1] else a) if kind == "and" else (a if a[1] else b)
        return (kind, a, b)
    if kind == "bin":
        a, b = fold(e[2]), fold(e[3])
        return ("const", BINARY[e[1]](a[1], b[1])) if a[0] == b[0] == "const" else ("bin", e[1], a, b)
    v, args = fold(e[2]), [fold(a) for a in e[3]]
    if e[1] != "escape" and all(x[0] == "const" for x in (v, *args)):
        return ("const", FILTERS[e[1]](None, v[1], *(a[1] for a in args)))
    return ("filter", e[1], v, args)


def fold_body(body: list) -> list:
    """Fold expressions, drop dead branches and join neighbouring text."""
    out: list = []
    for node in body:
        kind = node[0]
        if kind == "out":
            e = fold(node[1])
            node = ("text", _text(e[1])) if e[0] == "const" else ("out", e)
        elif kind == "for":
            node = ("for", node[1], fold(node[2]), fold_body(node[3]))
        elif kind == "set":
            node = ("set", node[1], fold(node[2]))
        elif kind == "gen":
            node = ("gen", fold_body(node[1]))
        elif kind == "if":
            cases, otherwise = [], fold_body(node[2])
            for test, inner in node[1]:
                test = fold(test)
                if test[0] != "const":
                    cases.append((test, fold_body(inner)))
                elif test[1]:
                    otherwise = fold_body(inner)
                    break
            if not cases:
                for x in otherwise:
                    _append(out, x)
                continue
            node = ("if", cases, otherwise)
        _append(out, node)
    return out


def _append(out: list, node: tuple):
    if node[0] == "text" and out and out[-1][0] == "text":
        node = ("text", out.pop()[1] + node[1])
    if node != ("text", ""):
        out.append(node)


def _value(e) -> Callable[[dict], Any]:
    kind = e[0]
    if kind == "const":
        v = e[1]
        return lambda env: v
    if kind == "name":
        n = e[1]
        return lambda env: env.get(n)
    if kind == "get":
        base, key = _value(e[1]), _value(e[2])

        def get(env):
            b = base(env)
            return b.get(key(env)) if isinstance(b, dict) else None
        return get
    if kind == "not":
        a = _value(e[1])
        return lambda env: not a(env)
    if kind == "and":
        a, b = _value(e[1]), _value(e[2])
        return lambda env: a(env) and b(env)
    if kind == "or":
        a, b = _value(e[1]), _value(e[2])
        return lambda env: a(env) or b(env)
    if kind == "bin":
        f, a, b = BINARY[e[1]], _value(e[2]), _value(e[3])
        return lambda env: f(a(env), b(env))
    f, v, args = FILTERS[e[1]], _value(e[2]), [_value(a) for a in e[3]]
    return lambda env: f(env, v(env), *(a(env) for a in args))


def _run(body: list) -> Callable[[dict, bool], Iterator[tuple[str, bool]]]:
    steps = [_step(node) for node in body]
    if len(steps) == 1:
        return steps[0]

    def run(env, gen):
        for s in steps:
            yield from s(env, gen)
    return run


def _step(node) -> Callable[[dict, bool], Iterator[tuple[str, bool]]]:
    kind = node[0]
    if kind == "text":
        s = node[1]

        def text(env, gen):
            yield s, gen
        return text
    if kind == "out":
        v = _value(node[1])

        def out(env, gen):
            yield _text(v(env)), gen
        return out
    if kind == "set":
        n, v = node[1], _value(node[2])

        def assign(env, gen):
            env[n] = v(env)
            yield from ()
        return assign
    if kind == "gen":
        inner = _run(node[1])
        return lambda env, gen: inner(env, True)
    if kind == "if":
        cases, otherwise = [(_value(t), _run(b)) for t, b in node[1]], _run(node[2])

        def choose(env, gen):
            for test, inner in cases:
                if test(env):
                    return inner(env, gen)
            return otherwise(env, gen)
        return choose
    name, over, inner = node[1], _value(node[2]), _run(node[3])

    def loop(env, gen):
        it, i = iter(over(env) or ()), 0
        item = next(it, _END)
        own = dict(env)
        while item is not _END:
            after = next(it, _END)
            own[name] = item
            own["loop"] = {"index": i + 1, "index0": i, "first": i == 0, "last": after is _END}
            yield from inner(own, gen)
            item, i = after, i + 1
    return loop


_END = object()


def compile_template(source: str, escape: Callable[[str], str] = str) -> Callable[..., Iterator[tuple[str, bool]]]:
    """``render(messages=..., **names)`` yields (text, is_generated) pieces in order."""
    run = _run(fold_body(parse(source)))
    return lambda **names: run({**names, "__escape__": escape}, False)


class Escaper:
    """Reversible escaping of control strings: no control string occurs in an escaped text.

    A backslash is doubled, and one is put behind the first character of each control string (also of
    overlapping ones), so a single backslash is always ours.
    """

    def __init__(self, controls: list[str]):
        if any(len(c) < 2 or "\\" in c for c in controls):
            raise ValueError("control strings need two characters or more and no backslash")
        heads = "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in controls)
        self._find = re.compile(rf"(\\)|({heads})" if heads else r"(\\)()")
        self._back = re.compile(r"\\(\\?)")

    def escape(self, s: str) -> str:
        return self._find.sub(lambda m: "\\\\" if m[1] else m[2] + "\\", s)

    def unescape(self, s: str) -> str:
        return self._back.sub(lambda m: m[1], s)
