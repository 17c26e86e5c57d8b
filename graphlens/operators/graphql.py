"""Whether a text is a document of operations and fragments, and which: a table-driven automaton with a stack, as a column.

The automaton's table is put together from the grammar's rules below. A text's tokens are folded over it in one pass.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# The language's tokens. What is left over (o) is no token and ends every document.
TOKEN = r"\"\"\"(?:[^\"\\]++|\\\"\"\"|\\|\"(?!\"\"))*+\"\"\"|\"(?:[^\"\\\n]++|\\[^\n\r\u0085\u2028\u2029])*+\"|#[^\n]*+|\.\.\.|-?(?:0|[1-9]\d*+)(?:\.\d++)?+(?:[eE][+-]?\d++)?+(?![\w.])|[A-Za-z_]\w*+|[!$&():=@\[\]{|}]|[^\s,﻿]"
OPERATIONS = ("query", "mutation", "subscription")

# Token classes, one character each: n a name, v a number, s a string, . a spread, o what is no token; q one of the
# operations, f fragment, t on; signs stand for themselves.
_SIGNS = "!$():=@[]{}"
_NAMES = "nqft"
_CLASSES = "o" + _SIGNS + _NAMES + "vs."
_POP = -1


@lru_cache(1)
def transitions() -> tuple[dict[str, str], dict[str, str]]:
    """(state, token class) to what happens, and the characters that stand for the states.

    What happens is the next state; a second one goes on the stack, to be gone on from after the bracket that now opens;
    - closes a bracket.
    """
    rules: dict[tuple[str, str], tuple[str, ...]] = {}

    def rule(state: str, classes: str, *to: str) -> None:
        for c in classes:
            rules[state, c] = to

    def value(state: str, then: str, constant: bool = False) -> None:
        """A value, after which ``then`` goes on; constant ones hold no variables."""
        kind = "constant " if constant else ""
        rule(state, _NAMES + "vs", then)
        rule(state, "[", f"{kind}list", then)
        rule(state, "{", f"{kind}object", then)
        if not constant:
            rule(state, "$", f"variable, then {then}")
            rule(f"variable, then {then}", _NAMES, then)

    def arguments(kind: str, constant: bool) -> None:
        """Arguments, of which there is one at least, lists and objects."""
        for state in (f"{kind}arguments", f"{kind}more arguments"):
            rule(state, _NAMES, f"{kind}argument")
        rule(f"{kind}more arguments", ")", "-")
        rule(f"{kind}argument", ":", f"{kind}argument value")
        value(f"{kind}argument value", f"{kind}more arguments", constant)
        value(f"{kind}list", f"{kind}list", constant)
        rule(f"{kind}list", "]", "-")
        rule(f"{kind}object", _NAMES, f"{kind}key")
        rule(f"{kind}object", "}", "-")
        rule(f"{kind}key", ":", f"{kind}key value")
        value(f"{kind}key value", f"{kind}object", constant)

    def directives(states: tuple[str, ...], then: str, kind: str = "") -> None:
        """In these states directives may follow, after which ``then`` goes on; all rules of ``then`` must stand already."""
        for state in (*states, then):
            rule(state, "@", f"directive, then {then}")
        rule(f"directive, then {then}", _NAMES, f"directive name, then {then}")
        for (state, c), to in [*rules.items()]:
            if state == then:
                rule(f"directive name, then {then}", c, *to)
        rule(f"directive name, then {then}", "(", f"{kind}arguments", then)

    arguments("", False)
    arguments("constant ", True)
    # Definitions. After a definition's selection set another may begin.
    for state in ("start", "definition"):
        rule(state, "{", "selections", "definition")
        rule(state, "q", "operation")
        rule(state, "f", "fragment")
    for state in ("operation", "named operation", "operation head"):
        rule(state, "{", "selections", "definition")
    rule("operation", _NAMES, "named operation")
    for state in ("operation", "named operation"):
        rule(state, "(", "variables", "operation head")
    directives(("operation", "named operation"), "operation head")
    rule("fragment", "nqf", "named fragment")
    rule("named fragment", "t", "fragment condition")
    rule("fragment condition", _NAMES, "fragment head")
    rule("fragment head", "{", "selections", "definition")
    directives((), "fragment head")
    # Selection sets: fields and spreads, one at least.
    inside = ("selections", "more selections", "field", "aliased field", "field with arguments", "field with directives", "spread name")
    for state in inside:
        rule(state, _NAMES, "field")
        rule(state, ".", "spread")
        if state != "selections":
            rule(state, "}", "-")
    rule("field", ":", "alias")
    rule("alias", _NAMES, "aliased field")
    for state in ("field", "aliased field"):
        rule(state, "(", "arguments", "field with arguments")
    for state in ("field", "aliased field", "field with arguments", "field with directives"):
        rule(state, "{", "selections", "more selections")
    directives(("field", "aliased field", "field with arguments"), "field with directives")
    rule("spread", "nqf", "spread name")
    directives((), "spread name")
    rule("spread", "t", "spread condition")
    rule("spread condition", _NAMES, "inline fragment")
    for state in ("spread", "inline fragment"):
        rule(state, "{", "selections", "more selections")
    directives(("spread",), "inline fragment")
    # Variables: a name, a type, perhaps a constant, perhaps directives.
    rule("variables", "$", "variable")
    rule("variable", _NAMES, "variable name")
    rule("variable name", ":", "type")
    rule("type", _NAMES, "typed")
    rule("type", "[", "inner type", "typed")
    rule("inner type", _NAMES, "inner typed")
    rule("inner type", "[", "inner type", "inner typed")
    rule("inner typed", "!", "inner required")
    for state in ("inner typed", "inner required"):
        rule(state, "]", "-")
    rule("typed", "!", "required")
    value("default", "variable done", True)
    for state in ("typed", "required", "variable done"):
        rule(state, "$", "variable")
        rule(state, ")", "-")
        if state != "variable done":
            rule(state, "=", "default")
    directives(("typed", "required"), "variable done", "constant ")
    signs: dict[str, str] = {"-": "-"}
    for state in [x for (s, _), to in rules.items() for x in (s, *to)]:
        signs.setdefault(state, chr(0x4E00 + len(signs)))
    return {signs[s] + c: "".join(signs[x] for x in to) for (s, c), to in rules.items()}, signs


def _class(token: Column) -> Column:
    """A token's class, by its place in _CLASSES."""
    named = lambda c: F.lit(_CLASSES.index(c))
    return (
        F.when(token.isin(*OPERATIONS), named("q"))
        .when(token == "fragment", named("f"))
        .when(token == "on", named("t"))
        .when(token.rlike(r"^[A-Za-z_]"), named("n"))
        .when(token == "...", named("."))
        .when(token.rlike(r'^"(?:"$|[^"]|""[\s\S]*"""$)') & (F.length(token) > 1), named("s"))
        .when(token.rlike(r"^-?\d"), named("v"))
        .when(F.length(token) == 1, F.position(token, F.lit(_SIGNS)))
        .otherwise(named("o"))
    )


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """The body of a value that is worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _numbered() -> tuple[list[int], dict[str, int]]:
    """The automaton as numbers, looked up by place: a row per state, 0 for none, of what happens for each class.

    That is the next state, and 256 times the one that goes on the stack; _POP closes a bracket, 0 leads nowhere.
    """
    rules, sign = transitions()
    number = {s: k for k, s in enumerate(sign.values())}  # the sign that closes a bracket stands first and is no state
    code = lambda to: _POP if to == sign["-"] else number[to[0]] + 256 * (number[to[1]] if len(to) > 1 else 0)
    rows = [[code(rules[s + c]) if s + c in rules else 0 for c in _CLASSES] for s in number]
    return [x for row in rows for x in row], {state: number[s] for state, s in sign.items()}


def definitions(body: Column) -> Column:
    """array<struct<kind, name>> of a document's operations and fragments; null if it is no such document.

    An operation without a name has none; a shorthand one is a query. Schema definitions are none of either.
    """
    numbers, sign = _numbered()
    table = F.array(*[F.lit(x) for x in numbers])
    tokens = F.filter(F.regexp_extract_all(body, F.lit(TOKEN), F.lit(0)), lambda x: ~x.startswith("#"))
    kind = "struct<kind:string,name:string>"
    start = F.struct(F.lit(sign["start"]).alias("state"), F.array().cast("array<int>").alias("stack"), F.lit(None).cast(kind).alias("now"), F.array().cast(f"array<{kind}>").alias("out"))

    def step(s: Column, token: Column) -> Column:
        return _let(F.get(table, s["state"] * len(_CLASSES) + _class(token)), lambda to: entered(s, token, to))

    def entered(s: Column, token: Column, to: Column) -> Column:
        depth = F.size(s["stack"])
        return _let(F.when(to == _POP, F.coalesce(F.get(s["stack"], depth - 1), F.lit(0))).otherwise(to % 256), lambda state: gone(s, token, to, depth, state))

    def gone(s: Column, token: Column, to: Column, depth: Column, state: Column) -> Column:
        pops = to == _POP
        stack = F.when(pops, F.slice(s["stack"], F.lit(1), F.greatest(depth - 1, F.lit(0)))).when(to >= 256, F.array_append(s["stack"], F.floor(to / 256).cast("int"))).otherwise(s["stack"])
        begins = s["state"].isin(sign["start"], sign["definition"])
        named = (s["state"] == sign["operation"]) & (state == sign["named operation"]) | (s["state"] == sign["fragment"]) & (state == sign["named fragment"])
        first = F.struct(F.when(token == "{", "query").otherwise(token).alias("kind"), F.lit(None).cast("string").alias("name"))
        now = F.when(begins, first).when(named, F.struct(s["now"]["kind"].alias("kind"), token.alias("name"))).otherwise(s["now"])
        closed = pops & (state == sign["definition"])
        return F.struct(state.alias("state"), stack.alias("stack"), now.alias("now"), F.when(closed, F.array_append(s["out"], now)).otherwise(s["out"]).alias("out"))

    return F.aggregate(tokens, start, step, lambda s: F.when(s["state"] == sign["definition"], s["out"]))


def _classes(token: str) -> str:
    """A token's class, where it is no sign and none of the words."""
    if token[0] == '"' and len(token) > 1:
        return "s"
    if token[0].isascii() and (token[0].isalpha() or token[0] == "_"):
        return "n"
    return "v" if re.match(r"-?[0-9]", token) else "o"


#: Tokens of one class each.
_KNOWN = {c: c for c in _SIGNS} | {x: "q" for x in OPERATIONS} | {"fragment": "f", "on": "t", "...": "."}


def _read(body: str | None, find: Callable[[str], list[str]], rules: dict[str, str], sign: dict[str, str]) -> list[dict] | None:
    """The definitions of one text; None if it is no such document."""
    start, done, closing = sign["start"], sign["definition"], sign["-"]
    naming = {(sign["operation"], sign["named operation"]), (sign["fragment"], sign["named fragment"])}
    if body is None:
        return None
    state, stack, now, out = start, [], {}, []
    for token in find(body):
        if token[0] == "#":
            continue
        to = rules.get(state + (_KNOWN.get(token) or _classes(token)))
        if to is None or (to == closing and not stack):
            return None
        before, state = state, stack.pop() if to == closing else to[0]
        if len(to) > 1:
            stack.append(to[1])
        if before == start or before == done:
            now = {"kind": "query" if token == "{" else token, "name": None}
        elif (before, state) in naming:
            now = {"kind": now["kind"], "name": token}
        if to == closing and state == done:
            out.append(now)
    return out if state == done else None


def definitions_in_batches(body: Column) -> Column:
    """``definitions`` by the same rules, in Arrow batches: for many documents, as a token's step is a dozen objects there."""
    rules, sign = transitions()
    kind = pa.list_(pa.struct([("kind", pa.string()), ("name", pa.string())]))

    def read(bodies: pa.Array) -> pa.Array:
        find = re.compile(TOKEN, re.ASCII).findall
        return pa.array([_read(x, find, rules, sign) for x in bodies.to_pylist()], kind)

    return F.arrow_udf(read, "array<struct<kind:string,name:string>>")(body)
