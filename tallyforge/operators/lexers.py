"""Symbols, imports and calls of JavaScript, TypeScript, Go and the script blocks of vue files, from their tokens.

A lexer knows strings, templates with code in them, comments and regular expressions, so brackets in these count for
nothing; the brackets that are left are matched, and definitions are read from what stands around them."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate
from typing import NamedTuple

#: Fixed value: how a script block looks in a vue file.
SCRIPT_BLOCK = re.compile(r"<script\b(?P<attrs>[^>]*)>(?P<body>.*?)</script>", re.S | re.I)

_SPACE = r"(?P<space>\s+|//[^\n]*|/\*.*?(?:\*/|\Z))"
_NAME = r"(?P<name>[#@]?[A-Za-z_$\u0080-\U0010ffff][\w$\u0080-\U0010ffff]*)"
_NUMBER = r"(?P<number>\d[\w.]*)"
_QUOTED = r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'"
_SCRIPT = re.compile(rf"{_SPACE}|{_NAME}|{_NUMBER}|(?P<string>{_QUOTED})|(?P<mark>=>|\?\.(?!\d)|\.\.\.|[-+*/%&|^=<>!?]=+|&&|\|\||\?\?|\+\+|--|[^\w\s])", re.S)
_GO = re.compile(rf"{_SPACE}|{_NAME}|{_NUMBER}|(?P<string>{_QUOTED}|`[^`]*`)|(?P<mark>:=|&&|\|\||<-|\.\.\.|[-+*/%&|^=<>!]=|[^\w\s])", re.S)
_REGEX = re.compile(r"/(?![*/])(?:[^\\/\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
_TEMPLATE = re.compile(r"(?:[^`\\$]|\\.|\$(?!\{))*(?P<end>`|\$\{|\Z)", re.S)

#: Words after which a slash begins a regular expression and `function` or `class` an expression.
_BEFORE_VALUE = frozenset("return typeof case in of delete void throw new else do yield await instanceof".split())
#: Words that aren't called, defined as methods of objects, or a member's own name.
_SCRIPT_WORDS = frozenset("async if for while switch catch function return with typeof await void delete new super import class do else in of instanceof throw yield case default const let var".split())
_GO_WORDS = frozenset("if for switch select func return go defer range case chan map struct interface type var const package import else".split())
_MODIFIERS = frozenset("static async get set readonly public private protected override accessor declare".split())
_OPENS, _CLOSES = {"(": ")", "[": "]", "{": "}"}, frozenset(")]}")


class Token(NamedTuple):
    kind: str
    text: str
    start: int
    end: int
    after_line: bool  # on another line than the token before


def tokens(text: str, go: bool = False) -> list[Token]:
    """The tokens of a text without comments. A template is a string token for each of its parts, the code between them is
    tokens in brackets; a quote that its line doesn't close is a mark."""
    out: list[Token] = []
    at, depth, templates, line = 0, 0, [], False

    def put(kind: str, start: int, end: int) -> None:
        nonlocal line
        out.append(Token(kind, text[start:end], start, end, line))
        line = False

    def template(start: int) -> int:
        m = _TEMPLATE.match(text, start)
        put("template", start, m.end())
        if m["end"] == "${":
            templates.append(depth)
            out.append(Token("mark", "{", m.end() - 1, m.end(), False))
        return m.end()

    while at < len(text):
        if not go and text[at] == "/" and (m := _REGEX.match(text, at)) and (not out or _value_next(out[-1])):
            put("string", at, m.end())
            at = m.end()
            continue
        m = (_GO if go else _SCRIPT).match(text, at)
        kind = m.lastgroup
        if kind == "space":
            line |= "\n" in m[0]
        elif kind == "mark" and not go and m[0] == "`":
            at = template(m.end())
            if templates and out[-1].text == "{":
                depth += 1
            continue
        else:
            put(kind, m.start(), m.end())
            if m[0] == "{":
                depth += 1
            elif m[0] == "}":
                depth -= 1
                if templates and templates[-1] == depth:
                    templates.pop()
                    at = template(m.end())
                    if out[-1].text == "{":
                        depth += 1
                    continue
        at = m.end()
    return out


def _value_next(t: Token) -> bool:
    """Whether a value, rather than an operator, comes after a token."""
    if t.kind == "name":
        return t.text in _BEFORE_VALUE
    return t.kind == "mark" and t.text not in (")", "]", "}", "++", "--")


def brackets(ts: list[Token]) -> tuple[dict[int, int], list[int]]:
    """The place of each bracket's partner, both ways, and of the innermost open bracket around each token (-1 without any).
    Brackets without a partner are left out."""
    partner: dict[int, int] = {}
    around, stack = [], []
    for i, t in enumerate(ts):
        if t.kind == "mark" and t.text in _CLOSES:
            k = next((k for k in range(len(stack) - 1, -1, -1) if _OPENS[ts[stack[k]].text] == t.text), None)
            if k is not None:
                partner[stack[k]], partner[i] = i, stack[k]
                del stack[k:]
        around.append(stack[-1] if stack else -1)
        if t.kind == "mark" and t.text in _OPENS:
            stack.append(i)
    return partner, around


class Found(NamedTuple):
    fact: str
    name: str
    kind: str
    start: int
    end: int
    head: int  # where a symbol's body begins; its signature ends there


class _Reader:
    def __init__(self, text: str, go: bool) -> None:
        self.text, self.ts = text, tokens(text, go)
        self.partner, self.around = brackets(self.ts)
        self.names: set[int] = set()  # tokens that name a definition

    def at(self, i: int) -> str:
        return self.ts[i].text if 0 <= i < len(self.ts) and self.ts[i].kind in ("name", "mark") else ""

    def symbol(self, name: int, kind: str, first: int, last: int, body: int | None) -> Found:
        """From token `first` to `last`; `body` is the token that opens the body."""
        self.names.add(name)
        end = self.ts[last].end
        return Found("symbol", self.ts[name].text, kind, self.ts[first].start, end, end if body is None else self.ts[body].start)

    def calls(self, words: frozenset[str]) -> Iterator[Found]:
        for i, t in enumerate(self.ts):
            if t.kind != "name" or i in self.names or t.text[0] in "#@" or self.at(self.around[i] - 1) == "interface" or t.text in words and self.at(i - 1) not in (".", "?."):
                continue
            follows = self.at(i + 1) == "(" or self.at(i + 1) == "?." and self.at(i + 2) == "(" or i + 1 < len(self.ts) and self.ts[i + 1].kind == "template" and self.text[self.ts[i + 1].start - 1] == "`"
            if follows and self.at(i - 1) != "function" or self.at(i - 1) == "new" and self.at(i + 1) not in (".", "?."):
                yield Found("call", t.text, "call", t.start, t.end, t.end)


class _Script(_Reader):
    """JavaScript, and TypeScript with its interfaces, types and modifiers."""

    def __init__(self, text: str, typed: bool) -> None:
        super().__init__(text, False)
        self.typed = typed
        self.bodies: dict[int, str] = {}  # open braces that hold members: class, interface or object

    def past(self, i: int) -> int:
        """The token behind a list of type parameters at `i`, or `i`."""
        if self.at(i) != "<":
            return i
        depth = 0
        for j in range(i, min(i + 400, len(self.ts))):
            depth += {"<": 1, ">": -1}.get(self.at(j), 0)
            if depth == 0:
                return j + 1
        return i

    def body(self, i: int) -> int | None:
        """The brace that opens a function's body after its parameters, behind a type if there is one."""
        if self.at(i) == "{":
            return i
        if self.at(i) != ":":
            return None
        j = i + 1
        while j < len(self.ts):
            x = self.at(j)
            if x == "{" and self.at(j - 1) not in (":", "|", "&", "=>", "<", ",", "extends"):
                return j
            if x in (";", ",", "=", ")", "]", "}") and x != "=>":
                return None
            j = max(self.past(j), self.partner.get(j, j) + 1 if x in _OPENS else j + 1)
        return None

    def value_end(self, i: int) -> int:
        """The last token of the expression that begins at `i`: before a comma, a semicolon or a closing bracket, or at a line's
        end where no operator goes on."""
        last = i
        while i < len(self.ts):
            t = self.ts[i]
            if t.kind == "mark" and (t.text in (",", ";") or t.text in _CLOSES):
                break
            goes_on = t.kind == "mark" and t.text not in ("{", "(", "[", "!", "@") or self.at(i) in ("in", "instanceof", "as", "satisfies")
            if t.after_line and last != i and not goes_on and not _value_next(self.ts[last]):
                break
            last = self.partner.get(i, i) if t.text in _OPENS and t.kind == "mark" else i
            i = last + 1
        return last

    def function_value(self, i: int) -> int | None:
        """The last token of the arrow function or function expression that begins at `i`, if one does."""
        j = i + (self.at(i) == "async")
        if self.at(j) == "function":
            while j < len(self.ts) and self.at(j) != "(":
                j += 1
            b = self.body(self.partner.get(j, len(self.ts)) + 1)
            return None if b is None or b not in self.partner else self.partner[b]
        j = self.past(j)
        if self.at(j) == "(" and j in self.partner:
            k = self.partner[j] + 1
            if self.at(k) == ":":
                while k < len(self.ts) and self.at(k) not in ("=>", ";", "="):
                    k = self.partner.get(k, k) + 1 if self.at(k) in _OPENS else k + 1
        elif j < len(self.ts) and self.ts[j].kind == "name":
            k = j + 1
        else:
            return None
        if self.at(k) != "=>":
            return None
        return self.partner[k + 1] if self.at(k + 1) == "{" and k + 1 in self.partner else self.value_end(k + 1) if k + 1 < len(self.ts) else k

    def declared(self, i: int) -> bool:
        """Whether `function`, `class` or `interface` at `i` begins a declaration, not an expression."""
        if i == 0 or self.ts[i - 1].kind == "name" and self.ts[i - 1].text in ("export", "default", "declare"):
            return True
        before = self.ts[i - 1]
        return before.text in (";", "{", "}", ")") and before.kind == "mark" or before.text in ("else", "do") or self.ts[i].after_line and (before.text == ">" or not _value_next(before))

    def found(self) -> Iterator[Found]:
        ts = self.ts
        for i, t in enumerate(ts):
            if t.kind == "mark" and t.text == "{":
                before = self.at(i - 1)
                if i and (before in ("=", "(", ",", ":", "[", "?", "??", "&&", "||", "return", "...", "default") or before == "{" and self.bodies.get(i - 1) == "template"):
                    self.bodies.setdefault(i, "object")
            if t.kind == "name" and self.at(i - 1) not in (".", "?."):
                yield from self.at_name(i, t)
            if t.kind in ("name", "string", "number") or t.text == "]":
                yield from self.member(i)
        yield from self.imports()
        yield from self.calls(_SCRIPT_WORDS)

    def at_name(self, i: int, t: Token) -> Iterator[Found]:
        ts = self.ts
        if t.text == "function":
            first = i - (self.at(i - 1) == "async")
            name = i + 1 + (self.at(i + 1) == "*")
            if name < len(ts) and ts[name].kind == "name" and self.declared(first):
                p = self.past(name + 1)
                if self.at(p) == "(" and p in self.partner:
                    b = self.body(self.partner[p] + 1)
                    if b in self.partner:
                        yield self.symbol(name, "function", first, self.partner[b], b)
        elif t.text in ("class", "interface") and (i + 1 < len(ts) and ts[i + 1].kind == "name" or t.text == "class") and (t.text == "class" or self.typed):
            b = i + 1
            while b < len(ts) and self.at(b) not in ("{", ";", ")", "="):
                b = max(self.past(b), self.partner.get(b, b) + 1 if self.at(b) in _OPENS else b + 1)
            if self.at(b) == "{" and b in self.partner:
                self.bodies[b] = t.text
                if self.declared(i) and ts[i + 1].kind == "name" and self.at(i + 1) not in ("extends", "implements"):
                    yield self.symbol(i + 1, t.text, i, self.partner[b], b)
        elif t.text in ("const", "let", "var"):
            name, scope = i + 1, self.around[i]
            while name < len(ts) and ts[name].kind == "name" or self.at(name) in ("{", "["):
                j = self.partner.get(name, name) + 1
                if self.at(j) == ":":
                    while j < len(ts) and self.at(j) not in ("=", ";", ",") and self.around[j] == scope and not (ts[j].after_line and not _value_next(ts[j - 1])):
                        j = self.partner.get(j, j) + 1 if self.at(j) in _OPENS else j + 1
                if self.at(j) == "=" and j + 1 < len(ts):
                    last = self.function_value(j + 1)
                    if last is not None and ts[name].kind == "name":
                        yield self.symbol(name, "function", name, last, None)
                    j = (self.value_end(j + 1) if last is None else last) + 1
                if self.at(j) != ",":
                    break
                name = j + 1

    def member(self, i: int) -> Iterator[Found]:
        """A method whose name (or its closing bracket, if computed) is at `i`."""
        home = self.bodies.get(self.around[i])
        name = self.partner.get(i, i) if self.at(i) == "]" else i
        if self.at(i) == "]":
            home = self.bodies.get(self.around[name])
        if home is None or i in self.names:
            return
        p = self.past(i + 1 + (self.at(i + 1) in ("?", "!")))
        if self.at(p) != "(" or p not in self.partner or self.at(i) == "@":
            return
        first = name
        while first and (self.at(first - 1) in _MODIFIERS or self.at(first - 1) == "*"):
            first -= 1
        before = self.at(first - 1)
        fits = before in ("{", ",") or home != "object" and (before in (";", "}", ")") or self.ts[first].after_line and not before.startswith("@"))
        if not fits or self.ts[first - 1].kind == "name" and before.startswith("@") or home == "object" and self.at(i) in _SCRIPT_WORDS:
            return
        b = self.body(self.partner[p] + 1)
        if home != "object":
            self.names.add(i)
        if b in self.partner and home != "interface":
            self.names.add(i)
            if name == i:
                yield self.symbol(i, "method", first, self.partner[b], b)
            else:
                yield Found("symbol", self.text[self.ts[name].start : self.ts[i].end], "method", self.ts[first].start, self.ts[self.partner[b]].end, self.ts[b].start)

    def imports(self) -> Iterator[Found]:
        for i, t in enumerate(self.ts):
            if t.text != "import" or t.kind != "name" or self.at(i - 1) in (".", "?."):
                continue
            if self.at(i + 1) == "(":
                j = i + 2
            else:
                j = i + 1
                while j < len(self.ts) and self.ts[j].kind != "string" and self.at(j) not in (";", "=", "(") and self.at(j) != "import":
                    j += 1
            if j < len(self.ts) and self.ts[j].kind == "string":
                yield Found("import", self.ts[j].text.strip("\"'`"), "import", self.ts[j].start, self.ts[j].end, self.ts[j].end)


class _Go(_Reader):
    def found(self) -> Iterator[Found]:
        ts = self.ts
        for i, t in enumerate(ts):
            if t.kind != "name" or self.at(i - 1) == ".":
                continue
            if t.text == "func":
                yield from self.function(i)
            elif t.text == "type":
                yield from self.types(i)
            elif t.text == "import":
                j = i + 1
                stop = self.partner.get(j, j) if self.at(j) == "(" else min(j + 2, len(ts))
                done = False
                for k in range(j, min(stop + 1, len(ts))):
                    if ts[k].kind == "string" and ts[k].text[0] == '"' and not done:
                        yield Found("import", ts[k].text[1:-1], "import", ts[k].start, ts[k].end, ts[k].end)
                        done = self.at(j) != "("
        yield from self.calls(_GO_WORDS)

    def function(self, i: int) -> Iterator[Found]:
        ts, j, kind = self.ts, i + 1, "function"
        if self.at(j) == "(" and j in self.partner:
            j, kind = self.partner[j] + 1, "method"
        name, p = j, j + 1
        if self.at(p) == "[":
            p = self.partner.get(p, p) + 1
        if name >= len(ts) or ts[name].kind != "name" or self.at(p) != "(" or p not in self.partner:
            return
        b = self.partner[p] + 1
        while b < len(ts) and not (self.at(b) == "{" and self.at(b - 1) not in ("interface", "struct")) and not (ts[b].after_line and self.at(b - 1) != ","):
            b = self.partner.get(b, b) + 1 if self.at(b) in _OPENS else b + 1
        if self.at(b) == "{" and b in self.partner:
            yield self.symbol(name, kind, i, self.partner[b], b)
        else:
            yield self.symbol(name, kind, i, b - 1, None)

    def types(self, i: int) -> Iterator[Found]:
        ts = self.ts
        if self.at(i + 1) == "(" and i + 1 in self.partner:
            specs = [k for k in range(i + 2, self.partner[i + 1]) if ts[k].kind == "name" and self.around[k] == i + 1 and (ts[k].after_line or self.at(k - 1) in ("(", ";"))]
            last = self.partner[i + 1]
        else:
            specs, last = [i + 1], i + 1
            k = i + 2
            while k < len(ts) and not (ts[k].after_line or self.at(k) == ";"):
                last = self.partner.get(k, k) if self.at(k) in _OPENS else k
                k = last + 1
        for name in specs:
            if name < len(ts) and ts[name].kind == "name" and self.at(name + 1) != "=" and name < last:
                yield self.symbol(name, "type", i, last, None)


def facts(text: str, lang: str) -> Iterator[tuple]:
    """Facts of a file of a language that isn't Python: (fact, name, qualified name, kind, first and last line, first and last byte,
    language, signature)."""
    blocks = [(m.start("body"), m["body"], "typescript" if "ts" in m["attrs"] else "javascript") for m in SCRIPT_BLOCK.finditer(text)] if lang == "vue" else [(0, text, lang)]
    ends = [i for i, c in enumerate(text) if c == "\n"]
    place = range(len(text) + 1) if text.isascii() else [0, *accumulate(len(c.encode("utf-8", "replace")) for c in text)]
    line = lambda i: bisect_right(ends, i - 1) + 1
    for start, body, kind in blocks:
        reader = _Go(body, True) if kind == "go" else _Script(body, kind in ("typescript", "tsx"))
        found = sorted(dict.fromkeys(reader.found()), key=lambda f: (f.start, -f.end, f.fact))
        above: list[tuple[int, str]] = []
        for f in found:
            a, b = f.start + start, f.end + start
            name = None
            if f.fact == "symbol":
                while above and above[-1][0] <= f.start:
                    above.pop()
                name = f"{above[-1][1]}.{f.name}" if above else f.name
                above.append((f.end, name))
            signature = " ".join(body[f.start : f.head].split()) if name else None
            yield (f.fact, f.name, name, f.kind, line(a), line(b), place[a], place[b], kind, signature)
