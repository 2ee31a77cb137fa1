"""A tolerant C and C++ reader: functions of a file, and what their bodies hold.

A lexer drops comments and preprocessor lines; a brace-level scan finds function
definitions (also in namespaces, linkage blocks and classes); a statement reader walks
a body for calls with their guarding conditions, identifiers and the rows worth keeping.

In C, words that only C++ reserves are names like any other. Where the brackets of a text
don't match with all branches of its conditional groups, only each group's first is read.

Known limits against a full grammar: no macro expansion, calls through templates, members
and qualified names aren't calls by a plain name, and ambiguous declarations are settled
by their first tokens.
"""

from __future__ import annotations

import re
from collections.abc import Generator
from dataclasses import dataclass, field

# File suffixes that are read as C++.
CPP_SUFFIXES = (".cpp", ".cc", ".cxx", ".hpp", ".hh", ".hxx")
C_SUFFIXES = (".c", ".h", *CPP_SUFFIXES)

_LEX = re.compile(
    r"""(?P<skip>\s+|/\*.*?(?:\*/|\Z)|//(?:[^\n\\]|\\.|\\\n)*)
    |(?P<pre>(?<![^\n])[ \t]*\#(?:[^\n\\]|\\\r?\n|\\.)*)
    |(?P<str>(?:u8|[uUL])?"(?:[^"\\\n]|\\.)*"?|(?:u8|[uUL])?'(?:[^'\\\n]|\\.)*'?)
    |(?P<id>[A-Za-z_$]\w*)
    |(?P<num>\.?\d(?:[eEpP][+-]|[\w.'])*)
    |(?P<op>->\*?|::|<<=|>>=|\.\.\.|[-+*/%&|^!=<>]=|&&|\|\||\+\+|--|<<|>>|.)""",
    re.S | re.X,
)
KEYWORDS = frozenset(
    "alignas alignof asm auto break case catch class const const_cast constexpr continue decltype default delete do dynamic_cast else"
    " enum explicit export extern false final for friend goto if inline mutable namespace new noexcept nullptr operator override private"
    " protected public register reinterpret_cast restrict return signed sizeof static static_assert static_cast struct switch template"
    " this throw true try typedef typeid typename union unsigned using virtual volatile while NULL".split()
)
#: Words that C++ reserves and C doesn't.
CPP_ONLY = frozenset(
    "catch class const_cast constexpr decltype delete dynamic_cast explicit export final friend mutable namespace new noexcept operator override"
    " private protected public reinterpret_cast static_cast template this throw try typeid typename using virtual".split()
)
C_KEYWORDS = KEYWORDS - CPP_ONLY
#: Those that never stand where a value does in C++, and what follows a value.
_NO_VALUE = frozenset("class delete explicit export friend namespace new private protected public template try typename using virtual".split())
_AFTER_VALUE = frozenset("= , ; ) ] . -> [ ++ -- + - == != < > += -= && || ?".split())
PRIMITIVES = frozenset(
    "bool char char8_t char16_t char32_t char64_t charptr_t double float int int8_t int16_t int32_t int64_t intptr_t long max_align_t"
    " nullptr_t ptrdiff_t short size_t ssize_t uint8_t uint16_t uint32_t uint64_t uintptr_t void".split()
)
_TYPE_WORDS = PRIMITIVES | frozenset("auto class const constexpr enum extern register signed static struct typedef typename union unsigned volatile".split())
_OPEN = {"(": ")", "[": "]", "{": "}"}


@dataclass
class Token:
    kind: str
    text: str
    start: int
    end: int
    row: int


@dataclass
class Call:
    name: str
    conditions: list[str]
    args: str = ""


@dataclass
class Walk:
    calls: list[Call] = field(default_factory=list)
    identifiers: set[str] = field(default_factory=set)
    keep_lines: set[int] = field(default_factory=set)


@dataclass
class Function:
    name: str
    line: int  # of the name, from 1
    start: int
    end: int
    walk: Walk


def lex(code: str) -> Tokens:
    """The tokens of a text, of all branches of its conditional groups if those go together."""
    every = _lex(code, True)
    return every if "#" not in code or _balanced(every) else _lex(code, False)


_DIRECTIVE = re.compile(r"\s*#\s*(if|ifdef|ifndef|elif|elifdef|elifndef|else|endif)\b")


def _lex(code: str, every_branch: bool) -> Tokens:
    out, row, at = Tokens(), 0, 0
    later: list[bool] = []  # of each open group, whether its first branch is over
    for m in _LEX.finditer(code):
        row += code.count("\n", at, m.start())
        at = m.start()
        if m.lastgroup == "pre":
            word = _DIRECTIVE.match(m.group())
            if word and word[1] in ("if", "ifdef", "ifndef"):
                later.append(False)
            elif word and later and word[1] == "endif":
                later.pop()
            elif word and later:
                later[-1] = True
        elif m.lastgroup != "skip" and (every_branch or True not in later):
            out.append(Token(m.lastgroup, m.group(), m.start(), m.end(), row))
    return out


def _balanced(tokens: list[Token]) -> bool:
    stack = []
    for t in tokens:
        if t.kind == "op" and t.text in _OPEN:
            stack.append(_OPEN[t.text])
        elif t.kind == "op" and t.text in ")]}" and (not stack or stack.pop() != t.text):
            return False
    return not stack


def _fits(tokens: list[Token], cpp: bool) -> bool:
    """Whether nothing in the tokens speaks against the language."""
    for before, t, after in zip([None, *tokens], tokens, [*tokens[1:], None]):
        if not cpp and t.kind == "op" and t.text == "::":
            return False
        if t.kind == "id" and t.text in CPP_ONLY and after is not None:
            if not cpp and (after.kind in ("id", "num") or after.text in ("{", ":")):
                return False
            if cpp and t.text in _NO_VALUE and after.kind == "op" and after.text in _AFTER_VALUE:
                special = (t.text == "template" and after.text == "<") or (t.text == "delete" and (after.text == "[" or (before is not None and before.text == "=")))
                if not special:
                    return False
    return _balanced(tokens)


class Tokens(list[Token]):
    """The tokens of a text, with the place of each bracket's partner once one is asked for."""

    ends: dict[int, int] | None = None


def _match(tokens: Tokens, i: int) -> int:
    """The index of the bracket that closes the one at i, or the last token."""
    if tokens.ends is None:
        tokens.ends, stack = {}, []
        for j, t in enumerate(tokens):
            if t.kind != "op":
                continue
            if t.text in _OPEN:
                stack.append((_OPEN[t.text], j))
            elif t.text in ")]}":
                while t.text == "}" and stack and stack[-1][0] != "}":
                    tokens.ends[stack.pop()[1]] = j  # a brace ends what is open inside it
                if stack and stack[-1][0] == t.text:
                    tokens.ends[stack.pop()[1]] = j
    return tokens.ends.get(i, len(tokens) - 1)


#: A reader that hands on the readers of what stands inside it and returns an index.
Steps = Generator["Steps", int | None, int | None]


def _keywords(cpp: bool) -> frozenset[str]:
    return KEYWORDS if cpp else C_KEYWORDS


class _Body:
    def __init__(self, code: str, tokens: list[Token], base: int, cpp: bool):
        self.code, self.t, self.base, self.out = code, tokens, base, Walk()
        self.cpp, self.keywords = cpp, _keywords(cpp)

    def text(self, a: int, b: int) -> str:
        return self.code[self.t[a].start : self.t[b - 1].end] if b > a else ""

    def keep(self, i: int) -> None:
        self.out.keep_lines.add(self.t[i].row - self.base)

    def op(self, i: int, text: str) -> bool:
        return i < len(self.t) and self.t[i].kind == "op" and self.t[i].text == text

    def condition(self, a: int, b: int) -> str:
        text = " ".join(self.text(a, b).split())
        if text.startswith("(") and text.endswith(")"):
            text = text[1:-1].strip()
        return text

    def expression(self, a: int, b: int, conds: list[str]) -> None:
        """Calls and identifiers between two tokens, in the order they are written."""
        for i in range(a, b):
            t = self.t[i]
            if t.kind == "op" and t.text == "(" and i > a and self.t[i - 1].kind == "op" and self.t[i - 1].text in (")", "]"):
                before = self._open(i - 1, a)
                if before is not None and (self.t[i - 1].text == "]" or self._value_before(before, a)):
                    self.keep(before)
            if t.kind != "id":
                continue
            if t.text not in self.keywords and t.text not in PRIMITIVES:
                self.out.identifiers.add(t.text)
                if self.op(i + 1, "(") and i + 1 < b:
                    member = i > a and self.t[i - 1].kind == "op" and self.t[i - 1].text in ("->", ".", "::")
                    created = self.cpp and i > a and self.t[i - 1].text == "new"
                    if not created:
                        self.keep(i)
                    if not member and not created:
                        self.out.calls.append(Call(t.text, list(conds)))

    def _open(self, close: int, low: int) -> int | None:
        depth = 0
        for i in range(close, low - 1, -1):
            if self.t[i].kind == "op":
                depth += (self.t[i].text in ")]") - (self.t[i].text in "([")
                if depth == 0:
                    return i
        return None

    def _value_before(self, i: int, low: int) -> bool:
        """Whether a parenthesis at i is (*f), a callee, and not a cast or a condition."""
        return self.op(i + 1, "*") and not (i > low and self.t[i - 1].kind == "id")

    def semicolon(self, i: int, end: int) -> int:
        while i < end:
            if self.t[i].kind == "op":
                if self.t[i].text == ";":
                    return i
                if self.t[i].text in _OPEN:
                    i = min(_match(self.t, i), end)
                elif self.t[i].text == "}":
                    return i
            i += 1
        return end

    def block(self, a: int, b: int, conds: list[str]) -> None:
        """Read the statements from a to b. Nested ones wait on a list, not on Python's stack."""
        open_, value = [self._block(a, b, conds)], None
        while open_:
            try:
                inner = open_[-1].send(value)
            except StopIteration as done:
                open_.pop()
                value = done.value
            else:
                open_.append(inner)
                value = None

    def _block(self, a: int, b: int, conds: list[str]) -> Steps:
        i = a
        while i < b:
            i = max((yield self._statement(i, b, conds)), i + 1)

    def _statement(self, i: int, end: int, conds: list[str]) -> Steps:
        """Read one statement; the index after it."""
        if i >= end:
            return end
        t = self.t[i]
        if self.op(i, "{"):
            close = min(_match(self.t, i), end)
            yield self._block(i + 1, close, conds)
            return close + 1
        if self.op(i, ";") or self.op(i, "}"):
            return i + 1
        if t.kind == "id":
            if t.text in ("if", "while", "switch", "for"):
                at = i + 1
                while at < end and not self.op(at, "("):
                    if self.t[at].text not in ("constexpr", "consteval"):
                        break
                    at += 1
                if self.op(at, "("):
                    return (yield self._control(i, at, end, conds))
            if t.text == "do":
                return (yield self._do(i, end, conds))
            if t.text == "else":  # without its if
                return (yield self._statement(i + 1, end, conds))
            if t.text in ("return", "goto"):
                self.keep(i)
                stop = self.semicolon(i, end)
                if t.text == "return":
                    self.expression(i + 1, stop, conds)
                return stop + 1
            if t.text in ("case", "default"):
                self.keep(i)
                at = i + 1
                while at < end and not self.op(at, ":"):
                    at += 1
                self.expression(i + 1, at, conds)
                return at + 1
            if self.cpp and t.text == "try":
                return (yield self._statement(i + 1, end, conds))
            if self.cpp and t.text == "catch" and self.op(i + 1, "("):
                close = _match(self.t, i + 1)
                self.expression(i + 2, close, conds)
                return (yield self._statement(close + 1, end, conds))
            if self.op(i + 1, ":") and t.text not in self.keywords:
                self.keep(i)
                return i + 2
        stop = self.semicolon(i, end)
        if self.declaration(i, stop):
            self.keep(i)
            self._declared(i, stop, conds)
        else:
            self.expression(i, stop, conds)
        return stop + 1

    def _control(self, i: int, at: int, end: int, conds: list[str]) -> Steps:
        word = self.t[i].text
        self.keep(i)
        close = min(_match(self.t, at), end)
        if word == "for":
            first = self.semicolon(at + 1, close)
            second = self.semicolon(first + 1, close)
            cond = self.condition(first + 1, second) if first < close else ""
            if self.declaration(at + 1, first):
                self.keep(at + 1)
                self._declared(at + 1, first, conds)
            else:
                self.expression(at + 1, first, conds)
            self.expression(first, close, conds)
        else:
            cond = self.condition(at, close + 1)
            self.expression(at + 1, close, conds)
        inner = [*conds, cond] if cond else conds
        after = yield self._statement(close + 1, end, inner)
        if word == "if" and after < end and self.t[after].text == "else":
            after = yield self._statement(after + 1, end, [*conds, f"!({cond})"] if cond else conds)
        return after

    def _do(self, i: int, end: int, conds: list[str]) -> Steps:
        self.keep(i)
        # The condition comes after the body: find it first, then read the body.
        stop = min(_match(self.t, i + 1), end) + 1 if self.op(i + 1, "{") else self.semicolon(i + 1, end) + 1
        cond, close = "", stop
        if stop < end and self.t[stop].text == "while" and self.op(stop + 1, "("):
            close = _match(self.t, stop + 1)
            cond = self.condition(stop + 1, close + 1)
        yield self._statement(i + 1, stop, [*conds, cond] if cond else conds)
        if close > stop:
            self.expression(stop + 2, close, conds)
            return self.semicolon(close, end) + 1
        return stop

    def declaration(self, a: int, b: int) -> bool:
        """Whether a statement declares: it starts with a type and goes on with a name."""
        if a >= b or self.t[a].kind != "id":
            return False
        first = self.t[a].text
        if first in _TYPE_WORDS and (self.cpp or first not in CPP_ONLY):
            return True
        if first in self.keywords:
            return False
        i = a + 1
        while i + 1 < b and self.op(i, "::") and self.t[i + 1].kind == "id":
            i += 2
        if self.op(i, "<"):  # a template argument list, if it closes before a name
            depth, j = 0, i
            while j < b and j < i + 64:
                depth += self.t[j].text.count("<") - self.t[j].text.count(">") if self.t[j].kind == "op" and self.t[j].text in ("<", ">", ">>") else 0
                j += 1
                if depth == 0:
                    break
            i = j
        stars = i
        while i < b and (self.t[i].text in ("*", "&", "&&", "const")):
            i += 1
        if i >= b or self.t[i].kind != "id" or self.t[i].text in self.keywords:
            return False
        if i > stars and self.t[stars].text in ("&", "&&", "*") and not (i + 1 >= b or self.t[i + 1].text in ("=", ",", ";", "[")):
            return False
        return i + 1 >= b or self.t[i + 1].text in ("=", ",", ";", "[", "(", "{", ":")

    def _declared(self, a: int, b: int, conds: list[str]) -> None:
        """A declaration: a name with parentheses right after the type isn't a call."""
        at = a
        while at < b and not (self.t[at].kind == "op" and self.t[at].text in ("=", "(", "{", "[", ",")):
            at += 1
        if at < b and self.op(at, "(") and at > a and self.t[at - 1].kind == "id":
            self.expression(a, at, conds)
            self.expression(at, b, conds)
        else:
            self.expression(a, b, conds)


def _definition(tokens: list[Token], start: int, brace: int, cpp: bool = True) -> int | None:
    """The index of the name if tokens [start, brace) head a function definition."""
    i, name = start, None
    while i < brace:
        t = tokens[i]
        if t.kind == "op":
            if t.text in ("=", ";"):
                return None
            if t.text == "(":
                close = _match(tokens, i)
                if close >= brace:
                    return None
                if name is None and i > start and tokens[i - 1].kind == "id" and tokens[i - 1].text not in _keywords(cpp):
                    if tokens[i - 1].text not in ("__attribute__", "__declspec"):
                        name = i - 1
                i = close
            elif t.text == ":" and name is not None:
                return name  # a constructor's initialisers
            elif t.text == "[":
                i = _match(tokens, i)
        elif t.kind == "id" and t.text in ("struct", "class", "union", "enum", "namespace") and name is None and not any(x.text == "(" for x in tokens[i:brace]):
            return None
        i += 1
    return name


def _old_head(tokens: Tokens, start: int, semicolon: int) -> tuple[int, frozenset[str]] | None:
    """The name's index and the parameters if a statement is an old head and a declaration.

    That is ``int f(a, b) int a;``: names alone in parentheses, and then no end.
    """
    i = start
    while i < semicolon and tokens[i].text != "(":
        if tokens[i].kind != "id" and tokens[i].text != "*":
            return None
        i += 1
    if i == start or i >= semicolon or tokens[i - 1].kind != "id":
        return None
    close = _match(tokens, i)
    inner = tokens[i + 1 : close]
    names = frozenset(t.text for t in inner[::2] if t.kind == "id" and t.text not in C_KEYWORDS and t.text not in PRIMITIVES)
    if not inner or len(inner[::2]) != len(inner[1::2]) + 1 or len(names) != len(inner[::2]) or any(t.text != "," for t in inner[1::2]):
        return None
    return (i - 1, names) if _declares(tokens, close + 1, semicolon, names) else None


def _declares(tokens: Tokens, a: int, b: int, names: frozenset[str]) -> bool:
    """Whether tokens [a, b) are a type and at least one of the names."""
    return b - a > 1 and tokens[a].kind == "id" and any(t.text in names for t in tokens[a + 1 : b])


def functions(code: str, cpp: bool = True, tokens: Tokens | None = None) -> list[Function]:
    """All function definitions of a file, in the order they are written."""
    tokens = lex(code) if tokens is None else tokens
    out: list[Function] = []
    old: tuple[int, int, frozenset[str]] | None = None  # first token, name and parameters of an old head
    i = start = 0
    while i < len(tokens):
        t = tokens[i]
        if t.kind == "op" and t.text == ";":
            if old is None:
                head = _old_head(tokens, start, i)
                old = (start, *head) if head else None
            elif not _declares(tokens, start, i, old[2]):
                old = None
            start = i + 1
        elif t.kind == "op" and t.text == "}":
            old, start = None, i + 1
        elif t.kind == "op" and t.text == "(":
            i = _match(tokens, i)
        elif t.kind == "op" and t.text == ":" and i > start and tokens[i - 1].text in ("public", "private", "protected"):
            old, start = None, i + 1
        elif t.kind == "op" and t.text == "{":
            close = _match(tokens, i)
            first, name = (old[0], old[1]) if old is not None and start == i else (start, _definition(tokens, start, i, cpp))
            if name is not None:
                out.append(_function(code, tokens, first, name, i, close, cpp))
                i, start = close, close + 1
            elif _enters(tokens, start, i):
                start = i + 1
            else:
                i = close
            old = None
        i += 1
    return out


def _enters(tokens: list[Token], start: int, brace: int) -> bool:
    """Whether a brace opens a scope that may hold definitions."""
    words = {t.text for t in tokens[start:brace] if t.kind == "id"}
    if "=" in {t.text for t in tokens[start:brace]} or "enum" in words:
        return False
    return brace == start or bool(words & {"namespace", "extern", "class", "struct", "union"})


def _function(code: str, tokens: list[Token], start: int, name: int, brace: int, close: int, cpp: bool) -> Function:
    base = tokens[start].row
    body = _Body(code, tokens, base, cpp)
    for t in tokens[start:brace]:
        if t.kind == "id" and t.text not in body.keywords and t.text not in PRIMITIVES:
            body.out.identifiers.add(t.text)
    body.block(brace + 1, close, [])
    return Function(tokens[name].text, tokens[name].row + 1, tokens[start].start, tokens[close].end, body.out)


def parse_detached(source: str, file_name: str = "") -> Walk:
    """The first function of a text on its own; an empty walk if there is none.

    It is read as C and as C++, the file's language first. The first reading that the text
    has nothing against is taken, else the first that finds a function.
    """
    tokens = lex(source)
    cpp_first = file_name.endswith(CPP_SUFFIXES)
    readings = [(functions(source, cpp, tokens), cpp) for cpp in (cpp_first, not cpp_first)]
    found = [(not _fits(tokens, cpp), place, read) for place, (read, cpp) in enumerate(readings) if read]
    return min(found, key=lambda x: x[:2])[2][0].walk if found else Walk()
