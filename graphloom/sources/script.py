"""JavaScript, TypeScript and JSX: a lexer with its modes, and a parser that finds the shapes that define, call and alias functions.

The parser knows statements, classes, object literals, parameters and types as far as it must to tell a definition
from a look-alike: types and interfaces define nothing, a default value or a signature without a body is no
definition, and the end of an expression is where two operands meet.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass
from itertools import accumulate

from graphloom.sources.manifest import Language


@dataclass(frozen=True)
class Tag:
    name: str
    kind: str
    start_line: int
    end_line: int
    start_byte: int
    end_byte: int
    capture_kind: str


@dataclass(slots=True)
class Token:
    kind: str  # name, number, string, regex, template, jsx, mark; "end" beyond the last
    text: str
    at: int
    end: int


_TOKEN = re.compile(
    r"""(?P<space>\s+)|(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<string>"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*')|(?P<number>\d[\w.]*)|(?P<name>\#?[^\W\d][\w$]*|\#?\$[\w$]*)|(?P<mark>=>|\?\.(?!\d)|\.\.\.|[=!]==?|.)""",
    re.S | re.X,
)
_REGEX = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*")
_OPERATOR_WORDS = {"return", "typeof", "case", "in", "of", "do", "else", "await", "yield", "new", "delete", "void", "throw", "instanceof", "default", "extends"}
_ELEMENT = re.compile(r"<(?:>|[^\W\d][\w$.:-]*(?!\s*(?:,|extends\b)))")
_JSX_TEXT = re.compile(r"[^<{]+")
_JSX_NAME = re.compile(r"[^\W\d][\w$-]*(?:[.:][^\W\d][\w$-]*)*|\$[\w$]*")


def _operand_next(out: list[Token]) -> bool:
    """Whether the next token begins an operand, as far as the last one tells."""
    if not out:
        return True
    last = out[-1]
    if last.kind == "mark":
        return last.text not in (")", "]", ".", "?.")
    return last.kind == "name" and last.text in _OPERATOR_WORDS


class Lexer:
    def __init__(self, text: str, jsx: bool) -> None:
        self.text, self.size, self.jsx, self.out = text, len(text), jsx, []
        self.code(0, False)

    def put(self, kind: str, text: str, at: int, end: int) -> None:
        n = self.size
        self.out.append(Token(kind, text, at if at < n else n, end if end < n else n))

    def code(self, at: int, nested: bool) -> int:
        """Tokens from at on; nested: up to the brace that closes what stands before at, whose place is returned."""
        text, size, depth = self.text, self.size, 0
        while at < size:
            c = text[at]
            if c == "`":
                at = self.template(at)
                continue
            if c == "/" and text[at : at + 2] not in ("//", "/*") and _operand_next(self.out) and (m := _REGEX.match(text, at)):
                self.put("regex", m[0], at, m.end())
                at = m.end()
                continue
            if c == "<" and self.jsx and _operand_next(self.out) and _ELEMENT.match(text, at):
                at = self.element(at)
                continue
            m = _TOKEN.match(text, at)
            if c == "}" and nested:
                if not depth:
                    return at
                depth -= 1
            depth += c == "{"
            kind, end = m.lastgroup, m.end()
            if kind != "space" and kind != "comment":
                self.out.append(Token(kind, m[0], at, end))
            at = end
        return at

    def inner(self, at: int) -> int:
        """A braced expression, whose opening brace stands at `at`, between parentheses of its own; returns where it ends."""
        self.put("mark", "(", at, at + 1)
        end = self.code(at + 1, True)
        self.put("mark", ")", end, end + 1)
        return end + 1

    def template(self, at: int) -> int:
        text, end, holes = self.text, at + 1, []
        mark = len(self.out)
        self.put("template", "`", at, at + 1)
        while end < len(text) and text[end] != "`":
            if text[end] == "\\":
                end += 2
            elif text.startswith("${", end):
                end = self.inner(end + 1)
                holes.append(end)
            else:
                end += 1
        self.out[mark].end = min(end + 1, len(text))
        return end + 1

    def element(self, at: int) -> int:
        """A JSX element: one token for its opening tag, then the expressions in its attributes and children."""
        text = self.text
        m = _JSX_NAME.match(text, at + 1)
        mark = len(self.out)
        self.put("jsx", m[0] if m else "", at, at)
        at = m.end() if m else at + 1
        while at < len(text) and text[at] != ">" and not text.startswith("/>", at):
            if text[at] == "{":
                at = self.inner(at)
            elif text[at] in "\"'":
                at = text.find(text[at], at + 1) + 1 or len(text)
            elif text[at] == "<" and self.out[mark].text:  # type arguments, or an element as a value
                at = self.element(at) if text[at - 1] == "=" else text.find(">", at) + 1 or len(text)
            else:
                at += 1
        closed = text.startswith("/>", at)
        at += 2 if closed else 1
        self.out[mark].end = min(at, len(text))
        while not closed and at < len(text):
            if text.startswith("</", at):
                at = text.find(">", at) + 1 or len(text)
                closed = True
            elif text[at] == "<":
                at = self.element(at)
            elif text[at] == "{":
                at = self.inner(at)
            else:
                at = _JSX_TEXT.match(text, at).end()
        self.put("mark", "(", at, at)  # an element is an operand: what follows it is an operator
        self.put("mark", ")", at, at)
        return at


_MODIFIERS = {"public", "private", "protected", "static", "readonly", "abstract", "override", "declare", "async", "get", "set", "accessor"}
_TYPE_WORDS = {"keyof", "typeof", "readonly", "infer", "unique", "asserts", "new", "abstract"}
_NOT_CALLED = {"super", "import", "if", "for", "while", "switch", "catch", "typeof", "void", "await", "yield", "return", "in", "of", "instanceof", "delete", "function", "new", "this", "throw", "case", "else", "do", "with"}
_BINARY_WORDS = {"in", "of", "instanceof", "as", "satisfies"}
_UNARY_WORDS = {"typeof", "void", "await", "yield", "delete", "return", "throw", "case", "else", "do"}
_NOT_IDENTIFIERS = {"this", "null", "true", "false", "undefined", "super"}
_END = Token("end", "", 0, 0)


#: What every alias is written with: a call of assign, or a member's name before a single "=", with spaces and comments between.
_ALIAS = re.compile(r"\bassign\b|\.(?>\s+|//[^\n]*+|/\*.*?\*/)*+\#?[\w$]++(?>\s+|//[^\n]*+|/\*.*?\*/)*+=(?![=>])", re.S)


def may_alias(text: str) -> bool:
    """Whether a text may hold an alias; one that may not need not be parsed to find that it has none."""
    return _ALIAS.search(text) is not None


class Script:
    """Tags and aliases of one file; positions in the token list are half-open ranges."""

    def __init__(self, text: str, language: Language) -> None:
        self.language, self.typed = language, language.typed
        self.toks = Lexer(text, language.jsx).out
        self.words = [t.text if t.kind == "mark" or t.kind == "name" else "" for t in self.toks]
        self.byte = range(len(text) + 1) if text.isascii() else [0, *accumulate(len(c.encode("utf-8", "surrogatepass")) for c in text)]
        self.lines = [m.start() for m in re.finditer("\n", text)]
        self.pair: dict[int, int] = {}
        stack: list[int] = []
        for i, t in enumerate(self.toks):
            if t.kind == "mark":
                if t.text in "([{":
                    stack.append(i)
                elif t.text in ")]}" and stack:
                    self.pair[stack.pop()] = i
        self.tags: list[Tag] = []
        self.aliases: list[tuple[str, str]] = []
        self.depth = 0  # of functions around
        self.block(0, len(self.toks))
        self.tags.sort(key=lambda t: (t.start_byte, -t.end_byte, t.kind != "def"))

    # -- plumbing

    def tok(self, i: int) -> Token:
        return self.toks[i] if 0 <= i < len(self.toks) else _END

    def text(self, i: int) -> str:
        """The token's text, empty for literals, so that no string passes for a mark or a word."""
        return self.words[i] if 0 <= i < len(self.words) else ""

    def is_name(self, i: int) -> bool:
        return self.tok(i).kind == "name"

    def close(self, i: int) -> int:
        """Where the bracket at i closes; the last token if it never does."""
        return self.pair.get(i, len(self.toks) - 1)

    def newline(self, i: int) -> bool:
        """Whether a line ends between the token at i and the one before."""
        return i > 0 and bisect_right(self.lines, self.tok(i).at) > bisect_right(self.lines, self.tok(i - 1).end - 1)

    def tag(self, name: str, kind: str, first: int, last: int, capture: str) -> None:
        excluded = self.language.excluded_defs if kind == "def" else self.language.excluded_refs
        if name in excluded or name.startswith("#"):
            return
        a, b = self.tok(first).at, self.tok(last).end
        self.tags.append(Tag(name, kind, bisect_right(self.lines, a - 1), bisect_right(self.lines, b - 1), self.byte[a], self.byte[b], capture))

    def define(self, name: str, first: int, end: int) -> None:
        self.tag(name, "def", first, end - 1, "function")

    # -- types

    def angles(self, i: int) -> int | None:
        """After the type parameters or arguments that begin at i; None if they are none."""
        depth = 0
        while i < len(self.toks):
            t = self.tok(i)
            if t.kind == "mark":
                if t.text == "<":
                    depth += 1
                elif t.text == ">":
                    depth -= 1
                    if not depth:
                        return i + 1
                elif t.text in "([{":
                    i = self.close(i)
                elif t.text in "&|" and self.text(i + 1) == t.text:
                    return None  # a logical operator
                elif t.text not in ("=>", ",", "|", "&", ".", "?", ":", "=", "...", "-", "`"):
                    return None
            elif t.kind in ("regex", "jsx"):
                return None
            i += 1
        return None

    def type(self, i: int) -> int:
        """After the type that begins at i."""
        while True:
            while self.text(i) in ("|", "&", "-", "...") or self.text(i) in _TYPE_WORDS and (self.is_name(i + 1) or self.text(i + 1) in ("(", "[", "{", "<")):
                i += 1
            t = self.tok(i)
            if self.text(i) in ("(", "[", "{"):
                i = self.close(i) + 1
                if self.text(i - 1) == ")" and self.text(i) == "=>":
                    i += 1
                    continue
            elif self.text(i) == "<":
                i = self.angles(i) or i + 1
                continue
            elif t.kind in ("name", "string", "number", "template"):
                i += 1
                if t.kind == "template":
                    while self.text(i) == "(" and self.tok(i).at < t.end:
                        i = self.close(i) + 1
                if t.text == "import" and self.text(i) == "(":
                    i = self.close(i) + 1
                while self.text(i) == ".":
                    i += 2
                if self.text(i) == "<":
                    i = self.angles(i) or i + 1
            else:
                return i
            while self.text(i) == "[" and not self.newline(i):
                i = self.close(i) + 1
            if self.text(i) in ("|", "&"):
                i += 1
                continue
            if self.text(i) == "is":
                i += 1
                continue
            if self.text(i) == "extends" and not self.newline(i):
                i = self.type(i + 1)
                if self.text(i) == "?":
                    i = self.type(i + 1)
                    if self.text(i) == ":":
                        i += 1
                        continue
            return i

    def annotation(self, i: int) -> int:
        """After a type annotation, if one begins at i."""
        if self.text(i) in ("?", "!") and self.text(i + 1) in (":", "=", ",", ")", ";", "}", "("):
            i += 1
        return self.type(i + 1) if self.text(i) == ":" else i

    def generics(self, i: int) -> int:
        return (self.angles(i) or i) if self.typed and self.text(i) == "<" else i

    # -- statements

    def block(self, i: int, end: int) -> None:
        while i < end:
            i = max(self.statement(i, end), i + 1)

    def statement(self, i: int, end: int) -> int:
        t, after = self.text(i), self.text(i + 1)
        if t == "{":
            self.block(i + 1, self.close(i))
            return self.close(i) + 1
        if t in ("", ";", ",", ":") and self.tok(i).kind == "mark":
            return i + 1
        if t == "@":
            return self.decorator(i)
        if t == "export":
            if after in ("{", "*"):
                return self.module_string(i + 1, end)
            if after == "default" and self.text(i + 2) not in ("function", "class", "async", "abstract", "interface"):
                return self.expr(i + 2, end)
            return i + 2 if after in ("default", "=") else i + 1
        if t == "import" and after not in ("(", "."):
            return self.module_string(i, end)
        if self.typed:
            if t in ("declare", "abstract") and self.is_name(i + 1):
                return i + 1
            if t == "interface" and self.is_name(i + 1):
                return self.body(i + 2) + 1
            if t == "type" and self.is_name(i + 1) and self.text(i + 2) in ("=", "<"):
                return self.type(self.generics(i + 2) + 1)
            if t in ("namespace", "module", "global") and (self.tok(i + 1).kind in ("name", "string") or after == "{"):
                open_ = next((k for k in range(i + 1, min(end, i + 40)) if self.text(k) == "{"), i)
                self.block(open_ + 1, self.close(open_)) if open_ > i else None
                return self.close(open_) + 1 if open_ > i else i + 1
            if t == "enum" and self.is_name(i + 1):
                self.pattern(i + 3, self.close(i + 2))
                return self.close(i + 2) + 1
            if t == "const" and after == "enum":
                return i + 1
        if t == "function" or t == "async" and after == "function":
            return self.function(i, True)
        if t == "class":
            return self.klass(i)
        if t in ("const", "let", "var", "using") and (self.is_name(i + 1) or after in ("{", "[")):
            return self.declarators(i + 1, end)
        if t in ("if", "while", "for", "switch", "with", "catch"):
            open_ = i + 2 if after == "await" else i + 1
            if self.text(open_) != "(":
                return i + 1
            k, close = open_ + 1, self.close(open_)
            if t == "catch":
                self.params(k, close)
            else:
                if self.text(k) in ("const", "let", "var"):
                    k = self.declarators(k + 1, close)
                self.region(k, close)
            return close + 1
        if t in ("try", "finally", "else", "do"):
            return i + 1
        if t in ("case", "default") and after != ".":
            k = i + 1 if t == "default" else self.expr(i + 1, end)
            return k + 1 if self.text(k) == ":" else k
        if t in ("return", "throw"):
            return self.expr(i + 1, end) if not self.newline(i + 1) else i + 1
        if self.is_name(i) and after == ":":
            return i + 2
        return self.expr(i, end)

    def module_string(self, i: int, end: int) -> int:
        """After an import or a re-export: its bindings, and the module's name if one follows."""
        while i < end and self.text(i) != ";":
            if self.tok(i).kind == "string":
                return i + 1
            if self.text(i) == "{":
                i = self.close(i) + 1
                if self.text(i) != "from":
                    return i
                continue
            if self.text(i) == "=":
                return self.expr(i + 1, end)
            i += 1
        return i

    def body(self, i: int) -> int:
        """The closing brace of the body of an interface whose heading goes on at i."""
        while i < len(self.toks) and self.text(i) != "{":
            i = self.generics(i) if self.text(i) == "<" and self.angles(i) else i + 1
        return self.close(i)

    def decorator(self, i: int) -> int:
        """After the decorator at i: a name, or a call of one, which is a reference."""
        k = i + 1
        if self.text(k) == "(":
            self.region(k + 1, self.close(k))
            return self.close(k) + 1
        first = k
        while self.text(k + 1) == ".":
            k += 2
        opened = self.generics(k + 1)
        if self.text(opened) != "(":
            return k + 1
        self.tag(self.tok(k).text, "ref", opened if k > first else k, self.close(opened), "call")
        self.region(opened + 1, self.close(opened))
        return self.close(opened) + 1

    # -- bindings

    def declarators(self, i: int, end: int) -> int:
        while i < end:
            first, name = i, self.tok(i).text if self.is_name(i) else None
            if name is None:
                self.pattern(i + 1, self.close(i))
                i = self.close(i)
            i = self.annotation(i + 1)
            if self.text(i) == "=":
                value = i + 1
                i, direct = self.value(value, end)
                if name is not None and direct:
                    self.define(name, first, i)
                self.compound(name, value)
            if self.text(i) != ",":
                return i
            i += 1
        return i

    def compound(self, name: str | None, i: int) -> None:
        """name = Object.assign(Base, ...) outside of any function: name is an alias of Base."""
        words = [self.text(i + k) for k in range(4)]
        if name is not None and not self.depth and words == ["Object", ".", "assign", "("] and self.is_name(i + 4) and self.text(i + 5) in (",", ")") and self.tok(i + 4).text not in _NOT_IDENTIFIERS:
            self.aliases.append((name, self.tok(i + 4).text))

    def pattern(self, i: int, end: int) -> None:
        """A destructuring pattern: only default values and computed keys hold expressions."""
        while i < end:
            if self.text(i) == "=":
                i, _ = self.value(i + 1, end)
            elif self.text(i) in ("{", "["):
                self.pattern(i + 1, self.close(i))
                i = self.close(i) + 1
            else:
                i += 1

    def params(self, i: int, end: int) -> None:
        while i < end:
            if self.text(i) == "@":
                i = self.decorator(i)
            elif self.text(i) in ("{", "["):
                self.pattern(i + 1, self.close(i))
                i = self.annotation(self.close(i) + 1)
            elif self.is_name(i):
                i = self.annotation(i + 1)
            elif self.text(i) == "=":
                i, _ = self.value(i + 1, end)
            else:
                i += 1

    # -- functions

    def function(self, i: int, declared: bool) -> int:
        """After the function that begins at i; its own name is a definition unless it is a generator expression."""
        first = i
        i += 2 if self.text(i) == "async" else 1
        generator = self.text(i) == "*"
        i += generator
        name = None
        if self.is_name(i):
            name, i = self.tok(i).text, i + 1
        i, body = self.signature(i)
        if body and name is not None and (declared or not generator):
            self.define(name, first, i)
        return i

    def signature(self, i: int) -> tuple[int, bool]:
        """(after it, whether there is a body) of the type parameters, parameters, return type and body that begin at i."""
        i = self.generics(i)
        if self.text(i) != "(":
            return i, False
        close = self.close(i)
        self.depth += 1
        self.params(i + 1, close)
        i = self.annotation(close + 1)
        body = self.text(i) == "{"
        if body:
            self.block(i + 1, self.close(i))
            i = self.close(i) + 1
        self.depth -= 1
        return i, body

    def arrow(self, i: int, end: int) -> int | None:
        """After the arrow function that begins at i, or None."""
        k = i + 1 if self.text(i) == "async" and (self.is_name(i + 1) or self.text(i + 1) in ("(", "<")) and not self.newline(i + 1) else i
        k = self.generics(k)
        if self.text(k) == "(":
            opened, close = k + 1, self.close(k)
            sign = close + 1
            if self.typed and self.text(sign) == ":":
                sign = self.type(sign + 1)
        elif self.is_name(k):
            opened = close = sign = k + 1
        else:
            return None
        if self.text(sign) != "=>" or sign >= end:
            return None
        self.depth += 1
        self.params(opened, close)
        if self.text(sign + 1) == "{":
            self.block(sign + 2, self.close(sign + 1))
            out = self.close(sign + 1) + 1
        else:
            out = self.expr(sign + 1, end, True)
        self.depth -= 1
        return out

    def value(self, i: int, end: int) -> tuple[int, bool]:
        """(after it, whether it is an arrow function or a function expression itself) of the expression that begins at i."""
        if self.text(i) == "function" or self.text(i) == "async" and self.text(i + 1) == "function":
            generator = self.text(i + (2 if self.text(i) == "async" else 1)) == "*"
            k = self.function(i, False)
            out = self.expr(k, end, True, False)
            return out, out == k and not generator
        k = self.arrow(i, end)
        if k is not None:
            return k, True
        return self.expr(i, end, True), False

    # -- classes and objects

    def klass(self, i: int) -> int:
        i += 1
        while i < len(self.toks) and self.text(i) not in ("{", "implements"):
            if self.text(i) == "<" and self.typed and self.angles(i):
                i = self.angles(i)
            elif self.text(i) == "(":
                self.region(i + 1, self.close(i))
                i = self.close(i) + 1
            else:
                i = self.call(i, self.text(i - 1) in (".", "?."), i) if self.is_name(i) and self.text(i) != "extends" else i + 1
        while i < len(self.toks) and self.text(i) != "{":
            i = self.angles(i) or i + 1 if self.text(i) == "<" else i + 1
        end, depth = self.close(i), self.depth
        i += 1
        while i < end:
            i = max(self.member(i, end), i + 1)
        self.depth = depth
        return end + 1

    def modifiers(self, i: int) -> int:
        while self.text(i) == "*" or self.text(i) in _MODIFIERS and self.text(i + 1) not in ("(", "=", ";", ":", "?", "!", "<", "}", ","):
            i += 1
        return i

    def key(self, i: int) -> tuple[str | None, int]:
        """(its plain name or None, after it) of the member name at i."""
        if self.text(i) == "[":
            self.region(i + 1, self.close(i))
            return None, self.close(i) + 1
        name = self.tok(i).text if self.is_name(i) and not self.tok(i).text.startswith("#") else None
        return name, i + 1

    def member(self, i: int, end: int) -> int:
        outer = i
        while self.text(i) == "@":
            i = self.decorator(i)
        if self.text(i) in (";", ","):
            return i + 1
        if self.text(i) == "static" and self.text(i + 1) == "{":
            self.block(i + 2, self.close(i + 1))
            return self.close(i + 1) + 1
        first = i
        i = self.modifiers(i)
        name, i = self.key(i)
        if self.text(i) in ("?", "!") and self.text(i + 1) in ("(", "<"):
            i += 1
        if self.text(self.generics(i)) == "(":
            i, body = self.signature(i)
            if body and name is not None:
                self.define(name, first, i)
            return i
        i = self.annotation(i)
        if self.text(i) == "=":
            i, direct = self.value(i + 1, end)
            if direct and name is not None and self.typed:
                self.define(name, outer, i)
        return i

    def object(self, i: int) -> int:
        """After the object literal that begins at i."""
        end = self.close(i)
        i += 1
        while i < end:
            if self.text(i) in (",", "..."):
                i = self.expr(i + 1, end, True) if self.text(i) == "..." else i + 1
                continue
            first = i
            i = self.modifiers(i)
            name, i = self.key(i)
            if self.text(self.generics(i)) == "(":
                i, body = self.signature(i)
                if body and name is not None:
                    self.define(name, first, i)
            elif self.text(i) == ":":
                i, direct = self.value(i + 1, end)
                if direct and name is not None:
                    self.define(name, first, i)
            elif self.text(i) == "=":
                i, _ = self.value(i + 1, end)
            i = max(i, first + 1)
        return end + 1

    # -- expressions

    def region(self, i: int, end: int) -> None:
        """Expressions and commas up to end."""
        while i < end:
            i = max(self.expr(i, end), i + 1)

    def call(self, i: int, member: bool, first: int) -> int:
        """After the name at i, or where the arguments of the call that it makes begin: the call is a reference."""
        name, k = self.tok(i).text, i + 1
        if self.text(k) == "?." and (self.text(k + 1) == "(" or self.typed and self.text(k + 1) == "<"):
            k += 1
        typed = self.generics(k)
        if typed != k and (self.text(typed) == "(" or self.tok(typed).kind == "template"):
            k = typed
        if (self.text(k) == "(" or self.tok(k).kind == "template") and (member or name not in _NOT_CALLED):
            last = self.close(k) if self.text(k) == "(" else k
            self.tag(name, "ref", k if member else i, last, "call")  # of a member call, the arguments
            return k
        return i + 1

    def construct(self, i: int) -> int:
        """After `new`, what it makes and its arguments: no reference."""
        i += 1
        if not self.is_name(i) or self.text(i) in ("class", "function", "new"):
            return i
        while self.text(i + 1) == ".":
            i += 2
        k = self.generics(i + 1)
        if self.text(k) == "(":
            self.region(k + 1, self.close(k))
            return self.close(k) + 1
        return i + 1

    def expr(self, i: int, end: int, single: bool = False, operand: bool = True) -> int:
        """After the expression that begins at i; single: a comma ends it. operand: whether an operand comes next."""
        first, ternary = i, 0  # first: of the primary expression that is being read
        while i < end:
            t, kind = self.text(i), self.tok(i).kind
            if t in (";", ")", "]", "}") or t == "," and single:
                return i
            if operand and (kind != "mark" or t in ("(", "<")):
                first = i
                k = self.arrow(i, end) if kind == "name" or t in ("(", "<") else None
                if k is not None:
                    i, operand = k, False
                    continue
            if kind in ("number", "string", "regex", "template", "jsx"):
                if not operand and kind != "template":
                    return i
                if kind == "jsx":
                    self.jsx(i)
                i, operand = i + 1, False
            elif kind == "name":
                member = self.text(i - 1) in (".", "?.") and i > 0
                if not operand and not member:
                    if t in ("as", "satisfies") and self.typed and not self.newline(i):
                        i = self.type(i + 1)
                        continue
                    if t not in _BINARY_WORDS:
                        return i  # two operands meet: a new statement
                    i, operand = i + 1, True
                elif member:
                    i, operand = self.named(i, first, True, end), False
                elif t == "function" or t == "async" and self.text(i + 1) == "function":
                    i, operand = self.function(i, False), False
                elif t == "class":
                    i, operand = self.klass(i), False
                elif t == "new" and self.text(i + 1) != ".":
                    i, operand = self.construct(i), False
                    operand = self.text(i) in ("class", "function", "new") or self.text(i - 1) == "new"
                elif t in _UNARY_WORDS:
                    i += 1
                else:
                    i, operand = self.named(i, first, False, end), False
            elif t == "(":
                self.region(i + 1, self.close(i))
                i, operand = self.close(i) + 1, False
            elif t == "[":
                self.region(i + 1, self.close(i))
                i, operand = self.close(i) + 1, False
            elif t == "{":
                if not operand:
                    return i
                i, operand = self.object(i), False
            elif t == "@":
                return i if not operand else self.decorator(i)
            elif t == "<" and operand and self.typed and self.angles(i):
                i = self.angles(i)  # a type assertion
            elif t == "?" :
                ternary += 1
                i, operand = i + 1, True
            elif t == ":":
                if not ternary:
                    return i
                ternary -= 1
                i, operand = i + 1, True
            elif t in (".", "?."):
                i += 1
                operand = False
            elif t == "!" and not operand and not self.newline(i):
                i += 1  # a non-null assertion
            elif t in ("+", "-") and self.text(i + 1) == t and self.tok(i).end == self.tok(i + 1).at:
                i += 2  # an increment, before or after its operand
            else:
                i, operand = i + 1, True
        return i

    def named(self, i: int, first: int, member: bool, end: int) -> int:
        """After the name at i: a call, an assignment, or neither. first: where its primary expression begins."""
        name = self.tok(i).text
        if self.text(i + 1) == "=" and (member or name not in _NOT_IDENTIFIERS):
            value = i + 2
            k, direct = self.value(value, end)
            if direct:
                self.define(name, first, k)
            plain = member and not self.depth and not name.startswith("#") and self.is_name(value) and k == value + 1 and self.tok(value).text not in _NOT_IDENTIFIERS
            if plain:
                self.aliases.append((name, self.tok(value).text))
            return k
        return self.call(i, member, i)

    def jsx(self, i: int) -> None:
        """A component of an opening tag: capitalized, or the root of a dotted name; others are the page's own."""
        root, dot, _ = self.tok(i).text.partition(".")
        if ":" not in root and "-" not in root and (dot or root[:1].isupper()):
            self.tag(root, "ref", i, i, "jsx")
