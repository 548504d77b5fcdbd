"""Definitions, references and aliases of one source file: Python by its own grammar, JavaScript and TypeScript by a parser of our own.

A tag is (name, kind, start_line, end_line, start_byte, end_byte, capture_kind); lines from 0, ends exclusive in bytes.
Files that do not parse give no tags.
"""

from __future__ import annotations

import ast
from collections.abc import Callable
from dataclasses import dataclass

from graphloom.sources import manifest
from graphloom.sources.manifest import Language
from graphloom.sources.script import Script, Tag, may_alias


@dataclass(frozen=True)
class Parser:
    """What a language needs: tags and aliases of a text, each a function of (text, language)."""

    tags: Callable[[str, Language], list[Tag]]
    aliases: Callable[[str, Language], list[tuple[str, str]]] = lambda text, language: []


def language_of(path: str, languages: list[Language] | None = None) -> Language | None:
    return next((x for x in languages or manifest.LANGUAGES if path.endswith(x.extensions)), None)


def python_tags(text: str) -> list[Tag]:
    try:
        root = ast.parse(text)
    except (SyntaxError, ValueError):
        return []
    starts = [0]
    for line in text.encode().splitlines(keepends=True):
        starts.append(starts[-1] + len(line))
    out = []

    def tag(node: ast.AST, name: str, kind: str, capture: str) -> None:
        out.append(Tag(name, kind, node.lineno - 1, node.end_lineno - 1, starts[node.lineno - 1] + node.col_offset, starts[node.end_lineno - 1] + node.end_col_offset, capture))

    def visit(node: ast.AST) -> None:
        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
            tag(node, node.name, "def", "function")
        elif isinstance(node, ast.Call) and isinstance(node.func, ast.Name | ast.Attribute):
            tag(node, node.func.id if isinstance(node.func, ast.Name) else node.func.attr, "ref", "call")
        for child in ast.iter_child_nodes(node):
            visit(child)

    visit(root)
    return out


class _Unread:
    tags: list[Tag] = []
    aliases: list[tuple[str, str]] = []


def script(text: str, language: Language) -> Script | _Unread:
    """The parsed file; nothing of one that is nested too deeply to be read."""
    try:
        return Script(text, language)
    except RecursionError:
        return _Unread()


#: Parsers by the name that a Language gives; register() adds to them.
PARSERS: dict[str, Parser] = {
    "python": Parser(lambda text, language: python_tags(text)),
    "js": Parser(lambda text, language: script(text, language).tags, lambda text, language: script(text, language).aliases if may_alias(text) else []),
}


def register(language: Language, parser: Parser | None = None) -> None:
    """Support a language: its files are discovered, parsed and excluded as the manifest's own. parser: by the name language.parser, unless there is one already.

    A language of a known name replaces the one before. Call it in the driver; each
    job takes the registry along (see Registry).
    """
    if parser is not None:
        PARSERS[language.parser] = parser
    if language.parser not in PARSERS:
        raise ValueError(f"no parser named {language.parser}")
    manifest.LANGUAGES[:] = [x for x in manifest.LANGUAGES if x.name != language.name] + [language]


@dataclass(frozen=True)
class Registry:
    """The languages and parsers of the moment, as a job takes them along to its workers."""

    languages: list[Language]
    parsers: dict[str, Parser]

    @classmethod
    def now(cls) -> Registry:
        return cls(list(manifest.LANGUAGES), dict(PARSERS))

    def tags(self, path: str, text: str) -> list[Tag]:
        language = language_of(path, self.languages)
        return [] if language is None else self.parsers[language.parser].tags(text, language)

    def aliases(self, path: str, text: str) -> list[tuple[str, str]]:
        language = language_of(path, self.languages)
        return [] if language is None else list(dict.fromkeys(self.parsers[language.parser].aliases(text, language)))


def extract_tags(path: str, text: str) -> list[Tag]:
    return Registry.now().tags(path, text)


def extract_aliases(path: str, text: str) -> list[tuple[str, str]]:
    return Registry.now().aliases(path, text)
