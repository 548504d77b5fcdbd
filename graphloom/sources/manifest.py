"""Language manifest: extensions, excluded directories and names of each language."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Language:
    name: str
    extensions: tuple[str, ...]
    excluded_dirs: tuple[str, ...]
    excluded_defs: tuple[str, ...] = ()
    excluded_refs: tuple[str, ...] = ()
    jsx: bool = False
    typed: bool = False
    parser: str = field(default="js")


_BUILD = ("node_modules", "out", "dist", "build")
#: The supported languages.
LANGUAGES = [
    Language("javascript", (".js", ".jsx"), _BUILD, ("constructor",), ("require",), jsx=True),
    Language("typescript", (".ts",), _BUILD, ("constructor",), typed=True),
    Language("typescriptreact", (".tsx",), _BUILD, ("constructor",), jsx=True, typed=True),
    Language("python", (".py",), ("__pycache__", ".venv", "venv", ".mypy_cache", ".pytest_cache", ".tox", "build", "dist", "*.egg-info"), parser="python"),
]


def extension_table(spark: SparkSession, languages: Sequence[Language] = LANGUAGES) -> DataFrame:
    """(ext, language), a few rows."""
    rows = ", ".join(f"('{e}', '{x.name}')" for x in languages for e in x.extensions)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(ext, language)")


def excluded_dirs(languages: Sequence[Language] = LANGUAGES) -> list[str]:
    """The union over all languages, which every walk applies."""
    return sorted({d for x in languages for d in x.excluded_dirs})
