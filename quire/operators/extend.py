"""Plug-in surface: named similarities, alignments, language rules, schemes and hooks."""

from __future__ import annotations

from collections.abc import Callable
from enum import Enum

from quire.functions import keys, text
from quire.operators import align, cite


class Registry:
    """Names to things of one kind; an unknown name is an error that lists those there are."""

    def __init__(self, kind: str, **known) -> None:
        self.kind, self._known = kind, dict(known)

    def add(self, name: str, what, replace: bool = False):
        if name in self._known and not replace:
            raise ValueError(f"{self.kind} {name} is taken")
        self._known[name] = what
        return what

    def __getitem__(self, name: str):
        try:
            return self._known[name]
        except KeyError:
            raise KeyError(f"no {self.kind} {name}; there are {', '.join(sorted(self._known))}") from None

    def names(self) -> list[str]:
        return sorted(self._known)


class Builder(Enum):
    """Models by which a translation's chapters are built."""

    CHAPTERS, COLUMNS, TURNS, NONE = "chapters", "columns", "turns", "none"


#: (texts, texts) to a matrix of similarities.
SIMILARITIES = Registry("similarity", lexical=align.similarity)
#: Alignments of two streams that ``align_groups`` knows.
ALIGNMENTS = Registry("alignment", **{k: k for k in ("lcs", "filled", "monotone", "beads", "global", "zipped")})
#: Language to its key, its search fold, and what tells a numeral.
LANGUAGES = Registry("language", grc=(keys.beta_key, text.beta, keys.is_greek_numeral), lat=(keys.latin_key, text.fold, lambda c: text.roman(c).isNotNull()))
SCHEMES = Registry("scheme", **cite.FORMS)
_HOOKS: dict[str, list[Callable]] = {}


def hook(name: str, f: Callable) -> None:
    """``f`` is called with each value of the named stage and may change it."""
    _HOOKS.setdefault(name, []).append(f)


def through_hooks(name: str, value):
    for f in _HOOKS.get(name, ()):
        value = f(value)
    return value


def register_functions(spark, functions: dict[str, Callable]) -> None:
    """Named Python functions for SQL text."""
    for name, f in functions.items():
        spark.udf.register(name, f)
