"""Rules as tables: rows add languages, words, markers and layers to the fixed values (§2.11).

Operators read every rule through ``rules``. Inside ``using(book)`` they see the tables of
the book; patterns and expressions are made from them when a plan is built. A book is
made of rows ``(rule, subject, value, place)``, for instance of a table kept beside the corpus.
"""

from __future__ import annotations

import copy
from collections.abc import Callable, Iterable
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass, field
from functools import wraps

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from codetrellis.functions import rules as fixed

RULE_ROWS = T.StructType(
    [*[T.StructField(c, T.StringType()) for c in ("rule", "subject", "value")], T.StructField("place", T.IntegerType())]
)
# a rule table is read whole on the driver, as its rows become parts of expressions
MOST_ROWS = 20_000

#: rules whose rows are (language, word), by the table they extend
_BY_LANGUAGE = {"extension": "LANGUAGE_EXTENSIONS", "function word": "FUNCTION_KEYWORDS", "type word": "TYPE_KEYWORDS"}
#: rules whose rows are (-, word)
_LISTS = {
    "skipped directory": "SKIPPED_DIRECTORIES",
    "control word": "CONTROL_KEYWORDS",
    "decision word": "DECISION_WORDS",
    "signature word": "SIGNATURE_QUALIFIERS",
    "standard method": "STANDARD_METHODS",
    "role word": "ROLE_KEYWORDS",
    "glossary word": "GLOSSARY_WORDS",
    "test marker": "TEST_MARKERS",
    "config marker": "CONFIG_MARKERS",
    "entry marker": "ENTRY_MARKERS",
    "starting name": "STARTING_NAMES",
    "route entry name": "ROUTE_ENTRY_NAMES",
}
#: how a language's scopes are found
_SCOPES = {"indent": "INDENT_SCOPED", "script": "SCRIPT_LANGUAGES", "shape": "SHAPE_LANGUAGES", "style": "STYLE_OR_MARKUP"}
#: rules whose rows are (name, marker), kept in order
_MARKERS = {"layer path": "LAYER_PATH_MARKERS", "layer name": "LAYER_NAME_MARKERS", "project kind": "PROJECT_KINDS"}
_LEXICAL = ("line comment", "block comment", "nested comment", "triple quote", "quote")
_OTHER = ("scope", "layer", "forbidden layers")


@dataclass(frozen=True)
class Rulebook:
    """The tables that differ from the fixed values, by name."""

    tables: dict[str, object] = field(default_factory=dict)

    @staticmethod
    def of_rows(rows: Iterable[tuple]) -> "Rulebook":
        """Fixed values with rows ``(rule, subject, value, place)`` added; ``place`` orders the rows of a rule.

        A language gets its own comments and quotes from its lexical rows. ``layer`` names a layer, its
        district and, as place, its rank; markers of a layer are tried before the fixed ones.
        A rule that is not known is an error.
        """
        tables: dict[str, object] = {}

        def changed(name: str):
            if name not in tables:
                tables[name] = copy.deepcopy(getattr(fixed, name))
            return tables[name]

        lexical: dict[str, dict[str, list[str]]] = {}
        markers: dict[str, dict[str, list[str]]] = {}
        for rule, subject, value, place in sorted(rows, key=lambda r: (r[3] is None, r[3] or 0)):
            if rule in _BY_LANGUAGE:
                changed(_BY_LANGUAGE[rule]).setdefault(subject, []).append(value)
            elif rule in _LISTS:
                changed(_LISTS[rule]).append(value)
            elif rule == "scope":
                changed(_SCOPES[value]).append(subject)
            elif rule in _MARKERS:
                markers.setdefault(_MARKERS[rule], {}).setdefault(subject, []).append(value)
            elif rule == "layer":
                changed("LAYER_RANKS")[subject] = int(place or 0)
                changed("DISTRICTS").setdefault(value, []).append(subject)
            elif rule == "forbidden layers":
                changed("FORBIDDEN_LAYERS").append((subject, value))
            elif rule in _LEXICAL:
                lexical.setdefault(subject, {}).setdefault(rule, []).append(value)
            else:
                raise ValueError(f"no rule is called {rule!r}")
        for name, added in markers.items():
            changed(name)[:0] = list(added.items())
        families = changed("LEXICAL_FAMILIES") if lexical else {}
        for language, parts in lexical.items():
            for names, *_ in families.values():
                if language in names:
                    names.remove(language)
            block = parts.get("block comment")
            families[f"rows of {language}"] = (
                [language],
                parts.get("line comment", []),
                tuple(block[0].split(" ")) if block else None,
                bool(parts.get("nested comment")),
                parts.get("triple quote", []),
                "".join(parts.get("quote", ['"'])),
            )
        return Rulebook(tables)

    @staticmethod
    def of_table(rows: DataFrame) -> "Rulebook":
        """A book from a table of RULE_ROWS, of at most MOST_ROWS rows."""
        found = rows.select(*RULE_ROWS.names).limit(MOST_ROWS + 1).collect()
        if len(found) > MOST_ROWS:
            raise ValueError(f"a rule table has at most {MOST_ROWS} rows")
        return Rulebook.of_rows(tuple(r) for r in found)


_CURRENT: ContextVar[Rulebook] = ContextVar("rulebook", default=Rulebook())


class _Rules:
    """The rules in force: those of the book in use, else the fixed values."""

    def __getattr__(self, name: str):
        tables = _CURRENT.get().tables
        return tables[name] if name in tables else getattr(fixed, name)


rules = _Rules()


@contextmanager
def using(book: Rulebook | None):
    """Plans that are built inside follow ``book``."""
    token = _CURRENT.set(book or _CURRENT.get())
    try:
        yield
    finally:
        _CURRENT.reset(token)


def ruled(method: Callable) -> Callable:
    """A method that builds its plan under the rulebook of its object's options."""

    @wraps(method)
    def build(self, *args, **kwargs):
        with using(self.options.rules):
            return method(self, *args, **kwargs)

    return build
