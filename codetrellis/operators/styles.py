"""Structure of stylesheets and markup.

Like ``scopes``, a file is read once by plain Python; the rows are of the same kind as those of ``code_facts``.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLOCK = r"/\*(?:[^*]++|\*(?!/))*+(?:\*/)?+"
_COMMENTS = {"css": re.compile(_BLOCK), "scss": re.compile(rf"{_BLOCK}|//[^\n]*+")}
# text up to the next delimiter, or what is left at the end
_segments_of = re.compile("[^{};]*+[{};]|[^{};]++").findall
# letters and numbers of any script, as in [\p{L}\p{N}\-_.%]
_INCLUDE = re.compile(r"@(?:include|extend) *([\w\-.%]+)")
_SPACES = re.compile(" {2,}")
# an attribute at the start of the text or after a space
_ID = re.compile(r"""(?:(?<=[ \t])|\A)id=(?:"([^"]*+)(?:"|\Z)|'([^']*+)(?:'|\Z))""")


def clean_selector(raw: Column) -> Column:
    """One readable name: single spaces, at most 42 characters and an ellipsis (P25)."""
    value = F.trim(F.regexp_replace(raw, " {2,}", " "))
    return F.when(F.length(value) > 44, F.concat(F.left(value, F.lit(42)), F.lit("…"))).otherwise(value)


def _clean(raw: str) -> str:
    """``clean_selector`` of a string."""
    value = _SPACES.sub(" ", raw).strip(" ")
    return value[:42] + "…" if len(value) > 44 else value


def _breaks(comment: re.Match) -> str:
    """A comment ends the selector before it and keeps its line breaks."""
    return ";" + "\n" * comment[0].count("\n")


def _side_by_side(parts: list[list]) -> list[tuple[int, object]]:
    """Pieces of the files of one key with their places; files that come twice are read together, piece by piece."""
    if len(parts) == 1:
        return list(enumerate(parts[0]))
    return sorted(((at, piece) for part in parts for at, piece in enumerate(part)), key=lambda x: x[0])


def stylesheet_facts(language: str, texts: list[str]) -> list[tuple]:
    """Rules as declarations, ``@include``/``@extend`` as calls, as rows of ``code_facts``."""
    comments = _COMMENTS[language]
    segments = _side_by_side([_segments_of(comments.sub(_breaks, text)) for text in texts])
    rules: dict[int, list[list]] = {}
    calls: dict[int | None, list[tuple]] = {}
    # only top-level rules get an end line: that of the closer that returns to depth 0
    unended: list[list] = []
    owner = None
    line, total, lowest = 1, 0, 0
    for at, segment in segments:
        first_line = line
        line += segment.count("\n")
        last = segment[-1]
        opens, closes = last == "{", last == "}"
        total += opens - closes
        # never below zero, however many closers are unmatched
        lowest = min(lowest, total)
        depth = total - lowest
        if "@" in segment and (found := list(_INCLUDE.finditer(segment))):
            at_line = first_line + segment.count("\n", 0, found[0].start())
            calls.setdefault(owner, []).extend((at, at_line, m[1], None) for m in found)
        if opens:
            raw = segment[:-1].replace("\n", " ").replace("\t", " ").strip(" ")
            name = _clean(raw)
            if name:
                kind = "function" if raw.startswith(("@mixin", "@function")) else "type"
                rule = [name, None, kind, line, line]
                rules.setdefault(at, []).append(rule)
                if depth == 1:
                    unended.append(rule)
                    owner = at
        elif closes and depth == 0:
            for rule in unended:
                rule[4] = line
            unended = []
            owner = None
    found = []
    for at, rows in rules.items():
        row = max(rows, key=lambda r: (r[0], r[2], r[3], r[4]))
        found.append((at, *row, 0, 0, sorted(calls.get(at, ()), key=lambda c: c[:3])))
    if None in calls:
        found.append((None, None, None, None, None, None, 0, 0, sorted(calls[None], key=lambda c: c[:3])))
    return found


def markup_facts(texts: list[str]) -> list[tuple]:
    """Element ids as ``#id`` declarations, the first of each name per file, as rows of ``code_facts``."""
    parts = []
    for text in texts:
        end, part = 0, []
        for m in _ID.finditer(text):
            part.append((text.count("\n", end, m.start()), text.count("\n", m.start(), m.end()), m[1] or m[2]))
            end = m.end()
        parts.append(part)
    first: dict[str, tuple[int, int]] = {}
    line = 1
    for at, (gap, inside, name) in _side_by_side(parts):
        if name:
            here = (at, line + gap)
            first[name] = min(first.get(name, here), here)
        line += gap + inside
    return [
        (at, f"#{name}", None, "type", line, line, 0, 0, [])
        for name, (at, line) in sorted(first.items(), key=lambda x: x[1])
    ]
