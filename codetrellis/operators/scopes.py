"""Declarations, their extent and what happens inside them.

A file is read once, in token order, by plain Python that gets the blanked text in batches. It keeps
running depths and the scopes that are open, never rows for tokens, so nothing is sorted or shuffled
but the files themselves:

1. tokens that can matter; running depths
2. matching parentheses, for declarations known by their shape
3. one event each: open, close, branch, call, nest
4. events inside a signature that was already consumed are dropped
5. a closer ends the scopes on its own level
6. the innermost scope of an event is the last scope opened on the event's level
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass
from operator import itemgetter

from codetrellis.functions.rulebook import rules
from codetrellis.operators.lexing import COMMENT, STRING, TRIVIA_END

# the tokens of a blanked line, as in ``lexing.TOKEN`` without the marks of comments and strings; letters are what is
# neither ASCII nor a control character, digit or sign, written as what they are not, which ``re`` tests faster
_NO_LETTER = "\\x00-@\\[-\\^`{-\\x7f"
_words_of = re.compile(
    f"[^{_NO_LETTER}][^\\x00-/:-@\\[-\\^`{{-\\x7f]*+|[0-9][^\\x00-\\-/:-@\\[-\\^`{{-\\x7f]*+|[^ \\t\\r{COMMENT}{TRIVIA_END}{STRING}]"
).findall
_MARKS = (COMMENT, STRING, TRIVIA_END)
_BINDERS = frozenset(["const", "let", "var"])
_METHOD_LEADS = frozenset([None, "{", ",", ";", "}", "async", "get", "set", "static"])


@dataclass(frozen=True)
class _Language:
    """What decides about the tokens of one language."""

    interest: frozenset
    types: frozenset
    functions: frozenset
    # words that can declare something
    declaring: frozenset
    control: frozenset
    # words that parentheses after them do not call
    uncalled: frozenset
    decisions: frozenset
    qualifiers: frozenset
    indent: bool
    script: bool
    shape: bool
    # parentheses are matched
    shaped: bool
    swift: bool
    rust: bool
    go: bool


def _words_of_interest(language: str) -> list[str]:
    """Tokens of a language that can open, close, branch or declare something."""
    words = {"(", "{", "}", "&", "|", *rules.DECISION_WORDS}
    words |= set(rules.TYPE_KEYWORDS.get(language, [])) | set(rules.FUNCTION_KEYWORDS.get(language, []))
    if language in rules.SHAPE_LANGUAGES:
        words |= {")", *rules.SIGNATURE_QUALIFIERS}
    if language in rules.SCRIPT_LANGUAGES:
        words |= {")", "const", "let", "var", "async"}
    if language == "go":
        words |= {")"}
    if language in rules.INDENT_SCOPED:
        words |= {")", "[", "]"}
    return sorted(words)


def languages() -> dict[str, _Language]:
    """The rules in force, by language; what has extractors of its own is left out."""
    found = {}
    for name in rules.LANGUAGE_EXTENSIONS:
        if name in rules.STYLE_OR_MARKUP:
            continue
        types, functions = (frozenset(t.get(name, [])) for t in (rules.TYPE_KEYWORDS, rules.FUNCTION_KEYWORDS))
        script, shape = name in rules.SCRIPT_LANGUAGES, name in rules.SHAPE_LANGUAGES
        control = frozenset([*rules.CONTROL_KEYWORDS, *(rules.C_CONTROL_KEYWORDS if name in ("c", "cpp") else [])])
        found[name] = _Language(
            interest=frozenset(_words_of_interest(name)),
            types=types,
            functions=functions,
            declaring=types | functions | (_BINDERS | {"function", "async"} if script else frozenset()),
            control=control,
            uncalled=control | types | functions,
            decisions=frozenset(rules.DECISION_WORDS),
            qualifiers=frozenset(rules.SIGNATURE_QUALIFIERS) if shape else frozenset(),
            indent=name in rules.INDENT_SCOPED,
            script=script,
            shape=shape,
            shaped=script or shape or name == "go",
            swift=name == "swift",
            rust=name == "rust",
            go=name == "go",
        )
    return found


class _Names(dict):
    """Whether a token is an identifier, told once for each; every non-ASCII character counts as a letter."""

    def __missing__(self, text: str | None) -> bool:
        c = text[0] if text else "\0"
        found = "a" <= c <= "z" or "A" <= c <= "Z" or c == "_" or c >= "\u0080"
        if len(self) > 1 << 16:  # of many texts
            self.clear()
        self[text] = found
        return found


_is_word = _Names()


# what stands before the first token and after the last one of a file
_BEFORE, _AFTER = 3, 5


class _Tokens:
    """Tokens of the files of one key, one behind another, and the places of those that can matter."""

    __slots__ = ("words", "lines", "indents", "begins", "places", "numbers", "last_line", "several")

    def __init__(self, language: _Language, texts: list[str]):
        self.words: list[str | None] = []
        self.lines: list[int] = []
        # by the place of a line's first token
        self.indents: dict[int, int] = {}
        self.begins: set[int] = set()
        # place in ``words`` and number in the file, from 1
        self.places: list[int] = []
        self.numbers: list[int] = []
        self.last_line = 0
        self.several = len(texts) > 1
        for text in texts:
            self._add(language, text)
        if self.several:  # files that come twice are read together, token by token
            order = sorted(range(len(self.places)), key=self.numbers.__getitem__)
            self.places = [self.places[k] for k in order]
            self.numbers = [self.numbers[k] for k in order]

    def _add(self, language: _Language, text: str) -> None:
        words, lines, indents, begins = self.words, self.lines, self.indents, self.begins
        words += [None] * _BEFORE
        lines += [0] * _BEFORE
        first = len(words)
        number = 0
        for body in text.split("\n"):
            number += 1
            found = _words_of(body)
            if found:
                if language.indent:
                    width = len(body) - len(body.lstrip(" \t\r"))
                    begin, at = body[width], len(words)
                    indents[at] = width + 3 * body.count("\t", 0, width) if begin != TRIVIA_END else 0
                    if begin not in _MARKS:
                        begins.add(at)
                words += found
                lines += [number] * len(found)
        last = len(words) - 1
        if last >= first:
            interest = language.interest
            if language.indent:
                # the first token of each line tells the indent of those after it
                places = [k for k, word in enumerate(words[first:last], first) if word in interest or k in indents]
            else:
                places = [k for k, word in enumerate(words[first:last], first) if word in interest]
            places.append(last)  # tells where a file ends
            self.places += places
            self.numbers += [k - first + 1 for k in places]
            self.last_line = max(self.last_line, lines[last])
        words += [None] * _AFTER
        lines += [0] * _AFTER


def _implemented(words: list, at: int) -> tuple[int, str] | None:
    """How far behind ``at`` the last name of an ``impl`` header stands, and the name; none when it never ends.

    The header is the run of names, ``<``, ``>`` and ``,`` after the word.
    """
    found = None
    k = at + 1
    while (word := words[k]) is not None:
        if _is_word[word]:
            found = (k - at, word)
        elif word not in ("<", ">", ","):
            return found
        k += 1
    return None


def _declared_by_word(language: _Language, words: list, at: int, rn: int) -> tuple | None:
    """Declaration introduced by a word, as (name, back, resume, kind); none when there is none.

    ``back`` is how many tokens before this one the declaration begins.
    """
    text, n1 = words[at], words[at + 1]
    named = _is_word[n1]
    if named and text in language.types:
        if language.rust and text == "impl" and (target := _implemented(words, at)):
            return target[1], 0, rn + target[0] + 1, "type"
        return n1, 0, rn + 2, "type"
    if language.script:
        if named and text in _BINDERS and words[at + 2] == "=":
            n3 = words[at + 3]
            if n3 in ("function", "async"):
                return n1, 0, rn + 4, "function"
            if n3 is not None and n3 != "(" and words[at + 4] == "=" and words[at + 5] == ">":
                return n1, 0, rn + 6, "function"
        if text in ("function", "async"):
            # name = function, name: async; after const, let or var the binding has it already
            p1, p2 = words[at - 1], words[at - 2]
            if p1 in ("=", ":") and _is_word[p2] and p2 not in language.functions:
                p3 = words[at - 3]
                if p1 == ":" or (p3 is not None and p3 not in _BINDERS):
                    return p2, 2, rn + 1, "function"
    if text in language.functions:
        if language.swift and text != "func":
            return text, 0, rn + 1, "initializer"
        if named:
            return n1, 0, rn + 2, "function"
    return None


# roles of events; an event is (place, role, line, details), its place being 4 * token + order at one token:
# close 0, inside 1, open 2
_CALL, _CLOSE, _BRACE, _OPEN, _BRANCH, _LINE = range(6)
_place = itemgetter(0)


def _events(language: _Language, tokens: _Tokens) -> list[tuple]:
    """What the tokens of a file tell, in token order."""
    words, lines = tokens.words, tokens.lines
    declaring, decisions, qualifiers, uncalled, interest = (
        language.declaring, language.decisions, language.qualifiers, language.uncalled, language.interest
    )
    indent_scoped, shape, shaped = language.indent, language.shape, language.shaped
    is_word = _is_word
    events: list[tuple] = []
    add = events.append
    braces = parens = brackets = lowest = noise = run_start = indent = 0
    last_close: tuple[int, int] | None = None
    # parentheses as [place, number, braces, indent, closer, body]; those without a closer or body by level
    opened: list[list] = []
    unclosed: dict[int, list[list]] = {}
    bodiless: dict[int, list[list]] = {}
    indents, begins = tokens.indents, tokens.begins
    # of one file lines follow each other; with several of one key the line is looked up
    starts = sorted(indents) if tokens.several else None
    for at, rn in zip(tokens.places, tokens.numbers):
        text = words[at]
        if indent_scoped:
            if starts is not None:
                indent = indents[starts[bisect_right(starts, at) - 1]]
            elif at in indents:
                indent = indents[at]
            if at in indents and at not in begins and text not in interest and words[at + 1] is not None:
                continue
            # depth of (), [] and {} before this token is zero; it never falls below that
            if brackets == lowest and at in begins:
                add((4 * rn, _CLOSE, lines[at], indent))
                add((4 * rn + 1, _LINE, lines[at], indent))
            if text in "([{":
                brackets += 1
            elif text in ")]}":
                brackets -= 1
                if brackets < lowest:
                    lowest = brackets
        if text in qualifiers:
            noise += 1
        declared = _declared_by_word(language, words, at, rn) if text in declaring else None
        if text == "(":
            parens += 1
            if declared is None:
                if shaped:
                    paren = [at, rn, braces, indent, None, None]
                    opened.append(paren)
                    unclosed.setdefault(parens - 1, []).append(paren)
                    if shape:
                        bodiless.setdefault(parens - 1, []).append(paren)
                else:
                    p1 = words[at - 1]
                    if is_word[p1] and p1 not in uncalled:
                        p3 = words[at - 3]
                        receiver = p3 if words[at - 2] == "." and is_word[p3] else None
                        add((4 * rn - 3, _CALL, lines[at - 1], (rn - 1, lines[at - 1], p1, receiver)))
        elif text == ")":
            parens -= 1
            if shaped:
                for paren in unclosed.pop(parens, ()):
                    paren[4] = (at, rn)
                if shape:
                    last_close = (rn, noise)
        elif text == "{":
            braces += 1
            # only qualifiers stand between the last ) and this {
            if shape and last_close is not None and noise - last_close[1] == rn - last_close[0] - 1:
                for paren in bodiless.pop(parens, ()):
                    paren[5] = (last_close[0], rn)
            if text not in decisions:
                add((4 * rn + 1, _BRACE, lines[at], braces))
        elif text == "}":
            braces -= 1
            if not indent_scoped:
                add((4 * rn, _CLOSE, lines[at], braces))
        elif text == "&" or text == "|":
            if words[at - 1] != text:
                run_start = rn
            if words[at + 1] == text and (rn - run_start) % 2 == 0 and text not in decisions:
                add((4 * rn + 1, _BRANCH, lines[at], None))
        if text in decisions:
            add((4 * rn + 1, _BRANCH, lines[at], None))
        if declared is not None:
            name, back, resume, kind = declared
            add((4 * (rn - back) + 2, _OPEN, lines[at - back], (rn - back, name, kind, resume, braces, indent)))
    for paren in opened:
        found = _at_parenthesis(language, words, lines, paren)
        if found is not None:
            add(found)
    events.sort(key=_place)
    return events


def _at_parenthesis(language: _Language, words: list, lines: list, paren: list) -> tuple | None:
    """The declaration known by what follows its parentheses, else the call, of a ``(``."""
    at, rn, braces, indent, close, body = paren
    p1, p2 = words[at - 1], words[at - 2]
    named = _is_word[p1]
    back = 0
    if close is not None:
        end, end_rn = close
        after = words[end + 1]
        if language.script:
            if after == "=" and words[end + 2] == ">" and _is_word[p2]:
                if p1 == "=" and words[at - 3] in _BINDERS:
                    back, name, resume = 3, p2, end_rn + 3
                elif p1 == ":" and p2 not in language.functions:
                    back, name, resume = 2, p2, end_rn + 3
            elif (
                after == "{" and named and p1 not in language.control and p1 not in language.functions
                and p2 in _METHOD_LEADS
            ):
                back, name, resume = 1, p1, end_rn + 1
        if back:
            pass
        elif (
            body is not None and body[0] == end_rn and named and p1 not in language.control
            and (p2 == "*" or _is_word[p2])
        ):
            back, name, resume = 1, p1, body[1]
        elif language.go and p1 == "func" and _is_word[after]:
            back, name, resume = 1, after, end_rn + 2
        if back:
            return (
                4 * (rn - back) + 2, _OPEN, lines[at - back], (rn - back, name, "function", resume, braces, indent)
            )
    # a name that opens a declaration is not a call
    if named and p1 not in language.uncalled:
        p3 = words[at - 3]
        receiver = p3 if p2 == "." and _is_word[p3] else None
        return 4 * rn - 3, _CALL, lines[at - 1], (rn - 1, lines[at - 1], p1, receiver)
    return None


def _call_order(call: tuple) -> tuple:
    at, line, callee, receiver = call
    return at, line, callee, receiver is not None, receiver or ""


def _declaration_order(d: list) -> tuple:
    name, container, kind, line, end_line = d
    return name, container is not None, container or "", kind, line, end_line


def _scoped(language: _Language, events: list[tuple], last_line: int) -> tuple[dict[int, list], list[tuple]]:
    """Declarations by token with what is directly inside them, and the calls outside of all.

    A declaration is [its rows, branches, nesting, calls]; a row is [name, container, kind, line, end_line].
    A closing brace ends scopes on its own level, and on the level above those that never got a
    body. A line ends the indentation levels between its own and the previous line's.
    """
    indent_scoped = language.indent
    symbols: dict[int, list] = {}
    outside: list[tuple] = []
    # declarations without an end by level, with whether they are types
    pending: dict[int, list[tuple[list, bool]]] = {}
    # the last scope opened on each level
    callables: dict[int, tuple[list, int, int, int]] = {}
    types: dict[int, tuple[int, str]] = {}
    call_level = type_level = until = first = 0
    previous_indent = None
    for place, role, line, details in events:
        if role == _OPEN:
            at, name, kind, resume, depth, indent = details
            kept = at >= until
            # a declaration inside another one's signature does not consume anything itself
            if at >= first and resume > until:
                until = resume
            if resume > first:
                first = resume
            if not kept:
                continue
            container = types.get(type_level)
            is_type = kind == "type"
            row = [name, None, kind, line, None]
            if container is not None:
                row[1] = container[1]
                if kind == "function":
                    row[2] = "method"
            symbol = symbols.get(at)
            if symbol is None:
                symbol = symbols[at] = [[row], 0, 0, []]
            else:
                symbol[0].append(row)
            level = indent if indent_scoped else depth
            if level in pending:
                pending[level].append((row, is_type))
            else:
                pending[level] = [(row, is_type)]
            if is_type:
                type_level += 1
                types[type_level] = (at, name)
            else:
                call_level += 1
                callables[call_level] = (symbol, depth, indent, at)
            previous_indent = indent
            continue
        if place >> 2 < until:
            continue
        if role == _CALL:
            owner = callables.get(call_level)
            if owner is None:
                outside.append(details)
            else:
                owner[0][3].append(details)
        elif role == _CLOSE:
            if indent_scoped:
                # levels that the file has, not all numbers between
                ended = () if previous_indent is None else [k for k in pending if details <= k <= previous_indent]
                previous_indent = details
            else:
                ended = (details, details + 1)
            for level in ended:
                if level in pending:
                    for row, is_type in pending.pop(level):
                        row[4] = line
                        if is_type:
                            type_level -= 1
                        else:
                            call_level -= 1
        else:
            owner = callables.get(call_level)
            if owner is None:
                continue
            symbol, depth, indent, at = owner
            if role == _BRANCH:
                symbol[1] += 1
                continue
            if role == _BRACE:
                nesting = details - depth - (0 if indent_scoped else 1)
            else:
                container = types.get(type_level)
                if container is not None and at <= container[0]:
                    continue
                nesting = (details - indent) // 4
            if nesting > symbol[2]:
                symbol[2] = nesting
    for left in pending.values():
        for row, _ in left:
            row[4] = last_line
    return symbols, outside


def code_facts(language: _Language, texts: list[str]) -> list[tuple]:
    """Declarations of blanked texts of one key, and one row for calls outside of all, in their order.

    Rows are (place or none, name, container, kind, line, end_line, branches, max_nesting, calls); calls are
    (place, line, callee, receiver). The calls of one declaration in one file are bounded by the file-size limit.
    """
    tokens = _Tokens(language, texts)
    symbols, outside = _scoped(language, _events(language, tokens), tokens.last_line)
    found = []
    for at, (rows, branches, nesting, calls) in symbols.items():
        row = rows[0] if len(rows) == 1 else max(rows, key=_declaration_order)
        if len(calls) > 1:
            calls.sort(key=_call_order)
        found.append((at, *row, branches, nesting, calls))
    if outside:
        outside.sort(key=_call_order)
        found.append((None, None, None, None, None, None, 0, 0, outside))
    return found
