"""Source text to tokens (X1, X2, X22) and token roles.

Text is blanked with one regular expression per family of languages, split into
lines, and exploded into tokens. Files are hashed to partitions once, as text;
every later step that works inside a file then needs no shuffle of tokens.
Declarations are found by ``scopes``, which reads the blanked text itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codetrellis.functions.rulebook import rules
from codetrellis.session import allow_wide_expressions, broadcast_as_measured
from codetrellis.sources.corpus import FILE_KEY, with_file_key

# control characters that stand where a comment or a string was
COMMENT, STRING, TRIVIA_END = "\u0001", "\u0003", "\u0002"
_RESERVED, _REPLACEMENT = COMMENT + TRIVIA_END + STRING, "\u0004\u0004\u0004"

# nested block comments: what one more level puts around the pattern of the levels inside
_LEVEL = ("/\\*(?:[^*/]++|\\*(?!/)|/(?!\\*)|", ")*+(?:\\*/)?+")
_INNERMOST = "/\\*(?:[^*]++|\\*(?!/))*+(?:\\*/)?+"
# stands for a nested comment in a family's pattern until the depth is known
_NESTED = "(?:nested)"

LETTER = "A-Za-z_\\x{80}-\\x{10FFFF}"
_WORD_OR_NUMBER = f"[{LETTER}][{LETTER}0-9]*+|[0-9][{LETTER}0-9.]*+"
TOKEN = f"{_WORD_OR_NUMBER}|[^ \\t\\r]"


def _quoted(quote: str) -> str:
    # quantifiers are possessive: a long literal must not deepen the stack
    stops = "\\\\" if quote == "`" else "\\\\\\n"
    return f"{quote}(?:[^{quote}{stops}]++|\\\\[\\s\\S]?+)*+{quote}?+"


def _block_comment(opening: str, closing: str, nested: bool) -> str:
    if opening == "<!--":
        return "<!--(?:[^-]++|-(?!->))*+(?:-->)?+"
    return _NESTED if nested else _INNERMOST


def comment_depth(content: Column) -> Column:
    """How deep block comments of a text can be nested, at most.

    The depth rises at every opening and falls, not below zero, at every closing mark; a mark that can be either,
    as in ``*/*``, opens. Comments that only seem to begin, in strings or after a line mark, can
    make it too large but never too small.
    """
    marks = F.regexp_extract_all(content, F.lit("/\\*|\\*/(?!\\*)"), F.lit(0))
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(at: Column, mark: Column) -> Column:
        now = F.greatest(F.lit(0), at["now"] + F.when(mark == "/*", 1).otherwise(-1))
        return F.struct(now.alias("now"), F.greatest(at["most"], now).alias("most"))

    return F.when(content.contains("/*"), F.aggregate(marks, start, step, lambda x: x["most"])).otherwise(0)


def _levels(content: Column) -> Column:
    """Levels of a text's pattern: a power of two, so that few different patterns are compiled."""
    depth = comment_depth(content)
    return F.when(depth <= 4, 4).otherwise(F.pow(F.lit(2), F.ceil(F.log2(depth))).cast("int"))


def _family_patterns(family: str) -> tuple[str, str, str]:
    """(all chunks, start of a comment, start of a string) for one family.

    A nested comment stands in the first as ``_NESTED``.
    """
    _, line_marks, block, nested, triples, quotes = rules.LEXICAL_FAMILIES[family]
    comment_starts = list(line_marks) + ([block[0]] if block else [])
    comments = [f"{mark}[^\\n]*+" for mark in line_marks]
    if block:
        comments.append(_block_comment(block[0], block[1], nested))
    strings = [
        f"{t}(?:[^{t[0]}\\\\]++|\\\\[\\s\\S]?+|{t[0]}(?!{t[0]}{t[0]}))*+(?:{t})?+" for t in triples
    ] + [_quoted(q) for q in quotes]
    first_chars = "".join(sorted({mark[0] for mark in comment_starts} | set(quotes)))
    starts = "|".join(mark.replace("*", "\\*") for mark in comment_starts)
    plain = f"(?:[^{first_chars}]++|(?!{starts})[{first_chars.translate({ord(q): None for q in quotes}) or ' '}])++"
    chunks = "|".join(comments + strings + [plain])
    return chunks, f"^(?:{starts})", f"^[{quotes}]"


def _blank_chunk(chunk: Column, marker: str) -> Column:
    def spaces(text: Column) -> Column:
        return F.regexp_replace(text, "[^\\n]", " ")

    inner = F.length(chunk) - 1
    return (
        F.when(~chunk.contains("\n"), F.concat(F.lit(marker), F.repeat(F.lit(" "), inner)))
        .when(chunk.endswith("\n"), F.concat(F.lit(marker), spaces(F.substr(chunk, F.lit(2)))))
        .otherwise(
            F.concat(F.lit(marker), spaces(F.substr(chunk, F.lit(2), inner - 1)), F.lit(TRIVIA_END))
        )
    )


def _blank(content: Column, family: str) -> Column:
    chunks, comment_start, string_start = _family_patterns(family)
    pattern = F.lit(chunks)
    if _NESTED in chunks:
        before, after = chunks.split(_NESTED)
        opening, closing = (F.repeat(F.lit(x), _levels(content)) for x in _LEVEL)
        pattern = F.concat(F.lit(before), opening, F.lit(_INNERMOST), closing, F.lit(after))

    def one(chunk: Column) -> Column:
        return (
            F.when(chunk.rlike(comment_start), _blank_chunk(chunk, COMMENT))
            .when(chunk.rlike(string_start), _blank_chunk(chunk, STRING))
            .otherwise(F.translate(chunk, _RESERVED, _REPLACEMENT))
        )

    return F.array_join(F.transform(F.regexp_extract_all(content, pattern, F.lit(0)), one), "")


def blank_trivia(content: Column, language: Column) -> Column:
    """Replace comments and strings by spaces, keeping length and line breaks.

    The first character of each becomes a marker, so a line that begins with one
    is still known to have begun; a marker also ends one that spans lines.
    """
    result = None
    for family, (languages, *_rest) in rules.LEXICAL_FAMILIES.items():
        cond = language.isin(languages)
        value = _blank(content, family)
        result = F.when(cond, value) if result is None else result.when(cond, value)
    return result


def by_file(files: DataFrame) -> DataFrame:
    """Hash whole files to partitions; later steps inside a file then need no shuffle.

    Files that have a key already, such as texts named by their content, keep it.

    Text grows many times over when it becomes tokens, so the number of
    partitions is the session's ``spark.sql.shuffle.partitions`` and is not
    coalesced; size it for some 16 MB of source text per partition.
    """
    allow_wide_expressions(files.sparkSession)
    broadcast_as_measured(files.sparkSession)
    count = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = files if set(FILE_KEY) <= set(files.columns) else with_file_key(files)
    return keyed.select(*FILE_KEY, "language", "content").repartition(count, *FILE_KEY)


def first_code_point(text: Column) -> Column:
    return F.ascii(text)


def is_word(text: Column) -> Column:
    """The token is an identifier; every non-ASCII character counts as a letter."""
    c = first_code_point(text)
    return c.between(97, 122) | c.between(65, 90) | (c == 95) | (c >= 128)


def _token_lines(content: Column, language: Column, pattern: str) -> Column:
    """Array of (line, indent, words) of a file; a tab indents by four."""

    def one(body: Column, at: Column) -> Column:
        width = F.length(body) - F.length(F.ltrim(body, F.lit(" \t\r")))
        lead = F.left(body, width)
        tabs = width - F.length(F.replace(lead, F.lit("\t"), F.lit("")))
        first = F.substr(body, width + 1, F.lit(1))
        # only languages that scope by indentation look at it
        measured = language.isin(rules.INDENT_SCOPED)
        return F.struct(
            (at + 1).alias("line"),
            F.when(measured & (first != TRIVIA_END), width + 3 * tabs).otherwise(0).cast("int").alias("indent"),
            F.regexp_extract_all(body, F.lit(pattern), F.lit(0)).alias("words"),
        )

    return F.transform(F.split(blank_trivia(content, language), "\n"), one)


def tokens(files: DataFrame, trivia: bool = False) -> DataFrame:
    """``files(repo, snap, path, language, content)`` to one row per token.

    Columns: file key, language, line, pos (order inside the line), text, indent,
    first_on_line. With ``trivia`` comments and strings are rows too.
    """
    lines = by_file(files).select(
        *FILE_KEY, "language", F.explode(_token_lines(F.col("content"), F.col("language"), TOKEN)).alias("l")
    )
    parts = lines.select(
        *FILE_KEY, "language", "l.line", "l.indent", F.posexplode("l.words").alias("pos", "text")
    ).withColumn("first_on_line", F.col("pos") == 0)
    if trivia:
        return parts.filter(F.col("text") != TRIVIA_END)
    return parts.filter(~F.col("text").isin(COMMENT, STRING, TRIVIA_END))


def token_kind(text: Column) -> Column:
    c = first_code_point(text)
    return (
        F.when(text == COMMENT, "comment")
        .when(text == STRING, "string")
        .when(is_word(text), "identifier")
        .when(c.between(48, 57), "number")
        .otherwise("punct")
    )


def with_roles(parts: DataFrame) -> DataFrame:
    """Role of each token for a reader (P26). ``parts`` comes from ``tokens(…, trivia=True)``.

    A word is a call when the next token that is not a comment or string end is
    an opening parenthesis directly after it in the token order.
    """
    order = Window.partitionBy(*FILE_KEY).orderBy("line", "pos")
    kind = token_kind(F.col("text"))
    first = F.left("text", F.lit(1))
    role = (
        F.when(kind != "identifier", kind)
        .when(F.col("text").isin(rules.ROLE_KEYWORDS), "keyword")
        .when(F.col("_next") == "(", "function")
        .when(first.rlike("^\\p{Lu}"), "type")
        .otherwise("plain")
    )
    return parts.withColumn("_next", F.lead("text").over(order)).withColumn("role", role).drop("_next")


def role_histogram(files: DataFrame) -> DataFrame:
    """Tokens per (repo, snap, language, role)."""
    per_file = (
        with_roles(tokens(files, trivia=True))
        .groupBy(*FILE_KEY, "language", "role")
        .agg(F.count(F.lit(1)).alias("tokens"))
    )
    owners = with_file_key(files).select(*FILE_KEY, "repo", "snap")
    return (
        per_file.join(owners, FILE_KEY)
        .groupBy("repo", "snap", "language", "role")
        .agg(F.sum("tokens").cast("bigint").alias("tokens"))
    )
