"""Secret scans through a trigram index.

From each rule's regular expression a Boolean query over trigrams is derived: all
its clauses must hold, a clause holds if all trigrams of one of its alternatives
occur. Postings (trigram, text) are intersected to candidate texts, which are then
verified by the expression itself. A rule without a mandatory trigram, such as
a run of hexadecimal digits, scans every text. DataFrame functions only.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codetrellis.llm.registry import query, table
from codetrellis.session import checkpointed as cut


@dataclass(frozen=True)
class Rule:
    """``group`` of a match must have ``least`` code points, else the match is dropped."""

    kind: str
    regex: str
    group: int = 0
    least: int = 1


#: fixed values: base kinds first, in the order in which spans of one start are listed
RULES = [
    Rule(
        "assign",
        r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        group=1,
        least=6,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", least=20),
    Rule("hex", r"[0-9a-f]{24,}", least=24),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+"),
    Rule("payment", r"[sr]k_(?:live|test)_[0-9A-Za-z]{16,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
]
BASE_KINDS = ("assign", "access", "hex")
#: keys of candidate texts, 16 bytes each, that are broadcast
CANDIDATES = 1_000_000

# --- from an expression to a trigram query -------------------------------------


def _strings(node, limit: int) -> set[str] | None:
    """All lower-case strings a parsed node can match, or None if more than ``limit`` or open."""
    name, value = str(node[0]), node[1]
    if name == "LITERAL":
        return {chr(value).lower()}
    if name == "IN":
        found = set()
        for kind, v in value:
            if str(kind) == "LITERAL":
                found.add(chr(v).lower())
            elif str(kind) == "RANGE" and v[1] - v[0] < limit:
                found |= {chr(x).lower() for x in range(v[0], v[1] + 1)}
            else:
                return None
        return found if len(found) <= limit else None
    if name == "SUBPATTERN":
        return _sequence_strings(value[3], limit)
    if name == "BRANCH":
        found = set()
        for part in value[1]:
            one = _sequence_strings(part, limit)
            if one is None:
                return None
            found |= one
        return found if len(found) <= limit else None
    if name == "MAX_REPEAT" and value[1] == 1:
        inner = _sequence_strings(value[2], limit)
        return None if inner is None else inner | ({""} if value[0] == 0 else set())
    return None


def _sequence_strings(nodes, limit: int) -> set[str] | None:
    found = {""}
    for node in nodes:
        one = _strings(node, limit)
        if one is None or len(found) * len(one) > limit:
            return None
        found = {a + b for a in found for b in one}
    return found


def trigram_query(regex: str, limit: int = 16) -> list[list[frozenset[str]]]:
    """Clauses of alternatives of trigram sets that every match's lower-case text satisfies.

    An empty list means that no trigram is mandatory.
    """
    clauses, run = [], {""}

    def close():
        nonlocal run
        sets = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in run}
        if all(sets):
            clauses.append(sorted(sets, key=sorted))
        run = {""}

    for node in re._parser.parse(regex):
        one = _strings(node, limit)
        if one is not None and len(run) * len(one) <= limit:
            run = {a + b for a in run for b in one}
        else:
            close()
            run = one if one is not None else {""}
    close()
    return clauses


# --- index and candidates --------------------------------------------------------


def vocabulary(rules: list[Rule]) -> list[str]:
    """Trigrams that some rule asks for; their number depends on the rules alone."""
    return sorted({t for r in rules for c in trigram_query(r.regex) for alternative in c for t in alternative})


def postings(texts: DataFrame, rules: list[Rule], key: str = "text_key", text: str = "text") -> DataFrame:
    """The index: (trigram_id, key) for the trigrams that the rules ask for."""
    terms = vocabulary(rules)
    lowered = texts.select(F.col(key), F.lower(F.col(text)).alias("_low"))
    ids = F.array_compact(F.array(*[F.when(F.contains("_low", F.lit(t)), F.lit(i)) for i, t in enumerate(terms)]))
    return lowered.select(key, F.explode(ids).alias("trigram_id"))


def candidates(index: DataFrame, rules: list[Rule], key: str = "text_key") -> DataFrame:
    """(key, rule_bits): the texts whose postings satisfy each rule's query.

    Postings of a key are joined into bit words, combined before the shuffle, so a
    text that occurs very often costs one row per task.
    """
    terms = {t: i for i, t in enumerate(vocabulary(rules))}
    words = len(terms) // 62 + 1
    found = index.groupBy(key).agg(
        *[
            F.bit_or(
                F.when(F.floor(F.col("trigram_id") / 62) == w, F.expr(f"shiftleft(1L, cast(trigram_id % 62 AS int))")).otherwise(F.lit(0).cast("long"))
            ).alias(f"_w{w}")
            for w in range(words)
        ]
    )

    def has(alternative) -> Column:
        masks = [0] * words
        for t in alternative:
            masks[terms[t] // 62] |= 1 << (terms[t] % 62)
        tests = [F.col(f"_w{w}").bitwiseAND(F.lit(m)) == F.lit(m) for w, m in enumerate(masks) if m]
        return _every(tests)

    bits = F.lit(0).cast("long")
    for n, rule in enumerate(rules):
        clauses = trigram_query(rule.regex)
        if clauses:
            holds = _every([_any([has(a) for a in clause]) for clause in clauses])
            bits = bits.bitwiseOR(F.when(holds, F.lit(1 << n)).otherwise(F.lit(0)).cast("long"))
    return found.select(key, bits.alias("rule_bits")).filter("rule_bits <> 0")


def _every(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


def _any(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


# --- verification ----------------------------------------------------------------


def _sum(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0).cast("long"), lambda n, x: n + x)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: elements that one level of a running value covers
_STRIDE = 64


def _running(values: Column, fold) -> Column:
    """For every element of an array of longs, ``fold`` of all up to it; the array must not be empty.

    On two levels of blocks: an element looks at its own block up to it and at what was found for the
    blocks before, so the work is some 64 steps an element and not as many as there are elements.
    """

    def folded(xs: Column) -> Column:  # of each block
        last = F.floor((F.size(xs) - 1) / _STRIDE).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda c: fold(F.slice(xs, c * _STRIDE + 1, F.lit(_STRIDE))))

    def spread(xs: Column, before) -> Column:  # from what holds before each block to each element
        def one(_, i):
            block = F.floor(i / _STRIDE).cast("int")
            return fold(F.concat(before(block), F.slice(xs, block * _STRIDE + 1, i % _STRIDE + 1)))

        return F.transform(xs, one)

    none = F.array().cast("array<long>")

    def upto(running: Column):
        return lambda block: F.when(block > 0, F.array(F.get(running, block - 1))).otherwise(none)

    def at_top(tops: Column) -> Column:
        return F.transform(tops, lambda _, i: fold(F.slice(tops, F.lit(1), i + 1)))

    def found(xs: Column, blocks: Column) -> Column:
        tops = _let(folded(blocks), at_top)
        return _let(tops, lambda top: _let(spread(blocks, upto(top)), lambda middle: spread(xs, upto(middle))))

    # every array is bound before it is looked into, else it would be worked out for each element
    return _let(values, lambda xs: _let(folded(xs), lambda blocks: found(xs, blocks)))


def _rule_spans(df: DataFrame, rule: Rule, number: int, asked: Column) -> DataFrame:
    """Adds ``_s{number}``: spans of the rule, from the pieces between its matches.

    What a text is asked for is bound once, so that the work grows with the text and its matches.
    """
    text = F.col("_text")

    def lengths(strings: Column) -> Column:
        return F.transform(strings, lambda x: F.length(x).cast("long"))

    def spans(matches: Column) -> Column:
        found = F.regexp_extract_all(text, F.lit(rule.regex), F.lit(rule.group)) if rule.group else matches
        return _let(
            F.struct(
                lengths(matches).alias("whole"),
                lengths(found).alias("group"),
                lengths(F.split(text, rule.regex)).alias("between"),
            ),
            lambda n: _let(
                # a match starts after all pieces up to it and all matches before it
                _running(F.zip_with(F.slice(n["between"], F.lit(1), F.size(n["whole"])), n["whole"], lambda x, y: x + y), _sum),
                lambda ends: F.filter(
                    F.zip_with(
                        F.zip_with(ends, n["whole"], lambda end, size: F.struct((end - size).alias("start"), size.alias("length"))),
                        n["group"],
                        lambda at, size: F.when(
                            size >= rule.least,
                            F.struct(at["start"].alias("start"), F.lit(number).alias("kind"), at["length"].alias("length")),
                        ),
                    ),
                    lambda x: x.isNotNull(),
                ),
            ),
        )

    none = F.array().cast("array<struct<start:bigint,kind:int,length:bigint>>")
    matches = F.when(asked, F.regexp_extract_all(text, F.lit(rule.regex), F.lit(0))).otherwise(F.array().cast("array<string>"))
    return df.withColumn(f"_s{number}", _let(matches, lambda m: F.when(F.size(m) > 0, spans(m)).otherwise(none)))


def scan(docs: DataFrame, rules: list[Rule] = RULES, text_col: str = "text", out: str = "spans") -> DataFrame:
    """``docs`` with a column ``out``: array<struct<kind, start, end>>, by start, then rule order.

    Positions are code points, ``end`` exclusive; matches of one kind are leftmost
    and do not overlap. Null and empty texts have no span. Every input row gives
    one row, repeated rows too; their text is indexed once. Texts are keyed by a
    64-bit hash: texts that collide share their trigrams, which can only add
    candidates. Columns of any name but ``out`` are kept, for the work is done beside a struct of the
    input row. A text of any length is scanned whole, in time that grows with its length and its
    matches. Up to ``CANDIDATES`` candidate texts are broadcast, more are joined by shuffle.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    rows = rows.withColumn("text_key", F.xxhash64("_text"))
    index = postings(rows.select("text_key", F.col("_text").alias("text")), rules)
    # written first: few meet the texts where they lie, many in a join in which a frequent text can be split
    found = cut(candidates(index, rules))
    df = rows.join(F.broadcast(found) if found.count() <= CANDIDATES else found, "text_key", "left")
    for n, rule in enumerate(rules):
        if trigram_query(rule.regex):
            asked = F.coalesce(F.col("rule_bits"), F.lit(0).cast("long")).bitwiseAND(F.lit(1 << n)) != 0
        else:
            asked = F.lit(True)
        df = _rule_spans(df, rule, n, asked)
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    every = F.array_sort(F.concat(*[F.col(f"_s{n}") for n in range(len(rules))]))
    spans = F.transform(
        every,
        lambda s: F.struct(
            F.get(kinds, s["kind"]).alias("kind"),
            s["start"].cast("long").alias("start"),
            (s["start"] + s["length"]).cast("long").alias("end"),
        ),
    )
    return df.select("_row", spans.alias("_spans")).select(
        *[F.col("_row")[c].alias(c) for c in docs.columns if c != out], F.col("_spans").alias(out)
    )


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """``text`` with every stretch covered by spans replaced by one ``mark``.

    The text is cut as UTF-32, where every place is found at once, and the furthest end so far is
    a running maximum; so the work grows with the text and its spans.
    """

    def between(wide: Column, start: Column, end: Column) -> Column:
        return F.decode(wide.substr((4 * start + 1).cast("int"), (4 * (end - start)).cast("int")), "UTF-32")

    def joined(s: Column, wide: Column, reach: Column) -> Column:
        def part(x: Column, i: Column) -> Column:
            before = F.when(i > 0, F.get(reach, i - 1)).otherwise(F.lit(-1).cast("long"))
            gap = F.concat(between(wide, F.greatest(before, F.lit(0).cast("long")), x["start"]), F.lit(mark))
            return F.when(x["start"] > before, gap).otherwise(F.lit(""))

        tail = between(wide, F.get(reach, F.size(reach) - 1), (F.length(wide) / 4).cast("long"))
        return F.concat(F.array_join(F.transform(s, part), ""), tail)

    found = _let(
        F.struct(spans.alias("s"), F.encode(text, "UTF-32").alias("wide")),
        lambda x: _let(
            _running(F.transform(x["s"], lambda y: y["end"]), F.array_max), lambda reach: joined(x["s"], x["wide"], reach)
        ),
    )
    return F.when(F.size(spans) > 0, found).otherwise(text)


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat(s["kind"], F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string")),
        ),
        ",",
    )


def _spans_sql(rule: Rule, number: int) -> str:
    regex = rule.regex.replace("'", "''")
    least = f"length(coalesce(regexp_extract(m[i], '{regex}', {rule.group}), '')) >= {rule.least}"
    return f"""
  SELECT r, m[i] AS hit, {number} AS kind,
    list_sum(list_transform(p[:i], lambda x: length(x)))::BIGINT
      + coalesce(list_sum(list_transform(m[:i - 1], lambda x: length(x))), 0)::BIGINT AS start
  FROM (SELECT r, m, p, unnest(range(1, len(m) + 1)) AS i FROM (
    SELECT r, regexp_extract_all(t, '{regex}') AS m, regexp_split_to_array(t, '{regex}') AS p FROM d))
  WHERE {least}"""


_SQL = (
    "WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents), s AS ("
    + " UNION ALL ".join(_spans_sql(rule, n) for n, rule in enumerate(RULES))
    + "), k AS (SELECT r, kind, start, ["
    + ", ".join(f"'{r.kind}'" for r in RULES)
    + """][kind + 1] || ':' || start || ':' || (start + length(hit)) AS span FROM s)
SELECT doc_id, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access,
  count(*) FILTER (WHERE kind = 2) AS n_hex,
  sha256(coalesce(string_agg(span, ',' ORDER BY start, kind) FILTER (WHERE kind < 3), '')) AS base_sha256,
  coalesce(string_agg(span, ',' ORDER BY start, kind), '') AS spans
FROM d LEFT JOIN k USING (r) GROUP BY r, doc_id"""
)


@query("op4_secret_scan", _SQL)
def op4_secret_scan(spark, sf_dir):
    """Secrets of every document."""
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.col("spans")
    base = F.filter(spans, lambda s: s["kind"].isin(*BASE_KINDS))

    def count(kind):
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(spans).alias("spans"),
    )
