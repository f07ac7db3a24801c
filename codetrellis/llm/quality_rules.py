"""Quality rules as a bitmask ledger.

Every rule is evaluated once per text. The ledger keeps the measurements and one
failure bit per rule; a policy is a versioned set of bits, so a verdict, and what
any single rule costs, come from the ledger without reading a text again. All of
it is row-local DataFrame work: no shuffle on the main path.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codetrellis.llm.registry import query, table

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 8


@dataclass(frozen=True)
class Rule:
    """``fails`` is SQL over the measurement columns; the position in the list is the bit."""

    name: str
    fails: str


#: fixed values: rules in bit order; append only, a bit never changes its meaning
RULES = [
    Rule("few_words", "n_words < 20"),
    Rule("repeated_words", "100 * n_repeat_words > 30 * n_words"),
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("duplicate_lines", "100 * n_dup_lines > 50 * n_lines"),
    Rule("word_length", "word_chars < 3 * n_words OR word_chars > 10 * n_words"),
    Rule("exclamations", "2 * n_exclamations > n_words"),
]


@dataclass(frozen=True)
class Policy:
    """The rules whose failure rejects a text; versions are kept side by side."""

    version: int
    rules: tuple[str, ...]

    def mask(self, rules: list[Rule] = RULES) -> int:
        names = [r.name for r in rules]
        return sum(1 << names.index(r) for r in self.rules)


BASE = Policy(1, ("few_words", "repeated_words"))
STRICT = Policy(2, tuple(r.name for r in RULES))


def _dropped_bytes(text: Column, characters: str) -> Column:
    """How often single-byte ``characters`` occur in ``text``."""
    total = F.lit(0)
    for c in characters:
        total = total + F.octet_length(text) - F.octet_length(F.replace(text, F.lit(c), F.lit("")))
    return total.cast("long")


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col`` and the measurements.

    A null text counts as empty (all measures 0); other columns are not read. A
    word window is compared by a 64-bit hash inside its own text only. Texts of
    fewer than eight words have no window. Repeated rows are measured each.
    """
    df = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    df = df.select(
        id_col,
        F.regexp_extract_all("_text", F.lit(WORD), F.lit(0)).alias("_words"),
        F.filter(F.split("_text", "\n"), lambda line: line.rlike(WORD)).alias("_lines"),
        _dropped_bytes(F.col("_text"), SYMBOLS).alias("n_symbols"),
        _dropped_bytes(F.col("_text"), "!").alias("n_exclamations"),
    )
    df = df.select(
        id_col,
        "n_symbols",
        "n_exclamations",
        F.size("_words").cast("long").alias("n_words"),
        F.aggregate("_words", F.lit(0).cast("long"), lambda n, w: n + F.length(w)).alias("word_chars"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.transform("_words", lambda w: F.xxhash64(w)).alias("_codes"),
    )
    df = df.withColumn(
        "_windows",
        F.when(
            F.size("_codes") >= WINDOW,
            F.transform(
                F.sequence(F.lit(1), F.size("_codes") - (WINDOW - 1)),
                lambda i: F.xxhash64(F.slice("_codes", i, WINDOW)),
            ),
        ).otherwise(F.array().cast("array<bigint>")),
    )
    repeats = F.size(F.array_distinct("_windows")) < F.size("_windows")
    df = df.withColumn(
        "_sorted",
        F.when(
            repeats,
            F.array_sort(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")),
    )
    sorted_ = F.col("_sorted")
    df = df.withColumn(
        "_starts",
        F.array_sort(
            F.transform(
                F.filter(
                    sorted_,
                    lambda e, j: (e["h"] == F.get(sorted_, j - 1)["h"])
                    | (e["h"] == F.get(sorted_, j + 1)["h"]),
                ),
                lambda e: e["i"],
            )
        ),
    )
    starts = F.col("_starts")
    covered = F.aggregate(
        F.transform(
            starts, lambda s, j: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, j + 1) - s, F.lit(WINDOW)))
        ),
        F.lit(0).cast("long"),
        lambda n, x: n + x,
    )
    return df.withColumn("n_repeat_words", covered).drop("_codes", "_windows", "_sorted", "_starts")


def ledger(docs: DataFrame, rules: list[Rule] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Measurements and ``failure_bits`` of every row of ``docs`` (see ``measure``)."""
    bits = F.lit(0).cast("long")
    for bit, rule in enumerate(rules):
        bits = bits.bitwiseOR(F.when(F.expr(rule.fails), F.lit(1 << bit)).otherwise(F.lit(0)).cast("long"))
    return measure(docs, id_col, text_col).withColumn("failure_bits", bits)


def kept(policy: Policy, rules: list[Rule] = RULES) -> Column:
    """Verdict of a policy on a ledger row."""
    return F.col("failure_bits").bitwiseAND(F.lit(policy.mask(rules))) == 0


def ablation(book: DataFrame, policies: list[Policy], rules: list[Rule] = RULES) -> DataFrame:
    """Per policy and rule: texts failing the rule, kept, and kept if the rule were dropped.

    Rows are first counted per distinct bitmask (at most 2^rules of them, summed
    before the shuffle), so a hot source costs nothing. An empty ledger gives 0s.
    """
    counts = book.groupBy("failure_bits").agg(F.count(F.lit(1)).alias("_n"))
    plan = [
        (p.version, r.name, 1 << b, p.mask(rules)) for p in policies for b, r in enumerate(rules) if r.name in p.rules
    ]
    cells = book.sparkSession.createDataFrame(plan, "version int, rule string, _bit long, _mask long")
    every = F.array(
        *[
            F.struct(F.lit(v).alias("version"), F.lit(r).alias("rule"), F.lit(b).alias("bit"), F.lit(m).alias("mask"))
            for v, r, b, m in plan
        ]
    )
    bits, at = F.col("failure_bits"), F.col("_cell")

    def total(condition):
        return F.sum(F.when(condition, F.col("_n")).otherwise(0))

    sums = (
        counts.withColumn("_cell", F.explode(every))
        .groupBy(at["version"].alias("version"), at["rule"].alias("rule"))
        .agg(
            total(bits.bitwiseAND(at["bit"].cast("long")) != 0).alias("n_failing"),
            total(bits.bitwiseAND(at["mask"].cast("long")) == 0).alias("n_kept"),
            total(bits.bitwiseAND((at["mask"] - at["bit"]).cast("long")) == 0).alias("n_kept_without"),
        )
    )
    return cells.select("version", "rule").join(sums, ["version", "rule"], "left").fillna(0)


_LEDGER_SQL = r"""
WITH w AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls
  FROM documents),
win AS (
  SELECT r, u.p AS p, u.k AS k FROM (
    SELECT r, unnest(list_transform(range(1, len(ws) - 6), lambda i: {'p': i, 'k': array_to_string(ws[i:i + 7], ' ')})) AS u
    FROM w WHERE len(ws) >= 8)),
rep AS (SELECT r, p FROM (SELECT r, p, count(*) OVER (PARTITION BY r, k) AS c FROM win) WHERE c > 1),
cov AS (SELECT r, sum(least(8, gap)) AS n FROM (
  SELECT r, coalesce(lead(p) OVER (PARTITION BY r ORDER BY p) - p, 8) AS gap FROM rep) GROUP BY r),
m AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words,
    coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (length(t) - length(replace(t, '!', '')))::BIGINT AS n_exclamations,
    len(ls)::BIGINT AS n_lines,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
    coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN cov USING (r)),
f AS (
  SELECT *, (CASE WHEN n_words < 20 THEN 1 ELSE 0 END
    + CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END
    + CASE WHEN 100 * n_dup_lines > 50 * n_lines THEN 8 ELSE 0 END
    + CASE WHEN word_chars < 3 * n_words OR word_chars > 10 * n_words THEN 16 ELSE 0 END
    + CASE WHEN 2 * n_exclamations > n_words THEN 32 ELSE 0 END)::BIGINT AS failure_bits
  FROM m)
"""


@query(
    "op8_quality_rules",
    _LEDGER_SQL
    + """SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed, failure_bits = 0 AS kept, failure_bits
FROM f""",
)
def op8_quality_rules(spark, sf_dir):
    """Every document judged by all rules."""
    book = ledger(table(spark, sf_dir, "documents"))
    return book.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        (~kept(BASE)).alias("base_failed"),
        kept(STRICT).alias("kept"),
        "failure_bits",
    )


@query(
    "quality_ablation",
    _LEDGER_SQL
    + """, p(version, rule, bit, mask) AS (VALUES (1, 'few_words', 1, 3), (1, 'repeated_words', 2, 3),
  (2, 'few_words', 1, 63), (2, 'repeated_words', 2, 63), (2, 'symbols', 4, 63), (2, 'duplicate_lines', 8, 63),
  (2, 'word_length', 16, 63), (2, 'exclamations', 32, 63))
SELECT version, rule, count(*) FILTER (WHERE failure_bits & bit <> 0) AS n_failing,
  count(*) FILTER (WHERE failure_bits & mask = 0) AS n_kept,
  count(*) FILTER (WHERE failure_bits & (mask - bit) = 0) AS n_kept_without
FROM f, p GROUP BY ALL""",
)
def quality_ablation(spark, sf_dir):
    """What each rule of both policies rejects, and what dropping it would keep."""
    return ablation(ledger(table(spark, sf_dir, "documents")), [BASE, STRICT])
