"""What moved between scans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codetrellis.functions import scores
from codetrellis.session import REPO_KEYS, consecutive, top_k

# fixed values: what counts as a movement, and how many of them a report shows
MIN_SPAN_CHANGE = 12
MIN_CALLER_CHANGE = 2
MIN_COMING_OR_GOING = 3
REPORT_ENTRIES = 8


def scan_record(symbols: DataFrame) -> DataFrame:
    """``history`` rows of a scan: span, branches, callers per drift key.

    Of several symbols with one key the last in the project counts.
    """
    key = scores.drift_key(F.col("path"), F.col("display"))
    callables = symbols.filter(~F.col("is_external") & scores.is_callable(F.col("kind")))
    return (
        callables.groupBy(*REPO_KEYS, key.alias("sym_key"))
        .agg(F.max(F.struct("sym_id", "span", "branches", F.col("fan_in").alias("callers"))).alias("r"))
        .select(*REPO_KEYS, "sym_key", "r.span", "r.branches", "r.callers")
    )


def cycle_record(components: DataFrame, modules: DataFrame) -> DataFrame:
    """``history_cycles`` rows: the sorted file names of each cycle.

    A cycle has at most as many members as the file graph keeps files.
    """
    named = components.join(modules.select(*REPO_KEYS, "path", "name"), REPO_KEYS + ["path"])
    return named.groupBy(*REPO_KEYS, "comp").agg(
        F.array_join(F.array_sort(F.collect_list("name")), "|").alias("cycle_key")
    ).drop("comp")


def successions(scans: DataFrame) -> DataFrame:
    """``(repo, previous, snap)`` for every scan that has a predecessor (K3)."""
    pairs = consecutive(scans.select("repo", "snap", "scanned_at").distinct(), ["repo"], ["scanned_at", "snap"])
    return pairs.select("repo", F.col("snap").alias("previous"), F.col("next_snap").alias("snap"))


def _both_scans(history: DataFrame, pairs: DataFrame, key: str, values: list[str]) -> DataFrame:
    """Rows of the current and the previous scan side by side, one shuffle by (repo, snap, key)."""
    value = F.struct(F.lit(True).alias("present"), *values)
    now = history.join(pairs.select(*REPO_KEYS), REPO_KEYS, "left_semi").select(
        *REPO_KEYS, key, value.alias("now"), F.lit(None).alias("then")
    )
    before = (
        history.withColumnRenamed("snap", "previous")
        .join(pairs, ["repo", "previous"])
        .select(*REPO_KEYS, key, F.lit(None).alias("now"), value.alias("then"))
    )
    return now.unionByName(before).groupBy(*REPO_KEYS, key).agg(F.max("now").alias("now"), F.max("then").alias("then"))


def compare(
    history: DataFrame,
    cycles: DataFrame,
    pairs: DataFrame,
    limit: int | None = None,
) -> DataFrame:
    """Drift entries of every scan against its predecessor, or the ``limit`` largest.

    ``history(repo, snap, sym_key, span, branches, callers)``,
    ``cycles(repo, snap, cycle_key)``, ``pairs(repo, previous, snap)``. A scan
    that is not in ``pairs`` is a first scan and has no entries.
    """
    matched = _both_scans(history, pairs, "sym_key", ["span", "branches", "callers"])
    spans = F.col("now.span") - F.col("then.span")
    callers = F.col("now.callers") - F.col("then.callers")
    branches = F.col("now.branches") - F.col("then.branches")

    def entry(kind, delta, detail):
        return F.struct(
            kind.alias("kind"), delta.cast("bigint").alias("delta"), detail.cast("string").alias("detail")
        )

    moved = F.filter(
        F.array(
            F.when(
                F.abs(spans) >= MIN_SPAN_CHANGE,
                entry(
                    F.when(spans > 0, "grew").otherwise("shrank"),
                    spans,
                    F.when(branches != 0, branches.cast("string")).otherwise(""),
                ),
            ),
            F.when(
                F.abs(callers) >= MIN_CALLER_CHANGE,
                entry(F.when(callers > 0, "gainedCallers").otherwise("lostCallers"), callers, F.lit("")),
            ),
        ),
        lambda e: e.isNotNull(),
    )
    both = matched.filter("now IS NOT NULL AND then IS NOT NULL")
    changed = both.select(
        *REPO_KEYS, F.substring_index("sym_key", "#", -1).alias("subject"), F.explode(moved).alias("e")
    ).select(*REPO_KEYS, "subject", "e.*")
    totals = matched.groupBy(*REPO_KEYS).agg(
        F.count_if(F.col("then").isNull()).alias("appeared"), F.count_if(F.col("now").isNull()).alias("vanished")
    )
    came_or_went = totals.select(
        *REPO_KEYS,
        F.lit("").alias("subject"),
        F.explode(
            F.array(
                entry(F.lit("appeared"), F.col("appeared"), F.lit("")),
                entry(F.lit("vanished"), -F.col("vanished"), F.lit("")),
            )
        ).alias("e"),
    ).select(*REPO_KEYS, "subject", "e.*").filter(F.abs("delta") >= MIN_COMING_OR_GOING)
    new_cycles = (
        _both_scans(cycles.distinct(), pairs, "cycle_key", [])
        .filter("then IS NULL")
        .select(
            *REPO_KEYS,
            F.array_join(F.slice(F.split("cycle_key", "\\|"), 1, 3), " → ").alias("subject"),
            F.lit("newCycle").alias("kind"),
            F.lit(1).cast("bigint").alias("delta"),
            F.lit("").alias("detail"),
        )
    )
    entries = reduce(DataFrame.unionByName, [new_cycles, changed, came_or_went])
    return with_flags(top_k(entries, REPO_KEYS, report_order(), limit, "place"))


def report_order() -> list:
    """New cycles first, then the largest movements."""
    return [(F.col("kind") != "newCycle"), F.abs("delta").desc(), "kind", "subject", "detail"]


def with_flags(entries: DataFrame) -> DataFrame:
    """Which entries are for the worse and which for the better."""
    return entries.withColumn("regression", F.col("kind").isin("newCycle", "gainedCallers")).withColumn(
        "improvement", F.col("kind").isin("lostCallers", "shrank")
    )
