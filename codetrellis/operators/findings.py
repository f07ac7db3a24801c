"""Places worth looking at."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codetrellis.functions import scores
from codetrellis.functions.rulebook import rules
from codetrellis.operators.graph import roots
from codetrellis.session import REPO_KEYS, cut, top_k

LOW, MEDIUM, HIGH = 0, 1, 2


@dataclass(frozen=True)
class Limits:
    # fixed values: thresholds of the findings
    max_functions_per_file: int = 45
    max_lines_per_file: int = 900
    complexity_score: int = 22
    god_function_callers: int = 45
    min_unreachable_span: int = 4
    # report limits, off unless asked for
    max_per_kind: int | None = None
    max_cycles: int | None = None
    max_unreachable: int | None = None


# fixed values: what a report shows
REPORT = Limits(max_per_kind=12, max_cycles=6, max_unreachable=40)


def _finding(
    df: DataFrame, kind: str, severity: Column, subject: Column, measure: Column, path: Column,
    line: Column, sym_id: Column, detail: Column | None = None,
) -> DataFrame:
    return df.select(
        *REPO_KEYS,
        F.lit(kind).alias("kind"),
        severity.cast("int").alias("severity"),
        subject.alias("subject"),
        measure.cast("bigint").alias("measure"),
        (measure.cast("string") if detail is None else detail).alias("detail"),
        path.alias("path"),
        line.cast("int").alias("line"),
        sym_id.cast("bigint").alias("sym_id"),
    )


def ranked_cycles(components: DataFrame) -> DataFrame:
    """Size and first file of each cycle, largest first (order of G5)."""
    return components.groupBy(*REPO_KEYS, "comp").agg(
        F.count(F.lit(1)).alias("size"), F.min("path").alias("first_path")
    )


def cycle_findings(components: DataFrame, modules: DataFrame, limits: Limits) -> DataFrame:
    """``components`` is ``(repo, snap, comp, path)``."""
    first = top_k(
        ranked_cycles(components), REPO_KEYS, [F.col("size").desc(), F.col("first_path")], limits.max_cycles, "turn"
    )
    members = components.join(first.select(*REPO_KEYS, "comp"), REPO_KEYS + ["comp"], "left_semi").join(
        modules.select(*REPO_KEYS, "path", "name", "top_symbols"), REPO_KEYS + ["path"]
    )
    named = (
        top_k(members, REPO_KEYS + ["comp"], ["path"], 4)
        .groupBy(*REPO_KEYS, "comp")
        .agg(
            F.array_join(
                F.array_sort(F.collect_list(F.struct("rank", "name"))).getField("name"), " → "
            ).alias("subject"),
            F.min_by(F.get("top_symbols", F.lit(0)), "rank").alias("sym_id"),
        )
    )
    return _finding(
        first.join(named, REPO_KEYS + ["comp"]),
        "cycle",
        F.when(F.col("size") > 3, HIGH).otherwise(MEDIUM),
        F.col("subject"),
        F.col("size"),
        F.col("first_path"),
        F.lit(1),
        F.col("sym_id"),
    )


def oversized_files(modules: DataFrame, limits: Limits) -> DataFrame:
    """Too many symbols, or else too many lines."""
    many = F.col("symbol_count") > limits.max_functions_per_file
    long = F.col("lines") > limits.max_lines_per_file
    return _finding(
        modules.filter(many | long),
        "oversizedFile",
        F.when(F.col("symbol_count") > 2 * limits.max_functions_per_file, HIGH).when(many, MEDIUM).otherwise(LOW),
        F.col("name"),
        F.when(many, F.col("symbol_count")).otherwise(F.col("lines")),
        F.col("path"),
        F.lit(1),
        F.get("top_symbols", F.lit(0)),
    )


def complex_functions(symbols: DataFrame, limits: Limits) -> DataFrame:
    """Hard to read; ranked by the number of branches."""
    score = F.col("score")
    kept = symbols.filter(
        ~F.col("is_external")
        & scores.is_callable(F.col("kind"))
        & (score >= limits.complexity_score)
        & ~F.lower("path").contains("test")
    )
    detail = F.concat_ws(" · ", *[F.col(c).cast("string") for c in ("branches", "max_nesting", "span")])
    return _finding(
        kept,
        "complexFunction",
        F.when(score >= 2 * limits.complexity_score, HIGH).otherwise(MEDIUM),
        F.col("display"),
        F.col("branches"),
        F.col("path"),
        F.col("line"),
        F.col("sym_id"),
        detail,
    )


def god_functions(symbols: DataFrame, limits: Limits) -> DataFrame:
    """The whole project leans on these (U4)."""
    kept = symbols.filter(~F.col("is_external") & (F.col("fan_in") >= limits.god_function_callers))
    return _finding(
        kept, "godFunction", F.lit(LOW), F.col("display"), F.col("fan_in"), F.col("path"), F.col("line"), F.col("sym_id")
    )


def layer_violations(
    modules: DataFrame, module_edges: DataFrame, forbidden: list[tuple[str, str]] | None = None
) -> DataFrame:
    """Edges between layers that should not meet."""
    pairs = [f"{a}>{b}" for a, b in (forbidden or rules.FORBIDDEN_LAYERS)]
    side = [*REPO_KEYS, "path", "name", "layer", "top_symbols"]
    src = modules.select(*side).withColumnsRenamed(
        {"path": "src_path", "name": "src_name", "layer": "src_layer", "top_symbols": "src_top"}
    )
    dst = modules.select(*side).withColumnsRenamed(
        {"path": "dst_path", "name": "dst_name", "layer": "dst_layer", "top_symbols": "dst_top"}
    )
    crossing = (
        module_edges.join(src, REPO_KEYS + ["src_path"])
        .join(dst, REPO_KEYS + ["dst_path"])
        .filter(F.concat_ws(">", "src_layer", "dst_layer").isin(pairs))
    )
    return _finding(
        crossing,
        "layerViolation",
        F.lit(MEDIUM),
        F.concat_ws(" → ", "src_name", "dst_name"),
        F.col("weight"),
        F.col("src_path"),
        F.lit(1),
        F.get("src_top", F.lit(0)),
    )


def unreachable(symbols: DataFrame) -> DataFrame:
    """Callables nothing calls that do not look like entry points or tests."""
    return roots(symbols).filter(~scores.looks_like_entry_or_test(F.col("path"), F.col("name")))


def unreachable_findings(symbols: DataFrame, limits: Limits) -> DataFrame:
    """With a limit, it comes before the filter on length."""
    first = top_k(unreachable(symbols), REPO_KEYS, ["sym_id"], limits.max_unreachable).drop("rank")
    return _finding(
        first.filter(F.col("span") >= limits.min_unreachable_span),
        "unreachable",
        F.lit(LOW),
        F.col("display"),
        F.col("span"),
        F.col("path"),
        F.col("line"),
        F.col("sym_id"),
    )


def find_issues(
    symbols: DataFrame,
    modules: DataFrame,
    module_edges: DataFrame,
    components: DataFrame,
    limits: Limits = Limits(),
) -> DataFrame:
    """All findings; with a limit the worst ``max_per_kind`` of each kind per repository.

    ``place`` is the order of the list: severity, then kind, then rank. ``of_kind`` is
    the true number of findings of the kind, whatever is shown.
    """
    everything = reduce(
        DataFrame.unionByName,
        [
            cycle_findings(components, modules, limits),
            oversized_files(modules, limits),
            complex_functions(symbols, limits),
            god_functions(symbols, limits),
            layer_violations(modules, module_edges),
            unreachable_findings(symbols, limits),
        ],
    )
    worst = [F.col("severity").desc(), F.col("measure").desc(), "path", "line", "subject"]
    everything = cut(everything)  # read twice: to count and to rank
    total = everything.groupBy(*REPO_KEYS, "kind").agg(F.count(F.lit(1)).alias("of_kind"))
    kept = top_k(everything, REPO_KEYS + ["kind"], worst, limits.max_per_kind)
    place = [F.col("severity").desc(), "kind", "rank"]
    return top_k(kept.join(total, REPO_KEYS + ["kind"]), REPO_KEYS, place, None, "place")


def finding_counts(findings: DataFrame) -> DataFrame:
    """Findings of the given list per repository: total and per severity (A10)."""
    return findings.groupBy(*REPO_KEYS).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("severity") == HIGH).alias("high"),
        F.count_if(F.col("severity") == MEDIUM).alias("medium"),
        F.count_if(F.col("severity") == LOW).alias("low"),
    )


def measurement(kind: Column, detail: Column) -> Column:
    """The numbers of a finding with their nouns."""
    part = F.split(detail, " · ")
    return (
        F.when(
            (kind == "complexFunction") & (F.size(part) == 3),
            F.concat_ws(
                " · ",
                F.concat(F.get(part, F.lit(0)), F.lit(" branches")),
                F.concat(F.get(part, F.lit(1)), F.lit(" deep")),
                F.concat(F.get(part, F.lit(2)), F.lit(" lines")),
            ),
        )
        .when(kind == "godFunction", F.concat(detail, F.lit(" callers")))
        .when(kind == "unreachable", F.concat(detail, F.lit(" lines")))
        .when(kind == "cycle", F.concat(detail, F.lit(" files")))
        .when(kind == "layerViolation", F.concat(detail, F.lit(" calls")))
        .otherwise(detail)
    )
