"""Scalar columns over symbols, files and findings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codetrellis.functions import paths
from codetrellis.functions.rulebook import rules


def display_name(container: Column, name: Column) -> Column:
    """``container.name`` or ``name`` (P5)."""
    return F.concat_ws(".", container, name)


def span(line: Column, end_line: Column) -> Column:
    """Lines covered, at least one."""
    return F.greatest(F.lit(1), end_line - line + 1)


def node_weight(fan_in: Column, fan_out: Column) -> Column:
    """Size of a node in a drawing."""
    return F.lit(1.6) * fan_in + F.lit(0.5) * fan_out + F.lit(1.0)


def difficulty_score(branches: Column, max_nesting: Column, lines: Column) -> Column:
    """Paths, depth counted twice, and a little for length; integer arithmetic."""
    extra = F.floor(F.greatest(F.lit(0), lines - 20) / 15).cast("int")
    return branches + 1 + 2 * max_nesting + extra


def difficulty_rank(score: Column) -> Column:
    """0 easy, 1 moderate, 2 hard."""
    return F.when(score < 6, 0).when(score < 13, 1).otherwise(2)


def difficulty_band(score: Column) -> Column:
    return F.when(score < 6, "easy").when(score < 13, "moderate").otherwise("hard")


def classify_layer(path: Column, names: Column) -> Column:
    """Layer of a file from its path, then from its symbol names (P10).

    Rules are substring tests and their order decides: the first that holds wins.
    """
    low = F.lower(path)
    last = paths.basename(low)
    stem = paths.stem(last)
    layer = F.when(paths.contains_any(low, rules.TEST_MARKERS), "test").when(
        paths.contains_any(low, rules.CONFIG_MARKERS), "config"
    )
    in_path = ["/" + marker for marker in rules.ENTRY_MARKERS]
    ends = "(?:" + "|".join(rules.ENTRY_SUFFIXES) + ")$"
    layer = layer.when(
        paths.starts_with_any(last, rules.ENTRY_MARKERS) | paths.contains_any(low, in_path) | stem.rlike(ends),
        "entry",
    )
    for name, markers in rules.LAYER_PATH_MARKERS:
        layer = layer.when(paths.contains_any(low, markers), name)
    joined = F.lower(F.coalesce(F.array_join(names, " "), F.lit("")))
    for name, markers in rules.LAYER_NAME_MARKERS:
        layer = layer.when(paths.contains_any(joined, markers), name)
    return layer.otherwise("logic")


def _lookup(table: dict, key: Column) -> Column:
    pairs = [F.lit(v) for item in table.items() for v in item]
    return F.try_element_at(F.create_map(*pairs), key)


def layer_rank(layer: Column) -> Column:
    """Top-to-bottom position of a layer."""
    return _lookup(rules.LAYER_RANKS, layer)


def district(layer: Column) -> Column:
    """Interface, logic or data."""
    return _lookup({l: d for d, layers in rules.DISTRICTS.items() for l in layers}, layer)


def district_rank(layer: Column) -> Column:
    order = list(rules.DISTRICTS)
    return _lookup({l: order.index(d) for d, layers in rules.DISTRICTS.items() for l in layers}, layer)


def signature(path: Column, display: Column, line: Column) -> Column:
    """Mark that survives a new scan of unchanged code."""
    return F.concat_ws("#", path, display, line.cast("string"))


def drift_key(path: Column, display: Column) -> Column:
    return F.concat_ws("#", path, display)


def is_callable(kind: Column) -> Column:
    return kind != "type"


def looks_like_entry_or_test(path: Column, name: Column) -> Column:
    """A callable that nothing calls but that is probably not dead."""
    low = F.lower(path)
    base = paths.basename(low)
    return (
        name.isin(rules.UNREACHABLE_ENTRY_NAMES)
        | paths.starts_with_any(name, rules.UNREACHABLE_NAME_PREFIXES)
        | paths.contains_any(low, rules.UNREACHABLE_PATH_MARKERS)
        | base.startswith("test")
        | paths.contains_any(base, rules.UNREACHABLE_FILE_MARKERS)
    )


def is_readable(path: Column, kind: Column, is_external: Column) -> Column:
    """Part of the program proper, worth a step on a reading route."""
    return (
        ~is_external
        & is_callable(kind)
        & path.isNotNull()
        & ~paths.contains_any(F.lower(path), rules.UNREADABLE_PATH_MARKERS)
    )


def in_core_directory(path: Column) -> Column:
    """The path starts in a source folder or has no folder at all."""
    low = F.lower(path)
    return paths.starts_with_any(low, rules.CORE_DIRECTORIES) | ~low.contains("/")


def _shortened(n: Column, unit: int, decimals: int) -> Column:
    """``n / unit`` with ``decimals`` (0 or 1) digits, rounded as the binary quotient is.

    Halfway cases go by the side of the half the double lies on, and to the even
    digit when it is the half itself.
    """
    step = unit // 10**decimals
    digits, rest = F.floor(n / step), n % step
    quotient = n.cast("double") / float(unit)

    def side(bits: int) -> Column:
        # scaling by a power of two is exact, so both products are
        scaled = (quotient * float(2**bits)).cast("bigint").cast("decimal(38,0)")
        return F.sign(scaled * unit - n.cast("decimal(20,0)") * F.lit(2**bits).cast("decimal(17,0)"))

    lean = F.when(quotient < 1024, side(52)).otherwise(side(42))
    up = (rest * 2 > step) | ((rest * 2 == step) & ((lean > 0) | ((lean == 0) & (digits % 2 == 1))))
    rounded = digits + up.cast("int")
    if decimals == 0:
        return rounded.cast("string")
    return F.concat(F.floor(rounded / 10).cast("string"), F.lit("."), (rounded % 10).cast("string"))


def compact_count(n: Column) -> Column:
    """``1.2k``, ``12k``, ``1.2M``."""
    return (
        F.when(n >= 1_000_000, F.concat(_shortened(n, 1_000_000, 1), F.lit("M")))
        .when(n >= 10_000, F.concat(_shortened(n, 1_000, 0), F.lit("k")))
        .when(n >= 1_000, F.concat(_shortened(n, 1_000, 1), F.lit("k")))
        .otherwise(n.cast("string"))
    )


def compact_seconds(seconds: Column) -> Column:
    """Milliseconds below a second, seconds with two digits from there; halves to even."""
    return F.when(seconds < 1, F.format_string("%.0f ms", F.bround(seconds * 1000, 0))).otherwise(
        F.format_string("%.2f s", F.bround(seconds, 2))
    )


def difficulty_reason(branches: Column, max_nesting: Column, lines: Column) -> Column:
    """Numbers behind a difficulty, in words; parts that say nothing drop out."""
    branch_word = F.when(branches == 1, " branch").otherwise(" branches")
    return F.concat_ws(
        " · ",
        F.when(branches > 0, F.concat(branches.cast("string"), branch_word)),
        F.when(max_nesting > 2, F.concat(F.lit("nested "), max_nesting.cast("string"), F.lit(" deep"))),
        F.concat(lines.cast("string"), F.lit(" lines")),
    )
