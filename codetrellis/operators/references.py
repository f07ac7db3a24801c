"""References between files: finding them (X17-X20, P13, P14) and resolving them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codetrellis.functions import paths
from codetrellis.functions.rulebook import rules
from codetrellis.session import REPO_KEYS


def is_local(reference: Column) -> Column:
    """The reference names something inside the project."""
    return (
        (F.length(reference) > 0)
        & (F.length(reference) < rules.MAX_REFERENCE_LENGTH)
        & ~paths.starts_with_any(reference, rules.REMOTE_PREFIXES)
    )


def without_query(reference: Column) -> Column:
    """Text before the first question mark."""
    return F.substring_index(reference, "?", 1)


def _attribute(content: Column, name: str) -> Column:
    pattern = f"(?<![^ \\t\\n]){name}=(?:\"([^\"]*+)(?:\"|\\z)|'([^']*+)(?:'|\\z))"
    return F.transform(
        F.arrays_zip(
            F.regexp_extract_all(content, F.lit(pattern), F.lit(1)).alias("a"),
            F.regexp_extract_all(content, F.lit(pattern), F.lit(2)).alias("b"),
        ),
        lambda m: F.concat(m["a"], m["b"]),
    )


def attribute_references(content: Column) -> Column:
    """Values of ``src`` and ``href`` attributes."""
    return F.concat(_attribute(content, "src"), _attribute(content, "href"))


def import_reference(line: Column) -> Column:
    """First quoted or bracketed text of an import line (X18); null when there is none."""
    return (
        F.when(line.rlike('"[^"]*"'), F.regexp_extract(line, '"([^"]*)"', 1))
        .when(line.rlike("'[^']*'"), F.regexp_extract(line, "'([^']*)'", 1))
        .when(line.rlike("<[^>]*>"), F.regexp_extract(line, "<([^>]*)>", 1))
    )


def import_references(content: Column, markers: list[str]) -> Column:
    lines = F.filter(F.split(content, "\n"), lambda line: paths.contains_any(line, markers))
    return F.filter(F.transform(lines, import_reference), lambda ref: ref.isNotNull())


def url_references(content: Column) -> Column:
    """Targets of ``url(…)``."""
    return F.transform(
        F.regexp_extract_all(content, F.lit("url\\(([^)]*+)\\)"), F.lit(1)),
        lambda value: F.regexp_replace(value, "^[\"' ]+|[\"' ]+$", ""),
    )


def python_reference(line: Column, strip_comma: bool = False) -> Column:
    """Module of an import line as a relative path (X20); null when there is none.

    ``import a, b`` gives ``a,`` as it stands; ``strip_comma`` drops the comma.
    """
    text = F.regexp_replace(line, "^[ \\t]+|[ \\t]+$", "")
    module = F.regexp_extract(text, "^(?:from|import) ([^ ]*)", 1)
    if strip_comma:
        module = F.regexp_replace(module, ",+$", "")
    dots = F.length(F.regexp_extract(module, "^(\\.*)", 1))
    name = F.translate(F.regexp_replace(module, "^\\.+", ""), ".", "/")
    climb = F.repeat(F.lit("../"), F.greatest(F.lit(0), dots - 1))
    return F.when(text.rlike("^(?:from|import) ") & (name != ""), F.concat(climb, name))


def python_references(content: Column, strip_comma: bool = False) -> Column:
    lines = F.filter(F.split(content, "\n"), lambda line: line.rlike("^[ \\t]*(?:from|import) "))
    return F.filter(
        F.transform(lines, lambda line: python_reference(line, strip_comma)), lambda ref: ref.isNotNull()
    )


def references(files: DataFrame, strip_comma: bool = False) -> DataFrame:
    """``(repo, snap, path, reference)`` as written, one row per place."""
    language, content = F.col("language"), F.col("content")
    script = import_references(content, ["from", "require(", "import("])
    found = (
        F.when(language.isin("html", "vue", "svelte"), attribute_references(content))
        .when(
            language.isin("css", "scss"),
            F.concat(F.filter(import_references(content, ["@import"]), is_local), url_references(content)),
        )
        .when(
            language.isin("javascript", "typescript"),
            F.concat(script, import_references(content, ["import"])),
        )
        .when(language == "python", python_references(content, strip_comma))
        .when(language.isin("c", "cpp"), import_references(content, ["#include"]))
    )
    rows = files.select(*REPO_KEYS, "path", "language", F.explode(found).alias("reference"))
    # module names of Python are paths by construction
    return rows.filter((F.col("language") == "python") | is_local(F.col("reference"))).drop("language")


def resolve_references(refs: DataFrame, files: DataFrame) -> DataFrame:
    """``file_refs(repo, snap, src_path, dst_path)``, distinct, without self-references.

    A written path is tried next to the file and then as it stands; each with
    every extension and then every index form. Instead of exploding references
    into forty candidates, each *file* lists the few names it answers to, best
    form first; the candidate join is then an equi-join with one row per name.
    """
    forms = F.array(
        *[
            F.struct(F.lit(suffix).alias("suffix"), F.lit(rank).alias("form"))
            for rank, suffix in enumerate(dict.fromkeys(rules.REFERENCE_EXTENSIONS + rules.REFERENCE_INDEX_FORMS))
        ]
    )
    # a path is standardized once, then met with every form; an array of its names would be made anew for each
    named = files.select(*REPO_KEYS, F.col("path").alias("dst_path"), paths.standardize(F.col("path")).alias("_target"))
    named = named.select("*", F.explode(forms).alias("n")).filter(F.col("_target").endswith(F.col("n.suffix")))
    answers = (
        named.groupBy(*REPO_KEYS, F.left("_target", F.length("_target") - F.length("n.suffix")).alias("base"))
        .agg(F.min_by("dst_path", F.struct("n.form", "dst_path")).alias("dst_path"))
    )
    written = without_query(F.col("reference"))
    beside = paths.join_path(paths.dirname(F.col("path")), written)
    bases = F.when(
        written.startswith("/"), F.array(F.substr(written, F.lit(2)))
    ).otherwise(F.array(beside, written))
    wanted = refs.select(*REPO_KEYS, "path", "reference").distinct().select(
        *REPO_KEYS,
        F.col("path").alias("src_path"),
        "reference",
        F.posexplode(F.transform(bases, paths.standardize)).alias("turn", "base"),
    )
    hits = wanted.join(answers, REPO_KEYS + ["base"])
    chosen = hits.groupBy(*REPO_KEYS, "src_path", "reference").agg(
        F.min_by("dst_path", "turn").alias("dst_path")
    )
    return chosen.filter("src_path <> dst_path").select(*REPO_KEYS, "src_path", "dst_path").distinct()
