"""Path column functions: purely lexical, separators are ``/``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize(path: Column) -> Column:
    """Fold backslashes to forward slashes."""
    return F.translate(path, "\\", "/")


def clean(path: Column) -> Column:
    """Collapse repeated separators and drop trailing ones; a lone ``/`` stays."""
    return F.regexp_replace(F.regexp_replace(normalize(path), "/{2,}", "/"), "(?<=.)/$", "")


def basename(path: Column) -> Column:
    plain = normalize(path)
    return F.when(plain.rlike("^/+$"), F.lit("/")).otherwise(
        F.substring_index(F.rtrim(plain, F.lit("/")), "/", -1)
    )


def dirname(path: Column) -> Column:
    """Everything before the last separator; empty for a bare name."""
    tidy = clean(path)
    return F.when(tidy.rlike("^/[^/]*$"), F.lit("/")).otherwise(
        F.regexp_extract(tidy, "^(.+)/[^/]*$", 1)
    )


def extension(path: Column) -> Column:
    """Text after the last dot; a leading or trailing dot is no extension."""
    return F.regexp_extract(normalize(path), "[^/]\\.([^./]++)/*+$", 1)


def stem(path: Column) -> Column:
    """The path without its extension."""
    tidy = clean(path)
    ext = extension(path)
    return F.when(ext == "", tidy).otherwise(
        F.left(tidy, F.length(tidy) - F.length(ext) - F.lit(1))
    )


def join_path(base: Column, part: Column) -> Column:
    """Join with exactly one separator; an empty side adds none."""
    left = normalize(base)
    right = normalize(part)
    return (
        F.when(left == "", right)
        .when(right == "", left)
        .otherwise(
            F.concat(F.regexp_replace(left, "/$", ""), F.lit("/"), F.regexp_replace(right, "^/", ""))
        )
    )


def standardize(path: Column) -> Column:
    """Resolve ``.`` and ``..`` without touching a disk.

    A leading ``..`` of a relative path has nothing to pop and stays.
    """
    plain = normalize(path)
    parts = F.filter(F.split(plain, "/"), lambda part: (part != "") & (part != "."))
    rooted = plain.startswith("/")

    def step(stack: Column, part: Column) -> Column:
        top = F.try_element_at(stack, F.lit(-1))
        poppable = (F.size(stack) > 0) & (top != "..")
        return (
            F.when(part != "..", F.concat(stack, F.array(part)))
            .when(poppable, F.slice(stack, F.lit(1), F.greatest(F.size(stack) - 1, F.lit(0))))
            .when(rooted, stack)
            .otherwise(F.concat(stack, F.array(part)))
        )

    folded = F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")
    needs_folding = plain.contains("./") | plain.endswith("/.") | plain.endswith("/..") | plain.contains("//")
    trimmed = F.when(F.length(plain) > 1, F.regexp_replace(plain, "/$", "")).otherwise(plain)
    return F.when(needs_folding, F.concat(F.when(rooted, F.lit("/")).otherwise(F.lit("")), folded)).otherwise(trimmed)


def is_absolute(path: Column) -> Column:
    return normalize(path).rlike("^(/|\\p{L}:)")


def contains_any(text: Column, markers: list[str]) -> Column:
    """True when any marker occurs in ``text`` as it is written."""
    quoted = "|".join("\\Q" + marker + "\\E" for marker in markers)
    return text.rlike(quoted)


def starts_with_any(text: Column, markers: list[str]) -> Column:
    quoted = "|".join("\\Q" + marker + "\\E" for marker in markers)
    return text.rlike("^(?:" + quoted + ")")
