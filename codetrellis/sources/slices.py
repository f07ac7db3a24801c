"""Line ranges of source text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codetrellis.session import REPO_KEYS


def slice_lines(content: Column, first: Column, last: Column) -> Column:
    """``struct(first_line, line_count, text)`` of a 1-based inclusive range, clamped."""
    lines = F.split(content, "\n")
    total = F.size(lines)
    start = F.greatest(F.lit(0), F.least(first - 1, total))
    end = F.greatest(start, F.least(last, total))
    return F.struct(
        (start + 1).alias("first_line"),
        (end - start).alias("line_count"),
        F.array_join(F.slice(lines, start + 1, end - start), "\n").alias("text"),
    )


def line_slices(files: DataFrame, requests: DataFrame) -> DataFrame:
    """Answer a table of ``(repo, snap, path, first, last)`` requests."""
    asked = files.select(*REPO_KEYS, "path", "content").join(requests, REPO_KEYS + ["path"])
    piece = slice_lines(F.col("content"), F.col("first"), F.col("last"))
    return asked.select(*REPO_KEYS, "path", "first", "last", piece.alias("s")).select(
        *REPO_KEYS, "path", "first", "last", "s.*"
    )
