"""Source files as a table: reading, filtering, decoding."""

from __future__ import annotations

import os
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codetrellis.functions import paths
from codetrellis.functions.rulebook import rules
from codetrellis.session import REPO_KEYS, top_k

FILE_KEY = ["f1", "f2"]


def language_of(path: Column) -> Column:
    """Language by lower-cased extension, null when it is not one we read."""
    pairs = [
        F.lit(value)
        for language, extensions in rules.LANGUAGE_EXTENSIONS.items()
        for ext in extensions
        for value in (ext, language)
    ]
    return F.try_element_at(F.create_map(*pairs), F.lower(paths.extension(path)))


def java_quoted(text: str) -> str:
    """A pattern of Java that matches ``text`` alone."""
    return "".join(c if c.isalnum() or ord(c) > 127 else f"\\x{{{ord(c):x}}}" for c in text)


def in_skipped_directory(path: Column) -> Column:
    """A directory of the path is vendored or generated; the file name does not count."""
    return path.rlike(f"(?:^|/)(?:{'|'.join(map(java_quoted, rules.SKIPPED_DIRECTORIES))})/")


def is_hidden(path: Column) -> Column:
    """A part of the path starts with a dot."""
    return path.rlike("(^|/)[.]")


def is_test_path(path: Column) -> Column:
    """Scan-time test filter."""
    low = F.lower(path)
    return low.contains("/test") | low.startswith("test") | low.contains("spec.")


def decode_text(data: Column) -> Column:
    """UTF-8 where it is valid, Latin-1 otherwise."""
    return F.when(F.is_valid_utf8(data.cast("string")), F.decode(data, "UTF-8")).otherwise(
        F.decode(data, "ISO-8859-1")
    )


def normalize_newlines(text: Column) -> Column:
    """Every line ending becomes ``\\n``."""
    return F.regexp_replace(text, "\r\n?", "\n")


def relative_path(path: Column, root: str) -> Column:
    """Path below ``root`` with ``/`` separators."""
    whole = paths.normalize(path)
    base = root.replace("\\", "/").rstrip("/") + "/"
    return F.when(whole.startswith(base), F.substr(whole, F.lit(len(base) + 1))).otherwise(whole)


def line_count(text: Column) -> Column:
    """Newlines plus one."""
    return (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("bigint")


def select_files(
    files: DataFrame,
    *,
    include_tests: bool = True,
    max_bytes: int | None = rules.MAX_FILE_BYTES,
    max_files: int | None = None,
    skip_hidden: bool = True,
) -> DataFrame:
    """Scan rules over ``files(repo, snap, path, content)``: S1-S6.

    ``content`` may be text or bytes; ``bytes`` is used when the source has it.
    ``max_files`` is off unless asked for; it keeps the first files in path order.
    ``max_bytes`` may be ``None``; ``oversized_files`` lists what it leaves out.
    """
    size = F.col("bytes") if "bytes" in files.columns else F.octet_length("content")
    kept = files.withColumn("path", paths.normalize(F.col("path")))
    kept = kept.filter(~in_skipped_directory(F.col("path")))
    if max_bytes is not None:
        kept = kept.filter(size <= max_bytes)
    if skip_hidden:
        kept = kept.filter(~is_hidden(F.col("path")))
    if not include_tests:
        kept = kept.filter(~is_test_path(F.col("path")))
    kept = kept.withColumn("language", language_of(F.col("path"))).filter("language IS NOT NULL")
    if max_files is not None:
        first = top_k(kept.select(*REPO_KEYS, "path"), REPO_KEYS, ["path"], max_files)
        kept = kept.join(first.drop("rank"), REPO_KEYS + ["path"], "left_semi")
    return kept


def oversized_files(files: DataFrame, max_bytes: int = rules.MAX_FILE_BYTES) -> DataFrame:
    """``repo, snap, path, bytes`` of the files that the size limit leaves out (S3)."""
    size = F.col("bytes") if "bytes" in files.columns else F.octet_length("content")
    return files.select(*REPO_KEYS, paths.normalize(F.col("path")).alias("path"), size.cast("bigint").alias("bytes")).filter(
        (F.col("bytes") > max_bytes) & ~in_skipped_directory(F.col("path"))
    )


def with_text(files: DataFrame) -> DataFrame:
    """Decode, normalise line endings and count lines: ``content`` becomes text."""
    content = F.col("content")
    if dict(files.dtypes)["content"] == "binary":
        content = decode_text(content)
    return files.withColumn("content", F.coalesce(normalize_newlines(content), F.lit(""))).withColumn(
        "lines", line_count(F.col("content"))
    )


def read_tree(spark: SparkSession, root: str, repo: str, snap: str, **options) -> DataFrame:
    """Read one directory tree as a corpus table.

    The size limit also reaches the reader, which then skips the content of
    larger files. A root without a scheme is a local folder, relative to the driver's.
    """
    # scheme and authority go on both sides, so that a path is compared with a path
    scheme = "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?/+"
    if not re.match(scheme, root) and not root.startswith("/"):
        root = os.path.abspath(root)
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    limit = options.get("max_bytes", rules.MAX_FILE_BYTES)
    if limit is not None:
        found = found.filter(F.col("length") <= limit)
    plain = F.regexp_replace(F.col("path"), scheme, "/")
    root = re.sub(scheme, "/", root)
    table = found.select(
        F.lit(repo).alias("repo"),
        F.lit(snap).alias("snap"),
        relative_path(plain, root).alias("path"),
        F.col("length").alias("bytes"),
        F.col("content"),
    )
    return read_corpus(table, **options)


def read_corpus(files: DataFrame, **options) -> DataFrame:
    """``files(repo, snap, path, content)`` to ``files(…, language, content, lines)``."""
    return with_text(select_files(files, **options))


def with_file_key(files: DataFrame) -> DataFrame:
    """Add a 128-bit key per file, so that long paths are not carried by every token."""
    parts = [F.col(c) for c in REPO_KEYS + ["path"]]
    return files.withColumn("f1", F.xxhash64(*parts)).withColumn(
        "f2", F.xxhash64(F.lit("second half"), *parts)
    )
