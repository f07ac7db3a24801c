"""Facts of texts by their content (X1-X16): a text is read once, wherever it occurs.

A text is named by 128 bits of its language and content. What a file declares and calls depends on nothing
else, so one file of every distinct text is lexed for all repositories and snapshots, and the
facts are joined back to all files that have it. A ``FactStore`` keeps them between runs:
then only texts are lexed that no earlier run has seen.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from codetrellis.operators.lexing import blank_trivia, by_file
from codetrellis.operators.scopes import code_facts, languages
from codetrellis.operators.styles import markup_facts, stylesheet_facts
from codetrellis.session import REPO_KEYS, cut
from codetrellis.sources.corpus import FILE_KEY
from codetrellis.sources.logstore import LogTable

FACTS = (
    "f1 bigint, f2 bigint, sym_at bigint, name string, container string, kind string, line int, end_line int, "
    "branches int, max_nesting int, calls array<struct<at:bigint,line:int,callee:string,receiver:string>>, ordinal int"
)


def text_key() -> list[Column]:
    """Name of a text: two hashes of language and content."""
    parts = [F.col("language"), F.col("content")]
    return [F.xxhash64(*parts).alias("f1"), F.xxhash64(F.lit("second half"), *parts).alias("f2")]


class FactStore:
    """Facts of all texts that were read before, in two tables that grow by appending.

    The table of texts is written after their facts, so a run that fails between the two only leads to
    the same facts being written again, which replace the first.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = 16):
        self.facts = LogTable(spark, f"{root}/facts", FACTS, ("f1",), ("f1", "f2", "ordinal"), buckets)
        self.texts = LogTable(spark, f"{root}/texts", "f1 bigint, f2 bigint", ("f1",), ("f1", "f2"), buckets)

    def add(self, texts: DataFrame, facts: DataFrame) -> None:
        self.facts.append(facts)
        self.texts.append(texts)


def list_files(files: DataFrame) -> DataFrame:
    """Files without their text, with its name: ``repo, snap, path, language, f1, f2``."""
    return cut(files.select(*REPO_KEYS, "path", "language", *text_key()))


class _Rows:
    """Facts that are handed on together, by column."""

    def __init__(self):
        self.keys: list[tuple[int, int]] = []
        self.counts: list[int] = []
        self.facts: list[tuple] = []
        self.calls: list[tuple] = []
        self.ends: list[int] = [0]

    def add(self, key: tuple[int, int], found: list[tuple]) -> None:
        self.keys.append(key)
        self.counts.append(len(found))
        self.facts += found
        for row in found:
            self.calls += row[8]
            self.ends.append(len(self.calls))

    def batch(self) -> pa.RecordBatch:
        def integers(values, kind):
            return pa.array(np.array(values, kind))

        counts = np.array(self.counts, np.int64)
        keys = np.array(self.keys, np.int64).reshape(-1, 2)
        ordinals = np.arange(len(self.facts)) - np.repeat(np.cumsum(counts) - counts, counts)
        at, *names, line, end_line, branches, nesting, _ = zip(*self.facts) if self.facts else [()] * 9
        call_at, call_line, callee, receiver = zip(*self.calls) if self.calls else [()] * 4
        calls = pa.StructArray.from_arrays(
            [integers(call_at, np.int64), integers(call_line, np.int32), pa.array(callee, pa.string()), pa.array(receiver, pa.string())],
            ["at", "line", "callee", "receiver"],
        )
        return pa.RecordBatch.from_arrays(
            [
                *(pa.array(np.repeat(keys[:, k], counts)) for k in (0, 1)),
                pa.array(at, pa.int64()),
                *(pa.array(c, pa.string()) for c in names),
                *(pa.array(c, pa.int32()) for c in (line, end_line)),
                *(integers(c, np.int32) for c in (branches, nesting)),
                pa.ListArray.from_arrays(integers(self.ends, np.int32), calls),
                integers(ordinals, np.int32),
            ],
            [c.split(" ")[0] for c in FACTS.split(", ")],
        )


# facts and calls after which a task hands on, to keep little in memory
_TOGETHER = 20_000


def _strings(column: pa.Array) -> list[str | None]:
    try:
        return column.to_pylist()
    except UnicodeDecodeError:  # as in the JVM, what is no UTF-8 is replaced
        return [None if x is None else x.decode("utf-8", "replace") for x in column.cast(pa.binary()).to_pylist()]


def _extracted(texts: DataFrame) -> DataFrame:
    """FACTS of ``texts(f1, f2, language, content)``: one pass reads all languages, each by its extractor."""
    known = languages()
    blanked = F.when(F.col("language").isin("css", "scss", "html"), F.col("content")).when(
        F.col("language").isin(list(known)), blank_trivia(F.col("content"), F.col("language"))
    )

    def read(language: str, of_key: list[str]) -> list[tuple]:
        if language == "html":
            return markup_facts(of_key)
        if language in ("css", "scss"):
            return stylesheet_facts(language, of_key)
        return code_facts(known[language], of_key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # what is made here has no cycles; looking for them takes a fifth of the time
        try:
            yield from facts_of(batches)
        finally:
            gc.enable()

    def facts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, language, of_key, rows = None, None, [], _Rows()
        for batch in batches:
            f1, f2 = (c.to_pylist() for c in batch.columns[:2])
            for *next_key, name, text in zip(f1, f2, *map(_strings, batch.columns[2:])):
                if text is None:
                    continue
                if of_key and key == next_key:  # rows of one key follow each other
                    of_key.append(text)
                    continue
                if of_key:
                    rows.add(key, read(language, of_key))
                    if len(rows.facts) + len(rows.calls) > _TOGETHER:
                        yield rows.batch()
                        rows = _Rows()
                key, language, of_key = next_key, name, [text]
        if of_key:
            rows.add(key, read(language, of_key))
        yield rows.batch()

    read_once = by_file(texts).select(*FILE_KEY, "language", blanked.alias("text"))
    return read_once.sortWithinPartitions(*FILE_KEY).mapInArrow(run, FACTS)


def text_facts(files: DataFrame, listed: DataFrame, store: FactStore | None = None, lexed: Observation | None = None) -> DataFrame:
    """FACTS of every distinct text of ``files``; ``listed`` comes from ``list_files``.

    One file of each text, the first by repository, snapshot and path, is read. ``lexed`` counts the texts
    that are (``texts``); it is not told where there is none. Without repeated texts and without a store the files are read as they are.
    """
    owners = listed.groupBy(*FILE_KEY).agg(F.min(F.struct(*REPO_KEYS, "path")).alias("_o")).select(*FILE_KEY, "_o.*")
    if store is not None:
        owners = owners.join(store.texts.read(), FILE_KEY, "left_anti")
    owners = cut(owners)
    keyed = files.select(*REPO_KEYS, "path", "language", "content", *text_key())
    if store is not None or owners.count() < listed.count():
        keyed = keyed.join(owners.select(*REPO_KEYS, "path"), REPO_KEYS + ["path"], "left_semi")
    texts = keyed.select(*FILE_KEY, "language", "content")
    if lexed is not None:
        texts = texts.observe(lexed, F.count(F.lit(1)).alias("texts"))
    if store is None:
        return _extracted(texts)
    if not owners.isEmpty():
        store.add(owners.select(*FILE_KEY), _extracted(texts))
    wanted = listed.select(*FILE_KEY).distinct()
    return store.facts.read(wanted).join(wanted, FILE_KEY, "left_semi")
