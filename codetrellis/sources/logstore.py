"""A table that grows by appending: segments, a list of the live ones, and merging (K2, K3).

Every append writes one segment, split by a bucket of its key, and then a new list of live segments; what a
reader sees is the newest whole list, so a write that failed leaves nothing behind. As soon as there
are ``fan`` segments of one level they are merged into one of the next, so n appends keep some
``fan`` times log(n) segments and every row is written again log(n) times. A merge may keep only the
last row of each identity. One writer at a time.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codetrellis.sources import storage

# lists of segments that stay for readers who have begun with one
_KEPT_LISTS = 2
_LIST = "segment string, level int, number bigint, n_rows bigint"


@dataclass(frozen=True)
class LogTable:
    """``key`` is what rows are found by. Rows that are equal in ``identity`` replace older ones, if it is given."""

    spark: SparkSession
    root: str
    schema: str
    key: tuple[str, ...]
    identity: tuple[str, ...] = ()
    buckets: int = 16
    fan: int = 8

    @cached_property
    def _folder(self) -> str:
        return self.root.rstrip("/")

    # --- the list of live segments ----------------------------------------------

    def _lists(self) -> list[str]:
        names = storage.children(self.spark, f"{self._folder}/lists")
        return [n for n in names if storage.exists(self.spark, f"{self._folder}/lists/{n}/_SUCCESS")]

    def segments(self) -> list:
        """Rows ``(segment, level, number, n_rows)`` of the live segments, oldest first: a few dozen."""
        lists = self._lists()
        if not lists:
            return []
        return sorted(self.spark.read.schema(_LIST).parquet(f"{self._folder}/lists/{lists[-1]}").collect(), key=lambda r: r["number"])

    def _commit(self, live: list[tuple]) -> None:
        lists = self._lists()
        number = int(lists[-1]) + 1 if lists else 0
        rows = self.spark.createDataFrame(live, _LIST).coalesce(1)
        rows.write.mode("overwrite").parquet(f"{self._folder}/lists/{number:012d}")
        # segments that no list names any more, and lists that nobody has begun with lately
        for old in lists[: -(_KEPT_LISTS - 1) or None]:
            storage.remove(self.spark, f"{self._folder}/lists/{old}")
        named = {r[0] for r in live}
        for kept in self._lists():
            named |= {r["segment"] for r in self.spark.read.schema(_LIST).parquet(f"{self._folder}/lists/{kept}").collect()}
        for segment in storage.children(self.spark, f"{self._folder}/segments"):
            if segment.removeprefix("_segment=") not in named:
                storage.remove(self.spark, f"{self._folder}/segments/{segment}")

    # --- writing ------------------------------------------------------------------

    def bucket(self, *key: Column) -> Column:
        return F.pmod(F.xxhash64(*(key or [F.col(k) for k in self.key])), F.lit(self.buckets)).cast("int")

    def _write(self, rows: DataFrame) -> str:
        name = uuid.uuid4().hex
        order = [c for c in (*self.key, *self.identity) if c != "_number"]
        # small buckets of an append share a task, a large one is written by several
        dealt = rows.withColumn("_bucket", self.bucket()).hint("rebalance", "_bucket")
        dealt.sortWithinPartitions("_bucket", *dict.fromkeys(order)).write.partitionBy("_bucket").parquet(f"{self._folder}/segments/_segment={name}")
        return name

    def append(self, rows: DataFrame) -> None:
        """Add ``rows``; all of them are seen at once, or none."""
        live = [tuple(r) for r in self.segments()]
        number = max((r[2] for r in live), default=-1) + 1
        columns = self._columns
        segment = self._write(rows.select(*columns).withColumn("_number", F.lit(number).cast("bigint")))
        live.append((segment, 0, number, self._read([segment]).count()))
        level = 0
        while sum(r[1] == level for r in live) >= self.fan:
            old = [r for r in live if r[1] == level]
            merged = self._latest(self._read([r[0] for r in old]))
            segment = self._write(merged)
            rest = [r for r in live if r[1] != level]
            live = [*rest, (segment, level + 1, max(r[2] for r in old), self._read([segment]).count())]
            level += 1
        self._commit(live)

    def replace(self, rows: DataFrame) -> None:
        """Put ``rows``, which may be made of what is there, in the place of all."""
        number = max((r["number"] for r in self.segments()), default=-1) + 1
        segment = self._write(rows.withColumn("_number", F.lit(number).cast("bigint")))
        self._commit([(segment, 0, number, self._read([segment]).count())])

    # --- reading ------------------------------------------------------------------

    @cached_property
    def _columns(self) -> list[str]:
        return T.StructType.fromDDL(self.schema).names

    def _read(self, segments: list[str]) -> DataFrame:
        whole = f"{self.schema}, _number bigint, _segment string, _bucket int"
        if not segments:
            return self.spark.createDataFrame([], whole)
        return self.spark.read.schema(whole).option("basePath", f"{self._folder}/segments").parquet(
            *[f"{self._folder}/segments/_segment={s}" for s in segments]
        )

    def _latest(self, rows: DataFrame) -> DataFrame:
        names = self._columns
        rows = rows.select(*names, "_number")
        if not self.identity:
            return rows
        rest = [c for c in names if c not in self.identity]
        # one append may bring an identity twice: the largest of its rows counts
        newest = rows.groupBy(*self.identity).agg(F.max(F.struct("_number", *rest)).alias("_r"))
        return newest.select(*self.identity, "_r.*").select(*names, "_number")

    def read(self, only: DataFrame | None = None) -> DataFrame:
        """The rows; with ``only``, a table of keys, from the buckets these are in."""
        rows = self._read([r["segment"] for r in self.segments()])
        if only is not None:
            keys = only.select(*self.key).distinct()
            touched = [r[0] for r in keys.select(self.bucket()).distinct().collect()]  # at most ``buckets`` numbers
            rows = rows.filter(F.col("_bucket").isin(touched)).join(keys, list(self.key), "left_semi")
        return self._latest(rows).drop("_number")

    def files(self) -> int:
        """Data files of the live segments."""
        return self._read([r["segment"] for r in self.segments()]).select(F.col("_metadata.file_path")).distinct().count()
