"""Drift of a stream of scans by keyed state.

The state of a (repository, bucket of symbols) holds the rows of its last compared scan and what has come
of the scans after it. When the watermark has passed a scan it is compared with the one before, whose rows
are then let go; so a batch costs what it brings, however long the stream has run. Scans
are announced on a stream of their own, so that a bucket learns of a scan that
brings it no row. Buckets put out movements; ``moved_entries`` adds up their counts.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from codetrellis.operators.drift import MIN_CALLER_CHANGE, MIN_COMING_OR_GOING, MIN_SPAN_CHANGE, report_order, with_flags
from codetrellis.session import REPO_KEYS, top_k

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
MOVES = "repo string, snap string, kind string, subject string, delta bigint, detail string"
# buckets of a repository; a bucket's rows of two scans are what a task holds at once
BUCKETS = 16
_VALUES = ["span", "branches", "callers"]
_ROWS = ["sym_key", "cycle_key", *_VALUES]


def movements(now: pd.DataFrame, then: pd.DataFrame) -> list[tuple]:
    """(kind, subject, delta, detail) between two scans of a bucket; counts of comings and goings are partial."""
    symbols = now[now["sym_key"].notna()].merge(
        then[then["sym_key"].notna()], how="outer", on="sym_key", suffixes=("", "_then"), indicator=True
    )
    found = []
    both = symbols[symbols["_merge"] == "both"]
    for key, *values in both[["sym_key", *_VALUES, *[f"{v}_then" for v in _VALUES]]].itertuples(index=False):
        span, branches, callers = (int(values[i]) - int(values[i + 3]) for i in range(3))
        subject = key.rsplit("#", 1)[-1]
        if abs(span) >= MIN_SPAN_CHANGE:
            found.append(("grew" if span > 0 else "shrank", subject, span, str(branches) if branches else ""))
        if abs(callers) >= MIN_CALLER_CHANGE:
            found.append(("gainedCallers" if callers > 0 else "lostCallers", subject, callers, ""))
    came, went = int((symbols["_merge"] == "left_only").sum()), int((symbols["_merge"] == "right_only").sum())
    found += [("appeared", "", came, "")] if came else []
    found += [("vanished", "", -went, "")] if went else []
    for cycle in sorted(set(now["cycle_key"].dropna()) - set(then["cycle_key"].dropna())):
        found.append(("newCycle", " → ".join(cycle.split("|")[:3]), 1, ""))
    return found


class ScanDrift(StatefulProcessor):
    """Compares the scans of a (repository, bucket) in the order of their times."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "snap string, piece bigint", "at bigint, rows binary")
        self.last = handle.getValueState("last", "at bigint, snap string, rows binary")
        self.pieces = handle.getValueState("pieces", "n bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        piece = self.pieces.get()[0] if self.pieces.exists() else 0
        last = self.last.get()[:2] if self.last.exists() else None
        for frame in rows:
            for snap, part in frame.groupby("snap", sort=False):
                at = int(part["at"].max())
                if last is not None and (at, snap) <= last:
                    continue  # late: its successor has been compared
                kept = part.loc[part["sym_key"].notna() | part["cycle_key"].notna(), _ROWS]
                self.waiting.updateValue((snap, piece), (at, pickle.dumps(kept.to_dict("list"))))
                self.handle.registerTimer(at)
                piece += 1
        self.pieces.update((piece,))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        scans: dict[str, list] = {}
        for (snap, piece), (at, blob) in list(self.waiting.iterator()):
            scans.setdefault(snap, []).append((at, piece, blob))
        out = []
        last = self.last.get() if self.last.exists() else None
        for snap, parts in sorted(scans.items(), key=lambda s: (max(p[0] for p in s[1]), s[0])):
            at = max(p[0] for p in parts)
            if at > passed:
                continue
            now = pd.concat([pd.DataFrame(pickle.loads(blob), columns=_ROWS) for _, _, blob in sorted(parts, key=lambda p: p[1])])
            # of rows that came twice the last one counts
            now = pd.concat([now[now["sym_key"].notna()].drop_duplicates("sym_key", keep="last"), now[now["sym_key"].isna()]])
            if last is not None:
                then = pd.DataFrame(pickle.loads(last[2]), columns=_ROWS)
                out += [(key[0], snap, *m) for m in movements(now, then)]
            last = (at, snap, pickle.dumps(now.to_dict("list")))
            for _, piece, _ in parts:
                self.waiting.removeKey((snap, piece))
        if last is not None:
            self.last.update(last)
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in MOVES.split(", ")])

    def close(self) -> None:
        pass


def stream_moves(records: DataFrame, scans: DataFrame, delay: str = "0 seconds", buckets: int = BUCKETS) -> DataFrame:
    """MOVES of every scan as the watermark passes it; to be written in append mode.

    ``records`` is a stream of ``repo, snap, scanned_at, sym_key, span, branches, callers`` and ``cycle_key``, where a row
    is a symbol or a cycle; ``scans`` announces ``repo, snap, scanned_at``. A scan may come in pieces and in any
    order within ``delay``; rows of a scan that was passed are left out. The session's
    state store must be able to hold this state: set ``spark.sql.streaming.stateStore.providerClass`` to PROVIDER.
    """
    bucket = F.pmod(F.xxhash64(F.coalesce("sym_key", "cycle_key")), F.lit(buckets)).cast("int")
    own = records.select(*REPO_KEYS, "scanned_at", bucket.alias("bucket"), *_ROWS)
    none = [F.lit(None).cast(records.schema[c].dataType).alias(c) for c in _ROWS]
    told = scans.select(*REPO_KEYS, "scanned_at", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket"), *none)
    both = own.unionByName(told).withWatermark("scanned_at", delay).withColumn("at", F.unix_millis("scanned_at"))
    return both.groupBy("repo", "bucket").transformWithStateInPandas(ScanDrift(), MOVES, "append", "EventTime")


def moved_entries(moves: DataFrame, limit: int | None = None) -> DataFrame:
    """Drift entries from the movements of all buckets, as ``drift.compare`` gives them."""
    counted = F.col("kind").isin("appeared", "vanished")
    sums = moves.filter(counted).groupBy(*REPO_KEYS, "kind").agg(F.sum("delta").alias("delta"))
    sums = sums.filter(F.abs("delta") >= MIN_COMING_OR_GOING)
    entries = moves.filter(~counted).unionByName(
        sums.select(*REPO_KEYS, "kind", F.lit("").alias("subject"), "delta", F.lit("").alias("detail"))
    )
    return with_flags(top_k(entries, REPO_KEYS, report_order(), limit, "place"))
