"""Search over names by an index of letter runs.

The index lists which names hold a run of one, two or three letters, and how many hold each. A question meets only the
names that hold its rarest run; a run that very many names hold is dealt out by a part of the
name, so that no task gets all of them. The index is written once and serves any number of questions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codetrellis.session import REPO_KEYS, cut, top_k

_LONGEST = 3
_NONE = "array<string>"


def _runs(text: Column, size: int) -> Column:
    """All runs of ``size`` letters of a text; none if it is null or shorter."""
    last = F.length(text) - (size - 1)
    found = F.transform(F.sequence(F.lit(1), last), lambda at: F.substr(text, at, F.lit(size)))
    return F.when(last >= 1, found).otherwise(F.array().cast(_NONE))


@dataclass(frozen=True)
class NameIndex:
    """``postings(keys, gram, salt, low_name, low_container)`` and ``grams(gram, names, salts)``.

    ``salts`` is the number of parts that a gram's names are dealt into.
    """

    keys: list[str]
    postings: DataFrame
    grams: DataFrame

    def save(self, root: str) -> None:
        self.postings.write.mode("overwrite").parquet(f"{root}/postings")
        self.grams.write.mode("overwrite").parquet(f"{root}/grams")

    @staticmethod
    def load(spark: SparkSession, root: str, keys: list[str]) -> "NameIndex":
        return NameIndex(keys, spark.read.parquet(f"{root}/postings"), spark.read.parquet(f"{root}/grams"))


def name_index(symbols: DataFrame, keys: list[str] = REPO_KEYS, part: int = 50_000) -> NameIndex:
    """The index of ``symbols(keys, name, container)``; a gram's names are dealt into parts of about ``part``."""
    names = symbols.select(*keys, F.lower("name").alias("low_name"), F.lower("container").alias("low_container")).distinct()
    words = F.concat(*[_runs(F.col(c), k) for c in ("low_name", "low_container") for k in range(1, _LONGEST + 1)])
    listed = cut(names.withColumn("gram", F.explode(F.array_distinct(words))))
    counted = listed.groupBy("gram").agg(F.count(F.lit(1)).alias("names"))
    grams = cut(counted.withColumn("salts", F.ceil(F.col("names") / part).cast("int")))
    # grams of several parts: fewer than all postings divided by the size of a part
    dealt = F.broadcast(grams.filter("salts > 1").select("gram", "salts"))
    salt = F.pmod(F.xxhash64(*keys, "low_name", "low_container"), F.coalesce("salts", F.lit(1))).cast("int")
    return NameIndex(keys, cut(listed.join(dealt, "gram", "left").withColumn("salt", salt).drop("salts")), grams)


def rarest_grams(index: NameIndex, needles: DataFrame) -> DataFrame:
    """``needle, gram, salt``: the run of each question that the fewest names hold, once for each of its parts.

    Questions with a run that no name holds have no answer and drop out.
    """
    needle = F.col("needle")
    asked = needles.select(F.lower("needle").alias("needle")).filter("needle <> ''").distinct()
    own = F.when(F.length(needle) < _LONGEST, F.array(needle)).otherwise(_runs(needle, _LONGEST))
    parts = asked.withColumn("gram", F.explode(F.array_distinct(own))).join(index.grams, "gram", "left")
    best = parts.groupBy("needle").agg(F.min(F.struct(F.coalesce("names", F.lit(0)).alias("n"), "gram", "salts")).alias("_b"))
    return best.filter("_b.n > 0").select("needle", "_b.gram", F.explode(F.sequence(F.lit(0), F.col("_b.salts") - 1)).alias("salt"))


def holding(index: NameIndex, needles: DataFrame) -> DataFrame:
    """``keys, needle, low_name, low_container``: names that hold a question in the name or the container."""
    needle, name, container = F.col("needle"), F.col("low_name"), F.col("low_container")
    met = index.postings.join(cut(rarest_grams(index, needles)), ["gram", "salt"])
    held = met.filter(name.contains(needle) | F.coalesce(container.contains(needle), F.lit(False)))
    return held.select(*index.keys, "needle", "low_name", "low_container")


def search(symbols: DataFrame, needles: DataFrame, limit: int | None = 40, keys: list[str] = REPO_KEYS, index: NameIndex | None = None) -> DataFrame:
    """Symbols whose name or container contains a needle, best first.

    ``needles(needle)`` is a table of questions and may be large. Order: exact, prefix, most
    called, id. ``index`` may be one that was written before, of these symbols.
    """
    hits = holding(index or name_index(symbols, keys), needles)
    found = symbols.withColumn("low_name", F.lower("name")).withColumn("low_container", F.lower("container"))
    matched = found.alias("s").join(
        hits.alias("h"),
        [F.col(f"s.{k}") == F.col(f"h.{k}") for k in keys]
        + [F.col("s.low_name") == F.col("h.low_name"), F.col("s.low_container").eqNullSafe(F.col("h.low_container"))],
    ).select("s.*", "h.needle")
    low_name, needle = F.col("low_name"), F.col("needle")
    order = [(low_name == needle).desc(), low_name.startswith(needle).desc(), F.col("fan_in").desc(), "sym_id"]
    return top_k(matched, keys + ["needle"], order, limit).drop("low_name", "low_container")
