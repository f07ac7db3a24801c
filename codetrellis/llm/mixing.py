"""Mixing sources to target weights by iterative proportional fitting.

Documents are summed to cells (source, language, topic) of token weight. The cells
are raked until every marginal has its target share; a cell's raked weight over its
tokens is the relative rate at which its documents are drawn, and one factor makes
the expected tokens meet the budget. All steps are grouped sums and joins.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codetrellis.llm.registry import query, table
from codetrellis.session import checkpointed as cut

WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Mix:
    """``flatten`` gives, per marginal, the power of the natural share that is aimed at:
    1 leaves the marginal as it is, 0 makes its categories equal. ``targets`` gives shares
    outright (category to weight) and wins over ``flatten``. ``budget`` is the expected share of tokens drawn."""

    flatten: dict[str, float] = field(default_factory=lambda: {"source": 0.7, "lang": 0.8, "topic": 1.0})
    targets: dict[str, dict[str, float]] = field(default_factory=dict)
    budget: float = 0.8
    seed: int = 17
    tolerance: float = 1e-6
    sweeps: int = 60
    #: at most so many cells are fitted on the driver and sent to all executors; more stay tables
    broadcast_cells: int = 100_000


def words(text: Column) -> Column:
    """Token weight of a text: its words."""
    return F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))).cast("long")


def shape(text: Column, tokens: Column) -> Column:
    """A topic where the table has none: the form of the text."""
    return (
        F.when(F.contains(text, F.lit(" | ")), F.lit("table"))
        .when(tokens < 50, F.lit("note"))
        .when(tokens < 1000, F.lit("article"))
        .otherwise(F.lit("essay"))
    )


def _targets(cells: DataFrame, mix: Mix, column: str) -> DataFrame:
    """``column, _share`` over the categories that have tokens; shares sum to 1."""
    sums = cells.groupBy(column).agg(F.sum("tokens").cast("double").alias("_t"))
    if column in mix.targets:
        given = cells.sparkSession.createDataFrame(
            [(str(k), float(v)) for k, v in mix.targets[column].items()], f"{column} string, _raw double"
        )
        raw = sums.join(given, column, "left").select(column, F.coalesce("_raw", F.lit(0.0)).alias("_raw"))
    else:
        raw = sums.select(column, F.pow("_t", F.lit(float(mix.flatten[column]))).alias("_raw"))
    total = raw.agg(F.sum("_raw").alias("s")).select("s").scalar()
    return raw.select(column, F.coalesce(F.try_divide(F.col("_raw"), total), F.lit(0.0)).alias("_share"))


def rake(cells: DataFrame, mix: Mix) -> DataFrame:
    """``cells`` with ``weight``: tokens raked to the target shares, total unchanged.

    Categories without tokens cannot be met; shares are taken over the others. The
    marginals' targets may contradict each other through empty cells: fitting stops
    after ``sweeps`` at the latest. A sweep's jobs read the cells, never the documents.
    """
    names = list(mix.flatten)
    total = cells.agg(F.sum("tokens")).first()[0]
    if not total:
        return cells.withColumn("weight", F.lit(0.0))
    targets = {c: cut(_targets(cells, mix, c)) for c in names}
    # a raked cell is its tokens times one factor per marginal: only the factors change
    factors = {c: targets[c].select(c, F.lit(1.0).alias(f"_f_{c}")) for c in names}

    def raked(apart: str | None = None) -> DataFrame:
        df, weight = cells, F.col("tokens").cast("double")
        for c in names:
            if c != apart:
                df, weight = df.join(factors[c], c), weight * F.col(f"_f_{c}")
        return df.withColumn("weight", weight)

    for _ in range(mix.sweeps):
        worst = 0.0
        for c in names:
            sums = raked(c).groupBy(c).agg(F.sum("weight").alias("_sum"))
            step = sums.join(targets[c], c).join(factors[c], c).select(
                c,
                F.when(F.col("_sum") > 0, F.col("_share") * total / F.col("_sum")).otherwise(0.0).alias("_new"),
                F.abs(F.col(f"_f_{c}") * F.col("_sum") / total - F.col("_share")).alias("_off"),
            )
            step = cut(step)
            worst = max(worst, step.agg(F.max("_off")).first()[0])
            factors[c] = step.select(c, F.col("_new").alias(f"_f_{c}"))
        if worst <= mix.tolerance:
            break
    return raked().drop(*[f"_f_{c}" for c in names])


def _factor(mix: Mix, low: float, high: float, aim: float, drawn) -> float:
    """Smallest factor found whose drawn tokens reach ``aim``; ``drawn`` sums for 33 candidates at a time."""
    least, most = mix.budget / high / 2, 1 / low
    for _ in range(8):
        tries = [least * (most / least) ** (i / 32) for i in range(33)]
        above = next((i for i, x in enumerate(drawn(tries)) if x >= aim), 32)
        least, most = tries[max(above - 1, 0)], tries[above]
    return most


def _rates_here(rows: list, names: list[str], mix: Mix) -> np.ndarray:
    """What ``rates`` gives, for a checked number of cells, in numpy on the driver."""
    tokens = np.array([r["tokens"] for r in rows], float)
    total, weight = tokens.sum(), tokens.copy()
    if not total:
        return np.ones(len(rows))
    goals = []
    for c in names:
        values, codes = np.unique([r[c] for r in rows], return_inverse=True)
        sums = np.bincount(codes, tokens)
        raw = np.array([mix.targets[c].get(v, 0.0) for v in values]) if c in mix.targets else sums ** mix.flatten[c]
        raw = np.where(sums > 0, raw, 0.0) if c in mix.targets else raw
        goals.append((codes, raw / raw.sum() if raw.sum() else raw))
    for _ in range(mix.sweeps):
        worst = 0.0
        for codes, share in goals:
            sums = np.bincount(codes, weight)
            worst = max(worst, np.abs(sums / total - share).max())
            weight = weight * np.divide(share * total, sums, out=np.zeros_like(sums), where=sums > 0)[codes]
        if worst <= mix.tolerance:
            break
    rate = np.divide(weight, tokens, out=np.zeros_like(tokens), where=tokens > 0)
    if not rate.any():
        return np.ones(len(rows))
    factor = _factor(
        mix, rate[rate > 0].min(), rate.max(), min(mix.budget, 1.0) * total,
        lambda tries: [(tokens * np.minimum(1.0, rate * f)).sum() for f in tries],
    )
    return np.where(tokens > 0, np.minimum(1.0, rate * factor), 1.0)


def rates(cells: DataFrame, mix: Mix) -> DataFrame:
    """``cells`` with ``probability``: the chance to draw a document of the cell.

    ``min(1, f * weight / tokens)`` with f such that the expected tokens are the budget's
    share of all; f is narrowed down by sums over the cells. Up to
    ``broadcast_cells`` cells, which are counted first, are fitted on the driver; more by jobs
    over the cell table, to the same result.
    """
    names = list(mix.flatten)
    if cells.count() <= mix.broadcast_cells:
        rows = cells.select(*names, "tokens").collect()
        found = [(*[r[c] for c in names], round(float(p), 12)) for r, p in zip(rows, _rates_here(rows, names, mix))]
        fields = ", ".join(f"{c} string" for c in names) + ", probability double"
        return cells.join(F.broadcast(cells.sparkSession.createDataFrame(found, fields)), names)
    fitted = rake(cells, mix)
    rate = F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")).otherwise(0.0)
    fitted = cut(fitted.withColumn("_rate", rate))
    total, low, high = fitted.agg(
        F.sum("tokens"), F.min(F.when(F.col("_rate") > 0, F.col("_rate"))), F.max("_rate")
    ).first()
    if not total or not high:
        return fitted.withColumn("probability", F.lit(1.0)).drop("_rate")

    def drawn(tries):
        return fitted.agg(*[F.sum(F.col("tokens") * F.least(F.lit(1.0), F.col("_rate") * f)) for f in tries]).first()

    factor = _factor(mix, low, high, min(mix.budget, 1.0) * total, drawn)
    chance = F.when(F.col("tokens") > 0, F.least(F.lit(1.0), F.col("_rate") * factor)).otherwise(F.lit(1.0))
    return fitted.withColumn("probability", F.round(chance, 12)).drop("_rate")


def mixed_documents(docs: DataFrame, mix: Mix = Mix(), tokens=words, topic=shape) -> DataFrame:
    """``docs`` with ``_tokens, _topic, _probability, _chosen``.

    A document is drawn if a number hashed from its id, text and the seed is below its
    cell's probability: the draw does not depend on order or partitions, and repeated rows
    share it. Null and empty categories are one category; a text without
    words weighs nothing and is always drawn; an empty table stays empty. Texts are read whole, whatever
    their length. Columns of the four names give way, all others are kept.
    """
    given = [c for c in docs.columns if c not in ("_tokens", "_topic", "_probability", "_chosen")]
    text = F.coalesce("text", F.lit(""))
    keys = ["source", "lang", "topic"]
    rows = docs.withColumn("_tokens", tokens(text))
    rows = rows.withColumn("_topic", topic(text, F.col("_tokens")))
    categories = {"source": F.col("source").cast("string"), "lang": F.col("lang").cast("string"), "topic": F.col("_topic")}
    rows = rows.select(
        F.struct(*[F.col(f"`{c}`") for c in [*given, "_tokens", "_topic"]]).alias("_row"),
        *[F.coalesce(value, F.lit("")).alias(c) for c, value in categories.items()],
    )
    cells = rows.groupBy(*keys).agg(F.sum("_row._tokens").alias("tokens"), F.count(F.lit(1)).alias("documents"))
    drawn = cut(rates(cut(cells), mix).select(*keys, "probability"))
    if drawn.count() <= mix.broadcast_cells:
        drawn = F.broadcast(drawn)
    whole = F.coalesce(F.col("_row.text"), F.lit(""))
    number = F.shiftrightunsigned(F.xxhash64("_row.doc_id", whole, F.lit(mix.seed)), 11) / float(1 << 53)
    out = rows.join(drawn, keys)
    return out.select(
        *[F.col("_row")[c].alias(c) for c in [*given, "_tokens", "_topic"]],
        F.col("probability").alias("_probability"),
        (number < F.col("probability")).alias("_chosen"),
    )


@query("op7_source_mixing")
def op7_source_mixing(spark, sf_dir):
    """The chance to draw every document, and which ones are drawn."""
    drawn = mixed_documents(table(spark, sf_dir, "documents"))
    return drawn.select(
        "doc_id",
        "source",
        "lang",
        F.col("_topic").alias("topic"),
        F.col("_tokens").alias("n_tokens"),
        F.col("_probability").alias("probability"),
        F.col("_chosen").alias("chosen"),
    )
