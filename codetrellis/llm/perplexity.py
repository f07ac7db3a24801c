"""Quality by perplexity: an interpolated modified Kneser-Ney model over byte n-grams.

The model is trained on all trusted texts, a second one on all toxic texts; the worst
window of a text by their ratio tells a few insults in a long clean text. Texts are dealt into compressed chunks
once; a chunk asks for the probability of each of its distinct n-grams, the answers
come from joins of counts sharded by n-gram, and go back to the chunk, which sums
them per text. No model is broadcast and no text meets all counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codetrellis.llm.blocks import blocks, text_bytes
from codetrellis.llm.registry import query, table
from codetrellis.session import checkpointed as cut


#: languages up to which a table of them is broadcast
BROADCAST_LANGUAGES = 100_000


@dataclass(frozen=True)
class Classifier:
    """n-grams of ``order`` bytes (2 to 4); a language's threshold is the ``quantile``
    of its trusted perplexities times ``margin``. Short texts are shrunk towards the
    language's trusted mean as if ``prior`` more bytes of it had been read. A language of
    ``least`` trusted texts has half of its threshold from them and half from all languages.
    Toxicity is that of the worst ``window`` bytes of a text, under the same rule."""

    order: int = 4
    quantile: float = 0.995
    margin: float = 1.05
    prior: int = 32
    least: int = 50
    window: int = 24
    chunk_bytes: int = 8 << 20


def _compressed(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))
    with pa.ipc.new_stream(sink, batch.schema, options=options) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _texts(blob) -> pa.RecordBatch:
    return pa.ipc.open_stream(pa.py_buffer(blob)).read_next_batch()


def _chunks(docs: DataFrame, limit: int) -> DataFrame:
    """``chunk, blob``: runs of rows (doc_id, text, lang), compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            _, offsets = text_bytes(batch.column(1))
            for a, b in blocks(offsets, limit):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number]), pa.array([_compressed(batch.slice(a, b - a))], pa.binary())], ["chunk", "blob"]
                )
                number += 1

    return docs.select("doc_id", "text", "lang").mapInArrow(run, "chunk long, blob binary")


def ngrams(column, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Packed n-gram ending at every byte, and the offset of each text; line breaks go before a text."""
    data, offsets = text_bytes(column)
    n, back = len(offsets) - 1, order - 1
    shift = np.repeat(np.arange(1, n + 1) * back, np.diff(offsets))
    at = np.arange(len(data)) + shift
    padded = np.full(len(data) + n * back, 10, np.uint32)
    padded[at] = data
    grams = np.zeros(len(data), np.uint32)
    for j in range(back, -1, -1):
        grams = (grams << np.uint32(8)) | padded[at - j]
    return grams, offsets


def counted(rows: pa.Table, learned: list[np.ndarray], order: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Distinct n-grams of a chunk and how often each occurs in each list of ``learned`` texts."""
    column = _texts(rows["blob"][0].as_buffer()).column("text")
    all_ = [np.zeros(0, np.uint32)]
    known = [[np.zeros(0, np.uint32)] for _ in learned]
    times = [[np.zeros(0, np.int64)] for _ in learned]
    for a, b in blocks(text_bytes(column)[1]):
        grams, offsets = ngrams(column.slice(a, b - a), order)
        all_.append(np.unique(grams))
        for k, at in enumerate(learned):
            member = np.zeros(len(column), bool)
            member[at] = True
            if member[a:b].any():
                some, often = np.unique(grams[np.repeat(member[a:b], np.diff(offsets))], return_counts=True)
                known[k].append(some)
                times[k].append(often)
    distinct = np.unique(np.concatenate(all_))
    counts = []
    for some, often in zip(known, times):
        n = np.zeros(len(distinct), np.int64)
        np.add.at(n, np.searchsorted(distinct, np.concatenate(some)), np.concatenate(often))
        counts.append(n)
    return distinct.astype(np.int64), counts


def worst_windows(values: np.ndarray, offsets: np.ndarray, window: int) -> np.ndarray:
    """Largest sum of ``window`` values in a row in each text, over ``window``; 0 for empty texts.

    Windows that begin before their text count what lies inside.
    """
    out = np.zeros(len(offsets) - 1)
    so_far = np.concatenate([[0.0], np.cumsum(values)])
    ends = np.arange(1, len(values) + 1)
    starts = np.maximum(ends - window, np.repeat(offsets[:-1], np.diff(offsets)))
    filled = np.diff(offsets) > 0
    if filled.any():
        out[filled] = np.maximum.reduceat((so_far[ends] - so_far[starts]) / window, offsets[:-1][filled])
    return out


def probabilities(trained: DataFrame, asked: DataFrame, order: int, models: tuple[str, ...] = ("n",)) -> DataFrame:
    """``gram`` and, for each of ``models``, ``logp_<model>`` of every asked n-gram, from ``trained(gram, *models)``.

    Lower orders count distinct left neighbours; discounts come from the counts of
    counts of each order. Without any trained n-gram all bytes are equally likely. All
    models go through the same joins.
    """

    orders = F.array(
        *[
            F.struct(F.lit(k).alias("k"), F.col("gram").bitwiseAND(F.lit((1 << 8 * k) - 1).cast("long")).alias("g"))
            for k in range(1, order + 1)
        ]
    )
    seen = (
        trained.select(F.explode(orders).alias("_o"), *models)
        .groupBy(F.col("_o.k").alias("k"), F.col("_o.g").alias("g"))
        .agg(*[F.sum(m).alias(m) for m in models])
    )
    shorter = F.col("g").bitwiseAND(F.expr("shiftleft(1L, 8 * (k - 1)) - 1"))
    lower = seen.filter("k > 1").groupBy((F.col("k") - 1).alias("k"), shorter.alias("g")).agg(
        *[F.count(F.when(F.col(m) > 0, 1)).alias(f"c_{m}") for m in models]
    )
    counts = seen.filter(F.col("k") == order).select("k", "g", *[F.col(m).alias(f"c_{m}") for m in models]).unionByName(lower)

    def times(m, j):
        return F.sum(F.when(F.col(f"c_{m}") == j, 1).otherwise(0)).cast("double")

    of_counts = counts.groupBy("k").agg(*[times(m, j).alias(f"n{j}_{m}") for m in models for j in (1, 2, 3, 4)])

    def discount(m, j):
        y = F.try_divide(F.col(f"n1_{m}"), F.col(f"n1_{m}") + 2 * F.col(f"n2_{m}"))
        raw = F.lit(float(j)) - F.try_divide((j + 1) * y * F.col(f"n{j + 1}_{m}"), F.col(f"n{j}_{m}"))
        # where a count of counts is 0 the estimate is undefined
        return F.least(F.greatest(F.coalesce(raw, F.lit(0.5 * j)), F.lit(0.1)), F.lit(float(j)))

    discounts = of_counts.select("k", *[discount(m, j).alias(f"d{j}_{m}") for m in models for j in (1, 2, 3)])
    context = F.shiftright("g", 8)
    figures = []
    for m in models:
        figures += [F.sum(f"c_{m}").alias(f"s_{m}"), times(m, 1).alias(f"c1_{m}"), times(m, 2).alias(f"c2_{m}")]
        figures.append(F.sum(F.when(F.col(f"c_{m}") >= 3, 1).otherwise(0)).cast("double").alias(f"c3_{m}"))
    contexts = counts.groupBy("k", context.alias("h")).agg(*figures).join(discounts, "k")
    wanted = asked.select("gram", F.explode(orders).alias("_o")).select("gram", F.col("_o.k").alias("k"), F.col("_o.g").alias("g"))
    # each shorter n-gram is rated once, so that the few short contexts meet few rows
    once = wanted.select("k", "g").distinct().withColumn("h", F.shiftright("g", 8))
    joined = once.join(counts, ["k", "g"], "left").join(contexts, ["k", "h"], "left")
    rated = []
    for m in models:
        c, d1, d2, d3 = F.coalesce(f"c_{m}", F.lit(0)), *[F.col(f"d{j}_{m}") for j in (1, 2, 3)]
        cut_off = F.when(c >= 3, d3).when(c == 2, d2).when(c == 1, d1).otherwise(F.lit(0.0))
        taken = d1 * F.col(f"c1_{m}") + d2 * F.col(f"c2_{m}") + d3 * F.col(f"c3_{m}")
        own = F.coalesce(F.try_divide(c - cut_off, F.col(f"s_{m}")), F.lit(0.0))
        rest = F.coalesce(F.try_divide(taken, F.col(f"s_{m}")), F.lit(1.0))  # no model knows all contexts
        rated += [own.alias(f"a_{m}"), rest.alias(f"r_{m}")]
    rated = joined.select("k", "g", F.struct(*rated).alias("_rated"))
    per = wanted.join(rated, ["k", "g"]).groupBy("gram").agg(
        *[F.max(F.when(F.col("k") == k, F.col("_rated"))).alias(f"_{k}") for k in range(1, order + 1)]
    )
    out = []
    for m in models:
        p = F.lit(1 / 256)
        for k in range(1, order + 1):
            p = F.col(f"_{k}.a_{m}") + F.col(f"_{k}.r_{m}") * p
        out.append(F.log(p).alias(f"logp_{m}"))
    return per.select("gram", *out)


def score(docs: DataFrame, trusted: DataFrame, spec: Classifier = Classifier(), toxic: DataFrame | None = None) -> DataFrame:
    """``doc_id, lang, n, logp, odds, trusted, toxic`` of every row: its bytes and their log probability.

    ``trusted`` holds the ``doc_id`` of the texts to learn from, ``toxic`` of those of the second
    model. ``odds`` is the log of how much likelier the worst window is to the second, a byte; null
    without one. Null texts are empty: n and logp are 0. Rows with a null doc_id are scored and never trusted; repeated
    rows are scored, and learned from, each. Chunks are numbered by task: ``docs`` is to
    be a stored table, whose rows come in the same tasks if a task is run again.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.col("lang").cast("string"))
    order = spec.order
    both = toxic is not None
    models = ("n", "m") if both else ("n",)
    chunks = _chunks(docs, spec.chunk_bytes).groupBy("chunk")

    def ids(key: tuple, rows: pa.Table) -> pa.Table:
        batch = _texts(rows["blob"][0].as_buffer())
        n = batch.num_rows
        return pa.table({"chunk": pa.array([key[0].as_py()] * n, pa.int64()), "row": pa.array(range(n), pa.int32()), "doc_id": batch.column("doc_id")})

    def count(key: tuple, rows: pa.Table, flags: pa.Table) -> pa.Table:
        at, kind = flags["row"].to_numpy(), flags["kind"].to_numpy()
        grams, counts = counted(rows, [at[kind & (1 << k) > 0] for k in range(len(models))], order)
        named = {m: pa.array(n) for m, n in zip(models, counts)}
        return pa.table({"chunk": pa.array([key[0].as_py()] * len(grams), pa.int64()), "gram": pa.array(grams), **named})

    def total(key: tuple, rows: pa.Table, answers: pa.Table) -> pa.Table:
        batch = _texts(rows["blob"][0].as_buffer())
        known, logp = answers["gram"].to_numpy(), answers["logp"].to_numpy()
        by = np.argsort(known)
        known, logp = known[by].astype(np.uint32), logp[by]
        odds = answers["odds"].to_numpy()[by] if both else None
        column = batch.column("text")
        sizes, sums, worst = [np.zeros(0, np.int64)], [np.zeros(0)], [np.zeros(0)]
        for a, b in blocks(text_bytes(column)[1]):
            grams, offsets = ngrams(column.slice(a, b - a), order)
            so_far = np.zeros(len(grams) + 1)
            at = np.searchsorted(known, grams)
            if len(grams):
                np.cumsum(logp[at], out=so_far[1:])
            if both:
                worst.append(worst_windows(odds[at], offsets, spec.window))
            sizes.append(np.diff(offsets))
            sums.append(so_far[offsets[1:]] - so_far[offsets[:-1]])
        return pa.table(
            {
                "chunk": pa.array([key[0].as_py()] * batch.num_rows, pa.int64()),
                "row": pa.array(range(batch.num_rows), pa.int32()),
                "doc_id": batch.column("doc_id"),
                "lang": batch.column("lang"),
                "n": pa.array(np.concatenate(sizes)),
                "logp": pa.array(np.concatenate(sums)),
                "odds": pa.array(np.concatenate(worst)) if both else pa.nulls(batch.num_rows, pa.float64()),
            }
        )

    learned = trusted.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(1).alias("kind")).distinct()
    if both:
        learned = learned.unionByName(toxic.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(2).alias("kind")).distinct())
        learned = learned.groupBy("doc_id").agg(F.sum("kind").cast("int").alias("kind"))
    flags = chunks.applyInArrow(ids, "chunk long, row int, doc_id long").join(learned, "doc_id").select(
        F.col("chunk").alias("_chunk"), "row", "kind"
    )
    counts = ", ".join(f"{m} long" for m in models)
    grams = chunks.cogroup(flags.groupBy("_chunk")).applyInArrow(count, f"chunk long, gram long, {counts}")
    trained = grams.filter(" OR ".join(f"{m} > 0" for m in models)).groupBy("gram").agg(*[F.sum(m).alias(m) for m in models])
    answers = probabilities(trained, grams.select("gram").distinct(), order, models).withColumnRenamed("logp_n", "logp")
    if both:  # single precision, as it is shuffled once for every n-gram of a chunk
        answers = answers.select("gram", "logp", (F.col("logp_m") - F.col("logp")).cast("float").alias("odds"))
    asked = grams.select(F.col("chunk").alias("_chunk"), "gram").join(answers, "gram")
    scored = chunks.cogroup(asked.groupBy("_chunk")).applyInArrow(
        total, "chunk long, row int, doc_id long, lang string, n long, logp double, odds double"
    )
    marked = flags.withColumnRenamed("_chunk", "chunk")
    kind = F.coalesce("kind", F.lit(0))
    return scored.join(marked, ["chunk", "row"], "left").select(
        "doc_id",
        "lang",
        "n",
        "logp",
        "odds",
        (kind.bitwiseAND(F.lit(1)) > 0).alias("trusted"),
        (kind.bitwiseAND(F.lit(2)) > 0).alias("toxic"),
    )


def _short(df: DataFrame) -> DataFrame:
    """``df``, of one row per language, to be joined without dealing the texts by language."""
    df = cut(df)
    return F.broadcast(df) if df.count() <= BROADCAST_LANGUAGES else df


def _limits(seen: DataFrame, value: str, spec: Classifier) -> DataFrame:
    """``_l, _limit``: how large ``value`` may be in each language with trusted texts.

    A few texts say little of a language, and the model, which learned from them, finds the
    others of it harder. So a language's quantile is blended, by the number of its trusted
    texts, with that of all languages, taken relative to the median of a language's texts.
    """
    seen = seen.filter("n > 0").select("_l", "trusted", F.col(value).alias("_v"))

    def quantile(column):
        return F.percentile_approx(column, spec.quantile, 10000)

    per = seen.groupBy("_l").agg(
        F.percentile_approx("_v", 0.5, 10000).alias("_centre"),
        quantile(F.when(F.col("trusted"), F.col("_v"))).alias("_own"),
        F.count(F.when(F.col("trusted"), F.col("_v"))).alias("_texts"),
    )
    per = _short(per.filter("_texts > 0"))
    shared = seen.filter("trusted").join(per, "_l").agg(quantile(F.col("_v") / F.col("_centre")).alias("q")).select("q").scalar()
    weight = F.col("_texts") / (F.col("_texts") + spec.least)
    blend = F.exp(weight * F.log("_own") + (1 - weight) * F.log(shared * F.col("_centre")))
    return _short(per.select("_l", (blend * spec.margin).alias("_limit")))


def classify(docs: DataFrame, trusted: DataFrame, spec: Classifier = Classifier(), toxic: DataFrame | None = None) -> DataFrame:
    """``doc_id, lang, perplexity, judged, threshold, toxicity, toxicity_threshold, kept`` of every row.

    ``judged`` is the perplexity after shrinking, compared with the ``threshold`` of
    the row's language (a null language is a language of its own). Empty texts
    have no perplexity and are not kept. A language without trusted texts is not judged:
    its ``judged`` and ``threshold`` are null and all its other texts are kept. Ties with the
    threshold are kept. ``toxicity``, the ratio of the model of ``toxic`` texts to that of the
    trusted ones in the worst window, has a threshold in the same way; without toxic texts
    both are null.
    """
    scored = cut(score(docs, trusted, spec, toxic)).withColumn("_l", F.coalesce("lang", F.lit("")))
    model = scored.filter("trusted AND n > 0")
    means = _short(model.groupBy("_l").agg((-F.sum("logp") / F.sum("n")).alias("_mean")))
    judged = F.when(F.col("n") > 0, F.exp((-F.col("logp") + spec.prior * F.col("_mean")) / (F.col("n") + spec.prior)))
    seen = scored.join(means, "_l", "left").withColumn("judged", judged)
    out = seen.join(_limits(seen, "judged", spec).withColumnRenamed("_limit", "threshold"), "_l", "left")
    if toxic is not None and not scored.filter("toxic AND n > 0").isEmpty():
        worst = F.when((F.col("n") > 0) & F.col("judged").isNotNull(), F.exp("odds"))
        limits = _limits(scored.withColumn("_worst", F.exp("odds")), "_worst", spec)
        out = out.withColumn("toxicity", worst).join(limits.withColumnRenamed("_limit", "toxicity_threshold"), "_l", "left")
    else:
        out = out.withColumns({c: F.lit(None).cast("double") for c in ("toxicity", "toxicity_threshold")})
    low = F.col("threshold").isNull() | (F.col("judged") <= F.col("threshold"))
    clean = F.col("toxicity_threshold").isNull() | (F.col("toxicity") <= F.col("toxicity_threshold"))
    return out.select(
        "doc_id",
        "lang",
        F.when(F.col("n") > 0, F.exp(-F.col("logp") / F.col("n"))).alias("perplexity"),
        "judged",
        "threshold",
        "toxicity",
        "toxicity_threshold",
        ((F.col("n") > 0) & low & clean).alias("kept"),
    )


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Texts labelled as good and not toxic."""
    return labels.filter("quality = 1 AND toxic = 0").select("doc_id").distinct()


def toxic_ids(labels: DataFrame) -> DataFrame:
    """Texts labelled as toxic."""
    return labels.filter("toxic = 1").select("doc_id").distinct()


@query("op5_quality_classifier")
def op5_quality_classifier(spark, sf_dir):
    """Every document judged by models of all trusted and of all toxic documents."""
    labels = table(spark, sf_dir, "labels")
    return classify(table(spark, sf_dir, "documents"), trusted_ids(labels), toxic=toxic_ids(labels))
