"""Sentences said from the graph alone, and label tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codetrellis.functions.rulebook import rules
from codetrellis.session import REPO_KEYS, top_k

LABELS = {
    # (group, key): wording; add rows with another ``lang`` for another language
    ("layer", "entry"): "entry", ("layer", "ui"): "user interface", ("layer", "api"): "network",
    ("layer", "logic"): "logic", ("layer", "data"): "storage", ("layer", "model"): "model",
    ("layer", "config"): "configuration", ("layer", "test"): "test", ("layer", "util"): "utility",
    ("kind", "function"): "function", ("kind", "method"): "method", ("kind", "initializer"): "initializer",
    ("kind", "type"): "type", ("kind", "closureOrVar"): "closure",
    ("severity", "0"): "minor", ("severity", "1"): "worth a check", ("severity", "2"): "important",
    ("finding", "cycle"): "files that need each other", ("finding", "oversizedFile"): "a very large file",
    ("finding", "complexFunction"): "hard to follow", ("finding", "godFunction"): "leaned on everywhere",
    ("finding", "layerViolation"): "a layer is skipped", ("finding", "unreachable"): "nothing seems to call it",
    ("drift", "newCycle"): "a cycle that was not there", ("drift", "grew"): "more lines than before",
    ("drift", "shrank"): "fewer lines than before", ("drift", "gainedCallers"): "more callers than before",
    ("drift", "lostCallers"): "fewer callers than before", ("drift", "appeared"): "new functions",
    ("drift", "vanished"): "functions gone",
    ("advice", "cycle"): "move what both sides need into a file of its own",
    ("advice", "oversizedFile"): "look for parts that can be read apart",
    ("advice", "complexFunction"): "give its branches names of their own",
    ("advice", "godFunction"): "change it in small steps and test its callers",
    ("advice", "layerViolation"): "go through the layer between the two",
    ("advice", "unreachable"): "check whether something calls it by name, else remove it",
    ("drift note", "newCycle"): "undo it while it is young",
    ("drift note", "grew"): "see whether it does one thing still",
    ("drift note", "shrank"): "what it did is done elsewhere or not at all",
    ("drift note", "gainedCallers"): "more depends on it now",
    ("drift note", "lostCallers"): "it may be on its way out",
    ("drift note", "appeared"): "read these first",
    ("drift note", "vanished"): "make sure that nothing misses them",
    ("project kind", "web framework"): "answers requests with pages",
    ("project kind", "compiler or parser"): "turns text into structure",
    ("project kind", "database or storage engine"): "keeps data and finds it again",
    ("project kind", "game"): "draws a world and lets it move",
    ("project kind", "data or machine learning tool"): "learns from tables or tensors",
    ("project kind", "command line tool"): "is run with words and flags",
    ("project kind", "desktop application"): "lives in windows",
    ("project kind", "server or network service"): "listens and answers",
    ("project kind", "library"): "is used by other programs",
}


def labels(spark: SparkSession) -> DataFrame:
    """``(topic, key, lang, text)``: wording is data that a user extends with rows (P20)."""
    rows = [(topic, key, "en", text) for (topic, key), text in LABELS.items()]
    return spark.createDataFrame(rows, "topic string, key string, lang string, text string")


def with_label(df: DataFrame, table: DataFrame, topic: str, column: str, out: str, lang: str = "en") -> DataFrame:
    """Look the wording of ``column`` up; a value without a row keeps its own spelling (P20)."""
    wording = table.filter((F.col("topic") == topic) & (F.col("lang") == lang)).select(
        F.col("key").alias("_key"), F.col("text").alias(out)
    )
    joined = df.join(wording, df[column].cast("string") == F.col("_key"), "left").drop("_key")
    return joined.withColumn(out, F.coalesce(out, F.col(column).cast("string")))


def _sides(symbols: DataFrame, edges: DataFrame, shown: int) -> DataFrame:
    """First callers and callees of each symbol in id order, as text and as totals."""
    sides = edges.select(
        *REPO_KEYS,
        F.explode(
            F.array(
                F.struct(F.col("dst").alias("sym_id"), F.lit("callers").alias("side"), F.col("src").alias("other")),
                F.struct(F.col("src").alias("sym_id"), F.lit("callees").alias("side"), F.col("dst").alias("other")),
            )
        ).alias("e"),
    ).select(*REPO_KEYS, "e.*")
    first = top_k(sides, REPO_KEYS + ["sym_id", "side"], ["other"], shown, "place")
    who = symbols.select(
        *REPO_KEYS, F.col("sym_id").alias("other"), "display", F.coalesce("path", F.lit("?")).alias("path"), "line"
    )
    named = first.join(who, REPO_KEYS + ["other"])
    return named.groupBy(*REPO_KEYS, "sym_id").pivot("side", ["callers", "callees"]).agg(
        F.array_sort(F.collect_list(F.struct("place", "display", "path", "line")))
    )


def _list_of(column: str, total: str, shown: int):
    names = F.array_join(F.col(column).getField("display"), ", ")
    more = F.when(F.col(total) > shown, F.format_string(" and %d more", F.col(total) - shown)).otherwise("")
    return F.concat(names, more)


def explanations(symbols: DataFrame, edges: DataFrame, shown: int = 3, hub_callers: int = 8) -> DataFrame:
    """What each declaration is, who needs it and what it needs, in plain sentences."""
    joined = symbols.join(_sides(symbols, edges, shown), REPO_KEYS + ["sym_id"], "left")
    fan_in, fan_out = F.col("fan_in"), F.col("fan_out")
    kind = F.format_string("%s: %s of %d lines.", "name", "kind", "span")
    callers = F.when(fan_in == 0, "No caller in this project.").otherwise(
        F.concat(F.format_string("Callers (%d): ", "fan_in"), _list_of("callers", "fan_in", shown), F.lit("."))
    )
    callees = F.when(fan_out == 0, "Makes no calls.").otherwise(
        F.concat(F.format_string("Makes calls to (%d): ", "fan_out"), _list_of("callees", "fan_out", shown), F.lit("."))
    )
    hub = F.when(fan_in >= hub_callers, "A hub: a change here is felt widely.")
    return joined.select(
        *REPO_KEYS, "sym_id", F.concat_ws(" ", kind, callers, callees, hub).alias("explanation")
    )


def who_calls(symbols: DataFrame, edges: DataFrame, shown: int = 6) -> DataFrame:
    """The first callers with their places and how many more there are."""
    joined = symbols.join(_sides(symbols, edges, shown), REPO_KEYS + ["sym_id"], "left")
    lines = F.array_join(
        F.transform("callers", lambda c: F.concat(c["display"], F.lit(" — "), c["path"], F.lit(":"), c["line"].cast("string"))),
        "\n",
    )
    more = F.when(F.col("fan_in") > shown, F.format_string("\nand %d more", F.col("fan_in") - shown)).otherwise("")
    answer = F.when(F.col("fan_in") == 0, "No caller in this project.").otherwise(F.concat(lines, more))
    return joined.select(*REPO_KEYS, "sym_id", answer.alias("answer"))


def glossary(spark: SparkSession) -> DataFrame:
    """``(word, lang, title)`` of the words explained to a reader; bodies are a user's own rows."""
    rows = [(word, "en", word) for word in rules.GLOSSARY_WORDS]
    return spark.createDataFrame(rows, "word string, lang string, title string")
