"""The ``symbols`` and ``calls`` tables of a corpus."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from codetrellis.operators.facts import FactStore, list_files, text_facts
from codetrellis.session import REPO_KEYS, cut, distributed_rank
from codetrellis.sources.corpus import FILE_KEY

# declarations in one file; the file-size limit keeps their number below this
SYMBOLS_PER_FILE = 1 << 21


@dataclass
class Declarations:
    symbols: DataFrame
    calls: DataFrame


def declarations(files: DataFrame, store: FactStore | None = None, lexed: Observation | None = None) -> Declarations:
    """Extract every declaration and call site of ``files``.

    ``sym_id`` follows path order, then order in the file, inside a repository
    snapshot: ``file_no * 2^21 + position``. Each distinct text is lexed once (see ``facts``), its facts
    are joined to the files that have it, in a join that adaptive execution can split where very many have one. The
    facts are written once and both tables read them.
    """
    listed = list_files(files)
    numbered = distributed_rank(listed, REPO_KEYS, ["path"], "file_no")
    facts = text_facts(files, listed, store, lexed)
    facts = cut(
        facts.join(numbered, FILE_KEY)
        .withColumn(
            "sym_id",
            F.when(
                F.col("sym_at").isNotNull(),
                F.when(
                    F.col("ordinal") >= SYMBOLS_PER_FILE, F.raise_error(F.lit("a file has too many declarations to number"))
                ).otherwise(F.col("file_no") * F.lit(SYMBOLS_PER_FILE) + F.col("ordinal")),
            ).cast("bigint"),
        )
        .drop(*FILE_KEY, "ordinal", "file_no", "sym_at")
    )
    symbols = facts.filter("sym_id IS NOT NULL").drop("calls")
    call = F.col("call")
    calls = facts.select(
        *REPO_KEYS, "path", "language", F.col("sym_id").alias("caller_id"), "container",
        F.explode("calls").alias("call"),
    ).select(
        *REPO_KEYS, "path", "language", "caller_id", "container",
        call["callee"].alias("callee"),
        call["receiver"].alias("receiver"),
        call["line"].alias("line"),
    )
    return Declarations(symbols=symbols, calls=calls.withColumnRenamed("container", "caller_container"))
