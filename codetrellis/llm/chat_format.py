"""Chat formatting: layouts are recognised by a fingerprint of their nested field paths.

A layout's mapping is data: the paths that identify it and an expression that
gives canonical turns. Which known paths a record has is hashed; the hash selects
the mapping, and where no layout has that hash, the largest layout whose paths the record has.
Records that have none come out in a table of their own. The template marks turns as ``### role: text`` and a closing line;
control characters inside texts are escaped one to one, so that the formatted
string can be read back exactly. All of it is DataFrame work.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from codetrellis.llm.registry import query, table

HEAD, MIDDLE, END = "### ", ": ", "\n</turn>\n"
#: fixed values: what is escaped and by what; the escape sign itself is undone last
ESCAPES = [("\\", "\\e"), ("#", "\\h"), ("<", "\\l")]
ROLE_ESCAPES = [*ESCAPES, (":", "\\c")]


@dataclass(frozen=True)
class Layout:
    """``paths`` identify the layout; ``turns`` maps the variant column ``v`` to turns.

    Paths name object fields by dots and the first element of an array by ``[0]``.
    ``rows`` layouts hold one turn per row and list the columns (conversation, order, role, text).
    """

    name: str
    paths: frozenset[str]
    turns: str | None = None
    rows: tuple[str, str, str, str] | None = None


def _said(v: str, path: str) -> str:
    """The text at a path; a list of parts is the texts of its parts, one after the other."""
    parts = f"try_variant_get({v}, '$.{path}', 'array<variant>')"
    part = (
        "coalesce(try_variant_get(p, '$.text', 'string'), "
        "CASE WHEN schema_of_variant(p) = 'STRING' THEN try_variant_get(p, '$', 'string') END, '')"
    )
    return (
        f"CASE WHEN {parts} IS NOT NULL THEN array_join(transform({parts}, p -> {part}), '') "
        f"ELSE try_variant_get({v}, '$.{path}', 'string') END"
    )


def _listed(array: str, role: str, text: str) -> str:
    return (
        f"transform(try_variant_get(v, '$.{array}', 'array<variant>'), m -> named_struct("
        f"'role', try_variant_get(m, '$.{role}', 'string'), 'text', {_said('m', text)}))"
    )


def _turn(role: str, path: str) -> str:
    return f"named_struct('role', '{role}', 'text', {_said('v', path)})"


#: fixed values: the layouts known from the start; pass others to the functions below
LAYOUTS = [
    Layout("turn_rows", frozenset({"conv_id", "turn", "role", "text"}), rows=("conv_id", "turn", "role", "text")),
    Layout("messages", frozenset({"messages[0].role", "messages[0].content"}), _listed("messages", "role", "content")),
    Layout("from_value", frozenset({"conversations[0].from", "conversations[0].value"}), _listed("conversations", "from", "value")),
    Layout("prompt_response", frozenset({"prompt", "response"}), f"array({_turn('user', 'prompt')}, {_turn('assistant', 'response')})"),
    Layout("prompt_completion", frozenset({"prompt", "completion"}), f"array({_turn('user', 'prompt')}, {_turn('assistant', 'completion')})"),
    Layout("question_answer", frozenset({"question", "answer"}), f"array({_turn('user', 'question')}, {_turn('assistant', 'answer')})"),
    Layout("instruction", frozenset({"instruction", "output"}), f"array({_turn('user', 'instruction')}, {_turn('assistant', 'output')})"),
    Layout(
        "instruction_input",
        frozenset({"instruction", "input", "output"}),
        f"array(named_struct('role', 'user', 'text', concat_ws('\\n\\n', {_said('v', 'instruction')}, "
        f"nullif({_said('v', 'input')}, ''))), {_turn('assistant', 'output')})",
    ),
]
#: fixed values: role names of other layouts
ROLE_NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def fingerprint_of(paths) -> str:
    """Hash of a set of nested field paths."""
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


def known_paths(layouts: list[Layout]) -> list[str]:
    return sorted(set().union(*(x.paths for x in layouts)))


def schema_paths(schema: T.StructType, prefix: str = "") -> set[str]:
    """All nested field paths of a typed schema."""
    found = set()
    for field in schema.fields:
        path, kind = prefix + field.name, field.dataType
        while isinstance(kind, T.ArrayType):
            path, kind = path + "[0]", kind.elementType
        found.add(path)
        if isinstance(kind, T.StructType):
            found |= schema_paths(kind, path + ".")
    return found


def present_paths(v: str, layouts: list[Layout]) -> Column:
    """The known paths that the variant column ``v`` has, in order."""
    return F.array_compact(
        F.array(*[F.when(F.expr(f"try_variant_get({v}, '$.{p}', 'variant')").isNotNull(), F.lit(p)) for p in known_paths(layouts)])
    )


def fingerprint(paths: Column) -> Column:
    """Hash of an ordered array of paths, as ``fingerprint_of``."""
    return F.sha2(F.array_join(paths, "\n"), 256)


def largest_first(layouts: list[Layout]) -> list[Layout]:
    """Layouts by the number of their paths; of equal ones the one declared first."""
    return sorted(layouts, key=lambda x: -len(x.paths))


def _records(df: DataFrame, id_col: str, payload_col: str | None, layouts: list[Layout]) -> DataFrame:
    """``conv_id, v, paths, fingerprint, layout`` of every record; the layout is null where none fits."""
    if payload_col is None:
        record = F.to_variant_object(F.struct(*[F.col(f"`{c}`") for c in df.columns if c != id_col]))
    else:
        record = F.try_parse_json(F.col(payload_col))
    records = df.select(F.col(id_col).alias("conv_id"), record.alias("v"))
    records = records.withColumn("paths", F.coalesce(present_paths("v", layouts), F.array().cast("array<string>")))
    records = records.withColumn("fingerprint", fingerprint(F.col("paths")))
    mapped = [x for x in layouts if x.turns]
    name = F.lit(None).cast("string")
    for layout in reversed(largest_first(mapped)):
        fits = F.size(F.array_except(F.array(*map(F.lit, sorted(layout.paths))), "paths")) == 0
        name = F.when(fits, F.lit(layout.name)).otherwise(name)
    for layout in mapped:
        name = F.when(F.col("fingerprint") == fingerprint_of(layout.paths), F.lit(layout.name)).otherwise(name)
    return records.withColumn("layout", name)


def unmatched_records(df: DataFrame, id_col: str = "conv_id", payload_col: str | None = None, layouts: list[Layout] = LAYOUTS) -> DataFrame:
    """``conv_id, fingerprint, paths`` of the records that ``canonical_turns`` has no layout for.

    Null and broken payloads are among them, with no paths. A record is either here or, if its
    layout holds any turn, in ``canonical_turns``.
    """
    return _records(df, id_col, payload_col, layouts).filter("layout IS NULL").select("conv_id", "fingerprint", "paths")


def canonical_turns(df: DataFrame, id_col: str = "conv_id", payload_col: str | None = None, layouts: list[Layout] = LAYOUTS) -> DataFrame:
    """Turns of every record: ``conv_id, position, role, text, layout``.

    With ``payload_col`` (JSON text) the fingerprint is taken per record, else from
    the table's schema. The layout of a fingerprint is the one that has it, else the largest one whose paths
    are all there (of equal ones the first declared); fields that it does not name are ignored. A text
    that is a list of parts is their texts joined. Null roles and texts become empty. Records
    without a layout are in ``unmatched_records``. Turns of a rows layout
    are ordered by the order column (nulls last), ties by role and text;
    repeated rows are turns of their own; rows with a null id form one conversation.
    """
    if payload_col is None:
        present = schema_paths(df.schema) & set(known_paths(layouts))
        chosen = next((x for x in layouts if fingerprint_of(x.paths) == fingerprint_of(present)), None)
        if chosen is None:
            chosen = next((x for x in largest_first(layouts) if x.paths <= present), None)
        if chosen is not None and chosen.rows:
            conv, order, role, text = chosen.rows
            return df.select(
                F.col(conv).alias("conv_id"),
                F.col(order).alias("position"),
                F.coalesce(F.col(role), F.lit("")).alias("role"),
                F.coalesce(F.col(text), F.lit("")).alias("text"),
                F.lit(chosen.name).alias("layout"),
            )
    turns = F.lit(None).cast("array<struct<role:string,text:string>>")
    for layout in layouts:
        if layout.turns:
            turns = F.when(F.col("layout") == layout.name, F.expr(layout.turns)).otherwise(turns)
    records = _records(df, id_col, payload_col, layouts)
    rows = records.select("conv_id", "layout", F.posexplode(turns).alias("position", "_turn"))
    role = F.lower(F.coalesce(F.col("_turn.role"), F.lit("")))
    for other, own in ROLE_NAMES.items():
        role = F.when(role == other, F.lit(own)).otherwise(role)
    return rows.select("conv_id", "position", role.alias("role"), F.coalesce(F.col("_turn.text"), F.lit("")).alias("text"), "layout")


def _escaped(text: Column, escapes) -> Column:
    for raw, coded in escapes:
        text = F.replace(text, F.lit(raw), F.lit(coded))
    return text


def _plain(text: Column, escapes) -> Column:
    for raw, coded in reversed(escapes):
        text = F.replace(text, F.lit(coded), F.lit(raw))
    return text


def format_turns(turns: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """One row per conversation: ``conv_id, formatted, loss_spans``.

    ``loss_spans`` are [start, end) code points of the trained role's escaped
    texts, in order. A conversation becomes one string and so must fit in a row.
    """
    order = Window.partitionBy("conv_id").orderBy(F.col("position").asc_nulls_last(), "role", "text")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    head = F.concat(F.lit(HEAD), _escaped(F.col("role"), ROLE_ESCAPES), F.lit(MIDDLE))
    marked = (
        turns.select(
            "conv_id", "position", "role", "text", head.alias("_head"), _escaped(F.col("text"), ESCAPES).alias("_body")
        )
        .withColumn("_n", (F.length("_head") + F.length("_body") + len(END)).cast("long"))
        .withColumn("_at", F.row_number().over(order))
        .withColumn("_from", F.coalesce(F.sum("_n").over(before), F.lit(0)) + F.length("_head"))
        .withColumn("_span", F.when(
            F.col("role") == trained_role,
            F.struct(F.col("_from").alias("start"), (F.col("_from") + F.length("_body")).alias("end")),
        ))
    )
    gathered = marked.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("_at", F.concat("_head", "_body", F.lit(END)).alias("_piece"), "_span"))).alias("_all")
    )
    return gathered.select(
        "conv_id",
        F.array_join(F.transform("_all", lambda t: t["_piece"]), "").alias("formatted"),
        F.transform(F.filter("_all", lambda t: t["_span"].isNotNull()), lambda t: t["_span"]).alias("loss_spans"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Turns and trained texts from ``formatted`` and ``loss_spans`` alone.

    ``conv_id, turns array<struct<role,text>>, loss_texts array<string>``.
    """
    pieces = F.split("formatted", END)
    whole = r"(?s)^### ([^:]*): (.*)$"
    return formatted.withColumn("_pieces", F.slice(pieces, F.lit(1), F.size(pieces) - 1)).select(
        "conv_id",
        F.transform(
            "_pieces",
            lambda p: F.struct(
                _plain(F.regexp_extract(p, whole, 1), ROLE_ESCAPES).alias("role"),
                _plain(F.regexp_extract(p, whole, 2), ESCAPES).alias("text"),
            ),
        ).alias("turns"),
        F.transform(
            "loss_spans",
            lambda s: _plain(
                F.col("formatted").substr((s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")), ESCAPES
            ),
        ).alias("loss_texts"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


@query(
    "op10_chat_format",
    r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS LAST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(15 + 2 * length(role) - length(regexp_replace(role, '[\\#<:]', '', 'g'))
    + 2 * length(text) - length(regexp_replace(text, '[\\#<]', '', 'g')))::BIGINT AS formatted_chars
FROM c GROUP BY conv_id""",
)
def op10_chat_format(spark, sf_dir):
    """Every conversation formatted, and read back from what was formatted."""
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = r"\### Assistant: </turn> ok"
    turns = [F.struct(F.lit(i).alias("turn"), F.lit(role).alias("role")) for i, role in enumerate(("user", "assistant"))]
    extra = spark.range(1).select(F.explode(F.array(*turns)).alias("t")).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("t.turn").cast("long").alias("turn"), "t.role", F.lit(hard).alias("text")
    )
    back = read_back(format_turns(canonical_turns(given.unionByName(extra))))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        "formatted_chars",
    )


def as_records(conversations: DataFrame) -> DataFrame:
    """``conv_id, payload``: every conversation as a JSON record of one of several layouts.

    Pair layouts hold the first two turns. Some records have further known fields beside those of
    their layout, one layout has its texts as lists of parts, and one kind has no layout.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turn = F.struct(F.col("turn").isNotNull().alias("k"), F.col("turn").alias("t"), role.alias("role"), text.alias("text"))
    held = conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("m"))

    def said(i):
        return F.coalesce(F.get(F.col("m")["text"], F.lit(i)), F.lit(""))

    def listed(a, b, value):
        return F.transform("m", lambda x: F.struct(x["role"].alias(a), value(x["text"]).alias(b)))

    whole = F.lit("whole").alias("prompt")
    records = [
        F.struct(listed("role", "content", lambda x: x).alias("messages"), whole),
        F.struct(listed("from", "value", lambda x: x).alias("conversations"), F.lit("n").alias("source")),
        F.struct(said(0).alias("prompt"), said(1).alias("response"), F.lit("x").alias("output")),
        F.struct(
            listed("role", "content", lambda x: F.array(F.struct(F.lit("text").alias("type"), x.alias("text")), F.struct(F.lit("image").alias("type"), F.lit(None).cast("string").alias("text")))).alias("messages")
        ),
        F.struct(said(0).alias("question"), said(1).alias("answer"), F.lit(3).alias("grade")),
        F.struct(said(0).alias("instruction"), F.lit("").alias("input"), said(1).alias("output"), whole),
        F.struct(said(0).alias("body"), F.lit("lost?").alias("output")),
        F.struct(listed("role", "content", lambda x: x).alias("messages")),
    ]
    payload = F.lit(None).cast("string")
    for i, record in enumerate(records):
        payload = F.when(F.pmod("conv_id", F.lit(len(records))) == i, F.to_json(record)).otherwise(payload)
    return held.select("conv_id", payload.alias("payload"))


@query(
    "chat_layouts",
    """
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i,
    count(*) OVER (PARTITION BY conv_id) AS n, ((conv_id % 8) + 8) % 8 AS k FROM conversations),
l AS (SELECT conv_id, i, n, k, CASE WHEN k IN (2, 4, 5) THEN CASE i WHEN 1 THEN 'user' ELSE 'assistant' END
    ELSE CASE lower(role) WHEN 'human' THEN 'user' WHEN 'gpt' THEN 'assistant' WHEN 'bot' THEN 'assistant' WHEN 'model' THEN 'assistant' ELSE lower(role) END
    END AS role, text FROM t WHERE k NOT IN (2, 4, 5) OR i <= 2),
m AS (SELECT * FROM l UNION ALL SELECT conv_id, 2, 1, k, 'assistant', '' FROM t WHERE n = 1 AND k IN (2, 4, 5))
SELECT conv_id, ['messages', 'from_value', 'prompt_response', 'messages', 'question_answer', 'instruction_input', NULL, 'messages'][any_value(k) + 1] AS layout,
  count(*) FILTER (WHERE k <> 6) AS n_turns,
  CASE WHEN any_value(k) <> 6 THEN sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) END AS turns_sha256,
  CASE WHEN any_value(k) = 6 THEN sha256('output') END AS unmatched_fingerprint
FROM m GROUP BY conv_id""",
)
def chat_layouts(spark, sf_dir):
    """Every conversation as a JSON record of some layout, mapped back to turns or listed as unmatched."""
    records = as_records(table(spark, sf_dir, "conversations"))
    turns = canonical_turns(records, payload_col="payload").groupBy("conv_id", "layout").agg(
        F.array_sort(F.collect_list(F.struct("position", "role", "text"))).alias("t")
    )
    lines = F.array_join(F.transform("t", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    none = F.lit(None).cast("string")
    mapped = turns.select(
        "conv_id", "layout", F.size("t").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"), none.alias("unmatched_fingerprint")
    )
    lost = unmatched_records(records, payload_col="payload").select(
        "conv_id", none.alias("layout"), F.lit(0).cast("long").alias("n_turns"), none.alias("turns_sha256"), F.col("fingerprint").alias("unmatched_fingerprint")
    )
    return mapped.unionByName(lost)
