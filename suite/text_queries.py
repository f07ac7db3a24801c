"""Queries over pages, documents, conversations and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from codetrellis.functions import paths, rules, scores
from codetrellis.operators.explain import labels, with_label
from codetrellis.operators.glossary import glossary_hits
from codetrellis.operators.lexing import role_histogram
from codetrellis.operators.references import attribute_references, is_local, without_query
from codetrellis.operators.styles import clean_selector
from codetrellis.sources.corpus import line_count
from codetrellis.sources.slices import line_slices
from suite.registry import query, table

# --- pages -------------------------------------------------------------------


@query(
    "page_references",
    r"""
SELECT page_id, reference, split_part(reference, '?', 1) AS target, count(*) AS times FROM (
  SELECT page_id, unnest(list_concat(regexp_extract_all(html, '[ \t\n]src="([^"]*)"', 1), regexp_extract_all(html, '[ \t\n]href="([^"]*)"', 1))) AS reference
  FROM pages)
WHERE length(reference) BETWEEN 1 AND 199 AND NOT regexp_matches(reference, '^(https?://|//|data:|mailto:|tel:|#|\{)')
GROUP BY ALL""",
)
def page_references(spark, sf_dir):
    """X17, P13, P14."""
    found = table(spark, sf_dir, "pages").select(
        "page_id", F.explode(attribute_references(F.col("html"))).alias("reference")
    )
    return (
        found.filter(is_local(F.col("reference")))
        .groupBy("page_id", "reference", without_query(F.col("reference")).alias("target"))
        .agg(F.count(F.lit(1)).alias("times"))
    )


_URL_PATH = "regexp_replace(regexp_replace(url, '[?#].*$', ''), '^https?://', '')"


@query(
    "page_paths",
    f"""
SELECT page_id, tidy AS path, split_part(tidy, '/', -1) AS base,
  CASE WHEN contains(tidy, '/') THEN regexp_replace(tidy, '/[^/]*$', '') ELSE '' END AS folder,
  coalesce(regexp_extract(split_part(tidy, '/', -1), '^.+\\.([^.]+)$', 1), '') AS ext,
  regexp_replace(tidy, '(/[^/.][^/]*)\\.[^./]+$', '\\1') AS stem,
  regexp_replace(tidy, '/[^/]*$', '') || '/extra' AS beside, false AS rooted
FROM (SELECT page_id, regexp_replace({_URL_PATH}, '/+$', '') AS tidy FROM pages)""",
)
def page_paths(spark, sf_dir):
    """P1-P4."""
    address = F.regexp_replace(F.regexp_replace("url", "[?#].*$", ""), "^https?://", "")
    tidy = table(spark, sf_dir, "pages").select("page_id", paths.clean(address).alias("path"))
    path = F.col("path")
    return tidy.select(
        "page_id",
        "path",
        paths.basename(path).alias("base"),
        paths.dirname(path).alias("folder"),
        paths.extension(path).alias("ext"),
        paths.stem(path).alias("stem"),
        paths.standardize(paths.join_path(path, F.lit("../extra"))).alias("beside"),
        paths.is_absolute(path).alias("rooted"),
    )


# --- documents ---------------------------------------------------------------


@query(
    "document_lines",
    "SELECT source, count(*) AS documents, sum(length(text) - length(replace(text, chr(10), '')) + 1)::BIGINT AS lines "
    "FROM documents GROUP BY source",
)
def document_lines(spark, sf_dir):
    """X3, A4."""
    return (
        table(spark, sf_dir, "documents")
        .groupBy("source")
        .agg(F.count(F.lit(1)).alias("documents"), F.sum(line_count(F.col("text"))).cast("bigint").alias("lines"))
    )


@query(
    "document_slices",
    """
SELECT doc_id::VARCHAR AS path, first, last, greatest(0, least(last, n) - least(first - 1, n)) AS line_count,
  least(first - 1, n) + 1 AS first_line,
  coalesce(list_aggregate(list_slice(lines, first, last), 'string_agg', chr(10)), '') AS text
FROM (SELECT doc_id, string_split(text, chr(10)) AS lines, len(string_split(text, chr(10))) AS n,
             (doc_id % 5 + 1)::INTEGER AS first, (doc_id % 5 + 1 + doc_id % 3)::INTEGER AS last FROM documents)""",
)
def document_slices(spark, sf_dir):
    """One request per document."""
    documents = table(spark, sf_dir, "documents")
    files = documents.select(
        F.col("source").alias("repo"), F.lit("a").alias("snap"), F.col("doc_id").cast("string").alias("path"),
        F.col("text").alias("content"),
    )
    first = (F.col("doc_id") % 5 + 1).cast("int")
    requests = documents.select(
        F.col("source").alias("repo"), F.lit("a").alias("snap"), F.col("doc_id").cast("string").alias("path"),
        first.alias("first"), (first + F.col("doc_id") % 3).cast("int").alias("last"),
    )
    return line_slices(files, requests).drop("repo", "snap")


_PLAIN = "translate(text, '\"''`/', '    ')"


def _roles_sql() -> str:
    words = ", ".join(f"'{w}'" for w in rules.ROLE_KEYWORDS)
    return f"""
SELECT source AS repo, role, count(*) AS tokens FROM (
  SELECT source, CASE
      WHEN regexp_matches(token, '^[0-9]') THEN 'number'
      WHEN NOT regexp_matches(token, '^[A-Za-z_\\x{{80}}-\\x{{10FFFF}}]') THEN 'punct'
      WHEN token IN ({words}) THEN 'keyword'
      WHEN following = '(' THEN 'function'
      WHEN regexp_matches(token, '^\\p{{Lu}}') THEN 'type' ELSE 'plain' END AS role
  FROM (SELECT source, list[k] AS token, list[k + 1] AS following FROM (
    SELECT source, list, unnest(range(1, len(list) + 1)) AS k FROM (
      SELECT source, regexp_extract_all({_PLAIN}, '[A-Za-z_\\x{{80}}-\\x{{10FFFF}}][0-9A-Za-z_\\x{{80}}-\\x{{10FFFF}}]*|[0-9][0-9A-Za-z_.\\x{{80}}-\\x{{10FFFF}}]*|[^ \\t\\r\\n]') AS list
      FROM documents))))
GROUP BY ALL"""


def _documents_as_code(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        F.col("source").alias("repo"), F.lit("a").alias("snap"), F.col("doc_id").cast("string").alias("path"),
        F.lit("javascript").alias("language"), F.translate("text", "\"'`/", "    ").alias("content"),
    )


@query("document_roles", _roles_sql())
def document_roles(spark, sf_dir):
    """X2, P26, A14 over whole documents; quotes and slashes are blanked on both sides."""
    return role_histogram(_documents_as_code(spark, sf_dir)).select("repo", "role", "tokens")


# comments, strings and what is between, as a script has them
_CHUNK = (
    r"//[^\n]*|/\*(?:[^*]|\*+[^*/])*(?:\*+/|\**)"
    r"""|"(?:[^"\\\n]|\\(?s:.)?)*"?|''(?:[^''\\\n]|\\(?s:.)?)*''?|`(?:[^`\\]|\\(?s:.)?)*`?"""
    r"""|[^"''`/]+|/"""
)
_LETTER = r"A-Za-z_\x{80}-\x{10FFFF}"


def _whole_roles_sql() -> str:
    words = ", ".join(f"'{w}'" for w in rules.ROLE_KEYWORDS)
    return rf"""
SELECT source AS repo, role, count(*) AS tokens FROM (
  SELECT source, CASE
      WHEN token = chr(1) THEN 'comment' WHEN token = chr(3) THEN 'string'
      WHEN regexp_matches(token, '^[0-9]') THEN 'number'
      WHEN NOT regexp_matches(token, '^[{_LETTER}]') THEN 'punct'
      WHEN token IN ({words}) THEN 'keyword'
      WHEN following = '(' THEN 'function'
      WHEN regexp_matches(token, '^\p{{Lu}}') THEN 'type' ELSE 'plain' END AS role
  FROM (SELECT source, list[k] AS token, list[k + 1] AS following FROM (
    SELECT source, list, unnest(range(1, len(list) + 1)) AS k FROM (
      SELECT source, flatten(list_transform(regexp_extract_all(text, '{_CHUNK}'), lambda c:
        CASE WHEN c LIKE '//%' OR c LIKE '/*%' THEN [chr(1)] WHEN left(c, 1) IN ('"', '''', '`') THEN [chr(3)]
          ELSE regexp_extract_all(c, '[{_LETTER}][0-9{_LETTER}]*|[0-9][0-9.{_LETTER}]*|[^ \t\r\n]') END)) AS list
      FROM documents))))
GROUP BY ALL"""


@query("document_roles_whole", _whole_roles_sql())
def document_roles_whole(spark, sf_dir):
    """X1, X2, P26, A14 over whole documents as they are, comments and strings included."""
    files = table(spark, sf_dir, "documents").select(
        F.col("source").alias("repo"), F.lit("a").alias("snap"), F.col("doc_id").cast("string").alias("path"),
        F.lit("javascript").alias("language"), F.col("text").alias("content"),
    )
    return role_histogram(files).select("repo", "role", "tokens")


_KNOWN_WORDS = rules.GLOSSARY_WORDS + ["the", "of", "la", "de", "und"]


def _glossary_sql() -> str:
    words = ", ".join(f"'{w}'" for w in _KNOWN_WORDS)
    return f"""
SELECT doc_id::VARCHAR AS path, word, row_number() OVER (PARTITION BY doc_id ORDER BY first_at) AS place FROM (
  SELECT doc_id, list[k] AS word, min(k) AS first_at FROM (
    SELECT doc_id, list, unnest(range(1, len(list) + 1)) AS k FROM (
      SELECT doc_id, regexp_extract_all({_PLAIN}, '[A-Za-z_\\x{{80}}-\\x{{10FFFF}}][0-9A-Za-z_\\x{{80}}-\\x{{10FFFF}}]*|[0-9][0-9A-Za-z_.\\x{{80}}-\\x{{10FFFF}}]*') AS list FROM documents))
  WHERE list[k] IN ({words}) GROUP BY ALL)
QUALIFY place <= 6"""


@query("document_glossary", _glossary_sql())
def document_glossary(spark, sf_dir):
    """X21 with a glossary widened by a few common words."""
    return glossary_hits(_documents_as_code(spark, sf_dir), _KNOWN_WORDS).select("path", "word", "place")


@query(
    "conversation_selectors",
    "SELECT conv_id, turn, CASE WHEN length(v) > 44 THEN left(v, 42) || '…' ELSE v END AS name FROM ("
    "SELECT conv_id, turn, trim(regexp_replace(replace(text, chr(10), ' '), ' {2,}', ' ', 'g')) AS v FROM conversations)",
)
def conversation_selectors(spark, sf_dir):
    """P25."""
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", clean_selector(F.translate("text", "\n", " ")).alias("name")
    )


# --- labels and numbers ------------------------------------------------------

_LAYERS = {0: "entry", 1: "ui", 2: "api", 3: "logic", 4: "model", 5: "data", 6: "util", 7: "config", 8: "test"}


@query(
    "part_layer_labels",
    "SELECT p_partkey, p_size % 9 AS layer_rank, CASE p_size % 9 WHEN 0 THEN 'interface' WHEN 1 THEN 'interface' WHEN 2 THEN 'logic' "
    "WHEN 3 THEN 'logic' WHEN 4 THEN 'data' WHEN 5 THEN 'data' WHEN 6 THEN 'logic' WHEN 7 THEN 'logic' ELSE 'data' END AS district, "
    "CASE p_size % 9 WHEN 0 THEN 'entry' WHEN 1 THEN 'user interface' WHEN 2 THEN 'network' WHEN 3 THEN 'logic' WHEN 4 THEN 'model' "
    "WHEN 5 THEN 'storage' WHEN 6 THEN 'utility' WHEN 7 THEN 'configuration' ELSE 'test' END AS label FROM part",
)
def part_layer_labels(spark, sf_dir):
    """P11, P12, P20."""
    names = F.create_map(*[F.lit(v) for item in _LAYERS.items() for v in item])
    layered = table(spark, sf_dir, "part").select(
        "p_partkey", F.try_element_at(names, (F.col("p_size") % 9).cast("int")).alias("layer")
    )
    return with_label(layered, labels(spark), "layer", "layer", "label").select(
        "p_partkey",
        scores.layer_rank(F.col("layer")).alias("layer_rank"),
        scores.district(F.col("layer")).alias("district"),
        "label",
    )


@query(
    "order_compact_numbers",
    "SELECT o_orderkey, CASE WHEN n >= 1000000 THEN printf('%.1fM', n / 1e6) WHEN n >= 10000 THEN printf('%.0fk', n / 1e3) "
    "WHEN n >= 1000 THEN printf('%.1fk', n / 1e3) ELSE n::VARCHAR END AS figure, "
    "CASE WHEN s < 1 THEN printf('%.0f ms', s * 1000) ELSE printf('%.2f s', s) END AS duration "
    "FROM (SELECT o_orderkey, floor(o_totalprice)::BIGINT * (1 + o_custkey % 9) AS n, (o_orderkey % 4096) / 1024 AS s FROM orders)",
)
def order_compact_numbers(spark, sf_dir):
    """P19."""
    n = F.floor("o_totalprice") * (1 + F.col("o_custkey") % 9)
    seconds = (F.col("o_orderkey") % 4096) / 1024
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", scores.compact_count(n).alias("figure"), scores.compact_seconds(seconds).alias("duration")
    )
