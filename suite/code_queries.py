"""Queries over the derived code corpus: extraction and resolution."""

from __future__ import annotations

from pyspark.sql import functions as F

from codetrellis.functions import rules, scores
from codetrellis.operators import explain, findings, graph, modules, ranking
from codetrellis.operators.declarations import declarations
from codetrellis.operators.quality import cover_holds
from codetrellis.operators.references import references
from suite import corpus
from suite.registry import query, shared


def declared(spark, sf_dir):
    return shared(spark, sf_dir, "declared", lambda: declarations(corpus.files(spark, sf_dir)))


@query("code_files", corpus.sql("SELECT repo, path, language, lines FROM file_rows"))
def code_files(spark, sf_dir):
    """S2-S8, X3."""
    return corpus.files(spark, sf_dir).select("repo", "path", "language", "lines")


@query(
    "code_symbols",
    corpus.sql("SELECT repo, path, name, container, kind, language, line, end_line, branches, max_nesting FROM sym"),
)
def code_symbols(spark, sf_dir):
    """X1-X8, X11-X14, X16."""
    return declared(spark, sf_dir).symbols.select(
        "repo", "path", "name", "container", "kind", "language", "line", "end_line", "branches", "max_nesting"
    )


@query(
    "code_symbol_order",
    corpus.sql(
        "SELECT repo, path, name, row_number() OVER (PARTITION BY repo, path ORDER BY place) AS place_in_file, "
        "dense_rank() OVER (PARTITION BY repo ORDER BY path) AS file_rank FROM "
        "(SELECT repo, path, place, name FROM sym UNION ALL SELECT repo, path, NULL, NULL FROM file_rows) "
        "QUALIFY name IS NOT NULL"
    ),
)
def code_symbol_order(spark, sf_dir):
    """Ids follow path order, then order in the file."""
    size = F.lit(1 << 21)
    return declared(spark, sf_dir).symbols.select(
        "repo",
        "path",
        "name",
        (F.col("sym_id") % size + 1).alias("place_in_file"),
        (F.floor(F.col("sym_id") / size) + 1).alias("file_rank"),
    )


@query(
    "code_calls",
    corpus.sql("SELECT repo, path, caller, callee, receiver, line, count(*) AS sites FROM site GROUP BY ALL"),
)
def code_calls(spark, sf_dir):
    """X9, X10, X15."""
    d = declared(spark, sf_dir)
    names = d.symbols.select("repo", "snap", F.col("sym_id").alias("caller_id"), F.col("name").alias("caller"))
    return (
        d.calls.join(names, ["repo", "snap", "caller_id"], "left")
        .groupBy("repo", "path", "caller", "callee", "receiver", "line")
        .agg(F.count(F.lit(1)).alias("sites"))
    )


@query("code_references", corpus.sql("SELECT repo, path, reference, count(*) AS times FROM refs GROUP BY ALL"))
def code_references(spark, sf_dir):
    """X17-X20, P13."""
    found = references(corpus.files(spark, sf_dir))
    return found.groupBy("repo", "path", "reference").agg(F.count(F.lit(1)).alias("times"))


@query(
    "code_file_refs",
    corpus.sql("SELECT DISTINCT repo, path AS src_path, dst_path FROM refs WHERE dst_path IS NOT NULL"),
)
def code_file_refs(spark, sf_dir):
    """J9, P1-P3, P14, U10."""
    return corpus.analysis(spark, sf_dir).file_refs.select("repo", "src_path", "dst_path")


def _named_edges(a):
    who = a.symbols.select("repo", "sym_id", "path", "name")
    return a.edges.join(
        who.withColumnsRenamed({"sym_id": "src", "path": "src_path", "name": "src_name"}), ["repo", "src"]
    ).join(who.withColumnsRenamed({"sym_id": "dst", "path": "dst_path", "name": "dst_name"}), ["repo", "dst"])


@query("code_edges", corpus.sql("SELECT repo, src_path, src_name, dst_path, dst_name, n FROM edge"))
def code_edges(spark, sf_dir):
    """J1-J7, A1."""
    return _named_edges(corpus.analysis(spark, sf_dir)).select(
        "repo", "src_path", "src_name", "dst_path", "dst_name", "n"
    )


@query(
    "code_external_edges",
    corpus.sql(
        "SELECT repo, path AS src_path, caller AS src_name, callee AS dst_name, count(*) AS n FROM site "
        "WHERE caller IS NOT NULL AND target IS NULL AND caller <> '{long}' "
        "AND NOT path LIKE '%.scss' GROUP BY ALL "
        "UNION ALL SELECT repo, path, caller, callee, count(*) FROM site WHERE path LIKE '%.scss' GROUP BY ALL"
    ),
)
def code_external_edges(spark, sf_dir):
    """Names nobody declares become symbols of their own."""
    named = _named_edges(corpus.analysis_with_externals(spark, sf_dir))
    return named.filter("dst_path IS NULL").select("repo", "src_path", "src_name", "dst_name", "n")


@query(
    "code_external_symbols",
    corpus.sql(
        "SELECT repo, callee AS name, row_number() OVER (PARTITION BY repo ORDER BY callee) AS place FROM "
        "(SELECT DISTINCT repo, callee FROM site WHERE caller IS NOT NULL AND target IS NULL)"
    ),
)
def code_external_symbols(spark, sf_dir):
    """One external symbol per name, after the known ones."""
    symbols = corpus.analysis_with_externals(spark, sf_dir).symbols
    first = symbols.filter("is_external").groupBy("repo").agg(F.min("sym_id").alias("first"))
    return symbols.filter("is_external").join(first, "repo").select(
        "repo", "name", (F.col("sym_id") - F.col("first") + 1).alias("place")
    )


@query(
    "code_nodes",
    corpus.sql(
        "SELECT repo, path, name, fan_in, fan_out, span::INTEGER AS span, score::INTEGER AS score, display, "
        "CASE WHEN score < 6 THEN 'easy' WHEN score < 13 THEN 'moderate' ELSE 'hard' END AS difficulty, "
        "1.6 * fan_in + 0.5 * fan_out + 1.0 AS weight, "
        "concat_ws('#', path, display, line::VARCHAR) AS signature, "
        "concat_ws(' · ', CASE WHEN branches > 0 THEN branches || CASE WHEN branches = 1 THEN ' branch' ELSE ' branches' END END, "
        "CASE WHEN max_nesting > 2 THEN 'nested ' || max_nesting || ' deep' END, span || ' lines') AS reason FROM node"
    ).replace("1.6 *", "1.6::DOUBLE *").replace("0.5 *", "0.5::DOUBLE *").replace("+ 1.0 AS", "+ 1.0::DOUBLE AS"),
)
def code_nodes(spark, sf_dir):
    """A2, P5-P9, P15, P22."""
    s = corpus.analysis(spark, sf_dir).symbols
    return s.select(
        "repo",
        "path",
        "name",
        "fan_in",
        "fan_out",
        "span",
        "score",
        "display",
        scores.difficulty_band(F.col("score")).alias("difficulty"),
        scores.node_weight(F.col("fan_in"), F.col("fan_out")).alias("weight"),
        scores.signature(F.col("path"), F.col("display"), F.col("line")).alias("signature"),
        scores.difficulty_reason(F.col("branches"), F.col("max_nesting"), F.col("span")).alias("reason"),
    )


@query(
    "code_hubs",
    corpus.sql(
        "SELECT repo, rank, path, name, fan_in FROM (SELECT *, row_number() OVER "
        "(PARTITION BY repo ORDER BY fan_in DESC, rank_id) AS rank FROM node) WHERE rank <= 12 AND fan_in > 0"
    ),
)
def code_hubs(spark, sf_dir):
    """R1, the flagship: what each repository leans on most."""
    a = corpus.analysis(spark, sf_dir)
    return graph.hubs(a.symbols, ["repo", "snap"], 12, "sym_id").select("repo", "rank", "path", "name", "fan_in")


@query(
    "code_roots",
    corpus.sql("SELECT repo, path, name FROM node WHERE fan_in = 0 AND kind <> 'type'"),
)
def code_roots(spark, sf_dir):
    """G9, P27."""
    return graph.roots(corpus.analysis(spark, sf_dir).symbols).select("repo", "path", "name")


@query(
    "code_unreachable",
    corpus.sql(
        "SELECT repo, path, name FROM node WHERE fan_in = 0 AND kind <> 'type' "
        "AND name NOT IN ('run', 'init') AND NOT starts_with(name, 'test') AND NOT starts_with(name, '_')"
    ),
)
def code_unreachable(spark, sf_dir):
    """G10, P16."""
    return findings.unreachable(corpus.analysis(spark, sf_dir).symbols).select("repo", "path", "name")


@query(
    "code_language_counts",
    corpus.sql(
        "SELECT repo, language, count(*) AS files FROM file_rows GROUP BY ALL"
    ),
)
def code_language_counts(spark, sf_dir):
    """A3."""
    return ranking.language_counts(corpus.files(spark, sf_dir)).select("repo", "language", "files")


@query(
    "code_top_languages",
    corpus.sql(
        "SELECT repo, language, files, row_number() OVER (PARTITION BY repo ORDER BY files DESC, language) AS rank "
        "FROM (SELECT repo, language, count(*) AS files FROM file_rows GROUP BY ALL) QUALIFY rank <= 3"
    ),
)
def code_top_languages(spark, sf_dir):
    """R13."""
    return ranking.top_languages(corpus.files(spark, sf_dir)).select("repo", "language", "files", "rank")


@query(
    "code_figures",
    corpus.sql(
        "SELECT f.repo, f.files, f.lines, s.symbols, s.readable, e.connections FROM "
        "(SELECT repo, count(*) files, sum(lines)::BIGINT AS lines FROM file_rows GROUP BY 1) f JOIN "
        "(SELECT repo, count(*) symbols, count(*) FILTER (kind <> 'type') readable FROM sym GROUP BY 1) s USING (repo) JOIN "
        "(SELECT repo, count(*) connections FROM edge GROUP BY 1) e USING (repo)"
    ),
)
def code_figures(spark, sf_dir):
    """A4, A15."""
    a = corpus.analysis(spark, sf_dir)
    return ranking.project_figures(a.files, a.symbols, a.edges).drop("snap")


@query(
    "code_starting_points",
    corpus.sql(
        "SELECT repo, path, name, start_score, row_number() OVER (PARTITION BY repo ORDER BY start_score DESC, fan_out DESC, rank_id) AS rank "
        "FROM (SELECT *, fan_out + CASE WHEN lower(name) IN ('main','run','start','app','init','serve','handle','execute') THEN 40 ELSE 0 END "
        "+ CASE WHEN fan_in = 0 THEN 12 ELSE 0 END + CASE WHEN span > 12 THEN 4 ELSE 0 END AS start_score FROM node "
        "WHERE kind <> 'type' AND fan_out >= 2) QUALIFY rank <= 8"
    ),
)
def code_starting_points(spark, sf_dir):
    """R7."""
    return ranking.starting_points(corpus.analysis(spark, sf_dir).symbols).select(
        "repo", "path", "name", "start_score", "rank"
    )


_SHOWN = """
per_name AS (
  SELECT *, row_number() OVER (PARTITION BY repo, path, name ORDER BY 2 * fan_in + fan_out DESC, kind = 'type', span DESC, rank_id) AS rn FROM node
),
shown AS (
  SELECT repo, path, name, language, row_number() OVER (PARTITION BY repo, path ORDER BY 2 * fan_in + fan_out DESC, kind = 'type', span DESC, rank_id) AS place
  FROM per_name WHERE rn = 1
)"""


@query("code_shown_symbols", corpus.sql("SELECT repo, path, name, place FROM shown WHERE place <= 12", _SHOWN))
def code_shown_symbols(spark, sf_dir):
    """R4."""
    return modules.shown_symbols(corpus.analysis(spark, sf_dir).symbols).select("repo", "path", "name", "place")


_LAYER = (
    "CASE split_part(s.path, '/', 2) WHEN 'view' THEN 'ui' WHEN 'api' THEN 'api' WHEN 'model' THEN 'model' "
    "WHEN 'store' THEN 'data' WHEN 'cmd' THEN 'entry' "
    "ELSE CASE WHEN s.path LIKE '%util%' THEN 'util' ELSE 'logic' END END"
)
_MODULES = f"""
weights AS (
  SELECT repo, path, count(*) AS weight FROM (
    SELECT repo, src_path AS path FROM edge
    UNION ALL SELECT repo, dst_path FROM edge WHERE src_path <> dst_path) GROUP BY ALL
),
figures AS (
  SELECT s.repo, s.path, any_value(language) AS language, count(DISTINCT name) AS symbol_count, max(end_line) AS lines,
         coalesce(any_value(w.weight), 0) AS weight, {_LAYER} AS layer
  FROM sym s LEFT JOIN weights w ON s.repo = w.repo AND s.path = w.path GROUP BY s.repo, s.path
),
kept AS (
  SELECT *, row_number() OVER (PARTITION BY repo ORDER BY weight DESC, path) AS place FROM figures QUALIFY place <= 60
),
all_file_edges AS (
  SELECT repo, src_path, dst_path, sum(w)::BIGINT AS weight FROM (
    SELECT repo, src_path, dst_path, n AS w FROM edge WHERE src_path <> dst_path
    UNION ALL SELECT DISTINCT repo, path, dst_path, 3 FROM refs WHERE dst_path IS NOT NULL) GROUP BY ALL
),
module_edge AS (
  SELECT e.* FROM all_file_edges e
  WHERE EXISTS (SELECT 1 FROM kept k WHERE k.repo = e.repo AND k.path = e.src_path)
    AND EXISTS (SELECT 1 FROM kept k WHERE k.repo = e.repo AND k.path = e.dst_path)
  QUALIFY row_number() OVER (PARTITION BY e.repo ORDER BY weight DESC, src_path, dst_path) <= 130
),
module AS (
  SELECT k.*, split_part(path, '/', -1) AS name, split_part(path, '/', 1) || '/' || split_part(path, '/', 2) AS directory,
    (SELECT count(*) FROM module_edge e WHERE e.repo = k.repo AND e.dst_path = k.path) AS fan_in,
    (SELECT count(*) FROM module_edge e WHERE e.repo = k.repo AND e.src_path = k.path) AS fan_out
  FROM kept k
)"""


@query(
    "code_modules",
    corpus.sql(
        "SELECT repo, path, name, directory, layer, language, symbol_count, lines, weight, fan_in, fan_out FROM module",
        _MODULES,
    ),
)
def code_modules(spark, sf_dir):
    """A5, A7, A8, P10, R2."""
    return corpus.analysis(spark, sf_dir).modules.select(
        "repo", "path", "name", "directory", "layer", "language", "symbol_count", "lines", "weight", "fan_in", "fan_out"
    )


@query(
    "code_module_edges_uncapped",
    corpus.sql(
        "SELECT repo, src_path, dst_path, weight FROM all_file_edges "
        "WHERE src_path IN (SELECT path FROM sym) AND dst_path IN (SELECT path FROM sym)",
        _MODULES,
    ),
)
def code_module_edges_uncapped(spark, sf_dir):
    """A6, J11 with both caps lifted."""
    a = corpus.analysis(spark, sf_dir)
    return modules.collapse(a.symbols, a.edges, a.file_refs, None, None).edges.drop("snap")


@query("code_module_edges", corpus.sql("SELECT repo, src_path, dst_path, weight FROM module_edge", _MODULES))
def code_module_edges(spark, sf_dir):
    """A6, J11, R3."""
    return corpus.analysis(spark, sf_dir).module_edges.drop("snap")


@query(
    "code_explanations",
    corpus.sql(
        "SELECT n.repo, n.path, n.name, n.line, n.name || ': ' || n.kind || ' of ' || n.span || ' lines. ' || "
        "CASE WHEN fan_in = 0 THEN 'No caller in this project.' ELSE 'Callers (' || fan_in || '): ' || i.names || "
        "CASE WHEN fan_in > 3 THEN ' and ' || (fan_in - 3) || ' more' ELSE '' END || '.' END || ' ' || "
        "CASE WHEN fan_out = 0 THEN 'Makes no calls.' ELSE 'Makes calls to (' || fan_out || '): ' || o.names || "
        "CASE WHEN fan_out > 3 THEN ' and ' || (fan_out - 3) || ' more' ELSE '' END || '.' END || "
        "CASE WHEN fan_in >= 8 THEN ' A hub: a change here is felt widely.' ELSE '' END AS explanation "
        "FROM node n LEFT JOIN callers i ON n.repo = i.repo AND n.path = i.dst_path AND n.name = i.dst_name AND n.kind <> 'type' "
        "LEFT JOIN callees o ON n.repo = o.repo AND n.path = o.src_path AND n.name = o.src_name AND n.kind <> 'type'",
        """
callers AS (
  SELECT repo, dst_path, dst_name, string_agg(display, ', ' ORDER BY rank_id) AS names FROM (
    SELECT e.repo, e.dst_path, e.dst_name, n.display, n.rank_id,
           row_number() OVER (PARTITION BY e.repo, e.dst_path, e.dst_name ORDER BY n.rank_id) AS k
    FROM edge e JOIN node n ON n.repo = e.repo AND n.path = e.src_path AND n.name = e.src_name AND n.kind <> 'type')
  WHERE k <= 3 GROUP BY ALL
),
callees AS (
  SELECT repo, src_path, src_name, string_agg(display, ', ' ORDER BY rank_id) AS names FROM (
    SELECT e.repo, e.src_path, e.src_name, n.display, n.rank_id,
           row_number() OVER (PARTITION BY e.repo, e.src_path, e.src_name ORDER BY n.rank_id) AS k
    FROM edge e JOIN node n ON n.repo = e.repo AND n.path = e.dst_path AND n.name = e.dst_name AND n.kind <> 'type')
  WHERE k <= 3 GROUP BY ALL
)""",
    ),
)
def code_explanations(spark, sf_dir):
    """P23, J10, R14."""
    a = corpus.analysis(spark, sf_dir)
    return a.explanations().join(a.symbols.select("repo", "snap", "sym_id", "path", "name", "line"), ["repo", "snap", "sym_id"]).select(
        "repo", "path", "name", "line", "explanation"
    )


@query(
    "code_project_kinds",
    corpus.sql(
        "SELECT repo, CASE WHEN max(hits) >= 2 THEN arg_max(kind, hits * 100 - place) ELSE 'library' END AS project_kind FROM ("
        "SELECT r.repo, k.kind, k.place, count(DISTINCT k.word) FILTER (contains(t.text, k.word)) AS hits "
        "FROM (SELECT DISTINCT repo FROM file_rows) r JOIN texts t USING (repo), words k GROUP BY ALL) GROUP BY repo",
        """
texts AS (
  SELECT repo, lower(path) AS text FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY path) k FROM file_rows) WHERE k <= 400
  UNION ALL SELECT repo, lower(name) FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY fan_in DESC, rank_id) k FROM node) WHERE k <= 30 AND fan_in > 0
),
words AS (SELECT * FROM (VALUES
""" + ", ".join(
            f"({place}, '{kind}', '{word}')"
            for place, (kind, words) in enumerate(rules.PROJECT_KINDS)
            for word in words
        ) + ") AS w(place, kind, word))",
    ),
)
def code_project_kinds(spark, sf_dir):
    """A12."""
    a = corpus.analysis(spark, sf_dir)
    return ranking.project_kinds(a.files, a.symbols).select("repo", "project_kind")


@query(
    "code_project_kinds_all",
    corpus.sql(
        "SELECT repo, CASE WHEN max(hits) >= 2 THEN arg_max(kind, hits * 100 - place) ELSE 'library' END AS project_kind FROM ("
        "SELECT r.repo, k.kind, k.place, count(DISTINCT k.word) FILTER (contains(t.text, k.word)) AS hits "
        "FROM (SELECT DISTINCT repo FROM file_rows) r JOIN texts t USING (repo), words k GROUP BY ALL) GROUP BY repo",
        "texts AS (SELECT repo, lower(path) AS text FROM file_rows UNION ALL SELECT repo, lower(name) FROM node WHERE fan_in > 0),"
        "words AS (SELECT * FROM (VALUES " + ", ".join(
            f"({place}, '{kind}', '{word}')" for place, (kind, words) in enumerate(rules.PROJECT_KINDS) for word in words
        ) + ") AS w(place, kind, word))",
    ),
)
def code_project_kinds_all(spark, sf_dir):
    """A12 from all paths and all called names."""
    a = corpus.analysis(spark, sf_dir)
    return ranking.project_kinds(a.files, a.symbols, None, None).select("repo", "project_kind")


@query(
    "code_cover",
    corpus.sql("SELECT repo, language, count(*) AS files, count(*) AS covered FROM file_rows GROUP BY ALL"),
)
def code_cover(spark, sf_dir):
    """Blanking keeps length and line breaks of every file."""


    held = corpus.files(spark, sf_dir).select(
        "repo", "language", cover_holds(F.col("content"), F.col("language")).alias("ok")
    )
    return held.groupBy("repo", "language").agg(
        F.count(F.lit(1)).alias("files"), F.count_if(F.col("ok")).alias("covered")
    )


@query(
    "code_who_calls",
    corpus.sql(
        "SELECT n.repo, n.path, n.name, n.line, CASE WHEN fan_in = 0 THEN 'No caller in this project.' ELSE c.names || "
        "CASE WHEN fan_in > 6 THEN chr(10) || 'and ' || (fan_in - 6) || ' more' ELSE '' END END AS answer "
        "FROM node n LEFT JOIN callers c ON n.repo = c.repo AND n.path = c.dst_path AND n.name = c.dst_name AND n.kind <> 'type'",
        """
callers AS (
  SELECT repo, dst_path, dst_name, string_agg(display || ' — ' || path || ':' || line, chr(10) ORDER BY rank_id) AS names FROM (
    SELECT e.repo, e.dst_path, e.dst_name, n.display, n.path, n.line, n.rank_id,
           row_number() OVER (PARTITION BY e.repo, e.dst_path, e.dst_name ORDER BY n.rank_id) AS k
    FROM edge e JOIN node n ON n.repo = e.repo AND n.path = e.src_path AND n.name = e.src_name AND n.kind <> 'type')
  WHERE k <= 6 GROUP BY ALL
)""",
    ),
)
def code_who_calls(spark, sf_dir):
    """P24, J10, R14."""
    a = corpus.analysis(spark, sf_dir)
    places = a.symbols.select("repo", "snap", "sym_id", "path", "name", "line")
    return explain.who_calls(a.symbols, a.edges).join(places, ["repo", "snap", "sym_id"]).select(
        "repo", "path", "name", "line", "answer"
    )


@query(
    "code_summary",
    corpus.sql(
        "SELECT f.repo, f.files, f.lines, s.symbols, e.connections, h.hubs, l.languages FROM "
        "(SELECT repo, count(*) files, sum(lines)::BIGINT AS lines FROM file_rows GROUP BY 1) f JOIN "
        "(SELECT repo, count(*) symbols FROM sym GROUP BY 1) s USING (repo) JOIN "
        "(SELECT repo, count(*) connections FROM edge GROUP BY 1) e USING (repo) JOIN "
        "(SELECT repo, string_agg(display || '=' || fan_in, ',' ORDER BY fan_in DESC, rank_id) AS hubs FROM ("
        "SELECT *, row_number() OVER (PARTITION BY repo ORDER BY fan_in DESC, rank_id) k FROM node) WHERE k <= 3 GROUP BY 1) h USING (repo) JOIN "
        "(SELECT repo, string_agg(language, ',' ORDER BY n DESC, language) AS languages FROM ("
        "SELECT repo, language, count(*) n, row_number() OVER (PARTITION BY repo ORDER BY count(*) DESC, language) k FROM file_rows GROUP BY 1, 2) "
        "WHERE k <= 3 GROUP BY 1) l USING (repo)"
    ),
)
def code_summary(spark, sf_dir):
    """K4: the one-row summary of each repository."""
    hubs = F.array_join(
        F.transform("top_hubs", lambda h: F.concat(h["name"], F.lit("="), h["callers"].cast("string"))), ","
    )
    return corpus.analysis(spark, sf_dir).summary().select(
        "repo", "files", "lines", "symbols", "connections", hubs.alias("hubs"), F.array_join("languages", ",").alias("languages")
    )
