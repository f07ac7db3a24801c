"""Queries over graphs found in the tables.

Session graph: a user's consecutive events. Assembly graph: part p needs parts
p/2 and p/3. Trade graph: customers call suppliers, nations are files.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from codetrellis.functions import scores
from codetrellis.operators import components, findings, graph, modules, reachability, routes, search, walks
from codetrellis.operators.explain import labels, with_label
from codetrellis.operators.quality import permutation_check
from codetrellis.session import REPO_KEYS, consecutive, cut
from suite.registry import query, shared, table

USER = ["user_id"]
ALL = ["repo"]

# --- session graph -----------------------------------------------------------

SESSION = """
step AS (
  SELECT user_id, event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events
),
edge AS (SELECT user_id, src, dst, count(*) AS n FROM step WHERE dst IS NOT NULL AND src <> dst GROUP BY ALL),
node AS (
  SELECT user_id, id, sum(i)::BIGINT AS fan_in, sum(o)::BIGINT AS fan_out FROM (
    SELECT user_id, src AS id, 0 AS i, 1 AS o FROM edge UNION ALL SELECT user_id, dst, 1, 0 FROM edge
    UNION ALL SELECT DISTINCT user_id, event_type, 0, 0 FROM events) GROUP BY ALL
)"""

CLOSURE = """
walk AS (SELECT user_id, src, dst FROM edge UNION SELECT w.user_id, w.src, e.dst FROM walk w JOIN edge e ON w.user_id = e.user_id AND w.dst = e.src)"""


def _session_sql(select: str, *ctes: str) -> str:
    return "WITH RECURSIVE " + ",\n".join([SESSION.strip(), *ctes]) + "\n" + select


def session_edges_table(spark, sf_dir):
    def build():
        events = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
        steps = consecutive(events, USER, ["ts", "event_id"])
        pairs = steps.select("user_id", F.col("event_type").alias("src"), F.col("next_event_type").alias("dst"))
        return cut(graph.fold_edges(pairs, USER))

    return shared(spark, sf_dir, "session edges", build)


def session_nodes_table(spark, sf_dir):
    nodes = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("id")).distinct()
    return graph.with_degrees(nodes, session_edges_table(spark, sf_dir), USER)


def session_sources(spark, sf_dir):
    return table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("source")).distinct()


@query("session_edges", _session_sql("SELECT user_id, src, dst, n FROM edge"))
def session_edges(spark, sf_dir):
    """A1 on consecutive events."""
    return session_edges_table(spark, sf_dir)


@query("session_degrees", _session_sql("SELECT user_id, id, fan_in, fan_out FROM node"))
def session_degrees(spark, sf_dir):
    """A2."""
    return session_nodes_table(spark, sf_dir)


@query(
    "session_hubs",
    _session_sql(
        "SELECT user_id, id, fan_in, fan_out, rank FROM (SELECT *, row_number() OVER "
        "(PARTITION BY user_id ORDER BY fan_in DESC, id) AS rank FROM node) WHERE rank <= 3 AND fan_in > 0"
    ),
)
def session_hubs(spark, sf_dir):
    """R1."""
    return graph.hubs(session_nodes_table(spark, sf_dir), USER, 3)


@query(
    "session_neighbours",
    _session_sql(
        "SELECT user_id, id, side, place, other, greatest(0, total - 2) AS hidden FROM (SELECT *, "
        "row_number() OVER (PARTITION BY user_id, id, side ORDER BY other) AS place, "
        "count(*) OVER (PARTITION BY user_id, id, side) AS total FROM ("
        "SELECT user_id, dst AS id, 'caller' AS side, src AS other FROM edge "
        "UNION ALL SELECT user_id, src, 'callee', dst FROM edge)) WHERE place <= 2"
    ),
)
def session_neighbours(spark, sf_dir):
    """J10, R14."""
    return graph.neighbours(session_edges_table(spark, sf_dir), USER, 2)


@query(
    "session_reciprocal",
    _session_sql(
        "SELECT a.user_id, a.src, a.dst FROM edge a JOIN edge b ON a.user_id = b.user_id AND a.src = b.dst AND a.dst = b.src WHERE a.src < a.dst"
    ),
)
def session_reciprocal(spark, sf_dir):
    """J12."""
    return graph.reciprocal_pairs(session_edges_table(spark, sf_dir), USER)


@query(
    "session_fan_bars",
    _session_sql(
        "SELECT user_id, id, fan_in, fan_out, fan_out / greatest(max(fan_out) OVER (PARTITION BY user_id), 1) AS fan_share FROM node"
    ),
)
def session_fan_bars(spark, sf_dir):
    """A13."""
    return graph.fan_bars(session_nodes_table(spark, sf_dir), USER)


@query("session_roots", _session_sql("SELECT user_id, id, fan_in, fan_out FROM node WHERE fan_in = 0"))
def session_roots(spark, sf_dir):
    """G9."""
    return graph.roots(session_nodes_table(spark, sf_dir))


@query(
    "session_reach",
    _session_sql(
        "SELECT n.user_id, n.id AS source, count(DISTINCT w.dst) FILTER (w.dst <> n.id) AS reach, false AS capped "
        "FROM node n LEFT JOIN walk w ON n.user_id = w.user_id AND n.id = w.src GROUP BY ALL",
        CLOSURE,
    ),
)
def session_reach(spark, sf_dir):
    """G1."""
    return walks.reach(session_edges_table(spark, sf_dir), session_sources(spark, sf_dir), USER)


@query(
    "session_blast",
    _session_sql(
        "SELECT n.user_id, n.id AS source, count(DISTINCT b.src) FILTER (b.src <> n.id) AS symbols, "
        "count(DISTINCT left(b.src, 1)) FILTER (b.src IS NOT NULL) AS files FROM node n LEFT JOIN ("
        "SELECT user_id, dst, src FROM edge UNION SELECT a.user_id, a.dst, b.src FROM edge a JOIN edge b ON a.user_id = b.user_id AND a.src = b.dst "
        "UNION SELECT user_id, id, id FROM node) b ON n.user_id = b.user_id AND n.id = b.dst GROUP BY ALL"
    ),
)
def session_blast(spark, sf_dir):
    """Callers within two hops; the first letter stands for the file."""
    places = session_sources(spark, sf_dir).select("user_id", F.col("source").alias("node"), F.left("source", F.lit(1)).alias("path"))
    return walks.blast(session_edges_table(spark, sf_dir), session_sources(spark, sf_dir), places, USER)


@query(
    "session_cycles",
    _session_sql(
        "SELECT a.user_id, a.src AS node, max(a.dst) AS comp FROM walk a JOIN walk b "
        "ON a.user_id = b.user_id AND a.src = b.dst AND a.dst = b.src GROUP BY ALL",
        CLOSURE,
    ),
)
def session_cycles(spark, sf_dir):
    """G5."""
    return components.components(session_edges_table(spark, sf_dir), USER)


# --- assembly graph ----------------------------------------------------------

ASSEMBLY = """
edge AS (
  SELECT DISTINCT 'all' AS repo, p_partkey AS src, p_partkey // d AS dst FROM part, (VALUES (2), (3)) v(d) WHERE p_partkey > 0
),
node AS (SELECT 'all' AS repo, p_partkey AS id FROM part)"""


def _assembly_sql(select: str, *ctes: str) -> str:
    return "WITH RECURSIVE " + ",\n".join([ASSEMBLY.strip(), *ctes]) + "\n" + select


def assembly_edges(spark, sf_dir):
    key = F.col("p_partkey")
    return (
        table(spark, sf_dir, "part")
        .filter(key > 0)
        .select(
            F.lit("all").alias("repo"),
            key.alias("src"),
            F.explode(F.array(F.floor(key / 2), F.floor(key / 3))).alias("dst"),
        )
        .distinct()
    )


def assembly_nodes(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.lit("all").alias("repo"), F.col("p_partkey").alias("id"))


_DISTANCE = """
walk AS (
  SELECT id, id AS root, 0 AS d, [id] AS path FROM node WHERE id NOT IN (SELECT dst FROM edge)
  UNION ALL SELECT e.dst, w.root, w.d + 1, list_append(w.path, e.dst) FROM walk w JOIN edge e ON w.id = e.src WHERE w.d < 8
)"""


@query(
    "assembly_depth",
    _assembly_sql(
        "SELECT n.repo, n.id, least(5, coalesce(max(d), 0)) AS depth FROM node n LEFT JOIN walk w USING (id) GROUP BY ALL",
        "walk AS (SELECT id, 0 AS d FROM node UNION SELECT e.dst, w.d + 1 FROM walk w JOIN edge e ON w.id = e.src WHERE w.d < 5)",
    ),
)
def assembly_depth(spark, sf_dir):
    """G6."""
    return walks.depth(assembly_nodes(spark, sf_dir), assembly_edges(spark, sf_dir), ALL)


@query(
    "assembly_backward",
    _assembly_sql(
        "SELECT e.repo, count(*) FILTER (b.depth <= a.depth) AS backward, count(*) AS edges FROM edge e "
        "JOIN deep a ON e.src = a.id JOIN deep b ON e.dst = b.id GROUP BY ALL",
        "walk AS (SELECT id, 0 AS d FROM node UNION SELECT e.dst, w.d + 1 FROM walk w JOIN edge e ON w.id = e.src WHERE w.d < 5)",
        "deep AS (SELECT id, max(d) AS depth FROM walk GROUP BY id)",
    ),
)
def assembly_backward(spark, sf_dir):
    """A11."""
    edges = assembly_edges(spark, sf_dir)
    return walks.backward_edges(edges, walks.depth(assembly_nodes(spark, sf_dir), edges, ALL), ALL)


@query(
    "assembly_chains",
    _assembly_sql(
        "SELECT n.repo, n.id, coalesce(list_aggregate(list_reverse(best.back), 'string_agg', '>'), n.id::VARCHAR) AS chain, "
        "best.back IS NOT NULL AS rooted FROM node n LEFT JOIN ("
        "SELECT w.id, min(list_reverse(w.path)) AS back FROM walk w "
        "JOIN (SELECT id, min(d) AS d FROM walk GROUP BY id) s ON w.id = s.id AND w.d = s.d GROUP BY w.id) best USING (id)",
        _DISTANCE,
    ),
)
def assembly_chains(spark, sf_dir):
    """The shortest path from a part nobody needs; ties by the smaller caller."""
    found = walks.chains(assembly_nodes(spark, sf_dir), assembly_edges(spark, sf_dir), ALL)
    return found.select("repo", "id", F.array_join(F.col("path").cast("array<string>"), ">").alias("chain"), "rooted")


@query(
    "assembly_reach",
    _assembly_sql(
        "SELECT n.repo, n.id AS source, count(DISTINCT w.dst) AS reach, false AS capped FROM node n LEFT JOIN walk w ON w.src = n.id GROUP BY ALL",
        "walk AS (SELECT src, dst FROM edge UNION SELECT w.src, e.dst FROM walk w JOIN edge e ON w.dst = e.src)",
    ),
)
def assembly_reach(spark, sf_dir):
    """G1 for every part; none needs 400 others."""
    sources = assembly_nodes(spark, sf_dir).withColumnRenamed("id", "source")
    return walks.reach(assembly_edges(spark, sf_dir), sources, ALL)


@query(
    "assembly_highlight",
    _assembly_sql(
        "SELECT DISTINCT 'all' AS repo, source, node FROM ("
        "SELECT s.source, w.dst AS node FROM src s JOIN walk w ON w.src = s.source "
        "UNION SELECT s.source, w.src FROM src s JOIN walk w ON w.dst = s.source UNION SELECT source, source FROM src)",
        "walk AS (SELECT src, dst FROM edge UNION SELECT w.src, e.dst FROM walk w JOIN edge e ON w.dst = e.src)",
        "src AS (SELECT n_nationkey::BIGINT AS source FROM nation)",
    ),
)
def assembly_highlight(spark, sf_dir):
    """Everything up- and downstream of the parts that nations are numbered like."""
    sources = table(spark, sf_dir, "nation").select(
        F.lit("all").alias("repo"), F.col("n_nationkey").cast("bigint").alias("source")
    )
    return walks.highlighted(assembly_edges(spark, sf_dir), sources, ALL)


def assembly_index(spark, sf_dir):
    def build():
        return reachability.index(assembly_nodes(spark, sf_dir).withColumnRenamed("id", "node"), assembly_edges(spark, sf_dir), ALL)

    return shared(spark, sf_dir, "assembly index", build)


_NEEDS = "walk AS (SELECT src, dst FROM edge UNION SELECT w.src, e.dst FROM walk w JOIN edge e ON w.dst = e.src)"


@query(
    "assembly_reach_all",
    _assembly_sql(
        "SELECT n.repo, n.id AS source, count(DISTINCT w.dst) AS reach FROM "
        "(SELECT repo, id FROM node UNION SELECT repo, dst FROM edge) n LEFT JOIN walk w ON w.src = n.id GROUP BY ALL",
        _NEEDS,
    ),
)
def assembly_reach_all(spark, sf_dir):
    """G1 without a limit, from the index of the condensed graph."""
    return reachability.reach_sizes(assembly_index(spark, sf_dir))


@query(
    "assembly_reachable",
    _assembly_sql(
        "SELECT q.repo, q.source, q.target, w.src IS NOT NULL AS reachable FROM (SELECT repo, id AS source, id // (2 * k) + id % k AS target "
        "FROM node, range(1, 6) r(k)) q LEFT JOIN walk w ON w.src = q.source AND w.dst = q.target",
        _NEEDS,
    ),
)
def assembly_reachable(spark, sf_dir):
    """Five questions for every part, answered from one index."""
    asked = assembly_nodes(spark, sf_dir).select(
        "repo", F.col("id").alias("source"), F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(5).cast("bigint"))).alias("k")
    )
    target = F.floor(F.col("source") / (2 * F.col("k"))) + F.col("source") % F.col("k")
    return reachability.reaches(assembly_index(spark, sf_dir), asked.select("repo", "source", target.alias("target")))


@query(
    "session_reach_all",
    _session_sql(
        "SELECT n.user_id, n.id AS source, count(DISTINCT w.dst) FILTER (w.dst <> n.id) AS reach "
        "FROM node n LEFT JOIN walk w ON n.user_id = w.user_id AND n.id = w.src GROUP BY ALL",
        CLOSURE,
    ),
)
def session_reach_all(spark, sf_dir):
    """G1 without a limit where cycles abound."""
    nodes = session_sources(spark, sf_dir).withColumnRenamed("source", "node")
    return reachability.reach_sizes(reachability.index(nodes, session_edges_table(spark, sf_dir), USER))


# --- ring graph: three parts in a row need each other, and each three the next ---

RING = """
n AS (SELECT p_partkey AS id, p_partkey // 3 AS g FROM part),
whole AS (SELECT g, max(id) AS comp FROM n GROUP BY g HAVING count(*) = 3)"""


def ring_edges(spark, sf_dir):
    key = F.col("p_partkey")
    place = key % 3
    ends = F.array(
        F.when(place < 2, key + 1),
        F.when(place == 2, key - 2),
        F.when(place == 2, key + 1),
    )
    steps = table(spark, sf_dir, "part").select(F.lit("all").alias("repo"), key.alias("src"), F.explode(F.array_compact(ends)).alias("dst"))
    known = table(spark, sf_dir, "part").select(key.alias("dst"))
    return steps.join(known, "dst", "left_semi").select("repo", "src", "dst")


@query("ring_cycles", "WITH " + RING.strip() + " SELECT 'all' AS repo, comp, id AS node FROM n JOIN whole USING (g)")
def ring_cycles(spark, sf_dir):
    """G5 on a long chain of cycles: one of three parts each, every one leading to the next."""
    return components.components(ring_edges(spark, sf_dir), ALL)


@query(
    "ring_reach",
    "WITH " + RING.strip() + ", m AS (SELECT max(id) AS top FROM n) SELECT 'all' AS repo, id AS source, "
    "CASE WHEN g IN (SELECT g FROM whole) THEN top - 3 * g ELSE top - id END AS reach FROM n, m",
)
def ring_reach(spark, sf_dir):
    """G1 where paths are as long as the graph is large: the chains of the index cover them."""
    nodes = table(spark, sf_dir, "part").select(F.lit("all").alias("repo"), F.col("p_partkey").alias("node"))
    return reachability.reach_sizes(reachability.index(nodes, ring_edges(spark, sf_dir), ALL))


# --- trade graph -------------------------------------------------------------

TRADE = """
place AS (
  SELECT n_nationkey, CASE n_regionkey WHEN 0 THEN 'src/view/' WHEN 1 THEN 'src/service/' WHEN 2 THEN 'src/store/'
    WHEN 3 THEN 'lib/model/' ELSE 'tools/cmd/' END || lower(n_name) || '.py' AS path,
    CASE n_regionkey WHEN 0 THEN 'ui' WHEN 1 THEN 'logic' WHEN 2 THEN 'data' WHEN 3 THEN 'model' ELSE 'entry' END AS layer,
    CASE n_regionkey WHEN 0 THEN 'interface' WHEN 1 THEN 'logic' WHEN 2 THEN 'data' WHEN 3 THEN 'data' ELSE 'interface' END AS district,
    CASE n_regionkey WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 2 ELSE 0 END AS district_rank
  FROM nation
),
bare AS (
  SELECT c_custkey * 2 AS sym_id, c_name AS name, path, (c_custkey % 40)::INTEGER AS branches, (c_custkey % 7)::INTEGER AS max_nesting,
         (c_custkey % 50 + 1)::INTEGER AS line, (c_custkey % 50 + 1 + c_custkey % 300)::INTEGER AS end_line
  FROM customer JOIN place ON c_nationkey = n_nationkey
  UNION ALL
  SELECT s_suppkey * 2 + 1, s_name, path, 0, 0, 1, (s_suppkey % 20)::INTEGER FROM supplier JOIN place ON s_nationkey = n_nationkey
),
edge AS (
  SELECT o_custkey * 2 AS src, l_suppkey * 2 + 1 AS dst, count(*) AS n
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL
),
node AS (
  SELECT b.*, coalesce(i.c, 0)::BIGINT AS fan_in, coalesce(o.c, 0)::BIGINT AS fan_out, greatest(1, end_line - line + 1) AS span,
         branches + 1 + 2 * max_nesting + greatest(0, greatest(1, end_line - line + 1) - 20) // 15 AS score
  FROM bare b LEFT JOIN (SELECT dst, count(*) c FROM edge GROUP BY 1) i ON sym_id = i.dst
  LEFT JOIN (SELECT src, count(*) c FROM edge GROUP BY 1) o ON sym_id = o.src
),
located AS (
  SELECT a.path AS src_path, b.path AS dst_path, n FROM edge JOIN bare a ON src = a.sym_id JOIN bare b ON dst = b.sym_id
),
module_edge AS (
  SELECT src_path, dst_path, sum(n)::BIGINT AS weight FROM located WHERE src_path <> dst_path GROUP BY ALL
  ORDER BY weight DESC, src_path, dst_path LIMIT 130
),
module AS (
  SELECT 'trade' AS repo, p.path, split_part(p.path, '/', 3) AS name, layer, district, district_rank, count(DISTINCT b.name) AS symbol_count, max(end_line) AS lines,
    (SELECT count(*) FROM located l WHERE l.src_path = p.path OR l.dst_path = p.path) AS weight,
    (SELECT count(*) FROM module_edge e WHERE e.dst_path = p.path) AS fan_in,
    (SELECT count(*) FROM module_edge e WHERE e.src_path = p.path) AS fan_out
  FROM place p JOIN bare b ON p.path = b.path GROUP BY ALL
)"""


def _trade_sql(select: str, *ctes: str) -> str:
    return "WITH RECURSIVE " + ",\n".join([TRADE.strip(), *ctes]) + "\n" + select


class Trade:
    def __init__(self, spark, sf_dir, whole=False):
        region = F.col("n_regionkey")
        folder = (
            F.when(region == 0, "src/view/").when(region == 1, "src/service/").when(region == 2, "src/store/")
            .when(region == 3, "lib/model/").otherwise("tools/cmd/")
        )
        place = table(spark, sf_dir, "nation").select(
            "n_nationkey", F.concat(folder, F.lower("n_name"), F.lit(".py")).alias("path")
        )

        def symbols(df, nation, **columns):
            named = df.join(place, F.col(nation) == F.col("n_nationkey"))
            return named.select(
                F.lit("trade").alias("repo"), F.lit("a").alias("snap"), "path",
                *[c.alias(k) for k, c in columns.items()],
            )

        key, sup = F.col("c_custkey"), F.col("s_suppkey")
        bare = symbols(
            table(spark, sf_dir, "customer"), "c_nationkey", sym_id=key * 2, name=F.col("c_name"),
            branches=(key % 40).cast("int"), max_nesting=(key % 7).cast("int"),
            line=(key % 50 + 1).cast("int"), end_line=(key % 50 + 1 + key % 300).cast("int"),
        ).unionByName(
            symbols(
                table(spark, sf_dir, "supplier"), "s_nationkey", sym_id=sup * 2 + 1, name=F.col("s_name"),
                branches=F.lit(0), max_nesting=F.lit(0), line=F.lit(1), end_line=(sup % 20).cast("int"),
            )
        ).withColumn("kind", F.lit("function")).withColumn("language", F.lit("python")).withColumn(
            "is_external", F.lit(False)
        ).withColumn("container", F.lit(None).cast("string"))
        # counted per (customer, order) rows first, so a hot order or supplier costs little
        items = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.count(F.lit(1)).alias("n"))
        orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
        raw = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
            F.lit("trade").alias("repo"), F.lit("a").alias("snap"),
            (F.col("o_custkey") * 2).alias("src"), (F.col("l_suppkey") * 2 + 1).alias("dst"), "n",
        )
        self.edges = cut(graph.fold_edges(raw, REPO_KEYS))
        shaped = bare.withColumn("display", scores.display_name(F.col("container"), F.col("name"))).withColumn(
            "span", scores.span(F.col("line"), F.col("end_line"))
        )
        scored = shaped.withColumn("score", scores.difficulty_score(F.col("branches"), F.col("max_nesting"), F.col("span")))
        self.symbols = cut(graph.with_degrees(scored, self.edges, REPO_KEYS, "sym_id"))
        nothing = self.edges.select(*REPO_KEYS, F.lit("").alias("src_path"), F.lit("").alias("dst_path")).filter("false")
        limits = (None, None) if whole else (modules.PICTURE_NODES, modules.PICTURE_EDGES)
        built = modules.collapse(self.symbols, self.edges, nothing, *limits)
        self.modules, self.module_edges = cut(built.modules), built.edges
        ends = self.module_edges.withColumnsRenamed({"src_path": "src", "dst_path": "dst"})
        self.components = cut(components.components(ends, REPO_KEYS).withColumnRenamed("node", "path"))


def trade(spark, sf_dir) -> Trade:
    """With the file graph as a picture shows it."""
    return shared(spark, sf_dir, "trade", lambda: Trade(spark, sf_dir))


def whole_trade(spark, sf_dir) -> Trade:
    """With the file graph as it is."""
    return shared(spark, sf_dir, "whole trade", lambda: Trade(spark, sf_dir, whole=True))


def _whole_sql(select: str, *ctes: str) -> str:
    """The same statements without the limits of picture and report."""
    text = _trade_sql(select, *ctes)
    for limit in (" LIMIT 130", " LIMIT 60", " LIMIT 6\n", " LIMIT 40", " QUALIFY rank <= 12"):
        text = text.replace(limit, "\n" if limit.endswith("\n") else "")
    return text


@query("trade_module_edges", _trade_sql("SELECT 'trade' AS repo, src_path, dst_path, weight FROM module_edge"))
def trade_module_edges(spark, sf_dir):
    """J11, A6, R3 on a complete graph."""
    return trade(spark, sf_dir).module_edges.drop("snap")


@query(
    "trade_modules",
    _trade_sql("SELECT repo, path, name, layer, symbol_count, lines, weight, fan_in, fan_out FROM module"),
)
def trade_modules(spark, sf_dir):
    """A5, A7, A8, P10, R2."""
    return trade(spark, sf_dir).modules.select(
        "repo", "path", "name", "layer", "symbol_count", "lines", "weight", "fan_in", "fan_out"
    )


_DISTRICTS = (
        "SELECT repo, district, files, symbols, symbols / greatest(sum(symbols) OVER (), 1) AS share, names FROM ("
        "SELECT repo, district, count(*) AS files, sum(symbol_count)::BIGINT AS symbols, "
        "string_agg(name, ' · ' ORDER BY k) FILTER (k <= 3) AS names FROM (SELECT *, row_number() OVER "
        "(PARTITION BY district ORDER BY fan_in + fan_out DESC, path) AS k FROM module) GROUP BY ALL)"
)
_MATRIX = (
        "SELECT repo, path, district, matrix_rank, min(matrix_rank) OVER (PARTITION BY district) AS district_start FROM ("
        "SELECT *, row_number() OVER (ORDER BY district_rank, symbol_count DESC, path) - 1 AS matrix_rank FROM module)"
)
_SEED = (
        "SELECT repo, path, depth, row_number() OVER (PARTITION BY depth ORDER BY district_rank, symbol_count DESC, path) - 1 AS seed_rank "
        "FROM module JOIN deep USING (path)"
)


@query(
    "trade_districts",
    _trade_sql(_DISTRICTS),
)
def trade_districts(spark, sf_dir):
    """A9, P12."""
    return modules.district_rollup(trade(spark, sf_dir).modules).drop("snap")


@query(
    "trade_matrix_order",
    _trade_sql(_MATRIX),
)
def trade_matrix_order(spark, sf_dir):
    """R10."""
    return modules.matrix_order(trade(spark, sf_dir).modules).drop("snap")


@query("trade_matrix_check", _trade_sql("SELECT DISTINCT repo, true AS is_permutation FROM module"))
def trade_matrix_check(spark, sf_dir):
    """V2."""
    ordered = modules.matrix_order(trade(spark, sf_dir).modules)
    return permutation_check(ordered, ["repo"], "matrix_rank")


_TRADE_CLOSURE = """
walk AS (SELECT src_path AS a, dst_path AS b FROM module_edge UNION SELECT w.a, e.dst_path FROM walk w JOIN module_edge e ON w.b = e.src_path),
comp AS (SELECT x.a AS path, max(x.b) AS comp FROM walk x JOIN walk y ON x.a = y.b AND x.b = y.a GROUP BY x.a),
comp_size AS (SELECT comp, count(*) AS size, min(path) AS first_path FROM comp GROUP BY comp HAVING count(*) > 1)"""


@query(
    "trade_cycles",
    _trade_sql("SELECT 'trade' AS repo, path, comp FROM comp JOIN comp_size USING (comp)", _TRADE_CLOSURE),
)
def trade_cycles(spark, sf_dir):
    """G5 on the kept file edges."""
    return trade(spark, sf_dir).components.drop("snap")


_TRADE_DEPTH = """
hop AS (SELECT path, 0 AS d FROM module UNION SELECT e.dst_path, h.d + 1 FROM hop h JOIN module_edge e ON h.path = e.src_path WHERE h.d < 5),
deep AS (SELECT path, max(d) AS depth FROM hop GROUP BY path)"""


@query(
    "trade_seed_order",
    _trade_sql(_SEED, _TRADE_DEPTH),
)
def trade_seed_order(spark, sf_dir):
    """G6, R11."""
    return _seeded(trade(spark, sf_dir))


def _seeded(t: Trade):
    ends = t.module_edges.withColumnsRenamed({"src_path": "src", "dst_path": "dst"})
    nodes = t.modules.select(*REPO_KEYS, F.col("path").alias("id"))
    depths = walks.depth(nodes, ends, REPO_KEYS).withColumnRenamed("id", "path")
    return modules.seed_order(t.modules, depths).drop("snap")


# the same five on the whole file graph: nothing is cut before the orders and shares

@query(
    "trade_modules_all",
    _whole_sql("SELECT repo, path, name, layer, symbol_count, lines, weight, fan_in, fan_out FROM module"),
)
def trade_modules_all(spark, sf_dir):
    """A5, A7, A8, P10 without a limit of files or edges."""
    return whole_trade(spark, sf_dir).modules.select(
        "repo", "path", "name", "layer", "symbol_count", "lines", "weight", "fan_in", "fan_out"
    )


@query("trade_districts_all", _whole_sql(_DISTRICTS))
def trade_districts_all(spark, sf_dir):
    """A9, P12 on the whole file graph."""
    return modules.district_rollup(whole_trade(spark, sf_dir).modules).drop("snap")


@query("trade_matrix_order_all", _whole_sql(_MATRIX))
def trade_matrix_order_all(spark, sf_dir):
    """R10 on the whole file graph."""
    return modules.matrix_order(whole_trade(spark, sf_dir).modules).drop("snap")


@query("trade_matrix_check_all", _whole_sql("SELECT DISTINCT repo, true AS is_permutation FROM module"))
def trade_matrix_check_all(spark, sf_dir):
    """V2 on the whole file graph."""
    return permutation_check(modules.matrix_order(whole_trade(spark, sf_dir).modules), ["repo"], "matrix_rank")


@query("trade_seed_order_all", _whole_sql(_SEED, _TRADE_DEPTH))
def trade_seed_order_all(spark, sf_dir):
    """G6, R11 on the whole file graph."""
    return _seeded(whole_trade(spark, sf_dir))


_TRADE_FINDINGS = _TRADE_CLOSURE + """,
cycles AS (
  SELECT 'cycle' AS kind, CASE WHEN size > 3 THEN 2 ELSE 1 END AS severity,
    (SELECT string_agg(split_part(path, '/', 3), ' → ' ORDER BY path) FROM (SELECT path FROM comp c WHERE c.comp = s.comp ORDER BY path LIMIT 4)) AS subject,
    size AS measure, size::VARCHAR AS detail, first_path AS path, 1 AS line
  FROM comp_size s ORDER BY size DESC, first_path LIMIT 6
),
found AS (
  SELECT * FROM cycles
  UNION ALL SELECT 'oversizedFile', CASE WHEN symbol_count > 90 THEN 2 WHEN symbol_count > 45 THEN 1 ELSE 0 END, name,
    CASE WHEN symbol_count > 45 THEN symbol_count ELSE lines END, (CASE WHEN symbol_count > 45 THEN symbol_count ELSE lines END)::VARCHAR, path, 1
    FROM module WHERE symbol_count > 45 OR lines > 900
  UNION ALL SELECT 'complexFunction', CASE WHEN score >= 44 THEN 2 ELSE 1 END, name, branches,
    branches || ' · ' || max_nesting || ' · ' || span, path, line FROM node WHERE score >= 22
  UNION ALL SELECT 'godFunction', 0, name, fan_in, fan_in::VARCHAR, path, line FROM node WHERE fan_in >= 45
  UNION ALL SELECT 'layerViolation', 1, a.name || ' → ' || b.name, e.weight, e.weight::VARCHAR, a.path, 1
    FROM module_edge e JOIN module a ON e.src_path = a.path JOIN module b ON e.dst_path = b.path WHERE a.layer = 'ui' AND b.layer = 'data'
  UNION ALL SELECT 'unreachable', 0, name, span, span::VARCHAR, path, line FROM (
    SELECT * FROM node WHERE fan_in = 0 ORDER BY sym_id LIMIT 40) WHERE span >= 4
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY kind ORDER BY severity DESC, measure DESC, path, line, subject) AS rank FROM found QUALIFY rank <= 12
)"""


@query(
    "trade_findings",
    _trade_sql(
        "SELECT 'trade' AS repo, kind, severity::INTEGER AS severity, subject, measure::BIGINT AS measure, detail, path, line, rank, "
        "row_number() OVER (ORDER BY severity DESC, kind, rank) AS place, "
        "CASE kind WHEN 'complexFunction' THEN split_part(detail, ' · ', 1) || ' branches · ' || split_part(detail, ' · ', 2) || ' deep · ' "
        "|| split_part(detail, ' · ', 3) || ' lines' WHEN 'godFunction' THEN detail || ' callers' WHEN 'unreachable' THEN detail || ' lines' "
        "WHEN 'cycle' THEN detail || ' files' WHEN 'layerViolation' THEN detail || ' calls' ELSE detail END AS measurement FROM ranked",
        _TRADE_FINDINGS,
    ),
)
def trade_findings(spark, sf_dir):
    """U1-U7, J13, R5, R12, P21."""
    t = trade(spark, sf_dir)
    found = findings.find_issues(t.symbols, t.modules, t.module_edges, t.components, findings.REPORT)
    measured = found.withColumn("measurement", findings.measurement(F.col("kind"), F.col("detail")))
    return measured.drop("snap", "sym_id", "of_kind")


@query(
    "trade_module_edges_all",
    _whole_sql("SELECT 'trade' AS repo, src_path, dst_path, weight FROM module_edge"),
)
def trade_module_edges_all(spark, sf_dir):
    """J11, A6 on the whole file graph."""
    return whole_trade(spark, sf_dir).module_edges.drop("snap")


@query(
    "trade_cycles_all",
    _whole_sql("SELECT 'trade' AS repo, path, comp FROM comp JOIN comp_size USING (comp)", _TRADE_CLOSURE),
)
def trade_cycles_all(spark, sf_dir):
    """G5 on the whole file graph."""
    return whole_trade(spark, sf_dir).components.drop("snap")


def _all_findings(spark, sf_dir):
    t = whole_trade(spark, sf_dir)
    return findings.find_issues(t.symbols, t.modules, t.module_edges, t.components)


@query(
    "trade_findings_all",
    _whole_sql(
        "SELECT 'trade' AS repo, kind, severity::INTEGER AS severity, subject, measure::BIGINT AS measure, detail, path, line, rank, "
        "count(*) OVER (PARTITION BY kind) AS of_kind, row_number() OVER (ORDER BY severity DESC, kind, rank) AS place FROM ranked",
        _TRADE_FINDINGS,
    ),
)
def trade_findings_all(spark, sf_dir):
    """U1-U7, J13 without report limits, with the true number of each kind."""
    return _all_findings(spark, sf_dir).drop("snap", "sym_id")


@query(
    "trade_advice",
    _whole_sql(
        "SELECT 'trade' AS repo, kind, CASE kind WHEN 'cycle' THEN 'files that need each other' WHEN 'oversizedFile' THEN 'a very large file' "
        "WHEN 'complexFunction' THEN 'hard to follow' WHEN 'godFunction' THEN 'leaned on everywhere' WHEN 'layerViolation' THEN 'a layer is skipped' "
        "ELSE 'nothing seems to call it' END AS label, CASE kind WHEN 'cycle' THEN 'move what both sides need into a file of its own' "
        "WHEN 'oversizedFile' THEN 'look for parts that can be read apart' WHEN 'complexFunction' THEN 'give its branches names of their own' "
        "WHEN 'godFunction' THEN 'change it in small steps and test its callers' WHEN 'layerViolation' THEN 'go through the layer between the two' "
        "ELSE 'check whether something calls it by name, else remove it' END AS advice, count(*) AS n FROM ranked GROUP BY ALL",
        _TRADE_FINDINGS,
    ),
)
def trade_advice(spark, sf_dir):
    """P20: what each kind of finding is called and what to do about it."""
    counted = _all_findings(spark, sf_dir).groupBy("repo", "kind").agg(F.count(F.lit(1)).alias("n"))
    wording = labels(spark)
    named = with_label(counted, wording, "finding", "kind", "label")
    return with_label(named, wording, "advice", "kind", "advice").select("repo", "kind", "label", "advice", "n")


@query(
    "trade_finding_counts_all",
    _whole_sql(
        "SELECT 'trade' AS repo, count(*) AS total, count(*) FILTER (severity = 2) AS high, count(*) FILTER (severity = 1) AS medium, "
        "count(*) FILTER (severity = 0) AS low FROM ranked",
        _TRADE_FINDINGS,
    ),
)
def trade_finding_counts_all(spark, sf_dir):
    """A10 over every finding."""
    return findings.finding_counts(_all_findings(spark, sf_dir)).drop("snap")


@query(
    "trade_finding_counts",
    _trade_sql(
        "SELECT 'trade' AS repo, count(*) AS total, count(*) FILTER (severity = 2) AS high, count(*) FILTER (severity = 1) AS medium, "
        "count(*) FILTER (severity = 0) AS low FROM ranked",
        _TRADE_FINDINGS,
    ),
)
def trade_finding_counts(spark, sf_dir):
    """A10."""
    t = trade(spark, sf_dir)
    shown = findings.find_issues(t.symbols, t.modules, t.module_edges, t.components, findings.REPORT)
    return findings.finding_counts(shown).drop("snap")


@query(
    "trade_entry_scores",
    _trade_sql(
        "SELECT 'trade' AS repo, sym_id, least(40, 2 * least(10, fan_out) + coalesce(beyond, 0)) AS entry_reach FROM node LEFT JOIN ("
        "SELECT src, sum(least(4, b.fan_out))::BIGINT AS beyond FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dst) k FROM edge) e "
        "JOIN node b ON e.dst = b.sym_id WHERE k <= 12 GROUP BY src) x ON sym_id = src WHERE fan_out >= 1"
    ),
)
def trade_entry_scores(spark, sf_dir):
    """G8."""
    t = trade(spark, sf_dir)
    return routes.entry_reach(routes.reading_nodes(t.symbols), t.edges).select("repo", "sym_id", "entry_reach")


_ENTRY = """
entry_points AS (
  SELECT *, entry_reach + CASE WHEN fan_in = 0 THEN 45 ELSE 0 END - CASE WHEN fan_in > 20 THEN 50 ELSE 0 END
    + CASE WHEN path LIKE 'src/%' OR path LIKE 'lib/%' THEN 20 ELSE 0 END - CASE WHEN span < 4 THEN 15 ELSE 0 END AS entry_score
  FROM (SELECT n.*, least(40, 2 * least(10, fan_out)) AS entry_reach FROM node n WHERE fan_out >= 1)
  ORDER BY entry_score DESC, sym_id LIMIT 1
)"""


@query("trade_entry_point", _trade_sql("SELECT 'trade' AS repo, sym_id, entry_score FROM entry_points", _ENTRY))
def trade_entry_point(spark, sf_dir):
    """R8, P17, P18; suppliers call nobody, so a customer's callees add nothing."""
    t = trade(spark, sf_dir)
    return routes.entry_points(routes.reading_nodes(t.symbols), t.edges).select("repo", "sym_id", "entry_score")


_ROUTE = _ENTRY + """,
options AS (
  SELECT b.sym_id, row_number() OVER (ORDER BY
    4 * least(12, b.fan_out) + least(6, b.fan_in) + CASE WHEN b.span >= 6 THEN 6 ELSE -10 END - CASE WHEN b.fan_out = 0 THEN 25 ELSE 0 END
    - CASE WHEN b.fan_in > 40 THEN 30 ELSE 0 END + CASE WHEN b.path LIKE 'src/%' OR b.path LIKE 'lib/%' THEN 12 ELSE 0 END
    + CASE WHEN regexp_replace(b.path, '/[^/]*$', '') = regexp_replace(p.path, '/[^/]*$', '') THEN 8 ELSE 0 END DESC, b.sym_id) AS k
  FROM entry_points p JOIN edge e ON e.src = p.sym_id JOIN node b ON b.sym_id = e.dst
),
steps AS (
  SELECT 1 AS step, sym_id, NULL::BIGINT AS reached_from FROM entry_points
  UNION ALL SELECT k + 1, o.sym_id, p.sym_id FROM options o, entry_points p WHERE k <= 5
)"""


@query("trade_route", _trade_sql("SELECT 'trade' AS repo, step, sym_id, reached_from FROM steps", _ROUTE))
def trade_route(spark, sf_dir):
    """Suppliers lead nowhere, so the route is the entry point widened by its callees."""
    t = trade(spark, sf_dir)
    return routes.route(t.symbols, t.edges).drop("snap")


@query(
    "trade_hubs_elsewhere",
    _trade_sql(
        "SELECT 'trade' AS repo, sym_id, fan_in, row_number() OVER (ORDER BY fan_in DESC, sym_id) AS rank FROM ("
        "SELECT * FROM node ORDER BY fan_in DESC, sym_id LIMIT 14) WHERE fan_in > 0 AND sym_id NOT IN (SELECT sym_id FROM steps) QUALIFY rank <= 8",
        _ROUTE,
    ),
)
def trade_hubs_elsewhere(spark, sf_dir):
    """J17."""
    t = trade(spark, sf_dir)
    return routes.hubs_elsewhere(t.symbols, routes.route(t.symbols, t.edges)).select("repo", "sym_id", "fan_in", "rank")


@query(
    "trade_route_progress",
    _trade_sql(
        "SELECT 'trade' AS repo, count(*) AS steps, count(*) FILTER (sym_id % 2 = 1 AND sym_id // 2 IN (SELECT doc_id FROM labels WHERE quality = 1)) AS understood FROM steps",
        _ROUTE,
    ),
)
def trade_route_progress(spark, sf_dir):
    """Suppliers whose number is a good document's are understood."""
    t = trade(spark, sf_dir)
    good = table(spark, sf_dir, "labels").filter("quality = 1").select((F.col("doc_id") * 2 + 1).alias("sym_id")).distinct()
    marks = t.symbols.join(good, "sym_id").select(
        "repo", scores.signature(F.col("path"), F.col("display"), F.col("line")).alias("signature")
    )
    return routes.route_progress(t.symbols, routes.route(t.symbols, t.edges), marks).drop("snap")


# --- search ------------------------------------------------------------------


@query(
    "part_search",
    """
SELECT repo, sym_id, needle, rank FROM (
  SELECT p_type AS repo, p_partkey AS sym_id, q.needle, row_number() OVER (PARTITION BY p_type, q.needle
    ORDER BY (lower(p_name) = q.needle) DESC, starts_with(lower(p_name), q.needle) DESC, p_size DESC, p_partkey) AS rank
  FROM part JOIN (SELECT DISTINCT split_part(p_name, ' ', 2) AS needle FROM part UNION SELECT DISTINCT lower(p_name) FROM part
                  UNION SELECT lower(substr(r_name, 1, 2)) FROM region UNION SELECT 'brand#1') q
    ON contains(lower(p_name), q.needle) OR contains(lower(p_brand), q.needle))
WHERE rank <= 40""",
)
def part_search(spark, sf_dir):
    """A table of questions over all names and containers."""
    part = table(spark, sf_dir, "part")
    symbols = part.select(
        F.col("p_type").alias("repo"), F.col("p_partkey").alias("sym_id"), F.col("p_name").alias("name"),
        F.col("p_brand").alias("container"), F.col("p_size").alias("fan_in"),
    )
    region = table(spark, sf_dir, "region")
    needles = (
        part.select(F.split_part("p_name", F.lit(" "), F.lit(2)).alias("needle"))
        .union(part.select(F.lower("p_name")))
        .union(region.select(F.lower(F.substr("r_name", F.lit(1), F.lit(2)))))
        .union(region.select(F.lit("Brand#1")))
        .distinct()
    )
    return search.search(symbols, needles, 40, ["repo"]).select("repo", "sym_id", "needle", "rank")
