"""A corpus in which every rule of call resolution decides something, and texts of a language given by rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from codetrellis.functions.rulebook import RULE_ROWS, Rulebook, using
from codetrellis.operators.declarations import declarations
from codetrellis.operators.lexing import comment_depth
from codetrellis.plans.analysis import Analysis, Options
from codetrellis.sources.corpus import read_corpus
from suite.registry import dealt, query, shared, table

# --- names that many types declare --------------------------------------------

#: every part gives one of each; all parts of a brand share the names grow, tend and append
MEMBERS = {
    "j/a_{p}.py": """class Alpha_{p}:
    def grow(self, n):
        return self.tend(n)

    def tend(self, n):
        return n

def start_{p}(x):
    Beta_{p}.grow(x)
    x.append(1)
    grow(x)
    x.tend(2)
""",
    "j/b_{p}.py": """class Beta_{p}:
    def grow(self, n):
        return self.tend(n)

    def tend(self, n):
        return n

    def append(self, n):
        return n

def stop_{p}(x):
    x.append(1)
    Gamma_{p}.grow(x)
""",
    "j/c_{p}.py": """def far_{p}(x):
    tend(x)
    tend(x)
""",
}

#: caller file, caller, its container, file of the target (None: the first of the repository), target, its container, sites
CHOSEN = [
    ("a", "grow", "Alpha_", "a", "tend", "Alpha_", 1),
    ("a", "start_{p}", None, "b", "grow", "Beta_", 1),
    ("a", "start_{p}", None, "a", "grow", "Alpha_", 1),
    ("a", "start_{p}", None, "a", "tend", "Alpha_", 1),
    ("b", "grow", "Beta_", "b", "tend", "Beta_", 1),
    ("b", "stop_{p}", None, "b", "append", "Beta_", 1),
    ("b", "stop_{p}", None, "b", "grow", "Beta_", 1),
    ("c", "far_{p}", None, None, "tend", "Alpha_", 2),
]


def _filled(templates: dict[str, str], parts, snap: str = "a"):
    def text(t):
        return F.replace(t, F.lit("{p}"), F.col("p_partkey").cast("string"))

    one_each = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(body).alias("body")) for name, body in templates.items()])
    rows = dealt(parts.select("p_partkey", "p_brand"), "p_partkey").select("p_partkey", "p_brand", F.explode(one_each).alias("t"))
    return rows.select(
        F.col("p_brand").alias("repo"), F.lit(snap).alias("snap"), text(F.col("t.name")).alias("path"), text(F.col("t.body")).alias("content")
    )


def _chosen_sql() -> str:
    rows = ", ".join(
        "(" + ", ".join("NULL" if v is None else str(v) if isinstance(v, int) else f"'{v}'" for v in row) + ")" for row in CHOSEN
    )
    return f"""
SELECT p_brand AS repo, 'j/' || src || '_' || p_partkey || '.py' AS src_path, replace(caller, '{{p}}', p_partkey::VARCHAR) AS src_name,
  CASE WHEN dst IS NULL THEN min('j/a_' || p_partkey || '.py') OVER (PARTITION BY p_brand) ELSE 'j/' || dst || '_' || p_partkey || '.py' END AS dst_path,
  callee AS dst_name,
  holder || CASE WHEN dst IS NULL THEN regexp_extract(min('j/a_' || p_partkey || '.py') OVER (PARTITION BY p_brand), '([0-9]+)', 1)
    ELSE p_partkey::VARCHAR END AS dst_container, n::BIGINT AS n
FROM part, (VALUES {rows}) v(src, caller, caller_holder, dst, callee, holder, n)"""


@query("code_call_choice", _chosen_sql())
def code_call_choice(spark, sf_dir):
    """The receiver's type, a guarded name, the caller's own type, its file, the first of the repository."""
    a = Analysis(read_corpus(_filled(MEMBERS, table(spark, sf_dir, "part"))))
    who = a.symbols.select("repo", "sym_id", "path", "name", "container")
    src = who.select("repo", F.col("sym_id").alias("src"), F.col("path").alias("src_path"), F.col("name").alias("src_name"))
    dst = who.select(
        "repo", F.col("sym_id").alias("dst"), F.col("path").alias("dst_path"), F.col("name").alias("dst_name"), F.col("container").alias("dst_container")
    )
    return a.edges.join(src, ["repo", "src"]).join(dst, ["repo", "dst"]).drop("src", "dst", "snap")


# --- comments of any depth -----------------------------------------------------


@query(
    "part_nested_comments",
    "SELECT p_partkey, p_partkey % 60 + 1 AS depth, 'a_' || p_partkey AS name, 1 AS line, (p_partkey % 60 + 5)::INTEGER AS end_line, "
    "'real_' || p_partkey AS callee, (p_partkey % 60 + 4)::INTEGER AS call_line FROM part",
)
def part_nested_comments(spark, sf_dir):
    """Comments inside comments, up to sixty deep, with calls that are no calls at the bottom."""
    key = F.col("p_partkey").cast("string")
    depth = (F.col("p_partkey") % 60 + 1).cast("int")
    content = F.concat(
        F.lit("fn a_"), key, F.lit("() { // /*\n"), F.repeat(F.lit("/* \" \n"), depth), F.lit("call_"), key, F.lit("() "),
        F.repeat(F.lit("*/ "), depth), F.lit("\n  let s = \"/*\"; "), F.lit("real_"), key, F.lit("()\n}\n"),
    )
    raw = dealt(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey").select(
        F.lit("r").alias("repo"), F.lit("a").alias("snap"), F.concat(key, F.lit(".rs")).alias("path"), content.alias("content")
    )
    files = read_corpus(raw)
    found = declarations(files)
    names = found.symbols.select("path", "name", "line", "end_line")
    calls = found.calls.select("path", "callee", F.col("line").alias("call_line"))
    depths = files.select("path", (comment_depth(F.col("content")) - 1).cast("bigint").alias("depth"))
    number = F.regexp_replace("path", "[.]rs$", "").cast("bigint")
    return depths.join(names, "path").join(calls, "path").select(number.alias("p_partkey"), "depth", "name", "line", "end_line", "callee", "call_line")


# --- a language and a layer by rows ---------------------------------------------

ROWS = [
    ("extension", "zig", "zig", 1), ("line comment", "zig", "//", 1), ("quote", "zig", '"', 1),
    ("function word", "zig", "fn", 1), ("type word", "zig", "struct", 1),
    ("layer", "wire", "interface", 2), ("layer path", "wire", "cable/", 1), ("forbidden layers", "wire", "data", 1),
]
ZIG = {
    "cable/m_{p}.zig": "// fn lost() {}\nfn one_{p}(a) {\n  if (a) { two_{p}(\"three()\"); }\n}\n",
    "store/s_{p}.zig": "fn two_{p}(a) { }\n",
}


def _ruled(spark, sf_dir) -> Analysis:
    def build():
        book = Rulebook.of_table(spark.createDataFrame(ROWS, RULE_ROWS))
        with using(book):
            files = read_corpus(_filled(ZIG, table(spark, sf_dir, "part")))
        return Analysis(files, Options(rules=book))

    return shared(spark, sf_dir, "ruled", build)


@query(
    "rules_language",
    "SELECT p_brand AS repo, 'zig' AS language, 'cable/m_' || p_partkey || '.zig' AS path, 'one_' || p_partkey AS name, 2 AS line, 4 AS end_line, "
    "1 AS branches, 'two_' || p_partkey AS calls FROM part UNION ALL "
    "SELECT p_brand, 'zig', 'store/s_' || p_partkey || '.zig', 'two_' || p_partkey, 1, 1, 0, NULL FROM part",
)
def rules_language(spark, sf_dir):
    """A language that only rows describe: extension, comments, quotes and words."""
    a = _ruled(spark, sf_dir)
    called = a.symbols.select("repo", F.col("sym_id").alias("dst"), F.col("name").alias("calls"))
    calls = a.edges.join(called, ["repo", "dst"]).select("repo", F.col("src").alias("sym_id"), "calls")
    return a.symbols.join(calls, ["repo", "sym_id"], "left").select("repo", "language", "path", "name", "line", "end_line", "branches", "calls")


@query(
    "rules_layers",
    "SELECT p_brand AS repo, 'cable/m_' || p_partkey || '.zig' AS path, 'wire' AS layer, 1::BIGINT AS violations FROM part "
    "UNION ALL SELECT p_brand, 'store/s_' || p_partkey || '.zig', 'data', 0 FROM part",
)
def rules_layers(spark, sf_dir):
    """A layer and a forbidden dependency that only rows describe."""
    a = _ruled(spark, sf_dir)
    broken = a.findings.filter("kind = 'layerViolation'").groupBy("repo", "path").agg(F.count(F.lit(1)).alias("violations"))
    return a.modules.select("repo", "path", "layer").join(broken, ["repo", "path"], "left").fillna(0, ["violations"])
