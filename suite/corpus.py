"""A code corpus derived from ``part``: each part becomes thirteen source files.

The texts are templates filled by Spark. The checking SQL never sees the text:
it states what each template declares and calls, and crosses that with ``part``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codetrellis.plans.analysis import REPORT, Analysis, Options
from codetrellis.sources.corpus import read_corpus
from suite.registry import dealt, shared, table

FOLDERS = {
    "ECONOMY": "src/view",
    "PROMO": "src/store",
    "MEDIUM": "src/service",
    "STANDARD": "src/api",
    "SMALL": "lib/model",
    "LARGE": "tools/cmd",
}

TEMPLATES = {
    "m_{p}.py": """# call ghost_{p}() stays a comment
import os, sys
from .util_{p} import tool
class Box_{p}(Base):
    \"\"\"doc fake_{p}(1)
    more\"\"\"
    def size_{p}(self, n):
        if n > 1 and n < 9:
            return self.weigh_{p}(n)
        return shared_{s}("text(1)", n)

    def weigh_{p}(
        self,
        n,
    ):
        for i in range(n):
            while i:
                i -= 1
        return {"a": {"b": n}}

def shared_{s}(text, n):
    def inner_{p}():
        return Box_{p}.size_{p}(n)
    return inner_{p}()
top_{p}(1)
""",
    "util_{p}.py": """def tool():
    pass

def lone_{p}(a):
    x = a
    y = x
    return y
""",
    "m_{p}.js": """import x from './w_{p}.ts'; // load_{p}(
const arrow_{p} = (a, b) => {
  if (a && b || !a) { return shared_{s}(a) }
};
exports.named_{p} = function (x) { return arrow_{p}(x) }
var o = { m_{p}: function () { k_{p}() }, n_{p}: (q) => { o.m_{p}() }, s_{p}(z) { return z } }
class Card_{p} { constructor(x) { this.x = x.get().put() }
  static make_{p}() { for (;;) { while (1) { o.push(`t(${1})`) } } } }
""",
    "w_{p}.ts": """interface Shape_{p} { area(): number }
export const area_{p} = async (n: number) => { return n }
function shared_{s}(a) {
  return area_{p}(a) + area_{p}(2)
}
""",
    "c_{p}.c": """#include "c_{p}.h"
#include <stdio.h>
struct node_{p} { int x; };
int proto_{p}(int a);
static int *mk_{p}(int a) { return use_{p}(a); }
int run(int argc, char **argv) {
  if (argc) { for (;;) { MACRO_{p}(x); } }
  return mk_{p}(1) + shared_{s}(2);
}
""",
    "c_{p}.h": """int proto_{p}(int a);
""",
    "g_{p}.go": """package main
type T_{p} struct { a int }
func (r *T_{p}) Name_{p}(x int) int { return r.help_{p}(x) }
func help_{p}(x int) int {
  switch { case x > 1: return 1 }
  return Name_{p}(x)
}
""",
    "r_{p}.rs": """impl Display for Thing_{p} {
  fn fmt_{p}(&self) { /* a /* b */ no(1) */ write(1); }
}
fn solo_{p}() { match 1 { _ => fmt_{p}() } }
""",
    "s_{p}.swift": """protocol P_{p} { func need_{p}() }
class C_{p} {
  init(a: Int) { self.a = a }
  func go_{p}() { guard a else { return }; need_{p}() }
}
""",
    "J_{p}.java": """package a;
public class J_{p} {
  int quote_{p}(int a) { return new J_{p}(a).ship_{p}(a); }
  void ship_{p}(int a) throws E { if (a > 1 || a < 0) { shared_{s}(a); } }
  int short_{p}(int a) { return a; }
}
""",
    "s_{p}.scss": """@import "t_{p}";
@mixin pad_{p}($x) { padding: $x; }
// @include none_{p}
.card_{p}, .long-selector-name-number-{p}-that-goes-past {
  @include pad_{p}(1);
  .in { @extend .card_{p}; }
  background: url('img_{p}.png');
}
""",
    "t_{p}.css": """.tile_{p} { color: red }
""",
    "p_{p}.html": """<html><body id="top_{p}" data-id="no">
<a href="/{d}/t_{p}.css?v=2">x</a> <a href="http://x.y">z</a>
<p id='para_{p}' id="top_{p}"><script src="m_{p}.js"></script>
""",
}

LANGUAGES = {
    "m_{p}.py": "python", "util_{p}.py": "python", "m_{p}.js": "javascript", "w_{p}.ts": "typescript",
    "c_{p}.c": "c", "c_{p}.h": "c", "g_{p}.go": "go", "r_{p}.rs": "rust", "s_{p}.swift": "swift",
    "J_{p}.java": "java", "s_{p}.scss": "scss", "t_{p}.css": "css", "p_{p}.html": "html",
}

# file, place in the file, name, container, kind, line, end_line, branches, max_nesting
DECLARED = [
    ("m_{p}.py", 0, "Box_{p}", None, "type", 4, 21, 0, 0),
    ("m_{p}.py", 1, "size_{p}", "Box_{p}", "method", 7, 12, 2, 2),
    ("m_{p}.py", 2, "weigh_{p}", "Box_{p}", "method", 12, 21, 2, 3),
    ("m_{p}.py", 3, "shared_{s}", None, "function", 21, 25, 0, 1),
    ("m_{p}.py", 4, "inner_{p}", None, "function", 22, 24, 0, 1),
    ("util_{p}.py", 0, "tool", None, "function", 1, 4, 0, 1),
    ("util_{p}.py", 1, "lone_{p}", None, "function", 4, 7, 0, 1),
    ("m_{p}.js", 0, "arrow_{p}", None, "function", 2, 4, 3, 1),
    ("m_{p}.js", 1, "named_{p}", None, "function", 5, 5, 0, 0),
    ("m_{p}.js", 2, "m_{p}", None, "function", 6, 6, 0, 0),
    ("m_{p}.js", 3, "n_{p}", None, "function", 6, 6, 0, 0),
    ("m_{p}.js", 4, "s_{p}", None, "function", 6, 6, 0, 0),
    ("m_{p}.js", 5, "Card_{p}", None, "type", 7, 8, 0, 0),
    ("m_{p}.js", 6, "constructor", "Card_{p}", "method", 7, 7, 0, 0),
    ("m_{p}.js", 7, "make_{p}", "Card_{p}", "method", 8, 8, 2, 2),
    ("w_{p}.ts", 0, "Shape_{p}", None, "type", 1, 1, 0, 0),
    ("w_{p}.ts", 1, "area_{p}", None, "function", 2, 2, 0, 0),
    ("w_{p}.ts", 2, "shared_{s}", None, "function", 3, 5, 0, 0),
    ("c_{p}.c", 0, "node_{p}", None, "type", 3, 3, 0, 0),
    ("c_{p}.c", 1, "mk_{p}", None, "function", 5, 5, 0, 0),
    ("c_{p}.c", 2, "run", None, "function", 6, 9, 2, 2),
    ("g_{p}.go", 0, "T_{p}", None, "type", 2, 2, 0, 0),
    ("g_{p}.go", 1, "Name_{p}", None, "function", 3, 3, 0, 0),
    ("g_{p}.go", 2, "help_{p}", None, "function", 4, 7, 1, 1),
    ("r_{p}.rs", 0, "Thing_{p}", None, "type", 1, 3, 0, 0),
    ("r_{p}.rs", 1, "fmt_{p}", "Thing_{p}", "method", 2, 2, 0, 0),
    ("r_{p}.rs", 2, "solo_{p}", None, "function", 4, 4, 1, 1),
    ("s_{p}.swift", 0, "P_{p}", None, "type", 1, 1, 0, 0),
    ("s_{p}.swift", 1, "need_{p}", "P_{p}", "method", 1, 1, 0, 0),
    ("s_{p}.swift", 2, "C_{p}", None, "type", 2, 5, 0, 0),
    ("s_{p}.swift", 3, "init", "C_{p}", "initializer", 3, 3, 0, 0),
    ("s_{p}.swift", 4, "go_{p}", "C_{p}", "method", 4, 4, 2, 1),
    ("J_{p}.java", 0, "J_{p}", None, "type", 2, 6, 0, 0),
    ("J_{p}.java", 1, "quote_{p}", "J_{p}", "method", 3, 3, 0, 0),
    ("J_{p}.java", 2, "short_{p}", "J_{p}", "method", 5, 5, 0, 0),
    ("s_{p}.scss", 0, "@mixin pad_{p}($x)", None, "function", 2, 2, 0, 0),
    ("s_{p}.scss", 1, "{long}", None, "type", 4, 8, 0, 0),
    ("s_{p}.scss", 2, ".in", None, "type", 6, 6, 0, 0),
    ("t_{p}.css", 0, ".tile_{p}", None, "type", 1, 1, 0, 0),
    ("p_{p}.html", 0, "#top_{p}", None, "type", 1, 1, 0, 0),
    ("p_{p}.html", 1, "#para_{p}", None, "type", 3, 3, 0, 0),
]

# file, caller (None at file scope), callee, receiver, line, file and name of the target
# target: "same part" names a file template, "first" the first in path order, None is unresolved
CALLED = [
    ("m_{p}.py", "size_{p}", "weigh_{p}", "self", 9, "m_{p}.py"),
    ("m_{p}.py", "size_{p}", "shared_{s}", None, 10, "m_{p}.py"),
    ("m_{p}.py", "inner_{p}", "size_{p}", "Box_{p}", 23, "m_{p}.py"),
    ("m_{p}.py", "shared_{s}", "inner_{p}", None, 24, "m_{p}.py"),
    ("m_{p}.py", None, "top_{p}", None, 25, None),
    ("m_{p}.js", "arrow_{p}", "shared_{s}", None, 3, "first"),
    ("m_{p}.js", "named_{p}", "arrow_{p}", None, 5, "m_{p}.js"),
    ("m_{p}.js", "m_{p}", "k_{p}", None, 6, None),
    ("m_{p}.js", "n_{p}", "m_{p}", "o", 6, "m_{p}.js"),
    ("m_{p}.js", "constructor", "get", "x", 7, None),
    ("m_{p}.js", "constructor", "put", None, 7, None),
    ("m_{p}.js", "make_{p}", "push", "o", 8, None),
    ("w_{p}.ts", None, "area", None, 1, None),
    ("w_{p}.ts", "shared_{s}", "area_{p}", None, 4, "w_{p}.ts"),
    ("w_{p}.ts", "shared_{s}", "area_{p}", None, 4, "w_{p}.ts"),
    ("c_{p}.c", None, "proto_{p}", None, 4, None),
    ("c_{p}.c", "mk_{p}", "use_{p}", None, 5, None),
    ("c_{p}.c", "run", "MACRO_{p}", None, 7, None),
    ("c_{p}.c", "run", "mk_{p}", None, 8, "c_{p}.c"),
    ("c_{p}.c", "run", "shared_{s}", None, 8, "first"),
    ("c_{p}.h", None, "proto_{p}", None, 1, None),
    ("g_{p}.go", "Name_{p}", "help_{p}", "r", 3, "g_{p}.go"),
    ("g_{p}.go", "help_{p}", "Name_{p}", None, 6, "g_{p}.go"),
    ("r_{p}.rs", "fmt_{p}", "write", None, 2, None),
    ("r_{p}.rs", "solo_{p}", "fmt_{p}", None, 4, "r_{p}.rs"),
    ("s_{p}.swift", "go_{p}", "need_{p}", None, 4, "s_{p}.swift"),
    ("J_{p}.java", "quote_{p}", "J_{p}", None, 3, None),
    ("J_{p}.java", "quote_{p}", "ship_{p}", None, 3, None),
    ("J_{p}.java", None, "ship_{p}", None, 4, None),
    ("J_{p}.java", None, "shared_{s}", None, 4, None),
    ("s_{p}.scss", "{long}", "pad_{p}", None, 5, None),
    ("s_{p}.scss", "{long}", ".card_{p}", None, 6, None),
]

# file, reference as written, file it resolves to
REFERRED = [
    ("m_{p}.py", "os,", None),
    ("m_{p}.py", "util_{p}", "util_{p}.py"),
    ("m_{p}.js", "./w_{p}.ts", "w_{p}.ts"),
    ("m_{p}.js", "./w_{p}.ts", "w_{p}.ts"),
    ("c_{p}.c", "c_{p}.h", "c_{p}.h"),
    ("c_{p}.c", "stdio.h", None),
    ("s_{p}.scss", "t_{p}", "t_{p}.css"),
    ("s_{p}.scss", "img_{p}.png", None),
    ("p_{p}.html", "m_{p}.js", "m_{p}.js"),
    ("p_{p}.html", "/{d}/t_{p}.css?v=2", "t_{p}.css"),
]


def raw_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``files(repo, snap, path, content)``; every row of ``part`` gives all templates."""
    folder = F.try_element_at(
        F.create_map(*[F.lit(v) for item in FOLDERS.items() for v in item]), F.col("p_type")
    )

    def filled(text):
        done = F.replace(text, F.lit("{p}"), F.col("p_partkey").cast("string"))
        done = F.replace(done, F.lit("{s}"), F.col("p_size").cast("string"))
        return F.replace(done, F.lit("{d}"), folder)

    one_each = F.array(
        *[F.struct(F.lit(name).alias("name"), F.lit(body).alias("body")) for name, body in TEMPLATES.items()]
    )
    rows = dealt(table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_brand", "p_type"), "p_partkey")
    parts = rows.select("*", F.explode(one_each).alias("t"))
    return parts.select(
        F.col("p_brand").alias("repo"),
        F.lit("a").alias("snap"),
        F.concat(folder, F.lit("/"), filled(F.col("t.name"))).alias("path"),
        filled(F.col("t.body")).alias("content"),
    )


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_corpus(raw_files(spark, sf_dir))


# what the diagram and the report show
PICTURE = REPORT


def analysis(spark: SparkSession, sf_dir: str) -> Analysis:
    return shared(spark, sf_dir, "analysis", lambda: Analysis(files(spark, sf_dir), Options(**PICTURE)))


def analysis_with_externals(spark: SparkSession, sf_dir: str) -> Analysis:
    return shared(
        spark, sf_dir, "analysis with externals",
        lambda: Analysis(files(spark, sf_dir), Options(include_external=True, **PICTURE)),
    )


# --- the same corpus as relations, for the checking SQL ---------------------


def _text(value) -> str:
    return "NULL" if value is None else "'" + str(value).replace("'", "''") + "'"


def _values(rows: list[tuple], columns: list[str]) -> str:
    body = ", ".join(
        "(" + ", ".join(str(v) if isinstance(v, int) else _text(v) for v in row) + ")" for row in rows
    )
    return f"(VALUES {body}) AS v({', '.join(columns)})"


def _fill(column: str) -> str:
    long = "left('.card_' || p_partkey || ', .long-selector-name-number-' || p_partkey || '-that-goes-past', 42) || '…'"
    return (
        f"replace(replace(replace(replace({column}, '{{p}}', p_partkey::VARCHAR), '{{s}}', p_size::VARCHAR), "
        f"'{{d}}', folder), '{{long}}', {long})"
    )


_FOLDER_CASE = "CASE p_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in FOLDERS.items()) + " END"

BASE = f"""
p AS (SELECT *, {_FOLDER_CASE} AS folder FROM part),
file_rows AS (
  SELECT p_brand AS repo, folder || '/' || {_fill('file')} AS path, lang AS language, lines::BIGINT AS lines
  FROM p, {_values([(n, LANGUAGES[n], TEMPLATES[n].count(chr(10)) + 1) for n in TEMPLATES], ['file', 'lang', 'lines'])}
),
sym AS (
  SELECT p_brand AS repo, folder || '/' || {_fill('file')} AS path, place, {_fill('name')} AS name,
         {_fill('container')} AS container, kind, line::INTEGER AS line, end_line::INTEGER AS end_line,
         branches::INTEGER AS branches, nesting::INTEGER AS max_nesting, lang AS language
  FROM p, {_values([(*row, LANGUAGES[row[0]]) for row in DECLARED], ['file', 'place', 'name', 'container', 'kind', 'line', 'end_line', 'branches', 'nesting', 'lang'])}
),
site AS (
  SELECT p_brand AS repo, folder || '/' || {_fill('file')} AS path, {_fill('caller')} AS caller,
         {_fill('callee')} AS callee, {_fill('receiver')} AS receiver, line::INTEGER AS line, target,
         folder || '/' || {_fill('target')} AS target_path
  FROM p, {_values(CALLED, ['file', 'caller', 'callee', 'receiver', 'line', 'target'])}
),
first_shared AS (
  SELECT repo, name, min(path) AS path FROM sym WHERE kind <> 'type' GROUP BY repo, name
),
edge AS (
  SELECT s.repo, s.path AS src_path, s.caller AS src_name,
         CASE WHEN s.target = 'first' THEN f.path ELSE s.target_path END AS dst_path,
         s.callee AS dst_name, count(*) AS n
  FROM site s LEFT JOIN first_shared f ON s.repo = f.repo AND s.callee = f.name
  WHERE s.caller IS NOT NULL AND s.target IS NOT NULL
  GROUP BY ALL
),
refs AS (
  SELECT p_brand AS repo, folder || '/' || {_fill('file')} AS path, {_fill('written')} AS reference,
         folder || '/' || {_fill('target')} AS dst_path
  FROM p, {_values(REFERRED, ['file', 'written', 'target'])}
),
node AS (
  SELECT s.*, coalesce(i.c, 0)::BIGINT AS fan_in, coalesce(o.c, 0)::BIGINT AS fan_out,
         greatest(1, end_line - line + 1) AS span,
         row_number() OVER (PARTITION BY s.repo ORDER BY s.path, s.place) AS rank_id,
         concat_ws('.', s.container, s.name) AS display,
         branches + 1 + 2 * max_nesting + greatest(0, greatest(1, end_line - line + 1) - 20) // 15 AS score
  FROM sym s
  LEFT JOIN (SELECT repo, dst_path, dst_name, count(*) c FROM edge GROUP BY ALL) i
    ON s.repo = i.repo AND s.path = i.dst_path AND s.name = i.dst_name AND s.kind <> 'type'
  LEFT JOIN (SELECT repo, src_path, src_name, count(*) c FROM edge GROUP BY ALL) o
    ON s.repo = o.repo AND s.path = o.src_path AND s.name = o.src_name AND s.kind <> 'type'
)
"""


def sql(select: str, *ctes: str) -> str:
    return "WITH RECURSIVE " + ",\n".join([BASE.strip(), *ctes]) + "\n" + select
