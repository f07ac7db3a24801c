"""Golden rows for the extraction rules on small sources."""

import pytest
from pyspark.sql import functions as F

from codetrellis.operators.declarations import declarations
from codetrellis.operators.lexing import blank_trivia, tokens
from codetrellis.operators.quality import cover_holds
from codetrellis.operators.references import references, resolve_references
from codetrellis.operators.resolve import call_edges, external_symbols, resolve_calls

SOURCES = {
    "plain.py": (
        'x = "ab(" # c(\n'
        "def f(a):\n"
        '  """doc\n'
        '  (x"""\n'
        "  if a and b or c:\n"
        "    return g(a)\n"
        "  elif d: h()\n"
        "z()\n"
    ),
    "wrapped.py": "def outer(\n  a,\n):\n    def inner():\n        return a.b.c()\n    x = {1: {2: 3}}\n    return f().g()\n",
    "quote.py": "def a():\n    '''it's\n    ''' ; b()\n'text'\n    # note\n    c()\n",
    "tabs.py": "class A:\n\tdef m(self):\n\t\tself.g()\n\n\tdef n(self): pass\n",
    "forms.js": (
        "const f = (a, b = {}) => { if (a && b || c) { g(a) } }\n"
        "exports.h = async function (x) { return f(x) }\n"
        "var o = { m: function () { k() }, n: (q) => { o.m() }, p(z) { return z } }\n"
        "class A { constructor(x) { x.get().put() } static s() { for (;;) { while(1) { t() } } } }\n"
        "const w = x => { p->q() }\n"
        "if (x) { call() }\n"
    ),
    "ns.cpp": (
        "namespace n { class K { int get() const noexcept override { return N::g(); } K(int a) { } int proto(); }; }\n"
        "void *make(int a) { return static_cast<int>(a && b); }\n"
    ),
    "recv.go": "type T struct { a int }\nfunc (r *T) Name(x int) int { return r.help(x) }\nfunc main() { go Name(1) }\n",
    "imp.rs": "impl Display for Thing { fn fmt(&self) { /* a /* b */ no(1) */ x.write(1) } }\nimpl Foo<T> { fn z() { y() } }\n",
    "p.swift": 'protocol P { func need() }\nclass C { init(a: Int) { } func go1() { need(); """\n bad() " \n""" } }\n',
    "k.kt": "object K { fun a(x: Int) { when (x) { 1 -> b() } } }\n",
    "r.rb": "class R\n  def go\n    x.each { y() }\n  end\nend\n",
    "p.php": "<?php class P { function a() { # c()\n return b(); } }\n",
    "v.vue": "<script>function load() { call() }</script>\n",
    "c.cs": "class C { int M(int a) { return a | b || c || d; } }\n",
    "open.c": "struct fwd;\nint f(int a) { g(); }\nint last(void) {\n  h();\n",
}

# name, container, kind, line, end_line, branches, max_nesting
DECLARED = {
    "plain.py": [("f", None, "function", 2, 8, 4, 1)],
    "wrapped.py": [("outer", None, "function", 1, 7, 0, 2), ("inner", None, "function", 4, 6, 0, 1)],
    # a line that begins with a string or a comment closes nothing
    "quote.py": [("a", None, "function", 1, 6, 0, 1)],
    "tabs.py": [("A", None, "type", 1, 5, 0, 0), ("m", "A", "method", 2, 5, 0, 1), ("n", "A", "method", 5, 5, 0, 0)],
    "forms.js": [
        ("f", None, "function", 1, 1, 3, 1), ("h", None, "function", 2, 2, 0, 0), ("m", None, "function", 3, 3, 0, 0),
        ("n", None, "function", 3, 3, 0, 0), ("p", None, "function", 3, 3, 0, 0), ("A", None, "type", 4, 4, 0, 0),
        ("constructor", "A", "method", 4, 4, 0, 0), ("s", "A", "method", 4, 4, 2, 2), ("w", None, "function", 5, 5, 0, 0),
    ],
    "ns.cpp": [
        ("n", None, "type", 1, 1, 0, 0), ("K", "n", "type", 1, 1, 0, 0), ("get", "K", "method", 1, 1, 0, 0),
        ("make", None, "function", 2, 2, 1, 0),
    ],
    "recv.go": [("T", None, "type", 1, 1, 0, 0), ("Name", None, "function", 2, 2, 0, 0), ("main", None, "function", 3, 3, 0, 0)],
    "imp.rs": [
        ("Thing", None, "type", 1, 1, 0, 0), ("fmt", "Thing", "method", 1, 1, 0, 0),
        ("T", None, "type", 2, 2, 0, 0), ("z", "T", "method", 2, 2, 0, 0),
    ],
    "p.swift": [
        ("P", None, "type", 1, 1, 0, 0), ("need", "P", "method", 1, 1, 0, 0), ("C", None, "type", 2, 4, 0, 0),
        ("init", "C", "initializer", 2, 2, 0, 0), ("go1", "C", "method", 2, 4, 0, 0),
    ],
    "k.kt": [("K", None, "type", 1, 1, 0, 0), ("a", "K", "method", 1, 1, 1, 1)],
    # blocks that end with a word are closed by the next brace that returns to their level
    "r.rb": [("R", None, "type", 1, 3, 0, 0), ("go", "R", "method", 2, 3, 0, 0)],
    "p.php": [("P", None, "type", 1, 2, 0, 0), ("a", "P", "method", 1, 2, 0, 0)],
    "v.vue": [("load", None, "function", 1, 1, 0, 0)],
    "c.cs": [("C", None, "type", 1, 1, 0, 0), ("M", "C", "method", 1, 1, 2, 0)],
    # a declaration without a body stays open to the next brace that returns to its level
    "open.c": [("fwd", None, "type", 1, 2, 0, 0), ("f", "fwd", "method", 2, 2, 0, 0), ("last", None, "function", 3, 4, 0, 0)],
}

# caller, callee, receiver
CALLED = {
    "plain.py": [(None, "z", None), ("f", "g", None), ("f", "h", None)],
    "wrapped.py": [("inner", "c", "b"), ("outer", "f", None), ("outer", "g", None)],
    "quote.py": [("a", "b", None), ("a", "c", None)],
    "tabs.py": [("m", "g", "self")],
    "forms.js": [
        (None, "call", None), ("constructor", "get", "x"), ("constructor", "put", None), ("f", "g", None),
        ("h", "f", None), ("m", "k", None), ("n", "m", "o"), ("s", "t", None), ("w", "q", None),
    ],
    "ns.cpp": [(None, "K", None), (None, "proto", None), ("get", "g", None)],
    "recv.go": [("Name", "help", "r"), ("main", "Name", None)],
    "imp.rs": [("fmt", "write", "x"), ("z", "y", None)],
    "p.swift": [("go1", "need", None)],
    "k.kt": [("a", "b", None)],
    "r.rb": [("go", "y", None)],
    "p.php": [("a", "b", None)],
    "v.vue": [("load", "call", None)],
    "c.cs": [],
    "open.c": [("f", "g", None), ("last", "h", None)],
}


@pytest.fixture(scope="module")
def extracted(corpus_of):
    d = declarations(corpus_of(SOURCES))
    names = {r.sym_id: r.name for r in d.symbols.collect()}
    symbols, calls = {p: [] for p in SOURCES}, {p: [] for p in SOURCES}
    for r in d.symbols.orderBy("sym_id").collect():
        symbols[r.path].append((r.name, r.container, r.kind, r.line, r.end_line, r.branches, r.max_nesting))
    for r in d.calls.collect():
        calls[r.path].append((names.get(r.caller_id), r.callee, r.receiver))
    return symbols, calls


@pytest.mark.parametrize("path", SOURCES)
def test_declarations(extracted, path):
    assert extracted[0][path] == DECLARED[path]


@pytest.mark.parametrize("path", SOURCES)
def test_calls(extracted, path):
    def key(c):
        return (c[0] or "", c[1])

    assert sorted(extracted[1][path], key=key) == sorted(CALLED[path], key=key)


def test_cover(corpus_of):
    files = corpus_of(SOURCES)
    assert files.filter(~cover_holds(F.col("content"), F.col("language"))).count() == 0


def test_long_literals_do_not_overflow(corpus_of):
    texts = {"a.js": 'f("' + "\\x" * 200_000 + '") /*' + "* /" * 100_000 + "*/ g()", "b.rs": "/*" * 20 + "x" * 200_000 + "*/" * 20 + " fn a() {}"}
    got = tokens(corpus_of(texts)).groupBy("language").agg(F.array_join(F.array_sort(F.collect_set("text")), " ").alias("t")).collect()
    assert {r.language: r.t for r in got} == {"javascript": "( ) f g", "rust": "( ) a fn { }"}


def test_trivia_marks(spark):
    df = spark.createDataFrame([("python", "a '''x\ny''' b")], "l string, c string")
    blank = df.select(blank_trivia(F.col("c"), F.col("l"))).first()[0]
    assert blank == "a \u0003   \n   \u0002 b"


def test_stylesheets_and_markup(corpus_of):
    texts = {
        "a.scss": "@mixin foo($a) { color: red; }\n// .no {}\n.a,\n  .b\n{ @include foo(1); /* x\n */ .c { @extend .a; } }\n@include late;",
        "i.html": "<p id='x'>\n<b id=\"y\" id='x' data-id='z' class=\"k\"><i\tid=\"w\">",
    }
    d = declarations(corpus_of(texts))
    got = [(r.path, r.name, r.kind, r.line, r.end_line) for r in d.symbols.orderBy("sym_id").collect()]
    assert got == [
        ("a.scss", "@mixin foo($a)", "function", 1, 1),
        ("a.scss", ".a, .b", "type", 5, 6),
        ("a.scss", ".c", "type", 6, 6),
        ("i.html", "#x", "type", 1, 1),
        ("i.html", "#y", "type", 2, 2),
        ("i.html", "#w", "type", 2, 2),
    ]
    names = {r.sym_id: r.name for r in d.symbols.collect()}
    calls = sorted((r.line, names.get(r.caller_id), r.callee) for r in d.calls.collect())
    assert calls == [(5, ".a, .b", "foo"), (6, ".a, .b", ".a"), (7, None, "late")]


def test_references(corpus_of):
    texts = {
        "p.html": "<a href=\"b.js?v=1\"><img src='i.png' data-src=\"no\"><a href=\"http://x\"><a href='#t'><a href=\"mailto:x\">",
        "a.js": "import x from './b'\nrequire(\"c\")\nimport 'x\"y'\nvar import_ = 1",
        "a.c": "#include <x.h>\n  #include \"y.h\"",
        "a.css": "@import 'z.css';\nb { background: url( 'q.png' ) url(data:xx) }",
        "a.py": "from . import y\nimport a, b\nfrom ..p.q import r\n  import m.n\nfrom .s import t",
    }
    got = {}
    for r in references(corpus_of(texts)).collect():
        got.setdefault(r.path, []).append(r.reference)
    assert {p: sorted(v) for p, v in got.items()} == {
        "p.html": ["b.js?v=1", "i.png"],
        "a.js": ["./b", "./b", "c", "x\"y"],
        "a.c": ["x.h", "y.h"],
        "a.css": ["q.png", "z.css"],
        "a.py": ["../p/q", "a,", "m/n", "s"],
    }


def test_reference_resolution(spark):
    files = spark.createDataFrame(
        [("r", "a", p) for p in ("s/m.js", "s/a.js", "s/a.ts", "a.js", "d/index.ts", "d/__init__.py", "s/b/index.js", "s/b.css", "q.py")],
        "repo string, snap string, path string",
    )
    refs = spark.createDataFrame(
        [("r", "a", "s/m.js", x) for x in ("./a", "../a", "/a", "../d", "./b", "m.js", "./m", "q", "nope", "./a?x=1")],
        "repo string, snap string, path string, reference string",
    )
    got = {r.dst_path for r in resolve_references(refs, files).collect()}
    assert got == {"s/a.js", "a.js", "d/index.ts", "s/b.css", "q.py"}


def test_package_fixture(corpus_of):
    texts = {
        "main.py": "from pkg.sub.mod import run\n\ndef main():\n    print(run(21))\n",
        "pkg/sub/mod.py": "from ..shared import util\nfrom ..shared.util import helper\n\ndef run(n):\n    return helper(n) + util.helper(n)\n",
        "pkg/shared/util.py": "def helper(x):\n    return x * 2\n\ndef unused_thing():\n    return 0\n",
        "pkg/shared/__init__.py": "",
    }
    files = corpus_of(texts)
    got = {(r.src_path, r.dst_path) for r in resolve_references(references(files), files).collect()}
    assert got == {
        ("pkg/sub/mod.py", "pkg/shared/util.py"), ("pkg/sub/mod.py", "pkg/shared/__init__.py"), ("main.py", "pkg/sub/mod.py"),
    }
    d = declarations(files)
    names = {r.sym_id: r.name for r in d.symbols.collect()}
    edges = {(names[r.src], names[r.dst], r.n) for r in call_edges(resolve_calls(d.calls, d.symbols)).collect()}
    assert edges == {("main", "run", 1), ("run", "helper", 2)}


def _resolved(spark, symbols, calls):
    s = spark.createDataFrame(
        [("r", "a", i, *row) for i, row in enumerate(symbols)],
        "repo string, snap string, sym_id bigint, path string, name string, container string, kind string",
    )
    c = spark.createDataFrame(
        [("r", "a", "python", 1, *row) for row in calls],
        "repo string, snap string, language string, line int, path string, caller_id bigint, caller_container string, callee string, receiver string",
    )
    return s, c


def test_resolution_order(spark):
    symbols = [
        ("a.py", "A", None, "type"), ("a.py", "go", "A", "method"), ("a.py", "go", "B", "method"), ("b.py", "go", None, "function"),
        ("b.py", "append", None, "function"), ("c.py", "append", None, "function"), ("c.py", "append", "C", "method"),
        ("c.py", "one", None, "function"), ("b.py", "B", None, "type"),
    ]
    calls = [
        ("b.py", 3, None, "go", "A"),         # the receiver's type
        ("b.py", 3, "B", "go", None),         # the caller's container
        ("b.py", 4, None, "go", "zz"),        # the caller's file
        ("d.py", 7, None, "go", None),        # first anywhere
        ("b.py", 7, None, "append", "xs"),    # guarded, one candidate in the file
        ("c.py", 1, None, "append", "xs"),    # guarded, two candidates in the file
        ("d.py", 1, None, "append", "xs"),    # guarded, none in the file
        ("d.py", 1, None, "one", "self"),     # only candidate
        ("d.py", 1, None, "A", None),         # a type is no target
        ("c.py", 7, None, "one", None),       # itself
        ("b.py", None, None, "one", None),    # file scope
        ("b.py", 4, None, "lost", "B"),       # nobody declares it
        ("b.py", 4, None, "go", "B"),         # type receiver with a member
    ]
    s, c = _resolved(spark, symbols, calls)
    resolved = resolve_calls(c, s)
    got = {(r.path, r.caller_id, r.callee, r.receiver): r.target_id for r in resolved.collect()}
    assert got == {
        ("b.py", 3, "go", "A"): 1, ("b.py", 3, "go", None): 2, ("b.py", 4, "go", "zz"): 3, ("d.py", 7, "go", None): 1,
        ("b.py", 7, "append", "xs"): 4, ("c.py", 1, "append", "xs"): None, ("d.py", 1, "append", "xs"): None,
        ("d.py", 1, "one", None): 7, ("d.py", 1, "A", None): None, ("c.py", 7, "one", None): 7, ("b.py", 4, "lost", "B"): None,
        ("b.py", 4, "go", "B"): 2,
    }
    outside = external_symbols(resolved, s, c)
    assert sorted((r.name, r.sym_id) for r in outside.collect()) == [("A", 9), ("lost", 10)]
    edges = {(r.src, r.dst, r.n) for r in call_edges(resolved, outside).collect()}
    assert (7, 7, 1) not in edges and (1, 9, 1) in edges and (4, 10, 1) in edges


def test_line_endings_and_partitions(spark, corpus_of):
    """A CRLF copy gives the same tables, and so does another number of partitions."""
    unix = declarations(corpus_of(SOURCES)).symbols
    dos = declarations(corpus_of({p: t.replace("\n", "\r\n") for p, t in SOURCES.items()})).symbols
    rows = sorted(map(tuple, unix.collect()), key=repr)
    assert rows == sorted(map(tuple, dos.collect()), key=repr)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        again = declarations(corpus_of(SOURCES)).symbols
        assert rows == sorted(map(tuple, again.collect()), key=repr)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
