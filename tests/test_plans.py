"""Sizes that Spark guesses must neither grow over rounds nor choose what goes through the driver."""

from pyspark.sql import functions as F

from codetrellis.llm.links import connected
from codetrellis.operators import modules, reachability
from codetrellis.operators.declarations import declarations
from codetrellis.operators.facts import _extracted, text_key
from codetrellis.operators.references import references, resolve_references
from codetrellis.session import brief, broadcast_as_measured, cut


def _guess(df) -> int:
    return df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length()


def test_guessed_sizes_stay_bounded_over_rounds(spark):
    found = cut(spark.range(20).withColumn("n", F.lit(1)))
    for _ in range(5):
        more = found.select("id", F.col("n").alias("m"))
        found = cut(found.join(more, "id").select("id", (F.col("n") + F.col("m")).alias("n")))
    assert _guess(found) <= 64
    assert {tuple(r) for r in found.collect()} == {(i, 32) for i in range(20)}


def test_connected_keeps_small_guesses(spark):
    # a path of 40 nodes in an order that takes several rounds
    found = connected(spark.range(39).select(((F.col("id") * 7) % 40).alias("u"), (((F.col("id") + 1) * 7) % 40).alias("v")))
    assert _guess(found) <= 64
    assert {tuple(r) for r in found.collect()} == {(i, 0) for i in range(40)}


def test_index_of_a_deep_graph_keeps_small_guesses(spark):
    part = spark.range(200)
    edges = part.filter("id >= 2").select(
        F.lit("all").alias("repo"), F.col("id").alias("src"), F.explode(F.array(F.floor(F.col("id") / 2), F.floor(F.col("id") / 3))).alias("dst")
    )
    nodes = part.select(F.lit("all").alias("repo"), F.col("id").alias("node"))
    found = reachability.index(nodes, edges, ["repo"])
    assert max(_guess(t) for t in (found.places, found.reached, found.sizes, found.cyclic)) <= 64
    ways = {}
    for i in range(200):
        steps = {i // 2, i // 3} - {i} if i >= 2 else set()
        ways[i] = steps.union(*(ways[s] for s in steps))
    assert {r.source: r.reach for r in reachability.reach_sizes(found).collect()} == {i: len(w) for i, w in ways.items()}


def test_exploded_rows_are_not_broadcast_by_a_guess(spark):
    broadcast_as_measured(spark)
    rows = spark.range(4).select("id", F.explode(F.sequence(F.lit(1), F.lit(100_000))).alias("n"))
    joined = spark.range(1000).join(rows, "id")
    assert "BroadcastExchange" not in joined._jdf.queryExecution().executedPlan().toString()
    assert joined.count() == 400_000


def test_facts_of_files_are_not_broadcast(spark, corpus_of):
    files = corpus_of({f"a{i}.py": f"def f{i}():\n    return g{i}()\n" for i in range(5)})
    found = declarations(files)
    joined = found.calls.join(found.symbols.select("repo", "snap", F.col("sym_id").alias("caller_id"), "name"), ["repo", "snap", "caller_id"])
    assert "BroadcastExchange" not in joined._jdf.queryExecution().executedPlan().toString()
    assert {(r.name, r.callee) for r in joined.collect()} == {(f"f{i}", f"g{i}") for i in range(5)}


def test_texts_are_read_in_one_pass(spark, corpus_of):
    files = corpus_of({"a.py": "def f():\n    return g()\n", "b.c": "int f(int a) { return g(a); }\n", "c.css": ".x { }\n", "d.html": '<p id="y">\n'})
    found = _extracted(files.select(*text_key(), "language", "content"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 1 and "Window" not in plan and "Join" not in plan
    assert sorted((r.name, r.ordinal, len(r.calls)) for r in found.collect()) == [("#y", 0, 0), (".x", 0, 0), ("f", 0, 1), ("f", 0, 1)]


def test_a_threshold_of_the_session_is_kept(spark):
    guessed, measured = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    before = spark.conf.get(guessed), spark.conf.get(measured, None)
    try:
        for given, set_before, expected in (("256k", None, "256k"), ("10485760b", None, str(4 << 20)), ("10MB", "1m", "1m"), ("-1", None, None)):
            spark.conf.set(guessed, given)
            spark.conf.unset(measured) if set_before is None else spark.conf.set(measured, set_before)
            broadcast_as_measured(spark)
            assert (spark.conf.get(guessed), spark.conf.get(measured, None)) == ("-1", expected)
    finally:
        spark.conf.set(guessed, before[0])
        spark.conf.unset(measured) if before[1] is None else spark.conf.set(measured, before[1])


def _parts(spark, root):
    spark.range(40).select(
        F.col("id").alias("p_partkey"), F.concat(F.lit("Brand#"), F.col("id") % 3).alias("p_brand")
    ).coalesce(1).write.parquet(f"{root}/part.parquet")
    return str(root)


def test_texts_of_a_small_table_are_made_by_many_tasks(spark, tmp_path):
    from suite.call_queries import MEMBERS, _filled
    from suite.registry import table

    filled = _filled(MEMBERS, table(spark, _parts(spark, tmp_path), "part"))
    assert filled.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert filled.count() == filled.distinct().count() == 40 * len(MEMBERS)


def test_a_tree_is_written_by_many_tasks(spark, tmp_path):
    from suite.source_queries import forest_files

    before = spark.sparkContext.statusTracker().getJobIdsForGroup("forest")
    assert not before
    spark.sparkContext.setJobGroup("forest", "tree")
    try:
        found = {(r.repo, r.path) for r in forest_files(spark, _parts(spark, tmp_path)).collect()}
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    names = {0: "src/a_{}.py", 3: "src/latin_{}.py", 7: "deep/a/b/c/d_{}.go"}
    assert found == {(f"Brand#{i % 3}", names[i % 9].format(i)) for i in range(40) if i % 9 in names}
    tracker = spark.sparkContext.statusTracker()
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup("forest") for s in tracker.getJobInfo(j).stageIds]
    assert max(s.numTasks for s in stages if s) >= int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_digest_is_not_dealt_to_a_few_tasks(spark, tmp_path):
    from suite.drift_queries import table_digest_counts

    spark.range(1000).select(
        (F.col("id") / 4).cast("bigint").alias("l_orderkey"), (F.col("id") % 4).cast("int").alias("l_linenumber"), F.lit(1).alias("l_suppkey")
    ).write.parquet(f"{tmp_path}/lineitem.parquet")
    found = table_digest_counts(spark, str(tmp_path))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(l_suppkey" not in plan and ", 5)" not in plan
    assert [tuple(r) for r in found.collect()] == [(1000, True)]


def test_a_large_append_is_written_by_several_tasks_of_a_bucket(spark, tmp_path):
    from codetrellis.sources.logstore import LogTable

    name = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, "64k")
    try:
        log = LogTable(spark, str(tmp_path / "log"), "k bigint, v string", ("k",), ("k",), buckets=1)
        log.append(spark.range(0, 40_000, 1, 8).select(F.col("id").alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("v")))
    finally:
        spark.conf.set(name, before)
    assert log.files() > 1
    assert log.read().count() == log.read().distinct().count() == 40_000


def test_a_cut_reads_the_columns_that_are_asked_for(spark):
    found = cut(spark.range(10).select("id", (F.col("id") * 2).alias("twice"), F.lit("x" * 50).alias("wide")))
    plan = found.groupBy().agg(F.sum("twice").alias("s"))
    scan = next(l for l in plan._jdf.queryExecution().executedPlan().toString().splitlines() if "Scan" in l)
    assert "twice" in scan and "wide" not in scan
    assert plan.collect()[0].s == 90
    nothing = cut(spark.range(3).select("id", F.lit(None).alias("nothing")))
    assert {tuple(r) for r in nothing.collect()} == {(0, None), (1, None), (2, None)}
    assert cut(spark.range(3).filter("id > 5")).isEmpty()


def test_a_step_of_a_route_does_not_shuffle_the_edges(spark):
    here = brief(cut(spark.range(1).select(F.lit("r").alias("repo"), F.col("id").alias("src"))))
    edges = spark.range(100).select(F.lit("r").alias("repo"), F.col("id").alias("src"), F.col("id").alias("dst"))
    joined = edges.join(here, ["repo", "src"])
    assert "SortMergeJoin" not in joined._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in joined.collect()] == [("r", 0, 0)]
    many = cut(spark.range(10_001))
    assert brief(many) is many


def test_the_file_graph_weighs_edges_by_pairs_of_files(spark):
    rows = [("r", "a", "x", "x", 2), ("r", "a", "x", "y", 3), ("r", "a", "x", "y", 4), ("r", "a", "y", None, 5)]
    located = spark.createDataFrame(rows, "repo string, snap string, src_path string, dst_path string, n long")
    pairs = modules.file_pairs(located)
    assert {tuple(r)[2:] for r in pairs.collect()} == {("x", "x", 1, 2), ("x", "y", 2, 7), ("y", None, 1, 5)}
    assert {r.path: r.weight for r in modules.connectedness(pairs).collect()} == {"x": 3, "y": 3}


def test_a_path_is_standardized_once_for_all_its_names(corpus_of):
    files = corpus_of({"a/x.js": "import y from './y'\n", "a/y.ts": "", "a/b/index.js": ""})
    found = resolve_references(references(files), files)
    # the fold over the parts of a path: one for the files and those of what is referred to
    assert found._jdf.queryExecution().optimizedPlan().toString().count("aggregate(") <= 8
    assert {(r.src_path, r.dst_path) for r in found.collect()} == {("a/x.js", "a/y.ts")}
