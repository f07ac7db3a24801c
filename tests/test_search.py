"""Search by the rarest run of letters, and where very many names hold one."""

import random

from pyspark.sql import functions as F

from codetrellis.operators.search import NameIndex, holding, name_index, rarest_grams, search

SYMBOLS = "repo string, sym_id bigint, name string, container string, fan_in int"


def brute(rows, needles, limit):
    found = set()
    for needle in {n.lower() for n in needles if n}:
        for repo in {r[0] for r in rows}:
            held = [r for r in rows if r[0] == repo and (needle in r[2].lower() or needle in (r[3] or "").lower())]
            held.sort(key=lambda r: (r[2].lower() != needle, not r[2].lower().startswith(needle), -r[4], r[1]))
            found |= {(repo, needle, r[1], k + 1) for k, r in enumerate(held[:limit])}
    return found


def test_answers_equal_a_scan(spark, tmp_path):
    draw = random.Random(3)
    letters = "abÄé_"
    rows = [(draw.choice("xy"), i, "".join(draw.choice(letters) for _ in range(draw.randint(0, 7))), draw.choice([None, "Box", "ab", "aBa"]), draw.randint(0, 4)) for i in range(250)]
    needles = ["", "a", "AB", "äé", "bab", "abab", "box", "zzz", "abz", "_", "éa_b"] + [r[2] for r in rows[:20]]
    symbols = spark.createDataFrame(rows, SYMBOLS)
    asked = spark.createDataFrame([(n,) for n in needles], "needle string")
    for index in (None, name_index(symbols, ["repo"], part=7)):
        got = {(r.repo, r.needle, r.sym_id, r["rank"]) for r in search(symbols, asked, 5, ["repo"], index).collect()}
        assert got == brute(rows, needles, 5)
    name_index(symbols, ["repo"]).save(str(tmp_path))
    kept = NameIndex.load(spark, str(tmp_path), ["repo"])
    assert {(r.repo, r.needle, r.sym_id, r["rank"]) for r in search(symbols, asked, 5, ["repo"], kept).collect()} == brute(rows, needles, 5)


def test_a_run_that_nearly_all_names_hold_is_dealt_out(spark):
    names = spark.range(40_000).select(
        F.lit("r").alias("repo"), F.col("id").alias("sym_id"),
        F.concat(F.when(F.col("id") % 100 < 99, "get").otherwise("put"), F.lit("Item"), F.col("id").cast("string")).alias("name"),
        F.lit(None).cast("string").alias("container"), F.lit(0).alias("fan_in"),
    )
    index = name_index(names, ["repo"], part=1000)
    asked = spark.createDataFrame([("get",), ("getItem123",), ("put",), ("nothing",)], "needle string")
    chosen = rarest_grams(index, asked)
    # the rarest run of the second question is in its number, not "get"
    assert {r.gram for r in chosen.filter("needle = 'getitem123'").collect()} <= {"123", "m12", "tem", "ite", "etI".lower(), "eti", "em1", "m12"} - {"get"}
    assert chosen.filter("needle = 'get'").count() == 40
    sizes = [r["n"] for r in index.postings.filter("gram = 'get'").groupBy("salt").agg(F.count(F.lit(1)).alias("n")).collect()]
    assert len(sizes) == 40 and max(sizes) < 2 * sorted(sizes)[20]
    held = {r.needle: r.n for r in holding(index, asked).groupBy("needle").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert held["get"] == 39_600 and held["put"] == 400 and "nothing" not in held
