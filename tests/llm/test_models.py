"""Packing, neighbours, token counts, the classifier, mixing and the pipeline."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from codetrellis.llm import mixing, neighbours, packing, perplexity, stages, token_counts

# --- packing -----------------------------------------------------------------


def check_bins(counts, caps):
    slots = packing.best_fit(counts, caps)
    bins, given = defaultdict(list), Counter()
    for (length, first, sequence, times, offset), following in zip(slots, [*slots[1:], None]):
        last = following[1] if following is not None and following[0] == length else counts[length]
        assert given[length] == first
        for rank in range(first, last):
            bins[sequence + (rank - first) // times].append((offset + (rank - first) % times * length, length))
        given[length] = last
    assert given == Counter(counts)
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= caps.tokens and len(held) <= caps.documents and sum(x * x for _, x in held) <= caps.attention
    return len(bins)


@pytest.mark.parametrize("choice", ["norm", "dot"])
def test_best_fit_keeps_every_capacity(choice):
    draw = random.Random(1)
    for _ in range(30):
        counts = {draw.randint(1, 64): draw.randint(1, 40) for _ in range(draw.randint(1, 30))}
        total = sum(k * n for k, n in counts.items())
        bins = check_bins(counts, packing.Capacities(64, 64, 64 * 64, choice=choice))
        if choice == "norm":
            greedy = []  # best-fit decreasing, piece by piece
            for length in sorted(counts, reverse=True):
                for _ in range(counts[length]):
                    fit = [i for i, room in enumerate(greedy) if room >= length]
                    if fit:
                        greedy[min(fit, key=greedy.__getitem__)] -= length
                    else:
                        greedy.append(64 - length)
            assert bins <= len(greedy) and bins >= -(-total // 64)
        check_bins(counts, packing.Capacities(64, 3, 64 * 64, choice=choice))
        check_bins(counts, packing.Capacities(128, 100, 64 * 64 + 7, choice=choice))
    with pytest.raises(ValueError):
        packing.best_fit({10: 1}, packing.Capacities(64, 3, 99))


def test_packing_round_trip(spark):
    draw = random.Random(2)
    pool = ["the ", "é", "\n", "  ", "<|endoftext|>", "12 ", "naïve ", "漢字", "don't ", "#" * 9]
    texts = [None, "", " "] + ["".join(draw.choice(pool) for _ in range(draw.choice([1, 5, 60, 400]))) for _ in range(80)]
    texts += [texts[9]] * 30
    ids = [i if i % 13 else None for i in range(len(texts))]
    docs = spark.createDataFrame(list(zip(ids, texts, texts)), "doc_id long, text string, length string").repartition(5)
    vocabulary = packing.Vocabulary(longest=900)
    rows = packing.pack(docs, packing.Capacities(tokens=64, documents=64, attention=64 * 64), vocabulary).collect()
    slow = Tokenizer.from_file(vocabulary.tokenizer)
    expected = Counter()
    for i, t in zip(ids, texts):
        own = slow.encode(t or "", add_special_tokens=False).ids + [0]
        first = len(own) % 64 or 64
        cuts = [0, *range(first, len(own) + 1, 64)]
        for n, (a, b) in enumerate(zip(cuts, cuts[1:])):
            expected[i, n, a, b - a, zlib.crc32(np.array(own[a:b], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == expected
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for held in sequences.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.pack(docs.limit(0)).collect() == []


# --- neighbours --------------------------------------------------------------


def test_neighbours_equal_brute_force(spark):
    draw = np.random.default_rng(4)
    vectors = draw.normal(size=(400, 8)).astype(np.float32)
    vectors[50:120] = vectors[50]  # many equal vectors
    vectors[200] *= 1e6
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    rows += [(1000, None), (1001, [0.0] * 8), (1002, [math.nan] * 8), (1003, [math.inf] + [1.0] * 7), (1004, [None] + [1.0] * 7), (1005, []), (None, [1.0] * 8)]
    rows += [(40, vectors[40].tolist()), (2000, [1.0, 2.0]), (2020, [3.0, -1.0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, score string")
    found = defaultdict(list)
    for r in neighbours.search(df, F.col("vec_id") % 20 == 0, k=7, query_block=8, candidate_block=60).orderBy("query_id", "rank").collect():
        assert r.rank == len(found[r.query_id]) + 1
        found[r.query_id].append((r.vec_id, r.score))
    wide = vectors.astype(np.float64)
    expected = {}
    for q in range(0, 400, 20):
        scores = [(-float(np.add.accumulate(wide[q] * wide[c])[-1]), c) for c in range(400) if c != q]
        expected[q] = [(c, -s) for s, c in sorted(scores)[:7]]
    expected[2000], expected[2020] = [(2020, 1.0)], [(2000, 1.0)]
    assert dict(found) == expected
    assert neighbours.search(df.limit(0), F.col("vec_id") % 20 == 0).collect() == []


def test_int8_bounds_hold():
    draw = np.random.default_rng(5)
    for dims in (1, 3, 1500):
        a, b = draw.normal(size=(20, dims)) * 10, draw.normal(size=(30, dims))
        codes, scale, norm, lost = neighbours.quantise(a)
        codes2, scale2, norm2, lost2 = neighbours.quantise(b)
        about = neighbours.int8_product(codes, codes2)
        assert (about == codes.astype(np.int64) @ codes2.astype(np.int64).T).all()
        about = about * scale[:, None] * scale2
        error = norm[:, None] * lost2 + lost[:, None] * (norm2 + lost2)
        assert (np.abs(about - a @ b.T) <= error + 1e-9).all()


# --- token counts --------------------------------------------------------------


def test_trie_equals_single_segmentations(spark):
    spec = token_counts.Unigrams(longest=12)
    score = token_counts.scores(spec.ranks)
    most = max(map(len, score))
    draw = random.Random(6)
    words = [bytes(draw.choice(b"abcx \xc3\xa9t") for _ in range(draw.randint(1, 16))) for _ in range(400)]
    words += [b"a", b"ab", b"abc", b"the", b" the", b"abc" * 30]
    counts, total = token_counts.Trie(score, spec.longest).segment(words)
    for w, n, s in zip(words, counts, total):
        assert (n, pytest.approx(s)) == token_counts.segment(w, score, most)
    import regex

    texts = [None, "", "the cat sat on the mat", "the  cat\n\n 123 naïve", "z" * 100, "the cat sat on the mat"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in token_counts.count_tokens(docs, spec).collect():
        parts = regex.findall(spec.pattern, texts[r.doc_id] or "")
        single = [token_counts.segment(p.encode(), score, most) for p in parts]
        assert (r.n_pretokens, r.n_tokens) == (len(parts), sum(n for n, _ in single))
        assert r.score == pytest.approx(sum(s for _, s in single))


# --- classifier ----------------------------------------------------------------


def kneser_ney(texts, order):
    """Probability of a byte after its context, straight from the definition."""
    counts = {order: Counter()}
    for t in texts:
        padded = b"\n" * (order - 1) + t.encode()
        counts[order].update(padded[i : i + order] for i in range(len(padded) - order + 1))
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    discounts = {}
    for k, c in counts.items():
        n = Counter(c.values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + 2 * n[2] else None
        discounts[k] = [0.0]
        for j in (1, 2, 3):
            raw = j - (j + 1) * y * n[j + 1] / n[j] if n[j] and y is not None else 0.5 * j
            discounts[k].append(min(max(raw, 0.1), j))

    def p(g):
        if not g:
            return 1 / 256
        k, c = len(g), counts[len(g)]
        same = [x for h, x in c.items() if h[:-1] == g[:-1]]
        if not same:
            return p(g[1:])
        d = discounts[k]
        own = max(c[g] - d[min(c[g], 3)], 0) / sum(same)
        return own + sum(d[min(x, 3)] for x in same) / sum(same) * p(g[1:])

    return p


def test_scores_equal_the_definition(spark):
    texts = {1: "abab abba abé", 2: "the cat\nthe bat", 3: "abc", 4: "", 5: None, 6: "zzé", 7: "the cat\nthe bat"}
    rows = [(i, t, "en", "x") for i, t in texts.items()] + [(None, "bat", None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, n string")
    trusted = spark.createDataFrame([(1,), (2,), (2,), (3,), (4,), (99,)], "doc_id long")
    p = kneser_ney([texts[i] for i in (1, 2, 3)], 3)
    found = perplexity.score(docs, trusted, perplexity.Classifier(order=3)).collect()
    assert len(found) == len(rows)
    for r in found:
        data = ("bat" if r.doc_id is None else texts[r.doc_id] or "").encode()
        padded = b"\n\n" + data
        assert r.n == len(data) and r.trusted == (r.doc_id in (1, 2, 3, 4))
        assert r.logp == pytest.approx(sum(math.log(p(padded[i : i + 3])) for i in range(len(data))))


def test_classifier_parts_held_out_texts(spark):
    draw = random.Random(8)
    syllables = ["ba", "to", "mi", "ren", "sol", "ta"]

    def good(n):
        return " ".join("".join(draw.choice(syllables) for _ in range(draw.randint(1, 3))) for _ in range(n)) + "."

    rows = [(i, good(draw.randint(5, 60)), "en" if i % 3 else None) for i in range(240)]
    rows += [(1000 + i, "".join(draw.choice("#$%&XQZ!!") for _ in range(150)), "en") for i in range(20)]
    rows += [(2000, "", "en"), (2001, None, "en"), (2002, good(30), "xx")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    trusted = spark.createDataFrame([(i,) for i in range(0, 240, 2)], "doc_id long")
    verdict = {r.doc_id: r.kept for r in perplexity.classify(docs, trusted, perplexity.Classifier(least=10)).collect()}
    assert not any(verdict[1000 + i] for i in range(20)) and not verdict[2000] and not verdict[2001]
    assert verdict[2002] and sum(verdict[i] for i in range(1, 240, 2)) >= 117
    free = perplexity.classify(docs, trusted.limit(0)).collect()
    assert all(r.kept == bool(r.doc_id not in (2000, 2001)) and r.threshold is None for r in free)
    assert perplexity.classify(docs.limit(0), trusted).collect() == []


def test_languages_of_few_trusted_texts(spark):
    draw = random.Random(13)
    words = {"en": ["ba", "to", "mi", "ren", "sol", "ta"], "yy": ["gük", "fez", "wox", "pyh", "dâl", "cuv"], "zz": ["жук", "пол", "рис", "сад"]}

    def good(lang, n):
        return " ".join("".join(draw.choice(words[lang]) for _ in range(draw.randint(1, 3))) for _ in range(n)) + "."

    rows = [(i, good("en", draw.randint(20, 60)), "en") for i in range(300)]
    rows += [(1000 + i, good("yy", draw.randint(20, 60)), "yy") for i in range(100)]
    rows += [(2000 + i, good("zz", draw.randint(20, 60)), "zz") for i in range(40)] + [(2100, "", "zz")]
    rows += [(3000 + i, "".join(chr(draw.randint(33, 0x24F)) for _ in range(150)), "yy") for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    limits = []
    for few in (1, 4, 30):
        trusted = spark.createDataFrame([(i,) for i in [*range(0, 300, 2), *range(1000, 1000 + few)]], "doc_id long")
        found = {r.doc_id: r for r in perplexity.classify(docs, trusted).collect()}
        assert all(found[2000 + i].kept and found[2000 + i].threshold is found[2000 + i].judged is None for i in range(40))
        assert not found[2100].kept
        assert sum(found[1000 + i].kept for i in range(few, 100)) >= 0.9 * (100 - few)
        assert not any(found[3000 + i].kept for i in range(10))
        limits.append(found[1000].threshold)
    assert limits[0] > limits[1] > limits[2]


def test_insults_in_long_clean_texts(spark):
    draw = random.Random(14)
    syllables = ["ba", "to", "mi", "ren", "sol", "ta"]
    insults = ["kluwgh", "zopfyx", "vrugqe"]

    def words(n):
        return ["".join(draw.choice(syllables) for _ in range(draw.randint(1, 3))) for _ in range(n)]

    def planted(n):
        out = words(n)
        for _ in range(2):
            out[draw.randrange(n)] = draw.choice(insults)
        return " ".join(out) + "."

    rows = [(i, " ".join(words(draw.randint(5, 600))) + ".", "en") for i in range(300)]
    rows += [(1000 + i, planted(draw.choice([100, 600])), "en") for i in range(80)] + [(2000, planted(200), "xx"), (2001, "", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    trusted = spark.createDataFrame([(i,) for i in range(0, 300, 2)], "doc_id long")
    toxic = spark.createDataFrame([(1000 + i,) for i in range(0, 80, 2)] + [(2001,)], "doc_id long")
    found = {r.doc_id: r for r in perplexity.classify(docs, trusted, toxic=toxic).collect()}
    assert sum(found[1000 + i].kept for i in range(1, 80, 2)) <= 4
    assert sum(found[i].kept for i in range(1, 300, 2)) >= 140
    assert found[2000].kept and found[2000].toxicity is None and not found[2001].kept
    none = perplexity.classify(docs, trusted, toxic=toxic.limit(0)).collect()
    assert all(r.toxicity is None and r.kept == (r.doc_id != 2001) for r in none if r.doc_id in found and r.doc_id >= 2000)
    offsets = np.array([0, 0, 3, 3, 10, 10])
    values = np.arange(10.0) - 4
    assert perplexity.worst_windows(values, offsets, 2).tolist() == [0.0, -2.0, 0.0, 4.5, 0.0]


# --- mixing --------------------------------------------------------------------


def test_raking_meets_the_marginals(spark):
    draw = random.Random(10)
    rows = [(s, l, t, draw.randint(0, 500)) for s in "abcde" for l in ("en", "") for t in "xyz"]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, tokens long")
    mix = mixing.Mix(flatten={"source": 0.5, "lang": 0.0, "topic": 1.0}, targets={"topic": {"x": 2, "y": 1, "z": 1, "none": 5}}, budget=0.6, tolerance=1e-4, sweeps=12)
    fitted = mixing.rake(cells, mix).collect()
    weight = np.array([r.weight for r in fitted])
    tokens = np.array([r.tokens for r in fitted], float)
    total = tokens.sum()
    assert weight.sum() == pytest.approx(total)
    for name, shares in (("topic", {"x": 0.5, "y": 0.25, "z": 0.25}), ("lang", {"en": 0.5, "": 0.5})):
        for value, share in shares.items():
            assert sum(r.weight for r in fitted if r[name] == value) == pytest.approx(share * total, rel=1e-2)
    plain = tokens.copy()  # the same by numpy
    natural = {s: sum(t for r, t in zip(fitted, tokens) if r.source == s) ** 0.5 for s in "abcde"}
    goal = {
        "source": {s: v / sum(natural.values()) for s, v in natural.items()},
        "lang": {"en": 0.5, "": 0.5},
        "topic": {"x": 0.5, "y": 0.25, "z": 0.25},
    }
    for _ in range(200):
        for name, shares in goal.items():
            for value, share in shares.items():
                at = np.array([r[name] == value for r in fitted])
                plain[at] *= share * total / plain[at].sum()
    assert weight == pytest.approx(plain, rel=2e-2, abs=1e-6)
    from dataclasses import replace

    chances = mixing.rates(cells, mix).collect()
    apart = {(r.source, r.lang, r.topic): r.probability for r in mixing.rates(cells, replace(mix, broadcast_cells=0)).collect()}
    assert all(r.probability == pytest.approx(apart[r.source, r.lang, r.topic], rel=1e-6) for r in chances)
    assert sum(r.tokens * r.probability for r in chances) == pytest.approx(0.6 * total, rel=1e-6)
    assert all(0 < r.probability <= 1 for r in chances)


def test_drawing_documents(spark):
    draw = random.Random(11)
    rows = [(i, "w " * draw.randint(1, 80), draw.choice("abb"), draw.choice(["en", "fr", None]), "k") for i in range(600)]
    rows += [(None, None, None, None, "k"), (7, "", "a", "en", "k"), (8, rows[8][1], rows[8][2], rows[8][3], "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, _k string")
    out = mixing.mixed_documents(docs, mixing.Mix(tolerance=1.0))
    found = out.collect()
    assert len(found) == len(rows) and {"doc_id", "text", "source", "lang", "_k"} < set(out.columns)
    assert len({(r.doc_id, r.text, r._chosen) for r in found}) == len({(r.doc_id, r.text) for r in found})
    shuffled = mixing.mixed_documents(docs.repartition(7), mixing.Mix(broadcast_cells=0, tolerance=1.0)).collect()
    assert Counter((r.doc_id, r._probability, r._chosen) for r in found) == Counter((r.doc_id, r._probability, r._chosen) for r in shuffled)
    assert all(r._chosen for r in found if not r._tokens)
    assert mixing.mixed_documents(docs.limit(0)).collect() == []


# --- pipeline --------------------------------------------------------------------


def test_stages_keep_columns_and_take_effect(spark, tmp_path):
    draw = random.Random(12)
    pool = ["ba", "to", "mirenso", "tasol", "renba", "mita", "soto", "bami", "remi"]
    rows = [(i, " ".join(draw.choice(pool) for _ in range(80)), "en", "s%d" % (i % 4), 0) for i in range(200)]
    rows += [(300 + i, rows[3][1] + " token=abcdef123456", "en", "s1", 0) for i in range(5)] + [rows[5], rows[5]]
    rows += [(400 + i, "#$%! " * 60 + str(i), "en", "s1", 0) for i in range(10)] + [(None, rows[6][1], "en", "s1", 0), (500, None, None, None, None)]
    docs = spark.createDataFrame([(*r, "p") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, _gone string")
    spark.createDataFrame([(i, 1, 0) for i in range(0, 200, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = stages.quality_classifier(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert not set(range(400, 410)) & set(ids) and 500 not in ids and ids.count(5) == 3 and None in ids
    unique = stages.near_duplicates(spark, docs, str(tmp_path))
    assert unique.columns == docs.columns
    ids = Counter(r.doc_id for r in unique.collect())
    assert ids[5] == 1 and ids[3] == 1 and not any(ids[300 + i] for i in range(5)) and ids[None] == 1
    clean = stages.secret_scan(spark, docs, str(tmp_path))
    assert clean.columns == docs.columns
    texts = {r.doc_id: (r.text, r.n_chars) for r in clean.collect()}
    assert texts[300] == (rows[3][1] + " [SECRET]", len(rows[3][1]) + 9) and texts[7] == (rows[7][1], 0)
    drawn = stages.source_mixing(spark, kept.withColumn("_tokens", F.lit("mine")), str(tmp_path))
    assert drawn.columns == [*docs.columns, "_tokens"] and {r["_tokens"] for r in drawn.collect()} == {"mine"}
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert packed and {r.doc_id for r in packed} <= {r.doc_id for r in kept.collect()}
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None


def test_texts_that_share_an_id_are_decided_apart(spark):
    draw = random.Random(15)

    def words():
        return " ".join("w%d" % draw.randrange(10000) for _ in range(60))

    copied, alone, other = words(), words(), words()
    rows = [(3, copied), (7, copied + " end"), (7, alone), (7, alone), (8, copied), (8, copied), (9, other), (9, other), (9, None), (None, copied)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, f1 string")
    found = stages.near_duplicates(spark, docs, "")
    assert found.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in found.collect()) == Counter([(3, copied), (7, alone), (9, other), (9, None), (None, copied)])
