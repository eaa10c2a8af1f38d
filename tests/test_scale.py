"""Steps that grew faster than their input: they are done once, in blocks, and give the same."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from simlake.functions import edit, fingerprints
from simlake.operators import search, store
from simlake.params import PRIME, SearchParams
from simlake.plans import queries as Q


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("parts"))
    k = F.col("id")
    spark.range(1, 61).select(k.alias("p_partkey"), (k % 50).cast("int").alias("p_size"), F.concat(F.lit("Brand#"), (k % 5).cast("string")).alias("p_brand")).write.parquet(f"{d}/part.parquet")
    return d


def test_all_pairs_by_pages_are_those_of_compare(spark, parts, monkeypatch):
    monkeypatch.setattr(search, "PAGE", 2)
    s = store.add_batch(store.empty(spark), Q.listings(spark, parts), Q.ASM).cache()
    cols = ["left", "right", *(F.round(c, 6) for c in ("jaccard", "edit_ratio", "score", "cfg_similarity"))]
    want = search.compare(search.similar_pairs(s, Q.ASM, 0.0), s, Q.ASM).select(*cols)
    assert sorted(map(tuple, search.compare_alike(s, Q.ASM).select(*cols).collect())) == sorted(map(tuple, want.collect()))
    assert search.compare_alike(s, Q.ASM).where("left >= right").isEmpty()


def test_lcs_of_many_pairs():
    r = np.random.default_rng(1)
    xs, ys = (["".join(r.choice(list("abé\U0001f600"), n)) for n in sizes] for sizes in ((0, 1, 63, 64, 65, 130, 200), (0, 2, 64, 129, 300)))
    assert edit.lcs_table(xs, ys).tolist() == [[edit.lcs(x, y) for y in ys] for x in xs]
    assert edit.ratio_table(xs, ys).tolist() == [[edit.ratio(x, y) for y in ys] for x in xs]
    assert edit.lcs_table(["a" * 600], ["a" * 599]).tolist() == [[599]]


def test_find_is_brute_force_with_few_and_many_queries(spark, monkeypatch):
    p = SearchParams(tokenizer="word", threshold=0.3, top_n=3)
    rows = [(i, f"n{i}", " ".join(f"w{(i // 8) * 7 + k * (1 + (i % 8 > 5))}" for k in range(20 + i % 8)) + f" x{i % 3}") for i in range(64)]
    s = store.add_batch(store.empty(spark), spark.createDataFrame(rows, "ord int, name string, code string"), p).cache()
    asked = [(i, rows[i // 2 * 2][2][3:]) for i in range(0, 64, 3)] + [(100, rows[0][2]), (101, rows[0][2]), (102, "zzz"), (103, "")]
    q = search.fingerprint(spark.createDataFrame(asked, "query_id int, code string"), p).cache()
    stored = {r.checksum: r for r in s.collect()}
    b, r = p.bands
    want = []
    for x in q.collect():
        like = []
        for c, y in stored.items():
            if max(x.sig) < PRIME and any(x.sig[k * r : k * r + r] == y.sig[k * r : k * r + r] for k in range(b)):
                j, e = sum(u == v for u, v in zip(x.sig, y.sig)) / 128, edit.ratio(x.code, y.code)
                like.append((-(j * 40 + e * 0.6), c, e))
        want += [(x.query_id, k + 1, c, round(-score, 6)) for k, (score, c, _) in enumerate(sorted(like)[:3])]
    for most in (2000, 5):
        monkeypatch.setattr(search, "BROADCAST_QUERIES", most)
        for prune in (True, False):
            got = [(v.query_id, v["rank"], v.checksum, round(v.score, 6)) for v in search.find(q, s, p, prune).collect()]
            assert sorted(got) == sorted(want)


def test_bounds_of_edit_ratios_hold():
    r = np.random.default_rng(2)
    for _ in range(200):
        x, y = ("".join(r.choice(list("ab c"), r.integers(0, 60))) for _ in range(2))
        assert edit.ratio(x, y) <= search._most(search._reach(x), search._reach(y)) + 1e-9


def test_signatures_are_taken_once(spark):
    df = spark.createDataFrame([(i, f"a b c {i}") for i in range(4)], "i int, code string")
    plan = search.fingerprint(df, Q.WORD).where(search.has_elements(F.col("sig"))).select(F.array_max("sig"), F.array_min("sig"))
    assert plan._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1


@pytest.mark.parametrize("p", [Q.WORD, Q.ASM, SearchParams(tokenizer="word", ngram=1, num_perm=16)])
def test_signatures_are_minima_of_md5(p):
    import hashlib

    from simlake.params import permutations

    texts = ["", "a", "A b, c d", "x" * 70 + " y z", "mov eax, 1\ncpuid ; x", " ".join(f"w{i}" for i in range(9000)), "a b", None]
    for t, row in zip(texts, fingerprints.signatures(texts, p)):
        if t is None:
            assert row is None
            continue
        h = np.array([int(hashlib.md5(e.encode()).hexdigest()[:8], 16) % PRIME for e in fingerprints.element_list(t, p)], np.int64)
        assert row.tolist() == [int(((a * h + b) % PRIME).min()) if len(h) else PRIME for a, b in zip(*permutations(p.num_perm, p.seed))]


def test_lcs_ends_early_only_below_what_is_asked():
    r = np.random.default_rng(3)
    for _ in range(60):
        x, y = ("".join(r.choice(list("abc"), r.integers(0, 700))) for _ in range(2))
        n = edit.lcs(x, y)
        assert edit.lcs(x, y, n) == n and edit.lcs(x, y, n + 1) in (-1, n) and edit.lcs(x, y, max(len(x), len(y)) + 1) in (-1, n)


def test_queries_of_one_text_all_have_its_answer(spark, monkeypatch):
    monkeypatch.setattr(search, "BROADCAST_QUERIES", 0)
    p = SearchParams(tokenizer="word", top_n=2)
    s = store.add_batch(store.empty(spark), spark.createDataFrame([(i, f"n{i}", f"a b c d {i % 3}") for i in range(6)], "ord int, name string, code string"), p)
    q = search.fingerprint(spark.range(0, 3000, 1, 12).select(F.col("id").alias("query_id"), F.concat(F.lit("a b c d "), F.pmod(F.xxhash64("id"), F.lit(3)).cast("string")).alias("code")), p)
    got = search.find(q, s, p).where("rank = 1")
    assert got.count() == 3000 and got.agg(F.min("score")).first()[0] == 100.0
