import itertools
import random

import numpy as np
import pyarrow as pa
import pytest

from simlake.llm import bagminhash as B
from simlake.llm import npwords as W
from simlake.llm.components import connected_components, roots
from simlake.llm import line_dedup as D
from simlake.llm.neargroups import enough, met
from simlake.llm.line_dedup import drop_duplicate_lines, duplicate_lines, edits_within


def points(text):
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def bags(texts):
    out = {}
    for c in W.chunks(pa.array(texts, pa.string())):
        r, g, n = B.features(c)
        for i in range(c.hi - c.lo):
            out[c.lo + i] = dict(zip(g[r == i].tolist(), n[r == i].tolist()))
    return out


def weighted_jaccard(x, y):
    keys = set(x) | set(y)
    return sum(min(x.get(k, 0), y.get(k, 0)) for k in keys) / max(1, sum(max(x.get(k, 0), y.get(k, 0)) for k in keys))


def test_signatures_estimate_weighted_jaccard_without_bias():
    r = random.Random(0)
    texts = []
    for _ in range(40):
        v = [f"w{i}" for i in range(r.choice([4, 40, 300]))]
        a = [r.choice(v) for _ in range(r.choice([2, 30, 300]))]
        b = [r.choice(v) if r.random() < 0.2 else w for w in a]
        texts += [" ".join(a), " ".join(b)]
    c = next(W.chunks(pa.array(texts)))
    sig = B.signatures(*B.features(c), len(texts), 1024)
    own = bags(texts)
    err = [(sig[i] == sig[i + 1]).mean() - weighted_jaccard(own[i], own[i + 1]) for i in range(0, len(texts), 2)]
    assert np.isfinite(sig).all() and abs(np.mean(err)) < 0.008 and np.abs(err).max() < 0.07


def test_components_by_stars_and_in_one_task(spark):
    r = random.Random(2)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1040)]
    ids, root = roots(np.array([a for a, _ in edges]), np.array([b for _, b in edges]))
    want = dict(zip(ids.tolist(), root.tolist()))
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    for per_task in (10**6, 40):
        assert {x.id: x.root for x in connected_components(df, per_task).collect()} == want
    assert connected_components(df.limit(0)).count() == 0


def test_edits_within_is_levenshtein():
    r = random.Random(1)

    for _ in range(120):
        a, b = ("".join(r.choice("abé") for _ in range(r.randint(0, 12))) for _ in range(2))
        assert [edits_within(points(a), points(b), k) for k in range(14)] == [distance(a, b) <= k for k in range(14)]


@pytest.fixture(scope="module")
def copies(prose):
    """Texts with exact copies, near copies of one changed word in twenty, a chain, and loners."""
    r = random.Random(5)
    out = []
    for g in range(12):
        base = prose(g, 80).split()
        out.append(" ".join(base))
        for _ in range(g % 5):
            w = list(base)
            for _ in range(3):
                w[r.randrange(80)] = "changed"
            out.append(" ".join(w))
        if g % 3 == 0:
            out.append(" ".join(base).upper())
    return out


def test_near_duplicates_are_those_of_brute_force(spark, make_docs, copies):
    own = bags(copies)
    pairs = [(i, j) for i, j in itertools.combinations(range(len(copies)), 2) if weighted_jaccard(own[i], own[j]) >= 0.5]
    got = {r.doc_id: r for r in B.near_duplicates(make_docs(copies)).collect()}
    assert sum(i in got and j in got and got[i].group_id == got[j].group_id for i, j in pairs) >= 0.9 * len(pairs)
    near = {i for p in pairs for i in p}
    assert set(got) <= near
    kept = {r.doc_id for r in B.drop_near_duplicates(make_docs(copies)).collect()}
    assert kept == set(range(len(copies))) - {i for i, r in got.items() if not r.is_kept}


def test_near_duplicates_in_hard_cases(spark, make_docs, hard, untouched):
    df = make_docs(hard)
    got = sorted((r.doc_id, r.group_id, r.n_docs) for r in B.near_duplicates(df).collect())
    assert got == [(4, 4, 3), (4, 4, 3), (5, 4, 3)]
    left = B.drop_near_duplicates(df)
    assert left.columns == df.columns and left.count() == len(hard) - 2 and untouched(left)
    same = make_docs([(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (None, "e f g h"), (None, "e f g h")])
    assert sorted((r.doc_id is None, r.doc_id) for r in B.drop_near_duplicates(same).collect()) == [(False, 1), (True, None)]
    for empty in (make_docs([]), make_docs([None, ""])):
        assert B.near_duplicates(empty).count() == 0 and B.drop_near_duplicates(empty).count() == empty.count()


def test_lines_are_those_of_brute_force(spark, make_docs, prose):
    r = random.Random(3)
    lines = [prose(100 + i, r.randint(12, 40)) for i in range(30)]
    near = [" ".join(w if k != 5 else w + "x" for k, w in enumerate(x.split())) for x in lines[:15]]
    texts = ["\n".join([lines[i], prose(500 + i, 20), near[i % 15] if i % 2 else "---"]) for i in range(30)]
    texts += ["\n".join(["", lines[3].upper(), "only here " + prose(900, 9)])]
    got = {(x.doc_id, x.line): (x.kept_doc_id, x.kept_line) for x in duplicate_lines(make_docs(texts)).collect()}
    want = {(30, 1)} | {(i, 2) for i in range(30) if i % 2}
    firsts = {}
    for i, t in enumerate(texts):
        for k, x in enumerate(t.split("\n")):
            for j, y in enumerate([*lines, *near]):
                if x == y:
                    firsts.setdefault(j % 30, []).append((i, k))
    want = {p for ps in firsts.values() for p in sorted(ps)[1:]} | {(30, 1)}
    assert len(set(got) & want) >= 0.9 * len(want) and set(got) <= want
    left = {x.doc_id: x.text for x in drop_duplicate_lines(make_docs(texts)).collect()}
    for i, t in enumerate(texts):
        assert left[i] == "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in got)


def test_lines_in_hard_cases(spark, make_docs, hard, untouched):
    df = make_docs(hard)
    left = drop_duplicate_lines(df)
    got = {(x.doc_id, x.text) for x in left.collect()}
    assert left.columns == df.columns and untouched(left)
    assert (None, "\n\n") in got and (2, " ") in got and (0, None) in got and (5, "?!") in got
    assert sum(t == "word" for _, t in got) == 1
    assert duplicate_lines(make_docs([])).count() == 0 and drop_duplicate_lines(make_docs([])).count() == 0
    twice = make_docs([(1, "a b c\nd e f"), (1, "a b c\nd e f"), (2, "a b c")])
    assert sorted((x.doc_id, x.text) for x in drop_duplicate_lines(twice).collect()) == [(1, "a b c\nd e f")] * 2


def test_lines_of_edited_characters_are_candidates(prose):
    r = random.Random(11)

    def edited(t, k):
        out = list(t)
        for p in r.sample([i for i, x in enumerate(t) if x != " "], k):
            out[p] = r.choice(["q", "z", "", out[p] + "v"])
        return "".join(out)

    for words, share in itertools.product((4, 7, 11, 60), (0, 0.05, 0.08)):
        lines = [prose(20_000 + 1000 * words + i, words).replace(".", "") for i in range(60)]
        lines = [(x, edited(x, max(1, int(share * len(x))))) for x in lines if len(x) > 20]
        key = lambda t: int(D.Lines(next(W.chunks(pa.array([t])))).key[0])
        rec = np.concatenate([D.sketches(c, D.SIMILARITY, D.BLOCKS, D.BLOCK_BITS) for c in W.chunks(pa.array([y for x in lines for y in x]))])
        ids, sizes = D.near_in_blocks(rec, D.SIMILARITY)
        found = {frozenset(p) for b in np.split(ids, np.cumsum(sizes)[:-1]) for p in itertools.combinations(b.tolist(), 2)}
        near = [frozenset((key(x), key(y))) for x, y in lines if edits_within(points(x), points(y), int(0.1 * max(len(x), len(y)) + 1e-9))]
        assert len(near) > 15 and sum(p in found for p in near) >= 0.9 * len(near), (words, share)


def distance(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


def test_bands_and_bounds_agree_with_levenshtein(prose):
    r = random.Random(6)
    for sim in (0.9, 0.5, 1.0):
        xs, ys = [], []
        for i in range(500):
            a = "".join(r.choice("abé ") for _ in range(r.randint(0, 60))) if i % 3 else prose(7000 + i, r.randint(1, 20))
            b = list(a)
            for _ in range(r.randint(0, 9)):
                p = r.randint(0, len(b))
                b[p : p + r.randint(0, 1)] = r.choice(["", "x", "漢", "😀"])
            xs.append(a)
            ys.append("".join(b) if r.random() < 0.9 else a[::-1])
        want = [distance(a, b) <= int((1 - sim) * max(len(a), len(b)) + 1e-9) for a, b in zip(xs, ys)]
        for long in (5, 2000):
            assert D.within(pa.array(xs), pa.array(ys), sim, long).tolist() == want
        edge = np.append(0, np.cumsum([len(t.encode()) + 1 for t in [*xs, *ys]]))
        sketch = D.bound_sketches(np.frombuffer("".join(t + " " for t in [*xs, *ys]).encode(), np.uint8), edge)
        assert D.may_be_near(sketch[:500], sketch[500:], sim)[np.array(want)].all()
        assert all(D.edits_at_most(points(a), points(b)) >= distance(a, b) for a, b in zip(xs, ys))


def test_buckets_of_long_keys_are_those_of_brute_force():
    r = np.random.default_rng(4)
    for bits in (16, 24):
        rec = np.zeros(4000, D._REC)
        rec["key"] = r.integers(0, 40, 4000) * 3 + (r.integers(0, 16, 4000).astype(np.uint32) << np.uint32(bits))
        rec["id"], rec["len"] = r.integers(0, 1 << 62, 4000), 50
        ids, sizes = D.near_in_blocks(rec, D.SIMILARITY)
        got = {frozenset(p) for b in np.split(ids, np.cumsum(sizes)[:-1]) for p in itertools.combinations(b.tolist(), 2)}
        want = {frozenset(p) for k in np.unique(rec["key"]) for p in itertools.combinations(rec["id"][rec["key"] == k].tolist(), 2)}
        assert got == want, bits


def test_lines_that_only_share_a_passage_are_left_out_by_sketches(spark, make_docs, monkeypatch):
    r = random.Random(12)
    seen, real = [], D.verified_groups

    def words(n):
        return " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(3, 8))) for _ in range(n))

    def counted(candidates, fetch, holds, *more):
        def held(both):
            seen.append(both.count())
            return holds(both)

        return real(candidates, fetch, held, *more)

    monkeypatch.setattr(D, "verified_groups", counted)
    passage = words(25)
    texts = [f"{words(5 + 3 * i)} {passage} {words(65 - 3 * i)}" for i in range(20)]
    texts += [texts[0].replace("a", "b", 3), words(90)]
    rows = D.near_lines(make_docs(texts)).collect()
    assert len(rows) == 2 and len({x.root for x in rows}) == 1
    assert 1 <= sum(seen) <= 8, seen


def test_lengths_and_places_that_near_lines_allow():
    r = random.Random(8)
    for _ in range(300):
        a = [r.choice("abcd") for _ in range(r.randint(10, 80))]
        b = list(a)
        for _ in range(r.randint(0, len(a) // 10)):
            p = r.randint(0, len(b))
            b[p : p + r.randint(0, 1)] = r.choice([[], ["x"]])
        ok, far = D.may_differ(np.array([len(a)]), np.array([len(b)]), D.SIMILARITY)
        near = distance(a, b) <= int((1 - D.SIMILARITY) * max(len(a), len(b)) + 1e-9)
        assert ok[0] or not near
        assert far[0] == int(0.1 * max(len(a), len(b)) + 1e-9)
    assert D.may_differ(np.array([70_000]), np.array([65_000]), 0.9)[1].tolist() == [65535]


def test_equal_minima_of_other_grams_make_no_bucket():
    rec = np.zeros(6, D._REC)
    rec["key"], rec["id"], rec["len"], rec["sure"] = 9, np.arange(6), 50, [1, 2, 2, 3, 4, 1]
    ids, sizes, pos = D.placed_in_blocks(rec, D.SIMILARITY)
    assert ids.tolist() == [0, 5, 1, 2] and sizes.tolist() == [2, 2] and len(pos) == 4


def test_blocks_of_two_passes_are_those_of_one():
    r = random.Random(4)
    c = next(W.chunks(pa.array(["\n".join(" ".join(r.choice(["alpha", "be", "gamma7", "deltas"]) for _ in range(r.randint(4, 60))) for _ in range(30))])))
    whole = D.sketches(c, 0.9, 26, 27)
    parts = np.concatenate([D.sketches(c, 0.9, 13, 27, lo) for lo in (0, 13)])
    assert sorted(whole.tolist()) == sorted(parts.tolist())


def test_a_thing_moves_to_its_pairs_block_once(spark):
    # Sixty things of one leader, all pairs: each thing is there once for all of its pairs, and all pairs get their verdict.
    things = spark.createDataFrame([(k, f"t{k}") for k in range(60)], "id bigint, thing string")
    every = list(itertools.combinations(range(60), 2))
    pairs = spark.createDataFrame([(a, b, 0) for a, b in every], "a bigint, b bigint, lead bigint")

    def near(values, i, j):
        assert len(values) <= 60 and len(set(values.to_pylist())) == len(values)
        n = [int(t[1:]) for t in values.to_pylist()]
        return np.array([(n[x] + n[y]) % 7 == 0 for x, y in zip(i, j)], bool)

    for per_leader in (50_000, 100):
        got = met(pairs, things, "thing", near, per_leader).collect()
        assert sorted((x.a, x.b) for x in got) == [(a, b) for a, b in every if (a + b) % 7 == 0]


def test_pairs_that_others_connect_get_no_verdict():
    # Forty things of two groups, all pairs across: one near pair makes them one group. Of three groups that aren't near every pair gets its verdict.
    i, j = (np.array(v) for v in zip(*itertools.product(range(20), range(20, 40))))
    asked = []

    def near(a, b):
        asked.extend(zip(a.tolist(), b.tolist()))
        return (a + b) % 3 == 0

    ok = enough(near, i, j, i * 0, i * 0 + 1)
    assert ok.sum() >= 1 and len(asked) <= 5 and ((i + j)[ok] % 3 == 0).all()
    asked.clear()
    pairs = np.array(list(itertools.combinations(range(0, 30, 3), 2)))
    ok = enough(lambda a, b: near(a, b) & False, pairs[:, 0], pairs[:, 1], pairs[:, 0] // 10, pairs[:, 1] // 10)
    assert not ok.any() and sorted(asked) == sorted(map(tuple, pairs[pairs[:, 0] // 10 != pairs[:, 1] // 10].tolist()))
    r = np.random.default_rng(5)
    for _ in range(50):
        i, j, group = r.integers(0, 40, 120), r.integers(0, 40, 120), r.integers(0, 12, 40)
        good = r.random(120) < 0.2
        number = np.arange(120)
        ok = enough(lambda a, b: good[a], number, j, group[i], group[j])
        whole, some = (dict(zip(*(v.tolist() for v in roots(group[i][k], group[j][k])))) for k in (good, ok))
        assert not (ok & ~good).any()
        assert all(some.get(g, g) == whole.get(g, g) for g in range(12))


def test_blocks_of_one_order_are_found_in_one_look_at_each_gram():
    r = np.random.default_rng(8)
    g, other, place = r.integers(0, 1 << 32, 900, dtype=np.uint32), r.integers(0, 1 << 32, 900, dtype=np.uint32), np.arange(900, dtype=np.int32)
    at = np.array([0, 5, 300])
    line, block, value, sure, pos = D.parted_values(g, other, at, place, 26, 27, 0, 26)
    own = np.searchsorted(at, pos, "right") - 1
    assert (own == line).all() and (g[pos].astype(np.uint64) * np.uint64(26) >> np.uint64(32) == block).all()
    assert len(set(zip(line.tolist(), block.tolist()))) == len(line) and (line == 0).sum() <= 5 and (line == 2).sum() == 26
    # A line with all of another's grams in another order has its blocks.
    order = 300 + r.permutation(600)
    again = D.parted_values(g[order], other[order], np.array([0]), place[:600], 26, 27, 0, 26)
    assert again[2].tolist() == value[line == 2].tolist() and again[3].tolist() == sure[line == 2].tolist()
