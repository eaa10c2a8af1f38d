import random

from hypothesis import given, settings
from hypothesis import strategies as st

from simlake.llm.decontam import Automaton, contaminated_spans, decontaminate


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=8), max_size=4), st.lists(st.integers(0, 3), max_size=20))
def test_automaton_finds_the_maximal_matches(items, text):
    auto = Automaton([(i, w) for i, w in enumerate(items) if w])
    parts = {tuple(w[a:z]) for w in items for a in range(len(w)) for z in range(a + 1, len(w) + 1)}

    def longest(end):
        return max([n for n in range(1, end + 1) if tuple(text[end - n : end]) in parts], default=0)

    reach = [0, *(longest(e) for e in range(1, len(text) + 1))]
    want = [(e - reach[e], e) for e in range(1, len(text) + 1) if reach[e] and (e == len(text) or reach[e + 1] != reach[e] + 1)]
    got = auto.matches(text)
    assert [(a, z) for a, z, *_ in got] == want
    for a, z, item, size in got:
        holders = [(len(w), i) for i, w in enumerate(items) if any(w[k : k + z - a] == text[a:z] for k in range(len(w)))]
        assert (size, item) == min(holders)


def bench(spark, rows):
    return spark.createDataFrame(rows, "item_id bigint, text string")


def test_spans_and_removal(spark, make_docs, prose):
    items = [(1, prose(1, 30)), (2, prose(2, 10)), (3, None), (4, "?!"), (5, prose(1, 30))]
    whole, part, short, clean = (f"{prose(9, 40)}\n{x}\n{prose(8, 40)}" for x in (prose(1, 30).upper().replace(".", " --"), " ".join(prose(1, 30).split()[3:18]), prose(2, 10), " ".join(prose(1, 30).split()[:5])))
    docs = make_docs([whole, part, short, clean, prose(2, 10), whole])
    got = {r.doc_id: r for r in contaminated_spans(docs, bench(spark, items)).collect()}
    assert set(got) == {0, 1, 2, 4, 5}
    assert (got[0].item_id, got[0].n_words, got[0].coverage) == (1, 30, 1.0)
    assert whole[got[0].start : got[0].end] == got[0].passage
    assert got[1].n_words == 15 and got[2].item_id == 2
    left = {r.doc_id: r for r in decontaminate(docs, bench(spark, items)).collect()}
    assert set(left) == {0, 1, 2, 3, 5}
    assert left[3].text == clean
    assert left[0].text == whole.replace(whole[got[0].start : got[0].end], "") and left[0].n_chars == len(left[0].text)
    assert decontaminate(docs, bench(spark, items)).columns == docs.columns


def test_slices_of_a_large_benchmark_agree(spark, make_docs, prose, untouched):
    items = [(i, prose(i, 20)) for i in range(12)]
    docs = make_docs([f"{prose(100 + i, 15)} {prose(i % 14, 20)}" for i in range(30)])
    key = lambda df: sorted((r.doc_id, r.span, r.start, r.end, r.item_id, r.passage) for r in df.collect())
    assert key(contaminated_spans(docs, bench(spark, items))) == key(contaminated_spans(docs, bench(spark, items), broadcast_words=60))
    # Items that adjoin or overlap, of which some hold parts of others, in different slices.
    w = [prose(40 + i, 20) for i in range(6)]
    items = [(i, t) for i, t in enumerate([*w, " ".join(w[0].split()[:9] + w[1].split()[:14]), " ".join(w[2].split()[4:13]), w[3] + " " + w[4]])]
    texts = [f"{prose(90 + a, 5)} {w[a]} and {w[b]} {prose(80 + b, 4)}" for a in range(6) for b in range(6)] + [f"start {w[0]} {w[1]}", " ".join(w[2].split()[3:14]), f"x {w[3]} {w[4]} {w[5]}"]
    docs = make_docs(texts)
    for words in (30, 60, 90):
        assert key(contaminated_spans(docs, bench(spark, items))) == key(contaminated_spans(docs, bench(spark, items), broadcast_words=words))
        left = decontaminate(docs, bench(spark, items), broadcast_words=words)
        assert sorted((r.doc_id, r.text) for r in left.collect()) == sorted((r.doc_id, r.text) for r in decontaminate(docs, bench(spark, items)).collect())
        assert untouched(left) and left.columns == docs.columns


def test_letters_that_change_in_lower_case(spark, make_docs, prose):
    item = prose(7, 20)
    text = f"\u0130stanbul 5 \u212a \u1e9e before\n{item.upper()}\nafter \u2126 it."
    assert decontaminate(make_docs([text]), bench(spark, [(1, item)])).first().text == text.replace(item.upper().rstrip("."), "")


def test_hard_cases(spark, make_docs, hard):
    docs = make_docs(hard)
    for items in ([], [(None, None)], [(1, "x " * 20)]):
        b = bench(spark, items)
        spans = contaminated_spans(docs, b).collect()
        n = decontaminate(docs, b).count()
        assert (len(spans) > 0) == (items == [(1, "x " * 20)])
        assert n == len(hard) - len({r.doc_id for r in spans})
    assert contaminated_spans(make_docs([]), bench(spark, [(1, "a b")])).count() == 0
    assert decontaminate(make_docs([]), bench(spark, [])).count() == 0


def test_streaming_matches_brute_force(spark, make_docs, prose):
    r = random.Random(4)
    items = [(i, prose(i, r.randint(8, 40))) for i in range(6)]
    texts = []
    for _ in range(40):
        w = prose(r.randint(50, 90), 60).split()
        it = items[r.randrange(6)][1].split()
        a = r.randrange(len(it))
        n = r.randint(3, len(it))
        k = r.randrange(60)
        texts.append(" ".join([*w[:k], *it[a : a + n], *w[k:]]))
    norm = lambda t: t.replace(".", "").split()
    grams = {n: {tuple(norm(t)[a : a + n]) for _, t in items for a in range(len(norm(t)) - n + 1)} for n in range(8, 41)}
    want = set()
    for i, t in enumerate(texts):
        w = norm(t)
        for a in range(len(w)):
            for n in range(8, 41):
                g = tuple(w[a : a + n])
                if len(g) == n and g in grams[n] and (n >= 13 or n >= 0.5 * min(len(norm(x)) for _, x in items if g in {tuple(norm(x)[k : k + n]) for k in range(len(norm(x)))})):
                    want.add(i)
    assert {r.doc_id for r in contaminated_spans(make_docs(texts), bench(spark, items)).collect()} == want
