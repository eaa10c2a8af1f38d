import random

import pyarrow as pa
import pytest
import regex

from simlake.llm import licences, matroska, maxent, packing, preferences, token_counts, toxicity
from simlake.llm import npwords as W
from simlake.llm.licence_texts import TEMPLATES


@pytest.fixture(scope="module")
def labelled(spark, make_docs, prose):
    r = random.Random(1)
    bad = ["vilest", "scoundrel", "dreadfool", "nastyone"]
    texts, labels = [], []
    for i in range(240):
        s = [prose(1000 + 50 * i + k, 10) for k in range(r.randint(2, 8))]
        toxic = i % 4 == 0
        if toxic:
            k = r.randrange(len(s))
            s[k] = f"{s[k]} {r.choice(bad)} {r.choice(bad)}"
        texts.append(". ".join(s) + ".")
        labels.append((i, int(toxic)))
    return make_docs(texts), spark.createDataFrame(labels[:180] + [(3, None), (None, 1), (0, 1)], "doc_id bigint, toxic int"), labels


def test_toxicity_on_held_out_labels(labelled):
    docs, labels, truth = labelled
    rows = toxicity.offending_sentences(docs, labels).collect()
    got = {r.doc_id for r in rows}
    held = {i: t for i, t in truth[180:]}
    assert sum((i in got) == bool(t) for i, t in held.items()) >= 0.95 * len(held)
    best = max((r for r in rows if r.doc_id == rows[0].doc_id), key=lambda r: r.score)
    assert any(w in best.sentence_text for w in ("vilest", "scoundrel", "dreadfool", "nastyone"))
    text = docs.where(f"doc_id = {best.doc_id}").first().text
    assert text[best.start : best.end].strip() == best.sentence_text
    kept = {r.doc_id for r in toxicity.reject_toxic(docs, labels).collect()}
    assert kept == set(range(240)) - got


def test_toxicity_in_hard_cases(spark, make_docs, hard, labelled):
    docs = make_docs(hard)
    one = spark.createDataFrame([(i, 0) for i in range(20)], "doc_id bigint, toxic int")
    for labels in (one, one.limit(0)):
        assert toxicity.offending_sentences(docs, labels).count() == 0
        assert toxicity.reject_toxic(docs, labels).count() == len(hard)
    toxic = spark.createDataFrame([(4, 1), (8, 1), (1, 0), (2, 0), (0, 0), (9, 0)], "doc_id bigint, toxic int")
    assert {0, 1, 2, 5} <= {r.doc_id for r in toxicity.reject_toxic(docs, toxic).collect()}
    assert toxicity.reject_toxic(make_docs([]), labelled[1]).count() == 0


def test_toxicity_does_not_come_from_length(spark, make_docs, labelled):
    docs, labels, _ = labelled
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(1000, "zzz qqq\n" * 20_000), (1001, docs.where("doc_id = 1").first().text.replace(".", "\n") * 4000)]
    for own in (labels, labels.limit(0)):
        assert not {r.doc_id for r in toxicity.offending_sentences(make_docs(rows), own).collect()} & {1000, 1001}
        assert {1000, 1001} <= {r.doc_id for r in toxicity.reject_toxic(make_docs(rows), own).collect()}


def dice(a, b):
    words = lambda t: regex.findall("[0-9a-z\u00c0-\u1fff]+", t.lower())
    x, y = ({*zip(w, w[1:])} for w in (words(a), words(b)))
    return 2 * len(x & y) / (len(x) + len(y)) if x and y else 0.0


def test_licences_are_those_of_brute_force(spark, make_docs, prose):
    texts = [prose(i, 30) + "\n" + t + "\n" + prose(i + 50, 9) for i, (_, t) in enumerate(TEMPLATES)] + [prose(99, 50), TEMPLATES[3][1].replace("Software", "Library")]
    rows = licences.licence_matches(make_docs(texts)).collect()
    lines = {(r.doc_id, r.first_line): r for r in rows if r.unit == "line"}
    for i, t in enumerate(texts):
        for k, line in enumerate(t.split("\n")):
            best = max(((dice(line, x), n) for n, x in TEMPLATES), key=lambda p: p[0])
            assert ((i, k) in lines) == (best[0] >= 0.8), (i, k, best)
            if best[0] >= 0.8:
                assert abs(lines[i, k].dice - best[0]) < 1e-9
    assert {r.licence for r in rows if r.doc_id == len(texts) - 1 and r.unit == "text"} == {"MIT"}
    assert not any(r.doc_id == len(texts) - 2 for r in rows)


def test_licences_amid_prose_are_found(make_docs, prose):
    texts = []
    for i, (_, t) in enumerate(TEMPLATES):
        first, second = prose(2 * i, 90), prose(2 * i + 1, 90)
        texts += [f"{first}\n\n{t}\n\n{second}", f"{first}. {' '.join(t.split())} {second}"]
        words = t.split()
        texts.append("\n\n".join([first, *(" ".join(words[k : k + 40]) for k in range(0, len(words), 40)), second]))
    rows = licences.licence_matches(make_docs(texts)).collect()
    for i, t in enumerate(texts):
        name, own = TEMPLATES[i // 3]
        best = max((r.dice for r in rows if r.doc_id == i and r.licence == name), default=0)
        assert best >= 0.8, (i, name)
    row = licences.licence_matches(make_docs(["This small library is free. Released under the MIT License."])).collect()
    assert [(r.unit, r.first_line, r.last_line, "MIT" in r.licence) for r in row] == [("run", 0, 0, True)]


def test_licences_in_hard_cases(make_docs, hard):
    assert licences.licence_matches(make_docs(hard)).count() == 0
    assert licences.licence_matches(make_docs([])).count() == 0
    assert licences.licence_matches(make_docs(["a b c"]), [("x", None), ("z", "a b c"), ("y", "a b c")]).first().licence == "y"
    with pytest.raises(ValueError):
        licences.licence_matches(make_docs([]), [], 0)


def test_pretokens_and_counts(make_docs, hard):
    pattern = regex.compile(token_counts.PATTERN)
    r = random.Random(2)
    texts = ["".join(r.choice(" \n\t  '''strevmlld''abcÉñ中1²٣.,!-　 😀_") for _ in range(r.randint(0, 40))) for _ in range(1500)] + ["don't they'll we've I'm 'sable ''s x ''s \n's  's"]
    for lo, hi, cp, offs in token_counts.points(pa.array(texts, pa.large_string())):
        s, e = token_counts.pretokens(cp, offs)
        for i in range(hi - lo):
            own = (s >= offs[i]) & (s < offs[i + 1])
            assert ["".join(map(chr, cp[a:z])) for a, z in zip(s[own], e[own])] == pattern.findall(texts[lo + i])
    encode = token_counts.Encoder.of(token_counts.VOCABULARY).encoding.encode_ordinary
    rows = [*enumerate(texts[:60]), *((1000 + i, t) for i, (_, t) in enumerate(hard))]
    want = {i: None if t is None else len(encode(t)) for i, t in rows}
    for table in (1 << 16, 4):
        assert {r.doc_id: r.n_tokens for r in token_counts.token_counts(make_docs(rows), frequent=table).collect()} == want
    assert token_counts.token_counts(make_docs([])).count() == 0


def test_cuts_are_the_best():
    r = random.Random(0)
    for _ in range(150):
        n = r.randint(1, 10)
        size, cost, w = [r.randint(1, 8) for _ in range(n)], [r.choice([0, 3, 9]) for _ in range(n)], 8

        def total(cuts):
            a = t = 0
            for z in cuts:
                s = sum(size[a : z + 1])
                if s > w:
                    return None
                t += w - s + (cost[z] if z < n - 1 else 0)
                a = z + 1
            return t

        best = min(x for m in range(1 << (n - 1)) if (x := total([i for i in range(n - 1) if m >> i & 1] + [n - 1])) is not None)
        assert total(packing.best_cuts(size, cost, w).tolist()) == best


def test_packing_keeps_every_token_in_order(make_docs, hard, prose):
    rows = [(i, prose(i, 5 + 37 * i % 300)) for i in range(60)] + [(100, "z" * 3000), (101, None), (101, prose(7, 40)), (101, prose(7, 40)), (None, prose(8, 20))]
    docs = make_docs(rows)
    w = packing.pack(docs, window=128, shard_span=25)
    got = w.collect()
    tokens = {r.doc_id: r.n_tokens for r in token_counts.token_counts(make_docs([x for x in rows if x[0] != 101 and x[0] is not None])).collect()}
    seen, order = {}, {}
    for r in sorted(got, key=lambda r: (r.shard is None, r.shard, r.window)):
        assert r.n_tokens + r.padding == 128 and r.n_tokens == sum(r.tokens) and r.padding >= 0
        for d, a, z, n in zip(r.doc_ids, r.starts, r.ends, r.tokens):
            seen[d] = seen.get(d, 0) + n
            if d not in (101, None):
                assert a == order.get(d, 0) or d == 100
                order[d] = z
        assert r.doc_ids == sorted(r.doc_ids, key=lambda d: (d is None, d))
    assert {d: n for d, n in seen.items() if d in tokens} == tokens
    texts = dict(rows)
    assert all(order[d] == len(texts[d]) for d in order)
    joined = {(r.shard, r.window): r.text for r in packing.window_texts(w, docs.where("doc_id < 60")).collect()}
    assert "".join(joined[k] for k in sorted(joined) if k[0] < 2) == "".join(t for _, t in rows[:50])
    assert packing.pack(make_docs(hard)).count() > 0 and packing.pack(make_docs([])).count() == 0


def test_preferences(spark):
    schema = "conv_id bigint, turn bigint, role string, text string, prompt string"
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "A"), (1, 2, "user", "r"), (1, 3, "assistant", "B"), (1, 4, "user", "end"), (2, 0, "user", "only"), (3, 0, None, None), (3, 1, "assistant", "x"), (4, 0, "assistant", "s"), (4, 1, "assistant", "s"), (None, 0, "assistant", "no"), (5, None, "assistant", "t")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], schema)
    got = {r.conv_id: r for r in preferences.format_preferences(preferences.stale_reply_pairs(df)).collect()}
    assert set(got) == {1, 3, 4, 5}
    one = got[1]
    assert one.n_common == 3 and one.prompt == "<|user|>\nq<|end|>\n<|assistant|>\nA<|end|>\n<|user|>\nr<|end|>\n"
    assert one.chosen == "<|assistant|>\nB<|end|>\n" and one.rejected == "<|assistant|>\nA<|end|>\n"
    a, z = map(int, one.chosen_mask.split("-"))
    assert one.chosen[a:z] == "B<|end|>\n"
    assert (got[3].prompt, got[3].rejected) == ("<|unknown|>\n<|end|>\n", "<|assistant|>\n<|end|>\n")
    assert (got[4].n_common, got[4].chosen, got[4].chosen_mask) == (2, "", "")
    assert preferences.format_preferences(preferences.stale_reply_pairs(df.limit(0))).count() == 0
    long = spark.createDataFrame([(9, [("user", "a"), ("assistant", "b"), ("user", "c"), ("assistant", "d")], [("user", "a"), ("assistant", "e")])], "conv_id bigint, chosen array<struct<role:string,text:string>>, rejected array<struct<role:string,text:string>>")
    r = preferences.format_preferences(long).first()
    assert [r.chosen[a:z] for a, z in (map(int, s.split("-")) for s in r.chosen_mask.split(","))] == ["b<|end|>\n", "d<|end|>\n"]


def test_matroska_round_trip():
    r = random.Random(3)
    for trial in range(60):
        blocks = [(1 + k % 2, 70 * k, [bytes(r.randrange(256) for _ in range(r.choice([0, 3, 3, 254, 255, 300, 700]))) for _ in range(r.randint(1, 5))]) for k in range(r.randint(1, 40))]
        b = matroska.mux(blocks, {1: (17, "S_TEXT/UTF8", None), 2: (2, "A_X", 20_000_000)}, per_cluster=7, unknown=trial % 2 == 1)
        f = matroska.File(b)
        assert f.error is None and f.tracks == {1: (17, "S_TEXT/UTF8", None), 2: (2, "A_X", 20_000_000)}
        want = [(t, time, k, x) for k, (t, time, frames) in enumerate(blocks) for x in frames]
        assert [(x[0], b[x[8] : x[9]]) for x in f.frames] == [(t, x) for t, _, _, x in want]
        assert [x[4] - x[3] * (20_000_000 if x[0] == 2 else 10_000_000 if x[2] % 7 % 2 else 0) for x in f.frames] == [time * 1_000_000 for _, time, _, _ in want]
        assert len(f.cues) == -(-len(blocks) // 7) and {(x[0], *x[10]) for x in f.frames if x[3] == 0} >= f.cues
        cut = r.randrange(len(b))
        g = matroska.File(b[:cut])
        assert [x[:10] for x in f.frames[: len(g.frames)]] == [x[:10] for x in g.frames]
    assert len({x[7] for x in f.frames} | {"none"}) >= 1


def test_matroska_files_in_a_row_and_bytes_by_hand():
    # Written out by hand: header, segment and cluster of unknown size, a track, a block with two frames of Xiph lacing.
    track = bytes.fromhex("1654ae6b 8f ae8d d78101 838111 8685535f585858")
    cluster = bytes.fromhex("1f43b675 01ffffffffffffff e7820102 a38b 81 0005 02 01 02") + b"hiyou"
    one = bytes.fromhex("1a45dfa380 18538067 01ffffffffffffff") + track + cluster
    f = matroska.File(one)
    assert f.error is None and f.tracks == {1: (17, "S_XXX", None)}
    assert [one[x[8] : x[9]] for x in f.frames] == [b"hi", b"you"] and f.frames[0][4] == (0x102 + 5) * 1_000_000
    two = matroska.File(one + one)
    assert two.error is None and [(one + one)[x[8] : x[9]] for x in two.frames] == [b"hi", b"you"] * 2


def test_matroska_never_crashes(spark):
    r = random.Random(4)
    good = matroska.mux([(1, 10 * k, [b"abc", b"de"]) for k in range(9)], {1: (17, "S", None)})
    for _ in range(800):
        b = bytearray(good)
        for _ in range(r.randint(1, 6)):
            b[r.randrange(len(b))] = r.randrange(256)
        matroska.File(bytes(b))
    files = spark.createDataFrame([(1, bytearray(good)), (2, None), (3, bytearray()), (4, bytearray(b"\x00junk")), (1, bytearray(good))], "file_id bigint, content binary")
    rows = matroska.packets(files).collect()
    assert sum(x.file_id == 1 for x in rows) == 36 and [x.track for x in rows if x.file_id == 4] == [None] and {x.file_id for x in rows} == {1, 4}


def test_subtitles_are_the_lines(make_docs, hard):
    docs = make_docs([(i, "a\nbb\n\nccc\n" * (i + 1)) for i in range(5)] + hard)
    files = {r.file_id: bytes(r.content) for r in matroska.subtitle_files(docs.where("doc_id < 3 and text like 'a%'")).collect()}
    for i, b in files.items():
        f = matroska.File(b)
        assert b"\n".join(b[x[8] : x[9]] for x in f.frames) == b"\n".join([b"a", b"bb", b"ccc"] * (i + 1))
    assert matroska.packets(matroska.subtitle_files(docs)).where("error is not null").count() == 0


def test_language_model_learns(make_docs, hard):
    r = random.Random(6)
    follow = {f"w{i}": [f"w{(7 * i + k) % 40}" for k in range(2)] for i in range(40)}
    texts = []
    for _ in range(150):
        w = ["w0"]
        while len(w) < 120:
            w.append(r.choice(follow[w[-1]]))
        texts.append(" ".join(w))
    shuffled = [" ".join(r.sample(t.split(), 120)) for t in texts[:30]]
    docs = make_docs([*texts, *[(1000 + i, t) for i, t in enumerate(shuffled)], *[(2000 + i, t) for i, (_, t) in enumerate(hard)]])
    how = {"vocabulary": 64, "classes": 8, "class_rows": 512, "word_rows": 1024, "batch": 256}
    got = {x.doc_id: x for x in maxent.score(docs, **how).collect()}
    like = lambda lo, hi: sorted(got[i].perplexity for i in range(lo, hi))[(hi - lo) // 2]
    assert like(0, 150) < 8 and like(1000, 1030) > 3 * like(0, 150)
    assert (got[2000].n_tokens, got[2000].perplexity) == (0, None)
    assert maxent.score(make_docs([]), **how).count() == 0
    assert [x.perplexity for x in maxent.score(make_docs([None, ""]), **how).collect()] == [None, None]


def test_softmaxes_are_of_all_words(make_docs):
    import numpy as np

    m = maxent.Model(np.sort(np.random.default_rng(0).integers(0, 1 << 62, 15).astype(W.U)), np.random.default_rng(1).normal(size=(32, 4)).astype(np.float32), np.random.default_rng(2).normal(size=(68, 4)).astype(np.float32), 4)
    f = np.repeat(m.features(np.array([3, 5, 1]), np.zeros(3, int))[:, 2:], 16, axis=1)
    assert abs(np.exp(m.log_probability(np.arange(16), f)).sum() - 1) < 1e-5


def test_scores_are_those_of_a_model_written_out(make_docs, monkeypatch):
    """Each token's probability from the weights that its features name, one word and one sum at a time."""
    import math

    texts = ["a b a c b a d e", "b b a", "zz a yy b", "", "a"] * 6
    docs = make_docs(texts)
    how = {"vocabulary": 8, "classes": 2, "class_rows": 64, "word_rows": 64, "batch": 32}
    m = maxent.train(docs, **how)
    monkeypatch.setattr(maxent, "train", lambda docs, **_: m)
    got = {x.doc_id: x for x in maxent.score(docs).collect()}
    words = {int(h): i for i, h in enumerate(m.words)}
    mask = (1 << 64) - 1

    def mix(x):
        x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & mask
        x = ((x ^ x >> 27) * 0x94D049BB133111EB) & mask
        return x ^ x >> 31

    def soft(z, k):
        return z[k] - max(z) - math.log(sum(math.exp(v - max(z)) for v in z))

    for i, t in enumerate(texts):
        ids = [words.get(int(c.h[k]), 7) for c in W.chunks(pa.array([t])) for k in range(len(c.h))]
        total = 0.0
        for k, w in enumerate(ids):
            one, two = (ids[k - 1] if k else 8), (ids[k - 2] if k > 1 else 8)
            f = [mix(one + (1 << 40)), mix(one + (two << 20) + (1 << 41)), mix(two + (1 << 42))]
            klass, place = divmod(w, 4)
            za = [sum(float(m.a[r][j]) for r in [0, *(1 + x % 63 for x in f)]) for j in range(2)]
            rows = [klass, *(2 + mix((x + klass * 0x9E3779B97F4A7C15) & mask) % 64 for x in f)]
            zb = [sum(float(m.b[r][j]) for r in rows) for j in range(4)]
            total += soft(za, klass) + soft(zb, place) - (math.log(max(1, m.types - len(m.words))) if w == 7 else 0)
        assert got[i].n_tokens == len(ids) and (not ids or abs(got[i].log_probability - total) < 2e-3), t


def test_words_beyond_the_vocabulary_have_their_exact_shares(make_docs, monkeypatch):
    """However many they are; a row that repeats another counts in the shares, and its own price stays that of one text."""
    import math
    from collections import Counter

    monkeypatch.setattr(maxent, "RARE_PER_TASK", 50)
    texts = ["a b a b c a b c", "q1 a q2 q2 b", "q1 a q2 q2 b", "a q3 q1", *(f"a b c r{i} r{i // 2}" for i in range(200)), "a b", "", None]
    docs = make_docs(texts)
    how = {"vocabulary": 4, "classes": 2, "class_rows": 64, "word_rows": 64, "batch": 32}
    m = maxent.train(docs, **how)
    monkeypatch.setattr(maxent, "train", lambda docs, **_: m)
    got = {x.doc_id: x for x in maxent.score(docs).collect()}
    assert len(got) == len(texts) and len(m.words) == 3
    rare = Counter(w for t in texts for w in (t or "").split() if w not in ("a", "b", "c"))
    assert m.rare == sum(rare.values()) and m.types == 3 + len(rare)
    for i, t in enumerate(texts):
        c = next(W.chunks(pa.array([t])))
        if not len(c.h):
            assert got[i].log_probability is None
            continue
        model = float(m.log_probability(m.ids(c), m.features(m.ids(c), c.rows())).sum())
        paid = sum(math.log(rare[w] / m.rare) for w in t.split() if w in rare)
        assert abs(got[i].log_probability - model - paid) < 2e-4, t
        assert abs(got[i].perplexity / math.exp(-(model + paid) / len(c.h)) - 1) < 1e-3


def test_steps_are_those_of_single_tokens():
    """A step over tokens that share contexts changes the weights as one does that sums up each token's own derivatives."""
    import numpy as np

    r = np.random.default_rng(5)
    m = maxent.Model(np.sort(r.integers(0, 1 << 62, 15).astype(W.U)), r.normal(size=(32, 4)).astype(np.float32), r.normal(size=(68, 4)).astype(np.float32), 4)
    ids = r.integers(0, 4, 300) * r.integers(1, 5, 300)
    ids = np.minimum(ids, 15)
    f = m.features(ids, np.arange(300) // 50)
    t = maxent.Trainer(m, [np.full(32, 0.1, np.float32), np.full(68, 0.1, np.float32)], 0.5)
    t.step(ids, f)
    soft = lambda z: np.exp(z - z.max()) / np.exp(z - z.max()).sum()
    for table, new, rows, hits, touched in ((m.a, t.m.a, m.class_rows(f), ids // 4, t.touched[0]), (m.b, t.m.b, m.word_rows(f, ids // 4), ids % 4, t.touched[1])):
        total, n = np.zeros(table.shape), np.zeros(len(table))
        for own, hit in zip(rows.T, hits):
            g = soft(table[own].astype(float).sum(0)) - np.eye(4)[hit]
            for row in own:
                total[row] += g
                n[row] += 1
        total /= np.sqrt(np.maximum(n, 1))[:, None]
        assert (n == touched).all()
        want = table - 0.5 * total / np.sqrt(0.1 + (total * total).sum(1) + 1e-3)[:, None]
        assert np.abs(new - want).max() < 1e-4


def test_workers_give_back_what_a_task_has_freed(spark):
    """In one Python process, whose heap ends in an object that lives on, so that only an explicit release shrinks it."""
    from simlake.llm.tables import arrow_map

    def resident():
        return int(open("/proc/self/statm").read().split()[1]) * 4096 / 1e6

    def task(batch):
        import numpy as np

        if not hasattr(np, "_kept"):
            np._kept = []
        parts = [np.ones(8_000) for _ in range(4_000)]  # 256 MB in pieces that the heap serves
        np._kept.append(parts.pop())
        most = resident()
        del parts
        return pa.RecordBatch.from_arrays([pa.array([most]), pa.array([float(len(np._kept))])], ["most", "tasks"])

    def look(batch):
        return pa.RecordBatch.from_arrays([pa.array([resident()])], ["now"])

    one = spark.range(1, numPartitions=1)
    most = arrow_map(one, task, "most double, tasks double").collect()[0].most
    # Idle processes are taken again one after another; the one that ran the task is among them.
    now = [arrow_map(one, look, "now double").collect()[0].now for _ in range(3)]
    assert most > 250 and max(now) < most - 200
