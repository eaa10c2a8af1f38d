import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from simlake.functions import cfg, edit, fingerprints, signature, text
from simlake.params import PRIME, SearchParams, banding

ASM = SearchParams()
CODES = [
    "push ebp\nmov ebp, esp ; frame\nsub esp, 10H",
    "?_0001: test eax, eax\njz ?_0002\ncpuid\n?_0002: ret",
    "mov eax, dword [esp+24H]\nlea $t0, 4(#16)\n%define X 1\ndb 'Hi', 0CH",
    "",
    "; only",
    "nop",
]


def rows(spark, codes):
    return spark.createDataFrame([(i, c) for i, c in enumerate(codes)], "i int, code string")


def test_assembly_tokens_by_columns_and_lists(spark):
    got = {r.i: r.t for r in rows(spark, CODES).select("i", text.asm_tokens(F.col("code")).alias("t")).collect()}
    assert got == {i: fingerprints.asm_token_list(c) for i, c in enumerate(CODES)}
    assert got[0] == ["PUSH", "REG", "MOV", "REG", "REG", "SUB", "REG", "IMM"]
    assert got[1] == ["LABEL", "TEST", "REG", "REG", "JZ", "?_0002", "CPUID", "LABEL", "RET"]
    assert got[2][:6] == ["MOV", "REG", "MEM_SIZE", "REG", "+", "IMM"] and "DEFINE" not in " ".join(got[2])
    plain = rows(spark, ["mov EAX, 1"]).select(text.asm_tokens(F.col("code"), False).alias("t")).first().t
    assert plain == ["MOV", "EAX", "1"]


@pytest.mark.parametrize("p", [ASM, SearchParams(tokenizer="word"), SearchParams(ngram=5, num_perm=32)])
def test_signatures_by_columns_and_in_one_pass(spark, p):
    df = rows(spark, [*CODES, "a b c d e f a b c d", None])
    hashes = text.element_hashes(text.elements(text.shingles(text.tokens(F.col("code"), p.tokenizer), p.ngram), p.tokenizer == "asm"))
    by_columns = {r.i: r.s for r in df.where("code is not null").select("i", signature.minhash_columns(hashes, p.num_perm, p.seed).alias("s")).collect()}
    one_pass = {r.i: r.s for r in df.select("i", fingerprints.signature_udf(p)("code").alias("s")).collect()}
    assert one_pass.pop(len(CODES) + 1) is None
    assert by_columns == one_pass
    assert set(one_pass[3]) == {PRIME}


def test_shingles_and_weights(spark):
    w = lambda s: fingerprints.weight(s)
    assert (w("CPUID REG"), w("MOV REG REG"), w("REG + IMM"), w("")) == (3, 1, 2, 1)
    df = spark.createDataFrame([("CPUID REG",), ("MOV REG REG",), ("REG + IMM",), ("",)], "s string")
    assert [r[0] for r in df.select(text.shingle_weight(F.col("s"))).collect()] == [3, 1, 2, 1]
    assert fingerprints.shingle_list(["a", "b"], 3) == ["a b"]
    assert fingerprints.shingle_list([], 3) == []
    assert fingerprints.shingle_list(list("ababa"), 3) == ["a b a", "b a b"]


def test_estimate_follows_jaccard():
    r = random.Random(1)
    p = SearchParams(tokenizer="word", num_perm=512)
    a = [f"w{r.randrange(10**6)}" for _ in range(300)]
    b = a[:200] + [f"v{r.randrange(10**6)}" for _ in range(100)]
    x, y = (set(fingerprints.element_list(" ".join(t), p)) for t in (a, b))
    s, t = fingerprints.signatures([" ".join(a), " ".join(b)], p)
    assert abs((s == t).mean() - len(x & y) / len(x | y)) < 0.08


def test_comments_and_case_leave_the_fingerprint():
    s, t = fingerprints.signatures(["MOV EAX, [ESP+4] ; x", "mov   eax, [esp+4]"], ASM)
    assert (s == t).all()


def test_canonical_text(spark):
    df = spark.createDataFrame([("mov  eax, 1 ; c\n\n",), ("; c",), ("mov eax, 1",)], "c string")
    got = [r[0] for r in df.select(text.canonical_text(F.col("c"))).collect()]
    assert got == ["mov eax, 1", None, "mov eax, 1"]


@pytest.mark.parametrize("t, n, want", [(0.5, 128, (25, 5)), (0.2, 128, (28, 2)), (0.3, 128, (37, 3)), (0.7, 128, (14, 9)), (0.8, 128, (9, 13)), (0.9, 128, (5, 25)), (0.0, 128, (128, 1))])
def test_banding(t, n, want):
    assert banding(t, n) == want


def test_parameters_are_checked():
    assert banding(0.5, 64)[0] == 14
    for bad in ({"num_perm": 1}, {"threshold": 1.1}, {"tokenizer": "x"}, {"ngram": 0}, {"jaccard_weight": 2}):
        with pytest.raises(ValueError):
            SearchParams(**bad)
    with pytest.raises(ValueError):
        SearchParams(threshold=0.995).bands


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), min_size=2, max_size=50))
def test_codec(values):
    raw = signature.pack_signature(values)
    assert len(raw) == signature.packed_size(len(values)) and signature.unpack_signature(raw) == values
    for bad in (raw[:-1], b"", b"xxxx" + raw[4:], raw + b"0"):
        with pytest.raises(ValueError):
            signature.unpack_signature(bad)


@settings(max_examples=100, deadline=None)
@given(st.text("abc", max_size=12), st.text("abc", max_size=12))
def test_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    assert edit.lcs(a, b) == row[-1]


def test_edit_ratio(spark):
    pairs = [("kitten", "sitting"), ("", ""), ("a", ""), ("same", "same"), ("abc", "xyz")]
    df = spark.createDataFrame(pairs, "x string, y string")
    got = df.select(edit.edit_ratio("x", "y").alias("a"), edit.edit_ratio_columns(F.col("x"), F.col("y")).alias("b")).collect()
    assert [round(r.a, 3) for r in got] == [61.538, 100.0, 0.0, 100.0, 0.0]
    assert [round(r.b, 3) for r in got] == [61.538, 100.0, 0.0, 100.0, 0.0]
    assert edit.ratio(None, "a") is None


def test_hybrid(spark):
    for j, e, w, want in ((0.9, 20.0, 0.4, 48), (0.6, 80.0, 0.5, 70), (0.8, 50.0, 1.0, 80), (0.8, 50.0, 0.0, 50)):
        got = spark.range(1).select(edit.hybrid(F.lit(j), F.lit(e), w)).first()[0]
        assert math.isclose(got, want)


def test_flow_graphs():
    assert cfg.flow_graph("")[:3] == (0, 0, [])
    assert cfg.flow_graph("mov eax, 1\nadd eax, 2\nret")[:3] == (1, 0, [3])
    assert cfg.flow_graph("mov eax, [fs:0]\nret")[:3] == (1, 0, [2])
    n, edges, sizes, adj = cfg.flow_graph("cmp eax, 1\njz done\nmov eax, 2\ndone:\nret")
    assert (n, edges, sizes, adj) == (3, 3, [2, 1, 1], {0: [1, 2], 1: [2], 2: []})
    assert cfg.flow_graph("a: jz a\nret")[0] == 1
    assert cfg.flow_graph("a: jz a\nret", strict=True)[0] == 2
    assert cfg.flow_graph("x: jmp x")[3] == {0: [0]}


def test_flow_similarity(spark):
    def like(a, b):
        df = spark.createDataFrame([(a, b)], "a string, b string").select(cfg.cfg_extract("a").alias("g"), cfg.cfg_extract("b").alias("h"))
        return df.select(cfg.cfg_similarity(F.col("g"), F.col("h"))).first()[0]

    assert like("", "") == 1.0 and like("", "nop") == 0.0
    assert like("nop\nnop", "nop\nnop") == 1.0
    a = "x\njmp b\nb:\nnop\nnop\nret"  # sizes 2, 3 and one edge
    assert 0 < like(a, "nop") < 1
