import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from simlake.llm import npwords as W


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="abZ09 .,\néÉß—中文あ\U0001f600_-", max_size=30)), max_size=12))
def test_words_are_those_of_a_pattern(rows):
    pattern = re.compile(r"[ぁ-ヿ䀀-鿿]|[0-9a-zÀ-῿]+")
    want = [pattern.findall((t or "").lower()) for t in rows]
    got = [[] for _ in rows]
    seen = {}
    for c in W.chunks(pa.array(rows, pa.string()), target=16):
        for r in range(c.hi - c.lo):
            for k in range(c.word_at[r], c.word_at[r + 1]):
                w = c.data[c.s[k] : c.e[k]].tobytes().decode()
                got[c.lo + r].append(w)
                assert seen.setdefault(w, c.h[k]) == c.h[k]
    assert got == want
    assert len(set(seen.values())) == len(seen)


def test_table_agrees_with_a_dict():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 1 << 63, 5000).astype(np.uint64))
    t = W.Table(keys, np.arange(len(keys)))
    assert (t.get(keys) == np.arange(len(keys))).all()
    assert (t.get(rng.integers(0, 1 << 63, 1000).astype(np.uint64) | np.uint64(1 << 63)) == -1).all()
    assert W.Table(np.zeros(0, np.uint64), np.zeros(0)).get(keys[:3]).tolist() == [-1] * 3


def test_segment_sums_of_empty_segments():
    assert W.seg_sum(np.array([1, 2, 3]), np.array([0, 0, 2, 2, 3, 3])).tolist() == [0, 3, 0, 3, 0]
