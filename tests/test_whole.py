"""Queries do their whole job."""

from simlake.operators import search, store
from simlake.plans import queries as Q
from test_scale import parts  # noqa: F401


def test_compare_scores_compares_the_whole_store(spark, parts):  # noqa: F811
    s = store.add_batch(store.empty(spark), Q.listings(spark, parts), Q.ASM)
    got = {(r.left, r.right) for r in Q.QUERIES["compare_scores"](spark, parts).collect()}
    assert got == {(r.left, r.right) for r in search.similar_pairs(s, Q.ASM, 0.0).collect()}
