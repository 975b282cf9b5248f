import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from codeloom.llm import packing as P


@given(st.lists(st.integers(1, 100), max_size=120))
@settings(max_examples=60, deadline=None)
def test_local_search_keeps_items_and_capacity(sizes):
    s = np.array(sizes, np.int64)
    start = P.best_fit(s, 100)
    n = len(start)
    bins = P.improve(s, start, 100)
    assert sorted(i for b in bins for i in b) == list(range(len(s)))
    assert all(s[b].sum() <= 100 for b in bins) and len(bins) <= n


@given(st.lists(st.integers(1, 40), max_size=24))
@settings(max_examples=80, deadline=None)
def test_no_step_is_left(sizes):
    s = np.array(sizes, np.int64)
    bins = P.improve(s, [[i] for i in range(len(s))], 40)
    fill = [int(s[b].sum()) for b in bins]
    for a, src in enumerate(bins):
        for c, dst in enumerate(bins):
            if a != c and fill[a] < 40 and fill[a] <= fill[c] < 40:
                outs = [(i,) for i in src] + [(i, j) for i in src for j in src if i < j]
                for out in outs:
                    for back in [0, *s[dst]]:
                        gain = int(s[list(out)].sum() - back)
                        assert gain <= 0 or fill[c] + gain > 40, (src, dst, out, back)


def test_containers_of_many_small_items():
    # More than 20 000 pairs of items between two containers; only an exchange of two for one fills the fuller one.
    s = np.array([3] * 200 + [8] + [4] * 160, np.int64)
    bins = P.improve(s, [list(range(200)), list(range(200, 361))], 650)
    assert sorted(int(s[b].sum()) for b in bins) == [int(s.sum()) - 650, 650]


def test_swaps_empty_a_container():
    # Neither container can take an item of the other's whole; exchanges are needed to fill one and empty none too many.
    s = np.array([60, 30, 50, 40, 20], np.int64)
    bins = P.improve(s, [[0, 1], [2, 3], [4]], 100)
    assert len(bins) == 2 and sorted(int(s[b].sum()) for b in bins) == [100, 100]


def test_pack_items_over_shards(spark):
    r = np.random.default_rng(1)
    items = spark.createDataFrame([(i, 0, int(r.integers(1, 900))) for i in range(600)], "doc_id bigint, part int, size bigint")
    got = P.pack_items(items, 2048, shard_items=100).collect()
    assert len({(x.doc_id, x.part) for x in got}) == len(got) == 600
    fill = {}
    for x in got:
        fill[x.container] = fill.get(x.container, 0) + x.size
    bound = -(-sum(fill.values()) // 2048)
    assert max(fill.values()) <= 2048 and len(fill) <= bound + 3


def test_documents(spark):
    pytest.importorskip("tiktoken")
    docs = [(1, "word " * 3000, "x"), (2, "", "x"), (3, None, "x"), (4, "short text", "x"), (None, "no id", "x"), (5, "ä<|endoftext|>", "x")]
    got = P.pack(spark.createDataFrame(docs, "doc_id bigint, text string, container string"), 1000).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    enc = P.encoder(P.VOCABULARY)
    assert set(by) == {1, 2, 3, 4, 5}
    assert sum(r.tokens for r in by[1]) == len(enc.encode_ordinary(docs[0][1])) and [r.tokens for r in sorted(by[1], key=lambda r: r.part)][:2] == [1000, 1000]
    assert by[2][0].container is None and by[3][0].tokens == 0 and len(by[4]) == len(by[5]) == 1
    fill = {}
    for r in got:
        if r.container:
            fill[r.container] = fill.get(r.container, 0) + r.tokens
    assert all(r.unused == 1000 - fill[r.container] for r in got if r.container)


def test_empty(spark):
    assert P.pack(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
