import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import packing as P
from quarry.llm.tokens import VOCABULARY, encoder


@pytest.mark.parametrize("seed", range(5))
def test_bins_hold_everything_once(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(0, 101, 400)
    at = P.sum_of_squares(sizes, 100)
    fill = np.bincount(at, weights=sizes)
    assert fill.max() <= 100 and fill.sum() == sizes.sum() and len(fill) <= 1.15 * -(-sizes.sum() // 100)


def test_placement_is_where_the_squares_become_smallest():
    sizes, cap = np.array([6, 6, 3, 3, 2, 2, 1]), 10
    at, gaps = P.sum_of_squares(sizes, cap), {}
    for i in np.argsort(-sizes, kind="stable"):
        def cost(b, i=i):
            g = {**gaps, b: gaps.get(b, cap) - sizes[i]}
            return sum(n * n for v, n in zip(*np.unique([v for v in g.values()], return_counts=True), strict=True) if v > 0)

        open_ = [b for b, g in gaps.items() if g >= sizes[i]]
        assert cost(at[i]) == min(cost(b) for b in [*open_, max(gaps, default=-1) + 1])
        gaps[at[i]] = gaps.get(at[i], cap) - sizes[i]


@pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary here")
def test_documents_whole_or_split(spark):
    enc = encoder()
    texts = ["word " * n for n in (1, 5, 30, 64, 65, 200)] + [None, "", "same", "same"]
    docs = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, piece int")
    budgets = spark.createDataFrame([(1, 64), (2, 16), (3, None), (4, 0), (1, 64)], "budget_id int, capacity_tokens int")
    out = P.pack_documents(docs, budgets, shard_tokens=60).collect()
    n = [len(enc.encode_ordinary(t)) if t else 0 for t in texts]
    for b, cap in ((1, 64), (2, 16)):
        rows = [r for r in out if r["budget_id"] == b]
        fill = {}
        for r in rows:
            fill[r["container_id"]] = fill.get(r["container_id"], 0) + r["n_tokens"]
        assert max(fill.values()) <= cap and sum(fill.values()) == sum(n)
        for i, size in enumerate(n):
            mine = sorted((r["first_token"], r["n_tokens"]) for r in rows if r["doc_id"] == i)
            assert len(mine) == max(1, -(-size // cap)) and sum(t for _, t in mine) == size
            assert all(a + t == c for (a, t), (c, _) in zip(mine, mine[1:], strict=False)) and mine[0][0] == 0
    assert {r["budget_id"] for r in out} == {1, 2}
    report = {r["budget_id"]: r for r in P.packing_report(P.pack_documents(docs, budgets), budgets.distinct()).collect()}
    assert report[1]["tokens"] == sum(n) and report[1]["containers"] >= report[1]["least_containers"]
    assert P.pack_documents(docs.limit(0), budgets).count() == 0 and P.pack_documents(docs, budgets.where(F.lit(False))).count() == 0


def test_many_empty_texts_are_spread(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "" if i % 50 else "one two three") for i in range(1000)], "doc_id long, text string")
    budgets = spark.createDataFrame([(1, 8)], "budget_id int, capacity_tokens int")
    packed = P.pack_documents(docs, budgets, shard_items=100).collect()
    assert sorted(r["doc_id"] for r in packed) == list(range(1000))
    per = {}
    for r in packed:
        per[r["container_id"]] = per.get(r["container_id"], 0) + r["n_tokens"]
    assert max(per.values()) <= 8 and len({r["container_id"].split("c")[0] for r in packed}) > 1
