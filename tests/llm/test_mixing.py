import itertools
import os
import random

import numpy as np
import pytest

from quarry.llm import mixing as M
from quarry.llm.tokens import VOCABULARY


@pytest.mark.parametrize("seed", range(20))
def test_bounded_subset_equals_brute_force(seed):
    rnd = random.Random(seed)
    lengths = np.array(rnd.sample(range(1, 30), 5))
    counts = np.array([rnd.randint(0, 3) for _ in lengths])
    budget = rnd.randint(0, 120)
    best = max(t for t in (sum(k * int(x) for k, x in zip(ks, lengths, strict=True)) for ks in itertools.product(*[range(c + 1) for c in counts])) if t <= budget)
    take = M.bounded_subset(lengths, counts, budget)
    assert (take <= counts).all() and (take >= 0).all() and int((take * lengths).sum()) == best


def test_fit_hits_reachable_targets_and_caps():
    lengths, counts = np.arange(0, 60), np.full(60, 20)
    total = int((lengths * counts).sum())
    for target in (0, 1, 777, total // 3, total - 1, 2 * total + 5):
        base, extra = M.fit_lengths(lengths, counts, target, 3, window=5000)
        assert base * total + int((extra * lengths).sum()) == target and (extra <= counts).all()
    assert M.fit_lengths(lengths, counts, 10 * total, 3)[0] == 3
    assert M.fit_lengths(lengths, counts, 50, 0)[0] == 0 and M.fit_lengths(np.array([0]), np.array([9]), 50, 2)[0] == 0


@pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary here")
def test_mix(spark):
    docs = [(i, ["A ", "b", None, " "][i % 4], "word " * (1 + i % 17), 5) for i in range(200)] + [(900, "a", None, 5), (901, "b", "", 5)]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string, n long")
    targets = spark.createDataFrame(
        [(1, "a", 3.0, 2, 0.4), (1, "B", 1.0, 1, 0.4), (1, "none such", 0.0, 1, 0.4), (2, "b", 1.0, 2, 9.0), (2, None, 1.0, 1, 9.0), (3, "a", None, 1, 1.0)],
        "mix_id int, source string, target_weight double, max_repeats int, total_ratio double",
    )
    selection, report = M.mix_documents(df, targets)
    sel = selection.collect()
    assert len({(r["mix_id"], r["doc_id"]) for r in sel}) == len(sel)
    assert all(1 <= r["repeats"] <= {1: {"a": 2, "b": 1}, 2: {"b": 2}}[r["mix_id"]][r["source"]] for r in sel)
    rep = {(r["mix_id"], r["source"]): r for r in report.collect()}
    a, b = rep[1, "a"], rep[1, "b"]
    assert a["actual_tokens"] == a["target_tokens"] and b["actual_tokens"] == b["target_tokens"] and abs(a["actual_share"] - 0.75) < 0.01
    assert rep[1, "none such"]["actual_tokens"] == 0 and rep[3, "a"]["actual_tokens"] == 0
    assert rep[2, "b"]["actual_tokens"] < rep[2, "b"]["target_tokens"] and rep[2, "b"]["most_repeats"] == 2
    again = M.mix_documents(df, targets)[0].collect()
    assert sorted(map(tuple, sel)) == sorted(map(tuple, again))
    assert M.mix_documents(df.limit(0), targets)[0].count() == 0
