import random

import numpy as np
import pytest

from quarry.operators import evaluation


def documents(seed, n, vocabulary):
    rnd = random.Random(seed)
    rows = [(rnd.choice("fg"), f"d{i:04}", [f"w{min(rnd.randrange(vocabulary), rnd.randrange(vocabulary))}" for _ in range(rnd.randint(1, 12))]) for i in range(n)]
    return rows + [("f", "none", []), (None, "no field", ["w1"]), ("g", "wide", [f"w{i}" for i in range(60)]), ("g", "wider", [f"w{i}" for i in range(70)])]


def overlaps(rows, threshold):
    sets = [(f, i, set(t)) for f, i, t in rows if f and t]
    return {(a, b): round(len(s & t) / len(s | t), 6) for f, a, s in sets for g, b, t in sets if f == g and a < b and len(s & t) / len(s | t) >= threshold}


@pytest.mark.parametrize("few,block,wide,whole,terms", [(32, 16_384, 512, 0.05, 50_000), (2, 50, 8, 0.05, 50_000), (2, 50, 512, 99, 50_000), (2, 50, 8, 99, 1), (10_000, 50, 8, 0.05, 1)])
def test_title_overlap_is_exact(spark, monkeypatch, few, block, wide, whole, terms):
    for name, value in (("FEW", few), ("BLOCK", block), ("WIDE", wide), ("WHOLE", whole), ("TERMS", terms)):
        monkeypatch.setattr(evaluation, name, value)
    rows = documents(1, 500, 40)
    for threshold in (0.38, 0.55):
        got = evaluation.title_overlap(spark.createDataFrame(rows, "f string, id string, t array<string>"), "f", "id", "t", threshold).collect()
        assert len(got) == len({(r["a"], r["b"]) for r in got}) and {(r["a"], r["b"]): r["jaccard"] for r in got} == overlaps(rows, threshold)


def test_only_pairs_of_the_threshold_leave_a_block():
    """Candidates are compared where they meet; none is written to be made distinct or joined to its texts."""
    terms = np.array([np.array([1, i, i + 1]) for i in range(2, 302)], dtype=object)
    ids, every = np.array([f"d{i:03}" for i in range(300)], dtype=object), np.ones(300, dtype=bool)
    got = evaluation.block_overlap(ids, terms, every, every, 1, 0.5)
    assert list(zip(got["a"], got["b"], strict=True)) == [(f"d{i:03}", f"d{i + 1:03}") for i in range(299)] and set(got["shared"]) == {2} and set(got["either"]) == {4}
    assert evaluation.block_overlap(ids, terms, every, every, 2, 0.5).empty
