import numpy as np
import pytest

from quarry.llm import vectors as V


def brute(ids, x, k, floor):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(u @ u.T, 9)
    out = {}
    for i in range(len(ids)):
        o = [j for j in np.lexsort((ids, -s[i])) if j != i and s[i, j] >= floor][:k]
        out[ids[i]] = [int(ids[j]) for j in o]
    return out


def table(spark, ids, rows):
    return spark.createDataFrame([(int(i), None if r is None else [float(v) for v in r], "x") for i, r in zip(ids, rows, strict=True)], "vec_id long, embeddings array<float>, v string")


def test_copies_ties_and_unusable_rows(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((40, 8)).astype(np.float32)
    x[10:25] = x[10]  # copies, more than the list is long
    x[30] = 2 * x[31]
    rows = [*x, None, [1.0] * 7, [0.0] * 8, [float("nan")] + [1.0] * 7, [float("inf")] + [1.0] * 7, []]
    got = {r["vec_id"]: [n["id"] for n in r["near"]] for r in V.neighbour_lists(table(spark, range(100, 146), rows), dim=8, k=5, floor=0.5).collect()}
    assert got == brute(np.arange(100, 140), x.astype(np.float64), 5, 0.5)
    pairs = V.neighbour_pairs(V.neighbour_lists(table(spark, range(100, 146), rows), dim=8, k=5, floor=0.5)).collect()
    assert {tuple(p) for p in pairs} == {(min(a, b), max(a, b)) for a, l in got.items() for b in l}
    assert V.neighbour_lists(table(spark, [], []), dim=8).count() == 0


@pytest.mark.parametrize("cell", [64, 256])
def test_recall_of_descended_trees(spark, cell):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((30, 32))
    x = (centres[rng.integers(0, 30, 1500)] + 0.35 * rng.standard_normal((1500, 32))).astype(np.float32)
    x[:500] = (centres[0] + 0.35 * rng.standard_normal((500, 32))).astype(np.float32)  # a third of all rows in one place
    ids = np.arange(1500)
    want = brute(ids, x.astype(np.float64), 10, 0.8)
    got = {r["vec_id"]: [n["id"] for n in r["near"]] for r in V.neighbour_lists(table(spark, ids, x), dim=32, cell=cell, leaf=64).collect()}
    hit = sum(len(set(want[i]) & set(got[i])) for i in want)
    assert set(got) == set(ids) and hit >= 0.9 * sum(map(len, want.values()))
    assert all(set(got[i]) <= set(ids) - {i} for i in got)


def test_oversized_subtrees_are_compared_in_blocks(spark):
    base = np.random.default_rng(2).standard_normal(16)
    x = np.stack([(1 + i / 300) * base for i in range(300)]).astype(np.float32)  # one direction, no copies: no prefix splits them
    got = {r["vec_id"]: [n["id"] for n in r["near"]] for r in V.neighbour_lists(table(spark, range(300), x), dim=16, cell=50, trees=1).collect()}
    want = brute(np.arange(300), x.astype(np.float64), 10, 0.8)
    assert got == want


def test_more_rows_need_more_trees():
    assert V.trees_for(5000, 8192, 0.9) == 1 and V.trees_for(60_000, 8192, 0.9) < V.trees_for(600_000, 8192, 0.9) and V.trees_for(60_000, 8192, 0.9) < V.trees_for(60_000, 8192, 0.8)
    assert V.agreement(np.zeros((0, 4), np.float32), *V.spread_planes(np.zeros((0, 4), np.float32), 8, np.random.default_rng(0)), 0.8) == pytest.approx(0.795, abs=0.001)


def test_subtrees_are_the_largest_that_fit():
    rng = np.random.default_rng(5)
    codes = np.concatenate([rng.integers(0, 1 << 10, 300), np.full(40, 77)])
    parts = V.subtrees(codes, 10, 16)
    assert sorted(np.concatenate([g for g, _ in parts])) == list(range(340))
    under = lambda code, depth: set(np.flatnonzero(codes >> (10 - depth) == code >> (10 - depth)))
    for g, c in parts:
        depth = next(d for d in range(11) if under(codes[g][0], d) == set(g))
        assert len(g) <= 16 or len(set(codes[g])) == 1
        # one step up would not fit any more
        assert depth == 0 or len(under(codes[g][0], depth - 1)) > 16
        # few members look further, to the strings beside them
        beside = sorted(codes[list(set(c) - set(g))], key=lambda x: abs(int(x) - int(codes[g][0])))
        assert set(g) <= set(c) and (len(g) >= 4 or len(beside) >= 4 - len(g)) and len(c) <= max(len(g), 8)


def test_the_forest_inside_a_cell_compares_few_pairs(monkeypatch):
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((60, 32))
    x = centres[rng.integers(0, 60, 4000)] + 0.35 * rng.standard_normal((4000, 32))
    pdf = V.pd.DataFrame({"rep": np.arange(4000), "v": list(x), "block": 0, "bi": 0, "bj": 0})
    done = []
    real = V._near
    monkeypatch.setattr(V, "_near", lambda q, c, *a: done.append(len(q) * len(c)) or real(q, c, *a))
    got = {r.rep: [n["id"] for n in r.near] for r in V._cell_search(10, 0.8, 256, 4, 1)(pdf).itertuples()}
    want = brute(np.arange(4000), x, 10, 0.8)
    assert sum(len(set(got.get(i, [])) & set(w)) for i, w in want.items()) >= 0.95 * sum(map(len, want.values()))
    assert sum(done) < 0.3 * 4000**2
