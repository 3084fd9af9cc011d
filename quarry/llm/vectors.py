"""Most similar vectors for every vector: a forest of hash-prefix trees.

Each tree gives every vector a long string of sign bits (random hyperplanes
drawn along the spread of a bounded sample). In the tree's sorted order, a prefix is a
subtree. The forest has two storeys. Above, a vector descends along its string and ascends again to the largest subtree, of
variable prefix length, that one task can hold; only there do vectors travel, once a tree. Inside, every subtree is
a forest of its own, with planes along its own spread: sorted arrays of strings, in all of them the longest match is
looked up and ascended from by one rule, up to the largest subtree of at most ``leaf`` strings; their union is the
candidate set. Candidates are compared by exact cosines in double precision.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quarry.operators.skew import split_join
from quarry.session import checkpoint

#: Length of a hash string in bits.
BITS = 40
#: Most vectors of the sample on which the hyperplanes are fitted.
SAMPLE_ROWS = 4096
#: Most strings of a subtree that a task holds; larger ones are descended further.
CELL = 16384
#: Most strings of a subtree whose members are compared, and trees inside a cell.
LEAF, INNER_TREES = 384, 7
#: Chance at which a near pair of the sample may share no cell.
MISS = 0.01
#: Rows of a side that may be broadcast (8 to 40 bytes each); beyond it an ordinary join does the same.
SMALL = 200_000


def usable_vectors(vectors: DataFrame, vec_id: str, vec: str, dim: int) -> DataFrame:
    """``vec_id, v`` of rows with exactly ``dim`` finite numbers, not all zero."""
    inf = float("inf")
    v = F.col(vec)
    ok = (
        (F.size(v) == dim)
        & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (x < inf) & (x > -inf))
        & F.exists(v, lambda x: x != 0)
    )
    return vectors.where(F.col(vec_id).isNotNull() & v.isNotNull() & ok).select(F.col(vec_id).cast("long").alias("vec_id"), v.cast("array<float>").alias("v"))


def agreement(sample: np.ndarray, planes: np.ndarray, cut: np.ndarray, floor: float) -> float:
    """Share of bits that pairs of the sample at or above ``floor`` have in common; that of random planes if there are few such pairs."""
    bits = (sample @ planes > cut).astype(np.float32)
    same = total = 0.0
    for at in range(0, len(sample), 512):
        near = (sample[at : at + 512] @ sample.T) >= floor
        near[np.arange(len(near)), np.arange(at, at + len(near))] = False
        q = bits[at : at + 512]
        both = (q @ bits.T + (1 - q) @ (1 - bits).T) / bits.shape[1]
        same += float(both[near].sum())
        total += float(near.sum())
    return same / total if total >= 100 else 1 - math.acos(max(-1.0, min(1.0, floor))) / math.pi


def trees_for(n: int, cell: int, agree: float, miss: float = MISS) -> int:
    """Trees needed so that a pair whose bits agree with chance ``agree`` misses all common cells with chance ``miss`` at most."""
    depth = max(0.0, math.log2(max(n, 1) / cell))
    share = agree**depth
    return 1 if share >= 1 else max(1, math.ceil(math.log(miss) / math.log(1 - share)))


def spread_planes(x: np.ndarray, n: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """``n`` hyperplanes drawn along the principal directions of ``x`` in proportion to its spread there, each cut at its median."""
    e, v = np.linalg.eigh(np.cov(x.T.astype(np.float64))) if len(x) > 1 else (np.ones(x.shape[1]), np.eye(x.shape[1]))
    scale = np.sqrt(np.maximum(e, 0))
    # the lesser half of the directions is mostly noise
    scale[: len(scale) // 2] = 0
    if not scale.any():
        scale[:] = 1
    w = (v @ (scale[:, None] * rng.standard_normal((len(scale), n)))).astype(np.float32)
    w /= np.maximum(np.linalg.norm(w, axis=0), 1e-30)
    return w, np.median(x.astype(np.float32) @ w, axis=0).astype(np.float32) if len(x) else np.zeros(n, np.float32)


def _unit(v: pd.Series, kind: type = np.float32) -> np.ndarray:
    x = np.stack(v.to_numpy()).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # keeps squares in range
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(kind)


def _strings(x: np.ndarray, w: np.ndarray, cut: np.ndarray, trees: int) -> np.ndarray:
    """Hash strings as numbers, one column per tree. What lies on a cut up to rounding gets one bit."""
    bits = (x @ w - cut) > 1e-5
    each = bits.shape[1] // trees
    return bits.reshape(len(x), trees, each) @ (1 << np.arange(each - 1, -1, -1)).astype(np.int64)


def _hasher(planes: np.ndarray, cut: np.ndarray, trees: int):
    @F.pandas_udf("array<bigint>")
    def strings(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for v in batches:
            yield pd.Series(list(_strings(_unit(v), planes, cut, trees)) if len(v) else [], dtype=object)

    return strings


def subtrees(codes: np.ndarray, bits: int, leaf: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Members of the largest prefix subtrees with at most ``leaf`` strings, and their candidates; equal strings stay together however many.

    Candidates are the members themselves. Where they are few, the ascent goes on in the sorted array: the strings beside
    the subtree, which share the longest prefixes with it, up to a quarter of ``leaf`` on each side.
    """
    order = np.argsort(codes, kind="stable")
    codes = codes[order]
    out = []
    stack = [(0, len(codes), bits)]
    while stack:
        lo, hi, left = stack.pop()
        if hi - lo <= leaf or left == 0 or codes[lo] == codes[hi - 1]:
            if hi > lo:
                more = max(0, leaf // 4 - (hi - lo))
                out.append((order[lo:hi], order[max(0, lo - more) : hi + more]))
            continue
        # first string with the next bit set
        bit = np.int64(1) << np.int64(left - 1)
        mid = lo + int(np.searchsorted(codes[lo:hi], (codes[lo] >> np.int64(left) << np.int64(left)) | bit))
        stack += [(lo, mid, left - 1), (mid, hi, left - 1)]
    return out


def _near(q: np.ndarray, c: np.ndarray, x: np.ndarray, k: int, low: np.float32) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of ``q`` and ``c`` (places in ``x``) at or above ``low`` that may be among the ``k`` best of a row, in single precision."""
    qs, cs = [], []
    for at in range(0, len(q), 1024):
        rows = q[at : at + 1024]
        s = x[rows] @ x[c].T
        s[rows[:, None] == c[None, :]] = -2
        edge = np.full(len(rows), low, dtype=np.float32)
        if len(c) > k:
            # all within the rounding of single precision of the k-th stay
            edge = np.maximum(edge, np.partition(s, len(c) - k, axis=1)[:, len(c) - k] - np.float32(2e-6))
        i, j = np.nonzero(s >= edge[:, None])
        qs.append(rows[i])
        cs.append(c[j])
    return np.concatenate(qs), np.concatenate(cs)


def _cell_search(k: int, floor: float, leaf: int, inner: int, seed: int):
    """Top-k of every vector of a cell by the forest inside it, or of block ``bi`` against block ``bj`` and back."""
    low = np.float32(floor - 1e-5)

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        exact, ids = _unit(pdf["v"], np.float64), pdf["rep"].to_numpy()
        x = exact.astype(np.float32)
        block, bi, bj = pdf["block"].to_numpy(), pdf["bi"].iat[0], pdf["bj"].iat[0]
        n = len(ids)
        if bi != bj:
            a, b = np.flatnonzero(block == bi), np.flatnonzero(block == bj)
            found = [_near(a, b, x, k, low), _near(b, a, x, k, low)]
        elif n <= leaf:
            found = [_near(np.arange(n), np.arange(n), x, k, low)]
        else:
            rng = np.random.default_rng(seed)
            w, cut = spread_planes(x[rng.permutation(n)[:SAMPLE_ROWS]], inner * BITS, rng)
            codes = _strings(x, w, cut, inner)
            found = [_near(g, c, x, k, low) for t in range(inner) for g, c in subtrees(codes[:, t], BITS, leaf)]
        pairs = np.unique(np.concatenate([i.astype(np.int64) * n + j for i, j in found]))
        i, j = pairs // n, pairs % n
        cos = np.concatenate([np.einsum("ij,ij->i", exact[i[at : at + 65536]], exact[j[at : at + 65536]]) for at in range(0, len(i), 65536)] or [np.zeros(0)])
        cos = np.round(cos, 9)
        keep = cos >= floor
        i, j, cos = i[keep], j[keep], cos[keep]
        order = np.lexsort((ids[j], -cos, i))
        i, j, cos = i[order], j[order], cos[order]
        who, first = np.unique(i, return_index=True)
        ends = np.append(first[1:], len(i))
        near = [[{"c": -c, "id": m} for c, m in zip(cos[f : min(e, f + k)].tolist(), ids[j[f : min(e, f + k)]].tolist())] for f, e in zip(first.tolist(), ends.tolist())]
        return pd.DataFrame({"rep": ids[who], "near": pd.Series(near, dtype=object)})

    return search


def _joined(facts: DataFrame, dim: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """Inner join to ``dim``, sent to every task if a count shows it is small, else split by the weight of its keys."""
    if dim.count() <= SMALL:
        return facts.join(F.broadcast(dim.drop(weight)), keys)
    return split_join(facts, dim, keys, weight)


def neighbour_lists(
    vectors: DataFrame, vec_id: str = "vec_id", vec: str = "embeddings", dim: int = 128, k: int = 10, floor: float = 0.8,
    cell: int = CELL, trees: int | None = None, seed: int = 17, leaf: int = LEAF, inner: int = INNER_TREES,
) -> DataFrame:
    """For every usable vector its ``k`` most similar others: ``vec_id, near array<struct<c, id>>``.

    ``c`` is minus the cosine rounded to nine decimals, the list is in order of
    (c, id), so ties go to the smaller id; those below ``floor`` are left out and
    lists may be short or empty. Rows without exactly ``dim`` finite numbers or
    with all zeros (or a null id) are unusable and get no row.

    Exact copies are folded first: a class searches once, its smallest ``k + 1``
    ids stand for it in other lists, and all its members get a list, so a third
    of all rows in one class costs its members, not their pairs. Every vector
    is indexed. The number of trees follows the depth of the cells and how often bits of near pairs of the sample agree. A subtree still above ``cell`` strings at full depth is compared
    exactly in block pairs of bounded size.
    """
    use = usable_vectors(vectors, vec_id, vec, dim).withColumn("h1", F.xxhash64("v")).withColumn("h2", F.xxhash64(F.lit(7), F.col("v")))
    classes = checkpoint(use.groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("m")))
    n, rows = (classes.agg(F.count(F.lit(1)), F.coalesce(F.sum("m"), F.lit(0))).first())[:2]
    many = checkpoint(classes.where("m > 1"))
    members = use.select("vec_id", "h1", "h2")
    copies = members.join(many, ["h1", "h2"])
    # vectors that are not the first of their class stay behind; the others don't move
    spare = copies.where("vec_id <> rep").select("vec_id")
    reps = use.join(F.broadcast(spare) if rows - n <= SMALL else spare, "vec_id", "left_anti").select(F.col("vec_id").alias("rep"), "v")
    sample = reps.orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE_ROWS).select("v").toPandas()
    fit = _unit(sample["v"]) if len(sample) else np.zeros((0, dim), np.float32)
    rng = np.random.default_rng(seed)
    trial = spread_planes(fit, 64, rng)
    trees = trees or trees_for(n, cell, agreement(fit, *trial, floor))
    planes, cut = spread_planes(fit, trees * BITS, rng)
    hashed = reps.select("rep", "v", _hasher(planes, cut, trees)("v").alias("s"))

    # counts per string prefix, merged before the shuffle; a subtree's depth is the least at which it fits
    deep = min(BITS, math.ceil(math.log2(max(n / cell, 1))) + 8)
    top = F.shiftright(F.col("h"), BITS - deep)
    strings = hashed.select(F.posexplode("s").alias("tree", "h"))
    leaves = checkpoint(strings.groupBy("tree", top.alias("leaf")).agg(F.count(F.lit(1)).alias("n")))
    levels = leaves.select("tree", "leaf", "n", F.explode(F.sequence(F.lit(0), F.lit(deep))).alias("depth")).withColumn("prefix", F.expr(f"shiftright(leaf, {deep} - depth)"))
    fits = levels.groupBy("tree", "depth", "prefix").agg(F.sum("n").alias("size")).where((F.col("size") <= cell) | (F.col("depth") == deep))
    at = checkpoint(levels.join(fits, ["tree", "depth", "prefix"]).groupBy("tree", "leaf").agg(F.first("n").alias("n"), F.min(F.struct("depth", "prefix", "size")).alias("cell")))
    placed = _joined(hashed.select("rep", "v", F.posexplode("s").alias("tree", "h")).withColumn("leaf", top).drop("h"), at, ["tree", "leaf"], "n")
    blocks = F.greatest(F.lit(1), F.ceil(F.col("cell.size") / cell)).cast("int")
    placed = placed.select("rep", "v", "tree", F.col("cell.depth").alias("depth"), F.col("cell.prefix").alias("prefix"), blocks.alias("nb"))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("nb")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("nb") - 1), lambda j: F.struct(F.least(F.col("block"), j).alias("bi"), F.greatest(F.col("block"), j).alias("bj")))
    placed = placed.select("rep", "v", "tree", "depth", "prefix", "block", F.explode(pairs).alias("p")).select("rep", "v", "tree", "depth", "prefix", "block", "p.bi", "p.bj")
    keys = ["tree", "depth", "prefix", "bi", "bj"]
    raw = placed.groupBy(*keys).applyInPandas(_cell_search(k + 1, floor, leaf, inner, seed), "rep long, near array<struct<c: double, id: long>>")
    best = raw.groupBy("rep").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("near")))), 1, k + 1).alias("near"))

    # classes with copies: their smallest ids stand for them
    ranked = copies.withColumn("r", F.row_number().over(W.partitionBy("h1", "h2").orderBy("vec_id"))).where(F.col("r") <= k + 1)
    firsts = checkpoint(ranked.groupBy("rep").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"), F.first("m").alias("m")))
    small = firsts.count() <= SMALL // k
    bounded = lambda d: F.broadcast(d) if small else d
    spread = best.select("rep", F.explode("near").alias("n")).select("rep", "n.c", "n.id").join(bounded(firsts.select(F.col("rep").alias("id"), "ids")), "id", "left")
    spread = spread.select("rep", F.explode(F.transform(F.coalesce("ids", F.array("id")), lambda i: F.struct(F.col("c").alias("c"), i.alias("id")))).alias("n"))
    own = firsts.select("rep", F.explode(F.transform("ids", lambda i: F.struct(F.lit(-1.0).alias("c"), i.alias("id")))).alias("n"))
    lists = spread.unionByName(own).groupBy("rep").agg(F.slice(F.array_sort(F.collect_list("n")), 1, 2 * (k + 1)).alias("near"))
    lists = checkpoint(lists.join(classes, "rep", "right").withColumn("near", F.coalesce("near", F.array().cast("array<struct<c:double,id:bigint>>"))))
    # a class of one is its own list; only copies are looked up by class
    alone = lists.where("m = 1").select(F.col("rep").alias("vec_id"), "near")
    shared = split_join(members.join(bounded(many.select("h1", "h2")), ["h1", "h2"], "left_semi"), lists.where("m > 1").select("h1", "h2", "m", "near"), ["h1", "h2"], "m").select("vec_id", "near")
    return alone.unionByName(shared).select("vec_id", F.slice(F.filter("near", lambda x: x["id"] != F.col("vec_id")), 1, k).alias("near"))


def neighbour_pairs(lists: DataFrame) -> DataFrame:
    """Pairs ``vec_id_a < vec_id_b`` of which at least one has the other in its list."""
    p = lists.select("vec_id", F.explode("near.id").alias("id"))
    return p.select(F.least("vec_id", "id").alias("vec_id_a"), F.greatest("vec_id", "id").alias("vec_id_b")).distinct()
