"""Connected components over an edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.session import checkpoint


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_levels: int = 100) -> DataFrame:
    """``node, component`` of every node with an edge; the component is one of its nodes.

    By contraction: every node takes the least of itself and its neighbours as
    parent, edges are mapped to the parents, and those that became loops or
    repeats are dropped, so most components are finished after one level and
    only the rest of the graph goes on. From the second level on "least" is by
    a hash that changes with the level, so a long path shrinks by a constant
    share each time. Minima are combined before the shuffle: a node with a third
    of all edges sends one value a task. Null ends and loops are ignored.
    """
    e = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    e = checkpoint(e)  # repeats do no harm to the first minimum
    parents: list[DataFrame] = []
    for level in range(max_levels):
        two = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
        both = e.select(F.explode(two).alias("two")).select("two.a", "two.b")
        if level == 0:
            p = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("p"))
        else:
            by = lambda c: F.struct(F.xxhash64(c, F.lit(level)).alias("h"), F.col(c).alias("n"))
            p = both.groupBy("a").agg(F.least(by("a"), F.min(by("b")))["n"].alias("p"))
        p = checkpoint(p.select(F.col("a").alias("node"), "p"))
        parents.append(p)
        pa, pb = p.select(F.col("node").alias("a"), F.col("p").alias("x")), p.select(F.col("node").alias("b"), F.col("p").alias("y"))
        up = e.join(pa, "a").join(pb, "b").where("x <> y")
        e = checkpoint(up.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        if e.isEmpty():
            break
    else:
        raise RuntimeError("components did not settle")
    out = parents[0].select("node", F.col("p").alias("component"))
    for p in parents[1:]:
        step = p.select(F.col("node").alias("component"), "p")
        out = out.join(step, "component", "left").select("node", F.coalesce("p", "component").alias("component"))
    return out
