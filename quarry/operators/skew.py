"""Operators that stay balanced when a few keys hold most rows."""

from __future__ import annotations

import math
import sys
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quarry.functions.normal import norm_key
from quarry.session import checkpoint

#: A key is hot when it holds at least this share of all fact rows, so there
#: are at most 1 / HOT_SHARE hot keys at any data size.
HOT_SHARE = 0.001


def split_join(facts: DataFrame, dim: DataFrame, keys: list[str], weight: str, hot_share: float = HOT_SHARE) -> DataFrame:
    """Inner join of ``facts`` to ``dim`` (unique on ``keys``) without a hot task.

    ``weight`` is the column of ``dim`` with the number of fact rows of the key.
    Keys with a share of at least ``hot_share`` number at most ``1 / hot_share``
    by arithmetic, whatever the data; only those are broadcast. The other keys,
    none above that share, go through an ordinary shuffle join. ``weight`` does
    not come out. Rows with a null in a key match nothing. An empty ``dim``
    gives an empty result.
    """
    total = dim.agg(F.sum(weight)).first()[0] or 0
    # greatest(1, ...) keeps the bound for tiny inputs: at most 1 / hot_share rows
    hot = dim.where(F.col(weight) >= F.lit(max(1.0, total * hot_share)))
    cold = dim.where(F.col(weight) < F.lit(max(1.0, total * hot_share)))
    on_hot = facts.join(F.broadcast(hot.drop(weight)), keys, "inner")
    rest = facts.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return on_hot.unionByName(rest.join(cold.drop(weight).hint("merge"), keys, "inner"))


def exact_quantiles(
    facts: DataFrame, keys: list[str], value: str, quantiles: list[float], buckets: int = 256, weight: str | None = None
) -> DataFrame:
    """Exact per-key quantiles by repeated refinement of value histograms.

    The quantile q of n values is the value of rank ``max(1, ceil(q * n))``
    (nearest rank). Every round splits the open interval of each (key, q) into
    ``buckets`` equal cells and counts them; counts merge before the shuffle, so
    a key with a third of all rows sends at most ``buckets`` counts a task and
    never its values. The cell that holds the rank becomes the next interval,
    until it holds one distinct value. The rounds are logarithmic in the range
    of the values, not in the number of rows.

    Null values and NaN are left out, infinite ones are ends of the order; a key with no value gives no row. Null
    keys form a group. Ties need no rule, equal values share a cell. Output:
    ``keys``, ``q``, ``n`` (values counted), ``value``.
    """
    qs = sorted(set(quantiles))
    names = {k: f"_k{i}" for i, k in enumerate(keys)}
    inner = list(names.values())
    rows = facts.select(*[F.col(k).alias(a) for k, a in names.items()], F.col(value).cast("double").alias("_v"), (F.col(weight) if weight else F.lit(1)).cast("long").alias("_w"))
    rows = rows.where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    # nulls are replaced in the join keys by a struct that is never null
    gid = F.struct(*inner)
    rows = checkpoint(rows.groupBy(gid.alias("_g"), "_v").agg(F.sum("_w").alias("_w")))
    state = rows.groupBy("_g").agg(F.sum("_w").alias("n"), F.count(F.lit(1)).alias("_rows"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
    state = state.select("_g", "n", "_rows", "lo", "hi", F.explode(F.array(*[F.lit(float(q)) for q in qs])).alias("q"))
    state = state.withColumn("rank", F.greatest(F.lit(1), F.ceil(F.col("q") * F.col("n"))).cast("long"))
    state = checkpoint(state.withColumn("below", F.lit(0).cast("long")))
    done: list[DataFrame] = []
    while True:
        done.append(state.where(F.col("lo") == F.col("hi")))
        open_ = state.where(F.col("lo") < F.col("hi"))
        if open_.isEmpty():
            break
        # the per-key bounds travel as one small array, so the join multiplies no rows
        bounds = open_.groupBy("_g").agg(F.collect_list(F.struct("q", "lo", "hi")).alias("_b"), F.max("_rows").alias("_rows"))
        joined = split_join(rows, bounds, ["_g"], "_rows")
        cells = joined.select("_g", "_v", "_w", F.explode(F.filter("_b", lambda b: (F.col("_v") >= b["lo"]) & (F.col("_v") <= b["hi"]))).alias("b"))
        # the ends have cells of their own, so every round leaves fewer values, however wide the range; infinite ends lie at the largest number
        big = sys.float_info.max
        half = lambda c: F.greatest(F.lit(-big), F.least(F.lit(big), c)) / 2
        lo, hi, v = half(F.col("b.lo")), half(F.col("b.hi")), half(F.col("_v"))
        inside = F.lit(1) + F.least(F.lit(buckets - 3), F.floor((v - lo) / (hi - lo) * (buckets - 2))).cast("int")
        cell = F.when(F.col("_v") == F.col("b.lo"), 0).when(F.col("_v") == F.col("b.hi"), buckets - 1).when(hi > lo, inside).otherwise(1)
        hist = cells.groupBy("_g", F.col("b.q").alias("q"), cell.alias("cell")).agg(F.sum("_w").alias("c"), F.min("_v").alias("mn"), F.max("_v").alias("mx"))
        # at most `buckets` rows a group
        cum = hist.withColumn("cum", F.sum("c").over(W.partitionBy("_g", "q").orderBy("cell").rowsBetween(W.unboundedPreceding, 0)))
        s = open_.select("_g", "q", "n", "_rows", "rank", "below")
        found = cum.join(s, ["_g", "q"]).where((F.col("cum") >= F.col("rank") - F.col("below")) & (F.col("cum") - F.col("c") < F.col("rank") - F.col("below")))
        state = checkpoint(
            found.select("_g", "n", "_rows", F.col("mn").alias("lo"), F.col("mx").alias("hi"), "q", "rank", (F.col("below") + F.col("cum") - F.col("c")).alias("below"))
        )
    out = reduce(DataFrame.unionByName, done)
    return out.select(*[F.col("_g")[a].alias(k) for k, a in names.items()], "q", "n", F.col("lo").alias("value"))


def key_rows(papers: DataFrame) -> DataFrame:
    """``field_name, key_value, citation_count, publication_year``: a row per paper and key, keys trimmed and in lower case, blank ones left out, an area once a paper."""
    areas = F.array_distinct(F.filter(F.transform(F.coalesce("subject_area", F.array().cast("array<string>")), norm_key), lambda x: x.isNotNull()))
    tags = F.concat(
        F.array(F.struct(F.lit("kerberos").alias("field_name"), norm_key("kerberos").alias("key_value"))),
        F.transform(areas, lambda x: F.struct(F.lit("subject_area").alias("field_name"), x.alias("key_value"))),
    )
    rows = papers.select("citation_count", "publication_year", F.explode(tags).alias("t"))
    return rows.select(F.col("t.field_name").alias("field_name"), F.col("t.key_value").alias("key_value"), "citation_count", "publication_year").where(F.col("key_value").isNotNull())


def key_profile(papers: DataFrame, quantiles: tuple[float, ...] = (0.5, 0.9)) -> DataFrame:
    """Papers, citations, years and exact citation quantiles of every key.

    ``papers`` has one row per paper: ``paper_key, kerberos, subject_area,
    citation_count, publication_year``. Keys are trimmed and lower-cased, blank
    ones left out; a subject area counts once per paper. All measures are
    mergeable counts, sums, extremes or refined histograms, so hot keys are
    combined before the shuffle. A key whose papers carry no citation count
    keeps null quantiles. ``papers`` counts the key's distinct papers and equals
    the sum of its year histogram.
    """
    keys = ["field_name", "key_value"]
    # the finest mergeable histogram of both measures; everything below reads it
    hist = checkpoint(key_rows(papers).groupBy(*keys, "citation_count", "publication_year").agg(F.count(F.lit(1)).alias("w")))
    base = hist.groupBy(*keys).agg(
        F.sum("w").alias("papers"),
        F.coalesce(F.sum(F.col("w") * F.col("citation_count")), F.lit(0)).cast("long").alias("citations"),
        F.min("publication_year").alias("first_year"),
        F.max("publication_year").alias("last_year"),
    )
    q = exact_quantiles(hist, keys, "citation_count", list(quantiles), weight="w")
    wide = q.groupBy(*keys).agg(*[F.max(F.when(F.col("q") == x, F.col("value"))).cast("int").alias(f"citations_p{round(x * 100)}") for x in quantiles])
    return base.join(wide, keys, "left")


def heavy_keys(rows: DataFrame, n_papers: int, share: float = 0.03, bits: int = 8) -> DataFrame:
    """``field_name, key_value`` of ``rows`` (:func:`key_rows`) with at least ``share`` of ``n_papers`` rows, by exact selection.

    The hashes of the keys are the values of a histogram. Every round counts the rows of each prefix of
    ``bits`` more bits; prefixes below the threshold hold no heavy key and are dropped, those with one key are
    resolved, the others refined. Counts merge before the shuffle, at most ``2 / share`` prefixes of a field
    go on, and no task holds a key's rows. At most ``64 / bits`` rounds; keys of one full hash are counted apart.
    """
    need = max(1, math.ceil(share * n_papers - 1e-9))
    rows = rows.select("field_name", "key_value", F.xxhash64("key_value").alias("h"))
    out: list[DataFrame] = []
    kept = F.lit(True)
    for depth in range(bits, 65, bits):
        prefix = F.shiftright("h", 64 - depth)
        cells = rows.where(kept).groupBy("field_name", prefix.alias("p")).agg(F.count(F.lit(1)).alias("n"), F.min("key_value").alias("key_value"), F.max("key_value").alias("last"))
        cells = checkpoint(cells.where(F.col("n") >= need))
        out.append(cells.where("key_value = last").select("field_name", "key_value"))
        more = [(r["field_name"], r["p"]) for r in cells.where("key_value < last").select("field_name", "p").collect()]
        if not more:
            return reduce(DataFrame.unionByName, out)
        kept = reduce(lambda a, b: a | b, [(F.col("field_name") == f) & (prefix == p) for f, p in more])
    rest = rows.where(kept).groupBy("field_name", "key_value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= need)
    return reduce(DataFrame.unionByName, out).unionByName(rest.select("field_name", "key_value"))
