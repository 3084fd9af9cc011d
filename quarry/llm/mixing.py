"""Mixing sources to target weights: budgets fitted by subset sums over lengths."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quarry.functions.normal import norm_key
from quarry.llm.tokens import VOCABULARY, token_count
from quarry.operators.skew import split_join
from quarry.session import checkpoint

#: Tokens left to the dynamic program after the proportional fill.
WINDOW = 1 << 16
#: Documents of one length that one task ranks.
RANKED = 10_000


def bounded_subset(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many of each length to take so that their sum comes closest to ``budget`` from below.

    Bounded knapsack over the reachable sums, kept as bits; multiplicities are
    split into powers of two. Ends as soon as the budget itself is reachable.
    """
    take = np.zeros(len(lengths), dtype=np.int64)
    if budget <= 0:
        return take
    mask = (1 << (budget + 1)) - 1
    reach, steps = 1, []
    for j in range(len(lengths)):
        size, left, part = int(lengths[j]), int(counts[j]), 1
        left = min(left, budget // size) if size > 0 else 0
        while left > 0 and not reach >> budget & 1:
            k = min(part, left)
            steps.append((j, k, reach))
            reach |= (reach << (size * k)) & mask
            left, part = left - k, part * 2
        if reach >> budget & 1:
            break
    at = reach.bit_length() - 1
    for j, k, before in reversed(steps):
        if not before >> at & 1:
            take[j] += k
            at -= k * int(lengths[j])
    return take


def fit_lengths(lengths: np.ndarray, counts: np.ndarray, target: int, max_repeats: int, seed: int = 0, window: int = WINDOW) -> tuple[int, np.ndarray]:
    """``(base, extra)``: every document ``base`` times, ``extra[l]`` documents of each length once more.

    The sum is the largest the fit finds not above ``target``. Whole passes come
    first, then the same share of every length, then single documents in seeded
    order, and the rest by :func:`bounded_subset`.
    """
    extra = np.zeros(len(lengths), dtype=np.int64)
    total = int((lengths * counts).sum())
    if max_repeats < 1 or target <= 0 or total == 0:
        return 0, extra
    if target >= max_repeats * total:
        return max_repeats, extra
    base, rest = divmod(target, total)
    extra = (counts * rest) // total
    rest -= int((lengths * extra).sum())
    order = np.random.default_rng(seed).permutation(len(lengths))
    for j in order:
        if rest <= window:
            break
        if lengths[j] and extra[j] < counts[j] and lengths[j] <= rest:
            k = min(int(counts[j] - extra[j]), max(1, (rest - window) // int(lengths[j])))
            extra[j] += k
            rest -= k * int(lengths[j])
    free = order[(lengths[order] > 0) & (extra[order] < counts[order]) & (lengths[order] <= rest)]
    extra[free] += bounded_subset(lengths[free], (counts - extra)[free], int(rest))
    return int(base), extra


def _fit(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("n", ignore_index=True)
    lengths, counts = pdf["n"].to_numpy(), pdf["docs"].to_numpy()
    base, extra = fit_lengths(lengths, counts, int(pdf["target_tokens"].iat[0]), int(pdf["max_repeats"].iat[0]), int(pdf["mix_id"].iat[0]))
    return pd.DataFrame({"mix_id": pdf["mix_id"], "source": pdf["source"], "n": lengths, "docs": counts, "base": base, "extra": extra})


def _targets(targets: DataFrame, total: int) -> DataFrame:
    t = targets.select(
        F.col("mix_id").cast("int").alias("mix_id"), norm_key("source").alias("source"), F.greatest(F.coalesce("target_weight", F.lit(0.0)), F.lit(0.0)).alias("w"),
        F.coalesce("max_repeats", F.lit(1)).alias("max_repeats"), F.coalesce("total_ratio", F.lit(1.0)).alias("ratio"),
    ).where("source IS NOT NULL")
    t = t.groupBy("mix_id", "source").agg(F.sum("w").alias("w"), F.max("max_repeats").alias("max_repeats"), F.max("ratio").alias("ratio"))
    share = F.coalesce(F.try_divide("w", F.sum("w").over(W.partitionBy("mix_id"))), F.lit(0.0))
    return t.withColumn("target_share", share).withColumn("target_tokens", F.round(F.col("target_share") * F.col("ratio") * F.lit(total)).cast("long"))


def mix_documents(docs: DataFrame, targets: DataFrame, vocabulary: str = VOCABULARY, seed: int = 11) -> tuple[DataFrame, DataFrame]:
    """``(selection, report)`` of every mix in ``targets``.

    ``docs``: ``doc_id, source, text``; ``targets``: ``mix_id, source,
    target_weight, max_repeats, total_ratio``. Sources compare trimmed and in
    lower case; a blank source belongs to no mix but counts in the size of all
    documents. Weights are relative; null and negative ones are zero, rows of
    one mix and source add up. A source aims at its share of ``total_ratio``
    times the tokens of all documents; one that cannot reach it even at
    ``max_repeats`` gives all it has, and the report shows the share reached.
    Sources without documents reach zero.

    ``selection``: ``mix_id, source, doc_id, n_tokens, repeats`` (at least 1).
    ``report``: ``mix_id, source, target_share, target_tokens, actual_tokens,
    actual_share, n_docs, most_repeats``.

    Documents are counted per source and exact length before anything else
    moves. The fit sees one row per length. Documents of one length are ranked
    by a seeded hash in buckets of about ``RANKED``, so no task holds a length
    that a third of all texts share.
    """
    sized = checkpoint(docs.select(F.col("doc_id").cast("long").alias("doc_id"), norm_key("source").alias("source"), token_count("text", vocabulary).alias("n")))
    total = sized.agg(F.sum("n")).first()[0] or 0
    goal = checkpoint(_targets(targets, total))
    lengths = sized.where("source IS NOT NULL").groupBy("source", "n").agg(F.count(F.lit(1)).alias("docs"))
    fitted = checkpoint(
        lengths.join(goal.select("mix_id", "source", "target_tokens", "max_repeats"), "source")
        .groupBy("mix_id", "source")
        .applyInPandas(_fit, "mix_id int, source string, n long, docs long, base int, extra long")
        .where("base > 0 OR extra > 0")
    )
    plan = fitted.groupBy("source", "n").agg(F.max("docs").alias("docs"), F.collect_list(F.struct("mix_id", "base", "extra", F.col("docs").alias("c"))).alias("m"))
    d = split_join(sized, plan, ["source", "n"], "docs").select("source", "n", "doc_id", F.explode("m").alias("m")).select("source", "n", "doc_id", "m.*")
    sure = d.where("extra = 0 OR extra = c").select("mix_id", "source", "doc_id", "n", (F.col("base") + F.when(F.col("extra") > 0, 1).otherwise(0)).alias("repeats"))
    h = F.xxhash64("doc_id", "mix_id", F.lit(seed))
    cut = d.where("extra > 0 AND extra < c").withColumn("h", h).withColumn("bucket", F.pmod(F.col("h"), F.greatest(F.lit(1), F.ceil(F.col("c") / RANKED))).cast("int"))
    group = ["mix_id", "source", "n"]
    sizes = cut.groupBy(*group, "bucket").agg(F.count(F.lit(1)).alias("k"))
    before = sizes.withColumn("before", F.sum("k").over(W.partitionBy(*group).orderBy("bucket").rowsBetween(W.unboundedPreceding, -1))).select(*group, "bucket", F.coalesce("before", F.lit(0)).alias("before"))
    ranked = cut.join(before, [*group, "bucket"]).withColumn("r", F.row_number().over(W.partitionBy(*group, "bucket").orderBy("h", "doc_id")))
    partly = ranked.select("mix_id", "source", "doc_id", "n", (F.col("base") + F.when(F.col("before") + F.col("r") <= F.col("extra"), 1).otherwise(0)).alias("repeats"))
    selection = sure.unionByName(partly).where("repeats > 0").select("mix_id", "source", "doc_id", F.col("n").alias("n_tokens"), F.col("repeats").cast("int").alias("repeats"))
    reached = selection.groupBy("mix_id", "source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("t"), F.count(F.lit(1)).alias("n_docs"), F.max("repeats").alias("most_repeats"))
    report = goal.join(reached, ["mix_id", "source"], "left").select(
        "mix_id", "source", F.round("target_share", 9).alias("target_share"), "target_tokens", F.coalesce("t", F.lit(0)).cast("long").alias("actual_tokens"),
        F.round(F.coalesce(F.try_divide("t", F.sum("t").over(W.partitionBy("mix_id"))), F.lit(0.0)), 9).alias("actual_share"),
        F.coalesce("n_docs", F.lit(0)).cast("long").alias("n_docs"), F.coalesce("most_repeats", F.lit(0)).cast("int").alias("most_repeats"),
    )
    return selection, report
