"""Filling containers of fixed capacity: sum-of-squares packing."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.tokens import VOCABULARY, token_count
from quarry.session import checkpoint

#: Tokens packed by one task; the number of tasks follows the data.
SHARD_TOKENS = 1 << 22
#: Items packed by one task, however few tokens they have.
SHARD_ITEMS = 1 << 16
#: Budgets of one run at most.
MOST_BUDGETS = 1000
#: Containers filled to this share are closed; the items of the others are packed once more across shards.
CLOSE = 0.98


def sum_of_squares(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container number of every item, largest items first.

    An item goes where the sum over all gaps of the squared number of open
    containers with that gap becomes smallest; opening a new container competes
    on the same terms. Ties go to the smallest remaining gap. Items of size zero
    join the last container. Sizes must not exceed ``capacity``.
    """
    out = np.zeros(len(sizes), dtype=np.int64)
    n_open = np.zeros(capacity + 1, dtype=np.int64)  # full containers (gap 0) are not open and count nothing
    by_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins = 0
    big = np.int64(1 << 60)
    for i in np.argsort(-sizes, kind="stable"):
        s = int(sizes[i])
        if s == 0:
            out[i] = max(0, bins - 1)
            bins = max(bins, 1)
            continue
        # change of the sum: 2 N(g - s) - 2 N(g) + 2 for an open container, 2 N(capacity - s) + 1 for a new one
        here = n_open[s:capacity]
        delta = np.where(here > 0, n_open[: capacity - s] - here, big)
        best, new = (int(delta.argmin()) if len(delta) else -1), capacity - s
        gain = 2 * int(delta[best]) + (1 if best == 0 else 2) if best >= 0 and delta[best] < big else None
        if gain is None or (2 * int(n_open[new]) + 1 if new else 0) < gain:
            b, gap = bins, new
            bins += 1
        else:
            b, gap = by_gap[best + s].pop(), best
            n_open[best + s] -= 1
        out[i] = b
        if gap:
            n_open[gap] += 1
            by_gap[gap].append(b)
    return out


def _pack(round_no: int):
    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "piece"], kind="stable", ignore_index=True)
        size, capacity = pdf["n_tokens"].to_numpy(), int(pdf["capacity"].iat[0])
        at = sum_of_squares(size, capacity)
        fill = np.bincount(at, weights=size).astype(np.int64)
        shard = int(pdf["shard"].iat[0])
        pdf["container_id"] = [f"r{round_no}s{shard}c{b}" for b in at]
        pdf["fill"] = fill[at]
        return pdf[["budget_id", "capacity", "doc_id", "piece", "first_token", "n_tokens", "container_id", "fill"]]

    return pack


_ITEM = "budget_id int, capacity long, doc_id long, piece long, first_token long, n_tokens long, container_id string, fill long"


def pack_documents(docs: DataFrame, budgets: DataFrame, vocabulary: str = VOCABULARY, shard_tokens: int = SHARD_TOKENS, close: float = CLOSE, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """Containers of every budget: ``budget_id, container_id, doc_id, piece, first_token, n_tokens``.

    ``docs``: ``doc_id`` (unique), ``text``; ``budgets``: ``budget_id,
    capacity_tokens`` (those null or below one are left out). A text goes whole
    into one container; only one larger than the container is split, into full
    containers and a rest that is packed like any item. Texts without tokens
    (null, empty) take no space and lie in some container. Every document comes
    out once per budget, or once per piece.

    Documents are spread over shards by a hash of their id, a shard holding
    about ``shard_tokens`` tokens and at most about ``shard_items`` items at any data size; each shard packs by itself,
    and the items of containers filled below ``close`` are packed again across
    fewer shards, as long as that at least halves what is left over.
    """
    sized = checkpoint(docs.select(F.col("doc_id").cast("long").alias("doc_id"), token_count("text", vocabulary).alias("n")))
    all_ = sized.agg(F.sum("n").alias("t"), F.count(F.lit(1)).alias("c")).first()
    total = all_["t"] or 0
    # budgets are parameters: a list of bounded size, spread over the documents as literals
    cap = budgets.where("capacity_tokens > 0").select(F.col("budget_id").cast("int"), F.col("capacity_tokens").cast("long")).distinct().limit(MOST_BUDGETS + 1).collect()
    if len(cap) > MOST_BUDGETS:
        raise ValueError(f"more than {MOST_BUDGETS} budgets")
    listed = F.array(*[F.struct(F.lit(b).cast("int").alias("budget_id"), F.lit(c).cast("long").alias("capacity")) for b, c in cap]) if cap else F.array().cast("array<struct<budget_id:int,capacity:bigint>>")
    wanted = sized.select("doc_id", "n", F.explode(listed).alias("b")).select("doc_id", "n", "b.budget_id", "b.capacity")
    whole = F.floor(F.col("n") / F.col("capacity"))
    split = wanted.where(F.col("n") >= F.col("capacity")).select("budget_id", "capacity", "doc_id", F.explode(F.sequence(F.lit(0).cast("long"), whole - 1)).alias("piece"))
    full = split.select(
        "budget_id", "capacity", "doc_id", "piece", (F.col("piece") * F.col("capacity")).alias("first_token"), F.col("capacity").alias("n_tokens"),
        F.concat(F.lit("d"), F.col("doc_id"), F.lit("p"), F.col("piece")).alias("container_id"), F.col("capacity").alias("fill"),
    )
    rest = wanted.where((F.col("n") % F.col("capacity") > 0) | (F.col("n") == 0)).select(
        "budget_id", "capacity", "doc_id", whole.cast("long").alias("piece"), (whole * F.col("capacity")).cast("long").alias("first_token"), (F.col("n") % F.col("capacity")).alias("n_tokens")
    )
    done = [full]
    left, left_tokens, left_items, round_no = rest, total, all_["c"], 0
    while True:
        shards = max(1, -(-left_tokens // shard_tokens), -(-left_items // shard_items))
        packed = checkpoint(
            left.withColumn("shard", F.pmod(F.xxhash64(F.col("doc_id"), F.lit(round_no)), F.lit(shards)).cast("int"))
            .groupBy("budget_id", "shard")
            .applyInPandas(_pack(round_no), _ITEM)
        )
        poor = F.col("fill") < F.col("capacity") * close
        per = packed.where(poor).groupBy("budget_id").agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("c"))
        over = per.agg(F.max("t").alias("t"), F.max("c").alias("c")).first() if shards > 1 else None
        again, items = ((over["t"] or 0), (over["c"] or 0)) if over else (0, 0)
        if again == 0 or again * 2 > left_tokens:
            done.append(packed)
            break
        done.append(packed.where(~poor))
        left, left_tokens, left_items, round_no = packed.where(poor).drop("container_id", "fill"), again, items, round_no + 1
    return reduce(DataFrame.unionByName, done).select("budget_id", "container_id", "doc_id", "piece", "first_token", "n_tokens")


def packing_report(packed: DataFrame, budgets: DataFrame) -> DataFrame:
    """Containers, tokens and unused share per budget, with the least number of containers that could do."""
    per = packed.groupBy("budget_id", "container_id").agg(F.sum("n_tokens").alias("t")).groupBy("budget_id").agg(F.count(F.lit(1)).alias("containers"), F.sum("t").alias("tokens"))
    return per.join(budgets.select("budget_id", "capacity_tokens"), "budget_id").select(
        "budget_id", "capacity_tokens", "containers", "tokens", F.ceil(F.col("tokens") / F.col("capacity_tokens")).alias("least_containers"),
        F.round(1 - F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 6).alias("unused_share"),
    )
