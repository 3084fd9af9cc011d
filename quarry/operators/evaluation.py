"""Retrieval metrics over (query, ranked documents, judgments)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quarry.session import checkpoint

#: Documents that share a rarest term, up to which they are joined pair by pair; more go in blocks of so many.
FEW, BLOCK = 32, 16_384
#: A field is compared whole from this share of its pairs on that meet under terms of more than ``FEW`` documents.
WHOLE = 0.05
#: Columns of the table of terms by which a block's pairs are ruled out.
WIDE = 512
#: Terms of all fields up to which their numbers are broadcast.
TERMS = 50_000


def metrics(run: DataFrame, judged: DataFrame, k: int = 10) -> DataFrame:
    """``query_id, recall, precision, mrr, ndcg`` at ``k`` (MRR over the whole run).

    ``run``: ``query_id, doc_id, rank``; ``judged``: ``query_id, doc_id, grade``
    (grade 0 is not relevant). A query without relevant judgments has no recall
    and nDCG 0.
    """
    rel = judged.where("grade > 0")
    hits = run.join(rel, ["query_id", "doc_id"], "left")
    gain = F.pow(F.lit(2.0), F.coalesce("grade", F.lit(0))) - 1
    at = F.col("rank") <= k
    got = hits.groupBy("query_id").agg(
        F.count(F.when(at & F.col("grade").isNotNull(), 1)).alias("found"),
        F.min(F.when(F.col("grade").isNotNull(), F.col("rank"))).alias("first"),
        F.sum(F.when(at, gain / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg"),
    )
    ideal = rel.withColumn("r", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("grade"), "doc_id")))
    best = ideal.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n_rel"), F.sum(F.when(F.col("r") <= k, (F.pow(F.lit(2.0), "grade") - 1) / F.log2(F.col("r") + 1)).otherwise(0.0)).alias("idcg")
    )
    return got.join(best, "query_id", "left").select(
        "query_id",
        F.round(F.col("found") / F.col("n_rel"), 6).alias("recall"),
        F.round(F.col("found") / F.lit(float(k)), 6).alias("precision"),
        F.round(F.coalesce(1.0 / F.col("first"), F.lit(0.0)), 6).alias("mrr"),
        F.round(F.coalesce(F.col("dcg") / F.col("idcg"), F.lit(0.0)), 6).alias("ndcg"),
    )


def macro_average(per_query: DataFrame) -> DataFrame:
    """Means over queries; missing recalls are skipped and counted."""
    return per_query.agg(F.count(F.lit(1)).alias("queries"), F.count("recall").alias("judged"), *[F.round(F.avg(c), 6).alias(c) for c in ("recall", "precision", "mrr", "ndcg")])


def title_overlap(pairs_on: DataFrame, field: str, doc_id: str, ts: str, threshold: float = 0.38) -> DataFrame:
    """Pairs of documents of one field whose title terms overlap (Jaccard) by ``threshold`` or more.

    Prefix filter: only documents that share one of their rarest terms, as any pair
    above the threshold must, are compared, under the rarest term they share, so each
    pair comes out once and no pairs below the threshold are ever written. Terms of few
    documents are joined, those of many compared in blocks of bounded size; a field of few
    different terms, where most documents would meet again and again, goes in such blocks as a whole.
    """
    x = pairs_on.select(F.col(field).alias("f"), F.col(doc_id).alias("id"), F.array_distinct(ts).alias("t")).where("f IS NOT NULL AND size(t) > 0")
    df = x.select("f", F.explode("t").alias("w")).groupBy("f", "w").agg(F.count(F.lit(1)).alias("n"))
    # a term's number is its place among those of its field, the rarest first
    df = checkpoint(df.select("f", "w", F.row_number().over(W.partitionBy("f").orderBy("n", "w")).alias("r")))
    small = df.count() <= TERMS
    sent = F.broadcast if small else lambda d: d
    e = x.select("f", "id", F.explode("t").alias("w")).join(sent(df), ["f", "w"])
    docs = checkpoint(e.groupBy("f", "id").agg(F.array_sort(F.collect_list("r")).alias("t")))
    k = F.size("t")
    docs = docs.withColumn("rare", F.slice("t", F.lit(1), (k - F.ceil(threshold * k - 1e-9) + 1).cast("int")))
    n = checkpoint(docs.select("f", F.explode("rare").alias("w")).groupBy("f", "w").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    met = n.where(F.col("n") > FEW).groupBy("f").agg(F.sum(F.col("n") * F.col("n")).alias("met"))
    fields = docs.groupBy("f").agg(F.count(F.lit(1)).alias("nf")).join(met, "f")
    fields = checkpoint(fields.where(F.col("met") >= WHOLE * F.col("nf") * F.col("nf")).select("f", "nf"))
    apart = n.join(fields, "f", "left_anti")
    few = apart.where(F.col("n") <= FEW).select("f", "w")
    blocks = lambda c: F.ceil(F.col(c) / BLOCK).cast("int").alias("nb")
    many, fields = apart.where(F.col("n") > FEW).select("f", "w", blocks("n")), fields.select("f", blocks("nf"))
    pre = docs.select("f", "id", "t", F.explode("rare").alias("w"))
    two = pre.join(sent(few), ["f", "w"])
    both = F.array_intersect("a.t", "b.t")
    two = two.alias("a").join(two.alias("b"), (F.col("a.f") == F.col("b.f")) & (F.col("a.w") == F.col("b.w")) & (F.col("a.id") < F.col("b.id")) & (F.array_min(both) == F.col("a.w")))
    two = two.select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), F.size(both).alias("shared"), (F.size("a.t") + F.size("b.t") - F.size(both)).alias("either")).where(F.col("shared") / F.col("either") >= threshold)
    of = pre.join(sent(many), ["f", "w"]).unionByName(docs.select("f", "id", "t", F.lit(0).alias("w")).join(sent(fields), "f"))
    of = of.withColumn("own", F.pmod(F.xxhash64("id"), F.col("nb")).cast("int")).withColumn("beside", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    of = of.select("f", "w", F.least("own", "beside").alias("lo"), F.greatest("own", "beside").alias("hi"), "own", "id", "t")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        return block_overlap(pdf["id"].to_numpy(), pdf["t"].to_numpy(), (pdf["own"] == pdf["lo"]).to_numpy(), (pdf["own"] == pdf["hi"]).to_numpy(), pdf["w"].iat[0], threshold)

    # blocks are small in bytes and costly to compare, so they are spread before the engine can put them together
    tasks = int(x.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ["f", "w", "lo", "hi"]
    y = of.repartition(tasks, *keys).groupBy(*keys).applyInPandas(compare, "a string, b string, shared int, either int").unionByName(two)
    return y.select("a", "b", F.round(F.col("shared") / F.col("either"), 6).alias("jaccard"))


def block_overlap(ids: np.ndarray, terms: np.ndarray, first: np.ndarray, second: np.ndarray, rarest: int, threshold: float) -> pd.DataFrame:
    """Pairs ``a < b`` of a ``first`` and a ``second`` document whose overlap reaches the threshold and whose rarest common term is ``rarest`` (0: any).

    ``terms`` has each document's distinct term numbers, from one. Products of their counts over at most ``WIDE`` columns are
    no less than the number of common terms, so they rule pairs out; the rest is counted.
    """
    k = np.array([len(t) for t in terms])
    flat, row = np.concatenate(list(terms)).astype(np.int32), np.repeat(np.arange(len(k)), k)
    known, col = np.unique(flat, return_inverse=True)
    m = np.zeros((len(k), min(len(known), WIDE)), dtype=np.float32)
    np.add.at(m, (row, col % m.shape[1]), 1)
    padded = np.full((len(k), k.max()), -1, dtype=np.int32)
    padded[row, np.arange(len(flat)) - np.repeat(np.cumsum(k) - k, k)] = flat
    other = np.where(padded < 0, -2, padded)
    # common >= threshold * (all terms of both) / (1 + threshold)
    part = (k * (threshold / (1 + threshold))).astype(np.float32)
    xs, ys = np.flatnonzero(first), np.flatnonzero(second)
    inside = bool((first & second).any())
    out: list[list[np.ndarray]] = [[], [], [], []]
    step = max(1, (1 << 22) // padded.shape[1] ** 2)
    for at in range(0, len(xs), 512):
        x = xs[at : at + 512]
        # within one block every pair is looked at once
        for to in range(at if inside else 0, len(ys), 2048):
            y = ys[to : to + 2048]
            over = m[x] @ m[y].T
            over -= part[y]
            i, j = np.divmod(np.flatnonzero(over > part[x, None] - 1e-3), len(y))
            i, j = x[i], y[j]
            if inside:
                i, j = i[i < j], j[i < j]
            for p in range(0, len(i), step):
                u, v = i[p : p + step], j[p : p + step]
                same = (padded[u][:, :, None] == other[v][:, None, :]).any(axis=2)
                shared = same.sum(axis=1)
                either = k[u] + k[v] - shared
                keep = (shared / either >= threshold) & ~(same & (padded[u] < rarest)).any(axis=1)
                u, v = ids[u[keep]], ids[v[keep]]
                less = u < v
                for o, c in zip(out, (np.where(less, u, v), np.where(less, v, u), shared[keep], either[keep]), strict=True):
                    o.append(c)
    got = [np.concatenate(o) if o else np.array([]) for o in out]
    return pd.DataFrame({"a": got[0].astype(object), "b": got[1].astype(object), "shared": got[2].astype(np.int32), "either": got[3].astype(np.int32)})


def calibrate(run: DataFrame, judged: DataFrame, depth: int = 50) -> DataFrame:
    """``query_id, doc_id, grade``: judged documents that the run has in its first ``depth``, graded anew by rank (3 to
    rank 10, 2 to rank 25, else 1). A query none of whose documents is found has no rows."""
    x = run.where(F.col("rank") <= depth).join(judged.select("query_id", "doc_id"), ["query_id", "doc_id"])
    return x.select("query_id", "doc_id", F.when(F.col("rank") <= 10, 3).when(F.col("rank") <= 25, 2).otherwise(1).alias("grade"))
