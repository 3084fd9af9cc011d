"""Lexical retrieval: postings of the query's terms only, scored by BM25."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.text import edit_allowance, edits_to, terms

# The engine defaults of BM25.
K1, B = 1.2, 0.75


def analysed(docs: DataFrame, doc_id: str, fields: dict[str, Column | str]) -> DataFrame:
    """``doc_id, field, ts``: the terms of every field of every document; null fields are empty."""
    one = F.array(*[F.struct(F.lit(f).alias("field"), terms(c).alias("ts")) for f, c in fields.items()])
    return docs.select(F.col(doc_id).alias("doc_id"), F.explode(one).alias("a")).select("doc_id", "a.field", "a.ts")


def postings(tokens: DataFrame, words: list[str]) -> DataFrame:
    """``doc_id, field, term, tf, dl`` of the query's terms.

    Only matches are counted, inside each row; no term of the corpus that the
    query does not ask for is ever exploded or shuffled.
    """
    hits = F.array(*[F.struct(F.lit(w).alias("term"), F.size(F.filter("ts", _is(w))).alias("tf")) for w in words])
    return tokens.select("doc_id", "field", F.size("ts").alias("dl"), F.explode(F.filter(hits, lambda h: h["tf"] > 0)).alias("h")).select("doc_id", "field", "h.term", "h.tf", "dl")


@dataclass(frozen=True)
class Index:
    """Stored postings ``term, doc_id, field, tf, dl``, sorted by term, and ``field, n_docs, avgdl``."""

    postings: DataFrame
    fields: DataFrame


def write_index(tokens: DataFrame, path: str) -> Index:
    """Postings and statistics of all terms, written once: a query then reads its terms' row groups only.

    Counts merge before the shuffle; the range partitioning by term keeps a frequent term in several files.
    """
    counted = tokens.select("doc_id", "field", F.size("ts").alias("dl"), F.explode("ts").alias("term")).groupBy("term", "doc_id", "field", "dl").agg(F.count(F.lit(1)).cast("int").alias("tf"))
    counted.repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(f"{path}/postings")
    size = F.size("ts")
    tokens.groupBy("field").agg(F.count(F.when(size > 0, 1)).alias("n_docs"), F.avg(F.when(size > 0, size)).alias("avgdl")).write.mode("overwrite").parquet(f"{path}/fields")
    return open_index(tokens.sparkSession, path)


def open_index(spark: SparkSession, path: str) -> Index:
    return Index(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/fields"))


def _is(w: str):
    return lambda t: t == w


def corpus_stats(tokens: DataFrame, words: list[str]) -> DataFrame:
    """``field, term, df, n_docs, avgdl`` in one pass: a row a field and term, bounded by the query.

    A field counts the documents that have it.
    """
    size = F.size("ts")
    has = [F.count(F.when(F.array_contains("ts", w), 1)).alias(f"df{i}") for i, w in enumerate(words)]
    wide = tokens.groupBy("field").agg(F.count(F.when(size > 0, 1)).alias("n_docs"), F.avg(F.when(size > 0, size)).alias("avgdl"), *has)
    tall = F.explode(F.array(*[F.struct(F.lit(w).alias("term"), F.col(f"df{i}").alias("df")) for i, w in enumerate(words)]))
    return wide.select("field", "n_docs", "avgdl", tall.alias("t")).select("field", "t.term", "t.df", "n_docs", "avgdl").where("df > 0")


def scored(tokens: DataFrame | Index, words: list[str], boosts: dict[str, float] | None = None) -> DataFrame:
    """``doc_id, field, term, score``: boosted BM25 of every matching (document, field, term).

    The statistics are a handful of rows, bounded by the query's terms and the
    fields, so they are broadcast.
    """
    if isinstance(tokens, Index):
        found = tokens.postings.where(F.col("term").isin(words))
        stats = found.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df")).join(tokens.fields, "field")
    else:
        found, stats = postings(tokens, words), corpus_stats(tokens, words)
    x = found.join(F.broadcast(stats), ["field", "term"])
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    score = idf * F.col("tf") / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    boost = F.lit(1.0)
    for f, w in (boosts or {}).items():
        boost = F.when(F.col("field") == f, F.lit(w)).otherwise(boost)
    return x.select("doc_id", "field", "term", (score * boost).alias("score"))


def match(tokens: DataFrame | Index, words: list[str], required: int = 1, boosts: dict[str, float] | None = None, tie_breaker: float = 0.3, variants: dict[str, str] | None = None) -> DataFrame:
    """``doc_id, score`` of documents that have at least ``required`` of the terms, in any field.

    A term counts its best field plus ``tie_breaker`` times the others; terms
    add up. ``variants`` maps other spellings to their words: they score, but a
    word and its variants are one term. No words, or more required than there are, match nothing.
    """
    if not words:
        of = tokens.postings if isinstance(tokens, Index) else tokens
        return of.limit(0).select("doc_id", F.lit(0.0).alias("score"))
    s = scored(tokens, [*words, *(variants or {})], boosts)
    for v, w in (variants or {}).items():
        s = s.withColumn("term", F.when(F.col("term") == v, F.lit(w)).otherwise(F.col("term")))
    per_term = s.groupBy("doc_id", "term").agg((F.max("score") + tie_breaker * (F.sum("score") - F.max("score"))).alias("score"))
    return per_term.groupBy("doc_id").agg(F.sum("score").alias("score"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= required).drop("n")


def phrase_at(ts: Column, words: list[str], slop: int = 0) -> Column:
    """True where the words occur in order with at most ``slop`` other terms between the first and last."""
    n = len(words)
    if not n:
        return F.lit(False)
    if slop == 0:
        return F.contains(F.concat(F.lit(" "), F.array_join(ts, " "), F.lit(" ")), F.lit(f" {' '.join(words)} "))
    gap = r"(?: \S+){0,%d}?"
    # the total of the gaps is checked on the matched stretch itself
    pattern = " " + (gap % slop + " ").join(words) + " "
    text = F.concat(F.lit(" "), F.array_join(ts, " "), F.lit(" "))
    spans = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    return F.exists(spans, lambda s: F.size(F.split(F.trim(s), " ")) - n <= slop)


def phrase_prefix_at(ts: Column, words: list[str]) -> Column:
    """The words in a row, the last one as a prefix."""
    return F.contains(F.concat(F.lit(" "), F.array_join(ts, " ")), F.lit(" " + " ".join(words)))


def vocabulary(tokens: DataFrame) -> DataFrame:
    """``term, df``: documents of every term (any field)."""
    return tokens.select("doc_id", F.explode(F.array_distinct("ts")).alias("term")).groupBy("term").agg(F.countDistinct("doc_id").alias("df"))


def fuzzy_terms(vocab: DataFrame, words: list[str], max_expansions: int = 10) -> DataFrame:
    """``word, term, df, d``: vocabulary terms within each word's edit allowance, the nearest and most frequent first.

    Runs over the vocabulary, never over documents; at most ``max_expansions`` a word.
    """
    from pyspark.sql import Window as W

    parts = [vocab.withColumn("word", F.lit(w)).withColumn("d", edits_to(F.col("term"), w)).where(F.col("d") <= edit_allowance(F.lit(len(w)))) for w in words or [""]]
    r = F.row_number().over(W.partitionBy("word").orderBy("d", F.desc("df"), "term"))
    return reduce(DataFrame.unionByName, parts).withColumn("r", r).where(F.col("r") <= max_expansions).select("word", "term", "df", "d", "r")


def suggestions(vocab: DataFrame, words: list[str], top: int = 3) -> DataFrame:
    """"Did you mean": per word of three letters or more, terms of the same first letter within two edits and more
    frequent than the word, by frequency."""
    from pyspark.sql import Window as W

    parts = [vocab.limit(0).select("term", "df", F.lit(0).alias("d"), F.lit(0).cast("long").alias("own"), F.lit("").alias("word"))]
    for w in words:
        if len(w) < 3:
            continue
        own = vocab.where(F.col("term") == w).agg(F.coalesce(F.max("df"), F.lit(0)).alias("own"))
        near = vocab.where(F.col("term").startswith(w[0]) & (F.col("term") != w)).withColumn("d", edits_to(F.col("term"), w)).where("d <= 2")
        parts.append(near.join(F.broadcast(own), F.col("df") > F.col("own")).withColumn("word", F.lit(w)).select("term", "df", "d", "own", "word"))
    r = F.row_number().over(W.partitionBy("word").orderBy(F.desc("df"), "d", "term"))
    return reduce(DataFrame.unionByName, parts).withColumn("rank", r).where(F.col("rank") <= top).select("word", "term", "df", "d", "rank")


def top_k(scored_docs: DataFrame, k: int, offset: int = 0, digits: int = 6) -> DataFrame:
    """``rank, doc_id, score`` of the page ``[offset, offset + k)`` by rounded score, ties by id."""
    from pyspark.sql import Window as W

    s = scored_docs.select("doc_id", F.round("score", digits).alias("score")).orderBy(F.desc("score"), "doc_id").limit(offset + k)
    ranked = s.withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), "doc_id")))
    return ranked.where(F.col("rank") > offset).select("rank", "doc_id", "score")


def two_tier(tokens: DataFrame, words: list[str]) -> tuple[DataFrame, str]:
    """``doc_id`` of phrase matches and "phrase"; only where there is none, of documents with all words and "terms"."""
    phrase = tokens.where(phrase_at(F.col("ts"), words)).select("doc_id").distinct()
    if words and not phrase.isEmpty():
        return phrase, "phrase"
    every = F.lit(bool(words))
    for w in words:
        every = every & F.array_contains("ts", w)
    return tokens.where(every).select("doc_id").distinct(), "terms"
