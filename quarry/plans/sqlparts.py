"""Pieces of SQL that the counterpart queries share."""

from __future__ import annotations


def norm(x: str) -> str:
    return rf"nullif(regexp_replace(lower({x}), '^\s+|\s+$', '', 'g'), '')"


def toks(x: str) -> str:
    return rf"list_filter(regexp_split_to_array(lower(coalesce({x}, '')), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '')"


PAPER_KEY = f"coalesce({norm('mongo_id')}, 'delivery:' || delivery_id)"

LATEST = f"""latest AS (
  SELECT * FROM (SELECT *, {PAPER_KEY} AS paper_key,
    row_number() OVER (PARTITION BY {PAPER_KEY} ORDER BY updated_at DESC NULLS LAST, delivery_id DESC) AS rn FROM papers) WHERE rn = 1)"""

DOC_TOKENS = f"tokens AS (SELECT doc_id, 'text' AS field, {toks('text')} AS ts FROM documents)"
PAPER_TOKENS = f"""{LATEST}, tokens AS (
  SELECT paper_key AS doc_id, 'title' AS field, {toks('title')} AS ts FROM latest UNION ALL
  SELECT paper_key, 'abstract', {toks('abstract')} FROM latest)"""


def scored(words: list[str], boosts: dict[str, float] | None = None) -> str:
    """CTEs ``p`` (postings) and ``s`` (doc_id, field, term, score) over ``tokens``."""
    terms = ", ".join(f"('{w}')" for w in words)
    boost = "CASE field " + " ".join(f"WHEN '{f}' THEN {b}::double" for f, b in (boosts or {}).items()) + " ELSE 1.0::double END" if boosts else "1.0::double"
    return f"""q(term) AS (VALUES {terms}),
p AS (SELECT doc_id, field, term, len(list_filter(ts, lambda t: t = term)) AS tf, len(ts) AS dl FROM tokens, q WHERE list_contains(ts, term)),
st AS (SELECT field, count(*) AS n, avg(len(ts)) AS avgdl FROM tokens WHERE len(ts) > 0 GROUP BY field),
dfs AS (SELECT field, term, count(*) AS df FROM p GROUP BY ALL),
s AS (SELECT doc_id, field, term, ln(1 + (n - df + 0.5::double) / (df + 0.5::double)) * tf / (tf + 1.2::double * (0.25::double + 0.75::double * dl / avgdl)) * {boost} AS score
      FROM p JOIN dfs USING (field, term) JOIN st USING (field))"""


def matched(required: int = 1, tie: float = 0.3) -> str:
    return f"""pt AS (SELECT doc_id, term, max(score) + {tie}::double * (sum(score) - max(score)) AS score FROM s GROUP BY ALL),
m AS (SELECT doc_id, sum(score) AS score FROM pt GROUP BY doc_id HAVING count(*) >= {required})"""


def top(name: str, k: int, digits: int = 6) -> str:
    return f"""(SELECT row_number() OVER (ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM
  (SELECT doc_id, round(score, {digits}) AS score FROM {name}) ORDER BY rank LIMIT {k})"""
