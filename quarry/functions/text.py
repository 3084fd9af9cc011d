"""Analyzers and text expressions."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions.normal import col

# The stop words that never count as query terms.
STOP_WORDS = (
    "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with"
).split()

# American and British spellings of one word.
SPELLINGS = [
    ("color", "colour"), ("favor", "favour"), ("honor", "honour"), ("humor", "humour"), ("labor", "labour"), ("neighbor", "neighbour"), ("vapor", "vapour"),
    ("fiber", "fibre"), ("center", "centre"), ("liter", "litre"), ("meter", "metre"), ("caliber", "calibre"), ("theater", "theatre"), ("defense", "defence"),
    ("offense", "offence"), ("license", "licence"), ("practice", "practise"), ("analyze", "analyse"), ("catalyze", "catalyse"), ("optimize", "optimise"),
    ("recognize", "recognise"), ("characterize", "characterise"), ("minimize", "minimise"), ("maximize", "maximise"), ("utilize", "utilise"), ("realize", "realise"),
    ("organize", "organise"), ("stabilize", "stabilise"), ("polymerize", "polymerise"), ("synthesize", "synthesise"), ("oxidize", "oxidise"), ("ionize", "ionise"),
    ("polarize", "polarise"), ("crystallize", "crystallise"), ("paralyze", "paralyse"), ("modeling", "modelling"), ("traveling", "travelling"),
    ("labeling", "labelling"), ("canceling", "cancelling"), ("aluminum", "aluminium"), ("sulfur", "sulphur"), ("aging", "ageing"), ("gray", "grey"),
]


def terms(c: str | Column) -> Column:
    """Lower-case runs of letters and digits of any script, in order; null text has none."""
    return F.filter(F.split(F.lower(F.coalesce(col(c), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def query_terms(query: str) -> list[str]:
    """Distinct terms of a query in order; stop words do not count unless there is nothing else."""
    words = list(dict.fromkeys(re.findall(r"[^\W_]+", query.lower())))
    return [w for w in words if w not in STOP_WORDS] or words


def required_matches(n: int, strict: bool = False) -> int:
    """Up to three content terms (or strict): all; more: three quarters, at least three."""
    return n if strict or n <= 3 else max(3, -(-3 * n // 4))


def spelling_variant(word: str) -> str | None:
    """The other spelling of a word or of the word it begins with; the first pair that fits counts."""
    w = word.lower()
    for pair in SPELLINGS:
        whole = [y for x, y in (pair, pair[::-1]) if w == x] or [y + w[len(x) :] for x, y in (pair, pair[::-1]) if w.startswith(x)]
        if whole:
            return whole[0]
    return None


def with_variants(words: list[str]) -> dict[str, str]:
    """Spelling variants of words that are not words themselves, each with the word it stands for."""
    return {v: w for w in words if (v := spelling_variant(w)) and v not in words}


def swapped(word: str) -> list[str]:
    """The words one swap of adjacent letters away."""
    return sorted({word[:i] + word[i + 1] + word[i] + word[i + 2 :] for i in range(len(word) - 1)} - {word})


def edits_to(t: Column, word: str) -> Column:
    """Edits between a term and a word, a swap of adjacent letters counting as one where it is all that parts them."""
    d = F.levenshtein(t, F.lit(word))
    near = swapped(word)
    return F.when(t.isin(near), F.least(d, F.lit(1))).otherwise(d) if near else d


def fold_plural(t: Column) -> Column:
    """Plural-only folding: -ies to -y, -es and -s dropped where that is safe."""
    return (
        F.when((F.length(t) > 4) & t.endswith("ies") & ~t.rlike("[ae]ies$"), F.concat(F.substr(t, F.lit(1), F.length(t) - 3), F.lit("y")))
        .when((F.length(t) > 3) & t.endswith("es") & ~t.rlike("[aeo]es$"), F.substr(t, F.lit(1), F.length(t) - 1))
        .when((F.length(t) > 3) & t.endswith("s") & ~t.rlike("[us]s$"), F.substr(t, F.lit(1), F.length(t) - 1))
        .otherwise(t)
    )


def edge_ngrams(t: Column, least: int = 2, most: int = 10) -> Column:
    """Prefixes of a term; a term shorter than ``least`` has none."""
    n = F.least(F.lit(most), F.length(t))
    return F.when(n >= least, F.transform(F.sequence(F.lit(least), n), lambda k: F.substr(t, F.lit(1), k))).otherwise(F.array().cast("array<string>"))


def char_ngrams(t: Column, n: int = 3) -> Column:
    k = F.length(t) - n + 1
    return F.when(k >= 1, F.transform(F.sequence(F.lit(1), k), lambda i: F.substr(t, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def shingles(ts: Column, n: int = 2) -> Column:
    """Runs of ``n`` adjacent terms joined by blanks."""
    k = F.size(ts) - n + 1
    return F.when(k >= 1, F.transform(F.sequence(F.lit(1), k), lambda i: F.array_join(F.slice(ts, i, n), " "))).otherwise(F.array().cast("array<string>"))


#: Private-use marks around highlighted words.
OPEN, CLOSE = "", ""


def highlight(c: str | Column, words: list[str]) -> Column:
    """Whole text with whole-word, case-insensitive matches between marks; null without a match."""
    if not words:
        return F.lit(None).cast("string")
    pattern = r"(?i)\b(" + "|".join(sorted(map(re.escape, words), key=lambda w: (-len(w), w))) + r")\b"
    return F.when(col(c).rlike(pattern), F.regexp_replace(col(c), pattern, f"{OPEN}$1{CLOSE}"))


def slugify(c: str | Column) -> Column:
    """``&`` becomes "and", other runs of non-alphanumerics one dash, none at the ends."""
    s = F.regexp_replace(F.lower(col(c)), "&", " and ")
    return F.regexp_replace(F.regexp_replace(s, "[^a-z0-9]+", "-"), "^-+|-+$", "")


def edit_allowance(length: Column) -> Column:
    """Edits an automatically fuzzy term may differ by: 0 up to two letters, 1 up to five, else 2."""
    return F.when(length <= 2, 0).when(length <= 5, 1).otherwise(2)


# --- Porter stemmer (published algorithm), for the analysed fields -----------------------------------

_VOWELS = "aeiou"


def _cons(w: str, i: int) -> bool:
    return not (w[i] in _VOWELS or (w[i] == "y" and i > 0 and _cons(w, i - 1)))


def _measure(w: str) -> int:
    form = "".join("c" if _cons(w, i) else "v" for i in range(len(w)))
    return len(re.findall("v+c+", form))


def _has_vowel(w: str) -> bool:
    return any(not _cons(w, i) for i in range(len(w)))


def _cvc(w: str) -> bool:
    return len(w) >= 3 and _cons(w, len(w) - 3) and not _cons(w, len(w) - 2) and _cons(w, len(w) - 1) and w[-1] not in "wxy"


# The suffix lists of the published algorithm's steps 2 to 4.
_STEP2 = "ational ate,tional tion,enci ence,anci ance,izer ize,abli able,alli al,entli ent,eli e,ousli ous,ization ize,ation ate,ator ate,alism al,iveness ive,fulness ful,ousness ous,aliti al,iviti ive,biliti ble"
_STEP3 = "icate ic,ative ,alize al,iciti ic,ical ic,ful ,ness "
_STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def porter_stem(w: str) -> str:
    if len(w) <= 2:
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    cut = False
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    elif w.endswith("ed") and _has_vowel(w[:-2]):
        w, cut = w[:-2], True
    elif w.endswith("ing") and _has_vowel(w[:-3]):
        w, cut = w[:-3], True
    if cut:
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif len(w) >= 2 and w[-1] == w[-2] and _cons(w, len(w) - 1) and w[-1] not in "lsz":
            w = w[:-1]
        elif _measure(w) == 1 and _cvc(w):
            w += "e"
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    for table in (_STEP2, _STEP3):
        for pair in sorted(table.split(","), key=lambda p: -len(p.split(" ")[0])):
            a, b = pair.split(" ")
            if w.endswith(a):
                if _measure(w[: -len(a)]) > 0:
                    w = w[: -len(a)] + b
                break
    for a in sorted(_STEP4, key=len, reverse=True):
        if w.endswith(a):
            stem = w[: -len(a)]
            if _measure(stem) > 1 and (a != "ion" or stem.endswith(("s", "t"))):
                w = stem
            break
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _cvc(w[:-1])):
            w = w[:-1]
    if w.endswith("ll") and _measure(w[:-1]) > 1:
        w = w[:-1]
    return w


def english(ts: str | Column) -> Column:
    """Stemmed terms of an array of terms, stop words removed; a bounded memo keeps each word's stem."""
    stop = frozenset(STOP_WORDS)

    @F.pandas_udf("array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        kept: dict[str, str] = {}
        for s in batches:
            out = []
            for words in s:
                row = []
                for w in words if words is not None else ():
                    if w in stop:
                        continue
                    r = kept.get(w)
                    if r is None:
                        if len(kept) > 1 << 18:
                            kept.clear()
                        r = kept[w] = porter_stem(w)
                    row.append(r)
                out.append(row)
            yield pd.Series(out, dtype=object)

    return run(col(ts))
