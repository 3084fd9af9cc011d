"""Pages made of repeated keywords, search phrases, links or product tags."""

from __future__ import annotations

import gc
import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain, compress

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_INVISIBLE = re.compile("[​-‏⁠﻿­]")
_END = re.compile(r"[.!?…。।][\"')\]]*$")
_SENTENCE = re.compile(r"[.!?…。।][\"')\]]* ")
_MARK = re.compile(r"[,;|·•›»/:()\[\]<>=]")
_TOKEN = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[^\W\d_A-Z]+|\d+|[^\w\s]|_")

#: Words of the longest piece that is judged as one; longer runs without a sentence end are cut.
PIECE = 40
#: Share of a sentence's characters covered by its own repeated substrings from which it is stuffed.
STUFFED = 0.4
#: Share of characters covered by the page's repeated substrings from which text without clauses is a list.
LISTED = 0.05
#: Fewest tokens of a substring whose repeats cover characters.
LEAST = 2
#: Text without clauses of at most this many words, in one piece, may be a title: its repeats must cover ``TITLE`` of it.
SHORT, TITLE = 20, 0.3
#: Words whose parts are remembered.
MEMO = 1 << 17


class SuffixAutomaton:
    """Suffix automaton of a sequence, online.

    ``end[i]`` is the state of the prefix that ends at place i. The substrings
    of a state are those longer than its link's longest, up to ``length``; they
    occur more than once exactly if another state links to it (``again``).
    """

    def __init__(self, seq: list) -> None:
        # the state of a prefix goes on to the next prefix; that step is kept apart, so most states need no dictionary
        most = 2 * len(seq) + 2
        nxt: list = [None] * most
        step: list = [None] * most
        link, length, again, to, end = [0] * most, [0] * most, bytearray(most), [0] * most, []
        nxt[0], link[0] = {}, -1
        last, free = 0, 1
        for c in seq:
            cur = free
            free += 1
            length[cur] = length[last] + 1
            if last:
                step[last], to[last] = c, cur
                p = link[last]
            else:
                p = 0
            while p >= 0:
                if step[p] == c:
                    q = to[p]
                else:
                    t = nxt[p]
                    if t is None:
                        nxt[p] = {c: cur}
                        p = link[p]
                        continue
                    if c not in t:
                        t[c] = cur
                        p = link[p]
                        continue
                    q = t[c]
                long = length[p] + 1
                if long == length[q]:
                    again[q] = 1
                else:
                    clone = free
                    free += 1
                    t = {} if nxt[q] is None else nxt[q].copy()
                    if step[q] is not None:
                        t[step[q]] = to[q]
                    nxt[clone], link[clone], length[clone], again[clone] = t, link[q], long, 1
                    while p >= 0 and (t := nxt[p]) is not None and t.get(c) == q:
                        t[c] = clone
                        p = link[p]
                    link[q] = q = clone
                link[cur] = q
                break
            last = cur
            end.append(cur)
        self.link, self.length, self.again, self.end = link, length, again, end

    def repeats(self) -> list[int]:
        """Length of the longest substring that ends at each place and occurs elsewhere too."""
        link, length, again = self.link, self.length, self.again
        return [length[s] if again[s] else length[link[s]] for s in self.end]


def covered(seq: list, least: int = LEAST) -> bytearray:
    """Places of ``seq`` covered by its repeated maximal substrings of at least ``least`` elements."""
    longest = SuffixAutomaton(seq).repeats()
    n = len(longest)
    if n > 128:
        places, k = np.arange(n), np.array(longest)
        starts = np.where(k >= least, places - k + 1, n)
        return bytearray(places >= np.minimum.accumulate(starts[::-1])[::-1])
    out, low = bytearray(n), n
    for i in range(n - 1, -1, -1):
        k = longest[i]
        if k >= least and i - k + 1 < low:
            low = i - k + 1
        if i >= low:
            out[i] = 1
    return out


def segments(text: str) -> list[list[str]]:
    """Sentences or lines as lists of words; a line that goes on in lower case is joined, a long run cut into pieces."""
    runs: list[list[str]] = []
    open_ = False
    for line in text.splitlines():
        w = line.split()
        if not w:
            open_ = False
            continue
        if open_ and w[0][0].islower():
            runs[-1] += w
        else:
            runs.append(w)
        tail = runs[-1][-1]
        open_ = len(runs[-1]) >= 6 and not _END.search(tail) and not _MARK.match(tail[-1])
    out = []
    for r in runs:
        line, begin = " ".join(r), 0
        for end in [m.end() for m in _SENTENCE.finditer(line)] + [len(line)]:
            w = line[begin:end].split()
            begin = end
            if len(w) <= PIECE:
                out.append(w)
            else:
                out += [w[i : i + PIECE] for i in range(0, len(w), PIECE)]
    return [w for w in out if w]


class Lexicon:
    """Parts of words, remembered up to a bound: ``(tokens, marks, short)`` of a word, tokens as small numbers, ``chars`` of a token.

    Tokens are lower-cased runs of letters (also inside CamelCase), numbers, all alike, and single marks.
    """

    def __init__(self) -> None:
        self.words: dict[str, tuple[tuple[int, ...], int, int]] = {}
        self.tokens: dict[str, int] = {}
        self.chars: list[int] = []
        self.line = self._token("\n")

    def _token(self, t: str) -> int:
        t = "0" if t.isdigit() else t.lower()
        n = self.tokens.get(t)
        if n is None:
            n = self.tokens[t] = len(self.chars)
            self.chars.append(len(t))
        return n

    def read(self, words: list[str]) -> list[tuple[tuple[int, ...], int, int]]:
        known = self.words
        out = list(map(known.get, words))
        if None in out:
            for i, w in enumerate(words):
                if out[i] is None:
                    out[i] = known[w] = (tuple(map(self._token, _TOKEN.findall(w))), len(_MARK.findall(w)), int(len(w) < 4 and w.isalpha()))
        return out

    def fresh(self) -> "Lexicon":
        """Itself, or an empty one where it has grown too large; between pages only, as tokens are numbers."""
        return self if len(self.words) < MEMO else Lexicon()

    def size(self, tokens: list[int], places: bytearray | None = None) -> int:
        """Characters of tokens, or of those at marked places."""
        return sum(map(self.chars.__getitem__, tokens if places is None else compress(tokens, places)))


def is_clause(words: list[str], parts: list[tuple[tuple[int, ...], int, int]]) -> bool:
    """The form of a sentence, in any language with letters: at least four words, few marks of a list, some words of at most three letters.

    Without a sentence end it takes ten words, hardly a mark and more short words. ``parts`` are what :meth:`Lexicon.read` tells of the words.
    """
    n = len(words)
    if n < 4:
        return False
    marks, short = sum([r[1] for r in parts]), sum([r[2] for r in parts])
    if marks * 3 > n:
        return False
    if _END.search(words[-1]):
        return short >= 0.08 * n
    return n >= 10 and marks * 10 <= n and short >= 0.2 * n


def is_stuffed(tokens: list[int], lexicon: Lexicon) -> bool:
    """Its own repeated substrings, or words of more than three letters said three times, cover ``STUFFED`` of its characters."""
    places = covered(tokens)
    often = {t for t, n in Counter(tokens).items() if n > 2 and lexicon.chars[t] > 3}
    if often:
        for i, t in enumerate(tokens):
            if t in often:
                places[i] = 1
    return lexicon.size(tokens, places) >= STUFFED * lexicon.size(tokens)


def page_scores(text: str | None, lexicon: Lexicon | None = None) -> tuple[int, int, float, float, bool]:
    """``(words, spam words, covered share of the page, covered share of what has no clauses, is a case)``.

    One suffix automaton holds the page's tokens; its repeated maximal
    substrings cover characters. Segments without the form of a clause are spam if such substrings cover
    at least ``LISTED`` of their characters together (``TITLE`` for a single short one), a sentence if its own do
    ``STUFFED`` of its characters. The page is a case if spam holds more than half of its words.
    """
    lexicon = lexicon or Lexicon()
    text = text or ""
    segs = segments(text if text.isascii() else _INVISIBLE.sub("", text))
    total = sum(map(len, segs))
    if not total:
        return 0, 0, 0.0, 0.0, False
    parts = [lexicon.read(w) for w in segs]
    tokens = [[*chain.from_iterable([r[0] for r in x]), lexicon.line] for x in parts]
    page = list(chain.from_iterable(tokens))
    places, chars = covered(page), list(map(lexicon.chars.__getitem__, page))
    at = bare = pieces = bare_chars = bare_covered = stuffed = 0
    for w, x, s in zip(segs, parts, tokens, strict=True):
        if not is_clause(w, x):
            bare += len(w)
            pieces += 1
            bare_chars += sum(chars[at : at + len(s)])
            bare_covered += sum(compress(chars[at : at + len(s)], places[at : at + len(s)]))
        elif len(set(s)) <= 0.8 * len(s) and is_stuffed(s[:-1], lexicon):
            stuffed += len(w)
        at += len(s)
    share = sum(compress(chars, places)) / sum(chars)
    listed = bare_covered / bare_chars if bare_chars else 0.0
    spam = stuffed + (bare if listed >= (TITLE if pieces == 1 and bare <= SHORT else LISTED) else 0)
    return total, spam, share, listed, spam * 2 > total


def score_pages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_words, spam_words, repeated_share, listed_share, is_spam``.

    Whole texts are read and every page's automaton is built. Words are runs of non-space characters; null, empty
    and blank texts have none and are no cases. Repeated rows are scored alike.
    No shuffle: pages are scored where they are read.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicon = Lexicon()
        gc.disable()  # automata have no cycles, and their many small parts set the collector off all the time
        for pdf in batches:
            rows = [page_scores(t, lexicon := lexicon.fresh()) for t in pdf["text"]]
            out = pd.DataFrame(rows, columns=["n_words", "spam_words", "repeated_share", "listed_share", "is_spam"])
            out.insert(0, "doc_id", pdf["doc_id"].to_numpy())
            yield out
        gc.enable()

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInPandas(
        run, "doc_id long, n_words long, spam_words long, repeated_share double, listed_share double, is_spam boolean"
    )
