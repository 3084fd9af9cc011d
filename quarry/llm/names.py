"""Variant spellings of names: metric-space join of surnames, then compatible given names.

Names are parsed into a surname, a given name (or only its initial) and a middle
initial. Surnames with the same given initial are joined within an edit radius by
metric-space partitioning: every surname goes to the cell of its nearest pivot,
boundary surnames are copied to each cell the triangle inequality cannot rule
out, and cells run an exact radius join with the Levenshtein metric. Joined
signatures whose given names and middle initials agree are linked; a signature
with less detail joins a richer one only where just one fits.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.normal import norm_key
from quarry.operators.components import connected_components
from quarry.session import checkpoint

# Titles and honorifics that are no part of a name.
TITLES = frozenset("prof professor dr er mr mrs ms miss sir shri smt phd md".split())
# Particles that belong to the word after them.
PARTICLES = frozenset("de el al van von da di del la bin ibn der den du le dos ben abu".split())
# Kinds of author groups.
KINDS = ("consortium", "collaboration", "network", "workinggroup", "group", "team", "committee", "initiative", "project", "institute", "laboratory")
# Everyday short names that are no prefix of the full one.
NICKNAMES = {
    "paco": "francisco", "pepe": "jose", "bob": "robert", "bobby": "robert", "bill": "william", "will": "william", "billy": "william", "dick": "richard", "rick": "richard",
    "kathy": "katherine", "kate": "katherine", "katie": "katherine", "cathy": "catherine", "beth": "elizabeth", "liz": "elizabeth", "lizzie": "elizabeth", "betty": "elizabeth",
    "peggy": "margaret", "maggie": "margaret", "meg": "margaret", "jim": "james", "jimmy": "james", "jack": "john", "johnny": "john", "tony": "anthony", "mike": "michael",
    "benny": "benjamin", "sasha": "alexander", "alex": "alexander", "sandy": "alexander", "hans": "johannes", "lena": "helena", "kolya": "nikolai", "misha": "mikhail", "nastya": "anastasia",
    "natasha": "natalia", "zhenya": "yevgeny", "urvi": "urvashi", "annie": "anne", "ted": "theodore", "teddy": "theodore", "harry": "henry", "chuck": "charles", "charlie": "charles",
    "nate": "nathaniel", "steve": "stephen", "stevie": "stephanie", "becky": "rebecca", "debbie": "deborah", "sue": "susan", "max": "maximilian", "fritz": "friedrich", "nacho": "ignacio",
}

#: Radius of the metric join, in edits of a folded surname.
RADIUS = 2
#: Pivots of the metric space: one more for this many words, within bounds.
WORDS_A_PIVOT, LEAST_PIVOTS, MOST_PIVOTS = 20_000, 8, 256
#: Words longer than this are joined on unchanged pieces instead of in cells.
LONGEST = 40
#: A surname from this length on may have gained or lost a particle.
LONG = 8
#: Longest author list that each of its members carries along; of longer ones they carry the name. At least two.
CREW = 100
#: Pairs of keys of two signatures, and papers of a key, up to which company is compared as lists.
FEW, CROWD = 1024, 10_000
#: A key is little known with at most this many papers in company.
LITTLE = 1
#: Home surnames of a cell that one task joins.
CELL = 4096
#: A given name is common from this share of the names with a certain order, so there are at most 1 / COMMON of them.
COMMON = 0.001


def _memo(f: Callable) -> Callable:
    """Remember results, up to a bound; unlike the library's cache it travels to executors by value."""
    kept: dict = {}

    def g(x):
        if x in kept:
            return kept[x]
        if len(kept) > 1 << 16:
            kept.clear()
        r = kept[x] = f(x)
        return r

    return g


@_memo
def _plain(s: str) -> str:
    if "0" in s or "1" in s:
        s = re.sub(r"(?<=[^\W\d_])0|0(?=[^\W\d_])", "o", s)
        s = re.sub(r"(?<=[^\W\d_])1|1(?=[^\W\d_])", "l", s)
    if s.isascii():
        return s.lower()
    s = s.replace("ø", "o").replace("Ø", "O").replace("ß", "ss").replace("ł", "l").replace("đ", "d").replace("æ", "ae")
    return "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c)).lower()


_DOUBLE = re.compile(r"(.)\1+")


@_memo
def fold(s: str) -> str:
    """Letters only, common transliterations of one sound made equal, double letters single."""
    s = re.sub(r"[^a-z]", "", _plain(s))
    for a, b in (("ph", "f"), ("ck", "k"), ("q", "k"), ("w", "v"), ("ee", "i"), ("oo", "u")):
        s = s.replace(a, b)
    return _DOUBLE.sub(r"\1", s)


@_memo
def fold_surname(s: str) -> str:
    """``fold`` with letters that are misread for each other made equal: rn for m, cl for d."""
    return _DOUBLE.sub(r"\1", fold(s).replace("rn", "m").replace("cl", "d"))


@_memo
def _given(s: str) -> str:
    g = re.sub(r"[^a-z]", "", _plain(s))
    return fold(NICKNAMES.get(g, g))


def _edits_within(a: str, b: str, r: int) -> bool:
    if abs(len(a) - len(b)) > r:
        return False
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (x != y)))
        prev = cur
    return prev[-1] <= r


_KIND_LETTERS = frozenset(k[0] for k in KINDS)
_GLUED = re.compile(r"(?<=[^\W\d_A-Z]{3})(?=[A-Z])")


@_memo
def _kind_of(w: str) -> str | None:
    """The kind of group a word names, cut short or mistyped after its first letter."""
    if w[0] not in _KIND_LETTERS:
        return None
    for k in KINDS:
        if w == k or (len(w) >= 4 and k.startswith(w)) or (w[0] == k[0] and len(w) >= 6 and len(k) >= 6 and len(set(w) - set(k)) <= 2 and _edits_within(w, k, 2)):
            return k
    return None


def parse_group(raw: str) -> tuple[str, str, str, str] | None:
    """Signature of an author group: kind initial, sorted content words, kind (empty for acronyms), no middle."""
    if "(" not in raw and raw.count(" ") + raw.count("-") < 2:
        return None
    text = _plain(raw)
    m = re.fullmatch(r"\s*([a-z]{2,6})\s*\(([^()]+)\)\s*", text)
    if m:
        words = re.findall(r"[a-z]+", m.group(2))
        if len(words) < len(m.group(1)):
            return ("#" + m.group(1)[-1], "".join(sorted(fold(w) for w in words)), "", "")
        return None
    words = [w for w in re.findall(r"[a-z]+", text) if w not in ("the", "for", "at", "of", "on", "and", "in")]
    if len(words) < 3:
        return None
    joined: list[str] = []
    i = 0
    while i < len(words):
        if i + 1 < len(words) and words[i][0] == "w" and words[i + 1][0] == "g" and _edits_within(words[i], "working", 2) and _edits_within(words[i + 1], "group", 2):
            joined.append("workinggroup")
            i += 2
        else:
            joined.append(words[i])
            i += 1
    kinds = [k for w in joined if (k := _kind_of(w))]
    rest = [w for w in joined if not _kind_of(w)]
    if not kinds or len(joined) < 3 or not rest:
        return None
    return ("#" + kinds[0][0], "".join(sorted(fold(w) for w in rest)), fold(kinds[0]), "")


#: How the alternatives of a parsed name are to be read.
CERTAIN, EITHER, SWAP = 0, 1, 2

Sig = tuple[str, str, str, str]


def parse_name(raw: str, structured: bool = False, plain: bool = False) -> tuple[int, list[Sig]]:
    """Reading and alternatives ``(initial, surname, given, middle)`` of a name as typed.

    ``CERTAIN`` has one alternative, ``EITHER`` two bare words in both orders,
    ``SWAP`` a name in two columns ("last, first") and the same swapped. An
    unreadable name has none. A name of only one word is read again with
    particles and "Md." as words and glued words apart (``plain``).
    """
    s = re.sub("[​‌‍⁠﻿]", "", raw).strip()
    group = parse_group(s.replace(",", " ") if structured else s)
    if group:
        return CERTAIN, [group]
    lower = any(c.islower() for c in s)
    parts: list[list[tuple[str, str]]] = []
    for part in s.split(","):
        out: list[tuple[str, str]] = []
        hold = ""
        part = re.sub(r"(?<=[^\W\d_])\.(?=\S)", ". ", part)
        for w in (_GLUED.sub(" ", part) if plain else part).split():
            core = w.strip(".;:()'\"")
            n = re.sub(r"[^a-z-]", "", _plain(core))
            if not n.strip("-") or (n in TITLES and not (plain and n == "md")):
                continue
            if len(n) == 1:
                out.append(("i", n))
            elif lower and core.isupper() and len(core) <= 3:
                out.extend(("i", c) for c in n if c != "-")
            elif n.rstrip("-") in PARTICLES and not plain:
                hold += n
            else:
                out.append(("f", hold + core))
                hold = ""
        if hold:
            out.append(("f", hold))
        if out:
            parts.append(out)
    items = [x for p in parts for x in p]
    full = [w for k, w in items if k == "f"]
    initials = [w for k, w in items if k == "i"]
    if not full:
        return CERTAIN, []

    def sig(surname: str, given: str, rest: list[str]) -> list[Sig]:
        sur, g = fold_surname(surname), _given(given) if given else ""
        if given:
            first, mids = g[:1], rest
        else:
            first, mids = (fold(rest[0])[:1] or rest[0][:1] if rest else ""), rest[1:]
        if not sur or not first:
            return []
        return [(first, sur, g, "".join(fold(m)[:1] or m[:1] for m in mids[:1]))]

    if len(full) == 1:
        if initials:
            return CERTAIN, sig(full[0], "", initials)
        return (CERTAIN, []) if plain else parse_name(raw, structured, True)
    if len(parts) > 1:
        last = [w for k, w in parts[0] if k == "f"]
        first = [w for p in parts[1:] for k, w in p if k == "f"]
        if last and first:
            straight = sig(" ".join(last), first[0], first[1:] + initials)
            if structured:
                swapped = sig(first[-1], last[0], last[1:] + initials)
                return (SWAP, straight + swapped) if straight and swapped else (CERTAIN, straight)
            return CERTAIN, straight
        if last and structured:
            return CERTAIN, sig(last[-1], last[0], initials)
    mid = full[1:-1] + initials
    forward, backward = sig(full[-1], full[0], mid), sig(full[0], full[-1], mid)
    if initials and len(full) == 2:
        return CERTAIN, backward if items[-1][0] == "i" else forward
    return (EITHER, forward + backward) if forward and backward else (CERTAIN, forward or backward)


def resolve(parsed: list[tuple[int, list[Sig]]], known: frozenset[str]) -> list[Sig]:
    """Signatures of one key from all its spellings.

    Common given names (``known``) decide the order of words, else both stay.
    Initials are dropped where another spelling tells the given name, and a
    spelling without a middle initial takes the sole one of the others.
    """
    sigs: set[Sig] = set()
    for kind, alts in parsed:
        if kind == CERTAIN or len(alts) < 2:
            sigs.update(alts[:1])
            continue
        a, b = alts[0][2] in known, alts[1][2] in known
        if kind == SWAP and a and b:
            sigs.add(alts[0])
        else:
            sigs.update(alts[:1] if a and not b else alts[1:] if b and not a else alts)
    mids: dict[str, set[str]] = {}
    for i, _, _, m in sigs:
        if m:
            mids.setdefault(i, set()).add(m)
    full = [t for t in sigs if t[2]]
    out = {(i, s, g, m or (next(iter(mids[i])) if len(mids.get(i, ())) == 1 else "")) for i, s, g, m in (full or sigs)}
    return sorted(out)


def _codes(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    if not len(strings):
        return np.zeros((0, 1), dtype=np.uint8), np.zeros(0, dtype=np.int16)
    packed = np.asarray(strings, dtype=bytes)
    out = packed.view(np.uint8).reshape(len(packed), max(1, packed.dtype.itemsize))
    return out, np.char.str_len(packed).astype(np.int16)


def edit_distances(xs: list[str], ys: list[str]) -> np.ndarray:
    """Levenshtein distances of all ``xs`` to all ``ys`` (folded, ASCII), row by row over both lists at once."""
    a, la = _codes(xs)
    b, lb = _codes(ys)
    s, p = len(xs), len(ys)
    out = np.zeros((s, p), dtype=np.int16)
    prev = [np.full((s, p), j, dtype=np.uint8) for j in range(b.shape[1] + 1)]
    for i in range(a.shape[1] + 1):
        if i:
            cur = [np.full((s, p), i, dtype=np.uint8)]
            for j in range(1, b.shape[1] + 1):
                step = prev[j - 1] + (a[:, i - 1, None] != b[None, :, j - 1])
                np.minimum(step, prev[j] + 1, out=step, casting="unsafe")
                np.minimum(step, cur[j - 1] + 1, out=step, casting="unsafe")
                cur.append(step)
            prev = cur
        done = np.flatnonzero(la == i)
        if len(done):
            for j in np.unique(lb):
                cols = np.flatnonzero(lb == j)
                out[np.ix_(done, cols)] = prev[j][np.ix_(done, cols)]
    return out


def radius_join(words: DataFrame, group: str, word: str, radius: int = RADIUS, pivots: int | None = None, seed: int = 5) -> DataFrame:
    """Pairs ``group, x, y, d`` with ``x < y`` in the same group and ``d <= radius`` edits, exactly.

    ``words`` is deduplicated first. Each word's home is the cell of its nearest
    pivot p (ties: first pivot). A partner y of a word x with home p lies within
    ``d(y, p) <= d(x, p) + radius`` and, as p is nearest to x, within the nearest
    pivot distance of y plus twice the radius; y is copied to the cells where
    both hold, the first with the largest home distance of that cell. As both words
    of a pair reach the other's cell, only one of the two cells gets the copies. Cells with
    many home words are cut into blocks that each see the copies. Pivots are a
    seeded sample of bounded size. Pairs with a word longer than ``LONGEST`` come from :func:`long_pairs`.
    """
    every = words.select(F.col(group).alias("g"), F.col(word).alias("w")).where(F.col("w").isNotNull()).distinct()
    distinct = every.where(F.length("w") <= LONGEST)
    names = distinct.select("w").distinct()
    pivots = pivots or min(MOST_PIVOTS, LEAST_PIVOTS + names.count() // WORDS_A_PIVOT)
    chosen = [r[0] for r in names.orderBy(F.xxhash64("w", F.lit(seed)), "w").limit(pivots).collect()]
    schema = "g string, x string, y string, d int"
    if not chosen:
        return long_pairs(every, radius)

    @F.pandas_udf("array<smallint>")
    def to_pivots(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            rows = [r for at in range(0, len(s), 1024) for r in edit_distances(s.iloc[at : at + 1024].tolist(), chosen)]
            yield pd.Series(rows, dtype=object)

    placed = checkpoint(names.withColumn("dv", to_pivots("w")).withColumn("near", F.array_min("dv")).withColumn("home", F.array_position("dv", F.col("near")).cast("int") - 1))
    # one number per pivot
    reach = {r["home"]: r["m"] for r in placed.groupBy("home").agg(F.max("near").alias("m")).collect()}
    limits = F.array(*[F.lit(int(reach.get(i, -10 * radius - LONGEST)) + radius) for i in range(len(chosen))])
    # of two cells the one of the lower number has their pairs if the sum is odd, else the other
    mine = lambda i: (i == F.col("home")) | (((i + F.col("home")) % 2 == 1) == (i < F.col("home")))
    cells = F.filter(
        F.transform("dv", lambda d, i: F.when((d <= F.col("near") + 2 * radius) & (d <= F.element_at(limits, i + 1)) & mine(i), i)), lambda i: i.isNotNull()
    )
    rows = distinct.join(placed.select("w", "home", cells.alias("cells")), "w")
    homes = rows.groupBy("g", "home").agg(F.count(F.lit(1)).alias("n"))
    blocks = homes.select("g", F.col("home").alias("cell"), F.greatest(F.lit(1), F.ceil(F.col("n") / CELL)).cast("int").alias("nb"))
    copies = rows.select("g", "w", "home", F.explode("cells").alias("cell")).join(blocks, ["g", "cell"])
    own = F.pmod(F.xxhash64("w"), F.col("nb")).cast("int")
    copies = copies.select("g", "w", (F.col("home") == F.col("cell")).alias("at_home"), "cell", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("block"))

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        ys, home = pdf["w"].to_numpy().astype(str), pdf["at_home"].to_numpy()
        found = cell_join(ys, home & (pdf["own"] == pdf["block"]).to_numpy(), home, radius)
        group = [pdf["g"].iat[0]] * len(found[2])
        return pd.DataFrame({"g": np.array(group, dtype=object), "x": np.array(found[0], dtype=object), "y": np.array(found[1], dtype=object), "d": np.array(found[2], dtype=np.int32)}).astype({c: object for c in ("g", "x", "y")})

    # cells are small in bytes and costly to join, so they are spread before the engine can put them together
    tasks = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return copies.repartition(tasks, "g", "cell", "block").groupBy("g", "cell", "block").applyInPandas(join, schema).unionByName(long_pairs(every, radius))


def long_pairs(words: DataFrame, radius: int) -> DataFrame:
    """Pairs ``g, x, y, d`` within the radius of which a word is longer than ``LONGEST``, exactly.

    Of ``radius + 1`` pieces of a word one stands unchanged in a partner, shifted by ``radius`` places at most.
    """
    near = words.where(F.length("w") > LONGEST - radius)
    of = lambda w, length, piece: F.substring(w, (piece * length / (radius + 1)).cast("int") + 1, ((piece + 1) * length / (radius + 1)).cast("int") - (piece * length / (radius + 1)).cast("int"))
    pieces = near.withColumn("n", F.length("w")).select("g", F.col("w").alias("x"), "n", F.explode(F.sequence(F.lit(0), F.lit(radius))).alias("p")).withColumn("t", of(F.col("x"), F.col("n"), F.col("p")))
    shifts = near.select("g", F.col("w").alias("y"), F.explode(F.sequence(F.length("w") - radius, F.length("w") + radius)).alias("n")).select("g", "y", "n", F.explode(F.sequence(F.lit(0), F.lit(radius))).alias("p"))
    start = (F.col("p") * F.col("n") / (radius + 1)).cast("int") + 1
    size = ((F.col("p") + 1) * F.col("n") / (radius + 1)).cast("int") + 1 - start
    shifts = shifts.select("g", "y", "n", "p", start.alias("b"), size.alias("k"), F.explode(F.sequence(F.lit(-radius), F.lit(radius))).alias("o")).where("b + o >= 1").withColumn("t", F.substring(F.col("y"), F.col("b") + F.col("o"), F.col("k")))
    pairs = pieces.join(shifts.select("g", "y", "n", "p", "t"), ["g", "n", "p", "t"]).where((F.col("x") != F.col("y")) & (F.greatest(F.length("x"), F.length("y")) > LONGEST))
    pairs = pairs.select("g", F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
    return pairs.withColumn("d", F.levenshtein("x", "y", radius)).where("d >= 0")


def _bags(codes: np.ndarray) -> np.ndarray:
    """Letter counts as unary marks, so that inner products count shared letters."""
    levels = 4
    counts = np.stack([(codes == c).sum(axis=1) for c in range(97, 123)], axis=1)
    return np.concatenate([counts > k for k in range(levels)], axis=1).astype(np.float32)


def pair_distances(a: np.ndarray, la: np.ndarray, b: np.ndarray, lb: np.ndarray, radius: int) -> np.ndarray:
    """Levenshtein distance of row k of ``a`` to row k of ``b`` for all k at once, ``radius + 1`` where it is larger.

    Only the cells within ``radius`` of the diagonal can hold a distance within it.
    """
    n = len(a)
    far = np.full(n, radius + 1, dtype=np.int8)
    out = far.copy()
    if not n:
        return out
    longest, wide = int(la.max()), int(lb.max())
    a, b = np.ascontiguousarray(a[:, :longest].T), np.ascontiguousarray(b[:, :wide].T)
    ends = set(la.tolist())
    prev = {j: np.full(n, j, dtype=np.int8) for j in range(min(radius, wide) + 1)}
    for i in range(longest + 1):
        if i:
            cur = {0: np.full(n, i, dtype=np.int8)} if i <= radius else {}
            for j in range(max(1, i - radius), min(wide, i + radius) + 1):
                step = np.minimum(prev.get(j, far), cur.get(j - 1, far))
                step += 1
                cur[j] = np.minimum(step, prev.get(j - 1, far) + (a[i - 1] != b[j - 1]), out=step)
            prev = cur
        if i in ends:
            for j, d in prev.items():
                at = (la == i) & (lb == j)
                out[at] = np.minimum(d[at], radius + 1)
    return out


def cell_join(ys: np.ndarray, first: np.ndarray, home: np.ndarray, radius: int) -> tuple[list[str], list[str], list[int]]:
    """Pairs within ``radius`` edits of a word in ``first`` and any other, the lesser word first; of two words at ``home`` the lesser must be in ``first``.

    ``first`` is part of ``home``. An edit takes one letter at most from a word and gives it one, so neither word of a pair has more than
    ``radius`` letters that the other lacks; the others are ruled out before the metric.
    """
    out: tuple[list[str], list[str], list[int]] = ([], [], [])
    if not first.any():
        return out
    order = np.argsort(ys, kind="stable")
    ys, first, home = ys[order], first[order], home[order]
    codes, lengths = _codes(ys)
    # letters beyond the fourth of a kind are not marked, which rules out less
    bags = _bags(codes)
    sizes = bags.sum(axis=1).astype(np.int64)
    bags = bags[:, bags[first].any(axis=0)]
    by_size = {n: np.flatnonzero(sizes == n) for n in np.unique(sizes).tolist()}
    for n, every in by_size.items():
        xs = every[first[every]]
        for at in range(0, len(xs), 512):
            x = xs[at : at + 512]
            for m in range(n - radius, n + radius + 1):
                near = by_size.get(m, xs[:0])
                for to in range(0, len(near), 4096):
                    y = near[to : to + 4096]
                    i, j = np.divmod(np.flatnonzero(bags[x] @ bags[y].T >= max(n, m) - radius), len(y))
                    i, j = x[i], y[j]
                    keep = ~(home[j] & (i >= j)) & (np.abs(lengths[i] - lengths[j]) <= radius)
                    i, j = i[keep], j[keep]
                    for p in range(0, len(i), 65536):
                        u, v = i[p : p + 65536], j[p : p + 65536]
                        d = pair_distances(codes[u], lengths[u], codes[v], lengths[v], radius)
                        u, v, d = u[d <= radius], v[d <= radius], d[d <= radius]
                        out[0].extend(ys[np.minimum(u, v)].tolist())
                        out[1].extend(ys[np.maximum(u, v)].tolist())
                        out[2].extend(d.tolist())
    return out


def name_rows(faculty: DataFrame, papers: DataFrame) -> DataFrame:
    """``key, raw, structured``: every spelling under every key, repeats included; ``raw`` is null or blank for a key without a name."""
    f = faculty.select(norm_key("expert_id").alias("key"), F.concat_ws(", ", F.col("lastname"), F.col("firstname")).alias("raw"), F.lit(True).alias("structured"))
    a = papers.select(F.explode("authors").alias("a")).select(norm_key("a.author_id").alias("key"), F.explode(F.array_union(F.array("a.author_name"), F.coalesce("a.author_available_names", F.array().cast("array<string>")))).alias("raw"), F.lit(False).alias("structured"))
    return f.unionByName(a).where("key IS NOT NULL")


# Parsed names travel as text, "kind;i|s|g|m;..." with the four folded parts of a signature: lists of
# records cost several times the parsing on their way between the engine and Python.
_FIELDS = ("i", "s", "g", "m")


def _parser():
    @F.pandas_udf("array<string>")
    def parse(spellings: pd.Series) -> pd.Series:
        def one(rows) -> list[str]:
            read = (parse_name(r[1:], r[0] == "1") for r in rows)
            return sorted({f"{k};" + ";".join(map("|".join, alts)) for k, alts in read if alts})

        return pd.Series([one(r) for r in spellings], dtype=object)

    return parse


def _resolver(known: frozenset[str]):
    @F.pandas_udf("array<string>")
    def run(parsed: pd.Series) -> pd.Series:
        def one(rows) -> list[str]:
            read = [(int(t[0]), [tuple(x.split("|")) for x in t[2:].split(";")]) for t in rows]
            return list(map("|".join, resolve(read, known)))

        return pd.Series([one(r) for r in parsed], dtype=object)

    return run


def _given_fits(g1: Column, g2: Column) -> Column:
    short = F.least(F.length(g1), F.length(g2))
    d = F.levenshtein(g1, g2)
    return (g1 == g2) | ((short >= 3) & (g1.startswith(g2) | g2.startswith(g1))) | ((short >= 4) & (d <= 1)) | ((short >= 6) & (d <= 2))


def _one_sound(g: Column) -> Column:
    return F.translate(g, "c", "k")


def _is_swap(x: str, y: str) -> Column:
    return (F.length(x) == F.length(y)) & (F.array_sort(F.split(x, "")) == F.array_sort(F.split(y, "")))


def _both_ways(pairs: DataFrame, a: str, b: str, *rest: str) -> DataFrame:
    two = F.array(F.struct(F.col(a).alias("a"), F.col(b).alias("b")), F.struct(F.col(b).alias("a"), F.col(a).alias("b")))
    return pairs.select(F.explode(two).alias("two"), *rest).select(F.col("two.a").alias(a), F.col("two.b").alias(b), *rest)


def given_pairs(kinds: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Pairs ``g1, g2, bare`` of different given names that may be one, each once.

    Within the radius: one edit from four letters on, two from six; names with
    different initials one edit or swap apart from five letters on, or of one
    sound. One cut short from three letters on. Two different common names never fit, but for
    one sound; one cut short of another common name fits only beside other evidence (``bare``).
    """
    words = kinds.where("g <> '' AND i NOT LIKE '#%'").select("g", "c").distinct()
    near = radius_join(words.select(F.lit("").alias("one"), "g"), "one", "g", radius)
    least = F.least(F.length("x"), F.length("y"))
    sound = _one_sound(F.col("x")) == _one_sound(F.col("y"))
    same_initial = F.substring("x", 1, 1) == F.substring("y", 1, 1)
    fits = F.when(same_initial, ((least >= 4) & (F.col("d") <= 1)) | (least >= 6)).otherwise((least >= 5) & ((F.col("d") <= 1) | _is_swap("x", "y")))
    near = near.select("x", "y", sound.alias("sound"), F.lit(False).alias("cut"), (sound | fits).alias("ok")).where("ok").drop("ok")
    parts = F.transform(F.sequence(F.lit(3), F.length("g") - 1), lambda n: F.substring(F.col("g"), F.lit(1), n))
    cut = words.where(F.length("g") > 3).select(F.col("g").alias("y"), F.explode(parts).alias("x")).join(words.select(F.col("g").alias("x")), "x", "left_semi")
    cut = cut.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"), F.lit(False).alias("sound"), F.lit(True).alias("cut"))
    both = near.unionByName(cut).groupBy("x", "y").agg(F.max("sound").alias("sound"), F.max("cut").alias("cut"))
    both = both.join(words.select(F.col("g").alias("x"), F.col("c").alias("cx")), "x").join(words.select(F.col("g").alias("y"), F.col("c").alias("cy")), "y")
    common = F.col("cx") & F.col("cy") & ~F.col("sound")
    # the rarer name first: few signatures bear it
    first = F.when(F.col("cx"), F.col("y")).otherwise(F.col("x"))
    return both.where(~common | F.col("cut")).select(first.alias("g1"), F.when(F.col("cx"), F.col("x")).otherwise(F.col("y")).alias("g2"), common.alias("bare"))


def without_particle(words: DataFrame) -> DataFrame:
    """Pairs ``x, y`` of surnames where ``x`` is a particle and ``y``; the rest must be long."""
    bare = F.filter(F.array(*[F.when(F.col("s").startswith(q), F.substring("s", len(q) + 1, 10_000)) for q in sorted({fold(q) for q in PARTICLES})]), lambda r: F.length(r) >= LONG)
    return words.select(F.col("s").alias("x"), F.explode(bare).alias("y")).join(words.select(F.col("s").alias("y")), "y").select("x", "y").distinct()


#: How well two signatures fit, best first: the same, the same surname, a near one, initials only, initials only and a near surname; fits that need other evidence.
SAME, FIT, NEAR, INITIALS, INITIALS_NEAR, LOOSE = 0, 1, 2, 3, 4, 9


def signature_pairs(kinds: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Pairs ``sig1, sig2, tier`` of different signatures that may be one name, both ways round.

    Surnames are equal, within ``radius`` edits or with and without a particle; middle initials agree or one is missing; given
    names are equal, a pair of :func:`given_pairs`, or one is only an initial.
    Every join is on the surname with the given name or the initial, so a
    frequent surname costs its fitting pairs, not all of them.
    """
    near = radius_join(kinds.withColumn("kind", F.when(F.col("i").startswith("#"), F.col("i")).otherwise("")), "kind", "s", radius).drop("g")
    least = F.least(F.length("x"), F.length("y"))
    close = ((F.col("d") <= 1) & (least >= 5)) | (_is_swap("x", "y") & (least >= 6))
    near = near.select("x", "y", F.when(close, 1).when(least >= LONG, 2).alias("d")).where("d IS NOT NULL")
    near = near.unionByName(without_particle(kinds.where("i NOT LIKE '#%'").select("s").distinct()).withColumn("d", F.lit(1)))
    near = _both_ways(near.groupBy("x", "y").agg(F.min("d").alias("d")), "x", "y", "d")
    near = near.unionByName(kinds.select(F.col("s").alias("x"), F.col("s").alias("y"), F.lit(0).alias("d")).distinct())
    # joins are by 64-bit hashes of the words
    sur = checkpoint(near.select(F.xxhash64("x").alias("x"), F.xxhash64("y").alias("y"), "d"))
    given = checkpoint(given_pairs(kinds, radius).select(F.xxhash64("g1").alias("g1"), F.xxhash64("g2").alias("g2"), "bare"))

    def side(n: int, by: str) -> DataFrame:
        return kinds.select("i", F.xxhash64("s").alias(by), *[F.col(c).alias(f"{c}{n}") for c in ("sig", "m")], F.when(F.col("g") != "", F.xxhash64("g")).alias(f"g{n}"))

    agree = (F.col("m1") == F.col("m2")) | (F.col("m1") == "") | (F.col("m2") == "")
    rich_tier = F.when(F.col("d") == 0, FIT).when(F.col("d") == 1, NEAR).otherwise(LOOSE)
    poor_tier = F.when(F.col("d") == 0, INITIALS).otherwise(INITIALS_NEAR)
    rich1, rich2 = side(1, "x").where("g1 IS NOT NULL"), side(2, "y").where("g2 IS NOT NULL")
    poor1 = side(1, "x").where("g1 IS NULL")
    # the same given name and the pairs of given names in one join; for the same one, one direction of the surnames is enough
    own = rich1.select("g1", F.col("g1").alias("g2"), F.lit(False).alias("bare"), F.lit(True).alias("one")).distinct()
    by = lambda d, g: d.withColumn("yg", F.xxhash64("y", g)).drop("y", g, "i")
    rich = by(rich1.join(given.withColumn("one", F.lit(False)).unionByName(own), "g1").drop("g1").join(sur, "x").where("NOT one OR x <= y").drop("x", "one"), "g2").join(by(rich2, "g2"), "yg").select("sig1", "sig2", "m1", "m2", F.when(F.col("bare"), LOOSE).otherwise(rich_tier).alias("tier"))
    poor = poor1.join(sur.where("d <= 1"), "x").drop("x").join(side(2, "y"), ["y", "i"]).select("sig1", "sig2", "m1", "m2", poor_tier.alias("tier"))
    fits = rich.unionByName(poor).where(agree & (F.col("sig1") != F.col("sig2")))
    return _both_ways(fits.groupBy(F.least("sig1", "sig2").alias("sig1"), F.greatest("sig1", "sig2").alias("sig2")).agg(F.min("tier").alias("tier")), "sig1", "sig2", "tier")


def linked_keys(faculty: DataFrame, papers: DataFrame, radius: int = RADIUS, evidence: tuple[str, ...] = ("ids", "papers", "company", "names")) -> DataFrame:
    """``key, entity`` of every key with its person or group (a hash without meaning).

    ``faculty``: ``expert_id, firstname, lastname, email, department, scopus_id,
    faculty_id``; ``papers``: ``paper_key, kerberos, authors, iitd_authors``, repeated
    deliveries allowed. Keys are the normalised expert and author ids of the two tables, each once; those
    without a readable name link through ids only. Rows without a key give none. Evidence:

    1. ids: a profile's ``scopus_id`` entries and its kerberos, the part of its email
       before the @, whatever the names and departments;
    2. papers: an author whose name fits a member of staff the paper names;
    3. company: fitting signatures (:func:`signature_pairs`) that share a co-author, a member of staff
       their papers name, or, for profiles, the department;
    4. names: an author seen in company on one paper at most joins the one entity whose name fits best, if there is just
       one, and a profile that no paper names the one such entity with a profile. Who is seen more often has shown
       their company: a namesake that shares none of it is someone else. Author groups join by the name alone.

    ``evidence`` names the kinds used, to measure one without the others.
    """
    # one row per key; repeats of a spelling merge before the shuffle
    tagged = F.concat(F.when(F.col("structured"), "1").otherwise("0"), F.coalesce("raw", F.lit("")))
    spelled = name_rows(faculty, papers).groupBy("key").agg(F.collect_set(tagged).alias("t"), F.max("structured").alias("profile"))
    spelled = checkpoint(spelled.select("key", "profile", _parser()("t").alias("p")))
    sure_given = spelled.select(F.explode("p").alias("p")).where(~F.col("p").startswith(f"{EITHER};")).select(F.split(F.split("p", ";")[1], r"\|").alias("t")).where(~F.col("t")[0].startswith("#")).select(F.col("t")[2].alias("g")).where("g <> ''")
    counts = sure_given.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    n_sure = counts.agg(F.sum("n")).first()[0] or 0
    # at most 1 / COMMON given names reach that share
    common = frozenset(r[0] for r in counts.where(F.col("n") >= max(5, COMMON * n_sure)).select("g").collect())
    is_common = F.col("g").isin(*common) if common else F.lit(False)
    sigs = spelled.select("key", F.explode(_resolver(common)("p")).alias("t")).select(_node("key").alias("node"), F.split("t", r"\|").alias("t")).select("node", *[F.col("t")[i].alias(c) for i, c in enumerate(_FIELDS)])
    # a signature and a key are named by 64-bit hashes
    sigs = checkpoint(sigs.withColumn("sig", F.xxhash64("i", "s", "g", "m")).withColumn("c", is_common))
    kinds = sigs.groupBy("sig", "i", "s", "g", "m", "c").agg(F.count(F.lit(1)).alias("n"))
    kinds = checkpoint(kinds)
    pairs = checkpoint(signature_pairs(kinds, radius))

    ids = faculty.select(_node_of(norm_key("expert_id")).alias("a"), F.explode("scopus_id").alias("b")).select("a", _node_of(norm_key("b")).alias("b")).where("a IS NOT NULL AND b IS NOT NULL").distinct()
    prof = profile_names(faculty)
    crews = checkpoint(paper_crews(papers, prof))
    known = crews.select("p", F.explode("staff").alias("b"), "authors")
    seen = checkpoint(papers_in_company(crews, known, prof))
    edges = sigs.limit(0).select(F.col("node").alias("a"), F.col("node").alias("b"))
    if "ids" in evidence:
        edges = edges.unionByName(ids).unionByName(kerberos_profiles(faculty))
    if "papers" in evidence:
        edges = edges.unionByName(paper_staff(prof, known, sigs))
    if "company" in evidence:
        edges = edges.unionByName(company_links(sigs, pairs, company(faculty, crews), seen))
    if "names" in evidence:
        # a signature of a group is a node of its own, its hash as it is; keys are not negative
        node = lambda c: -1 - F.shiftrightunsigned(c, 1)
        of = sigs.where("i LIKE '#%'").select("node", "sig").join(pairs.where(F.col("tier") < LOOSE).select(F.col("sig1").alias("sig"), "sig2"), "sig", "left")
        ends = F.array(F.col("node"), node(F.col("sig2")))
        edges = edges.unionByName(of.select(F.explode(ends).alias("a"), node(F.col("sig")).alias("b")))
    cc = connected_components(edges)
    keys = spelled.select("key", "profile", _node("key").alias("node")).join(cc, "node", "left")
    keys = checkpoint(keys.withColumn("cluster", F.coalesce("component", "node")).drop("component"))
    if "names" not in evidence:
        return keys.select("key", F.col("cluster").alias("entity"))
    joined = connected_components(name_links(keys, sigs, kinds, pairs, seen))
    return keys.join(joined.withColumnRenamed("node", "cluster"), "cluster", "left").select("key", F.coalesce("component", "cluster").alias("entity"))


def company(faculty: DataFrame, crews: DataFrame) -> DataFrame:
    """``node, xs, crew``: the company of a key as 64-bit hashes, in several rows, the key itself among them.

    Co-authors and the staff a paper names; both not negative. Of a list with more than ``CREW`` authors, which would
    take the square of its length, ``crew`` is the name and :func:`crew_links` finds what its members share. Profiles
    keep the company of their department, which is negative.
    """
    long = F.size("authors") > CREW
    beside = F.when(long, F.col("staff")).otherwise(F.concat("authors", "staff"))
    crew = crews.where("size(authors) > 1 OR size(staff) > 0").select(F.explode("authors").alias("node"), beside.alias("xs"), F.when(long, F.xxhash64(F.array_sort("authors"))).alias("crew"))
    dept = faculty.select(_node_of(norm_key("expert_id")).alias("node"), (-1 - _staff_node("d", norm_key("department"))).alias("x")).where("node IS NOT NULL AND x IS NOT NULL")
    return crew.unionByName(dept.select("node", F.array("x").alias("xs"), F.lit(None).cast("long").alias("crew")))


def crew_links(two: DataFrame, lists: DataFrame, long: DataFrame) -> DataFrame:
    """Pairs ``a < b`` of ``two`` that share a companion whom at least one of them met in a ``long`` list of authors (``node, crew``).

    ``lists`` (``node, xs``) is all other company. The companion is neither of the two, so of what crews and lists have in
    common a few members tell. Long lists stay apart from the keys, so one costs its length, not the square.
    """
    member = lambda node, crew="crew": long.select(F.col("node").alias(node), F.col("crew").alias(crew))
    met = checkpoint(_both_ways(two, "a", "b").join(member("a"), "a").distinct())
    # a long list of both has a third
    same = met.join(member("b"), ["b", "crew"]).select("a", "b")
    told = met.select("b", "crew").distinct().join(lists.select(F.col("node").alias("b"), F.explode("xs").alias("x")), "b").join(member("x"), ["x", "crew"])
    told = told.groupBy("b", "crew").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    listed = met.join(told, ["b", "crew"]).where("lo <> a OR hi <> a").select("a", "b")
    both = met.where("a < b").join(member("b", "crew2"), "b").where("crew <> crew2").select("a", "b", F.least("crew", "crew2").alias("c1"), F.greatest("crew", "crew2").alias("c2"))
    both = checkpoint(both.distinct())
    common = both.select("c1", "c2").distinct().join(member("x", "c1"), "c1").join(member("x", "c2"), ["c2", "x"])
    common = common.groupBy("c1", "c2").agg(F.slice(F.array_sort(F.collect_set("x")), 1, 3).alias("xs"))
    third = both.join(common, ["c1", "c2"]).where(F.exists("xs", lambda x: (x != F.col("a")) & (x != F.col("b")))).select("a", "b")
    every = same.unionByName(listed).unionByName(third)
    return every.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def company_links(sigs: DataFrame, pairs: DataFrame, kept: DataFrame, seen: DataFrame, few: int = FEW) -> DataFrame:
    """Pairs ``a, b`` of keys with fitting signatures and common company.

    Signatures of few keys are compared key by key, with their company as lists.
    Pairs of signatures with more than ``few`` pairs of keys, or of a key with more than ``CROWD`` papers,
    go by rows instead: a chain through all keys of a signature and companion. Both give the same components.
    """
    most = sigs.select("node", "sig").join(seen.select("node", "rows"), "node", "left").groupBy("sig").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max("rows"), F.lit(0)).alias("rows"))
    many = lambda n: F.col(f"n{n}")
    side = lambda n: most.select(F.col("sig").alias(f"sig{n}"), F.col("n").alias(f"n{n}"), F.col("rows").alias(f"rows{n}"))
    own = side(1).where("n1 > 1").select("sig1", F.col("sig1").alias("sig2"), F.lit(SAME).alias("tier"), "n1", F.col("n1").alias("n2"), "rows1", F.col("rows1").alias("rows2"))
    every = checkpoint(pairs.where("sig1 < sig2").join(side(1), "sig1").join(side(2), "sig2").select(*own.columns).unionByName(own))
    light = (many(1) * many(2) <= few) & (F.greatest("rows1", "rows2") <= CROWD)
    of = sigs.select("node", "sig")
    two = every.where(light).join(of.select(F.col("sig").alias("sig1"), F.col("node").alias("a")), "sig1").join(of.select(F.col("sig").alias("sig2"), F.col("node").alias("b")), "sig2").where("a <> b AND (sig1 <> sig2 OR a < b)")
    two = checkpoint(two.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("tier").alias("tier")))
    need = two.select("a").union(two.select("b")).distinct().withColumnRenamed("a", "node")
    lists = kept.join(need, "node", "left_semi").groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("xs"))).alias("xs"))
    lists = checkpoint(lists.select("node", F.array_remove("xs", F.col("node")).alias("xs")))
    near = lambda c: F.when(F.col("tier") < LOOSE, F.col(c)).otherwise(F.filter(c, lambda x: x >= 0))
    met = two.join(lists.select(F.col("node").alias("a"), F.col("xs").alias("xa")), "a").join(lists.select(F.col("node").alias("b"), F.col("xs").alias("xb")), "b")
    met = met.where(F.arrays_overlap(near("xa"), "xb")).select("a", "b")
    long = kept.where("crew IS NOT NULL").select("node", "crew")
    crowded = not long.isEmpty()
    if crowded:
        long = checkpoint(long.distinct())
        met = met.unionByName(crew_links(two, lists, long))
    heavy = every.where(~light)
    if heavy.isEmpty():
        return met
    need = of.join(heavy.select(F.col("sig1").alias("sig")).union(heavy.select("sig2")).distinct(), "sig")
    at = need.join(kept, "node").select("sig", "node", F.explode("xs").alias("x"))
    if crowded:
        at = at.unionByName(need.join(long, "node").join(long.select(F.col("node").alias("x"), "crew"), "crew").select("sig", "node", "x"))
    at = at.where("x <> node")
    lo = checkpoint(at.groupBy("sig", "x").agg(F.min("node").alias("lo"), F.max("node").alias("hi")))
    chain = at.join(lo.where("lo <> hi").select("sig", "x", "lo"), ["sig", "x"]).select(F.col("lo").alias("a"), F.col("node").alias("b"))
    across = heavy.where("sig1 <> sig2").join(lo.select(F.col("sig").alias("sig1"), "x", F.col("lo").alias("a")), "sig1").join(lo.select(F.col("sig").alias("sig2"), "x", F.col("lo").alias("b")), ["sig2", "x"])
    across = across.where((F.col("x") >= 0) | (F.col("tier") < LOOSE)).select("a", "b")
    return met.unionByName(chain).unionByName(across).where("a <> b").distinct()


def papers_in_company(crews: DataFrame, known: DataFrame, prof: DataFrame) -> DataFrame:
    """``node, np, rows``: papers on which an author has a co-author or a named member of staff beside them, or that name a
    profile (``np``, more than one counted as two), and the deliveries behind them."""
    of = crews.where("size(authors) > 1 OR size(staff) > 0").select("p", F.explode("authors").alias("node"))
    of = of.unionByName(known.join(prof, "b").select("p", F.col("a").alias("node")))
    some = of.groupBy("node").agg(F.min("p").alias("lo"), F.max("p").alias("hi"), F.count(F.lit(1)).alias("rows"))
    return some.select("node", F.when(F.col("lo") == F.col("hi"), 1).otherwise(2).alias("np"), "rows")


def name_links(keys: DataFrame, sigs: DataFrame, kinds: DataFrame, pairs: DataFrame, seen: DataFrame) -> DataFrame:
    """Pairs ``a, b`` of clusters of which ``a`` is little known and joins the only one its name fits best.

    Little known: at most ``LITTLE`` papers in company and no profile that a paper names. A cluster with a profile
    joins only one with a profile, as papers would name it beside an author seen more often. What fits
    is kept as the least and greatest cluster of a signature, so a name of many people costs no more than one of few.
    """
    np = F.coalesce("np", F.lit(0))
    size = keys.join(seen, "node", "left").groupBy("cluster").agg(((F.sum(np) > LITTLE) | F.max(F.col("profile") & (np > 0))).alias("firm"), F.max("profile").alias("staff"))
    of = sigs.join(keys.select("node", "cluster"), "node").join(size, "cluster").select("sig", "cluster", "firm", "staff").distinct()
    borne = kinds.groupBy("s").agg(F.sum("n").alias("often"))
    looks = kinds.join(borne, "s").select("sig", (F.col("g") == "").alias("poor"), "often")
    of = of.join(looks, "sig")
    # initials say nothing more where the cluster tells a given name
    named = of.groupBy("cluster").agg(F.min("poor").alias("bare"))
    of = checkpoint(of.join(named, "cluster").where("NOT poor OR bare").drop("bare"))
    own_tier = F.when(F.col("poor"), INITIALS).otherwise(SAME)
    little = of.where("NOT firm")
    mine = F.when(F.col("staff"), F.col("cluster"))
    firm = of.where("firm").groupBy("sig").agg(F.min("cluster").alias("lo"), F.max("cluster").alias("hi"), F.min(mine).alias("lo_staff"), F.max(mine).alias("hi_staff"))
    told = pairs.where(F.col("tier") < LOOSE).withColumnRenamed("sig1", "sig")

    def best(who: DataFrame, targets: DataFrame, own: bool) -> DataFrame:
        # initials beside a near surname tell something only where nobody else bears the surname
        beside = who.join(told, "sig").where((F.col("tier") != INITIALS_NEAR) | (F.col("often") == 1)).select("cluster", "staff", "tier", F.col("sig2").alias("sig"))
        if own:
            beside = beside.unionByName(who.select("cluster", "staff", own_tier.alias("tier"), "sig"))
        pick = lambda c: F.when(F.col("staff"), F.col(f"{c}_staff")).otherwise(F.col(c)).alias(c)
        fits = beside.join(targets, "sig").select("cluster", "tier", pick("lo"), pick("hi")).where("lo IS NOT NULL").groupBy("cluster", "tier").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        return fits.groupBy("cluster").agg(F.min(F.struct("tier", "lo", "hi")).alias("b")).select("cluster", "b.lo", "b.hi")

    to_firm = checkpoint(best(little, firm, True))
    alone = checkpoint(little.join(to_firm, "cluster", "left_anti"))
    # those of one full name without a better known namesake are one unit
    units = alone.where("NOT poor").groupBy("sig").agg(F.min("cluster").alias("lo"))
    same = alone.where("NOT poor").join(units, "sig")
    to_unit = best(alone, units.select("sig", *[F.col("lo").alias(c) for c in ("lo", "hi", "lo_staff", "hi_staff")]), False)
    out = to_firm.where("lo = hi").select("cluster", "lo").unionByName(to_unit.where("lo = hi").select("cluster", "lo")).unionByName(same.select("cluster", "lo"))
    return out.select(F.col("cluster").alias("a"), F.col("lo").alias("b")).where("a <> b")


def _node(key: str) -> Column:
    return _node_of(F.col(key))


def _node_of(key: Column) -> Column:
    """Node of a key: not negative, so that signatures, which are negative, become the labels of components."""
    return F.when(key.isNotNull(), F.shiftrightunsigned(F.xxhash64(F.lit("key"), key), 1))


def _staff_node(kind: str, value: Column) -> Column:
    """Node of a kerberos (``k``) or faculty id (``f``): what profiles and papers both name."""
    return F.when(value.isNotNull(), F.shiftrightunsigned(F.xxhash64(F.lit(kind), value), 1))


def kerberos_profiles(faculty: DataFrame) -> DataFrame:
    """Pairs ``a`` (profile), ``b`` (kerberos), as nodes: a kerberos is one person's, however many profiles bear it."""
    pairs = faculty.select(_node_of(norm_key("expert_id")).alias("a"), _staff_node("k", norm_key(F.split("email", "@")[0])).alias("b"))
    return pairs.where("a IS NOT NULL AND b IS NOT NULL").distinct()


def _author_nodes() -> Column:
    """Distinct nodes of a paper's authors."""
    return F.array_distinct(F.filter(F.transform(F.coalesce("authors.author_id", F.array().cast("array<string>")), lambda a: _node_of(norm_key(a))), lambda x: x.isNotNull()))


def profile_names(faculty: DataFrame) -> DataFrame:
    """Pairs ``a`` (profile), ``b`` (kerberos or faculty id), as nodes: what papers may name a profile by."""
    kerb, fid = norm_key(F.split("email", "@")[0]), norm_key("faculty_id")
    prof = faculty.select(_node_of(norm_key("expert_id")).alias("a"), F.explode(F.array(_staff_node("k", kerb), _staff_node("f", fid))).alias("b"))
    return prof.where("a IS NOT NULL AND b IS NOT NULL").distinct()


def paper_crews(papers: DataFrame, prof: DataFrame) -> DataFrame:
    """``p, authors, staff`` of deliveries with authors: the paper, its authors and the profiles' kerberos values and faculty ids it names, as
    hashes. A kerberos without a profile is no person's."""
    none = F.array().cast(papers.schema["iitd_authors"].dataType)
    tags = F.array_union(
        F.array(_staff_node("k", norm_key("kerberos"))),
        F.flatten(F.transform(F.coalesce("iitd_authors", none), lambda a: F.array(_staff_node("k", norm_key(a["kerberos"])), _staff_node("f", norm_key(a["faculty_ref"]))))),
    )
    crews = papers.select(F.xxhash64("paper_key").alias("p"), _author_nodes().alias("authors"), F.filter(tags, lambda v: v.isNotNull()).alias("tags")).where(F.size("authors") > 0)
    crews = checkpoint(crews)
    staff = crews.select("p", F.explode("tags").alias("b")).join(prof.select("b").distinct(), "b", "left_semi").groupBy("p").agg(F.collect_set("b").alias("staff"))
    return crews.drop("tags").join(staff, "p", "left").withColumn("staff", F.coalesce("staff", F.array().cast("array<bigint>")))


def paper_staff(prof: DataFrame, known: DataFrame, sigs: DataFrame) -> DataFrame:
    """Pairs ``a`` (author or profile), ``b`` (kerberos or faculty id), as nodes.

    An author hangs on a kerberos or id that a paper of theirs names where their name
    fits one of its profiles, and all its profiles hang on it. A paper's authors travel
    with the staff it names, so papers are never joined to themselves.
    """
    pairs = known.select("b", F.explode("authors").alias("a")).distinct()
    # several profiles of one kerberos count once per spelling
    e = sigs.select(F.col("node").alias("a"), F.col("i").alias("i1"), F.col("s").alias("s1"), F.col("g").alias("g1"), F.col("m").alias("m1")).join(prof, "a").drop("a").distinct()
    a = sigs.select(F.col("node").alias("a"), F.col("i").alias("i2"), F.col("s").alias("s2"), F.col("g").alias("g2"), F.col("m").alias("m2"))
    ok = F.levenshtein("s1", "s2") <= F.when(F.length("s1") >= 8, 2).otherwise(1)
    both_given = (F.col("g1") != "") & (F.col("g2") != "")
    ok = ok & F.when(both_given, (_one_sound(F.col("g1")) == _one_sound(F.col("g2"))) | _given_fits(F.col("g1"), F.col("g2"))).otherwise(F.col("i1") == F.col("i2")) & ((F.col("m1") == "") | (F.col("m2") == "") | (F.col("m1") == F.col("m2")))
    fit = pairs.join(e, "b").join(a, "a").where(ok)
    return fit.select("a", "b").distinct().unionByName(prof.select("a", "b"))


def entity_pairs(linked: DataFrame) -> DataFrame:
    """All pairs ``key_a < key_b`` of keys of one entity."""
    a, b = linked.select("entity", F.col("key").alias("key_a")), linked.select("entity", F.col("key").alias("key_b"))
    return a.join(b, "entity").where("key_a < key_b").select("key_a", "key_b")
