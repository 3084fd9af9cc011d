import random

import pytest

from quarry.llm import names as N


def lev(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        c = [i]
        for j, y in enumerate(b, 1):
            c.append(min(p[j] + 1, c[-1] + 1, p[j - 1] + (x != y)))
        p = c
    return p[-1]


def words(seed, n):
    rnd = random.Random(seed)
    base = ["".join(rnd.choice("abcdeilmnorst") for _ in range(rnd.randint(4, 12))) for _ in range(n // 3)]
    out = list(base)
    for w in base * 2:
        w = list(w)
        for _ in range(rnd.randint(0, 3)):
            w[rnd.randrange(len(w))] = rnd.choice("abcdeilmnorst")
        out.append("".join(w))
    return out


def test_edit_distances_equal_the_definition():
    xs, ys = words(1, 40), words(2, 40) + ["", "a"]
    assert N.edit_distances(xs, ys).tolist() == [[lev(x, y) for y in ys] for x in xs]


@pytest.mark.parametrize("pivots", [1, 5, 30])
def test_radius_join_is_exact(spark, pivots):
    rows = [(g, w) for g in ("a", "b") for w in words(3 if g == "a" else 4, 150)] + [("a", None), ("a", "x" * 60), ("a", "mmmmmmmm"), ("a", "mmmmmmm")]
    got = {(r["g"], r["x"], r["y"]): r["d"] for r in N.radius_join(spark.createDataFrame(rows * 2, "i string, s string"), "i", "s", 2, pivots).collect()}
    want = {}
    for g in ("a", "b"):
        ws = sorted({w for h, w in rows if h == g and w})
        want |= {(g, x, y): lev(x, y) for x in ws for y in ws if x < y and lev(x, y) <= 2}
    assert got == want
    assert N.radius_join(spark.createDataFrame([], "i string, s string"), "i", "s").count() == 0


@pytest.mark.parametrize(
    "raw,want",
    [
        ("Srianmann, Thomas", ("t", "srianman", "thomas", "")), ("E.A. Paloroomura", ("e", "palorumura", "", "a")), ("Er. Ines J. Venobakratz", ("i", "venobakratz", "ines", "j")),
        ("Holenrathi G.B.", ("g", "holenrathi", "", "b")), ("Dhaenponathu Ojas B.", ("o", "dhaenponathu", "ojas", "b")), ("Ivaeereenikar,NT", ("n", "ivairinikar", "", "t")),
        ("Prof. Dr. José K. de Ivaenmann", ("j", "deivaenman", "jose", "k")), ("The Klemoto Gripper Collaboration", ("#c", "griperklemoto", "colaboration", "")),
        ("MBC (Musnikar Bearing)", ("#c", "bearingmusnikar", "", "")), ("Working Group for Cache at Ravdorp", ("#w", "kacheravdorp", "vorkingroup", "")),
    ],
)
def test_parsing(raw, want):
    kind, alts = N.parse_name(raw)
    if want[0].startswith("#"):
        assert alts[0][0] == want[0] and alts[0][3] == "" and (alts[0][2] == "") == (want[2] == "")
    else:
        assert kind == N.CERTAIN and alts == [want] or want in alts


def test_two_bare_words_in_both_orders():
    kind, alts = N.parse_name("Ojas Dhaenponathu")
    assert kind == N.EITHER and len(alts) == 2
    assert N.resolve([(kind, alts)], frozenset({"ojas"})) == [("o", "dhaenponathu", "ojas", "")]
    assert N.parse_name("") == (N.CERTAIN, []) and N.parse_name("Dr.") == (N.CERTAIN, []) and N.parse_name("123 ??") == (N.CERTAIN, [])


def test_linking(spark):
    fac = [
        ("E1", "Wilhelmina", "Hirarrenmoto", "whira1@x.example", "d1", ["11", None, ""], "f1"), ("e2", "Wilhelmina", "Hirarenmoto", None, "d1", None, "f2"),
        ("e3", "Faisal", "Kleelingam", "a@x", "d1", [], "f3"), ("e4", "Faisal", "Kleelingam", "b@x", "d2", [], "f4"), (None, "No", "Key", None, None, None, None), ("e5", None, None, None, None, ["55"], None),
    ]
    names = {
        "11": ["W. Hirarrenmoto"], "12": ["Hirarrenmoto, Wilhelmina", "W. Hirarrenmoto"], "13": ["Hiraremnoto W."], "21": ["Paco V. Pruaworth"], "22": ["Pruaworth, Francisco V."], "31": ["Anna Toronvish"], "32": ["Otto Toronvish"],
        "33": ["A. B. Toronvish"], "34": [None], "41": ["Devika Javen"], "42": ["Dhruv Javen"], "43": ["D. Javen"], "55": ["Somebody Else"], "61": ["The Zelquist Soot Network"], "62": ["ZELQUIST-SOOT NETWORK"], "71": ["Faisal Kleelingam"],
    }
    authors = [(f" {k}", n[0], n[1:]) for k, n in names.items()]
    schema = "paper_key string, kerberos string, authors array<struct<author_id:string,author_name:string,author_available_names:array<string>>>, iitd_authors array<struct<kerberos:string,faculty_ref:string>>, g string"
    papers = [(f"p{i}", {" 71": "b", " 41": "a"}.get(a[0]), [a], None, "x") for i, a in enumerate(authors)] + [("p0", None, [authors[0]], [(None, None)], "x"), ("p99", None, None, None, None)]
    f = spark.createDataFrame(fac, "expert_id string, firstname string, lastname string, email string, department string, scopus_id array<string>, faculty_id string")
    got = {tuple(r) for r in N.entity_pairs(N.linked_keys(f, spark.createDataFrame(papers, schema))).collect()}
    want = [{"e1", "e2", "11", "12", "13"}, {"21", "22"}, {"e5", "55"}, {"61", "62"}, {"e4", "71"}, {"31", "33"}]
    assert got == {(a, b) for s in want for a in s for b in s if a < b}
    assert N.linked_keys(f.limit(0), spark.createDataFrame([], schema)).count() == 0


FACULTY = "expert_id string, firstname string, lastname string, email string, department string, scopus_id array<string>, faculty_id string"
PAPERS = "paper_key string, kerberos string, authors array<struct<author_id:string,author_name:string,author_available_names:array<string>>>, iitd_authors array<struct<kerberos:string,faculty_ref:string>>"


def linked(spark, fac, papers):
    rows = [(f"p{n}", k, [(a, name, []) for a, name in authors], None) for n, (k, authors) in enumerate(papers)]
    return {tuple(r) for r in N.entity_pairs(N.linked_keys(spark.createDataFrame(fac, FACULTY), spark.createDataFrame(rows, PAPERS))).collect()}


def test_one_kerberos_is_one_person_across_departments_and_spellings(spark):
    fac = [
        ("e1", "Venkatesh L.", "Yaravalla", "vyara382@x", "d1", None, "f1"), ("e2", "Venkatesh", "Yarawalla", " VYARA382@mail.x", "d2", None, "f2"),
        ("e3", "Bruakratz R.", "A.", "abrua1@x", "d1", None, "f3"), ("e4", "Aishwarya", "Bruakratz", "abrua1@x", "d1", None, "f4"), ("e5", None, None, "abrua1@x", None, None, "f5"),
        # one name, two departments, two kerberos values: the name alone tells nothing
        ("e6", "Faisal", "Kleelingam", "a@x", "d1", None, "f6"), ("e7", "Faisal", "Kleelingam", "b@x", "d2", None, "f7"),
        # a spelling of the second of the two
        ("e8", "Faisal", "Kleelinngam", "c@x", "d2", None, "f8"), ("e9", "Faisal", "Kleelinggam", "d@x", "d3", None, "f9"),
    ]
    want = [{"e1", "e2"}, {"e3", "e4", "e5"}, {"e7", "e8"}]
    # papers name each kerberos
    papers = [(None, [("a1", "Faisal Kleelingam")])] + [(k, [(f"x{k}", name)]) for k, name in zip("abcd", ["Zoe Ulanbel", "Tara Pruavi", "Omkar Venadi", "Lin Rekubo"], strict=True)]
    assert linked(spark, fac, papers) == {(a, b) for s in want for a in s for b in s if a < b}


def test_papers_name_a_kerberos_of_several_profiles(spark):
    fac = [
        ("e1", "Katherine", "Nadeeswami", "knade1@x", "d1", None, "f1"), ("e2", "K.", "Nadeeswami", "knade1@x", "d2", None, "f2"),
        ("e3", "Kamalesh", "Nadeeswami", "knade2@x", "d1", None, "f3"),
    ]
    # the initials fit two people, so only the kerberos tells which
    got = linked(spark, fac, [(" KNADE1 ", [("a1", "K. Nadeeswami"), ("a2", "Kamalesh Zelmura")])])
    assert got == {("a1", "e1"), ("a1", "e2"), ("e1", "e2")}


def by_author(spark, names):
    return linked(spark, [("e1", None, None, None, None, None, None)], [(None, [(k, n)]) for k, n in names.items()])


def test_misread_letters_and_particles(spark):
    assert N.fold_surname("Koraclheti") == N.fold_surname("Koradheti") and N.fold_surname("Ivaurnzadeh") == N.fold_surname("Ivaumzadeh")
    names = {
        "11": "Nadanrathi, Frederick", "12": "Naclanrathi, Frederick", "21": "al-Zeladrathi, Zoe", "22": "Zeladrathi, Zoe", "23": "Zeladrathi, Zara", "31": "von Zelquistmann, Otto", "32": "Zelquistmann, Otto",
        # two edits are more often another surname
        "41": "Musonikar, Rohan", "42": "Lasonikar, Rohan",
    }
    assert by_author(spark, names) == {("11", "12"), ("21", "22"), ("31", "32")}


def test_a_frequent_surname_keeps_its_misspellings(spark):
    names = {f"{g[0]}{n:02}": f"Palarmoto, {g}" for g in ("Anna", "Otto") for n in range(20)} | {"x1": "Palarnoto, Anna", "x2": "Palarnoto, Otto"}
    got = by_author(spark, names)
    assert {("a00", "x1"), ("o00", "x2")} <= got and ("x1", "x2") not in got
    # two surnames of people seen in company of their own
    names = {"y1": "Vesafield, Anna", "y2": "Vesafield, Otto", "z1": "Vesafielt, Anna", "z2": "Vesafielt, Otto"}
    crew = [(None, [(k, n), (f"{k}{c}", f"{w} {k}")]) for k, n in names.items() for c, w in (("p", "Rekubodi"), ("q", "Shaunari"))]
    assert not {p for p in linked(spark, [("e1", None, None, None, None, None, None)], crew) if p[0] in names or p[1] in names}


def test_given_names_with_different_initials(spark):
    names = {
        "11": "Marithfield, Katherine", "12": "Marithfield, Catherine", "21": "Balithwalla, Anders", "22": "Balithwalla, Snders", "31": "Nereepati, Katherine", "32": "Nerepati, Catherine",
        "41": "Zelmura, Dinesh", "42": "Zelmura, Ganesh",
    }
    assert by_author(spark, names) == {("11", "12"), ("21", "22"), ("31", "32")}


def test_a_profile_no_paper_names_joins_the_one_it_resembles(spark):
    fac = [
        ("e1", "Goran", "Korondorp", "gkoro1@x", "d1", ["a1"], "f1"), ("e2", "G.", "Koronclorp", "gkoro2@x", "d2", None, "f2"),
        # two it may be
        ("e3", "Isolde", "Holanikar", "ihola1@x", "d1", ["a3"], "f3"), ("e4", "Isolde", "Holanikar", "ihola2@x", "d2", ["a4"], "f4"), ("e5", "Isolde", "Holaniirar", "ihola3@x", "d3", None, "f5"),
        # an author seen twice whose papers never name the profile
        ("e6", "Pavel", "Torolkavshev", "ptoro1@x", "d1", None, "f6"),
    ]
    papers = [(k, [(a, n), ("z" + a, f"Zoe {z}")]) for k, a, n, z in [("gkoro1", "a1", "Goran Korondorp", "Ulanbel"), ("ihola1", "a3", "I. Holanikar", "Pruavi"), ("ihola2", "a4", "I. Holanikar", "Venadi")]]
    papers += [(None, [("a6", "Pavel Torolkavshev"), (f"y{n}", f"Lin {w}")]) for n, w in enumerate(["Rekubodi", "Shaunari"])]
    want = [{"e1", "a1", "e2"}, {"e3", "a3"}, {"e4", "a4"}]
    assert linked(spark, fac, papers) == {tuple(sorted((a, b))) for s in want for a in s for b in s if a != b}


def test_company_tells_namesakes_apart(spark):
    def crew(a, name, *others):
        return [(None, [(a, name), (o, f"Omkar {o}")]) for o in others]

    papers = crew("b1", "Benjamin Korogithmoto", "crielziak", "varelmann") + crew("b2", "B. Korogithmoto", "varelmann", "tamelpat") + crew("b3", "Benjamin Korogithmoto", "ostanfeld", "pruongur")
    # three edits away from nobody, seen once, and fits two
    papers += crew("b4", "Benjamin Korogithmoto", "zelumari") + crew("b5", "Benjamin Korogitmoto", "pruithor")
    # two edits apart, which only common company bears out
    papers += crew("c1", "Emeka Marushnathu", "ivaoland", "hirenpat") + crew("c2", "Emeka Marishnuthu", "hirenpat", "kleavdor") + crew("c3", "Emeka Maroshnithu", "quinamav", "ravelgan")
    papers += crew("d1", "K. Nadiberg", "lavurati", "fenushan") + crew("d2", "Kunal Nadiberg", "fenushan", "toralund")
    got = linked(spark, [("e1", None, None, None, None, None, None)], papers)
    assert got == {("b1", "b2"), ("c1", "c2"), ("d1", "d2")}


def test_every_key_has_an_entity(spark):
    fac = [("e1", None, None, "a@x", None, ["77", "88"], None), ("e2", "Zoe", "Ulanbel", None, None, None, None), (None, "Zoe", "Ulanbel", "b@x", None, ["99"], None)]
    rows = [("p1", None, [("77", None, None), ("99", "X", [])], None), ("p2", None, [(None, "Zoe Ulanbel", None)], None), ("p3", None, None, None), ("p4", None, [None], None)]
    got = {r["key"]: r["entity"] for r in N.linked_keys(spark.createDataFrame(fac, FACULTY), spark.createDataFrame(rows, PAPERS)).collect()}
    assert set(got) == {"e1", "e2", "77", "99"} and got["e1"] == got["77"] and len(set(got.values())) == 3


def test_glued_words_and_given_names_like_particles():
    assert N.parse_name("LavarpatitM")[1] == [("m", "lavarpatit", "", "")]
    assert {a[1:3] for a in N.parse_name("KunalWexurwalla")[1]} == {("vexurvala", "kunal"), ("kunal", "vexurvala")}
    assert {a[1] for a in N.parse_name("Ben Torolkavshev")[1]} == {"torolkavshev", "ben"} and N.parse_name("Md. Rahman")[1]
    assert N.parse_name("Leonardo IvaamgadBrueshve")[1][0][1] == "ivamgadbrueshve"


def test_long_words_join_exactly(spark):
    rnd = random.Random(9)
    base = ["".join(rnd.choice("abcde") for _ in range(n)) for n in (38, 39, 40, 41, 42, 60, 200)]
    ws = list(base)
    for w in base * 4:
        w = list(w)
        for _ in range(rnd.randint(1, 3)):
            at, how = rnd.randrange(len(w)), rnd.choice("sid")
            w[at : at + (how != "i")] = [] if how == "d" else [rnd.choice("abcde")]
        ws.append("".join(w))
    got = {(r["x"], r["y"]): r["d"] for r in N.radius_join(spark.createDataFrame([("a", w) for w in ws], "i string, s string"), "i", "s", 2).collect()}
    assert got == {(x, y): lev(x, y) for x in set(ws) for y in set(ws) if x < y and lev(x, y) <= 2}


def test_company_by_lists_and_by_rows_give_the_same_components(spark):
    rnd = random.Random(4)
    names = ["Emeka Marushnathu", "E. Marushnathu", "Emeka Marishnathu", "Zoe Ulanbel", "Z. Ulanbel"]
    rows = [(f"p{n}", None, [(f"a{rnd.randrange(30):02}", names[rnd.randrange(5)], []) for _ in range(3)], None) for n in range(60)]
    papers, fac = spark.createDataFrame(rows, PAPERS), spark.createDataFrame([], FACULTY)
    prof = N.profile_names(fac)
    crews = N.paper_crews(papers, prof)
    known = crews.select("p", N.F.explode("staff").alias("b"), "authors")
    sigs = N.name_rows(fac, papers).where("raw IS NOT NULL").select(N._node("key").alias("node"), N.F.xxhash64("raw").alias("sig")).distinct()
    ids = {n: r[0] for n in names for r in spark.range(1).select(N.F.xxhash64(N.F.lit(n))).collect()}
    pairs = spark.createDataFrame([(ids[a], ids[b], 1) for a in names[:3] for b in names[:3] if a != b] + [(ids[names[3]], ids[names[4]], 3), (ids[names[4]], ids[names[3]], 3)], "sig1 long, sig2 long, tier int")
    seen = N.papers_in_company(crews, known, prof)
    got = []
    for few in (0, 10_000):
        links = N.company_links(sigs, pairs, N.company(fac, crews), seen, few)
        got.append({(r["node"], r["component"]) for r in N.connected_components(links).collect()})
    label = [{n: min(m for m, d in g if d == c) for n, c in g} for g in got]
    assert label[0] == label[1] and len(set(label[0].values())) > 0


@pytest.mark.parametrize("few", [10_000, 0])
def test_long_author_lists_tell_company_too(spark, monkeypatch, few):
    rnd = random.Random(6)
    names = ["Emeka Marushnathu", "E. Marushnathu", "Zoe Ulanbel", "Tara Pruavi", "Kim Xander"]
    # an author has one name; a third stands alone on a second paper with few others
    papers_ = [[f"a{i:02}" for i in sorted({rnd.randrange(60) for _ in range(rnd.choice((1, 2, 3, 5)))})] for _ in range(45)]
    rows = [(f"p{n}", None, [(i, names[int(i[1:]) % 5], []) for i in crew], None) for n, crew in enumerate(papers_)]
    papers, fac = spark.createDataFrame(rows, PAPERS), spark.createDataFrame([], FACULTY)
    prof = N.profile_names(fac)
    crews = N.checkpoint(N.paper_crews(papers, prof))
    seen = N.papers_in_company(crews, crews.select("p", N.F.explode("staff").alias("b"), "authors"), prof)
    sigs = N.checkpoint(N.name_rows(fac, papers).select(N._node("key").alias("node"), N.F.xxhash64("raw").alias("sig")).distinct())
    one, two = spark.range(1).select(*[N.F.xxhash64(N.F.lit(n)) for n in names[:2]]).first()
    pairs = spark.createDataFrame([(one, two, 1), (two, one, 1)], "sig1 long, sig2 long, tier int")
    node = {r["key"]: r["node"] for r in spark.createDataFrame([(f"a{i:02}",) for i in range(60)], "key string").select("key", N._node("key").alias("node")).collect()}
    met = {i: {j for crew in papers_ if i in crew for j in crew if i != j} for i in node}
    fits = lambda a, b: a % 5 == b % 5 or {a % 5, b % 5} == {0, 1}
    want = {tuple(sorted((node[a], node[b]))) for a in node for b in node if a < b and fits(int(a[1:]), int(b[1:])) and met[a] & met[b]}
    got = []
    for most in (100, 3, 2):
        monkeypatch.setattr(N, "CREW", most)
        links = N.company_links(sigs, pairs, N.company(fac, crews), seen, few)
        if few:
            assert {(r["a"], r["b"]) for r in links.collect()} == want
        got.append({(r["node"], r["component"]) for r in N.connected_components(links).collect()})
    assert got[0] and got[0] == got[1] == got[2]


def test_a_cell_gives_each_pair_once():
    ws = sorted(set(words(8, 120)) | {"aaaaaaab", "aaaaaaaab", "a"})
    ys = N.np.array(ws)
    home = N.np.array([len(w) % 3 > 0 for w in ws])
    got = []
    # two blocks of the home words
    for block in (0, 1):
        first = home & (N.np.arange(len(ws)) % 2 == block)
        got += list(zip(*N.cell_join(ys, first, home, 2), strict=True))
    at_home = dict(zip(ws, home.tolist(), strict=True))
    assert sorted(got) == sorted((x, y, lev(x, y)) for x in ws for y in ws if x < y and (at_home[x] or at_home[y]) and lev(x, y) <= 2)
