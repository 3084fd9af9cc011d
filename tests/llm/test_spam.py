import random

import pytest

from quarry.llm import spam

PROSE = "The composite sensor reduces the drift of the network when the load is small. We measured it at two plants and it was stable. "


@pytest.mark.parametrize(
    "text",
    [
        "cheap lab glassware, lab glassware, best lab glassware, cheap lab glassware, lab glasswares, top lab glassware",
        "\n".join(f"[alloy map {i}](http://shop{i}.example/x?id={i})" for i in range(6)),
        "#AlloyPump #RuralBeaker #DensePipette #SalinePump #UrbanBeaker #ModularPump",
        "Why thesis help? thesis help because thesis help gives thesis help and more thesis help. Looking for thesis help? Our thesis help is the thesis help for every thesis help need.",
        "brand: pdfbay; item: beaker; pack: 3; stock: no\nbrand: pdfbay; item: pump; pack: 4; stock: yes",
        PROSE + "\n" + " | ".join(f"alloy filter {i} price" for i in range(30)),
        " ".join(f"rural beaker ({i})" for i in range(12)),
    ],
)
def test_cases(text):
    assert spam.page_scores(text)[4]


@pytest.mark.parametrize(
    "text",
    [None, "", " \n\n ", "Towards an adaptive protein benchmark: recall and bit error rate", "Adaptive protein benchmark", PROSE * 5, PROSE * 3 + "\nKeywords: alloy, canal map, soot index.",
     PROSE + "See http://journal.example/a for more.", "Die Versuche dauerten 77 Tage und wurden zweimal wiederholt. " * 40, "http://one.example/x"],
)
def test_no_cases(text):
    assert not spam.page_scores(text)[4]


@pytest.mark.parametrize("seed", range(20))
def test_repeats_equal_the_definition(seed):
    rnd = random.Random(seed)
    s = [rnd.choice("abcde"[: 1 + seed % 5]) for _ in range(60)]
    text = "".join(s)
    times = lambda x: sum(text.startswith(x, i) for i in range(len(text)))
    longest = [max(m for m in range(i + 2) if m == 0 or times(text[i - m + 1 : i + 1]) > 1) for i in range(60)]
    assert spam.SuffixAutomaton(s).repeats() == longest
    want = bytearray(60)
    for i, m in enumerate(longest):
        if m >= 2:
            want[i - m + 1 : i + 1] = b"\1" * m
    assert spam.covered(s) == want
    # long sequences go another way
    page = s * 3
    assert spam.covered(page) == bytearray([1]) * 180 and spam.covered(list(range(200))) == bytearray(200) and spam.covered([]) == bytearray()


def test_repeats_decide(monkeypatch):
    text = "\n".join(f"how to get a loan in {w}" for w in "mumbai delhi pune surat kochi jaipur nagpur".split())
    assert spam.page_scores(text)[4]
    # the same form of lines without repeats is no list
    bare = "granular perovskite index\nurban drone optimiser\nbiochar metric\nrainfall gripper policy\nsoot scheduler"
    assert not spam.page_scores(bare)[4]
    monkeypatch.setattr(spam, "covered", lambda s, least=2: bytearray(len(s)))
    assert not spam.page_scores(text)[4]


@pytest.mark.parametrize(
    "text",
    [
        "Przed obiadem poszli do lasu i nad rzeke. Potem wrocili do domu, a on spal. Nie ma go od lat w tym kraju. " * 9,
        "the sensor was set\nup at the site and it\nran for two days until the rain\nhad come in and we took it to\nthe lab. Then it ran on.\n" * 5,
        "we went to the lab and set up the rig then we ran it for an hour and saw that the gap in the seal was too big to use so we had to do it all over " * 4,
    ],
)
def test_prose_of_other_languages_wrapped_or_without_marks(text):
    assert not spam.page_scores(text)[4]


def test_table_keeps_every_row(spark):
    rows = [(1, None, 3), (2, "", 3), (3, "cheap pump, " * 20, 3), (3, "cheap pump, " * 20, 3), (4, PROSE * 3000, 3)]
    got = spam.score_pages(spark.createDataFrame(rows, "doc_id long, text string, n_words int")).collect()
    assert sorted((r["doc_id"], r["is_spam"]) for r in got) == [(1, False), (2, False), (3, True), (3, True), (4, False)]
    assert spam.score_pages(spark.createDataFrame([], "doc_id long, text string")).count() == 0
