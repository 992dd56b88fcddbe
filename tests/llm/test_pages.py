import numpy as np

from lapidar.llm import pages

SCHEMA = "page_id bigint, doc string, page_no int, text string"
WORDS = "Die alte {} am Hang wurde von Handwerkern gebaut und später von Soldaten wieder zerstört"


def vectors(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "w array<string>")
    words = {}
    for t in texts:
        for w in t:
            words[w] = words.get(w, 0) + 1
    return pages.skip_grams(df, words)


def test_vectors_are_the_same_whatever_the_order_of_rows(spark):
    texts = [f"w{i % 7} w{i % 5} w{i % 3} stone w{i % 11} wall".split() for i in range(200)]
    a, b = vectors(spark, texts), vectors(spark, texts[::-1])
    assert a[1] == b[1] and np.array_equal(a[2], b[2]) and all(np.array_equal(a[0][w], b[0][w]) for w in a[0])


def test_misread_words_stand_where_the_right_ones_do(spark):
    texts = [WORDS.format("Mauer").split()] * 40 + [WORDS.format("Maner").split()] * 3
    texts += [["Der", "Zeuge", "sagte", "Maler", "seien", "teuer"]] * 40
    contexts, places, v = vectors(spark, texts)
    voc = pages.Vocabulary({}, {}, {}, contexts, places, v)
    assert voc.kinship("Maner", "Mauer") > 0.9 > 0.5 > voc.kinship("Maner", "Maler")


def test_vectors_decide_between_links():
    """Two words are as frequent and as plausible by letters; only their surroundings tell which one was misread."""
    contexts = {"fluss": np.array([1, 0], np.float32), "kirche": np.array([0, 1], np.float32)}
    words = {"bauen": 50, "hanen": 50}
    known = pages.Vocabulary(words, {}, {}, contexts, {"bauen": 0, "hanen": 1}, np.array([[0, 5], [5, 0]], np.float32))
    blind = pages.Vocabulary(words, {}, {}, {}, {}, np.zeros((0, 2), np.float32))
    assert {x for x, _ in known.near("banen")} == set(words)
    assert known.part("banen", "", "", ["Kirche"]) == "bauen" and known.part("banen", "", "", ["Fluss"]) == "hanen"
    assert blind.part("banen", "", "", ["Kirche"]) == blind.part("banen", "", "", ["Fluss"])


def test_vectors_change_repairs_of_a_corpus(spark):
    """A misread form that recurs is as such no rare word; its vector links it to the right one."""
    line = "Die alte {} am Hang wurde von Handwerkern gebaut\nund von Soldaten wieder zerstört."
    others = ["Zuerst kamen die Händler über den Fluss ins Land.", "Danach zogen viele Bauern mit Ochsen und Karren fort.", "Später fand man Scherben neben dem Brunnen im Hof.", "Zuletzt blieb nur Asche von allen Häusern der Stadt."]
    body = lambda i, w: "\n".join([*(others[(i + k * k) % 4] for k in range(4)), line.format(w), *(others[(i * k + 1) % 4] for k in range(4))])
    rows = [(i, f"d{i}", 1, body(i, "Mauer" if i % 20 else "Maner")) for i in range(100)]
    p = pages.ScannedPages(spark.createDataFrame(rows, SCHEMA))
    fixed = {r.page_id for r in p.defects().where("defect = 'char' and repaired = 'Mauer'").collect()}
    assert fixed == {i for i in range(100) if i % 20 == 0}


def test_classes_take_in_more_than_two_errors():
    voc = pages.Vocabulary({"beziehung": 80}, {}, {}, {}, {}, np.zeros((0, 2), np.float32))
    assert pages.glyph_class("bczichnng") == pages.glyph_class("beziehung")
    assert voc.near("bczichnng") == (("beziehung", 80),)


def test_two_errors_are_found_as_by_trying_all_edits():
    import random

    r = random.Random(5)
    words = "Mauer Grenze Brücke Hafen Tempel murallas torre ciudad fouilles ville céramique abandonnée terrazza monumento village mortar archive building Schmelzgrube".split()
    voc = pages.Vocabulary(dict.fromkeys(words, 9), {}, {}, {}, {}, np.zeros((0, 2), np.float32))
    found = 0
    for x in words * 30:
        w = r.choice(sorted(pages.edited(r.choice(sorted(pages.edited(x, pages.MISREADINGS)) or [x]), pages.MISREADINGS)) or [x])
        one = set(pages.edited(w))
        if len(w) < 4 or not w.isalpha() or pages._strange(w) or any(y in words for y in one):
            continue
        want = {z for y in one for z in pages.edited(y) if z != w and z in words and voc.count(z) > voc.count(w)}
        assert {z for z, _ in voc.near(w)} >= want
        found += bool(want)
    assert found > 50
