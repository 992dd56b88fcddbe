from residue_cases import CONTENT, RESIDUE

from lapidar.llm import residue

COLUMNS = "doc_id bigint, text string, source string, lines string"


def found(spark, rows, **kw):
    return {r.doc_id: r.kinds for r in residue.residue(spark.createDataFrame(rows, COLUMNS), **kw).collect()}


def test_notices_and_contents_in_twelve_languages(spark):
    """Each text is a host's only one, so only its own evidence speaks."""
    got = found(spark, [(i, t, f"host{i}", None) for i, t in enumerate(RESIDUE + CONTENT)])
    right = sum(i < len(RESIDUE) for i in got)
    assert right >= 0.9 * len(RESIDUE) and right >= 0.9 * len(got)


def test_counts_by_host_decide(spark):
    standing = "The portal of the state museums shows pictures and finds from all parts of the country."
    banner = "This website uses cookies. Enable cookies in your browser to go on."
    rows = [(i, f"{standing}\nThe {w} was cut into the rock before the wall was built.", "museum", None) for i, w in enumerate("well tomb gate road".split())]
    rows += [(10, f"{standing}\nPage not found.", "museum", None), (11, f"{standing}\nPage not found.", "elsewhere", None)]
    rows += [(20 + i, f"{banner}\nThe {w} was cut into the rock before the wall was built.", "archive", None) for i, w in enumerate("well tomb gate road".split())]
    rows += [(30, f"{banner}\nBronze fibula, grave 17", "archive", None), (31, f"{banner}\nBronze fibula, grave 17", "elsewhere", None)]
    # notices recur too, but not beside content
    rows += [(40 + i, f"Access denied.\nRequest a{i}", "press", None) for i in range(5)]
    assert set(found(spark, rows)) == {10, 31, *range(40, 45)}
    # without counts the standing sentence counts as content, and the banner as a notice
    assert set(found(spark, rows, recur_docs=10**9)) == {30, 31, *range(40, 45)}


def test_content_after_two_standing_sentences(spark):
    """All of a text tells whether standing sentences stand beside content, not only its first two content lines."""
    standing = "The portal of the state museums shows pictures and finds from all parts of the country.\nThe collections were brought together by four generations of curators and their friends."
    rows = [(i, f"{standing}\nBronze fibula\nThe {w} was cut into the rock before the wall was built.", "museum", None) for i, w in enumerate("well tomb gate road".split())]
    rows += [(10, f"{standing}\nPage not found.", "museum", None), (11, f"{standing}\nPage not found.", "elsewhere", None)]
    # the first two content lines differ in a number only, and others recur before content comes
    counted = "\n".join(f"Room {i} of the museum is shown on the plan of the house." for i in range(3))
    rows += [(20 + i, f"{counted}\n{standing}\nThe {w} was cut into the rock before the wall was built.", "gallery", None) for i, w in enumerate("well tomb gate road".split())]
    rows += [(30, f"{counted}\nPage not found.", "gallery", None)]
    # nothing but standing sentences further on: no content beside them
    rows += [(40 + i, f"{standing}\nThe rooms are open to all visitors on every day of the week.\nRoom {w}", "annex", None) for i, w in enumerate("east west north south".split())]
    rows += [(50, f"{standing}\nPage not found.", "annex", None)]
    assert set(found(spark, rows)) == {10, 30}


def test_copies_of_one_text_are_one(spark):
    rows = [(i, "The portal of the museums shows finds from all parts of the country.\nPage not found.", "museum", None) for i in range(5)]
    assert found(spark, rows) == {}


def test_edges(spark):
    rows = [(1, None, "a", None), (2, "", "a", None), (3, " \n​", None, None), (4, "{{title}}\n{{author}}", None, None), (4, "{{title}}\n{{author}}", None, None), (None, "Page not found", "a", None)]
    rows += [(5, "\n".join(f"Layer {i} of the trench held {i * 7} sherds and {i} coins of the third century." for i in range(20000)) + "\nPage not found", "a", None)]
    assert found(spark, rows) == {4: ["template"], None: ["notice"]}
    assert found(spark, []) == {}
