"""Functions and operators on small fixtures."""

import math

import pytest
from pyspark.sql import functions as F

from lapidar.functions import markup as M
from lapidar.functions import text as T
from lapidar.operators import evaluate, gazetteer, records, sentences, tokens, translate
from lapidar.plans import annotation_queries, collection_queries
from lapidar.sources import files, paged, sinks


def one(spark, value, kind, expr):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x")).alias("y")).first().y


def fold(lines, lower):
    """Joins by hand, line by line."""
    lines = list(lines)
    for i in range(len(lines) - 1):
        if lines[i].endswith("-"):
            a, b = lines[i].split(" "), lines[i + 1].split(" ")
            if not lower or b[0][:1].islower():
                a[-1] = a[-1].rstrip("-") + b[0]
                lines[i], lines[i + 1] = " ".join(a), " ".join(b[1:])
    return lines


@pytest.mark.parametrize("lines", [["a-", "b c"], ["foo-", "bar-", "baz"], ["x foo--", "bar"], ["foo-", "Bar"], ["foo-", "1"], ["foo-", "ª x"], ["foo-", ""], ["a -", "b"], ["a"], [], ["a-"]])
def test_hyphens(spark, lines):
    for lower in (True, False):
        assert one(spark, lines, "array<string>", lambda c, lo=lower: T.join_hyphenated(c, always=not lo)) == fold(lines, lower)


def test_hyphens_by_dictionary(spark):
    got = one(spark, ["(final-", "ly) x", "well-", "known"], "array<string>", lambda c: T.join_hyphenated(c, known=F.array(F.lit("finally"))))
    assert got == ["(finally)", "x", "well-", "known"]


def test_whitespace_and_lines(spark):
    assert one(spark, "a  b\r\n\f\nc ", "string", lambda c: T.split_lines(c)) == ["a  b", "", "", "c"]
    assert one(spark, [" x \t y\t", " \t", "a\tb"], "array<string>", T.clean_whitespace) == ["x y", "a\tb"]
    assert one(spark, None, "string", T.split_lines) is None
    assert one(spark, "", "string", T.split_lines) == []


def test_names_years_hosts(spark):
    assert one(spark, "Terra sigillata (pottery style)", "string", T.clean_period_name) == "Terra sigillata"
    assert one(spark, "Third Crusade, 1189-1192", "string", T.clean_period_name) == "Third Crusade"
    assert [one(spark, y, "int", T.year_text) for y in (5, -500, None)] == ["+0005", "-0500", "None"]
    assert [one(spark, u, "string", T.host) for u in ("http://www3.a.org/x", "b.org/y", "http://[x", "")] == ["a.org", "b.org", "invalid-url.xyz", "invalid-url.xyz"]
    assert one(spark, ["18xx", " 1800 ", "0", "-5"], "array<string>", T.earliest_year) == "-5"
    assert one(spark, ["0", "x"], "array<string>", T.earliest_year) == ""
    assert [one(spark, v, "string", T.value_kind) for v in ("196", "BC0200", "PXY", "1999-SU", "PAST_REF", "T12:30", "x", None)] == ["date", "date_bc", "duration", "season", "reference", "time", "invalid", None]


LINE_1 = '<s>pre<temponym>abc<dne type="person">def ghi</dne></temponym>post</s>'
LINE_2 = '<s>pre<temponym><dne type="person">abc <TIMEX3>def</TIMEX3></dne> ghi</temponym>post</s>'


def bio(spark, line, mode="default"):
    df = spark.createDataFrame([(1, line, "w", "named")], "k int, line string, w string, named string")
    return [(r.word, r.tag) for r in tokens.bio_table(df, ["k"], mode=mode).orderBy("word_no").collect()]


def test_nested_annotations(spark):
    assert bio(spark, LINE_1) == [("pre", "O"), ("abc", "B-temponym"), ("def", "I-temponym"), ("ghi", "I-temponym"), ("post", "O")]
    assert bio(spark, LINE_1, "only_non_timex") == [("pre", "O"), ("abc", "O"), ("def", "B-person"), ("ghi", "I-person"), ("post", "O")]
    assert bio(spark, LINE_2, "only_time") == [("pre", "O"), ("abc", "B-temponym"), ("def", "I-temponym"), ("ghi", "I-temponym"), ("post", "O")]
    assert bio(spark, "<s></s>") == [(".", "O")]


def test_spans(spark):
    df = spark.createDataFrame([(1, "<s>pre <temponym>abc <dne type=\"person\">def ghi</dne></temponym> &amp; post<x></x></s>"), (2, "plain"), (3, None), (4, "<a>un<b>closed</a>")], "k int, line string")
    got = {(r.k, r.name, r.start_in_line, r.end_in_line, r.text) for r in M.span_rows(df, ["k"]).collect()}
    assert got == {(1, "s", 0, 21, "pre abc def ghi & post"), (1, "temponym", 4, 14, "abc def ghi"), (1, "dne", 8, 14, "def ghi"), (1, "x", None, None, ""), (4, "a", 0, 7, "unclosed")}


def decide(gold, system):
    keys = ["doc", "line"]
    return evaluate.decisions(evaluate.by_line(gold, keys), evaluate.by_line(system, keys), keys)


def test_scores(spark):
    cols = "doc int, line int, tag_seq int, text string, attrs map<string,string>, start_in_line int, end_in_line int"
    gold = spark.createDataFrame([(1, 0, 0, "abcdef", {"value": "1", "type": "D"}, 0, 5), (1, 1, 0, "x", {}, None, None), (2, 0, 0, "q", {"type": "D"}, 3, 3)], cols)
    system = spark.createDataFrame([(1, 0, 0, "abc", {"value": "1", "type": "E"}, 0, 2), (1, 0, 1, "def", {"value": "2", "type": "D"}, 3, 5), (3, 0, 0, "z", {}, 0, 0)], cols)
    s = {(r.task_type, r.attr_name): r for r in evaluate.scores(decide(gold, system)).collect()}
    relaxed, strict, value = s["TAG_RELAXED", ""], s["TAG_STRICT", ""], s["ATTRIBUTE", "value"]
    assert (relaxed.tp, relaxed.fp, relaxed.fn) == (2, 1, 2)
    assert (strict.tp, strict.fp, strict.fn) == (0, 3, 4) and math.isnan(strict.f1) and strict.precision == 0
    assert (value.tp, value.fp, value.fn, value.max_matches) == (1, 2, 3, 2) and value.accuracy == 0.5
    none = evaluate.scores(decide(gold.limit(0), system.limit(0)))
    assert none.count() == 0


def test_records(spark):
    df = spark.createDataFrame([(1, [("http://a.org", "x"), (None, None)]), (2, None), (3, [("b.org", None)])], "id int, urls array<struct<url:string,desc:string>>")
    assert [r.id for r in records.with_url(df).orderBy("id").collect()] == [1, 3]
    assert [(r.id, len(r.urls)) for r in records.without_descriptions(df, ["x"]).orderBy("id").collect()] == [(1, 1), (3, 1)]
    assert [(r.id, r.pattern) for r in records.matching_any(df, ["org", "a[.]"]).orderBy("id", "pattern").collect()] == [(1, "a[.]"), (1, "org"), (3, "org")]
    assert [tuple(r) for r in records.host_counts(df).orderBy("host").collect()] == [("a.org", 1), ("b.org", 1)]


def test_sentences(spark):
    got = one(spark, "Am 19. Jahrhundert, vgl. Abb. 3. Das Haus  ist alt! Siehe S. 20f. dort. Ende", "string", sentences.split_text)
    assert got == ["Am 19. Jahrhundert, vgl.", "Abb. 3. Das Haus ist alt!", "Siehe S. 20f. dort.", "Ende"]
    assert one(spark, "", "string", sentences.split_text) == []
    assert one(spark, "Siehe vgl. Das Haus. Es steht.", "string", lambda c: sentences.split_text(c, ("vgl",))) == ["Siehe vgl. Das Haus.", "Es steht."]


def test_learned_abbreviations(spark):
    rows = [("Die Mauer (vgl. die Karte) wird nach Prof. Weber datiert. Das ist alles.",)] * 6 + [("Er wird bald datiert und ist nach alles zu haben.",)] * 3 + [(None,), ("",)]
    got = {r.word for r in sentences.abbreviations(spark.createDataFrame(rows, "text string")).collect()}
    assert got == {"vgl"}  # Prof never goes on in small letters here and isn't short


def test_pilot_to_corpus(spark):
    doc = (
        '<TimeML><temponym-fn type="reign" tid="t1">Nero <dne type="person">N</dne></temponym-fn> <temponym-fn type="place">Rom</temponym-fn> <TIMEX3 type="TEMPONYM" value="x" exploration-time="true">Eisenzeit</TIMEX3>'
        ' <TIMEX3 type="DATE" literature-time="true">1900</TIMEX3> <TIMEX3 type="DATE" check="no">1901</TIMEX3></TimeML>'
    )
    want = (
        '<TimeML><temponym type="reign" temporal-context="topic">Nero <dne type="person">N</dne></temponym> <dne type="place">Rom</dne> <temponym type="" temporal-context="exploration">Eisenzeit</temponym>'
        ' <TIMEX3 type="DATE" temporal-context="exploration">1900</TIMEX3> <TIMEX3 type="DATE" temporal-context="topic">1901</TIMEX3></TimeML>'
    )
    assert one(spark, doc, "string", M.pilot_to_corpus) == want


def test_small_text_functions(spark):
    assert one(spark, "  a\n\n\t b\r\n c\n", "string", T.left_stripped) == "a\nb\r\nc\n"
    assert one(spark, "http://x.org/t?b=1&arg=42", "string", lambda c: T.argument(c, "arg")) == 42
    assert one(spark, 'a "b"', "string", T.escape_quotes) == 'a \\"b\\"'
    assert one(spark, "a | b|c", "string", T.without_pipes) == "a bc"
    assert one(spark, "B-x,I-date", "string", T.without_prefix) == "B-x,date"
    assert one(spark, "<?xml?> <TimeML><TEXT>a\nb</TEXT></TimeML>", "string", T.text_on_lines) == "<TimeML><TEXT>\na\nb\n</TEXT></TimeML>"


def test_unbounded_walk(spark):
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(7)] + [("n7", "n2")], "src string, dst string")
    got = {(r.node, r.depth) for r in translate.walk(edges, spark.createDataFrame([("n0",)], "start string"), -1).collect()}
    assert got == {(f"n{i}", i) for i in range(8)}


def test_lists_of_sentences_and_own_parents(spark):
    import pytest

    t = spark.createDataFrame([(1, 1, "b", None, "O"), (1, 0, "a", "N", "B-x")], "s int, word_no int, word string, pos string, tag string")
    assert [(x.word, x.pos, x.tag) for x in tokens.sentence_lists(t, ["s"]).first().tokens] == [("a", "N", "B-x"), ("b", None, "O")]
    d = spark.createDataFrame([("e", {"isPartOf": ["a", "b"], "isSenseOf": ["b", "c"], "other": ["z"]})], "id string, relations map<string,array<string>>")
    assert d.select(gazetteer.parents(F.col("relations"), F.col("id"))).first()[0] == ["a", "b", "c"]
    with pytest.raises(Exception, match="own parent"):
        d.select(gazetteer.parents(F.col("relations"), F.lit("a"))).collect()
    w = spark.createDataFrame([(["a"], ["O", "O"])], "w array<string>, t array<string>")
    with pytest.raises(Exception, match="different length"):
        w.select(tokens.paired(F.col("w"), F.col("t"))).collect()


def test_walk(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("b", "a"), ("a", "b")], "src string, dst string")
    s = spark.createDataFrame([("a",)], "start string")
    assert {(r.node, r.depth) for r in translate.walk(e, s, 2).collect()} == {("a", 0), ("b", 1), ("c", 2)}


def test_literal_pairs(spark):
    assert one(spark, "[('de', 'Haus'), ('fr', 'maison')]", "string", files.literal_pairs)[0].term == "Haus"
    assert one(spark, "No similar term found", "string", files.literal_pairs) is None
    assert one(spark, "__import__('os').getcwd()", "string", files.literal_pairs) is None


def test_files(spark, tmp_path):
    (tmp_path / "a_DONE.txt").write_text("x\ny", encoding="utf-8")
    (tmp_path / "b.html").write_text("<p>a &lt; <b>c</b></p><script>no</script>", encoding="utf-8")
    docs = files.documents(spark, str(tmp_path))
    assert {(r.name, r.text) for r in files.extracted(docs).collect()} == {("a", "x\ny"), ("b", "a < c")}
    assert files.lines(docs.where("name = 'a'")).count() == 2
    (tmp_path / "c.doc").write_text("?", encoding="utf-8")
    with pytest.raises(Exception, match="no extractor"):
        files.extracted(files.documents(spark, str(tmp_path))).collect()


def test_csv_encodings(spark, tmp_path):
    (tmp_path / "u.csv").write_bytes("a,b\n1,é\n".encode())
    (tmp_path / "l.csv").write_bytes("a,b\n1,é\n".encode("latin-1"))
    for name in ("u", "l"):
        assert files.csv_table(spark, str(tmp_path / f"{name}.csv"), "a int, b string").first().b == "é"


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(0, 0, "a", None, "O"), (0, 1, "b", None, "B-x")], "sentence_no int, word_no int, word string, pos string, tag string")
    sinks.token_csv(df, str(tmp_path / "t"))
    assert [r["Sentence #"] for r in spark.read.option("header", True).csv(str(tmp_path / "t")).collect()] == ["Sentence: 0", None]
    with pytest.raises(Exception, match="(?i)exists"):
        sinks.token_csv(df, str(tmp_path / "t"))
    sinks.by_language(df.withColumn("lang", F.col("pos")), str(tmp_path / "l"))
    assert spark.read.parquet(str(tmp_path / "l")).first().lang == "unknown"
    assert sinks.stage_path("r", 3, "clean", "TODO") == "r/003_clean-TODO"


def test_paged_source(spark):
    def fetch(params):
        every = [{"id": str(i), "languages": ["de" if i % 2 else "en"], "urls": [{"url": f"u{i}"}] if i % 3 else []} for i in range(7)]
        a = params["page"] * params["limit"]
        return {"resultCount": 7, "records": every[a : a + params["limit"]]}

    paged.register(spark, "pages_of_test", fetch)
    df = spark.read.format("pages_of_test").option("limit", "3").load()
    assert df.count() == 7
    assert {r.id for r in df.where("language = 'de' and url is not null").collect()} == {"1", "5"}


def test_numbered_without_one_window(spark):
    df = spark.createDataFrame([(g, i) for g in (1, 2, 3000, 5000) for i in range(3)], "g int, i int")
    assert [r.sentence_no for r in tokens.numbered(df, "g", ["i"]).orderBy("g", "i").collect()] == list(range(12))


def test_pipeline(spark):
    from lapidar.plans import pipeline

    d = spark.createDataFrame([(1, "Das ist die Mau-\ner & der Hof.   Und\n\nmehr. ", "x"), (2, None, "x"), (3, " \n", "x"), (4, "The end of the work-\nshop is here.", "x")], "doc_id int, text string, lang string")
    got = [(r.doc_id, r.lang, r.sentence) for r in pipeline.prepared(d, known=["workshop"]).orderBy("doc_id", "sentence_no").collect()]
    assert got == [(1, "de", "Das ist die Mauer &amp; der Hof."), (1, "de", "Und mehr."), (4, "en", "The end of the workshop is here.")]
    many = spark.createDataFrame([(1, "Es ist gut. " * 30)], "doc_id int, text string")
    assert pipeline.prepared(many, window=4).count() == 4


def test_batches_and_splits(spark):
    df = spark.range(23)
    assert tokens.whole_batches(df, ["id"], 5).count() == 20 and tokens.whole_batches(df, ["id"], 23).count() == 23
    train, test = tokens.split_by_hash(df, "id", 0.3)
    assert train.count() + test.count() == 23 and 0 < test.count() < 15
    assert one(spark, [1, 2, 3], "array<int>", lambda c: tokens.shortened(tokens.padded(c, 6), F.lit(3))) == [1, 2, 3]


def test_norms_by_line(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "line_no int, translation string")
    assert translate.with_norms(t, t.withColumnRenamed("translation", "norm")).count() == 2
    with pytest.raises(Exception, match="no counterpart"):
        translate.with_norms(t, t.withColumnRenamed("translation", "norm").limit(1)).collect()


def test_pattern_files(spark, tmp_path):
    df = spark.createDataFrame([("de", "b", "n1"), ("de", "a", "n2"), ("fr", "c", None)], "lang string, pattern string, norm string")
    sinks.pattern_files(df, str(tmp_path / "x"))
    assert [r.value for r in spark.read.text(str(tmp_path / "x" / "patterns" / "lang=de")).collect()] == ["a", "b"]


def test_tids_and_dates(spark):
    line = '<TIMEX3 type="D">a</TIMEX3> b <TIMEX3 tid="x">c</TIMEX3>'
    assert one(spark, line, "string", lambda c: M.numbered_tids(c, F.lit(7))) == '<TIMEX3 tid="t7" type="D">a</TIMEX3> b <TIMEX3 tid="t8">c</TIMEX3>'
    assert one(spark, "x", "string", lambda c: M.with_creation_date(c, "2000-01-01")).endswith("</DCT>x")


def test_labels_of_frequent_names(spark, tmp_path):
    """A name of more than 20 subjects is looked up like any other."""
    names = [(f"e{i:02}", {"en": ["Iron Age", None], "de": [f"Eisenzeit {i % 7}"]}) for i in range(30)] + [("e99", {"en": ["Rare"], "fr": None}), ("e98", None)]
    spark.createDataFrame(names, "id string, names map<string,array<string>>").write.parquet(f"{tmp_path}/epochs.parquet")
    got = {r.term: r.labels for r in collection_queries.QUERIES["triple_labels"](spark, str(tmp_path)).collect()}
    assert got == {"Iron Age": "|".join([*(f"de:Eisenzeit {i}" for i in range(7)), "en:Iron Age"]), "Rare": "en:Rare"}


@pytest.mark.parametrize("name", ["rf_tagger", "memory_tagger_folds"])
def test_every_token_is_predicted(spark, small, name):
    key = ["doc_id", "line_no", "word_no"]
    got = annotation_queries.QUERIES[name](spark, small).select(*key).collect()
    assert sorted(got) == sorted(annotation_queries._tokens(spark, small).select(*key).collect())


def test_memories_of_folds(spark):
    """Each fold's tags come from the other folds alone."""
    rows = [(d, 0, w, word, tag) for d, line in enumerate(["a:X b:O", "a:Y b:O", "a:Y c:X"]) for w, (word, tag) in enumerate(x.split(":") for x in line.split())] + [(None, 0, 0, "a", "X")]
    t = spark.createDataFrame(rows, "doc_id int, line_no int, word_no int, word string, tag string")
    got = {(r.doc_id, r.word): r.predicted for r in tokens.fold_tagged(t, "doc_id", 3).collect()}
    assert got == {(0, "a"): "Y", (0, "b"): "O", (1, "a"): "X", (1, "b"): "O", (2, "a"): "X", (2, "c"): "O", (None, "a"): "Y"}
