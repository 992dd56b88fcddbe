"""Operators on training texts, on small fixtures and on the small tables."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lapidar.llm import bpe, language, leaks, pages, queries, residue, sentences
from lapidar.runtime import table

VOC = "/opt/tokenizers/byte_bpe_50k.tiktoken"


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_give_rows(spark, small, name):
    assert queries.QUERIES[name](spark, small).count() > 0


# -- token ids


def public_ids(texts):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_ids_of_odd_texts():
    r = random.Random(1)
    letters = list("abAB19'sreéßนแ中😀½²٣<|endoftext|>") + ["̀", "​", " ", "　", "\x1c", "\x85", "\r", "\n", "\t", " ", " ", "﻿"]
    texts = ["".join(r.choice(letters) for _ in range(r.randrange(40))) for _ in range(3000)] + ["", None, "<|endoftext|>", "a" * 5000, "ab" * 3000, " " * 999]
    assert bpe.encoder(VOC)(texts) == public_ids(texts)


def test_ids_of_documents(spark, small):
    d = table(spark, small, "documents")
    got = {r.doc_id: list(r.ids) for r in bpe.token_ids(d).collect()}
    rows = d.select("doc_id", "text").collect()
    want = public_ids([r.text for r in rows])
    assert got == {r.doc_id: w for r, w in zip(rows, want, strict=True)}
    back = bpe.vocabulary(VOC).token
    assert all(b"".join(back[i] for i in got[r.doc_id]) == (r.text or "").encode() for r in rows)


def test_ids_edges(spark):
    df = spark.createDataFrame([(None, "a", 1), (1, None, 2), (1, "", 3), (2, "x y", 4), (2, "x y", 4)], "doc_id bigint, text string, ids int")
    assert sorted(((r.doc_id or 0), len(r.ids)) for r in bpe.token_ids(df).collect()) == [(0, 1), (1, 0), (1, 0), (2, 2), (2, 2)]
    assert bpe.token_ids(df.limit(0)).count() == 0


# -- template residue


CONTENT = "The circular chapel covers an older floor of beaten clay near the gate."
CASES = [
    (1, "Error 404: page not found", True), (2, "Notes on the pottery\nPlease enable JavaScript to view this page.", True), (3, f"{CONTENT}\n\nPlease enable JavaScript.", False),
    (4, "{{title}}: {{author}} ({{year}})", True), (5, "Lorem ipsum dolor sit amet velit.", True), (6, "bla bla bla bla bla bla bla bla", True), (7, CONTENT, False), (8, None, False),
    (9, " \n ", False), (10, "Home | Search | Contact", False), (11, f"An error on page 404 is noted here. {CONTENT}", False), (12, "Notes on the pottery", False),
    (13, "没想到与多帕帕的贸易已经中断！西北塔楼覆盖着较早的夯土地面。\n404 not found", False), (14, "x" * 200_000, False),
]


def test_residue(spark):
    df = spark.createDataFrame([(i, t, "h" if i % 2 else None, "k") for i, t, _ in CASES], "doc_id int, text string, source string, line string")
    assert {r.doc_id for r in residue.residue(df).collect()} == {i for i, _, c in CASES if c}
    assert residue.residue(df.limit(0)).count() == 0


def test_recurrent_lines_are_no_content(spark):
    rows = [(i, f"Subscribe to our weekly letter now.\nerror {500 + i}: internal server error", "h") for i in range(5)] + [(9, "Subscribe to our weekly letter now.\n502: internal server error", "other")]
    got = {r.doc_id for r in residue.residue(spark.createDataFrame(rows, "doc_id int, text string, source string")).collect()}
    assert got == {0, 1, 2, 3, 4}


def test_copies_and_small_shares_are_no_boilerplate(spark):
    line = "The old gate was closed by clay."
    fill = lambda n: " ".join(f"word{i}" for i in range(9)) + f" {n} ends."
    rows = [(i, f"{line}\nPlease enable cookies.", "copies") for i in range(4)]
    # three different texts of five hundred
    rows += [(10 + i, f"{line}\nPlease enable cookies number {'abc'[i]}.", "large") for i in range(3)] + [(100 + i, fill(i), "large") for i in range(500)]
    # a sentence of a script without spaces that recurs
    rows += [(20 + i, f"没想到与多帕帕的贸易已经中断！西北塔楼覆盖着较早的夯土地面。\nPlease enable cookies {'abc'[i]}.", "dense") for i in range(3)]
    assert residue.residue(spark.createDataFrame(rows, "doc_id int, text string, source string")).count() == 0


# -- languages


def test_paragraph_runs():
    assert language.paragraphs("a\nb\r\n ​\r\nc\x85\x85 d\r\re") == ["a\nb", "c", "d", "e"]
    assert language.paragraphs(None) == [] and language.paragraphs(" \n﻿") == []


def test_labels(spark):
    df = spark.createDataFrame([(["IT ", "fr_FR"],), (["Deutsch", None, "?", "ger"],), (None,), ([],), (["zh-Hans", "xx", "de-AT"],)], "l array<string>")
    assert [list(r.n) for r in df.select(language.named_languages(F.col("l")).alias("n")).collect()] == [["it", "fr"], ["de"], [], [], ["zh", "de"]]


def brute_bits(samples, text):
    """Code length by walking contexts, one byte after another."""
    pad = b"\n" * language.ORDER
    counts = [{} for _ in range(language.ORDER + 1)]
    for s in samples:
        s = pad + s
        for i in range(language.ORDER, len(s)):
            for k in range(language.ORDER + 1):
                c = counts[k].setdefault(s[i - k : i], {})
                c[s[i]] = c.get(s[i], 0) + 1
    bits, t = 0.0, pad + text
    for i in range(language.ORDER, len(t)):
        for k in range(language.ORDER, -1, -1):
            c = counts[k].get(t[i - k : i])
            if c is None:
                continue
            total = sum(c.values()) + len(c)
            if t[i] in c:
                bits -= np.log2(c[t[i]] / total)
                break
            bits -= np.log2(len(c) / total)
        else:
            bits += 8
    return bits


def test_code_lengths():
    r = random.Random(2)
    word = lambda a: "".join(r.choice(a) for _ in range(6))
    samples = [[" ".join(word(a) for _ in range(9)).encode() for _ in range(5)] for a in ("abcd", "cdefé", "xyz")]
    texts = [b"", b"a", "abé xyq ÿ".encode(), samples[0][0], b"cd" * 50]
    got = language.ContextTrees(samples).code_lengths(texts)
    want = [[brute_bits(s, t) for s in samples] for t in texts]
    assert np.allclose(got, want, rtol=1e-4, atol=1e-3)


def test_held_out_languages(spark, small):
    d = table(spark, small, "documents")
    trees = language.train(d.where("doc_id % 2 = 0"))
    found = language.paragraph_languages(d.where("doc_id % 2 = 1"), trees).where("size(named) = 1 and n_bytes > 60")
    right = found.where(F.col("lang") == F.col("named")[0]).count()
    assert right > 0.75 * found.count()  # a part of the labels is wrong


def test_language_edges(spark, small):
    d = spark.createDataFrame([(1, None, None, "x"), (2, "", [], "x"), (3, "123\n\n...", None, "x"), (None, "Das Haus und der Hof, die Burg", ["de"], "x")], "doc_id bigint, text string, languages array<string>, lang string")
    trees = language.train(table(spark, small, "documents"))
    got = {(r.doc_id, r.para_no, r.lang) for r in language.paragraph_languages(d, trees).collect()}
    assert got == {(3, 0, None), (3, 1, None), (None, 0, "de")}
    assert language.paragraph_languages(d.limit(0), language.train(d.limit(0))).count() == 0


# -- leaks


def test_leaks(spark):
    r = random.Random(4)
    vocabulary = ["".join(r.choice("abcdefghijk") for _ in range(6)) for _ in range(3000)]
    text = lambda n: [r.choice(vocabulary) for _ in range(n)]
    items = {i: text(60) for i in range(8)}
    docs, want = [], set()
    for d in range(300):
        w = text(r.randrange(0, 200))
        if d % 10 == 0:
            i = r.randrange(8)
            n, share = 60, r.choice([1.0, 0.6, 0.3])
            a = r.randrange(0, int(n * (1 - share)) + 1)
            piece = items[i][a : a + int(n * share)]
            piece[7] = "changed"
            piece.insert(12, "added")
            w[5:5] = piece
            if share >= 0.5:
                want.add((d, i))
        docs.append((d, " ".join(x.upper() if d % 20 else x for x in w).replace("AB", "A-\nb") if d % 30 == 0 else ", ".join(w), "extra"))
    docs += [(1000, None, "x"), (1001, "", "x")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, w string")
    it = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()] + [(90, None), (91, "")], "item_id bigint, text string")
    assert {(x.doc_id, x.item_id) for x in leaks.leaked(df, it).collect()} == want
    assert leaks.leaked(df.limit(0), it).count() == 0
    assert leaks.leaked(df, it.limit(0)).count() == 0


def test_hot_half_of_an_item(spark):
    """The half that leaked into many documents has low IDF; the documents are found all the same."""
    r = random.Random(8)
    vocabulary = ["".join(r.choice("abcdefghijk") for _ in range(6)) for _ in range(3000)]
    text = lambda n: [r.choice(vocabulary) for _ in range(n)]
    items = {i: text(60) for i in range(4)}
    docs = [(d, " ".join(text(40) + (items[1][:32] if d % 5 < 2 else []) + text(40))) for d in range(300)]
    got = leaks.leaked(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id bigint, text string"))
    assert {(x.doc_id, x.item_id) for x in got.collect()} == {(d, 1) for d in range(300) if d % 5 < 2}


def test_normal_form():
    assert leaks.words("Zer­störte „Burg“ am Jahr-\n> hunderts ﬁne") == ["zerstorte", "burg", "am", "jahrhunderts", "fine"]
    assert leaks.words(None) == []


def test_alignment_scores():
    r = random.Random(6)
    pairs = [([r.randrange(5) for _ in range(r.randrange(1, 30))], [r.randrange(5) for _ in range(r.randrange(1, 40))]) for _ in range(60)]

    def brute(a, b):
        h, best = [[0] * (len(a) + 1) for _ in range(len(b) + 1)], 0
        for j in range(1, len(b) + 1):
            for i in range(1, len(a) + 1):
                h[j][i] = max(0, h[j - 1][i - 1] + (1 if a[i - 1] == b[j - 1] else -1), h[j - 1][i] - 1, h[j][i - 1] - 1)
                best = max(best, h[j][i])
        return best

    got = leaks.best_scores([np.array(a) for a, _ in pairs], [np.array(b) for _, b in pairs])
    assert got.tolist() == [brute(a, b) for a, b in pairs]


# -- sentences


def test_sentences_of_the_small_table(spark, small):
    d = table(spark, small, "timeml_docs")
    model = sentences.train(d)
    text = "﻿Nach Prof. Dr. Istfalmun (vgl. Abb. 3) misst die Mauer 2,5 m. „Halt!“ rief H. Kasnor, „die Mauer stürzt.“ Im 3. Jh. v. Chr. ruht sie. \n\nZur Keramik\n\nWusste S. Kas, dass sie alt ist?"
    assert [text[a:b] for a, b, _ in sentences.split(text, model)] == [
        "Nach Prof. Dr. Istfalmun (vgl. Abb. 3) misst die Mauer 2,5 m.", "„Halt!“ rief H. Kasnor, „die Mauer stürzt.“", "Im 3. Jh. v. Chr. ruht sie.", "Zur Keramik", "Wusste S. Kas, dass sie alt ist?",
    ]
    edge = spark.createDataFrame([(1, None, ["x"]), (2, "", None), (3, " \n​", None), (4, "12 345", None), (4, "12 345", None), (None, "Ja.", None)], "tml_id bigint, text string, sentence array<string>")
    assert sorted((r.tml_id or 0, r.start_pos, r.end_pos) for r in sentences.sentence_units(edge, model=model).collect()) == [(0, 0, 3), (4, 0, 6), (4, 0, 6)]
    assert sentences.sentence_units(d.limit(0)).count() == 0
    long = spark.createDataFrame([(1, "Das ist gut. " * 20000)], "tml_id bigint, text string")
    assert sentences.sentence_units(long, model=model).count() == 20000


def test_posteriors_against_all_events():
    """Forward and backward sums equal the sum over all settings of the events."""
    counts = {("", "<s>", "a"): 5, ("<s>", "a", "b."): 4, ("a", "b.", "<s>"): 3, ("b.", "<s>", "a"): 3, ("a", "b.", "a"): 2, ("b.", "a", "b."): 2, ("<s>", "a", "c"): 1, ("a", "c", "<s>"): 2, ("c", "<s>", "a"): 1}
    m = sentences.EventModel(frozenset(), counts)
    words, open_ = ["a", "b.", "a", "b.", "c", "a", "b.", "a", "c"], [False, False, True, False, True, True, False, True, False]
    gaps = [i for i, o in enumerate(open_) if o]
    total, on = 0.0, dict.fromkeys(gaps, 0.0)
    for mask in range(1 << len(gaps)):
        chosen = {g for k, g in enumerate(gaps) if mask >> k & 1}
        stream = ["<s>", words[0]]
        for i in range(1, len(words)):
            stream += ["<s>"] * (i in chosen) + [words[i]]
        stream.append("<s>")
        x = 1.0
        for j in range(2, len(stream)):
            x *= m.p(stream[j - 2], stream[j - 1], stream[j])
        total += x
        for g in chosen:
            on[g] += x
    got = m.posteriors(words, open_)
    assert all(abs(got[g] - on[g] / total) < 1e-9 for g in gaps)


# -- scanned pages


def test_furniture():
    text = "            12\nZUR KERAMIK\n\nDie Mauer ist alt.\nEnde\n\n- 3 -        Reports 5 (1900)"
    assert pages.furniture(text, [pages.key_of("Zur Kcramik"), pages.key_of("Reports 4 (1900)")]) == {0: "page_number", 1: "header", 6: "header"}
    assert pages.furniture("", []) == {} and pages.furniture("12", []) == {0: "page_number"}


def test_paragraphs_of_pages_without_document(spark):
    rows = [(1, "d", 1, "Der Hof ist weit."), (900, None, None, "Das Tor ruht."), (901, None, 1, "Die Mauer ist alt."), (902, None, 1, "Ein Graben.")]
    got = pages.ScannedPages(spark.createDataFrame(rows, "page_id bigint, doc string, page_no int, text string")).paragraphs()
    assert sorted((r.doc or "", r.text) for r in got.collect()) == [("", "Das Tor ruht."), ("", "Die Mauer ist alt."), ("", "Ein Graben."), ("d", "Der Hof ist weit.")]


def test_pages(spark):
    r = random.Random(3)
    nouns = ["Turm", "Hof", "Wall", "Ofen", "Graben", "Brunnen", "Keller", "Hafen", "Garten", "Speicher"]
    sentence = [f"{a} {b} {c} {n}." for a in ("Der", "Jener", "Ein") for b in ("alte", "enge", "runde") for c in ("und", "oder") for n in nouns] + ["Die alte Mauer bezeichnet die Grenze des Marktes.", "Der Graben enthielt mehrere Bruchstücke.", "Das Tor ruht auf dem Felsen am Fuß der Burg."]
    rows = []
    for d in range(12):
        for p in range(1, 7):
            body = " ".join(r.choice(sentence) for _ in range(12)).split()
            lines = [" ".join(body[i : i + 8]) for i in range(0, len(body), 8)]
            rows.append([d * 10 + p, f"d{d}", p, "\n".join([f"Funde aus Kor{d}", *lines, str(p + 40)])])
    # one document with planted defects
    rows[0][3] = "Funde aus Kor0\nDie a1te Mauer be-\nzeichnet die Grenzc des Marktes um l980.\nOst- und West. Das Tor ruht auf dem Fel-\n41"
    rows[1][3] = "Funde aus Kor0\nsen am Fuß der Burg.\n42"
    df = spark.createDataFrame([tuple(x) + ("z",) for x in rows] + [(900, None, None, "Das Tor ruht.", "z"), (901, "e", 1, None, "z")], "page_id bigint, doc string, page_no int, text string, marks string")
    scan = pages.ScannedPages(df)
    got = {(x.line_no, x.defect, x.repaired) for x in scan.defects().where("page_id = 1").collect()}
    assert got == {(0, "header", ""), (1, "char", "alte"), (1, "hyphen", "bezeichnet"), (2, "char", "Grenze"), (2, "char", "1980"), (3, "hyphen", "Felsen"), (4, "page_number", "")}
    assert scan.defects().where("page_id in (900, 901)").count() == 0
    text = " ".join(x.text for x in scan.paragraphs().where("doc = 'd0'").orderBy("para_no").collect())
    assert "Die alte Mauer bezeichnet die Grenze des Marktes um 1980. Ost- und West. Das Tor ruht auf dem Felsen am Fuß der Burg." in text
    assert pages.ScannedPages(df.limit(0)).defects().count() == 0
