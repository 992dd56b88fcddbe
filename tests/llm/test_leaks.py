import random

import numpy as np

from lapidar.llm import leaks


def words(r, n, vocabulary):
    return [r.choice(vocabulary) for _ in range(n)]


def test_lists_find_what_all_pairs_find():
    """Candidates from the nearest lists against cosines of all passages with all passages."""
    r = random.Random(2)
    vocabulary = ["".join(r.choice("abcdefghijk") for _ in range(6)) for _ in range(2000)]
    items = [words(r, 60, vocabulary) for _ in range(200)]
    docs = [words(r, 40, vocabulary) + (items[d % 200][10:50] if d % 3 == 0 else []) + words(r, 40, vocabulary) for d in range(300)]
    hashed = [list(leaks._hashed(" ".join(x) for x in xs)) for xs in (items, docs)]
    latent = leaks._with_zero(np.random.default_rng(1).standard_normal((leaks.FEATURES, 64)))
    index = leaks.Items(list(range(200)), hashed[0], np.ones(leaks.FEATURES), latent)
    assert index.probes * 4 < len(index.centroids)
    offsets = np.cumsum([0] + [len(x) for x in hashed[1]])
    flat = np.concatenate(hashed[1])
    got = set(leaks.candidates(index, latent, flat, offsets))
    row, start, end = leaks._windows(offsets, leaks.DOC_STRIDE)
    near = leaks._unit(leaks._sums(latent, flat & (leaks.FEATURES - 1), offsets, start, end)) @ index.passages.T >= leaks.COSINE
    i, q = np.nonzero(near)
    brute = set(zip(row[i].tolist(), index.of[q].tolist(), strict=True))
    assert got <= brute and len(got) >= 0.98 * len(brute) >= 95


def test_paraphrase_keeps_its_answers():
    item = np.arange(40)
    weight = np.where(np.arange(40) % 4 == 0, 9.0, 1.0)
    part = item.copy()
    part[np.arange(40) % 4 == 1] = 1000 + np.arange(10)  # a quarter changed, common words only
    share, matched, answers = leaks.accepted(item, weight, part)
    assert share > 0.9 and leaks.PARAPHRASE <= matched < leaks.MATCH and answers == 1
    part = item.copy()
    part[np.arange(40) % 4 == 0] = 1000 + np.arange(10)  # the rare words changed
    assert leaks.accepted(item, weight, part) is None


def test_blocks_of_items(spark, monkeypatch):
    r = random.Random(5)
    vocabulary = ["".join(r.choice("abcdefghijk") for _ in range(6)) for _ in range(2000)]
    items = [words(r, 50, vocabulary) for _ in range(12)]
    docs = [(d, " ".join(words(r, 30, vocabulary) + items[d % 12][5:40])) for d in range(60)]
    monkeypatch.setattr(leaks, "ITEM_BLOCK", 5)
    got = leaks.leaked(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id bigint, text string"))
    assert {(x.doc_id, x.item_id) for x in got.collect()} == {(d, d % 12) for d in range(60)}


def test_passages_cover_all_words():
    r = np.random.default_rng(3)
    lengths = [0, 1, 3, 4, 19, 20, 21, 24, 25, 57, 0, 130]
    offsets = np.cumsum([0] + lengths)
    f = r.integers(0, 50, offsets[-1])
    table = leaks._with_zero(r.standard_normal((50, 3)))
    for stride in (leaks.ITEM_STRIDE, leaks.DOC_STRIDE, leaks.WINDOW):
        row, start, end = leaks._windows(offsets, stride)
        seen = {x for a, z in zip(start, end, strict=True) for x in range(a, z)}
        assert seen == set(range(offsets[-1])) and set(row.tolist()) == {i for i, n in enumerate(lengths) if n}
        want = np.array([table[f[a:z]].sum(axis=0) for a, z in zip(start, end, strict=True)])
        assert np.allclose(leaks._sums(table, f, offsets, start, end), want, atol=1e-4)
