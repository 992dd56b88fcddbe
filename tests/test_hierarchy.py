"""Hierarchies against a walk over the graph."""

import random
from collections import Counter

import pytest

from lapidar.operators import gazetteer, hierarchy

SCHEMA = "id string, parent_ids array<string>, depth int, head string"


def expected(rows):
    ids = {i for i, _ in rows if i is not None}
    parents = {i: set() for i in ids}
    for i, ps in rows:
        if i is not None:
            parents[i] |= {p.strip() for p in ps or [] if p is not None and p.strip() in ids}
    kids = {i: [j for j in ids if i in parents[j]] for i in ids}

    def below(i):
        seen, todo = set(), list(kids[i])
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += kids[x]
        return seen

    under = {i: below(i) for i in ids}
    cyclic = {i for i in ids if i in under[i]}
    bad = set().union(*(under[i] for i in cyclic)) if cyclic else set()
    out = [(i, "cycle", "", -1, "") for i in cyclic] + [(i, "below", "", -1, "") for i in bad - cyclic]
    ways = {}

    def paths(i):
        if i not in ways:
            ways[i] = [[i]] if not parents[i] else [w + [i] for p in sorted(parents[i]) for w in paths(p)]
        return ways[i]

    for i in ids - bad - cyclic:
        out += [(i, "path", w[0], len(w) - 1, "/".join(w)) for w in paths(i)]
    pairs = {(w[k], i) for i in ids - bad - cyclic for w in paths(i) for k in range(len(w) - 1)}
    return Counter(out), pairs


def run(spark, rows):
    return hierarchy.Hierarchy(spark.createDataFrame([(i, p, 1, "x") for i, p in rows], SCHEMA))


def check(spark, rows):
    h = run(spark, rows)
    want, pairs = expected(rows)
    assert Counter(map(tuple, h.paths().collect())) == want
    got = {tuple(r) for r in h.descendants().collect()}
    assert got == below(rows) and pairs <= got


def test_shapes(spark):
    rows = [
        ("r", None), ("a", ["r"]), ("b", ["a", " a ", None]), ("c", ["b", "x"]), ("d", ["b", "e"]), ("e", ["r"]), ("f", ["d"]), ("f", ["d"]), (None, ["a"]), ("g", ["nobody"]), ("h", []),
        ("s", ["s"]), ("s2", ["s"]), ("s3", ["s2", "r"]), ("p", ["q"]), ("q", ["p", "r"]), ("t", ["q"]), ("u", ["w"]), ("w", ["v"]), ("v", ["u"]), ("z", ["v"]), ("y", ["z", "t"]),
        # two cycles with a node between them
        ("m", ["m"]), ("k", ["m"]), ("l", ["k", "l"]),
    ]
    check(spark, rows)


def below(rows):
    """(id, descendant) by walking down from each node."""
    ids = {i for i, _ in rows if i is not None}
    kids = {i: set() for i in ids}
    for i, ps in rows:
        for p in ps or []:
            if i is not None and p is not None and p.strip() in ids:
                kids[p.strip()].add(i)
    out = set()
    for i in ids:
        todo = list(kids[i])
        while todo:
            x = todo.pop()
            if (i, x) not in out:
                out.add((i, x))
                todo += kids[x]
    return out


@pytest.mark.parametrize("rows", [
    # a cycle at the root of an ordinary subtree
    [("u", ["v"]), ("v", ["u"]), ("a", ["v"]), ("b", ["a"]), ("c", ["a"]), ("d", ["c", "r"]), ("r", None), ("e", ["d"]), ("s", ["s"])],
    # a cycle through heads of several parents and through trees
    [("r", []), ("p", ["q", "r"]), ("x", ["p"]), ("q", ["x"]), ("y", ["x"]), ("t", ["y", "m"]), ("m", ["m"]), ("k", ["m"]), ("l", ["k", "l"]), ("z", ["l"])],
    [(f"n{i:02}", [f"n{random.Random(i * 7 + j).randrange(60):02}" for j in range((1, 1, 1, 2)[i % 4])]) for i in range(60)],
])
def test_descendants(spark, rows):
    got = [tuple(r) for r in run(spark, rows).descendants().collect()]
    assert len(got) == len(set(got)) and set(got) == below(rows)


def test_random(spark):
    r = random.Random(3)
    rows = []
    for i in range(120):
        n = r.choices([0, 1, 2, 3], [1, 12, 2, 1])[0]
        rows.append((f"n{i:03}", [f"n{r.randrange(max(1, i)) if r.random() < 0.97 else r.randrange(120):03}" for _ in range(n)]))
    check(spark, rows)


def test_hot_parent_and_rulers(spark, monkeypatch):
    monkeypatch.setattr(hierarchy, "LAST_LIST", 5)
    monkeypatch.setattr(hierarchy, "SALT_LEVEL", 3)
    rows = [("top", [])] + [(f"k{i:03}", ["top"]) for i in range(200)] + [(f"c{i:03}", [f"c{i - 1:03}" if i else "k007"]) for i in range(60)]
    check(spark, rows)


def test_more_trees_than_the_last_list_holds(spark, monkeypatch):
    """Trees without rulers, single nodes among them, leave the ranking; before, it went on for ever."""
    monkeypatch.setattr(hierarchy, "LAST_LIST", 5)
    rank, levels = hierarchy.Hierarchy._rank, []

    def bounded(self, links, level):
        levels.append(level)
        assert level < 8, "the lists of rulers don't get shorter"
        return rank(self, links, level)

    monkeypatch.setattr(hierarchy.Hierarchy, "_rank", bounded)
    rows = [(f"r{i:02}", []) for i in range(30)] + [(f"c{i:02}", [f"r{i:02}"]) for i in range(20)] + [(f"d{i:03}", [f"d{i - 1:03}" if i else "c03"]) for i in range(150)]
    check(spark, rows + [("t", ["c01", "c02"]), ("u", ["t"])])
    assert max(levels) > 1


def test_empty(spark):
    h = run(spark, [])
    assert h.paths().count() == 0 and h.descendants().count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_representative_epoch(spark, seed):
    r = random.Random(seed)
    n = 40
    rows = [(f"e{i:02}", {"de": [f"Name {r.randrange(4)} (x)", None]} if r.random() < 0.9 else None, (r.randrange(-50, 50), 0), (r.randrange(50, 90), r.randrange(90, 200)), [f"e{r.randrange(n):02}" for _ in range(r.randrange(3))]) for i in range(n)]
    df = spark.createDataFrame(rows, "id string, names map<string,array<string>>, begin_border struct<earliest:int,latest:int>, end_border struct<earliest:int,latest:int>, parent_ids array<string>")
    got = {(x.lang, x.name): x.id for x in gazetteer.representative(df).collect()}
    groups = {}
    for i, names, b, e, ps in rows:
        for x in (names or {}).get("de", []):
            if x:
                groups.setdefault(("de", x.replace(" (x)", "")), []).append((i, e[1] - b[0], set(ps)))
    want = {}
    for key, members in groups.items():
        members.sort()
        left = {m[0] for m in members}
        for m in members:
            if left & (m[2] - {m[0]}):
                left.discard(m[0])
        best = sorted((-m[1], m[0]) for m in members if m[0] in left)
        if best:
            want[key] = best[0][1]
    assert got == want
