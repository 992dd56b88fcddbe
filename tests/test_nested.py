"""Flat tables from nested records, against a plain walk over the decoded JSON."""

import json
import random
from collections import Counter
from datetime import datetime, timedelta

from lapidar.operators import nested

SCHEMA = "delivery_id bigint, record_id string, payload string, harvested_at timestamp, loaded_at timestamp, feed string"
T0 = datetime(2020, 1, 1)


def entries(x):
    return x if isinstance(x, list) else [] if x is None else [x]


def walk(rid, o, path, out):
    for i, u in enumerate(entries(o.get("urls"))):
        v = u.get("url") if isinstance(u, dict) else u
        if v is not None:
            out.append((rid, path, "urls", i, str(v)))
    for i, d in enumerate(entries(o.get("publicationDates"))):
        if d is not None:
            out.append((rid, path, "publicationDates", i, str(d)))
    a = o.get("authors")
    for g in nested.AUTHOR_GROUPS if isinstance(a, dict) else ():
        x = a.get(g)
        for i, n in enumerate(list(x) if isinstance(x, dict) else entries(x)):
            v = n.get("name") if isinstance(n, dict) else n
            if v is not None:
                out.append((rid, path, f"authors.{g}", i, v))
    for i, p in enumerate(entries(o.get("parts"))):
        if isinstance(p, dict):
            walk(rid, p, f"{path}.{i}" if path else str(i), out)


def record(r, depth):
    o = {}
    names = lambda: [f"N{r.randrange(99)}, \"é{i}\"" for i in range(r.randrange(3))]
    if r.random() < 0.7:
        o["urls"] = r.choice([None, [], "http://a.b/{x}", {"url": "u1", "desc": {"lang": "de"}}, ["u2", None, {"desc": "x"}, {"url": None}, {"url": "u}3"}]])
    if r.random() < 0.7:
        o["publicationDates"] = r.choice([1900, "[1864]", ["1901", None, 1902, " 1903 "], [], None])
    if r.random() < 0.7:
        o["authors"] = r.choice([None, [], {"primary": names(), "secondary": dict.fromkeys(names(), [])}, {"primary": "Solo", "corporate": [{"name": "I", "role": ["x"]}, {"role": []}]}])
    if depth and r.random() < 0.8:
        o["parts"] = r.choice([[record(r, depth - 1) for _ in range(r.randrange(4))], record(r, depth - 1), [None, "x", record(r, depth - 1)]])
    return o


def test_random_records(spark):
    r = random.Random(5)
    rows, want = [], []
    for i in range(150):
        o = record(r, 7)
        text = json.dumps(o, ensure_ascii=r.random() < 0.5)
        rows.append((i, f"r{i}", r.choice(["", "﻿", "cb(", ")]',\n"]) + text + r.choice(["", ")", " tail {"]), T0, T0, "f"))
        walk(f"r{i}", o, "", want)
    got = [tuple(x) for x in nested.flatten_records(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert Counter(got) == Counter(want)


def test_latest_readable_delivery(spark):
    ok = lambda v: json.dumps({"urls": [v]})
    rows = [
        (1, "a", ok("old"), T0, T0, "f"), (2, "a", ok("new"), T0 + timedelta(1), T0, "f"), (3, "a", ok("broken")[:-3], T0 + timedelta(2), T0, "f"), (4, "a", None, T0 + timedelta(3), T0, "f"),
        (5, "a", "", T0 + timedelta(4), T0, "f"), (6, "b", "<html>503</html>", T0, T0, "f"), (7, None, ok("x"), T0, T0, "f"), (8, "c", ok("tie1"), None, None, None), (9, "c", ok("tie2"), None, None, None),
    ]
    got = {(x.record_id, x.value) for x in nested.flatten_records(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {("a", "new"), ("c", "tie2")}


def test_empty_table_and_extra_columns(spark):
    empty = spark.createDataFrame([], SCHEMA + ", value string, pos int, path string")
    assert nested.flatten_records(empty).columns == ["record_id", "part_path", "field", "pos", "value"]
    assert nested.flatten_records(empty).count() == 0 and nested.part_table(empty).count() == 0
    one = spark.createDataFrame([(1, "a", '{"title":"t","urls":"u","parts":{"title":"p"}}', T0, T0, "f", "v", 3, "q")], SCHEMA + ", value string, pos int, path string")
    assert [tuple(x) for x in nested.flatten_records(one).collect()] == [("a", "", "urls", 0, "u")]
    assert {(x.part_path, x.parent_path, x.level, x.title) for x in nested.part_table(one).collect()} == {("", None, 0, "t"), ("0", "", 1, "p")}


def test_long_payload(spark):
    o = {"urls": [f"http://x/{i}" for i in range(20000)]}
    rows = [(1, "a", json.dumps(o), T0, T0, "f")]
    assert nested.flatten_records(spark.createDataFrame(rows, SCHEMA)).count() == 20000
