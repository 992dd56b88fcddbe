"""Translations: walks over links between terms, similar terms, and merging of candidate lists."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapidar.runtime import Scratch


def walk(edges: DataFrame, starts: DataFrame, most: int) -> DataFrame:
    """(start, node, depth): nodes reached from each start within most steps, at their least depth; most < 0 knows no end. edges (src, dst), starts (start).

    Breadth first: each round goes on only from nodes that are new for their start. Without end, each round's table is written out.
    """
    if most < 0:
        return _walk_on(edges, starts)
    front = starts.select("start", F.col("start").alias("node")).distinct()
    seen = front.withColumn("depth", F.lit(0))
    for depth in range(1, most + 1):
        step = front.join(edges, front["node"] == edges["src"]).select("start", F.col("dst").alias("node")).distinct()
        front = step.join(seen.select("start", "node"), ["start", "node"], "left_anti")
        seen = seen.unionByName(front.withColumn("depth", F.lit(depth)))
    return seen


def _walk_on(edges: DataFrame, starts: DataFrame) -> DataFrame:
    s = Scratch(edges.sparkSession)
    edges = s.keep(edges.select("src", "dst").distinct(), "edges")
    front = s.keep(starts.select("start", F.col("start").alias("node")).distinct().withColumn("depth", F.lit(0)), "front0")
    seen = front
    for depth in itertools.count(1):
        step = front.join(edges, front["node"] == edges["src"]).select("start", F.col("dst").alias("node")).distinct()
        front, n = s.counted(step.join(seen.select("start", "node"), ["start", "node"], "left_anti").withColumn("depth", F.lit(depth)), f"front{depth}")
        if not n:
            return seen
        seen = seen.unionByName(front)


def source_first(translations: DataFrame, inputs: DataFrame, source: str, key: str) -> DataFrame:
    """(key, rank, lang, term): each input (key, term) at rank 0, then its translations (key, lang, term), once each: those in the source language, then by language and term."""
    order = Window.partitionBy(key).orderBy(F.col("lang") != source, "lang", "term")
    rest = translations.select(key, "lang", "term").distinct().withColumn("rank", F.row_number().over(order).cast("bigint"))
    head = inputs.select(key, F.lit(source).alias("lang"), "term", F.lit(0).cast("bigint").alias("rank"))
    return head.unionByName(rest, allowMissingColumns=False).select(key, "rank", "lang", "term")


def similar(left: DataFrame, right: DataFrame, key: str, a: str, b: str, most: int = 3) -> DataFrame:
    """Pairs of one key whose words differ by at most so many letters, with their distance."""
    return left.join(right, key).withColumn("distance", F.levenshtein(F.col(a), F.col(b), most)).where("distance >= 0")


def labels_of(triples: DataFrame, terms: DataFrame | None = None, lang: str = "en") -> DataFrame:
    """(term, labels): all labels of the subjects that carry the term in lang. triples (subject, label, lang), terms (term); without terms, every label in lang is one.

    Joined by subject, so that a term of many subjects is no hot key; its (term, label) are made
    distinct map-side before the lists are made.
    """
    named = triples.where(F.col("lang") == lang).select("subject", F.col("label").alias("term"))
    if terms is not None:
        named = named.join(terms, "term", "left_semi")
    pairs = named.join(triples.select("subject", F.concat("lang", F.lit(":"), "label").alias("l")), "subject").select("term", "l").distinct()
    return pairs.groupBy("term").agg(F.array_join(F.array_sort(F.collect_list("l")), "|").alias("labels"))


def candidates(pairs: Column, lang: str, original: Column) -> Column:
    """The terms of lang in a list of (lang, term) joined by ||; empty where that is the original itself."""
    joined = F.array_join(F.transform(F.filter(pairs, lambda p: p["lang"] == lang), lambda p: p["term"]), "||")
    return F.when(F.trim(joined) == F.trim(original), "").otherwise(F.coalesce(joined, F.lit("")))


def preferred(columns: list[str], original: str = "original") -> Column:
    """The first term of the first column that isn't blank, else the original."""
    first = [F.when(F.trim(F.col(c)) != "", F.split_part(F.col(c), F.lit("||"), F.lit(1))) for c in columns]
    return F.coalesce(*first, F.col(original))


def merged(original: DataFrame, lists: dict[str, DataFrame], lang: str) -> DataFrame:
    """original (line_no, original) joined by line with lists (line_no, pairs) of each label, a column per label; lines without a list get empty ones."""
    out = original
    for label, d in lists.items():
        out = out.join(d.select("line_no", F.col("pairs").alias("_p")), "line_no", "left")
        out = out.withColumn(label, F.coalesce(candidates(F.col("_p"), lang, F.col("original")), F.lit(""))).drop("_p")
    return out


def with_norms(translations: DataFrame, norms: DataFrame) -> DataFrame:
    """translations (line_no, translation) with norms (line_no, norm) by line; an error at run time if either has a line that the other lacks."""
    both = translations.join(norms, "line_no", "full")
    whole = F.col("translation").isNotNull() & F.col("norm").isNotNull()
    return both.withColumn("norm", F.when(whole, F.col("norm")).otherwise(F.raise_error(F.concat(F.lit("no counterpart for line "), F.col("line_no").cast("string")))))
