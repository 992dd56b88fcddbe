"""Comparison of gold and system annotations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



TAG = "struct<tag_seq:int,text:string,attrs:map<string,string>,start_in_line:int,end_in_line:int>"
_ENTRY = "array<struct<task_type:string,attr_name:string,result_type:string,tag1:%s,tag2:%s>>" % (TAG, TAG)


def by_line(tags: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, tags): a line's tags as one array, of rows with tag_seq, text, attrs, start_in_line, end_in_line (inclusive)."""
    tag = F.struct("tag_seq", "text", "attrs", "start_in_line", "end_in_line").cast(TAG)
    return tags.groupBy(*keys).agg(F.collect_list(tag).alias("tags"))


def decisions(gold: DataFrame, system: DataFrame, keys: list[str], attributes: tuple[str, ...] = ("type", "value")) -> DataFrame:
    """(task_type, attr_name, result_type, keys, tag1, tag2): what each tag and pair of tags counts as.

    gold and system have keys and tags, an array of TAG for each line. Each overlapping pair is one
    match; a pair with unequal text or value is a false positive and a false negative; a gold tag
    without the attribute still is a possible match. Empty elements (null positions) overlap
    nothing. Lines meet in one full join by their keys; within a line tags are compared as arrays,
    so either side is read and shuffled once.
    """
    none = F.array().cast(f"array<{TAG}>")
    both = gold.select(*keys, F.col("tags").alias("g")).join(system.select(*keys, F.col("tags").alias("s")), keys, "full")
    both = both.select(*keys, F.coalesce("g", none).alias("g"), F.coalesce("s", none).alias("s"))

    def hit(a: Column, b: Column) -> Column:
        return F.coalesce((a["start_in_line"] <= b["end_in_line"]) & (b["start_in_line"] <= a["end_in_line"]), F.lit(False))

    def entry(task: str, attr: str, result: str, one: Column, two: Column | None = None) -> Column:
        second = two if two is not None else F.lit(None).cast(TAG)
        return F.struct(F.lit(task).alias("task_type"), F.lit(attr).alias("attr_name"), F.lit(result).alias("result_type"), one.alias("tag1"), second.alias("tag2"))

    def value(t: Column, a: str) -> Column:
        return F.coalesce(F.try_element_at(t["attrs"], F.lit(a)), F.lit(""))

    def pair(g: Column, s: Column) -> Column:
        wrong = lambda task, attr: F.array(entry(task, attr, "FP", g, s), entry(task, attr, "FN", g, s))
        out = [
            F.array(entry("TAG_RELAXED", "", "TP", g, s)),
            F.when(F.trim(g["text"]) == F.trim(s["text"]), F.array(entry("TAG_STRICT", "", "TP", g, s))).otherwise(wrong("TAG_STRICT", "")),
        ]
        for a in attributes:
            empty = F.array().cast(_ENTRY)
            out.append(F.array(entry("ATTRIBUTE", a, "ATTR_MATCH_POSSIBLE", g, s)))
            out.append(F.when(value(g, a) == "", empty).when(value(g, a) == value(s, a), F.array(entry("ATTRIBUTE", a, "TP", g, s))).otherwise(wrong("ATTRIBUTE", a)))
        return F.concat(*(x.cast(_ENTRY) for x in out))

    def lone(t: Column, result: str) -> Column:
        return F.array(entry("TAG_RELAXED", "", result, t), entry("TAG_STRICT", "", result, t), *(entry("ATTRIBUTE", a, result, t) for a in attributes)).cast(_ENTRY)

    pairs = F.flatten(F.transform("g", lambda g: F.flatten(F.transform(F.filter("s", lambda s: hit(g, s)), lambda s: pair(g, s)))))
    lone_g = F.flatten(F.transform(F.filter("g", lambda g: ~F.exists("s", lambda s: hit(g, s))), lambda g: lone(g, "FN")))
    lone_s = F.flatten(F.transform(F.filter("s", lambda s: ~F.exists("g", lambda g: hit(g, s))), lambda s: lone(s, "FP")))
    rows = both.select(*keys, F.inline(F.concat(pairs, lone_g, lone_s)))
    return rows.select("task_type", "attr_name", "result_type", *keys, "tag1", "tag2")


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(float("nan"))).otherwise(a / F.nullif(b, F.lit(0)))


def f_score(p: Column, r: Column, beta: float) -> Column:
    b = beta * beta
    none = F.isnan(p) | F.isnan(r) | ((p == 0) & (r == 0))
    return F.when(none, F.lit(float("nan"))).otherwise((1 + b) * p * r / F.nullif(b * p + r, F.lit(0.0)))


def scores(d: DataFrame, by: list[str] | None = None) -> DataFrame:
    """tp, fp, fn, max_matches, precision, recall, f05, f1, f2, accuracy for each task and attribute (and by); undefined ones are NaN."""
    by = ["task_type", "attr_name", *(by or [])]
    n = lambda r: F.count_if(F.col("result_type") == r)
    c = d.groupBy(*by).agg(n("TP").alias("tp"), n("FP").alias("fp"), n("FN").alias("fn"), n("ATTR_MATCH_POSSIBLE").alias("max_matches"))
    return with_scores(c)


def with_scores(c: DataFrame) -> DataFrame:
    c = c.withColumn("p", _ratio(F.col("tp").cast("double"), F.col("tp") + F.col("fp"))).withColumn("r", _ratio(F.col("tp").cast("double"), F.col("tp") + F.col("fn")))
    six = lambda x: F.round(x, 6)
    return c.select(
        *(x for x in c.columns if x not in ("p", "r")),
        six(F.col("p")).alias("precision"),
        six(F.col("r")).alias("recall"),
        *(six(f_score(F.col("p"), F.col("r"), b)).alias(n) for n, b in (("f05", 0.5), ("f1", 1.0), ("f2", 2.0))),
        six(_ratio(F.col("tp").cast("double"), F.col("max_matches"))).alias("accuracy"),
    )


def count_differences(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row (mean, differing): how far two counts lie apart on average, and the share of rows where they differ."""
    gap = F.abs(F.col(a) - F.col(b))
    return df.agg(F.round(F.avg(gap), 6).alias("mean"), F.round(F.avg((gap > 0).cast("int")), 6).alias("differing"))


def involving(d: DataFrame, attr: str, value: str, keep: bool = True) -> DataFrame:
    """Decisions in which some tag has that value, or those in which none has."""
    has = lambda t: F.coalesce(F.try_element_at(F.col(f"{t}.attrs"), F.lit(attr)) == value, F.lit(False))
    any_ = has("tag1") | has("tag2")
    return d.where(any_ if keep else ~any_)
