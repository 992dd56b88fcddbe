"""Reports over evaluation decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


# Names of tasks, in full and short.
ATTRIBUTE, RELAXED, STRICT = (f"task_type in ('{a}', '{b}')" for a, b in (("ATTRIBUTE", "ATTR"), ("TAG_RELAXED", "RELAXED"), ("TAG_STRICT", "STRICT")))


def runs(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Rows of df whose value differs from the row before within their group; nulls are equal to each other."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).withColumn("_b", F.lag(value).over(w)).where((F.col("_n") == 1) | ~F.col("_b").eqNullSafe(F.col(value))).drop("_n", "_b")


def false_normalised(d: DataFrame) -> DataFrame:
    return d.where(f"{ATTRIBUTE} and attr_name = 'value' and result_type = 'FN' and tag1_attr_value <> tag2_attr_value")


def false_positives(d: DataFrame) -> DataFrame:
    return d.where(f"{RELAXED} and result_type = 'FP'")


def false_negatives(d: DataFrame) -> DataFrame:
    return d.where(f"{RELAXED} and result_type = 'FN'")


def strict_mismatches(d: DataFrame) -> DataFrame:
    """Strict false positives that are neither a relaxed one nor wrongly normalised.

    The two exclusions are null-aware: one null id in them leaves nothing, and a null id of one's own is never let through.
    As null-aware anti joins broadcast their right side, the rule is spelt out with one look for nulls and plain anti joins.
    """
    out = d.where(f"{STRICT} and result_type = 'FP'")
    for other in (false_positives(d), false_normalised(d)):
        ids = other.select("tag1_attr_tid")
        if not ids.where("tag1_attr_tid is null").isEmpty():
            return out.where(F.lit(False))
        if not ids.isEmpty():
            out = out.where("tag1_attr_tid is not null").join(ids.distinct(), "tag1_attr_tid", "left_anti")
    return out.select(d.columns)


def positions(d: DataFrame, extra: Column | None = None) -> DataFrame:
    """(basename, pos): distinct starts of gold tags, over all tasks."""
    g = d.where(F.col("tag1_is_gold") if extra is None else F.col("tag1_is_gold") & extra)
    return g.select(F.col("tag1_basename").alias("basename"), F.col("tag1_text_pos_start").alias("pos")).where("pos is not null").distinct()


def histogram(pos: DataFrame, sizes: DataFrame, bins: int = 20) -> DataFrame:
    """(basename, bin, n, occurrences): pos (basename, pos) by place in the text; sizes (basename, chars)."""
    placed = pos.join(sizes.where("chars > 0"), "basename").select("basename", F.expr(f"cast({bins} * cast(pos as bigint) div chars as bigint)").alias("bin"))
    per = placed.groupBy("basename", "bin").agg(F.count("*").alias("n"))
    return per.withColumn("occurrences", F.sum("n").over(Window.partitionBy("basename")))  # at most bins + 1 rows for a text


def histogram_sum(h: DataFrame) -> DataFrame:
    return h.groupBy("bin").agg(F.sum("n").alias("n"))


def histogram_mean(h: DataFrame, texts: int | Column) -> DataFrame:
    """Mean over all texts of each text's shares, rounded to four places before and after."""
    # in whole ten-thousandths, halves up
    share = F.expr("(20000 * n + occurrences) div (2 * occurrences)")
    return h.groupBy("bin").agg(F.sum(share).alias("s")).select("bin", (F.floor((2 * F.col("s") + texts) / (2 * texts)) / 10000).alias("mean"))
