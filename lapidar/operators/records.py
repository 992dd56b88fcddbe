"""Selection of bibliographic records by what their nested lists of urls hold.

Records have id and urls array<struct<url, desc>>. A null list counts as empty, a null url matches nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapidar.functions import text as T


def _urls() -> Column:
    return F.coalesce(F.col("urls"), F.array().cast("array<struct<url:string,desc:string>>"))


def with_url(df: DataFrame) -> DataFrame:
    return df.where(F.size(_urls()) > 0)


def without_descriptions(df: DataFrame, unwanted: list[str]) -> DataFrame:
    """Drops urls of these descriptions, then records without any url."""
    kept = F.filter(_urls(), lambda u: F.coalesce(~u["desc"].isin(unwanted), F.lit(True)))
    return with_url(df.withColumn("urls", kept))


def matching(df: DataFrame, pattern: str) -> DataFrame:
    """Records with some url that matches, with those urls only."""
    hit = lambda u: F.coalesce(u["url"].rlike(pattern), F.lit(False))
    return df.where(F.exists(_urls(), hit)).withColumn("urls", F.filter(_urls(), hit))


def matching_any(df: DataFrame, patterns: list[str]) -> DataFrame:
    """The selections by each pattern, one after another; a record comes once for each pattern that it matches. One scan."""
    hit = lambda u, p: F.coalesce(F.regexp_like(u["url"], p), F.lit(False))
    each = F.transform(F.array(*map(F.lit, patterns)), lambda p: F.struct(p.alias("pattern"), F.filter(_urls(), lambda u: hit(u, p)).alias("urls")))
    some = F.filter(each, lambda x: F.size(x["urls"]) > 0)
    return df.withColumn("_m", F.explode(some)).withColumns({"urls": F.col("_m.urls"), "pattern": F.col("_m.pattern")}).drop("_m")


def host_counts(df: DataFrame) -> DataFrame:
    """(host, n): distinct urls of each host. A host with very many urls is counted in two steps of groups."""
    u = df.select(F.explode(_urls()).alias("u")).select(F.col("u.url").alias("url")).where("url is not null")
    return u.distinct().select(T.host(F.col("url")).alias("host")).groupBy("host").agg(F.count("*").alias("n"))


def common_hosts(df: DataFrame, more_than: int) -> DataFrame:
    return host_counts(df).where(F.col("n") > more_than)


def cooccurrence(df: DataFrame, first: str, second: str) -> DataFrame:
    """One row: records with urls of the first pattern, of the second, and of both."""
    has = lambda p: F.exists(_urls(), lambda u: F.coalesce(u["url"].rlike(p), F.lit(False)))
    per = df.select("id", has(first).alias("a"), has(second).alias("b")).groupBy("id").agg(F.bool_or("a").alias("a"), F.bool_or("b").alias("b"))
    return per.agg(F.count_if("a").alias("n_first"), F.count_if("b").alias("n_second"), F.count_if(F.col("a") & F.col("b")).alias("n_both"))


def reshaped(df: DataFrame) -> DataFrame:
    """(id, first_url, links): links as "url (desc)"."""
    text = F.transform(_urls(), lambda u: F.concat(F.coalesce(u["url"], F.lit("")), F.lit(" ("), F.coalesce(u["desc"], F.lit("")), F.lit(")")))
    return df.select("id", F.try_element_at(_urls(), F.lit(1))["url"].alias("first_url"), F.array_join(text, "|").alias("links"))


def sample(df: DataFrame, n: int, key: str = "id", seed: int = 0) -> DataFrame:
    """n rows, the same ones for the same seed; all if there are fewer."""
    return df.orderBy(F.pmod(F.col(key).cast("bigint") * 48271 + seed, F.lit(2147483647)), key).limit(n)
