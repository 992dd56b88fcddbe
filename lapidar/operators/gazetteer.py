"""Period names from epochs: names, borders, and the epoch that stands for a name.

Epochs have id, names map<lang, array<name>>, begin_border and end_border struct<earliest, latest>, parent_ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapidar.functions import text as T
from lapidar.operators.hierarchy import clean_edges
from lapidar.runtime import Scratch


def latest(df: DataFrame) -> DataFrame:
    """One row for each id: the latest by modified_at, then loaded_at. Aggregated map-side."""
    rest = F.struct(*(c for c in df.columns if c != "id"))
    return df.where("id is not null").groupBy("id").agg(F.max_by(rest, F.struct(F.coalesce(F.col("modified_at").cast("bigint"), F.lit(0)), F.coalesce(F.col("loaded_at").cast("bigint"), F.lit(0)), F.xxhash64(F.to_json(F.struct("begin_border", "end_border"))))).alias("r")).select("id", "r.*")


RELATIONS = ("isListedIn", "isPartOf", "fallsWithin", "isSenseOf")
"""Fixed values: the relations that make one epoch another's parent."""


def parents(relations: Column, id: Column) -> Column:
    """The ids that an epoch's relations (map<string, array<string>>) name as parents, each once; an error at run time if the epoch itself is among them."""
    none = F.array().cast("array<string>")
    every = F.array_distinct(F.flatten(F.array(*(F.coalesce(F.try_element_at(relations, F.lit(k)), none) for k in RELATIONS))))
    return F.when(F.array_contains(every, id), F.raise_error(F.concat(F.lit("own parent: "), id)).cast("array<string>")).otherwise(every)


def usable() -> Column:
    """All four border years are known."""
    return F.col("begin_border.earliest").isNotNull() & F.col("begin_border.latest").isNotNull() & F.col("end_border.earliest").isNotNull() & F.col("end_border.latest").isNotNull()


def years_covered() -> Column:
    return F.coalesce(F.col("end_border.latest") - F.col("begin_border.earliest"), F.lit(0))


def epoch_names(df: DataFrame) -> DataFrame:
    """(lang, name, id): each epoch once for each of its cleaned names; blank and null names don't count."""
    n = df.select("id", F.explode("names").alias("lang", "list")).select("id", "lang", F.explode("list").alias("raw"))
    return n.select("lang", T.clean_period_name(F.col("raw")).alias("name"), "id").where("name <> ''").distinct()


def border_text(border: Column) -> Column:
    return F.when(border.isNull(), "None").otherwise(F.concat(T.year_text(border["earliest"]), F.lit(", "), T.year_text(border["latest"])))


def range_text() -> Column:
    return F.concat(F.lit("["), border_text(F.col("begin_border")), F.lit(", "), border_text(F.col("end_border")), F.lit("]"))


def link(id: Column, base: str) -> Column:
    return F.concat(F.lit("['"), F.lit(base), id, F.lit("']"))


def norm_line(name: Column, links: Column) -> Column:
    return F.concat(F.lit('"'), name, F.lit('","'), range_text(), F.lit(","), links, F.lit('"'))


def representative(df: DataFrame) -> DataFrame:
    """(lang, name, id): the epoch that stands for a name, df holding each id once.

    In the order of ids, a candidate with a parent among the remaining candidates is dropped; of those
    that stay, the one with most years covered is taken, ties by id. So a candidate is dropped if some
    parent of the same name comes later, or comes earlier and stays. A name's epochs are no group:
    parents meet children in a join on (lang, name, id), and what depends on earlier ones is settled
    in as many rounds as such links follow one another.
    """
    s = Scratch(df.sparkSession)
    names = s.keep(epoch_names(df), "names")
    _, edges = clean_edges(df)
    within = (
        names.join(edges, "id").join(names.select("lang", "name", F.col("id").alias("parent")), ["lang", "name", "parent"])
        .where("id <> parent")
    )
    within = s.keep(within, "within")
    gone = s.keep(within.where("parent > id").select("lang", "name", "id").distinct(), "gone")
    # the others hang on earlier parents: stay if all of these are dropped, go if one stays
    opens = s.keep(within.join(gone, ["lang", "name", "id"], "left_anti"), "open")
    waiting = opens.count()
    while waiting:
        undecided = opens.select("lang", "name", "id").distinct()
        key = ["lang", "name", "parent"]
        # a parent that is neither dropped nor undecided stays
        kept = opens.join(gone.withColumnRenamed("id", "parent"), key, "left_anti").join(undecided.withColumnRenamed("id", "parent"), key, "left_anti")
        now_gone = kept.select("lang", "name", "id").distinct()
        gone = s.keep(gone.unionByName(now_gone), "gone")
        rest = opens.join(gone, ["lang", "name", "id"], "left_anti")
        opens = s.keep(rest.join(gone.withColumnRenamed("id", "parent"), key, "left_anti"), "open")
        n = opens.count()
        if n == waiting:
            break
        waiting = n
    left = names.join(gone, ["lang", "name", "id"], "left_anti")
    years = df.select("id", years_covered().alias("years"))
    best = lambda d: d.join(years, "id").groupBy("lang", "name").agg(F.min_by("id", F.struct(-F.col("years"), F.col("id"))).alias("id"))
    return best(left)


def voted(table: DataFrame, lang: str) -> DataFrame:
    """Rows whose name in lang, or else in general, was voted usable."""
    first = lambda c: F.substring(F.coalesce(F.col(c), F.lit("")), 1, 1)
    return table.where((first(f"{lang}_vote") == "U") | ((first(f"{lang}_vote") == "") & (first("vote_general") == "U")))
