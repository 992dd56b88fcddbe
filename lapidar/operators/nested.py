"""Flat tables from deeply nested bibliographic records (problem 1).

Every record is one JSON object whose fields are optional and come in several shapes, and which
holds contained works (``parts``) to any depth. A fold over the payload unrolls the parts level by
level with nested ``transform`` calls that attach the path of ancestor indices, ``flatten`` combines
the levels, and one ``inline`` per target table emits the rows. Nothing is shuffled but the choice
of each record's latest readable delivery.

Raw JSON text is carried for nested values: it keeps the order of keys (names can be keys) and
numbers exactly as written, both of which a sorted binary form would lose.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AUTHOR_GROUPS = ("primary", "secondary", "corporate")
_GROUPS = ",".join(f"{g}:{{0}}" for g in AUTHOR_GROUPS)
RAW = f"urls:string,publicationDates:string,parts:string,title:string,authors:struct<{_GROUPS.format('string')}>"
LIST = f"urls:array<string>,publicationDates:array<string>,parts:array<string>,authors:struct<{_GROUPS.format('array<string>')}>"
NODE = f"array<struct<path:string,raw:struct<{RAW}>,list:struct<{LIST}>>>"
"""A record or part: its fields as raw text, and as lists where they are; each text is parsed once either way."""
ROW = "array<struct<part_path:string,field:string,pos:bigint,value:string>>"


def json_object_text(payload: Column) -> Column:
    """The text from the first ``{`` on; null unless a complete JSON object starts there."""
    text = F.substring(payload, F.instr(payload, "{"), F.length(payload))
    return F.when((F.instr(payload, "{") > 0) & F.json_object_keys(text).isNotNull(), text)


def latest_readable(df: DataFrame) -> DataFrame:
    """One row (record_id, body) for each record_id: its readable delivery with the greatest harvested_at.

    Ties go to the later loaded_at, then the greater delivery_id. Rows with a null record_id and
    records without any readable delivery give no row. Aggregated map-side before the shuffle, so a
    record delivered very often doesn't pile up in one task.
    """
    order = F.struct(
        F.col("harvested_at").isNotNull(), F.col("harvested_at"), F.col("loaded_at").isNotNull(), F.col("loaded_at"), F.col("delivery_id")
    )
    return (
        df.select("record_id", json_object_text(F.col("payload")).alias("body"), order.alias("o"))
        .where(F.col("body").isNotNull() & F.col("record_id").isNotNull())
        .groupBy("record_id")
        .agg(F.max_by("body", "o").alias("body"))
    )


def _is_object(raw: Column) -> Column:
    return F.json_object_keys(raw).isNotNull()


def _entries(as_list: Column, raw: Column) -> Column:
    """A list as it is; a single value as a list of one; null as no entry."""
    return F.coalesce(as_list, F.when(raw.isNotNull(), F.array(raw)), F.array().cast("array<string>"))


def _node(path: Column, body: Column) -> Column:
    return F.struct(path.alias("path"), F.from_json(body, f"struct<{RAW}>").alias("raw"), F.from_json(body, f"struct<{LIST}>").alias("list"))


def _children(node: Column) -> Column:
    """The parts of a node, each with its path of indexes. Entries that aren't objects keep their index but are no part."""
    prefix = F.when(node["path"] == "", F.lit("")).otherwise(F.concat(node["path"], F.lit(".")))
    entries = F.transform(_entries(node["list"]["parts"], node["raw"]["parts"]), lambda p, i: F.struct(F.concat(prefix, i.cast("string")).alias("path"), p.alias("body")))
    return F.transform(F.filter(entries, lambda c: c["body"].isNotNull() & _is_object(c["body"])), lambda c: _node(c["path"], c["body"]))


def all_nodes(body: Column) -> Column:
    """The record and all its parts at every level, as NODE.

    The fold takes as many steps as the text mentions the key, which is never less than the depth;
    once no part is left, further steps work on an empty array. A text that escapes letters could
    hide the key's name, so there each ``{`` counts as a possible level.
    """
    named = F.size(F.split(body, '"parts"', -1)) - 1
    steps = F.when(body.rlike(r"\\u00[67]"), F.size(F.split(body, r"\{", -1))).otherwise(named)
    root = F.array(_node(F.lit(""), body)).cast(NODE)
    start = F.struct(root.alias("all"), root.alias("last"))

    def deeper(state: Column, _: Column) -> Column:
        below = F.flatten(F.transform(state["last"], _children)).cast(NODE)
        return F.when(F.size(state["last"]) == 0, state).otherwise(F.struct(F.concat(state["all"], below).alias("all"), below.alias("last")))

    # an int64 0..n sequence; n = 0 gives no step
    turns = F.when(steps > 0, F.sequence(F.lit(1), steps)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(turns, start, deeper, lambda s: s["all"])


def _rows(node: Column, field: str, values: Column) -> Column:
    """Rows for the entries that hold a value; the place counts all entries."""
    numbered = F.transform(
        values, lambda v, i: F.struct(node["path"].alias("part_path"), F.lit(field).alias("field"), i.cast("bigint").alias("pos"), v.alias("value"))
    )
    return F.filter(numbered, lambda r: r["value"].isNotNull()).cast(ROW)


def _inside(entry: Column, key: str) -> Column:
    """An entry's own text, or the named field if the entry is an object."""
    return F.when(_is_object(entry), F.from_json(entry, f"{key} string")[key]).otherwise(entry)


def url_rows(node: Column) -> Column:
    return _rows(node, "urls", F.transform(_entries(node["list"]["urls"], node["raw"]["urls"]), lambda e: _inside(e, "url")))


def date_rows(node: Column) -> Column:
    key = "publicationDates"
    return _rows(node, key, F.transform(_entries(node["list"][key], node["raw"][key]), lambda e: _inside(e, "date")))


def author_rows(node: Column) -> Column:
    """Names are entries of a list (strings or objects with a name), keys of an object, or a single string."""
    out = []
    for g in AUTHOR_GROUPS:
        raw, as_list = node["raw"]["authors"][g], node["list"]["authors"][g]
        name = F.from_json(raw, "name string")["name"]
        shaped = F.when(as_list.isNull() & _is_object(raw), F.when(name.isNotNull(), F.array(name)).otherwise(F.json_object_keys(raw)))
        values = F.coalesce(F.transform(as_list, lambda e: _inside(e, "name")), shaped, _entries(as_list, raw))
        out.append(_rows(node, f"authors.{g}", values))
    return F.concat(*out)


TARGETS = {"urls": url_rows, "publicationDates": date_rows, "authors": author_rows}


def flatten_records(df: DataFrame, targets: tuple[str, ...] = tuple(TARGETS)) -> DataFrame:
    """Rows (record_id, part_path, field, pos, value) of the chosen targets, each tied to its record and part.

    df has record_id, payload, harvested_at, loaded_at, delivery_id; other columns are ignored.
    Null, empty or unreadable payloads give nothing; empty lists, nulls and objects of another shape
    give no row; an empty string is a value.
    """
    nodes = latest_readable(df).select("record_id", all_nodes(F.col("body")).alias("nodes"))
    per_node = lambda n: F.concat(*(TARGETS[t](n) for t in targets))
    return nodes.select("record_id", F.inline(F.flatten(F.transform("nodes", per_node))))


def part_table(df: DataFrame) -> DataFrame:
    """(record_id, part_path, parent_path, level, title) of every record and part: the parent side of the links."""
    nodes = latest_readable(df).select("record_id", all_nodes(F.col("body")).alias("nodes"))
    row = lambda n: F.struct(
        n["path"].alias("part_path"),
        F.when(n["path"] == "", F.lit(None).cast("string")).otherwise(F.regexp_replace(n["path"], r"\.?[0-9]+$", "")).alias("parent_path"),
        F.when(n["path"] == "", F.lit(0)).otherwise(F.size(F.split(n["path"], r"\."))).alias("level"),
        n["raw"]["title"].alias("title"),
    )
    return nodes.select("record_id", F.inline(F.transform("nodes", row)))
