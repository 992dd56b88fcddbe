"""Inline markup as arrays of events, without any shuffle.

A line or document is cut once into tags and text. All that looks like a tree is a fold over the
events of one row: open elements are a stack, character offsets a running sum. Markup is expected
to be well formed, without > in attribute values; an end tag closes the nearest open element of its
name, what is never closed gives no span.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapidar.functions import text as T

PIECE = r"(<[^>]+>|[^<]+)"
SPAN = "struct<tag_seq:int,name:string,attrs:map<string,string>,start:int,end:int,depth:int,ancestors:array<string>>"
_OPEN = "array<struct<seq:int,name:string,tag:string,start:int>>"


def pieces(markup: Column) -> Column:
    return F.regexp_extract_all(markup, F.lit(PIECE), F.lit(1))


def is_text(p: Column) -> Column:
    return ~p.startswith("<")


def tag_name(p: Column) -> Column:
    return F.regexp_extract(p, r"^</?([^\s/>]+)", 1)


def attributes(p: Column) -> Column:
    names = F.regexp_extract_all(p, F.lit(r'([\w:.-]+)="([^"]*)"'), F.lit(1))
    values = F.regexp_extract_all(p, F.lit(r'([\w:.-]+)="([^"]*)"'), F.lit(2))
    return F.map_from_arrays(names, F.transform(values, T.unescape_xml))


def plain_text(markup: Column) -> Column:
    """All text without tags, character references resolved."""
    return T.unescape_xml(F.array_join(F.filter(pieces(markup), is_text), ""))


def spans(markup: Column) -> Column:
    """array of SPAN, in document order: half-open character offsets in the plain text, depth from 0, names of the elements around, outermost first."""

    kind = "array<struct<tag_seq:int,name:string,tag:string,start:int,end:int,depth:int,ancestors:array<string>>>"
    state = f"struct<at:int,seq:int,open:{_OPEN},done:{kind}>"

    def now(at: Column, seq: Column, open_: Column, done: Column) -> Column:
        return F.struct(at.alias("at"), seq.alias("seq"), open_.alias("open"), done.alias("done")).cast(state)

    def bound(x: Column, f) -> Column:
        """f of x, x worked out once."""
        return F.transform(F.array(x), f)[0]

    def closed(acc: Column, p: Column) -> Column:
        def with_rest(last: Column, rest: Column) -> Column:
            done = F.struct(
                last["seq"].alias("tag_seq"), last["name"].alias("name"), last["tag"].alias("tag"), last["start"].alias("start"), acc["at"].alias("end"),
                F.size(rest).alias("depth"), F.transform(rest, lambda o: o["name"]).alias("ancestors"),
            )
            return now(acc["at"], acc["seq"], rest, F.concat(acc["done"], F.array(done).cast(kind)))

        def with_last(last: Column) -> Column:
            return F.when(last.isNull(), acc).otherwise(bound(F.filter(acc["open"], lambda o: o["seq"] < last["seq"]), lambda rest: with_rest(last, rest)))

        return bound(tag_name(p), lambda name: bound(F.try_element_at(F.filter(acc["open"], lambda o: o["name"] == name), F.lit(-1)), with_last))

    def step(acc: Column, p: Column) -> Column:
        new = F.struct(acc["seq"].alias("seq"), tag_name(p).alias("name"), p.alias("tag"), acc["at"].alias("start"))
        return (
            F.when(is_text(p), now(acc["at"] + F.length(T.unescape_xml(p)), acc["seq"], acc["open"], acc["done"]))
            .when(p.startswith("</"), closed(acc, p))
            .when(p.rlike(r"^<[!?]|/>$"), acc)
            .otherwise(now(acc["at"], acc["seq"] + 1, F.concat(acc["open"], F.array(new).cast(_OPEN)), acc["done"]))
        )

    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("seq"), F.array().cast(_OPEN).alias("open"), F.array().cast(kind).alias("done")).cast(state)
    found = F.aggregate(pieces(markup), start, step, lambda a: F.array_sort(a["done"]))
    return F.transform(
        found,
        lambda s: F.struct(
            s["tag_seq"], s["name"].alias("name"), attributes(s["tag"]).alias("attrs"), s["start"].alias("start"), s["end"].alias("end"), s["depth"].alias("depth"), s["ancestors"].alias("ancestors")
        ),
    ).cast(f"array<{SPAN}>")


def span_rows(lines: DataFrame, keys: list[str], markup: str = "line", lower: bool = True) -> DataFrame:
    """One row per element of lines: keys, tag_seq, name, attrs, text, start_in_line, end_in_line (inclusive; null for an empty element), depth, ancestors."""
    s = lines.select(*keys, plain_text(F.col(markup)).alias("plain"), F.explode(spans(F.col(markup))).alias("s"))
    name = F.lower("s.name") if lower else F.col("s.name")
    full = F.col("s.end") > F.col("s.start")
    return s.select(
        *keys,
        F.col("s.tag_seq"),
        name.alias("name"),
        F.col("s.attrs"),
        F.expr("substring(plain, s.start + 1, s.end - s.start)").alias("text"),
        F.when(full, F.col("s.start")).alias("start_in_line"),
        F.when(full, F.col("s.end") - 1).alias("end_in_line"),
        F.col("s.depth"),
        F.col("s.ancestors"),
    )


def tags_by_line(lines: DataFrame, keys: list[str], name: str, markup: str = "line") -> DataFrame:
    """(keys, tags): the elements of that name in each line as one array, with text, attributes and inclusive positions; no shuffle."""
    s = lines.select(*keys, plain_text(F.col(markup)).alias("plain"), F.filter(spans(F.col(markup)), lambda x: F.lower(x["name"]) == name).alias("s"))
    full = lambda x: x["end"] > x["start"]
    tag = lambda x: F.struct(
        x["tag_seq"].alias("tag_seq"),
        F.substring(F.col("plain"), x["start"] + 1, x["end"] - x["start"]).alias("text"),
        x["attrs"].alias("attrs"),
        F.when(full(x), x["start"]).alias("start_in_line"),
        F.when(full(x), x["end"] - 1).alias("end_in_line"),
    )
    return s.select(*keys, F.transform("s", tag).alias("tags"))


# -- rewriting


def _rewritten(p: Column, name: Column, attrs: Column) -> Column:
    body = F.array_join(F.transform(F.map_entries(attrs), lambda e: F.concat(F.lit(" "), e["key"], F.lit('="'), T.escape_xml(e["value"]), F.lit('"'))), "")
    return F.when(p.startswith("</"), F.concat(F.lit("</"), name, F.lit(">"))).otherwise(F.concat(F.lit("<"), name, body, F.when(p.endswith("/>"), "/>").otherwise(">")))


def drop_declarations(markup: Column) -> Column:
    return F.array_join(F.filter(pieces(markup), lambda p: ~p.rlike(r"^<[!?]")), "")


def unwrap(markup: Column, names: list[str]) -> Column:
    """Drops the tags of elements of these names and keeps what they hold."""
    return F.array_join(F.filter(pieces(markup), lambda p: is_text(p) | ~tag_name(p).isin(names)), "")


def keep_only(markup: Column, names: list[str]) -> Column:
    return F.array_join(F.filter(pieces(markup), lambda p: is_text(p) | tag_name(p).isin(names)), "")


def rename(markup: Column, old: list[str], new: str, attrs=None) -> Column:
    """Gives elements another name; attrs maps (name, attributes) to new attributes."""

    def one(p: Column) -> Column:
        changed = attrs(tag_name(p), attributes(p)) if attrs else attributes(p)
        return F.when(is_text(p) | ~tag_name(p).isin(old), p).otherwise(_rewritten(p, F.lit(new), changed))

    return F.array_join(F.transform(pieces(markup), one), "")


def strip_attributes(markup: Column, names: list[str]) -> Column:
    one = lambda p: F.when(is_text(p) | p.rlike(r"^</|^<[!?]"), p).otherwise(_rewritten(p, tag_name(p), F.map_filter(attributes(p), lambda k, _: ~k.isin(names))))
    return F.array_join(F.transform(pieces(markup), one), "")


def repair_attributes(markup: Column) -> Column:
    """Repairs tid and value of all elements that have them."""
    fixed = lambda m: F.transform_values(m, lambda k, v: F.when(k == "tid", T.repaired_tid(v)).when(k == "value", T.repaired_value(v)).otherwise(v))
    one = lambda p: F.when(is_text(p) | p.rlike(r"^</|^<[!?]"), p).otherwise(_rewritten(p, tag_name(p), fixed(attributes(p))))
    return F.array_join(F.transform(pieces(markup), one), "")


def window_content(markup: Column, name: str = "annotation-window") -> Column:
    """What the first element of that name holds; null where there is none."""
    got = F.regexp_extract(markup, rf"(?s)<{name}(?:\s[^>]*)?>(.*?)</{name}>", 1)
    return F.when(markup.rlike(rf"(?s)<{name}[\s>].*</{name}>"), got)


def wrap(content: Column, tag: str = "TEXT", head: str = "") -> Column:
    return F.concat(F.lit(head), F.lit(f"<{tag}>"), content, F.lit(f"</{tag}>"))


def _with_ancestors(markup: Column, change) -> Column:
    """Rewrites each piece by change(piece, names of the elements around it)."""

    def step(acc: Column, p: Column) -> Column:
        opens = ~is_text(p) & ~p.rlike(r"^</|^<[!?]|/>$")
        inner = F.when(p.startswith("</"), F.slice(acc["open"], 1, F.greatest(F.size(acc["open"]) - 1, F.lit(0)))).otherwise(acc["open"])
        return F.struct(
            F.when(opens, F.concat(acc["open"], F.array(tag_name(p)))).otherwise(inner).alias("open"),
            F.concat(acc["out"], change(p, inner)).alias("out"),
        )

    start = F.struct(F.array().cast("array<string>").alias("open"), F.lit("").alias("out"))
    return F.aggregate(pieces(markup), start, step, lambda a: a["out"])


def mark_literature(markup: Column) -> Column:
    """literature-time="true" for each time expression inside a literature element."""

    def change(p: Column, around: Column) -> Column:
        time = ~is_text(p) & ~p.startswith("</") & tag_name(p).isin("TIMEX3", "temponym") & F.array_contains(around, F.lit("literature"))
        return F.when(time, _rewritten(p, tag_name(p), F.map_concat(attributes(p), F.create_map(F.lit("literature-time"), F.lit("true"))))).otherwise(p)

    return _with_ancestors(markup, change)


def unwrap_outside_window(markup: Column, window: str = "annotation-window", keep: str = "TIMEX3", inside: str = "sentence") -> Column:
    """Within sentences but outside the window only time expressions keep their tags."""

    def change(p: Column, around: Column) -> Column:
        free = ~is_text(p) & ~p.rlike(r"^<[!?]") & ~tag_name(p).isin(keep, window, inside) & F.array_contains(around, F.lit(inside)) & ~F.array_contains(around, F.lit(window))
        return F.when(free, "").otherwise(p)

    return _with_ancestors(markup, change)


def with_creation_date(markup: Column, date: str) -> Column:
    """A document creation date as the first element."""
    return F.concat(F.lit(f'<DCT><TIMEX3 tid="t0" type="DATE" value="{date}" functionInDocument="CREATION_TIME">{date}</TIMEX3></DCT>'), markup)


def numbered_tids(markup: Column, first: Column, name: str = "TIMEX3") -> Column:
    """Gives the elements of that name running tids from first on, in document order."""

    def step(acc: Column, p: Column) -> Column:
        mine = ~is_text(p) & ~p.startswith("</") & (tag_name(p) == name)
        others = F.map_filter(attributes(p), lambda k, _: k != "tid")
        new = _rewritten(p, tag_name(p), F.map_concat(F.create_map(F.lit("tid"), F.concat(F.lit("t"), acc["n"].cast("string"))), others))
        return F.struct(F.when(mine, acc["n"] + 1).otherwise(acc["n"]).alias("n"), F.concat(acc["out"], F.when(mine, new).otherwise(p)).alias("out"))

    return F.aggregate(pieces(markup), F.struct(first.cast("bigint").alias("n"), F.lit("").alias("out")), step, lambda a: a["out"])


def to_temponym(markup: Column) -> Column:
    """temponym, temponym-fn and dne become TIMEX3 of type TEMPONYM, with their old type as value."""
    new = lambda _, a: F.create_map(F.lit("type"), F.lit("TEMPONYM"), F.lit("value"), F.coalesce(F.try_element_at(a, F.lit("type")), F.lit("")))
    return rename(markup, ["temponym", "temponym-fn", "dne"], "TIMEX3", new)


def has(p: Column, name: str, attrs: dict[str, str] | None = None) -> Column:
    """Whether a tag has that name and these attributes; an attribute that is missing counts as empty."""
    fits = ~is_text(p) & ~p.startswith("</") & (tag_name(p) == name)
    for k, v in (attrs or {}).items():
        fits = fits & (F.coalesce(F.try_element_at(attributes(p), F.lit(k)), F.lit("")) == v)
    return fits


def retagged(markup: Column, change) -> Column:
    """Gives start tags a new name and new attributes by change(tag) → (name, attrs), columns; end tags follow their start tags."""

    def step(acc: Column, p: Column) -> Column:
        opens, closes = ~is_text(p) & ~p.rlike(r"^</|^<[!?]"), p.startswith("</")
        name, attrs = change(p)
        nested = opens & ~p.endswith("/>")
        return F.struct(
            F.when(nested, F.concat(acc["open"], F.array(name))).when(closes, F.slice(acc["open"], 1, F.greatest(F.size(acc["open"]) - 1, F.lit(0)))).otherwise(acc["open"]).alias("open"),
            F.concat(acc["out"], F.when(opens, _rewritten(p, name, attrs)).when(closes, F.concat(F.lit("</"), F.coalesce(F.try_element_at(acc["open"], F.lit(-1)), tag_name(p)), F.lit(">"))).otherwise(p)).alias("out"),
        )

    start = F.struct(F.array().cast("array<string>").alias("open"), F.lit("").alias("out"))
    return F.aggregate(pieces(markup), start, step, lambda a: a["out"])


def pilot_to_corpus(markup: Column) -> Column:
    """Annotations of the pilot scheme in the corpus's: periods, dynasties and reigns become temponym, other names dne; time expressions of type
    TEMPONYM become temponym of empty type; time expressions say in temporal-context whether they come from exploration or literature, or are the topic."""
    names = ["period", "dynasty", "reign"]

    def change(p: Column) -> tuple[Column, Column]:
        a = attributes(p)
        get = lambda k: F.coalesce(F.try_element_at(a, F.lit(k)), F.lit(""))
        temponym = has(p, "TIMEX3", {"type": "TEMPONYM"})
        name = F.when(tag_name(p) == "temponym-fn", F.when(get("type").isin(names), "temponym").otherwise("dne")).when(temponym, "temponym").otherwise(tag_name(p))
        kept = F.when(temponym, F.create_map(F.lit("type"), F.lit(""))).otherwise(F.map_filter(a, lambda k, _: ~k.isin("exploration-time", "literature-time", "check", "tid")))
        # what became of a TEMPONYM keeps its exploration time only
        flagged = (get("exploration-time") == "true") | (~temponym & (get("literature-time") == "true"))
        context = F.create_map(F.lit("temporal-context"), F.when(flagged, "exploration").otherwise("topic"))
        return name, F.when(name.isin("temponym", "TIMEX3"), F.map_concat(kept, context)).otherwise(kept)

    return retagged(markup, change)


PRESETS = {
    "pilot_to_corpus": lambda m: pilot_to_corpus(drop_declarations(m)),
    "default": lambda m: to_temponym(unwrap(drop_declarations(m), ["literature", "temponym-phrase", "TIMEX3INTERVAL", "sentence", "annotation-window"])),
    "tagged_corpus": lambda m: to_temponym(unwrap(mark_literature(drop_declarations(m)), ["literature", "temponym-phrase", "TIMEX3INTERVAL", "sentence", "annotation-window"])),
    "annotation_window": lambda m: to_temponym(unwrap(window_content(drop_declarations(m)), ["literature", "temponym-phrase", "TIMEX3INTERVAL", "sentence"])),
    "only_temponyms": lambda m: keep_only(drop_declarations(m), ["temponym", "temponym-fn", "dne", "sentence", "TimeML"]),
    "text_only": lambda m: T.escape_xml(plain_text(drop_declarations(m))),
}
"""Rule sets for whole documents."""
