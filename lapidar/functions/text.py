"""Text functions of preprocessing, as Column expressions.

All of them give null for null. White space means Unicode white space, lines end at all of Unicode's line ends.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode white space and line ends, written out as Java's and RE2's \s know ASCII only.
SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
LINE_END = r"\r\n|[\n-\r\x1c-\x1e\x{85}\x{2028}\x{2029}]"
LOWER = r"\p{Ll}ªº"


def strip(s: Column) -> Column:
    return F.regexp_replace(s, rf"^{SPACE}+|{SPACE}+$", "")


def split_lines(text: Column) -> Column:
    """Lines of a text; a line end at the very end begins no further line, an empty text has no lines."""
    lines = F.split(text, LINE_END, -1)
    return F.when(F.element_at(lines, -1) == "", F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)


def clean_whitespace(lines: Column) -> Column:
    """Drops blank lines, strips the others, and squeezes runs of two and more blanks; a single tab stays."""
    shown = F.filter(lines, lambda l: ~l.rlike(rf"^{SPACE}*$"))
    return F.transform(shown, lambda l: F.regexp_replace(strip(l), rf"{SPACE}{{2,}}", " "))


def squash(s: Column) -> Column:
    return strip(F.regexp_replace(s, rf"{SPACE}+", " "))


def join_hyphenated(lines: Column, always: bool = False, known: Column | None = None) -> Column:
    """Pulls the rest of a word broken at a line's end up to that line, from the first line to the last.

    A line changed by the line before is looked at in its changed form; one that held nothing but
    the rest stays as an empty line. All hyphens at the end go. Joined if the rest begins in
    lower case, or if the whole word without marks around it is in known (an array), or always.
    """

    def step(acc: Column, line: Column) -> Column:
        last = acc["last"]
        rest = F.substring_index(line, " ", 1)
        whole = F.concat(F.regexp_replace(F.substring_index(last, " ", -1), "-+$", ""), rest)
        if always:
            fits = F.lit(True)
        elif known is not None:
            fits = F.array_contains(known, F.regexp_replace(whole, r"^[^\p{L}\p{N}_]+|[^\p{L}\p{N}_]+$", ""))
        else:
            fits = rest.rlike(rf"^[{LOWER}]")
        pull = last.endswith("-") & fits
        head = F.substring(last, F.lit(1), F.length(last) - F.length(F.substring_index(last, " ", -1)))
        done = F.when(pull, F.concat(head, whole)).otherwise(last)
        left = F.when(pull, F.substring(line, F.length(rest) + 2, F.length(line))).otherwise(line)
        return F.struct(F.concat(acc["done"], F.array(done)).alias("done"), left.alias("last"))

    start = F.struct(F.array().cast("array<string>").alias("done"), lines[0].alias("last"))
    folded = F.aggregate(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), start, step, lambda a: F.concat(a["done"], F.array(a["last"])))
    return F.when(F.size(lines) > 0, folded).otherwise(lines)


def left_stripped(text: Column) -> Column:
    """Each line without white space at its beginning; of blank lines nothing stays."""
    return F.regexp_replace(text, rf"(?:^|({LINE_END})){SPACE}+", "$1")


def argument(uri: Column, name: str) -> Column:
    """The number that a uri's query gives under a name; null where there is none."""
    return F.try_parse_url(uri, F.lit("QUERY"), F.lit(name)).try_cast("bigint")


def escape_quotes(s: Column) -> Column:
    """For terms within quotation marks of a query language."""
    return F.replace(s, F.lit('"'), F.lit('\\"'))


def without_pipes(s: Column) -> Column:
    """Drops separators | with the blanks before them."""
    return F.regexp_replace(s, rf"{SPACE}*\|", "")


def without_prefix(label: Column) -> Column:
    """A row's last label without B- or I-."""
    return F.regexp_replace(label, r"[BI]-([^,]*)$", "$1")


def text_on_lines(markup: Column) -> Column:
    """What TEXT holds on lines of its own, and nothing before TimeML on its line."""
    opened = F.regexp_replace(markup, r"<TEXT>([^\n])", "<TEXT>\n$1")
    closed = F.regexp_replace(opened, r"([^\n])</TEXT>", "$1\n</TEXT>")
    return F.regexp_replace(closed, r"(?m)^.*<TimeML><TEXT>$", "<TimeML><TEXT>")


def escape_xml(s: Column) -> Column:
    """Only & < >; quotes stay."""
    return F.replace(F.replace(F.replace(s, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def unescape_xml(s: Column) -> Column:
    out = s
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def clean_period_name(s: Column) -> Column:
    """A period's name without a remark in brackets and without what follows a comma."""
    return strip(F.regexp_replace(F.regexp_replace(s, r" \(.*\)", ""), r", .*$", ""))


def repaired_tid(s: Column) -> Column:
    digits = F.regexp_extract(s, r"^[cC]([0-9]*)", 1)
    return F.when(s.rlike("^[cC]"), F.concat(F.lit("t00000000"), digits)).otherwise(s)


def repaired_value(s: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(s, r"^-", "BC"), r"^\+", "")


def year(s: Column) -> Column:
    return strip(s).try_cast("int")


def year_text(y: Column) -> Column:
    return F.when(y.isNull(), "None").otherwise(F.format_string("%+05d", y))


def host(url: Column) -> Column:
    """The url's host without www; a url without scheme gets one; invalid-url.xyz where there is no host."""
    got = F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.try_parse_url(F.concat(F.lit("http://"), url), F.lit("HOST")), F.lit("invalid-url.xyz"))
    return F.regexp_replace(got, r"^www[0-9]*\.", "")


def earliest_year(dates: Column) -> Column:
    """The least number among the dates as text; empty where there is none but zeros."""
    years = F.filter(F.transform(dates, lambda d: strip(d).try_cast("int")), lambda y: y.isNotNull())
    return F.when(F.exists(years, lambda y: y != 0), F.array_min(years).cast("string")).otherwise("")


def around(text: Column, start: Column, end: Column, before: int = 30, after: int = 30) -> tuple[Column, Column]:
    """What stands before a span, and after it; the span's end is inclusive, and what follows is one character short."""
    lead = F.substring(text, F.greatest(start - before, F.lit(0)) + 1, F.least(start, F.lit(before)))
    return lead, F.rtrim(F.substring(text, end + 2, F.lit(after - 1)))


# The forms of time values in the annotation scheme.
VALUE_FORMS = [
    ("reference", r"^(?:PAST|PRESENT|FUTURE)_REF$"),
    ("season", r"^[0-9X]{1,4}-(?:SP|SU|FA|WI)$"),
    ("part_of_year", r"^[0-9X]{1,4}-(?:Q[1-4X]|H[12X])$"),
    ("week", r"^[0-9X]{1,4}-W[0-9X]{1,2}(?:-(?:[1-7X]|WE))?$"),
    ("time", r"^(?:[0-9X]{1,4}-[0-9X]{1,2}-[0-9X]{1,2})?T(?:[0-9X]{2}(?::[0-9X]{2}(?::[0-9X]{2})?)?|MO|AF|EV|NI|DT|MI)$"),
    ("duration", r"^P(?:T?[0-9X]+(?:\.[0-9]+)?(?:DE|CE|EN|[YMWDHS]))+$"),
    ("duration", r"^PX(?:[YMWD]|T[HMS])?$"),
    ("date_bc", r"^BC[0-9X]{1,4}$"),
    ("date", r"^[0-9X]{1,4}(?:-[0-9X]{1,2}(?:-[0-9X]{1,2})?)?$"),
]


def value_kind(s: Column) -> Column:
    """The form of a time value, or invalid; null for null."""
    out = F.when(s.isNull(), F.lit(None).cast("string"))
    for name, form in VALUE_FORMS:
        out = out.when(s.rlike(form), name)
    return out.otherwise("invalid")
