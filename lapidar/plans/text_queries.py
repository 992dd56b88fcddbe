"""Queries of preprocessing and of markup, with the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lapidar.functions import markup as M
from lapidar.functions import text as T
from lapidar.operators import sentences
from lapidar.runtime import spread, table

WS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
LE = r"\r\n|[\n-\r\x1c-\x1e\x{85}\x{2028}\x{2029}]"
SQL_LINES = f"(select doc_id, case when l[-1] = '' then l[:-2] else l end as lines from (select doc_id, regexp_split_to_array(text, '{LE}') as l from documents where text is not null))"
# pages, their hyphens at line ends followed by blanks made plain
SQL_PAGES = r"(select page_id, regexp_replace(text, '- +(\n|$)', '-\1', 'g') as text from scan_pages where text is not null)"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").where("text is not null"))


def clean_whitespace(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = T.clean_whitespace(T.split_lines(F.col("text")))
    return _docs(spark, sf_dir).select("doc_id", F.size(lines).cast("bigint").alias("n_lines"), F.array_join(lines, "\n").alias("text"))


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain = F.regexp_replace("text", r"- +(\n|$)", "-$1")
    return spread(table(spark, sf_dir, "scan_pages").where("text is not null")).select("page_id", F.split(plain, "\n", -1).alias("lines"))


def dehyphenate_lower(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("page_id", F.array_join(T.join_hyphenated(F.col("lines")), "\n").alias("text"))


def dehyphenate_always(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("page_id", F.array_join(T.join_hyphenated(F.col("lines"), always=True), "\n").alias("text"))


def escape_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", T.escape_xml(F.col("text")).alias("text"))


def squash_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", T.squash(F.col("text")).alias("text"))


def normalise_tid_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "decisions")
    raw = F.when(F.col("decision_id") % 3 == 0, F.regexp_replace("tag1_attr_tid", "^t", "c")).otherwise(F.col("tag1_attr_tid"))
    value = F.when(F.col("decision_id") % 4 == 0, F.concat(F.lit("-"), "tag1_attr_value")).when(F.col("decision_id") % 4 == 1, F.concat(F.lit("+"), "tag1_attr_value")).otherwise(F.col("tag1_attr_value"))
    return d.select("decision_id", T.repaired_tid(raw).alias("tid"), T.repaired_value(value).alias("value"))


def timeml_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "decisions").select(T.value_kind(F.col("tag1_attr_value")).alias("kind"))
    return d.groupBy("kind").agg(F.count("*").alias("n"))


def context_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands around the third word of each document's first line."""
    d = _docs(spark, sf_dir).select("doc_id", T.squash(F.col("text")).alias("t")).where(F.length("t") > 60)
    start = F.col("doc_id") % 50
    before, after = T.around(F.col("t"), start.cast("int"), (start + 4).cast("int"))
    return d.select("doc_id", before.alias("before_text"), after.alias("after_text"))


def line_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running offsets of lines; the end is inclusive, so an empty line ends before it starts."""
    lines = T.split_lines(F.col("text"))
    starts = F.aggregate(
        lines,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")),
        lambda a, l: F.struct((a["at"] + F.length(l)).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")),
        lambda a: a["out"],
    )
    d = spread(table(spark, sf_dir, "timeml_docs").where("text is not null")).select("tml_id", F.posexplode(F.arrays_zip(lines.alias("line"), starts.alias("start_pos"))))
    return d.select(
        "tml_id", F.col("pos").cast("bigint").alias("line_no"), F.length("col.line").cast("bigint").alias("length"),
        F.col("col.start_pos").cast("bigint").alias("start_pos"), (F.col("col.start_pos") + F.length("col.line") - 1).cast("bigint").alias("end_pos"),
    )


def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.rule_sentences(_docs(spark, sf_dir).select("doc_id", "text"))


def random_window(spark: SparkSession, sf_dir: str, size: int = 3) -> DataFrame:
    """A run of lines of each longer document; its start comes from the id, and the last possible run is never taken."""
    d = _docs(spark, sf_dir).select("doc_id", T.split_lines(F.col("text")).alias("lines")).withColumn("n", F.size("lines"))
    start = F.when(F.col("n") > size, F.pmod(F.col("doc_id") * 7919, F.col("n") - size)).otherwise(0)
    return d.select("doc_id", start.cast("bigint").alias("first_line"), F.array_join(F.slice("lines", (start + 1).cast("int"), F.when(F.col("n") > size, F.lit(size)).otherwise(F.greatest("n", F.lit(1)))), "\n").alias("text"))


def wrap_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = T.split_lines(F.col("text"))
    d = _docs(spark, sf_dir).select("doc_id", F.posexplode(lines))
    return d.select("doc_id", F.format_string('<sentence no="%d">%s</sentence>', F.col("pos") + 1, F.col("col")).alias("line"))


# -- rendered annotations: words of each line by blanks, tags by the word's place and length


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.split("text", "\n", -1)
    d = _docs(spark, sf_dir).select("doc_id", F.posexplode(lines).alias("line_no", "raw"))
    return d.select("doc_id", F.col("line_no").cast("bigint").alias("line_no"), F.regexp_extract_all("raw", F.lit(r"([^\t\n\f\r ]+)"), F.lit(1)).alias("w")).where(F.size("w") > 0)


def _gold(w: Column, i: Column, doc: Column) -> Column:
    n = F.length(w)
    kind = F.when(n % 2 == 0, "DATE").otherwise("DURATION")
    value = F.when(n % 6 == 0, "").otherwise(n.cast("string"))
    tag = F.concat(F.lit('<TIMEX3 type="'), kind, F.lit('" value="'), value, F.when(doc % 3 == 0, '" literature-time="true">').otherwise('">'), T.escape_xml(w), F.lit("</TIMEX3>"))
    return F.when(i % 5 == 2, tag).otherwise(T.escape_xml(w))


def gold_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _words(spark, sf_dir).select("doc_id", "line_no", F.array_join(F.transform("w", lambda w, i: _gold(w, i, F.col("doc_id"))), " ").alias("line"))


def _system(w: Column, i: Column, n: Column) -> Column:
    k = F.length(w)
    kind = F.when(k % 3 == 0, "DURATION").otherwise("DATE")
    value = (k + F.when(i % 4 == 0, 1).otherwise(0)).cast("string")
    head = F.concat(F.lit('<TIMEX3 type="'), kind, F.lit('" value="'), value, F.lit('">'), T.escape_xml(w))
    two = (i % 5 == 2) & ((i + k) % 3 != 0) & (k % 4 == 0) & (i + 1 < n)
    one = ((i % 5 == 2) & ((i + k) % 3 != 0) & ~two) | ((i % 11 == 4) & ~(i % 5).isin(2, 3))
    return F.when(two, head).when(one, F.concat(head, F.lit("</TIMEX3>"))).otherwise(T.escape_xml(w))


def system_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A word that follows the first of two tagged words closes the tag."""
    prev_two = lambda w, i: (i % 5 == 3) & (((i - 1) + F.length(F.col("w")[(i - 1).cast("int")])) % 3 != 0) & (F.length(F.col("w")[(i - 1).cast("int")]) % 4 == 0)
    one = lambda w, i: F.concat(_system(w, i, F.size("w")), F.when((i > 0) & prev_two(w, i), "</TIMEX3>").otherwise(""))
    return _words(spark, sf_dir).select("doc_id", "line_no", F.array_join(F.transform("w", one), " ").alias("line"))


SQL_W = r"""
w0 as (select doc_id, line_no, regexp_extract_all(raw, '[^\t\n\f\r ]+') as w from (
  select doc_id, unnest(range(0, len(l))) as line_no, unnest(l) as raw from (select doc_id, string_split(text, chr(10)) as l from documents where text is not null))),
w1 as (select doc_id, line_no, unnest(range(0, len(w))) as i, unnest(w) as w, len(w) as n from w0 where len(w) > 0),
words as (select *, length(w) as k, coalesce(sum(length(w) + 1) over (partition by doc_id, line_no order by i rows between unbounded preceding and 1 preceding), 0)::bigint as s, lead(w) over (partition by doc_id, line_no order by i) as nw from w1),
gold as (select doc_id, line_no, i, s as a, s + k - 1 as b, w as t, case when k % 2 = 0 then 'DATE' else 'DURATION' end as type, case when k % 6 = 0 then '' else k::varchar end as value, doc_id % 3 = 0 as lit from words where i % 5 = 2),
sys0 as (select *, (i % 5 = 2 and (i + k) % 3 <> 0 and k % 4 = 0 and i + 1 < n) as two from words where (i % 5 = 2 and (i + k) % 3 <> 0) or (i % 11 = 4 and i % 5 not in (2, 3))),
system as (select doc_id, line_no, i, s as a, case when two then s + k + length(nw) else s + k - 1 end as b, case when two then w || ' ' || nw else w end as t,
  case when k % 3 = 0 then 'DURATION' else 'DATE' end as type, (k + case when i % 4 = 0 then 1 else 0 end)::varchar as value from sys0)
"""


def span_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = M.span_rows(system_lines(spark, sf_dir), ["doc_id", "line_no"])
    return s.select(
        "doc_id", "line_no", "name", F.col("attrs")["type"].alias("type"), F.col("attrs")["value"].alias("value"), "text",
        F.col("start_in_line").cast("bigint").alias("start_in_line"), F.col("end_in_line").cast("bigint").alias("end_in_line"),
    )


def text_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gold_lines(spark, sf_dir).select("doc_id", "line_no", M.PRESETS["text_only"](F.col("line")).alias("line"))


def _nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line with its first word in a literature element, that in a window with the second, the line in a sentence."""
    w = lambda i: T.escape_xml(F.col("w")[i])
    rest = F.array_join(F.transform(F.slice("w", 3, F.greatest(F.size("w") - 2, F.lit(0))), T.escape_xml), " ")
    line = F.concat(
        F.lit('<sentence no="'), F.col("line_no").cast("string"), F.lit('"><annotation-window><literature><TIMEX3 tid="c12" type="DATE" value="-500">'), w(0),
        F.lit('</TIMEX3></literature> <temponym type="period" x="1">'), w(1), F.lit("</temponym></annotation-window> <dne type=\"place\">"), rest, F.lit("</dne></sentence>"),
    )
    return _words(spark, sf_dir).where(F.size("w") > 2).select("doc_id", "line_no", line.alias("line"))


def _rewrite(change):
    return lambda spark, sf_dir: _nested(spark, sf_dir).select("doc_id", "line_no", change(F.col("line")).alias("line"))


def _sql_nested(pattern: str) -> str:
    """pattern: SQL over w1, w2, rest (escaped) and line_no."""
    esc = lambda x: f"replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
    return f"with {SQL_W} select doc_id, line_no, {pattern} as line from (select doc_id, line_no, {esc('w[1]')} as w1, {esc('w[2]')} as w2, {esc(chr(97) + 'rray_to_string(w[3:], chr(32))')} as rest from w0 where len(w) > 2)"


REWRITES = {
    "rewrite_drop_tags": (lambda m: M.unwrap(m, ["literature", "annotation-window", "sentence"]), """'<TIMEX3 tid="c12" type="DATE" value="-500">' || w1 || '</TIMEX3> <temponym type="period" x="1">' || w2 || '</temponym> <dne type="place">' || rest || '</dne>'"""),
    "rewrite_rename": (lambda m: M.to_temponym(M.unwrap(m, ["literature", "annotation-window", "sentence"])), """'<TIMEX3 tid="c12" type="DATE" value="-500">' || w1 || '</TIMEX3> <TIMEX3 type="TEMPONYM" value="period">' || w2 || '</TIMEX3> <TIMEX3 type="TEMPONYM" value="place">' || rest || '</TIMEX3>'"""),
    "rewrite_strip_attrs": (lambda m: M.strip_attributes(M.unwrap(m, ["literature", "annotation-window", "sentence"]), ["x", "tid"]), """'<TIMEX3 type="DATE" value="-500">' || w1 || '</TIMEX3> <temponym type="period">' || w2 || '</temponym> <dne type="place">' || rest || '</dne>'"""),
    "rewrite_repair_attrs": (lambda m: M.repair_attributes(M.unwrap(m, ["literature", "annotation-window", "sentence", "dne", "temponym"])), """'<TIMEX3 tid="t0000000012" type="DATE" value="BC500">' || w1 || '</TIMEX3> ' || w2 || ' ' || rest"""),
    "rewrite_window": (lambda m: M.window_content(m), """'<literature><TIMEX3 tid="c12" type="DATE" value="-500">' || w1 || '</TIMEX3></literature> <temponym type="period" x="1">' || w2 || '</temponym>'"""),
    "rewrite_literature": (lambda m: M.unwrap(M.mark_literature(m), ["literature", "annotation-window", "sentence"]), """'<TIMEX3 tid="c12" type="DATE" value="-500" literature-time="true">' || w1 || '</TIMEX3> <temponym type="period" x="1">' || w2 || '</temponym> <dne type="place">' || rest || '</dne>'"""),
    "rewrite_outside_window": (lambda m: M.unwrap_outside_window(m), """'<sentence no="' || line_no || '"><annotation-window><literature><TIMEX3 tid="c12" type="DATE" value="-500">' || w1 || '</TIMEX3></literature> <temponym type="period" x="1">' || w2 || '</temponym></annotation-window> ' || rest || '</sentence>'"""),
    "rewrite_tagged_corpus": (M.PRESETS["tagged_corpus"], """'<TIMEX3 tid="c12" type="DATE" value="-500" literature-time="true">' || w1 || '</TIMEX3> <TIMEX3 type="TEMPONYM" value="period">' || w2 || '</TIMEX3> <TIMEX3 type="TEMPONYM" value="place">' || rest || '</TIMEX3>'"""),
    "rewrite_wrap": (lambda m: M.wrap(M.keep_only(m, ["TIMEX3"])), """'<TEXT><TIMEX3 tid="c12" type="DATE" value="-500">' || w1 || '</TIMEX3> ' || w2 || ' ' || rest || '</TEXT>'"""),
}

QUERIES = {
    f.__name__: f
    for f in (
        clean_whitespace, dehyphenate_lower, dehyphenate_always, escape_xml, squash_space, normalise_tid_value, timeml_validate, context_window,
        line_offsets, sentence_split, random_window, wrap_sentences, span_table, text_only,
    )
} | {k: _rewrite(v[0]) for k, v in REWRITES.items()}

_q = lambda pattern: pattern.replace("'", "''")
_KINDS = "".join(f"when regexp_matches(tag1_attr_value, '{form}') then '{name}' " for name, form in T.VALUE_FORMS)
ORACLES = {
    "clean_whitespace": rf"""select doc_id, len(c)::bigint as n_lines, array_to_string(c, chr(10)) as text from (
        select doc_id, list_transform(list_filter(lines, lambda l: not regexp_full_match(l, '{WS}*')), lambda l: regexp_replace(regexp_replace(l, '^{WS}+|{WS}+$', '', 'g'), '{WS}{{2,}}', ' ', 'g')) as c from {SQL_LINES})""",
    "dehyphenate_lower": rf"select page_id, regexp_replace(text, '-+\n([\p{{Ll}}ªº][^ \n]*) ?', '\1' || chr(10), 'g') as text from {SQL_PAGES}",
    "dehyphenate_always": rf"select page_id, regexp_replace(text, '-+\n([^ \n]*) ?', '\1' || chr(10), 'g') as text from {SQL_PAGES}",
    "escape_xml": "select doc_id, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') as text from documents where text is not null",
    "squash_space": f"select doc_id, regexp_replace(regexp_replace(text, '{WS}+', ' ', 'g'), '^{WS}+|{WS}+$', '', 'g') as text from documents where text is not null",
    "normalise_tid_value": r"""select decision_id,
        case when regexp_matches(t, '^[cC]') then 't00000000' || regexp_extract(t, '^[cC]([0-9]*)', 1) else t end as tid,
        regexp_replace(regexp_replace(v, '^-', 'BC'), '^\+', '') as value from (select decision_id,
        case when decision_id % 3 = 0 then regexp_replace(tag1_attr_tid, '^t', 'c') else tag1_attr_tid end as t,
        case decision_id % 4 when 0 then '-' || tag1_attr_value when 1 then '+' || tag1_attr_value else tag1_attr_value end as v from decisions)""",
    "timeml_validate": f"select case when tag1_attr_value is null then null {_KINDS} else 'invalid' end as kind, count(*) as n from decisions group by 1",
    "context_window": f"""select doc_id, substr(t, greatest(p - 30, 0) + 1, least(p, 30)) as before_text, rtrim(substr(t, p + 6, 29), ' ') as after_text
        from (select doc_id, (doc_id % 50)::int as p, regexp_replace(regexp_replace(text, '{WS}+', ' ', 'g'), '^{WS}+|{WS}+$', '', 'g') as t from documents where text is not null) where length(t) > 60""",
    "line_offsets": f"""select tml_id, i as line_no, n as length, s as start_pos, s + n - 1 as end_pos from (
        select *, coalesce(sum(n) over (partition by tml_id order by i rows between unbounded preceding and 1 preceding), 0)::bigint as s from (
        select tml_id, unnest(range(0, len(l))) as i, unnest(list_transform(l, lambda x: length(x)))::bigint as n from (
        select tml_id, case when l[-1] = '' then l[:-2] else l end as l from (select tml_id, regexp_split_to_array(text, '{LE}') as l from timeml_docs where text is not null))))""",
    "sentence_split": rf"""with t as (select doc_id, regexp_replace(regexp_replace(text, '{WS}+', ' ', 'g'), '^{WS}+|{WS}+$', '', 'g') as s from documents where text is not null),
        w as (select unnest(l) as t, unnest(list_append(l[2:], '')) as nxt from (select string_split(s, ' ') as l from t)),
        c as (select lower(regexp_extract(t, '{_q(sentences.TOKEN)}', 1)) as word, regexp_matches(t, '{_q(sentences.DOTTED)}') as dot, regexp_matches(nxt, '{_q(sentences.GOES_ON)}') or t not like '%.' as inn from w),
        ab as (select word from c where word <> '' group by 1 having count(*) filter (dot) >= {sentences.LEAST} and count(*) filter (dot) * 10 >= count(*) * 9 and (count(*) filter (dot and inn) * 4 >= count(*) filter (dot) or length(word) <= 3)),
        p as (select doc_id, unnest(l) as piece, generate_subscripts(l, 1) as i from (select doc_id, string_split(regexp_replace(s, '([.!?…]) ', '\1' || chr(10) || ' ', 'g'), chr(10)) as l from t)),
        q as (select *, lag(piece) over (partition by doc_id order by i) as b from p),
        j as (select *, b is not null and (regexp_matches(b, '{_q(sentences.NO_END)}') or regexp_matches(piece, '^ \p{{Ll}}') or (regexp_matches(b, '{_q(sentences.SHORT_WORD)}') and regexp_matches(piece, '^ [0-9]'))
          or lower(regexp_extract(b, '{_q(sentences.LAST_WORD)}', 1)) in (select word from ab)) as joined from q),
        g as (select doc_id, i, piece, sum((not joined)::int) over (partition by doc_id order by i) as k from j),
        r as (select doc_id, k, trim(string_agg(piece, '' order by i)) as sentence from g group by 1, 2)
        select doc_id, row_number() over (partition by doc_id order by k) - 1 as sentence_no, sentence from r where sentence <> ''""",
    "random_window": f"""select doc_id, p as first_line, array_to_string(lines[p + 1 : p + case when n > 3 then 3 else greatest(n, 1) end], chr(10)) as text from (
        select doc_id, lines, len(lines) as n, case when len(lines) > 3 then (doc_id * 7919) % (len(lines) - 3) else 0 end as p from {SQL_LINES})""",
    "wrap_sentences": f"""select doc_id, '<sentence no="' || i || '">' || l || '</sentence>' as line from (select doc_id, unnest(range(1, len(lines) + 1)) as i, unnest(lines) as l from {SQL_LINES})""",
    "span_table": f"with {SQL_W} select doc_id, line_no, 'timex3' as name, type, value, t as text, a as start_in_line, b as end_in_line from system",
    "text_only": f"with {SQL_W} select doc_id, line_no, replace(replace(replace(array_to_string(w, ' '), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') as line from w0 where len(w) > 0",
} | {k: _sql_nested(v[1]) for k, v in REWRITES.items()}
