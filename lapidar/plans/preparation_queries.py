"""Queries of smaller operators of preparation, translation and token tables, with the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapidar.functions import markup as M
from lapidar.functions import text as T
from lapidar.operators import evaluate, gazetteer, reports, tokens, translate
from lapidar.plans.text_queries import LE, WS
from lapidar.runtime import spread, table


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").where("text is not null")).select("doc_id", "text")


def left_strip_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    indented = F.concat(F.lit("  "), F.replace(F.col("text"), F.lit(". "), F.lit(".\n \t")))
    return _docs(spark, sf_dir).select("doc_id", T.left_stripped(indented).alias("text"))


def uri_arguments(spark: SparkSession, sf_dir: str) -> DataFrame:
    uri = F.concat(F.lit("http://vocab.example/term?"), F.when(F.col("p_partkey") % 4 == 0, "q=arg").otherwise(F.concat(F.lit("lang=de&arg="), "p_partkey")))
    return table(spark, sf_dir, "part").select("p_partkey", T.argument(uri, "arg").alias("term_id"))


def quoted_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", T.escape_quotes(F.replace("text", F.lit("“"), F.lit('"'))).alias("text"))


def pipes_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", T.without_pipes(F.replace("text", F.lit(", "), F.lit(" | "))).alias("text"))


def plain_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = F.concat_ws(",", F.lit("B-word"), F.concat(F.when(F.col("decision_id") % 2 == 0, "B-").otherwise("I-"), F.coalesce("tag1_attr_type", F.lit("O"))))
    return table(spark, sf_dir, "decisions").select("decision_id", T.without_prefix(row).alias("row"))


def text_on_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spread(table(spark, sf_dir, "timeml_docs").where("text is not null"))
    doc = F.concat(F.lit('<?xml version="1.0"?> <TimeML><TEXT>'), T.escape_xml(F.col("text")), F.lit("</TEXT></TimeML>"))
    return d.select("tml_id", T.text_on_lines(doc).alias("doc"))


def token_count_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words by blanks against words and marks, over all lines."""
    d = _docs(spark, sf_dir).select(F.explode(F.split("text", "\n", -1)).alias("line"))
    n = d.select(F.regexp_count("line", F.lit(r"[^\t\n\f\r ]+")).alias("a"), F.regexp_count("line", F.lit(r"[\p{L}\p{N}]+|[.,;:!?]")).alias("b"))
    return evaluate.count_differences(n, "a", "b")


def ordered_translations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of each epoch as translations of its first English name."""
    e = table(spark, sf_dir, "epochs").where("id is not null").select("id", F.explode("names").alias("lang", "l"))
    t = e.select("id", "lang", F.explode("l").alias("term")).where("term is not null")
    return translate.source_first(t, t.where("lang = 'en'").groupBy("id").agg(F.min("term").alias("term")), "en", "id")


def relation_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parents stated by several relations; an epoch's own id is taken out beforehand."""
    e = table(spark, sf_dir, "epochs").where("id is not null and parent_ids is not null")
    others = F.filter("parent_ids", lambda p: p.isNotNull() & (p != F.col("id")))
    relations = F.create_map(F.lit("isPartOf"), others, F.lit("isSenseOf"), F.reverse(others), F.lit("fallsWithin"), F.slice(others, 1, 1), F.lit("follows"), F.array(F.col("id")))
    found = gazetteer.parents(relations, F.col("id"))
    return e.select("id", F.size(found).cast("bigint").alias("n"), F.array_join(F.array_sort(found), "|").alias("parents")).distinct()


def rewrite_pilot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions rendered in the pilot scheme and brought to the corpus's."""
    n = F.col("decision_id")
    doc = F.concat(
        F.lit('<TimeML><temponym-fn type="'), F.when(n % 3 == 0, "reign").otherwise("site"), F.lit('">'), n.cast("string"), F.lit('</temponym-fn> <TIMEX3 type="'), F.when(n % 2 == 0, "TEMPONYM").otherwise("DATE"),
        F.lit('" exploration-time="'), F.when(n % 5 == 0, "true").otherwise("false"), F.lit('">x</TIMEX3></TimeML>'),
    )
    return table(spark, sf_dir, "decisions").select("decision_id", M.PRESETS["pilot_to_corpus"](doc).alias("doc"))


def term_walk_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From suppliers and nations over all links, without a bound on steps."""
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("src"), F.concat(F.lit("r"), "n_regionkey").alias("dst"))
    s = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("src"), F.concat(F.lit("n"), "s_nationkey").alias("dst"))
    back = n.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return translate.walk(s.unionByName(n).unionByName(back), s.select(F.col("src").alias("start")), -1).withColumn("depth", F.col("depth").cast("bigint"))


def event_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each user that differ in type from the one before."""
    return reports.runs(table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type"), ["user_id"], ["ts", "event_id"], "event_type").select("event_id", "user_id", "event_type")


def word_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each text paired with a class for each word, by place."""
    words = F.regexp_extract_all("text", F.lit(r"(\p{L}+)"), F.lit(1))
    shapes = F.transform(words, lambda w: F.when(w.rlike(r"^\p{Lu}"), "U").otherwise("l"))
    d = _docs(spark, sf_dir).select("doc_id", F.inline(tokens.paired(words, shapes)))
    return d.groupBy("doc_id", "tag").agg(F.count("*").alias("n"), F.countDistinct("word").alias("words"))


QUERIES = {
    f.__name__: f
    for f in (
        left_strip_lines, uri_arguments, quoted_terms, pipes_removed, plain_labels, text_on_lines, token_count_differences, ordered_translations, relation_parents, rewrite_pilot,
        term_walk_all, event_runs, word_shapes,
    )
}

_NAMES = "(select id, unnest(map_keys(names)) as lang, unnest(map_values(names)) as l from epochs where id is not null)"
ORACLES = {
    "left_strip_lines": f"select doc_id, regexp_replace('  ' || replace(text, '. ', '.' || chr(10) || ' ' || chr(9)), '(?:^|({LE})){WS}+', '\\1', 'g') as text from documents where text is not null",
    "uri_arguments": "select p_partkey, case when p_partkey % 4 <> 0 then p_partkey::bigint end as term_id from part",
    "quoted_terms": "select doc_id, replace(replace(text, '“', '\"'), '\"', '\\\"') as text from documents where text is not null",
    "pipes_removed": f"select doc_id, regexp_replace(replace(text, ', ', ' | '), '{WS}*\\|', '', 'g') as text from documents where text is not null",
    "plain_labels": "select decision_id, 'B-word,' || coalesce(tag1_attr_type, 'O') as row from decisions",
    "text_on_lines": r"""select tml_id, case when t = '' then '<TimeML><TEXT>' || chr(10) || '</TEXT></TimeML>' when t[1] = chr(10) and t[-1] = chr(10) then '<TimeML><TEXT>' || t || '</TEXT></TimeML>'
        when t[1] = chr(10) then '<TimeML><TEXT>' || t || chr(10) || '</TEXT></TimeML>' when t[-1] = chr(10) then '<TimeML><TEXT>' || chr(10) || t || '</TEXT></TimeML>' else '<TimeML><TEXT>' || chr(10) || t || chr(10) || '</TEXT></TimeML>' end as doc
        from (select tml_id, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') as t from timeml_docs where text is not null)""",
    "token_count_differences": r"""select round(avg(abs(a - b)), 6) as mean, round(avg((a <> b)::int), 6) as differing from (select len(regexp_extract_all(l, '[^\t\n\f\r ]+')) as a, len(regexp_extract_all(l, '[\p{L}\p{N}]+|[.,;:!?]')) as b
        from (select unnest(string_split(text, chr(10))) as l from documents where text is not null))""",
    "ordered_translations": f"""with t as (select distinct id, lang, term from (select id, lang, unnest(l) as term from {_NAMES}) where term is not null)
        select id, 0::bigint as rank, 'en' as lang, min(term) as term from t where lang = 'en' group by 1 union all select id, row_number() over (partition by id order by lang <> 'en', lang, term) as rank, lang, term from t""",
    "relation_parents": """select distinct id, len(p)::bigint as n, array_to_string(p, '|') as parents from (
        select id, list_sort(list_distinct(list_filter(parent_ids, lambda x: x is not null and x <> id))) as p from epochs where id is not null and parent_ids is not null)""",
    "rewrite_pilot": """select decision_id, '<TimeML>' || case when decision_id % 3 = 0 then '<temponym type="reign" temporal-context="topic">' || decision_id || '</temponym> ' else '<dne type="site">' || decision_id || '</dne> ' end
        || case when decision_id % 2 = 0 then '<temponym type="" temporal-context="' else '<TIMEX3 type="DATE" temporal-context="' end || case when decision_id % 5 = 0 then 'exploration' else 'topic' end || '">x</'
        || case when decision_id % 2 = 0 then 'temponym' else 'TIMEX3' end || '></TimeML>' as doc from decisions""",
    "term_walk_all": """with recursive e as (select 'n' || n_nationkey as src, 'r' || n_regionkey as dst from nation union all select 'r' || n_regionkey, 'n' || n_nationkey from nation union all select 's' || s_suppkey, 'n' || s_nationkey from supplier),
        w as (select 's' || s_suppkey as start, 's' || s_suppkey as node, 0 as depth from supplier union select start, dst, depth + 1 from w join e on node = src where depth < 12) select start, node, min(depth)::bigint as depth from w group by 1, 2""",
    "event_runs": "select event_id, user_id, event_type from (select *, row_number() over w as n, lag(event_type) over w as b from events window w as (partition by user_id order by ts nulls first, event_id nulls first)) where n = 1 or b is distinct from event_type",
    "word_shapes": r"""select doc_id, tag, count(*) as n, count(distinct word) as words from (select doc_id, word, case when regexp_matches(word, '^\p{Lu}') then 'U' else 'l' end as tag from (
        select doc_id, unnest(regexp_extract_all(text, '\p{L}+')) as word from documents where text is not null)) group by 1, 2""",
}
