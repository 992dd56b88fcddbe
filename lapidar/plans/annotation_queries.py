"""Queries of evaluation, reports, tokens and tagging, with the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapidar.functions import markup as M
from lapidar.operators import evaluate as E
from lapidar.operators import reports as R
from lapidar.operators import tagging, tokens
from lapidar.plans.text_queries import SQL_W, _words, gold_lines, system_lines
from lapidar.runtime import table

KEYS = ["doc_id", "line_no"]


def _decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = lambda d: M.tags_by_line(d, KEYS, "timex3")
    return E.decisions(tags(gold_lines(spark, sf_dir)), tags(system_lines(spark, sf_dir)), KEYS)


def eval_relaxed_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.scores(_decisions(spark, sf_dir))


def eval_filtered_attr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.scores(E.involving(_decisions(spark, sf_dir), "literature-time", "true", keep=False))


def eval_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By language and over all, from one pass over the decisions."""
    lang = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("lang", F.lit("?")).alias("lang"))
    n = lambda r: F.count_if(F.col("result_type") == r)
    d = _decisions(spark, sf_dir).where("task_type = 'TAG_RELAXED'").groupBy("doc_id").agg(n("TP").alias("a"), n("FP").alias("b"), n("FN").alias("c")).join(lang, "doc_id")
    c = d.rollup("lang").agg(F.sum("a").alias("tp"), F.sum("b").alias("fp"), F.sum("c").alias("fn"))
    return E.with_scores(c.select(F.coalesce("lang", F.lit("all")).alias("lang"), "tp", "fp", "fn", F.lit(0).cast("bigint").alias("max_matches"))).drop("accuracy", "max_matches")


def unmatched_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decisions(spark, sf_dir).where("task_type = 'TAG_RELAXED' and result_type = 'FN'").select(*KEYS, F.col("tag1.text").alias("text"), F.col("tag1.start_in_line").cast("bigint").alias("start_in_line"))


def unmatched_system(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decisions(spark, sf_dir).where("task_type = 'TAG_RELAXED' and result_type = 'FP'").select(*KEYS, F.col("tag1.text").alias("text"), F.col("tag1.start_in_line").cast("bigint").alias("start_in_line"))


def file_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each system name with the first gold path that holds it.

    Names hold or are runs of parts between underscores, so a path offers all runs of its parts (few) and the join is one of equals.
    """
    paths = table(spark, sf_dir, "timeml_docs").where("doc is not null").select(F.concat(F.lit("gold/"), "doc").alias("path"), F.split(F.regexp_replace("doc", r"\.[^.]*$", ""), "_").alias("p"))
    runs = F.flatten(F.transform("p", lambda _, i: F.transform(F.sequence(F.lit(1), F.size("p") - i), lambda n: F.array_join(F.slice("p", i + 1, n), "_"))))
    gold = paths.select("path", F.explode(F.array_distinct(runs)).alias("base"))
    system = table(spark, sf_dir, "timeml_docs").where("doc is not null").select(F.regexp_extract("doc", r"^([^_]+_text_[0-9]+)", 1).alias("base")).distinct()
    return system.join(gold, "base").groupBy("base").agg(F.min("path").alias("path"))


def _report(f, *cols: str):
    return lambda spark, sf_dir: f(table(spark, sf_dir, "decisions")).select("decision_id", *cols)


def _histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = table(spark, sf_dir, "timeml_docs").select(F.col("doc").alias("basename"), F.length("text").alias("chars"))
    return R.histogram(R.positions(table(spark, sf_dir, "decisions")), sizes)


def position_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _histogram(spark, sf_dir)


def histogram_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.histogram_sum(_histogram(spark, sf_dir))


def histogram_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.histogram_mean(_histogram(spark, sf_dir), table(spark, sf_dir, "timeml_docs").count())


def tag_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = M.span_rows(gold_lines(spark, sf_dir), KEYS)
    return s.groupBy("text").agg(F.count("*").alias("n"))


def tag_line_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with some tag, not tags, for each document."""
    return gold_lines(spark, sf_dir).groupBy("doc_id").agg(F.count_if(F.col("line").rlike("(?i)<timex3")).alias("n_lines"))


def tag_unique_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    lang = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("lang", F.lit("?")).alias("lang"))
    s = M.span_rows(gold_lines(spark, sf_dir), KEYS).groupBy("doc_id", "text").agg(F.count("*").alias("n")).join(lang, "doc_id")
    # added up by text first, so that the distinct count needs no row per tag
    return s.groupBy("lang", "text").agg(F.sum("n").alias("n")).groupBy("lang").agg(F.sum("n").alias("total"), F.count("*").alias("uniq"))


def bio_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.bio_table(system_lines(spark, sf_dir), KEYS).groupBy(*KEYS).agg(
        F.count_if(F.col("tag") == "B-timex3").alias("b"), F.count_if(F.col("tag") == "I-timex3").alias("i"), F.count_if(F.col("tag") == "O").alias("o")
    )


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of documents by blanks, tagged by their place and length."""
    d = _words(spark, sf_dir).select("doc_id", "line_no", F.posexplode("w").alias("word_no", "word"))
    n = F.length("word")
    tag = F.when(F.col("word_no") % 5 == 2, F.when(n % 2 == 0, "B-date").otherwise("B-duration")).otherwise("O")
    return d.select("doc_id", "line_no", F.col("word_no").cast("bigint").alias("word_no"), "word", tag.alias("tag"))


SQL_TOKENS = f"{SQL_W}, tok as (select doc_id, line_no, i as word_no, w as word, case when i % 5 = 2 then case when k % 2 = 0 then 'B-date' else 'B-duration' end else 'O' end as tag from words)"


def sentence_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.numbered(_words(spark, sf_dir).select("doc_id", "line_no"), "doc_id", ["line_no"])


def number_tids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running tids over all documents: each line's share is counted, and lines get what comes before them."""
    lines = gold_lines(spark, sf_dir)
    counted = lines.select("doc_id", "line_no", F.size(F.filter(M.pieces(F.col("line")), lambda p: p.startswith("<TIMEX3"))).cast("bigint").alias("n"))
    first = tokens.summed_before(counted, "doc_id", ["line_no"], "n")
    return lines.join(first, KEYS).select("doc_id", "line_no", M.numbered_tids(F.col("line"), F.col("before") + 1).alias("line"))


def forward_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _tokens(spark, sf_dir).withColumn("mark", F.when(F.col("word_no") % 4 == 0, F.col("word")))
    return tokens.forward_fill(t, ["doc_id", "line_no"], ["word_no"], ["mark"]).select("doc_id", "line_no", "word_no", "mark")


def context_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.context_features(_tokens(spark, sf_dir), ["doc_id", "line_no"], "word_no")


def _tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _tokens(spark, sf_dir)
    return tokens.memory_tagged(t.where("doc_id % 5 <> 0"), t.where("doc_id % 5 = 0"))


def memory_tagger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fitted on four folds of documents, applied to the fifth, as its SQL has it; memory_tagger_folds predicts every fold."""
    return _tagged(spark, sf_dir).select("doc_id", "line_no", "word_no", "predicted")


def label_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.label_scores(_tagged(spark, sf_dir))


def token_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_accuracy(_tagged(spark, sf_dir))


def _fold_tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.fold_tagged(_tokens(spark, sf_dir), "doc_id", tagging.FOLDS)


def memory_tagger_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross prediction: each fold of documents is predicted from the four others."""
    return _fold_tagged(spark, sf_dir).select("doc_id", "line_no", "word_no", "predicted")


def label_scores_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.label_scores(_fold_tagged(spark, sf_dir))


def token_accuracy_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_accuracy(_fold_tagged(spark, sf_dir))


def rare_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.rare_words(_tokens(spark, sf_dir), 3).groupBy("word").agg(F.count("*").alias("n"))


def label_encoder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encoder(_tokens(spark, sf_dir), "tag")


def padded_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    lens = F.transform("w", lambda w: F.length(w))
    return _words(spark, sf_dir).select("doc_id", "line_no", F.array_join(F.transform(tokens.padded(lens, 8), lambda x: x.cast("string")), ",").alias("codes"))


def rf_tagger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tagging.forest_predictions(_tokens(spark, sf_dir))


def crf_substitute(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tagging.regression_predictions(_tokens(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (
        eval_relaxed_strict, eval_filtered_attr, eval_by_language, unmatched_gold, unmatched_system, file_pairing, position_histogram, histogram_total, histogram_weighted,
        tag_frequency, tag_line_counts, tag_unique_total, bio_tokens, sentence_numbers, number_tids, forward_fill, context_features, memory_tagger, label_scores, token_accuracy,
        memory_tagger_folds, label_scores_folds, token_accuracy_folds, rare_words, label_encoder,
        padded_codes, rf_tagger, crf_substitute,
    )
} | {
    "report_false_normalised": _report(R.false_normalised, "tag1_attr_value", "tag2_attr_value"),
    "report_false_positive": _report(R.false_positives, "tag1_basename", "tag1_text"),
    "report_false_negative": _report(R.false_negatives, "tag1_basename", "tag1_text"),
    "report_strict_mismatch": _report(R.strict_mismatches, "tag1_basename", "tag1_attr_tid"),
    "report_strict_mismatch_known": lambda spark, sf_dir: R.strict_mismatches(table(spark, sf_dir, "decisions").where("tag1_attr_tid is not null")).select("decision_id", "tag1_attr_tid"),
}

_HIT = "g.doc_id = s.doc_id and g.line_no = s.line_no and g.a <= s.b and s.a <= g.b"
_DEC = f"""{SQL_W},
pairs as (select g.doc_id, g.line_no, g.t as gt, s.t as st, g.type as g_type, s.type as s_type, g.value as g_value, s.value as s_value, g.lit from gold g join system s on {_HIT}),
lg as (select *, lit from gold g where not exists (select 1 from system s where {_HIT})),
ls as (select *, false as lit from system s where not exists (select 1 from gold g where {_HIT})),
dec as (
  select doc_id, lit, 'TAG_RELAXED' as task_type, '' as attr_name, 'TP' as result_type from pairs
  union all select doc_id, lit, 'TAG_STRICT', '', 'TP' from pairs where gt = st
  union all select doc_id, lit, 'TAG_STRICT', '', unnest(['FP', 'FN']) from pairs where gt <> st
  union all select doc_id, lit, 'ATTRIBUTE', unnest(['type', 'value']), 'ATTR_MATCH_POSSIBLE' from pairs
  union all select doc_id, lit, 'ATTRIBUTE', 'type', 'TP' from pairs where g_type <> '' and g_type = s_type
  union all select doc_id, lit, 'ATTRIBUTE', 'type', unnest(['FP', 'FN']) from pairs where g_type <> '' and g_type <> s_type
  union all select doc_id, lit, 'ATTRIBUTE', 'value', 'TP' from pairs where g_value <> '' and g_value = s_value
  union all select doc_id, lit, 'ATTRIBUTE', 'value', unnest(['FP', 'FN']) from pairs where g_value <> '' and g_value <> s_value
  union all select doc_id, lit, unnest(['TAG_RELAXED', 'TAG_STRICT', 'ATTRIBUTE', 'ATTRIBUTE']), unnest(['', '', 'type', 'value']), 'FN' from lg
  union all select doc_id, lit, unnest(['TAG_RELAXED', 'TAG_STRICT', 'ATTRIBUTE', 'ATTRIBUTE']), unnest(['', '', 'type', 'value']), 'FP' from ls)"""
_PR = """case when tp + fp = 0 then 'nan'::double else tp::double / (tp + fp) end as p, case when tp + fn = 0 then 'nan'::double else tp::double / (tp + fn) end as r"""


def _f(beta: float, name: str) -> str:
    b = beta * beta
    return f"case when isnan(p) or isnan(r) or (p = 0 and r = 0) then 'nan'::double else round({1 + b} * p * r / ({b} * p + r), 6) end as {name}"


_SCORES = f"round(p, 6) as precision, round(r, 6) as recall, {_f(0.5, 'f05')}, {_f(1.0, 'f1')}, {_f(2.0, 'f2')}"
_COUNTS = "count(*) filter (result_type = 'TP') as tp, count(*) filter (result_type = 'FP') as fp, count(*) filter (result_type = 'FN') as fn"


def _eval_sql(where: str) -> str:
    return f"""with {_DEC}, c as (select task_type, attr_name, {_COUNTS}, count(*) filter (result_type = 'ATTR_MATCH_POSSIBLE') as max_matches from dec where {where} group by 1, 2)
    select task_type, attr_name, tp, fp, fn, max_matches, {_SCORES}, case when max_matches = 0 then 'nan'::double else round(tp::double / max_matches, 6) end as accuracy from (select *, {_PR} from c)"""


_POS = "(select distinct tag1_basename as basename, tag1_text_pos_start as pos from decisions where tag1_is_gold and tag1_text_pos_start is not null)"
_HIST = f"""(select basename, bin, n, sum(n) over (partition by basename)::bigint as occurrences from (
    select p.basename, (20 * p.pos::bigint) // t.chars as bin, count(*) as n from {_POS} p join (select doc as basename, length(text) as chars from timeml_docs) t on p.basename = t.basename and t.chars > 0 group by 1, 2))"""
_FP = "select tag1_attr_tid from decisions where task_type in ('TAG_RELAXED', 'RELAXED') and result_type = 'FP'"
_FN = "task_type in ('ATTRIBUTE', 'ATTR') and attr_name = 'value' and result_type = 'FN' and tag1_attr_value <> tag2_attr_value"
ORACLES = {
    "eval_relaxed_strict": _eval_sql("true"),
    "eval_filtered_attr": _eval_sql("not lit"),
    "eval_by_language": f"""with {_DEC}, c as (select coalesce(lang, 'all') as lang, {_COUNTS} from (select dec.*, coalesce(d.lang, '?') as lang from dec join documents d using (doc_id)) where task_type = 'TAG_RELAXED' group by rollup (lang))
        select lang, tp, fp, fn, {_SCORES} from (select *, {_PR} from c)""",
    "unmatched_gold": f"with {_DEC} select doc_id, line_no, t as text, a as start_in_line from lg",
    "unmatched_system": f"with {_DEC} select doc_id, line_no, t as text, a as start_in_line from ls",
    "file_pairing": """with p as (select 'gold/' || doc as path, string_split(regexp_replace(doc, '\\.[^.]*$', ''), '_') as p from timeml_docs where doc is not null),
        runs as (select path, array_to_string(p[i:j], '_') as base from (select path, p, i, unnest(range(i, len(p) + 1)) as j from (select path, p, unnest(range(1, len(p) + 1)) as i from p)))
        select base, min(path) as path from (select distinct regexp_extract(doc, '^([^_]+_text_[0-9]+)', 1) as base from timeml_docs where doc is not null) join runs using (base) group by 1""",
    "position_histogram": f"select basename, bin, n, occurrences from {_HIST}",
    "histogram_total": f"select bin, sum(n)::bigint as n from {_HIST} group by 1",
    "histogram_weighted": f"select bin, ((2 * sum((20000 * n + occurrences) // (2 * occurrences)) + (select count(*) from timeml_docs)) // (2 * (select count(*) from timeml_docs)))::double / 10000 as mean from {_HIST} group by 1",
    "tag_frequency": f"with {SQL_W} select t as text, count(*) as n from gold group by 1",
    "tag_line_counts": f"with {SQL_W} select doc_id, count(*) filter (n > 2) as n_lines from (select doc_id, line_no, max(n) as n from words group by 1, 2) group by 1",
    "tag_unique_total": f"with {SQL_W} select coalesce(lang, '?') as lang, count(*) as total, count(distinct t) as uniq from gold join documents using (doc_id) group by 1",
    "sentence_numbers": f"with {SQL_W} select doc_id, line_no, row_number() over (order by doc_id, line_no) - 1 as sentence_no from w0 where len(w) > 0",
    "number_tids": f"""with {SQL_W}, e as (select words.*, replace(replace(replace(w, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') as x, i % 5 = 2 as tagged, sum(case when i % 5 = 2 then 1 else 0 end) over (order by doc_id, line_no, i) as tid from words)
        select doc_id, line_no, string_agg(case when tagged then '<TIMEX3 tid="t' || tid || '" type="' || case when k % 2 = 0 then 'DATE' else 'DURATION' end || '" value="' || case when k % 6 = 0 then '' else k::varchar end
        || case when doc_id % 3 = 0 then '" literature-time="true">' else '">' end || x || '</TIMEX3>' else x end, ' ' order by i) as line from e group by 1, 2""",
    "forward_fill": f"with {SQL_TOKENS} select doc_id, line_no, word_no, last_value(case when word_no % 4 = 0 then word end ignore nulls) over (partition by doc_id, line_no order by word_no) as mark from tok",
    "context_features": rf"""with {SQL_TOKENS} select doc_id, line_no, word_no, word, lag(word, 1, 'BOS') over w as prev_word, lead(word, 1, 'EOS') over w as next_word, lower(word) as lower, right(word, 3) as suffix3, right(word, 2) as suffix2,
        regexp_matches(word, '\p{{L}}') and not regexp_matches(word, '\p{{Lu}}') as is_lower, regexp_matches(word, '\p{{L}}') and not regexp_matches(word, '\p{{Ll}}') as is_upper,
        regexp_matches(word, '^\p{{Lu}}\P{{Lu}}*$') as is_title, regexp_matches(word, '^[0-9]+$') as is_digit, length(word) as len from tok window w as (partition by doc_id, line_no order by word_no)""",
    "memory_tagger": f"""with {SQL_TOKENS}, m as (select word, tag from (select word, tag, row_number() over (partition by word order by count(*) desc, tag) as r from tok where doc_id % 5 <> 0 group by 1, 2) where r = 1)
        select doc_id, line_no, word_no, coalesce(m.tag, 'O') as predicted from tok left join m using (word) where doc_id % 5 = 0""",
    "label_scores": f"""with {SQL_TOKENS}, m as (select word, tag from (select word, tag, row_number() over (partition by word order by count(*) desc, tag) as r from tok where doc_id % 5 <> 0 group by 1, 2) where r = 1),
        p as (select tok.tag, coalesce(m.tag, 'O') as predicted from tok left join m using (word) where doc_id % 5 = 0),
        c as (select label, count(*) filter (tag = label and predicted = label) as tp, count(*) filter (tag <> label and predicted = label) as fp, count(*) filter (tag = label and predicted <> label) as fn
              from p, (select tag as label from p union select predicted from p) where label <> 'O' group by 1)
        select label, tp, fp, fn, round(pr, 6) as precision, round(re, 6) as recall, case when pr + re = 0 then 0.0 else round(2 * pr * re / (pr + re), 6) end as f1, tp + fn as support
        from (select *, case when tp + fp = 0 then 0.0 else tp::double / (tp + fp) end as pr, case when tp + fn = 0 then 0.0 else tp::double / (tp + fn) end as re from c)""",
    "token_accuracy": f"""with {SQL_TOKENS}, m as (select word, tag from (select word, tag, row_number() over (partition by word order by count(*) desc, tag) as r from tok where doc_id % 5 <> 0 group by 1, 2) where r = 1),
        p as (select tok.tag, coalesce(m.tag, 'O') as predicted from tok left join m using (word) where doc_id % 5 = 0),
        c as (select avg((tag = predicted)::int) as a, count(*) filter (tag = predicted and tag <> 'O') as tp, count(*) filter (tag <> 'O') as g, count(*) filter (predicted <> 'O') as q from p)
        select round(a, 6) as accuracy, case when q = 0 then 0.0 else round(tp::double / q, 6) end as precision, case when g = 0 then 0.0 else round(tp::double / g, 6) end as recall, case when g + q = 0 then 0.0 else round(2.0::double * tp / (g + q), 6) end as f1 from c""",
    "rare_words": f"with {SQL_TOKENS} select case when n < 3 then '__RARE_WORD__' else word end as word, sum(n)::bigint as n from (select word, count(*) as n from tok group by 1) group by 1",
    "label_encoder": f"with {SQL_TOKENS} select tag, row_number() over (order by tag) - 1 as code from (select distinct tag from tok)",
    "padded_codes": f"with {SQL_W} select doc_id, line_no, array_to_string(list_resize(list_transform(w[1:8], lambda x: length(x)), 8, 0), ',') as codes from w0 where len(w) > 0",
    "report_false_normalised": f"select decision_id, tag1_attr_value, tag2_attr_value from decisions where {_FN}",
    "report_false_positive": "select decision_id, tag1_basename, tag1_text from decisions where task_type in ('TAG_RELAXED', 'RELAXED') and result_type = 'FP'",
    "report_false_negative": "select decision_id, tag1_basename, tag1_text from decisions where task_type in ('TAG_RELAXED', 'RELAXED') and result_type = 'FN'",
    "report_strict_mismatch": f"""select decision_id, tag1_basename, tag1_attr_tid from decisions where task_type in ('TAG_STRICT', 'STRICT') and result_type = 'FP'
        and tag1_attr_tid not in ({_FP}) and tag1_attr_tid not in (select tag1_attr_tid from decisions where {_FN})""",
    "report_strict_mismatch_known": f"""with decisions as (select * from main.decisions where tag1_attr_tid is not null) select decision_id, tag1_attr_tid from decisions where task_type in ('TAG_STRICT', 'STRICT') and result_type = 'FP'
        and tag1_attr_tid not in ({_FP}) and tag1_attr_tid not in (select tag1_attr_tid from decisions where {_FN})""",
    "bio_tokens": rf"""with {SQL_W}, x as (select w.doc_id, w.line_no, w.i, len(regexp_extract_all(w.w, '[\p{{L}}\p{{M}}\p{{N}}_]+(?:[''’][\p{{L}}\p{{M}}]+)?|[^\t\n\x0b\f\r \p{{L}}\p{{M}}\p{{N}}_]')) as c, s.i as si, p.i as pi
          from words w left join system s on s.doc_id = w.doc_id and s.line_no = w.line_no and s.i = w.i left join sys0 p on p.doc_id = w.doc_id and p.line_no = w.line_no and p.i = w.i - 1 and p.two)
        select doc_id, line_no, (count(*) filter (si is not null and c > 0) + count(*) filter (si is null and pi is not null and false))::bigint as b,
          coalesce(sum(case when si is not null then greatest(c - 1, 0) when pi is not null then c end), 0)::bigint as i, coalesce(sum(case when si is null and pi is null then c end), 0)::bigint as o from x group by 1, 2""",
}
