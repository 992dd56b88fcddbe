"""Queries of sources, streams and order, with the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapidar.functions import text as T
from lapidar.operators import gazetteer, lang, spotting
from lapidar.sources import files, sinks
from lapidar.streaming import windows
from lapidar.runtime import spread, table


def markup_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents rendered as HTML and read back as text."""
    d = spread(table(spark, sf_dir, "documents").where("text is not null"))
    page = F.concat(F.lit("<html><head><style>p > a { }</style></head><body><p class=\"x\">"), T.escape_xml(F.col("text")), F.lit("</p><script>a < b</script></body></html>"))
    docs = d.select("doc_id", F.lit("html").alias("extension"), page.alias("text"))
    return files.extracted(docs, ("html", "txt")).select("doc_id", "text")


def language_guess(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spread(table(spark, sf_dir, "timeml_docs").where("text is not null"))
    return d.select("tml_id", lang.guess(F.col("text")).alias("lang"))


def collated_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct names in German order, with their rank."""
    n = gazetteer.epoch_names(table(spark, sf_dir, "epochs")).where("lang = 'de'").select("name").distinct()
    return n.orderBy(F.collate("name", "de"))


def append_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select(F.col("n_name").alias("rule"))
    return sinks.added(n.where("rule < 'K'"), n.where("rule > 'F'"))


def folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents dealt into five folds, with their sizes."""
    d = table(spark, sf_dir, "documents").select(F.pmod("doc_id", F.lit(5)).alias("fold"), F.coalesce(F.length("text"), F.lit(0)).alias("n"))
    return d.groupBy("fold").agg(F.count("*").alias("docs"), F.sum("n").alias("chars"))


def spotted_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = gazetteer.epoch_names(table(spark, sf_dir, "epochs")).select("name")
    d = spread(table(spark, sf_dir, "timeml_docs").where("text is not null").select("tml_id", F.col("text").alias("line")))
    return spotting.spotted(d, names, ["tml_id"]).groupBy("name").agg(F.count("*").alias("n"))


def stream_event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    stream = windows.folder_stream(spark, sf_dir, schema, "events.parquet")
    return windows.drained(spark, stream, windows.event_counts, ["window_start", "event_type"]).select("event_type", F.unix_timestamp("window_start").alias("window_start"), "n", F.round("total", 4).alias("total"))


def unprocessed_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "timeml_docs").select(F.col("doc").alias("path"))
    done = table(spark, sf_dir, "decisions").select(F.col("tag1_basename").alias("path")).distinct()
    return windows.unprocessed(found, done)


QUERIES = {f.__name__: f for f in (markup_text, language_guess, collated_names, append_absent, folds, spotted_names, stream_event_counts, unprocessed_docs)}


def _guess() -> str:
    def one(code: str, words: str) -> str:
        listed = ", ".join(f"'{w}'" for w in words.split())
        return f"len(list_filter(w, lambda x: x in ({listed})))"

    langs = sorted(lang.FUNCTION_WORDS)
    counts = ", ".join(f"{one(c, lang.FUNCTION_WORDS[c])} as n_{c}" for c in langs)
    best = "greatest(" + ", ".join(f"n_{c}" for c in langs) + ")"
    case = " ".join(f"when n_{c} = {best} then '{c}'" for c in langs)
    return rf"select tml_id, case {case} end as lang from (select tml_id, {counts} from (select tml_id, regexp_split_to_array(lower(text), '[^\p{{L}}]+') as w from timeml_docs where text is not null))"


ORACLES = {
    "markup_text": "select doc_id, text from documents where text is not null",
    "language_guess": _guess(),
    "collated_names": r"""select distinct name from (select lang, trim(regexp_replace(regexp_replace(raw, ' \(.*\)', ''), ', .*$', '')) as name
        from (select lang, unnest(l) as raw from (select unnest(map_keys(names)) as lang, unnest(map_values(names)) as l from epochs))) where lang = 'de' and name <> ''""",
    "append_absent": "select n_name as rule from nation where n_name < 'K' union select n_name from nation where n_name > 'F'",
    "folds": "select doc_id % 5 as fold, count(*) as docs, sum(coalesce(length(text), 0))::bigint as chars from documents group by 1",
    "stream_event_counts": "select event_type, epoch(date_trunc('hour', ts))::bigint as window_start, count(*) as n, round(sum(value), 4) as total from events group by 1, 2",
    "unprocessed_docs": "select doc as path from timeml_docs where doc not in (select tag1_basename from decisions where tag1_basename is not null)",
}
