"""The whole preparation of plain texts as one plan, narrow but for a partitioned write."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapidar.functions import text as T
from lapidar.operators import lang, sentences
from lapidar.runtime import spread, table


def prepared(docs: DataFrame, known: list[str] | None = None, window: int | None = None) -> DataFrame:
    """(doc_id, lang, sentence_no, sentence): texts cleaned, told apart by language, joined at line ends, cut, escaped.

    German words are joined before a small letter, others if the whole is in known; without a list
    they are joined before a small letter too. window: only so many sentences of each longer text,
    from a place that comes from the id. Null and blank texts give nothing.
    """
    d = docs.where("text is not null").select("doc_id", T.clean_whitespace(T.split_lines(F.col("text"))).alias("lines"))
    d = d.withColumn("lang", lang.guess(F.array_join("lines", "\n")))
    lower = T.join_hyphenated(F.col("lines"))
    joined = lower if known is None else F.when(F.col("lang") == "de", lower).otherwise(T.join_hyphenated(F.col("lines"), known=F.array(*map(F.lit, known))))
    s = d.select("doc_id", "lang", F.transform(sentences.split_text(F.array_join(joined, "\n")), T.escape_xml).alias("s"))
    if window:
        n = F.size("s")
        start = F.when(n > window, F.pmod(F.xxhash64("doc_id"), n - window)).otherwise(0).cast("int")
        s = s.withColumn("s", F.slice("s", start + 1, F.when(n > window, F.lit(window)).otherwise(F.greatest(n, F.lit(1)))))
    return s.select("doc_id", "lang", F.posexplode("s").alias("sentence_no", "sentence"))


def preprocess_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepared(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))


QUERIES = {"preprocess_pipeline": preprocess_pipeline}
ORACLES: dict = {}
