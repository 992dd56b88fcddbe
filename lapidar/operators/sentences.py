"""Rule-based sentence splitting: end marks followed by a blank, unless what stands before or after them says otherwise.

Abbreviations aren't listed: they are learned from the texts, as words that hardly ever stand without a full stop and
either often go on in small letters after it or are very short.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapidar.functions import text as T

LEAST = 5
"""So often at least a word must have been seen with a full stop."""
MOST = 10_000
"""Of the learned abbreviations the most frequent ones are kept, at most so many."""
TOKEN = r"^[(\[„“«\"‘]*(\p{L}+(?:\.\p{L}+)*)\.?[,;:)\]]*$"
DOTTED = r"\p{L}\.[,;:)\]]*$"
GOES_ON = r"^[\p{Ll}0-9]"
LAST_WORD = r"(\p{L}+(?:\.\p{L}+)*)\.$"
# single letters, letter pairs, numbers below 1000, page references, roman numbers
NO_END = r"(?:^|[\s(\[])(?:\p{L}|\p{L}\.\p{L}|[1-9][0-9]{0,2}|[0-9]{1,4}ff?|[IVXLC]+)\.$"
SHORT_WORD = r"(?:^|[\s(\[])\p{L}{1,4}\.$"


def abbreviations(df: DataFrame, text: str = "text") -> DataFrame:
    """(word, n): abbreviations of the texts, in small letters without their last full stop. Counted map-side, word by word."""
    tokens = df.select(F.split(T.squash(F.col(text)), " ").alias("t"))
    pairs = tokens.select(F.inline(F.transform("t", lambda t, i: F.struct(t.alias("t"), F.coalesce(F.get("t", i + 1), F.lit("")).alias("next")))))
    dotted = F.regexp_like("t", F.lit(DOTTED))
    words = pairs.select(
        F.lower(F.regexp_extract("t", TOKEN, 1)).alias("word"), dotted.alias("dot"), (dotted & (F.regexp_like("next", F.lit(GOES_ON)) | ~F.col("t").endswith("."))).alias("inner"),
    )
    n = words.where("word <> ''").groupBy("word").agg(F.count("*").alias("all"), F.count_if("dot").alias("n"), F.count_if("inner").alias("inner"))
    return n.where((F.col("n") >= LEAST) & (F.col("n") * 10 >= F.col("all") * 9) & ((F.col("inner") * 4 >= F.col("n")) | (F.length("word") <= 3))).select("word", "n")


def split_text(text: Column, known: tuple[str, ...] = ()) -> Column:
    """Sentences of a text, each with single blanks. known: abbreviations that end no sentence."""
    parts = F.split(T.squash(text), r"(?<=[.!?…])(?=[ ])")

    def step(acc: Column, part: Column) -> Column:
        last = F.element_at(acc, -1)
        short = last.rlike(SHORT_WORD) & part.rlike(r"^ [0-9]")
        open_ = (F.size(acc) > 0) & (last.rlike(NO_END) | part.rlike(r"^ \p{Ll}") | short)
        if known:
            open_ = open_ | ((F.size(acc) > 0) & F.lower(F.regexp_extract(last, LAST_WORD, 1)).isin(list(known)))
        joined = F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.concat(last, part)))
        return F.when(open_, joined).otherwise(F.concat(acc, F.array(part)))

    folded = F.aggregate(parts, F.array().cast("array<string>"), step)
    return F.filter(F.transform(folded, lambda s: F.trim(s)), lambda s: s != "")


def rule_sentences(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, sentence_no, sentence), with the abbreviations of these very texts."""
    known = tuple(r.word for r in abbreviations(df, text).orderBy(F.desc("n"), "word").limit(MOST).collect())
    return df.select(key, F.posexplode(split_text(F.col(text), known)).alias("sentence_no", "sentence")).withColumn("sentence_no", F.col("sentence_no").cast("bigint"))
