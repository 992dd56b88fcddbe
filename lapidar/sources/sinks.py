"""Where results go. Nothing that exists is overwritten."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stage_path(root: str, number: int, name: str, mark: str = "") -> str:
    """Folder of a numbered step, as 003_clean; mark: TODO or DONE."""
    return f"{root}/{number:03d}_{name}{'-' + mark if mark else ''}"


def text_lines(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """One column of lines, in folders by the others; an existing path is an error."""
    w = df.write.mode("errorifexists")
    (w.partitionBy(*by) if by else w).text(path)


def by_language(df: DataFrame, path: str, lang: str = "lang") -> None:
    df.withColumn(lang, F.coalesce(lang, F.lit("unknown"))).repartition(F.col(lang), F.pmod(F.xxhash64(*df.columns), F.lit(16))).write.mode("errorifexists").partitionBy(lang).parquet(path)


def quoted_csv(df: DataFrame, path: str, sep: str = ";") -> None:
    """All fields quoted, as decision tables, overviews and record lists are."""
    df.write.mode("errorifexists").option("header", True).option("sep", sep).option("quoteAll", True).option("escape", '"').option("nullValue", "").csv(path)


def token_csv(df: DataFrame, path: str) -> None:
    """Sentence #, Word, POS, Tag; the sentence stands on its first word only."""
    first = F.when(F.col("word_no") == 0, F.concat(F.lit("Sentence: "), F.col("sentence_no").cast("string"))).otherwise("")
    rows = df.select("sentence_no", "word_no", first.alias("Sentence #"), F.col("word").alias("Word"), F.col("pos").alias("POS"), F.col("tag").alias("Tag"))
    rows.repartitionByRange("sentence_no").sortWithinPartitions("sentence_no", "word_no").drop("sentence_no", "word_no").write.mode("errorifexists").option("header", True).option("emptyValue", "").csv(path)


def decision_columns(d: DataFrame) -> DataFrame:
    """Decisions with their two tags as flat columns; those of an absent second tag are null."""
    def tag(n: int) -> list:
        t = f"tag{n}"
        a = lambda k: F.try_element_at(F.col(f"{t}.attrs"), F.lit(k))
        return [
            F.col(f"{t}.start_in_line").alias(f"{t}_text_pos_start"), F.col(f"{t}.end_in_line").alias(f"{t}_text_pos_end"), a("tid").alias(f"{t}_attr_tid"),
            a("type").alias(f"{t}_attr_type"), a("value").alias(f"{t}_attr_value"), a("literature-time").alias(f"{t}_attr_literature_time"), F.col(f"{t}.text").alias(f"{t}_text"),
        ]

    keys = [c for c in d.columns if c not in ("tag1", "tag2")]
    return d.select(*keys, *tag(1), *tag(2))


def added(existing: DataFrame, new: DataFrame) -> DataFrame:
    """existing and the rows of new that it doesn't hold yet."""
    return existing.unionByName(new.distinct().join(existing, new.columns, "left_anti"))


def pattern_files(df: DataFrame, path: str, lang: str = "lang") -> None:
    """Pattern and normalisation lines of each language, sorted in that order of lines, in folders patterns and norms. df has lang, pattern, norm."""
    for name in ("pattern", "norm"):
        part = df.select(lang, name).where(F.col(name).isNotNull()).repartitionByRange(lang, name).sortWithinPartitions(lang, name)
        part.write.mode("errorifexists").partitionBy(lang).text(f"{path}/{name}s")


def json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").json(path)
