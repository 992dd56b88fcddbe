"""Documents, lines and tables from files, and texts from documents of several formats."""

from __future__ import annotations

import ast
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lapidar.functions import markup as M
from lapidar.functions import text as X


def documents(spark: SparkSession, path: str, pattern: str = "*", recursive: bool = False, encoding: str = "UTF-8") -> DataFrame:
    """(path, name, extension, content, text) of a file, of all files of a folder, or of those a pattern picks. Text is decoded as it stands."""
    r = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", recursive).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return r.select("path", base_name(name).alias("name"), F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1)).alias("extension"), "content", F.decode("content", encoding).alias("text"))


def base_name(name: Column, drop: str = "_DONE") -> Column:
    """A file's name without its last extension and without a mark of finished work."""
    return F.regexp_replace(F.regexp_replace(name, r"\.[^.]*$", ""), f"{drop}$", "")


def lines(docs: DataFrame, key: str = "name", text: str = "text") -> DataFrame:
    """(key, line_no, line), with all of Unicode's line ends."""
    return docs.select(key, F.posexplode(X.split_lines(F.col(text))).alias("line_no", "line"))


# -- text extraction, by extension


def _plain(d: DataFrame) -> DataFrame:
    return d.withColumn("text", F.col("text"))


def _markup(d: DataFrame) -> DataFrame:
    return d.withColumn("text", M.plain_text(F.regexp_replace("text", r"(?s)<(script|style)\b.*?</\1>", "")))


def _outside(tool: str) -> Callable[[DataFrame], DataFrame]:
    def run(d: DataFrame) -> DataFrame:
        raise NotImplementedError(f"register a function that runs {tool} on the column content")

    return run


EXTRACTORS: dict[str, Callable[[DataFrame], DataFrame]] = {"text": _plain, "markup": _markup, "ghostscript": _outside("gs"), "pdfminer": _outside("pdf2txt"), "mupdf": _outside("mutool")}
BY_EXTENSION = {"txt": "text", "xml": "markup", "html": "markup", "htm": "markup", "pdf": "mupdf"}


def register(name: str, extractor: Callable[[DataFrame], DataFrame]) -> None:
    EXTRACTORS[name] = extractor


def extracted(docs: DataFrame, extensions: tuple[str, ...] = ("txt", "xml", "html", "htm")) -> DataFrame:
    """docs with the text that the extractor for each extension gives; any extension without one is an error at run time."""
    kinds: dict[str, list[str]] = {}
    for e in extensions:
        kinds.setdefault(BY_EXTENSION[e], []).append(e)
    parts = [EXTRACTORS[k](docs.where(F.col("extension").isin(es))) for k, es in kinds.items()]
    other = docs.where(~F.col("extension").isin(*extensions) | F.col("extension").isNull())
    parts.append(other.withColumn("text", F.raise_error(F.concat(F.lit("no extractor for "), F.coalesce("extension", F.lit("?")))).cast("string")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# -- tables


def json_array(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def csv_table(spark: SparkSession, path: str, schema: T.StructType | str, sep: str = ",", fallback: str = "ISO-8859-1") -> DataFrame:
    """A CSV file with header; read in the fallback encoding if it isn't valid UTF-8."""
    raw = spark.read.format("binaryFile").load(path)
    bad = raw.where(~F.is_valid_utf8(F.col("content").cast("string"))).limit(1).count()
    return spark.read.schema(schema).option("header", True).option("sep", sep).option("encoding", fallback if bad else "UTF-8").option("multiLine", True).option("escape", '"').csv(path)


PAIRS = "array<struct<lang:string,term:string>>"


def literal_pairs(col: Column) -> Column:
    """Lists of (lang, term) written as literals; lines that are none, such as a notice that nothing was found, give null. Nothing is ever executed."""

    @F.pandas_udf(PAIRS)
    def parse(s: pd.Series) -> pd.Series:
        def one(x: str | None):
            try:
                return [{"lang": str(a), "term": str(b)} for a, b in ast.literal_eval(x)]
            except (ValueError, SyntaxError, TypeError):
                return None

        return s.map(one)

    return parse(col)


def after_junk(body: Column) -> Column:
    """A response from its first { on."""
    return F.when(F.instr(body, "{") > 0, F.substring(body, F.instr(body, "{"), F.length(body)))
