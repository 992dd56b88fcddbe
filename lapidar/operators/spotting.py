"""Period names found in lines: a gazetteer tagger."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

def spotted(lines: DataFrame, names: DataFrame, keys: list[str], line: str = "line") -> DataFrame:
    """(keys, name, word_no): each place where a line's words are a name of names (name). Runs of words meet names in a join of equals."""
    names = names.select("name").distinct()
    longest = names.agg(F.max(F.size(F.split("name", " ")))).first()[0] or 1
    words = F.regexp_extract_all(F.col(line), F.lit(r"([\p{L}\p{M}\p{N}'’-]+)"), F.lit(1))
    w = lines.select(*keys, words.alias("w"))
    runs = F.flatten(F.transform("w", lambda _, i: F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), F.size("w") - i)), lambda n: F.struct(i.alias("word_no"), F.array_join(F.slice("w", i + 1, n), " ").alias("name")))))
    return w.select(*keys, F.inline(runs)).join(names, "name")
