"""Token tables with BIO labels, and what is derived from them in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapidar.functions import markup as M
from lapidar.functions import text as T

WORD = r"[\p{L}\p{M}\p{N}_]+(?:['’][\p{L}\p{M}]+)?|[^\s\p{L}\p{M}\p{N}_]"


def paired(words: Column, tags: Column) -> Column:
    """array<struct<word, tag>> of two lists by place; an error at run time if their lengths differ."""
    both = F.zip_with(words, tags, lambda w, t: F.struct(w.alias("word"), t.alias("tag")))
    return F.when(F.size(words) == F.size(tags), both).otherwise(F.raise_error(F.lit("lists of different length")).cast("array<struct<word:string,tag:string>>"))


def sentence_lists(t: DataFrame, keys: list[str], order: str = "word_no", columns: tuple[str, ...] = ("word", "pos", "tag")) -> DataFrame:
    """(keys, tokens): each sentence's tokens in order. A sentence is one row's worth by nature."""
    return t.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, *columns))), lambda x: F.struct(*(x[c].alias(c) for c in columns))).alias("tokens"))


def bio_table(lines: DataFrame, keys: list[str], markup: str = "line", mode: str = "default") -> DataFrame:
    """(keys, word_no, word, tag): words of each line with the label of the outermost range that holds them.

    A range's first word gets B-, the others I-; words in no range get O. A line without words gives one row (., O).
    Words are cut at tags, as each text node is cut for itself.
    """
    one = F.filter(M.spans(F.col(markup)), lambda s: s["end"] > s["start"])

    def cut(acc: Column, p: Column) -> Column:
        words = F.regexp_extract_all(T.unescape_xml(p), F.lit(f"({WORD})"), F.lit(1))
        text = F.when(M.is_text(p), F.transform(words, lambda w: F.struct(w.alias("word"), acc["at"].alias("at")))).otherwise(F.array().cast("array<struct<word:string,at:int>>"))
        return F.struct((acc["at"] + F.when(M.is_text(p), F.length(T.unescape_xml(p))).otherwise(0)).alias("at"), F.concat(acc["out"], text).alias("out"))

    words = F.aggregate(M.pieces(F.col(markup)), F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<word:string,at:int>>").alias("out")), cut, lambda a: a["out"])
    base = lines.select(*keys, words.alias("w"), one.alias("spans"))
    named = F.filter(F.transform("spans", lambda s: F.struct(s["depth"].alias("depth"), s["start"].alias("start"), s["end"].alias("end"), s["tag_seq"].alias("seq"), _label(s, mode).alias("label"))), lambda s: s["label"] != "")
    base = base.select(*keys, "w", named.alias("named"))
    # the text node's start decides which ranges hold its words
    tagged = F.transform("w", lambda w: F.struct(w["word"].alias("word"), F.try_element_at(F.array_sort(F.filter("named", lambda s: (s["start"] <= w["at"]) & (w["at"] < s["end"]))), F.lit(1)).alias("s")))
    # a range's first word is where its number stands first
    place = lambda t, seqs: F.transform(t, lambda x, i: F.struct(x["word"].alias("word"), x["s"]["label"].alias("label"), (F.array_position(seqs, x["s"]["seq"]) == i + 1).alias("first")))
    # arrays around t and seqs: each is worked out once
    placed = F.flatten(F.transform(F.array(tagged), lambda t: F.flatten(F.transform(F.array(F.transform(t, lambda x: x["s"]["seq"])), lambda seqs: place(t, seqs)))))
    rows = base.select(*keys, F.posexplode_outer(placed).alias("word_no", "t"))
    tag = F.when(F.col("t.label").isNull(), "O").otherwise(F.concat(F.when(F.col("t.first"), "B-").otherwise("I-"), "t.label"))
    return rows.select(*keys, F.coalesce("word_no", F.lit(0)).cast("bigint").alias("word_no"), F.coalesce("t.word", F.lit(".")).alias("word"), tag.alias("tag"))


def _label(s: Column, mode: str) -> Column:
    """A span's label, or empty: time expressions by name, named entities by type; or only some of them."""
    name, kind = F.lower(s["name"]), F.coalesce(F.try_element_at(s["attrs"], F.lit("type")), F.lit(""))
    time = name.isin("timex3", "temponym")
    if mode == "only_time":
        return F.when(time, name).otherwise("")
    if mode == "only_non_timex":
        return F.when(name == "dne", kind).otherwise("")
    if mode == "literature":
        return F.when(name == "literature", name).otherwise("")
    return F.when(time, name).when(name == "dne", kind).otherwise("")


def summed_before(df: DataFrame, group: str, order: list[str], value: str) -> DataFrame:
    """(group, order, before): the sum of value over all rows that come before in the order of group, then order, without one window over all rows.

    Sums run within each group; what comes before it is a running sum over one row per block of 1024 groups.
    """
    block = F.floor(F.col(group) / 1024)
    sums = df.groupBy(group).agg(F.sum(value).alias("_n"))
    in_block = Window.partitionBy(block).orderBy(group).rowsBetween(Window.unboundedPreceding, -1)
    over = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # one row for 1024 groups
    base = sums.groupBy(block.alias("_b")).agg(F.sum("_n").alias("_s")).withColumn("_base", F.coalesce(F.sum("_s").over(over), F.lit(0))).drop("_s")
    offsets = sums.withColumn("_b", block).withColumn("_in", F.coalesce(F.sum("_n").over(in_block), F.lit(0))).join(base, "_b").select(group, (F.col("_in") + F.col("_base")).alias("_off"))
    inner = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("_r", F.coalesce(F.sum(value).over(inner), F.lit(0))).join(offsets, group).select(group, *order, (F.col("_r") + F.col("_off")).cast("bigint").alias("before"))


def numbered(df: DataFrame, group: str, order: list[str], name: str = "sentence_no") -> DataFrame:
    """df's distinct (group, order) with running numbers from 0 over all of them."""
    return summed_before(df.withColumn("_one", F.lit(1)), group, order, "_one").withColumnRenamed("before", name)


def forward_fill(df: DataFrame, group: list[str], order: list[str], cols: list[str]) -> DataFrame:
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in cols})


def context_features(df: DataFrame, group: list[str], order: str, word: str = "word", keep: tuple[str, ...] = ()) -> DataFrame:
    """Neighbours with marks at the ends, and the word's shape, each sentence for itself; keep: other columns to carry along."""
    w = Window.partitionBy(*group).orderBy(order)
    c = F.col(word)
    return df.select(
        *group, order, word,
        F.lag(c, 1, "BOS").over(w).alias("prev_word"),
        F.lead(c, 1, "EOS").over(w).alias("next_word"),
        F.lower(c).alias("lower"),
        F.right(c, F.lit(3)).alias("suffix3"),
        F.right(c, F.lit(2)).alias("suffix2"),
        (c.rlike(r"\p{L}") & ~c.rlike(r"\p{Lu}")).alias("is_lower"),
        (c.rlike(r"\p{L}") & ~c.rlike(r"\p{Ll}")).alias("is_upper"),
        c.rlike(r"^\p{Lu}\P{Lu}*$").alias("is_title"),
        c.rlike(r"^[0-9]+$").alias("is_digit"),
        F.length(c).cast("bigint").alias("len"),
        *keep,
    )


def most_frequent_tag(tokens: DataFrame) -> DataFrame:
    """(word, tag): each word's most frequent tag; ties go to the lesser tag. Counts are added before the choice, so a frequent word is no big group."""
    counts = tokens.groupBy("word", "tag").agg(F.count("*").alias("n"))
    return counts.groupBy("word").agg(F.min_by("tag", F.struct(-F.col("n"), F.col("tag"))).alias("tag"))


def memory_tagged(train: DataFrame, test: DataFrame) -> DataFrame:
    """test with the tag predicted for each word; O for words not seen in train."""
    return test.join(most_frequent_tag(train).withColumnRenamed("tag", "predicted"), "word", "left").withColumn("predicted", F.coalesce("predicted", F.lit("O")))


def fold_of(key: str, folds: int) -> Column:
    """The fold of a row, by a whole number that rows kept together share; null keys are in the first."""
    return F.coalesce(F.pmod(F.col(key), F.lit(folds)), F.lit(0)).cast("int")


def fold_memories(tokens: DataFrame, key: str, folds: int) -> DataFrame:
    """(word, tags): for each fold, in order, the word's most frequent tag in all other folds, null where it isn't in them; ties go to the lesser tag."""
    counts = tokens.groupBy("word", "tag").agg(F.array(*(F.count_if(fold_of(key, folds) != k) for k in range(folds))).alias("n"))
    best = lambda k: F.min_by("tag", F.when(F.col("n")[k] > 0, F.struct(-F.col("n")[k], F.col("tag"))))
    return counts.groupBy("word").agg(F.array(*(best(k) for k in range(folds))).alias("tags"))


def fold_tagged(tokens: DataFrame, key: str, folds: int) -> DataFrame:
    """Every token with the tag predicted for it from all folds but its own; O for words not seen there."""
    own = F.col("tags")[fold_of(key, folds)]
    return tokens.join(fold_memories(tokens, key, folds), "word", "left").withColumn("predicted", F.coalesce(own, F.lit("O"))).drop("tags")


def label_scores(p: DataFrame) -> DataFrame:
    """(label, tp, fp, fn, precision, recall, f1, support) of each label but O; tag is right, predicted is given."""
    pairs = p.groupBy("tag", "predicted").agg(F.count("*").alias("n"))
    side = pairs.select(F.explode(F.array(F.struct(F.col("tag").alias("label"), F.lit(1).alias("gold"), F.lit(0).alias("pred")), F.struct(F.col("predicted").alias("label"), F.lit(0).alias("gold"), F.lit(1).alias("pred")))).alias("x"), "tag", "predicted", "n")
    hit = F.col("tag") == F.col("predicted")
    c = side.groupBy(F.col("x.label").alias("label")).agg(
        F.sum(F.when(hit & (F.col("x.gold") == 1), F.col("n")).otherwise(0)).alias("tp"),
        F.sum(F.when(~hit & (F.col("x.pred") == 1), F.col("n")).otherwise(0)).alias("fp"),
        F.sum(F.when(~hit & (F.col("x.gold") == 1), F.col("n")).otherwise(0)).alias("fn"),
    )
    zero = lambda a, b: F.when(b == 0, F.lit(0.0)).otherwise(a / F.nullif(b, F.lit(0)))
    c = c.withColumn("p", zero(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("r", zero(F.col("tp"), F.col("tp") + F.col("fn")))
    f1 = F.when(F.col("p") + F.col("r") == 0, F.lit(0.0)).otherwise(2 * F.col("p") * F.col("r") / F.nullif(F.col("p") + F.col("r"), F.lit(0.0)))
    return c.where("label <> 'O'").select("label", "tp", "fp", "fn", F.round("p", 6).alias("precision"), F.round("r", 6).alias("recall"), F.round(f1, 6).alias("f1"), (F.col("tp") + F.col("fn")).alias("support"))


def rare_words(tokens: DataFrame, least: int, mark: str = "__RARE_WORD__") -> DataFrame:
    """Words seen less often than least are replaced."""
    rare = tokens.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") < least).select("word", F.lit(True).alias("_rare"))
    return tokens.join(rare, "word", "left").withColumn("word", F.when(F.col("_rare"), mark).otherwise(F.col("word"))).drop("_rare")


def encoder(labels: DataFrame, col: str) -> DataFrame:
    """(col, code): codes of distinct values in their order, from 0. The values are a vocabulary, ranked in ranges and not in one task."""
    d = labels.select(col).where(F.col(col).isNotNull()).distinct()
    return numbered(d.withColumn("_g", F.coalesce(F.ascii(col), F.lit(0))), "_g", [col], "code").drop("_g")


def padded(codes: Column, length: int, pad: int = 0) -> Column:
    """Cut or filled up at the end to a fixed length."""
    return F.slice(F.concat(codes, F.array_repeat(F.lit(pad), length)), 1, length)


def shortened(codes: Column, lengths: Column) -> Column:
    """The first so many codes of each list: undoes padding."""
    return F.slice(codes, 1, lengths)


def whole_batches(df: DataFrame, order: list[str], batch: int) -> DataFrame:
    """As many rows from the first on as fill whole batches; order is unique."""
    n = df.count()
    return df if n % batch == 0 else df.orderBy(*order).limit(n - n % batch)


def split_by_hash(df: DataFrame, key: str, test: float, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Train and test rows; rows of one key stay together, whatever the order or partitioning."""
    h = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(10_000))
    return df.where(h >= int(10_000 * test)), df.where(h < int(10_000 * test))


def token_accuracy(p: DataFrame) -> DataFrame:
    """One row: share of right tags, and micro precision, recall and F1 over all labels but O."""
    hit, gold, pred = F.col("tag") == F.col("predicted"), F.col("tag") != "O", F.col("predicted") != "O"
    c = p.agg(F.avg(hit.cast("int")).alias("accuracy"), F.count_if(hit & gold).alias("tp"), F.count_if(gold).alias("gold"), F.count_if(pred).alias("pred"))
    zero = lambda a, b: F.when(b == 0, F.lit(0.0)).otherwise(a / F.nullif(b, F.lit(0)))
    return c.select(
        F.round("accuracy", 6).alias("accuracy"), F.round(zero(F.col("tp"), F.col("pred")), 6).alias("precision"), F.round(zero(F.col("tp"), F.col("gold")), 6).alias("recall"),
        F.round(zero(2 * F.col("tp"), F.col("gold") + F.col("pred")), 6).alias("f1"),
    )
