"""Tagging baselines on token features: a random forest, and a multinomial regression where Spark has no sequence model.

Both are cross predictions: for each fold of documents a model is fitted on tokens of the others and predicts
that fold, so every token gets a prediction. Memory tags among the features are those of the fitted folds.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import FeatureHasher
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lapidar.operators import tokens
from lapidar.runtime import Scratch

FOLDS = 5
FIT_ROWS = 200_000
"""About so many tokens at most, of whole lines, are fitted on for each fold; every token of the fold is predicted."""
MEMORY = ["memory", "memory_prev", "memory_next"]


def features(t: DataFrame, memories: DataFrame) -> DataFrame:
    """Features of tokens; memory, memory_prev and memory_next hold tags for each fold (tokens.fold_memories). Lines' ends and a full stop before count as O."""
    w = Window.partitionBy("doc_id", "line_no").orderBy("word_no")
    none = F.array_repeat(F.lit("O"), FOLDS)
    m = t.join(memories, "word", "left").withColumn("memory", F.coalesce(F.transform("tags", lambda x: F.coalesce(x, F.lit("O"))), none)).drop("tags")
    before = F.when(F.lag("word").over(w) != ".", F.lag("memory").over(w))
    m = m.withColumns({"memory_prev": F.coalesce(before, none), "memory_next": F.coalesce(F.lead("memory").over(w), none), "is_alpha": F.col("word").rlike(r"^\p{L}+$")})
    return tokens.context_features(m, ["doc_id", "line_no"], "word_no", keep=("tag", "is_alpha", *MEMORY))


def _cross_predicted(t: DataFrame, estimator, columns: list[str]) -> DataFrame:
    keep = Scratch(t.sparkSession).keep
    memories = keep(tokens.fold_memories(t, "doc_id", FOLDS), "memories")
    f = features(t, memories)
    names = [r.tag for r in t.select("tag").distinct().orderBy("tag").collect()]
    code = F.create_map(*(x for i, n in enumerate(names) for x in (F.lit(n), F.lit(float(i)))))
    # only conditions on documents and lines, which reach the scan
    share = FIT_ROWS / max(1, t.count() * (FOLDS - 1) / FOLDS)
    some = f if share >= 1 else f.where(F.pmod(F.xxhash64("doc_id", "line_no"), F.lit(1_000_000)) < int(1_000_000 * share))
    some = keep(some.withColumn("label", F.element_at(code, F.col("tag"))), "fitted")
    hasher = FeatureHasher(inputCols=columns, outputCol="features", numFeatures=1 << 10)
    fold = tokens.fold_of("doc_id", FOLDS)
    parts = []
    for k in range(FOLDS):
        seen = lambda d, k=k: hasher.transform(d.withColumns({m: F.col(m)[k] for m in MEMORY}))
        train = some.where(fold != k)
        # nothing to learn from: all documents are in this fold
        if train.isEmpty():
            parts.append(f.where(fold == k).select("doc_id", "line_no", "word_no", "tag", F.lit("O").alias("predicted"), F.lit(None).cast("double").alias("confidence")))
        else:
            parts.append(_predicted(estimator.fit(seen(train)), seen(f.where(fold == k)), names))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _predicted(model, test: DataFrame, names: list[str]) -> DataFrame:
    p = model.transform(test)
    best = F.array(*(F.lit(n) for n in names))[F.col("prediction").cast("int")]
    return p.select("doc_id", "line_no", "word_no", "tag", best.alias("predicted"), F.round(F.array_max(vector_to_array("probability")), 4).alias("confidence"))


def forest_predictions(t: DataFrame) -> DataFrame:
    columns = ["suffix2", "is_lower", "is_upper", "is_title", "is_digit", "is_alpha", "len", *MEMORY]
    return _cross_predicted(t, RandomForestClassifier(numTrees=20, maxDepth=5, seed=1), columns)


def regression_predictions(t: DataFrame) -> DataFrame:
    columns = ["lower", "suffix3", "prev_word", "next_word", "is_title", "is_digit"]
    return _cross_predicted(t, LogisticRegression(maxIter=20, regParam=0.01, elasticNetParam=0.2), columns)
