"""Models by name, fitted with Spark ML on embargoed folds."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapelab.sources.files import stored

FEATURES = ("ret_21", "drawdown")
REGISTRY = {
    "logistic": lambda: LogisticRegression(featuresCol="features", labelCol="label", weightCol="weight", maxIter=100),
    "forest": lambda: RandomForestClassifier(featuresCol="features", labelCol="label", weightCol="weight", numTrees=200, maxDepth=4, seed=7),
    "gbt": lambda: GBTClassifier(featuresCol="features", labelCol="label", weightCol="weight", maxIter=20, maxDepth=4, stepSize=0.1, seed=7),
}


def fit(train: DataFrame, kind: str, balanced: bool = True):
    """A model of rows with ``label``; None unless both labels are there. Balanced weights are n / (2 n_class)."""
    train = train.withColumn("label", F.col("label").cast("double"))
    counts = {r["label"]: r["count"] for r in train.groupBy("label").count().collect()}
    if len(counts) < 2:
        return None
    n = sum(counts.values())
    weight = F.when(F.col("label") == 1, n / (2 * counts[1.0])).otherwise(n / (2 * counts[0.0])) if balanced else F.lit(1.0)
    filled = [f"{c}_filled" for c in FEATURES]
    return Pipeline(stages=[Imputer(inputCols=list(FEATURES), outputCols=filled), VectorAssembler(inputCols=filled, outputCol="features"), REGISTRY[kind]()]).fit(train.withColumn("weight", weight))


def predict(model, rows: DataFrame, share: float = 0.0) -> DataFrame:
    """``rows`` with ``probability`` of label 1; ``share`` where there is no model."""
    if model is None:
        return rows.withColumn("probability", F.lit(share))
    return model.transform(rows).withColumn("__p", vector_to_array("probability")[1]).select(*rows.columns, F.col("__p").alias("probability"))


def before(scored: DataFrame, cut_year: int, gap_days: int = 100) -> tuple[DataFrame, DataFrame]:
    """Rows to learn from, the last ``gap_days`` before the cut left out, and rows from the cut on. They are stored first, as a fit goes through them many times."""
    cut = F.lit(f"{cut_year}-01-01").cast("date")
    scored = stored(scored, "scored")
    return scored.filter(F.col("date") < F.date_sub(cut, gap_days)), scored.filter(F.col("date") >= cut)


def fit_predict(scored: DataFrame, kind: str, cut_year: int = 1996, balanced: bool = True) -> DataFrame:
    """ticker, date, label, probability for rows from ``cut_year`` on, by a model of the rows before (its last 100 days left out).

    Without both classes the probability is the training share.
    """
    train, test = before(scored, cut_year)
    model = fit(train, kind, balanced)
    share = 0.0 if model is not None else float(train.agg(F.max("label")).first()[0] or 0)
    return predict(model, test, share).select("ticker", "date", "label", "probability")


def permutation_importance(scored: DataFrame, kind: str, cut_year: int = 1996, rows_per_bucket: int = 10_000) -> DataFrame:
    """feature, auc, auc_shuffled, drop: how much the AUC of the rows from ``cut_year`` on falls when a feature is shuffled among them.

    Rows are dealt into buckets by hash; within a bucket, the value of the k-th row by one hash goes to the k-th by another, so no
    task sorts the whole table. Without a model all AUCs are null or a half.
    """
    from tapelab.operators.stats import auc

    train, test = before(scored, cut_year)
    model = fit(train, kind)
    buckets = max(1, test.count() // rows_per_bucket)
    rows = test.withColumn("__b", F.pmod(F.xxhash64("ticker", "date"), F.lit(buckets)))
    k = lambda seed: F.row_number().over(Window.partitionBy("__b").orderBy(F.xxhash64(F.lit(seed), "ticker", "date"), "ticker", "date"))
    one = rows.withColumn("__k", k(1)).select("__b", "__k", "label", F.struct(*FEATURES).alias("own"))
    other = rows.withColumn("__k", k(2)).select("__b", "__k", F.struct(*FEATURES).alias("strange"))
    swapped = lambda f: F.struct(F.lit(f).alias("feature"), *(F.col(f"{'strange' if c == f else 'own'}.{c}").alias(c) for c in FEATURES))
    variants = F.explode(F.array(swapped(""), *map(swapped, FEATURES))).alias("x")
    each = one.join(other, ["__b", "__k"]).select("label", variants).select("label", "x.*")
    a = auc(predict(model, each), "probability", "label", ["feature"])
    base = a.filter("feature = ''").select(F.col("auc").alias("base"))
    return a.filter("feature <> ''").join(F.broadcast(base)).select("feature", F.col("base").alias("auc"), F.col("auc").alias("auc_shuffled"), (F.col("base") - F.col("auc")).alias("drop"))


def holdout_eval(scored: DataFrame, held_out: DataFrame, kind: str, cut_year: int = 1996, threshold: float = 0.5) -> DataFrame:
    """ticker, n, accuracy, picks, mean_ret of the tickers in ``held_out`` from ``cut_year`` on, by a model that learned from the others before."""
    held = held_out.select("ticker").distinct()
    train, test = before(scored, cut_year)
    model = fit(train.join(held, "ticker", "left_anti"), kind)
    t = predict(model, test.join(held, "ticker", "left_semi"))
    pick = F.col("probability") >= threshold
    return t.groupBy("ticker").agg(F.count(F.lit(1)).alias("n"), F.avg((pick == (F.col("label") == 1)).cast("int")).alias("accuracy"), F.count_if(pick).alias("picks"), F.avg(F.when(pick, F.col("fwd_ret"))).alias("mean_ret"))
