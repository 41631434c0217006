"""The churn model, trained on naive and on engineered features."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import durable, ordered, running_sum
from .distortion import engineered_features, naive_features
from .warehouse import Warehouse

NAIVE = ["total_rounds_naive", "total_stake_naive", "total_deposits_naive", "tenure_days"]
ENGINEERED = ["total_sessions", "total_stake_engineered", "total_deposits_gbp", "tenure_days"]


def stratified_split(df: DataFrame, label: str, key: str, test_share: float = 0.25, width: float = 2.0**50):
    """Mark the same share of every class as test rows, in hash order of ``key``. Exact and repeatable.

    The classes are two huge groups, so positions come from ``ordered``, which cuts a class into slices.
    """
    hashed = df.withColumn("_hash", F.xxhash64(F.col(key)))
    rows = ordered(hashed, [label], ["_hash", key], width).add(_nth=running_sum(F.lit(1))).result()
    sizes = df.groupBy(label).agg(F.ceil(F.count("*") * F.lit(test_share)).alias("_tests"))
    return (
        rows.join(F.broadcast(sizes), label)  # one row per class
        .withColumn("is_test", F.col("_nth") <= F.col("_tests"))
        .drop("_hash", "_nth", "_tests")
    )


def score_metrics(scored: DataFrame, label: str = "label", score: str = "score", width: float = 1e-4):
    """Ranking and threshold metrics of a scored frame, computed from one curve over its distinct scores.

    Average precision is the step sum over thresholds, AUC counts tied pairs half, and the 0.5 metrics are zero
    when nothing is predicted or nothing is positive.
    """
    hit = F.col(label).cast("int")
    curve = scored.groupBy((-F.col(score)).alias("_down")).agg(
        F.sum(hit).alias("pos"), F.sum(1 - hit).alias("neg")
    )
    above = ordered(curve.withColumn("_all", F.lit(0)), ["_all"], ["_down"], width).add(
        cum_pos=running_sum(F.col("pos")), cum_neg=running_sum(F.col("neg"))
    ).result()
    chosen = F.col("_down") <= -0.5
    pos, neg = F.col("positives"), F.col("negatives")
    return above.agg(
        F.sum("pos").alias("positives"),
        F.sum("neg").alias("negatives"),
        F.sum(F.col("pos") * F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))).alias("_ap"),
        F.sum(F.col("pos") * (F.col("cum_neg") - F.col("neg") / 2)).alias("_beaten"),
        F.coalesce(F.sum(F.when(chosen, F.col("pos"))), F.lit(0)).alias("_tp"),
        F.coalesce(F.sum(F.when(chosen, F.col("neg"))), F.lit(0)).alias("_fp"),
    ).select(
        (pos + neg).alias("n_test"),
        (1 - F.try_divide(F.col("_beaten"), pos * neg)).alias("auc"),
        F.try_divide(F.col("_ap"), pos).alias("average_precision"),
        F.coalesce(F.try_divide(F.col("_tp"), F.col("_tp") + F.col("_fp")), F.lit(0.0)).alias("precision"),
        F.coalesce(F.try_divide(F.col("_tp"), pos), F.lit(0.0)).alias("recall"),
    )


def fit_and_score(df: DataFrame, features: list[str], label: str, key: str) -> DataFrame:
    """One row of metrics for a balanced logistic regression on standardised features.

    The objective is that of the usual L2 model with C = 1: balanced weights sum to n, so the penalty is 1 / n.
    """
    columns = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in features]
    data = df.select(key, F.col(label).cast("int").alias("label"), *columns)
    split = durable(stratified_split(data, "label", key))  # read by the fit's iterations, the scaler and the scoring
    train, test = split.filter("not is_test"), split.filter("is_test")

    stats = train.agg(
        F.count("*").alias("n"),
        F.sum("label").alias("positives"),
        *[F.avg(c).alias(f"mean_{c}") for c in features],
        *[F.stddev_pop(c).alias(f"sd_{c}") for c in features],
    ).first()
    n, positives = stats["n"], stats["positives"]
    rate = data.agg(F.avg("label").alias("positive_rate")).scalar()
    trained_on = F.lit(n).cast("bigint").alias("n_train")
    if not positives or positives == n:  # one class only: there is no model to score
        nothing = [F.lit(None).cast("double").alias(m) for m in ("auc", "average_precision", "precision", "recall")]
        return test.agg(F.count("*").alias("n_test")).select(trained_on, "n_test", rate.alias("positive_rate"), *nothing)
    scaled = [((F.col(c) - F.lit(stats[f"mean_{c}"])) / F.lit(stats[f"sd_{c}"] or 1.0)).alias(c) for c in features]
    weight = F.when(F.col("label") == 1, n / (2.0 * positives)).otherwise(n / (2.0 * (n - positives)))
    assembler = VectorAssembler(inputCols=features, outputCol="features")
    ready = lambda d: assembler.transform(d.select("label", weight.alias("weight"), *scaled))

    model = LogisticRegression(
        maxIter=1000, regParam=1.0 / n, standardization=False, weightCol="weight", tol=1e-8
    ).fit(ready(train))
    scored = model.transform(ready(test)).select("label", vector_to_array("probability")[1].alias("score"))
    return score_metrics(scored).select(
        trained_on, "n_test", rate.alias("positive_rate"), "auc", "average_precision", "precision", "recall"
    )


def compare_models(w: Warehouse) -> DataFrame:
    """The same model on naive and on engineered data, a row each."""
    naive = fit_and_score(naive_features(w), NAIVE, "is_churned_naive", "player_id")
    kept = engineered_features(w).filter(~F.coalesce("is_self_excluded_as_of", F.lit(False)))
    engineered = fit_and_score(kept, ENGINEERED, "is_churned", "player_id")
    return naive.select(F.lit("naive").alias("dataset"), "*").unionByName(
        engineered.select(F.lit("engineered").alias("dataset"), "*")
    )
