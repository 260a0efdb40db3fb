"""Backbones: window scorers trained with Spark ML, by name, with class weights and distillation of judged labels.

Each backbone is a set of features of a window's tokens, hashed into ``cells`` counts, and a classifier. The neural
originals need a deep-learning runtime; here the sequence models are logistic regressions over n-grams that keep the
order, ``neurallog`` is a perceptron.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Model
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sequences import class_weights


def _grams(tokens: Column, n: int) -> Column:
    text = tokens.cast("array<string>")
    if n == 1:
        return text
    every = F.transform(F.sequence(F.lit(1), F.greatest(F.size(text) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(text, i, n), ">"))
    return F.when(F.size(text) >= n, every).otherwise(F.array().cast("array<string>"))


def _placed(tokens: Column) -> Column:
    return F.transform(tokens.cast("array<string>"), lambda t, i: F.concat(i.cast("string"), F.lit("@"), t))


#: Names of each backbone to the pieces of a window that it counts.
FEATURES: dict[str, Callable[[Column], Column]] = {
    "neurallog": lambda t: F.concat(_grams(t, 1), _placed(t)),
    "deeplog": lambda t: F.concat(_grams(t, 2), _grams(t, 3)),
    "loganomaly": lambda t: F.concat(_grams(t, 1), _grams(t, 2)),
    "logbert": lambda t: F.concat(_grams(t, 1), _grams(t, 2), _placed(t)),
    "logrobust": lambda t: _grams(t, 1),
}


def features(w: DataFrame, name: str, cells: int = 256, tokens: str = "tokens") -> DataFrame:
    """``w`` with a vector ``features``: counts of the backbone's pieces in ``cells`` hash cells, without a shuffle."""
    if name.lower() not in FEATURES:
        raise ValueError(f"unknown backbone {name}; known: {sorted(FEATURES)}")
    pieces = w.withColumn("_pieces", FEATURES[name.lower()](F.col(tokens)))
    return HashingTF(numFeatures=cells, inputCol="_pieces", outputCol="features").transform(pieces).drop("_pieces")


def with_teacher(w: DataFrame, judged: DataFrame) -> DataFrame:
    """Windows with the judged label of their session (``judged``: session_id, is_high_risk), 0 if there is none."""
    return w.join(judged.select("session_id", F.col("is_high_risk").alias("teacher")), "session_id", "left").withColumn("teacher", F.coalesce("teacher", F.lit(0)))


def weighted(w: DataFrame, teach: float = 0.0) -> DataFrame:
    """Rows (target, weight): each window by its label with the weight of its class; with ``teach`` in (0, 1], that loss
    counts 1 - teach, and the same window by its teacher label counts teach."""
    per = {r["label"]: r["weight"] for r in class_weights(w).collect()}  # two classes
    of = F.coalesce(*[F.when(F.col("label") == k, F.lit(float(v))) for k, v in per.items()], F.lit(1.0)) if per else F.lit(1.0)
    own = w.withColumn("target", F.col("label").cast("double")).withColumn("weight", of * (1.0 - teach))
    if not teach:
        return own
    return own.unionByName(w.withColumn("target", F.col("teacher").cast("double")).withColumn("weight", F.lit(float(teach))))


def train(w: DataFrame, name: str, teach: float = 0.0, epochs: int = 25, cells: int = 256, seed: int = 43) -> Model:
    """A classifier of windows (tokens, label; teacher, if ``teach``)."""
    rows = weighted(features(w, name, cells), teach)
    if name.lower() == "neurallog":
        # a perceptron takes no weights: rows are repeated in their proportion, up to eight times
        least = rows.agg(F.min(F.when(F.col("weight") > 0, F.col("weight")))).first()[0] or 1.0
        times = F.least(F.greatest(F.round(F.col("weight") / least), F.lit(1)), F.lit(8)).cast("int")
        rows = rows.where("weight > 0").withColumn("_t", F.explode(F.array_repeat(F.lit(1), times))).drop("_t")
        return MultilayerPerceptronClassifier(layers=[cells, 32, 2], labelCol="target", maxIter=epochs, seed=seed).fit(rows)
    return LogisticRegression(labelCol="target", weightCol="weight", maxIter=epochs, regParam=0.01).fit(rows)


def scored(w: DataFrame, model: Model, name: str, cells: int = 256) -> DataFrame:
    """session_id, win_idx, label, p1: the probability of the second class, the same for the same window."""
    out = model.transform(features(w, name, cells))
    return out.select("session_id", "win_idx", "label", vector_to_array("probability")[1].alias("p1"))
