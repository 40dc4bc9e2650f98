"""Which of two answers is better: a linear classifier on the TF-IDF features of both.

Words are hashed to ``FEATURES`` columns, so a vocabulary is never gathered; document frequencies are
counted over the first answers of the training rows, as both sides must weigh words alike.  Features of
the first and the second answer stand side by side, each of length 1.  Training minimises the hinge
loss with gradients added up over Spark's partitions; the driver holds the weights.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LinearSVC
from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer, StopWordsRemover, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FEATURES, ROUNDS, PENALTY, HELD_OUT, SEED = 1 << 14, 20, 0.01, 20, 42


def held_out(key: Column, percent: int = HELD_OUT, seed: int = SEED) -> Column:
    """Whether a row is kept for testing: by its key alone, so that reruns and other partitions agree."""
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(100)) < percent


def _counted(side: str, features: int) -> list:
    words = [RegexTokenizer(inputCol=side, outputCol=f"{side}_all", pattern=r"[^\p{L}\p{N}]+"), StopWordsRemover(inputCol=f"{side}_all", outputCol=f"{side}_words")]
    return [*words, HashingTF(inputCol=f"{side}_words", outputCol=f"{side}_counts", numFeatures=features)]


class _Sides:
    """Stages for both sides with the document frequencies of the first."""

    def __init__(self, features: int) -> None:
        self.counted = [*_counted("first", features), *_counted("second", features)]

    def fit(self, rows: DataFrame) -> list:
        counted = PipelineModel(self.counted).transform(rows)
        idf = IDF(inputCol="first_counts", outputCol="first_raw").fit(counted)
        other = idf.copy({idf.inputCol: "second_counts", idf.outputCol: "second_raw"})
        normal = [Normalizer(inputCol=f"{s}_raw", outputCol=f"{s}_features") for s in ("first", "second")]
        return [*self.counted, idf, other, *normal, VectorAssembler(inputCols=["first_features", "second_features"], outputCol="features")]


def _texts(pairs: DataFrame) -> DataFrame:
    q = F.coalesce("question", F.lit(""))
    return pairs.withColumns({s: F.concat(q, F.lit(" "), F.coalesce(c, F.lit(""))) for s, c in (("first", "answer_1"), ("second", "answer_2"))})


def train(pairs: DataFrame, features: int = FEATURES, rounds: int = ROUNDS, penalty: float = PENALTY) -> PipelineModel:
    """A model of ``pairs`` (question, answer_1, answer_2, label: 1 if the first answer is better)."""
    rows = _texts(pairs.where("label is not null")).withColumn("label", F.col("label").cast("double"))
    stages = _Sides(features).fit(rows)
    made = PipelineModel(stages).transform(rows).select("features", "label")
    svm = LinearSVC(maxIter=rounds, regParam=penalty, standardization=False)
    return PipelineModel([*stages, Pipeline(stages=[svm]).fit(made).stages[0]])


def compare(pairs: DataFrame, model: PipelineModel) -> DataFrame:
    """``pairs`` with margin and better (1 or 2); a margin of 0 or below is for the second."""
    from pyspark.ml.functions import vector_to_array

    scored = model.transform(_texts(pairs))
    margin = vector_to_array("rawPrediction")[1].alias("margin")
    return scored.select(*pairs.columns, margin, F.when(F.col("prediction") == 1, 1).otherwise(2).alias("better"))


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)
