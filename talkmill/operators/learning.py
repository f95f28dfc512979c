"""Distributed text classification and the labelling loops around it (Spark ML)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import SparkContext
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, IDF, RegexTokenizer, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from talkmill import schemas as S
from talkmill.functions.labels import like_weight
from talkmill.operators.conform import union_by_name
from talkmill.operators.metrics import cv_summary, fold_accuracy, overall_metrics
from talkmill.operators.sampling import accept_confident, class_weights, per_class_cap, stratified_kfold, stratified_split
from talkmill.session import checkpointing, written

_WEIGHT = "_weight"


def _without_summary(model: PipelineModel) -> PipelineModel:
    """The model without its training summary, which holds the session.

    A model travels to the executors as it is, and a session that has observed metrics can't.
    """
    java = model.stages[-1]._java_obj
    java.setSummary(SparkContext._active_spark_context._jvm.scala.Option.empty())
    return model


@dataclass
class TextClassifier:
    """Hashed TF-IDF and multinomial logistic regression."""

    text: str = S.CLEANED
    label: str = "aspect_label"
    features: int = 1 << 16
    iterations: int = 20
    regularization: float = 0.01

    def stages(self) -> Pipeline:
        return Pipeline(stages=[
            StringIndexer(inputCol=self.label, outputCol="_y", stringOrderType="alphabetAsc", handleInvalid="skip"),
            RegexTokenizer(inputCol=self.text, outputCol="_tokens", pattern=r"[\p{L}\p{N}_]{2,}", gaps=False),
            HashingTF(inputCol="_tokens", outputCol="_tf", numFeatures=self.features),
            IDF(inputCol="_tf", outputCol="_x"),
            LogisticRegression(
                featuresCol="_x", labelCol="_y", weightCol=_WEIGHT, maxIter=self.iterations,
                regParam=self.regularization, family="multinomial",
            ),
        ])

    def train(self, df: DataFrame, weighting: str = "class", sample_weight: str | None = None) -> PipelineModel:
        """Fit the model. ``weighting``: ``class`` (inverse frequency), ``sample`` (the column
        ``sample_weight`` replaces class weights), ``both`` (product) or ``none``."""
        text = F.coalesce(F.col(self.text), F.lit("")).alias(self.text)
        sample = F.col(sample_weight) if sample_weight and weighting in ("sample", "both") else F.lit(1.0)
        rows = df.select(text, F.col(self.label), sample.cast("double").alias("_s"))
        if weighting in ("class", "both"):
            per_class = class_weights(rows, self.label).select(self.label, F.col("weight").alias("_c"))
            # As many rows as the model has classes: without the hint all texts of a class are shuffled to one task.
            rows = rows.join(F.broadcast(per_class), self.label)
            weight = F.col("_s") * F.col("_c")
        else:
            weight = F.col("_s")
        return self._fitted(rows.select(self.text, self.label, weight.alias(_WEIGHT)))

    def _fitted(self, rows: DataFrame) -> PipelineModel:
        """The stages fitted; texts are cut and counted once, both fits that follow read the counts."""
        index, *count, idf, regression = self.stages().getStages()
        plain = PipelineModel([index.fit(rows), *count])
        counts = written(plain.transform(rows).select("_y", "_tf", _WEIGHT), "term-counts")
        weigh = idf.fit(counts)
        return _without_summary(PipelineModel([*plain.stages, weigh, regression.fit(weigh.transform(counts))]))

    def best_of(self, train: DataFrame, validation: DataFrame, candidates: list[float], **kwargs) -> PipelineModel:
        """The model with the best validation accuracy over regularisation strengths."""
        best, top = None, -1.0
        for strength in candidates:
            model = TextClassifier(self.text, self.label, self.features, self.iterations, strength).train(train, **kwargs)
            scored = self.predict(model, validation).agg(
                F.avg((F.col("predicted") == F.col(self.label)).cast("double"))
            ).first()[0]  # one number
            if scored is not None and scored > top:
                best, top = model, scored
        return best

    def _scored(self, model: PipelineModel, df: DataFrame) -> DataFrame:
        names = F.array(*[F.lit(name) for name in model.stages[0].labels])
        filled = df.withColumn(self.text, F.coalesce(F.col(self.text), F.lit("")))
        # The label indexer is skipped: rows to score need no label.
        scored = PipelineModel(model.stages[1:]).transform(filled)
        return scored.withColumns({"_names": names, "_p": vector_to_array("probability")})

    def predict(self, model: PipelineModel, df: DataFrame) -> DataFrame:
        """Adds ``predicted``."""
        scored = self._scored(model, df)
        return scored.select(*df.columns, F.element_at("_names", F.col("prediction").cast("int") + 1).alias("predicted"))

    def predict_with_scores(self, model: PipelineModel, df: DataFrame) -> DataFrame:
        """Adds ``predicted``, ``confidence`` and the map ``scores``."""
        scored = self._scored(model, df)
        return scored.select(
            *df.columns, F.element_at("_names", F.col("prediction").cast("int") + 1).alias("predicted"),
            F.array_max("_p").alias("confidence"), F.map_from_arrays("_names", "_p").alias("scores"),
        )

    def labels(self, model: PipelineModel) -> list[str]:
        return list(model.stages[0].labels)


def evaluate_holdout(clf: TextClassifier, df: DataFrame, key: str, labels: list[str], seed: int = 42, **kwargs) -> DataFrame:
    """Stratified split, train on one part, metrics on the other."""
    checkpointing(df.sparkSession)
    split = stratified_split(df, clf.label, key, seed=seed).checkpoint()
    model = clf.train(split.filter("NOT is_test"), **kwargs)
    return overall_metrics(clf.predict(model, split.filter("is_test")), clf.label, "predicted", labels)


def cross_validate(clf: TextClassifier, df: DataFrame, key: str, folds: int = 5, seed: int = 42, **kwargs) -> DataFrame:
    """Out-of-fold predictions of all rows (columns plus ``fold`` and ``predicted``)."""
    checkpointing(df.sparkSession)
    # Every fold reads the table twice: number the rows once.
    folded = stratified_kfold(df, clf.label, key, folds, seed).checkpoint()
    parts = []
    for i in range(folds):
        model = clf.train(folded.filter(F.col("fold") != i), **kwargs)
        parts.append(clf.predict(model, folded.filter(F.col("fold") == i)))
    return union_by_name(*parts)


def cross_validation_summary(predictions: DataFrame, label: str) -> DataFrame:
    return cv_summary(fold_accuracy(predictions, "fold", label, "predicted"))


def like_weighted(df: DataFrame, likes: str = "comment_like_count") -> DataFrame:
    """Adds ``sample_weight`` for like-weighted training."""
    return df.withColumn("sample_weight", like_weight(F.col(likes)))


def unlabeled(df: DataFrame, annotated: DataFrame, key: str) -> DataFrame:
    """Rows without an annotation; rows with a null id stay."""
    return df.join(annotated.select(key).distinct(), key, "left_anti")


def pseudo_label(clf: TextClassifier, model: PipelineModel, pool: DataFrame, key: str) -> DataFrame:
    """(key, text, pseudo_aspect, confidence, scores) of the unlabeled pool."""
    scored = clf.predict_with_scores(model, pool.select(key, clf.text))
    return scored.withColumnRenamed("predicted", "pseudo_aspect")


def high_confidence(pseudo: DataFrame, threshold: float = 0.90) -> DataFrame:
    return pseudo.filter(F.col("confidence") >= threshold)


def non_other_confident(pseudo: DataFrame, threshold: float = 0.95) -> DataFrame:
    return pseudo.filter((F.col("pseudo_aspect") != "Other") & (F.col("confidence") >= threshold))


def merged_training_set(clf: TextClassifier, seeds: DataFrame, pseudo: DataFrame) -> DataFrame:
    """Seeds (confidence 1) and accepted pseudo-labels in one training table."""
    a = seeds.select(clf.text, clf.label, F.lit("seed").alias("source"), F.lit(1.0).alias("confidence"))
    b = pseudo.select(clf.text, F.col("pseudo_aspect").alias(clf.label), F.lit("pseudolabel").alias("source"), "confidence")
    return union_by_name(a, b)


def pseudo_label_and_retrain(clf: TextClassifier, seeds: DataFrame, everything: DataFrame, key: str,
                             accept=high_confidence) -> tuple[PipelineModel, DataFrame]:
    """Score the unlabeled rows, add the accepted ones to the seeds, train again."""
    first = clf.train(seeds)
    pseudo = pseudo_label(clf, first, unlabeled(everything, seeds, key), key)
    merged = merged_training_set(clf, seeds, accept(pseudo))
    return clf.train(merged), merged


def self_train(clf: TextClassifier, seeds: DataFrame, pool: DataFrame, key: str, rounds: int = 3,
               cap: int = 150, evaluate=None) -> tuple[PipelineModel, DataFrame, list[dict]]:
    """Up to ``rounds`` times: train, accept confident pool rows (capped per class), move them.

    Each round ends in a checkpoint, so the lineage stays short and an executor loss does
    not replay earlier rounds. Returns the model, its training rows and a log.
    """
    checkpointing(pool.sparkSession)
    train = seeds.select(key, clf.text, clf.label)
    rest = pool.select(key, clf.text)
    log: list[dict] = []
    model = None
    for number in range(1, rounds + 1):
        model = clf.train(train)
        scored = pseudo_label(clf, model, rest, key).drop("scores")
        accepted = per_class_cap(accept_confident(scored), "pseudo_aspect", key, cap).checkpoint()
        new = accepted.count()  # one number
        log.append({"round": number, "new": new, **(evaluate(model) if evaluate else {})})
        if new == 0:
            break
        moved = accepted.select(key, clf.text, F.col("pseudo_aspect").alias(clf.label))
        train = train.unionByName(moved).checkpoint()
        rest = rest.join(accepted.select(key), key, "left_anti").checkpoint()
    return model, train, log
