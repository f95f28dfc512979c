"""Learning jobs with the operators' settings, and what SQL can know of their results.

A model's numbers are its own; but who is in which fold or part, how many rows come out, that
scores are probabilities and that reported metrics are those of the stored predictions, is not.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from talkmill.checks.bindings import lit
from talkmill.checks.facts import facts, sql_facts
from talkmill.checks.registry import register
from talkmill.operators import epochs as EP, learning as LE, metrics
from talkmill.operators.sampling import stratified_split
from talkmill.plans.jobs import staged
from talkmill.session import run_dir

_CLF = LE.TextClassifier(text="text", label="lang")
_LANGS = ["de", "en", "es", "fr"]


def _labelled(t) -> DataFrame:
    return t.documents.select("doc_id", "text", "lang", (F.col("n_chars") % 50).alias("comment_like_count"))


def _seeds(t) -> DataFrame:
    return _labelled(t).join(t.labels.select("doc_id").distinct(), "doc_id", "left_semi")


def _kept(df: DataFrame, name: str) -> DataFrame:
    """Predictions are made once and then read."""
    return staged(df, run_dir(df.sparkSession, "learning"), name)


def _all(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _checks(df: DataFrame, report: str, **tests: Column) -> DataFrame:
    """One row of conditions over a whole table."""
    return facts(df.agg(*[F.coalesce(test, F.lit(True)).alias(name) for name, test in tests.items()]), report)


def _true(report: str, *names: str) -> str:
    return sql_facts(report, "(SELECT 1)", "''", {n: "true" for n in names})


def _same(a: Column, b: Column) -> Column:
    return F.abs(a - b) < 1e-9


def _accuracy(predictions: DataFrame) -> float:
    return predictions.agg(F.avg((F.col("predicted") == F.col("lang")).cast("double"))).first()[0]


_SEEDS = "(SELECT * FROM documents WHERE doc_id IN (SELECT doc_id FROM labels))"
_PER_LANG = "(SELECT lang, count(*) AS n FROM {0} GROUP BY 1)"


# L1: the label wins over always saying the most frequent one.
def _train(t):
    done = _kept(_CLF.predict(_CLF.train(_seeds(t)), _labelled(t)).select("doc_id", "lang", "predicted"), "predicted")
    hit = (F.col("predicted") == F.col("lang")).cast("double")
    most = done.groupBy("lang").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    return _all(facts(done.groupBy("lang").agg(F.count("predicted").alias("n")), "predicted", ["lang"]),
                _checks(done, "checks", labels_known=F.bool_and(F.col("predicted").isin(_LANGS)), better_than_most_frequent=F.sum(hit) > most))


register("train_text_classifier", _train, f"{sql_facts('predicted', _PER_LANG.format('documents'), 'lang', {'n': 'n'})} UNION ALL {_true('checks', 'labels_known', 'better_than_most_frequent')}")


# L2: every document has a probability per label; the label shown is the likeliest.
def _scores(t):
    done = _kept(_CLF.predict_with_scores(_CLF.train(_seeds(t)), _labelled(t)).select("doc_id", "predicted", "confidence", "scores"), "scored")
    values = F.map_values("scores")
    total = F.aggregate(values, F.lit(0.0), lambda a, v: a + v)
    return done.select("doc_id", F.size("scores").alias("classes"), _same(total, F.lit(1.0)).alias("sums_to_one"), (F.col("scores")[F.col("predicted")] == F.col("confidence")).alias("confidence_is_its_score"),
                       (F.array_max(values) == F.col("confidence")).alias("predicted_is_likeliest"))


register("predict_with_scores", _scores, "SELECT doc_id, (SELECT count(DISTINCT lang) FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)) AS classes, true AS sums_to_one, true AS confidence_is_its_score, true AS predicted_is_likeliest FROM documents")


# L3: folds, and fold accuracies of the stored predictions.
def _folds(t):
    done = _kept(LE.cross_validate(_CLF, _seeds(t), "doc_id").select("doc_id", "lang", "fold", "predicted"), "folds")
    own = done.groupBy("fold").agg(F.avg((F.col("predicted") == F.col("lang")).cast("double")).alias("a")).agg(F.avg("a").alias("mean"), F.min("a").alias("low"), F.max("a").alias("high")).first()
    summary = LE.cross_validation_summary(done, "lang")
    mean = next(c for c in summary.columns if "mean" in c or "avg" in c)
    return _all(facts(done.select("doc_id", "lang", "fold"), "fold", ["doc_id"]),
                _checks(summary, "checks", mean_of_folds=F.bool_and(F.abs(F.col(mean) - own["mean"]) < 0.01) if own["mean"] is not None else F.lit(True)),
                _checks(done, "predictions", labels_known=F.bool_and(F.col("predicted").isin(_LANGS))))


_FOLDS = f"(SELECT doc_id, lang, (row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || doc_id), doc_id) - 1) % 5 AS fold FROM {_SEEDS})"
register("cross_validate", _folds, " UNION ALL ".join([
    sql_facts("fold", _FOLDS, "CAST(doc_id AS VARCHAR)", {"lang": "lang", "fold": "fold"}), _true("checks", "mean_of_folds"), _true("predictions", "labels_known")]))


def split_sql(source: str, share: str, name: str) -> str:
    """A stratified split as CTEs: sizes, allotted rows, and ``name`` with is_test."""
    return f"""{name}_s AS (SELECT lang, count(*) AS size, sum(count(*)) OVER () AS total FROM {source} GROUP BY 1), {name}_w AS (SELECT *, ceil(total * {share}::DOUBLE) AS wanted FROM {name}_s),
  {name}_f AS (SELECT *, floor(size * wanted / total::DOUBLE) AS whole, size * wanted / total::DOUBLE - floor(size * wanted / total::DOUBLE) AS part FROM {name}_w),
  {name}_a AS (SELECT lang, whole + CASE WHEN row_number() OVER (ORDER BY part DESC, lang) <= wanted - sum(whole) OVER () THEN 1 ELSE 0 END AS take FROM {name}_f),
  {name} AS (SELECT d.*, row_number() OVER (PARTITION BY d.lang ORDER BY md5('42:' || d.doc_id), d.doc_id) <= a.take AS is_test FROM {source} d JOIN {name}_a a USING (lang))"""


# L4: the held-out part, and the report against the metrics of its stored predictions.
def _holdout(t):
    split = stratified_split(_labelled(t), "lang", "doc_id")
    report = LE.evaluate_holdout(_CLF, _labelled(t), "doc_id", _LANGS)
    test = _kept(_CLF.predict(_CLF.train(split.where("NOT is_test")), split.where("is_test")).select("doc_id", "lang", "predicted"), "held_out")
    own = metrics.overall_metrics(test, "lang", "predicted", _LANGS).first()
    return _all(facts(test.select("doc_id", "lang"), "held_out", ["doc_id"]), _checks(report, "checks", **{c: F.bool_and(F.abs(F.col(c) - own[c]) < 0.02) for c in report.columns}))


register("evaluate_holdout", _holdout, f"WITH {split_sql('documents', '0.15', 'split')} {sql_facts('held_out', '(SELECT * FROM split WHERE is_test)', 'CAST(doc_id AS VARCHAR)', {'lang': 'lang'})} UNION ALL "
         + _true("checks", "accuracy", "macro_precision", "macro_recall", "macro_f1"))


# L7: the weights themselves, and a report within its bounds.
def _weighted(t):
    weighted = LE.like_weighted(_seeds(t))
    report = metrics.overall_metrics(_CLF.predict(_CLF.train(weighted, "sample", "sample_weight"), _labelled(t)), "lang", "predicted", _LANGS)
    return _all(facts(weighted.select("doc_id", F.round("sample_weight", 6).alias("weight")), "weight", ["doc_id"]), _checks(report, "checks", **{c: F.bool_and(F.col(c).between(0.0, 1.0)) for c in report.columns}))


register("like_weighted_training", _weighted, sql_facts("weight", f"(SELECT doc_id, least(1 + log2(1 + n_chars % 50), 10) AS w FROM {_SEEDS})", "CAST(doc_id AS VARCHAR)", {"weight": "w"}, ("weight",))
         + " UNION ALL " + _true("checks", "accuracy", "macro_precision", "macro_recall", "macro_f1"))


# L5: seeds stay, and only confident rows of the pool come in.
def _pseudo(t):
    _, merged = LE.pseudo_label_and_retrain(_CLF, _seeds(t), _labelled(t), "doc_id")
    merged = _kept(merged, "merged")
    seeds = merged.where("source = 'seed'").groupBy("lang").agg(F.count("*").alias("n"), F.min("confidence").alias("confidence"))
    pool = LE.unlabeled(_labelled(t), t.labels, "doc_id").select("text").distinct().withColumn("of_pool", F.lit(True))
    added = merged.where("source = 'pseudolabel'")
    joined = added.join(pool, added["text"].eqNullSafe(pool["text"]), "left")
    limit = _labelled(t).join(t.labels.select("doc_id").distinct(), "doc_id", "left_anti").count()
    return _all(facts(seeds, "seed", ["lang"]), _checks(joined, "added", confident=F.bool_and(F.col("confidence") >= 0.9), labels_known=F.bool_and(F.col("lang").isin(_LANGS)),
                                                       from_the_pool=F.bool_and(F.coalesce("of_pool", F.lit(False))), at_most_the_pool=F.count("*") <= limit))


register("pseudo_label", _pseudo, sql_facts("seed", f"(SELECT lang, count(*) AS n, 1.0 AS confidence FROM {_SEEDS} GROUP BY 1)", "lang", {"n": "n", "confidence": "confidence"}, ("confidence",))
         + " UNION ALL " + _true("added", "confident", "labels_known", "from_the_pool", "at_most_the_pool"))


# L6: rounds move rows from the pool to the training set, each once, within the cap of each round.
def _self_train(t):
    _, rows, log = LE.self_train(_CLF, _seeds(t), LE.unlabeled(_labelled(t), t.labels, "doc_id"), "doc_id")
    rows = _kept(rows, "self_trained").join(t.labels.select("doc_id").distinct().withColumn("seed", F.lit(True)), "doc_id", "left").withColumn("seed", F.coalesce("seed", F.lit(False)))
    added = rows.where("NOT seed").groupBy("lang").agg(F.count("*").alias("n"))
    moved = sum(e["new"] for e in log)
    return _all(facts(rows.where("seed").select("doc_id", "lang"), "seed", ["doc_id"]), _checks(added, "added", within_the_cap=F.bool_and(F.col("n") <= 150 * len(log)), as_logged=F.coalesce(F.sum("n"), F.lit(0)) == moved),
                _checks(rows, "rows", once=F.count("*") == F.count_distinct("doc_id"), rounds=F.lit(1 <= len(log) <= 3)))


register("self_train", _self_train, sql_facts("seed", _SEEDS, "CAST(doc_id AS VARCHAR)", {"lang": "lang"}) + " UNION ALL " + _true("added", "within_the_cap", "as_logged") + " UNION ALL " + _true("rows", "once", "rounds"))


# Training that keeps its best epoch: the three parts, the log, and the kept model on rows never seen.
def _best_epoch(t):
    parts = _kept(EP.three_way_split(_labelled(t), "lang", "doc_id"), "parts")
    model = EP.EpochClassifier("text", "lang").train(parts)
    logged = [e["validation_accuracy"] for e in model.log]
    test = _kept(model.predict(parts.where("part = 'test'")).select("doc_id", "lang", "predicted", "confidence"), "tested")
    again = _accuracy(model.predict(parts.where("part = 'validation'")))
    most = test.groupBy("lang").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    hits = F.sum((F.col("predicted") == F.col("lang")).cast("long"))
    return _all(facts(parts.select("doc_id", "lang", "part"), "part", ["doc_id"]),
                _checks(test, "checks", best_is_argmax=F.lit(model.best_epoch == 1 + logged.index(max(logged))), kept_weights_give_it_again=F.lit(abs(again - max(logged)) < 1e-9),
                        at_least_most_frequent=hits >= most, confident=F.bool_and(F.col("confidence").between(0.0, 1.0)), rows=F.count("*") > 0))


register("train_best_epoch", _best_epoch, f"""WITH {split_sql('documents', '0.15', 'held')}, rest AS (SELECT * EXCLUDE (is_test) FROM held WHERE NOT is_test), {split_sql('rest', '0.15', 'val')},
  parts AS (SELECT doc_id, lang, 'test' AS part FROM held WHERE is_test UNION ALL SELECT doc_id, lang, CASE WHEN is_test THEN 'validation' ELSE 'train' END FROM val)
  {sql_facts('part', 'parts', 'CAST(doc_id AS VARCHAR)', {'lang': 'lang', 'part': 'part'})} UNION ALL """ + _true("checks", "best_is_argmax", "kept_weights_give_it_again", "at_least_most_frequent", "confident", "rows"))
