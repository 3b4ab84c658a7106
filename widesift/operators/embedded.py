"""Selection by a fitted model: L1 coefficients or forest importances.

Both work on the scaled, non-constant features. L1 models of all cohorts and seeds are fitted in one batch; a forest takes the
vectors (sample_id, label, part, features) of one cohort and seed and the feature names in vector order, and is tuned by MLlib's
cross-validation over a fold column, so the folds are the stratified ones and not random rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, functions as F

from widesift.operators import batched, metrics
from widesift.operators.models import MacroF1, depth_or_limit, indexed, training_facts
from widesift.operators.splits import stratified_folds
from widesift.session import cut_lineage

# Inverse penalty strengths, forest grid and fold count of the tuned searches.
LASSO_STRENGTHS = (1e-4, 1e-2, 1.0, 1e2, 1e4)
LASSO_SWEEP = (0.1, 0.05, 0.01)
FOREST_TREES = (100, 200)
FOREST_DEPTHS = (10, 20, None)
FOLDS = 3


def _training(vectors: DataFrame, folds: int | None) -> tuple[DataFrame, list[str], int]:
    [(_, classes, n)] = training_facts(vectors, ["cohort", "seed"])
    rows = indexed(vectors.where(F.col("part") == "train"), classes)
    return (stratified_folds(rows, folds) if folds else rows), classes, n


def _path_fits(groups: DataFrame, held: Sequence[int], strengths: Sequence[float]) -> DataFrame:
    """A fit for each left-out fold of every cohort and seed, from the intercepts alone down a falling list of L1 strengths."""
    falling = [math.inf, *sorted((1.0 / c for c in strengths), reverse=True)]
    one = F.explode(F.array(*[F.struct(F.lit(i).cast("bigint").alias("fit"), F.lit(f).alias("held")) for i, f in enumerate(held)]))
    return groups.select(*batched.GROUP, one.alias("f")).select(
        *batched.GROUP, "f.fit", "f.held", F.array().cast("array<int>").alias("columns"), F.lit(0.0).alias("l2"), F.array(*map(F.lit, falling)).alias("strengths"))


def _paths(blocks: DataFrame, held: Sequence[int], strengths: Sequence[float], folder: str | None = None) -> DataFrame:
    """The models of every strength, as `batched.models` gives them; `c` is the strength's inverse."""
    counts = cut_lineage(batched.class_counts(blocks, held))
    fits = _path_fits(counts.select(*batched.GROUP).distinct(), held, strengths)
    states = batched.fitted(blocks, batched.starting(fits, counts), whole=True, folder=folder)
    inverse = F.element_at(F.create_map(*[x for c in strengths for x in (F.lit(1.0 / c), F.lit(float(c)))]), F.col("strength"))
    return cut_lineage(batched.models(states).withColumn("c", inverse))


def _largest_weights(models: DataFrame) -> DataFrame:
    """(KEYS, place, pos, score): the largest absolute weight of a column over the classes, for the columns a model was fitted on."""
    wide = F.size("columns") + 1
    of = lambda i: F.transform(F.sequence(F.lit(0), F.size("present") - 1), lambda k: F.abs(F.get("weights", k * wide + i + 1)))
    scores = F.transform("columns", lambda c, i: F.struct(c.alias("pos"), F.array_max(of(i)).alias("score")))
    return models.where(F.size("columns") > 0).select(*batched.KEYS, "place", F.inline(scores))


def lasso_scores(vectors: DataFrame, places: DataFrame, strengths: Sequence[float] = LASSO_STRENGTHS, folds: int = FOLDS) -> DataFrame:
    """(cohort, seed, feature, score): largest absolute coefficient over the classes, at the strength with the best accuracy.

    vectors: (cohort, seed, sample_id, label, part, features); places: (cohort, seed, feature, pos). All cohorts, seeds, folds and
    strengths are fitted in one batch, each from the strongest penalty down and from the weights before, with screened
    columns. Of equal mean accuracies the strongest penalty is taken. A feature is selected when its score is not 0.
    """
    train = vectors.where(F.col("part") == "train")
    dealt = stratified_folds(train.select("cohort", "seed", "sample_id", "label"), folds)
    blocks = batched.row_blocks(train.select("cohort", "seed", "sample_id", "features").join(dealt, ["cohort", "seed", "sample_id"]))
    models = _paths(blocks, [batched.EVERY, *range(folds)], strengths)
    guessed = batched.confusions(blocks, models.where(F.col("held") >= 0))
    right = F.sum(F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)) / F.sum("n")
    by_place = (guessed.groupBy(*batched.KEYS, "place").agg(right.alias("accuracy"))
                .groupBy(*batched.GROUP, "place").agg(F.avg("accuracy").alias("accuracy")))
    best = by_place.groupBy(*batched.GROUP).agg(F.min(F.struct((-F.round("accuracy", 9)).alias("less"), "place")).alias("b")).select(
        *batched.GROUP, F.col("b.place").alias("place"))
    chosen = models.where(F.col("held") == batched.EVERY).join(best, [*batched.GROUP, "place"])
    weights = _largest_weights(chosen).select(*batched.GROUP, "pos", "score")
    return places.select("cohort", "seed", "feature", "pos").join(weights, [*batched.GROUP, "pos"], "left").select(
        *batched.GROUP, "feature", F.coalesce("score", F.lit(0.0)).alias("score"))


def _sweep(vectors: DataFrame, strengths: Sequence[float]) -> tuple[DataFrame, DataFrame]:
    """Blocks whose fold 0 are the test rows, and the models of the training rows."""
    fold = F.when(F.col("part") == "test", 0).otherwise(1)
    blocks = batched.row_blocks(vectors.select("cohort", "seed", "sample_id", "label", "features", fold.alias("fold")))
    return blocks, _paths(blocks, [0], strengths)


def lasso_sweep(vectors: DataFrame, strengths: Sequence[float] = LASSO_SWEEP) -> DataFrame:
    """(cohort, seed, c, n_coefficients, n_features, accuracy, macro_f1) for each fixed strength, fitted on the training rows."""
    blocks, models = _sweep(vectors, strengths)
    guessed = batched.confusions(blocks, models).join(models.select(*batched.KEYS, "place", "c"), [*batched.KEYS, "place"])
    keys = [*batched.GROUP, "c"]
    per_class = metrics.class_metrics(guessed, keys)
    quality = per_class.groupBy(*keys).agg((F.sum("tp") / F.sum("support")).alias("accuracy"), F.avg("f1").alias("macro_f1"))
    wide = F.size("columns") + 1
    used = F.size(F.filter("weights", lambda w, i: (w != 0) & (i % wide != 0)))
    sizes = models.select(*keys, used.alias("n_coefficients"), "place", *[k for k in batched.KEYS if k not in keys])
    features = _largest_weights(models).where("score > 0").groupBy(*batched.KEYS, "place").agg(F.count(F.lit(1)).cast("int").alias("n_features"))
    counted = sizes.join(features, [*batched.KEYS, "place"], "left").select(*keys, "n_coefficients", F.coalesce("n_features", F.lit(0)).alias("n_features"))
    return quality.join(counted, keys).select(*keys, "n_coefficients", "n_features", "accuracy", "macro_f1")


def lasso_violations(vectors: DataFrame, strengths: Sequence[float] = LASSO_SWEEP) -> DataFrame:
    """(cohort, seed, c, converged, violation): how far each model is from the minimum, over all columns, as a part of its strength.

    At the minimum the gradient of the loss is minus the strength times the sign for a weight that is not 0, and no larger
    than the strength for one that is; a column that screening left out counts as any other.
    """
    blocks, models = _sweep(vectors, strengths)
    slopes = batched.gradients(blocks, models)
    return models.join(slopes, [*batched.KEYS, "place"]).select(*batched.GROUP, "c", "converged", (F.col("violation") / F.col("strength")).alias("violation"))


def forest_scores(vectors: DataFrame, features: Sequence[str], seed: int, trees: Sequence[int] = FOREST_TREES,
                  depths: Sequence[int | None] = FOREST_DEPTHS, folds: int = FOLDS, parallelism: int = 8) -> DataFrame:
    """(feature, score): importances of the forest with the best cross-validated macro F1.

    A feature is selected when its score is above the mean (`selection.above_mean`).
    """
    rows, _, _ = _training(vectors, folds)
    # written, not kept in memory: a cached table has as many partitions as shuffles are set to, however few its rows, and every
    # level of every forest is a job over them
    rows = cut_lineage(rows)
    forest = RandomForestClassifier(labelCol="_y", seed=seed)
    grid = (ParamGridBuilder().addGrid(forest.numTrees, list(trees))
            .addGrid(forest.maxDepth, [depth_or_limit(d) for d in depths]).build())
    search = CrossValidator(estimator=forest, estimatorParamMaps=grid, evaluator=MacroF1(), foldCol="fold",
                            numFolds=folds, parallelism=parallelism)
    best = search.fit(rows).bestModel
    importances = best.featureImportances.toArray()
    return vectors.sparkSession.createDataFrame([(f, float(s)) for f, s in zip(features, importances)],
                                                "feature string, score double")
