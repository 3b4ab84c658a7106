"""Classifiers on assembled vectors, trained with Spark MLlib.

A vectors table is (run keys..., sample_id, label, part, features). Training is the only step that
loops over runs on the driver: the list of runs is short, the rows stay on the executors, and several
fits are submitted side by side. A fit that fails becomes a run with an error, and the others go on.
"""

from __future__ import annotations

import math
import time
import uuid
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from widesift.operators import stochastic
from widesift.operators.metrics import RUN_KEYS
from widesift.operators.prepare import assemble, median_impute, standard_scale
from widesift.operators.selection import project_features
from widesift.session import broadcast_if_bounded, checkpoint_folder, cut_lineage

PREDICTION_SCHEMA = "sample_id string, label string, prediction string, proba map<string,double>"


@dataclass(frozen=True)
class Classifier:
    """How to build the estimator for n training rows."""

    build: Callable[[int], object]


def _logistic(max_iter: int, tol: float = 1e-6, c: float = 1.0) -> Callable[[int], LogisticRegression]:
    """L2 multinomial logistic regression; a penalty C on a sum of losses is 1 / (C n) on their mean."""
    return lambda n: LogisticRegression(labelCol="_y", family="multinomial", regParam=1.0 / (c * n),
                                        elasticNetParam=0.0, standardization=False, maxIter=max_iter, tol=tol)


CLASSIFIERS = {
    "logistic": Classifier(_logistic(1000)),
    "logistic_long": Classifier(_logistic(5000)),
    "logistic_short": Classifier(_logistic(500, tol=1e-4)),
}
#: classifiers that are trained for all runs in one batch: until the loss stands still, and for a fixed number of passes
STOCHASTIC = {
    "one_vs_rest": stochastic.Settings(passes=1000, tolerance=1e-3),
    "one_vs_rest_50": stochastic.Settings(passes=50, tolerance=None, softmax=True),
}


def build_vectors(matrix: DataFrame, split: DataFrame, feature_sets: DataFrame, moments: DataFrame,
                  fill: DataFrame | None = None, gaps: str = "error") -> DataFrame:
    """(RUN_KEYS, sample_id, label, part, features): each feature set projected, scaled and assembled.

    feature_sets: (cohort, seed, method, param, feature). Scaling is fitted on the training rows. With
    `fill` (cohort, seed, feature, fill) the gaps of the selected features are filled first; other gaps are
    an error or, with gaps="zero", zeros that take no space. Every sample of the split gets its vector.
    """
    sets = feature_sets.select(*RUN_KEYS, "feature")
    cells = matrix.select("cohort", "sample_id", "feature", "value")
    if fill is not None:
        used = fill.join(sets.select("cohort", "seed", "feature").distinct(), ["cohort", "seed", "feature"], "left_semi")
        cells = median_impute(cells, split, used).select("cohort", "seed", "sample_id", "feature", "value")
    cells = standard_scale(project_features(cells, sets), moments, centred=gaps != "zero")
    rows = split.select("cohort", "seed", "sample_id", "label", "part")
    runs = sets.select(*RUN_KEYS).distinct()
    wanted = rows.select("cohort", "seed", "sample_id").join(broadcast_if_bounded(runs), ["cohort", "seed"])
    vectors = assemble(cells, [*RUN_KEYS, "sample_id"], features=sets, rows=wanted, gaps=gaps)
    return vectors.join(broadcast_if_bounded(rows, rows_from=split), ["cohort", "seed", "sample_id"])


def stored(vectors: DataFrame) -> DataFrame:
    """The vectors as Parquet in the shared folder, a directory for each run, so that a fit reads its own run only."""
    spark = vectors.sparkSession
    folder = f"{checkpoint_folder(spark)}/vectors-{uuid.uuid4().hex}"
    # large runs are split over several files, small ones are not scattered
    vectors.hint("rebalance", *[F.col(k) for k in RUN_KEYS]).write.partitionBy(*RUN_KEYS).parquet(folder)
    return spark.read.schema(vectors.schema).parquet(folder)


def indexed(vectors: DataFrame, classes: list[str]) -> DataFrame:
    names = F.array(*[F.lit(c) for c in classes])
    return vectors.withColumn("_y", (F.array_position(names, F.col("label")) - 1).cast("double"))


def probabilities(classes: list[str]) -> Column:
    """Class -> probability from a model's output columns."""
    names = F.array(*[F.lit(c) for c in classes])
    return F.map_from_arrays(names, F.slice(vector_to_array("probability"), 1, len(classes)))


def name_of(index: Column, classes: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(c) for c in classes]), index.cast("int") + 1)


class MacroF1(Evaluator):
    """Unweighted mean F1 over the classes that occur as label or prediction."""

    def _evaluate(self, dataset: DataFrame) -> float:
        # classes x classes counts, whatever the number of rows
        counts = dataset.groupBy("_y", "prediction").count().collect()
        true, guessed, right = Counter(), Counter(), Counter()
        for y, p, n in counts:
            true[y] += n
            guessed[p] += n
            right[y] += n if y == p else 0
        classes = true.keys() | guessed.keys()
        return sum(2 * right[c] / (true[c] + guessed[c]) for c in classes) / len(classes)

    def isLargerBetter(self) -> bool:
        return True


@dataclass
class Fit:
    """One trained run: its predictions on the held-out rows, and what is recorded about it."""

    keys: dict
    predictions: DataFrame | None = None
    model: object = None
    train_time_s: float = 0.0
    run_time_s: float = 0.0
    status: str = "ok"


def training_facts(vectors: DataFrame, keys: list[str]) -> list[tuple[dict, list[str], int]]:
    """(keys, classes in sorted order, training rows) of every run, in one small job."""
    rows = (vectors.where(F.col("part") == "train").groupBy(*keys)
            .agg(F.array_sort(F.collect_set("label")).alias("classes"), F.count("*").alias("n")).collect())
    return sorted(((({k: r[k] for k in keys}), r["classes"], r["n"]) for r in rows), key=lambda f: tuple(f[0].values()))


def fit_run(vectors: DataFrame, classifier: Classifier, keys: dict, classes: list[str], rows: int) -> Fit:
    """Trains on the `train` rows of one run, predicts its `test` rows and writes the predictions."""
    started = time.time()
    fit = Fit(keys)
    training = indexed(vectors.where(F.col("part") == "train"), classes).select("_y", "features")
    fit.model = classifier.build(rows).fit(training)
    fit.train_time_s = time.time() - started
    guessed = fit.model.transform(vectors.where(F.col("part") == "test"))
    tags = [F.lit(v).alias(k) for k, v in keys.items()]
    fit.predictions = cut_lineage(guessed.select(*tags, "sample_id", "label", name_of(F.col("prediction"), classes).alias("prediction"),
                                                 probabilities(classes).alias("proba")))
    fit.run_time_s = time.time() - started
    return fit


def fit_runs(vectors: DataFrame, classifier_of: Callable[[dict], Classifier], parallelism: int = 8, shared_s: float = 0.0) -> list[Fit]:
    """One fit per run key of a materialised vectors table, a few at a time; `shared_s` seconds were spent on all of them before."""
    facts = training_facts(vectors, RUN_KEYS)

    def one(fact: tuple[dict, list[str], int]) -> Fit:
        keys, classes, rows = fact
        mine = vectors.where(reduce(lambda a, b: a & b, [F.col(k) == F.lit(v) for k, v in keys.items()]))
        try:
            fit = fit_run(mine, classifier_of(keys), keys, classes, rows)
        except Exception as error:  # recorded as a failed run
            return Fit(keys, status=f"failed: {type(error).__name__}: {error}")
        fit.run_time_s += shared_s / len(facts)
        return fit

    with ThreadPool(parallelism) as pool:
        return pool.map(inheritable_thread_target(vectors.sparkSession)(one), facts)


def collected_predictions(fits: list[Fit]) -> DataFrame:
    """The predictions of all fits, which each of them has written, as one table."""
    tables = [f.predictions for f in fits if f.predictions is not None]
    if not tables:
        raise RuntimeError("no model could be trained: " + "; ".join(sorted({f.status for f in fits})))
    return reduce(DataFrame.unionByName, tables)


def fit_log(vectors: DataFrame, fits: list[Fit]) -> DataFrame:
    """(RUN_KEYS, train_time_s, run_time_s, status), one row per fit."""
    rows = [(*[f.keys[k] for k in RUN_KEYS], float(f.train_time_s), float(f.run_time_s), f.status) for f in fits]
    return vectors.sparkSession.createDataFrame(
        rows, "cohort string, seed int, method string, param string, train_time_s double, run_time_s double, status string")


def penalty(c: float, rows: int) -> float:
    """MLlib penalty for an inverse strength C."""
    return 1.0 / (c * rows)


def depth_or_limit(depth: int | None) -> int:
    """Unlimited depth is MLlib's limit of 30."""
    return 30 if depth is None or math.isinf(depth) else depth
