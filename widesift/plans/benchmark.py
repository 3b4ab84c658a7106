"""The whole benchmark: select features, train, evaluate, and record a run per cohort, seed and setting.

Splits, statistics, selections and metrics are single plans over all cohorts and seeds. Only model
fits are submitted one by one (see `operators.models`).
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from widesift.operators import (embedded, forward, information, metrics, models, moments, prepare, ranking, reports,
                                 scores, selection, splits, stochastic)
from widesift.session import cut_lineage

# The settings the published benchmark was run with.
VARIANCE_THRESHOLDS = (0.05, 0.10, 0.25, 0.50, 0.75)
ANOVA_TOP_K = 5000
MUTUAL_INFO_TOP_K = 2000
K_BEST_FRACTIONS = (0.50,)
FORWARD_PREFILTER = 1000
FORWARD_FRACTION = 0.2
FORWARD_FOLDS = 2


@dataclass
class Prepared:
    """Inputs every method shares, each written once."""

    matrix: DataFrame
    samples: DataFrame
    seeds: list[int]
    split: DataFrame
    moments: DataFrame
    rows: int
    width: int
    fill: DataFrame | None = None
    gaps: str = "error"

    def row_buckets(self) -> int:
        """Tasks per group that is ordered by sample."""
        return ranking.buckets_for(self.rows)

    def feature_buckets(self) -> int:
        """Tasks per group that is ordered by feature."""
        return ranking.buckets_for(self.width)

    def cells(self) -> DataFrame:
        """The matrix, with its gaps filled (per seed) if they stand for something: dense, for methods that need all cells."""
        if self.gaps == "error":
            return self.matrix
        fill = self.fill if self.gaps == "median" else self.moments.select("cohort", "seed", "feature", F.lit(0.0).alias("fill"))
        return prepare.median_impute(self.matrix, self.split, fill).select(
            "cohort", "seed", "sample_id", "feature", "value")

    def vectors(self, feature_sets: DataFrame) -> DataFrame:
        """Assembled vectors of the feature sets, written once."""
        return models.stored(models.build_vectors(self.matrix, self.split, feature_sets, self.moments, self.fill,
                                                  "zero" if self.gaps == "zero" else "error"))

    def train_cells(self) -> DataFrame:
        return prepare.train_cells(self.cells(), self.split)


@dataclass(frozen=True)
class Method:
    """A named selection (returning cohort, seed, param, feature), its params and its classifier."""

    name: str
    params: tuple[str, ...]
    select: Callable[[Prepared], DataFrame]
    classifier: str = "logistic"


def prepared(matrix: DataFrame, samples: DataFrame, seeds: Sequence[int], impute: bool = False,
             share: float = splits.HOLDOUT_SHARE, gaps: str | None = None) -> Prepared:
    """Splits and statistics for an aligned matrix.

    gaps says what an absent cell is: an error ("error", the default), a zero ("zero", for sparse matrices) or
    the training median of its feature ("median", or impute=True).
    """
    gaps = gaps or ("median" if impute else "error")
    if gaps not in ("error", "zero", "median"):
        raise ValueError(f"gaps is 'error', 'zero' or 'median', not {gaps!r}")
    seeds = [int(s) for s in seeds]
    rows = samples.count()
    split = cut_lineage(splits.stratified_split(samples, seeds, share))
    stats = moments.feature_stats(matrix, split, seeds, samples)
    if gaps == "median":
        fill = cut_lineage(prepare.train_medians(matrix, split, ranking.buckets_for(rows)))
        summary = cut_lineage(moments.feature_moments(stats, moments.class_sizes(split), fill))
    else:
        fill = None
        sizes = moments.class_sizes(split) if gaps == "zero" else None
        summary = cut_lineage(moments.feature_moments(stats, sizes))
    widest = summary.groupBy("cohort", "seed").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    return Prepared(matrix, samples, seeds, split, summary, rows, widest or 0, fill, gaps)


def _tagged(features: DataFrame, param) -> DataFrame:
    column = F.lit(param) if isinstance(param, str) else param
    return features.select("cohort", "seed", column.alias("param"), "feature")


def baseline() -> Method:
    return Method("baseline", ("all",), lambda p: _tagged(p.moments, "all"))


def variance_threshold(thresholds: Sequence[float] = VARIANCE_THRESHOLDS) -> Method:
    names = {float(t): f"threshold={t:g}" for t in thresholds}

    def select(p: Prepared) -> DataFrame:
        hits = [F.when(F.col("score") > t, F.lit(n)) for t, n in names.items()]
        return _tagged(scores.variance_scores(p.moments).withColumn("n", F.explode(F.array_compact(F.array(*hits)))), F.col("n"))

    return Method("variance", tuple(names.values()), select, "one_vs_rest")


def scored(name: str, score: Callable[[Prepared], DataFrame], k: int, classifier: str = "logistic_long",
           higher_index_wins: bool = True) -> Method:
    """Top k by any score function: the way in for a user's own scorer."""
    param = f"k={k}"
    return Method(name, (param,), lambda p: _tagged(selection.top_k(score(p), k, higher_index_wins, p.feature_buckets()), param), classifier)


def anova(k: int = ANOVA_TOP_K) -> Method:
    return scored("anova", lambda p: scores.SCORERS["anova"](p.moments), k)


def mutual_info(k: int = MUTUAL_INFO_TOP_K) -> Method:
    return scored("mutual_info", lambda p: scores.SCORERS["mutual_info"](p.train_cells(), p.row_buckets()), k)


def select_k_best(fractions: Sequence[float] = K_BEST_FRACTIONS) -> Method:
    names = tuple(f"fraction={f:g}" for f in fractions)

    def select(p: Prepared) -> DataFrame:
        best = selection.top_fraction(scores.anova_scores(p.moments), list(fractions), p.feature_buckets())
        named = F.element_at(F.create_map(*[x for f, n in zip(fractions, names) for x in (F.lit(float(f)), F.lit(n))]), F.col("fraction"))
        return _tagged(best, named)

    return Method("select_k_best", names, select, "one_vs_rest_50")


def forward_selection(fraction: float = FORWARD_FRACTION, prefilter: int = FORWARD_PREFILTER,
                      folds: int = FORWARD_FOLDS, scorer: str = "naive_bayes") -> Method:
    """Forward selection of a fraction of the `prefilter` features with the highest variance."""
    param = f"fraction={fraction:g}"

    def select(p: Prepared) -> DataFrame:
        candidates = cut_lineage(selection.top_k(scores.variance_scores(p.moments), prefilter, False, p.feature_buckets())
                                 .select("cohort", "seed", "feature"))
        widest = candidates.groupBy("cohort", "seed").count().agg(F.max("count")).first()[0]
        train = p.split.where(F.col("part") == "train").drop("part")
        folded = splits.stratified_folds(train, folds)
        steps = max(1, int(widest * fraction))
        if scorer == "logistic":
            named = candidates.withColumns({"method": F.lit("forward"), "param": F.lit("candidates")})
            vectors = p.vectors(named)
            found = forward.forward_selection_logistic(vectors, folded, candidates, steps, folds)
        else:
            found = forward.forward_selection(p.cells(), folded, steps, folds, candidates)
        return _tagged(found, param)

    return Method("forward", (param,), select, "logistic_short")


def _by_model(score: Callable[[DataFrame, list[str], int], DataFrame], mask: Callable[[DataFrame], DataFrame],
              param: str) -> Callable[[Prepared], DataFrame]:
    """Selection by a model trained per cohort and seed on the scaled, non-constant features."""

    def select(p: Prepared) -> DataFrame:
        varying = cut_lineage(scores.varying_features(p.moments)
                              .withColumns({"method": F.lit("tuning"), "param": F.lit("all")}))
        vectors = p.vectors(varying)
        found = []
        for run in vectors.select("cohort", "seed").distinct().orderBy("cohort", "seed").collect():
            this = (F.col("cohort") == run["cohort"]) & (F.col("seed") == run["seed"])
            # feature names in vector order: as many as the model has coefficients
            names = [r[0] for r in varying.where(this).select("feature").orderBy("feature").collect()]
            table = score(vectors.where(this), names, run["seed"]).withColumns(
                {"cohort": F.lit(run["cohort"]), "seed": F.lit(run["seed"])})
            found.append(_tagged(mask(table), param))
        return reduce(DataFrame.unionByName, found)

    return select


def lasso(**options) -> Method:
    def select(p: Prepared) -> DataFrame:
        varying = cut_lineage(scores.varying_features(p.moments).withColumns({"method": F.lit("tuning"), "param": F.lit("all")}))
        places = prepare.positions(varying, ["cohort", "seed"])
        return _tagged(selection.nonzero(embedded.lasso_scores(p.vectors(varying), places, **options)), "cv")

    return Method("LASSO", ("cv",), select)


def random_forest(**options) -> Method:
    return Method("RandomForest", ("cv",), _by_model(
        lambda v, names, seed: embedded.forest_scores(v, names, seed, **options), selection.above_mean, "cv"))


@dataclass
class Outcome:
    runs: DataFrame
    predictions: DataFrame
    feature_sets: DataFrame


def evaluate_feature_sets(p: Prepared, feature_sets: DataFrame, classifier: str, parallelism: int = 8,
                          selected_s: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """(predictions, fit log) of one classifier for every feature set (RUN_KEYS, feature); `selected_s` seconds went into the sets."""
    started = time.time()
    vectors = p.vectors(feature_sets)
    if classifier in models.STOCHASTIC:
        trained = time.time()
        predictions, states = stochastic.fit_runs(vectors, models.STOCHASTIC[classifier])
        spent, whole = time.time() - trained, selected_s + time.time() - started
        # runs of one batch share its time
        n = states.count()
        log = states.select(*metrics.RUN_KEYS, F.lit(spent / n).alias("train_time_s"), F.lit(whole / n).alias("run_time_s"), F.lit("ok").alias("status"))
        return predictions, log
    fits = models.fit_runs(vectors, lambda keys: models.CLASSIFIERS[classifier], parallelism, selected_s + time.time() - started)
    return models.collected_predictions(fits), models.fit_log(vectors, fits)


def run_benchmark(p: Prepared, methods: Sequence[Method], parallelism: int = 8) -> Outcome:
    """Runs every method for every cohort and seed. A failure is a run with its status, not an abort."""
    parts, broken, first = [], [], None
    for method in methods:
        started = time.time()
        try:
            sets = cut_lineage(method.select(p).select("cohort", "seed", F.lit(method.name).alias("method"), "param", "feature"))
            parts.append((sets, *evaluate_feature_sets(p, sets, method.classifier, parallelism, time.time() - started)))
        except Exception as error:  # recorded, and the other methods go on
            broken.append(F.when(F.col("method") == method.name, f"failed: {type(error).__name__}: {error}"))
            first = first or error
    if not parts:
        raise RuntimeError("no method could be run") from first
    sets, predictions, log = (reduce(DataFrame.unionByName, column) for column in zip(*parts))
    results = metrics.evaluate(predictions, buckets=p.row_buckets()).join(log, metrics.RUN_KEYS, "full")
    width = p.moments.groupBy("cohort").agg(F.count_distinct("feature").alias("n_features_total"))
    grid = splits.job_grid(p.samples, p.seeds, {m.name: m.params for m in methods})
    runs = reports.run_records(grid, sets, results, width)
    if broken:
        runs = runs.withColumn("status", F.coalesce(*broken, "status"))
    return Outcome(cut_lineage(runs), predictions, sets)
