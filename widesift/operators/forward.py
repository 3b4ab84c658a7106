"""Sequential forward selection: each step adds the feature with the best cross-validated macro F1.

The default scorer is Gaussian naive Bayes. Its class log-likelihood is a sum over features, so a step
does not train anything: it adds each candidate's term to the sum of the features chosen so far and takes
the best class. One job scores all candidates of all cohorts and seeds. Rows lie in blocks that are written
once; what is sent to them in a step are the Gaussians and the choice so far, and what comes back are counts.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window, functions as F

from widesift.operators import batched, metrics
from widesift.operators.prepare import positions
from widesift.operators.selection import project_features
from widesift.session import broadcast_if_bounded, broadcast_limit, cut_lineage, measured

# functions that run in Python workers travel with their job: executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

GROUP = ["cohort", "seed"]
SAMPLE = ["cohort", "seed", "fold", "sample_id"]
FOLD = [*GROUP, "fold"]
CELL = ["cohort", "seed", "sample_id", "feature", "value"]
#: of the largest variance of a feature among the rows that a fold is fitted on; added to every variance
SMOOTHING = 1e-9
DIGITS = 9
#: cells of a block of rows, and rows that are scored at a time
BLOCK_CELLS = 1 << 20
SLICE = 2048
ABSENT, EMPTY, KNOWN = range(3)


def _small(written: DataFrame) -> DataFrame:
    """A table that has been written: measured where it is."""
    return broadcast_if_bounded(written, written)


def _row_keys(cells: DataFrame) -> list[str]:
    return [k for k in ("cohort", "seed", "sample_id") if k in cells.columns]


def _pooled(classes):
    """Variance over the rows of all classes, from array<struct<n, mean, var>>."""
    add = lambda part: F.aggregate(classes, F.lit(0.0), lambda a, c: a + c["n"] * part(c))
    n, mean = add(lambda c: F.lit(1.0)), add(lambda c: c["mean"])
    return add(lambda c: c["var"] + F.pow(c["mean"] - mean / n, F.lit(2.0))) / n


def _blocks(cells: DataFrame, folded: DataFrame, places: DataFrame, cells_per_block: int) -> DataFrame:
    """(FOLD, block, width, labels, y, x, state): the rows of every fold in blocks of a bounded number of cells, column by column.

    `labels` are those of the cohort and seed; `state` says which cells are absent, null or known, and is null where all are known.
    """
    keys, rows = [k for k in GROUP if k in cells.columns], _row_keys(cells)
    # a null has its place below zero, since a list of doubles tells it no longer from NaN
    place = F.when(F.col("value").isNull(), -F.col("pos") - 1).otherwise(F.col("pos"))
    listed = (cells.join(_small(places.drop("width")), [*keys, "feature"])
              .groupBy(*rows).agg(F.collect_list(F.struct(place.alias("at"), F.coalesce("value", F.lit(0.0)).alias("value"))).alias("_c"))
              .select(*rows, F.col("_c.at").alias("at"), F.col("_c.value").alias("value")))
    labels = folded.groupBy(*GROUP).agg(F.array_sort(F.collect_set("label")).alias("labels"))
    sizes = (folded.groupBy(*FOLD).agg(F.count(F.lit(1)).alias("n")).join(labels, GROUP)
             .join(places.select(*keys, "width").distinct(), keys)
             .select(*FOLD, "labels", "width", F.ceil(F.col("n") * F.col("width") / cells_per_block).cast("int").alias("blocks")))
    dealt = listed.join(folded, rows).join(broadcast_if_bounded(sizes), FOLD).select(
        *FOLD, F.pmod(F.xxhash64("sample_id"), F.col("blocks")).cast("int").alias("block"), "width", "labels",
        (F.array_position("labels", F.col("label")) - 1).cast("int").alias("y"), "at", "value")

    def block(frame: pd.DataFrame) -> pd.DataFrame:
        first = frame.iloc[0]
        x, state = np.zeros((first.width, len(frame))), np.zeros((first.width, len(frame)), np.uint8)
        at = np.concatenate(frame["at"].tolist()).astype(int)
        column, row = np.where(at < 0, -at - 1, at), np.repeat(np.arange(len(frame)), frame["at"].map(len))
        x[column, row] = np.concatenate(frame["value"].tolist())
        state[column, row] = np.where(at < 0, EMPTY, KNOWN)
        return pd.DataFrame([{**{k: first[k] for k in (*FOLD, "block", "width", "labels")}, "y": frame.y.to_numpy(np.int32).tobytes(),
                              "x": x.tobytes(), "state": None if (state == KNOWN).all() else state.tobytes()}])

    return cut_lineage(dealt.groupBy(*FOLD, "block").applyInPandas(
        block, "cohort string, seed int, fold int, block int, width int, labels array<string>, y binary, x binary, state binary"))


def _arrays(r) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """(labels by number, cells by column and row, their states or None) of a block."""
    y = np.frombuffer(r.y, np.int32)
    return y, np.frombuffer(r.x).reshape(r.width, len(y)), None if r.state is None else np.frombuffer(r.state, np.uint8).reshape(r.width, len(y))


def _block_moments(blocks: DataFrame) -> DataFrame:
    """(FOLD, label, pos, cells, n, mean, m2): cells of a block by class and column, and moments of those with a value."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples():
                y, x, state = _arrays(r)
                found = []
                for c in np.unique(y).tolist():
                    part, of = x[:, y == c], None if state is None else state[:, y == c]
                    known = np.ones(part.shape, bool) if of is None else of == KNOWN
                    n = known.sum(axis=1)
                    mean = np.where(known, part, 0.0).sum(axis=1) / np.maximum(n, 1)
                    m2 = (np.where(known, part - mean[:, None], 0.0) ** 2).sum(axis=1)
                    present = n if of is None else (of != ABSENT).sum(axis=1)
                    found.append(pd.DataFrame({"cohort": r.cohort, "seed": r.seed, "fold": r.fold, "label": r.labels[c], "pos": np.arange(len(n)),
                                               "cells": present, "n": n, "mean": mean, "m2": m2}))
                yield pd.concat(found)

    return blocks.mapInPandas(run, "cohort string, seed int, fold int, label string, pos int, cells bigint, n bigint, mean double, m2 double")


def _fold_fits(blocks: DataFrame, folded: DataFrame, folds: int) -> tuple[DataFrame, DataFrame]:
    """Class priors and per-feature Gaussians of every fold, fitted on the rows of the other folds.

    priors: (cohort, seed, fold, classes array<struct<label, prior>>); fits: (cohort, seed, fold, pos,
    params array<struct<mean, peak, slope>>) in the order of `classes`; a log-density is
    peak - slope * (value - mean)^2. A class without values for the feature has three zeros.
    """
    others = F.explode(F.filter(F.array(*[F.lit(f) for f in range(folds)]), lambda f: f != F.col("fold")))
    counts = folded.withColumn("fold", others).groupBy(*FOLD, "label").agg(F.count("*").alias("n"))
    priors = counts.groupBy(*FOLD).agg(
        F.array_sort(F.collect_list(F.struct("label", "n"))).alias("_c"), F.sum("n").alias("_n")).select(
        *FOLD, F.transform("_c", lambda c: F.struct(
            c["label"].alias("label"), F.log(c["n"] / F.col("_n")).alias("prior"))).alias("classes"))
    # moments of a block's rows, put together: a list is as long as the blocks of a cohort and seed are many
    spread = F.aggregate("_parts", F.lit(0.0), lambda a, p: a + p["m2"] + p["n"] * F.pow(p["mean"] - F.col("mean"), F.lit(2.0)))
    classes = (_block_moments(blocks).where("cells > 0").withColumn("fold", others)
               .groupBy(*FOLD, "pos", "label")
               .agg(F.sum("n").alias("n"), F.try_divide(F.sum(F.col("n") * F.col("mean")), F.sum("n")).alias("mean"),
                    F.collect_list(F.struct("n", "mean", "m2")).alias("_parts"))
               .withColumn("var", F.try_divide(spread, F.col("n")))
               .groupBy(*FOLD, "pos")
               .agg(F.collect_list(F.struct("label", "n", "mean", "var")).alias("_by")))
    classes = cut_lineage(classes.withColumn("_all", _pooled(F.filter("_by", lambda c: c["n"] > 0))))
    # where no feature varies any number does
    added = classes.groupBy(*GROUP, "fold").agg((F.max("_all") * SMOOTHING).alias("_most")).select(
        *GROUP, "fold", F.when(F.col("_most") > 0, F.col("_most")).otherwise(SMOOTHING).alias("_added"))

    def gaussian(c):
        var = c["var"] + F.col("_added")
        return F.struct(c["label"].alias("label"), F.struct(
            c["mean"].alias("mean"), (-0.5 * F.log(2 * math.pi * var)).alias("peak"), (0.5 / var).alias("slope")).alias("p"))

    gaussians = classes.join(added, FOLD).select(
        *FOLD, "pos", F.map_from_entries(F.transform("_by", gaussian)).alias("_by"))
    nothing = F.struct(F.lit(0.0).alias("mean"), F.lit(0.0).alias("peak"), F.lit(0.0).alias("slope"))

    def of_class(c):
        p = F.col("_by")[c["label"]]
        return F.when(p["slope"].isNotNull(), p).otherwise(nothing)

    return priors, gaussians.join(priors, FOLD).select(*FOLD, "pos", F.transform("classes", of_class).alias("params"))


def _packed(priors: DataFrame, fits: DataFrame) -> DataFrame:
    """(FOLD, names, prior, pos, mean, peak, slope, chosen): all Gaussians of a fold in a row, by feature and class."""
    lists = fits.groupBy(*FOLD).agg(F.array_sort(F.collect_list(F.struct("pos", "params"))).alias("_f"))

    def flat(part: str):
        return F.flatten(F.transform("_f", lambda f: F.transform(f["params"], lambda p: p[part]))).alias(part)

    return lists.join(priors, FOLD).select(
        *FOLD, F.col("classes.label").alias("names"), F.col("classes.prior").alias("prior"), F.col("_f.pos").alias("pos"), flat("mean"), flat("peak"), flat("slope"),
        F.array().cast("array<int>").alias("chosen"))


def forward_selection(matrix: DataFrame, folded: DataFrame, steps: int, folds: int = 2,
                      candidates: DataFrame | None = None, cells_per_block: int = BLOCK_CELLS) -> DataFrame:
    """(cohort, seed, rank, feature, score): the features in the order they were added.

    matrix: cells (cohort, [seed,] sample_id, feature, value); folded: training rows with `fold`;
    candidates: (cohort, seed, feature), or None for all features.
    The cells are shuffled once, into blocks of rows; a step reads the blocks and shuffles counts.
    """
    cells = matrix.select(*[c for c in CELL if c in matrix.columns])
    if candidates is not None:
        cells = project_features(cells, candidates.select(*GROUP, "feature"))
    folded = cut_lineage(folded.select(*SAMPLE, "label"))
    places = cut_lineage(positions(cells, [k for k in GROUP if k in cells.columns]))
    blocks = _blocks(cells, folded, places, cells_per_block)
    models = cut_lineage(_packed(*_fold_fits(blocks, folded, folds)))
    chosen = None
    for rank in range(1, steps + 1):
        best = cut_lineage(_best_candidate(blocks, models).withColumn("rank", F.lit(rank)))
        models = cut_lineage(models.join(_small(best.select(*GROUP, F.col("pos").alias("_won"))), GROUP, "left").withColumn(
            "chosen", F.concat("chosen", F.array_compact(F.array("_won")))).drop("_won"))
        chosen = best if chosen is None else chosen.unionByName(best)
    return chosen.join(_small(places.drop("width")), [k for k in (*GROUP, "pos") if k in places.columns]).select(*GROUP, "rank", "feature", "score")


def _confusions(blocks: DataFrame, models: DataFrame) -> DataFrame:
    """(FOLD, pos, label, prediction, n) after adding each candidate that is left; a row without a cell for it does not count."""
    size = measured(models)[1]
    met = blocks.drop("block").join(F.broadcast(models) if size <= broadcast_limit(models.sparkSession) else models, FOLD)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, counts, names, labels = None, None, None, None

        def out() -> pd.DataFrame:
            pos, label, guess = np.nonzero(counts)
            return pd.DataFrame({"cohort": key[0], "seed": key[1], "fold": key[2], "pos": pos, "label": np.array(labels, object)[label],
                                 "prediction": np.array(names, object)[guess], "n": counts[pos, label, guess]})

        for frame in frames:
            for r in frame.itertuples():
                if key != (r.cohort, r.seed, r.fold):
                    if key is not None:
                        yield out()
                    key, names, labels = (r.cohort, r.seed, r.fold), list(r.names), list(r.labels)
                    counts = np.zeros((r.width, len(labels), len(names)), np.int64)
                y, x, state = _arrays(r)
                k = len(names)
                row_of = {int(pos): i for i, pos in enumerate(r.pos)}
                mean, peak, slope = (np.array(part, np.float64).reshape(-1, k) for part in (r.mean, r.peak, r.slope))

                def terms(pos: int, rows: slice) -> np.ndarray:
                    i = row_of[pos]
                    gap = x[pos, rows, None] - mean[i]
                    term = slope[i] * gap
                    term *= gap
                    np.subtract(peak[i], term, out=term)
                    if not slope[i].all():
                        term[:, slope[i] == 0] = 0.0
                    if state is not None:
                        term[state[pos, rows] != KNOWN] = 0.0
                    return term

                chosen = list(map(int, r.chosen))
                for start in range(0, len(y), SLICE):
                    rows = slice(start, start + SLICE)
                    total = np.tile(np.array(r.prior, np.float64), (len(y[rows]), 1))
                    for pos in chosen:
                        if pos in row_of:
                            total += terms(pos, rows)
                    for pos in row_of:
                        if pos in chosen:
                            continue
                        # compared as whole multiples of 1e-9, so that the order of a sum cannot decide between equal classes
                        sums = terms(pos, rows)
                        sums += total
                        sums *= 10.0 ** DIGITS
                        pairs = y[rows] * k + np.rint(sums, out=sums).argmax(axis=1)
                        if state is not None:
                            pairs = pairs[state[pos, rows] != ABSENT]
                        counts[pos] += np.bincount(pairs, minlength=counts[pos].size).reshape(counts[pos].shape)
        if key is not None:
            yield out()

    found = met.mapInPandas(run, "cohort string, seed int, fold int, pos int, label string, prediction string, n bigint")
    return found.groupBy(*FOLD, "pos", "label", "prediction").agg(F.sum("n").alias("n"))


def candidate_scores(blocks: DataFrame, models: DataFrame) -> DataFrame:
    """(cohort, seed, pos, score): mean over folds of the macro F1 after adding the feature."""
    keys = [*FOLD, "pos"]
    return (metrics.class_metrics(_confusions(blocks, models), keys).groupBy(*keys).agg(F.avg("f1").alias("f1"))
            .groupBy(*GROUP, "pos").agg(F.avg("f1").alias("score")))


def _best_candidate(blocks: DataFrame, models: DataFrame) -> DataFrame:
    first = F.min(F.struct((-F.round("score", DIGITS)).alias("_d"), "pos", "score"))
    return (candidate_scores(blocks, models).groupBy(*GROUP).agg(first.alias("b"))
            .select(*GROUP, "b.pos", "b.score"))


# ---- trained candidates -----------------------------------------------------------------------

def forward_selection_logistic(vectors: DataFrame, folded: DataFrame, candidates: DataFrame, steps: int, folds: int = 2, c: float = 1.0) -> DataFrame:
    """The same selection with a logistic model trained for every candidate, fold and step.

    vectors: scaled (cohort, seed, sample_id, features) of all candidates in name order; `c` is the inverse strength of the L2
    penalty. The models of all candidates, folds, cohorts and seeds of a step are one batch of Newton fits, which begin at
    the weights of the step before, so the number of jobs follows the steps and not the candidates. A candidate whose score is
    equal to another one's comes after it if its name does.
    """
    rows = vectors.select(*GROUP, "sample_id", "features").join(folded.select(*GROUP, "sample_id", "label", "fold"), [*GROUP, "sample_id"])
    blocks = batched.row_blocks(rows)
    counts = cut_lineage(batched.class_counts(blocks, range(folds)))
    place = F.row_number().over(Window.partitionBy(*GROUP).orderBy("feature")) - 1
    left = cut_lineage(candidates.select(*GROUP, "feature").distinct().withColumn("pos", place))
    # what has been chosen, and by fold the weights of the model with it
    start = cut_lineage(counts.select(*GROUP, "held", F.array().cast("array<int>").alias("columns"), F.lit(None).cast("array<double>").alias("weights"), F.size("present").alias("k")))
    found = None
    for rank in range(1, steps + 1):
        width = F.size("columns") + 1
        wider = F.flatten(F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda i: F.concat(F.slice("weights", i * width + 1, width), F.array(F.lit(0.0)))))
        fits = left.join(start, GROUP).select(
            *GROUP, (F.col("pos") * folds + F.col("held")).cast("bigint").alias("fit"), "held", F.concat("columns", F.array("pos")).alias("columns"),
            F.lit(1.0 / c).alias("l2"), F.array(F.lit(0.0)).alias("strengths"), wider.alias("at"))
        models = cut_lineage(batched.models(batched.fitted(blocks, batched.starting(fits, counts))))
        per_class = metrics.class_metrics(batched.confusions(blocks, models).drop("place"), batched.KEYS)
        scored = (per_class.groupBy(*batched.KEYS).agg(F.avg("f1").alias("f1"))
                  .groupBy(*GROUP, F.floor(F.col("fit") / folds).cast("int").alias("pos")).agg(F.avg("f1").alias("score")))
        first = F.min(F.struct((-F.round("score", DIGITS)).alias("_d"), "pos", "score"))
        best = cut_lineage(scored.groupBy(*GROUP).agg(first.alias("b")).select(*GROUP, "b.pos", "b.score")
                           .join(left, [*GROUP, "pos"]).select(*GROUP, F.lit(rank).alias("rank"), "feature", "score", "pos"))
        found = best if found is None else found.unionByName(best)
        left = cut_lineage(left.join(_small(best.select(*GROUP, "pos")), [*GROUP, "pos"], "left_anti"))
        won = models.join(_small(best.select(*GROUP, "pos")), GROUP).where(F.floor(F.col("fit") / folds) == F.col("pos"))
        start = cut_lineage(won.select(*GROUP, "held", "columns", "weights", F.size("present").alias("k")))
        if left.isEmpty():
            break
    return found.drop("pos")
