"""One binary logistic model for each class, trained by stochastic gradient descent, for many runs at once.

A pass starts every block of rows (see `batched.row_blocks`) from the run's weights and takes its rows one after another, in the
order of a hash of run seed and sample; the weights of all blocks, averaged by their rows, are the result of the pass. Blocks
follow from the samples, so the result is the same however the rows are partitioned. The loss of every pass is measured by the
next one, and a pass that did not lower it is repeated with half the step, so that the recorded losses fall.
"""

from __future__ import annotations

import sys
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from widesift.operators.batched import row_blocks
from widesift.operators.metrics import RUN_KEYS
from widesift.session import broadcast_limit, checkpoint_folder, cut_lineage, finished_tables, measured, remove_folder, written

# functions that run in Python workers travel with their job: executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

KINDS = "cohort string, seed int, method string, param string"
STATE = f"{KINDS}, classes array<string>, at array<double>, best array<double>, loss double, scale double, losses array<double>, passes int, still int, done boolean"
#: halvings of the step before a run counts as finished
LEAST_SCALE = 2.0 ** -20


@dataclass(frozen=True)
class Settings:
    """Passes at most; a run ends before when `patience` passes in a row lower the mean loss by less than `tolerance` (None: never)."""

    passes: int = 1000
    tolerance: float | None = 1e-3
    patience: int = 5
    penalty: float = 1e-4
    softmax: bool = False  # how decision values become probabilities; otherwise by sigmoids that are scaled to one


def step_offset(penalty: float) -> float:
    """t0 of the steps 1 / (penalty (t0 + t)): the first step moves a typical weight, penalty^(-1/4), by no more than itself."""
    typical = penalty ** -0.25
    return 1.0 / (typical * penalty)


def one_pass(x: np.ndarray, y: np.ndarray, order: np.ndarray, weights: np.ndarray, penalty: float, scale: float, done: int) -> np.ndarray:
    """Weights (class by intercept and columns) after the rows in `order`; `done` rows have been taken in earlier passes."""
    # a row costs a handful of small products, so that what counts is how many calls they are: the intercepts are the last
    # column, and the weights have the other sign
    offset, held = step_offset(penalty), -np.column_stack([weights[:, 1:], weights[:, 0]])
    inputs, off = np.column_stack([x, np.ones(len(x))]), np.empty(len(held))
    slopes, column, pull = held[:, :-1], off[:, None], np.empty_like(held)
    steps = scale / (penalty * (offset + np.arange(done + 1, done + len(order) + 1)))
    shrinks = np.maximum(0.0, 1.0 - steps * penalty)
    with np.errstate(over="ignore"):  # a chance of 1 / infinity is zero
        for i, label, step, shrink in zip(order.tolist(), y[order].tolist(), steps.tolist(), shrinks.tolist()):
            row = inputs[i]
            np.dot(held, row, out=off)
            np.exp(off, out=off)
            np.add(off, 1.0, out=off)
            np.divide(step, off, out=off)
            off[label] -= step
            np.multiply(slopes, shrink, out=slopes)
            np.multiply(column, row, out=pull)
            np.add(held, pull, out=held)
    return -np.column_stack([held[:, -1], held[:, :-1]])


def turns(seed: int, ids) -> np.ndarray:
    """The places of sorted sample ids in the order of a hash of seed and id."""
    prefix = zlib.crc32(f"{seed}:".encode())
    return np.argsort(np.array([zlib.crc32(i.encode(), prefix) for i in ids], np.int64), kind="stable")


def loss_of(x: np.ndarray, y: np.ndarray, weights: np.ndarray) -> float:
    """Sum over rows and classes of the binary log loss."""
    z = x @ weights[:, 1:].T + weights[:, 0]
    z[np.arange(len(y)), y] *= -1
    return float(np.logaddexp(0.0, z).sum())


def _met(blocks: DataFrame, states: DataFrame, size: int) -> DataFrame:
    """Every block with the state of its run; states of `size` bytes go to the blocks if they can."""
    return blocks.join(F.broadcast(states) if size <= broadcast_limit(states.sparkSession) else states, RUN_KEYS)


def fitted(blocks: DataFrame, settings: Settings, folder: str | None = None) -> DataFrame:
    """(RUN_KEYS, classes, best, losses, passes, ...): the weights of every run, and the mean loss before each of its passes and after the last.

    All runs advance in the same job, one for each pass. A `folder` of the caller keeps the states: a second call with it goes on
    after the last whole pass.
    """
    spark = blocks.sparkSession
    base = folder or f"{checkpoint_folder(spark)}/passes-{uuid.uuid4().hex}"
    rounds = finished_tables(spark, base)
    read = lambda name: spark.read.schema(STATE).parquet(f"{base}/{name}")
    if rounds:
        number, states = int(rounds[-1]), read(rounds[-1])
    else:
        zeros = F.array_repeat(F.lit(0.0), F.size("classes") * (F.col("width") + 1))
        start = blocks.groupBy(*RUN_KEYS).agg(F.first("classes").alias("classes"), F.first("width").alias("width")).select(
            *RUN_KEYS, "classes", zeros.alias("at"), zeros.alias("best"), F.lit(float("inf")).alias("loss"), F.lit(1.0).alias("scale"),
            F.array().cast("array<double>").alias("losses"), F.lit(0).alias("passes"), F.lit(0).alias("still"), F.lit(False).alias("done"))
        number, states = 0, written(start, f"{base}/{0:06d}")
    rows = blocks.drop("classes")

    def taken(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = []
            for r in frame.itertuples():
                x, y = np.frombuffer(r.x).reshape(-1, r.width), np.frombuffer(r.y, np.int32)
                weights = np.array(r.at).reshape(-1, r.width + 1)
                after = one_pass(x, y, turns(r.seed, r.ids), weights, settings.penalty, r.scale, r.passes * len(y))
                found.append((r.cohort, r.seed, r.method, r.param, r.block, len(y), loss_of(x, y, weights), after.ravel()))
            yield pd.DataFrame(found, columns=[*RUN_KEYS, "block", "rows", "part", "after"])

    def judged(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("block")
        s = frame.iloc[0]
        n, weights = int(frame.rows.sum()), np.array(s["at"])
        by_class = weights.reshape(len(s.classes), -1)
        loss = float(sum(frame.part)) / n + settings.penalty / 2 * float((by_class[:, 1:] ** 2).sum())
        new = {k: s[k] for k in (*RUN_KEYS, "classes", "best", "loss", "scale", "losses", "passes", "still", "done")}
        if loss > s.loss:  # the last pass went too far
            new.update(at=s.best, scale=s.scale / 2, done=s.scale / 2 < LEAST_SCALE)
            return pd.DataFrame([new])
        known = len(s.losses) > s.passes  # a repeated start
        losses = list(s.losses) if known else [*s.losses, loss]
        little = settings.tolerance is not None and len(losses) > 1 and losses[-2] - losses[-1] < settings.tolerance
        still = s.still if known else s.still + 1 if little else 0
        ended = s.passes >= settings.passes or settings.tolerance is not None and still >= settings.patience
        after = sum(np.array(a) * (m / n) for a, m in zip(frame.after, frame.rows))
        new.update(at=weights if ended else after, best=weights, loss=loss, losses=losses, still=still, done=ended, passes=s.passes + (not ended))
        return pd.DataFrame([new])

    names = [c.split()[0] for c in STATE.split(", ")]
    while True:
        waiting = states.where(~F.col("done"))
        sent = waiting.select(*RUN_KEYS, "at", "scale", "passes")
        left, size = measured(sent)
        if not left:
            break
        parts = _met(rows, sent, size).mapInPandas(taken, f"{KINDS}, block int, rows int, part double, after array<double>")
        moved = waiting.join(parts, RUN_KEYS).groupBy(*RUN_KEYS).applyInPandas(lambda f: judged(f)[names], STATE)
        number += 1
        states = written(states.where("done").unionByName(moved), f"{base}/{number:06d}")
        remove_folder(spark, f"{base}/{number - 1:06d}")
    if folder is None:
        states = cut_lineage(states)
        remove_folder(spark, base)
    return states


def predictions(blocks: DataFrame, states: DataFrame, softmax: bool) -> DataFrame:
    """(RUN_KEYS, sample_id, label, prediction, proba) for the rows of blocks; the class with the largest decision value, the first of equals."""
    models = cut_lineage(states.select(*RUN_KEYS, F.col("classes").alias("names"), "best"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = []
            for r in frame.itertuples():
                x, y = np.frombuffer(r.x).reshape(-1, r.width), np.frombuffer(r.y, np.int32)
                w = np.array(r.best).reshape(len(r.names), -1)
                z = x @ w[:, 1:].T + w[:, 0]
                p = np.exp(z - z.max(axis=1, keepdims=True)) if softmax else 1.0 / (1.0 + np.exp(-np.clip(z, -500, 500)))
                total = p.sum(axis=1, keepdims=True)
                p = p / np.where(total > 0, total, 1.0)
                found += [(r.cohort, r.seed, r.method, r.param, i, r.classes[c], r.names[b], dict(zip(r.names, row)))
                          for i, c, b, row in zip(r.ids, y, z.argmax(axis=1), p.tolist())]
            yield pd.DataFrame(found, columns=[*RUN_KEYS, "sample_id", "label", "prediction", "proba"])

    return _met(blocks, models, measured(models)[1]).mapInPandas(run, f"{KINDS}, sample_id string, label string, prediction string, proba map<string,double>")


def run_blocks(vectors: DataFrame, part: str) -> DataFrame:
    return row_blocks(vectors.where(F.col("part") == part).select(*RUN_KEYS, "sample_id", "label", "features"), keys=RUN_KEYS)


def fit_runs(vectors: DataFrame, settings: Settings) -> tuple[DataFrame, DataFrame]:
    """(predictions of the test rows, states) for every run of a vectors table, all in one batch."""
    states = fitted(run_blocks(vectors, "train"), settings)
    return cut_lineage(predictions(run_blocks(vectors, "test"), states, settings.softmax)), states
