"""Many penalised softmax regressions at once.

A fit is one model of a cohort and seed: some of the columns, one fold left out or none, an L2 strength and a falling list of
L1 strengths. All fits of all cohorts and seeds advance in the same jobs. A round is one pass over the rows: blocks of rows meet
the fits of their group, a task adds up loss, gradient and Hessian of every fit over its blocks, and one row for each fit and
task is shuffled to the Newton step. How many jobs there are depends on the slowest fit, not on how many there are.

Rows lie in blocks that a hash of the sample id deals out, of a bounded number of cells each; blocks stay where they are, and the
fits, which are small, are sent to them. States are written after every round, so that nothing is derived again.
"""

from __future__ import annotations

import sys
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F, types as T

from widesift.session import broadcast_if_bounded, broadcast_limit, checkpoint_folder, cut_lineage, finished_tables, measured, remove_folder, written

# functions that run in Python workers travel with their job: executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

GROUP = ["cohort", "seed"]
KEYS = [*GROUP, "fit"]
#: numbers in a block of rows, fits that meet a block in one row, bytes of sums that a task gathers before it hands them on
BLOCK_CELLS = 1 << 21
SLOT = 512
HELD_BYTES = 1 << 25
#: numbers in the products of rows, classes and columns that a Hessian is added up from at a time
SLICE_CELLS = 1 << 20
#: rounds for one strength at most; a fit that needs more is marked as not converged
ROUNDS = 200
TOLERANCE = 1e-10
#: distance from the condition of a minimum, as a part of the L1 strength, and change of the weights at which a fit ends
SLACK = 1e-6
LAST_MOVE = 1e-8
EVERY = -1

BLOCK = "block int, width int, classes array<string>, ids array<string>, y binary, fold binary, x binary"
PATH = "array<struct<strength:double,columns:array<int>,weights:array<double>,converged:boolean>>"
STATE = (f"cohort string, seed int, fit bigint, held int, present array<boolean>, columns array<int>, l2 double, strengths array<double>, "
         f"at array<double>, best array<double>, move array<double>, step double, goal double, rounds int, done boolean, path {PATH}")


def row_blocks(rows: DataFrame, cells: int = BLOCK_CELLS, keys: Sequence[str] = GROUP) -> DataFrame:
    """Rows (keys, sample_id, label, fold, features) as dense blocks; `classes` are the labels of a group of equal keys in order.

    `fold` may be absent. The blocks of a group and what they hold follow from the samples alone, not from partitions.
    """
    keys = list(keys)
    if "fold" not in rows.columns:
        rows = rows.withColumn("fold", F.lit(EVERY))
    # a vector's width, not its values, decides how many rows make a block
    listed = rows.select(*keys, "sample_id", "label", "fold", vector_to_array("features").alias("x"))
    facts = listed.groupBy(*keys).agg(F.array_sort(F.collect_set("label")).alias("classes"), F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("width"))
    facts = cut_lineage(facts.withColumn("blocks", F.ceil(F.col("n") * (F.col("width") + 1) / cells).cast("int")))
    placed = listed.join(broadcast_if_bounded(facts, facts), keys).withColumns({
        "block": F.pmod(F.xxhash64("sample_id"), F.col("blocks")).cast("int"), "y": (F.array_position("classes", F.col("label")) - 1).cast("int")})

    def block(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("sample_id", kind="stable")
        x = np.array(frame.x.tolist(), np.float64).reshape(len(frame), -1)
        first = frame.iloc[0]
        return pd.DataFrame([{**{k: first[k] for k in keys}, "block": first.block, "width": x.shape[1], "classes": first.classes, "ids": frame.sample_id.tolist(),
                              "y": frame.y.to_numpy(np.int32).tobytes(), "fold": frame.fold.to_numpy(np.int32).tobytes(), "x": x.tobytes()}])

    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    return cut_lineage(placed.drop("blocks", "n", "width", "label").groupBy(*keys, "block").applyInPandas(block, f"{kinds}, {BLOCK}"))


def class_counts(blocks: DataFrame, folds: Sequence[int]) -> DataFrame:
    """(cohort, seed, held, present): which classes have rows outside the fold `held`, for each of `folds`."""
    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = []
            for r in frame.itertuples():
                y, fold = np.frombuffer(r.y, np.int32), np.frombuffer(r.fold, np.int32)
                found += [(r.cohort, r.seed, f, c, len(r.classes)) for f in folds for c in np.unique(y[fold != f]).tolist()]
            yield pd.DataFrame(found, columns=["cohort", "seed", "held", "c", "k"])

    seen = blocks.select(*GROUP, "classes", "y", "fold").mapInPandas(count, "cohort string, seed int, held int, c int, k int")
    sets = seen.groupBy(*GROUP, "held").agg(F.collect_set("c").alias("seen"), F.max("k").alias("k"))
    return sets.select(*GROUP, "held", F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda c: F.array_contains("seen", c)).alias("present"))


def starting(fits: DataFrame, counts: DataFrame) -> DataFrame:
    """States at the weights `at` (by class: the intercept and each column's), or at zero without that column, for (cohort, seed, fit, held, columns, l2, strengths), `fit` counted from 0 in a group; without L1 `strengths` is [0]."""
    nothing = F.lit(None)
    kinds = {f.name: f.dataType for f in T._parse_datatype_string(STATE).fields}
    found = fits.join(counts, [*GROUP, "held"]).withColumns({
        "at": F.col("at") if "at" in fits.columns else nothing, "best": nothing, "move": nothing, "step": F.lit(1.0), "goal": F.lit(float("inf")),
        "rounds": F.lit(0), "done": F.lit(False), "path": F.array()})
    return found.select(*(F.col(c).cast(k).alias(c) for c, k in kinds.items()))


def _inputs(x: np.ndarray, columns) -> np.ndarray:
    """A column of ones and the chosen columns."""
    return np.hstack([np.ones((len(x), 1)), x[:, np.asarray(columns, int)]])


def _chances(z: np.ndarray, weights: np.ndarray, present: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(logits, log of the normaliser by row, probabilities); a class without rows to be fitted on has none."""
    logits = z @ weights.T
    logits[:, ~present] = -np.inf
    top = logits.max(axis=1)
    p = np.exp(logits - top[:, None])
    total = p.sum(axis=1)
    return logits, np.log(total) + top, p / total[:, None]


def sums(x: np.ndarray, y: np.ndarray, columns, weights: np.ndarray, present: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Loss, gradient by class and chosen column, Hessian, gradient by class and any column, over rows that a fit is fitted on."""
    k, d = weights.shape
    loss, gradient, hessian, every = 0.0, np.zeros((k, d)), np.zeros((k * d, k * d)), np.zeros((k, x.shape[1]))
    rows = max(1, SLICE_CELLS // (k * d))
    for start in range(0, len(y), rows):
        part, labels = x[start:start + rows], y[start:start + rows]
        z = _inputs(part, columns)
        logits, level, p = _chances(z, weights, present)
        loss += float((level - logits[np.arange(len(labels)), labels]).sum())
        off = p.copy()
        off[np.arange(len(labels)), labels] -= 1
        mixed = (p[:, :, None] * z[:, None, :]).reshape(len(labels), k * d)
        hessian -= mixed.T @ mixed
        for c in range(k):
            hessian[c * d:(c + 1) * d, c * d:(c + 1) * d] += (p[:, c, None] * z).T @ z
        gradient += off.T @ z
        every += off.T @ part
    return loss, gradient, hessian, every


def _met(blocks: DataFrame, fits: DataFrame, columns: list[str], size: int) -> DataFrame:
    """Every block with the fits of its group, a bounded number of them in a row; the fits, of `size` bytes, go to the blocks if they can."""
    packed = fits.groupBy(*GROUP, F.floor(F.col("fit") / SLOT).alias("slot")).agg(F.collect_list(F.struct("fit", *columns)).alias("fits"))
    return blocks.drop("ids", "block").join(F.broadcast(packed) if size <= broadcast_limit(fits.sparkSession) else packed, GROUP)


def _arrays(r) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(r.x).reshape(-1, r.width), np.frombuffer(r.y, np.int32), np.frombuffer(r.fold, np.int32)


def _totals(blocks: DataFrame, waiting: DataFrame, size: int, whole: bool) -> DataFrame:
    """(KEYS, loss, gradient, hessian, every): sums over the blocks of a task, for fits of `size` bytes in all."""
    met = _met(blocks, waiting, ["held", "present", "columns", "at"], size)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, list] = {}
        size = 0

        def out() -> pd.DataFrame:
            return pd.DataFrame([(*key, v[0], v[1].tobytes(), v[2].tobytes(), v[3].tobytes() if whole else None) for key, v in held.items()],
                                columns=[*KEYS, "loss", "gradient", "hessian", "every"])

        for frame in frames:
            for r in frame.itertuples():
                x, y, fold = _arrays(r)
                last = None
                for fit in sorted(r.fits, key=lambda f: f["held"]):  # one copy of the rows at a time
                    if fit["held"] != last:
                        last, rows = fit["held"], fold != fit["held"]
                        part, labels = x[rows], y[rows]
                    present, d = np.array(fit["present"], bool), len(fit["columns"]) + 1
                    weights = np.zeros((len(present), d)) if fit["at"] is None else np.array(fit["at"], np.float64).reshape(-1, d)
                    found = sums(part, labels, fit["columns"], weights, present)
                    key = (r.cohort, r.seed, fit["fit"])
                    if key in held:
                        held[key] = [a + b for a, b in zip(held[key], found)]
                    else:
                        held[key] = list(found)
                        size += 8 * (found[1].size + found[2].size + found[3].size * whole)
                if size > HELD_BYTES:
                    yield out()
                    held, size = {}, 0
        if held:
            yield out()

    return met.mapInPandas(run, "cohort string, seed int, fit bigint, loss double, gradient binary, hessian binary, every binary")


def _lasso_move(weights: np.ndarray, gradient: np.ndarray, hessian: np.ndarray, penalty: np.ndarray, present: np.ndarray, tries: int = 60) -> np.ndarray:
    """The step to the minimum of the quadratic model plus penalty * |weight|.

    A few sweeps over the coordinates find which weights are not zero, and their signs; with those the minimum is a linear
    system. Its solution is taken as far as no weight changes its sign, and the sweeps go on from there until nothing moves.
    One amount added to a column's weights of all classes changes no probability, so that after every sweep the amount is
    taken that makes the penalty least: coordinates alone would creep along this direction.
    """
    w, g = weights.copy(), gradient.copy()
    by_class = w.reshape(len(present), -1)
    inner = np.ix_(present, np.arange(by_class.shape[1]) > 0)
    diagonal = np.diagonal(hessian)
    ordered = np.flatnonzero(diagonal > 1e-14 * (np.abs(diagonal).max() or 1.0))
    first = 0.0
    for n in range(tries):
        largest = 0.0
        for _ in range(3):
            # a weight that is 0 stays it while its slope is below the penalty
            for j in ordered[(w[ordered] != 0) | (np.abs(g[ordered]) > penalty[ordered])]:
                at = w[j] - g[j] / diagonal[j]
                new = np.sign(at) * max(abs(at) - penalty[j] / diagonal[j], 0.0)
                if new != w[j]:
                    change = new - w[j]
                    g += hessian[:, j] * change
                    w[j] = new
                    largest = max(largest, change * change * diagonal[j])
        ranked = np.sort(by_class[present, 1:], axis=0)
        by_class[inner] -= np.clip(0.0, ranked[(len(ranked) - 1) // 2], ranked[len(ranked) // 2])
        first = max(first, largest)
        # far from the minimum the model is not worth more than this
        if largest <= 1e-12 * first or n >= 8 and largest <= 3e-3 * first:
            break
        support = ordered[(w[ordered] != 0) | (penalty[ordered] == 0)]
        part = hessian[np.ix_(support, support)]
        toward = -np.linalg.solve(part + 1e-12 * np.diag(np.diagonal(part)), g[support] + penalty[support] * np.sign(w[support]))
        flips = (penalty[support] > 0) & (w[support] * (w[support] + toward) < 0)
        # all weights that would change their sign stop at 0, if that is lower; else the first one does
        move = np.where(flips, -w[support], toward)
        level = np.abs(w[support] + move) - np.abs(w[support])
        if flips.any() and move @ (g[support] + part @ move / 2) + penalty[support] @ level >= 0:
            share = float((-w[support][flips] / toward[flips]).min())
            stops = flips & (np.abs(w[support] + share * toward) <= 1e-12 * np.abs(toward))
            move = np.where(stops, -w[support], share * toward)
        w[support] += move
        g = gradient + hessian @ (w - weights)
    return w - weights


def advanced(state: dict, loss: float, gradient: np.ndarray, hessian: np.ndarray, every: np.ndarray | None) -> dict:
    """A fit's next state after a round, from the sums at its weights `at`."""
    present, columns = np.array(state["present"], bool), list(map(int, state["columns"]))
    k, d = len(present), len(columns) + 1
    l1 = state["strengths"][0]
    weights = np.zeros(k * d) if state["at"] is None else np.array(state["at"], np.float64)
    slope = np.tile(np.r_[0.0, np.ones(d - 1)], k)  # intercepts are not penalised
    lasso = np.where(slope > 0, l1, 0.0) if np.isfinite(l1) else slope * 0
    goal = loss + state["l2"] / 2 * float(slope @ weights ** 2) + float(lasso @ np.abs(weights))
    new = dict(state, rounds=state["rounds"] + 1)
    tiny = TOLERANCE * (1 + abs(goal))
    if goal > state["goal"] + tiny:  # too far: half of the way
        best, move, step = np.array(state["best"]), np.array(state["move"]), state["step"] / 2
        new.update(at=best + step * move, step=step)
        if step < 1e-9:
            return _settled(dict(new, at=state["best"]), None, True)
        return new if new["rounds"] < ROUNDS else _settled(dict(new, at=state["best"]), every, False)
    g = gradient.ravel() + state["l2"] * slope * weights
    h = hessian + np.diag(state["l2"] * slope)
    h[np.diag_indices(k * d)] += np.where(np.repeat(present, d), 0.0, 1.0)
    at_intercept = np.arange(0, k * d, d)
    h[np.ix_(at_intercept, at_intercept)] += max(1.0, float(np.abs(np.diagonal(hessian)).max())) / k  # equal shifts of all intercepts change nothing
    if lasso.any():
        move = _lasso_move(weights, g, h, lasso, present)
        gain = -float(g @ move) - float(lasso @ (np.abs(weights + move) - np.abs(weights)))
        off = np.where(weights != 0, np.abs(g + lasso * np.sign(weights)), np.maximum(np.abs(g) - lasso, 0))
        # the gradient is a sum over rows, and no more exact than that
        near = off.max() <= max(SLACK * l1, 1e-12 * (1 + abs(goal)))
    else:
        move = -np.linalg.lstsq(h, g, rcond=1e-13)[0] if state["l2"] == 0 else -np.linalg.solve(h, g)
        gain = -float(g @ move) / 2
        near = np.abs(move).max() <= LAST_MOVE * (1 + np.abs(weights).max())
    new.update(best=weights, goal=goal, at=weights)
    # the loss grows with the rows: a gain that is small beside it says little about the weights
    if gain <= tiny and near:
        return _settled(new, every, True)
    if new["rounds"] >= ROUNDS:
        return _settled(new, every, False)
    new.update(move=move, step=1.0, at=weights + move)
    return new


def _settled(state: dict, every: np.ndarray | None, converged: bool) -> dict:
    """After the minimum over the chosen columns: columns that were left out wrongly come in, or the next strength begins."""
    columns, strengths = list(map(int, state["columns"])), list(state["strengths"])
    k, d = len(state["present"]), len(columns) + 1
    weights = np.array(state["at"], np.float64).reshape(k, d)
    l1 = strengths[0]
    pull = np.zeros(0) if every is None else np.abs(every).max(axis=0)  # of every column
    if np.isfinite(l1) and l1 > 0 and converged and every is not None:
        missed = sorted(set(np.flatnonzero(pull > l1 * (1 + 1e-9)).tolist()) - set(columns))
        if missed:
            return dict(_with_columns(state, columns + missed), rounds=0)
    if np.isfinite(l1):
        entry = {"strength": l1, "columns": columns, "weights": weights.ravel().tolist(), "converged": bool(converged)}
        state = dict(state, path=[*state["path"], entry])
    strengths = strengths[1:]
    if not strengths:
        return dict(state, done=True)
    before = l1 if np.isfinite(l1) else float(pull.max(initial=0.0))
    # the sequential strong rule: a column whose gradient is below 2 next - last is unlikely to be chosen at the next strength;
    # where strengths lie far apart, half of the next one keeps the choice small. Wrong guesses come in by the check above
    least = max(2 * strengths[0] - before, strengths[0] / 2)
    used = {c for i, c in enumerate(columns) if weights[:, i + 1].any()}
    wanted = sorted(used | set(np.flatnonzero(pull >= least).tolist())) if every is not None else columns
    return dict(_with_columns(state, wanted), strengths=strengths, goal=float("inf"), rounds=0)


def _with_columns(state: dict, columns: list[int]) -> dict:
    """The same model over other columns; new ones have zero weights."""
    old = {c: i + 1 for i, c in enumerate(map(int, state["columns"]))}
    weights = np.array(state["at"], np.float64).reshape(len(state["present"]), -1)
    moved = np.zeros((len(weights), len(columns) + 1))
    moved[:, 0] = weights[:, 0]
    for i, c in enumerate(columns):
        if c in old:
            moved[:, i + 1] = weights[:, old[c]]
    return dict(state, columns=list(columns), at=moved.ravel(), best=moved.ravel())


def fitted(blocks: DataFrame, states: DataFrame, whole: bool = False, folder: str | None = None) -> DataFrame:
    """All states at their minimum. `whole` computes gradients of every column, which L1 strengths need for their columns.

    One job for each round, however many fits there are; fits that are done take no part. The states of every round are
    written. A `folder` of the caller keeps the last ones: a second call with it goes on after the last whole round.
    """
    spark = states.sparkSession
    base = folder or f"{checkpoint_folder(spark)}/fits-{uuid.uuid4().hex}"
    schema = T._parse_datatype_string(STATE)
    names = [f.name for f in schema.fields]
    rounds = finished_tables(spark, base)
    if rounds:
        number, states = int(rounds[-1]), spark.read.schema(schema).parquet(f"{base}/{rounds[-1]}")
    else:
        number, states = 0, written(states, f"{base}/{0:06d}")
    while True:
        waiting = states.where(~F.col("done"))
        left, size = measured(waiting.select(*KEYS, "held", "present", "columns", "at"))
        if not left:
            break
        totals = _totals(blocks, waiting, size, whole)
        # a state's rows lie side by side: its sums by task, with the state
        met = waiting.join(totals, KEYS).repartition(*KEYS).sortWithinPartitions(*KEYS)

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            key, state, total = None, None, None

            def out() -> list[dict]:
                return [] if state is None else [advanced(state, *total)]

            for frame in frames:
                found = []
                for r in frame.to_dict("records"):
                    gradient, hessian = np.frombuffer(r["gradient"]), np.frombuffer(r["hessian"])
                    part = [r["loss"], gradient, hessian.reshape(len(gradient), -1),
                            np.frombuffer(r["every"]).reshape(len(r["present"]), -1) if whole else None]
                    if (r["cohort"], r["seed"], r["fit"]) == key:
                        total = [a if a is None else a + b for a, b in zip(total, part)]
                    else:
                        found += out()
                        key, total = (r["cohort"], r["seed"], r["fit"]), part
                        state = {n: r[n] for n in names}
                        state["path"] = [p if isinstance(p, dict) else p.asDict() for p in state["path"]]
                yield pd.DataFrame(found, columns=names)
            yield pd.DataFrame(out(), columns=names)

        number += 1
        states = written(states.where("done").unionByName(met.mapInPandas(run, schema)), f"{base}/{number:06d}")
        remove_folder(spark, f"{base}/{number - 1:06d}")
    if folder is None:
        states = cut_lineage(states)
        remove_folder(spark, base)
    return states


def models(states: DataFrame) -> DataFrame:
    """(KEYS, held, present, place, strength, columns, weights, converged), a row for each strength of a fit, `place` from 0."""
    return states.select(*KEYS, "held", "present", F.posexplode("path").alias("place", "p")).select(*KEYS, "held", "present", "place", "p.*")


def confusions(blocks: DataFrame, found: DataFrame) -> DataFrame:
    """(KEYS, place, label, prediction, n) of models on the rows of the fold that each left out."""
    found = cut_lineage(found)
    met = _met(blocks, found, ["place", "held", "present", "columns", "weights"], measured(found)[1])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for r in frame.itertuples():
                x, y, fold = _arrays(r)
                for fit in r.fits:
                    mine = fold == fit["held"]
                    present = np.array(fit["present"], bool)
                    weights = np.array(fit["weights"]).reshape(len(present), -1)
                    p = _chances(_inputs(x[mine], fit["columns"]), weights, present)[0].argmax(axis=1)
                    pairs, n = np.unique(np.stack([y[mine], p]), axis=1, return_counts=True)
                    rows += [(r.cohort, r.seed, fit["fit"], fit["place"], r.classes[a], r.classes[b], c) for (a, b), c in zip(pairs.T, n.tolist())]
            yield pd.DataFrame(rows, columns=[*KEYS, "place", "label", "prediction", "n"])

    schema = "cohort string, seed int, fit bigint, place int, label string, prediction string, n bigint"
    return met.mapInPandas(run, schema).groupBy(*KEYS, "place", "label", "prediction").agg(F.sum("n").alias("n"))


def gradients(blocks: DataFrame, found: DataFrame) -> DataFrame:
    """(KEYS, place, violation): the largest distance of any column's gradient from what an L1 minimum asks for."""
    found = cut_lineage(found)
    met = _met(blocks, found, ["place", "held", "present", "columns", "weights"], measured(found)[1])

    def part(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for r in frame.itertuples():
                x, y, fold = _arrays(r)
                for fit in r.fits:
                    keep = fold != fit["held"]
                    present = np.array(fit["present"], bool)
                    weights = np.array(fit["weights"]).reshape(len(present), -1)
                    off = _chances(_inputs(x[keep], fit["columns"]), weights, present)[2]
                    off[np.arange(keep.sum()), y[keep]] -= 1
                    rows.append((r.cohort, r.seed, fit["fit"], fit["place"], (off.T @ x[keep]).tobytes()))
            yield pd.DataFrame(rows, columns=[*KEYS, "place", "slope"])

    def whole(frame: pd.DataFrame) -> pd.DataFrame:
        first = frame.iloc[0]
        slope = sum(np.frombuffer(s) for s in frame.slope).reshape(len(first.present), -1)
        weights = np.array(first["weights"]).reshape(len(first.present), -1)[:, 1:]
        every = np.zeros_like(slope)
        every[:, np.array(first["columns"], int)] = weights
        off = np.where(every != 0, np.abs(slope + first.strength * np.sign(every)), np.maximum(np.abs(slope) - first.strength, 0))
        return pd.DataFrame([(first.cohort, first.seed, first.fit, first.place, float(off.max(initial=0.0)))], columns=[*KEYS, "place", "violation"])

    parts = met.mapInPandas(part, "cohort string, seed int, fit bigint, place int, slope binary")
    rows = parts.join(found.select(*KEYS, "place", "present", "strength", "columns", "weights"), [*KEYS, "place"])
    return rows.groupBy(*KEYS, "place").applyInPandas(whole, "cohort string, seed int, fit bigint, place int, violation double")
