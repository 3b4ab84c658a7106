"""Imputation, scaling and vector assembly, always fitted on training rows."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import StructField, StructType

from widesift.operators import ranking
from widesift.session import broadcast_if_bounded, cut_lineage

KEYS = ["cohort", "seed", "feature"]
FILL_CHUNKS = 32
#: training cells of a task that orders them by feature, if no feature has more
CELLS_PER_TASK = 200_000
#: features that one task numbers
FEATURES_PER_TASK = 1_000_000
VECTOR = StructType([StructField("v", VectorUDT())])


def train_cells(matrix: DataFrame, splits: DataFrame, part: str = "train") -> DataFrame:
    """(cohort, seed, sample_id, label, feature, value) of one part of every seed's split.

    The cells are shuffled once, by (cohort, seed, feature), so that groups by these need no further shuffle. There are as many
    partitions as the counted cells ask for: a number that follows from compressed bytes lets a task hold ever more rows.
    """
    rows = splits.where(F.col("part") == part).select("cohort", "sample_id", "seed", "label")
    if "seed" in matrix.columns:
        cells = matrix.join(broadcast_if_bounded(rows, rows_from=splits), ["cohort", "seed", "sample_id"])
    else:
        seeds = rows.groupBy("cohort", "sample_id", "label").agg(F.collect_list("seed").alias("_seeds"))
        cells = matrix.join(broadcast_if_bounded(seeds), ["cohort", "sample_id"]).withColumn("seed", F.explode("_seeds")).drop("_seeds")
    return cells.repartition(ranking.buckets_for(cells.count(), CELLS_PER_TASK, most=1 << 15), *KEYS)


def train_medians(matrix: DataFrame, splits: DataFrame, buckets: int = 1) -> DataFrame:
    """(cohort, seed, feature, fill): exact training medians. A feature without training values has none."""
    return ranking.medians(train_cells(matrix, splits), KEYS, "value", "fill", buckets)


def median_impute(matrix: DataFrame, splits: DataFrame, fill: DataFrame) -> DataFrame:
    """Dense cells per seed: every sample x every feature of `fill`, gaps filled with the median.

    The output is as large as it sounds, so restrict `fill` to the features that are needed. Scores need
    no dense matrix at all; see `moments.feature_moments`. The features of a cohort and seed are kept in
    FILL_CHUNKS lists, and a sample meets each list under its own key, so that the expansion of one
    cohort is spread over many tasks.
    """
    keys = ["cohort", "seed", "_chunk"]
    lists = (fill.withColumn("_chunk", F.pmod(F.hash("feature"), F.lit(FILL_CHUNKS)))
             .groupBy(*keys).agg(F.collect_list(F.struct("feature", "fill")).alias("_fills")))
    rows = splits.select("cohort", "seed", "sample_id", "part",
                         F.explode(F.sequence(F.lit(0), F.lit(FILL_CHUNKS - 1))).alias("_chunk"))
    grid = rows.join(broadcast_if_bounded(lists), keys).select("cohort", "seed", "sample_id", "part", F.inline("_fills"))
    return (grid.join(matrix, ["cohort", "sample_id", "feature"], "left")
            .select("cohort", "seed", "sample_id", "part", "feature",
                    F.coalesce("value", "fill").alias("value"), F.col("value").isNull().alias("imputed")))


def scaling(feature_moments: DataFrame) -> DataFrame:
    """(cohort, seed, feature, centre, spread); a constant feature is only centred."""
    deviation = F.sqrt((F.col("between") + F.col("within")) / F.col("n"))
    return feature_moments.select(*KEYS, F.col("mean").alias("centre"),
                                  F.when(F.col("hi") > F.col("lo"), deviation).otherwise(1.0).alias("spread"))


def standard_scale(cells: DataFrame, feature_moments: DataFrame, centred: bool = True) -> DataFrame:
    """Adds seed and `scaled` to cells (cohort, sample_id, feature, value); train and test rows alike.

    Without centring a zero stays a zero, so that implicit zeros need no cells; a model with a free intercept is the same.
    """
    on = KEYS if "seed" in cells.columns else ["cohort", "feature"]
    shifted = F.col("value") - F.col("centre") if centred else F.col("value")
    return (cells.join(broadcast_if_bounded(scaling(feature_moments)), on)
            .withColumn("scaled", shifted / F.col("spread"))
            .drop("centre", "spread"))


def positions(features: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, feature, pos, width): place of each feature, in feature order, in the vectors of its feature set.

    A long list of features is cut into ranges that are numbered by their own tasks, since a set may have as many as a text has words.
    """
    named = cut_lineage(features.select(*keys, "feature").distinct())
    buckets = ranking.buckets_for(named.count(), FEATURES_PER_TASK)
    if buckets <= 1:
        of_set = Window.partitionBy(*keys)
        return named.withColumns({"pos": F.row_number().over(of_set.orderBy("feature")) - 1, "width": F.count("*").over(of_set).cast("int")})
    # written, so that the ranges are the same for the numbers and for the sizes of the ranges before
    cut = cut_lineage(named.repartitionByRange(buckets, *keys, "feature").withColumn(ranking.BUCKET, F.spark_partition_id()))
    widths = cut.groupBy(*keys).agg(F.count("*").cast("int").alias("width"))
    return ranking.numbered(cut, keys, ["feature"], "_n", bucketed=True).join(broadcast_if_bounded(widths), keys).select(
        *keys, "feature", (F.col("_n") - 1).cast("int").alias("pos"), "width")


def assemble(cells: DataFrame, keys: list[str], value: str = "scaled", features: DataFrame | None = None, rows: DataFrame | None = None,
             gaps: str = "error") -> DataFrame:
    """One `features` vector per key: every feature at its place, whatever cells are there.

    keys are the keys of a feature set and those of a sample. `features` lists the feature sets (by default the features that
    occur in the cells, one set for everything), `rows` the samples that get a vector (by default those with a cell). A cell that
    is absent or null is a gap: `gaps` says whether that is an error when the vector is made, or a zero, in which case vectors
    are sparse.
    """
    if gaps not in ("error", "zero"):
        raise ValueError(f"gaps is 'error' or 'zero', not {gaps!r}")
    set_keys = [k for k in keys if features is not None and k in features.columns]
    if features is None:
        features = cells
    if set_keys:
        places = positions(features, set_keys)
    else:
        places = positions(features.withColumn("_one", F.lit(1)), ["_one"]).drop("_one")
    widths = places.select(*set_keys, "width").distinct()
    placed = cells.where(F.col(value).isNotNull()).join(broadcast_if_bounded(places.drop("width")), [*set_keys, "feature"])
    lists = placed.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("pos", F.col(value).cast("double").alias("value")))).alias("_cells"))
    if rows is not None:
        lists = rows.select(*keys).distinct().join(lists, keys, "left")
    widths = broadcast_if_bounded(widths)
    sized = lists.join(widths, set_keys) if set_keys else lists.crossJoin(widths)  # a single row
    filled = sized.withColumn("_cells", F.coalesce("_cells", F.array().cast("array<struct<pos:int,value:double>>")))
    values = F.transform("_cells", lambda s: s["value"])
    if gaps == "error":
        missing = F.concat(F.lit("a sample has "), F.size("_cells").cast("string"), F.lit(" of "), F.col("width").cast("string"), F.lit(" features"))
        vector = F.when(F.size("_cells") == F.col("width"), array_to_vector(values)).otherwise(
            F.from_json(F.raise_error(missing).cast("string"), VECTOR)["v"])
    else:
        # the JVM's own way from plain columns to a sparse vector
        plain = F.struct(F.lit(0).cast("byte").alias("type"), F.col("width").alias("size"), F.transform("_cells", lambda s: s["pos"]).alias("indices"),
                         values.alias("values"))
        vector = F.from_json(F.to_json(F.struct(plain.alias("v"))), VECTOR)["v"]
    return filled.select(*keys, vector.alias("features"))
