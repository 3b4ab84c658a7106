"""Exact running totals, ranks and medians over groups of any size.

`Window.partitionBy(key)` puts a whole key into one task. Here a key is first cut into ordered
buckets, every bucket is summed by its own task, and the total of the earlier buckets (a table of
keys x buckets) is added. The result is the same as that of the plain window, which is used when
`buckets` is 1.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from widesift.session import broadcast_if_bounded, cut_lineage

ROWS_PER_BUCKET = 1_000_000
BUCKET = "_bucket"


def buckets_for(rows: int, rows_per_bucket: int = ROWS_PER_BUCKET, most: int = 1024) -> int:
    """Bucket count that keeps one bucket of an evenly cut group near `rows_per_bucket`."""
    return max(1, min(most, math.ceil(rows / rows_per_bucket)))


def with_value_bucket(df: DataFrame, keys: list[str], col: str, buckets: int,
                      cuts_from: DataFrame | None = None) -> DataFrame:
    """Adds `_bucket`, non-decreasing in `col` within each key; equal values share a bucket.

    Cut points come from a mergeable quantile sketch per key. They only balance the work: any cut
    points give the same final result.
    """
    fractions = [i / buckets for i in range(1, buckets)]
    cuts = (cuts_from if cuts_from is not None else df).groupBy(*keys).agg(
        F.percentile_approx(col, fractions, max(1000, 20 * buckets)).alias("_cuts"))
    return (df.join(broadcast_if_bounded(cuts), keys)
            .withColumn(BUCKET, F.size(F.filter("_cuts", lambda c: c < F.col(col))))
            .drop("_cuts"))


def running_total(df: DataFrame, keys: list[str], order: list[Column | str], value: Column, out: str,
                  bucketed: bool = False) -> DataFrame:
    """Adds `out`, the sum of `value` over the rows of the key up to and including this one.

    With `bucketed` the frame must carry a `_bucket` column that agrees with `order`; it is dropped.
    """
    spread = [*keys, BUCKET] if bucketed else keys
    window = Window.partitionBy(*spread).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = df.withColumn(out, F.sum(value).over(window))
    if not bucketed:
        return local
    return (local.join(bucket_offsets(df, keys, value), spread)
            .withColumn(out, F.col(out) + F.col("_before"))
            .drop("_before", BUCKET))


def bucket_offsets(df: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """(keys, _bucket, _before): what the earlier buckets of the key add up to."""
    totals = df.groupBy(*keys, BUCKET).agg(F.sum(value).alias("_total"))
    earlier = (Window.partitionBy(*keys).orderBy(BUCKET)
               .rowsBetween(Window.unboundedPreceding, -1))
    return totals.select(*keys, BUCKET, F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_before"))


def numbered(df: DataFrame, keys: list[str], order: list[Column | str], out: str,
             bucketed: bool = False) -> DataFrame:
    """`row_number()` within the key; see `running_total` for `bucketed`."""
    return running_total(df, keys, order, F.lit(1).cast("long"), out, bucketed)


def medians(df: DataFrame, keys: list[str], col: str, out: str, buckets: int = 1) -> DataFrame:
    """Exact median per key: the middle value, or the midpoint of the two middle values."""
    present = df.where(F.col(col).isNotNull())
    if buckets <= 1:
        return present.groupBy(*keys).agg(F.percentile(col, 0.5).alias(out))
    # one row for each distinct value, however often it occurs; written because the sketch, the sizes and the totals read it
    folded = cut_lineage(present.groupBy(*keys, col).agg(F.count(F.lit(1)).alias("_n")))
    cut = with_value_bucket(folded, keys, col, buckets)
    sizes = folded.groupBy(*keys).agg(F.sum("_n").alias("_size"))
    # the group size travels with the bucket offsets, so that the rows never meet under the key alone
    offsets = bucket_offsets(cut, keys, F.col("_n")).join(sizes, keys)
    spread = [*keys, BUCKET]
    upto = F.sum("_n").over(Window.partitionBy(*spread).orderBy(col).rowsBetween(Window.unboundedPreceding, 0))
    low, high = F.floor((F.col("_size") + 1) / 2), F.floor(F.col("_size") / 2) + 1
    return (cut.withColumn("_upto", upto).join(offsets, spread)
            .withColumn("_upto", F.col("_upto") + F.col("_before"))
            .where((F.col("_upto") >= low) & (F.col("_upto") - F.col("_n") < high))
            .groupBy(*keys).agg(F.avg(col).alias(out)))
