"""Positions in a global order without a global sort in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxcohort.session import attach, fits_broadcast, join_summary, settle


#: Bits of an order value that one level of running sums covers; a sum sees at most 2^16 rows.
LEVEL = 16

#: A group of at most this many rows is ranked in one window.
WHOLE_ROWS = 1 << 16


def running_position(df: DataFrame, order: str, weight: Column | None = None, name: str = "position") -> DataFrame:
    """Sum of the weights (by default: number) of all rows with a smaller ``order``.

    ``order`` is a unique non-negative bigint. Its bits form four levels of buckets. Sums are gathered upwards and offsets handed
    down, so each running sum sees the at most 65536 buckets (or rows) below one bucket, and no task more.
    """
    w = F.lit(1).cast("long") if weight is None else weight
    levels = range(1, 64 // LEVEL)
    tagged = df.withColumns({"_w": w} | {f"_b{k}": F.shiftright(order, LEVEL * k) for k in levels} | {f"_b{len(levels) + 1}": F.lit(0).cast("long")})

    def before(above: str, by: str) -> Column:
        window = Window.partitionBy(above).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum("_s").over(window), F.lit(0).cast("long"))

    buckets = [f"_b{k}" for k in levels]
    sums = {"_b1": settle(tagged.groupBy(*buckets, f"_b{len(levels) + 1}").agg(F.sum("_w").alias("_s")))}
    for lower, upper in zip(buckets, buckets[1:]):
        above = [b for b in sums[lower].columns if b not in (lower, "_s")]
        sums[upper] = sums[lower].groupBy(*above).agg(F.sum("_s").alias("_s"))
    starts = None
    for k in reversed(levels):
        own, above = f"_b{k}", f"_b{k + 1}"
        placed = sums[own].withColumn("_o", before(above, own))
        if starts is not None:
            placed = placed.join(starts, above).withColumn("_o", F.col("_o") + F.col("_start"))
        starts = placed.select(own, F.col("_o").alias("_start"))
    here = Window.partitionBy("_b1").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    local = F.coalesce(F.sum("_w").over(here), F.lit(0))
    placed = attach(tagged, starts, ["_b1"]).withColumn(name, F.col("_start") + local)
    return placed.drop("_w", *[f"_b{k}" for k in range(1, len(levels) + 2)], "_start")


def number_lines(lines: DataFrame, name: str = "line") -> DataFrame:
    """Number the lines of a text scan 0, 1, ...: files in the order of their paths, lines as they stand in a file.

    ``lines`` is the scan itself. Spark reads a file in blocks, in any order of files, but numbers the rows of a block in their order. So
    one row a block, with its first number and its size, gives every line its place; blocks are summed by file, files by
    path.
    """
    tagged = lines.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block")).withColumn(
        "_id", F.monotonically_increasing_id())
    blocks = settle(tagged.groupBy("_file", "_block").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n")))
    # one row a file
    earlier = Window.partitionBy(F.lit(0)).orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    begins = blocks.groupBy("_file").agg(F.sum("_n").alias("_lines")).select("_file", F.coalesce(F.sum("_lines").over(earlier), F.lit(0)).alias("_begin"))
    within = F.coalesce(F.sum("_n").over(Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = blocks.withColumn("_within", within).join(begins, "_file").select("_file", "_block", (F.col("_begin") + F.col("_within") - F.col("_first")).alias("_shift"))
    return attach(tagged, starts, ["_file", "_block"]).withColumn(name, F.col("_id") + F.col("_shift")).drop("_id", "_file", "_block", "_shift")


def large_groups(df: DataFrame, keys: list[str], whole_rows: int) -> DataFrame:
    """Keys of the groups of over ``whole_rows`` rows, of which there are few for their rows; stored."""
    return settle(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > whole_rows).select(*keys))


def rank_in_group(df: DataFrame, keys: list[str], value: str, tie: str, bins: int = 1024, name: str = "rank",
                  whole_rows: int = WHOLE_ROWS) -> DataFrame:
    """0-based rank by ``value`` and ``tie`` within each group.

    Groups of at most ``whole_rows`` rows are ranked as they are. The value range of a larger one is cut into equal bins that are
    ranked on their own, plus the row count of the bins before; so the rows of a hot group are spread over its bins.
    """
    large = large_groups(df, keys, whole_rows)
    whole = (F.row_number().over(Window.partitionBy(*keys).orderBy(value, tie)) - 1).cast("long")
    if large.isEmpty():
        return df.withColumn(name, whole)
    small = fits_broadcast(large)
    rest = join_summary(df, large, keys, "left_anti", small).withColumn(name, whole)
    return rest.unionByName(_rank_by_bins(join_summary(df, large, keys, "left_semi", small), keys, value, tie, bins, name))


def _rank_by_bins(df: DataFrame, keys: list[str], value: str, tie: str, bins: int, name: str) -> DataFrame:
    bounds = df.groupBy(*keys).agg(F.min(value).alias("_low"), F.max(value).alias("_high"))
    width = F.col("_high") - F.col("_low")
    place = F.when(width > 0, F.least(F.floor((F.col(value) - F.col("_low")) / width * bins), F.lit(bins - 1)))
    binned = attach(df, bounds, keys).withColumn("_bin", F.coalesce(place, F.lit(0))).drop("_low", "_high")
    sizes = binned.groupBy(*keys, "_bin").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select(*keys, "_bin", F.coalesce(before, F.lit(0)).alias("_start"))
    local = F.row_number().over(Window.partitionBy(*keys, "_bin").orderBy(value, tie)) - 1
    return attach(binned, starts, [*keys, "_bin"]).withColumn(name, F.col("_start") + local).drop("_bin", "_start")
