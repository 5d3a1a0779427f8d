"""Descriptive statistics of a value column per group.

Everything that one pass can give (moments, extremes, energy) is a plain aggregate with map-side
combination. Order statistics are exact and never sort a group in one task: see ``select_ranks``.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxcohort.session import attach, fits_broadcast, join_summary, settle

IMAGE = ["image_id"]
BINS = 1024
WALK_ROWS = 1_000_000


# --- one-pass aggregate expressions -----------------------------------------------------------

def _ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def minimum(v: Column) -> Column:
    return F.min(v)


def maximum(v: Column) -> Column:
    return F.max(v)


def total(v: Column) -> Column:
    return F.sum(v)


def mean(v: Column) -> Column:
    return F.avg(v)


def variance(v: Column) -> Column:
    return F.var_samp(v)


def std_dev(v: Column) -> Column:
    return F.stddev_samp(v)


def skewness(v: Column) -> Column:
    """Mean cubed z-score with the sample deviation; the built-in uses the population deviation."""
    n = F.count(v)
    return F.skewness(v) * F.pow((n - 1) / n, F.lit(1.5))


def kurtosis(v: Column) -> Column:
    """Mean fourth power of the z-score, not the excess."""
    n = F.count(v)
    return (F.kurtosis(v) + 3) * F.pow((n - 1) / n, F.lit(2))


def value_range(v: Column) -> Column:
    return F.max(v) - F.min(v)


def studentized_range(v: Column) -> Column:
    """Range over the variance. The name suggests the deviation; downstream numbers use the variance."""
    return _ratio(F.max(v) - F.min(v), F.var_samp(v))


def coef_variation(v: Column) -> Column:
    return _ratio(F.stddev_samp(v), F.avg(v))


def energy(v: Column) -> Column:
    return F.sum(v * v)


def rms(v: Column) -> Column:
    return F.sqrt(F.avg(v * v))


def moments(df: DataFrame, keys: Sequence[str] = IMAGE, value: str = "value") -> DataFrame:
    """All one-pass statistics of each group in a single aggregate."""
    v = F.col(value)
    named = {"minimum": minimum, "maximum": maximum, "total": total, "mean": mean, "variance": variance,
             "std_dev": std_dev, "skewness": skewness, "kurtosis": kurtosis, "value_range": value_range,
             "studentized_range": studentized_range, "coef_variation": coef_variation, "energy": energy, "rms": rms}
    return df.groupBy(*keys).agg(F.count(v).alias("n"), *[f(v).alias(n) for n, f in named.items()])


# --- exact order statistics -------------------------------------------------------------------

def value_counts(df: DataFrame, keys: Sequence[str] = IMAGE, value: str = "value") -> DataFrame:
    return df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("value")).agg(
        F.count(F.lit(1)).alias("count"))


def select_ranks(df: DataFrame, ranks: Mapping[str, Callable[[Column], Column]], keys: Sequence[str] = IMAGE,
                 value: str = "value", bins: int = BINS, walk_rows: int | None = None) -> DataFrame:
    """Values at given 0-based positions of each sorted group, one column per name.

    ``ranks`` maps a name to a function of the group size n. While a range that holds a wanted position
    has more than ``walk_rows`` rows, it is split into equal bins: the bins are counted map-side, a
    running sum over at most ``bins`` rows finds the bin of the position, and only that bin is kept,
    with the bounds of the finite values that are really in it. What is left is walked distinct value
    by distinct value. Rows are never shuffled before they are reduced, and as binning is monotone the
    result is exact for every distribution. Only row counts reach the driver.

    -Infinity comes first, Infinity after all finite values and NaN last; each of them has a bin of its
    own. Every split leaves the least and the greatest finite value in different bins, so it ends.
    """
    limit = WALK_ROWS if walk_rows is None else walk_rows
    key = list(keys)
    rows = df.where(F.col(value).isNotNull()).select(*key, F.col(value).alias("value"))
    wanted = F.array(*[F.struct(F.lit(name).alias("name"), rank(F.col("n")).cast("long").alias("rank"))
                       for name, rank in ranks.items()])
    as_double = F.col("value").cast("double")
    finite = F.when(~F.isnan(as_double) & (F.abs(as_double) < float("inf")), F.col("value"))
    spans = settle(rows.groupBy(*key).agg(F.count("value").alias("n"), F.min(finite).alias("low"), F.max(finite).alias("high"))
                   .select(*key, "low", "high", "n", wanted.alias("wanted")))
    # later rounds have at most one row per group and name
    small = fits_broadcast(spans)
    while not spans.where((F.col("n") > limit) & (F.col("low") < F.col("high"))).isEmpty():
        name = f"_bin{len(key) - len(keys)}"
        low, high = F.col("low").cast("double") / 2, F.col("high").cast("double") / 2  # halves, so that a difference cannot overflow
        within = F.least(F.floor((as_double / 2 - low) / (high - low) * bins), F.lit(bins - 1))
        place = (F.when(F.isnan(as_double), bins + 1).when(as_double == float("inf"), bins).when(as_double == float("-inf"), -1)
                 .when(high > low, within))
        bounds = spans.select(*key, "low", "high")
        binned = join_summary(rows, bounds, key, "inner", small).select(*key, F.coalesce(place, F.lit(0)).alias(name), "value")
        filled = binned.groupBy(*key, name).agg(F.count(F.lit(1)).alias("n"), F.min(finite).alias("low"), F.max(finite).alias("high"))
        running = Window.partitionBy(*key).orderBy(name).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        placed = join_summary(filled, spans.select(*key, "wanted"), key, "inner", small).withColumn(
            "before", F.sum("n").over(running) - F.col("n"))
        here = F.filter("wanted", lambda w: (w["rank"] >= F.col("before")) & (w["rank"] < F.col("before") + F.col("n")))
        shifted = F.transform(here, lambda w: F.struct(w["name"].alias("name"), (w["rank"] - F.col("before")).alias("rank")))
        spans = settle(placed.select(*key, name, "low", "high", "n", shifted.alias("wanted")).where(F.size("wanted") > 0))
        key = [*key, name]
        rows = join_summary(binned, spans.select(*key), key, "inner", small)
    counts = rows.groupBy(*key, "value").agg(F.count(F.lit(1)).alias("count"))
    walk = Window.partitionBy(*key).orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = counts.withColumn("end", F.sum("count").over(walk))
    found = join_summary(ends, spans.select(*key, "wanted"), key, "inner", small).withColumn("w", F.explode("wanted")).where(
        (F.col("w.rank") < F.col("end")) & (F.col("w.rank") >= F.col("end") - F.col("count")))
    return found.groupBy(*keys).agg(*[F.max(F.when(F.col("w.name") == n, F.col("value"))).alias(n) for n in ranks])


def percentile_rank(percent: float) -> Callable[[Column], Column]:
    """Position floor(p * n / 100) of the sorted values; the minimum below one percent."""
    if percent < 1:
        return lambda n: F.lit(0)
    return lambda n: F.least(F.floor(F.lit(float(percent)) * n / 100), n - 1)


def nth_percentile(df: DataFrame, percents: Mapping[str, float], keys: Sequence[str] = IMAGE,
                   value: str = "value") -> DataFrame:
    return select_ranks(df, {name: percentile_rank(p) for name, p in percents.items()}, keys, value)


def median(df: DataFrame, keys: Sequence[str] = IMAGE, value: str = "value") -> DataFrame:
    """Middle value, or the mean of the two middle values."""
    middle = select_ranks(df, {"lower": lambda n: F.floor((n - 1) / 2), "upper": lambda n: F.floor(n / 2)}, keys, value)
    return middle.select(*keys, ((F.col("lower") + F.col("upper")) / 2).alias("median"))


def mode(df: DataFrame, keys: Sequence[str] = IMAGE, value: str = "value") -> DataFrame:
    """Most frequent value; equal frequencies go to the smallest value."""
    counts = value_counts(df, keys, value)
    return counts.groupBy(*keys).agg(F.max_by("value", F.struct(F.col("count"), -F.col("value"))).alias("mode"))


def quartiles(df: DataFrame, keys: Sequence[str] = IMAGE, value: str = "value") -> DataFrame:
    """Interquartile range and quartile dispersion."""
    q = nth_percentile(df, {"p25": 25, "p75": 75}, keys, value)
    gap, both = F.col("p75") - F.col("p25"), F.col("p75") + F.col("p25")
    return q.select(*keys, gap.alias("iqr"), _ratio(gap, both).alias("quartile_dispersion"))


def _deviation(df: DataFrame, centre: DataFrame, column: str, keys: list[str], value: str, legacy: bool, name: str) -> DataFrame:
    difference = F.col(value) - F.col(column)
    joined = attach(df, centre, keys)
    return joined.groupBy(*keys).agg(F.avg(difference if legacy else F.abs(difference)).alias(name))


def mean_abs_deviation(df: DataFrame, keys: Sequence[str] = IMAGE, value: str = "value", legacy: bool = False) -> DataFrame:
    """Mean absolute distance from the mean; ``legacy`` leaves out the absolute value."""
    centre = df.groupBy(*keys).agg(F.avg(value).alias("_centre"))
    return _deviation(df, centre, "_centre", list(keys), value, legacy, "mean_abs_deviation")


def median_abs_deviation(df: DataFrame, keys: Sequence[str] = IMAGE, value: str = "value", legacy: bool = False) -> DataFrame:
    """Mean absolute distance from the median; ``legacy`` leaves out the absolute value."""
    centre = median(df, keys, value).withColumnRenamed("median", "_centre")
    return _deviation(df, centre, "_centre", list(keys), value, legacy, "median_abs_deviation")


def robust_mad(df: DataFrame, low: float = 10, high: float = 90, keys: Sequence[str] = IMAGE,
               value: str = "value") -> DataFrame:
    """Mean absolute deviation of the values between two percentiles from their own mean."""
    limits = nth_percentile(df, {"_low": low, "_high": high}, keys, value)
    kept = attach(df, limits, list(keys)).where(F.col(value).between(F.col("_low"), F.col("_high")))
    return mean_abs_deviation(kept, keys, value).withColumnRenamed("mean_abs_deviation", "robust_mad")


def zscores(df: DataFrame, keys: Sequence[str] = IMAGE, value: str = "value", name: str = "zscore") -> DataFrame:
    stats = df.groupBy(*keys).agg(F.avg(value).alias("_mean"), F.stddev_samp(value).alias("_std"))
    joined = attach(df, stats, list(keys))
    return joined.withColumn(name, _ratio(F.col(value) - F.col("_mean"), F.col("_std"))).drop("_mean", "_std")


# --- counts and sets --------------------------------------------------------------------------

def unique_values(df: DataFrame, keys: Sequence[str] = IMAGE, value: str = "value", sort: bool = False) -> DataFrame:
    found = df.select(*keys, value).distinct()
    return found.orderBy(*keys, value) if sort else found


def unique_elements(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()


def label_counts(labelmap: DataFrame, keys: Sequence[str] = IMAGE, label: str = "label") -> DataFrame:
    return labelmap.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("voxels"))


def same_label_set(a: DataFrame, b: DataFrame, keys: Sequence[str] = IMAGE, label: str = "label") -> DataFrame:
    """Whether two label maps of a group hold exactly the same labels."""
    seen = a.select(*keys, label, F.lit(1).alias("side")).unionByName(b.select(*keys, label, F.lit(2).alias("side")))
    sides = seen.groupBy(*keys, label).agg(F.min("side").alias("first"), F.max("side").alias("last"))
    return sides.groupBy(*keys).agg(F.bool_and((F.col("first") == 1) & (F.col("last") == 2)).alias("same"))


def population_mask(images: DataFrame, group: str = "modality", value: str = "value") -> DataFrame:
    """Coordinates whose values sum to more than 0 over all images of a modality."""
    summed = images.groupBy(group, "x", "y", "z").agg(F.sum(value).alias("total"))
    return summed.where(F.col("total") > 0).select(group, "x", "y", "z", F.lit(1).alias("mask"))


def column_means(df: DataFrame, features: str = "features", keys: Sequence[str] = ()) -> DataFrame:
    """Mean of each vector component, one row per component."""
    parts = df.select(*keys, F.posexplode(features).alias("feature", "value"))
    return parts.groupBy(*keys, "feature").agg(F.avg("value").alias("mean"))


def field_norms(df: DataFrame, keys: Sequence[str] = IMAGE, value: str = "value") -> DataFrame:
    v = F.col(value)
    return df.groupBy(*keys).agg(F.sum(v).alias("voxel_sum"), F.sum(v * v).alias("squared_norm"),
                                 F.min(v).alias("minimum"), F.max(v).alias("maximum"))


def vector_norms(df: DataFrame, keys: Sequence[str] = IMAGE, vector: str = "vector") -> DataFrame:
    length = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda acc, v: acc + v * v))
    return df.groupBy(*keys).agg(F.min(length).alias("shortest"), F.max(length).alias("longest"))


def inner_product(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda acc, v: acc + v)


# --- class agreement --------------------------------------------------------------------------

def confusion(df: DataFrame, real: str, predicted: str, keys: Sequence[str] = (), positive: int = 1) -> DataFrame:
    """TP, FP, TN, FN, RP, PP. Any equal pair other than the positive class counts as TN."""
    r, p = F.col(real), F.col(predicted)
    flags = {"tp": (r == positive) & (p == positive), "tn": (r == p) & (r != positive),
             "fn": (r == positive) & (p != positive), "fp": (r != positive) & (r != p),
             "rp": r == positive, "pp": p == positive}
    return df.groupBy(*keys).agg(*[F.count_if(c).alias(n) for n, c in flags.items()])


def roc_columns(legacy: bool = False) -> dict[str, Column]:
    """Rates over the columns of ``confusion``. ``legacy`` gives the FDR, prevalence and Jaccard variants."""
    c = {n: F.col(n).cast("double") for n in ("tp", "fp", "tn", "fn", "rp", "pp")}
    n = c["tp"] + c["fp"] + c["tn"] + c["fn"]
    rn, pn = c["tn"] + c["fp"], c["tn"] + c["fn"]
    tpr, fpr = _ratio(c["tp"], c["rp"]), _ratio(c["fp"], rn)
    fnr, tnr = _ratio(c["fn"], c["rp"]), _ratio(c["tn"], rn)
    ppv = _ratio(c["tp"], c["pp"])
    overlap = c["tp"] + c["fp"] + c["fn"]
    plus, minus = _ratio(tpr, fpr), _ratio(fnr, tnr)
    return {
        "accuracy": _ratio(c["tp"] + c["tn"], n), "precision": ppv,
        "fdr": ppv if legacy else _ratio(c["fp"], c["pp"]),
        "for": _ratio(c["fn"], pn), "npv": _ratio(c["tn"], pn),
        "prevalence": _ratio(c["rp"], 2 * n if legacy else n),
        "sensitivity": tpr, "fall_out": fpr, "miss_rate": fnr, "specificity": tnr,
        "lr_plus": plus, "lr_minus": minus, "dor": _ratio(plus, minus),
        "dice": _ratio(2 * c["tp"], 2 * c["tp"] + c["fp"] + c["fn"]),
        "jaccard": _ratio((2 if legacy else 1) * c["tp"], overlap),
    }


def roc_values(counts: DataFrame, keys: Sequence[str] = (), legacy: bool = False) -> DataFrame:
    return counts.select(*keys, *[c.alias(n) for n, c in roc_columns(legacy).items()])
