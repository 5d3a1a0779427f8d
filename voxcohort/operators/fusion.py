"""Fusion of several label maps of one image into one."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxcohort.session import attach, fits_broadcast, join_summary, settle

IMAGE = ["image_id"]
XYZ = ["x", "y", "z"]


def fusion_inputs(files: DataFrame, path: str = "path") -> DataFrame:
    """Label maps of single architectures: every file whose name has neither "final" nor "fused"."""
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    return files.where(~name.contains("final") & ~name.contains("fused"))


def _counted(entries: Column, label: str) -> Column:
    """(score, -label) of every label among the votes of a voxel, whose number is that of the raters."""
    same = lambda v: F.filter(entries, lambda e: e[label] == v)
    score = lambda v: F.round(F.aggregate(F.transform(same(v), lambda e: e["weight"]), F.lit(0.0), lambda a, w: a + w), 9)
    return F.transform(F.array_distinct(F.transform(entries, lambda e: e[label])), lambda v: F.struct(score(v).alias("score"), (-v).alias("order"), v.alias(label)))


def weighted_vote(maps: DataFrame, weights: DataFrame, keys: Sequence[str] = IMAGE, label: str = "label") -> DataFrame:
    """Label with the largest summed rater weight; equal sums go to the lowest label.

    ``weights`` has one ``weight`` per rater, or per image and rater. The votes of a voxel meet once, as one short array.
    """
    on = [c for c in weights.columns if c != "weight"]
    entry = F.struct(F.col(label), F.col("weight").cast("double").alias("weight"))
    # sorted, so that sums don't depend on the order in which votes arrive
    voted = attach(maps, weights, on).groupBy(*keys, *XYZ).agg(F.array_sort(F.collect_list(entry)).alias("_votes"))
    return voted.select(*keys, *XYZ, F.array_max(_counted(F.col("_votes"), label))[label].alias(label))


def fuse_majority(maps: DataFrame, keys: Sequence[str] = IMAGE, label: str = "label") -> DataFrame:
    """Most frequent label of each voxel; ties go to the lowest label. Counts of labels are merged in one aggregate."""
    return maps.groupBy(*keys, *XYZ).agg(F.mode(F.col(label), True).alias(label))


def fuse_voting(maps: DataFrame, undecided: int | None = None, keys: Sequence[str] = IMAGE, label: str = "label") -> DataFrame:
    """Most frequent label; a tie gives ``undecided``, by default one above the largest label of the image."""
    keys = list(keys)
    voted = maps.where(F.col(label).isNotNull()).groupBy(*keys, *XYZ).agg(F.collect_list(F.struct(F.col(label), F.lit(1.0).alias("weight"))).alias("_votes"))
    scored = voted.select(*keys, *XYZ, _counted(F.col("_votes"), label).alias("_scores"))
    top = F.array_max("_scores")
    alone = F.size(F.filter("_scores", lambda s: s["score"] == top["score"])) == 1
    decided = scored.select(*keys, *XYZ, F.when(alone, top[label]).alias(label))
    if undecided is not None:
        return decided.fillna({label: undecided})
    largest = maps.groupBy(*keys).agg((F.max(label) + 1).alias("_undecided"))
    return attach(decided, largest, keys).select(*keys, *XYZ, F.coalesce(label, "_undecided").alias(label))


# --- iterative fusion over vote patterns ------------------------------------------------------
# The voxels of an image collapse to distinct vote patterns with counts: with R raters and K labels at
# most K^R rows, however many voxels there are. The iterations run on that table, one image per task
# row group; the voxels only meet the result again in a lookup join.

def vote_patterns(maps: DataFrame, keys: Sequence[str] = IMAGE, label: str = "label") -> DataFrame:
    """Votes of each voxel as an array in the order of the image's raters; raters that miss a voxel vote 0."""
    keys = list(keys)
    raters = maps.groupBy(*keys).agg(F.array_sort(F.collect_set("rater")).alias("_raters"))
    voted = maps.groupBy(*keys, *XYZ).agg(F.collect_list(F.struct("rater", F.col(label).alias("label"))).alias("_votes"))
    own = lambda r: F.transform(F.filter("_votes", lambda e: e["rater"] == r), lambda e: e["label"])
    pattern = F.transform("_raters", lambda r: F.coalesce(F.array_max(own(r)), F.lit(0)).cast("int"))
    return attach(voted, raters, keys).select(*keys, *XYZ, pattern.alias("pattern"))


def staple_posterior(votes: np.ndarray, counts: np.ndarray, iterations: int, tolerance: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of the class per pattern, rater sensitivities and specificities, by expectation maximisation.

    ``votes`` is boolean, patterns by raters; the prior is the mean vote.
    """
    prior = float((votes * counts[:, None]).sum() / (counts.sum() * votes.shape[1]))
    p = np.full(votes.shape[1], 0.99999)
    q = np.full(votes.shape[1], 0.99999)
    if prior in (0.0, 1.0):
        return np.full(len(votes), prior), p, q
    weight = np.zeros(len(votes))
    for _ in range(iterations):
        with np.errstate(divide="ignore"):
            yes = np.log(prior) + np.where(votes, np.log(p), np.log1p(-p)).sum(axis=1)
            no = np.log1p(-prior) + np.where(votes, np.log1p(-q), np.log(q)).sum(axis=1)
        top = np.maximum(yes, no)
        weight = np.exp(yes - top) / (np.exp(yes - top) + np.exp(no - top))
        mass, rest = weight * counts, (1 - weight) * counts
        new_p = (mass[:, None] * votes).sum(axis=0) / max(mass.sum(), 1e-300)
        new_q = (rest[:, None] * ~votes).sum(axis=0) / max(rest.sum(), 1e-300)
        moved = max(np.abs(new_p - p).max(), np.abs(new_q - q).max())
        p, q = np.clip(new_p, 1e-7, 1 - 1e-7), np.clip(new_q, 1e-7, 1 - 1e-7)
        if moved < tolerance:
            break
    return weight, p, q


def simple_weights(votes: np.ndarray, counts: np.ndarray, labels: np.ndarray, iterations: int, alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """Rater weights and fused label per pattern: raters below mean - alpha * std of the overlap drop out."""
    weights = np.ones(votes.shape[1])
    fused = np.zeros(len(votes), dtype=np.int64)
    for _ in range(iterations):
        scores = np.stack([((votes == k) * weights).sum(axis=1) for k in labels], axis=1)
        fused = labels[np.round(scores, 9).argmax(axis=1)]
        agree = ((votes == fused[:, None]) & (fused[:, None] != 0)) * counts[:, None]
        size = (votes != 0) * counts[:, None]
        total = size.sum(axis=0) + ((fused != 0) * counts).sum()
        overlap = np.where(total > 0, 2 * agree.sum(axis=0) / np.maximum(total, 1), 1.0)
        active = weights > 0
        floor = overlap[active].mean() - alpha * overlap[active].std()
        updated = np.where(active & (overlap >= floor - 1e-12), overlap, 0.0)
        if np.array_equal(updated > 0, active) and np.allclose(updated, weights, atol=1e-6):
            break
        weights = updated
    return weights, fused


def _fuse_patterns(maps: DataFrame, solve, keys: Sequence[str], label: str) -> DataFrame:
    """Run ``solve(votes, counts, labels) -> fused labels`` on the patterns of each image and look voxels up."""
    keys = list(keys)
    patterns = settle(vote_patterns(maps, keys, label))
    counted = patterns.groupBy(*keys, "pattern").agg(F.count(F.lit(1)).alias("count"))

    def fuse(group: pd.DataFrame) -> pd.DataFrame:
        votes = np.stack(group["pattern"].to_list())
        labels = np.unique(np.append(votes, 0))
        out = group[[*keys, "pattern"]].copy()
        out["label"] = solve(votes, group["count"].to_numpy(), labels)
        return out

    fields = [maps.schema[k] for k in keys]
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in fields), "pattern array<int>", "label int"])
    lookup = settle(counted.groupBy(*keys).applyInPandas(fuse, schema))
    joined = join_summary(patterns, lookup, [*keys, "pattern"], "inner", fits_broadcast(lookup))
    return joined.select(*keys, *XYZ, F.col("label").alias(label))


def fuse_staple(maps: DataFrame, iterations: int = 100, tolerance: float = 1e-7, keys: Sequence[str] = IMAGE,
                label: str = "label") -> DataFrame:
    """Each label against the rest by expectation maximisation; the largest posterior wins, ties the lowest label."""
    def solve(votes, counts, labels):
        posterior = np.stack([staple_posterior(votes == k, counts, iterations, tolerance)[0] for k in labels], axis=1)
        return labels[np.round(posterior, 9).argmax(axis=1)]
    return _fuse_patterns(maps, solve, keys, label)


def fuse_simple(maps: DataFrame, iterations: int = 10, alpha: float = 1.5, keys: Sequence[str] = IMAGE,
                label: str = "label") -> DataFrame:
    """Weighted vote with repeated removal of raters whose overlap with the estimate is too low.

    Among three raters none can lie 1.5 deviations below the mean, so the default never prunes on to
    the point where a single rater decides alone.
    """
    return _fuse_patterns(maps, lambda v, c, k: simple_weights(v, c, k, iterations, alpha)[1], keys, label)
