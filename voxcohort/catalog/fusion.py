"""Fusion of label maps."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxcohort.catalog.registry import query
from voxcohort.operators import fusion as fu
from voxcohort.plans import derive as d


@query("fusion_inputs", d.with_ctes(d.HEADERS, "SELECT image_id, path FROM headers WHERE lower(split_part(path, '/', -1)) NOT LIKE '%final%' AND lower(split_part(path, '/', -1)) NOT LIKE '%fused%'"))
def fusion_inputs(t):
    return fu.fusion_inputs(d.headers(t).select("image_id", "path"))


VOTES = "votes AS (SELECT image_id, x, y, z, label, count(*) AS votes FROM raters GROUP BY ALL)"


@query("fuse_majority", d.with_ctes(d.CELLS, d.RATERS, VOTES, "SELECT image_id, x, y, z, arg_max(label, votes * 100 - label) AS label FROM votes GROUP BY ALL"))
def fuse_majority(t):
    return fu.fuse_majority(d.rater_maps(t))


def _voting_sql(undecided):
    return d.with_ctes(d.CELLS, d.RATERS, VOTES, f"""SELECT image_id, x, y, z, CAST(CASE WHEN count(*) FILTER (WHERE votes = top) = 1 THEN max(CASE WHEN votes = top THEN label END)
      ELSE {undecided} END AS INTEGER) AS label FROM (SELECT *, max(votes) OVER (PARTITION BY image_id, x, y, z) AS top FROM votes)
      JOIN (SELECT image_id, max(label) + 1 AS above FROM raters GROUP BY 1) USING (image_id) GROUP BY image_id, x, y, z""")


@query("fuse_voting", _voting_sql("max(above)"))
def fuse_voting(t):
    return fu.fuse_voting(d.rater_maps(t))


@query("fuse_voting_fixed", _voting_sql("9"))
def fuse_voting_fixed(t):
    return fu.fuse_voting(d.rater_maps(t), undecided=9)


@query("weighted_vote", d.with_ctes(d.CELLS, d.RATERS, """SELECT image_id, x, y, z, arg_max(label, score * 1000 - label) AS label FROM
  (SELECT image_id, x, y, z, label, sum(CASE rater WHEN 'rater0' THEN 0.5 WHEN 'rater1' THEN 1.0 WHEN 'rater2' THEN 0.25 WHEN 'rater3' THEN 2.0 ELSE 0.75 END) AS score FROM raters GROUP BY ALL)
  GROUP BY ALL"""))
def weighted_vote(t):
    weights = d.rater_maps(t).select("rater").distinct().withColumn(
        "weight", F.element_at(F.array(*map(F.lit, [0.5, 1.0, 0.25, 2.0, 0.75])), F.substring("rater", 6, 2).cast("int") + 1))
    return fu.weighted_vote(d.rater_maps(t), weights)


PATTERNS = """wide AS (SELECT image_id, x, y, z, """ + ", ".join(f"max(CASE WHEN rater = 'rater{r}' THEN label END) AS v{r}" for r in range(5)) + """ FROM raters GROUP BY ALL),
  pat AS (SELECT image_id, v0, v1, v2, v3, v4, count(*) AS n FROM wide GROUP BY ALL), lab AS (SELECT DISTINCT image_id, label AS k FROM raters UNION SELECT DISTINCT image_id, 0 FROM raters)"""


def _staple_sql(rounds):
    """Expectation and maximisation written out round by round."""
    each = lambda text: ", ".join(text.format(r=r) for r in range(5))
    parts = [f"e AS (SELECT *, {each('CAST(v{r} = k AS INTEGER) AS b{r}')} FROM pat JOIN lab USING (image_id))",
             "prior AS (SELECT image_id, k, sum((b0 + b1 + b2 + b3 + b4) * n) / (5.0 * sum(n)) AS pr FROM e GROUP BY 1, 2)",
             f"m0 AS (SELECT image_id, k, {each('0.99999::DOUBLE AS p{r}, 0.99999::DOUBLE AS q{r}')} FROM prior)"]
    for i in range(rounds):
        yes = " + ".join(f"CASE WHEN b{r} = 1 THEN ln(p{r}) ELSE ln(1 - p{r}) END" for r in range(5))
        no = " + ".join(f"CASE WHEN b{r} = 1 THEN ln(1 - q{r}) ELSE ln(q{r}) END" for r in range(5))
        columns = "image_id, k, n, v0, v1, v2, v3, v4, b0, b1, b2, b3, b4"
        parts.append(f"w{i} AS (SELECT {columns}, CASE WHEN pr IN (0, 1) THEN pr ELSE exp(yes - greatest(yes, no)) / (exp(yes - greatest(yes, no)) + exp(no - greatest(yes, no))) END AS w FROM "
                     f"(SELECT {columns}, pr, CASE WHEN pr IN (0, 1) THEN 0 ELSE ln(pr) + {yes} END AS yes, CASE WHEN pr IN (0, 1) THEN 0 ELSE ln(1 - pr) + {no} END AS no FROM e JOIN prior USING (image_id, k) JOIN m{i} USING (image_id, k)))")
        clip = lambda value: f"greatest(least({value}, 1 - 1e-7), 1e-7)"
        rates = ", ".join(f"{clip(f'sum(w * n * b{r}) / greatest(sum(w * n), 1e-300)')} AS p{r}, {clip(f'sum((1 - w) * n * (1 - b{r})) / greatest(sum((1 - w) * n), 1e-300)')} AS q{r}" for r in range(5))
        parts.append(f"m{i + 1} AS (SELECT image_id, k, {rates} FROM w{i} GROUP BY 1, 2)")
    parts.append(f"best AS (SELECT image_id, v0, v1, v2, v3, v4, CAST(arg_max(k, {{'w': round(w, 9), 'k': -k}}) AS INTEGER) AS label FROM w{rounds - 1} GROUP BY ALL)")
    return d.with_ctes(d.CELLS, d.RATERS, PATTERNS, *parts, "SELECT image_id, x, y, z, label FROM wide JOIN best USING (image_id, v0, v1, v2, v3, v4)")


def _simple_sql(rounds, alpha=1.5):
    parts = [f"m0 AS (SELECT DISTINCT image_id, {', '.join(f'1.0::DOUBLE AS w{r}' for r in range(5))} FROM pat)"]
    for i in range(rounds):
        score = " + ".join(f"CASE WHEN v{r} = k THEN w{r} ELSE 0 END" for r in range(5))
        parts.append(f"f{i} AS (SELECT image_id, v0, v1, v2, v3, v4, any_value(n) AS n, CAST(arg_max(k, {{'s': round({score}, 9), 'k': -k}}) AS INTEGER) AS label "
                     f"FROM pat JOIN lab USING (image_id) JOIN m{i} USING (image_id) GROUP BY image_id, v0, v1, v2, v3, v4)")
        total = lambda r: f"(sum(CASE WHEN v{r} <> 0 THEN n ELSE 0 END) + sum(CASE WHEN label <> 0 THEN n ELSE 0 END))"
        overlap = ", ".join(f"CASE WHEN {total(r)} > 0 THEN 2.0 * sum(CASE WHEN v{r} = label AND label <> 0 THEN n ELSE 0 END) / {total(r)} ELSE 1 END AS o{r}" for r in range(5))
        parts.append(f"o{i} AS (SELECT image_id, {overlap} FROM f{i} GROUP BY 1)")
        active = "list_filter([" + ", ".join(f"CASE WHEN w{r} > 0 THEN o{r} END" for r in range(5)) + "], lambda v: v IS NOT NULL)"
        kept = ", ".join(f"CASE WHEN w{r} > 0 AND o{r} >= list_avg(a) - {alpha} * list_stddev_pop(a) - 1e-12 THEN o{r} ELSE 0 END AS w{r}" for r in range(5))
        parts.append(f"m{i + 1} AS (SELECT image_id, {kept} FROM (SELECT *, {active} AS a FROM o{i} JOIN m{i} USING (image_id)))")
    return d.with_ctes(d.CELLS, d.RATERS, PATTERNS, *parts, f"SELECT image_id, x, y, z, label FROM wide JOIN f{rounds - 1} USING (image_id, v0, v1, v2, v3, v4)")


@query("fuse_staple_rounds", _staple_sql(3))
def fuse_staple_rounds(t):
    """Three rounds of expectation maximisation, which SQL can write out."""
    return fu.fuse_staple(d.rater_maps(t), iterations=3)


@query("fuse_simple_rounds", _simple_sql(2))
def fuse_simple_rounds(t):
    """Two rounds of weighing and removal, which SQL can write out."""
    return fu.fuse_simple(d.rater_maps(t), iterations=2)


@query("fuse_staple")
def fuse_staple(t):
    return fu.fuse_staple(d.rater_maps(t))


@query("fuse_simple")
def fuse_simple(t):
    return fu.fuse_simple(d.rater_maps(t))
