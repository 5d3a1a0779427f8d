"""Morphology and connectivity."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxcohort.catalog.agreement import border_sql
from voxcohort.catalog.registry import query, rounded
from voxcohort.operators import regions as rg
from voxcohort.plans import derive as d

INSIDE = "inside AS (SELECT image_id, x, y, z FROM mask WHERE mask <> 0)"


def _inside(t):
    return d.mask(t).where("mask <> 0").select(*d.VOXEL)


@query("surface", d.with_ctes(d.CELLS, d.MASK, INSIDE, f"SELECT * FROM {border_sql('inside', 2, 'image_id')}"))
def surface(t):
    return rg.surface(_inside(t))


@query("dilate", d.with_ctes(d.CELLS, d.MASK, INSIDE, """SELECT DISTINCT image_id, x + dx AS x, y + dy AS y, z + dz AS z FROM (SELECT image_id, x, y, z FROM cells WHERE d <= 2),
  (SELECT a AS dx, b AS dy, c AS dz FROM (SELECT unnest(range(-2, 3)) AS a), (SELECT unnest(range(-2, 3)) AS b), (SELECT unnest(range(-2, 3)) AS c) WHERE a*a + b*b + c*c <= 6)
  WHERE x + dx BETWEEN 0 AND 11 AND y + dy BETWEEN 0 AND 9 AND z + dz BETWEEN 0 AND 7"""))
def dilate(t):
    return rg.dilate(d.cells(t).where("d <= 2").select(*d.VOXEL), 2, size=[12, 10, 8])


def reach_sql(source, same="", full=False):
    """Recursive reachability between the voxels of a mask; id orders by z, y, x."""
    near = ("abs(a.x-b.x) <= 1 AND abs(a.y-b.y) <= 1 AND abs(a.z-b.z) <= 1" if full
            else "abs(a.x-b.x) + abs(a.y-b.y) + abs(a.z-b.z) = 1")
    equal = f" AND a.{same} = b.{same}" if same else ""
    return [f"node AS MATERIALIZED (SELECT *, z * 10000 + y * 100 + x AS id FROM {source})",
            f"link AS MATERIALIZED (SELECT a.image_id, a.id AS a, b.id AS b FROM node a JOIN node b ON a.image_id = b.image_id{equal} AND b.x BETWEEN a.x-1 AND a.x+1 "
            f"AND b.y BETWEEN a.y-1 AND a.y+1 AND {near} WHERE a.id <> b.id)",
            "reach AS (SELECT image_id, id AS a, id AS b FROM node UNION SELECT r.image_id, r.a, l.b FROM reach r JOIN link l ON l.image_id = r.image_id AND l.a = r.b)",
            "comp AS (SELECT image_id, a AS id, min(b) AS c, count(*) AS size FROM reach GROUP BY 1, 2)"]


def recursive(*parts):
    return d.with_ctes(*parts).replace("WITH ", "WITH RECURSIVE ", 1)


BRIGHT = "bright AS (SELECT image_id, x, y, z FROM voxels WHERE value > 70)"


@query("connected_components", recursive(d.VOXELS, BRIGHT, *reach_sql("bright"),
       "SELECT DISTINCT image_id, (c // 10000) || '_' || (c // 100 % 100) || '_' || (c % 100) AS component, size AS voxels FROM comp"))
def connected_components(t):
    bright = d.voxels(t).where("value > 70").select(*d.VOXEL)
    return rg.component_sizes(rg.connected_components(bright))


@query("connected_components_full", recursive(d.VOXELS, BRIGHT.replace("70", "95"), *reach_sql("bright", full=True),
       "SELECT DISTINCT image_id, (c // 10000) || '_' || (c // 100 % 100) || '_' || (c % 100) AS component, size AS voxels FROM comp"))
def connected_components_full(t):
    bright = d.voxels(t).where("value > 95").select(*d.VOXEL)
    return rg.component_sizes(rg.connected_components(bright, full=True))


SEEDS = "seeds AS (SELECT image_id, x, y, z FROM cells WHERE d = 0 OR (x = 1 AND y = 1 AND z = 1))"


def _seeds(t):
    return d.cells(t).where("d = 0 OR (x = 1 AND y = 1 AND z = 1)").select(*d.VOXEL)


GROWN = "SELECT n.image_id, x, y, z FROM node n JOIN comp USING (image_id, id) WHERE (image_id, c) IN (SELECT image_id, c FROM comp JOIN (SELECT image_id, z * 10000 + y * 100 + x AS id FROM seeds) USING (image_id, id))"


@query("grow_region", recursive(d.VOXELS, d.CELLS, SEEDS, "band AS (SELECT image_id, x, y, z FROM voxels WHERE value BETWEEN 40 AND 110)", *reach_sql("band"), GROWN))
def grow_region(t):
    return rg.grow_region(d.voxels(t), _seeds(t), 40.0, 110.0)


@query("grow_region_seed_band", recursive(d.VOXELS, d.CELLS, SEEDS,
       """band AS (SELECT image_id, x, y, z FROM voxels JOIN (SELECT image_id, avg(value) AS m, coalesce(stddev_samp(value), 0) AS s FROM voxels JOIN seeds USING (image_id, x, y, z) GROUP BY 1)
  USING (image_id) WHERE value BETWEEN m - s AND m + s)""", *reach_sql("band"), GROWN))
def grow_region_seed_band(t):
    return rg.grow_region(d.stored(d.voxels(t)), _seeds(t), None, None)


CENTRE = "seeds AS (SELECT image_id, x, y, z FROM cells WHERE d = 0)"


@query("farthest_in_component", recursive(d.CELLS, d.PAIR, CENTRE, "lab AS (SELECT image_id, x, y, z, src AS label FROM pair)", *reach_sql("lab", "label"),
       f"""SELECT image_id, {rounded('sqrt(max(d2))')} AS distance, arg_max(x, d2 * 1000000 - id) AS x, arg_max(y, d2 * 1000000 - id) AS y, arg_max(z, d2 * 1000000 - id) AS z FROM
  (SELECT n.image_id, n.x, n.y, n.z, n.id, (n.x-s.x)*(n.x-s.x)+(n.y-s.y)*(n.y-s.y)+(n.z-s.z)*(n.z-s.z) AS d2 FROM node n JOIN comp USING (image_id, id) JOIN seeds s ON s.image_id = n.image_id
   WHERE c = (SELECT c FROM comp k WHERE k.image_id = n.image_id AND k.id = s.z * 10000 + s.y * 100 + s.x)) GROUP BY 1"""))
def farthest_in_component(t):
    seeds = d.cells(t).where("d = 0").select(*d.VOXEL)
    found = rg.farthest_in_component(d.labelmap(t), seeds)
    return found.withColumn("distance", F.round("distance", 6))


@query("fill_holes", recursive(d.CELLS, d.META, "shell AS (SELECT image_id, x, y, z FROM cells WHERE d BETWEEN 2 AND 40 AND q % 11 <> 0)",
       """back AS (SELECT m.image_id, x, y, z FROM meta m, (SELECT unnest(range(12)) AS x), (SELECT unnest(range(10)) AS y), (SELECT unnest(range(8)) AS z)
  WHERE (m.image_id, x, y, z) NOT IN (SELECT image_id, x, y, z FROM shell))""", *reach_sql("back"),
       """SELECT image_id, x, y, z FROM shell UNION ALL SELECT n.image_id, x, y, z FROM node n JOIN comp USING (image_id, id) WHERE (image_id, c) NOT IN
  (SELECT image_id, c FROM comp JOIN node USING (image_id, id) WHERE x IN (0, 11) OR y IN (0, 9) OR z IN (0, 7))"""))
def fill_holes(t):
    shell = d.cells(t).where("d BETWEEN 2 AND 40 AND q % 11 <> 0").select(*d.VOXEL)
    return rg.fill_holes(shell, d.image_meta(t).select("image_id", "size"))


@query("points_to_mask", d.with_ctes(d.VOXELS, d.CELLS, SEEDS, "SELECT image_id, x, y, z, CASE WHEN s.k IS NULL THEN 0 ELSE 150 END AS mask FROM voxels "
       "LEFT JOIN (SELECT *, 1 AS k FROM seeds) s USING (image_id, x, y, z)"))
def points_to_mask(t):
    return rg.points_to_mask(d.voxels(t), _seeds(t), 150)


@query("near_far_mask", d.with_ctes(d.CELLS, "SELECT image_id, x, y, z, CASE WHEN d < 3 THEN 1 WHEN d > 60 THEN 2 ELSE 0 END AS mask FROM cells"))
def near_far_mask(t):
    cells = d.cells(t)
    points = cells.where("d < 3 OR d > 60").withColumn("kind", F.when(F.col("d") < 3, 1).otherwise(2))
    return rg.points_to_mask(cells, points, by=F.col("kind"))
