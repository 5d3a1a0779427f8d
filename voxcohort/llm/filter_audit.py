"""How filters interact: what each filter of every order removes, finds already removed, and costs in labelled rows.

1. Every filter has one table: the ids of all rows that fail it. An id is known by key, part and text, so keys may repeat or be null.
2. What a prefix of filters lets through depends on the filters in it, not on their order. The survivors of all sets of filters are
   one relation (id, set): filter by filter, the rows that it leaves (a left-anti join of all sets so far) are added under the set with that
   filter. So five joins serve 32 sets. Left-semi joins give the rows that fail a filter. Rows are summed to a few numbers a part and set.
3. A step removes the survivors before it that are no survivors after it; a failing row that it doesn't remove was removed
   earlier; the unique failures of a filter are what it removes after all others. All orders follow from these sums.

Everything is a DataFrame; only sums by part leave the tasks, and no join has an order of filters as a row.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from functools import reduce
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxcohort.llm.common import Shelf, prepare

ID = ["_a", "_b"]


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def default_filters() -> dict[str, Callable[[Column], Column]]:
    """Failure conditions on a text: few words, few different words, many capitals, symbols."""
    count = lambda text: F.size(words(text))
    return {
        "A": lambda text: count(text) < 100,
        "B": lambda text: 100 * F.size(F.array_distinct(words(text))) < 80 * count(text),
        "C": lambda text: 100 * (F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))) > 10 * F.length(text),
        "D": lambda text: text.rlike(r"[#$%&*|]"),
    }


class FailingIds:
    """The rows (part, good, toxic, n) by id and, per filter, the table of the ids that fail it."""

    def __init__(self, rows: DataFrame, failing: dict[str, DataFrame]):
        self.rows, self.failing = rows, failing

    def survivors(self, names: Sequence[str]) -> DataFrame:
        return reduce(lambda left, name: left.join(self.failing[name], ID, "left_anti"), names, self.rows)

    def removed(self, prefix: Sequence[str], name: str) -> DataFrame:
        """Rows that ``name`` removes after ``prefix``."""
        return self.survivors(prefix).join(self.failing[name], ID, "left_semi")

    def redundant(self, prefix: Sequence[str], name: str) -> DataFrame:
        """Rows that fail ``name`` but were removed by ``prefix``."""
        failed = self.rows.join(self.failing[name], ID, "left_semi")
        return failed.join(self.survivors(prefix).select(*ID), ID, "left_anti")


def failing_ids(documents: DataFrame, labels: DataFrame, filters: dict[str, Callable[[Column], Column]] | None = None, copies: str = "E",
                key: str = "doc_id", text: str = "text", part: str = "lang") -> FailingIds:
    """Judge all rows once and store the id tables. The filter ``copies`` fails rows whose text some smaller key has."""
    spark = documents.sparkSession
    prepare(spark)
    shelf = Shelf(spark)
    filters = default_filters() if filters is None else filters
    body = F.coalesce(F.col(text), F.lit(""))
    plain = documents.select(F.col(key).alias("_key"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("_part"), body.alias("_text"))
    judged = plain.select("_key", "_part", F.sha2("_text", 256).alias("_digest"), *(F.coalesce(fails(F.col("_text")), F.lit(False)).alias(f"_f{name}") for name, fails in filters.items()))
    # null and 0 differ, and so do an empty part and a missing one
    whole = [F.isnull("_key"), F.coalesce(F.col("_key").cast("string"), F.lit("")), "_part", "_digest"]
    known = judged.groupBy(F.xxhash64(*whole).alias("_a"), F.xxhash64(F.lit(1), *whole).alias("_b")).agg(
        F.count("*").alias("n"), *(F.first(c).alias(c) for c in ("_key", "_part", "_digest", *(f"_f{name}" for name in filters))))
    known = shelf.put(known)
    marked = labels.groupBy(F.col(key).alias("_key")).agg(F.max((F.col("quality") == 1).cast("long")).alias("good"), F.max((F.col("toxic") == 1).cast("long")).alias("toxic"))
    mark = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")) * F.col("n")
    rows = shelf.put(known.join(marked.where("_key is not null"), "_key", "left").select(*ID, "_part", "n", mark("good").alias("good"), mark("toxic").alias("toxic")))
    failing = {name: shelf.put(known.where(f"_f{name}").select(*ID)) for name in filters}
    # the row that holds a text first has its least key: (digest, key) spreads the copies of one text
    first = known.where("_key is not null").groupBy("_digest").agg(F.min("_key").alias("_key"))
    failing[copies] = shelf.put(known.where("_key is not null").join(first, ["_digest", "_key"], "left_anti").select(*ID))
    return FailingIds(rows, failing)


def survivors_of_all_sets(found: FailingIds, names: Sequence[str]) -> DataFrame:
    """The rows that each set of filters leaves, with the set as a number (bit i stands for filter i) in ``_set``."""
    shelf = Shelf(found.rows.sparkSession)
    parts = [found.rows.withColumn("_set", F.lit(0))]
    for i, name in enumerate(names):
        left = reduce(DataFrame.unionByName, parts).join(found.failing[name], ID, "left_anti").withColumn("_set", F.col("_set") + F.lit(1 << i))
        parts.append(shelf.put(left) if i + 1 < len(names) else left)
    return reduce(DataFrame.unionByName, parts)


def audit(found: FailingIds) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley), zeros included, per part, order
    of the filters and step. A table without rows has no parts."""
    names = sorted(found.failing)
    place = {name: 1 << i for i, name in enumerate(names)}
    everything = (1 << len(names)) - 1
    sets = [(mask, [n for n in names if place[n] & mask]) for mask in range(everything + 1)]
    # -1, -2, ... stand for the rows that fail one filter
    kinds = [survivors_of_all_sets(found, names)] + [found.removed([], n).withColumn("_set", F.lit(-1 - i)) for i, n in enumerate(names)]
    sums = reduce(DataFrame.unionByName, kinds).groupBy("_part", "_set").agg(*(F.sum(c).alias(c) for c in ("n", "good", "toxic")))
    # at most 37 rows a part meet here
    by_part = Shelf(found.rows.sparkSession).put(sums).groupBy("_part").agg(F.map_from_entries(F.collect_list(F.struct("_set", F.struct("n", "good", "toxic")))).alias("_sums"))
    value = lambda s, c: F.coalesce(F.try_element_at("_sums", s)[c], F.lit(0).cast("long"))
    lost = lambda before, after, c: value(before, c) - value(after, c)
    fixed = lambda rows, schema: F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")
    # how many orders put exactly the filters of a set before a filter
    share = [{"name": n, "before": m, "after": m | place[n], "orders": factorial(m.bit_count()) * factorial(len(names) - 1 - m.bit_count())}
             for n in names for m, _ in sets if not m & place[n]]
    alone = [{"name": n, "before": everything & ~place[n], "after": everything, "orders": 1} for n in names]
    steps = []
    for order in permutations(names):
        before = 0
        for i, name in enumerate(order, 1):
            steps.append({"filter_order": "".join(order), "step": i, "name": name, "failing": -1 - names.index(name), "before": before, "after": before | place[name]})
            before |= place[name]

    def by_name(rows: list[dict]) -> Column:
        """Removals of each filter, summed over the rows that name it."""
        listed = fixed(rows, "name string, before int, after int, orders long")
        total = lambda name: F.aggregate(F.filter(listed, lambda r: r["name"] == name), F.lit(0).cast("long"),
                                         lambda s, r: s + r["orders"] * lost(r["before"], r["after"], "n"))
        return F.create_map(*(c for n in names for c in (F.lit(n), total(n))))

    steps = fixed(steps, "filter_order string, step int, name string, failing int, before int, after int")
    wide = by_part.select("_part", "_sums", by_name(share).alias("_shapley"), by_name(alone).alias("_unique"), F.explode(steps).alias("_s"))
    s = F.col("_s")
    gone = lambda c: lost(s["before"], s["after"], c)
    return wide.select(F.col("_part").alias("part"), s["filter_order"].alias("filter_order"), s["step"].alias("step"), value(s["after"], "n").alias("kept"),
                       gone("n").alias("removed"), (value(s["failing"], "n") - gone("n")).alias("redundant"), F.col("_unique")[s["name"]].alias("unique_fails"),
                       gone("good").alias("good_lost"), gone("toxic").alias("toxic_lost"), F.col("_shapley")[s["name"]].alias("shapley"))
