"""Rollups of stories kept up to date from partial aggregates.

A cell holds how many articles of a story came from a source in an hour, and the latest of them. Cells add up: a batch's own cells are united
with those there are, and of articles only those of the batch are aggregated; others are not read again. Cells of removed articles are
counted anew from the articles of these cells alone, as a latest time cannot be taken back; merged stories' cells take the target's name and
are added up. A rollup reads cells, which are at most one a story, source and hour.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom.functions.text import family
from storyloom.operators.graphs import stored
from storyloom.operators.rollups import _rolled, since, text_ts
from storyloom.registry import register
from storyloom.sources.views import STAR_AS_OF

CELL = ("story_id", "source_id", "hour")


def cells(links: DataFrame) -> DataFrame:
    """(story_id, source_id, hour, n, latest) of links (story_id, source_id, ts). Null sources and times are cells of their own."""
    return links.groupBy("story_id", "source_id", F.date_trunc("hour", "ts").alias("hour")).agg(F.count("*").alias("n"), F.max("ts").alias("latest"))


def _same(a: DataFrame, b: DataFrame):  # noqa: ANN202
    on = a["story_id"] == b["story_id"]
    for c in CELL[1:]:
        on = on & a[c].eqNullSafe(b[c])
    return on


def _together(parts: DataFrame) -> DataFrame:
    """Cells of one story, source and hour as one."""
    return parts.groupBy(*CELL).agg(F.sum("n").alias("n"), F.max("latest").alias("latest"))


def added(table: DataFrame, more: DataFrame) -> DataFrame:
    """The table after more cells: one aggregate of cells, which reads the table once, so that deltas in a row do not multiply."""
    return _together(table.unionByName(more))


def removed(table: DataFrame, gone: DataFrame, links: DataFrame) -> DataFrame:
    """The table after links `gone` have left `links`: only their cells are counted anew."""
    touched = cells(gone).select(*CELL)
    hours = links.withColumn("hour", F.date_trunc("hour", "ts"))
    left = hours.join(touched, _same(hours, touched), "left_semi").drop("hour")
    return table.join(touched, _same(table, touched), "left_anti").unionByName(cells(left))


def merged(table: DataFrame, plan: DataFrame) -> DataFrame:
    """The table after merges (source, target), each source with its last target: the sources' cells are added to the targets'."""
    to = plan.select(F.col("source").alias("story_id"), "target")
    return _together(table.join(to, "story_id", "left").withColumn("story_id", F.coalesce("target", "story_id")).drop("target"))


def rollup(table: DataFrame, sources: DataFrame, at: str, recent_hours: int = 24, days: int | None = None) -> DataFrame:
    """What story_rollup() gives, from cells. `at` is a whole hour, as cells are."""
    moment = dt.datetime.fromisoformat(at)
    if moment.minute or moment.second or moment.microsecond:
        raise ValueError("cells are of whole hours")
    rows = table if days is None else table.where(since("hour", at, 24 * days))
    rows = rows.join(sources.select(F.col("id").alias("source_id"), "domain", "weight"), "source_id", "left")
    recent = F.when(since("hour", at, recent_hours), F.col("n")).otherwise(0)
    return rows.groupBy("story_id").agg(
        F.sum("n").alias("article_count"), F.count_distinct("domain").alias("source_count"), F.count_distinct(family(F.col("domain"))).alias("family_count"), F.sum(recent).alias("recent_count"),
        F.round(F.sum(F.coalesce("weight", F.lit(1.0)) * F.col("n")) / F.sum("n"), 6).alias("avg_weight"), F.max("latest").alias("latest_at"),
    )


def _in_steps(x: DataFrame, s: DataFrame) -> DataFrame:
    """Half of the links as a first table, then batches, removals and merges as deltas; SQL rolls up what is left at the end."""
    rows = stored(x.select("story_id", "source_id", "ts"))
    table = cells(rows.where("source_id % 4 < 2 or source_id is null"))
    for k in (2, 3):
        table = added(table, cells(rows.where(f"source_id % 4 = {k}")))
    gone = "day(ts) % 7 = 0 and story_id % 3 = 0"
    table = removed(table, rows.where(gone), rows.where(f"not ({gone})"))
    plan = rows.where("story_id % 16 > 7").select(F.col("story_id").alias("source"), F.expr("story_id - 8").alias("target")).distinct()
    return rollup(merged(table, plan), s, STAR_AS_OF, 4800).withColumn("latest_at", text_ts("latest_at"))


register(
    "story_rollup_incremental", "star_links star_sources", _in_steps,
    _rolled(STAR_AS_OF, 4800, "").replace("FROM star_links l", "FROM (SELECT * REPLACE (CASE WHEN story_id % 16 > 7 THEN story_id - 8 ELSE story_id END AS story_id) FROM star_links WHERE NOT (day(ts) % 7 = 0 AND story_id % 3 = 0)) l"),
)
