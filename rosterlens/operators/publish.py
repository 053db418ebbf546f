"""Nested records and how they are written."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def club_records(rows: DataFrame, clubs: Sequence[str], id: str, shape: DataFrame | None = None) -> DataFrame:
    """One record per club with its players' ids in order and, if given, its shape."""
    per = rows.groupBy(*clubs).agg(F.array_sort(F.collect_set(id)).alias("players"))
    if shape is None:
        return per
    cells = shape.groupBy(*clubs).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("grp", "places")))).alias("shape"))
    return per.join(cells, list(clubs), "left")


def player_records(rows: DataFrame, priced: Column, z: float = 1.645) -> DataFrame:
    """One rounded record per player; price facts only where priced."""
    return rows.select(
        "id", F.coalesce(F.when(F.col("nickname") != "", F.col("nickname")), F.col("name")).alias("name"), "grp",
        F.round("value", 4).alias("value"), F.round(F.col("value") - z * F.col("sd"), 4).alias("low"),
        F.round(F.col("value") + z * F.col("sd"), 4).alias("high"), F.when(priced, F.col("band")).alias("band"))


def as_json(records: DataFrame, key: Sequence[str], name: str = "json") -> DataFrame:
    """Each record as one JSON line; numbers that are not finite stop the job."""
    body = [c for c in records.columns]
    bad = F.lit(False)
    for c, t in records.dtypes:
        if t in ("double", "float"):
            bad = bad | F.isnan(c) | (F.abs(c) == float("inf"))
    line = F.to_json(F.struct(*body))
    checked = F.when(F.coalesce(bad, F.lit(False)), F.raise_error(F.lit("a number that is not finite"))).otherwise(line)
    return records.select(*key, checked.alias(name))


def write_records(records: DataFrame, path: str, partition: str) -> None:
    """One folder of JSON lines per value of the partition column; only those present are replaced."""
    (records.repartition(partition).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(partition).json(path))


def digest(lines: DataFrame, path: str, content: str, by: Sequence[str] = ()) -> DataFrame:
    """One hash over the sorted (path, content hash) lines.

    Meant for the published files: a line is a file's path and hash, so there are as many lines as
    files, not rows. ``by`` gives one digest per folder.
    """
    hashed = lines.select(*by, F.concat_ws(" ", F.col(path), F.sha2(F.col(content), 256)).alias("_line"))
    joined = F.array_join(F.array_sort(F.collect_list("_line")), "\n")
    per = hashed.groupBy(*by).agg(F.sha2(joined, 256).alias("digest"))
    return per
