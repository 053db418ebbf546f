"""Scans of landed files: CSV tables, JSON event feeds, partitioned tables, guarded date ranges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.text import unescape


def csv_table(spark: SparkSession, path: str, schema: StructType, timestamps: Sequence[str] = ()) -> DataFrame:
    """A (compressed) CSV table. Only the empty string is null, so "NA" stays text; the listed
    columns become timestamps."""
    raw = StructType([StructField(f.name, StringType() if f.name in timestamps else f.dataType) for f in schema.fields])
    df = spark.read.csv(path, schema=raw, header=True, nullValue="", emptyValue="", enforceSchema=False,
                        multiLine=False, escape='"')
    strings = [f.name for f in raw.fields if isinstance(f.dataType, StringType)]
    df = df.withColumns({c: F.nullif(F.col(c), F.lit("")) for c in strings})
    return df.withColumns({c: F.to_timestamp(c) for c in timestamps})


def to_parquet(df: DataFrame, path: str, partition: Sequence[str] = ()) -> None:
    """Writes a table; with partitions only those present are replaced."""
    w = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    (w.partitionBy(*partition) if partition else w).parquet(path)


def json_feed(spark: SparkSession, path: str, schema: StructType,
              partition: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Events of landed JSON-lines files and the lines that could not be read, with their file.

    Folder columns named in ``partition`` are kept on both.
    """
    wide = StructType([*schema.fields, StructField("_corrupt_record", StringType())])
    lines = spark.read.text(path).select(*partition, "value", F.col("_metadata.file_name").alias("file"))
    parsed = lines.withColumn("_e", F.from_json(
        "value", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}))
    broken = F.col("_e._corrupt_record").isNotNull()
    good = parsed.filter(~broken).select(*partition, "file", *[f"_e.{f.name}" for f in schema.fields])
    bad = parsed.filter(broken).select(*partition, "file", F.col("value").alias("error"))
    return good, bad


def remaining(work: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Work whose part is not marked as done."""
    return work.join(done, list(keys), "left_anti")


def consolidated(games: DataFrame, done: DataFrame, counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Finished games with their event counts, null where no count is known."""
    return games.join(done, list(keys), "left_semi").join(counts, list(keys), "left")


def decoded(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Escaped names become text; rows without a backslash skip Python's work."""
    return df.withColumns({c: F.coalesce(unescape(F.when(F.contains(F.col(c), F.lit("\\u")), F.col(c))), F.col(c))
                           for c in columns})


def partitioned_scan(spark: SparkSession, path: str, names: DataFrame, on: Sequence[str], season: str) -> DataFrame:
    """Every partition of a table with looked-up names and a season label."""
    return spark.read.parquet(path).join(names, list(on), "left").withColumn("season", F.lit(season))


def dated_scan(table: DataFrame, columns: Sequence[str], date: str, low: Column | None, high: Column,
               within: dict[str, Sequence] | None = None) -> DataFrame:
    """Chosen columns of rows in a date range; later rows are never read past the filter, which
    sits on the bare column so that it reaches the files."""
    kept = table.filter(F.col(date) <= high)
    if low is not None:
        kept = kept.filter(F.col(date) >= low)
    for c, values in (within or {}).items():
        kept = kept.filter(F.col(c).isin(*values))
    return kept.select(*columns)


def window_bundle(games: DataFrame, tables: dict[str, DataFrame], keys: Sequence[str]) -> dict[str, DataFrame]:
    """Each table restricted to the given games."""
    held = games.select(*keys).distinct()
    return {n: t.join(held, list(keys), "left_semi") for n, t in tables.items()}


def manifest(spark: SparkSession, path: str, source: str) -> DataFrame:
    """Byte size of each input file with the time of the look; file contents are not read."""
    files = spark.read.format("binaryFile").load(path).select("path", "length", "modificationTime")
    return files.withColumns({"source": F.lit(source), "recorded": F.current_timestamp()})


def unmatched_keys(features: DataFrame, labels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """How many keys only one of two co-scanned tables holds; both counts must be 0."""
    a = features.select(*keys).withColumn("_a", F.lit(True))
    b = labels.select(*keys).withColumn("_b", F.lit(True))
    return a.join(b, list(keys), "full_outer").agg(
        F.count_if(F.col("_b").isNull()).alias("only_features"), F.count_if(F.col("_a").isNull()).alias("only_labels"))
