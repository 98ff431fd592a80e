"""Profiles that are kept and merged: counts, extremes, distinct values and quantiles of each column of each part of a table.

A part's profile is made in one pass over it, as partial aggregates of bounded size: HyperLogLog for distinct values and a KLL sketch for
quantiles. Profiles of parts merge into that of the table without another look at its rows, so a new file costs the reading of itself.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brightcask.sources import readers

#: Sizes of the sketches: about 0.8 % standard error of distinct values, and below 1 % of the rows in the place of a quantile.
HLL_BITS, KLL_SIZE = 14, 400
FILE = ("path", "modified", "length")
SKETCHES = "name string, n_rows long, n_values long, least_number double, most_number double, least_text string, most_text string, distincts binary, quantiles binary"


def _sketch(field: T.StructField) -> Column:
    c = F.col(f"`{field.name}`")
    plain = c if isinstance(field.dataType, T.AtomicType) else F.to_json(c)
    number = c.cast("double") if isinstance(field.dataType, T.NumericType) else None
    none = lambda kind: F.lit(None).cast(kind)
    text = plain.cast("string")
    return F.struct(
        F.lit(field.name).alias("name"), F.count(F.lit(1)).alias("n_rows"), F.count(plain).alias("n_values"),
        *[(f(number) if number is not None else none("double")).alias(n) for f, n in ((F.min, "least_number"), (F.max, "most_number"))], *[(f(text) if number is None else none("string")).alias(n) for f, n in ((F.min, "least_text"), (F.max, "most_text"))],
        F.hll_sketch_agg(text, F.lit(HLL_BITS)).alias("distincts"), (F.kll_sketch_agg_double(number, F.lit(KLL_SIZE)) if number is not None else none("binary")).alias("quantiles"),
    )


def sketched(df: DataFrame, by: Sequence[Column] = ()) -> DataFrame:
    """(by, then SKETCHES): a row for each part and column of df. Maps, arrays and structs are profiled as JSON."""
    kinds = df.schema.fields
    parts = df.groupBy(*by).agg(F.array(*map(_sketch, kinds)).alias("_all"))
    return parts.select(*[F.col(f"`{c}`") for c in parts.columns[:-1]], F.inline("_all"))


def merged(parts: DataFrame, digits: int = 9) -> DataFrame:
    """(name, n_rows, n_values, n_distinct, least, most, q1, median, q3) of each column from the profiles of its parts; n_distinct and the
    quartiles are estimates, null for columns that are no numbers or have no values."""
    known = parts.filter("n_values > 0 or quantiles is null")
    total = parts.groupBy("name").agg(F.sum("n_rows").alias("n_rows"), F.sum("n_values").alias("n_values"), F.hll_sketch_estimate(F.hll_union_agg("distincts")).alias("n_distinct"), *[f(c).alias(c) for f, c in ((F.min, "least_number"), (F.max, "most_number"), (F.min, "least_text"), (F.max, "most_text"))])
    places = known.filter("quantiles is not null").groupBy("name").agg(F.kll_merge_agg_double("quantiles", F.lit(KLL_SIZE)).alias("quantiles"))
    text = lambda side: F.coalesce(F.round(f"{side}_number", digits).cast("string"), F.col(f"{side}_text")).alias(side)
    at = [F.kll_sketch_get_quantile_double("quantiles", F.lit(p)).alias(n) for p, n in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))]
    return total.join(places.select("name", *at), "name", "left").select("name", "n_rows", "n_values", "n_distinct", text("least"), text("most"), "q1", "median", "q3")


def files(spark: SparkSession, path: str, ends: str = "*") -> DataFrame:
    """(path, modified, length) of the files under a path; none is opened."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", ends).load(path)
    return found.select("path", F.col("modificationTime").alias("modified"), "length")


def refresh(spark: SparkSession, kind: str, path: str, store: str, **options: str) -> list[str]:
    """Brings the kept profiles of a table of files up to date; the files that had to be read, new or changed ones alone."""
    now = files(spark, path, f"*.{kind}*")
    known = kept(spark, store)
    fresh = [r.path for r in (now if known is None else now.join(known.select(*FILE), list(FILE), "left_anti")).select("path").collect()]  # names of new files
    if fresh:
        reader = spark.read.format(kind).options(**options)
        schema = readers.read(spark, kind, path=path, **options).schema
        rows = reader.schema(schema).load(fresh)
        at = [F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("modified"), F.col("_metadata.file_size").alias("length")]
        sketched(rows, at).write.mode("append").parquet(store)
    return fresh


def kept(spark: SparkSession, store: str) -> DataFrame | None:
    """All profiles in the store, those of files that are gone or have changed too; None if there is no store yet."""
    where = spark._jvm.org.apache.hadoop.fs.Path(store)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return None
    return spark.read.schema(f"path string, modified timestamp, length long, {SKETCHES}").parquet(store)


def profile(spark: SparkSession, kind: str, path: str, store: str) -> DataFrame:
    """merged() of the files that are there now, from the store alone."""
    return merged(kept(spark, store).join(files(spark, path, f"*.{kind}*"), list(FILE), "left_semi"))
