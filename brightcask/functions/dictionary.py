"""A stored index of the distinct values of text columns, in which mistyped and partial values are found by equi-joins on keys.

- Near values. Two texts within two edits come to one text when up to two letters of each are left out. Every value is kept under all that it
  comes to in that way; a word looks up all that it comes to, and edit distance decides. Of long texts only the two ends are taken, for an
  edit between them changes neither, and one in them moves one letter across their border at most.
- Containing values. Every value is kept under the runs of three letters that it has. A word looks up the rarest of its own runs, and what is
  found is searched for the whole word.

Both tables are sorted by key within the partitions that a key's hash gives, one column's values beside each other's. No column of the source is read
for a lookup. A value is no longer than MOST letters here; longer ones are texts and not values, and are left out.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brightcask.functions.nearest import edits
from brightcask.sources.catalog import Source

#: Letters of either end that letters are left out of, of a run, and of a value.
END, GRAM, MOST = 12, 3, 200
#: Words whose keys, some hundreds of each, are broadcast at most; those of more are sorted and merged with the index.
FEW_WORDS = 300


@dataclass(frozen=True)
class Dictionary:
    """near: (key, table_name, column_name, value), key being a hash; grams: the same, key being a run of letters; counts: (key, table_name, column_name, n), how many values a run of letters has."""

    near: DataFrame
    grams: DataFrame
    counts: DataFrame


def _without(text: Column) -> Column:
    """The texts that leaving out one letter makes."""
    return F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.concat(F.substring(text, F.lit(1), i - 1), F.substring(text, i + 1, F.length(text))))


def near_keys(text: Column) -> Column:
    """Hashes of a text's ends, in lower case, with up to two letters left out."""
    low = F.lower(text)
    ends = F.when(F.length(low) <= 2 * END, low).otherwise(F.concat(F.substring(low, 1, END), F.substring(low, -END, END)))
    one = F.array_distinct(F.when(F.length(ends) > 0, _without(ends)).otherwise(F.array(ends)))
    two = F.flatten(F.transform(one, lambda t: F.when(F.length(t) > 0, _without(t)).otherwise(F.array(t))))
    return F.array_distinct(F.transform(F.concat(F.array(ends), one, two), lambda t: F.xxhash64(t)))


def runs(text: Column) -> Column:
    """The runs of three letters of a text, in lower case; none if it is shorter."""
    low = F.lower(text)
    return F.when(F.length(low) >= GRAM, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(low) - GRAM + 1), lambda i: F.substring(low, i, F.lit(GRAM))))).otherwise(F.array().cast("array<string>"))


def _spread(df: DataFrame) -> DataFrame:
    """df in as many parts as a shuffle has, however small it is: the keys that its rows are about to come to are hundreds of times as large."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *df.columns)


def values_of(spark: SparkSession, source: Source, columns: Sequence[tuple[str, str]]) -> DataFrame:
    """(table_name, column_name, value): the distinct values of these columns."""
    out = None
    for table, column in columns:
        own = source.table(spark, table).select(F.lit(table).alias("table_name"), F.lit(column).alias("column_name"), F.col(f"`{column}`").cast("string").alias("value"))
        own = own.filter(F.length("value") <= MOST).distinct()
        out = own if out is None else out.unionByName(own)
    return out


def build(values: DataFrame, path: str) -> None:
    """Writes the index of (table_name, column_name, value) under a path that all executors share."""
    kept = ["table_name", "column_name", "value"]
    for name, keys in (("near", near_keys), ("grams", runs)):
        rows = _spread(values).select(F.explode(keys(F.col("value"))).alias("key"), *kept)
        rows.repartition("key", F.pmod(F.xxhash64("value"), F.lit(8))).sortWithinPartitions("key", *kept).write.parquet(f"{path}/{name}")  # a frequent run of letters is eight
    values.sparkSession.read.parquet(f"{path}/grams").groupBy("key", "table_name", "column_name").agg(F.count(F.lit(1)).alias("n")).write.parquet(f"{path}/counts")


def load(spark: SparkSession, path: str) -> Dictionary:
    return Dictionary(*(spark.read.parquet(f"{path}/{n}") for n in ("near", "grams", "counts")))


def nearest(words: DataFrame, held: Dictionary, most: int = 2) -> DataFrame:
    """(table_name, column_name, word, meant, distance) for words of (table_name, column_name, word): the value within so many edits, two at
    most, a swap of neighbours being one; none if two are as near. Words of up to four letters may have one edit.

    The optimiser takes the keys of words for as small as the words, so it is told which join to take.
    """
    words = words.select("table_name", "column_name", "word").distinct()
    few = words.limit(FEW_WORDS + 1).count() <= FEW_WORDS
    asked = (words if few else _spread(words)).select("table_name", "column_name", "word", F.explode(near_keys(F.col("word"))).alias("key")).hint("broadcast" if few else "merge")
    found = asked.join(held.near, ["key", "table_name", "column_name"]).select("table_name", "column_name", "word", F.col("value").alias("meant")).distinct()
    limit = F.when(F.length("word") <= 4, 1).otherwise(most)
    likely = found.filter((F.abs(F.length("word") - F.length("meant")) <= most) & (F.levenshtein(F.lower("word"), F.lower("meant"), most + 1) >= 0))
    near = likely.withColumn("distance", edits(F.lower("word"), F.lower("meant")).cast("long")).filter(F.col("distance") <= limit)
    of = ["table_name", "column_name", "word"]
    return near.groupBy(*of, "distance").agg(F.min("meant").alias("meant"), F.count(F.lit(1)).alias("n")).groupBy(*of).agg(F.min(F.struct("distance", "meant", "n")).alias("b")).filter("b.n = 1").select(*of, "b.meant", "b.distance")


def containing(words: DataFrame, held: Dictionary) -> DataFrame:
    """(table_name, column_name, word, value) for words of three letters or more: all values that hold the word, in any case of letters."""
    of = ["table_name", "column_name", "word"]
    asked = words.distinct().select(*of, F.explode(runs(F.col("word"))).alias("key"))
    rarest = asked.join(held.counts, ["key", "table_name", "column_name"], "left").groupBy(*of).agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "key")).alias("r"))
    some = rarest.filter("r.n > 0").select(*of, F.col("r.key").alias("key"))  # a run that no value has: nothing holds the word
    return some.join(held.grams, ["key", "table_name", "column_name"]).filter(F.contains(F.lower("value"), F.lower("word"))).select(*of, "value")
