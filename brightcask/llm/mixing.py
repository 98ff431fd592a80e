"""Mixing sources to target weights by Sainte-Lague apportionment, in DataFrame functions alone.

1. Targets. The mix has as many words as the input. Sources, ordered by code point with null last, weigh 1, 2, 3 and so on
   again; a target stops at max_repeats times its source's size, and the excess is shared by weight among the others.
2. Apportionment. The mix is so many blocks of block_words words. They go to the sources by the highest quotients
   target / (2k + 1), each source's blocks go in the same way to its wings (of 1,024 shards) by their sizes, and each
   wing's to its shards: integer quotas per shard. The blocks that are sure to be won are counted in closed form and only the
   contested ones are ranked, so the work is a few rows per source and shard, however many blocks there are.
3. Selection. A shard's documents are laid out in seeded order and cut into equal blocks. A quota of whole passes takes every
   word so often; what is left of it takes the blocks that come first in a seeded permutation of the shard's blocks.

A shard holds about shard_rows documents of all sources, so a source with a third of all rows is spread over all shards, and their
number grows with the corpus.

Null text and empty text have size 0 and are never taken; a null source is a source of its own. Null ids take part. Rows that repeat
are rows of their own; only those with one id and one text share a shard. A very long text is many blocks of its shard. An empty table
gives an empty mix. Ties in quotients go to the smaller source or shard. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brightcask.llm.common import dropped, staged, text_mark, whole_row, word_count

#: A prime above any number of blocks of a shard, hence coprime to it: b -> b * STEP + start is a permutation of the blocks.
STEP = 2147483647


def source_targets(sizes: DataFrame, weights: Sequence[int] = (1, 2, 3), max_repeats: int = 3) -> DataFrame:
    """sizes: (key, source, source_size), a row per source. Adds weight and target.

    Sources are filled in the order of their limit per unit of weight; those before the first whose share fits are full.
    The windows without a key see one row per source, not per document.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((rank - 1) % len(weights) + 1).cast("int"))
    t = sizes.withColumn("weight", weight.cast("double")).withColumn("cap", F.col("source_size") * F.lit(float(max_repeats)))
    t = t.withColumn("fill", F.col("cap") / F.col("weight"))
    every, before = Window.partitionBy(), Window.orderBy("fill", "key").rowsBetween(Window.unboundedPreceding, -1)
    sum_before = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0.0))
    t = t.withColumn("level", (F.sum(F.col("source_size").cast("double")).over(every) - sum_before("cap")) / (F.sum("weight").over(every) - sum_before("weight")))
    level = F.min(F.when(F.col("fill") >= F.col("level"), F.struct("fill", "key", "level"))).over(every)["level"]
    return t.withColumn("target", F.least(F.col("cap"), F.col("weight") * level)).select("key", "source", "source_size", "weight", "target")


def apportion(parties: DataFrame, group: Sequence[str], party: str, votes: str, seats: str) -> DataFrame:
    """parties with won: the seats that Sainte-Lague's method gives each party of a group by its votes.

    With n parties, V votes and N seats, all quotients above V / (N - n/2) win and none below V / (N + n/2) does. Between
    the two lie about two quotients per party; those alone are ranked. A group's parties meet in one task, sorted once.
    """
    of = Window.partitionBy(*group)
    p = parties.withColumns({"_n": F.count(F.lit(1)).over(of), "_v": F.sum(F.col(votes).cast("double")).over(of)})
    bound = lambda side, step: F.when(F.col("_v") > 0, F.greatest(F.lit(0.0), F.floor(F.col(votes) * (F.col(seats) + side * F.col("_n") / 2) / F.col("_v") + 0.5) + step)).otherwise(0).cast("long")
    p = p.withColumns({"_sure": bound(-1, -1), "_top": bound(1, 1)})
    p = p.withColumn("_left", F.col(seats) - F.sum("_sure").over(of))
    contested = F.when((F.col("_v") > 0) & (F.col(votes) > 0) & (F.col("_left") > 0), F.transform(F.sequence("_sure", "_top"), lambda k: F.col(votes) / (2 * k + 1)))
    p = p.select(*parties.columns, "_sure", "_left", F.explode_outer(contested).alias("_q"))
    ranked = p.withColumn("_r", F.row_number().over(of.orderBy(F.desc_nulls_last("_q"), party)))
    won = F.first("_sure") + F.count_if(F.col("_q").isNotNull() & (F.col("_r") <= F.col("_left")))
    keys = [*group, party]
    return ranked.groupBy(*keys).agg(*[F.first(c).alias(c) for c in parties.columns if c not in keys], won.alias("won")).select(*parties.columns, "won")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *, weights: Sequence[int] = (1, 2, 3), max_repeats: int = 3, block_words: int = 128, shard_rows: int = 2000, wing_shards: int = 1024, seed: int = 7) -> DataFrame:
    """One row per row of docs: id_col, size, source_size, target, taken (words of it in the mix, repeats counted)."""
    laid = laid_out(docs, id_col, text_col, source_col, weights, max_repeats, block_words, shard_rows, wing_shards, seed)
    return laid.select(F.col("id").alias(id_col), "size", "source_size", "target", "taken")


def source_key(source: Column) -> Column:
    return F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source.cast("string")))


def laid_out(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: Sequence[int], max_repeats: int, block_words: int, shard_rows: int, wing_shards: int, seed: int) -> DataFrame:
    """(id, mark, key, size, source_size, target, taken) of each row of docs; mark stands for its text, key for its source."""
    slim = docs.select(F.col(id_col).alias("id"), text_mark(F.col(text_col)).alias("mark"), F.col(source_col).cast("string").alias("source"), source_key(F.col(source_col)).alias("key"), word_count(F.col(text_col)).alias("size"))
    slim = staged(slim, "sizes")
    shards = max(1, -(-slim.count() // shard_rows))
    slim = slim.withColumn("draw", F.xxhash64("id", "mark", F.lit(seed))).withColumn("shard", F.pmod(F.xxhash64("draw", "size"), F.lit(shards)))
    held = staged(slim.groupBy("key", "shard").agg(F.first("source").alias("source"), F.sum("size").alias("held")).withColumn("wing", F.expr(f"shard div {wing_shards}")), "shards")
    wings = held.groupBy("key", "wing").agg(F.first("source").alias("source"), F.sum("held").alias("wing_held"))
    sources = source_targets(wings.groupBy("key").agg(F.first("source").alias("source"), F.sum("wing_held").alias("source_size")), weights, max_repeats)
    seats = F.round(F.sum("target").over(Window.partitionBy()) / block_words).cast("long")
    sources = apportion(sources.withColumn("all", F.lit(0)).withColumn("seats", seats), ["all"], "key", "target", "seats").select("key", "source_size", "target", F.col("won").alias("blocks"))
    sources = staged(sources, "sources")
    wings = apportion(wings.drop("source").join(sources, "key"), ["key"], "wing", "wing_held", "blocks")
    shared = held.drop("source").join(wings.select("key", "wing", "source_size", "target", F.col("won").alias("blocks")), ["key", "wing"])
    quota = apportion(shared, ["key", "wing"], "shard", "held", "blocks")
    quota = quota.withColumn("quota", F.least(F.col("won"), F.floor(F.lit(max_repeats) * F.col("held") / block_words)).cast("long")).withColumn("full", F.expr(f"held div {block_words}"))
    passes = F.when(F.col("held") == 0, 0).when(F.col("full") == 0, F.least(F.lit(max_repeats), F.round(F.col("won") * block_words / F.col("held")))).otherwise(F.floor(F.col("quota") * block_words / F.col("held"))).cast("long")
    quota = quota.withColumn("passes", passes)
    rest = F.round((F.col("quota") * block_words - F.col("passes") * F.col("held")) / block_words)
    quota = quota.withColumn("drawn", F.when((F.col("full") == 0) | (F.col("passes") >= max_repeats), 0).otherwise(F.least(F.col("full"), rest)).cast("long"))
    quota = staged(quota.select("key", "shard", "source_size", "target", "full", "passes", "drawn", F.pmod(F.xxhash64("key", "shard", F.lit(seed)), F.greatest("full", F.lit(1))).alias("turn")), "quotas")
    dropped(sources, held)

    end = F.sum("size").over(Window.partitionBy("key", "shard").orderBy("draw", "id", "mark").rowsBetween(Window.unboundedPreceding, 0))
    laid = slim.withColumn("end", end).join(quota, ["key", "shard"])
    return laid.select("id", "mark", "key", "size", "source_size", "target", _taken(block_words).alias("taken"))


def _taken(block_words: int) -> Column:
    """Words that the mix takes of the document at [end - size, end) of its shard."""
    return F.expr(f"""size * passes + if(drawn = 0 or size = 0, 0L, aggregate(
        sequence((end - size) div {block_words}, (end - 1) div {block_words}), 0L,
        (sum, b) -> sum + if(b < full and pmod(b * {STEP}L + turn, full) < drawn,
                             least(end, (b + 1) * {block_words}) - greatest(end - size, b * {block_words}), 0L)))""")


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *, weights: Sequence[int] = (1, 2, 3), max_repeats: int = 3, block_words: int = 128, shard_rows: int = 2000, wing_shards: int = 1024, seed: int = 7) -> DataFrame:
    """The rows of docs, each as often as the mix takes it: whole documents, the odd part of one taken with that chance, by a seeded draw.

    A row is known by its id, its text's hash and its source, so null and repeated ids have shares and draws of their own. Rows that are
    alike in all three share their words; each draws by its place in the input as well.
    """
    laid = laid_out(docs, id_col, text_col, source_col, weights, max_repeats, block_words, shard_rows, wing_shards, seed)
    share = laid.groupBy("id", "mark", F.col("key").alias("of")).agg((F.sum("taken") / F.greatest(F.sum("size"), F.lit(1))).alias("_share"), F.count(F.lit(1)).alias("_alike"))
    rows = whole_row(docs, key=docs[id_col], text=text_mark(docs[text_col]), source=source_key(docs[source_col]), place=F.monotonically_increasing_id())
    draw = F.xxhash64("key", "text", "source", F.when(F.col("_alike") > 1, F.col("place")).otherwise(0), F.lit(seed + 1))
    times = F.floor(F.col("_share") + F.pmod(draw, F.lit(1 << 20)) / (1 << 20)).cast("int")
    met = rows.join(share, F.col("key").eqNullSafe(F.col("id")) & (F.col("text") == F.col("mark")) & (F.col("source") == F.col("of")))
    return met.withColumn("times", times).filter("times > 0").select("row", F.explode(F.sequence(F.lit(1), "times"))).select("row.*")
