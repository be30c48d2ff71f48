"""Mix sources to target weights: blocks of equal size go to sources by highest quotients.

The word mass of the corpus is cut into blocks. Sainte-Laguë apportionment
(quotients weight / (2k + 1)) gives every source a whole number of blocks and, in
the same way, every shard of a source its part of them. A shard lays its documents
end to end in a seeded order and takes a run of blocks from a seeded start: whole
rounds first, then part of one.

Defined results: null text has no words; null is a source of its own, ordered
last; documents without words, and sources without any, take nothing; rows with
the same id are separate rows; an empty table gives an empty mix. Only the id,
source and text columns are read, so other columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.llm.text import count_blank_words, saved

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
PRECISION = 0.001  # a block is at most this part of the smallest target
MAX_BLOCK = 1024
SHARD_ROWS = 4096  # documents expected in a shard


def _digest(seed: int, *parts: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)))


def _digest_mod(digest: Column, n: Column) -> Column:
    """The first 15 hexadecimal digits, below ``n``."""
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") % n


def _target_weights(totals: DataFrame, weights: tuple[int, ...], max_repeats: int) -> DataFrame:
    """Weight by code-point order and the target after resharing; one row per source.

    The level that fills all targets is the largest of the levels reached by
    stopping the k sources with the smallest limit per weight, over all k.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    cycle = F.array(*(F.lit(float(w)) for w in weights))
    ranked = totals.withColumn("weight", F.element_at(cycle, (F.row_number().over(by_name) - 1) % len(weights) + 1))
    limit = (F.col("source_size") * max_repeats).cast("double")
    by_limit = Window.orderBy(limit / F.col("weight"), F.col("source").isNull(), "source")
    before = F.coalesce(F.sum(limit).over(by_limit.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    after = F.sum("weight").over(by_limit.rowsBetween(0, Window.unboundedFollowing))
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything) - before) / after
    return (ranked.withColumn("level", level)
            .withColumn("target", F.least(limit, F.max("level").over(everything) * F.col("weight")))
            .drop("level"))


def highest_quotients(rows: DataFrame, group: list[str], key: list[str], weight: str, seats: Column,
                      limit: Column) -> DataFrame:
    """Add ``quota``: the seats of each row when ``seats`` go to the highest quotients of its group.

    All seats that a too large divisor gives out are certain; only the few
    quotients between it and a too small divisor are ranked. ``key`` breaks ties,
    ``limit`` is the most a row can take.
    """
    whole = Window.partitionBy(*group)
    n = F.count(F.lit(1)).over(whole)
    total = F.sum(F.col(weight)).over(whole).cast("double")
    share = F.when(total > 0, F.col(weight) / total).otherwise(0.0)
    sure = F.floor(share * F.greatest(seats - n / 2, F.lit(0.0)) + 0.5)
    most = F.floor(share * (seats + n * 1.5 + 1) + 0.5)
    bounded = (rows.withColumn("__seats", seats).withColumn("__limit", limit)
               .withColumn("__low", F.when(seats > n / 2, F.least(sure, "__limit")).otherwise(F.lit(0)).cast("long"))
               .withColumn("__high", F.least(most, "__limit").cast("long"))
               .withColumn("__left", F.col("__seats") - F.sum("__low").over(whole)))
    open_seats = bounded.filter("__high > __low").select(
        *group, *key, weight, "__left", F.explode(F.sequence(F.col("__low"), F.col("__high") - 1)).alias("__k"))
    best = Window.partitionBy(*group).orderBy(
        (F.col(weight) / (2 * F.col("__k") + 1)).desc(), *key, "__k")
    won = (open_seats.withColumn("__rank", F.row_number().over(best)).filter("__rank <= __left")
           .groupBy(*group, *key).agg(F.count(F.lit(1)).alias("__won")))
    left, right = bounded.alias("l"), won.alias("r")
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in [*group, *key]]
    return left.join(right, same, "left").select(
        *(F.col(f"l.{c}") for c in rows.columns),
        (F.col("l.__low") + F.coalesce("r.__won", F.lit(0))).alias("quota"))


def mix(spark: SparkSession, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
        source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS,
        precision: float = PRECISION, shard_rows: int = SHARD_ROWS, seed: int = 7) -> DataFrame:
    """One row per document: its size, its source's size and target, and the words the mix takes of it."""
    sizes = saved(docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), count_blank_words(F.col(text_col)).alias("size"),
    ), spark, "mix-sizes")

    totals = sizes.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_rows"))
    targets = _target_weights(totals, weights, max_repeats)
    everything = Window.partitionBy()
    smallest = F.min(F.when(F.col("target") > 0, F.col("target"))).over(everything)
    targets = targets.withColumn("block", F.coalesce(
        F.least(F.greatest(F.floor(smallest * precision), F.lit(1)), F.lit(MAX_BLOCK)), F.lit(1)).cast("long"))
    targets = targets.withColumn("everything", F.floor(F.sum("source_size").over(everything) / F.col("block")))
    targets = highest_quotients(
        targets.withColumn("all", F.lit(1)).withColumn("unnamed", F.col("source").isNull()), ["all"], ["unnamed", "source"],
        "target", F.col("everything"), F.floor(F.col("source_size") * max_repeats / F.col("block")))
    targets = saved(targets.select(
        "source", "source_size", "target", "block", F.col("quota").alias("source_quota"),
        F.ceil(F.col("source_rows") / shard_rows).alias("shards")), spark, "mix-sources")

    digest = _digest(seed, F.col("doc_id"))
    dealt = (sizes.alias("d").join(targets.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source")))
             .select("d.doc_id", "d.source", "d.size", "t.block", "t.source_quota", "t.source_size", "t.target",
                     digest.alias("digest"), _digest_mod(digest, F.col("t.shards")).alias("shard")))
    shards = dealt.groupBy("source", "shard", "block", "source_quota").agg(F.sum("size").alias("words"))
    blocks = F.ceil(F.col("words") / F.col("block"))
    shards = highest_quotients(shards, ["source"], ["shard"], "words", F.col("source_quota"), blocks * max_repeats)
    shards = saved(shards.filter("words > 0").select(
        "source", "shard", "words", blocks.alias("blocks"), "quota",
        _digest_mod(_digest(seed, F.col("source"), F.col("shard")), blocks).alias("first")), spark, "mix-shards")

    in_order = (Window.partitionBy("source", "shard").orderBy("digest", "doc_id", "size")
                .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = dealt.withColumn("stop", F.sum("size").over(in_order)).alias("p").join(
        shards.alias("s"), F.col("p.source").eqNullSafe(F.col("s.source")) & (F.col("p.shard") == F.col("s.shard")), "left")
    start, stop, block = F.col("p.stop") - F.col("p.size"), F.col("p.stop"), F.col("p.block")

    def inside(low: Column, high: Column) -> Column:
        return F.greatest(F.least(stop, high) - F.greatest(start, low), F.lit(0))

    rounds, part = F.floor(F.col("s.quota") / F.col("s.blocks")), F.col("s.quota") % F.col("s.blocks")
    end = F.col("s.first") + part
    run = inside(F.col("s.first") * block, F.least(end * block, F.col("s.words")))
    wrapped = inside(F.lit(0), F.greatest(end - F.col("s.blocks"), F.lit(0)) * block)
    taken = F.coalesce(rounds * F.col("p.size") + run + wrapped, F.lit(0)).cast("long")
    return placed.select("p.doc_id", "p.source", "p.size", "p.source_size", "p.target", taken.alias("taken"))
